"""Conversation turns, sessions, context windows and training examples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.ordered import previous, running, sliced

TURN_GAP_SECONDS, SESSION_GAP_SECONDS, CONTEXT_TURNS, MAX_TOKENS = 30 * 60, 12 * 3600, 10, 768
#: Turns of a chat in one slice: no task sorts more of a chat at once.
SLICE_TURNS = 10_000


def collapse_turns(bubbles: DataFrame, gap_seconds: int = TURN_GAP_SECONDS, by: Sequence[str] = ("role",), by_time: Sequence[str] = ("msg_no",)) -> DataFrame:
    """(chat_id, turn_no, role, content, sec, msg_no, and what else ``by`` names): consecutive bubbles of one sender, at most the gap apart, as one turn.

    Bubbles follow one another in the order of ``by_time``. Blank ones are skipped. A missing time does not part bubbles. A turn has the
    time and number of its last bubble.
    """
    chat, order = ["chat_id"], list(by_time)
    rows = sliced(bubbles.where(T.strip(T.text_or_empty(F.col("text"))) != ""), chat, order)
    rows = previous(rows, chat, order, list(dict.fromkeys(["msg_no", "sec", *by])))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"prev_{c}").eqNullSafe(F.col(c))
    near = F.coalesce(F.col("sec") - F.col("prev_sec") <= gap_seconds, F.lit(True))
    rows = running(rows, chat, order, (F.col("prev_msg_no").isNull() | ~(same & near)).cast("int"), "turn_no")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("text").alias("t")))), lambda x: x["t"])
    last = lambda c: F.max_by(c, F.struct(*order)).alias(c)
    more = [F.first(c).alias(c) for c in by if c != "role"]
    return rows.groupBy("chat_id", "turn_no").agg(F.first("role").alias("role"), F.array_join(parts, T.BUBBLE).alias("content"), last("sec"), last("msg_no"), *more)


def sessionize(turns: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Add session_no: a pause of more than the gap between turns' (last) times starts a new session."""
    chat, order = ["chat_id"], ["turn_no"]
    rows = previous(turns.withColumn("_slice", _slice()), chat, order, ["sec"])
    fresh = F.coalesce((F.col("sec") - F.col("prev_sec") > gap_seconds).cast("int"), F.lit(0))
    return running(rows, chat, order, fresh, "session_no").withColumn("session_no", F.col("session_no") + 1).drop("prev_sec", "_slice")


def _slice() -> Column:
    return F.floor(F.col("turn_no") / SLICE_TURNS)


def merge_roles(messages: Column) -> Column:
    """Adjacent messages of one role as one (their contents joined as bubbles), without leading messages that are no user's."""
    zero = F.array().cast("array<struct<role:string,content:string>>")

    def add(done: Column, m: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(m["role"].alias("role"), F.concat(last["content"], F.lit(T.BUBBLE), m["content"]).alias("content"))
        one = F.struct(m["role"].alias("role"), m["content"].alias("content"))
        return (
            F.when((F.size(done) == 0) & (m["role"] != "user"), done)
            .when((F.size(done) > 0) & (last["role"] == m["role"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))
            .otherwise(F.concat(done, F.array(one)))
        )

    return F.aggregate(messages, zero, add)


def is_alternating(messages: Column) -> Column:
    """user, assistant, user, ... and an assistant at the end; system messages do not count."""
    messages = F.filter(messages, lambda m: m["role"] != "system")
    n = F.size(messages)
    steps = F.when(n > 1, F.forall(F.sequence(F.lit(1), n - 1), lambda i: F.get(messages, i)["role"] != F.get(messages, i - 1)["role"])).otherwise(True)
    return (n > 0) & (F.get(messages, F.lit(0))["role"] == "user") & (F.try_element_at(messages, F.lit(-1))["role"] == "assistant") & steps


def system_part(messages: Column) -> Column:
    """The system message that a chat begins with, as an array of one or none."""
    return F.filter(F.slice(messages, 1, 1), lambda m: m["role"] == "system")


def body_part(messages: Column) -> Column:
    n = F.size(system_part(messages))
    return F.slice(messages, n + 1, F.size(messages))


def _windows(sessions: DataFrame, turns: int) -> DataFrame:
    """Add window, a turn and the ``turns - 1`` before it in its session.

    Turns are numbered one by one, so the last of a slice are all that the next one needs: they are copied there, and no window is longer than a slice.
    """
    late = F.pmod("turn_no", F.lit(SLICE_TURNS)) >= SLICE_TURNS - turns + 1
    copied = sessions.withColumn("_at", F.explode(F.when(late, F.array(_slice(), _slice() + 1)).otherwise(F.array(_slice()))))
    w = Window.partitionBy("chat_id", "session_no", "_at").orderBy("turn_no").rowsBetween(1 - turns, 0)
    return copied.withColumn("window", F.collect_list(F.struct("role", "content")).over(w)).where(F.col("_at") == _slice()).drop("_at")


def context_windows(sessions: DataFrame, turns: int = CONTEXT_TURNS) -> DataFrame:
    """One row for each assistant turn with a valid context: the turns before it in its session, merged by role, ending with a user.

    Columns: chat_id, session_no, turn_no, sec, msg_no, messages, query, reply.
    """
    rows = _windows(sessions, turns).where("role = 'assistant'")
    context = F.slice("window", 1, F.size("window") - 1)
    rows = rows.withColumn("context", merge_roles(context))
    rows = rows.where((F.size("context") > 0) & (F.try_element_at("context", F.lit(-1))["role"] == "user"))
    reply = F.array(F.struct("role", "content"))
    return rows.select("chat_id", "session_no", "turn_no", "sec", "msg_no", F.concat("context", reply).alias("messages"), F.try_element_at("context", F.lit(-1))["content"].alias("query"), F.col("content").alias("reply"))


def laddered_windows(sessions: DataFrame, turns: int = CONTEXT_TURNS, ladder: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """As ``context_windows``, and for each reply a second, shallower context whose depth steps through the ladder; equal ones once."""
    own = sessions.where("role = 'assistant'").select("chat_id", "session_no", "turn_no", _slice().alias("_slice"))
    own = running(own, ["chat_id", "session_no"], ["turn_no"], F.lit(1), "k").withColumn("k", F.col("k") - 1).drop("_slice")
    full = context_windows(sessions, turns).join(own, ["chat_id", "session_no", "turn_no"])
    steps = F.array(*(F.lit(x + 1) for x in ladder))
    depth = F.try_element_at(steps, (F.col("k") % len(ladder) + 1).cast("int"))
    shallow = full.withColumn("messages", merge_roles(F.slice("messages", -F.least(depth, F.size("messages")), F.least(depth, F.size("messages")))))
    shallow = shallow.where(is_alternating(F.col("messages")))
    return full.unionByName(shallow).drop("k").dropDuplicates(["chat_id", "session_no", "turn_no", "messages"])


def openers(sessions: DataFrame, turns: int = CONTEXT_TURNS, prompt: str = "Send a natural text to continue or open this conversation.") -> DataFrame:
    """Assistant turns without a valid context, paired with a prompt."""
    valid = context_windows(sessions, turns).select("chat_id", "turn_no")
    rows = sessions.where("role = 'assistant'").join(valid, ["chat_id", "turn_no"], "left_anti")
    ask = F.struct(F.lit("user").alias("role"), F.lit(prompt).alias("content"))
    return rows.select("chat_id", "session_no", "turn_no", "sec", "msg_no", F.array(ask, F.struct("role", "content")).alias("messages"), F.col("content").alias("reply"))


def rendered_length(messages: Column) -> Column:
    """Tokens of a rendered chat, at four characters each."""
    text = F.array_join(F.transform(messages, lambda m: m["content"]), "\n")
    return F.floor((F.char_length(text) + 3) / 4)


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that it reads more than once, computed once: a column that is named several times, or in a lambda, is computed each time."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def fit_messages(messages: Column, most: int = MAX_TOKENS) -> Column:
    """Drop the oldest context, but not a system message, until the chat fits and begins with a user; null if even the last exchange does not."""
    return once(messages, lambda m: once(system_part(m), lambda system: once(body_part(m), lambda body: _fit(system, body, most))))


def _fit(system: Column, body: Column, most: int) -> Column:
    n = F.size(body)
    lines = lambda a: F.transform(a, lambda m: F.coalesce(F.char_length(m["content"]) + 1, F.lit(0)))  # noqa: E731  (each with the line break behind it)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    rest = lambda a, i: F.slice(a, i, n - i + 1)
    tokens = lambda chars: F.floor((F.greatest(chars - 1, F.lit(0)) + 3) / 4)  # noqa: E731  (as ``rendered_length``)
    fits = lambda sizes, room, i: (F.try_element_at(body, i)["role"] == "user") & (tokens(room + total(rest(sizes, i))) <= most)
    starts = once(lines(body), lambda sizes: once(total(lines(system)), lambda room: F.filter(F.sequence(F.lit(1), n - 1), lambda i: fits(sizes, room, i))))
    return once(F.when(n >= 2, starts), lambda s: F.when(F.size(s) > 0, F.concat(system, rest(body, F.try_element_at(s, F.lit(1))))))


def last_of(messages: Column, role: str) -> Column:
    """The content of the last message of a role, or the empty text."""
    own = F.filter(messages, lambda m: m["role"] == role)
    return F.when(F.size(own) > 0, F.try_element_at(own, F.lit(-1))["content"]).otherwise("")


def few_shot(pairs: Column) -> Column:
    """(query, reply) pairs as alternating messages."""
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.flatten(F.transform(pairs, lambda p: F.array(msg("user", p["query"]), msg("assistant", p["reply"]))))
