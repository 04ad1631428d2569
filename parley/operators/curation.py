"""Splits, caps and samples that turn examples into train, valid and test sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import turns as X
from parley.operators.ordered import running, sliced
from parley.operators.tapbacks import not_tapback
from parley.plans.scratch import arrow_batches, save

TRAIN, VALID = 0.80, 0.10
MAX_COPIES, MAX_SHORT_COPIES = 4, 2
HALF_LIFE_DAYS, FLOOR, LEAST_KEPT = 365.0, 0.15, 8
CHUNK, SKIPPED = 80, 10
#: Sessions whose sizes one task deals.
DEAL_SESSIONS = 1_000_000
_DENSE = 1_000_000


def unit_hash(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of the columns: a repeatable draw."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(_DENSE)) / _DENSE


def reject_reason(reply: Column, messages: Column, most_tokens: int = X.MAX_TOKENS) -> Column:
    """Why an example is refused, in order; null if it is kept."""
    fitted = X.fit_messages(messages, most_tokens)
    return (
        F.when(T.is_media_only(reply), "media_only")
        .when(T.is_link_only(reply), "link_only")
        .when(T.contains_redaction(T.redact(reply)), "redacted")
        .when(fitted.isNull(), "too_long")
        .when(~X.is_alternating(fitted), "not_alternating")
    )


def reject_counts(examples: DataFrame) -> DataFrame:
    reason = F.coalesce(reject_reason(F.col("reply"), F.col("messages")), F.lit("kept"))
    return examples.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def split_chrono(examples: DataFrame, session: list[str], sec: str = "sec", train: float = TRAIN, valid: float = VALID) -> DataFrame:
    """Add split: whole sessions by the time of their first example; the oldest train.

    Fewer than ten sessions still get one each for valid and test where there are three.
    """
    units = examples.groupBy(*session).agg(F.min(sec).alias("at"))
    ranked = ranked_rows(units, ["at", *session])
    n = F.col("units")
    test, held = F.greatest(F.lit(1), F.bround(n * F.lit(1 - train - valid))), F.greatest(F.lit(1), F.bround(n * F.lit(valid)))
    a = F.when(n >= 10, F.greatest(F.lit(1), n - held - test)).when(n >= 3, n - 2).otherwise(F.greatest(n - 1, F.lit(1)))
    b = F.when(n >= 10, n - test).when(n >= 3, n - 1).otherwise(n)
    split = F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "valid").otherwise("test")
    return examples.join(ranked.select(*session, split.alias("split")), session)


def ranked_rows(units: DataFrame, order: list[str]) -> DataFrame:
    """rank from 1 in a global order, and units, their number; cut into ranges of about equal size, so no task sees them all."""
    rows = sliced(units, [], order)
    sizes = rows.groupBy("_slice").agg(F.count("*").alias("_n"))  # a row for each range
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "units": F.sum("_n").over(Window.partitionBy(F.lit(1)))})
    inner = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return rows.withColumn("_inner", inner).join(F.broadcast(sizes), "_slice").withColumn("rank", F.col("_before") + F.col("_inner")).drop("_slice", "_n", "_before", "_inner")


def chunks(examples: DataFrame, size: int = CHUNK) -> DataFrame:
    """Add chunk and in_chunk: rows of a chat's session in chunks of ``size``, by time."""
    keys, order = ["chat_id", "session_no"], ["sec", "msg_no"]
    rows = running(sliced(examples, keys, order), keys, order, F.lit(1), "_k").drop("_slice")
    k = F.col("_k") - 1
    return rows.withColumns({"chunk": F.floor(k / size).cast("long"), "in_chunk": (k % size).cast("int")}).drop("_k")


def deal(sizes: Iterator[int], have: dict[str, int], want: dict[str, float]) -> Iterator[str]:
    """The split of each chunk: the one that lacks the largest part of its quota, train before valid before test; ``have`` is brought up to date."""
    for n in sizes:
        name = max(want, key=lambda s: (want[s] - have[s]) / max(1.0, want[s]))
        have[name] += n
        yield name


def split_stratified(examples: DataFrame, train: float = TRAIN, valid: float = VALID, at_once: int = DEAL_SESSIONS) -> DataFrame:
    """Add split: sessions are cut into chunks, and those, oldest first, dealt to the split furthest below its quota of rows.

    So the held-out rows are spread over the whole history. The first rows of a chunk whose previous chunk is in another split are dropped, as
    their context is there. Fewer than ten sessions are split by time. Each deal depends on those before: it runs over the sizes of sessions,
    ``at_once`` of them in a task, and what each split has got so far (three numbers) goes on to the next task.
    """
    keys = ["chat_id", "session_no"]
    sessions = examples.groupBy(*keys).agg(F.min("sec").alias("at"), F.count("*").alias("n"))
    ranked = save(ranked_rows(sessions, ["at", *keys]).select("rank", F.col("chat_id").cast("long"), F.col("session_no").cast("long"), "n"), "ranked-sessions")
    many, total = ranked.agg(F.count("*"), F.sum("n")).first()
    if many < 10:
        return split_chrono(examples, keys, train=train, valid=valid)
    want = {"train": train * total, "valid": valid * total, "test": max(0.0, 1 - train - valid) * total}
    have, dealt = dict.fromkeys(want, 0), None
    arrow_batches(examples.sparkSession)
    for first in range(1, many + 1, at_once):
        part = ranked.where(F.col("rank").between(first, first + at_once - 1)).coalesce(1).sortWithinPartitions("rank")
        done = save(part.mapInPandas(_dealer(dict(have), want), "chat_id long, session_no long, chunk long, split string, previous string, k long, train long, valid long, test long"), "dealt")
        have = done.orderBy(F.desc("k")).select(*have).first().asDict()
        dealt = done if dealt is None else dealt.unionByName(done)
    cut = (F.col("in_chunk") < SKIPPED) & (F.col("previous") != F.col("split"))
    rows = chunks(examples).join(dealt.drop("k", *want), [*keys, "chunk"])
    return rows.where(F.coalesce(~cut, F.lit(True))).drop("previous", "in_chunk")


def _dealer(have: dict[str, int], want: dict[str, float], size: int = CHUNK) -> Callable:
    """A function that deals the chunks of sessions (rank, chat_id, session_no, n) and tells what each split has got after each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, out = 0, []
        for b in batches:
            for chat, session, n in b[["chat_id", "session_no", "n"]].itertuples(index=False):
                before = None
                sizes = (min(size, n - s) for s in range(0, n, size))
                for chunk, name in enumerate(deal(sizes, have, want)):
                    k += 1
                    out.append((chat, session, chunk, name, before, k, *have.values()))
                    before = name
                    if len(out) >= 50_000:
                        yield pd.DataFrame(out, columns=_DEALT)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=_DEALT)

    return run


_DEALT = ["chat_id", "session_no", "chunk", "split", "previous", "k", "train", "valid", "test"]


def cap_duplicates(examples: DataFrame, reply: str = "reply", order: tuple[str, str] = ("sec", "msg_no"), most: int = MAX_COPIES, most_short: int = MAX_SHORT_COPIES) -> DataFrame:
    """The newest few of each identical reply, fewer of those that only acknowledge."""
    w = Window.partitionBy(reply).orderBy(F.desc(order[0]), F.desc(order[1]))
    cap = F.when(T.is_low_signal(F.col(reply)), most_short).otherwise(most)
    return examples.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")


def cap_low_signal_share(examples: DataFrame, share: float, reply: str = "reply", order: tuple[str, str] = ("sec", "msg_no")) -> DataFrame:
    """Keep the newest acknowledgements, so that they are at most ``share`` of what is left."""
    rows = examples.withColumn("_low", T.is_low_signal(F.col(reply)))
    rich = rows.where(~F.col("_low"))
    room = rich.count()
    allowed = int(share * room / (1 - share)) if share < 1 else None
    low = rows.where("_low")
    if allowed is None:
        return rows.drop("_low")
    newest = ranked_rows(low.withColumns({"_at": -F.col(order[0]), "_tie": -F.col(order[1])}), ["_at", "_tie"])
    return rich.unionByName(newest.where(F.col("rank") <= allowed).select(*rich.columns)).drop("_low")


def recency_weight(age_days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def downsample_recency(examples: DataFrame, key: list[str], sec: str = "sec", floor: float = FLOOR, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """Keep each row with probability max(floor, half-life weight) of its age, by a repeatable draw.

    If fewer than eight rows, or than a fifth, would be left, all stay.
    """
    newest = examples.agg(F.max(sec).alias("newest"), F.count("*").alias("rows"))
    rows = examples.crossJoin(F.broadcast(newest))  # one row
    keep = unit_hash(*key) <= F.greatest(F.lit(floor), recency_weight((F.col("newest") - F.col(sec)) / 86400.0, half_life))
    rows = rows.withColumn("_keep", keep)
    left = rows.agg(F.count_if("_keep").alias("left"))
    few = F.col("left") < F.greatest(F.lit(LEAST_KEPT), F.floor(F.col("rows") / 5))
    return rows.crossJoin(F.broadcast(left)).where(F.col("_keep") | few).drop("newest", "rows", "_keep", "left")


def sample(rows: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by a hash of their key: a longer sample begins with a shorter one."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def depth_sample(examples: DataFrame, key: list[str], depth: Column, buckets: tuple[int, ...] = (2, 3, 4, 6), most: int = 40) -> DataFrame:
    """Up to ``most`` examples at least as deep as each bucket, none used twice; deeper buckets take what shallower ones left."""
    left, out = examples.withColumn("depth", depth), None
    for b in buckets:
        taken = sample(left.where(F.col("depth") >= b), key, most, b).withColumn("bucket", F.lit(b))
        out = taken if out is None else out.unionByName(taken)
        left = left.join(taken.select(*key), key, "left_anti")
    return out


def target_concentration(examples: DataFrame, reply: str = "reply", top: int = 20) -> DataFrame:
    """One row: different replies, and the share of the most common ones."""
    each = examples.groupBy(reply).agg(F.count("*").alias("n"))
    most = each.orderBy(F.desc("n"), reply).limit(top).agg(F.sum("n").alias("top"))
    return each.agg(F.count("*").alias("unique"), F.sum("n").alias("total")).crossJoin(F.broadcast(most)).select("unique", (F.col("top") / F.col("total")).alias("top_share"))


def low_signal_share(examples: DataFrame, reply: str = "reply") -> DataFrame:
    return examples.agg(F.count("*").alias("n"), F.count_if(T.is_low_signal(F.col(reply))).alias("low"))


def first_chat(messages: DataFrame, chat_rank: DataFrame) -> DataFrame:
    """Each message once, in the first of its chats by rank (columns msg_id, chat_id, rank)."""
    rows = messages.join(chat_rank, "chat_id")
    w = Window.partitionBy("msg_id").orderBy("rank", "chat_id")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def profile(messages: DataFrame, members: DataFrame, voice: Column | None = None, handles: Sequence | None = None) -> DataFrame:
    """One row about what a dataset could be made of; no text leaves it.

    ``messages``: id, kind, is_from_me, text, ts and what ``voice``, the messages that are learnt from, reads (default: mine). Tapbacks do not count,
    and a message in several chats counts once. Received messages count if they have text; those of the voice without text are attachments.
    Chats (``members``: chat_id, handle) with one other person are direct ones; with ``handles``, only chats of these people count.
    """
    rows = messages.where(not_tapback(F.col("kind"))).dropDuplicates(["id"])
    voice = F.col("is_from_me") == 1 if voice is None else voice
    blank = T.strip(T.text_or_empty(F.col("text"))) == ""
    told = rows.agg(
        F.count_if(voice).alias("sent"), F.count_if(voice & ~blank).alias("sent_text"), F.count_if(~voice & ~blank).alias("received_text"),
        F.count_if(voice & blank).alias("attachment_only"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    chats = members if handles is None else members.join(members.where(F.col("handle").isin(*handles)).select("chat_id").distinct(), "chat_id", "left_semi")
    sizes = chats.groupBy("chat_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") == 1).alias("direct_chats"), F.count_if(F.col("n") > 1).alias("group_chats"))
    return told.crossJoin(F.broadcast(sizes))  # one row each
