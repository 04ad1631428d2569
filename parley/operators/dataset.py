"""From a message archive to training examples: who is imitated, which messages count, examples with counters, and the exported folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.chat import opener_prompt, peer_label, system_prompt
from parley.operators import curation, retrieval, turns
from parley.operators.ordered import running, sliced
from parley.operators.tapbacks import not_tapback
from parley.plans.scratch import save
from parley.sources import jsonl

ME = "me"


def subjects(messages: DataFrame, people: DataFrame) -> DataFrame:
    """(person, handle, handles, texts): me first in spirit (person ``me``, no handle, what I sent), then each person with what they sent.

    ``people`` has handle, person and name; a person's handle is the one they write from most, ties to the smaller. Handles without a person are left out.
    """
    real = messages.where(not_tapback(F.col("kind")))
    mine = real.where("is_from_me = 1").agg(F.lit(ME).alias("person"), F.lit(None).cast(messages.schema["handle"].dataType).alias("handle"), F.lit(0).cast("long").alias("handles"), F.count("*").alias("texts"))
    each = real.where("is_from_me = 0").groupBy("handle").agg(F.count("*").alias("n")).join(people.select("handle", F.col("person").cast("string").alias("person")), "handle")
    best = F.max_by("handle", F.struct("n", -F.xxhash64("handle"))) if messages.schema["handle"].dataType.simpleString() == "string" else F.max_by("handle", F.struct("n", -F.col("handle")))
    theirs = each.groupBy("person").agg(best.alias("handle"), F.count("*").alias("handles"), F.sum("n").alias("texts"))
    return mine.unionByName(theirs)


def direct_chats(members: DataFrame) -> DataFrame:
    """(chat_id, handle) of chats with exactly one other participant."""
    return members.groupBy("chat_id").agg(F.count("*").alias("n"), F.min("handle").alias("handle")).where("n = 1").drop("n")


def chat_order(messages: DataFrame, newest_first: bool = False) -> DataFrame:
    """(chat_id, first_ts, last_ts, rank): chats with a message that is no tapback; rank sorts by first message, or by last from the newest."""
    rows = messages.where(not_tapback(F.col("kind"))).groupBy("chat_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return rows.withColumn("rank", -F.unix_micros(F.col("last_ts").cast("timestamp")) if newest_first else F.unix_micros(F.col("first_ts").cast("timestamp")))


def direct_streams(messages: DataFrame, members: DataFrame, people: DataFrame) -> DataFrame:
    """(person, chat_id, handle, ts, is_from_me): messages of one-to-one chats by resolved person, so that a person who changed handles is one stream."""
    owner = direct_chats(members).join(people.select("handle", "person"), "handle", "left").withColumn("person", F.coalesce(F.col("person").cast("string"), F.col("handle").cast("string")))
    return messages.where(not_tapback(F.col("kind"))).drop("handle").join(owner, "chat_id").select("person", "chat_id", "handle", "ts", "id", "is_from_me")


def stream_totals(streams: DataFrame) -> DataFrame:
    """(person, sent, received, handle, first_ts, last_ts); the handle with most messages, ties to the smaller."""
    each = streams.groupBy("person", "handle").agg(
        F.sum("is_from_me").alias("sent"), F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    ranked = each.withColumn("k", F.row_number().over(Window.partitionBy("person").orderBy(F.desc("n"), "handle")))
    return ranked.groupBy("person").agg(
        F.sum("sent").alias("sent"), (F.sum("n") - F.sum("sent")).alias("received"), F.min_by("handle", "k").alias("handle"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )


def is_assistant(person: str | None = None) -> Column:
    """Messages of the voice that is learnt: mine, or those of one person."""
    if person is None or person == ME:
        return F.col("is_from_me") == 1
    return (F.col("is_from_me") == 0) & (F.col("person").cast("string") == person)


def admitted(messages: DataFrame, person: str | None = None) -> DataFrame:
    """Messages that examples are made of, with role and text.

    Tapbacks, unsent messages and artifacts of the messenger are left out; a message without text stands for its attachment, or is left out without one.
    Columns read: kind, is_unsent, has_attachment, text, is_from_me, and person where one is given.
    """
    text = T.text_or_empty(F.col("text"))
    empty = text == ""
    rows = messages.where(not_tapback(F.col("kind")) & (F.coalesce("is_unsent", F.lit(0)) == 0) & ~T.is_artifact(text) & (~empty | (F.coalesce("has_attachment", F.lit(0)) == 1)))
    return rows.withColumns({"role": F.when(is_assistant(person), "assistant").otherwise("user"), "text": F.when(empty, T.MEDIA_MARK).otherwise(text)})


def chat_turns(
    messages: DataFrame, members: DataFrame, person: str | None = None, groups: bool = False, names: DataFrame | None = None, labels: bool = True,
    per_chat: int = 0, newest_first: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(admitted messages, turns with sessions) of chats where the voice speaks; a message in several chats counts in the first of them only.

    ``per_chat`` reads that many of a chat's newest messages (0: all). In group chats the turns of others begin with who sends them, by ``names`` (handle, name) or
    else by handle; those of the voice never do.
    """
    rows = messages if groups else messages.join(direct_chats(members).select("chat_id"), "chat_id", "left_semi")
    if per_chat:
        latest = Window.partitionBy("chat_id").orderBy(F.desc("ts"), F.desc("id"))
        rows = rows.where(not_tapback(F.col("kind"))).withColumn("_k", F.row_number().over(latest)).where(F.col("_k") <= per_chat).drop("_k")
    order = chat_order(messages, newest_first).select("chat_id", "rank")
    sender = F.when(F.col("is_from_me") == 1, "me").otherwise(F.coalesce(F.col("handle").cast("string"), F.lit("user")))
    once = curation.first_chat(admitted(rows, person).withColumn("msg_id", F.col("id")), order).drop("rank")
    once = save(once.withColumns({"sec": F.unix_seconds(F.col("ts").cast("timestamp")), "msg_no": F.col("id"), "sender": sender}), "admitted")
    found = turns.collapse_turns(once, by=("role", "sender"), by_time=("ts", "id"))
    if groups and labels:
        who = group_labels(members, names).select("chat_id", F.col("handle").alias("sender"), "label")
        content = F.when(F.col("role") == "user", T.label_sender(F.col("content"), F.col("label"))).otherwise(F.col("content"))
        found = found.join(who, ["chat_id", "sender"], "left").withColumn("content", content).drop("label")
    found = turns.sessionize(found.drop("sender"))
    voiced = found.where("role = 'assistant'").select("chat_id").distinct()
    return once, save(found.join(voiced, "chat_id", "left_semi"), "turns")


def group_labels(members: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(chat_id, handle string, label) of the members of chats with two or more others: the first word of their name, else of their handle."""
    many = members.where("handle IS NOT NULL").groupBy("chat_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("chat_id")
    rows = members.where("handle IS NOT NULL").join(many, "chat_id", "left_semi").select("chat_id", F.col("handle").cast("string").alias("handle"))
    known = _names(names, rows).join(rows.select("handle").distinct(), "handle", "left_semi")
    return rows.join(known, "handle", "left").select("chat_id", "handle", T.sender_label(F.coalesce("name", "handle")).alias("label"))


def _names(names: DataFrame | None, like: DataFrame) -> DataFrame:
    """(handle string, name) with a name that is not blank."""
    if names is None:
        return like.select(F.col("handle").cast("string").alias("handle"), F.lit("").alias("name")).where("1 = 0")
    return names.select(F.col("handle").cast("string").alias("handle"), T.strip(T.text_or_empty(F.col("name"))).alias("name")).where("name <> ''").dropDuplicates(["handle"])


def peers(members: DataFrame, names: DataFrame | None = None, person: str | None = None) -> DataFrame:
    """(chat_id, peer): whom the voice talks to in a direct chat: the name of the other, or ``this contact``; You, where another person's voice is learnt."""
    direct = direct_chats(members).select("chat_id", F.col("handle").cast("string").alias("handle"))
    if person is not None and person != ME:
        return direct.select("chat_id", F.lit("You").alias("peer"))
    return direct.join(_names(names, direct), "handle", "left").select("chat_id", peer_label(F.col("name")).alias("peer"))


def judged(examples: DataFrame, most_tokens: int = turns.MAX_TOKENS) -> DataFrame:
    """Examples masked and fitted, with the reason why one is refused (null: kept), in this order: media, link, masked, overflow, order of roles."""
    masked = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), T.redact(m["content"]).alias("content")))
    rows = examples.withColumn("_masked", masked).withColumn("_fitted", turns.fit_messages(F.col("_masked"), most_tokens))
    reason = (
        F.when(T.is_media_only(F.col("query")) | T.is_media_only(F.col("reply")), "media")
        .when(T.is_link_only(F.col("reply")), "link")
        .when(T.contains_redaction(F.try_element_at("_masked", F.lit(-1))["content"]), "masked")
        .when(F.col("_fitted").isNull(), "overflow")
        .when(~turns.is_alternating(F.col("_fitted")), "order")
    )
    fitted = F.when(reason.isNull(), F.col("_fitted")).otherwise(F.col("_masked"))
    return rows.withColumns({"reason": reason, "messages": fitted}).drop("_masked", "_fitted").withColumns(
        {"query": F.coalesce(F.try_element_at("messages", F.lit(-2))["content"], "query"), "reply": F.try_element_at("messages", F.lit(-1))["content"]}
    )


def collect_examples(
    messages: DataFrame, members: DataFrame, person: str | None = None, groups: bool = False, ladder: Sequence[int] = (), openers: bool = False,
    name: str | None = None, names: DataFrame | None = None, labels: bool = True, limit: int = 0, per_chat: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(examples, counters): one example for each turn of the voice with a context in its session, and one row that says what became of all turns.

    An example begins with a system message that says whose voice it is (``name``) and, in direct chats, whom it talks to (column peer). With ``limit``, chats
    are taken from the newest on until there are so many examples, and counters speak of these chats only.
    """
    once, found = chat_turns(messages, members, person, groups, names, labels, per_chat, newest_first=limit > 0)
    rows = turns.laddered_windows(found, ladder=ladder) if ladder else turns.context_windows(found)
    rows = rows.withColumn("opener", F.lit(0))
    alone = turns.openers(found, prompt=opener_prompt(name))
    if openers:
        rows = rows.unionByName(alone.withColumns({"query": F.get("messages", F.lit(0))["content"], "opener": F.lit(1)}))
    if groups:
        rows = rows.withColumn("peer", F.lit(""))
    else:
        rows = rows.join(peers(members, names, person), "chat_id", "left").withColumn("peer", F.coalesce("peer", F.lit("")))
    system = F.struct(F.lit("system").alias("role"), system_prompt(F.lit(name).cast("string"), F.col("peer")).alias("content"))
    marked = save(judged(rows.withColumn("messages", F.concat(F.array(system), "messages"))), "judged")
    kept = marked.where("reason IS NULL")
    if limit:
        used = save(_first_chats(kept, found, chat_order(messages, True), limit), "used-chats")
        among = lambda df: df.join(used.select("chat_id"), "chat_id", "left_semi")
        once, found, alone, marked = (among(df) for df in (once, found, alone, marked))
        place = Window.partitionBy("chat_id").orderBy("session_no", "opener", "turn_no", F.desc(F.size("messages")))
        kept = kept.join(used, "chat_id").withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= F.col("_room")).drop("_k", "_room")
    kept = kept.drop("reason", "opener")
    sent = found.where("role = 'assistant'")
    voiced = once.join(found.select("chat_id").distinct(), "chat_id", "left_semi")
    skipped = [F.count_if(F.col("reason") == r).alias(f"skipped_{r}") for r in ("media", "link", "masked", "overflow", "order")]
    parts = [
        found.agg(F.countDistinct("chat_id").alias("chats"), F.countDistinct("chat_id", "session_no").alias("sessions"), F.count_if(F.col("role") == "assistant").alias("sent_turns")),
        voiced.agg(F.count_if((F.col("role") == "assistant") & (F.col("text") != T.MEDIA_MARK)).alias("sent_texts")),
        sent.join(alone.select("chat_id", "turn_no"), ["chat_id", "turn_no"], "left_semi").agg(F.count("*").alias("opener_turns")),
        marked.agg(*skipped, F.count_if(F.col("reason").isNull()).alias("contextual_turns")),
        kept.agg(F.count("*").alias("examples")),
        members.groupBy("chat_id").agg(F.count("*").alias("n")).agg(F.count_if((F.col("n") > 1) & F.lit(not groups)).alias("skipped_groups")),
    ]
    counters = parts[0]
    for part in parts[1:]:
        counters = counters.crossJoin(F.broadcast(part))  # one row each
    return kept, counters


def _first_chats(kept: DataFrame, found: DataFrame, order: DataFrame, limit: int) -> DataFrame:
    """(chat_id, _room): chats by rank until they hold ``limit`` examples, and how many of the last one's are wanted."""
    sizes = kept.groupBy("chat_id").agg(F.count("*").alias("n"))
    chats = found.select("chat_id").distinct().join(sizes, "chat_id", "left").join(order.select("chat_id", "rank"), "chat_id").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = running(sliced(chats, [], ["rank", "chat_id"]), [], ["rank", "chat_id"], F.col("n"), "upto")
    return rows.withColumn("_room", limit - (F.col("upto") - F.col("n"))).where(F.col("_room") > 0).select("chat_id", "_room")


def export_dataset(
    messages: DataFrame, members: DataFrame, path: str | None = None, person: str | None = None, split: str = "chrono", floor: float = curation.FLOOR,
    low_signal_share: float = 1.0, shots: bool = True, ladder: Sequence[int] = (), openers: bool = False, groups: bool = False,
    name: str | None = None, names: DataFrame | None = None, labels: bool = True, limit: int = 0, per_chat: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(examples with split, report of one row). Train rows alone are capped, thinned by age, relieved of acknowledgements and given shots.

    With ``path`` the splits are written as JSON lines, and the report beside them.
    """
    kept, counters = collect_examples(messages, members, person, groups, ladder, openers, name, names, labels, limit, per_chat)
    kept = save(kept.withColumns({"qid": F.xxhash64("chat_id", "turn_no", F.to_json("messages")), "_row": F.monotonically_increasing_id()}), "examples")
    # the steps that choose rows read these columns only; chats come back by row
    narrow = kept.select("chat_id", "session_no", "turn_no", "msg_no", "sec", "qid", "reply", "_row")
    parted = save(curation.split_chrono(narrow, ["chat_id", "session_no"]) if split == "chrono" else curation.split_stratified(narrow).drop("chunk"), "parted")
    train = parted.where("split = 'train'")
    key = ["chat_id", "turn_no", "qid"]
    capped = save(curation.cap_duplicates(train, order=("sec", "qid")), "capped")
    recent = save(curation.downsample_recency(capped, key, floor=floor), "recent")
    rich = save(curation.cap_low_signal_share(recent, low_signal_share, order=("sec", "qid")), "rich")
    whole = lambda rows: kept.join(rows.select("_row", "split"), "_row")
    final = whole(rich)
    if shots:
        index = save(retrieval.index_rows(whole(rich).select(F.col("qid").alias("id"), "query", "reply", "peer", "sec")), "shots")
        found = retrieval.retrieve(index.select(F.col("id").alias("qid"), "query", "peer", F.array("reply").alias("exclude_replies")), index)
        final = retrieval.with_shots(final, found, index)
    out = save(final.unionByName(whole(parted.where("split <> 'train'"))), "dataset")
    sizes = kept.select("_row", F.size("messages").alias("_n"))
    longer = out.where("split = 'train'").select("_row", F.size("messages").alias("_m")).join(sizes, "_row").agg(F.count_if(F.col("_m") > F.col("_n")).alias("train_with_shots"))
    out = out.drop("_row")
    tally = lambda df, name: df.agg(F.count("*").alias(name))
    report = counters
    for part in (
        out.agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("train", "valid", "test"))), curation.target_concentration(train), longer,
        tally(train, "_train"), tally(capped, "_capped"), tally(recent, "_recent"), tally(rich, "_rich"),
    ):
        report = report.crossJoin(F.broadcast(part))  # one row each
    dropped = {"capped_targets": F.col("_train") - F.col("_capped"), "recency_dropped": F.col("_capped") - F.col("_recent"), "low_signal_dropped": F.col("_recent") - F.col("_rich")}
    report = report.withColumns(dropped).drop("_train", "_capped", "_recent", "_rich")
    if path is not None:
        jsonl.write_splits(out, path, key="qid")
        jsonl.write_report(report, f"{path}/split.json")
    return out, report


def prompt_messages(messages: Column) -> Column:
    """A chat without its last reply: what a model is asked."""
    n = F.size(messages)
    return F.when(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.slice(messages, 1, n - 1)).otherwise(messages)


def public_example(examples: DataFrame) -> DataFrame:
    return examples.select("messages")


def supervised_mask(tokens: DataFrame, key: str, header: Sequence[int], end: int) -> DataFrame:
    """(key, pos, token, supervised): tokens (key, pos, token) that the voice must produce: all after a header up to and with the end mark.

    A header inside such a run changes nothing; a run without an end goes to the last token.
    """
    order = Window.partitionBy(key).orderBy("pos")
    last = F.lit(True)
    for back, value in enumerate(reversed(header)):
        last = last & (F.lag("token", back).over(order) == value if back else F.col("token") == value)
    turn = F.when(last, 1).when(F.col("token") == end, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = tokens.withColumn("_turn", turn)
    return rows.withColumn("supervised", F.coalesce(F.last("_turn", ignorenulls=True).over(before), F.lit(0))).drop("_turn")
