"""Queries about training runs, contacts and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import runs
from parley.plans.register import Registry
from parley.plans.scratch import new_path
from parley.sources import catalog as c
from parley.sources import contacts, jsonl
from parley.streaming import index as stream_index
from parley.streaming import logs

registered = Registry()
query = registered.query
QUERIES, ORACLE = registered.queries, registered.oracle


@query("SELECT event_id AS iter, user_id AS run, round(value, 3) AS train_loss FROM events WHERE value IS NOT NULL")
def training_log_parse(spark, sf):
    e = c.table(spark, sf, "events").where("value IS NOT NULL")
    line = F.concat(F.lit("\x1b[32mIter "), F.col("event_id").cast("string"), F.lit(": Train loss "), F.round("value", 3).cast("string"), F.lit(", Tokens/sec 245.5\x1b[0m"))
    return runs.parse_log(e.select(F.col("user_id").alias("run"), line.alias("line"))).select("iter", "run", "train_loss")


#: The fold over a run's evaluations: the best moves on a drop of 0.01, six stale ones stop the run.
_STOP = """WITH e AS (SELECT user_id AS run, event_id AS iter, value AS loss FROM events WHERE value IS NOT NULL),
    l AS (SELECT run, list({'best': loss, 'best_iter': iter, 'stale': 0, 'n': 1, 'stop': NULL::BIGINT} ORDER BY iter) AS xs FROM e GROUP BY run),
    f AS (SELECT run, list_reduce(xs, lambda s, x: CASE WHEN s.stop IS NOT NULL THEN s
        WHEN s.best - x.best >= 0.01 THEN {'best': x.best, 'best_iter': x.best_iter, 'stale': 0, 'n': s.n + 1, 'stop': NULL::BIGINT}
        ELSE {'best': s.best, 'best_iter': s.best_iter, 'stale': s.stale + 1, 'n': s.n + 1, 'stop': CASE WHEN s.stale + 1 >= 6 AND s.n + 1 >= 3 THEN x.best_iter END} END) AS s FROM l)"""


@query(f"{_STOP} SELECT run, s.best AS best, s.best_iter AS best_iter, s.stop AS stop_iter FROM f")
def early_stop(spark, sf):
    e = c.table(spark, sf, "events").where("value IS NOT NULL")
    return runs.early_stop(e.select(F.col("user_id").alias("run"), F.col("event_id").alias("iter"), F.col("value").alias("loss")))


@query(f"{_STOP.replace('value AS loss', 'round(value, 3) AS loss')} SELECT run::VARCHAR AS run, 'stop' AS event, s.best AS best, s.best_iter AS best_iter, s.stop AS at_iter FROM f WHERE s.stop IS NOT NULL")
def early_stop_live(spark, sf):
    """The same decisions made by a stream over log lines, which come in three pieces with a restart after each."""
    e = c.table(spark, sf, "events").where("value IS NOT NULL")
    line = F.concat(F.lit("Iter "), F.col("event_id").cast("string"), F.lit(": Val loss "), F.format_string("%.3f", F.round("value", 3)))
    lines = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("n"), line.alias("line"))
    third = e.agg(F.max("event_id")).first()[0] // 3 + 1
    source, target = new_path(spark, "log-in"), new_path(spark, "log-events")
    for k in range(3):
        lines.where(F.floor(F.col("n") / third) == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(lines.schema).parquet(source)
        logs.follow(stream, target, f"{target}-checkpoint").awaitTermination()
    return spark.read.parquet(target)


@query("""WITH e AS (SELECT user_id AS run, event_type AS phase, ts, event_id FROM events), n AS (SELECT run, phase, epoch_us(lead(ts) OVER (PARTITION BY run ORDER BY ts, event_id)) - epoch_us(ts) AS took FROM e)
    SELECT run, phase, sum(coalesce(took, 0)) / 1000000.0::DOUBLE AS seconds FROM n GROUP BY ALL""")
def phase_times(spark, sf):
    return runs.phase_times(c.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("phase"), "ts"))


@query("""SELECT s_suppkey AS handle, s_name AS name FROM supplier""")
def contact_resolution(spark, sf):
    s = c.table(spark, sf, "supplier")
    cards = s.select(F.col("s_suppkey").alias("card"), F.lit(0).alias("file_order"), F.lit("").alias("first"), F.lit(None).cast("string").alias("last"), F.lit("").alias("nick"), F.col("s_name").alias("org"))
    value = F.concat(F.lit("+1 555 "), (F.col("s_suppkey") + 1000000).cast("string"))
    book = contacts.directory(cards, s.select(F.col("s_suppkey").alias("card"), F.lit(0).alias("file_order"), value.alias("value")))
    handles = s.select((F.col("s_suppkey") + 5551000000).cast("string").alias("handle"), F.col("s_suppkey").alias("k"))
    return contacts.resolve(handles, book).select(F.col("k").alias("handle"), "name")


@query()
def dataset_fingerprint(spark, sf):
    return jsonl.fingerprint(c.document_messages(spark, sf))


@query(r"""SELECT term, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM documents) t GROUP BY term HAVING count(*) >= 5""")
def incremental_index(spark, sf):
    """The index as a stream of new files leaves it."""
    source, target = new_path(spark, "stream-in"), new_path(spark, "stream-out")
    docs = c.table(spark, sf, "documents").select(F.col("doc_id").alias("msg_id"), F.lit(1).alias("chat_id"), F.col("text").alias("body"), F.lit(None).cast("int").alias("kind"))
    docs.write.parquet(source)
    stream_index.stream_postings(spark, source, "msg_id long, chat_id int, body string, kind int", target, f"{target}-checkpoint").awaitTermination()
    return spark.read.parquet(target).groupBy("term").agg(F.count("*").alias("docs")).where("docs >= 5")
