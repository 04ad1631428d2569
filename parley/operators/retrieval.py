"""Retrieval of similar incoming messages and their replies by token overlap.

A score is the cosine of token sets times a factor between 0.5 and 1.2 for age and peer. That any query's best may be any
row is the nature of the job, so all pairs are looked at, but none becomes a row: blocks of queries meet blocks of
index rows inside a task, where common tokens are counted by a matrix product for the tokens that many rows hold, and
by lists of rows for the others. Newest rows come first and give each query a score that others must reach; what leaves a task is at
most the ``k`` best of each query. Results are exact, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parley.functions import text as T
from parley.operators.curation import ranked_rows, recency_weight
from parley.operators.turns import CONTEXT_TURNS, MAX_TOKENS, body_part, few_shot, fit_messages, is_alternating, once, system_part
from parley.plans.scratch import arrow_batches, save

K, PEER_BOOST = 2, 1.2
#: Queries and index rows of a block, tokens of either, and the newest rows that give each query its first scores.
QUERIES, ROWS, TOKENS, NEWEST = 4096, 16_384, 1 << 20, 4096
#: Tokens in more than this share of a block's rows are counted by a matrix product, for so many queries at once; no more than WIDE tokens of a block.
COMMON, AT_ONCE, WIDE = 0.04, 32, 256


def index_rows(pairs: DataFrame) -> DataFrame:
    """Pairs with a query and a reply, trimmed. Columns: id, query, reply, peer, sec."""
    rows = pairs.withColumns({c: T.strip(T.text_or_empty(F.col(c))) for c in ("query", "reply", "peer")}).withColumn("sec", F.coalesce("sec", F.lit(0)))
    return rows.where("query <> '' AND reply <> ''")


_QUERY = {"qid": "long", "text": "long", "qp": "long", "barred": "array<long>", "toks": "array<long>"}
_ROW = {"id": "long", "rank": "long", "text": "long", "reply": "long", "ip": "long", "f": "double", "toks": "array<long>"}


def _candidates(index: DataFrame, k: int, barred: int) -> DataFrame:
    """Index rows as ``_ROW`` says, texts by their hashes; a text brings only as many rows as could be among a query's best."""
    newest = index.agg(F.max("sec")).first()[0]
    factor = 0.5 + 0.5 * recency_weight((F.lit(newest) - F.col("sec")) / 86400.0)
    peer = F.when(F.col("peer") != "", F.xxhash64("peer")).otherwise(0)
    rows = ranked_rows(index.select("id", "query", F.xxhash64("reply").alias("reply"), peer.alias("ip"), "sec"), ["query", "id"])  # rank: what decides ties
    tokens = F.transform(F.array_distinct(T.word_tokens(F.col("query"))), lambda t: F.xxhash64(t))
    rows = save(rows.select("id", "rank", F.xxhash64("query").alias("text"), "reply", "ip", factor.alias("f"), tokens.alias("toks")).where(F.size("toks") > 0), "retrieval-rows")
    # rows of one text score alike but for factor and peer, and are left out alike but for their replies
    first = lambda df, n, *keys: df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("f"), "rank"))).where(F.col("_k") <= n).drop("_k")
    narrow = rows.drop("toks", "id")
    any_, of_peer = (first(first(narrow, k, "text", "reply", *by), k * (barred + 1), "text", *by) for by in ([], ["ip"]))
    kept = save(any_.select("rank").unionAll(of_peer.where("ip <> 0").select("rank")).distinct(), "retrieval-kept")
    return rows if kept.count() == rows.count() else rows.join(kept, "rank", "left_semi")


def _packed(rows: DataFrame, fields: dict[str, str], most: int) -> DataFrame:
    """(block, an array of each field): up to ``most`` rows of a partition in one, lists end to end beside their lengths (``n_`` and their name)."""
    lists = [c for c, kind in fields.items() if kind.startswith("array")]
    struct = StructType.fromDDL(", ".join(["block long", *(f"{c} {kind if c in lists else f'array<{kind}>'}" for c, kind in fields.items()), *(f"n_{c} array<long>" for c in lists)]))
    arrow = to_arrow_schema(struct)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, held, tokens = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(part).combine_chunks()
            columns = {c: (pc.list_flatten(t.column(c)) if c in lists else t.column(c)).to_numpy() for c in fields}
            columns |= {f"n_{c}": pc.list_value_length(t.column(c)).to_numpy() for c in lists}
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *(pa.array([columns[f.name]], type=f.type) for f in list(arrow)[1:])], schema=arrow)

        for b in batches:
            if not b.num_rows:
                continue
            size = pc.sum(pc.list_value_length(b.column("toks"))).as_py() or 0
            if part and (held + b.num_rows > most or tokens + size > TOKENS):
                yield flush()
                at, part, held, tokens = at + 1, [], 0, 0
            part.append(b)
            held, tokens = held + b.num_rows, tokens + size
        if part:
            yield flush()

    arrow_batches(rows.sparkSession, 256)
    return rows.select(*fields).mapInArrow(pack, struct)


class _Rows:
    """A block of index rows, ready to be counted: rows by token, and the tokens of many rows as a matrix."""

    def __init__(self, v: dict[str, np.ndarray]) -> None:
        self.id, self.rank, self.text, self.reply, self.ip, self.f = (v[c] for c in ("id", "rank", "text", "reply", "ip", "f"))
        sizes = v["n_toks"]
        self.n, self.root = len(sizes), np.sqrt(sizes)
        self.weight = (self.f / self.root).astype(np.float32)
        self.vocabulary, codes = np.unique(v["toks"], return_inverse=True)
        self.posts = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[np.argsort(codes, kind="stable")]
        uses = np.bincount(codes)
        self.starts = np.r_[0, np.cumsum(uses)]
        common = np.flatnonzero(uses > COMMON * self.n)
        common = common[np.argsort(-uses[common], kind="stable")[:WIDE]]
        self.column = np.full(len(uses), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n), np.float32)
        for k, c in enumerate(common.tolist()):
            self.matrix[k, self.posts[self.starts[c] : self.starts[c + 1]]] = 1


class _Queries:
    """A block of queries with the best rows found so far; ``kth`` and ``kth_rank`` say what a row must reach."""

    def __init__(self, v: dict[str, np.ndarray], k: int) -> None:
        self.qid, self.text, self.qp, self.toks, self.barred = (v[c] for c in ("qid", "text", "qp", "toks", "barred"))
        self.ends, self.bars = (np.r_[0, np.cumsum(v[c])] for c in ("n_toks", "n_barred"))
        self.root, self.k, n = np.sqrt(v["n_toks"]), k, len(self.qid)
        self.score, self.rank, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), np.int64)
        self.kth = v["kth"].copy() if "kth" in v else np.full(n, -np.inf)
        self.kth_rank = v["kth_rank"].copy() if "kth_rank" in v else np.full(n, np.iinfo(np.int64).max)

    def meet(self, rows: _Rows) -> None:
        at = np.minimum(np.searchsorted(rows.vocabulary, self.toks), len(rows.vocabulary) - 1)
        codes = np.where(rows.vocabulary[at] == self.toks, at, -1)
        for first in range(0, len(self.qid), AT_ONCE):
            ends = self.ends[first : first + AT_ONCE + 1]
            of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            mine = codes[ends[0] : ends[-1]]
            column = np.where(mine >= 0, rows.column[mine], -1)
            has = np.zeros((len(ends) - 1, len(rows.matrix)), np.float32)
            has[of[column >= 0], column[column >= 0]] = 1
            common = has @ rows.matrix
            for i in range(len(ends) - 1):
                own = mine[ends[i] - ends[0] : ends[i + 1] - ends[0]]
                own = own[(own >= 0) & (rows.column[own] < 0)]
                if len(own):
                    lists = [rows.posts[s:e] for s, e in zip(rows.starts[own].tolist(), rows.starts[own + 1].tolist(), strict=True)]
                    common[i] += np.bincount(np.concatenate(lists), minlength=rows.n)
                self._add(first + i, rows, common[i])

    def _add(self, i: int, rows: _Rows, common: np.ndarray) -> None:
        """Take rows by their common tokens: first by single precision and room for its error, then as they are."""
        least = self.kth[i] * self.root[i] / (PEER_BOOST if self.qp[i] else 1.0) * (1 - 1e-5)
        at = np.flatnonzero(common * rows.weight >= least) if least > 0 else np.flatnonzero(common)
        at = at[rows.text[at] != self.text[i]]
        if self.bars[i + 1] > self.bars[i]:
            at = at[~np.isin(rows.reply[at], self.barred[self.bars[i] : self.bars[i + 1]])]
        boost = np.where((rows.ip[at] == self.qp[i]) & (self.qp[i] != 0), PEER_BOOST, 1.0)
        score = common[at].astype(np.float64) / (self.root[i] * rows.root[at]) * rows.f[at] * boost
        good = (score > self.kth[i]) | ((score == self.kth[i]) & (rows.rank[at] <= self.kth_rank[i]))
        at, score = at[good], score[good]
        if not len(at):
            return
        if len(at) > 8 * self.k:  # ties of very many rows need not be sorted
            least = -np.partition(-score, self.k - 1)[self.k - 1]
            more, same = np.flatnonzero(score > least), np.flatnonzero(score == least)
            if len(same) > self.k:
                same = same[np.argpartition(rows.rank[at[same]], self.k - 1)[: self.k]]
            chosen = np.r_[more, same]
            at, score = at[chosen], score[chosen]
        score, rank, ids = np.r_[self.score[i], score], np.r_[self.rank[i], rows.rank[at]], np.r_[self.id[i], rows.id[at]]
        best = np.lexsort((rank, -score))[: self.k]
        self.score[i], self.rank[i], self.id[i] = score[best], rank[best], ids[best]
        if self.score[i, -1] > -np.inf:
            self.kth[i], self.kth_rank[i] = self.score[i, -1], self.rank[i, -1]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name)[0].values.to_numpy(zero_copy_only=False)


def _meet(queries: DataFrame, rows: DataFrame, k: int, bounds: bool) -> DataFrame:
    """Blocks of queries by blocks of rows, a task for each partition of both. With ``bounds`` the blocks of queries again with the k-th scores found, else the best
    rows that a partition has for each query: qid, score, rank, id."""
    rows = rows.select(*(F.col(c).alias(f"r_{c}") for c in rows.columns))
    known = [c for c in queries.columns if c != "block"]
    struct = StructType.fromDDL("block long, " + ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in known) + ", kth array<double>, kth_rank array<long>") if bounds else StructType.fromDDL("qid long, score double, rank long, id long")
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, first, ready = None, None, None, {}

        def told() -> pa.RecordBatch:
            if bounds:
                full = held.score[:, -1] > -np.inf
                kth, rank = np.where(full, held.score[:, -1], -np.inf), held.rank[:, -1]
                return pa.RecordBatch.from_arrays([*(first.column(c) for c in ("block", *known)), pa.array([kth], pa.list_(pa.float64())), pa.array([rank], pa.list_(pa.int64()))], schema=arrow)
            at, place = np.nonzero(held.score > -np.inf)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (held.qid[at], held.score[at, place], held.rank[at, place], held.id[at, place])], schema=arrow)

        for b in batches:
            if not b.num_rows:
                continue
            if b.column("block")[0].as_py() != block:
                if held is not None:
                    yield told()
                block, first, held = b.column("block")[0].as_py(), b if bounds else None, _Queries({c: _column(b, c) for c in known}, k)
            name = b.column("r_block")[0].as_py()
            if name not in ready:
                while len(ready) >= 4:
                    ready.pop(next(iter(ready)))
                ready[name] = _Rows({c: _column(b, f"r_{c}") for c in (*_ROW, "n_toks")})
            held.meet(ready[name])
        if held is not None:
            yield told()

    arrow_batches(queries.sparkSession, 1)
    return queries.crossJoin(rows.hint("shuffle_replicate_nl")).mapInArrow(run, struct)


def _dealt(spark: SparkSession, n: int, most: int) -> int:
    """Partitions for ``n`` rows: blocks of up to ``most``, but no fewer than there are cores where rows suffice."""
    return max(1, -(-n // most), min(-(-n // 256), spark.sparkContext.defaultParallelism))


def retrieve(queries: DataFrame, index: DataFrame, k: int = K) -> DataFrame:
    """(qid, id, score, place): the k most similar index rows of each query (columns qid, query, peer, and exclude_replies if there are any).

    Score: cosine of token sets, times 0.5 to 1 for recency, times a boost for the same peer; ties go by query text, then id. The query itself
    does not count, nor do rows with a reply in the query's array exclude_replies. Pairs without a common token score nothing. Queries that ask the same are
    searched once. Tokens, texts and replies are told apart by 64 bits.
    """
    spark = queries.sparkSession
    barred = F.coalesce("exclude_replies", F.array().cast("array<string>")) if "exclude_replies" in queries.columns else F.array().cast("array<string>")
    query, peer = T.strip(T.text_or_empty(F.col("query"))), T.strip(T.text_or_empty(F.col("peer")))
    asked = queries.select(
        "qid", F.xxhash64(query).alias("text"), F.when(peer != "", F.xxhash64(peer)).otherwise(0).alias("qp"),
        F.array_sort(F.array_distinct(F.transform(barred, lambda r: F.xxhash64(T.strip(T.text_or_empty(r)))))).alias("barred"),
        F.transform(F.array_distinct(T.word_tokens(F.col("query"))), lambda t: F.xxhash64(t)).alias("toks"),
    ).where(F.size("toks") > 0)
    kind = F.struct("text", "qp", "barred")
    asked = save(asked.withColumn("kind", F.struct(F.xxhash64(kind).alias("a"), F.xxhash64(F.lit(1), kind).alias("b"))), "retrieval-asked")
    unique = asked.select("kind", "text", "qp", "barred", "toks").dropDuplicates(["kind"]).withColumn("qid", F.monotonically_increasing_id())
    unique = save(unique, "retrieval-queries")
    many, most_barred = unique.agg(F.count("*"), F.max(F.size("barred"))).first()
    rows = _candidates(index, k, most_barred or 0)
    blocks = save(_packed(rows.repartition(_dealt(spark, rows.count(), ROWS)), _ROW, ROWS), "retrieval-blocks")
    newest = save(_packed(rows.orderBy(F.desc("f"), "rank").limit(NEWEST).coalesce(1), _ROW, NEWEST), "retrieval-newest")
    packed = _packed(unique.repartition(_dealt(spark, many, QUERIES)), _QUERY, QUERIES)
    bounded = packed if newest.isEmpty() else save(_meet(packed, newest.limit(1), k, True), "retrieval-bounded")
    met = save(_meet(bounded, blocks, k, False), "retrieval-met")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank"))
    best = met.withColumn("place", place).where(F.col("place") <= k).drop("rank").withColumnRenamed("qid", "_qid")
    found = best.join(unique.select(F.col("qid").alias("_qid"), "kind"), "_qid")
    return asked.select("qid", "kind").join(found, "kind").select("qid", "id", "score", "place")


def with_shots(examples: DataFrame, found: DataFrame, index: DataFrame, most: int = MAX_TOKENS, turns: int = CONTEXT_TURNS) -> DataFrame:
    """Put retrieved pairs before each example's context (column qid joins), behind its system message.

    Shots and context share ``turns``, so the oldest context goes. Where the whole does not fit with the first shot in it, the example stays as it is.
    """
    pairs = found.join(index.select("id", "query", "reply"), "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "query", "reply"))).alias("pairs"))
    rows = examples.join(pairs, "qid", "left")
    longer = once(few_shot(F.col("pairs")), lambda shots: once(body_part(F.col("messages")), lambda body: fit_messages(_with_recent(shots, body, turns), most)))

    def chosen(found: Column) -> Column:
        told = F.exists(found, lambda m: m["content"] == F.try_element_at("pairs", F.lit(1))["query"])
        return F.when(F.coalesce(told & is_alternating(found), F.lit(False)), found).otherwise(F.col("messages"))

    return rows.withColumn("messages", F.when(F.col("pairs").isNotNull(), once(longer, chosen)).otherwise(F.col("messages"))).drop("pairs")


def _with_recent(shots: Column, body: Column, turns: int) -> Column:
    """The system message, the shots, and of the context as many last messages as there is room for, from a user's on."""
    room = F.greatest(F.lit(2), turns - F.size(shots))

    def from_user(recent: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(recent)), lambda i: F.try_element_at(recent, i)["role"] == "user")
        return once(begins, lambda b: F.when(F.size(b) > 0, F.slice(recent, F.try_element_at(b, F.lit(1)), F.size(recent))))

    last = F.when(F.size(body) > 0, F.slice(body, -F.least(room, F.size(body)), F.least(room, F.size(body))))
    return F.concat(system_part(F.col("messages")), shots, once(last, from_user))
