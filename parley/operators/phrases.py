"""Word statistics: n-grams, frequent phrases of any length and distinctive words."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import PHRASE_EDGES, PHRASE_LIGHT, voice_tokens
from parley.plans.scratch import arrow_batches, save

MAX_N, MIN_COUNT, TOP_PHRASES, TOP_WORDS = 6, 3, 20, 80
PERSON_WORDS, PERSON_MIN, PERSON_LIFT = 12, 6, 2.0
YEAR_WORDS, YEAR_MIN, YEAR_LIFT = 14, 5, 1.5


def word_counts(messages: DataFrame, text: str = "body", stop: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """(by..., word, n)."""
    words = messages.select(*by, F.explode(voice_tokens(F.col(text))).alias("word"))
    return (words.where(~F.col("word").isin(*stop)) if stop else words).groupBy(*by, "word").agg(F.count("*").alias("n"))


def _spans(tokens: Column, low: int, high: int) -> Column:
    """All runs of low to high tokens, each with its place (one-based)."""
    n = F.size(tokens)
    of_length = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct(i.alias("at"), F.slice(tokens, i, k).alias("span")))).otherwise(F.array())
    return F.concat(*(of_length(k) for k in range(low, high + 1)))


#: Words that are counted together, places of phrases in one part, bits of the filter at most, and bytes of an Arrow batch.
BATCH_WORDS, PART_PLACES, FILTER_BITS, BATCH_BYTES = 1 << 21, 1 << 21, 1 << 28, 8 << 20


def phrase_counts(messages: DataFrame, text: str = "body", low: int = 2, high: int = MAX_N, min_count: int = 1) -> DataFrame:
    """(phrase, n): n-grams that neither start nor end with an edge word and have no one-letter word.

    With a ``min_count`` they are counted length by length, over numbers that stand for words (``_frequent``).
    """
    words = messages.select(voice_tokens(F.col(text)).alias("toks"))  # a column of its own: it is used many times
    if min_count > 1:
        return _frequent(words, low, high, min_count)
    # a row for each word with those that follow it
    shifted = [F.slice("toks", k, F.greatest(F.size("toks") - k + 1, F.lit(0))) for k in range(1, high + 1)]
    rows = words.where(F.size("toks") >= min(low, 2)).select(F.inline(F.arrays_zip(*(x.alias(f"w{k}") for k, x in enumerate(shifted, 1)))))
    w = [F.col(c) for c in rows.columns]
    long = lambda c: c.isNotNull() & (F.length(c) >= 2)
    found, inner = [], long(w[0])
    for k in range(2, high + 1):
        inner = inner & long(w[k - 1])
        if k >= low:
            found.append(F.when(inner & ~(w[0].isin(*PHRASE_EDGES) | w[k - 1].isin(*PHRASE_EDGES)), F.concat_ws(" ", *w[:k])))
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


def _frequent(words: DataFrame, low: int, high: int, min_count: int) -> DataFrame:
    """(phrase, n) of what comes ``min_count`` times.

    Only words that come so often can be part of it. They are numbered by frequency, and texts are written once as these numbers. Of each length, a task counts
    its phrases and hands them on by part, sorted, as differences: a few bytes for each, where rows of words would take forty. Both halves of a frequent
    phrase that are one word shorter are frequent: a filter of bits, broadcast, leaves out most others, and what it lets through is counted all the same.
    Numbers stand for words one to one, so the result is exact.
    """
    spark = words.sparkSession
    every = words.select(F.explode("toks").alias("word")).where(F.length("word") >= 2).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    every = save(every, "phrase-vocabulary")
    many, places = every.agg(F.count("*"), F.sum("n")).first()
    out = spark.createDataFrame([], "phrase string, n long")
    if not many:
        return out
    arrow_batches(spark, 4096)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    names = every.orderBy(F.desc("n"), "word").select("word").toArrow().column("word").combine_chunks().cast(pa.string())
    edges = np.r_[False, pc.is_in(names, pa.array(PHRASE_EDGES)).to_numpy(zero_copy_only=False)]
    parts = 1 << (-(-places // PART_PLACES) - 1).bit_length()
    form = Form(int(many).bit_length(), parts, max(8, min(FILTER_BITS, 1 << (8 * places // min_count).bit_length()) // parts))
    vocabulary = spark.sparkContext.broadcast((names, edges))
    numbered = save(words.mapInArrow(_numbers(vocabulary), "ids array<int>"), "phrase-ids")
    seen = None
    for k in range(2, high + 1):
        counted = numbered.mapInArrow(_phrases(form, k, seen), "part int, packed binary").groupBy("part")
        level = save(counted.applyInArrow(_counts(form, k, min_count, k >= low, vocabulary), "phrase string, n long, part int, seen binary"), "phrase-counts")
        told = level.where("seen IS NOT NULL").select("part", "seen").collect()  # a filter of FILTER_BITS
        if not told:
            break
        if k >= low:
            out = out.unionByName(level.where("phrase IS NOT NULL").select("phrase", "n"))
        size = form.filter_bits // 8
        flags = np.zeros(parts * size, np.uint8)
        for r in told:
            flags[r.part * size : (r.part + 1) * size] = np.frombuffer(r.seen, np.uint8)
        seen = spark.sparkContext.broadcast(flags)
    return out


def _numbers(vocabulary: Broadcast) -> Callable:
    """Words as their numbers from 1; 0 for those that are not in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0)
            flat = words.flatten().dictionary_encode()
            number = pc.fill_null(pc.index_in(flat.dictionary, vocabulary.value[0].cast(flat.dictionary.type)), -1).to_numpy() + 1
            ends = np.r_[0, np.cumsum(pc.list_value_length(words).to_numpy())].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(number[flat.indices.to_numpy()].astype(np.int32)))], names=["ids"])

    return run


class Form:
    """How phrases are written: a column of 63 bits holds as many numbers of ``bits`` as fit; parts and filter go by a hash of the columns."""

    def __init__(self, bits: int, parts: int, filter_bits: int) -> None:
        self.bits, self.parts, self.filter_bits, self.fit = bits, parts, filter_bits, 63 // bits

    def columns(self, ids: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
        """The ``k`` words from each place on."""
        out = []
        for first in range(0, k, self.fit):
            x = np.zeros(len(at), np.uint64)
            for j in range(first, min(k, first + self.fit)):
                x = (x << np.uint64(self.bits)) | ids[at + j].astype(np.uint64)
            out.append(x)
        return out

    def words(self, columns: list[np.ndarray], k: int) -> list[np.ndarray]:
        """The numbers of each of the ``k`` words again."""
        out, mask = [], np.uint64((1 << self.bits) - 1)
        for c, first in zip(columns, range(0, k, self.fit), strict=True):
            n = min(self.fit, k - first)
            out += [((c >> np.uint64(self.bits * (n - 1 - j))) & mask).astype(np.int64) for j in range(n)]
        return out

    def place(self, columns: list[np.ndarray]) -> np.ndarray:
        """Where a phrase's bit is: the highest bits are its part."""
        x = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            x = (x ^ c) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
        return (x >> np.uint64(65 - (self.parts * self.filter_bits).bit_length())).astype(np.int64)

    def known(self, flags: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        at = self.place(columns)
        return (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _tally(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows in order, and how often each comes (``n`` times each)."""
    if len(columns) == 1 and n is None:
        columns = [np.sort(columns[0])]
    else:
        order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
        columns, n = [c[order] for c in columns], n if n is None else n[order]
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(fresh)
    return [c[starts] for c in columns], np.diff(np.r_[starts, len(fresh)]) if n is None else np.add.reduceat(n, starts)


def pack(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Rows in order and their counts: the first column as differences, bytes of one weight side by side."""
    values = [np.diff(columns[0], prepend=np.uint64(0)), *columns[1:], n.astype(np.uint64)]
    planes = np.concatenate([v.view(np.uint8).reshape(-1, 8).T.ravel() for v in values])
    return len(n).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, width: int) -> list[np.ndarray]:
    """The ``width`` columns and the counts."""
    rows = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=rows * 8 * (width + 1), codec="zstd", asbytes=True), np.uint8).reshape(width + 1, 8, rows)
    values = [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]
    return [np.cumsum(values[0], dtype=np.uint64), *values[1:]]


def _phrases(form: Form, k: int, seen: Broadcast | None) -> Callable:
    """Texts to their phrases of ``k`` words, counted and packed by part; ``seen`` tells which of ``k - 1`` words are frequent."""

    def counted(texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([x for t in texts for x in (t, np.zeros(k, np.int32))])
        whole = np.lib.stride_tricks.sliding_window_view(ids > 0, k).all(axis=1) if len(ids) >= k else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        for half in (0, 1) if seen is not None else ():
            at = at[form.known(seen.value, form.columns(ids, at + half, k - 1))]
        if not len(at):
            return
        columns, n = _tally(form.columns(ids, at, k))
        part = form.place(columns) // form.filter_bits
        order = np.argsort(part, kind="stable")
        part = part[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)].tolist()
        packed = [pack([c[order[x:y]] for c in columns], n[order[x:y]]) for x, y in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids = b.column(0)
            flat, ends = ids.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(ids).to_numpy())].tolist()
            for x, y in zip(ends, ends[1:], strict=False):
                held.append(flat[x:y])
                size += y - x + k
                if size >= BATCH_WORDS:
                    yield from counted(held)
                    held, size = [], 0
        if held:
            yield from counted(held)

    return run


def _counts(form: Form, k: int, min_count: int, wanted: bool, vocabulary: Broadcast) -> Callable:
    """A part's phrases that come ``min_count`` times, as text if they are ``wanted`` and have no edge words, and the part's share of the filter."""
    schema = pa.schema([("phrase", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("seen", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        width = -(-k // form.fit)
        pieces = [unpack(p, width) for p in table.column("packed").to_pylist()]
        *columns, n = (np.concatenate(x) for x in zip(*pieces, strict=True))
        columns, n = _tally(columns, n)
        columns, n = [c[n >= min_count] for c in columns], n[n >= min_count]
        if not len(n):
            return schema.empty_table()
        part = table.column("part")[0].as_py()
        bit = np.zeros(form.filter_bits, np.uint8)
        bit[form.place(columns) - part * form.filter_bits] = 1
        out = [pa.table([[None], [None], [part], [np.packbits(bit, bitorder="little").tobytes()]], schema=schema)]
        if wanted:
            names, edges = vocabulary.value
            words = form.words(columns, k)
            good = ~(edges[words[0]] | edges[words[-1]])
            phrase = pc.binary_join_element_wise(*(names.take(pa.array(w[good] - 1)) for w in words), " ")
            none = pa.nulls(len(phrase))
            out.append(pa.table([phrase, pa.array(n[good].astype(np.int64)), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema))
        return pa.concat_tables(out)

    return run


def frequent_phrases(counts: DataFrame, stop: Sequence[str] = (), limit: int = TOP_PHRASES, min_count: int = MIN_COUNT) -> DataFrame:
    """(phrase, n): frequent phrases, without those that longer ones explain or that only add light words to a shorter one.

    Phrases of equal length never affect each other, so both passes go by length: from the longest down to take away
    what kept longer phrases explain, then from the shortest up to drop light-word variants.
    """
    weak = sorted({*stop, *PHRASE_EDGES, *PHRASE_LIGHT})
    light = lambda w: w.isin(*weak)
    items = counts.where(F.col("n") >= min_count).withColumn("toks", F.split("phrase", " ")).withColumn("k", F.size("toks"))
    items = save(items.where(~F.forall("toks", light)), "phrases")
    lengths = sorted(r.k for r in items.select("k").distinct().collect())
    kept = None
    for k in reversed(lengths):
        level = items.where(F.col("k") == k)
        if kept is not None:
            inside = kept.select("n", F.explode(F.array_distinct(F.transform(_spans(F.col("toks"), k, k), lambda s: F.array_join(s["span"], " ")))).alias("phrase"))
            explained = inside.groupBy("phrase").agg(F.sum("n").alias("explained"))
            level = level.join(explained, "phrase", "left").where(F.col("n") - F.coalesce("explained", F.lit(0)) >= min_count).drop("explained")
        level = save(level.select("phrase", "n", "toks", "k"), "phrases-kept")
        kept = level if kept is None else kept.unionByName(level)
    if kept is None:
        return counts.where("1 = 0").select("phrase", "n")
    cores = None
    for k in lengths:
        level = kept.where(F.col("k") == k)
        if cores is not None:
            low = lengths[0]
            outer = light(F.get("toks", F.lit(0))) | light(F.try_element_at("toks", F.lit(-1)))  # else no wing is light
            spans = level.where(outer).select("phrase", "toks", F.explode(_spans(F.col("toks"), low, k - 1)).alias("s")).select("phrase", "toks", "s.*")
            m = F.size("span")
            wings = F.concat(F.slice("toks", 1, F.col("at") - 1), F.slice("toks", F.col("at") + m, F.greatest(F.size("toks") - F.col("at") - m + 1, F.lit(0))))
            earlier = F.when(F.col("at") > 1, F.exists(F.sequence(F.lit(1), F.col("at") - 1), lambda i: F.slice("toks", i, m) == F.col("span"))).otherwise(False)
            first = spans.where((F.size(wings) > 0) & F.forall(wings, light) & ~earlier).select("phrase", F.array_join("span", " ").alias("core"))
            lightly = first.join(cores.select(F.col("phrase").alias("core")), "core", "left_semi").distinct()
            level = level.join(lightly.select("phrase"), "phrase", "left_anti")
        level = save(level, "phrases-cores")
        cores = level if cores is None else cores.unionByName(level)
    return _halves(cores, limit)


def _halves(cores: DataFrame, limit: int) -> DataFrame:
    """Half the places for word pairs and half for longer phrases; what one leaves the other may fill."""
    weight = F.col("n") * F.col("k")
    two = cores.where("k = 2").orderBy(F.desc("n"), "phrase").limit(limit).withColumn("pair", F.lit(True))
    longer = cores.where("k > 2").orderBy(weight.desc(), F.desc("n"), "phrase").limit(limit).withColumn("pair", F.lit(False))
    rows = two.unionByName(longer)  # at most 2 * limit rows
    w = Window.partitionBy("pair").orderBy(weight.desc(), F.desc("n"), "phrase")
    rows = rows.withColumn("place", F.row_number().over(w))
    every = Window.partitionBy(F.lit(1))
    n2, nl = F.count_if("pair").over(every), F.count_if(~F.col("pair")).over(every)
    take_longer = F.least(nl, limit - F.least(n2, F.lit(limit // 2)))
    take = F.when(F.col("pair"), F.least(n2, limit - take_longer)).otherwise(take_longer)
    return rows.withColumn("take", take).where(F.col("place") <= F.col("take")).orderBy(weight.desc(), F.desc("n"), "phrase").select("phrase", "n")


def distinctive(messages: DataFrame, by: str, text: str = "body", stop: Sequence[str] = (), min_n: int = PERSON_MIN, min_lift: float = PERSON_LIFT, limit: int = PERSON_WORDS) -> DataFrame:
    """(by, word, n, lift): words that a person (or year) uses more than everyone, by n times the logarithm of the lift."""
    own = word_counts(messages, text, stop, [by])
    overall = own.groupBy("word").agg(F.sum("n").alias("g"))
    sizes = own.groupBy(by).agg(F.sum("n").alias("total"))
    everyone = sizes.agg(F.sum("total").alias("all"))
    rows = own.where(F.col("n") >= min_n).join(overall, "word").join(F.broadcast(sizes), by).crossJoin(F.broadcast(everyone))
    lift = (F.col("n") / F.col("total")) / (F.col("g") / F.col("all"))
    rows = rows.withColumn("x", lift).where(F.col("x") >= min_lift).withColumn("score", F.col("n") * F.log("x"))
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.desc("x"), F.desc("n"), F.desc("word"))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(by, "word", "n", F.bround("x", 1).alias("lift"), "place")


def voice_totals(messages: DataFrame, by: Sequence[str] = (), text: str = "body", stop: Sequence[str] = ()) -> DataFrame:
    """(by..., messages, avg_len, tokens): lengths count all characters, tokens leave stop words out."""
    words = voice_tokens(F.col(text))
    words = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    return messages.groupBy(*by).agg(F.count("*").alias("messages"), F.avg(F.char_length(text)).alias("avg_len"), F.sum(F.size(words)).alias("tokens"))


def vocabulary(rows: DataFrame, text: str) -> DataFrame:
    from parley.functions.text import word_tokens

    return rows.select(F.explode(word_tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def vocab_overlap(pred: DataFrame, gold: DataFrame, top: int = 300) -> DataFrame:
    """One row (overlap): how far the frequencies of gold's most common words are matched."""
    most = gold.orderBy(F.desc("n"), "word").limit(top).select("word", F.col("n").alias("g"))
    totals = gold.agg(F.sum("n").alias("gt")).crossJoin(F.broadcast(pred.agg(F.sum("n").alias("pt"))))
    rows = most.join(pred.select("word", F.col("n").alias("p")), "word", "left")
    rows = rows.crossJoin(F.broadcast(totals)).select((F.coalesce("p", F.lit(0)) / F.col("pt")).alias("p"), (F.col("g") / F.col("gt")).alias("g"))
    return rows.agg((F.sum(F.least("p", "g")) / F.sum("g")).alias("overlap"))
