"""Full-text search over a postings table: phrases, prefixes, AND and OR, BM25 and snippets."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parley.functions.stem import stem
from parley.functions.text import escape_html
from parley.plans.scratch import arrow_batches, save
from parley.sources import publish

K1, B, LIMIT = 1.2, 0.75, 300
# A query is quoted phrases and loose terms, of which only these characters count; the words that join terms are no prefixes.
QUERY_PART, TERM_NOISE, JOINERS = r'"([^"]*)"|(\S+)', r"[^\w'-]+", ("and", "or", "not", "near")
_TOKEN = r"[\p{L}\p{N}]+"
#: Bytes of words in a batch of documents whose postings are brought together.
BATCH_BYTES = 16 << 20


def fold(term: str) -> str:
    """Lower case, without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", term.lower()) if not unicodedata.combining(c))


def analyse(term: str, stemming: bool = True) -> str:
    return stem(fold(term)) if stemming else term.lower()


@dataclass
class Index:
    """postings (doc_id, term, positions, tf), lengths (doc_id, dl), and totals of the corpus."""

    postings: DataFrame
    lengths: DataFrame
    stemming: bool

    @functools.cached_property
    def totals(self) -> tuple[int, float]:
        n, avg = self.lengths.agg(F.count("*"), F.avg("dl")).first()
        return n or 0, avg or 1.0


def token_lists(docs: DataFrame, doc_id: str = "doc_id", columns: tuple[str, ...] = ("body",)) -> DataFrame:
    """(doc_id, words array<struct<pos, raw>>): words in order; columns are far apart, so that no phrase reaches across."""

    def numbered(k: int, column: str) -> Column:
        words = F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(_TOKEN), F.lit(0))
        return F.transform(words, lambda w, i: F.struct((i + k * 100_000_000).alias("pos"), w.alias("raw")))

    parts = [numbered(k, c) for k, c in enumerate(columns)]
    return docs.select(F.col(doc_id).alias("doc_id"), F.concat(*parts).alias("words"))


def tokens(docs: DataFrame, doc_id: str = "doc_id", columns: tuple[str, ...] = ("body",)) -> DataFrame:
    """(doc_id, pos, raw): a row for each word."""
    return token_lists(docs, doc_id, columns).select("doc_id", F.inline("words"))


def build_index(docs: DataFrame, doc_id: str = "doc_id", columns: tuple[str, ...] = ("body",), stemming: bool = True, root: str | None = None) -> Index:
    """Write the postings, in order of term so that a lookup reads few row groups, and the lengths; under ``root`` if it is given.

    A task brings together what its batches of documents say of a term, so that neither words nor postings travel one by one. Stemming and folding
    run on distinct words only.
    """
    lists = token_lists(docs, doc_id, columns)
    lengths = save(lists.select("doc_id", F.size("words").alias("dl")), "doc-lengths")
    arrow_batches(docs.sparkSession, 4096)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kind = docs.schema[doc_id].dataType.simpleString()
    lists = lists.select("doc_id", "words.pos", "words.raw")
    packed = save(lists.mapInArrow(_by_term(stemming, to_arrow_type(docs.schema[doc_id].dataType)), f"term string, first {kind}, docs array<{kind}>, tfs array<int>, places array<int>"), "packed-postings")
    dealt = packed.repartitionByRange("term", "first").select("term", "docs", "tfs", "places")
    postings = dealt.mapInArrow(_one_by_one(to_arrow_type(docs.schema[doc_id].dataType)), f"doc_id {kind}, term string, positions array<int>, tf int")
    n, different = lengths.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if different < n:  # rows that repeat an id are one document
        postings = postings.groupBy("doc_id", "term").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")).withColumn("tf", F.size("positions"))
        postings = postings.repartitionByRange("term", "doc_id")
    ordered = postings.sortWithinPartitions("term", "doc_id")
    if root is None:
        return Index(save(ordered, "postings"), lengths, stemming)
    write_segment(ordered, lengths, root)
    return read_segments(docs.sparkSession, [root], stemming)


def _by_term(stemming: bool, kind: pa.DataType) -> Callable:
    """Documents to one row for each term of a batch: its documents, how often each has it, and where, all end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = functools.cache(analyse)
        for b in batches:
            raw = b.column("raw").flatten().dictionary_encode()
            if not len(raw):
                continue
            words = raw.dictionary.to_pylist()
            terms = pa.array([stems(w) for w in words] if stemming else words, pa.string()).dictionary_encode()
            term = terms.indices.to_numpy()[raw.indices.to_numpy()]
            doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("raw")).to_numpy())
            order = np.lexsort((doc, term))  # positions of a document are in order already
            term, doc, places = term[order], doc[order], b.column("pos").flatten().to_numpy()[order]
            fresh = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])
            tfs = np.diff(np.r_[fresh, len(term)]).astype(np.int32)
            begins = np.flatnonzero(np.r_[True, term[fresh][1:] != term[fresh][:-1]])
            cuts = np.r_[begins, len(fresh)].astype(np.int32)
            ids = b.column("doc_id").take(pa.array(doc[fresh])).cast(kind)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), x) for x in (ids, pa.array(tfs))]
            at = pa.ListArray.from_arrays(pa.array(np.r_[fresh, len(term)][cuts].astype(np.int32)), pa.array(places))
            yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(term[fresh[begins]])), ids.take(pa.array(begins)), *lists, at], names=["term", "first", "docs", "tfs", "places"])

    return run


def _one_by_one(kind: pa.DataType) -> Callable:
    """The rows of ``_by_term`` to one for each document and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tfs = b.column("tfs").flatten()
            term = b.column("term").take(pa.array(np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("tfs")).to_numpy())))
            ends = pa.array(np.r_[0, np.cumsum(tfs.to_numpy())].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("docs").flatten().cast(kind), term, pa.ListArray.from_arrays(ends, b.column("places").flatten()), tfs], names=["doc_id", "term", "positions", "tf"])

    return run


def write_segment(postings: DataFrame, lengths: DataFrame, root: str) -> None:
    postings.write.parquet(f"{root}/postings")
    lengths.write.parquet(f"{root}/lengths")


def read_segments(spark: SparkSession, roots: list[str], stemming: bool) -> Index:
    """One index over the postings of several folders, each in order of term."""
    return Index(spark.read.parquet(*(f"{r}/postings" for r in roots)), spark.read.parquet(*(f"{r}/lengths" for r in roots)), stemming)


def stored_index(docs: DataFrame, root: str, version: str, doc_id: str = "doc_id", columns: tuple[str, ...] = ("body",), stemming: bool = True) -> Index:
    """The index of one version of ``docs``: built under ``root`` the first time, then read by every query."""
    spark = docs.sparkSession
    place = f"{root}/{'-'.join(columns)}-{'stems' if stemming else 'words'}"
    path = publish.find(spark, place, version)
    if path is None:
        path = publish.new_folder(place)
        build_index(docs, doc_id, columns, stemming, path)
        path = publish.add(spark, place, version, path)
    return read_segments(spark, [path], stemming)


@dataclass(frozen=True)
class Part:
    """One condition: a phrase of terms in a row, or a single term, whole or as a prefix."""

    terms: tuple[str, ...]
    prefix: bool


def parse_query(text: str) -> tuple[list[str], list[str]]:
    """(quoted phrases, loose terms)."""
    phrases, loose = [], []
    for quoted, term in re.findall(QUERY_PART, text or ""):
        (loose if term else phrases).append((term or quoted).strip())
    return [p for p in phrases if p], [t for t in loose if t]


def parts_of(text: str, stemming: bool = True) -> list[Part]:
    """Phrases as they stand; loose terms of two characters or more as prefixes, but for the words of the query language."""
    phrases, loose = parse_query(text)
    split = lambda s: [analyse(w, stemming) for w in re.findall(r"[^\W_]+", s)]
    out = [Part(tuple(t), False) for p in phrases if (t := split(p))]
    for term in loose:
        clean = re.sub(TERM_NOISE, "", term).strip("-'")
        if len(clean) >= 2 and (t := split(clean)):
            out.append(Part(tuple(t), len(t) == 1 and clean.lower() not in JOINERS))
    return out


def part_hits(index: Index, part: Part) -> DataFrame:
    """(doc_id, tf) of one part."""
    p = index.postings
    if len(part.terms) == 1:
        term = part.terms[0]
        hit = F.startswith("term", F.lit(term)) if part.prefix else F.col("term") == term
        return p.where(hit).groupBy("doc_id").agg(F.sum("tf").alias("tf"))
    places = {t: [i for i, u in enumerate(part.terms) if u == t] for t in part.terms}
    rows = p.where(F.col("term").isin(*places)).select("doc_id", "term", F.explode("positions").alias("pos"))
    at = functools.reduce(lambda c, t: c.when(F.col("term") == t, F.array(*(F.lit(i) for i in places[t]))), places, F)
    starts = rows.select("doc_id", "pos", F.explode(at).alias("i")).select("doc_id", (F.col("pos") - F.col("i")).alias("start"), "i")
    whole = starts.groupBy("doc_id", "start").agg(F.countDistinct("i").alias("k")).where(F.col("k") == len(part.terms))
    return whole.groupBy("doc_id").agg(F.count("*").alias("tf"))


def match(index: Index, parts: list[Part], every: bool = True) -> DataFrame:
    """(doc_id, score): documents with every part, or any; Okapi BM25 with the customary constants."""
    n, avg = index.totals
    hits = functools.reduce(DataFrame.unionByName, (part_hits(index, p).withColumn("part", F.lit(k)) for k, p in enumerate(parts)))
    df = hits.groupBy("part").agg(F.count("*").alias("df"))  # a row for each part
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    rows = hits.join(F.broadcast(df), "part").join(index.lengths, "doc_id")
    weight = F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(float(avg))))
    found = rows.groupBy("doc_id").agg(F.sum(idf * weight).alias("score"), F.count("*").alias("k"))
    return (found.where(F.col("k") == len(parts)) if every else found).drop("k")


def search(index: Index, text: str, limit: int = LIMIT, among: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """The best ``limit + 1`` documents (one more tells that there are others), and whether AND was relaxed to OR.

    ``among`` restricts the documents (column doc_id).
    """
    parts = parts_of(text, index.stemming)
    if not parts:
        return index.lengths.where("1 = 0").select("doc_id", F.lit(0.0).alias("score")), False
    top = lambda every: _among(match(index, parts, every), among).orderBy(F.desc("score"), "doc_id").limit(limit + 1)
    if len(parts) == 1:
        return top(True), False
    found = save(top(True), "found")  # limit + 1 rows, looked at twice
    if found.isEmpty():
        relaxed = save(top(False), "found")
        return relaxed, not relaxed.isEmpty()
    return found, False


def _among(rows: DataFrame, among: DataFrame | None) -> DataFrame:
    return rows if among is None else rows.join(among, "doc_id", "left_semi")


def snippet(text: Column, needles: list[str], width: int = 220, lead: int = 50, mark: bool = True) -> Column:
    """A window around the earliest needle, needles marked, the rest escaped; the beginning if there is none."""
    low = F.lower(text)
    places = [F.nullif(F.instr(low, n.lower()), F.lit(0)) for n in needles if n]
    at = F.least(*places) if len(places) > 1 else places[0] if places else F.lit(None).cast("int")
    start = F.when(at.isNull(), 1).otherwise(F.greatest(at - lead, F.lit(1)))
    cut = F.substr(text, start, F.lit(width))
    shown = escape_html(cut)
    longest = sorted((n for n in needles if len(n) > 1), key=len, reverse=True)
    if mark and longest:
        escaped = [re.escape(n).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for n in longest]
        shown = F.regexp_replace(shown, "(?iu)(" + "|".join(escaped) + ")", "<mark>$1</mark>")
    more = lambda c: F.when(c, "…").otherwise("")
    return F.concat(more(start > 1), shown, more(start + width <= F.char_length(text)))
