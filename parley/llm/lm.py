"""A hashed maximum-entropy language model with a class-factored softmax.

A word is coded by its classes, from coarse to fine: first the band of its corpus count (the power of two), then
16-way digits of its hash, as many as the vocabulary asks for (``digits_for``). P(word | history) is the product of a
softmax over 16 outcomes for each class, given the classes before, and the word's share of its last class, which
is nearly always its own but for rare words. A softmax starts from the corpus distribution of its outcomes and adds weights
looked up by hashed features of the history: the word before (bigram), the two before (trigram) and the word two back (skip).

Weights are sharded, not averaged. Each history belongs to one bucket, and in it to one model, by its last word; a model holds the weights of
its own histories and takes AdaGrad steps on all training tokens after them, then scores all
tokens. Buckets hold BUCKET_TOKENS tokens on average, so weights grow with the corpus, and no weight passes
through the driver. The histories of a word too frequent for one bucket are dealt to several by document.

The corpus is cut into blocks of documents, each with its own dictionary. Words meet across blocks in
buckets, packed by block, to get their exact corpus counts; the blocks themselves never move.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parley.llm.common import blocks_by_part, by_bucket, id_crc, id_text, part_of, prepare, with_answers
from parley.plans.scratch import save

HELD_OUT_OF, SMOOTHING = 10, 0.1
#: Documents in a block at most (bytes are bounded too); dictionary entries and tokens in a bucket on average.
BLOCK_ROWS, BUCKET_ENTRIES, BUCKET_TOKENS = 2048, 400_000, 500_000
#: Outcomes of a softmax; words of one band in a last class at most, and digits at most: the table of last classes has 16^5 rows then.
WAYS, CLASS_WORDS, MOST_DIGITS = 16, 1500, 4
#: Tokens that share one set of weights, on average: a bucket's histories are divided again, so that the tables in use stay small.
MODEL_TOKENS = 60_000
#: Weight rows of a feature of one softmax: a power of two, about one for eight tokens between these exponents.
ROW_BITS = (10, 16)
RATE, DAMPING, SLICE, FEATURES = 0.5, 1.0, 1 << 11, 3
#: Minibatches in a pass, and events in one at least and at most.
STEPS, MINIBATCH = 5, (256, 1 << 16)
_FAN_IN, KEY_BITS = 64, 64
_ONES = np.ones(WAYS, np.float32)
#: Share of an outcome that no training token has: squares of it are not yet subnormal numbers, which take many times as long.
_NONE = 1e-18
_START = np.uint32(0x5BD1E995)
_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_TRAINED = np.uint16(1 << 15)
#: Parts of a decimal digit that a token's logarithm travels in: two bytes, off by 0.0001 at most.
_PARTS = 4096

_BLOCK_SCHEMA = (
    "part int, batch int, words binary, hashes binary, counts binary, tokens binary, doc_ids array<long>, fold array<int>, lengths array<int>"
)
_COUNT_SCHEMA = "part int, batch int, bucket int, counts binary, salts binary, tokens long, distinct long, leaf binary, leaf_n binary, leaf_v binary"
_EVENT_SCHEMA = "bucket int, part int, batch int, one binary, runs binary, two binary, code binary"
_SCORE_SCHEMA = "part int, batch int, bucket int, logs binary"


def dictionary(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words as bytes (entry 0, the empty word, is the end), all texts as entry numbers, each with its end, and their lengths."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = lists.flatten()
    real = pc.not_equal(found, "")  # blanks at either end of a text leave empty words
    coded = found.filter(real).dictionary_encode()
    lengths = np.diff(np.r_[0, np.cumsum(np.asarray(real))][np.asarray(lists.offsets)]) + 1
    tokens = np.zeros(lengths.sum(), np.uint32)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(lengths) - 1] = False
    tokens[inner] = np.asarray(coded.indices) + 1
    return pa.concat_arrays([pa.array([b""]), coded.dictionary.cast(pa.binary())]), tokens, lengths


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _M[0]
    x ^= x >> np.uint64(29)
    return x * _M[1]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in words], np.uint32)


def bands(counts: np.ndarray) -> np.ndarray:
    """The power of two of a count, 15 at most; unknown words are with those seen once."""
    return np.minimum(np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1, WAYS - 1).astype(np.int64)


def leaves(hashes: np.ndarray, counts: np.ndarray, digits: int = MOST_DIGITS) -> np.ndarray:
    """The last class of a word: its band, then digits of its hash."""
    tail = (mix(hashes) >> np.uint64(48)).astype(np.int64) >> 4 * (MOST_DIGITS - digits)
    return bands(counts) << 4 * digits | tail


def digits_for(distinct: int) -> int:
    """Digits so that a band's words are CLASS_WORDS or fewer in a last class, on average, up to MOST_DIGITS."""
    digits = 1
    while digits < MOST_DIGITS and distinct > CLASS_WORDS * WAYS**digits:
        digits += 1
    return digits


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block: its dictionary (entry 0, the empty word, is the end), its counts in training rows and in all, and documents as entry numbers."""
    spark = docs.sparkSession
    prepare(spark, BLOCK_ROWS)
    struct = StructType.fromDDL(_BLOCK_SCHEMA)
    arrow = to_arrow_schema(struct)
    rows = id_text(docs, id_col, text_col).select("doc_id", "text", (id_crc(F.col("doc_id")) % HELD_OUT_OF).cast("int").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            if not b.num_rows:
                continue
            words, tokens, lengths = dictionary(b.column("text"))
            fold = np.asarray(b.column("fold"))
            counts = [np.bincount(t, minlength=len(words)).astype(np.uint32) for t in (tokens[np.repeat(fold != 0, lengths)], tokens)]
            names = words.to_numpy(zero_copy_only=False).tolist()  # they hold no blanks, so they travel in one piece
            row = [[part_of(task, k)], [k], [b" ".join(names)], [word_hashes(names).tobytes()], [np.concatenate(counts).tobytes()], [tokens.tobytes()], [b.column("doc_id").to_pylist()], [fold], [lengths]]
            cols = [pa.array(c, f.type) for c, f in zip(row, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return blocks_by_part(rows.mapInArrow(run, struct), "lm_blocks")


def _narrow(numbers: np.ndarray, below: int) -> np.ndarray:
    """In two bytes if they fit: NumPy sorts those by their digits."""
    return numbers.astype(np.uint16) if below <= 1 << 16 else numbers


def _word_buckets(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    return _narrow((hashes.astype(np.int64) * 0x9E3779B1 >> 8) % n_buckets, n_buckets)


def _token_buckets(hashes: np.ndarray, n_buckets: int, spread: np.ndarray | int = 0) -> np.ndarray:
    return (mix(hashes + spread * _M[2]) >> np.uint64(33)) % np.uint64(n_buckets)


def _salts(counts: np.ndarray) -> np.ndarray:
    """Buckets that the histories of words with these counts are dealt to."""
    return np.minimum(1 + counts // max(1, BUCKET_TOKENS // 2), (1 << 32) - 1).astype(np.uint32)


def corpus_counts(found: DataFrame, entries: int) -> DataFrame:
    """By (part, batch, bucket) the training counts of a block's dictionary entries and how many buckets their histories go to; and one row of totals for each bucket."""
    n_buckets = max(1, -(-entries // BUCKET_ENTRIES))
    packed_struct = StructType.fromDDL("bucket int, part int, batch int, words binary, counts binary")
    packed_arrow = to_arrow_schema(packed_struct)
    names = [f.split()[0] for f in _COUNT_SCHEMA.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words, counts = b.column("words")[k].as_py().split(b" "), np.frombuffer(b.column("counts")[k].as_py(), np.uint32).reshape(2, -1)
                order, places = by_bucket(_word_buckets(np.frombuffer(b.column("hashes")[k].as_py(), np.uint32), n_buckets))
                head = [b.column(c)[k].as_py() for c in ("part", "batch")]
                own = [order[s:e] for s, e in places.values()]
                cols = [list(places), [head[0]] * len(own), [head[1]] * len(own), [b" ".join([words[i] for i in o.tolist()]) for o in own], [counts[:, o].tobytes() for o in own]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, packed_arrow, strict=True)], schema=packed_arrow)

    def count(group: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = defaultdict(itertools.count().__next__)
        numbers = [np.fromiter(map(known.__getitem__, x.split(b" ")), np.int64) for x in group["words"]]
        counts = [np.frombuffer(x, np.uint32).reshape(2, -1) for x in group["counts"]]
        which = np.concatenate(numbers)
        trained, every = (np.bincount(which, np.concatenate([c[j] for c in counts]), len(known)).astype(np.int64) for j in (0, 1))
        salts = _salts(every)
        rows = [(part, batch, bucket, trained[n].tobytes(), salts[n].tobytes(), None, None, None, None, None) for part, batch, bucket, n in zip(group["part"], group["batch"], group["bucket"], numbers, strict=True)]
        seen = trained > 0
        leaf, back = np.unique(leaves(word_hashes(list(known)), trained)[seen], return_inverse=True)
        sums = [leaf.astype(np.uint32), np.bincount(back, trained[seen], len(leaf)).astype(np.int64), np.bincount(back, minlength=len(leaf)).astype(np.int64)]
        rows.append((None, None, int(group["bucket"].iloc[0]), None, None, int(trained.sum()), int(seen.sum()), *(x.tobytes() for x in sums)))
        return pd.DataFrame(rows, columns=names).astype({"part": "Int64", "batch": "Int64", "tokens": "Int64", "distinct": "Int64"})

    packed = found.select("part", "batch", "words", "hashes", "counts").mapInArrow(pack, packed_struct)
    return save(packed.groupBy("bucket").applyInPandas(count, _COUNT_SCHEMA), "lm-counts")


class Tree:
    """The classes of words: the corpus distribution of each softmax's outcomes, and of words in the last class."""

    def __init__(self, tokens: int, distinct: int, leaf: np.ndarray, n: np.ndarray, v: np.ndarray) -> None:
        """``leaf``, ``n`` and ``v``: last classes with MOST_DIGITS digits, their training tokens and distinct words."""
        self.tokens, self.distinct, self.digits = tokens, distinct, digits_for(distinct)
        coarse, size = leaf.astype(np.int64) >> 4 * (MOST_DIGITS - self.digits), WAYS ** (self.digits + 1)
        self.n, self.v = (np.bincount(coarse, x, size).astype(np.int64) for x in (n, v))
        # in band 0 every last class can be an unknown word's; elsewhere only those that have words can be met
        weight = self.n.astype(np.float64)
        weight[: size // WAYS] += 0.5
        self.logs, self.single = [], []
        for level in range(self.digits + 1):
            each = weight.reshape(WAYS**level, WAYS, -1).sum(2)
            total = each.sum(1, keepdims=True)
            share = np.where(total > 0, each / np.maximum(total, 1e-300), 1 / WAYS)
            self.logs.append(np.log(np.maximum(share, _NONE)).astype(np.float32))
            self.single.append(share.max(1) == 1)

    def log_share(self, leaf: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | last class). Unknown words have half of what those seen once have, by Good and Turing's argument; all of an empty class."""
        n, v = np.maximum(self.n[leaf], 1), self.v[leaf]
        rare = np.where(v == 0, 1.0, 0.5 / np.where(counts > 0, np.maximum(v, 1), 1))
        return np.log10(np.where(leaf < len(self.n) // WAYS, rare, np.maximum(counts, 1) / n))


def tree_of(counted: DataFrame) -> Tree:
    totals = counted.where("part IS NULL")
    sums = totals.agg(F.sum("tokens"), F.sum("distinct"), F.max("bucket")).first()

    def add(group: pd.DataFrame) -> pd.DataFrame:
        leaf, n, v = (np.frombuffer(b"".join(group[c]), t) for c, t in (("leaf", np.uint32), ("leaf_n", np.int64), ("leaf_v", np.int64)))
        leaf, back = np.unique(leaf, return_inverse=True)
        n, v = (np.bincount(back, x, len(leaf)).astype(np.int64) for x in (n, v))
        return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0]) // _FAN_IN], "leaf": [leaf.tobytes()], "leaf_n": [n.tobytes()], "leaf_v": [v.tobytes()]})

    sparse, last = totals.select("bucket", "leaf", "leaf_n", "leaf_v"), sums[2] or 0
    while last > 0:  # a tree: no task adds more than _FAN_IN of them
        sparse = save(sparse.groupBy(F.floor(F.col("bucket") / _FAN_IN).alias("team")).applyInPandas(add, "bucket int, leaf binary, leaf_n binary, leaf_v binary"), "lm-leaves")
        last //= _FAN_IN
    rows = sparse.collect()  # one row, of 16^5 classes at most
    leaf, n, v = (np.frombuffer(rows[0][c] if rows else b"", t) for c, t in (("leaf", np.uint32), ("leaf_n", np.int64), ("leaf_v", np.int64)))
    return Tree(sums[0] or 0, sums[1] or 0, leaf, n, v)


def histories(tokens: np.ndarray, lengths: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the entries of the word before and of the one before that; ``entries`` where a document starts."""
    begins = np.cumsum(lengths) - lengths
    found = []
    for _ in range(2):
        before = np.empty(len(tokens), np.uint32)
        before[1:] = tokens[:-1]
        before[begins] = entries
        found.append(tokens := before)
    return found[0], found[1]


def _sums(delta: np.ndarray, rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each outcome the sums over the events of each weight row."""
    return (np.bincount(rows, d, size) for d in delta)


class BucketModel:
    """The weights of some of a bucket's histories."""

    def __init__(self, tree: Tree, tokens: int) -> None:
        self.tree, self.levels = tree, tree.digits + 1
        self.bits = min(max(tokens.bit_length() - 3, ROW_BITS[0]), ROW_BITS[1])
        self.weights = [[np.zeros((1 << self.bits, WAYS), np.float32) for _ in range(FEATURES)] for _ in range(self.levels)]

    def rows(self, one: np.ndarray, two: np.ndarray, node: np.ndarray, level: int) -> list[np.ndarray]:
        """The weight rows of each event's features: bigram, trigram and skip, each with the classes before."""
        n = node.view(np.uint64) * np.uint64(8) + np.uint64(level)
        a, c = one.astype(np.uint64) << np.uint64(20), two.astype(np.uint64)
        keys = ((a << np.uint64(12)) ^ n, (a ^ (c + np.uint64(1))) * _M[2] ^ n, (c << np.uint64(24)) ^ n)
        return [(mix(k + np.uint64(f)) >> np.uint64(64 - self.bits)).view(np.int64) for f, k in enumerate(keys)]

    def powers(self, level: int, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """What the chances of an event's outcomes are in proportion to."""
        z = np.take(self.tree.logs[level], node, 0, mode="clip")  # no index is out of range; other modes are slower
        for w, r in zip(self.weights[level], rows, strict=True):
            z += np.take(w, r, 0, mode="clip")
        np.minimum(z, 80, out=z)
        return np.exp(z, out=z)

    def chances(self, level: int, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        z = self.powers(level, node, rows)
        z *= (1 / (z @ _ONES))[:, None]
        return z

    def _missing(self, level: int, node: np.ndarray, rows: list[np.ndarray], outcome: np.ndarray) -> np.ndarray:
        """For each outcome what its chance lacks of what happened, in the type that bincount adds in."""
        delta = np.empty((WAYS, len(node)))
        for s in range(0, len(node), SLICE):
            cut = slice(s, s + SLICE)
            np.negative(self.chances(level, node[cut], [r[cut] for r in rows]).T, out=delta[:, cut])
        delta.ravel()[outcome * len(node) + np.arange(len(node))] += 1
        return delta

    def gradient(self, level: int, node: np.ndarray, rows: list[np.ndarray], outcome: np.ndarray) -> list[np.ndarray]:
        """Of the log probability of all outcomes, by each feature's weights."""
        delta = self._missing(level, node, rows, outcome)
        return [np.stack(list(_sums(delta, r, 1 << self.bits)), 1) for r in rows]

    def _parts(self, one: np.ndarray, two: np.ndarray, code: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
        """(level, events whose outcome is open, the classes before, weight rows, the outcome) for each softmax."""
        for level in range(self.levels):
            shift = 4 * (self.levels - level)
            node = code.astype(np.int64) >> shift
            use = np.flatnonzero(~self.tree.single[level][node])
            node = node[use]
            yield level, use, node, self.rows(one[use], two[use], node, level), (code[use].astype(np.int64) >> (shift - 4)) & (WAYS - 1)

    def _train(self, level: int, node: np.ndarray, rows: list[np.ndarray], outcome: np.ndarray) -> None:
        """One AdaGrad pass over these events, in minibatches of the order they come in."""
        squares = [np.full(w.shape[::-1], DAMPING, np.float32) for w in self.weights[level]]
        steps, root = np.empty((WAYS, 1 << self.bits), np.float32), np.empty(1 << self.bits, np.float32)
        size = min(max(-(-len(node) // STEPS), MINIBATCH[0]), MINIBATCH[1])
        for s in range(0, len(node), size):
            cut = slice(s, s + size)
            delta = self._missing(level, node[cut], [r[cut] for r in rows], outcome[cut])
            for w, sums, r in zip(self.weights[level], squares, rows, strict=True):
                for g, q, total in zip(steps, sums, _sums(delta, r[cut], len(w)), strict=True):  # what belongs to one outcome stays in the cache
                    g[:] = total
                    q += np.square(g, out=root)
                    g *= RATE
                    g /= np.sqrt(q, out=root)
                w += steps.T

    def _add_logs(self, out: np.ndarray, level: int, use: np.ndarray, node: np.ndarray, rows: list[np.ndarray], outcome: np.ndarray) -> None:
        for s in range(0, len(use), SLICE):
            cut = slice(s, s + SLICE)
            z = self.powers(level, node[cut], [r[cut] for r in rows])
            p = z.ravel()[np.arange(0, z.size, WAYS) + outcome[cut]] / (z @ _ONES)
            out[use[cut]] += np.log10(np.maximum(p, 1e-30))

    def learn_and_score(self, one: np.ndarray, two: np.ndarray, code: np.ndarray, learn: np.ndarray, seed: int) -> np.ndarray:
        """Train on the events that ``learn`` marks; then log10 of the probability of each event's last class."""
        rng, out = np.random.default_rng(seed), np.zeros(len(code))
        order = np.r_[rng.permutation(np.flatnonzero(learn)), np.flatnonzero(~learn)]  # so that each pass reads on in one piece
        logs, learnt = np.zeros(len(code)), np.count_nonzero(learn)
        for level, use, node, rows, outcome in self._parts(one[order], two[order], code[order]):
            own = slice(np.searchsorted(use, learnt))
            self._train(level, node[own], [r[own] for r in rows], outcome[own])
            self._add_logs(logs, level, use, node, rows, outcome)
        out[order] = logs
        return out

    def log_chances(self, one: np.ndarray, two: np.ndarray, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each event's last class."""
        out = np.zeros(len(code))
        for level, *event in self._parts(one, two, code):
            self._add_logs(out, level, *event)
        return out


def score_events(tree: Tree, one: np.ndarray, two: np.ndarray, code: np.ndarray, learn: np.ndarray, seed: int) -> np.ndarray:
    """log10 of the probability of each event's last class, by models of about MODEL_TOKENS events that divide the histories by their last word."""
    models = max(1, -(-len(one) // MODEL_TOKENS))
    order, places = by_bucket(_narrow((mix(one) >> np.uint64(13)).view(np.int64) % models, models))
    out = np.empty(len(one))
    for k, (s, e) in places.items():
        own = order[s:e]
        out[own] = BucketModel(tree, len(own)).learn_and_score(one[own], two[own], code[own], learn[own], seed * 1000 + k)
    return out


def _joined(group: pd.DataFrame, column: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(group[column]), dtype)


def _code_type(tree: Tree) -> type:
    return np.uint16 if tree.digits < MOST_DIGITS else np.uint32


def content_order(one: np.ndarray, two: np.ndarray, code: np.ndarray) -> np.ndarray:
    """An order of events that depends on what they are and not on where they come from; ``two`` carries whether an event is learnt."""
    return np.argsort(mix(one.astype(np.uint64) << np.uint64(32) | two) ^ mix(code.astype(np.uint64) + _M[1]))


def _score_bucket(tree: Tree, group: pd.DataFrame) -> pd.DataFrame:
    """Events are learnt in an order of their own content, whatever blocks they came in: equal ones are interchangeable, so the weights do not depend on how the table is cut into files."""
    one = np.repeat(_joined(group, "one", np.uint32), _joined(group, "runs", np.uint32))
    two, code = _joined(group, "two", np.uint16), _joined(group, "code", _code_type(tree))
    order = content_order(one, two, code)
    logs = np.empty(len(one))
    logs[order] = score_events(tree, one[order], (two & ~_TRAINED)[order], code[order], ((two & _TRAINED) != 0)[order], int(group["bucket"].iloc[0]))
    sizes = group["two"].map(len).to_numpy() // 2
    ends = np.cumsum(sizes)
    parts = np.minimum(np.round(-logs * _PARTS), 65_535).astype(np.uint16)
    return pd.DataFrame({"part": group["part"], "batch": group["batch"], "bucket": group["bucket"], "logs": [parts[e - n : e].tobytes() for n, e in zip(sizes, ends, strict=True)]})


class _Block:
    """A block with the answers to its dictionary entries."""

    def __init__(self, b: pa.RecordBatch, k: int, n_buckets: int) -> None:
        self.part, self.batch = b.column("part")[k].as_py(), b.column("batch")[k].as_py()
        self.hashes = np.frombuffer(b.column("hashes")[k].as_py(), np.uint32)
        self.tokens = np.frombuffer(b.column("tokens")[k].as_py(), np.uint32)
        self.lengths = np.asarray(b.column("lengths")[k].values).astype(np.int64)
        self.fold = np.asarray(b.column("fold")[k].values)
        self.ids = b.column("doc_ids")[k].values.fill_null(0).to_numpy().view(np.uint64)
        self.counts, self.salts = np.empty(len(self.hashes), np.int64), np.empty(len(self.hashes), np.uint32)
        order, places = by_bucket(_word_buckets(self.hashes, n_buckets))
        for x in b.column("answers")[k].as_py():
            own = order[slice(*places[x["bucket"]])]
            self.counts[own], self.salts[own] = np.frombuffer(x["counts"], np.int64), np.frombuffer(x["salts"], np.uint32)

    def dealt(self, documents: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's tokens in order of bucket and of the word before, with their buckets and histories in that order.

        A frequent word's histories are dealt by document id, so that a document goes the same way in any block.
        """
        entries, hashes = len(self.hashes), np.append(self.hashes, _START)
        last, second = histories(self.tokens, self.lengths, entries)
        salts = np.append(self.salts, _salts(np.array([documents])))
        bucket = _token_buckets(hashes, n_buckets)[last]
        hot = np.flatnonzero(salts[last] > 1)
        document = np.repeat(np.arange(len(self.lengths)), self.lengths)[hot]
        bucket[hot] = _token_buckets(hashes[last[hot]], n_buckets, (mix(self.ids) >> np.uint64(32))[document] % salts[last[hot]])
        # a history's entry tells it from others as well as its hash; with the token's place in the key, sorts of any kind agree
        history, bits = bucket * np.uint64(entries + 1) + last, np.uint64(len(last).bit_length())
        if n_buckets * (entries + 1) << int(bits) <= 1 << KEY_BITS:
            order = (np.sort(history << bits | np.arange(len(last), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
        else:
            order = np.argsort(history, kind="stable")
        two = (mix(hashes) >> np.uint64(49)).astype(np.uint16)
        return order, _narrow(bucket[order].view(np.int64), n_buckets), hashes[last[order]], two[second[order]]

    def events(self, tree: Tree, documents: int, n_buckets: int) -> dict[str, list]:
        """Tokens for each bucket; the hash of the word before is sent once for each run of it."""
        order, bucket, one, two = self.dealt(documents, n_buckets)
        two |= np.repeat(np.where(self.fold != 0, _TRAINED, np.uint16(0)), self.lengths)[order]
        code = leaves(self.hashes, self.counts, tree.digits).astype(_code_type(tree))[self.tokens[order]]
        run = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (bucket[1:] != bucket[:-1])])
        length = np.diff(np.r_[run, len(one)]).astype(np.uint32)
        _, places = by_bucket(bucket)
        rows = [slice(*np.searchsorted(run, e).tolist()) for e in places.values()]
        cut = lambda column: [column[s:e].tobytes() for s, e in places.values()]
        return {
            "bucket": list(places), "part": [self.part] * len(rows), "batch": [self.batch] * len(rows),
            "one": [one[run[r]].tobytes() for r in rows], "runs": [length[r].tobytes() for r in rows], "two": cut(two), "code": cut(code),
        }

    def logs(self, found: list[dict], documents: int, n_buckets: int) -> np.ndarray:
        """log10 of the probability of each token's last class, from what the buckets returned."""
        order, bucket, _, _ = self.dealt(documents, n_buckets)
        _, places = by_bucket(bucket)
        out = np.empty(len(order))
        for x in found:
            out[order[slice(*places[x["bucket"]])]] = np.frombuffer(x["logs"], np.uint16) / -_PARTS
        return out


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Learns from rows whose crc32(id as text) mod 10 is not 0 (a null id counts as the empty text: held out) and scores all.
    A null text counts as empty: one end token. Repeated rows are learnt from and
    scored each. Without training rows N and V are 0, every word is unknown and the
    softmaxes stay as they are. A text needs about 60 bytes of memory for each of its tokens. An empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    found = blocks(docs, id_col, text_col)
    entries, documents, tokens = (x or 0 for x in found.agg(F.sum(F.octet_length("hashes") / 4).cast("long"), F.sum(F.size("lengths")), F.sum(F.octet_length("tokens") / 4).cast("long")).first())
    prepare(spark, 1)
    counted = corpus_counts(found, entries)
    tree = tree_of(counted)
    shared = spark.sparkContext.broadcast(tree)  # 16^5 classes at most, whatever the corpus
    word_buckets, token_buckets = max(1, -(-entries // BUCKET_ENTRIES)), max(1, -(-tokens // BUCKET_TOKENS))
    answered = with_answers(found, counted.where("part IS NOT NULL"), "answers", "bucket", "counts", "salts")
    event, event_arrow = StructType.fromDDL(_EVENT_SCHEMA), to_arrow_schema(StructType.fromDDL(_EVENT_SCHEMA))
    base = ["part", "batch", "hashes", "tokens", "fold", "lengths", "doc_ids", "answers"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                cols = _Block(b, k, word_buckets).events(shared.value, documents, token_buckets)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in event_arrow], schema=event_arrow)

    def scored(group: pd.DataFrame) -> pd.DataFrame:
        return _score_bucket(shared.value, group)

    scores = answered.select(*base).mapInArrow(send, event).groupBy("bucket").applyInPandas(scored, _SCORE_SCHEMA)
    struct = StructType.fromDDL("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    arrow = to_arrow_schema(struct)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            for k in range(b.num_rows):
                x = _Block(b, k, word_buckets)
                chance = np.log10((x.counts + SMOOTHING) / (t.tokens + SMOOTHING * (t.distinct + 1)))
                share = t.log_share(leaves(x.hashes, x.counts, t.digits), x.counts)
                begins = np.cumsum(x.lengths) - x.lengths
                total = lambda values: np.add.reduceat(values[x.tokens], begins)  # noqa: E731, B023
                score = np.add.reduceat(x.logs(b.column("found")[k].as_py(), documents, token_buckets) + share[x.tokens], begins)
                cols = [b.column("doc_ids")[k].values, x.fold == 0, x.lengths, total((x.counts > 0).astype(np.int64)), np.full(len(x.lengths), t.tokens), total(chance), score]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    gathered = with_answers(answered, scores, "found", "bucket", "logs").select(*base, "found")
    out = save(gathered.mapInArrow(gather, struct), "lm-scores")
    prepare(spark)
    return out
