"""A search index that grows by segments and is searched while it does.

Each increment is written as a segment of its own: postings in order of term, and lengths. A manifest names the segments
that count, how many documents and words they hold, and up to which message the source was read; committing it is what
makes an increment visible (``sources.publish``). Searches read all segments of the newest manifest as one index. When there are many,
the smallest are merged into one. An increment that is run again after a failure finds its number in the manifest and does nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators.search import Index, build_index, read_segments, write_segment
from parley.plans.scratch import save
from parley.sources import publish
from parley.streaming.index import VERSION, indexable, plan_increment

#: Segments at most before the smallest are merged, and how many are left then.
MOST_SEGMENTS, MERGED_TO = 8, 4


@dataclass
class Store:
    """Segments under ``root`` of documents named by ``doc_id``; ``mark`` is a number that grows with the source."""

    spark: SparkSession
    root: str
    doc_id: str = "doc_id"
    mark: str = "doc_id"
    columns: tuple[str, ...] = ("body",)
    stemming: bool = True

    def state(self) -> tuple[int, dict]:
        """The newest manifest; an empty one if there is none or if it is of another version of the index."""
        found = publish.newest(self.spark, self.root)
        empty = {"version": VERSION, "last_msg_id": -1, "streams": {}, "segments": []}
        if found is None:
            return 0, empty
        return found[0], found[1] if found[1].get("version") == VERSION else empty

    def index(self) -> Index:
        """All segments as one index; totals come from the manifest."""
        segments = self.state()[1]["segments"]
        if not segments:
            raise LookupError(f"nothing is indexed under {self.root}")
        index = read_segments(self.spark, [s["path"] for s in segments], self.stemming)
        n = sum(s["n"] for s in segments)
        index.totals = (n, sum(s["words"] for s in segments) / n if n else 1.0)
        return index

    def refresh(self, source: DataFrame) -> str:
        """Bring the index up to the source: what was done (none, append or rebuild). A source that shrank is indexed anew."""
        number, state = self.state()
        found = publish.newest(self.spark, self.root)
        todo = plan_increment(source.select(F.col(self.mark).alias("msg_id")), found[1] if found else state)
        if todo == "append":
            self._commit(number, state, source.where(F.col(self.mark) > state["last_msg_id"]))
        elif todo == "rebuild":
            self._commit(number, {**state, "last_msg_id": -1, "segments": []}, source)
        return todo

    def append(self, docs: DataFrame, stream: str | None = None, batch: int = 0) -> None:
        """Add one increment; with ``stream``, once for each batch number of that stream."""
        number, state = self.state()
        if stream is not None and state["streams"].get(stream, -1) >= batch:
            return
        streams = state["streams"] if stream is None else {**state["streams"], stream: batch}
        self._commit(number, {**state, "streams": streams}, docs)

    def _commit(self, number: int, state: dict, docs: DataFrame) -> None:
        fresh = save(indexable(docs).dropDuplicates([self.doc_id]), "segment-docs")
        low, high = fresh.agg(F.min(self.mark), F.max(self.mark)).first()
        seen = [s["path"] for s in state["segments"] if high is not None and s["low"] <= high and s["high"] >= low]
        if seen:  # only segments whose range of marks meets this one's can hold the same documents
            known = self.spark.read.parquet(*(f"{p}/lengths" for p in seen)).select(F.col("doc_id").alias("_known"))
            fresh = save(fresh.join(known, F.col(self.doc_id) == F.col("_known"), "left_anti"), "segment-docs")
        newest = docs.agg(F.max(self.mark)).first()[0]
        segments = list(state["segments"])
        if not fresh.isEmpty():
            path = publish.new_folder(self.root)
            lengths = build_index(fresh, self.doc_id, self.columns, self.stemming, path).lengths
            segments.append(_segment(path, lengths, *fresh.agg(F.min(self.mark), F.max(self.mark)).first()))
        if len(segments) > MOST_SEGMENTS:
            segments = self._merged(segments)
        publish.commit(self.spark, self.root, number + 1, {**state, "last_msg_id": max(-1 if newest is None else newest, state["last_msg_id"]), "segments": segments})

    def _merged(self, segments: list[dict]) -> list[dict]:
        """The smallest segments as one, so that a document is written again about log n times."""
        by_size = sorted(segments, key=lambda s: s["n"])
        small, kept = by_size[: len(segments) - MERGED_TO + 1], by_size[len(segments) - MERGED_TO + 1 :]
        both = read_segments(self.spark, [s["path"] for s in small], self.stemming)
        path = publish.new_folder(self.root)
        write_segment(both.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), both.lengths, path)
        return [*kept, {"path": path, "n": sum(s["n"] for s in small), "words": sum(s["words"] for s in small), "low": min(s["low"] for s in small), "high": max(s["high"] for s in small)}]


def _segment(path: str, lengths: DataFrame, low: int, high: int) -> dict:
    n, words = lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return {"path": path, "n": n, "words": words, "low": low, "high": high}


def stream_index(rows: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Index a stream of documents, a segment for each micro-batch, up to what has come so far; the same checkpoint goes on from there."""
    return rows.writeStream.foreachBatch(lambda batch, number: store.append(batch, checkpoint, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
