"""A data source that reads a SQLite table, split into ranges of row ids.

``scan`` reads the columns that are asked for and lets the store evaluate comparisons, so that neither other columns nor other
rows cross into Spark. The file must be readable on every executor; it is opened read-only.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_KINDS = {"INT": "bigint", "CHAR": "string", "TEXT": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double"}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Options: path, table, rows (row ids in a partition, 500,000 by default), pushdown (see ``scan``)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        table = self.options["table"]
        with _open(self.options["path"]) as conn:
            info = conn.execute("SELECT name, type FROM pragma_table_info(?)", (table,)).fetchall()
        kind = lambda t: next((k for mark, k in _KINDS.items() if mark in (t or "").upper()), "string")
        return ", ".join(["rowid bigint", *(f"`{n}` {kind(t)}" for n, t in info if n.lower() != "rowid")])

    def reader(self, schema: StructType) -> SqliteReader:
        return (PushingReader if self.options.get("pushdown") == "true" else SqliteReader)(schema, dict(self.options))


#: Comparisons whose meaning is the same in the store for numbers, and for texts compared byte by byte.
_SIGNS = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
_VALUES = (int, float, str, bytes)


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        self.names, self.options = schema.names, options
        self.where: list[tuple[str, list]] = []  # conditions and their values
        self.on_rows: list[tuple[str, list]] = []  # those on row ids, which narrow the ranges

    def _condition(self, f: D.Filter) -> tuple[str, list] | None:
        if isinstance(f, D.Not):
            inner = self._condition(f.child)
            return inner and (f"NOT ({inner[0]})", inner[1])
        if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in self.kinds:
            return None
        name = f'"{f.attribute[0]}"'
        if isinstance(f, D.IsNull | D.IsNotNull):
            return f"{name} IS {'NOT ' if isinstance(f, D.IsNotNull) else ''}NULL", []
        if isinstance(f, D.In) and f.value and all(isinstance(v, _VALUES) for v in f.value):
            return f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)
        if type(f) in _SIGNS and isinstance(f.value, _VALUES) and f.value == f.value:
            return f"{name} {_SIGNS[type(f)]} ?", [f.value]
        return None

    def _sql(self, what: str, conditions: list[tuple[str, list]]) -> tuple[str, list]:
        where = " AND ".join(f"({c})" for c, _ in conditions) or "1"
        return f'SELECT {what} FROM "{self.options["table"]}" WHERE {where}', [v for _, values in conditions for v in values]

    def partitions(self) -> list[Range]:
        size = int(self.options.get("rows", 500_000))
        with _open(self.options["path"]) as conn:
            low, high = conn.execute(*self._sql("min(rowid), max(rowid)", self.on_rows)).fetchone()
        return [Range(k, k + size) for k in range(low, high + 1, size)] if low is not None else [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        columns = ", ".join(f'"{n}"' for n in self.names)
        rows = ("rowid >= ? AND rowid < ?", [partition.low, partition.high])
        with _open(self.options["path"]) as conn:
            yield from conn.execute(*self._sql(columns, [rows, *self.where]))


class PushingReader(SqliteReader):
    """A reader for sessions in which Spark hands its filters over."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        """Take what the store can evaluate; the rest is Spark's."""
        for f in filters:
            said = self._condition(f)
            if said is None:
                yield f
                continue
            self.where.append(said)
            if getattr(f, "attribute", None) == ("rowid",):
                self.on_rows.append(said)


def scan(spark: SparkSession, path: str, table: str, columns: Sequence[str] | None = None, rows: int = 500_000) -> DataFrame:
    """A table of the store: only ``columns`` are read from it, in partitions of ``rows`` row ids; comparisons of a ``where`` on it go to the store."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    options = {"path": path, "table": table, "rows": str(rows), "pushdown": "true"}
    reader = spark.read.format("sqlite").options(**options)
    if columns is None:
        return reader.load()
    kinds = dict(part.rsplit(" ", 1) for part in SqliteSource(options).schema().split(", "))
    named = {n.strip("`"): k for n, k in kinds.items()}
    return reader.schema(", ".join(f"`{c}` {named[c]}" for c in columns)).load()
