"""Intermediate tables in the folder that the whole cluster shares.

Spark recomputes lost partitions from lineage; long lineages and reused
intermediates are cut by writing a Parquet table instead. Such a table is
readable from every executor, so losing one costs nothing but a re-read.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a temporary folder if driver and executors are one process, as in tests.

    Elsewhere every executor would write to a disk of its own, so that the setting is required.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the whole cluster shares (master {master})")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="parley-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/parley/{uuid.uuid4().hex}/{name}"


#: Rows of a narrow table in one file, where their number is known.
FILE_ROWS = 200_000


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind: the table stands for them, and the driver may not collect its garbage for long."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def save(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    With ``rows``, about how many narrow rows there are, it is written in so many tasks and files as they need.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession, rows: int = 10_000) -> None:
    """Rows in an Arrow batch from now on; operators that need other bounds set their own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="parley-src-")) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, os.path.join(root.name, path.relative_to(root)))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)
