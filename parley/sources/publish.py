"""Tables that appear whole or not at all.

A writer puts data into a folder that nothing reads. Then it writes a manifest, a small JSON file that names the
folders, and renames it into its place: that is the commit. Readers follow the newest manifest only, so that
what a writer left behind when it died is never taken for a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "manifests"


class Conflict(Exception):
    """Another writer has committed this number."""


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path: any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def newest(spark: SparkSession, root: str) -> tuple[int, dict] | None:
    """The number and content of the newest manifest under ``root``, None before the first commit."""
    fs, at = _fs(spark, f"{root}/{MANIFESTS}")
    if not fs.exists(at):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", "."))]
    if not numbers:
        return None
    text = spark.read.text(f"{root}/{MANIFESTS}/{max(numbers):012d}.json", wholetext=True).first()[0]
    return max(numbers), json.loads(text)


def commit(spark: SparkSession, root: str, number: int, body: dict) -> None:
    """Make ``body`` manifest ``number``; one writer at a time, a second one that comes late fails."""
    final = f"{root}/{MANIFESTS}/{number:012d}.json"
    fs, staged = _fs(spark, f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}.staged")
    _, target = _fs(spark, final)
    fs.mkdirs(target.getParent())
    out = fs.create(staged, True)
    out.writeBytes(json.dumps(body))  # ASCII
    out.close()
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        raise Conflict(final)


def new_folder(root: str) -> str:
    return f"{root}/data/{uuid.uuid4().hex}"


def find(spark: SparkSession, root: str, version: str) -> str | None:
    """The folder of a version that was committed."""
    found = newest(spark, root)
    return found[1].get(version) if found else None


def add(spark: SparkSession, root: str, version: str, path: str) -> str:
    """Commit a version's folder beside the others; the folder that counts, which is another's if that writer was first."""
    while True:
        found = newest(spark, root)
        number, tables = found or (0, {})
        if version in tables:
            return tables[version]
        try:
            commit(spark, root, number + 1, {**tables, version: path})
        except Conflict:  # another version came between
            continue
        return path


def publish(spark: SparkSession, root: str, version: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of one version: made and written under ``root`` if no commit names it yet, and read from there.

    Versions stay side by side, so readers of an older one are not disturbed.
    """
    path = find(spark, root, version)
    if path is None:
        path = new_folder(root)
        make().write.parquet(path)
        path = add(spark, root, version, path)
    return spark.read.parquet(path)
