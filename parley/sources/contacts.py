"""Contact cards from many files, and who a handle belongs to."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import handle_key, text_or_empty
from parley.plans.scratch import save, ship_package

# The tables and columns of an address book.
_CARDS = "SELECT Z_PK, ZFIRSTNAME, ZLASTNAME, ZNICKNAME, ZORGANIZATION, coalesce(nullif(ZTHUMBNAILIMAGEDATA, x''), ZIMAGEDATA) FROM ZABCDRECORD"
_ADDRESSES = ("SELECT ZOWNER, ZFULLNUMBER FROM ZABCDPHONENUMBER", "SELECT ZOWNER, ZADDRESS FROM ZABCDEMAILADDRESS")

_ROW = "file string, kind string, card long, first string, last string, nick string, org string, image binary, value string, error string"


def _book_rows(file: str, content: bytes) -> Iterator[dict]:
    """Cards and addresses of one address book, then an error if it ends in one; what was read before it counts."""
    conn = sqlite3.connect(":memory:")
    try:
        conn.deserialize(content)
        for pk, first, last, nick, org, image in conn.execute(_CARDS):
            yield {"file": file, "kind": "card", "card": pk, "first": first, "last": last, "nick": nick, "org": org, "image": image}
        for sql in _ADDRESSES:
            for owner, value in conn.execute(sql):
                if owner is not None and value:
                    yield {"file": file, "kind": "address", "card": owner, "value": value}
    except (sqlite3.Error, ValueError, TypeError) as e:
        yield {"file": file, "kind": "error", "error": f"{type(e).__name__}: {e}"}
    finally:
        conn.close()


def read_books(spark: SparkSession, patterns: Sequence[str], files: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cards, addresses, errors) of all address books that match the patterns, as ``directory`` takes them.

    A book is read whole by one task, ``files`` at a time; a broken one is reported in errors (file, error) and the others are read all the same. A later
    pattern's books come after those of an earlier one, and books of a pattern by name.
    """
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [part.split()[0] for part in _ROW.split(", ")]
        for b in batches:
            for file, content in zip(b["file"], b["content"], strict=True):
                found = pd.DataFrame(_book_rows(file, bytes(content)), columns=columns, dtype=object)
                if len(found):
                    yield found

    books = None
    for k, pattern in enumerate(patterns):
        part = spark.read.format("binaryFile").load(pattern).select(F.concat(F.lit(f"{k:06d}:"), "path").alias("file"), "content")
        books = part if books is None else books.unionByName(part)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(files))
    rows = save(books.mapInPandas(run, _ROW), "address-books")
    cards = rows.where("kind = 'card'").select("card", F.col("file").alias("file_order"), "first", "last", "nick", "org", "image")
    return cards, rows.where("kind = 'address'").select("card", F.col("file").alias("file_order"), "value"), rows.where("kind = 'error'").select("file", "error")


def card_names(cards: DataFrame) -> DataFrame:
    """Add name: first and last, else nickname, else organisation; null without any."""
    full = F.nullif(F.trim(F.concat_ws(" ", F.nullif("first", F.lit("")), F.nullif("last", F.lit("")))), F.lit(""))
    return cards.withColumn("name", F.coalesce(full, F.nullif("nick", F.lit("")), F.nullif("org", F.lit(""))))


def directory(cards: DataFrame, addresses: DataFrame) -> DataFrame:
    """(handle_key, name, owner): a later file (column file_order) overrides an earlier one.

    ``cards``: card, file_order, first, last, nick, org. ``addresses``: card, file_order, value.
    """
    rows = addresses.join(card_names(cards), ["card", "file_order"]).withColumn("handle_key", handle_key(F.col("value")))
    best = F.max_by(F.struct("name", F.col("card").alias("owner")), F.struct("file_order", "card"))
    return rows.where("handle_key IS NOT NULL AND name IS NOT NULL").groupBy("handle_key").agg(best.alias("b")).select("handle_key", "b.*")


def resolve(handles: DataFrame, contacts: DataFrame, handle: str = "handle") -> DataFrame:
    """Add handle_key, name and person: the card that owns the handle, else the key itself."""
    rows = handles.withColumn("handle_key", handle_key(F.col(handle))).join(contacts, "handle_key", "left")
    return rows.withColumn("person", F.coalesce(F.concat(F.lit("card:"), F.col("owner").cast("string")), "handle_key")).drop("owner")


def photos(cards: DataFrame) -> DataFrame:
    """(card, kind, image): pictures without their version byte; an image that two names share is a placeholder and goes."""
    body = F.substr("image", F.lit(2))
    head = F.hex(F.substring("image", 2, 4))
    kind = F.when(head == "89504E47", "png").when(F.startswith(head, F.lit("FFD8")), "jpeg")
    rows = card_names(cards).where(F.octet_length("image") > 100).select("card", "name", kind.alias("kind"), body.alias("image"), F.sha2("image", 256).alias("h")).where("kind IS NOT NULL")
    single = rows.groupBy("h").agg(F.countDistinct(text_or_empty(F.col("name"))).alias("n")).where("n = 1").select("h")
    return rows.join(single, "h", "left_semi").select("card", "kind", "image")
