"""Attachments: filters, pages, counts and runs by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators import paging

PAGE = 80
# Payload files that are no media, and extensions that are shown as pictures or films.
PAYLOAD = "%.pluginPayloadAttachment"
VISUAL = r"(?i)\.(heic|heif|mov|mp4)$"


def is_media(filename: Column) -> Column:
    """Files without a name count as media."""
    return filename.isNull() | ~filename.ilike(PAYLOAD)


def is_visual(mime: Column, filename: Column) -> Column:
    return F.coalesce(mime.ilike("image/%"), F.lit(False)) | F.coalesce(mime.ilike("video/%"), F.lit(False)) | F.coalesce(filename.rlike(VISUAL), F.lit(False))


def mime_of(mime: Column, filename: Column) -> Column:
    """The stored type, else one guessed from the extension."""
    ext = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    guess = F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext.isin("png", "gif", "webp", "heic", "heif"), F.concat(F.lit("image/"), ext)).when(ext == "mov", "video/quicktime").when(ext == "mp4", "video/mp4").when(ext == "pdf", "application/pdf")
    return F.coalesce(mime, guess, F.lit("application/octet-stream"))


def media(attachments: DataFrame, visual_only: bool = False) -> DataFrame:
    rows = attachments.where(is_media(F.col("filename")))
    return rows.where(is_visual(F.col("mime"), F.col("filename"))) if visual_only else rows


def media_page(attachments: DataFrame, visual_only: bool = False, limit: int = PAGE, **cursor) -> DataFrame:
    """A keyset page in (ts, att_id) order, each attachment once for each place it was sent."""
    return paging.page(media(attachments, visual_only).distinct(), "ts", "att_id", limit=limit, **cursor)


def media_count(attachments: DataFrame, visual_only: bool = False) -> DataFrame:
    """Distinct attachments; those without a name count."""
    return media(attachments, visual_only).agg(F.countDistinct("att_id").alias("n"))


def named_count(attachments: DataFrame) -> DataFrame:
    """All sent attachments with a name, repeats included."""
    return attachments.where(~F.col("filename").ilike(PAYLOAD)).agg(F.count("*").alias("n"))


def media_bounds(attachments: DataFrame, visual_only: bool = False) -> DataFrame:
    return media(attachments, visual_only).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def first_places(attachments: DataFrame) -> DataFrame:
    """Each attachment once, where it was first sent."""
    return attachments.groupBy("att_id").agg(F.min(F.struct("ts", "msg_id", "mime", "filename")).alias("x")).select("att_id", "x.*")


def month_sections(attachments: DataFrame, visual_only: bool = False) -> DataFrame:
    """(month, n, first_ts, last_ts): the sections of a media listing."""
    rows = media(attachments, visual_only).groupBy(F.date_format("ts", "yyyy-MM").alias("month"))
    return rows.agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def message_attachments(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """(msg_id, files): attachments of a page of messages, in order of id."""
    rows = attachments.join(messages.select("msg_id").distinct(), "msg_id", "left_semi")
    return rows.groupBy("msg_id").agg(F.array_sort(F.collect_set(F.struct("att_id", "mime", "filename"))).alias("files"))


def newest(attachments: DataFrame, n: int = PAGE) -> DataFrame:
    w = Window.partitionBy("att_id").orderBy("ts", "msg_id")
    return media(attachments).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k").orderBy(F.desc("ts"), F.desc("att_id")).limit(n)
