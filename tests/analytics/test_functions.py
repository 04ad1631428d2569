import datetime as dt

import pytest
from pyspark.sql import functions as F

from parley.functions import chat, timing
from parley.operators import runs


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_archive_clock(spark):
    assert one(spark, timing.from_archive_ns(F.lit(1_500_000_001_999))) == dt.datetime(2001, 1, 1, 0, 25, 0, 1)
    assert one(spark, timing.to_archive_ns(F.lit("2001-01-02"))) == 86_400_000_000_000


@pytest.mark.parametrize(("day", "want"), [("2024-05-10", "Today"), ("2024-05-09", "Yesterday"), ("2024-05-06", "Monday"), ("2024-02-01", "February 1"), ("2023-02-01", "February 1, 2023")])
def test_day_labels(spark, day, want):
    assert one(spark, timing.day_label(F.lit(day), F.lit("2024-05-10"))) == want


def test_labels_and_estimates(spark):
    assert one(spark, timing.month_label(F.lit("2024-05"))) == "May 2024" and one(spark, timing.short_month(F.lit("2024-05"))) == "May 24"
    assert [one(spark, timing.gap_label(F.lit(s))) for s in (30, 90, 7200, 200_000)] == ["30 s", "2 min", "2 h", "2 d"]
    assert one(spark, timing.eta_seconds(F.lit(10), F.lit(30), F.lit(5.0))) == 10.0
    assert one(spark, timing.week_start(F.lit("2024-05-10").cast("date"))) == dt.date(2024, 5, 5)
    assert one(spark, timing.cloud_size(F.lit(5), F.lit(5))) == 1.0


def test_prompts(spark):
    none = F.lit(None).cast("string")
    text = one(spark, chat.system_prompt(F.lit("Ann"), F.lit(" Bob \n Lee ")))
    assert one(spark, chat.peer_of(F.lit(text))) == "Bob Lee"
    assert one(spark, chat.peer_of(chat.system_prompt(none, none))) == "" and one(spark, chat.peer_label(F.lit(" "))) == "this contact"


def test_run_folders(spark, tmp_path):
    for k, day in (("a", "2024-01-01"), ("b", "2024-02-01")):
        (tmp_path / k).mkdir()
        (tmp_path / k / "run.json").write_text(f'{{"created": "{day}T00:00:00Z", "model": "m"}}')
    assert [r.run for r in runs.registry(spark, str(tmp_path)).collect()] == ["b", "a"]
    paths = spark.createDataFrame([("/x/0000200_adapters.bin",), ("/x/final.bin",)], "path string")
    assert [r.step for r in runs.checkpoint_steps(paths).collect()] == [200]
    c = runs.parse_checkpoint(F.lit("m/r/200"))
    assert [one(spark, c[k]) for k in ("model", "run", "step")] == ["m", "r", 200]
