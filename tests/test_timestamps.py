"""Moments in every ISO form, compared with the standard library."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from shelfline.functions.text import parse_timestamp

TEXTS = ["2024-01-15", "20240115", "2024-W03-1", "2024W031", "2024-W03", "2024W03",
         "2020-W53-7", "2021-W53-1", "2024-W00-1", "2024-W54", "2024-W01-8", "2024-W01-0",
         "2024-01-15T10", "2024-01-15T1030", "2024-01-15 10:30", "2024-01-15T103015", "2024-01-15T10:30:15.5", "2024-01-15T10:30:15,123456789",
         "2024-01-15T10:30Z", "2024-01-15T10:30z", "2024-01-15T10:30:15+03", "2024-01-15T10:30:15-0330", "2024-01-15T10:30:15+03:30:15", "2024-01-15x10:30",
         "2024-02-30", "2024-13-01", "2024-01-15T25:00", "2024-01-15T10:60", "2024-01", "yesterday",
         "", "2024-1-5", "2024-01-15T", "2024-01-15T10:30+25:00", "2024-0115", "20240115T10:30:00Z",
         "2024-01-15T10:3", "2024-001", None, "0001-01-01", "2024-01-15T10:30:15.", "2024-01-15T10:30:15+03:3"]


def moment(text):
    try:
        found = datetime.fromisoformat((text or "").replace("Z", "+00:00"))
    except ValueError:
        return None
    found = found if found.tzinfo else found.replace(tzinfo=timezone.utc)
    return int(found.timestamp()) * 1_000_000 + found.microsecond


def test_iso_moments(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, x string").select("i", F.unix_micros(parse_timestamp(F.col("x"))).alias("t")).collect()
    assert {TEXTS[r.i]: r.t for r in rows} == {t: moment(t) for t in TEXTS}
