"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfline.session import shared_dir, ship_package

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder that all executors share and read it back: the lineage ends there, so a lost executor costs
    no recomputation and several readers share one computation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/shelfline-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def uniform(*parts: Column) -> Column:
    """Reproducible number in (0, 1) drawn from the values given."""
    return ((F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52)))
