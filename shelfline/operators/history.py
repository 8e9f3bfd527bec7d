"""Price history over append-only observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shelfline.functions.text import finite
from shelfline.operators.pricing import first_per


def valid_observations(offers: DataFrame) -> DataFrame:
    return offers.filter(finite(F.col("price")) & (F.col("price") >= 0))


def batch_minimum(observations: DataFrame) -> DataFrame:
    """Cheapest observation per product, instant and currency."""
    return first_per(observations, ["product_key", "observed_at", "currency"], ["price", "id"])


def price_history(observations: DataFrame, limit: int = 10) -> DataFrame:
    """Newest batch minima of every product; the limit stays between 1 and 100."""
    newest = Window.partitionBy("product_key").orderBy(F.desc("observed_at"), "currency")
    return (batch_minimum(observations).withColumn("place", F.row_number().over(newest))
            .filter(F.col("place") <= min(max(int(limit), 1), 100))
            .select("product_key", "observed_at", "price", "currency", "source", "place"))


def min_price_trend(observations: DataFrame) -> DataFrame:
    """Change of the batch minimum against the previous batch of the same product and currency."""
    minima = observations.groupBy("product_key", "currency", "observed_at").agg(F.min("price").alias("min_price"))
    before = F.lag("min_price").over(Window.partitionBy("product_key", "currency").orderBy("observed_at"))
    return minima.withColumn("previous_price", before).withColumn("change", F.col("min_price") - F.col("previous_price"))
