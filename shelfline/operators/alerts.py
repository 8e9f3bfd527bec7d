"""Price-drop subscriptions: evaluation and toggling."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shelfline.functions.text import finite
from shelfline.operators.pricing import lowest_price

KEY = ["chat_id", "product_key"]
VALUES = ["title", "query", "price", "currency"]


def evaluate_alerts(subscriptions: DataFrame, offers: DataFrame, now: Column) -> DataFrame:
    """Subscriptions with ``fired``; a fired one gets the new price as its baseline."""
    lowest = lowest_price(offers).select("product_key", F.col("currency_key").alias("_currency"),
                                         F.col("price").alias("current_price"), F.col("source").alias("current_source"),
                                         F.col("url").alias("current_url"))
    active = subscriptions.filter("active").withColumn("_currency", F.lower("currency"))
    joined = active.join(lowest, ["product_key", "_currency"], "left").drop("_currency")
    fired = F.coalesce(F.col("current_price") < F.col("last_notified_price"), F.lit(False))
    return joined.withColumns({
        "fired": fired,
        "new_baseline": F.when(fired, F.col("current_price")).otherwise(F.col("last_notified_price")),
        "checked_at": now,
    })


def toggle_alerts(state: DataFrame, toggles: DataFrame, now: Column) -> DataFrame:
    """State after a batch of toggles, applied per key in order of ``position``.

    Every valid toggle flips the subscription. The values come from the toggle that switched it on last:
    the last one if the result is active, else the one before it.
    """
    keyed = reduce(and_, [F.col(k).isNotNull() for k in KEY])
    valid = toggles.filter(finite(F.col("price")) & (F.col("price") >= 0) & keyed)
    carried = [c for c in state.columns if c not in KEY]
    nothing = lambda df, names: F.lit(None).cast(T.StructType([df.schema[c] for c in names]))
    # states stand behind the toggles of their key, so one sorted reading of both gives all that a key needs
    both = state.select(*KEY, F.lit(0).alias("_toggle"), F.lit(None).cast(dict(toggles.dtypes)["position"]).alias("position"),
                        nothing(toggles, VALUES).alias("_value"), F.struct(*carried).alias("_state")).unionByName(
        valid.select(*KEY, F.lit(1).alias("_toggle"), "position", F.struct(*VALUES).alias("_value"), nothing(state, carried).alias("_state")))
    latest = Window.partitionBy(*KEY).orderBy(F.desc("_toggle"), F.desc("position"))
    whole = latest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    read = both.withColumns({"_place": F.row_number().over(latest), "_rows": F.count(F.lit(1)).over(whole), "_flips": F.sum("_toggle").over(whole),
                             "_last": F.nth_value("_value", 1).over(whole), "_earlier": F.nth_value("_value", 2).over(whole)})
    # a key without a state is shown by its last toggle
    joined = read.filter("_toggle = 0 OR _place = 1 AND _rows = _flips").select(*KEY, "_flips", "_last", "_earlier", "_state.*")
    was_active = F.coalesce("active", F.lit(False))
    flipped = F.col("_flips")
    is_active = was_active != (flipped % 2 == 1)
    switched_on = F.when(flipped > 0, F.when(is_active, F.col("_last")).otherwise(F.col("_earlier")))
    renewed = switched_on.isNotNull()
    return joined.select(
        *KEY,
        F.coalesce(switched_on["title"], "title").alias("title"), F.coalesce(switched_on["query"], "query").alias("query"),
        F.coalesce(switched_on["price"], "last_notified_price").alias("last_notified_price"),
        F.coalesce(switched_on["currency"], "currency").alias("currency"),
        is_active.alias("active"), F.coalesce("created_at", now).alias("created_at"),
        F.when(~renewed, F.col("checked_at")).alias("checked_at"))
