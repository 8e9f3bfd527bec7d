"""Price checks, outliers, cheapest offers and comparison results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.functions import vocabulary as v
from shelfline.functions.text import finite, source_key, squeeze

STATES = {"found": 4, "filtered": 3, "not_found": 2, "unavailable": 1}
CACHED_LABEL = "Сохранённая цена; источник сейчас недоступен"


def plausible_price(title: Column, price: Column, currency: Column, context: Column | None = None) -> Column:
    """A finite positive value that can be the full price of the titled product."""
    byn = squeeze(F.lower(currency)).isin(*v.BYN_NAMES)
    floor = (F.when(byn & title.rlike(v.IPHONE_WORD), v.IPHONE_PRICE_FLOOR)
             .when(byn & title.rlike(v.DURABLE_GOODS), v.DURABLE_PRICE_FLOOR).otherwise(0.0))
    ok = finite(price) & (price > 0) & (price >= floor)
    if context is not None:
        ok = ok & ~F.coalesce(context.rlike(v.INSTALMENT), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def filter_plausible_price(offers: DataFrame, context: str | None = None) -> DataFrame:
    return offers.filter(plausible_price(F.col("title"), F.col("price"), F.col("currency"),
                                         F.col(context) if context else None))


def filter_sellable(offers: DataFrame) -> DataFrame:
    return offers.filter(F.col("available") & finite(F.col("price")) & (F.col("price") >= 0))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str, count: str | None = None) -> DataFrame:
    """Exact median per key without holding a group in memory.

    Equal values are counted before the shuffle and the running count finds the middle ranks, so a
    group that holds a large share of the rows is sorted with spilling, not buffered.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    running = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumns({"_to": running, "_total": F.sum("_n").over(group)})
    holds = lambda rank: (F.col("_to") - F.col("_n") < rank) & (rank <= F.col("_to"))
    low, high = F.expr("(_total + 1) div 2"), F.expr("_total div 2 + 1")
    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias(out),
        *([F.max("_total").alias(count)] if count else []))


def filter_price_outliers(offers: DataFrame, cohort: Sequence[str] = ("product_key",), price: str = "price",
                          source: str = "source", seller: str = "seller", ratio: float = 0.25) -> DataFrame:
    """Drop prices below a share of the cohort's reference price.

    Every source has one vote: the reference is the median of the per-source medians. A cohort with
    fewer than two sources passes through. Prices that are not finite and positive always go.
    """
    voter = F.lower(F.coalesce(F.nullif(F.col(source), F.lit("")), F.nullif(F.col(seller), F.lit("")),
                               F.concat_ws("|", F.col("url"), F.col("title"), F.col(price).cast("string"))))
    valid = offers.filter(finite(F.col(price)) & (F.col(price) > 0))
    medians = exact_median(valid.select(*cohort, voter.alias("_voter"), F.col(price).alias("_price")),
                           [*cohort, "_voter"], "_price", "_median")
    floors = (exact_median(medians, cohort, "_median", "_reference", "_voters")
              .filter(F.col("_voters") >= 2)
              .select(*cohort, (F.col("_reference") * ratio).alias("_floor")))
    # Joined on copies of the cohort columns: the ranking that usually follows then needs its own shuffle, so
    # adaptive execution may split a hot cohort here, and the ranking is cut down before that shuffle.
    copies = [f"_of_{name}" for name in cohort]
    keyed = valid.withColumns({copy: F.col(name) for copy, name in zip(copies, cohort)})
    kept = keyed.join(floors.withColumnsRenamed(dict(zip(cohort, copies))), copies, "left")
    return kept.filter(F.col("_floor").isNull() | (F.col(price) >= F.col("_floor"))).select(*offers.columns)


def first_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """First row per key by an explicit order; limited per partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def offer_key() -> list[Column]:
    return [source_key(F.col("source")), F.lower(F.trim(F.coalesce(F.col("seller"), F.lit("")))),
            F.regexp_replace(F.trim(F.col("url")), "/+$", ""), F.lower(F.trim(F.col("currency")))]


def cheapest_per_offer_key(offers: DataFrame, cohort: Sequence[str] = ()) -> DataFrame:
    return first_per(offers, [*cohort, *offer_key()], ["price", "position"])


def cheapest_per_source(offers: DataFrame, cohort: Sequence[str] = ("product_key",)) -> DataFrame:
    """Available plausible offers without outliers, the first by price of every exact source."""
    usable = filter_plausible_price(offers.filter("available"))
    return first_per(filter_price_outliers(usable, cohort), [*cohort, "source"], ["price", "position"])


def sort_offers(offers: DataFrame, cohort: Sequence[str] = ()) -> DataFrame:
    return offers.orderBy(*cohort, "price", F.lower("source"), F.lower(F.coalesce("seller", F.lit(""))), F.lower("title"),
                          "position")


def rank_offers(offers: DataFrame, cohort: Sequence[str] = ("product_key",)) -> DataFrame:
    """Display position 1..n by price inside a cohort."""
    order = Window.partitionBy(*cohort).orderBy("price", "position")
    return offers.withColumn("place", F.row_number().over(order))


def top_k_offers(offers: DataFrame, k: int, cohort: Sequence[str] = ("product_key",)) -> DataFrame:
    usable = filter_price_outliers(filter_plausible_price(offers.filter("available")), cohort)
    return rank_offers(usable, cohort).filter(F.col("place") <= max(k, 0))


def lowest_price(offers: DataFrame) -> DataFrame:
    """Cheapest sellable offer per product and currency."""
    sellable = filter_sellable(offers).withColumn("currency_key", F.lower("currency"))
    best = first_per(sellable, ["product_key", "currency_key"], ["price", "position"])
    return best.select("product_key", "currency_key", "price", "source", "seller", "url")


def cheapest_variant(offers: DataFrame, request: str, variant: str, variant_position: str) -> DataFrame:
    """Winning variant of every request: the one with the lowest minimum, the earliest on a tie."""
    minima = offers.groupBy(request, variant).agg(F.min("price").alias("lowest"), F.min(variant_position).alias("_at"))
    return first_per(minima, [request], ["lowest", "_at", variant]).drop("_at")


def distinct_decisions(decisions: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    return first_per(decisions, [*keys, "source", "title", "accepted", "reason"], ["position"])


def rejection_histogram(decisions: DataFrame) -> DataFrame:
    return (decisions.filter(~F.col("accepted")).groupBy("reason").agg(F.count(F.lit(1)).alias("rejected"))
            .orderBy("reason"))


def source_status(attempts: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("request_id", "source")) -> DataFrame:
    """State per request and source; ``attempts(keys, failed)`` keeps sources that returned nothing."""
    counted = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_checked"),
                                            F.count_if("accepted").alias("_matched"))
    checked, matched = F.coalesce("_checked", F.lit(0)), F.coalesce("_matched", F.lit(0))
    state = (F.when(F.col("failed"), "unavailable").when(matched > 0, "found")
             .when(checked > 0, "filtered").otherwise("not_found"))
    return attempts.join(counted, list(keys), "left").select(
        *keys, state.alias("state"), matched.alias("matched_offers"), checked.alias("checked_candidates"))


def merge_source_status(statuses: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """One status per source over all variants: best state, summed counts, longest duration, first name."""
    priority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col("state")),
                          F.lit(0))
    return (statuses.groupBy(*keys, source_key(F.col("source")).alias("source_key"))
            .agg(F.min_by("source", "position").alias("source"),
                 F.max_by("state", priority).alias("state"),
                 F.sum("matched_offers").alias("matched_offers"), F.sum("checked_candidates").alias("checked_candidates"),
                 F.max("duration_seconds").alias("duration_seconds")))


def union_sources(*offers: DataFrame) -> DataFrame:
    """Offers of several sources as one set."""
    result = offers[0]
    for more in offers[1:]:
        result = result.unionByName(more)
    return result


def cached_fallback(attempts: DataFrame, verified: DataFrame, stored: DataFrame, key: str = "request_id") -> DataFrame:
    """Stored offers of failed sources for requests where every source failed and nothing was verified."""
    all_failed = attempts.groupBy(key).agg(F.bool_and("failed").alias("_dead")).filter("_dead").select(key)
    empty = all_failed.join(verified.select(key).distinct(), key, "left_anti")
    failed_sources = attempts.filter("failed").select(key, F.lower("source").alias("_source")).distinct()
    return (stored.join(empty, key, "left_semi").withColumn("_source", F.lower("source"))
            .join(failed_sources, [key, "_source"], "left_semi").drop("_source")
            .withColumn("availability_text", F.lit(CACHED_LABEL)))


def union_verified_cached(verified: DataFrame, cached: DataFrame) -> DataFrame:
    return verified.withColumn("availability_text", F.lit(None).cast("string")).unionByName(cached)
