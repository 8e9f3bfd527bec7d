"""Catalog upsert, snapshot deactivation, lookups, metrics and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.functions.text import source_key
from shelfline.operators.filters import fresh
from shelfline.operators.pricing import first_per

KEY = ["source_key", "external_id"]
MATCH_FIELDS = ["match_level", "match_score", "match_reason", "match_conflicts", "match_candidate_key"]


def with_key(items: DataFrame) -> DataFrame:
    return items.withColumn("external_id", F.trim("external_id")).withColumn("source_key", source_key(F.col("source")))


def last_per_key(items: DataFrame) -> DataFrame:
    """Newest row of every external key in a batch."""
    return first_per(with_key(items), KEY, [F.desc("position")])


def upsert_existing(catalog: DataFrame, items: DataFrame) -> DataFrame:
    """Catalog offers after a batch, with ``action``: updated, kept, or new for keys without a product.

    The newest row of a key replaces the whole offer. A row without match level keeps the five match
    fields of the stored one. Stored offers keep their product and position.
    """
    newest = last_per_key(items)
    for name in MATCH_FIELDS:
        if name in catalog.columns and name not in newest.columns:
            newest = newest.withColumn(name, F.lit(None).cast(dict(catalog.dtypes)[name]))
    columns = [c for c in catalog.columns if c not in KEY]
    fresh_row = newest.select(*KEY, F.struct(*[c for c in newest.columns if c in columns]).alias("_n"))
    stored = catalog.select(*KEY, F.struct(*columns).alias("_o"))
    joined = stored.join(fresh_row, KEY, "full_outer")
    replaced = F.col("_n").isNotNull()
    keeps_match = F.col("_o").isNotNull() & F.col("_n.match_level").isNull()
    given = set(newest.columns)

    def value(name: str) -> Column:
        old = F.col(f"_o.{name}")
        if name == "product_key" or name not in given:
            return old
        if name == "position":
            return F.coalesce(old, F.col("_n.position"))
        new = F.col(f"_n.{name}")
        if name in MATCH_FIELDS:
            return F.when(replaced & ~keeps_match, new).otherwise(old)
        return F.when(replaced, new).otherwise(old)

    action = F.when(~replaced, "kept").when(F.col("_o").isNull(), "new").otherwise("updated")
    return joined.select(*KEY, *[value(c).alias(c) for c in columns], action.alias("action"))


def missing_offers(catalog: DataFrame, items: DataFrame, source: str) -> DataFrame:
    """Available offers of a source that its snapshot no longer lists."""
    seen = with_key(items).select(*KEY).distinct()
    return catalog.filter((F.col("source_key") == source.strip().lower()) & F.col("available")).join(seen, KEY, "left_anti")


def deactivate_missing(catalog: DataFrame, items: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Offers of the snapshot sources that are not in the feed become unavailable as of ``now``."""
    seen = with_key(items).select(*KEY, F.lit(True).alias("_seen")).distinct()
    wanted = sources.select(source_key(F.col("source")).alias("source_key"), F.lit(True).alias("_snapshot")).distinct()
    marked = catalog.join(wanted, "source_key", "left").join(seen, KEY, "left")
    gone = F.coalesce("_snapshot", F.lit(False)) & F.col("_seen").isNull() & F.col("available")
    return marked.withColumn("deactivated", gone).select(
        *[c for c in catalog.columns if c not in ("available", "updated_at")],
        (F.col("available") & ~F.col("deactivated")).alias("available"),
        F.when(F.col("deactivated"), now).otherwise(F.col("updated_at")).alias("updated_at"), "deactivated")


def candidate_from_product(products: DataFrame, offers: DataFrame, key_prefix: str = "catalog:") -> DataFrame:
    """Searchable card per product: URL of its first available offer, else of its first offer."""
    order = F.struct((~(F.col("available") & (F.trim(F.col("url")) != ""))).alias("no"), F.col("position").alias("at"))
    chosen = offers.groupBy("product_key").agg(F.min_by("url", order).alias("url"))
    return products.join(chosen, "product_key").select(
        F.concat(F.lit(key_prefix), "product_key").alias("candidate_key"), "title", "url")


def lookup_products(wanted: DataFrame, products: DataFrame) -> DataFrame:
    """Requested keys with their title and a ``hit`` flag."""
    return wanted.join(products.select("product_key", "title", F.lit(True).alias("_hit")), "product_key", "left").select(
        *wanted.columns, "title", F.coalesce("_hit", F.lit(False)).alias("hit"))


def lookup_counts(lookups: DataFrame) -> DataFrame:
    return lookups.agg(F.count_if("hit").alias("lookup_hits"), F.count_if(~F.col("hit")).alias("lookup_misses"))


def ingest_report(actions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts per batch; the touched products themselves come from ``touched_products``."""
    return actions.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total_offers"),
        F.count_if(F.col("action") == "created").alias("created_products"),
        F.count_if(F.col("action") == "merged").alias("merged_offers"),
        F.count_if(F.col("action") == "updated").alias("updated_offers"),
        F.count_distinct("product_key").alias("products"))


def touched_products(actions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct products of a batch by their first position."""
    return actions.groupBy(*(keys or []), "product_key").agg(F.min("position").alias("first_position"))


def presentation_eligible(actions: DataFrame, key: str = "batch_id") -> DataFrame:
    """A batch is shown as one product only if all its rows map to exactly one."""
    return actions.groupBy(key).agg((F.count_distinct("product_key") == 1).alias("eligible"),
                                    F.min("product_key").alias("product_key")).filter("eligible").drop("eligible")


def ingest_metrics(batches: DataFrame) -> DataFrame:
    """Running totals over batch reports (one row per batch, empty batches included)."""
    total = batches.agg(
        F.count(F.lit(1)).alias("batches"), F.sum("total_offers").alias("total_offers"),
        F.sum("created_products").alias("created_products"), F.sum("merged_offers").alias("merged_offers"),
        F.sum("updated_offers").alias("updated_offers"),
        F.count_if(F.col("products") == 1).alias("single_product_batches"),
        F.count_if(F.col("products") > 1).alias("ambiguous_batches"),
        F.count_if(F.col("total_offers") == 0).alias("empty_batches"))
    attached = F.col("merged_offers") + F.col("updated_offers")
    non_empty = F.col("batches") - F.col("empty_batches")
    return total.withColumns({
        "duplicate_rate": F.when(F.col("total_offers") > 0, attached / F.col("total_offers")).otherwise(0.0),
        "presentation_eligibility_rate": F.when(non_empty > 0, F.col("single_product_batches") / non_empty).otherwise(0.0),
    })


def catalog_metrics(products: DataFrame, offers: DataFrame, now: Column, stale_hours: float = 24.0) -> DataFrame:
    """One row of catalog quality: size, deduplication, match levels and freshness."""
    key = F.nullif(source_key(F.col("source")), F.lit(""))
    is_fresh = fresh(now, stale_hours)
    level = lambda name: F.count_if(F.col("match_level") == name).alias(f"_{name}")
    # partial sums per product and source first, so no product is gathered row by row
    per_source = offers.groupBy("product_key", key.alias("_source")).agg(
        F.count(F.lit(1)).alias("_offers"), level("exact"), level("probable"), level("review"), level("rejected"),
        F.count_if(is_fresh).alias("_fresh"), F.count_if(~F.col("available")).alias("_unavailable"))
    sums = {c: F.sum(c).alias(c) for c in ("_offers", "_exact", "_probable", "_review", "_rejected", "_fresh", "_unavailable")}
    per_product = per_source.groupBy("product_key").agg(F.count("_source").alias("_sources"), *sums.values())
    joined = products.select("product_key").join(per_product, "product_key", "left")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    total = joined.agg(
        F.count(F.lit(1)).alias("product_count"), whole("_offers").alias("offer_count"),
        F.count_if(F.coalesce("_sources", F.lit(0)) <= 1).alias("single_source_products"),
        F.count_if(F.col("_sources") > 1).alias("multi_source_products"),
        whole("_exact").alias("exact_matches"), whole("_probable").alias("probable_matches"),
        whole("_review").alias("review_matches"), whole("_rejected").alias("rejected_matches"),
        whole("_fresh").alias("fresh_offers"), whole("_unavailable").alias("unavailable_offers"))
    merged = F.greatest(F.col("offer_count") - F.col("product_count"), F.lit(0))
    return total.withColumns({
        "merged_offer_count": merged,
        "duplicate_rate": F.when(F.col("offer_count") > 0, merged / F.col("offer_count")).otherwise(0.0),
        "stale_offers": F.col("offer_count") - F.col("fresh_offers"),
    })


def source_offer_counts(offers: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim(F.col("source")), F.lit("")), F.lit("unknown"))
    return (offers.groupBy(name.alias("source")).agg(F.count(F.lit(1)).alias("offers"))
            .orderBy(F.desc("offers"), F.lower("source")))


def match_quality(metrics: DataFrame) -> DataFrame:
    automatic = F.col("exact_matches") + F.col("probable_matches")
    return metrics.select(automatic.alias("automatic_matches"),
                          F.when(automatic > 0, F.col("exact_matches") / automatic).otherwise(0.0).alias("exact_share"))


def latest_update(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Newest update per product; the smallest timestamp for a product without offers."""
    newest = offers.groupBy("product_key").agg(F.max("updated_at").alias("_latest"))
    earliest = F.lit("0001-01-01 00:00:00").cast(dict(offers.dtypes)["updated_at"])
    return products.join(newest, "product_key", "left").withColumn(
        "latest_update", F.coalesce("_latest", earliest)).drop("_latest")


def stale_products(products: DataFrame, offers: DataFrame, now: Column, stale_hours: float = 24.0,
                   limit: int | None = None) -> DataFrame:
    """Products whose newest update is older than the freshness time, oldest first."""
    threshold = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(stale_hours * 3600.0))
    ordered = (latest_update(products, offers).filter(F.col("latest_update") < threshold)
               .orderBy("latest_update", F.lower("title"), "product_key"))
    return ordered if limit is None else ordered.limit(limit)


def stale_count(products: DataFrame, offers: DataFrame, now: Column, stale_hours: float = 24.0) -> DataFrame:
    threshold = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(stale_hours * 3600.0))
    return latest_update(products, offers).agg(F.count_if(F.col("latest_update") < threshold).alias("stale_products"))


def refresh_outcome(selected: DataFrame, before: DataFrame, after: DataFrame, failed: DataFrame) -> DataFrame:
    """Per selected product: refreshed, unchanged or failed, by its newest update before and after."""
    old = before.groupBy("product_key").agg(F.max("updated_at").alias("_old"))
    new = after.groupBy("product_key").agg(F.max("updated_at").alias("_new"))
    errors = failed.select("product_key", F.lit(True).alias("_failed")).distinct()
    joined = (selected.select("product_key").join(old, "product_key", "left").join(new, "product_key", "left")
              .join(errors, "product_key", "left"))
    moved = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.col("_new") > F.col("_old")))
    return joined.select("product_key", F.when(F.col("_failed"), "failed").when(moved, "refreshed")
                         .otherwise("unchanged").alias("outcome"))


def refresh_report(outcomes: DataFrame) -> DataFrame:
    is_ = lambda name: F.count_if(F.col("outcome") == name).alias(f"{name}_products")
    return outcomes.agg(F.count(F.lit(1)).alias("selected_products"), is_("refreshed"), is_("unchanged"), is_("failed"))


def duplicate_products(products: DataFrame) -> DataFrame:
    return products.groupBy("product_key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def contested_keys(offers: DataFrame) -> DataFrame:
    """External keys that belong to more than one product."""
    owned = with_key(offers).groupBy(*KEY).agg(F.count_distinct("product_key").alias("owners"))
    return owned.filter("owners > 1")


def check_integrity(products: DataFrame, offers: DataFrame) -> DataFrame:
    """One row: duplicate product keys, contested external keys, highest generated number."""
    number = F.nullif(F.regexp_extract("product_key", r"^product-(\d+)$", 1), F.lit("")).try_cast("bigint")
    highest = products.agg(F.coalesce(F.max(number), F.lit(0)).alias("highest_sequence"))
    doubled = duplicate_products(products).agg(F.count(F.lit(1)).alias("duplicate_products"))
    contested = contested_keys(offers).agg(F.count(F.lit(1)).alias("contested_keys"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  three one-row results side by side
    return one(highest).join(one(doubled), "_one").join(one(contested), "_one").drop("_one")


def route_requests(requests: DataFrame, offers: DataFrame, live: DataFrame, now: Column, hours: float = 24.0) -> DataFrame:
    """Where each selected product is answered from: fresh, live, stored or not_found."""
    usable = offers.filter(F.col("available") & F.col("price").isNotNull() & (F.trim(F.col("url")) != ""))
    state = usable.groupBy("product_key").agg(F.bool_or(fresh(now, hours)).alias("_fresh"))
    online = live.select("product_key", F.lit(True).alias("_live")).distinct()
    route = (F.when(F.col("_fresh"), "fresh").when(F.col("_live"), "live").when(F.col("_fresh").isNotNull(), "stored")
             .otherwise("not_found"))
    return (requests.join(state, "product_key", "left").join(online, "product_key", "left")
            .withColumn("route", route).drop("_fresh", "_live"))
