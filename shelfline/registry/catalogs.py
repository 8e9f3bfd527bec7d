"""Catalog upsert, reviews, metrics and refresh over the test tables."""

import uuid

from pyspark.sql import functions as F

from shelfline import bindings as b
from shelfline.operators import catalog, reviews
from shelfline.registry.base import Registry
from shelfline.session import shared_dir
from shelfline.sources import store

registry = Registry()
query = registry.query
CATALOG = ("v_catalog_offers", "v_catalog_products")
FEED = ("v_catalog_offers", "v_catalog_products", "v_feed_items")


def stored(spark, sf):
    return b.view(spark, sf, "v_catalog_offers")


def products(spark, sf):
    return b.view(spark, sf, "v_catalog_products")


def by_product(spark, sf):
    """Products and offers of the stored catalog, the offers of a product side by side."""
    offers = b.from_sql(spark, sf, b.BY_PRODUCT)
    return spark.sql(b.VIEWS["v_catalog_products"], v_catalog_offers=offers), offers


def feed(spark, sf):
    return b.view(spark, sf, "v_feed_items")


NEWEST = """newest AS (SELECT * FROM (SELECT *, lower(trim(source)) AS source_key,
  row_number() OVER (PARTITION BY lower(trim(source)), trim(external_id) ORDER BY position DESC) AS rn FROM v_feed_items)
  WHERE rn = 1)"""
UPSERT = f"""{NEWEST},
upserted AS (SELECT coalesce(c.source_key, n.source_key) AS source_key, coalesce(c.external_id, n.external_id) AS external_id,
  c.product_key, coalesce(c.position, n.position) AS position, coalesce(n.source, c.source) AS source,
  coalesce(n.title, c.title) AS title, coalesce(n.url, c.url) AS url, coalesce(n.price, c.price) AS price,
  coalesce(n.currency, c.currency) AS currency, coalesce(n.available, c.available) AS available,
  coalesce(n.updated_at, c.updated_at) AS updated_at, c.match_level, c.match_score, c.match_reason, c.match_candidate_key,
  CASE WHEN n.source IS NULL THEN 'kept' WHEN c.source IS NULL THEN 'new' ELSE 'updated' END AS action
FROM v_catalog_offers c FULL JOIN newest n ON c.source_key = n.source_key AND c.external_id = n.external_id)"""


def upserted(spark, sf):
    return catalog.upsert_existing(stored(spark, sf), feed(spark, sf).drop("brand", "model", "mpn"))


@query("upsert_existing", f"WITH {UPSERT} SELECT * FROM upserted", FEED)
def _(spark, sf):
    return upserted(spark, sf)


# a new key creates its product unless the catalog already has a product of that id
ACTIONS = f"""{UPSERT},
actions AS (SELECT source_key AS batch_id, concat('product-', external_id) AS product_key, position,
  CASE WHEN action = 'updated' THEN 'updated'
       WHEN concat('product-', external_id) IN (SELECT product_key FROM v_catalog_products) THEN 'merged' ELSE 'created' END AS action
FROM upserted WHERE action <> 'kept')"""


def actions(spark, sf):
    touched = upserted(spark, sf).filter("action <> 'kept'").withColumn("product_key", F.concat(F.lit("product-"), "external_id"))
    known = products(spark, sf).select("product_key", F.lit(True).alias("known"))
    return touched.join(known, "product_key", "left").select(
        F.col("source_key").alias("batch_id"), "product_key", "position",
        F.when(F.col("action") == "updated", "updated").when(F.col("known"), "merged").otherwise("created").alias("action"))


REPORT = """count(*) AS total_offers, count(*) FILTER (action = 'created') AS created_products,
count(*) FILTER (action = 'merged') AS merged_offers, count(*) FILTER (action = 'updated') AS updated_offers,
count(DISTINCT product_key) AS products"""


@query("ingest_report", f"WITH {ACTIONS} SELECT {REPORT} FROM actions", FEED)
def _(spark, sf):
    return catalog.ingest_report(actions(spark, sf))


@query("touched_products", f"""
WITH {ACTIONS} SELECT batch_id, product_key, min(position) AS first_position FROM actions GROUP BY ALL""", FEED)
def _(spark, sf):
    return catalog.touched_products(actions(spark, sf), ["batch_id"])


@query("ingest_metrics", f"""
WITH {ACTIONS}, reports AS (SELECT batch_id, {REPORT} FROM actions GROUP BY batch_id)
SELECT count(*) AS batches, CAST(sum(total_offers) AS BIGINT) AS total_offers, CAST(sum(created_products) AS BIGINT) AS created_products,
  CAST(sum(merged_offers) AS BIGINT) AS merged_offers, CAST(sum(updated_offers) AS BIGINT) AS updated_offers,
  count(*) FILTER (products = 1) AS single_product_batches, count(*) FILTER (products > 1) AS ambiguous_batches,
  count(*) FILTER (total_offers = 0) AS empty_batches,
  (sum(merged_offers) + sum(updated_offers)) / sum(total_offers) AS duplicate_rate,
  count(*) FILTER (products = 1) / count(*) FILTER (total_offers > 0) AS presentation_eligibility_rate
FROM reports""", FEED)
def _(spark, sf):
    return catalog.ingest_metrics(catalog.ingest_report(actions(spark, sf), ["batch_id"]))


@query("presentation_eligible", """
SELECT batch_id, min(product_key) AS product_key FROM (
  SELECT concat(source, '/', CAST(updated_at AS DATE)) AS batch_id, concat('product-', external_id) AS product_key
  FROM v_feed_items) GROUP BY batch_id HAVING count(DISTINCT product_key) = 1""", FEED)
def _(spark, sf):
    batches = feed(spark, sf).select(F.concat("source", F.lit("/"), F.to_date("updated_at")).alias("batch_id"),
                                     F.concat(F.lit("product-"), "external_id").alias("product_key"))
    return catalog.presentation_eligible(batches)


# sources whose name ends in an even digit deliver full snapshots
SNAPSHOT = "SELECT s_name AS source FROM supplier WHERE s_acctbal > 5000"


def snapshot_sources(spark, sf):
    return b.from_sql(spark, sf, "SELECT s_name AS source FROM {supplier} WHERE s_acctbal > 5000")


@query("deactivate_missing", f"""
WITH marked AS (SELECT *, available AND source IN ({SNAPSHOT})
  AND NOT EXISTS (SELECT 1 FROM v_feed_items f WHERE lower(trim(f.source)) = c.source_key AND f.external_id = c.external_id) AS deactivated
  FROM v_catalog_offers c)
SELECT * REPLACE (available AND NOT deactivated AS available,
  CASE WHEN deactivated THEN {b.NOW_SQL} ELSE updated_at END AS updated_at) FROM marked""", FEED)
def _(spark, sf):
    return catalog.deactivate_missing(stored(spark, sf), feed(spark, sf), snapshot_sources(spark, sf), b.now())


@query("missing_offers", """
SELECT c.* FROM v_catalog_offers c WHERE source_key = 'supplier#000000003' AND available
  AND NOT EXISTS (SELECT 1 FROM v_feed_items f WHERE lower(trim(f.source)) = c.source_key AND f.external_id = c.external_id)""", FEED)
def _(spark, sf):
    return catalog.missing_offers(stored(spark, sf), feed(spark, sf), "Supplier#000000003")


@query("candidate_from_product", """
SELECT concat('catalog:', product_key) AS candidate_key, p.title AS title, url FROM v_catalog_products p JOIN (
  SELECT product_key, url, row_number() OVER (PARTITION BY product_key ORDER BY NOT (available AND trim(url) <> ''), position) AS rn
  FROM v_catalog_offers) o USING (product_key) WHERE rn = 1""", CATALOG)
def _(spark, sf):
    return catalog.candidate_from_product(products(spark, sf), stored(spark, sf))


@query("lookup_products", """
WITH wanted AS (SELECT concat('product-', p_size * 40) AS product_key, p_partkey AS request_id FROM part)
SELECT w.*, p.title, p.title IS NOT NULL AS hit FROM wanted w LEFT JOIN v_catalog_products p USING (product_key)""", CATALOG)
def _(spark, sf):
    wanted = b.from_sql(spark, sf, "SELECT concat('product-', p_size * 40) AS product_key, p_partkey AS request_id FROM {part}")
    return catalog.lookup_products(wanted, products(spark, sf))


@query("lookup_counts", """
SELECT count(*) FILTER (p.product_key IS NOT NULL) AS lookup_hits, count(*) FILTER (p.product_key IS NULL) AS lookup_misses
FROM (SELECT concat('product-', p_size * 40) AS product_key FROM part) w LEFT JOIN v_catalog_products p USING (product_key)""", CATALOG)
def _(spark, sf):
    wanted = b.from_sql(spark, sf, "SELECT concat('product-', p_size * 40) AS product_key, p_partkey AS request_id FROM {part}")
    return catalog.lookup_counts(catalog.lookup_products(wanted, products(spark, sf)))


FRESH = f"updated_at >= {b.NOW_SQL} - INTERVAL 8760 HOUR"
METRICS = f"""
metrics AS (SELECT (SELECT count(*) FROM v_catalog_products) AS product_count, count(*) AS offer_count,
  (SELECT count(*) FROM (SELECT product_key FROM v_catalog_offers GROUP BY 1 HAVING count(DISTINCT source_key) <= 1)) AS single_source_products,
  (SELECT count(*) FROM (SELECT product_key FROM v_catalog_offers GROUP BY 1 HAVING count(DISTINCT source_key) > 1)) AS multi_source_products,
  count(*) FILTER (match_level = 'exact') AS exact_matches, count(*) FILTER (match_level = 'probable') AS probable_matches,
  count(*) FILTER (match_level = 'review') AS review_matches, count(*) FILTER (match_level = 'rejected') AS rejected_matches,
  count(*) FILTER ({FRESH}) AS fresh_offers, count(*) FILTER (NOT available) AS unavailable_offers,
  greatest(count(*) - (SELECT count(*) FROM v_catalog_products), 0) AS merged_offer_count,
  greatest(count(*) - (SELECT count(*) FROM v_catalog_products), 0) / count(*) AS duplicate_rate,
  count(*) FILTER (NOT ({FRESH})) AS stale_offers FROM v_catalog_offers)"""


def metrics(spark, sf):
    return catalog.catalog_metrics(products(spark, sf), stored(spark, sf), b.now(), 8760.0)


@query("catalog_metrics", f"WITH {METRICS} SELECT * FROM metrics", CATALOG)
def _(spark, sf):
    return metrics(spark, sf)


@query("match_quality", f"""
WITH {METRICS} SELECT exact_matches + probable_matches AS automatic_matches,
  exact_matches / (exact_matches + probable_matches) AS exact_share FROM metrics""", CATALOG)
def _(spark, sf):
    return catalog.match_quality(metrics(spark, sf))


@query("source_offer_counts", "SELECT source, count(*) AS offers FROM v_catalog_offers GROUP BY source", CATALOG)
def _(spark, sf):
    return catalog.source_offer_counts(stored(spark, sf))


LATEST = "SELECT product_key, max(updated_at) AS latest FROM v_catalog_offers GROUP BY product_key"


@query("latest_update", f"""
SELECT p.*, coalesce(latest, CAST('0001-01-01 00:00:00' AS TIMESTAMP)) AS latest_update
FROM v_catalog_products p LEFT JOIN ({LATEST}) USING (product_key)""", CATALOG)
def _(spark, sf):
    return catalog.latest_update(products(spark, sf), stored(spark, sf))


@query("stale_products", f"""
SELECT p.*, latest AS latest_update FROM v_catalog_products p JOIN ({LATEST}) USING (product_key)
WHERE latest < {b.NOW_SQL} - INTERVAL 7920 HOUR ORDER BY latest, lower(title), product_key LIMIT 50""", CATALOG)
def _(spark, sf):
    return catalog.stale_products(products(spark, sf), stored(spark, sf), b.now(), 7920.0, limit=50)


@query("stale_count", f"""
SELECT count(*) AS stale_products FROM ({LATEST}) WHERE latest < {b.NOW_SQL} - INTERVAL 7920 HOUR""", CATALOG)
def _(spark, sf):
    return catalog.stale_count(products(spark, sf), stored(spark, sf), b.now(), 7920.0)


# a refresh run: the 2001 feed arrives, products of the largest size fail
OUTCOMES = """outcomes AS (
SELECT product_key, CASE WHEN product_key IN (SELECT concat('product-', p_partkey) FROM part WHERE p_size > 45) THEN 'failed'
  WHEN n.latest > o.latest OR (o.latest IS NULL AND n.latest IS NOT NULL) THEN 'refreshed' ELSE 'unchanged' END AS outcome
FROM v_catalog_products LEFT JOIN (SELECT product_key, max(updated_at) AS latest FROM v_catalog_offers GROUP BY 1) o USING (product_key)
LEFT JOIN (SELECT concat('product-', external_id) AS product_key, max(updated_at) AS latest FROM v_feed_items GROUP BY 1) n USING (product_key))"""


def outcomes(spark, sf):
    failed = b.from_sql(spark, sf, "SELECT concat('product-', p_partkey) AS product_key FROM {part} WHERE p_size > 45")
    after = feed(spark, sf).withColumn("product_key", F.concat(F.lit("product-"), "external_id"))
    return catalog.refresh_outcome(products(spark, sf), stored(spark, sf), after, failed)


@query("refresh_outcome", f"WITH {OUTCOMES} SELECT * FROM outcomes", FEED)
def _(spark, sf):
    return outcomes(spark, sf)


@query("refresh_report", f"""
WITH {OUTCOMES} SELECT count(*) AS selected_products, count(*) FILTER (outcome = 'refreshed') AS refreshed_products,
  count(*) FILTER (outcome = 'unchanged') AS unchanged_products, count(*) FILTER (outcome = 'failed') AS failed_products
FROM outcomes""", FEED)
def _(spark, sf):
    return catalog.refresh_report(outcomes(spark, sf))


@query("check_integrity", """
SELECT (SELECT max(CAST(split_part(product_key, '-', 2) AS BIGINT)) FROM v_catalog_products) AS highest_sequence,
  (SELECT count(*) FROM (SELECT product_key FROM v_catalog_products GROUP BY 1 HAVING count(*) > 1)) AS duplicate_products,
  (SELECT count(*) FROM (SELECT source_key, currency FROM v_catalog_offers GROUP BY ALL HAVING count(DISTINCT product_key) > 1)) AS contested_keys""",
       CATALOG)
def _(spark, sf):
    # the currency stands in for the external id, so that keys really are contested
    by_currency = stored(spark, sf).withColumn("external_id", F.col("currency"))
    return catalog.check_integrity(products(spark, sf), by_currency)


@query("route_requests", f"""
WITH usable AS (SELECT product_key, bool_or(updated_at >= {b.NOW_SQL} - INTERVAL 8000 HOUR) AS f FROM v_catalog_offers
    WHERE available AND price IS NOT NULL AND trim(url) <> '' GROUP BY 1),
wanted AS (SELECT product_key, concat('r-', product_key) AS request_id FROM v_products)
SELECT w.*, CASE WHEN f THEN 'fresh' WHEN product_key IN (SELECT concat('product-', external_id) FROM v_feed_items) THEN 'live'
  WHEN f IS NOT NULL THEN 'stored' ELSE 'not_found' END AS route FROM wanted w LEFT JOIN usable USING (product_key)""",
       FEED)
def _(spark, sf):
    wanted = b.view(spark, sf, "v_products").select("product_key", F.concat(F.lit("r-"), "product_key").alias("request_id"))
    live = feed(spark, sf).select(F.concat(F.lit("product-"), "external_id").alias("product_key"))
    return catalog.route_requests(wanted, stored(spark, sf), live, b.now(), 8000.0)


REVIEWS = """waiting AS (SELECT o.product_key, p.title AS product_title, o.match_candidate_key AS candidate_key,
  c.title AS candidate_title, o.source, o.external_id, o.title AS incoming_title, o.match_score, o.match_reason,
  o.updated_at AS created_at, o.position FROM v_catalog_offers o JOIN v_catalog_products p ON p.product_key = o.product_key
  JOIN v_catalog_products c ON c.product_key = o.match_candidate_key WHERE o.match_level = 'review')"""


@query("pending_reviews", f"WITH {REVIEWS} SELECT * FROM waiting", CATALOG)
def _(spark, sf):
    return reviews.pending_reviews(products(spark, sf), stored(spark, sf), limit=None)


@query("newest_reviews", f"WITH {REVIEWS} SELECT * FROM waiting ORDER BY created_at DESC, position LIMIT 20", CATALOG)
def _(spark, sf):
    return reviews.pending_reviews(products(spark, sf), stored(spark, sf))


def review_decisions(spark, sf, offers=None):
    """Small products are merged into their candidate, in order of their number."""
    return spark.sql("""
        SELECT DISTINCT product_key, match_candidate_key AS candidate_key, CAST(external_id AS BIGINT) AS position
        FROM {offers} JOIN {part} ON p_partkey = CAST(external_id AS BIGINT)
        WHERE match_level = 'review' AND p_size < 25""", offers=stored(spark, sf) if offers is None else offers, part=b.table(spark, sf, "part"))


def kept_offers(spark, sf, *columns):
    """The stored catalog's offers, worked out once and written compressed for the several steps that read them."""
    path = f"{shared_dir(spark)}/offers-{uuid.uuid4().hex}"
    offers = stored(spark, sf).select(*columns)
    offers.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(offers.schema).parquet(path)


DECISIONS = """decisions AS (SELECT DISTINCT product_key, match_candidate_key AS candidate_key
  FROM v_catalog_offers JOIN part ON p_partkey = CAST(external_id AS BIGINT)
  WHERE match_level = 'review' AND p_size < 25 AND match_candidate_key IN (SELECT product_key FROM v_catalog_products))"""
# ascending numbers: every decision still finds its candidate, so offers follow the chain to its end
CHAIN = f"""{DECISIONS},
chain AS (SELECT product_key, candidate_key, 1 AS depth FROM decisions
  UNION ALL SELECT c.product_key, d.candidate_key, depth + 1 FROM chain c JOIN decisions d ON d.product_key = c.candidate_key),
target AS (SELECT product_key, arg_max(candidate_key, depth) AS target FROM chain GROUP BY product_key)"""


@query("accept_reviews", f"""
WITH {CHAIN} SELECT o.source_key, o.external_id, coalesce(target, o.product_key) AS product_key,
  CASE WHEN target IS NULL THEN match_level ELSE 'probable' END AS match_level,
  CASE WHEN target IS NULL THEN match_reason ELSE 'manual_approval' END AS match_reason,
  coalesce(target, match_candidate_key) AS match_candidate_key
FROM v_catalog_offers o LEFT JOIN target USING (product_key)""", CATALOG)
def _(spark, sf):
    kept = kept_offers(spark, sf, "source_key", "external_id", "product_key", "title", "position", "match_level", "match_reason", "match_candidate_key")
    cards = spark.sql(b.VIEWS["v_catalog_products"], v_catalog_offers=kept)
    _, offers = reviews.accept_reviews(cards, kept, review_decisions(spark, sf, kept))
    return offers.select("source_key", "external_id", "product_key", "match_level", "match_reason", "match_candidate_key")


@query("reject_reviews", f"""
WITH {DECISIONS} SELECT o.source_key, o.external_id, o.product_key,
  CASE WHEN d.product_key IS NOT NULL AND match_level = 'review' THEN 'rejected' ELSE match_level END AS match_level,
  CASE WHEN d.product_key IS NOT NULL AND match_level = 'review' THEN 'manual_rejection' ELSE match_reason END AS match_reason
FROM v_catalog_offers o LEFT JOIN decisions d ON d.product_key = o.product_key AND d.candidate_key = o.match_candidate_key""",
       CATALOG)
def _(spark, sf):
    after = reviews.reject_reviews(stored(spark, sf), products(spark, sf), review_decisions(spark, sf))
    return after.select("source_key", "external_id", "product_key", "match_level", "match_reason")


@query("save_load_catalog", "SELECT * FROM v_catalog_offers", CATALOG)
def _(spark, sf):
    root = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}"
    store.save_catalog(products(spark, sf), stored(spark, sf), root)
    return store.load_catalog(spark, root)[1]


@query("export_import_catalog", "SELECT * FROM v_catalog_offers", CATALOG)
def _(spark, sf):
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    cards, offers = by_product(spark, sf)
    store.export_catalog_json(cards, offers, path)
    return store.import_catalog_json(spark, path, cards.schema, offers.schema)[1]


@query("export_catalog", """
SELECT p.product_key, p.title, count(o.product_key) AS offers, min(o.position) AS first_position
FROM v_catalog_products p LEFT JOIN v_catalog_offers o ON o.product_key = p.product_key GROUP BY ALL""", CATALOG)
def _(spark, sf):
    nested = store.nest_catalog(*by_product(spark, sf))
    return nested.groupBy("product_key", "title").agg(F.sum(F.size("offers")).cast("bigint").alias("offers"),
                                                      F.min(F.col("offers")[0]["position"]).alias("first_position"))


@query("bootstrap_if_empty", """
SELECT 'first' AS step, count(*) AS imported, (SELECT count(*) FROM v_catalog_offers) AS offers FROM v_catalog_products
UNION ALL SELECT 'again', 0, (SELECT count(*) FROM v_catalog_offers)""", CATALOG)
def _(spark, sf):
    place = f"{shared_dir(spark)}/bootstrap-{uuid.uuid4().hex}"
    cards, offers = by_product(spark, sf)
    store.export_catalog_json(cards, offers, f"{place}/json")
    steps = []
    for step in ("first", "again"):
        imported = store.bootstrap_if_empty(spark, f"{place}/catalog", f"{place}/json", cards.schema, offers.schema)
        kept = store.load_catalog(spark, f"{place}/catalog")[1]
        steps.append(kept.agg(F.count(F.lit(1)).alias("offers")).select(F.lit(step).alias("step"), F.lit(imported).cast("bigint").alias("imported"), "offers"))
    return steps[0].unionByName(steps[1])
