"""Catalog search, card ranking and entity resolution over the test tables."""

import uuid
from difflib import SequenceMatcher
from itertools import product

from pyspark.sql import functions as F

from shelfline import bindings as b
from shelfline.operators import filters, matching, search, search_index
from shelfline.plans import compare_batch
from shelfline.plans.import_feed import update_catalog
from shelfline.registry.prices import OUTLIERS, PLAUSIBLE
from shelfline.registry.titles import REASON, SAID
from shelfline.session import compressed, shared_dir
from shelfline.registry.base import Registry

registry = Registry()
query = registry.query
CATALOG = ("v_model_requests", "v_products", "v_catalog_offers", "v_catalog_products")


def requests(spark, sf):
    return b.view(spark, sf, "v_model_requests")


def identified(df):
    nothing = F.lit(None).cast("string")
    return df.withColumn("identity", F.struct(
        F.lower("brand").alias("brand"), F.col("model").alias("model"), nothing.alias("memory"), nothing.alias("color"),
        nothing.alias("revision"), nothing.alias("ean"), F.lower("mpn").alias("mpn")))


def products(spark, sf):
    return identified(b.view(spark, sf, "v_products")).select("product_key", "title", "identity")


VALUES = """vals AS (SELECT product_key, 'title' AS kind, title AS value FROM v_products
  UNION SELECT product_key, 'brand_model', concat(lower(brand), ' ', model) FROM v_products
  UNION SELECT product_key, 'model', model FROM v_products
  UNION SELECT product_key, 'identifier', lower(mpn) FROM v_products WHERE mpn IS NOT NULL
  UNION SELECT product_key, 'offer_title', title FROM v_catalog_offers),
n AS (SELECT *, trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) AS w, regexp_replace(lower(value), '[^a-z0-9]+', '', 'g') AS c FROM vals),
r AS (SELECT *, trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')) AS qw, regexp_replace(lower(query), '[^a-z0-9]+', '', 'g') AS qc FROM v_model_requests),
scored AS (SELECT request_id, product_key, CASE
  WHEN kind = 'identifier' THEN CASE WHEN c = qc THEN 1000 WHEN length(qc) >= 6 AND starts_with(c, qc) THEN 850 ELSE 0 END
  WHEN c = qc THEN CASE kind WHEN 'model' THEN 950 WHEN 'brand_model' THEN 925 WHEN 'title' THEN 875 ELSE 850 END
  WHEN w = qw THEN 825
  WHEN len(list_filter(string_split(qw, ' '), lambda x: NOT list_contains(string_split(w, ' '), x))) = 0
    THEN CASE kind WHEN 'brand_model' THEN 760 WHEN 'model' THEN 750 WHEN 'title' THEN 700 ELSE 675 END
  WHEN starts_with(w, qw) THEN 600 WHEN contains(w, qw) THEN 500 WHEN length(qc) >= 4 AND contains(c, qc) THEN 450 ELSE 0 END AS score
  FROM r, n),
best AS (SELECT request_id, product_key, max(score) AS score FROM scored WHERE score > 0 GROUP BY ALL)"""


@query("search_catalog", f"""
WITH {VALUES} SELECT request_id, product_key, title, score FROM best JOIN v_products USING (product_key)""", CATALOG)
def _(spark, sf):
    return search.search_catalog(requests(spark, sf), products(spark, sf), b.view(spark, sf, "v_catalog_offers"))


# the index is written for the cards alone, then extended by the stored offers
@query("search_catalog_indexed", f"""
WITH {VALUES} SELECT request_id, product_key, title, score FROM best JOIN v_products USING (product_key)""", CATALOG)
def _(spark, sf):
    root = f"{shared_dir(spark)}/search-index-{uuid.uuid4().hex}"
    cards_, offers = products(spark, sf), b.view(spark, sf, "v_catalog_offers")
    search_index.update_index(search.search_values(cards_, offers.limit(0)), root)
    search_index.update_index(search.search_values(cards_, offers), root)
    return search.search_indexed(requests(spark, sf), cards_, offers, root)


@query("search_catalog_top", f"""
WITH {VALUES} SELECT * FROM (SELECT request_id, product_key, title, score,
  row_number() OVER (PARTITION BY request_id ORDER BY score DESC, lower(title), product_key) AS place FROM best JOIN v_products USING (product_key))
WHERE place <= 10""", CATALOG)
def _(spark, sf):
    return search.search_catalog(requests(spark, sf), products(spark, sf), b.view(spark, sf, "v_catalog_offers"), limit=10)


ASKED = """
SELECT DISTINCT concat(CASE p_type WHEN 'ECONOMY' THEN 'Apple iPhone' WHEN 'LARGE' THEN 'laptop' WHEN 'PROMO' THEN 'case' ELSE 'device' END, ' ', lower(brand), ' ', model) AS query
FROM {v_products} UNION ALL SELECT 'no such gadget'"""
TOP = f"""asked AS (SELECT concat('q-', query) AS request_id, query FROM ({ASKED.format(v_products='v_products')})), {VALUES.replace('v_model_requests', 'asked')},
found AS (SELECT request_id, product_key, title, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, lower(title), product_key) AS place
  FROM best JOIN v_products USING (product_key) QUALIFY place <= 10),
{SAID}, judged AS (SELECT f.request_id, o.source, o.title, o.price, o.currency, o.available, o.url, o.position, {REASON} IS NULL AS accepted, coalesce({REASON}, 'exact_match') AS reason
  FROM found f JOIN v_catalog_offers o USING (product_key) JOIN v_products op USING (product_key) JOIN found s ON s.request_id = f.request_id AND s.place = 1
  JOIN v_products sp ON sp.product_key = s.product_key JOIN said r ON r.title = s.title AND r.p_type = sp.p_type JOIN said c ON c.title = o.title AND c.p_type = op.p_type
  WHERE o.source NOT LIKE '%7')"""
BATCH = (*CATALOG, "v_shown")


def searched(spark, sf):
    """Every kind of card asked for in words; sources whose number ends in seven do not answer."""
    asked = b.from_sql(spark, sf, ASKED).select(F.concat(F.lit("q-"), "query").alias("request_id"), "query")
    offers = b.view(spark, sf, "v_catalog_offers").withColumn("seller", F.lit(None).cast("string"))
    failed = offers.select("source").distinct().filter("source LIKE '%7'")
    return asked, compare_batch.run_search_batch(asked, products(spark, sf), offers, failed)


@query("run_comparison_batch", f"""
WITH {TOP}, usable AS (SELECT * FROM judged WHERE accepted AND available AND {PLAUSIBLE}), {OUTLIERS.replace('product_key', 'request_id')},
cheapest AS (SELECT * FROM sane QUALIFY row_number() OVER (PARTITION BY request_id, source ORDER BY price, position) = 1),
state AS (SELECT request_id, source, bool_or(accepted) AS matched, count(*) AS checked FROM judged GROUP BY ALL),
dead AS (SELECT DISTINCT source FROM v_catalog_offers WHERE source LIKE '%7')
SELECT a.request_id, a.query, (SELECT count(*) FROM found f WHERE f.request_id = a.request_id) AS candidates, s.product_key AS selected_key, s.title AS wanted_title,
  CASE WHEN s.product_key IS NULL THEN 'no candidates' END AS error, (SELECT count(*) FROM cheapest c WHERE c.request_id = a.request_id) AS offers,
  (SELECT min(price) FROM cheapest c WHERE c.request_id = a.request_id) AS price,
  CASE WHEN s.product_key IS NOT NULL THEN (SELECT count(*) FILTER (matched) FROM state t WHERE t.request_id = a.request_id) END AS found_sources,
  CASE WHEN s.product_key IS NOT NULL THEN (SELECT count(*) FILTER (NOT matched) FROM state t WHERE t.request_id = a.request_id) END AS filtered_sources,
  CASE WHEN s.product_key IS NOT NULL THEN (SELECT count(*) FROM dead) END AS failed_sources,
  CASE WHEN s.product_key IS NOT NULL THEN (SELECT coalesce(sum(checked), 0)::BIGINT FROM state t WHERE t.request_id = a.request_id) END AS checked_candidates
FROM asked a LEFT JOIN (SELECT * FROM found WHERE place = 1) s USING (request_id)""", BATCH)
def _(spark, sf):
    asked, batch = searched(spark, sf)
    return compare_batch.search_report(asked, batch, b.now()).select(
        "request_id", "query", "candidates", "selected_key", "wanted_title", "error", "offers", "best.price", "found_sources", "filtered_sources", "failed_sources", "checked_candidates")


@query("comparison_decisions", f"WITH {TOP} SELECT DISTINCT request_id, source, title, accepted, reason FROM judged", BATCH)
def _(spark, sf):
    return searched(spark, sf)[1].comparison.decisions


@query("simple_search", """
WITH t AS (SELECT product_key, lower(title) AS t FROM v_products UNION SELECT product_key, lower(title) FROM v_catalog_offers)
SELECT request_id, product_key, max(CASE WHEN t = lower(query) THEN 3 WHEN starts_with(t, lower(query)) THEN 2 ELSE 1 END) AS score
FROM v_model_requests JOIN t ON contains(t, lower(query)) GROUP BY ALL""", CATALOG)
def _(spark, sf):
    return search.simple_search(requests(spark, sf), products(spark, sf), b.view(spark, sf, "v_catalog_offers"))


def cards(spark, sf):
    return b.view(spark, sf, "v_products").select(
        F.col("product_key").alias("key"), "title", F.concat(F.lit("https://shop.example/products/"), F.replace("model", F.lit(" "), F.lit("-"))).alias("url"))


@query("rank_card_index")
def _(spark, sf):
    return search.rank_card_index(requests(spark, sf), cards(spark, sf))


# result lists: the cards of a model name and type; phones are asked for by their family, others by their name
def result_list(spark, sf):
    return b.view(spark, sf, "v_products").select(
        F.concat_ws(" ", "p_type", "model").alias("request_id"), F.concat(F.lit("device "), F.col("model")).alias("query"), "product_key", "title",
        F.col("brand").alias("category"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("rank"))


LISTED = """p AS (SELECT concat(p_type, ' ', model) AS request_id, product_key, p_type, model, lower(title) AS t, lpad(concat('', p_partkey), 12, '0') AS rank,
  regexp_replace(lower(title), '\\s*\\((red|dark blue|obsidian|sky blue)\\)$', '') AS base FROM v_products)"""


@query("rank_family", f"""
WITH {LISTED}, k AS (SELECT *, -CAST(regexp_extract(t, 'iphone ([0-9]+)', 1) AS INT) AS a,
  CASE WHEN t LIKE '%dual sim%' THEN 1 WHEN t LIKE '%esim%' THEN 3 ELSE 0 END AS s FROM p WHERE p_type = 'ECONOMY'),
n AS (SELECT *, len(list_filter(string_split(concat('device ', model), ' '), lambda w: NOT list_contains(regexp_extract_all(base, '[a-z0-9]+'), w))) AS missing,
  abs(len(list_distinct(regexp_extract_all(base, '[a-z0-9]+'))) - 3) AS gap FROM p WHERE p_type <> 'ECONOMY')
SELECT request_id, product_key, row_number() OVER (PARTITION BY request_id ORDER BY a, s, base, rank) AS place FROM k
UNION ALL SELECT request_id, product_key, row_number() OVER (PARTITION BY request_id ORDER BY missing, gap, rank) FROM n""", ("v_products",))
def _(spark, sf):
    asked = result_list(spark, sf).withColumn("query", F.when(F.col("request_id").startswith("ECONOMY"), "apple iphone").otherwise(F.col("query")))
    return search.rank_family(asked).select("request_id", "product_key", "place")


# no request names the phone here: lists of phones only are recognised by their cards
@query("rank_family_by_closeness", f"""
WITH {LISTED}, k AS (SELECT *, CASE WHEN p_type = 'ECONOMY' THEN -CAST(regexp_extract(t, 'iphone ([0-9]+)', 1) AS INT)
    ELSE len(list_filter(string_split(concat('device ', model), ' '), lambda w: NOT list_contains(regexp_extract_all(base, '[a-z0-9]+'), w))) END AS a,
  CASE WHEN p_type <> 'ECONOMY' THEN abs(len(list_distinct(regexp_extract_all(base, '[a-z0-9]+'))) - 3) WHEN t LIKE '%dual sim%' THEN 1 WHEN t LIKE '%esim%' THEN 3 ELSE 0 END AS s,
  CASE WHEN p_type = 'ECONOMY' THEN base ELSE '' END AS d FROM p)
SELECT request_id, product_key, row_number() OVER (PARTITION BY request_id ORDER BY a, s, d, rank) AS place FROM k""", ("v_products",))
def _(spark, sf):
    return search.rank_family(result_list(spark, sf)).select("request_id", "product_key", "place")


@query("cluster_same_base_title", """
WITH b AS (SELECT concat(p_type, ' ', model) AS request_id, product_key, lpad(concat('', p_partkey), 12, '0') AS rank,
  lower(regexp_replace(title, '\\s*\\((Red|Dark Blue|Obsidian|Sky Blue)\\)$', '')) AS base_key FROM v_products)
SELECT request_id, product_key, base_key, min(rank) OVER (PARTITION BY request_id, base_key) AS group_rank FROM b""", ("v_products",))
def _(spark, sf):
    return search.cluster_same_base_title(result_list(spark, sf)).select("request_id", "product_key", "base_key", "group_rank")


@query("filter_primary_category", """
WITH l AS (SELECT concat(p_type, ' ', model) AS request_id, product_key, brand AS category, p_partkey AS rank FROM v_products),
f AS (SELECT request_id, arg_min(category, rank) AS category FROM l GROUP BY request_id)
SELECT l.request_id, l.product_key, l.category FROM l JOIN f USING (request_id, category)""", ("v_products",))
def _(spark, sf):
    return filters.filter_primary_category(result_list(spark, sf)).select("request_id", "product_key", "category")


# every brand is asked for, in the result list of its model names
@query("discover_categories", """
SELECT request_id, category, min(rank) AS first_rank FROM (
  SELECT concat(lower(brand), ' ', model) AS request_id, lower(p_type) AS category, lpad(concat('', p_partkey), 12, '0') AS rank FROM v_products WHERE p_type <> 'PROMO')
GROUP BY ALL""", ("v_products",))
def _(spark, sf):
    cards_ = b.view(spark, sf, "v_products")
    own = F.concat(F.lit("https://catalog.example/"), F.lower("p_type"), F.lit("/"), F.lower("brand"), F.lit("/"), "p_partkey")
    other = F.concat(F.lit("https://catalog.example/"), F.lower("p_type"), F.lit("/not-"), F.lower("brand"), F.lit("/"), "p_partkey")
    listed = cards_.select(
        F.concat_ws(" ", F.lower("brand"), "model").alias("request_id"), F.regexp_replace("brand", "^Brand", "Brand ").alias("query"), F.lit("").alias("category"),
        F.explode(F.array(own, other)).alias("url"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("rank"))
    return search.discover_categories(listed, ["promo"])


@query("dedupe_candidates", """
SELECT seller_key, url, min(position) AS position FROM (SELECT lower(coalesce(seller, '')) AS seller_key, url, position FROM v_offers) GROUP BY ALL""",
       ("v_offers",))
def _(spark, sf):
    offers = b.view(spark, sf, "v_offers").withColumn("seller_key", F.lower(F.coalesce("seller", F.lit(""))))
    return filters.dedupe_candidates(offers, ["seller_key", "url"], ["position"]).select("seller_key", "url", "position")


@query("prefer_exact_identifier", """
WITH o AS (SELECT concat(brand, ' ', model) AS request_id, o.price, o.position, regexp_replace(lower(o.title), '[^a-z0-9]', '', 'g') LIKE '%512gb%' AS identifier_hit
  FROM v_offers o JOIN v_products p USING (product_key))
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY identifier_hit DESC, price, position) AS place FROM o
WHERE identifier_hit OR request_id NOT IN (SELECT request_id FROM o WHERE identifier_hit)""", ("v_offers", "v_products"))
def _(spark, sf):
    offers = b.from_sql(spark, sf, """
        SELECT concat(brand, ' ', model) AS request_id, o.title AS title, o.price, o.position
        FROM {v_offers} o JOIN {v_products} p ON p.product_key = o.product_key""").withColumn("identifiers", F.array(F.lit("512-GB")))
    return search.prefer_exact_identifier(offers).select("request_id", "price", "position", "identifier_hit", "place")


def items(spark, sf):
    return identified(b.view(spark, sf, "v_items")).drop("brand", "model", "mpn")


def catalog(spark, sf):
    """Products before 2001, each with the identity of its first item."""
    first = b.view(spark, sf, "v_products").select("product_key", "brand", "model", "mpn")
    cards_ = identified(b.view(spark, sf, "v_catalog_products").join(first, "product_key")).drop("brand", "model", "mpn")
    offers = identified(b.view(spark, sf, "v_catalog_offers").join(first, "product_key")).drop("brand", "model", "mpn")
    return cards_, offers.withColumn("match_conflicts", F.array().cast("array<string>"))


# the names of the test tables, for the similarities that SQL cannot compute
MODEL_NAMES = [first + last for first in ("blue", "cold", "hot", "large", "new", "old", "red", "small")
               for last in ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")]
BRAND_NAMES = [f"brand{n}" for n in range(1, 26)]


def ratios(name, texts):
    """Similarities of all pairs of names that can matter, as a table; the order of a pair counts."""
    rows = [(a, b, 1.0 if a == b else SequenceMatcher(None, a, b).ratio()) for a, b in product(texts, texts)]
    return f"{name}(a, b, r) AS (VALUES " + ", ".join(f"('{a}', '{b}', {r!r}::DOUBLE)" for a, b, r in rows if r > 0.5) + ")"


#: The sequential walk as rounds: which identities have opened a product, and where, until nothing changes.
WALK = f"""{ratios("model_ratio", MODEL_NAMES)}, {ratios("brand_ratio", BRAND_NAMES)},
fresh AS (SELECT source, external_id, lower(trim(source)) AS source_key, brand, model, mpn, position, concat(lower(brand), '|', model, '|', coalesce(mpn, '')) AS u,
    concat('1', position) AS place, concat('product-', substr(sha256(concat(lower(trim(source)), chr(1), external_id)), 1, 16)) AS own_key
  FROM v_feed_items f WHERE NOT EXISTS (SELECT 1 FROM v_catalog_offers c WHERE c.source_key = lower(trim(f.source)) AND c.external_id = f.external_id)
  QUALIFY row_number() OVER (PARTITION BY lower(trim(source)), external_id ORDER BY position) = 1),
stored AS (SELECT concat(lower(brand), '|', model, '|', coalesce(mpn, '')) AS u, min(concat('0', c.position, '#', c.product_key)) AS place
  FROM v_catalog_products c JOIN v_products p USING (product_key) GROUP BY ALL),
idents AS (SELECT DISTINCT u, lower(brand) AS brand, replace(model, ' ', '') AS model, mpn FROM (
  SELECT u, brand, model, mpn FROM fresh UNION ALL SELECT s.u, p.brand, p.model, p.mpn FROM stored s JOIN v_products p ON concat(lower(p.brand), '|', p.model, '|', coalesce(p.mpn, '')) = s.u)),
alike AS (SELECT c.u AS c, i.u AS i, CASE WHEN c.mpn = i.mpn THEN 'exact' WHEN c.brand = i.brand AND c.model = i.model THEN 'probable'
    WHEN b.r >= 0.9 AND m.r >= 0.9 THEN 'probable' WHEN round(coalesce(b.r, 0) * 0.25 + m.r * 0.75, 4) >= 0.72 THEN 'review' END AS level,
    CASE WHEN c.mpn = i.mpn THEN 0.99 WHEN c.brand = i.brand AND c.model = i.model THEN 0.9 ELSE round(coalesce(b.r, 0) * 0.25 + m.r * 0.75, 4) END AS score
  FROM idents i JOIN model_ratio m ON m.b = i.model JOIN idents c ON c.model = m.a LEFT JOIN brand_ratio b ON b.a = c.brand AND b.b = i.brand WHERE i.u IN (SELECT u FROM fresh)
  UNION ALL SELECT c.u, i.u, 'exact', 0.99 FROM idents i JOIN idents c ON c.mpn = i.mpn AND c.u <> i.u),
asks AS (SELECT i, c, max(struct_pack(score, level)) AS best FROM alike WHERE level IS NOT NULL GROUP BY ALL),
walk AS (
  SELECT 0 AS round, u, min(place || '#' || own_key) AS place FROM fresh GROUP BY u
  UNION ALL
  SELECT round, u, min(place || '#' || own_key) FROM (
    SELECT w.round + 1 AS round, f.u, f.place, f.own_key, arg_max(best.level, struct_pack(score := best.score, early := -rank)) AS level
    FROM (SELECT DISTINCT round FROM walk) w CROSS JOIN fresh f LEFT JOIN (
      SELECT a.i, a.best, t.place, dense_rank() OVER (ORDER BY t.place) AS rank FROM asks a JOIN (SELECT u, place FROM walk UNION ALL SELECT u, place FROM stored) t ON t.u = a.c) e
      ON e.i = f.u AND e.place < f.place
    WHERE w.round < 8 GROUP BY ALL)
  WHERE level IS NULL OR level = 'review' GROUP BY round, u),
places AS (SELECT u, place FROM walk WHERE round = (SELECT max(round) FROM walk) UNION ALL SELECT u, place FROM stored),
decided AS (SELECT f.source, f.external_id, f.own_key, arg_max(struct_pack(level := best.level, score := best.score, key := string_split(e.place, '#')[2]),
    struct_pack(score := best.score, early := -rank)) AS b
  FROM fresh f LEFT JOIN (SELECT a.i, a.best, t.place, dense_rank() OVER (ORDER BY t.place) AS rank FROM asks a JOIN places t ON t.u = a.c) e ON e.i = f.u AND e.place < f.place
  GROUP BY f.source, f.external_id, f.own_key),
placed AS (SELECT source, external_id, CASE WHEN b.level IN ('exact', 'probable') THEN 'merged' ELSE 'created' END AS action,
  CASE WHEN b.level IN ('exact', 'probable') THEN b.key ELSE own_key END AS product_key, coalesce(b.level, 'rejected') AS match_level, b.score AS match_score,
  b.key AS match_candidate_key FROM decided)"""
RESOLVED = ("v_feed_items", "v_catalog_offers", "v_catalog_products", "v_products")


@query("match_identities", f"WITH {WALK} SELECT * FROM placed", RESOLVED)
def _(spark, sf):
    cards_, offers = catalog(spark, sf)
    fresh = matching.new_items(offers, identified(b.view(spark, sf, "v_feed_items")).drop("brand", "model", "mpn"))
    return matching.match_identities(fresh, cards_).select("source", "external_id", "action", "product_key", "match_level", "match_score", "match_candidate_key")


@query("new_items", """
SELECT lower(trim(source)) AS source_key, external_id, min(position) AS position FROM v_feed_items f
WHERE NOT EXISTS (SELECT 1 FROM v_catalog_offers c WHERE c.source_key = lower(trim(f.source)) AND c.external_id = f.external_id) GROUP BY ALL""",
       ("v_feed_items", "v_catalog_offers"))
def _(spark, sf):
    return matching.new_items(b.view(spark, sf, "v_catalog_offers"), b.view(spark, sf, "v_feed_items")).select("source_key", "external_id", "position")


# only identifiers decide here: an item with an mpn joins the oldest product of that mpn
@query("match_by_identifier", """
WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY position) AS rn FROM v_items WHERE mpn IS NOT NULL) WHERE rn = 1)
SELECT source, external_id, CASE WHEN row_number() OVER (PARTITION BY mpn ORDER BY position) = 1 THEN 'created' ELSE 'merged' END AS action,
  min(position) OVER (PARTITION BY mpn) AS product_position FROM n""", ("v_items",))
def _(spark, sf):
    coded = b.view(spark, sf, "v_items").filter("mpn IS NOT NULL").withColumns({"brand": F.lit(None).cast("string"), "model": F.lit(None).cast("string")})
    fresh = matching.new_items(b.view(spark, sf, "v_catalog_offers").limit(0), identified(coded).select("position", "source", "external_id", "identity"))
    nothing = fresh.select("product_key", "position", "identity").limit(0)
    placed = compressed(matching.match_identities(fresh, nothing).select("source", "external_id", "action", "product_key", "position"))
    opened = placed.filter("action = 'created'").select("product_key", F.col("position").alias("product_position"))
    return placed.join(opened, "product_key").select("source", "external_id", "action", "product_position")


@query("update_catalog", f"""
WITH {WALK}, acted AS (SELECT CASE WHEN f.position = p.position THEN p.action ELSE 'updated' END AS action
  FROM v_feed_items f LEFT JOIN (SELECT source, external_id, action, position FROM placed JOIN fresh USING (source, external_id)) p
    ON lower(trim(p.source)) = lower(trim(f.source)) AND p.external_id = f.external_id)
SELECT coalesce(action, 'updated') AS action, count(*) AS rows FROM acted GROUP BY ALL""", RESOLVED)
def _(spark, sf):
    cards_, offers = catalog(spark, sf)
    feed = identified(b.view(spark, sf, "v_feed_items")).drop("brand", "model", "mpn")
    return update_catalog(cards_, offers, feed, b.now()).actions.groupBy("action").agg(F.count(F.lit(1)).alias("rows"))
