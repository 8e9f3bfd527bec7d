"""Price checks, comparison results, history and alerts over the test tables."""

from pyspark.sql import functions as F

from shelfline import bindings as b
from shelfline.operators import alerts, filters, history, pricing
from shelfline.registry.base import Registry

registry = Registry()
query = registry.query

# the plausibility rule on ASCII titles
PLAUSIBLE = """price > 0 AND CASE
  WHEN currency = 'BYN' AND regexp_matches(title, '(?i)\\biphone\\b') THEN price >= 300
  WHEN currency = 'BYN' AND regexp_matches(title, '(?i)\\b(iphone|laptop|washer|dryer|oven|refrigerator|dishwasher)\\b')
    THEN price >= 100 ELSE true END"""

# the outlier rule over a relation named ``usable``
OUTLIERS = """
medians AS (SELECT product_key, lower(source) AS voter, median(price) AS m FROM usable GROUP BY ALL),
floors AS (SELECT product_key, 0.25 * median(m) AS f FROM medians GROUP BY product_key HAVING count(*) >= 2),
sane AS (SELECT u.* FROM usable u LEFT JOIN floors USING (product_key) WHERE f IS NULL OR price >= f)"""


def offers(spark, sf):
    return b.view(spark, sf, "v_offers")


@query("filter_sellable", "SELECT * FROM v_offers WHERE available AND isfinite(price) AND price >= 0", ("v_offers",))
def _(spark, sf):
    return pricing.filter_sellable(offers(spark, sf))


@query("filter_plausible_price", f"SELECT * FROM v_offers WHERE {PLAUSIBLE}", ("v_offers",))
def _(spark, sf):
    return pricing.filter_plausible_price(offers(spark, sf))


@query("filter_plausible_price_in_context", f"""
SELECT *, concat(title, CASE WHEN seller IS NULL THEN ' per month' ELSE '' END) AS context FROM v_offers
WHERE {PLAUSIBLE} AND seller IS NOT NULL""", ("v_offers",))
def _(spark, sf):
    page = offers(spark, sf).withColumn(
        "context", F.concat("title", F.when(F.col("seller").isNull(), " per month").otherwise("")))
    return pricing.filter_plausible_price(page, context="context")


@query("filter_fresh", f"""
SELECT * FROM v_items WHERE available AND price IS NOT NULL AND trim(url) <> ''
AND updated_at >= {b.NOW_SQL} - INTERVAL 24 HOUR""", ("v_items",))
def _(spark, sf):
    return filters.filter_fresh(b.view(spark, sf, "v_items"), b.now())


@query("filter_live_products", f"""
SELECT * FROM v_catalog_products WHERE product_key IN (
  SELECT concat('product-', external_id) FROM v_items WHERE available AND updated_at >= {b.NOW_SQL} - INTERVAL 720 HOUR)""",
       ("v_catalog_products", "v_items"))
def _(spark, sf):
    current = b.view(spark, sf, "v_items").withColumn("product_key", F.concat(F.lit("product-"), "external_id"))
    return filters.filter_live_products(b.view(spark, sf, "v_catalog_products"), current, b.now())


@query("filter_price_outliers", f"WITH usable AS (SELECT * FROM v_offers WHERE available), {OUTLIERS} SELECT * FROM sane",
       ("v_offers",))
def _(spark, sf):
    return pricing.filter_price_outliers(offers(spark, sf).filter("available"))


@query("source_median_price", """
SELECT product_key, source, round(median(price), 4) AS median_price FROM v_offers GROUP BY ALL""", ("v_offers",))
def _(spark, sf):
    return pricing.exact_median(offers(spark, sf), ["product_key", "source"], "price", "m").select(
        "product_key", "source", F.round("m", 4).alias("median_price"))


@query("cheapest_per_source", f"""
WITH usable AS (SELECT * FROM v_offers WHERE available AND {PLAUSIBLE}), {OUTLIERS}
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY product_key, source ORDER BY price, position) AS rn FROM sane) WHERE rn = 1""",
       ("v_offers",))
def _(spark, sf):
    return pricing.cheapest_per_source(offers(spark, sf))


@query("cheapest_per_offer_key", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(trim(source)), lower(trim(coalesce(seller, ''))),
    rtrim(trim(url), '/'), lower(trim(currency)) ORDER BY price, position) AS rn FROM v_offers) WHERE rn = 1""", ("v_offers",))
def _(spark, sf):
    return pricing.cheapest_per_offer_key(offers(spark, sf))


@query("top_k_offers", f"""
WITH usable AS (SELECT * FROM v_offers WHERE available AND {PLAUSIBLE}), {OUTLIERS}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY price, position) AS place FROM sane)
WHERE place <= 6""", ("v_offers",))
def _(spark, sf):
    return pricing.top_k_offers(offers(spark, sf), 6)


@query("sort_offers", "SELECT * FROM v_offers WHERE available ORDER BY price, position", ("v_offers",))
def _(spark, sf):
    return pricing.sort_offers(offers(spark, sf).filter("available"))


@query("rank_offers", """
SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY price, position) AS place FROM v_offers""", ("v_offers",))
def _(spark, sf):
    return pricing.rank_offers(offers(spark, sf))


@query("lowest_price", """
SELECT product_key, currency_key, price, source, seller, url FROM (
  SELECT *, lower(currency) AS currency_key,
    row_number() OVER (PARTITION BY product_key, lower(currency) ORDER BY price, position) AS rn
  FROM v_offers WHERE available AND price >= 0) WHERE rn = 1""", ("v_offers",))
def _(spark, sf):
    return pricing.lowest_price(offers(spark, sf))


@query("cheapest_variant", """
WITH minima AS (SELECT request_id, product_key, min(price) AS lowest, min(position) AS first_at FROM v_decisions WHERE accepted
                GROUP BY ALL)
SELECT request_id, product_key, lowest FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY lowest, first_at, product_key) AS rn FROM minima) WHERE rn = 1""",
       ("v_decisions",))
def _(spark, sf):
    accepted = b.view(spark, sf, "v_decisions").filter("accepted")
    return pricing.cheapest_variant(accepted, "request_id", "product_key", "position")


@query("any_variant_offers", """
SELECT request_id, source, seller, url, currency, price, product_key FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id, lower(trim(source)), lower(trim(coalesce(seller, ''))),
    rtrim(trim(url), '/'), lower(trim(currency)) ORDER BY price, position) AS rn FROM v_decisions WHERE accepted)
WHERE rn = 1""", ("v_decisions",))
def _(spark, sf):
    accepted = b.view(spark, sf, "v_decisions").filter("accepted")
    return pricing.cheapest_per_offer_key(accepted, ["request_id"]).select(
        "request_id", "source", "seller", "url", "currency", "price", "product_key")


@query("distinct_decisions", """
SELECT request_id, source, title, accepted, reason, min(position) AS position FROM v_decisions GROUP BY ALL""",
       ("v_decisions",))
def _(spark, sf):
    return pricing.distinct_decisions(b.view(spark, sf, "v_decisions")).select(
        "request_id", "source", "title", "accepted", "reason", "position")


@query("rejection_histogram", """
SELECT reason, count(*) AS rejected FROM v_decisions WHERE NOT accepted GROUP BY reason ORDER BY reason""", ("v_decisions",))
def _(spark, sf):
    return pricing.rejection_histogram(b.view(spark, sf, "v_decisions"))


STATUS = """
counted AS (SELECT request_id, source, count(*) AS checked, count(*) FILTER (accepted) AS matched
            FROM v_decisions GROUP BY ALL),
status AS (SELECT a.request_id, a.source,
  CASE WHEN failed THEN 'unavailable' WHEN coalesce(matched, 0) > 0 THEN 'found'
       WHEN coalesce(checked, 0) > 0 THEN 'filtered' ELSE 'not_found' END AS state,
  coalesce(matched, 0) AS matched_offers, coalesce(checked, 0) AS checked_candidates
  FROM v_attempts a LEFT JOIN counted c USING (request_id, source))"""


def statuses(spark, sf):
    return pricing.source_status(b.view(spark, sf, "v_attempts"), b.view(spark, sf, "v_decisions"))


@query("source_status", f"WITH {STATUS} SELECT * FROM status", ("v_decisions", "v_attempts"))
def _(spark, sf):
    return statuses(spark, sf)


@query("merge_source_status", f"""
WITH {STATUS}, ranked AS (SELECT *, split_part(request_id, ' ', 1) AS family,
   CASE state WHEN 'found' THEN 4 WHEN 'filtered' THEN 3 WHEN 'not_found' THEN 2 ELSE 1 END AS p FROM status)
SELECT family, lower(trim(source)) AS source_key, min(source) AS source,
  CASE max(p) WHEN 4 THEN 'found' WHEN 3 THEN 'filtered' WHEN 2 THEN 'not_found' ELSE 'unavailable' END AS state,
  CAST(sum(matched_offers) AS BIGINT) AS matched_offers, CAST(sum(checked_candidates) AS BIGINT) AS checked_candidates,
  max(length(request_id)) / 10 AS duration_seconds
FROM ranked GROUP BY ALL""", ("v_decisions", "v_attempts"))
def _(spark, sf):
    variants_of = (statuses(spark, sf).withColumn("family", F.split("request_id", " ")[0])
                   .withColumn("position", F.col("request_id"))
                   .withColumn("duration_seconds", F.length("request_id") / 10))
    return pricing.merge_source_status(variants_of, ["family"])


CACHED = """
dead AS (SELECT request_id FROM v_attempts GROUP BY request_id HAVING bool_and(failed)),
verified AS (SELECT d.* FROM v_decisions d JOIN v_attempts a USING (request_id, source)
             WHERE accepted AND NOT failed),
cached AS (SELECT *, 'Сохранённая цена; источник сейчас недоступен' AS availability_text FROM v_decisions s
  WHERE available AND request_id IN (SELECT request_id FROM dead) AND request_id NOT IN (SELECT request_id FROM verified)
    AND (request_id, lower(source)) IN (SELECT request_id, lower(source) FROM v_attempts WHERE failed))"""


def verified_and_cached(spark, sf):
    decisions, attempts = b.view(spark, sf, "v_decisions"), b.view(spark, sf, "v_attempts")
    reachable = attempts.filter("NOT failed").select("request_id", "source")
    verified = decisions.filter("accepted").join(reachable, ["request_id", "source"], "left_semi")
    return verified, pricing.cached_fallback(attempts, verified, decisions.filter("available"))


@query("cached_fallback", f"WITH {CACHED} SELECT * FROM cached", ("v_decisions", "v_attempts"))
def _(spark, sf):
    return verified_and_cached(spark, sf)[1]


@query("union_verified_cached", f"""
WITH {CACHED} SELECT *, NULL AS availability_text FROM verified UNION ALL SELECT * FROM cached""",
       ("v_decisions", "v_attempts"))
def _(spark, sf):
    return pricing.union_verified_cached(*verified_and_cached(spark, sf))


@query("union_sources", """
SELECT product_key, source, price, currency, url FROM v_offers
UNION ALL SELECT product_key, source, price, currency, '' FROM v_stream""", ("v_offers", "v_stream"))
def _(spark, sf):
    columns = ["product_key", "source", "price", "currency", "url"]
    return pricing.union_sources(offers(spark, sf).select(columns),
                                 b.view(spark, sf, "v_stream").withColumn("url", F.lit("")).select(columns))


MINIMA = """minima AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY product_key, observed_at, currency ORDER BY price, id) AS rn FROM v_observations) WHERE rn = 1)"""


@query("price_history", f"""
WITH {MINIMA} SELECT product_key, observed_at, price, currency, source, place FROM (
  SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY observed_at DESC, currency) AS place FROM minima)
WHERE place <= 10""", ("v_observations",))
def _(spark, sf):
    return history.price_history(b.view(spark, sf, "v_observations"))


@query("min_price_trend", """
WITH m AS (SELECT product_key, currency, observed_at, min(price) AS min_price FROM v_observations GROUP BY ALL)
SELECT *, lag(min_price) OVER w AS previous_price, min_price - lag(min_price) OVER w AS change FROM m
WINDOW w AS (PARTITION BY product_key, currency ORDER BY observed_at)""", ("v_observations",))
def _(spark, sf):
    return history.min_price_trend(b.view(spark, sf, "v_observations"))


@query("append_observations", """
SELECT product_key, title, source, seller, price, currency, url, observed_at FROM v_observations
WHERE isfinite(price) AND price >= 0""", ("v_observations",))
def _(spark, sf):
    return history.valid_observations(b.view(spark, sf, "v_observations")).drop("id")


@query("evaluate_alerts", f"""
WITH lowest AS (SELECT * FROM (SELECT product_key, lower(currency) AS ck, price AS current_price, source AS current_source,
    url AS current_url, row_number() OVER (PARTITION BY product_key, lower(currency) ORDER BY price, position) AS rn
  FROM v_offers WHERE available AND price >= 0) WHERE rn = 1)
SELECT s.chat_id, s.product_key, s.title, s.query, s.last_notified_price, s.currency, s.active, s.created_at, current_price,
  current_source, current_url, coalesce(current_price < last_notified_price, false) AS fired,
  CASE WHEN current_price < last_notified_price THEN current_price ELSE last_notified_price END AS new_baseline,
  {b.NOW_SQL} AS checked_at
FROM v_subscriptions s LEFT JOIN lowest l ON l.product_key = s.product_key AND l.ck = lower(s.currency) WHERE s.active""",
       ("v_subscriptions", "v_offers"))
def _(spark, sf):
    return alerts.evaluate_alerts(b.view(spark, sf, "v_subscriptions"), offers(spark, sf), b.now())


@query("toggle_alerts", f"""
WITH valid AS (SELECT *, row_number() OVER (PARTITION BY chat_id, product_key ORDER BY position DESC) AS rn,
    count(*) OVER (PARTITION BY chat_id, product_key) AS flips FROM v_toggles WHERE price >= 0),
joined AS (SELECT coalesce(s.chat_id, l.chat_id) AS chat_id, coalesce(s.product_key, l.product_key) AS product_key,
    s.title AS s_title, s.query AS s_query, s.last_notified_price AS s_price, s.currency AS s_currency, s.created_at AS s_created,
    coalesce(s.active, false) AS was, coalesce(l.flips, 0) AS flips, l.title AS l_title, l.query AS l_query, l.price AS l_price,
    l.currency AS l_currency, e.title AS e_title, e.query AS e_query, e.price AS e_price, e.currency AS e_currency
  FROM v_subscriptions s FULL JOIN (SELECT * FROM valid WHERE rn = 1) l
    ON s.chat_id = l.chat_id AND s.product_key = l.product_key
  LEFT JOIN (SELECT * FROM valid WHERE rn = 2) e ON e.chat_id = l.chat_id AND e.product_key = l.product_key),
decided AS (SELECT *, was <> (flips % 2 = 1) AS now_active FROM joined)
SELECT chat_id, product_key,
  coalesce(CASE WHEN now_active AND flips > 0 THEN l_title WHEN flips > 0 THEN e_title END, s_title) AS title,
  coalesce(CASE WHEN now_active AND flips > 0 THEN l_query WHEN flips > 0 THEN e_query END, s_query) AS query,
  coalesce(CASE WHEN now_active AND flips > 0 THEN l_price WHEN flips > 0 THEN e_price END, s_price) AS last_notified_price,
  coalesce(CASE WHEN now_active AND flips > 0 THEN l_currency WHEN flips > 0 THEN e_currency END, s_currency) AS currency,
  now_active AS active, coalesce(s_created, {b.NOW_SQL}) AS created_at, CAST(NULL AS TIMESTAMP) AS checked_at
FROM decided""", ("v_subscriptions", "v_toggles"))
def _(spark, sf):
    state = b.view(spark, sf, "v_subscriptions").withColumn("checked_at", F.lit(None).cast("timestamp_ntz"))
    return alerts.toggle_alerts(state, b.view(spark, sf, "v_toggles"), b.now())
