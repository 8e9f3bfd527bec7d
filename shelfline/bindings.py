"""Product-offer views over the generic star-schema test tables.

Every view is one SQL text that Spark and DuckDB read alike; ``view`` resolves it for Spark,
``ctes`` renders the same text as a WITH clause. ``{name}`` refers to a table or another view.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Reference instant of every time-dependent query (the last observation is one day earlier).
NOW = "2001-11-05 00:00:00"
NOW_SQL = f"CAST('{NOW}' AS TIMESTAMP)"
NOW_NTZ = f"TIMESTAMP_NTZ'{NOW}'"

VIEWS: dict[str, str] = {}

# part = product card; the title carries the features a shop would write into it
VIEWS["v_products"] = """
SELECT p_partkey,
       concat('product-', p_partkey) AS product_key,
       concat_ws(' ',
         CASE p_type WHEN 'ECONOMY' THEN concat('Apple iPhone ', 10 + p_size % 8)
                     WHEN 'LARGE' THEN 'laptop' WHEN 'PROMO' THEN 'case' ELSE 'device' END,
         replace(p_brand, '#', ''), p_name,
         CASE WHEN p_type = 'LARGE' THEN concat(CASE p_size % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END, '/512')
              ELSE concat(CASE p_size % 4 WHEN 0 THEN 64 WHEN 1 THEN 128 WHEN 2 THEN 256 ELSE 512 END, 'GB') END,
         CASE p_size % 5 WHEN 1 THEN 'Dual SIM' WHEN 2 THEN 'eSIM only' WHEN 3 THEN 'nano-SIM + eSIM' END,
         CASE p_size % 7 WHEN 1 THEN 'EU' WHEN 2 THEN 'Global' WHEN 3 THEN 'USA' END,
         CASE p_size % 11 WHEN 1 THEN 'refurbished' WHEN 2 THEN 'open box' WHEN 3 THEN 'used' END,
         CASE WHEN p_name LIKE 'red %' THEN '(Red)' WHEN p_name LIKE 'blue %' THEN '(Dark Blue)'
              WHEN p_name LIKE 'small %' THEN '(Obsidian)' WHEN p_name LIKE 'hot %' THEN '(Sky Blue)' END) AS title,
       replace(p_brand, '#', '') AS brand, p_name AS model,
       CASE WHEN p_partkey % 2 = 1 THEN concat('P', p_partkey) END AS mpn,
       p_type, p_size, p_retailprice
FROM {part}
"""

# titles that are shown, by the pool they are compared in: a model name of one type and of two neighbouring brands.
# A pool has a bounded number of titles, so every card may ask and the pairs still grow with the cards.
VIEWS["v_shown"] = """
SELECT DISTINCT title, model, p_type, brand, CAST(floor(CAST(replace(brand, 'Brand', '') AS INT) / 2) AS INT) AS brands FROM {v_products}
"""

# requests of a comparison: every card asks
VIEWS["v_wanted"] = """
SELECT product_key AS request_id, title AS wanted_title, model, p_type, brand, CAST(floor(CAST(replace(brand, 'Brand', '') AS INT) / 2) AS INT) AS brands
FROM {v_products}
"""

# the same with equal cards asking once, for comparisons with offers
VIEWS["v_wanted_titles"] = """
SELECT min(product_key) AS request_id, title AS wanted_title, model, p_type, brand FROM {v_products} GROUP BY title, model, p_type, brand
"""

# line = one observed offer, supplier = source
VIEWS["v_offers"] = """
SELECT p.product_key, s_name AS source,
       CASE l_linenumber % 3 WHEN 0 THEN NULL ELSE concat('Seller ', l_linenumber) END AS seller,
       p.title AS title,
       floor(l_extendedprice * 100 / l_quantity) / 100 AS price,
       CASE l_returnflag WHEN 'A' THEN 'BYN' WHEN 'N' THEN 'USD' ELSE 'EUR' END AS currency,
       l_linestatus = 'O' AS available,
       concat('https://shop', l_suppkey, '.example/p/', l_partkey) AS url,
       l_shipdate AS observed_at,
       concat(CAST(l_shipdate AS DATE), '-', lpad(concat('', l_orderkey), 11, '0'), '-', l_linenumber, '-',
              lpad(concat('', l_partkey), 10, '0'), '-', lpad(concat('', l_suppkey), 8, '0'), '-',
              lpad(concat('', CAST(l_quantity AS INT)), 3, '0')) AS position
FROM {lineitem}
JOIN {v_products} p ON p.p_partkey = l_partkey
JOIN {supplier} ON s_suppkey = l_suppkey
"""

# rows of a feed: key is (source, external_id), which repeats by design
VIEWS["v_items"] = """
SELECT concat(CAST(l_shipdate AS DATE), '-', lpad(concat('', l_orderkey), 11, '0'), '-', l_linenumber, '-',
              lpad(concat('', l_partkey), 10, '0'), '-', lpad(concat('', l_suppkey), 8, '0'), '-',
              lpad(concat('', CAST(l_quantity AS INT)), 3, '0')) AS position,
       s_name AS source, concat('', l_partkey) AS external_id, p.title AS title,
       concat('https://shop', l_suppkey, '.example/p/', l_partkey) AS url,
       floor(l_extendedprice * 100 / l_quantity) / 100 AS price,
       CASE l_returnflag WHEN 'A' THEN 'BYN' WHEN 'N' THEN 'USD' ELSE 'EUR' END AS currency,
       l_linestatus = 'O' AS available,
       p.brand AS brand, p.model AS model, p.mpn AS mpn,
       l_shipdate AS updated_at
FROM {lineitem}
JOIN {v_products} p ON p.p_partkey = l_partkey
JOIN {supplier} ON s_suppkey = l_suppkey
"""

# newest row of every external key before 2001: the catalog a later feed meets
VIEWS["v_catalog_offers"] = """
SELECT source_key, external_id, product_key, position, source, title, url, price, currency, available, updated_at,
       match_level, CAST(raw_score AS DOUBLE) AS match_score, match_reason, match_candidate_key
FROM (
  SELECT lower(trim(source)) AS source_key, external_id, concat('product-', external_id) AS product_key, position,
         source, title, url, price, currency, available, updated_at,
         CASE WHEN price < 400 THEN 'rejected' WHEN price < 1000 THEN 'review'
              WHEN price < 5000 THEN 'probable' WHEN price < 20000 THEN 'exact' END AS match_level,
         CASE WHEN price < 400 THEN 0.0 WHEN price < 1000 THEN 0.8
              WHEN price < 5000 THEN 0.9 WHEN price < 20000 THEN 0.96 END AS raw_score,
         CASE WHEN price < 1000 THEN 'ambiguous_brand_or_model' ELSE 'same_model_no_variant_conflicts' END AS match_reason,
         CASE WHEN price < 1000 THEN concat('product-', CAST(external_id AS INT) + 1) END AS match_candidate_key,
         row_number() OVER (PARTITION BY source, external_id ORDER BY position DESC) AS rn
  FROM {v_items} WHERE updated_at < CAST('2001-01-01 00:00:00' AS TIMESTAMP)) ranked
WHERE rn = 1
"""

VIEWS["v_catalog_products"] = """
SELECT product_key, min(title) AS title, min(position) AS position FROM {v_catalog_offers} GROUP BY product_key
"""

# the feed that arrives in 2001
VIEWS["v_feed_items"] = """
SELECT * FROM {v_items} WHERE updated_at >= CAST('2001-01-01 00:00:00' AS TIMESTAMP)
"""

# observations share one instant per month, like a batch with one timestamp
VIEWS["v_observations"] = """
SELECT product_key, title, source, seller, price, currency, url,
       date_trunc('month', observed_at) AS observed_at, position AS id
FROM {v_offers}
"""

VIEWS["v_subscriptions"] = """
SELECT DISTINCT o_custkey AS chat_id, p.product_key AS product_key, p.title AS title, p.model AS query,
       p.p_retailprice AS last_notified_price, 'BYN' AS currency, p.p_size % 3 <> 0 AS active,
       CAST('2001-01-01 00:00:00' AS TIMESTAMP) AS created_at
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {v_products} p ON p.p_partkey = l_partkey
"""

# toggle events of a customer for a product, some of them with an unusable price
VIEWS["v_toggles"] = """
SELECT o_custkey AS chat_id, p.product_key AS product_key, p.title AS title, p.model AS query,
       CASE WHEN l_linenumber = 7 THEN -1.0 ELSE floor(l_extendedprice * 100 / l_quantity) / 100 END AS price,
       'BYN' AS currency,
       concat(CAST(l_shipdate AS DATE), '-', lpad(concat('', l_orderkey), 11, '0'), '-', l_linenumber, '-',
              lpad(concat('', l_suppkey), 8, '0'), '-', lpad(concat('', CAST(l_quantity AS INT)), 3, '0')) AS position
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {v_products} p ON p.p_partkey = l_partkey
"""

# user turns as raw queries, model names as clean ones
VIEWS["v_requests"] = """
SELECT concat('c', conv_id, '-', turn) AS request_id, text AS query FROM {conversations} WHERE role = 'user'
"""
VIEWS["v_model_requests"] = """
SELECT DISTINCT concat('m-', replace(p_name, ' ', '-')) AS request_id, p_name AS query FROM {part}
"""

# one feed record per event; the event type decides what is wrong with it
VIEWS["v_feed"] = """
SELECT event_id + 1 AS record,
       CASE WHEN event_type = 'error' AND value < 20 THEN NULL ELSE concat('Shop ', user_id) END AS source,
       concat('Device ', user_id, ' ', CASE WHEN value < 50 THEN '64GB' ELSE '128GB' END) AS title,
       CASE WHEN event_type = 'view' AND value < 5 THEN concat('ftp://shop.example/', event_id)
            WHEN event_type = 'view' AND value > 200 THEN '/relative'
            ELSE concat('https://shop', user_id, '.example/item/', event_id) END AS url,
       CASE WHEN event_type = 'click' AND value < 3 THEN 'n/a'
            WHEN event_type = 'click' AND value > 150 THEN concat('-', CAST(floor(value) AS INT))
            WHEN event_type = 'signup' THEN concat(CAST(floor(value) AS INT), ',5')
            ELSE concat('', CAST(floor(value) AS INT)) END AS price,
       CASE event_type WHEN 'purchase' THEN 'in_stock' WHEN 'signup' THEN 'no'
                       WHEN 'error' THEN CASE WHEN value > 150 THEN 'maybe' ELSE 'yes' END ELSE 'true' END AS available,
       CASE WHEN event_type = 'signup' AND value > 180 THEN 'yesterday'
            WHEN event_type = 'purchase' THEN '2024-01-15T10:00:00+00:00' ELSE '2024-01-15T10:00:00Z' END AS updated_at
FROM {events}
"""

# candidate offers of a comparison, accepted if sellable and not too cheap; one request per brand and model
VIEWS["v_decisions"] = """
SELECT o.*, concat(p.brand, ' ', p.model) AS request_id,
       available AND price >= 500 AS accepted,
       CASE WHEN NOT available THEN 'unavailable' WHEN price < 100 THEN 'accessory' WHEN price < 500 THEN 'model_number'
            ELSE 'exact_match' END AS reason
FROM {v_offers} o JOIN {v_products} p ON p.product_key = o.product_key
"""

# which source was asked for which request, and whether it answered
VIEWS["v_attempts"] = """
SELECT DISTINCT d.request_id AS request_id, d.source AS source,
       s_acctbal < 0 OR d.request_id LIKE '%Brand7 %' AS failed
FROM {v_decisions} d JOIN {supplier} ON s_name = d.source
"""

VIEWS["v_stream"] = """
SELECT event_id, ts AS observed_at, concat('user-', user_id) AS product_key, event_type AS source,
       value AS price, 'BYN' AS currency
FROM {events}
"""


# The same rows as v_catalog_offers in an order of steps that shuffles less: the newest line of a key is chosen on the line's own
# columns, and titles, addresses and positions are written for the lines that stay. Only Spark reads this text.
_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate"
_POSITION = """concat(CAST(l_shipdate AS DATE), '-', lpad(concat('', l_orderkey), 11, '0'), '-', l_linenumber, '-',
              lpad(concat('', l_partkey), 10, '0'), '-', lpad(concat('', l_suppkey), 8, '0'), '-',
              lpad(concat('', CAST(l_quantity AS INT)), 3, '0'))"""
_LEVELS = """SELECT *,
       CASE WHEN price < 400 THEN 'rejected' WHEN price < 1000 THEN 'review'
            WHEN price < 5000 THEN 'probable' WHEN price < 20000 THEN 'exact' END AS match_level,
       CAST(CASE WHEN price < 400 THEN 0.0 WHEN price < 1000 THEN 0.8
                 WHEN price < 5000 THEN 0.9 WHEN price < 20000 THEN 0.96 END AS DOUBLE) AS match_score,
       CASE WHEN price < 1000 THEN 'ambiguous_brand_or_model' ELSE 'same_model_no_variant_conflicts' END AS match_reason,
       CASE WHEN price < 1000 THEN concat('product-', CAST(external_id AS INT) + 1) END AS match_candidate_key
FROM offers
"""
SPARK_VIEWS = {"v_catalog_offers": f"""
WITH lines AS (
  SELECT /*+ REPARTITION(s_name, l_partkey) */ {_LINE}, s_name FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey
  WHERE l_shipdate < CAST('2001-01-01 00:00:00' AS TIMESTAMP) AND l_partkey IS NOT NULL),
newest AS (
  SELECT {_LINE}, s_name FROM (SELECT *, row_number() OVER (PARTITION BY s_name, l_partkey ORDER BY {_POSITION} DESC) AS rn FROM lines)
  WHERE rn = 1),
-- cards that come more than once still give an offer once
cards AS (SELECT p_partkey, min(title) AS title FROM {{v_products}} GROUP BY p_partkey),
offers AS (
  SELECT lower(trim(s_name)) AS source_key, concat('', l_partkey) AS external_id, concat('product-', l_partkey) AS product_key, {_POSITION} AS position,
         s_name AS source, title, concat('https://shop', l_suppkey, '.example/p/', l_partkey) AS url, floor(l_extendedprice * 100 / l_quantity) / 100 AS price,
         CASE l_returnflag WHEN 'A' THEN 'BYN' WHEN 'N' THEN 'USD' ELSE 'EUR' END AS currency, l_linestatus = 'O' AS available, l_shipdate AS updated_at
  FROM newest JOIN cards ON p_partkey = l_partkey)
{_LEVELS}"""}

# Subscriptions and toggles meet per customer and product. Customers are found for the bare numbers of a line, those are shuffled by product, and
# titles come to them there: what follows by customer and product has its rows in place, and no title is shuffled but that of a card.
SPARK_VIEWS["v_subscriptions"] = """
WITH pairs AS (
  SELECT DISTINCT chat_id, product_key FROM (
    SELECT /*+ REPARTITION(product_key) */ * FROM (
      SELECT o_custkey AS chat_id, concat('product-', l_partkey) AS product_key FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey) WHERE product_key IS NOT NULL)),
cards AS (
  SELECT DISTINCT product_key, title, model AS query, p_retailprice AS last_notified_price, p_size % 3 <> 0 AS active FROM {v_products})
SELECT chat_id, pairs.product_key AS product_key, title, query, last_notified_price, 'BYN' AS currency, active, CAST('2001-01-01 00:00:00' AS TIMESTAMP) AS created_at
FROM pairs JOIN cards ON cards.product_key = pairs.product_key
"""
SPARK_VIEWS["v_toggles"] = """
WITH lines AS (
  SELECT /*+ REPARTITION(product_key) */ * FROM (
    SELECT o_custkey AS chat_id, concat('product-', l_partkey) AS product_key, l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate
    FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey) WHERE product_key IS NOT NULL)
SELECT chat_id, lines.product_key AS product_key, p.title AS title, p.model AS query,
       CASE WHEN l_linenumber = 7 THEN -1.0 ELSE floor(l_extendedprice * 100 / l_quantity) / 100 END AS price,
       'BYN' AS currency,
       concat(CAST(l_shipdate AS DATE), '-', lpad(concat('', l_orderkey), 11, '0'), '-', l_linenumber, '-',
              lpad(concat('', l_suppkey), 8, '0'), '-', lpad(concat('', CAST(l_quantity AS INT)), 3, '0')) AS position
FROM lines JOIN {v_products} p ON p.product_key = lines.product_key
"""

# The rows of v_catalog_offers once more, for steps that gather the offers of a product. One shuffle of narrow lines by product serves all of them: what follows finds the
# offers where they are. The newest line is the greatest struct, whose columns cannot be cut one by one, so that plans which read
# different columns of the offers still have this shuffle in common. Of lines with one position, or without, the first one read counts.
BY_PRODUCT = f"""
WITH lines AS (
  SELECT /*+ REPARTITION(product_key) */ * FROM (
    SELECT concat('product-', l_partkey) AS product_key, s_name, -monotonically_increasing_id() AS earlier, {_LINE} FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey
    WHERE l_shipdate < CAST('2001-01-01 00:00:00' AS TIMESTAMP) AND l_partkey IS NOT NULL) WHERE product_key IS NOT NULL),
newest AS (
  SELECT product_key, s_name, max(struct({_POSITION} AS position, earlier, {_LINE})) AS line FROM lines GROUP BY product_key, s_name),
cards AS (SELECT product_key, min(title) AS title FROM {{v_products}} GROUP BY product_key),
offers AS (
  SELECT lower(trim(s_name)) AS source_key, concat('', line.l_partkey) AS external_id, newest.product_key AS product_key, line.position AS position,
         s_name AS source, title, concat('https://shop', line.l_suppkey, '.example/p/', line.l_partkey) AS url, floor(line.l_extendedprice * 100 / line.l_quantity) / 100 AS price,
         CASE line.l_returnflag WHEN 'A' THEN 'BYN' WHEN 'N' THEN 'USD' ELSE 'EUR' END AS currency, line.l_linestatus = 'O' AS available, line.l_shipdate AS updated_at
  FROM newest JOIN cards ON cards.product_key = newest.product_key)
{_LEVELS}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _references(sql: str) -> list[str]:
    return sorted({field for _, field, _, _ in Formatter().parse(sql) if field})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    return from_sql(spark, sf_dir, SPARK_VIEWS.get(name) or VIEWS[name])


def from_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    inputs = {name: view(spark, sf_dir, name) for name in _references(sql)}
    return spark.sql(sql, **inputs)


def ctes(*names: str) -> str:
    """The views as a WITH clause, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for dependency in _references(VIEWS[name]):
            visit(dependency)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in ordered:
        body = VIEWS[name].format(**{r: r for r in _references(VIEWS[name])})
        parts.append(f"{name} AS ({body.strip()})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def now() -> Column:
    """The reference instant as a column; built on demand because it needs a running session."""
    return F.expr(NOW_NTZ)
