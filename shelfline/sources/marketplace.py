"""Marketplace JSON payloads and sitemaps as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfline.functions.text import display_time, slug_title
from shelfline.sources.pages import exact_price

# fixed values: labels of a marketplace position
PREORDER, IN_STOCK, LIMITED, ORDERABLE, PICKUP, UNCLEAR = (
    "Предзаказ", "В наличии", "Ограниченное количество", "Доступен к заказу", "Доступен для самовывоза", "Наличие уточнить")


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _string(value: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(_get(value, path, "variant")) == "STRING", _get(value, path))


def _secure(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def flatten_positions(payloads: DataFrame) -> DataFrame:
    """Offers of marketplace payloads ``(product_title, product_url, payload)``: positions joined with their shops."""
    staged = payloads.withColumn("_v", F.try_parse_json("payload"))
    shops = _get(F.col("_v"), "$.shops", "map<string,variant>")
    rows = staged.select("product_title", "product_url", shops.alias("_shops"),
                         F.posexplode(_get(F.col("_v"), "$.positions.primary", "array<variant>")).alias("position", "_p"))
    p = F.col("_p")
    shop_id = _get(p, "$.shop_id")
    rows = rows.withColumn("_shop", F.try_element_at("_shops", shop_id))
    price = exact_price(_get(p, "$.position_price.amount"))
    quantity = F.when(F.schema_of_variant(_get(p, "$.prime_info.quantity_left", "variant")) == "BIGINT", _get(p, "$.prime_info.quantity_left", "bigint"))
    term = F.nullif(_get(p, "$.shipping.term"), F.lit(""))
    code = _get(p, "$.stock_status.code")
    pickup = F.coalesce(F.size(_get(p, "$.delivery.pickup_point.items", "array<variant>")) > 0, F.lit(False))
    label = (F.when(_get(p, "$.shipping.preorder", "boolean"), PREORDER)
             .when(quantity > 0, F.concat(F.lit("В наличии: "), quantity.cast("string"), F.lit(" шт.")))
             .when(code == "in_stock", IN_STOCK).when(code == "run_out_of_stock", LIMITED).when(term.isNotNull(), ORDERABLE)
             .when(pickup, PICKUP).otherwise(UNCLEAR))
    updated = _string(p, "$.date_update")
    moment = F.regexp_replace(updated, r"([+-]\d{2}:?\d{2}|Z)$", "").try_cast("timestamp")
    staged = rows.withColumns({"price": price, "availability_text": label, "_shop_id": shop_id}).filter("price IS NOT NULL")
    return staged.select(
        F.col("product_title").alias("title"), "price", F.lit("BYN").alias("currency"), (F.col("availability_text") != PREORDER).alias("available"),
        _secure(F.coalesce(_string(F.col("_shop"), "$.html_url"), F.concat(F.regexp_replace("product_url", "/+$", ""), F.lit("/prices")))).alias("url"),
        F.coalesce(_string(F.col("_shop"), "$.title"), F.concat(F.lit("Магазин #"), "_shop_id")).alias("seller"), "availability_text",
        term.alias("delivery_text"), F.coalesce(display_time(moment), updated).alias("updated_at"), "position")


def parse_candidates(payloads: DataFrame, host: str) -> DataFrame:
    """Cards of search payloads ``(request_id, payload)`` on the expected host, with their place in the answer."""
    rows = payloads.select("request_id", F.posexplode(_get(F.try_parse_json("payload"), "$.products", "array<variant>")).alias("rank", "_p"))
    p = F.col("_p")
    url = _string(p, "$.html_url")
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda x: x != "")
    from_url = F.when(F.size(parts) >= 3, F.element_at(parts, -1))
    given = F.nullif(_get(p, "$.key"), F.lit(""))
    title = F.when(F.coalesce(_get(p, "$.full_name"), F.lit("")) != "", _string(p, "$.full_name")).otherwise(_string(p, "$.name"))
    staged = rows.select("request_id", "rank", F.when(given.isNotNull(), _string(p, "$.key")).otherwise(from_url).alias("key"),
                         F.trim(title).alias("title"), _secure(url).alias("url"), _string(p, "$.schema.key").alias("category"))
    return staged.filter(F.col("key").isNotNull() & F.col("title").isNotNull() & (F.length("key") <= 50)
                         & (F.lower(F.try_parse_url("url", F.lit("HOST"))) == host))


def parse_site_search(payloads: DataFrame, site: str) -> DataFrame:
    """Cards of a site-search payload whose links stay under ``/products/``."""
    rows = payloads.select("request_id", F.posexplode(_get(F.try_parse_json("payload"), "$.products", "array<variant>")).alias("rank", "_p"))
    p = F.col("_p")
    staged = rows.select("request_id", "rank", _string(p, "$.id").alias("key"), F.trim(_string(p, "$.name")).alias("title"), _string(p, "$.link_url").alias("_link"))
    return staged.filter((F.trim("key") != "") & (F.col("title") != "") & F.col("_link").startswith("/products/")).select(
        "request_id", "rank", "key", "title", F.concat(F.lit(site.rstrip("/")), F.regexp_replace("_link", "/+$", "")).alias("url"))


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Locations of the urlset files under a path; namespaces do not matter."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path).select(F.trim("loc").alias("loc")).filter("loc <> ''")


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """Locations of child sitemaps."""
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path).select(F.trim("loc").alias("loc")).filter("loc <> ''")


def build_card_index(locations: DataFrame, site: str, loc: str = "loc") -> DataFrame:
    """Cards ``(key, title, url)`` of the product pages among the locations, each once."""
    host = site.split("//")[-1].strip("/")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(loc, F.lit("PATH")), F.lit("")), "/+$", "")
    own = F.regexp_replace(F.lower(F.try_parse_url(loc, F.lit("HOST"))), r"^www\.", "") == host
    urls = locations.filter(own & path.rlike("^/+products/+[^/]+$")).select(F.concat(F.lit(f"https://{host}"), path).alias("url")).distinct()
    titled = urls.select(F.substring(F.sha1(F.encode("url", "UTF-8")), 1, 12).alias("key"), slug_title(F.regexp_extract("url", "([^/]+)$", 1)).alias("title"), "url")
    return titled.filter("title <> ''")
