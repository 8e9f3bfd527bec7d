"""Feed reading, validation and import over the test tables."""

import uuid

from pyspark.sql import functions as F

from shelfline import bindings as b
from shelfline.functions import text
from shelfline.operators import filters, validation
from shelfline.plans import import_feed
from shelfline.registry.base import Registry
from shelfline.session import shared_dir
from shelfline.sources import feeds, store

registry = Registry()
query = registry.query
FEED = ("v_feed",)

ISSUES = """issues AS (
  SELECT record, 'source' AS field, 'source is required' AS message FROM v_feed WHERE source IS NULL
  UNION ALL SELECT record, 'url', 'absolute http(s) URL is required' FROM v_feed WHERE NOT regexp_matches(url, '^https?://[^/]+')
  UNION ALL SELECT record, 'price', 'price must be numeric' FROM v_feed WHERE price = 'n/a'
  UNION ALL SELECT record, 'price', 'price must be non-negative' FROM v_feed WHERE price LIKE '-%'
  UNION ALL SELECT record, 'available', 'available must be boolean' FROM v_feed WHERE available = 'maybe'
  UNION ALL SELECT record, 'updated_at', 'updated_at must be ISO-8601' FROM v_feed WHERE updated_at = 'yesterday')"""


def raw_feed(spark, sf):
    return b.view(spark, sf, "v_feed")


def validated(spark, sf):
    return validation.validate_records(raw_feed(spark, sf), b.now())


@query("validate_records", f"WITH {ISSUES} SELECT * FROM issues", FEED)
def _(spark, sf):
    return validation.record_issues(validated(spark, sf)).select("record", "field", "message")


@query("valid_records", f"""
WITH {ISSUES} SELECT record, source, substr(sha256(lower(trim(url))), 1, 24) AS external_id, title, url,
  CAST(replace(price, ',', '.') AS DOUBLE) AS price, 'BYN' AS currency, available IN ('true', 'yes', 'in_stock') AS available,
  CAST('2024-01-15 10:00:00' AS TIMESTAMP) AS updated_at
FROM v_feed WHERE record NOT IN (SELECT record FROM issues)""", FEED)
def _(spark, sf):
    good = validated(spark, sf).filter(F.size("issues") == 0).drop("issues")
    return good.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("feed_summary", f"""
WITH {ISSUES} SELECT (SELECT count(*) FROM v_feed) AS total_records,
  (SELECT count(*) FROM v_feed WHERE record NOT IN (SELECT record FROM issues)) AS valid_records, count(DISTINCT record) AS invalid_records,
  (SELECT count(DISTINCT lower(source)) FROM v_feed WHERE record NOT IN (SELECT record FROM issues)) AS sources,
  (SELECT min(lower(source)) FROM v_feed WHERE record NOT IN (SELECT record FROM issues)) AS snapshot_source FROM issues""", FEED)
def _(spark, sf):
    return validation.feed_summary(validated(spark, sf))


DECISION = """(SELECT count(*) FROM v_feed) AS total_records, (SELECT count(*) FROM v_feed WHERE record NOT IN (SELECT record FROM issues)) AS valid_records,
  count(DISTINCT record) AS invalid_records, (SELECT min(lower(source)) FROM v_feed WHERE record NOT IN (SELECT record FROM issues)) AS snapshot_source"""


@query("reject_or_partial", f"""
WITH {ISSUES} SELECT {DECISION}, NULL AS batch_issue, true AS rejected, 'rejected' AS status FROM issues
UNION ALL SELECT {DECISION}, NULL, false, 'imported' FROM issues
UNION ALL SELECT {DECISION}, 'snapshot must contain exactly one source', true, 'dry_run' FROM issues""", FEED)
def _(spark, sf):
    summary = validation.feed_summary(validated(spark, sf))
    return (validation.decide(summary).unionByName(validation.decide(summary, allow_partial=True))
            .unionByName(validation.decide(summary, snapshot=True, dry_run=True)))


#: Records per written file.
PART = 2000
PARTS = f"""rows AS (
  SELECT *, (record - 1) // {PART} AS part, record - (record - 1) // {PART} * {PART} AS place FROM v_feed
), lines AS (
  SELECT *, place + count(*) FILTER (source IS NULL) OVER (PARTITION BY part ORDER BY record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line FROM rows)"""
FIELDS = "source, title, url, price, available, updated_at"
LINE_ROWS = f"""SELECT part, line AS record, {FIELDS}, NULL AS field, NULL AS message FROM lines {{only}}
UNION ALL SELECT part, line + 1, NULL, NULL, NULL, NULL, NULL, NULL, 'json', 'Expecting value' FROM lines WHERE source IS NULL {{also}}"""
DOCUMENT_ROWS = f"""SELECT part, place AS record, {FIELDS}, NULL AS field, NULL AS message FROM rows {{only}}
UNION ALL SELECT part, max(place) + 1, NULL, NULL, NULL, NULL, NULL, NULL, 'record', 'record must be an object' FROM rows {{only}} GROUP BY part"""


def written_feed(spark, sf, kind):
    """The feed as many files: JSON lines, JSON documents, or (auto) one after the other of both."""
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    record = F.to_json(F.struct("source", "title", "url", "price", "available", "updated_at"))
    rows = raw_feed(spark, sf).select(F.floor((F.col("record") - 1) / PART).alias("part"), F.col("record").alias("at"), "source", record.alias("value"))
    document = {"jsonl": F.lit(False), "json": F.lit(True)}.get(kind, F.col("part") % 2 == 0)
    # a broken line after every record of an unknown shop, a stray value at the end of every document
    broken = F.when(F.col("source").isNull(), F.array("value", F.lit('{"source": '))).otherwise(F.array("value"))
    lines = rows.filter(~document).select("part", "at", F.posexplode(broken).alias("n", "value"))
    items = rows.filter(document).select("part", "at", F.lit(0).alias("n"), F.concat("value", F.lit(",")).alias("value"))
    frame = rows.filter(document).select("part").distinct().select("part", F.inline(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(0).alias("n"), F.lit('{"items": [').alias("value")),
        F.struct(F.lit(2**62).alias("at"), F.lit(0).alias("n"), F.lit('"stray"]}').alias("value")))))
    written = lines.unionByName(items).unionByName(frame)
    written.repartition("part").sortWithinPartitions("part", "at", "n").select("part", "value").write.partitionBy("part").text(path)
    return path


def read_back(spark, sf, kind):
    """Every record and issue with the file it comes from."""
    records = feeds.read_feed(spark, written_feed(spark, sf, kind), kind)
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("part")
    none = [F.lit(None).cast("string").alias(c) for c in FIELDS.split(", ")]
    good = feeds.record_fields(records).select(part, "record", *FIELDS.split(", "), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("message"))
    return good.unionByName(records.filter("raw IS NULL").select(part, "record", *none, "field", "message"))


@query("read_feed_jsonl", f"WITH {PARTS} " + LINE_ROWS.format(only="", also=""), FEED)
def _(spark, sf):
    return read_back(spark, sf, "jsonl")


@query("read_feed_json", f"WITH {PARTS} " + DOCUMENT_ROWS.format(only=""), FEED)
def _(spark, sf):
    return read_back(spark, sf, "json")


@query("read_feed_auto", f"WITH {PARTS} " + LINE_ROWS.format(only="WHERE part % 2 = 1", also="AND part % 2 = 1") + " UNION ALL " + DOCUMENT_ROWS.format(only="WHERE part % 2 = 0"), FEED)
def _(spark, sf):
    return read_back(spark, sf, "auto")


GOOD = "FROM v_feed WHERE record NOT IN (SELECT record FROM issues)"
# the titles of one user and memory name one product; every record has an address, so an external id, of its own
COUNTED = f"""(SELECT count(*) FROM v_feed) + (SELECT count(*) FROM v_feed WHERE source IS NULL) AS total_records, (SELECT count(*) {GOOD}) AS valid_records,
  (SELECT count(DISTINCT record) FROM issues) + (SELECT count(*) FROM v_feed WHERE source IS NULL) AS invalid_records"""
ENTERED = f"""(SELECT count(DISTINCT title) {GOOD}) AS created_products, (SELECT count(*) - count(DISTINCT title) {GOOD}) AS merged_offers,
  0 AS updated_offers, 0 AS deactivated_offers"""


def imported(spark, path, root, **options):
    return import_feed.import_feed(spark, path, root, b.now().cast("timestamp"), format_hint="jsonl", **options)[0]


@query("import_feed", f"""
WITH {ISSUES} SELECT 'imported' AS status, false AS dry_run, {COUNTED}, {ENTERED}
UNION ALL SELECT 'imported', false, {COUNTED}, 0, 0, (SELECT count(*) {GOOD}), 0""", FEED)
def _(spark, sf):
    root, path = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}", written_feed(spark, sf, "jsonl")
    first = imported(spark, path, root, allow_partial=True)
    return first.unionByName(imported(spark, path, root, allow_partial=True))


@query("dry_run_import", f"""
WITH {ISSUES} SELECT 'dry_run' AS status, true AS dry_run, {COUNTED}, 0 AS created_products, 0 AS merged_offers, 0 AS updated_offers, 0 AS deactivated_offers
UNION ALL SELECT 'dry_run', true, {COUNTED}, {ENTERED}""", FEED)
def _(spark, sf):
    root, path = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}", written_feed(spark, sf, "jsonl")
    report = imported(spark, path, root, dry_run=True).unionByName(imported(spark, path, root, dry_run=True, allow_partial=True))
    assert store.load_catalog(spark, root) is None
    return report


@query("write_import_report", f"""
WITH {ISSUES}, written AS (SELECT field, message FROM issues UNION ALL SELECT 'json', 'Expecting value' FROM v_feed WHERE source IS NULL)
SELECT 'rejected' AS status, false AS dry_run, {COUNTED}, 0 AS created_products, field, message, count(*) AS issues FROM written GROUP BY field, message""", FEED)
def _(spark, sf):
    place = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    report, issues = import_feed.import_feed(spark, written_feed(spark, sf, "jsonl"), f"{place}/catalog", b.now().cast("timestamp"), format_hint="jsonl")
    store.write_import_report(report, issues, place)
    counted = spark.read.json(f"{place}/issues").groupBy("field", "message").agg(F.count(F.lit(1)).alias("issues"))
    return spark.read.json(f"{place}/report").join(counted).select(
        "status", "dry_run", "total_records", "valid_records", "invalid_records", "created_products", "field", "message", "issues")


@query("offer_to_item", """
SELECT position, substr(sha256(lower(trim(url))), 1, 24) AS external_id,
  substr(sha256(concat_ws('|', lower(trim(source)), lower(trim(title)), coalesce(lower(trim(seller)), ''))), 1, 24) AS fallback_id FROM v_offers""",
       ("v_offers",))
def _(spark, sf):
    offers = b.view(spark, sf, "v_offers")
    args = (F.col("source"), F.col("title"), F.col("seller"))
    return offers.select("position", text.external_id(F.col("url"), *args).alias("external_id"),
                         text.external_id(F.lit(" "), *args).alias("fallback_id"))


@query("parse_price", """
SELECT event_id, round(value, 2) AS price FROM events""")
def _(spark, sf):
    written = F.concat(F.format_string("%,.2f", F.col("value")), F.lit(" руб."))
    swapped = F.translate(F.translate(written, ",", " "), ".", ",")
    return b.table(spark, sf, "events").select("event_id", text.parse_price(swapped).alias("price"))


@query("parse_timestamp", """
SELECT event_id, date_trunc('second', ts) AS moment, strftime(ts, '%d.%m.%Y %H:%M') AS shown, date_trunc('second', ts) AS basic, date_trunc('day', ts) AS week_day
FROM events""")
def _(spark, sf):
    def ntz(x):
        return text.parse_timestamp(x).cast("timestamp_ntz")

    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    week = F.format_string("%d-W%02d-%d", F.extract(F.lit("YEAROFWEEK"), "ts"), F.extract(F.lit("WEEK"), "ts"), F.extract(F.lit("DAYOFWEEK_ISO"), "ts"))
    return b.table(spark, sf, "events").select("event_id", ntz(iso).alias("moment"), text.display_time(text.parse_timestamp(iso)).alias("shown"),
                                               ntz(F.date_format("ts", "yyyyMMdd'T'HHmmss'+0000'")).alias("basic"), ntz(week).alias("week_day"))


@query("normalize_queries", """
WITH q AS (SELECT request_id, query, trim(regexp_replace(nfc_normalize(query), '\\s+', ' ', 'g')) AS normalized FROM v_requests)
SELECT request_id, normalized, CASE WHEN length(normalized) < 3 THEN 'too_short' WHEN length(normalized) > 200 THEN 'too_long' END AS reason FROM q""",
       ("v_requests",))
def _(spark, sf):
    return filters.normalize_queries(b.view(spark, sf, "v_requests")).select("request_id", "normalized", "reason")


@query("is_broad_query", """
SELECT request_id, query, len(regexp_extract_all(lower(query), '[a-z0-9]+')) BETWEEN 1 AND 2 AND NOT regexp_matches(query, '[0-9]') AS broad
FROM v_model_requests""", ("v_model_requests",))
def _(spark, sf):
    return b.view(spark, sf, "v_model_requests").withColumn("broad", filters.is_broad_query(F.col("query")))


@query("distinct_seeds", """
SELECT query, min(part) AS part FROM (SELECT query, 0 AS part FROM v_model_requests UNION ALL SELECT p_name, 1 FROM part
UNION ALL SELECT p_type, 1 FROM part) GROUP BY query""", ("v_model_requests",))
def _(spark, sf):
    seeds = b.view(spark, sf, "v_model_requests").select("query", F.col("request_id").alias("position"))
    asked = b.from_sql(spark, sf, "SELECT p_name AS query, concat('', p_partkey) AS position FROM {part} UNION ALL SELECT p_type, concat('', p_partkey) FROM {part}")
    return filters.distinct_seeds(seeds, asked).select("query", "part")
