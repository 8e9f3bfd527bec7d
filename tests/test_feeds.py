"""Feeds from text to catalog: reading, validation, import, snapshot, reviews."""

import json

import pytest
from pyspark.sql import functions as F

from shelfline.operators import alerts, catalog, filters, history, pricing, reviews, validation
from shelfline.plans.import_feed import import_feed
from shelfline.sources import feeds, store

NOW = "2026-07-20 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def record(**fields):
    base = {"source": "Shop", "title": "Acme Widget 5", "url": "https://shop.example/w", "price": "10,50", "available": True,
            "updated_at": "2026-07-20T10:00:00Z"}
    return {**base, **fields}


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def issues_of(spark, tmp_path, value):
    records = feeds.read_feed(spark, write(tmp_path / "f.json", json.dumps(value)), "json")
    checked = validation.validate_records(feeds.record_fields(records), now())
    return [(r["record"], r["field"]) for r in validation.record_issues(checked).orderBy("record", "field").collect()]


def test_all_issues_of_a_record(spark, tmp_path):
    bad = record(url="/relative", price={"amount": 1}, available="maybe", updated_at=["x"])
    assert issues_of(spark, tmp_path, [record(), bad]) == [(2, "available"), (2, "price"), (2, "updated_at"), (2, "url")]


@pytest.mark.parametrize("fields,expected", [
    ({"price": True}, ["price"]), ({"price": -1}, ["price"]), ({"price": "NaN"}, ["price"]), ({"price": ""}, []), ({"price": None}, []),
    ({"available": None}, ["available"]), ({"available": 0}, []), ({"source": " "}, ["source"]), ({"title": {"a": 1}}, ["title"]),
])
def test_single_issue(spark, tmp_path, fields, expected):
    assert [f for _, f in issues_of(spark, tmp_path, {"items": [record(**fields)]})] == expected


def test_lines_keep_their_numbers(spark, tmp_path):
    text = "\n".join([json.dumps(record()), "", '{"broken": ', '"text"', json.dumps(record()) + " trailing"])
    rows = feeds.read_feed(spark, write(tmp_path / "f.jsonl", text)).orderBy("record").collect()
    assert [(r["record"], r["field"]) for r in rows] == [(1, None), (3, "json"), (4, "record"), (5, "json")]


def test_import_twice_then_snapshot(spark, tmp_path):
    root = str(tmp_path / "catalog")
    two = [record(source="A", external_id="1", ean="4600000000017"), record(source="B", external_id="9", ean="4600000000017", title="Acme Widget Five")]
    path = write(tmp_path / "two.json", json.dumps(two))

    def counts(**options):
        row = import_feed(spark, options.pop("path", path), root, now(), **options)[0].first()
        return row["status"], row["created_products"], row["merged_offers"], row["updated_offers"], row["deactivated_offers"]

    assert counts(dry_run=True) == ("dry_run", 1, 1, 0, 0)
    assert store.load_catalog(spark, root) is None
    assert counts() == ("imported", 1, 1, 0, 0)
    assert counts() == ("imported", 0, 0, 2, 0)
    one = write(tmp_path / "one.json", json.dumps([record(source="a", external_id="2", ean="4600000000024", title="Other Thing 7")]))
    assert counts(path=one, snapshot=True) == ("imported", 1, 0, 0, 1)
    offers = {(r["source_key"], r["external_id"]): r["available"] for r in store.load_catalog(spark, root)[1].collect()}
    assert offers == {("a", "1"): False, ("b", "9"): True, ("a", "2"): True}
    assert store.catalog_versions(spark, root) == [1, 2, 3]


def test_partial_import(spark, tmp_path):
    path = write(tmp_path / "f.jsonl", json.dumps(record()) + "\n{broken")
    report, issues = import_feed(spark, path, str(tmp_path / "c"), now())
    assert report.first()["status"] == "rejected" and issues.count() == 1
    report, _ = import_feed(spark, path, str(tmp_path / "c"), now(), allow_partial=True)
    assert (report.first()["status"], report.first()["valid_records"], report.first()["invalid_records"]) == ("imported", 1, 1)
    assert len(store.load_catalog(spark, str(tmp_path / "c"))[1].first()["external_id"]) == 24
    with pytest.raises(ValueError):
        import_feed(spark, path, str(tmp_path / "c"), now(), allow_partial=True, snapshot=True)


def offers(spark, rows, schema="product_key string, source string, price double"):
    df = spark.createDataFrame(rows, schema)
    extra = {"seller": "string", "title": "string", "url": "string", "currency": "string", "position": "string"}
    for name, kind in extra.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit({"currency": "BYN", "title": "thing", "url": "u", "position": "1"}.get(name)).cast(kind))
    return df if "available" in df.columns else df.withColumn("available", F.lit(True))


def test_outliers(spark):
    rows = [("p", "a", 25.0), ("p", "b", 5200.0), ("p", "c", 5400.0), ("q", "a", 1.0), ("q", "a", 100.0), ("r", "a", float("nan")), ("r", "b", -1.0)]
    kept = pricing.filter_price_outliers(offers(spark, rows)).collect()
    assert sorted((r["product_key"], r["price"]) for r in kept) == [("p", 5200.0), ("p", 5400.0), ("q", 1.0), ("q", 100.0)]


@pytest.mark.parametrize("title,price,currency,context,expected", [
    ("washer", 25.0, "BYN", None, False), ("washer", 1799.0, "BYN", None, True), ("cable", 25.0, "BYN", None, True),
    ("Apple iPhone 17", 299.0, "руб", None, False), ("cable", 55.0, "BYN", "Платёж в месяц", False), ("Apple iPhone 17", 25.0, "USD", None, True),
])
def test_plausible_price(spark, title, price, currency, context, expected):
    df = spark.createDataFrame([(title, price, currency, context)], "t string, p double, c string, x string")
    assert df.select(pricing.plausible_price(F.col("t"), F.col("p"), F.col("c"), F.col("x")).alias("ok")).first()["ok"] is expected


def test_history_minimum(spark):
    rows = [("p", "a", 3900.0, "10:00", 1), ("p", "b", 3600.0, "10:00", 2), ("p", "c", 3500.0, "12:00", 3)]
    df = offers(spark, rows, "product_key string, source string, price double, observed_at string, id int")
    assert [(r["price"], r["source"]) for r in history.price_history(df).orderBy("place").collect()] == [(3500.0, "c"), (3600.0, "b")]
    assert history.price_history(df, limit=-5).count() == 1


def test_alert_fires_once_and_respects_currency(spark):
    subs = spark.createDataFrame([(1, "p", 1000.0, "BYN", True)], "chat_id int, product_key string, last_notified_price double, currency string, active boolean")
    other = [("p", "a", 300.0, "USD", True), ("p", "a", float("nan"), "BYN", True), ("p", "a", -1.0, "BYN", True), ("p", "a", 100.0, "BYN", False), ("p", "a", 1100.0, "BYN", True)]
    schema = "product_key string, source string, price double, currency string, available boolean"
    assert not alerts.evaluate_alerts(subs, offers(spark, other, schema), now()).first()["fired"]
    low = alerts.evaluate_alerts(subs, offers(spark, [("p", "a", 990.0, "byn", True)], schema), now()).first()
    assert low["fired"] and low["new_baseline"] == 990.0


def test_toggles_in_order(spark):
    state = spark.createDataFrame([(1, "p", "t", "q", 10.0, "BYN", True, None, None)], "chat_id int, product_key string, title string, query string, "
                                  "last_notified_price double, currency string, active boolean, created_at timestamp, checked_at timestamp")
    toggles = spark.createDataFrame([(1, "p", "t", "q", 5.0, "BYN", "1"), (1, "p", "t", "q", 6.0, "BYN", "2"), (2, "p", "t", "q", 7.0, "BYN", "1"),
                                     (2, "p", "t", "q", float("inf"), "BYN", "2"), (3, "p", "t", "q", 8.0, "BYN", "1"), (3, "p", "t", "q", 9.0, "BYN", "2")],
                                    "chat_id int, product_key string, title string, query string, price double, currency string, position string")
    rows = {r["chat_id"]: (r["active"], r["last_notified_price"]) for r in alerts.toggle_alerts(state, toggles, now()).collect()}
    assert rows == {1: (True, 6.0), 2: (True, 7.0), 3: (False, 8.0)}


def test_review_decisions_follow_their_order(spark):
    products = spark.createDataFrame([(p,) for p in "abcd"], "product_key string")
    rows = [(p, c, "review", "r") for p, c in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"))]
    review = spark.createDataFrame(rows, "product_key string, match_candidate_key string, match_level string, match_reason string")
    decisions = spark.createDataFrame([("b", "c", 1), ("a", "b", 2), ("c", "d", 3), ("d", "a", 4), ("x", "a", 5)], "product_key string, candidate_key string, position int")
    left, after = reviews.accept_reviews(products, review, decisions)
    # a -> b comes too late because b is gone; d -> a is the last one standing
    assert sorted(r[0] for r in left.collect()) == ["a"]
    assert {r["product_key"] for r in after.collect()} == {"a"}


def test_query_normalisation(spark):
    df = spark.createDataFrame([("Ｇｏｏｇｌｅ​  Pixel\t8",), ("a",), ("!!!",), ("x" * 201,)], "query string")
    rows = [(r["normalized"], r["reason"]) for r in filters.normalize_queries(df).collect()]
    assert rows[0] == ("Google Pixel 8", None) and [r for _, r in rows[1:]] == ["too_short", "no_alphanumeric", "too_long"]


def test_metrics_of_a_small_catalog(spark):
    rows = [("p1", "Beta", "1", True, "2026-07-20 11:00:00", "exact"), ("p1", "alpha", "2", False, "2026-07-20 11:00:00", None), ("p2", "Gamma", "3", True, "2026-07-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "product_key string, source string, external_id string, available boolean, updated_at string, match_level string").withColumn("updated_at", F.to_timestamp("updated_at"))
    products = df.select("product_key").distinct()
    got = catalog.catalog_metrics(products, df, now()).first()
    assert (got["merged_offer_count"], got["multi_source_products"], got["single_source_products"], got["fresh_offers"], got["stale_offers"], got["unavailable_offers"]) == (1, 1, 1, 2, 1, 1)
    assert abs(got["duplicate_rate"] - 1 / 3) < 1e-9
    assert [r["source"] for r in catalog.source_offer_counts(df).collect()] == ["alpha", "Beta", "Gamma"]
