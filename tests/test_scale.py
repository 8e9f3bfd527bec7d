"""Steps that have to stay small: the catalog view, snapshots on disk, the card index."""

import os
import re
from datetime import datetime

from pyspark.sql import functions as F

from __spark_entry__ import queries
from shelfline import bindings as b
from shelfline.operators import alerts, search
from shelfline.registry import catalogs
from shelfline.sources import store


def tables(spark, folder):
    """Lines of two products before and after 2001; a card and a supplier come twice, names and keys are missing."""
    day = lambda year, n: datetime(year, 1, 1 + n)
    lines = [(order, part, supplier, 1 + order % 3, float(1 + order), 900.0 * (1 + order), "ANR"[order % 3], "FO"[order % 2], day(2000 + order % 2, order % 20))
             for order in range(30) for part in (1, 2, 7) for supplier in (1, 2, 3)] + [(1, None, 1, 1, 1.0, 5.0, "A", "O", day(2000, 1)), (1, 1, None, 1, 1.0, 5.0, "A", "O", day(2000, 1))]
    spark.createDataFrame(lines + lines[:5], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, "
                          "l_shipdate timestamp_ntz").write.parquet(f"{folder}/lineitem.parquet")
    cards = [(1, "hot bolt", "Brand#1", "ECONOMY", 12, 900.0), (2, "red ring", None, "LARGE", None, 900.0), (1, "hot bolt", "Brand#1", "ECONOMY", 12, 900.0)]
    spark.createDataFrame(cards, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(1, "Shop A", 1, 1.0), (2, None, 1, 1.0), (3, "Shop A", 1, 1.0), (3, "Shop A", 1, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(
        f"{folder}/supplier.parquet")
    return str(folder)


def test_catalog_view_narrow(spark, tmp_path):
    """The catalog's rows are those of the text that SQL reads, and no title or address is shuffled before the newest line of a key is known."""
    folder = tables(spark, tmp_path)
    shown, told = b.view(spark, folder, "v_catalog_offers"), b.from_sql(spark, folder, b.VIEWS["v_catalog_offers"])
    assert shown.columns == told.columns and dict(shown.dtypes) == dict(told.dtypes)
    assert sorted(map(str, shown.collect())) == sorted(map(str, told.collect())) and shown.count() == 4
    chosen = shown._jdf.queryExecution().optimizedPlan().toString().split("Window ")[1].split("Scan ")[0].split("Relation ")[0]
    assert "RepartitionByExpression" in chosen and "example/p/" not in chosen and "title" not in chosen


def test_snapshot_is_compressed(spark, tmp_path):
    folder = tables(spark, tmp_path / "tables")
    offers, cards = b.view(spark, folder, "v_catalog_offers"), b.view(spark, folder, "v_catalog_products")
    store.export_catalog_json(cards, offers, str(tmp_path / "json"))
    parts = [f for f in os.listdir(tmp_path / "json") if f.startswith("part-")]
    assert parts and all(f.endswith(".json.gz") for f in parts)
    read_cards, read_offers = store.import_catalog_json(spark, str(tmp_path / "json"), cards.schema, offers.schema)
    same = lambda x, y: sorted(map(str, x.select(*y.columns).collect())) == sorted(map(str, y.collect()))
    assert same(read_cards, cards) and same(read_offers, offers)


def test_snapshot_shuffles_lines_once(spark, tmp_path):
    """Products and nested offers share one shuffle of narrow lines; rows are those of the catalog, also for keys that come twice or are missing."""
    folder = tables(spark, tmp_path / "tables")
    cards, offers = catalogs.by_product(spark, folder)
    told = b.from_sql(spark, folder, b.VIEWS["v_catalog_offers"])
    same = lambda x, y: sorted(map(str, x.select(*y.columns).collect())) == sorted(map(str, y.collect()))
    assert offers.columns == told.columns and dict(offers.dtypes) == dict(told.dtypes) and same(offers, told) and same(cards, b.view(spark, folder, "v_catalog_products"))
    loose = told.unionByName(told.limit(1).withColumn("product_key", F.lit(None).cast("string")))
    nested = store.nest_catalog(cards, loose, per_line=1)
    assert same(nested.select("product_key", F.inline("offers")), told) and nested.groupBy("product_key").agg(F.countDistinct("part").alias("n")).filter("n > 1").count() > 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = store.nest_catalog(cards, offers)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall("- Exchange .*REPARTITION_BY_COL", plan)) == 1 and plan.count("ReusedExchange") >= 1


def test_toggles_are_not_shuffled_again(spark, tmp_path):
    """Subscriptions and toggles stay where their product is; keys that come twice or are missing count as they did."""
    folder = tables(spark, tmp_path)
    spark.createDataFrame([(n, None if n == 3 else n % 4, "O", 1.0) for n in [*range(30), 4]], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    for name in ("v_subscriptions", "v_toggles"):
        shown, told = b.view(spark, folder, name), b.from_sql(spark, folder, b.VIEWS[name])
        assert shown.columns == told.columns and dict(shown.dtypes) == dict(told.dtypes) and told.count() > 0
        assert sorted(map(str, shown.collect())) == sorted(map(str, told.collect()))
    plan = queries()["toggle_alerts"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(product_key") >= 2 and "Exchange hashpartitioning(chat_id" not in plan


def test_toggled_states(spark):
    at = datetime(2001, 1, 1)
    state = spark.createDataFrame([(1, "a", "t", "q", 5.0, "BYN", True, at, at), (1, "a", "t2", "q", 6.0, "BYN", False, at, at), (None, "a", "t", "q", 7.0, "BYN", True, at, at),
                                   (2, "b", "t", "q", 8.0, "BYN", True, at, at)],
                                  "chat_id long, product_key string, title string, query string, last_notified_price double, currency string, active boolean, created_at timestamp_ntz, checked_at timestamp_ntz")
    turns = spark.createDataFrame([(1, "a", "x1", "q", 1.0, "BYN", "p1"), (1, "a", "x2", "q", 2.0, "BYN", "p2"), (1, "a", "x3", "q", 3.0, "BYN", "p3"), (1, "a", "no", "q", -1.0, "BYN", "p9"),
                                   (3, "c", "y", "q", 4.0, "BYN", "p1"), (None, "a", "z", "q", 4.0, "BYN", "p1"), (4, None, "z", "q", 4.0, "BYN", "p1")],
                                  "chat_id long, product_key string, title string, query string, price double, currency string, position string")
    rows = alerts.toggle_alerts(state, turns, F.lit(datetime(2002, 1, 1)).cast("timestamp_ntz")).select("chat_id", "product_key", "title", "last_notified_price", "active", F.col("checked_at").isNull()).collect()
    # three valid toggles: off by the last one where it was on, on by it where it was off; a toggle without a key is none
    assert sorted(map(tuple, rows), key=str) == sorted([(1, "a", "x2", 2.0, False, True), (1, "a", "x3", 3.0, True, True), (None, "a", "t", 7.0, True, False),
                                                        (2, "b", "t", 8.0, True, False), (3, "c", "y", 4.0, True, True)], key=str)


def test_card_index_is_not_broadcast(spark):
    """Neither the fragments of all cards nor the cards go to every executor, however small Spark takes them for."""
    cards = spark.range(200).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("Phone "), F.col("id") % 7, F.lit(" blue ring")).alias("title"), F.lit("https://c.example/p").alias("url"))
    asked = spark.createDataFrame([("a", "phone 3"), ("b", "blue")], "request_id string, query string")
    ranked = search.rank_card_index(asked, cards)
    assert ranked.groupBy("request_id").count().orderBy("request_id").collect() == [("a", 5), ("b", 5)]
    assert {r.title for r in ranked.filter("request_id = 'a'").collect()} == {"Phone 3 blue ring"}
    assert ranked._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") >= 2
