"""No caps: long chains, deep values, long numbers, many files, streams beside other writers."""

import json

from pyspark.sql import functions as F

from shelfline.functions.text import natural_key, parse_price
from shelfline.functions.variants import display_title
from shelfline.operators import reviews, validation
from shelfline.plans.import_feed import import_feed
from shelfline.sources import feeds, store
from shelfline.sources.pages import exact_price, product_in, shop_price
from shelfline.streaming.jobs import stream_feed_ingest
from tests.test_feeds import now, record, write


def test_prices_keep_their_digits(spark):
    row = spark.createDataFrame([("12.34567", "999999999999999.5")], "a string, b string").select(
        *[fn(F.col(c)).alias(f"{fn.__name__}_{c}") for fn in (parse_price, shop_price, exact_price) for c in "ab"]).first()
    assert list(row) == [12.34567, 999999999999999.5] * 3


def test_natural_key_of_long_numbers(spark):
    titles = ["item 9", "item 10", "item 010", "item " + "9" * 50, "item 1" + "0" * 50]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").orderBy(natural_key(F.col("t")), "t").collect()
    assert [r.t for r in rows] == [titles[0], titles[2], titles[1], titles[3], titles[4]]


def test_prefixes_are_stripped_to_the_last(spark):
    title = "смартфон смартфон смартфон смартфон смартфон Acme Phone 5"
    one, many = spark.createDataFrame([("смартфон Acme Phone 5", title)], "a string, b string").select(display_title(F.col("a")), display_title(F.col("b"))).first()
    assert one == many


def test_deep_product_graphs():
    value = {"@type": "Product", "name": "deep"}
    for level in range(5000):
        value = {"@graph": [value]} if level % 2 else [value]
    assert product_in(value)["name"] == "deep"


def test_long_chain_of_decisions(spark):
    keys = [f"p{i:02d}" for i in range(14)]
    moves = spark.createDataFrame([(keys[i], keys[i + 1], i) for i in range(13)], "product_key string, candidate_key string, position int")
    assert reviews.effective_moves(moves).count() == 13
    targets = reviews.resolve_targets(moves).collect()
    assert len(targets) == 13 and {r.candidate_key for r in targets} == {keys[-1]}


def test_records_of_several_files_are_told_apart(spark, tmp_path):
    for name in ("a", "b"):
        write(tmp_path / f"{name}.jsonl", "\n".join(map(json.dumps, [record(price="bad"), record()])))
    checked = validation.validate_records(feeds.record_fields(feeds.read_feed(spark, str(tmp_path), "jsonl")), now())
    summary = validation.feed_summary(checked).first()
    assert (summary.total_records, summary.valid_records, summary.invalid_records) == (4, 2, 2)
    assert validation.record_issues(checked).select("file", "record").distinct().count() == 2


def test_stream_into_a_catalog_that_others_write(spark, tmp_path):
    root, incoming = str(tmp_path / "catalog"), tmp_path / "in"
    incoming.mkdir()
    import_feed(spark, write(tmp_path / "first.json", json.dumps([record(source="First", external_id="1")])), root, now())
    write(incoming / "feed.jsonl", json.dumps(record(source="Second", external_id="2", title="Other Gadget 7")))
    for _ in range(2):
        stream_feed_ingest(spark, str(incoming), root, str(tmp_path / "checkpoint"), now).awaitTermination()
    _, offers = store.load_catalog(spark, root)
    assert store.catalog_versions(spark, root) == [1, 2]
    assert sorted(r.source for r in offers.collect()) == ["First", "Second"]
