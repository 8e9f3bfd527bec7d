"""Steps that several queries share and that must not gather their rows in one task or repeat their work."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from shelfline.functions import features
from shelfline.operators import matching
from shelfline.plans.import_feed import update_catalog
from shelfline.registry import catalogs
from tests.test_matching import frame, run, walk
from tests.test_scale import tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_meet_answers_by_identity(spark):
    """Items without a code and items of one text are not brought together by the code or text that they share."""
    items = frame(spark, [(f"n{i}", {"mpn": f"m{i % 7}" if i % 2 else None}) for i in range(60)])
    placed = matching.match_identities(items, frame(spark, []))
    joins = [line for line in plan(placed).splitlines() if "Join" in line]
    assert len(joins) == 1 and "_u#" in joins[0] and "_s#" not in joins[0] and "_k#" not in joins[0]
    # an item with a code joins the first of its code, one without opens a product
    assert placed.filter("action = 'merged'").count() == 30 - 7


def test_lines_are_read_once_for_identifiers(spark, tmp_path):
    """The answer comes from stored rows, the lines are not worked out again for it; ids are bytes, not text."""
    placed = queries()["match_by_identifier"](spark, tables(spark, tmp_path))
    assert not any("lineitem" in f for f in placed.inputFiles())
    rows = placed.orderBy("source").collect()
    # product 1 alone has a code; both sources that have a name or none meet in the first of them
    assert [r.action for r in rows].count("created") == 1 and len({r.product_position for r in rows}) == 1 and {r.external_id for r in rows} == {"1"}
    assert all(len(r[0]) == 16 for r in matching.identity_keys(frame(spark, [("n", {"mpn": "m"})])).select("_u").collect())


def test_later_copy_opens_its_own_product(spark):
    """A second item of a text meets a doubtful product that the first one did not meet, and that scores higher."""
    known = {"brand": "abcdefg", "model": "zen 5"}
    near = {"brand": "abcdefx", "model": "zen 5"}
    existing, items = [("p", known)], [("n0", known), ("n1", near), ("n2", known), ("n3", known), ("n4", near)]
    expected = walk(existing, items)
    assert [e[0] for e in expected[:3]] == ["merged", "created", "created"]
    assert run(spark, existing, items) == expected


def test_identity_once_per_title(spark):
    """The same title is read once; distinct ones are spread however few files they come from."""
    rows = [("Apple iPhone 17 256GB", "Apple"), ("Apple iPhone 17 256GB", None), (None, "x"), (None, None), ("Apple iPhone 17 256GB", "Apple"), ("null", "Samsung")]
    df = spark.createDataFrame(rows, "title string, maker string").coalesce(1)
    found = features.build_identity(df, "title", {"brand": F.col("maker")})
    assert "Repartition 8, true" in plan(found)
    assert found.columns == ["title", "maker", "identity"]
    got = sorted((str(r.title), str(r.maker), str(r.identity.brand)) for r in found.collect())
    assert got == sorted([("Apple iPhone 17 256GB", "Apple", "apple")] * 2 + [("Apple iPhone 17 256GB", "None", "apple"), ("None", "x", "x"), ("None", "None", "None"), ("null", "Samsung", "samsung")])


def test_update_reads_the_catalog_keys_once(spark):
    """The catalog's offers are searched for the batch's keys once; the actions read what was found."""
    identity = "struct<brand:string,model:string,memory:string,color:string,revision:string,ean:string,mpn:string>"
    offer = ("s", "1", "p1", "000", "S", "T", None)
    columns = f"source_key string, external_id string, product_key string, position string, source string, title string, identity {identity}"
    offers = spark.createDataFrame([offer, ("s", "9", "p9", "001", "S", "U", None)], columns)
    marked = offers.filter(F.col("title") != "catalog-mark")
    products = spark.createDataFrame([], f"product_key string, title string, identity {identity}, position string")
    items = spark.createDataFrame([("100", "S", "1", "T", ("a", "b", None, None, None, None, None)), ("101", "S", "2", "T", ("a", "b", None, None, None, None, None))],
                                  f"position string, source string, external_id string, title string, identity {identity}")
    actions = update_catalog(products, marked, items, F.lit(None)).actions
    assert "catalog-mark" not in plan(actions)
    assert sorted((r.external_id, r.action, r.product_key == "p1") for r in actions.collect()) == [("1", "updated", True), ("2", "created", False)]


def test_reviews_read_the_catalog_once(spark, tmp_path):
    folder = tables(spark, tmp_path)
    after = catalogs.registry.queries["accept_reviews"](spark, folder)
    assert "lineitem" not in after._jdf.queryExecution().executedPlan().toString() and "Window" not in plan(after)
    assert after.count() == 4
