"""Decisions on pairs of titles, variant groups and search."""

from pyspark.sql import functions as F

from shelfline.functions import features
from shelfline.operators import candidates, compare, search, variants

WANTED = "Samsung Galaxy S25 12GB/256GB Navy"
REASONS = {
    "Samsung Galaxy S24 12GB/256GB Navy": "model_number", "Samsung Galaxy S25 12GB/128GB Navy": "memory",
    "Samsung Galaxy S25 Ultra 12GB/256GB Navy": "version", "Samsung Galaxy S25 12GB/256GB Black": "color",
    "Samsung Galaxy S25 12GB/256GB Navy refurbished": "condition", "Samsung Galaxy S25 12GB/256GB Navy + Watch": "bundle",
    "Смартфон SAMSUNG Galaxy S25 12GB/256GB (Navy)": None, "Xiaomi Galaxy S25 12GB/256GB Navy": "brand",
    "Samsung Galaxy S25 12GB/256GB": "color_unknown",
}
# core rules on full titles: wanted, candidate, requested
ACCEPTED = [
    ("Bosch Serie 4 HBA534EB3", "Электрический духовой шкаф Bosch HBA-534-EB3", "Bosch HBA534EB3"),
    ("DeLonghi Magnifica S ECAM 22.110.B", "Кофемашина DeLonghi MAGNIFICA S ECAM 22.110 B", "DeLonghi ECAM 22.110.B"),
    ("LG OLED C4 OLED55C4RLA", "Телевизор LG OLED55C4RLA OLED evo", "LG OLED55C4RLA"),
    ("Samsung Galaxy S24 Ultra SM-S928B 256GB", "Смартфон Samsung Galaxy S24 Ultra SM-S928BZKDEUC 12GB/256GB", "Samsung SM-S928B 256GB"),
]


def test_reasons(spark):
    pairs = spark.createDataFrame([(WANTED, t) for t in REASONS], "wanted_title string, title string")
    got = {r["title"]: r["reason"] for r in compare.judge_pairs(pairs).collect()}
    assert got == REASONS


def test_confirmation_needs_every_feature(spark):
    pairs = spark.createDataFrame([("Apple iPhone 17 256GB (черный)", t) for t in (
        "Apple iPhone 17 256GB (black)", "Apple iPhone 17 (black)", "Apple iPhone 17 256GB", "Чехол Apple iPhone 17 256GB (black)",
        "Apple iPhone 17 256GB (black) Dual SIM")], "wanted_title string, title string")
    assert {r["title"] for r in compare.judge_pairs(pairs).filter("confirmed").collect()} == {"Apple iPhone 17 256GB (black)"}


def test_core_accepts_spellings_of_codes(spark):
    df = spark.createDataFrame(ACCEPTED, "a string, b string, r string")
    for name in ("a", "b", "r"):
        df = features.compare_features(df, name, f"{name}_", reduce=False)
    rows = df.select("a", compare.core_reason(F.col("a_f"), F.col("b_f"), F.col("r_f")).alias("reason")).collect()
    assert {r["a"]: r["reason"] for r in rows} == {a: None for a, _, _ in ACCEPTED}


def cards(spark, titles):
    return spark.createDataFrame([(f"k{i}", t, f"{i:03d}") for i, t in enumerate(titles)], "key string, title string, position string")


def test_variant_groups(spark):
    four = ["Apple iPhone 17 128GB (черный)", "Apple iPhone 17 256GB (белый)", "Apple iPhone 17 Pro 256GB (черный)", "Apple iPhone 17 Pro 128GB (синий)"]
    df = cards(spark, four)
    assert sorted({r["group_title"] for r in variants.group_product_variants(df).collect()}) == ["Apple iPhone 17", "Apple iPhone 17 Pro"]
    grouped = variants.group_by_memory(df).select("group_key", "group_order").distinct().orderBy("group_order").collect()
    assert [r["group_key"] for r in grouped] == ["128GB", "256GB"]


def test_parenthesis_counts_as_colour_only_with_proof(spark):
    titles = ["Brand Kettle (Zorn)", "Brand Kettle (Plim)", "Brand Toaster (Solo)"]
    got = {r["title"]: r["group_title"] for r in variants.group_model_variants(cards(spark, titles)).collect()}
    assert got == {titles[0]: "Brand Kettle", titles[1]: "Brand Kettle", titles[2]: "Brand Toaster (Solo)"}


def test_store_codes_drop_only_with_siblings(spark):
    titles = ["Acme Mixer Pro ABC12345", "Acme Mixer Pro XYZ98765", "Acme Blender Max QWE55555"]
    got = {r["title"]: r["group_title"] for r in variants.group_display_models(cards(spark, titles)).collect()}
    assert got[titles[0]] == got[titles[1]] == "Acme Mixer Pro" and got[titles[2]] == "Acme Blender Max QWE55555"


def test_search_by_identifier(spark):
    identity = "struct<brand:string,model:string,memory:string,color:string,revision:string,ean:string,mpn:string>"
    products = spark.createDataFrame([
        ("pixel-8", "Google Pixel 8", ("google", "pixel 8", None, None, None, "0840244706821", "GA04834-US")),
        ("oven", "Bosch Oven HBA534EB3", ("bosch", "hba534eb3", None, None, None, None, None))], f"product_key string, title string, identity {identity}")
    offers = spark.createDataFrame([("oven", "YY-2954 oven kit")], "product_key string, title string")
    asked = {"1": "0840244706821", "2": "GA 04834 US", "3": "HBA-534-EB3", "4": "YY-2954", "5": "  ", "6": "oven bosch"}
    requests = spark.createDataFrame(list(asked.items()), "request_id string, query string")
    got = {r["request_id"]: (r["product_key"], r["score"]) for r in search.search_catalog(requests, products, offers, limit=1).collect()}
    assert got == {"1": ("pixel-8", 1000), "2": ("pixel-8", 1000), "3": ("oven", 950), "4": ("oven", 675), "6": ("oven", 700)}


def test_scopes_judge_like_listed_pairs(spark, monkeypatch):
    monkeypatch.setattr(compare, "SLICE", 2)
    titles = [(1, t) for t in [WANTED, *list(REASONS)[:4], None]] + [(2, WANTED), (None, WANTED)]
    rows = spark.createDataFrame(titles, "scope int, title string")
    asked = rows.withColumnRenamed("title", "wanted_title")
    listed = compare.judge_pairs(asked.filter("scope IS NOT NULL").join(rows, "scope"))
    scoped = compare.judge_scopes(asked, rows, ["scope"])
    found = [sorted(map(str, df.select("scope", "wanted_title", "title", "reason", "confirmed").collect())) for df in (listed, scoped)]
    assert len(found[0]) == 6 * 6 + 1 and found[0] == found[1]


def test_offers_stand_once_for_all_requests(spark):
    requests = spark.createDataFrame([("a", WANTED), ("b", WANTED), ("c", "Samsung Galaxy S24 12GB/256GB Navy")], "request_id string, wanted_title string")
    asked = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2)], "request_id string, brand int")
    offers = spark.createDataFrame([(1, WANTED, "s1", "k2"), (1, WANTED, "s1", "k1"), (2, "Samsung Galaxy S24 12GB/256GB Navy", "s1", "k3"), (2, WANTED, "s2", "k4")],
                                   "brand int, title string, source string, candidate_key string")
    offers = offers.withColumns({"available": F.lit(True), "price": F.lit(9.0), "currency": F.lit("USD"), "rank": F.col("candidate_key")})
    expanded = offers.join(asked, "brand")
    fields = ["request_id", "source", "candidate_key"]
    for operator in (compare.confirm_variant, compare.pick_reference_candidate):
        once = operator(requests, offers, asked=asked).select(*fields).collect()
        assert sorted(once) == sorted(operator(requests, expanded).select(*fields).collect())
    assert sorted(map(tuple, once)) == [("a", "s1", "k1"), ("b", "s1", "k1"), ("b", "s2", "k4"), ("c", "s1", "k3")]


def test_codes_and_variants_meet_in_scopes(spark, monkeypatch):
    monkeypatch.setattr(compare, "SLICE", 1)
    asked = spark.createDataFrame([(1, "Bosch HBA534EB3 64GB"), (1, "Bosch HBA534EB3 64GB Dual SIM"), (2, "LG OLED55C4RLA")], "scope int, wanted_title string")
    shown = spark.createDataFrame([(1, "Oven HBA534EB3 64GB eSIM only"), (1, "Oven 128GB"), (2, "LG OLED55C4RLA"), (3, "LG")], "scope int, title string")
    related = {(r["wanted_title"], r["title"]): (r["is_subset"], r["shared"]) for r in compare.code_relations(asked, shown, ["scope"]).collect()}
    assert len(related) == 5 and related["LG OLED55C4RLA", "LG OLED55C4RLA"] == (True, ["oled55c4rla"])
    assert related["Bosch HBA534EB3 64GB", "Oven 128GB"] == (False, [])
    reasons = {(r["wanted_title"], r["title"]): r["reason"] for r in compare.variant_reasons(asked, shown, ["scope"]).collect()}
    assert len(reasons) == 5 and reasons["Bosch HBA534EB3 64GB Dual SIM", "Oven HBA534EB3 64GB eSIM only"] == "sim"
    assert reasons["Bosch HBA534EB3 64GB", "Oven 128GB"] == "memory" and reasons["LG OLED55C4RLA", "LG OLED55C4RLA"] is None


def test_only_matching_texts_leave_the_search_joins(spark):
    values = spark.createDataFrame([(i, t, t.split(" ")) for i, t in enumerate(["case brand7 red ring", "case brand7 hot ring", "ring brand8 red case"])], "_id int, _t string, _words array<string>")
    asked = spark.createDataFrame([("a", "brand7 red", ["brand7", "red"]), ("b", "case", ["case", "ring"]), ("c", "none", ["none"])], "request_id string, q string, words array<string>")
    contained = candidates.containing_pairs(asked, "request_id", "q", values, "_id", "_t")
    assert sorted(map(tuple, contained.collect())) == [("a", 0), ("b", 0), ("b", 1), ("b", 2)]
    having_words = candidates.token_pairs(asked, "request_id", "words", values, "_id", "_words")
    assert sorted(map(tuple, having_words.collect())) == [("a", 0), ("b", 0), ("b", 1), ("b", 2)]
