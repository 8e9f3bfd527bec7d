"""Golden titles: text in, feature out."""

import pytest
from pyspark.sql import functions as F

from shelfline.functions import codes, colors, features, text, variants

CASES = [
    (variants.memory_label, "Samsung A55 8/256GB", "8GB/256GB"),
    (variants.memory_label, "Ноутбук 16/512 Midnight", "16GB/512GB"),
    (variants.memory_label, "Ноутбук 1TB/16GB", "16GB/1TB"),
    (variants.memory_label, "Телефон 128 ГБ", "128GB"),
    (variants.memory_label, "Phone 8/16", None),
    (variants.memory_signature, "Phone 1TB", [1048576]),
    (variants.memory_signature, "Phone 1024GB", [1048576]),
    (variants.memory_signature, "Phone 8/16 256GB", []),
    (colors.color_key, "Phone (Dark Blue)", "dark_blue"),
    (colors.color_key, "Google Pixel (Obsidian)", "black"),
    (colors.color_key, "Xiaomi Redmi Note 13 Pro", None),
    (colors.color_key, "Samsung Galaxy S25 (Global)", None),
    (colors.display_color, "Apple iPhone 17 512GB (голубой)", "Mist Blue"),
    (colors.display_color, "Наушники (черный/белый)", "Black/White"),
    (colors.neutral_of_color, "Samsung Galaxy S25 (Global)", "Samsung Galaxy S25 (Global)"),
    (colors.neutral_of_color, "Google Pixel 8 256GB Space Black", "Google Pixel 8 256GB"),
    (colors.neutral_of_color, "Google Pixel 8 (Obsidian)", "Google Pixel 8"),
    (colors.neutral_of_color, "Xiaomi Blue Star 5", "Xiaomi Blue Star 5"),
    (variants.sim_config, "Phone nano-SIM + eSIM", "hybrid"),
    (variants.sim_config, "Phone eSIM only", "esim_only"),
    (variants.sim_config, "Phone Dual eSIM", "dual_esim"),
    (variants.sim_config, "Phone 2 nano-SIM", "dual_sim"),
    (variants.region, "Phone (EU)", "eu"),
    (variants.condition, "Phone Open Box", "open_box"),
    (variants.condition, "Восстановленный телефон", "refurbished"),
    (variants.condition, "Phone", "new"),
    (lambda c: variants.bundle(c)["marker"], "PS5 + DualSense", "controller"),
    (lambda c: variants.bundle(c)["count"], "PS5 два геймпада", 2),
    (lambda c: variants.bundle(c).isNull(), "Phone nano-SIM + eSIM", True),
    (codes.tier_signature, "Honor 90 Лайт", ["lite"]),
    (codes.tier_signature, "TV MiniLED 55", []),
    (codes.tier_signature, "Phone Light Blue", []),
    (codes.tier_signature, "Apple iPhone 16 eSIM", []),
    (codes.specific_codes, "Телевизор LG QNED70 50QNED70B6C", ["50qned70b6c"]),
    (codes.model_numbers, "Apple iPhone 17 256GB", ["17"]),
    (codes.suffix_models, "Apple iPhone 16e 128GB 120Hz", ["16e"]),
    (codes.short_codes, "Samsung Galaxy S24 5G 8GB", ["s24"]),
    (codes.long_codes, "Huawei nova Y63 GFY-LX1 8GB/256GB", ["gfylx1"]),
    (codes.identifier_query_variants, "Bosch духовой шкаф HBA-534-EB3",
     ["Bosch HBA-534-EB3", "Bosch духовой шкаф HBA-534-EB3"]),
    (text.strip_region_suffix, "WW90T554CAT/LP", "WW90T554CAT"),
    (text.norm_compact, "Ёлка-12 ++", "елка12"),
    (text.parse_price, "1 234,50 р.", 1234.5),
    (text.parse_price, "1.234.50", 1234.5),
    (text.index_norm, "iPhone17-256-GB S25", "iphone 17 256gb s 25"),
    (text.slug_title, "smartfon-apple-iphone-17", "smartfon Apple iPhone 17"),
    (text.cross_source_query, "Samsung S25 (Navy) SM-S931B 8/256", "Samsung S25 8 256"),
    (variants.without_variants, "Apple iPhone 17 Pro 12GB/256GB EU Dual SIM", "Apple iPhone 17 Pro"),
    (variants.base_title, "Apple iPhone 17 8/256GB (голубой)", "Apple iPhone 17"),
    (variants.model_title, "Смартфон Apple Смартфон Apple iPhone 17 256GB (черный)", "Apple iPhone 17"),
    (variants.strip_type_words, "Phone Y", "Phone Y"),
    (variants.display_title, "Смартфон Apple iPhone 17 pro max 256GB (черный)", "Apple iPhone 17 Pro Max"),
    (variants.display_title, "Смартфон Samsung Galaxy S25 eSIM 256GB (Navy)", "Samsung Galaxy S25 256GB"),
    (colors.selection_color_key, "Google Pixel 9 (Peony)", "peony"),
]


def test_golden_titles(spark):
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "i int, title string")
    chosen = [build(F.lit(title).cast("string")).alias(f"c{i}") for i, (build, title, _) in enumerate(CASES)]
    # literals fold at planning time, so the values come from a real column instead
    failures = []
    for i, (build, title, expected) in enumerate(CASES):
        got = df.filter(F.col("i") == i).select(build(F.col("title")).alias("x")).first()["x"]
        if got != expected:
            failures.append((title, got, expected))
    assert not failures, failures
    assert len(chosen) == len(CASES)


def test_color_identity(spark):
    df = spark.createDataFrame([("Чехол мятно-зелёный",), ("Чехол зелёный",), ("Samsung Galaxy S25 256GB Coral Sun",)], "t string")
    rows = [tuple(r["x"]) for r in df.select(colors.color_identity(F.col("t")).alias("x")).collect()]
    assert rows == [("green", "mint", "exact_variant"), ("green", "green", "base_color"),
                    ("unknown", "name:coral_sun", "unknown")]


@pytest.mark.parametrize("requested,candidate,expected", [
    ("зелёный", "мятный", True), ("мятный", "зелёный", False), ("", "red", True), ("red", "", False),
    ("navy", "темно синий", True), ("Black Titanium", "titanium black", True),
])
def test_match_colors(spark, requested, candidate, expected):
    df = spark.createDataFrame([(requested, candidate)], "r string, c string")
    assert df.select(colors.match_colors(F.col("r"), F.col("c")).alias("x")).first()["x"] is expected


def test_identity_ignores_region_suffix(spark):
    titles = ["Стиральная машина Samsung WW90T554CAT/LP", "Samsung Стиральная машина Samsung WW90T554CAT",
              "Samsung WW90T554CAT"]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    rows = features.build_identity(df).select("identity.brand", "identity.model").distinct().collect()
    assert [tuple(r) for r in rows] == [("samsung", "ww90t554cat")]


def test_enrich_is_one_row_per_title(spark):
    df = spark.createDataFrame([("Apple iPhone 17 256GB (черный)",)] * 3, "title string")
    rows = features.enrich_titles(df).collect()
    assert len(rows) == 1 and rows[0]["memory"] == "256GB" and rows[0]["color"]["variant"] == "black"
