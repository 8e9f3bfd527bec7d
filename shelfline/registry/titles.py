"""Title features, comparison and variant groups over the test tables."""

from pyspark.sql import functions as F

from shelfline import bindings as b
from shelfline.functions import codes, colors, features, text, variants
from shelfline.operators import compare, filters, variants as groups
from shelfline.registry.base import Registry

registry = Registry()
query = registry.query
PRODUCTS = ("v_products",)


def titles(spark, sf):
    return b.view(spark, sf, "v_products").select("product_key", "title", "brand", "model", "p_type")


def title_query(name, sql, **columns):
    """Columns of every product title against the same rule in SQL."""

    @query(name, f"SELECT product_key, {sql} FROM v_products", PRODUCTS)
    def _(spark, sf):
        return titles(spark, sf).select("product_key", *[build(F.col("title")).alias(alias) for alias, build in columns.items()])


title_query("norm_text", """
  nullif(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), '') AS compact,
  trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS words,
  array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), '|') AS tokens,
  nullif(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), '') AS identifier,
  nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), '') AS clean""",
            compact=text.norm_compact, words=text.norm_words, tokens=lambda t: F.array_join(text.tokens(t), "|"),
            identifier=text.norm_identifier, clean=text.text_or_null)

title_query("memory_features", """
  CASE WHEN regexp_matches(title, '[0-9]+/512') THEN concat(regexp_extract(title, '([0-9]+)/512', 1), 'GB/512GB')
       ELSE nullif(regexp_extract(title, '([0-9]+GB)', 1), '') END AS memory,
  CASE WHEN regexp_matches(title, '[0-9]+/512') THEN concat(CAST(regexp_extract(title, '([0-9]+)/512', 1) AS INT) * 1024, '|524288')
       ELSE concat('', CAST(regexp_extract(title, '([0-9]+)GB', 1) AS INT) * 1024) END AS megabytes""",
            memory=variants.memory_label, megabytes=lambda t: F.array_join(variants.memory_signature(t).cast("array<string>"), "|"))

title_query("color_keys", """
  CASE WHEN title LIKE '%(Red)' THEN 'red' WHEN title LIKE '%(Dark Blue)' THEN 'dark_blue' WHEN title LIKE '%(Obsidian)' THEN 'black'
       WHEN title LIKE '%(Sky Blue)' THEN 'light_blue' END AS color_key,
  CASE WHEN title LIKE '%(Red)' THEN 'Red' WHEN title LIKE '%(Dark Blue)' THEN 'Dark Blue' WHEN title LIKE '%(Obsidian)' THEN 'Obsidian'
       WHEN title LIKE '%(Sky Blue)' THEN 'Sky Blue' END AS label,
  trim(regexp_replace(title, '\\((Red|Dark Blue|Obsidian|Sky Blue)\\)$', '')) AS without_color""",
            color_key=colors.color_key, label=colors.color_label,
            without_color=colors.neutral_of_color)

# without the phone wording only an explicit parenthesis or a closing alias counts
title_query("marketing_colors", """
  CASE WHEN title LIKE '%(Red)' THEN 'red' WHEN title LIKE '%(Dark Blue)' THEN 'name:dark_blue' WHEN title LIKE '%(Obsidian)' THEN 'obsidian'
       WHEN title LIKE '%(Sky Blue)' THEN 'sky_blue' END AS marketing_key""",
            marketing_key=lambda t: colors.marketing_key(F.regexp_replace(t, "^Apple iPhone", "device")))

title_query("variant_features", """
  CASE WHEN title LIKE '%nano-SIM + eSIM%' THEN 'hybrid' WHEN title LIKE '%eSIM only%' THEN 'esim_only' WHEN title LIKE '%Dual SIM%' THEN 'dual_sim' END AS sim,
  CASE WHEN regexp_matches(title, '\\bGlobal\\b') THEN 'global' WHEN regexp_matches(title, '\\bEU\\b') THEN 'eu' WHEN regexp_matches(title, '\\bUSA\\b') THEN 'us' END AS region,
  CASE WHEN title LIKE '%refurbished%' THEN 'refurbished' WHEN title LIKE '% used%' THEN 'used' WHEN title LIKE '%open box%' THEN 'open_box' ELSE 'new' END AS condition,
  regexp_matches(replace(title, 'nano-SIM + eSIM', ''), '\\s\\+\\s') AS is_bundle,
  CASE WHEN regexp_matches(title, '(?i)\\b(lte|4g)\\b') THEN '4g' END AS device""",
            sim=variants.sim_config, region=variants.region, condition=variants.condition,
            is_bundle=lambda t: variants.bundle(t).isNotNull(), device=variants.device_config)

title_query("model_features", """
  CASE WHEN title LIKE 'Apple iPhone %' THEN regexp_extract(title, 'iPhone ([0-9]+)', 1) ELSE '' END AS numbers,
  CASE WHEN title LIKE 'Apple iPhone %' THEN regexp_extract(title, 'iPhone ([0-9]+)', 1) ELSE '' END AS generations,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'),
    lambda x: length(x) >= 4 AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '^[0-9]+gb$')))), '|') AS codes,
  regexp_matches(title, '[a-z0-9]\\+') AS has_plus""",
            numbers=lambda t: F.array_join(codes.model_numbers(t), "|"), generations=lambda t: F.array_join(codes.generation_numbers(t), "|"),
            codes=lambda t: F.array_join(codes.long_codes(t), "|"), has_plus=codes.has_plus)

title_query("cross_source_queries", """
  trim(regexp_replace(replace(regexp_replace(title, '\\([^()]*\\)', ' ', 'g'), '/', ' '), '\\s+', ' ', 'g')) AS query""",
            query=text.cross_source_query)

title_query("index_words", """
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'),
    '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'), '\\b([0-9]+)\\s+(gb|tb|mb)\\b', '\\1\\2', 'g'), '\\s+', ' ', 'g')) AS words""",
            words=text.index_norm)


# titles are written by a rule, so what a feature has to be follows from the parts of the title
PARTS = r"""parts AS (SELECT DISTINCT title, model, brand,
    CASE WHEN title LIKE 'Apple iPhone %' THEN 'Apple iPhone ' || regexp_extract(title, 'iPhone ([0-9]+)', 1) ELSE split_part(title, ' ', 1) END AS lead,
    regexp_extract(title, 'iPhone ([0-9]+)', 1) AS generation, regexp_extract(title, ' ([0-9]+GB|[0-9]+/512)', 1) AS memory,
    regexp_extract(title, '(Dual SIM|eSIM only|nano-SIM \+ eSIM)', 1) AS sim, regexp_extract(title, '\b(EU|Global|USA)\b', 1) AS region,
    regexp_extract(title, ' (refurbished|open box|used)', 1) AS condition, regexp_extract(title, '\((Red|Dark Blue|Obsidian|Sky Blue)\)$', 1) AS color
  FROM v_products)"""


def joined(*parts):
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x <> ''), ' ')"


COLOR_PARTS = {"Red": ("red", "red", "red", "base_color"), "Dark Blue": ("dark_blue", "unknown", "name:dark_blue", "unknown"),
               "Obsidian": ("black", "black", "obsidian", "exact_variant"), "Sky Blue": ("light_blue", "blue", "sky_blue", "exact_variant")}


def by_color(place, other="NULL"):
    return "CASE color " + " ".join(f"WHEN '{name}' THEN '{parts[place]}'" for name, parts in COLOR_PARTS.items()) + f" ELSE {other} END"


# what is left of the writing of the SIM, where only its marker is taken out
BARE_SIM = "CASE sim WHEN 'eSIM only' THEN 'only' ELSE '' END"
# behind the memory of a phone a colour is expected, so what stands there is taken for the name of one, but for known words
REST = joined(BARE_SIM, "region", "condition")
AFTER_MEMORY = f"CASE WHEN generation <> '' AND region NOT IN ('EU', 'Global') AND {REST} NOT IN ('', 'USA', 'refurbished') THEN replace(lower({REST}), ' ', '_') END"
NAMED = f"'name:' || {AFTER_MEMORY}"
UNKNOWN = f"CASE WHEN {AFTER_MEMORY} IS NOT NULL THEN 'unknown' END"
# a word for the kind of thing is no part of a model
MODEL = joined("CASE lead WHEN 'laptop' THEN '' ELSE lead END", "brand", "model", "sim", "region", "condition")


@query("enrich_titles", f"""
WITH {PARTS} SELECT title, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS compact, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS words,
  replace(replace(memory, 'GB', ''), '/', 'GB/') || 'GB' AS memory, array_to_string(list_transform(string_split(replace(memory, 'GB', ''), '/'), lambda x: x::INT * 1024), '|') AS memory_mb,
  {by_color(0)} AS color_key, {by_color(1, UNKNOWN)} AS family, {by_color(2, NAMED)} AS variant, {by_color(3, UNKNOWN)} AS confidence, nullif(color, '') AS color_label,
  CASE sim WHEN 'Dual SIM' THEN 'dual_sim' WHEN 'eSIM only' THEN 'esim_only' WHEN 'nano-SIM + eSIM' THEN 'hybrid' END AS sim,
  CASE region WHEN 'EU' THEN 'eu' WHEN 'USA' THEN 'us' WHEN 'Global' THEN 'global' END AS region, CASE condition WHEN '' THEN 'new' ELSE replace(condition, ' ', '_') END AS condition,
  generation AS model_numbers, generation AS generations, lower(brand) AS long_codes, lower(brand) AS specific_codes,
  trim(concat_ws(' ', CASE lead WHEN 'device' THEN '' ELSE regexp_replace(lower(lead), ' [0-9]+', '') END, 'brand', model, {BARE_SIM})) AS identity_words,
  {MODEL} AS model_title, {joined("lead", "brand", "model", "sim", "region", "condition")} AS base_title,
  {joined("lead", "brand", "model", BARE_SIM, "CASE WHEN color <> '' THEN '(' || color ELSE '' END")} AS neutral_title FROM parts""", PRODUCTS)
def _(spark, sf):
    lists = ("memory_mb", "model_numbers", "generations", "long_codes", "specific_codes")
    rich = features.enrich_titles(titles(spark, sf)).withColumns(
        {c: F.array_join(F.col(c).cast("array<string>"), "|") for c in lists} | {"identity_words": F.array_join("identity_words", " ")})
    return rich.select("title", "compact", "words", "memory", "color_key", "color.family", "color.variant", "color.confidence", "color_label", "sim", "region",
                       "condition", *lists, "identity_words", "model_title", "base_title", "neutral_title")


@query("build_identities", f"""
WITH {PARTS} SELECT p.product_key, p.title, CASE lead WHEN 'laptop' THEN lower(brand) ELSE lower(split_part(lead, ' ', 1)) END AS brand,
  lower({joined("CASE WHEN generation <> '' THEN 'iphone ' || generation ELSE '' END", "CASE lead WHEN 'laptop' THEN '' ELSE brand END", "model", "replace(sim, ' +', '')",
                "region", "condition")}) AS model,
  replace(replace(memory, 'GB', ''), '/', 'GB/') || 'GB' AS memory, {by_color(2, NAMED)} AS color FROM parts JOIN v_products p USING (title, model, brand)""", PRODUCTS)
def _(spark, sf):
    return features.build_identity(titles(spark, sf).select("product_key", "title")).select("product_key", "title", "identity.brand", "identity.model", "identity.memory", "identity.color")


# a feed names memory and colour in its own way; what it leaves out is read from the title
@query("build_identities_from_feed", """
SELECT product_key, lower(brand) AS brand, model, lower(mpn) AS mpn,
  CASE p_size % 3 WHEN 0 THEN '32GB' WHEN 1 THEN '8GB/1TB'
    ELSE CASE WHEN p_type = 'LARGE' THEN concat(regexp_extract(title, '([0-9]+)/512', 1), 'GB/512GB') ELSE regexp_extract(title, '([0-9]+GB)', 1) END END AS memory,
  CASE p_size % 2 WHEN 0 THEN 'dark_blue' ELSE 'sea_foam' END AS color FROM v_products""", PRODUCTS)
def _(spark, sf):
    shown = b.view(spark, sf, "v_products")
    memory = F.when(F.col("p_size") % 3 == 0, "32 gb").when(F.col("p_size") % 3 == 1, "8/1TB")
    color = F.when(F.col("p_size") % 2 == 0, "Dark Blue").otherwise("Sea-foam")
    given = {"brand": F.col("brand"), "model": F.col("model"), "mpn": F.col("mpn"), "memory": memory, "color": color}
    return features.build_identity(shown, "title", given).select("product_key", "identity.brand", "identity.model", "identity.mpn", "identity.memory", "identity.color")


POOL = ["model", "p_type", "brands"]


def pools(spark, sf):
    """Every card asks, against the titles of its pool."""
    return b.view(spark, sf, "v_wanted").drop("brand"), b.view(spark, sf, "v_shown").drop("brand")


# what a title says, read off its fixed parts
SAID = """said AS (SELECT DISTINCT title, model, p_type, brand, brands, regexp_extract(title, 'iPhone ([0-9]+)', 1) AS generation,
    CASE WHEN title LIKE '%refurbished%' THEN 'refurbished' WHEN title LIKE '% used%' THEN 'used' WHEN title LIKE '%open box%' THEN 'open_box' ELSE 'new' END AS condition,
    CASE WHEN regexp_matches(title, '/512') THEN concat(regexp_extract(title, '([0-9]+)/512', 1), '/512') ELSE regexp_extract(title, '([0-9]+)GB', 1) END AS memory,
    CASE WHEN regexp_matches(title, '\\bGlobal\\b') THEN 'global' WHEN regexp_matches(title, '\\bEU\\b') THEN 'eu' WHEN regexp_matches(title, '\\bUSA\\b') THEN 'us' END AS region,
    CASE WHEN title LIKE '%nano-SIM + eSIM%' THEN 'hybrid' WHEN title LIKE '%eSIM only%' THEN 'esim_only' WHEN title LIKE '%Dual SIM%' THEN 'dual_sim' END AS sim
  FROM v_shown)"""
VARIANT = """CASE WHEN r.condition <> c.condition THEN 'condition' WHEN r.memory <> c.memory THEN 'memory'
  WHEN r.region <> c.region THEN 'region' WHEN r.sim <> c.sim THEN 'sim' END"""
# the colour goes with the first word of the model name, which also stands where a laptop's brand is looked for; in a pool the names are equal
REASON = f"""CASE WHEN r.generation <> c.generation THEN 'model_number' WHEN r.brand <> c.brand THEN 'model_code'
  WHEN r.title LIKE 'laptop%' AND r.model <> c.model THEN 'brand' ELSE coalesce({VARIANT}, CASE WHEN r.model <> c.model THEN 'color' END) END"""


@query("match_offers_to_reference", f"""
WITH {SAID}, judged AS (SELECT w.request_id, w.wanted_title, c.title, {REASON} AS reason, r.sim AS r_sim, c.sim AS c_sim
  FROM v_wanted w JOIN said r ON r.title = w.wanted_title AND r.p_type = w.p_type JOIN said c ON c.model = w.model AND c.p_type = w.p_type AND c.brands = w.brands)
SELECT request_id, wanted_title, title, reason, reason IS NULL AND r_sim IS NOT DISTINCT FROM c_sim
  AND (wanted_title NOT LIKE '%iPhone%' OR NOT regexp_matches(title, 'refurbished| used|open box')) AS confirmed FROM judged""", ("v_wanted", "v_shown"))
def _(spark, sf):
    asked, shown = pools(spark, sf)
    judged = compare.judge_scopes(asked.select(*POOL, "wanted_title").distinct(), shown, POOL)
    return compare.join_titles(asked, judged, [*POOL, "wanted_title"]).select("request_id", "wanted_title", "title", "reason", "confirmed")


@query("variant_mismatches", f"""
WITH {SAID} SELECT w.request_id, c.title, {VARIANT} AS reason
FROM v_wanted w JOIN said r ON r.title = w.wanted_title AND r.p_type = w.p_type JOIN said c ON c.model = w.model AND c.p_type = w.p_type AND c.brands = w.brands""", ("v_wanted", "v_shown"))
def _(spark, sf):
    asked, shown = pools(spark, sf)
    judged = compare.variant_reasons(asked.select(*POOL, "wanted_title").distinct(), shown, POOL)
    return asked.join(judged, [*POOL, "wanted_title"]).select("request_id", "title", "reason")


def seller_candidates(spark, sf):
    """Wanted titles, and the titles that sources show with the card behind each; they meet in the same brand, model and type."""
    shown = b.view(spark, sf, "v_offers").select("source", "product_key").distinct().join(titles(spark, sf), "product_key")
    return b.view(spark, sf, "v_wanted_titles"), shown.withColumnRenamed("product_key", "candidate_key").withColumn("rank", F.col("candidate_key"))


@query("pick_reference_candidate", f"""
WITH {SAID}, shown AS (SELECT DISTINCT o.source, o.product_key, p.title, p.p_type FROM v_offers o JOIN v_products p USING (product_key))
SELECT w.request_id, o.source, min(o.product_key) AS candidate_key
FROM v_wanted_titles w JOIN said r ON r.title = w.wanted_title AND r.p_type = w.p_type JOIN said c ON c.model = w.model AND c.p_type = w.p_type AND c.brand = w.brand
  JOIN shown o ON o.title = c.title AND o.p_type = c.p_type
WHERE {REASON} IS NULL GROUP BY ALL""", ("v_wanted_titles", "v_shown", "v_offers"))
def _(spark, sf):
    asked, candidates = seller_candidates(spark, sf)
    return compare.pick_reference_candidate(asked.select("request_id", "wanted_title"), candidates, asked=asked.drop("wanted_title"))


@query("confirm_variant", f"""
WITH {SAID} SELECT w.request_id, o.position, o.price
FROM v_wanted_titles w JOIN said r ON r.title = w.wanted_title AND r.p_type = w.p_type JOIN said c ON c.model = w.model AND c.p_type = w.p_type AND c.brand = w.brand
  JOIN v_products p ON p.title = c.title AND p.p_type = c.p_type JOIN v_offers o ON o.product_key = p.product_key
WHERE {REASON} IS NULL AND r.sim IS NOT DISTINCT FROM c.sim AND (r.title NOT LIKE '%iPhone%' OR c.condition = 'new') AND o.available AND o.price > 0
  AND (o.currency <> 'BYN' OR CASE WHEN o.title LIKE '%iPhone%' THEN o.price >= 300 WHEN o.title LIKE 'laptop%' THEN o.price >= 100 ELSE true END)""",
       ("v_wanted_titles", "v_shown", "v_offers"))
def _(spark, sf):
    asked = b.view(spark, sf, "v_wanted_titles")
    offers = b.view(spark, sf, "v_offers").join(titles(spark, sf).drop("title"), "product_key")
    return compare.confirm_variant(asked.select("request_id", "wanted_title"), offers, asked=asked.drop("wanted_title")).select("request_id", "position", "price")


COLORED = """(SELECT product_key, brand, v_products.p_type AS p_type, CASE WHEN p_name LIKE 'red %' THEN 'red' WHEN p_name LIKE 'blue %' THEN 'blue' WHEN p_name LIKE 'small %' THEN 'Obsidian'
  WHEN p_name LIKE 'hot %' THEN 'Sky Blue' END AS color FROM v_products JOIN part USING (p_partkey))"""


@query("match_colors", f"""
SELECT a.product_key AS request_id, c.color, CASE WHEN a.color IS NULL THEN true WHEN c.color IS NULL THEN false
  WHEN a.color = 'blue' THEN c.color IN ('blue', 'Sky Blue') WHEN a.color = 'red' THEN c.color = 'red' ELSE a.color = c.color END AS matches
FROM {COLORED} a JOIN (SELECT DISTINCT brand, p_type, color FROM {COLORED}) c USING (brand, p_type)""", PRODUCTS)
def _(spark, sf):
    color = (F.when(F.col("model").startswith("red "), "red").when(F.col("model").startswith("blue "), "blue")
             .when(F.col("model").startswith("small "), "Obsidian").when(F.col("model").startswith("hot "), "Sky Blue"))
    asked = titles(spark, sf).select(F.col("product_key").alias("request_id"), "brand", "p_type", color.alias("wanted"))
    # every card asks, against the colours that cards of its brand and type are shown in
    shown = titles(spark, sf).select("brand", "p_type", color.alias("color")).distinct()
    pairs = asked.join(shown, ["brand", "p_type"])
    # a pair of colour names is judged once, however many cards show it
    judged = pairs.select("wanted", F.col("color").alias("_color")).distinct().withColumn("matches", colors.match_colors(F.col("wanted"), F.col("_color"))).withColumnRenamed("wanted", "_wanted")
    same = F.col("wanted").eqNullSafe(F.col("_wanted")) & F.col("color").eqNullSafe(F.col("_color"))
    return pairs.join(judged, same).select("request_id", "color", "matches")


GROUPED = f"""
WITH {PARTS}, c AS (SELECT p.model AS request_id, product_key, lpad(regexp_extract(product_key, '[0-9]+'), 12, '0') AS position, {{key}} AS base
  FROM parts JOIN v_products p USING (title, model, brand))
SELECT request_id, product_key, {{label}} AS group_key, first_value(base) OVER w AS group_title, min(position) OVER w AS group_position,
  count(*) OVER (PARTITION BY request_id, {{label}}) AS group_size FROM c
WINDOW w AS (PARTITION BY request_id, {{label}} ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
BASE = joined("lead", "brand", "p.model", "sim", "region", "condition")
KIND = MODEL.replace("model", "p.model")
# a phone is shown by its generation alone
SHOWN = "CASE WHEN generation <> '' THEN lead ELSE " + joined("CASE lead WHEN 'laptop' THEN '' ELSE lead END", "brand", "p.model", BARE_SIM, "region", "condition") + " END"
NORMAL = "trim(regexp_replace(lower(base), '[^a-z0-9]+', ' ', 'g'))"


def cards(spark, sf):
    return titles(spark, sf).select("product_key", "title", F.col("model").alias("request_id"), F.lit("red things").alias("query"),
                                    F.lpad(F.regexp_extract("product_key", r"\d+", 0), 12, "0").alias("position"))


@query("group_product_variants", GROUPED.format(key=BASE, label="lower(base)"), PRODUCTS)
def _(spark, sf):
    return groups.group_product_variants(cards(spark, sf), ["request_id"]).select("request_id", "product_key", "group_key", "group_title", "group_position", "group_size")


MEMORY_SQL = """CASE WHEN p_type = 'LARGE' THEN concat(regexp_extract(title, '([0-9]+)/512', 1), 'GB/512GB') ELSE regexp_extract(title, '([0-9]+GB)', 1) END"""


@query("group_by_memory", f"""
SELECT product_key, memory AS group_key, count(*) OVER (PARTITION BY model, memory) AS group_size, model AS request_id
FROM (SELECT *, {MEMORY_SQL} AS memory FROM v_products)""", PRODUCTS)
def _(spark, sf):
    return groups.group_by_memory(cards(spark, sf), ["request_id"]).select("product_key", "group_key", "group_size", "request_id")


@query("memory_choices", f"""
WITH m AS (SELECT model AS request_id, memory, count(*) AS cards FROM (SELECT *, {MEMORY_SQL} AS memory FROM v_products) GROUP BY ALL),
keyed AS (SELECT *, list_transform(string_split(replace(memory, 'GB', ''), '/'), lambda x: CAST(x AS BIGINT)) AS sizes FROM m)
SELECT request_id, memory, cards, row_number() OVER (PARTITION BY request_id ORDER BY sizes DESC) AS place,
  count(*) OVER (PARTITION BY request_id) > 1 AS has_choice FROM keyed""", PRODUCTS)
def _(spark, sf):
    return groups.memory_choices(cards(spark, sf), ["request_id"])


@query("group_by_sim", """
WITH s AS (SELECT product_key, model AS request_id, CASE WHEN title LIKE '%nano-SIM + eSIM%' THEN 'hybrid' WHEN title LIKE '%eSIM only%' THEN 'esim_only'
  WHEN title LIKE '%Dual SIM%' THEN 'dual_sim' ELSE 'unknown' END AS group_key FROM v_products)
SELECT *, count(*) OVER (PARTITION BY request_id, group_key) AS group_size FROM s""", PRODUCTS)
def _(spark, sf):
    return groups.group_by_sim(cards(spark, sf), ["request_id"]).select("product_key", "request_id", "group_key", "group_size")


@query("group_model_variants", GROUPED.format(key=KIND, label=NORMAL), PRODUCTS)
def _(spark, sf):
    return groups.group_model_variants(cards(spark, sf), ["request_id"]).select("request_id", "product_key", "group_key", "group_title", "group_position", "group_size")


@query("group_display_models", GROUPED.format(key=SHOWN, label=NORMAL), PRODUCTS)
def _(spark, sf):
    return groups.group_display_models(cards(spark, sf), ["request_id"]).select("request_id", "product_key", "group_key", "group_title", "group_position", "group_size")


@query("color_choices", """
WITH c AS (SELECT model AS request_id, product_key, title, CASE WHEN title LIKE '%(Red)' THEN 'red' WHEN title LIKE '%(Dark Blue)' THEN 'dark_blue'
    WHEN title LIKE '%(Obsidian)' THEN 'black' WHEN title LIKE '%(Sky Blue)' THEN 'light_blue' END AS color_key FROM v_products),
usable AS (SELECT request_id, coalesce(color_key, 'unknown') AS color_key FROM c
  WHERE color_key IS NOT NULL OR request_id NOT IN (SELECT request_id FROM c WHERE color_key IS NOT NULL))
SELECT request_id, color_key, count(*) AS cards, CASE color_key WHEN 'red' THEN 'Red' WHEN 'dark_blue' THEN 'Dark Blue' WHEN 'black' THEN 'Obsidian'
  WHEN 'light_blue' THEN 'Sky Blue' ELSE 'Цвет не указан' END AS label FROM usable GROUP BY ALL""", PRODUCTS)
def _(spark, sf):
    return groups.color_choices(cards(spark, sf)).select("request_id", "color_key", "cards", "label")


@query("collapse_color_variants", f"""
WITH {PARTS}, c AS (SELECT p.model AS request_id, product_key, title, CASE WHEN p_size % 2 = 0 THEN 'gear' ELSE 'red gear' END AS query, lpad(regexp_extract(product_key, '[0-9]+'), 12, '0') AS position,
    regexp_replace(title, ' \\((Red|Dark Blue|Obsidian|Sky Blue)\\)$', '') AS base FROM parts JOIN v_products p USING (title, model, brand))
SELECT request_id, query, product_key FROM c WHERE query = 'red gear'
UNION ALL SELECT request_id, 'gear', arg_min(product_key, position) FROM c WHERE query = 'gear' GROUP BY request_id, lower(base)""", PRODUCTS)
def _(spark, sf):
    sizes = b.view(spark, sf, "v_products").select("product_key", "p_size")
    asked = cards(spark, sf).join(sizes, "product_key").withColumn("query", F.when(F.col("p_size") % 2 == 0, "gear").otherwise("red gear"))
    return groups.collapse_color_variants(asked).select("request_id", "query", "product_key")


@query("natural_sort_desc", """
WITH m AS (SELECT DISTINCT request_id, concat('S', n) AS group_title, n FROM (
  SELECT p_type AS request_id, p_size AS n FROM v_products))
SELECT request_id, group_title, row_number() OVER (PARTITION BY request_id ORDER BY n DESC) AS group_place FROM m""", PRODUCTS)
def _(spark, sf):
    sized = b.view(spark, sf, "v_products").select(F.col("p_type").alias("request_id"), F.concat(F.lit("S"), "p_size").alias("group_title"))
    return groups.order_groups(sized, scope=["request_id"])


@query("filter_relevant", """
SELECT product_key, title, 'Apple iPhone' AS query, '' AS url FROM v_products WHERE title LIKE 'Apple iPhone %'
AND title NOT LIKE '%refurbished%' AND title NOT LIKE '% used%' AND title NOT LIKE '%open box%'""", PRODUCTS)
def _(spark, sf):
    return filters.filter_relevant(titles(spark, sf).select(
        "product_key", "title", F.lit("Apple iPhone").alias("query"), F.lit("").alias("url")))


# every card answers two requests of its type: one for its own number and one for a shifted number
GENERATION_PAIRS = """
SELECT concat(p_type, '-', CAST(p_size % 30 AS INT)) AS request_id, concat('iphone ', CAST(p_size % 30 AS INT)) AS query, product_key, title FROM {v_products}
UNION ALL SELECT concat(p_type, '-', CAST((p_size + 7) % 30 AS INT)), concat('iphone ', CAST((p_size + 7) % 30 AS INT)), product_key, title FROM {v_products}"""


@query("filter_query_generation", f"""
WITH marked AS (SELECT *, regexp_extract(title, 'iPhone ([0-9]+)', 1) = regexp_extract(query, '[0-9]+') AS fits
  FROM ({GENERATION_PAIRS.format(v_products='v_products')}))
SELECT request_id, query, product_key, title FROM marked m WHERE fits OR request_id NOT IN (SELECT request_id FROM marked WHERE fits)""", PRODUCTS)
def _(spark, sf):
    return filters.filter_query_generation(b.from_sql(spark, sf, GENERATION_PAIRS))


@query("filter_accessories", """
SELECT product_key, title, model AS query FROM v_products WHERE NOT regexp_matches(lower(title), '(^|\\s)(case|cover|cable|charger|adapter|mount|strap)')""", PRODUCTS)
def _(spark, sf):
    return filters.filter_accessories(titles(spark, sf).select("product_key", "title", F.col("model").alias("query")))


@query("code_set_algebra", """
WITH c AS (SELECT title, model, p_type, brands, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'),
    lambda x: length(x) >= 4 AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '^[0-9]+gb$'))) AS t FROM v_shown)
SELECT w.request_id, c.title, len(list_filter(a.t, lambda x: NOT list_contains(c.t, x))) = 0 AS is_subset,
  NOT list_has_any(a.t, c.t) AS is_disjoint, array_to_string(list_sort(list_intersect(a.t, c.t)), '|') AS shared
FROM v_wanted w JOIN c a ON a.title = w.wanted_title AND a.p_type = w.p_type JOIN c ON c.model = w.model AND c.p_type = w.p_type AND c.brands = w.brands""", ("v_wanted", "v_shown"))
def _(spark, sf):
    asked, shown = pools(spark, sf)
    related = asked.join(compare.code_relations(asked.select(*POOL, "wanted_title").distinct(), shown, POOL), [*POOL, "wanted_title"])
    return related.select("request_id", "title", "is_subset", "is_disjoint", F.array_join("shared", "|").alias("shared"))


@query("query_variants", f"""
WITH {PARTS}, q AS (SELECT p.product_key, list_distinct(list_filter([CASE WHEN color <> '' THEN p.model || ' ' || color END, p.model], lambda x: x IS NOT NULL)) AS texts
  FROM parts JOIN v_products p USING (title, model, brand))
SELECT product_key, unnest(range(len(texts)))::INT AS place, unnest(list_sort(texts, 'DESC')) AS query FROM q""", PRODUCTS)
def _(spark, sf):
    cards_ = titles(spark, sf)
    texts = codes.query_variants(F.col("model"), colors.explicit_color(F.col("title")), colors.display_color(F.col("title")))
    return cards_.select("product_key", F.posexplode(texts).alias("place", "query"))


@query("identifier_query_variants", """
SELECT product_key, 0 AS place, concat(split_part(title, ' ', 1), ' ', brand) AS query FROM v_products UNION ALL SELECT product_key, 1, title FROM v_products""", PRODUCTS)
def _(spark, sf):
    return titles(spark, sf).select("product_key", F.posexplode(codes.identifier_query_variants(F.col("title"))).alias("place", "query"))
