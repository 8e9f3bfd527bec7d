"""Variant columns: memory, SIM, region, condition, bundle, device, titles without them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfline.functions import vocabulary as v
from shelfline.functions.colors import color_phrase, explicit_color, neutral_of_color, without_sim
from shelfline.functions.text import first_match, fold, let, lookup, squeeze, strip_region_suffix, word_list

_PAIR_PARTS = rf"(?iU)^(\d{{1,2}})\s*({v.UNIT})?\s*/\s*(\d{{1,4}})\s*({v.UNIT})?$"
_SINGLE_PARTS = rf"(?iU)^(\d+)\s*({v.UNIT})$"
# a pair that counts: some unit is written, or the right side is large enough to be storage
_COUNTING_PAIR = (
    rf"(?iU)(?<!\d)(?:\d{{1,2}}\s*(?:{v.UNIT})\s*/\s*\d{{1,4}}(?:\s*(?:{v.UNIT}))?|\d{{1,2}}\s*/\s*\d{{1,4}}\s*(?:{v.UNIT})|"
    rf"\d{{1,2}}\s*/\s*(?:3[2-9]|[4-9]\d|[1-9]\d{{2,3}}))(?!\w)"
)


def _part(amount: Column, unit: Column) -> Column:
    """struct(mb, label) of one memory size; a missing unit means GB."""
    name = F.coalesce(F.nullif(F.translate(F.upper(unit), "ГБТМ", "GBTM"), F.lit("")), F.lit("GB"))
    number = amount.try_cast("bigint")
    scale = F.when(name == "MB", 1).when(name == "TB", 1024 * 1024).otherwise(1024)
    return F.struct((number * scale).alias("mb"), F.concat(number.cast("string"), name).alias("label"))


def _pair_parts(pair: Column) -> Column:
    return F.array(_part(F.regexp_extract(pair, _PAIR_PARTS, 1), F.regexp_extract(pair, _PAIR_PARTS, 2)),
                   _part(F.regexp_extract(pair, _PAIR_PARTS, 3), F.regexp_extract(pair, _PAIR_PARTS, 4)))


def _pair_counts(pair: Column) -> Column:
    bare = (F.regexp_extract(pair, _PAIR_PARTS, 2) == "") & (F.regexp_extract(pair, _PAIR_PARTS, 4) == "")
    return ~(bare & (F.regexp_extract(pair, _PAIR_PARTS, 3).try_cast("int") < v.SMALLEST_UNITLESS_STORAGE))


def _pairs(title: Column) -> Column:
    return F.regexp_extract_all(title, F.lit(v.MEMORY_PAIR), F.lit(0))


def _singles(title: Column) -> Column:
    found = F.regexp_extract_all(title, F.lit(v.MEMORY_SINGLE), F.lit(0))
    return F.transform(found, lambda s: _part(F.regexp_extract(s, _SINGLE_PARTS, 1), F.regexp_extract(s, _SINGLE_PARTS, 2)))


def _by_size(parts: Column) -> Column:
    """Labels ordered by size; equal sizes keep their order in the title."""
    numbered = F.transform(parts, lambda p, i: F.struct(p["mb"].alias("mb"), i.alias("i"), p["label"].alias("label")))
    return F.array_join(F.transform(F.array_sort(numbered), lambda p: p["label"]), "/")


def memory_label(title: Column) -> Column:
    """``8GB/256GB``: the first counting pair, else every size in ascending order."""
    counting = F.filter(_pairs(title), _pair_counts)
    label = let(counting, lambda pairs: F.when(F.size(pairs) > 0, _by_size(_pair_parts(pairs[0]))).otherwise(
        F.nullif(_by_size(_singles(title)), F.lit(""))))
    return F.when(title.rlike(r"\d"), label)


def memory_signature(title: Column) -> Column:
    """Sorted distinct sizes in MB; a first pair that does not count ends with no sizes."""
    sizes = let(_pairs(title), lambda pairs: F.when(F.size(pairs) == 0, F.transform(_singles(title), lambda p: p["mb"]))
                .when(_pair_counts(pairs[0]), F.transform(_pair_parts(pairs[0]), lambda p: p["mb"]))
                .otherwise(F.array().cast("array<bigint>")))
    return F.coalesce(F.array_sort(F.array_distinct(sizes)), F.array().cast("array<bigint>"))


def memory_order(label: Column) -> Column:
    """struct(known, sizes): sort key of a memory label, largest last."""
    sizes = F.transform(F.split(label, "/"), lambda p: F.coalesce(
        _part(F.regexp_extract(p, _SINGLE_PARTS, 1), F.regexp_extract(p, _SINGLE_PARTS, 2))["mb"], F.lit(0)))
    known = label != v.NO_MEMORY_CHOICE
    return F.struct(known.alias("known"), F.when(known, sizes).otherwise(F.array().cast("array<bigint>")).alias("sizes"))


def feed_memory(value: Column) -> Column:
    """Memory from a feed field: a label, a bare number of GB, or the text itself."""
    plain = F.regexp_replace(F.upper(value), r"(?U)\s+", "")
    plain = F.replace(F.replace(plain, F.lit("ГБ"), F.lit("GB")), F.lit("ТБ"), F.lit("TB"))
    return F.coalesce(memory_label(value), F.when(value.rlike(r"(?U)^\d+$"), F.concat(value.try_cast("bigint").cast("string"), F.lit("GB"))),
                      F.nullif(plain, F.lit("")))


def sim_config(x: Column) -> Column:
    return first_match(fold(x), v.SIMS)


def region(x: Column) -> Column:
    return first_match(x, v.REGIONS)


def condition(x: Column) -> Column:
    return F.coalesce(first_match(x, v.CONDITIONS), F.lit("new"))


def device_config(x: Column) -> Column:
    return first_match(fold(x), v.DEVICES)


def connector(x: Column) -> Column:
    return first_match(fold(x), v.CONNECTORS)


def voice(x: Column) -> Column:
    return first_match(fold(x), v.VOICES)


def display_config(x: Column) -> Column:
    return first_match(x, v.DISPLAYS)


def bundle(x: Column) -> Column:
    """struct(marker, count) if the title offers a bundle, else NULL."""

    def describe(text: Column) -> Column:
        word = F.regexp_extract(text, v.BUNDLE_COUNT, 1)
        count = F.coalesce(word.try_cast("int"), lookup({k: str(n) for k, n in v.BUNDLE_COUNT_WORDS.items()}, word).cast("int"))
        return F.when(text.rlike(v.BUNDLE_SIGNAL),
                      F.struct(first_match(text, v.BUNDLE_ITEMS).alias("marker"), count.alias("count")))

    return let(F.regexp_replace(fold(x), v.BUNDLE_PLUS_EXCEPTIONS, " "), describe)


def without_variants(title: Column) -> Column:
    """Title without memory, condition, region, display, SIM, network and bundle."""
    result = F.regexp_replace(F.regexp_replace(title, v.MEMORY_PAIR, " "), v.MEMORY_SINGLE, " ")
    removed = [p for table in (v.CONDITIONS, v.REGIONS, v.DISPLAYS) for _, p in table] + v.VARIANT_WORDS
    for pattern in removed:
        result = F.regexp_replace(result, pattern, " ")
    result = F.regexp_replace(result, v.BUNDLE_TAIL, " ")
    result = F.regexp_replace(result, r"(?U)\(\s*[,;/+-]*\s*\)", " ")
    return F.btrim(F.regexp_replace(result, r"(?U)\s+", " "), F.lit(" -/,;()"))


def base_title(title: Column) -> Column:
    """Title without the closing colour parenthesis and without memory."""
    plain = F.when(explicit_color(title).isNotNull(), F.regexp_replace(title, r"\s*\([^()]*\)\s*$", "")).otherwise(title)
    # only the first counting pair goes; the remaining sizes are removed one by one
    first_pair = F.regexp_replace(plain, rf"(?s){_COUNTING_PAIR}(.*)$", " $1")
    rest = F.regexp_replace(F.regexp_replace(first_pair, v.MEMORY_SINGLE, " "), r"(?U)\s*/\s*", " ")
    return F.btrim(squeeze(rest), F.lit(" -/,"))


def _is_code(token: Column) -> Column:
    compact = F.regexp_replace(F.lower(token), "[^a-zа-я0-9]", "")
    return (F.length(compact) >= 5) & compact.rlike("[a-zа-я]") & compact.rlike("[0-9]")


def strip_type_words(title: Column) -> Column:
    """Drop category words before brand and model, and a brand repeated after them."""
    kinds = word_list(v.TYPE_WORDS)

    def leading(words: Column) -> Column:
        return F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), lambda s, w: F.when(
            s["open"] & F.array_contains(kinds, F.lower(w)),
            F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(
            F.struct(s["n"].alias("n"), F.lit(False).alias("open"))))["n"]

    def drop(words: Column, n: Column) -> Column:
        return F.slice(words, n + 1, F.size(words))

    def after_brand(words: Column) -> Column:
        tail_all = drop(words, F.lit(1))

        def fix(parts: Column) -> Column:
            skipped = leading(parts)
            tail = drop(parts, skipped)
            doubled = F.lower(F.coalesce(F.try_element_at(tail, F.lit(1)), F.lit(""))) == F.lower(words[0])
            technical = F.exists(tail, _is_code)
            kept = F.when(doubled, drop(tail, F.lit(1))).otherwise(tail)
            return F.when((skipped > 0) & (doubled | technical), kept).otherwise(parts)

        return F.array_join(F.concat(F.slice(words, 1, 1), let(tail_all, fix)), " ")

    def clean(words: Column) -> Column:
        def without_kinds(rest: Column) -> Column:
            uncertain = (F.size(rest) < 3) & ~F.exists(rest, _is_code)
            starts_with_kind = F.size(rest) < F.size(words)
            return F.when(starts_with_kind & uncertain, title).otherwise(after_brand(rest))

        return let(drop(words, leading(words)), without_kinds)

    return F.when(title == "", title).otherwise(let(F.split(squeeze(title), " "), clean))


def model_title(title: Column) -> Column:
    """Model without memory, colour, regional code suffix and category label."""
    plain = let(strip_region_suffix(neutral_of_color(title)), base_title)
    return F.coalesce(F.nullif(let(plain, strip_type_words), F.lit("")), title)


def group_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(fold(title), "[^a-zа-я0-9]+", " "))


def _iphone_name(text: Column) -> Column:
    model = F.lower(squeeze(F.regexp_extract(text, v.IPHONE_DISPLAY_MODEL, 1)))

    def name(m: Column) -> Column:
        year = F.regexp_extract(m, r"20\d{2}", 0)
        number = F.regexp_extract(m, r"^\d{1,2}e?", 0)
        tier = F.trim(F.substring(m, F.length(number) + 1, F.lit(100)))
        return (F.when(m.startswith("se"), F.concat(F.lit("SE"), F.when(year != "", F.concat(F.lit(" "), year)).otherwise("")))
                .when(m.isin("x", "xr", "xs", "xs max"), F.upper(m))
                .when(m.isin("air", "duo"), F.initcap(m))
                .when(number != "", F.concat(number, F.when(tier != "", F.concat(F.lit(" "), F.coalesce(lookup(v.IPHONE_TIER_LABELS, F.regexp_replace(tier, r"\s+", " ")), tier))).otherwise(""))))

    return F.when(text.rlike(v.IPHONE_DISPLAY_MODEL), F.concat(F.lit("Apple iPhone "), let(model, name)))


def display_title(title: Column) -> Column:
    """Model wording of a selection screen; the prefix rules run until nothing is left to strip.

    A pass that changes something takes at least a word away, so there is a pass for every word."""
    kind_prefix = rf"(?iU)^{v.PRODUCT_KIND}\s*[:—-]?\s+"
    brand_wrap = rf"(?iU)^([a-zа-я0-9][a-zа-я0-9.+-]*)\s+{v.PRODUCT_KIND}\s+(?:\1\s+)?"
    doubled = r"(?iU)^([a-zа-я0-9][a-zа-я0-9.+-]*)\s+\1\b"

    def stripped(text: Column, _: Column) -> Column:
        text = F.trim(F.regexp_replace(text, kind_prefix, ""))
        text = F.trim(F.regexp_replace(text, brand_wrap, "$1 "))
        return F.trim(F.regexp_replace(text, doubled, "$1"))

    result = F.aggregate(F.split(title, r"\s+"), without_sim(title), stripped)

    def finish(text: Column) -> Column:
        apple = F.regexp_replace(F.regexp_replace(text, r"(?iU)\bapple\b", "Apple"), r"(?iU)\biphone\b", "iPhone")
        cased = F.when(text.rlike(r"(?iU)\b(?:apple|iphone)\b"), F.btrim(squeeze(apple), F.lit(" -/,"))).otherwise(text)

        def cut(t: Column) -> Column:
            def remove(phrase: Column) -> Column:
                bracketed = F.concat(F.lit("("), phrase, F.lit(")"))
                ends = lambda s: F.endswith(F.lower(t), F.lower(s))
                head = lambda s: F.btrim(F.substring(t, F.lit(1), F.length(t) - F.length(s)), F.lit(" -/,"))
                return F.when(ends(bracketed), head(bracketed)).when(ends(phrase), head(phrase)).otherwise(t)

            return F.when(t.rlike(v.ISAI_BLUE), F.btrim(F.regexp_replace(t, v.ISAI_BLUE, ""), F.lit(" -/,"))).otherwise(
                F.coalesce(let(color_phrase(t), lambda p: F.when(p.isNotNull(), remove(p))), t))

        iphone = F.when(text.rlike(r"(?iU)\b(?:apple|iphone)\b"), let(cased, _iphone_name))
        return F.coalesce(iphone, let(cased, cut))

    return let(result, finish)


def trailing_sku(title: Column) -> Column:
    """struct(stem, code) if a store code closes a title that still names a model without it."""
    code = F.regexp_replace(F.lower(F.regexp_extract(title, v.TRAILING_SKU, 1)), "[^a-zа-я0-9]", "")
    stem = F.btrim(F.regexp_replace(title, v.TRAILING_SKU, ""), F.lit(" -/,"))
    words = F.regexp_extract_all(F.lower(stem), F.lit("[a-zа-я0-9]+"), F.lit(0))
    usable = (F.length(code) >= 6) & code.rlike("[a-zа-я]") & code.rlike("[0-9]") & (F.size(words) >= 2)
    return F.when(title.rlike(v.TRAILING_SKU) & usable, F.struct(stem.alias("stem"), code.alias("code")))


def parenthesis_stem(title: Column) -> Column:
    """struct(stem, suffix) if a non-technical closing parenthesis might be a colour."""
    suffix = squeeze(F.regexp_extract(title, r"(?U)\s*\(([^()]*)\)\s*$", 1))
    stem = F.btrim(F.regexp_replace(title, r"(?U)\s*\([^()]*\)\s*$", ""), F.lit(" -/,"))
    usable = ((suffix != "") & (F.length(suffix) <= 40) & ~suffix.rlike(r"(?U)\d")
              & ~suffix.rlike(v.TECHNICAL_PARENTHESIS))
    return F.when(title.rlike(r"\([^()]*\)\s*$") & usable,
                  F.struct(stem.alias("stem"), F.lower(F.regexp_extract(title, r"\(([^()]*)\)\s*$", 1)).alias("suffix")))
