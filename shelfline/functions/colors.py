"""Colour columns: pattern keys, alias identities, labels and colour-free titles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfline.functions import vocabulary as v
from shelfline.functions.text import first_match, fold, let, lookup, sql_text, squeeze

_EDGES = "()[]{}.,;:-_/ "
_KEY_TABLE = [(name, rf"(?iU)\b(?:{words})\b") for name, words in v.COLOR_KEY_WORDS]
_FALLBACK_TABLE = [(name, rf"(?iU)\b(?:{words})\b") for name, words in v.COLOR_FALLBACK_WORDS]
_ANY_KEY = r"(?iU)\b(?:" + "|".join(words for _, words in v.COLOR_KEY_WORDS) + r")\b"
_ANY_COLOR = r"(?iU)\b(?:" + "|".join(w for _, w in v.COLOR_KEY_WORDS + v.COLOR_FALLBACK_WORDS) + r")\b"
_TRAILING = r"\(([^()]*)\)\s*$"

IDENTITY_TYPE = "struct<family:string,variant:string,confidence:string>"


def _trailing(title: Column) -> Column:
    """Text of a closing parenthesis, NULL without one."""
    return F.when(title.rlike(_TRAILING), F.trim(F.regexp_extract(title, _TRAILING, 1)))


def pattern_key(x: Column) -> Column:
    """One cheap test rules out texts without any colour word."""
    return F.when(x.rlike(_ANY_KEY), first_match(x, _KEY_TABLE))


def plain_color(x: Column) -> Column:
    """Colour of a text without closing parenthesis: keys first, then the wider vocabulary."""
    return F.when(x.rlike(_ANY_COLOR), first_match(x, _KEY_TABLE + _FALLBACK_TABLE))


def explicit_color(title: Column) -> Column:
    inside = _trailing(title)
    return F.when(inside.rlike(_ANY_KEY), inside)


def display_color(title: Column) -> Column:
    """Marketing or official label of the colour in the closing parenthesis."""

    def label(color: Column) -> Column:
        plain = squeeze(F.regexp_replace(fold(color), "[–—]", "-"))
        official = [F.when(title.rlike(model), lookup(labels, plain)) for model, labels in v.OFFICIAL_COLOR_LABELS]
        parts = F.transform(F.split(color, "/"), lambda p: F.trim(p))
        translated = F.array_join(
            F.transform(parts, lambda p: F.coalesce(lookup(v.COLOR_LABELS, squeeze(F.lower(p))), p)), "/")
        return F.when(color.rlike("(?i)[a-z]"), color).otherwise(
            F.coalesce(*official, lookup(v.COLOR_LABELS, plain), F.when(F.size(parts) > 1, translated), color))

    return F.when(explicit_color(title).isNotNull(), let(explicit_color(title), label))


def color_key(title: Column) -> Column:
    """Colour key: closing parenthesis first, else the whole title."""

    def named(color: Column) -> Column:
        slug = F.btrim(F.regexp_replace(F.lower(color), "[^a-z0-9]+", "_"), F.lit("_"))
        return F.coalesce(let(F.coalesce(display_color(title), color), pattern_key), F.concat(F.lit("name:"), slug))

    return F.when(
        title.rlike(_ANY_KEY),
        F.when(explicit_color(title).isNotNull(), let(explicit_color(title), named)).otherwise(pattern_key(title)))


def requested_color(title: Column) -> Column:
    """Colour key, or the wider fallback vocabulary."""
    return F.when(title.rlike(_ANY_COLOR),
                  F.coalesce(color_key(title), F.when(title.rlike(_ANY_COLOR), first_match(title, _FALLBACK_TABLE))))


def _closing_words(words: Column, width: Column) -> Column:
    return F.array_join(F.slice(words, F.size(words) - width + 1, width), " ")


def color_suffix_width(title: Column) -> Column:
    """How many closing words of a squeezed title name its colour; NULL if none do."""

    def measure(words: Column) -> Column:
        full = plain_color(title)

        def fits(width: Column) -> Column:
            phrase = F.btrim(_closing_words(words, width), F.lit(_EDGES))
            return (phrase != "") & ~phrase.rlike(r"(?U)\d") & (let(phrase, plain_color) == full)

        start = F.filter(F.sequence(F.lit(1), F.least(F.lit(4), F.size(words) - 1)), fits)

        def extend(state: Column, width: Column) -> Column:
            before = F.btrim(words[F.size(words) - width], F.lit(_EDGES))
            joins = ((state["open"]) & (width == state["width"] + 1) & before.rlike(v.COLOR_DESCRIPTOR)
                     & ~before.rlike(r"(?U)\d") & (let(_closing_words(words, width), plain_color) == full))
            past = width <= state["width"]
            return F.struct(F.when(joins, width).otherwise(state["width"]).alias("width"),
                            (past | F.coalesce(joins, F.lit(False))).alias("open"))

        grown = let(start, lambda found: F.when(F.size(found) > 0, F.aggregate(
            F.sequence(F.lit(1), F.size(words)),
            F.struct(found[0].alias("width"), F.lit(True).alias("open")), extend)["width"]))
        last = F.btrim(words[F.size(words) - 1], F.lit(_EDGES))
        return F.when((F.size(words) > 1) & last.rlike(_ANY_COLOR), grown)

    return F.when(title.rlike(_ANY_COLOR), let(F.split(title, " "), measure))


def neutral_of_color(title: Column) -> Column:
    """Title without its closing colour; colour words inside the model stay."""

    def strip(text: Column) -> Column:
        in_parenthesis = F.when(text.rlike(_TRAILING), let(F.regexp_extract(text, _TRAILING, 1), plain_color))
        without_parenthesis = F.btrim(F.regexp_replace(text, r"\s*\([^()]*\)\s*$", ""), F.lit(" -/,"))
        words = F.split(text, " ")
        rest = let(color_suffix_width(text), lambda width: F.when(width.isNotNull(), F.btrim(
            F.array_join(F.slice(words, F.lit(1), F.size(words) - width), " "), F.lit(" -/,"))))
        return F.when(in_parenthesis.isNotNull(), without_parenthesis).otherwise(
            F.coalesce(F.nullif(rest, F.lit("")), text))

    return let(squeeze(title), lambda text: F.when(text.rlike(_ANY_COLOR), strip(text)).otherwise(text))


def _alias_map() -> Column:
    entries = ", ".join(
        f"'{alias}', named_struct('family', '{family}', 'variant', '{variant}', 'confidence', '{confidence}')"
        for alias, family, variant, confidence in v.color_aliases())
    return F.expr(f"map({entries})")


def alias_form(x: Column) -> Column:
    return F.trim(F.regexp_replace(fold(x), "[^0-9a-zа-я]+", " "))


def color_of_phrase(phrase: Column) -> Column:
    return F.try_element_at(_alias_map(), alias_form(phrase))


def color_phrase(title: Column) -> Column:
    """The explicit colour wording: after the memory of a phone, in a closing parenthesis, or closing words."""

    def find(text: Column) -> Column:
        after_memory = F.when(
            text.rlike(v.PHONE_WORDS), F.nullif(F.regexp_extract(text, r"(?iU)\d+\s*(?:GB|TB|ГБ|ТБ)\s+(.+)$", 1), F.lit("")))
        suffix = F.btrim(without_sim(after_memory), F.lit(" ()"))
        as_suffix = let(suffix, lambda s: F.when(
            (s != "") & (F.length(s) <= 40) & ~s.rlike(r"(?U)[\d,;+()/]") & ~s.rlike(v.TECHNICAL_SUFFIX)
            & ~s.rlike(v.NOT_A_COLOR_SUFFIX), s))
        as_parenthesis = let(_trailing(text), lambda p: F.when(
            color_of_phrase(p).isNotNull()
            | ((alias_form(p) != "") & (F.length(p) <= 40) & ~p.rlike(r"(?U)\d") & ~p.rlike("[,;+]")
               & ~p.rlike(v.TECHNICAL_SUFFIX)), p))
        words = F.split(text, " ")

        def closing(width: int) -> Column:
            phrase = F.btrim(_closing_words(words, F.lit(width)), F.lit(_EDGES))
            return F.when(F.size(words) >= width,
                          let(phrase, lambda p: F.when(color_of_phrase(p).isNotNull(), p)))

        as_words = F.coalesce(*[closing(w) for w in range(v.LONGEST_COLOR_ALIAS, 0, -1)])
        return F.coalesce(as_suffix, F.when(text.rlike(_TRAILING), as_parenthesis).otherwise(as_words))

    return let(squeeze(title), find)


def color_identity(title: Column) -> Column:
    """struct(family, variant, confidence); an explicit unknown phrase keeps its own name."""

    def identify(phrase: Column) -> Column:
        unknown = F.struct(F.lit("unknown").alias("family"),
                           F.concat(F.lit("name:"), F.replace(alias_form(phrase), F.lit(" "), F.lit("_"))).alias("variant"),
                           F.lit("unknown").alias("confidence"))
        return F.when(phrase.isNotNull(), F.coalesce(color_of_phrase(phrase), unknown))

    return let(color_phrase(title), identify)


def normalize_color(text: Column) -> Column:
    """Strongest colour in free text: the alias that ends last, exact before base, longer before shorter."""
    padded = F.concat(F.lit(" "), alias_form(text), F.lit(" "))

    # distance from the end is the position in the reversed text
    hits = ", ".join(
        f"CASE WHEN locate('{f' {alias} '[::-1]}', reverse(p)) > 0 THEN named_struct("
        f"'ends', length(p) - locate('{f' {alias} '[::-1]}', reverse(p)), 'exact', {int(confidence == 'exact_variant')}, "
        f"'words', {len(alias.split())}, 'family', '{family}', 'variant', '{variant}', 'confidence', '{confidence}') END"
        for alias, family, variant, confidence in v.color_aliases())

    def score(p: Column) -> Column:
        found = F.call_function("transform", F.array(p), F.expr(f"p -> array_max(array_compact(array({hits})))"))[0]
        return let(found, lambda best: F.when(best.isNotNull(), F.struct(
            best["family"].alias("family"), best["variant"].alias("variant"), best["confidence"].alias("confidence"))))

    return let(padded, score)


def identities_match(requested: Column, candidate: Column) -> Column:
    """Asymmetric: a base colour accepts every known variant of its family, not the reverse."""
    same_variant = (requested["confidence"] == candidate["confidence"]) & (requested["variant"] == candidate["variant"])
    base = (candidate["confidence"] != "unknown") & (requested["family"] == candidate["family"])
    return F.when(requested["confidence"].isin("unknown", "exact_variant"), same_variant).otherwise(base)


def match_colors(requested: Column, candidate: Column) -> Column:
    """Colour texts match; no request matches everything, an unrecognised colour nothing."""
    hit = let(F.struct(normalize_color(requested).alias("r"), normalize_color(candidate).alias("c")),
              lambda s: identities_match(s["r"], s["c"]))
    return F.when(F.coalesce(requested, F.lit("")) == "", F.lit(True)).otherwise(F.coalesce(hit, F.lit(False)))


def marketing_key(title: Column) -> Column:
    """Key of the explicit colour wording: the variant, or the family of a base colour."""
    return let(color_identity(title), lambda c: F.when(c["confidence"] == "base_color", c["family"]).otherwise(c["variant"]))


def without_sim(title: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(title, v.SIM_WORDS, " "), r"(?U)\(\s*\)", " ")
    return F.btrim(squeeze(bare), F.lit(" ,-/"))


def _caption(x: Column) -> Column:
    text = squeeze(F.btrim(x, F.lit(_EDGES)))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))


def color_label(title: Column) -> Column:
    """Readable colour label of a card."""
    trailing = F.when(title.rlike(_TRAILING), F.regexp_extract(title, _TRAILING, 1))
    in_parenthesis = F.when(let(trailing, plain_color).isNotNull(), _caption(trailing))
    words = F.split(title, " ")
    in_suffix = let(color_suffix_width(title), lambda w: F.when(w.isNotNull(), _caption(_closing_words(words, w))))
    found = ", ".join(f"nullif(regexp_extract(x, {sql_text(pattern)}, 0), '')" for _, pattern in _FALLBACK_TABLE)
    inside = F.call_function("transform", F.array(title), F.expr(f"x -> coalesce({found})"))[0]
    return F.when(title.rlike(_ANY_COLOR), F.coalesce(display_color(title), in_parenthesis, in_suffix, _caption(inside)))


def selection_color_key(title: Column) -> Column:
    """Colour key for choices: exact and unknown marketing colours stay apart."""
    marketing = let(color_identity(title), lambda c: F.when(c["confidence"].isin("exact_variant", "unknown"), c["variant"]))
    return F.coalesce(marketing, F.when(title.rlike(v.ISAI_BLUE), F.lit("isai_blue")), requested_color(title))


def selection_color_label(title: Column) -> Column:
    phrase = let(color_phrase(title), lambda p: F.when(p.isNotNull() & color_of_phrase(p).isNull(), p))
    return F.when(title.rlike(v.ISAI_BLUE), F.lit("Isai Blue")).otherwise(F.coalesce(phrase, color_label(title)))
