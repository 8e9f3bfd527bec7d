"""String normal forms and parsers as native columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from shelfline.functions import vocabulary as v


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps nested expressions small."""
    return F.transform(F.array(value), body)[0]


def sql_text(value: str) -> str:
    """A raw SQL string literal."""
    return "r'" + value + "'"


def first_match(value: Column, table: list[tuple[str, str]]) -> Column:
    """Name of the first pattern found in the value, NULL if none."""
    # one parsed lambda instead of a Column call per pattern: planning stays short
    branches = " ".join(f"WHEN x RLIKE {sql_text(pattern)} THEN '{name}'" for name, pattern in table)
    return F.call_function("transform", F.array(value), F.expr(f"x -> CASE {branches} END"))[0]


def lookup(table: dict[str, str], key: Column) -> Column:
    entries = ", ".join(f"'{k}', '{name}'" for k, name in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)


def word_list(words: list[str]) -> Column:
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def fold(x: Column) -> Column:
    """Lower case with ё as е; the normal form of all matching."""
    return F.translate(F.lower(x), "ё", "е")


def norm_compact(x: Column) -> Column:
    return F.nullif(F.regexp_replace(fold(x), "[^a-zа-я0-9]+", ""), F.lit(""))


def norm_words(x: Column) -> Column:
    return F.trim(F.regexp_replace(fold(x), "[^a-zа-я0-9]+", " "))


def norm_phrase(x: Column) -> Column:
    """Identity text: letters, digits and the signs ``. + -`` kept."""
    return F.nullif(squeeze(F.regexp_replace(fold(x), "[^a-zа-я0-9.+-]+", " ")), F.lit(""))


def norm_identifier(x: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(x), "[^a-z0-9]+", ""), F.lit(""))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(fold(x), F.lit("[a-zа-я0-9]+"), F.lit(0))


def text_or_null(x: Column) -> Column:
    return F.nullif(squeeze(x), F.lit(""))


def source_key(x: Column) -> Column:
    return F.lower(F.trim(x))


def strip_region_suffix(x: Column) -> Column:
    return F.regexp_replace(x, v.REGIONAL_CODE_SUFFIX, "$1")


def cross_source_query(title: Column) -> Column:
    bare = F.regexp_replace(title, r"\([^()]*\)", " ")
    bare = F.regexp_replace(bare, r"(?iU)\bSM-[A-Z0-9-]+\b", " ")
    return squeeze(F.replace(bare, F.lit("/"), F.lit(" ")))


def slug_title(slug: Column) -> Column:
    words = F.split(squeeze(F.replace(F.try_url_decode(F.replace(slug, F.lit("+"), F.lit("%2B"))), F.lit("-"), F.lit(" "))), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(lookup(v.SLUG_WORDS, F.lower(w)), w)), " ")


def index_norm(x: Column) -> Column:
    """Words with letters and digits separated, memory units joined back to their number."""
    decoded = F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    text = F.regexp_replace(fold(decoded), "[^a-zа-я0-9]+", " ")
    text = F.regexp_replace(text, r"([a-zа-я])(\d)", "$1 $2")
    text = F.regexp_replace(text, r"(\d)([a-zа-я])", "$1 $2")
    return squeeze(F.regexp_replace(text, rf"(?U)\b(\d+)\s+({v.UNIT})\b", "$1$2"))


def parse_price(x: Column) -> Column:
    """Shop price text to DOUBLE: spaces dropped, comma or last dot is the decimal sign."""
    digits = F.regexp_replace(F.regexp_replace(x, r"(?U)[\s  ]+", ""), ",", ".")
    number = F.regexp_extract(digits, r"\d[\d.]*", 0)
    number = F.regexp_replace(number, r"\.(?=.*\.)", "")
    return number.try_cast("double")


def finite(price: Column) -> Column:
    """NaN and both infinities are no price."""
    return price.isNotNull() & ~F.isnan(price) & (F.abs(price) != float("inf"))


#: ISO-8601 calendar and week dates, extended and basic; then any one character, a time, and an offset.
ISO_DATE = r"\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?"
ISO_TIME = r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?"
ISO_OFFSET = r"Z|[+-]\d{2}(?::\d{2}(?::\d{2})?)?|[+-]\d{4}(?:\d{2})?"
ISO_MOMENT = rf"(?s)^({ISO_DATE})(?:.({ISO_TIME})({ISO_OFFSET})?)?$"


def _digits(x: Column, first: int, count: int) -> Column:
    return F.nullif(F.substring(x, first, count), F.lit("")).try_cast("int")


def _iso_date(plain: Column) -> Column:
    """Date of a calendar or week date without dashes."""
    week, day = _digits(plain, 6, 2), F.coalesce(_digits(plain, 8, 1), F.lit(1))
    monday = F.to_date(F.date_trunc("week", F.concat(F.left(plain, F.lit(4)), F.lit("-01-04")).try_cast("timestamp_ntz")))
    found = F.date_add(monday, (week - 1) * 7 + day - 1)
    # the week has to exist in its year
    exists = week.between(1, 53) & day.between(1, 7) & (F.extract(F.lit("WEEK"), found) == week)
    return F.when(plain.contains("W"), F.when(exists, found)).otherwise(
        F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2)).try_cast("date"))


def _iso_time(time: Column) -> Column:
    """Time as HH:MM:SS.ffffff; what is not given is zero, further digits of a fraction are cut."""
    clock = F.split(F.replace(time, F.lit(","), F.lit(".")), r"\.")
    hms = F.rpad(F.replace(clock[0], F.lit(":")), 6, "0")
    fraction = F.rpad(F.left(F.coalesce(F.try_element_at(clock, F.lit(2)), F.lit("")), F.lit(6)), 6, "0")
    return F.concat(F.substring(hms, 1, 2), F.lit(":"), F.substring(hms, 3, 2), F.lit(":"), F.substring(hms, 5, 2), F.lit("."), fraction)


def _iso_offset(offset: Column) -> Column:
    plain = F.rpad(F.replace(F.replace(F.substring(offset, 2, 8), F.lit(":")), F.lit("Z")), 6, "0")
    hours, minutes, seconds = (_digits(plain, at, 2) for at in (1, 3, 5))
    east = F.when((hours < 24) & (minutes < 60) & (seconds < 60), F.make_dt_interval(F.lit(0), hours, minutes, seconds))
    return F.when(offset.startswith("-"), -east).otherwise(east)


def parse_timestamp(x: Column) -> Column:
    """ISO-8601 text to TIMESTAMP; text without zone is UTC."""
    parts = F.struct(*[F.regexp_extract(x, ISO_MOMENT, group).alias(name) for group, name in ((1, "day"), (2, "time"), (3, "offset"))])

    def moment(p: Column) -> Column:
        written = F.concat(_iso_date(F.replace(p["day"], F.lit("-"))).cast("string"), F.lit(" "), _iso_time(p["time"]), F.lit("+00:00"))
        return F.when(p["day"] != "", written.try_cast("timestamp") - _iso_offset(p["offset"]))

    # the parts are bound once; written out, every use would match the pattern again
    return F.transform(F.array(parts), moment)[0]


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "dd.MM.yyyy HH:mm")


def external_id(url: Column, source: Column | None = None, title: Column | None = None,
                seller: Column | None = None) -> Column:
    """First 24 hex digits of the hashed URL; without URL of source, title and seller."""
    address = F.lower(F.trim(url))
    parts = [F.coalesce(F.lower(F.trim(c)), F.lit("")) for c in (source, title, seller) if c is not None]
    payload = F.when(address != "", address)
    if parts:
        payload = F.coalesce(payload, F.concat_ws("|", *parts))
    return F.substring(F.sha2(payload, 256), 1, 24)


def natural_key(x: Column) -> Column:
    """Sort key in which digit runs compare as numbers and rank above text."""
    runs = F.regexp_extract_all(fold(x), F.lit(r"(?U)\d+|\D+"), F.lit(0))
    return F.transform(runs, lambda t: F.when(
        t.rlike(r"(?U)^\d+$"),
        # of two numbers without leading zeros the longer is larger, whatever their length
        F.struct(F.lit(1).alias("kind"), F.char_length(F.ltrim(t, F.lit("0"))).alias("digits"), F.ltrim(t, F.lit("0")).alias("text")),
    ).otherwise(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("digits"), squeeze(t).alias("text"))))
