"""Row filters over offers, candidates and queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shelfline.functions import codes, variants
from shelfline.functions import vocabulary as v


def fresh(now: Column, hours: float) -> Column:
    return F.col("updated_at") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))


def filter_fresh(offers: DataFrame, now: Column, hours: float = 24.0) -> DataFrame:
    """Available priced offers with a URL whose update is inside the freshness time."""
    return offers.filter(F.col("available") & F.col("price").isNotNull() & (F.trim(F.col("url")) != "") & fresh(now, hours))


def filter_live_products(products: DataFrame, offers: DataFrame, now: Column, ttl_days: float = 30.0) -> DataFrame:
    """Products with at least one available offer inside the inventory time."""
    live = offers.filter(F.col("available") & fresh(now, ttl_days * 24.0)).select("product_key").distinct()
    return products.join(live, "product_key", "left_semi")


def means_phone(query: Column) -> Column:
    return F.coalesce(query.rlike(v.IPHONE_WORD) & ~query.rlike(v.PHONE_ACCESSORY), F.lit(False))


def relevant(query: Column, title: Column, url: Column) -> Column:
    """A query for the phone itself accepts only new phones with a recognised model."""
    phone = ((variants.condition(title) == "new") & ~title.rlike(v.NOT_NEW) & ~title.rlike(v.PHONE_ACCESSORY)
             & ~F.coalesce(url, F.lit("")).rlike(v.ACCESSORY_URL) & title.rlike(v.IPHONE_MODEL))
    return ~means_phone(query) | phone


def filter_relevant(pairs: DataFrame, query: str = "query") -> DataFrame:
    return pairs.filter(relevant(F.col(query), F.col("title"), F.col("url")))


def filter_query_generation(pairs: DataFrame, request: str = "request_id", query: str = "query") -> DataFrame:
    """Candidates with every generation number of the query; all of them where none has."""
    wanted = codes.generation_numbers(F.col(query))
    fits = F.size(F.array_except(wanted, codes.generation_numbers(F.col("title")))) == 0
    marked = pairs.withColumn("_fits", fits)
    # the fallback flag is one partially aggregated row per request, not a window over its candidates
    any_fits = marked.groupBy(request).agg(F.bool_or("_fits").alias("_any"))
    return marked.join(any_fits, request).filter(F.col("_fits") | ~F.col("_any")).drop("_fits", "_any")


def filter_primary_category(candidates: DataFrame, request: str = "request_id", category: str | None = None) -> DataFrame:
    """Candidates of an explicit category, or of the first ranked candidate's category."""
    if category is not None:
        return candidates.filter(F.col("category") == category)
    first = candidates.groupBy(request).agg(F.min_by("category", "rank").alias("_category"))
    return candidates.join(first, request).filter(F.col("category") == F.col("_category")).drop("_category")


def filter_accessories(pairs: DataFrame, query: str = "query") -> DataFrame:
    """Drop accessories unless the query itself asks for one."""
    return pairs.filter(~codes.is_accessory(codes.core_text(F.col("title"))) | codes.is_accessory(codes.core_text(F.col(query))))


def canonical_url(url: Column, hosts: list[str], path_pattern: str) -> Column:
    """https URL without query, fragment and closing slash if host and path are allowed, else NULL.

    A redirect that carries its target in ``?url=`` is judged by the target.
    """
    target = F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("url"))), url)
    host = F.lower(F.try_parse_url(target, F.lit("HOST")))
    path = F.coalesce(F.try_parse_url(target, F.lit("PATH")), F.lit(""))
    scheme = F.lower(F.try_parse_url(target, F.lit("PROTOCOL")))
    allowed = scheme.isin("http", "https") & path.rlike(path_pattern)
    if hosts:
        allowed = allowed & F.regexp_replace(host, r"^www\.", "").isin(*[h.removeprefix("www.") for h in hosts])
    return F.when(allowed, F.concat(F.lit("https://"), F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")))


def filter_valid_urls(df: DataFrame, hosts: list[str], path_pattern: str = "^/.+", url: str = "url") -> DataFrame:
    return (df.withColumn("canonical_url", canonical_url(F.col(url), hosts, path_pattern))
            .filter(F.col("canonical_url").isNotNull()))


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no builtin for it."""
    return values.str.normalize("NFKC")


def normalize_queries(requests: DataFrame, query: str = "query", min_length: int = 3, max_length: int = 200) -> DataFrame:
    """Add ``normalized`` and ``reason`` (too_short, too_long, no_alphanumeric or NULL)."""
    # control, format, unassigned and private characters go, white space stays until it is squeezed
    visible = F.regexp_replace(nfkc(F.col(query)), r"[\p{C}&&[^\t\n\r]]", "")
    text = F.trim(F.regexp_replace(visible, r"(?U)\s+", " "))
    staged = requests.withColumn("normalized", text)
    length = F.length("normalized")
    reason = (F.when(length < min_length, "too_short").when(length > max_length, "too_long")
              .when(~F.col("normalized").rlike(r"[\p{L}\p{N}]"), "no_alphanumeric"))
    return staged.withColumn("reason", reason)


def is_broad_query(query: Column) -> Column:
    """One or two words and no digit: a category has to be chosen first."""
    words = F.size(F.regexp_extract_all(F.lower(query), F.lit("[a-zа-яё0-9]+"), F.lit(0)))
    return words.between(1, 2) & ~query.rlike(r"(?U)\d")


def filter_challenge_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Drop anti-bot pages before extraction."""
    # fixed values: both marks together identify a verification page
    challenge = F.contains(html, F.lit("<title>Verification</title>")) & F.contains(html, F.lit("hg-security="))
    return pages.filter(~F.coalesce(challenge, F.lit(False)))


def dedupe_candidates(candidates: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """First candidate per key by an explicit order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return candidates.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def distinct_seeds(seeds: DataFrame, requested: DataFrame) -> DataFrame:
    """Seed queries, then requested ones, each text once at its first place."""
    both = seeds.select("query", F.lit(0).alias("part"), F.col("position")).unionByName(
        requested.select("query", F.lit(1).alias("part"), F.col("position")))
    return both.groupBy("query").agg(F.min(F.struct("part", "position")).alias("place")).select(
        "query", "place.part", "place.position")
