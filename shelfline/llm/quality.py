"""Quality rules: fixed base rules, then robust multivariate outliers per language and source (native).

Method. Every text gives a vector of transformed statistics (log of the mean word length, log of one plus symbols per word, share of
repeated lines, share of words in repeated 3-word windows). For each stratum (language and source) the minimum covariance determinant
estimate of location and scatter is searched: from two starts (a median and MAD ball; the classical estimate) concentration steps keep
the `SHARE` of rows nearest by Mahalanobis distance and estimate again, in every stratum until its own determinant stops falling; only
strata that have not settled take part in the next step. The start with the smaller determinant wins. The scatter is made consistent
for the normal distribution, and `FLOOR` keeps statistics that hardly vary from rejecting small deviations. A text is rejected if its squared distance exceeds the `CUTOFF` quantile of chi-squared.

Quantiles are taken over distances rounded to a grid: equal values are counted before the shuffle, a group of any size needs a table
of bounded size, and the result does not depend on the order of rows. Everything per stratum is one row with numbers; the texts are
read once and never shuffled.

Strata with fewer than `LEAST_ROWS` texts that pass the base rules use the estimate of their language, and languages with fewer that
of the whole corpus.

Defined results: null and empty texts have no words and fail the base rules; a null language or source forms strata of its own;
repeated rows are judged each and alike; an empty table gives an empty result; other columns are kept or ignored by the caller.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from shelfline.llm.common import stored, words_of
from shelfline.session import evaluate_once

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
WITH_WORD = r"[^\x20\x09-\x0D]"

STATS = ["x1", "x2", "x3", "x4"]
#: Least standard deviation of each statistic. x3 stays below 1 and x4, after the base rules, at 0.5 or less: a tenth of that, so that each
#: of them alone can exceed the cutoff. x1 and x2 have no upper limit.
FLOOR = (0.07, 0.05, 0.1, 0.05)
SHARE = 0.75
#: Quantiles of chi-squared with four degrees of freedom.
CHI2_SHARE = 5.3853  # 0.75
CUTOFF = 23.5127  # 0.9999
LEAST_ROWS = 100
#: Up to so many strata their estimates (a few hundred bytes each) are broadcast.
FEW_STRATA = 10_000


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns as the struct `row`, lang, source, and the base statistics of the text."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: line.rlike(WITH_WORD))
    rows = docs.select(F.struct(*keep).alias("row"), F.col("lang").alias("lang"), F.col("source").alias("source"),
                       F.coalesce("text", F.lit("")).alias("text"))
    cut = evaluate_once(rows, ["row", "lang", "source"], {
        "words": words_of(F.col("text")), "lines": lines, "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long")})
    hashed = evaluate_once(cut, ["row", "lang", "source", "n_symbols"], {
        "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")})
    counts = ["row", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    # a window is a position; its hash covers the hashes of three words
    places = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).otherwise(F.array().cast("array<int>"))
    windows = evaluate_once(hashed, [*counts, "hashes"], {
        "windows": F.transform(places, lambda i: F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), F.get("hashes", i + 2)))})
    # low bits: position; high bits: as much of the hash as fits. Sorted, equal windows are neighbours.
    low = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_words") + 1))).cast("long")
    doubled = F.size(F.array_distinct("windows")) < F.size("windows")
    packed = F.sort_array(F.transform("windows", lambda h, i: h.bitwiseAND(-low).bitwiseOR(i.cast("long"))))
    ordered = evaluate_once(windows, [*counts, "windows"], {"low": low, "packed": F.when(doubled, packed).otherwise(F.array().cast("array<bigint>"))})

    def same(a: Column, b: Column) -> Column:
        at = lambda x: F.get("windows", x.bitwiseAND(F.col("low") - 1).cast("int"))
        return F.coalesce(at(a) == at(b), F.lit(False))

    found = evaluate_once(ordered, counts, {"repeats": F.sort_array(F.transform(
        F.filter("packed", lambda x, k: same(x, F.get("packed", k - 1)) | same(x, F.get("packed", k + 1))),
        lambda x: x.bitwiseAND(F.col("low") - 1)))})
    # each repeated window covers three words, less those that the window before covers too
    covered = F.aggregate("repeats", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
                          lambda acc, p: F.struct((acc.n + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n"), p.alias("last")))["n"]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return found.select(*counts, covered.alias("n_repeat_words")).withColumn("base_failed", failed)


def with_vector(rows: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return rows.withColumns({
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "x2": F.log1p(F.col("n_symbols") / words),
        "x3": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "x4": F.col("n_repeat_words") / words})


def strata(rows: DataFrame) -> DataFrame:
    """lang, source, stratum: the finest level with enough rows. One row per language and source."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    by_lang = sizes.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("n_lang"))
    joined = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("of_lang")))
    name = (F.when(F.col("n") >= LEAST_ROWS, F.to_json(F.struct("lang", "source")))
            .when(F.col("n_lang") >= LEAST_ROWS, F.to_json(F.struct(F.col("lang").alias("all_of"))))
            .otherwise(F.lit("all")))
    return joined.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), name.alias("stratum"))


PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
ESTIMATE = [*[f"m{i}" for i in range(4)], *[f"s{i}{j}" for i, j in PAIRS]]


def estimates(rows: DataFrame) -> DataFrame:
    """rows (stratum, start, x1..x4): mean and covariance per stratum and start."""
    return rows.groupBy(F.col("stratum").alias("e_stratum"), F.col("start").alias("e_start")).agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(STATS)], *[F.covar_pop(STATS[i], STATS[j]).alias(f"s{i}{j}") for i, j in PAIRS])


def factored(found: DataFrame, scale: float = 1.0) -> DataFrame:
    """estimates with the Cholesky factor of the scatter and its log determinant."""
    for i, j in PAIRS:  # row by row
        value = F.col(f"s{i}{j}") * scale + (FLOOR[i] ** 2 if i == j else 0.0)
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        found = found.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}"))
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(4)), F.lit(0.0)) * 2
    return found.withColumn("logdet", F.round(logdet, 9))


def squared_distance() -> Column:
    """Mahalanobis distance by forward substitution, from the columns of `estimates`."""
    y: list[Column] = []
    for i, x in enumerate(STATS):
        value = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * y[k]
        y.append(value / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def on_grid(value: Column, steps: int = 1000) -> Column:
    return F.floor(F.log1p(value) * steps)


def per_stratum(table: DataFrame, few: bool) -> DataFrame:
    """A table of one row per stratum and start, to be joined to rows: sent to the workers if the strata are few, so that a stratum
    with a large share of the rows is not dealt to one task; otherwise Spark chooses."""
    return F.broadcast(table) if few else table


def nearest(rows: DataFrame, distance: Column, few: bool) -> DataFrame:
    """The share of rows of each stratum and start with the smallest distance; ties at the limit are all kept."""
    graded = rows.withColumn("grade", on_grid(distance))
    limits = graded.groupBy(F.col("stratum").alias("q_stratum"), F.col("start").alias("q_start")).agg(F.percentile("grade", SHARE).alias("limit"))
    return graded.join(per_stratum(limits, few), (F.col("stratum") == F.col("q_stratum")) & (F.col("start") == F.col("q_start"))).filter(
        F.col("grade") <= F.col("limit"))


def by_estimate(rows: DataFrame, found: DataFrame, few: bool) -> DataFrame:
    return rows.join(per_stratum(found, few), (F.col("stratum") == F.col("e_stratum")) & (F.col("start") == F.col("e_start")))


def minimum_covariance(rows: DataFrame, few: bool) -> DataFrame:
    """rows (stratum, x1..x4): the estimate of every stratum, as in `factored` with consistent scatter."""
    # medians of values on a grid: the table of distinct values stays small
    grid = lambda c: F.round(F.col(c), 3)
    centre = rows.groupBy("stratum").agg(*[F.percentile(grid(x), 0.5).alias(f"c{i}") for i, x in enumerate(STATS)]).withColumnRenamed("stratum", "c_stratum")
    off = rows.join(per_stratum(centre, few), F.col("stratum") == F.col("c_stratum"))
    spread = off.groupBy("stratum").agg(*[F.percentile(F.round(F.abs(F.col(x) - F.col(f"c{i}")), 3), 0.5).alias(f"d{i}") for i, x in enumerate(STATS)]).withColumnRenamed("stratum", "d_stratum")
    off = off.join(per_stratum(spread, few), F.col("stratum") == F.col("d_stratum"))
    ball = sum((((F.col(x) - F.col(f"c{i}")) / (F.col(f"d{i}") * 1.4826 + FLOOR[i])) ** 2 for i, x in enumerate(STATS)), F.lit(0.0))
    robust = nearest(off.withColumn("start", F.lit(0)), ball, few).select("stratum", "start", *STATS)
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    found = factored(estimates(robust.unionByName(both.filter("start = 1").select("stratum", "start", *STATS))))
    # neither start is a subset of nearest rows yet, so the first step is taken in any case
    found = stored(found.withColumns({"logdet": F.lit(math.inf), "falls": F.lit(True)}), "mcd")
    columns = found.columns
    while True:  # a step is taken only while determinants fall, and there are finitely many subsets, so this ends
        falling = found.filter("falls")
        stepped = factored(estimates(nearest(by_estimate(both, falling, few), squared_distance(), few).select("stratum", "start", *STATS)))
        old = falling.select(*[F.col(c).alias(f"old_{c}") for c in columns])
        joined = old.join(stepped, (F.col("old_e_stratum") == F.col("e_stratum")) & (F.col("old_e_start") == F.col("e_start")))
        fell = F.col("logdet") < F.col("old_logdet")
        taken = joined.select(*[F.when(fell, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in columns if c != "falls"], fell.alias("falls"))
        found = stored(found.filter("NOT falls").unionByName(taken), "mcd")
        if found.filter("falls").isEmpty():
            break
    best = found.groupBy("e_stratum").agg(F.min(F.struct("logdet", "e_start", *ESTIMATE)).alias("best")).select("e_stratum", "best.e_start", *[f"best.{c}" for c in ESTIMATE])
    half = CHI2_SHARE / 2
    consistency = SHARE / (1 - math.exp(-half) * (1 + half + half * half / 2))
    return stored(factored(best, consistency), "mcd")


def judge_quality(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per document: `row` (the keep columns), base statistics, base_failed, distance (squared) and kept."""
    rows = stored(with_vector(text_statistics(docs, keep)), "quality")
    names = stored(strata(rows), "strata")
    few = names.count() <= FEW_STRATA
    named = rows.join(per_stratum(names, few), F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")))
    passing = named.filter(~F.col("base_failed"))
    # strata that stand for a language or for the corpus are estimated from all of it
    levels = F.array_distinct(F.array(F.col("stratum"), F.to_json(F.struct(F.col("lang").alias("all_of"))), F.lit("all")))
    wanted = names.select(F.col("stratum").alias("wanted")).distinct()
    fit = passing.select(F.explode(levels).alias("stratum"), *STATS).join(wanted, F.col("stratum") == F.col("wanted"), "left_semi")
    found = minimum_covariance(stored(fit, "fit"), few)
    judged = named.join(per_stratum(found, few), F.col("stratum") == F.col("e_stratum"), "left").withColumn("distance", squared_distance())
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))
