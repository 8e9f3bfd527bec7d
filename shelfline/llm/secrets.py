"""Secret scans with a random forest that removes false findings (native).

Method. Candidates are runs of key characters with at least one digit, anywhere in the whole text, and whatever is assigned to a
credential word, of any characters and length. Each gets features: length, shares of
character classes, transitions between classes, distinct characters, coverage by dictionary words, path shape, and the neighbouring
words and signs. Findings with a known outcome (formats that providers publish; plain numbers, UUIDs, addresses and paths) label a
bounded, reproducible sample of at most about `LABELLED` candidates, from which a random forest is trained with Spark ML. The forest
then judges every candidate by its features alone; those below `THRESHOLD` are dropped as false.

The dictionary holds every word that all documents together have `LEAST_COUNT` times or more outside their candidates. It grows with the
corpus, is counted in each task before the shuffle and stays a table that is joined.

Defined results: null and empty texts have no candidates; repeated rows have the same findings each; a table without candidates, or
whose labelled candidates are all of one kind, is judged by the labels alone (unlabelled candidates count as false); an empty table
gives an empty result; positions are 1-based characters; other columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from shelfline.llm.common import stored, uniform

KEY = r"[A-Za-z0-9+/_\-]"
CREDENTIAL_WORD = r"(?:pass(?:word|wd|phrase)?|secret|token|api.?key|access.?key|private.?key|credential|auth)"
#: A value after a credential word: within quotes all of it, otherwise up to white space, a quote or a closing full stop, comma or semicolon.
#: The short look-behinds come first, as they refuse most places.
VALUE = (rf"(?<=[=:\s\"'])(?<=[=:]\s{{0,4}}[\"']?)(?<=(?i:{CREDENTIAL_WORD})[\"']?\s{{0,4}}[=:]{{1,3}}\s{{0,4}}[\"']?)"
         r"(?:(?<=\")[^\"\r\n]+(?=\")|(?<=')[^'\r\n]+(?=')|[^\s\"'<>=:][^\s\"'<>]*(?<![.,;]))")
CANDIDATE = rf"{VALUE}|(?<!{KEY})(?=[A-Za-z+/_\-]*[0-9]){KEY}{{10,}}={{0,2}}"
BEFORE, AFTER = 48, 16
LABELLED = 20_000
#: A letter run that occurs once in the whole corpus is no word.
LEAST_COUNT = 2
THRESHOLD = 0.5
MASK = "[SECRET]"
TREES, DEPTH, SEED = 30, 6, 11

#: Published formats of access keys and tokens.
KNOWN_FORMATS = r"^(A(KI|SI)A[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"
CREDENTIAL = rf"(?i){CREDENTIAL_WORD}[\"']?\s*[=:]+\s*[\"']?$"
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
FEATURES = ["length", "digits", "upper", "lower", "hex", "transitions", "distinct", "vowels", "dictionary", "slashes", "in_path",
            "credential", "assigned", "quoted", "address"]


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, digest (of id and text), k (its number in the text), start, candidate, before, after."""
    text = F.coalesce("text", F.lit(""))
    digest = F.xxhash64("doc_id", "text")
    cut = docs.select("doc_id", digest.alias("digest"), text.alias("text")).filter(F.col("text").rlike(CANDIDATE)).distinct()
    cut = cut.select("doc_id", "digest", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("gaps"))
    lengths = lambda a: F.transform(a, lambda x: F.char_length(x))
    cut = cut.withColumns({"gap_chars": lengths("gaps"), "found_chars": lengths("found")})
    rows = cut.select("doc_id", "digest", "gaps", "gap_chars", "found_chars", F.posexplode("found").alias("k", "candidate"))
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda x, y: x + y)
    return rows.select("doc_id", "digest", "k", (total("gap_chars", F.col("k") + 1) + total("found_chars", F.col("k")) + 1).alias("start"), "candidate",
                       F.right(F.get("gaps", F.col("k")), F.lit(BEFORE)).alias("before"), F.left(F.get("gaps", F.col("k") + 1), F.lit(AFTER)).alias("after"))


def dictionary(docs: DataFrame) -> DataFrame:
    """word: words of at least four letters over all documents, counted outside candidates, so that no secret vouches for itself."""
    text = F.regexp_replace(F.col("text"), CANDIDATE, " ")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT).select("word")


def share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.col("length")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    change = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    flag = lambda c: c.cast("double")
    rows = found.withColumn("length", F.char_length("candidate").cast("double")).withColumns({
        "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "hex": share("[0-9a-f]"), "vowels": share("[aeiouAEIOU]"),
        "transitions": share(change), "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.col("length"),
        "slashes": share("/"), "in_path": flag(F.col("before").rlike(r"[./\\]$") | F.col("after").rlike(r"^[./\\]\w")),
        "credential": flag(F.col("before").rlike(CREDENTIAL)), "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")),
        "address": flag(F.col("before").rlike("@$") | F.col("after").rlike("^@"))})
    # share of the characters that belong to letter runs found in the dictionary
    runs = rows.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{4,}"), F.lit(0))).alias("run"))
    covered = runs.join(words, F.col("run") == F.col("word")).groupBy(F.col("candidate").alias("of")).agg(F.sum(F.char_length("run")).alias("covered"))
    return rows.join(covered, F.col("candidate") == F.col("of"), "left").withColumn("dictionary", F.coalesce("covered", F.lit(0)) / F.col("length")).drop("of", "covered")


def outcome() -> Column:
    """Label of a finding whose outcome its form settles; null for all others."""
    candidate = F.col("candidate")
    secret = candidate.rlike(KNOWN_FORMATS) | ((F.col("credential") > 0) & (F.col("digits") > 0) & (F.col("digits") < 1) & (F.col("dictionary") < 0.5))
    false = candidate.rlike(r"^[0-9+/_\-]+$") | candidate.rlike(UUID) | (F.col("address") > 0) | candidate.rlike(r"^[a-z]*\d{1,4}(-[a-z0-9]+)*$") | (F.col("slashes") > 0.1)
    return F.when(secret, 1.0).when(false, 0.0)


def scan(docs: DataFrame) -> DataFrame:
    """One row per candidate of every distinct (id, text): doc_id, digest, k, start, candidate, probability, is_secret."""
    found = stored(with_features(candidates(docs), dictionary(docs)).withColumn("label", outcome()), "candidates")
    labelled, kinds = found.filter(F.col("label").isNotNull()).agg(F.count("*"), F.countDistinct("label")).first()
    keep = ["doc_id", "digest", "k", "start", "candidate", "probability"]
    if kinds < 2:
        judged = found.withColumn("probability", F.coalesce("label", F.lit(0.0))).select(*keep)
    else:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="vector")
        sample = found.filter(F.col("label").isNotNull()).filter(uniform(F.col("digest"), F.col("k")) * F.lit(float(labelled)) < LABELLED)
        forest = RandomForestClassifier(featuresCol="vector", labelCol="label", probabilityCol="odds", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        model = forest.fit(stored(assembler.transform(sample).select("vector", "label"), "labelled"))
        odds = vector_to_array("odds").getItem(1)
        judged = model.transform(assembler.transform(found)).withColumn("probability", F.round(odds, 6)).select(*keep)
    return judged.withColumn("is_secret", F.col("probability") >= THRESHOLD)


def findings(docs: DataFrame) -> DataFrame:
    """Findings of every row of docs, the value hashed: repeated rows have theirs each."""
    judged = scan(docs)
    copies = docs.groupBy(F.col("doc_id").alias("c_id"), F.xxhash64("doc_id", "text").alias("c_digest")).agg(F.count("*").alias("copies"))
    return judged.join(copies, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("digest") == F.col("c_digest"))).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "start", F.char_length("candidate").alias("length"), F.sha2("candidate", 256).alias("value_sha256"), "probability", "is_secret")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret in their texts replaced by `MASK`; rows without a candidate pass unchanged and unshuffled."""
    secrets = scan(docs).filter("is_secret").groupBy(F.col("digest").alias("s_digest"), F.col("doc_id").alias("s_id")).agg(F.collect_set("k").alias("bad"))
    has = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    columns = docs.columns
    suspects = docs.filter(has).select(F.struct(*columns).alias("row"))
    joined = suspects.join(secrets, F.col("row.doc_id").eqNullSafe(F.col("s_id")) & (F.xxhash64("row.doc_id", "row.text") == F.col("s_digest")), "left")
    found, gaps = F.regexp_extract_all("row.text", F.lit(CANDIDATE), F.lit(0)), F.split("row.text", CANDIDATE, -1)
    parts = joined.select("row", "bad", found.alias("found"), gaps.alias("gaps"))
    masked = F.transform(F.col("found"), lambda value, k: F.when(F.array_contains("bad", k), F.lit(MASK)).otherwise(value))
    text = F.array_join(F.flatten(F.zip_with("gaps", F.concat(masked, F.array(F.lit(""))), lambda gap, value: F.array(gap, value))), "")
    clean = parts.select(*[F.when(F.col("bad").isNull(), F.col("row.text")).otherwise(text).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns])
    return docs.filter(~has).unionByName(clean)
