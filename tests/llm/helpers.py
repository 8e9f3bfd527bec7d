"""Small tables with the odd cases that every corpus operator has to stand."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, word string, k int, fp string"
PROSE = "the quick brown fox jumps over the lazy dog and runs far away into the deep green wood before the rain begins to fall"


def odd_documents(spark):
    """Nulls in all columns, empty and blank texts, a long text, repeated rows, equal texts, ties, clashing column names."""
    texts = [PROSE, PROSE, None, "", " \t\n ", "one", "two words", PROSE.upper(), PROSE + " tail", "ä ö ü é 日本語 　 x", "a\n\na\nb b b b",
             " ".join(f"w{i % 97}" for i in range(3000)), "x" * 5000, PROSE.replace("fox", "cat")]
    rows = [(i, t, "en" if i % 2 else None, ["s1", "s2", None][i % 3], len(t or ""), 7, "w", 1, "f") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def sample(spark, rows=200):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs.orderBy("doc_id").limit(rows).withColumn("size", F.lit(1))
