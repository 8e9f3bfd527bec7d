"""Audit of how filters interact: what each removes in every order, by counting paths through the lattice of filter sets.

Method. A document is reduced to the set of filters it fails, and a part of the corpus to the count of documents per set (at most 2^n
rows). A state of the lattice is the set of filters already applied; an edge applies one more and removes the documents that fail it
and none of the state. Counting paths forward (orders that reach a state) and backward (orders that leave it) gives every edge the
number of orders that run through it: removals weighted by it sum to the Shapley figure of the edge's filter, and the steps of every
single order are read from the same edges. So each edge is computed once, however many orders there are.

The filters here: A under 200 words; B fewer than half of the words distinct; C over 2 % of the characters in A-Z; D any of `#$%&*|`;
E equal to the text of a smaller doc_id anywhere in the table. Texts are read once by Arrow workers and leave as digests; equal texts
meet as counts per digest, so large groups of copies are small before any shuffle, and no text is shuffled.

Defined results: null texts are empty texts (and equal to them). A null or empty source is the part of the empty string. Rows without an id are smaller
than no other and fail no E, and have no label; rows that repeat an id do not fail E for each other. A document is good or toxic if any label of its id says so.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

FILTERS = "ABCDE"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(text: bytes, chars: int) -> int:
    """Bits of the filters A to D that a text fails; words end at ASCII white space."""
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 2 * chars) << 2
            | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def judged_texts(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and failed bits (A to D) of every row."""
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = pc.utf8_length(batch.column(2)).to_pylist()
            texts = batch.column(2).cast(pa.binary())
            digests, bits = [], []
            for i, n in enumerate(chars):
                text = texts[i].as_py()
                digests.append(hashlib.sha256(text).digest())
                bits.append(text_failures(text, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(bits, pa.int32())],
                                             names=["doc_id", "part", "digest", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text")).mapInArrow(judged, "doc_id long, part string, digest binary, bits int")


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part and set of failed filters: part, failed, n, good, toxic."""
    rows = judged_texts(docs).groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n"))
    flags = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").cast("string").alias("label_key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id join nothing and are dealt by their text
    keyed = rows.withColumn("label_key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.hex("digest"))))
    marked = keyed.join(flags, "label_key", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # per text, part and flags: the smallest id with its rows, and all rows; the text's own smallest id decides which of them pass E
    groups = ["digest", "part", "bits", "good", "toxic"]
    least = F.col("doc_id").isNotNull()
    of_text = marked.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum(F.when(~least, F.col("n")).otherwise(0)).alias("without"),
                                          F.min("doc_id").alias("least"), F.min_by(F.when(least, F.col("n")), "doc_id").alias("at_least"))
    # a text has few such rows however many copies it has
    first = F.min("least").over(Window.partitionBy("digest"))
    split = of_text.withColumn("first", first).withColumn("passing", F.col("without") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0))
    both = split.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("bits").alias("failed"), F.col("passing").alias("n")),
        F.struct((F.col("bits") + (1 << FILTERS.index("E"))).alias("failed"), (F.col("n") - F.col("passing")).alias("n")))))
    return both.groupBy("part", "failed").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def lattice_edges(n: int) -> list[tuple[int, int, int]]:
    """Edges (state, filter, orders through it) of the lattice of sets of n filters, by forward and backward path counts."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return [(state, f, reach[state] * leave[state | 1 << f]) for state in range(full) for f in range(n) if not state >> f & 1]


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from documents per part and set of failed filters."""
    spark, n = counts.sparkSession, len(filters)
    failed = F.col("failed")

    def has(bits: Column | int) -> Column:
        return failed.bitwiseAND(bits) != 0

    # every count meets the fixed list of edges: at most 2^n rows a part times n * 2^(n-1) edges, summed before the shuffle
    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("orders")) for s, f, w in lattice_edges(n)])
    met = counts.select("part", "failed", "n", "good", "toxic", F.inline(edges)).withColumn("bit", F.expr("shiftleft(1, filter)"))
    before, now = has(F.col("state")), has(F.col("bit"))
    removed = ~before & now
    edge = met.groupBy("part", "state", "filter", "orders").agg(
        F.sum(F.when(~before & ~now, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(removed, F.col("n")).otherwise(0)).alias("removed"),
        F.sum(F.when(before & now, F.col("n")).otherwise(0)).alias("redundant"), F.sum(F.when(failed == F.col("bit"), F.col("n")).otherwise(0)).alias("unique_fails"),
        F.sum(F.when(removed, F.col("good")).otherwise(0)).alias("good_lost"), F.sum(F.when(removed, F.col("toxic")).otherwise(0)).alias("toxic_lost"))
    # the Shapley figure of a filter needs all its edges; the steps need each edge under its orders: both from a part's one list of edges
    lists = edge.groupBy("part").agg(F.collect_list(F.struct("state", "filter", "orders", *COUNTS)).alias("edges"))
    steps = [("".join(filters[f] for f in order), step + 1, sum(1 << f for f in order[:step]), f)
             for order in permutations(range(n)) for step, f in enumerate(order)]
    table = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, state int, filter int"))
    shapley = F.expr("aggregate(filter(edges, e -> e.filter = at.filter), 0L, (sum, e) -> sum + e.orders * e.removed)")
    return lists.select("part", F.explode("edges").alias("at"), "edges").select("part", "at.*", shapley.alias("shapley")).join(table, ["state", "filter"]).select(
        "part", "filter_order", "step", *[F.col(c).cast("long") for c in COUNTS], F.col("shapley").cast("long"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failure_counts(docs, labels))
