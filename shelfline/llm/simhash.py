"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Method. A fingerprint has 64 bits. Every bit position i is given a vector m(i) of `RADIUS` + 1 bits; for each of the 2^(RADIUS + 1) - 1
non-zero vectors v there is a table: the positions with odd <m(i), v> are its mask, and fingerprints with equal masked bits share a
bucket. Two fingerprints that differ in at most RADIUS positions have a non-zero v orthogonal to the vectors of all of these, so they
meet in table v: no link is lost, and each table compares only fingerprints that agree in about half of the bits.

Equal fingerprints are collapsed first. A bucket is linked inside one task by comparing its members in numpy blocks, and only a
spanning forest of its links leaves the task. A bucket with more than `BUCKET_ROWS` different fingerprints is not compared: the same
construction is applied to the positions that its mask leaves free, which gives finer buckets and again loses no pair; after three
levels at most eight positions are free, so a bucket cannot hold more than 256 fingerprints. Links of all buckets go to a distributed
component search.

Defined results: null and empty texts, and texts of white space, have no words and fingerprint zero, which is linked like any other;
rows with equal ids keep a row each and one component (the smallest id reachable); a null id takes part but never names a component
unless no other id is reachable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from shelfline.llm.common import stored
from shelfline.llm.components import components

RADIUS = 4
SHINGLE_WORDS = 4
HASH_SEED = 42
BUCKET_ROWS = 4096
#: With so few free positions a bucket has at most 256 fingerprints and is compared in any case.
COMPARED_BITS = 8
#: Shingles of one text that are hashed at a time.
SHINGLE_CHUNK = 1 << 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes) -> int:
    """SimHash of the 4-word shingles: a bit is set if it is set in over half the shingle hashes."""
    words = text.translate(LOWER).split()  # bytes.split() cuts at exactly space and \\x09-\\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE_WORDS, len(words))
    first, last = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), SHINGLE_CHUNK):
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(first[at:at + SHINGLE_CHUNK], last[at:at + SHINGLE_CHUNK], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(first), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash (of all columns) and fp (the 64 bits as a signed long)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("row_hash", T.LongType()),
                           T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(text or b"") for text in batch.column(2).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.int64())], names=schema.names)

    return docs.select("doc_id", F.xxhash64(*docs.columns).alias("row_hash"), "text").mapInArrow(run, schema)


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions, one per non-zero v: position number i is kept if <m(i), v> is odd.

    The vectors m(i) run through all non-zero vectors in turn, so every mask keeps about half of the positions."""
    size = (1 << (radius + 1)) - 1
    vectors = {p: i % size + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p, m in vectors.items() if (m & v).bit_count() % 2) for v in range(1, size + 1)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bucketed(rows: DataFrame, cases: dict[int, list[int]]) -> DataFrame:
    """rows (fp, kept): one row per row and mask that extends what it keeps; kept becomes the wider mask.

    cases: the masks to add, by the mask kept so far: a constant of the method of at most 31 * 31 rows, whatever the data."""
    table = rows.sparkSession.createDataFrame([(signed(kept), [signed(kept | m) for m in masks]) for kept, masks in cases.items()],
                                              "case long, wider array<bigint>")
    return rows.join(F.broadcast(table), F.col("kept") == F.col("case")).select("fp", F.explode("wider").alias("kept"))


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the graph of distances among sorted distinct values: pairs (value, smallest value of its part)."""
    left, us, vs = values, [], []
    while len(left) > 1:
        first, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):  # what a value reaches leaves the rest, so each value is compared once
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                reached = left[near]
                queue.extend(reached)
                us.append(reached)
                vs.append(np.full(len(reached), first))
                left = left[~near]
    none = np.zeros(0, values.dtype)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


#: Parts that the fingerprints of one component are dealt to.
DEALS = 32
LINKS = "u long, v long"


def bucket_links(rows: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """rows (kept, key, fp), sorted by bucket: links of each bucket. A bucket never exceeds BUCKET_ROWS rows."""
    held = None
    for batch in rows:
        part = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
        part = part if held is None else np.concatenate((held, part))
        edges = np.concatenate(([0], np.nonzero((np.diff(part[:, :2], axis=0) != 0).any(axis=1))[0] + 1))
        held = part[edges[-1]:].copy()  # the last bucket may go on in the next batch
        yield from _links_of(part[:edges[-1]], edges, radius)
    if held is not None:
        yield from _links_of(held, np.array([0, len(held)]), radius)


def _links_of(part: np.ndarray, edges: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    us, vs = [], []
    sizes = np.diff(edges)
    pairs = edges[:-1][sizes == 2]  # by far the most: compared all at once
    near = np.bitwise_count(part[pairs, 2].view(np.uint64) ^ part[pairs + 1, 2].view(np.uint64)) <= radius if len(pairs) else np.zeros(0, bool)
    us.append(part[pairs, 2][near])
    vs.append(part[pairs + 1, 2][near])
    for a, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        u, v = forest(np.ascontiguousarray(part[a:a + n, 2]).view(np.uint64), radius)
        us.append(u.view(np.int64))
        vs.append(v.view(np.int64))
    u, v = np.concatenate(us), np.concatenate(vs)
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct (fp): links (u, v) of different fingerprints that span all components of the graph of distances <= radius."""
    cases = {0: covering_masks(list(range(64)), radius)}
    rows, found = distinct.select("fp", F.lit(0).cast("long").alias("kept")), None
    while True:
        keyed = bucketed(rows, cases).withColumn("key", F.col("fp").bitwiseAND(F.col("kept")))
        sizes = keyed.groupBy("kept", "key").agg(F.count("*").alias("n")).filter("n > 1")
        sized = keyed.join(sizes, ["kept", "key"])
        sized = stored(sized, "buckets")
        large = (F.col("n") > BUCKET_ROWS) & (F.bit_count("kept") < 64 - COMPARED_BITS)
        links = sized.filter(~large).select("kept", "key", "fp").repartition("kept", "key").sortWithinPartitions("kept", "key", "fp").mapInArrow(
            lambda batches: bucket_links(batches, radius), LINKS)
        found = links if found is None else found.unionByName(links)
        rows = sized.filter(large).select("fp", "kept").distinct()
        kept_masks = [row.kept % (1 << 64) for row in rows.select("kept").distinct().collect()]  # at most 31, then 31 * 31
        if not kept_masks:
            return found
        cases = {kept: covering_masks([p for p in range(64) if not kept >> p & 1], radius) for kept in kept_masks}


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, row_hash, fingerprint (16 hex digits), component (a fingerprint that stands for the component, whatever
    its ids), component_id (its smallest id: null if it has none, and shared by components in which that id is repeated)."""
    printed = stored(fingerprints(docs), "fingerprints")
    distinct = printed.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    distinct = stored(distinct, "distinct-fingerprints")
    # signed comparison orders nodes; any order will do, the smallest id is looked up afterwards
    labelled = stored(components(fingerprint_links(distinct, radius)), "components")
    linked = distinct.join(labelled, distinct["fp"] == labelled["node"]).select("fp", "least_id", "component")
    names = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    # a component may hold a large share of all fingerprints: it is dealt out, and its name goes to every deal
    names = names.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    dealt = linked.withColumn("deal", F.pmod(F.xxhash64("fp"), F.lit(DEALS)).cast("int")).join(names, ["component", "deal"])
    alone = distinct.join(labelled, distinct["fp"] == labelled["node"], "left_anti")
    by_print = dealt.select(F.col("fp").alias("of"), "component", "component_id").unionByName(
        alone.select(F.col("fp").alias("of"), F.col("fp").alias("component"), F.col("least_id").alias("component_id")))
    return printed.join(by_print, F.col("fp") == F.col("of")).select(
        "doc_id", "row_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component", "component_id")


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of every component: the one with the smallest id (of equal ids, the one with the smallest row hash); a row without
    an id only where the component has no other. Components are told apart by their fingerprints, as ids may be null or repeated."""
    found = near_duplicates(docs, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("first")
    kept = found.groupBy("component").agg(first).select("first.doc_id", "first.row_hash")
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("d"), F.xxhash64(*columns).alias("h"))
    joined = rows.join(kept, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("row_hash")), "left_semi")
    once = joined.withColumn("copy", F.row_number().over(Window.partitionBy("d", "h").orderBy("d"))).filter("copy = 1")
    return once.select("row.*")
