"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitioning (native).

Method. The range key of a row is the hash of its text (high 40 bits) followed by a hash of its id (low 24 bits), so equal texts
lie next to each other and a large group of copies can still be cut. Rows are drawn with a probability in proportion to their
size; every so many draws a boundary is set. Ranges that turn out overfull are cut again at the draws that lie inside them.
Boundaries move to the start of a group of equal texts, unless the group is larger than a range. Exact running sizes inside the
ranges, plus the sizes of the ranges before, give each row its place in the whole order; the place decides the shard. Shard
sizes are therefore equal to within one range (1/64 of a shard) and one row, whatever the sample was.

Nothing but the boundaries (at most `MAX_RANGES`, from at most about 32 times as many drawn keys) passes through the driver.

Defined results: null text counts as empty (size 1, CRC-32 of no bytes); repeated rows are kept and get slots of their own; null
ids take part; ties in the key are ordered by id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.llm.common import stored, uniform

RANGES_PER_SHARD = 64
MAX_RANGES = 4096
DRAWS_PER_RANGE = 32
ROWS_PER_RANGE = 1_000_000
TIE_BITS = 24
OVERFULL = 1.5


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one, so that empty texts weigh something."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def range_key(text: Column, doc_id: Column) -> Column:
    high = F.shiftleft(F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), TIE_BITS), TIE_BITS)
    return high.bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit((1 << TIE_BITS) - 1)))


def group_of(key: Column) -> Column:
    return F.shiftright(key, TIE_BITS)


def draw_keys(rows: DataFrame, total: int, draws: int) -> list[int]:
    """Keys drawn with probability size * draws / total, in order; their number is `draws` give or take a few root-draws."""
    picked = rows.filter(uniform(F.col("doc_id"), F.col("key"), F.lit("draw")) * F.lit(float(total)) < F.col("size") * F.lit(float(draws)))
    return sorted(row.key for row in picked.select("key").collect())


def aligned(cuts: list[int]) -> list[int]:
    """Move the first cut inside a group of equal texts to the group's start; further cuts of the same group stay."""
    placed, seen = set(), set()
    for cut in sorted(set(cuts)):
        group = cut >> TIE_BITS
        placed.add(cut if group in seen else group << TIE_BITS)
        seen.add(group)
    return sorted(placed)


def range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key, by a two-level search over a constant array."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    constant = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    tops = cuts[width - 1::width]
    block = F.size(F.filter(constant(tops), lambda s: s <= key))
    inside = F.size(F.filter(F.slice(constant(cuts), block * width + 1, F.lit(width)), lambda s: s <= key))
    return block * width + inside


def choose_cuts(rows: DataFrame, total: int, count: int, n_shards: int) -> list[int]:
    n_ranges = min(MAX_RANGES, max(RANGES_PER_SHARD * n_shards, count // ROWS_PER_RANGE))
    drawn = draw_keys(rows, total, n_ranges * DRAWS_PER_RANGE)
    cuts = aligned(drawn[DRAWS_PER_RANGE::DRAWS_PER_RANGE])
    sizes = rows.groupBy(range_of(F.col("key"), cuts).alias("range")).agg(F.sum("size").alias("bytes"))
    overfull = sizes.filter(F.col("bytes") > F.lit(OVERFULL * total / n_ranges)).collect()  # at most n_ranges / OVERFULL rows
    edges = [-(1 << 63), *cuts, 1 << 63]
    more = []
    for row in overfull:
        inside = [k for k in drawn if edges[row.range] <= k < edges[row.range + 1]]
        step = max(1, int(len(inside) * total / n_ranges / row.bytes))
        more += inside[step::step]
    return aligned(cuts + more)


def shard_by_sampled_splitters(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, range, shard and a gapless slot within the shard."""
    rows = stored(docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
                              range_key(F.col("text"), F.col("doc_id")).alias("key")), "shard-keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cuts = choose_cuts(rows, total, count, n_shards) if count else []
    ranged = rows.withColumns({"range": range_of(F.col("key"), cuts), "group": group_of(F.col("key"))})

    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range, MAX_RANGES and a half at most
    offsets = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select(
        F.col("range").alias("at"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))

    order = ["group", "key", "doc_id", "size", "text_crc32"]
    in_range = Window.partitionBy("range").orderBy(*order)
    in_group = Window.partitionBy("range", "group").orderBy(*order[1:])
    placed = (
        ranged.withColumns({"place": F.row_number().over(in_range),
                            "start": F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
        .withColumn("start", F.first("start").over(in_group))
        .join(F.broadcast(offsets), F.col("range") == F.col("at"))
        .select("doc_id", "size", "text_crc32", "range", (F.col("rows_before") + F.col("place")).alias("place"),
                F.floor((F.col("bytes_before") + F.col("start")).cast("decimal(38,0)") * n_shards / F.lit(max(total, 1))).cast("int").alias("shard"))
    )
    placed = stored(placed, "shard-places")
    firsts = placed.groupBy(F.col("shard").alias("of")).agg(F.min("place").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), F.col("shard") == F.col("of")).select(
        "doc_id", "size", "text_crc32", "range", "shard", (F.col("place") - F.col("first")).alias("slot"))
