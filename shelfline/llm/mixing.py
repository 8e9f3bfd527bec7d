"""Mixing sources to target weights by fixed-length blocks and per-source index permutations.

Method. The words of a source, document after document, form one stream that is packed into blocks of `BLOCK_WORDS` words. A source's
target (see `source_targets`) becomes a number of slots. The slots of the mix are dealt over output shards: every shard draws its
counts per source from a multinomial over what the sources still have to give, without replacement, so the totals meet the targets
exactly. Slot number k of a source belongs to epoch k // blocks and reads block permutation(k mod blocks); the permutation is a keyed
Feistel network with cycle walking, so no index table exists. Slots and blocks are joined by (source, block).

A block occurs once per epoch and no source exceeds three epochs, so no document is taken more than three times. The last slot of a
source is cut, so that the words taken equal the target rounded down.

Only counts per source and shard exist outside tasks: `SHARDS` times the number of sources, made by Spark from one row per source.

Defined results: null or empty texts have size 0 and are never taken (one row, taken 0); a null source is a source of its own, last
in order; rows with equal ids are separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shelfline.llm.common import WORD, stored, words_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 256
SHARDS = 64
#: Documents of a source are chained in this many runs, so that no task orders a whole source.
RUNS = 256
#: Slots that one row of the plan stands for before it is exploded.
SLOTS_PER_ROW = 100_000
SEED = 20240711


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size): one row per source; adds rank, weight and target.

    Targets share the whole size by weight; a source stops at `max_epochs` times its size and its excess is shared again by weight.
    Sources ordered by limit / weight are capped in that order, so the level at which the rest is shared has a closed form: the
    first k sources are capped, where k is the first place whose own limit / weight is not below the level that remains.
    """
    by_code_point = Window.orderBy(F.col("source").isNull(), "source")  # one row per source
    cycle = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = sizes.withColumn("rank", F.row_number().over(by_code_point)).withColumn(
        "weight", F.element_at(cycle, (F.col("rank") - 1) % len(WEIGHTS) + 1).cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    levels = (
        ranked.withColumn("limit", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("capped_before", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(whole) - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("open", F.col("limit") >= F.col("level") * F.col("weight"))
        .withColumn("final_level", F.max(F.when(F.col("open"), F.col("level"))).over(whole))
    )
    return levels.select("source", "source_size", "rank", "weight",
                         F.least(F.col("limit"), F.coalesce(F.col("final_level") * F.col("weight"), F.col("limit"))).alias("target"))


def chained(docs: DataFrame) -> DataFrame:
    """Place of every document in its source's stream of words: adds rank, run, seq (unique together) and start."""
    sized = docs.withColumns({"size": F.size(words_of(F.col("text"))).cast("long"), "run": F.pmod(F.xxhash64("doc_id"), F.lit(RUNS)).cast("int"),
                              "row_hash": F.xxhash64(*docs.columns)})
    sized = stored(sized.select("doc_id", "row_hash", "source", "size", "run"), "mix-sizes")
    runs = sized.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    targets = stored(source_targets(runs.groupBy("source").agg(F.sum("run_size").alias("source_size"))), "mix-targets")
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # RUNS rows per source
    offsets = runs.withColumn("run_start", F.coalesce(F.sum("run_size").over(before), F.lit(0)))
    offsets = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(
        targets["source"].alias("of"), F.col("run").alias("of_run"), "run_start", "rank", "source_size", "target")
    in_run = Window.partitionBy("source", "run").orderBy("doc_id", "row_hash")
    placed = sized.withColumns({"seq": F.row_number().over(in_run),
                                "in_run": F.sum("size").over(in_run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    return placed.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("run") == F.col("of_run"))).select(
        "doc_id", "row_hash", "source", "size", "run", "seq", "rank", "source_size", "target", (F.col("run_start") + F.col("in_run")).alias("start"))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, inverse: bool = False, rounds: int = 4) -> np.ndarray:
    """Pseudorandom permutation of range(size) per element: a Feistel network on the next even number of bits, walked until the
    value falls inside the range (fewer than four steps are expected)."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, todo = index.astype(np.uint64), np.arange(len(index))
    limit, key = size.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        x, h, m, k = value[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in reversed(range(rounds)) if inverse else range(rounds):
            turned = left if inverse else right
            mixed = (turned + k + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed >> np.uint64(31)) & m
            left, right = (right ^ mixed, left) if inverse else (right, left ^ mixed)
        value[todo] = (left << h) | right
        todo = todo[value[todo] >= limit[todo]]
    return value.astype(np.int64)


def _permute(position: pd.Series, blocks: pd.Series, key: pd.Series, inverse: bool = False) -> pd.Series:
    return pd.Series(permuted(*(c.to_numpy(np.int64) for c in (position, blocks, key)), inverse=inverse))


@F.pandas_udf(T.LongType())
def block_at(position: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
    return _permute(position, blocks, key)


@F.pandas_udf(T.LongType())
def position_of(block: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
    return _permute(block, blocks, key, inverse=True)


def shard_counts(quotas: pd.DataFrame) -> pd.DataFrame:
    """quotas (rank, slots): counts per shard and source, drawn shard by shard from what is left; first is the source's slot number."""
    quotas = quotas.sort_values("rank")
    left = quotas["slots"].to_numpy(np.int64).copy()
    rng = np.random.default_rng(SEED)
    share, rest = divmod(int(left.sum()), SHARDS)
    given, rows = np.zeros_like(left), []
    for shard in range(SHARDS):
        size = share + (shard < rest)
        exact = left.sum() < 10**9  # the range of the library's hypergeometric
        drawn = rng.multivariate_hypergeometric(left, size, method="marginals") if exact else bounded_multinomial(rng, left, size)
        at = 0
        for i in np.nonzero(drawn)[0]:
            rows.append((shard, int(quotas["rank"].iloc[i]), int(given[i]), int(drawn[i]), at))
            at += int(drawn[i])
        given += drawn
        left -= drawn
    return pd.DataFrame(rows, columns=["shard", "rank", "first", "n", "at"]).astype("int64")


def bounded_multinomial(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """A multinomial draw; what a source has no slots left for goes to those that have most."""
    drawn = np.minimum(rng.multinomial(n, left / left.sum()), left)
    for i in np.argsort(-(left - drawn)):
        missing = n - int(drawn.sum())
        if not missing:
            break
        drawn[i] += min(missing, int(left[i] - drawn[i]))
    return drawn


def mix_slots(sources: DataFrame) -> DataFrame:
    """sources (rank, source_size, target): one row per slot of the mix: shard, slot, rank, epoch, block, words (those of the block
    that the slot takes, from its start)."""
    sources = sources.filter("source_size > 0")
    blocks = F.ceil(F.col("source_size") / F.lit(BLOCK_WORDS)).cast("long")
    tail = F.col("source_size") - (F.col("blocks") - 1) * BLOCK_WORDS
    plan = (
        sources.withColumn("blocks", blocks).withColumn("tail", tail)
        .withColumn("wanted", F.floor(F.col("target") + F.lit(1e-6)).cast("long"))
        .withColumn("epochs", F.floor(F.col("wanted") / F.col("source_size")).cast("long"))
        .withColumn("rest", F.col("wanted") - F.col("epochs") * F.col("source_size"))
        # the short last block may come early in the order: one slot more than the rest alone would need
        .withColumn("slots", F.col("epochs") * F.col("blocks") + F.least(F.col("blocks"), F.ceil(F.col("rest") / F.lit(BLOCK_WORDS)) + F.when(F.col("rest") > 0, 1).otherwise(0)))
    )
    plan = plan.withColumn("key", F.xxhash64(F.lit(SEED), F.col("rank"))).withColumn("tail_position", position_of(F.col("blocks") - 1, "blocks", "key"))
    plan = stored(plan, "mix-plan")
    counts = plan.select("rank", "slots").coalesce(1).mapInPandas(
        lambda frames: [shard_counts(pd.concat(list(frames)))], "shard long, rank long, first long, n long, at long")
    parts = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(SLOTS_PER_ROW)))))
    parts = parts.join(plan.withColumnRenamed("rank", "of"), F.col("rank") == F.col("of")).repartition("shard", "rank", "part")
    low = F.col("part") * SLOTS_PER_ROW
    slots = parts.withColumn("i", F.explode(F.sequence(low, F.least(low + SLOTS_PER_ROW, F.col("n")) - 1)))
    k = F.col("first") + F.col("i")
    slots = slots.select("shard", (F.col("at") + F.col("i")).alias("slot"), "rank", F.floor(k / F.col("blocks")).cast("long").alias("epoch"),
                         (k % F.col("blocks")).alias("position"), "blocks", "tail", "tail_position", "epochs", "rest", "key")
    slots = slots.withColumn("block", block_at("position", "blocks", "key"))
    # in the last, partial epoch words are taken until the rest is reached; the tail block counts with its own length
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(F.lit(BLOCK_WORDS).cast("long"))
    taken_before = F.col("position") * BLOCK_WORDS - F.when(F.col("tail_position") < F.col("position"), F.lit(BLOCK_WORDS) - F.col("tail")).otherwise(0)
    words = F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.greatest(F.lit(0), F.least(length, F.col("rest") - taken_before)))
    return slots.select(
        "shard", "slot", "rank", "epoch", "block", words.cast("long").alias("words")).filter("words > 0")


def pieces_of(places: DataFrame) -> DataFrame:
    """One row per document and block that it touches: from_word and to_word within the block (to_word exclusive)."""
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / F.lit(BLOCK_WORDS)), F.floor((end - 1) / F.lit(BLOCK_WORDS))
    return places.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last))).withColumns(
        {"from_word": F.greatest(F.col("start") - F.col("block") * BLOCK_WORDS, F.lit(0)),
         "to_word": F.least(end - F.col("block") * BLOCK_WORDS, F.lit(BLOCK_WORDS))})


def mix_blocks(places: DataFrame) -> DataFrame:
    """Join of slots and blocks: per slot and document piece, what the mix takes of a document (doc_from, doc_to in its words)."""
    sources = places.groupBy("rank").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    slots = mix_slots(sources).withColumnsRenamed({"rank": "slot_rank", "block": "slot_block"})
    pieces = pieces_of(places)
    # the planner takes slots for as small as the plan they are exploded from, and would broadcast them
    joined = pieces.join(slots.hint("merge"), (F.col("rank") == F.col("slot_rank")) & (F.col("block") == F.col("slot_block")))
    to_word = F.least(F.col("to_word"), F.col("words"))
    offset = F.col("block") * BLOCK_WORDS - F.col("start")
    return joined.filter(to_word > F.col("from_word")).select(
        "rank", "run", "seq", "shard", "slot", "epoch", (offset + F.col("from_word")).alias("doc_from"), (offset + to_word).alias("doc_to"))


def taken_words(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    places = stored(chained(docs), "mix-places")
    taken = mix_blocks(places).groupBy(F.col("rank").alias("r"), F.col("run").alias("u"), F.col("seq").alias("s")).agg(
        F.sum(F.col("doc_to") - F.col("doc_from")).alias("taken"))
    return places.join(taken, (F.col("rank") == F.col("r")) & (F.col("run") == F.col("u")) & (F.col("seq") == F.col("s")), "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row per document and epoch in which the mix takes of it, with the columns of docs.

    The text is the whole text where all its words are taken, else the taken words in order, with the white space after each."""
    places = stored(chained(docs), "mix-places")
    taken = mix_blocks(places).groupBy("rank", "run", "seq", "epoch").agg(
        F.sum(F.col("doc_to") - F.col("doc_from")).alias("words"), F.sort_array(F.collect_list(F.struct("doc_from", "doc_to"))).alias("ranges"))
    keys = places.select(F.col("rank").alias("r"), F.col("run").alias("u"), F.col("seq").alias("s"), F.col("doc_id").alias("d"), F.col("row_hash").alias("h"), "size")
    taken = taken.join(keys, (F.col("rank") == F.col("r")) & (F.col("run") == F.col("u")) & (F.col("seq") == F.col("s"))).select("d", "h", "size", "words", "ranges")
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("of_d"), F.xxhash64(*columns).alias("of_h"))
    # repeated rows are taken each on their own account, so one of them stands for all here
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("of_d", "of_h").orderBy("of_d"))).filter("copy = 1")
    joined = rows.join(taken, F.col("of_d").eqNullSafe(F.col("d")) & (F.col("of_h") == F.col("h")))
    words = F.regexp_extract_all("row.text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = joined.select("row", F.when(F.col("words") == F.col("size"), F.array("row.text")).otherwise(words).alias("parts"),
                        F.when(F.col("words") == F.col("size"), F.lit(None)).otherwise(F.col("ranges")).alias("ranges"))
    part = F.flatten(F.transform("ranges", lambda r: F.slice("parts", (r["doc_from"] + 1).cast("int"), (r["doc_to"] - r["doc_from"]).cast("int"))))
    text = F.array_join(F.coalesce(part, F.col("parts")), "")
    return cut.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns])
