"""Cross-entropy difference: matched target and background n-gram models over one shared, open vocabulary.

Method. The vocabulary holds every word of all documents, so both models see the same set of words and none is unknown or shares its
counts with another. Bigrams (with a start token per document) are counted over all background documents (every document) and all
target documents. Both models are interpolated with the same absolute discount, weight and unigram floor. A document's score is the
mean per token of its loss under the target model minus its loss under the background model: the lower, the closer to the target.

Words are numbered by frequency. The numbers only decide which way a word or bigram takes, never the result:

* Bigrams of two `FREQUENT` words (or the start token) fall into a dense table of fixed size: counted within each task, collected,
  and sent to the workers as losses (about 17 MB a model).
* Every other bigram is dealt, with its document, to the bucket of its rarest part and counted there over all documents. Buckets grow in
  number with the corpus. A word that is not frequent is at most one of `FREQUENT` words of the corpus, so no bucket is hot.
* Totals of the `KNOWN` most frequent words are a table of bounded size, summed by task, collected and sent to the workers. Those of
  the other words, named by 63 bits of a hash, are complete in the word's own bucket; only bigrams of two such words are joined to
  the totals of the first one.

Defined results: null and empty texts have no tokens, null losses and a null score; repeated rows are counted and scored each; without
target documents the target model is the uniform one; an empty table gives an empty result; null ids are never target documents;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelfline.llm.common import stored

#: Words numbered for all tasks; further words go by their hash.
KNOWN = 1 << 17
#: Words whose bigrams with one another are counted in a dense table.
FREQUENT = 2_048
#: Numbers after those of the known words: the start token, and the sign that a token's hash stands in `others`.
START, OTHER = KNOWN, KNOWN + 1
#: Added to a known second word, to tell it from a first one.
SECOND = 1 << 20
MODELS = ("background", "target")
DISCOUNT = 0.75
UNIGRAM_FLOOR = 0.5
#: Occurrences that a second word's own share counts for after every first word. Rare first words have bigrams of their own, no class to
#: share them with: without this, a document's own bigrams after them would make up most of its loss under the background model.
CONTEXT_PRIOR = 20
#: Different words or bigrams that a task gathers before it passes them on.
GATHERED = 1 << 19
#: Words of the corpus per bucket of bigrams, about.
BUCKET = 1 << 20
#: Rows of one part of the table of tokens are numbered from the same multiple of 2 to this power.
PART = 33
#: Documents whose losses are summed together: 2 to this power.
TOGETHER = 13


def words_of_text(text: str) -> list[str]:
    """Lower-cased words; the signs around a word do not make it another one."""
    return [w.strip(".,;:!?\"'()[]") for w in text.lower().split()]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(words_of_text(text or ""))
                if len(found) > GATHERED:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame, known: int) -> dict[str, int]:
    """The most frequent words of word_counts, numbered; ties by the word. Collected: known rows at most, and no more than KNOWN."""
    known = min(known, KNOWN)
    least, reached = None, 0
    for level in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(known).collect():
        least, reached = level.n, reached + level.words
        if reached >= known:
            break
    if least is None:
        return {}
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(known).toArrow()["word"].to_pylist()
    return {word: i for i, word in enumerate(top)}


def other_id(word: str) -> int:
    """Negative number of a word that is not known."""
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) | -(1 << 63)


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, byte by byte of equal weight."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: str = "<i8") -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * size, codec="zstd"), np.uint8).reshape(size, n).T).view(kind).ravel()


def tokenised(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n_tokens, tokens (packed numbers of the words) and others (signed 64-bit numbers of the words that are OTHER, in order)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("tokens", T.BinaryType()), T.StructField("others", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, tokens, others = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of_text(text or "")
                found = [vocabulary.value.get(w, OTHER) for w in words]
                sizes.append(len(words))
                tokens.append(packed(np.array(found, "<u4")))
                others.append(np.array([other_id(w) for w, i in zip(words, found, strict=True) if i == OTHER], "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary()), pa.array(others, pa.binary())],
                                             names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def ids_of(n_tokens: int, tokens: bytes, others: bytes) -> np.ndarray:
    """Start token, then one number per word."""
    ids = np.concatenate(([START], unpacked(tokens, n_tokens, "<u4").astype(np.int64)))
    ids[ids == OTHER] = np.frombuffer(others, "<i8")
    return ids


def dense_places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the dense table of every bigram of a document, and which bigrams have one."""
    first, second = ids[:-1], ids[1:]
    starts = first == START
    held = (starts | (first >= 0) & (first < FREQUENT)) & (second >= 0) & (second < FREQUENT)
    return np.where(starts, FREQUENT, first) * FREQUENT + second, held


def frequent_counts(rows: DataFrame) -> DataFrame:
    """pair (place in the dense table), background and target: counts over all documents and over those with is_target."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, (FREQUENT + 1) * FREQUENT), np.int32)
        for batch in batches:
            for n_tokens, tokens, others, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place, held = dense_places(ids_of(n_tokens, tokens, others))
                pair, n = np.unique(place[held], return_counts=True)
                table[0][pair] += n
                if target:
                    table[1][pair] += n
        pair = np.flatnonzero(table[0])
        for start in range(0, len(pair), GATHERED):
            at = pair[start:start + GATHERED]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(counts[at].astype(np.int64)) for counts in table]],
                                             names=["pair", "background", "target"])

    counted = rows.select("n_tokens", "tokens", "others", "is_target").mapInArrow(count, "pair int, background long, target long")
    return counted.groupBy("pair").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def dealt_bigrams(rows: DataFrame, buckets: int) -> DataFrame:
    """The bigrams outside the dense table, by bucket and gathered documents: base, n, and packed place, other and mark.

    place is the second word where that is not known, else the first where that is not known, else the number of the pair; other is
    the remaining word (0 for a pair, a known second word with SECOND added). A bigram of two words that are not known also goes to the
    first one's place, as a witness for that word's totals. mark holds the document's row less base, then a bit for witnesses, then one for targets.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple] = []
        base = size = 0

        def flush() -> pa.RecordBatch:
            place, other, mark = (np.concatenate(c) for c in zip(*gathered, strict=True))
            gathered.clear()
            bucket = ((place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
            order = np.lexsort((place, bucket))
            bucket, place, other, mark = (c[order] for c in (bucket, place, other, mark))
            found, start = np.unique(bucket, return_index=True)
            parts = [slice(i, j) for i, j in zip(start, [*start[1:], len(bucket)], strict=True)]
            return pa.RecordBatch.from_arrays([
                pa.array(found.astype(np.int64)), pa.array(np.full(len(found), base, np.int64)), pa.array([p.stop - p.start for p in parts], pa.int64()),
                # places are in order: their differences are smaller
                pa.array([packed(np.diff(place[p], prepend=0)) for p in parts], pa.binary()),
                pa.array([packed(other[p]) for p in parts], pa.binary()), pa.array([packed(mark[p]) for p in parts], pa.binary())],
                names=["bucket", "base", "n", "place", "other", "mark"])

        for batch in batches:
            for row, n_tokens, tokens, others, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if gathered and (size > GATHERED or row < base or row >> PART != base >> PART):
                    yield flush()
                    size = 0
                if not gathered:
                    base = row
                ids = ids_of(n_tokens, tokens, others)
                rest = ~dense_places(ids)[1]
                first, second = ids[:-1][rest], ids[1:][rest]
                mark = np.full(len(first), (row - base) * 4 + target, np.int64)
                place = np.where(second < 0, second, np.where(first < 0, first, first * SECOND + second))
                other = np.where(second < 0, first, np.where(first < 0, second + SECOND, 0))
                gathered.append((place, other, mark))
                both = (first < 0) & (second < 0)
                gathered.append((first[both], second[both], mark[both] + 2))
                size += len(place)
        if size:
            yield flush()

    return rows.select("row", "n_tokens", "tokens", "others", "is_target").mapInArrow(
        run, "bucket long, base long, n long, place binary, other binary, mark binary")


#: Of a bigram: its counts, and the totals that are complete in its bucket: for a second word that is not known its occurrences, for a
#: first one those and the different words that follow; both over all and over target documents.
COUNTS = ("background", "target")
TOTALS = ("word_background", "word_target", "n_background", "n_target", "kinds_background", "kinds_target")
#: Rows of counted_bigrams: many bigrams packed into one; an occurrence of a bigram of two words that are not known; a first word of such bigrams.
MANY, ONE, FIRST = 0, 1, 2
NUMBERS = ("row", "first", *COUNTS, *TOTALS)
COUNTED = f"kind int, pairs long, size long, {', '.join(f'{c} binary' for c in ('firsts', 'seconds', 'counts', 'totals', 'rows'))}, " + ", ".join(f"{c} long" for c in NUMBERS)


def sums_of(group: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(group, weight, size).astype(np.int64)


def count_bucket(table: pa.Table) -> pa.Table:
    """All bigrams of a bucket with their counts and the totals of words that are not known."""
    parts: list[tuple] = []
    for base, n, place, other, mark in zip(*(table[c].to_pylist() for c in ("base", "n", "place", "other", "mark")), strict=True):
        marks = unpacked(mark, n)
        parts.append((np.cumsum(unpacked(place, n)), unpacked(other, n), marks & 3, (marks >> 2) + base))
    place, other, bits, row = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    order = np.lexsort((row, bits >> 1, other, place))
    place, other, bits, row = (c[order] for c in (place, other, bits, row))
    witness, target = bits >> 1, bits & 1
    starts = np.ones(len(place), bool)
    starts[1:] = (place[1:] != place[:-1]) | (other[1:] != other[:-1]) | (witness[1:] != witness[:-1])
    at = np.flatnonzero(starts)
    pair_place, pair_other, pair_witness = place[at], other[at], witness[at].astype(bool)
    count = {"background": np.diff(np.append(at, len(place))), "target": np.add.reduceat(target, at)}
    unknown = pair_place < 0
    is_second = unknown & ~pair_witness & (pair_other < SECOND)
    is_first = unknown & ~is_second
    group = np.cumsum(np.append(True, pair_place[1:] != pair_place[:-1])) - 1
    size = group[-1] + 1
    total = {}
    for m in MODELS:
        total[f"word_{m}"] = np.where(is_second, sums_of(group, count[m] * is_second, size)[group], 0)
        total[f"n_{m}"] = np.where(is_first, sums_of(group, count[m] * is_first, size)[group], 0)
        total[f"kinds_{m}"] = np.where(is_first, sums_of(group, (count[m] > 0) & is_first, size)[group], 0)

    first = np.where(unknown, np.where(is_second, pair_other, -1), pair_place >> 20)
    second = np.where(unknown, np.where(is_second, -1, pair_other - SECOND), pair_place & (SECOND - 1))
    single = is_second & (pair_other < 0)
    many = ~pair_witness & ~single
    occurs = np.repeat(np.arange(len(at)), count["background"])
    batches = [rows_of(MANY, 1, {
        "pairs": [int(many.sum())], "size": [int(many[occurs].sum())], "firsts": [packed(first[many])], "seconds": [packed(second[many])],
        "counts": [packed(np.concatenate([count[m][many] for m in COUNTS]))], "totals": [packed(np.concatenate([total[c][many] for c in TOTALS]))],
        "rows": [packed(row[many[occurs]])]})]
    alone = single[occurs]
    batches.append(rows_of(ONE, int(alone.sum()), {"row": row[alone], "first": pair_other[occurs[alone]]} | {
        c: v[occurs[alone]] for c, v in (count | total).items()}))
    seen = np.flatnonzero(pair_witness)
    seen = seen[np.append(True, np.diff(pair_place[seen]) != 0)[:len(seen)]]
    batches.append(rows_of(FIRST, len(seen), {"first": pair_place[seen]} | {c: v[seen] for c, v in total.items()}))
    return pa.concat_tables(batches)


def rows_of(kind: int, n: int, columns: dict) -> pa.Table:
    """Rows of counted_bigrams; what is not given is null."""
    types = {"kind": pa.int32()} | {c: pa.binary() for c in ("firsts", "seconds", "counts", "totals", "rows")}
    names = [c.split()[0] for c in COUNTED.split(", ")]
    columns = {"kind": np.full(n, kind, np.int32)} | columns
    return pa.table({c: pa.array(columns[c], types.get(c, pa.int64())) if c in columns else pa.nulls(n, types.get(c, pa.int64())) for c in names})


def unpack_many(batch: pa.RecordBatch) -> Iterator[tuple]:
    """firsts, seconds, counts and totals by name (one per bigram) and rows (one per occurrence) of each MANY row; -1 for a word that is not known."""
    for pairs, size, firsts, seconds, counts, totals, rows in zip(
            *(batch[c].to_pylist() for c in ("pairs", "size", "firsts", "seconds", "counts", "totals", "rows")), strict=True):
        yield (unpacked(firsts, pairs), unpacked(seconds, pairs), dict(zip(COUNTS, unpacked(counts, 2 * pairs).reshape(2, -1), strict=True)),
               dict(zip(TOTALS, unpacked(totals, 6 * pairs).reshape(6, -1), strict=True)), unpacked(rows, size))


def known_totals(counted: DataFrame) -> DataFrame:
    """id and TOTALS of the known words (and START) outside the dense table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros(KNOWN + 1, np.int64) for c in TOTALS}
        for batch in batches:
            for first, second, count, *_ in unpack_many(batch):
                for m in MODELS:
                    for name, ids, weight in (("n", first, count[m]), ("kinds", first, count[m] > 0), ("word", second, count[m])):
                        sums[f"{name}_{m}"] += sums_of(ids[ids >= 0], weight[ids >= 0], KNOWN + 1)
        at = np.flatnonzero(sums["n_background"] + sums["word_background"])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(sums[c][at]) for c in TOTALS]], names=["id", *TOTALS])

    many = counted.filter(F.col("kind") == MANY).mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in TOTALS))
    # bigrams of a known and another word are packed too; those of two others hold no known word
    return many.groupBy("id").agg(*[F.sum(c).alias(c) for c in TOTALS])


def positive(values: np.ndarray) -> np.ndarray:
    return np.maximum(values, 0)


def bigram_loss(count, total, kinds, share, positive=positive, log=np.log):
    """-log P(second | first): absolute discount, interpolated with the second word's share; a context never seen leaves that alone.
    Of arrays, or of columns with their own functions."""
    return -log((positive(count - DISCOUNT) + (DISCOUNT * kinds + CONTEXT_PRIOR) * share) / (total + CONTEXT_PRIOR))


class Totals:
    """What a model holds outside its bigrams: documents' words and different words."""

    def __init__(self, words: int, different: int):
        self.whole = words + UNIGRAM_FLOOR * different

    def share(self, occurrences):
        """Smoothed share of a word, for numbers, arrays and columns."""
        return (occurrences + UNIGRAM_FLOOR) / (self.whole or 1.0)


def score_documents(docs: DataFrame, targets: DataFrame, known_words_at_most: int = KNOWN) -> DataFrame:
    """docs scored against the documents whose ids are in targets (doc_id): doc_id, n_tokens, target_loss, background_loss, score.

    known_words_at_most sets how many words are numbered; the scores are the same whatever it is."""
    context = docs.sparkSession.sparkContext
    words = stored(word_counts(docs), "words")
    vocabulary = context.broadcast(vocabulary_of(words, known_words_at_most))
    wanted = targets.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("target_id")).distinct()
    # labels grow with the corpus: joined the same way at every size, never broadcast
    rows = stored(tokenised(docs, vocabulary).join(wanted.hint("merge"), F.col("doc_id") == F.col("target_id"), "left").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("target_id").isNotNull().alias("is_target"), "n_tokens", "tokens", "others"), "tokens")
    sums = rows.agg(F.sum("n_tokens").alias("background"), F.sum(F.when(F.col("is_target"), F.col("n_tokens"))).alias("target")).first()
    different = words.count()
    totals = {m: Totals(sums[m] or 0, different) for m in MODELS}

    frequent = frequent_counts(rows).toArrow()  # (FREQUENT + 1) * FREQUENT rows at most
    tables = {m: np.zeros((FREQUENT + 1, FREQUENT)) for m in MODELS}
    for m in MODELS:
        tables[m].flat[frequent["pair"].to_numpy()] = frequent[m].to_numpy()
    dealt = dealt_bigrams(rows, 1 + (sums["background"] or 0) // BUCKET)
    counted = stored(dealt.groupBy("bucket").applyInArrow(count_bucket, COUNTED), "bigrams")

    outside = known_totals(counted).toArrow()  # KNOWN + 1 rows at most
    known = {c: np.zeros(KNOWN + 1, np.int64) for c in TOTALS}
    frequents = [*range(FREQUENT), START]
    for c in TOTALS:
        known[c][outside["id"].to_numpy()] = outside[c].to_numpy()
    dense = []
    for m in MODELS:
        known[f"n_{m}"][frequents] += tables[m].sum(axis=1).astype(np.int64)
        known[f"kinds_{m}"][frequents] += np.count_nonzero(tables[m], axis=1)
        known[f"word_{m}"][:FREQUENT] += tables[m].sum(axis=0).astype(np.int64)
        dense.append(bigram_loss(tables[m], known[f"n_{m}"][frequents, None], known[f"kinds_{m}"][frequents, None],
                                 totals[m].share(known[f"word_{m}"][:FREQUENT])).astype(np.float32).ravel())
    models = context.broadcast(dense)
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
                           *[T.StructField(f"dense_{m}", T.DoubleType()) for m in MODELS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost: list[list[float]] = [[], []]
            for n_tokens, tokens, others in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                place, held = dense_places(ids_of(n_tokens, tokens, others))
                at = place[held]
                for found, model in zip(lost, models.value, strict=True):
                    found.append(float(model[at].sum(dtype=np.float64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(found, pa.float64()) for found in lost]], names=schema.names)

    scored = rows.select("row", "doc_id", "n_tokens", "tokens", "others").mapInArrow(run, schema)
    rest = rest_losses(counted, context.broadcast(known), totals)
    loss = {m: (F.col(f"dense_{m}") + F.coalesce(f"rest_{m}", F.lit(0.0))) / F.when(F.col("n_tokens") > 0, F.col("n_tokens")) for m in MODELS}
    return scored.join(rest, "row", "left").select("doc_id", "n_tokens", loss["target"].alias("target_loss"), loss["background"].alias("background_loss"),
                                                   (loss["target"] - loss["background"]).alias("score"))


def rest_losses(counted: DataFrame, known, totals: dict[str, Totals]) -> DataFrame:
    """row and per model the summed losses of its bigrams outside the dense table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, second, count, total, rows in unpack_many(batch):
                found, at = np.unique(rows, return_inverse=True)
                lost = []
                for m in MODELS:
                    n, kinds, word = (np.where(ids >= 0, known.value[f"{name}_{m}"][ids], total[f"{name}_{m}"])
                                      for name, ids in (("n", first), ("kinds", first), ("word", second)))
                    loss = bigram_loss(count[m], n, kinds, totals[m].share(word))
                    lost.append(np.bincount(at, np.repeat(loss, count["background"]), len(found)))
                together, start = np.unique(found >> TOGETHER, return_index=True)
                parts = [slice(i, j) for i, j in zip(start, [*start[1:], len(found)], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(together, pa.int64()), pa.array([p.stop - p.start for p in parts], pa.int64()),
                    *[pa.array([packed(c[p]) for p in parts], pa.binary()) for c in (found & (1 << TOGETHER) - 1, *lost)]], names=["together", "n", "at", *MODELS])

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros((2, 1 << TOGETHER))
        seen = np.zeros(1 << TOGETHER, bool)
        for n, at, *lost in zip(*(table[c].to_pylist() for c in ("n", "at", *MODELS)), strict=True):
            at = unpacked(at, n)
            seen[at] = True
            for total, loss in zip(sums, lost, strict=True):
                total[at] += unpacked(loss, n, "<f8")
        at = np.flatnonzero(seen)
        return pa.table({"row": at + (table["together"][0].as_py() << TOGETHER)} | {m: total[at] for m, total in zip(MODELS, sums, strict=True)})

    summed = "row long, " + ", ".join(f"{m} double" for m in MODELS)
    many = counted.filter(F.col("kind") == MANY).mapInArrow(run, "together long, n long, at binary, " + ", ".join(f"{m} binary" for m in MODELS)).groupBy(
        "together").applyInArrow(add, summed)
    firsts = counted.filter(F.col("kind") == FIRST).select("first", *[c for c in TOTALS if not c.startswith("word")])
    ones = counted.filter(F.col("kind") == ONE).select("row", "first", *COUNTS, *[f"word_{m}" for m in MODELS]).join(firsts.hint("merge"), "first").select(
        "row", *[bigram_loss(F.col(m), F.col(f"n_{m}"), F.col(f"kinds_{m}"), totals[m].share(F.col(f"word_{m}")),
                             lambda c: F.greatest(c, F.lit(0.0)), F.log).alias(m) for m in MODELS])
    return many.unionByName(ones).groupBy("row").agg(*[F.sum(m).alias(f"rest_{m}") for m in MODELS])
