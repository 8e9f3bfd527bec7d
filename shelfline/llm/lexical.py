"""Ranked lexical search in reverse: the items are the index, the documents stream through it.

Method. The terms of the items form an inverted index (term -> item, repeats) that is broadcast; every document's term counts are
looked up in it, each hit adds to the scores of the items that hold the term, and a bounded heap per item keeps the best documents of
a task. The heaps of all tasks, at most `k` rows an item and task, are merged by rank. The documents are read twice: once for the
corpus figures (documents, terms, documents per indexed term), once for the scores; no text is shuffled or written.

The index never grows with the data: items are dealt into blocks of about `POSTINGS` postings, each block is one pass of the two
steps, and only the block's own index is on the driver and in the broadcast (an item with more postings is a block of its own size).
Scores are 64-bit integers; a task holds at most `CELLS` of them at once and reads long texts in pieces of `PIECE` bytes.

Defined results: terms are the maximal runs of ASCII letters, ASCII digits and characters beyond ASCII, A-Z in lower case. Null and empty texts
have no term, neither have texts of separators only; such documents count for nothing, such items have no rows. Repeated documents are
documents of their own; a null id comes after all others among equal scores. Repeated item rows count once; different texts under one
id (also a null id) are ranked each for itself. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfline.llm.common import stored

POSTINGS = 262_144
CELLS = 1 << 20
PIECE = 1 << 22
#: Every byte that separates terms becomes a space, every other ASCII letter its lower case.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
LAST = np.iinfo(np.int64).min


def term_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some megabytes of it at a time."""
    start, end = 0, len(text or b"")
    while start < end:
        # a piece ends at a separator, so no term is cut; bytes beyond ASCII never separate
        stop = start + PIECE
        while stop < end and FOLD[text[stop]] != 32:
            stop += 1
        yield text[start:stop].translate(FOLD).split()
        start = stop


class Index:
    """Inverted index of a block of items: term -> items and repeats, as flat arrays."""

    def __init__(self, postings: pa.Table):
        rows = sorted(zip(*(postings.column(c).to_pylist() for c in ("term", "item_id", "item_hash", "repeats")), strict=True),
                      key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
        self.items = sorted({r[1:3] for r in rows}, key=lambda i: (i[0] is None, i[0] or 0, i[1]))
        at = {item: i for i, item in enumerate(self.items)}
        self.terms: dict[bytes, int] = {}
        for r in rows:
            self.terms.setdefault(r[0], len(self.terms))
        self.item = np.array([at[r[1:3]] for r in rows], np.int64)
        self.repeats = np.array([r[3] for r in rows], np.int64)
        self.start = np.searchsorted(np.array([self.terms[r[0]] for r in rows]), np.arange(len(self.terms) + 1))

    def weigh(self, documents: int, length: int, frequency: dict[int, int]) -> None:
        self.documents, self.length = documents, length
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(self.terms))], np.int64)

    def scores(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Matrix of documents by items from (document, term, count) and the documents' lengths."""
        total = np.zeros(len(lengths) * len(self.items), np.int64)
        norm = 75 + (25 * lengths * self.documents) // self.length
        part = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm[doc]))
        width = self.start[term + 1] - self.start[term]
        ends = np.cumsum(width)
        low = 0
        while low < len(doc):
            # entries are expanded to their postings some at a time; one entry has at most the block's postings
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + CELLS, "right")))
            each = width[low:high]
            posting = np.repeat(self.start[term[low:high]] - (ends[low:high] - each - before), each) + np.arange(ends[high - 1] - before)
            np.add.at(total, np.repeat(doc[low:high] * len(self.items), each) + self.item[posting], np.repeat(part[low:high], each) * self.repeats[posting])
            low = high
        return total.reshape(len(lengths), len(self.items))


class Heaps:
    """The k best (score, document) of every item; equal scores keep the smaller id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.heaps: list[list[tuple[int, int, int | None]]] = [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)
        self.least_order = np.full(items, LAST)

    def update(self, scores: np.ndarray, ids: list[int | None]) -> None:
        order = np.array([LAST if i is None else ~i for i in ids], np.int64)
        # what is not among the block's own k best, ties included, cannot enter
        floor = np.partition(scores, -self.k, axis=0)[-self.k] if len(ids) > self.k else 0
        enters = (scores >= np.maximum(floor, 1)) & ((scores > self.least) | ((scores == self.least) & (order[:, None] > self.least_order)))
        for row, item in zip(*np.nonzero(enters), strict=True):
            heap, entry = self.heaps[item], (int(scores[row, item]), int(order[row]), ids[row])
            if len(heap) < self.k:
                heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item], self.least_order[item] = heap[0][:2]


def postings_of(items: DataFrame) -> DataFrame:
    """One row per item and distinct term: item_id, item_hash, term, repeats."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                counts: Counter = Counter()
                for terms in term_lists(text):
                    counts.update(terms)
                if counts:
                    at = pa.array([i] * len(counts), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(list(counts), pa.binary()),
                                                      pa.array(list(counts.values()), pa.int64())], names=["item_id", "item_hash", "term", "repeats"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return rows.select("item_id", F.xxhash64("text").alias("item_hash"), F.col("text").cast("binary").alias("text")).mapInArrow(
        counted, "item_id long, item_hash long, term binary, repeats long")


def corpus_figures(docs: DataFrame, terms) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms in all, and documents per indexed term."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        frequency, documents, length = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, found = 0, set()
                for some in term_lists(text):
                    n += len(some)
                    found |= known.keys() & set(some)
                documents, length = documents + (n > 0), length + n
                frequency[[known[t] for t in found]] += 1
        at = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(frequency[at], documents)), pa.array(np.append(at * 0, length))],
                                         names=["term", "documents", "length"])

    found = docs.select(F.col("text").cast("binary")).mapInArrow(counted, "term long, documents long, length long").groupBy("term").agg(
        F.sum("documents").alias("documents"), F.sum("length").alias("length")).collect()
    figures = {r.term: r for r in found}
    whole = figures.pop(-1, None)
    return (whole.documents, whole.length, {t: r.documents for t, r in figures.items()}) if whole else (0, 0, {})


def best_of_tasks(docs: DataFrame, index, k: int) -> DataFrame:
    """The heaps of every task as rows."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        heaps = Heaps(len(own.items), k)
        step = max(1, CELLS // len(own.items))
        for batch in batches:
            for low in range(0, len(batch), step):
                part = batch.slice(low, step)
                doc, term, tf, lengths = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    n, counts = 0, Counter()
                    for some in term_lists(text):
                        n += len(some)
                        counts.update(filter(own.terms.__contains__, some))
                    lengths.append(n)
                    doc += [i] * len(counts)
                    term += map(own.terms.__getitem__, counts)
                    tf += counts.values()
                if doc:
                    heaps.update(own.scores(*(np.array(x, np.int64) for x in (doc, term, tf, lengths))), part.column(0).to_pylist())
        rows = [(*own.items[i], entry[2], entry[0]) for i, heap in enumerate(heaps.heaps) for entry in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["item_id", "item_hash", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(scored, "item_id long, item_hash long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of every item: item_id, item_hash, rank, doc_id, score."""
    context = docs.sparkSession.sparkContext
    postings = stored(postings_of(items), "postings")
    blocks = -(-postings.count() // POSTINGS)
    dealt = postings.withColumn("block", F.pmod(F.xxhash64("item_id", "item_hash"), F.lit(max(blocks, 1))))
    found = None
    for block in range(blocks):
        index = Index(dealt.filter(F.col("block") == block).toArrow())
        if not index.items:
            continue
        terms = context.broadcast(index.terms)
        documents, length, frequency = corpus_figures(docs, terms)
        terms.unpersist()
        if not documents:
            break
        index.weigh(documents, length, frequency)
        best = best_of_tasks(docs, context.broadcast(index), k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, item_hash long, doc_id long, score long")
    place = Window.partitionBy("item_id", "item_hash").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("item_id", "item_hash", "rank", "doc_id", "score")
