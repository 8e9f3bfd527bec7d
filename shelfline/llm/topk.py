"""Exact top-k search by inner product with multi-resolution segment statistics.

Method. Vectors are cut into segments; a segment is described by its mean and its deviation. For a query q and a row x the inner
product is at most the sum over segments of length s of  s * mean(q) * mean(x) + s * dev(q) * dev(x)  (Cauchy-Schwarz on what is left
of the means), which is the same bound as the lower bound on their distance, as |q - x|^2 = |q|^2 + |x|^2 - 2 q.x. Bounds run from
one segment to sixteen; rows whose bound falls below the query's k-th best exact score so far are dropped at each level, and exact
integer products are computed for the survivors only. The first rows that get exact scores are those with the highest coarse bounds.

Queries and rows meet in blocks: rows are dealt into blocks of about `ROW_BLOCK` and queries into blocks of about `QUERY_BLOCK`; every
pair of blocks is one group of bounded size and leaves k candidates per query, of which the best k over all row blocks remain. So a row is
copied once per `QUERY_BLOCK` queries; inside a group, queries are taken `CHUNK` at a time.

Defined results: components are floor(1024 * x) of the double x. Vectors that are null, empty, or hold a null or non-finite component
take no part, nor do null ids. Vectors with components so large that a product could leave 64 bits are scored with whole numbers of
any length; a score beyond 64 bits is given as the nearest 64-bit number (ties to the smaller id). Only vectors of equal length are compared. Rows that repeat an id are one row if
their vectors agree; otherwise each is a candidate of its own and, for a query id, each is a query and none its candidate. Ties go to
the smaller id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelfline.llm.common import stored

LEVELS = (1, 4, 16)
ROW_BLOCK = 16_384
QUERY_BLOCK = 4096
CHUNK = 256
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1
RESULT = "query_id long, q_hash long, vec_id long, score long"


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, vec (array<double> of whole numbers), dim and hash of the vectors that take part; repeated rows once."""
    # rounding down with a scale keeps a double; floor alone would be cut to 64 bits
    scaled = F.transform("embedding", lambda x: whole_below(x.cast("double") * 1024))
    finite = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return embeddings.filter(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), scaled.alias("vec")).distinct().withColumns(
        {"dim": F.size("vec"), "hash": F.xxhash64("vec")})


def whole_below(x):
    """The greatest whole number not above a double, as a double; from 2^52 on all doubles are whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


class Exact:
    """Inner products of queries and rows without rounding: 64-bit integers where no sum can leave them, else Python integers."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray):
        limit = 2.0 ** 31 / np.sqrt(rows.shape[1]) - 1
        self.queries, self.rows = queries, rows
        self.wide_query, self.wide_row = (np.abs(m).max(axis=1, initial=0) > limit for m in (queries, rows))
        self.int_queries, self.int_rows = (np.where(wide[:, None], 0, m).astype(np.int64) for wide, m in ((self.wide_query, queries), (self.wide_row, rows)))

    def scores(self, query: int, rows: np.ndarray) -> np.ndarray:
        wide = self.wide_row[rows] | self.wide_query[query]
        found = self.int_rows[rows] @ self.int_queries[query]
        if wide.any():
            own = [int(x) for x in self.queries[query]]
            for at in np.nonzero(wide)[0]:
                total = sum(a * int(b) for a, b in zip(own, self.rows[rows[at]], strict=True))
                found[at] = min(max(total, LEAST), GREATEST)
        return found


class Statistics:
    """Means and deviations of equal segments of the rows of a matrix, scaled so that a bound is one matrix product."""

    def __init__(self, matrix: np.ndarray):
        self.levels = []
        for segments in LEVELS:
            n, dim = matrix.shape
            segments = min(segments, dim)
            edges = np.linspace(0, dim, segments + 1).astype(int)
            sizes = np.diff(edges)
            sums = np.add.reduceat(matrix, edges[:-1], axis=1)
            squares = np.add.reduceat(matrix * matrix, edges[:-1], axis=1)
            rest = np.sqrt(np.maximum(squares - sums * sums / sizes, 0))
            self.levels.append(np.hstack((sums / np.sqrt(sizes), rest)))


def top_of_block(queries: tuple[np.ndarray, np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[tuple]:
    """Per query the k best rows of the block, exactly: (query id, query hash, row ids, scores)."""
    (q_ids, q_hashes, q_all), (ids, x_all) = queries, rows
    exact = Exact(q_all, x_all)
    with np.errstate(over="ignore", invalid="ignore"):
        x = Statistics(x_all)
        norms = np.sqrt((x_all ** 2).sum(axis=1))
        for start in range(0, len(q_ids), CHUNK):
            yield from top_of_chunk(slice(start, start + CHUNK), q_ids, q_hashes, q_all, ids, x, norms, exact, k)


def top_of_chunk(part: slice, q_ids, q_hashes, q_all, ids, x: Statistics, norms: np.ndarray, exact: Exact, k: int) -> Iterator[tuple]:
    own = q_all[part]
    q = Statistics(own)
    # rounding: a bound may be too small by a few units in the last place of the norms' product; what cannot be bounded may be best
    slack = 1e-9 * np.sqrt((own ** 2).sum(axis=1))[:, None] * norms + 1e-6
    coarse = np.nan_to_num(q.levels[0] @ x.levels[0].T + slack, nan=np.inf, posinf=np.inf)
    for i in range(len(own)):
        query = part.start + i
        alive = np.nonzero(ids != q_ids[query])[0]
        if len(alive) > k:
            start = alive[np.argpartition(-coarse[i, alive], k - 1)[:k]]
            least = exact.scores(query, start).min()
            alive = alive[coarse[i, alive] >= least]
            for level in range(1, len(LEVELS)):
                if len(alive) <= k:
                    break
                bound = np.nan_to_num(x.levels[level][alive] @ q.levels[level][i] + slack[i, alive], nan=np.inf, posinf=np.inf)
                # the rows that look best at this level raise the score to beat
                best = alive[np.argpartition(-bound, k - 1)[:k]]
                least = max(least, exact.scores(query, best).min())
                alive = alive[bound >= least]
        scores = exact.scores(query, alive)
        order = np.lexsort((ids[alive], ~scores))[:k]
        yield q_ids[query], q_hashes[query], ids[alive][order], scores[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors and queries as from `quantised`: query_id, rank, vec_id, score."""
    counts = vectors.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
    row_blocks, query_blocks = (max(1, -(-n // size)) for n, size in zip(counts, (ROW_BLOCK, QUERY_BLOCK), strict=True))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "hash"), F.lit(n)).cast("int")
    rows = vectors.select("dim", deal(row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"),
                          F.lit(False).alias("asks"), "vec_id", "hash", "vec")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), deal(query_blocks).alias("qb"),
                           F.lit(True).alias("asks"), "vec_id", "hash", "vec")

    def meet(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        asks = table["asks"].to_numpy()
        matrix = table["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        ids, hashes = table["vec_id"].to_numpy(), table["hash"].to_numpy()
        out = list(top_of_block((ids[asks], hashes[asks], matrix[asks]), (ids[~asks], matrix[~asks]), k)) if asks.any() and not asks.all() else []
        sizes = [len(s) for *_, s in out]
        column = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": column([np.repeat(o[0], n) for o, n in zip(out, sizes, strict=True)]),
                         "q_hash": column([np.repeat(o[1], n) for o, n in zip(out, sizes, strict=True)]),
                         "vec_id": column([o[2] for o in out]), "score": column([o[3] for o in out])})

    best = rows.unionByName(asked).groupBy("dim", "rb", "qb").applyInArrow(meet, RESULT)
    order = Window.partitionBy("query_id", "q_hash").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_of_every_hundredth(embeddings: DataFrame, k: int = 10) -> DataFrame:
    vectors = stored(quantised(embeddings), "vectors")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"), k)
