"""Byte-level BPE encoding and decoding in length-bucketed numpy matrices.

Method. A text is cut by the vocabulary's pattern into pre-tokens; each is encoded separately. The distinct pre-tokens of a batch
of texts are put into matrices, one per bucket of byte lengths, padded with -1. In every round each row
merges its leftmost pair of minimum rank; ranks of pairs come from an open-addressing hash table in numpy arrays. Rows without a
pair left leave the matrix (compaction). Rows of the longest buckets merge, in one round, as many further places of the same pair as
cannot be overtaken by a lower pair that a merge makes, which gives the same result as one at a time.

Decoding joins the bytes of the ids. Texts are handled one by one inside a partition and whole; the memory of a worker holds the
hash table and one batch of texts. There is no shuffle.

Defined results: a null text counts as empty (0 tokens, digests of no bytes); repeated rows give repeated rows; an empty table gives
an empty result; other columns are ignored; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: Upper byte lengths of the buckets; longer pre-tokens form buckets by powers of two.
BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128)
#: Cells of a matrix at most, so that a bucket with many rows is encoded in several.
MATRIX_CELLS = 1 << 19
#: From this length on, several places of a row merge in one round.
LONG_ROW = 128
NO_RANK = np.int32(2**31 - 1)
HASH_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Hash table from a pair of ids to the id of their concatenation, with linear probing."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        bits = int(len(pairs) * 4).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int32)
        left, slots, self.probes = np.arange(len(pairs)), self._slots(pairs), 0
        while len(left):
            at = (slots[left] + self.probes) & self.mask
            free = self.keys[at] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True  # of those that want the same slot, one gets it
            won = free & first
            self.keys[at[won]], self.values[at[won]] = pairs[left[won]], ranks[left[won]]
            left = left[~won]
            self.probes += 1

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * HASH_FACTOR) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NO_RANK where it has none or a side is padding (-1)."""
        pairs = (left.astype(np.int64) << 32) | right
        slots = self._slots(pairs)
        keys = self.keys[slots]
        found = np.where(keys == pairs, self.values[slots], NO_RANK)
        open_ = np.nonzero((keys != pairs) & (keys >= 0) & (left >= 0) & (right >= 0))
        for probe in range(1, self.probes):
            if not len(open_[0]):
                break
            at = (slots[open_] + probe) & self.mask
            keys = self.keys[at]
            hit = keys == pairs[open_]
            found[tuple(x[hit] for x in open_)] = self.values[at[hit]]
            on = ~hit & (keys >= 0)
            open_ = tuple(x[on] for x in open_)
        found[(left < 0) | (right < 0)] = NO_RANK
        return found


class Vocabulary:
    """Ranks, the byte ids and the pair table of a rank file's content."""

    def __init__(self, content: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        pairs, merged = [], []
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left << 32) | right)
                    merged.append(rank)
        self.table = PairTable(np.array(pairs, np.int64), np.array(merged, np.int32))

    def encode_distinct(self, tokens: pa.Array) -> "Ragged":
        """Ids of every pre-token."""
        offsets = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset:tokens.offset + len(tokens) + 1]
        raw = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
        starts, lengths = offsets[:-1], np.diff(offsets)
        edges = [*BUCKETS]
        while edges[-1] < lengths.max(initial=0):
            edges.append(edges[-1] * 2)
        bucket = np.searchsorted(edges, lengths)
        order, parts, counts = [], [], []
        for b in np.unique(bucket):
            rows, width = np.nonzero(bucket == b)[0], edges[b]
            step = max(1, MATRIX_CELLS // width)
            for part in (rows[at:at + step] for at in range(0, len(rows), step)):
                matrix = np.full((len(part), width), -1, np.int32)
                filled = np.arange(width) < lengths[part][:, None]
                matrix[filled] = self.of_byte[concatenated(raw, starts[part], lengths[part])]
                merge = self._merge_long if width > LONG_ROW else self._merge_matrix
                for numbers, ids, sizes in merge(matrix):
                    order.append(part[numbers])
                    parts.append(ids)
                    counts.append(sizes)
        if not order:
            return Ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64))
        done = Ragged(np.concatenate(parts).astype("<u4"), np.concatenate(counts))
        back = np.argsort(np.concatenate(order))
        return Ragged(concatenated(done.flat, done.starts[back], done.lengths[back]), done.lengths[back])

    def _merge_matrix(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Yields row numbers, their ids one after the other, and how many each has, as rows are done."""
        alive = np.arange(len(ids))
        ranks = self.table.rank(ids[:, :-1], ids[:, 1:])
        while len(alive):
            at = ranks.argmin(axis=1)  # the leftmost of equal ranks
            best = ranks[np.arange(len(alive)), at]
            if (over := best == NO_RANK).any():
                lines = ids[over]
                yield alive[over], lines[lines >= 0], np.count_nonzero(lines >= 0, axis=1)
                on = ~over
                alive, ids, ranks, at, best = alive[on], ids[on], ranks[on], at[on], best[on]
                if not len(alive):
                    break
            # the pair becomes one id and its second column goes: each row is one column shorter, so the matrix stays full
            n, width = ids.shape
            rows, columns = np.arange(n), np.arange(width, dtype=np.int32)
            ids[rows, at] = best
            ids = ids[columns != at[:, None] + 1].reshape(n, width - 1)
            if width == 2:
                ranks = np.full((n, 1), NO_RANK)
                ids = np.pad(ids, ((0, 0), (0, 1)), constant_values=-1)
                continue
            ranks = ranks[columns[:-1] != at[:, None]].reshape(n, width - 2)
            left, right = at > 0, at < width - 2
            l_row, r_row, l_at, r_at = rows[left], rows[right], at[left], at[right]
            fresh = self.table.rank(np.concatenate((ids[l_row, l_at - 1], ids[r_row, r_at])),
                                    np.concatenate((ids[l_row, l_at], ids[r_row, r_at + 1])))
            ranks[l_row, l_at - 1], ranks[r_row, r_at] = fresh[:len(l_row)], fresh[len(l_row):]

    def _merge_long(self, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for number, row in enumerate(matrix):
            ids = row[row >= 0]
            ranks = self.table.rank(ids[:-1], ids[1:])
            while len(ranks) and (best := ranks.min()) != NO_RANK:
                ids = self._merge_places(ids, ranks, best)
                ranks = self.table.rank(ids[:-1], ids[1:])
            yield np.array([number]), ids, np.array([len(ids)])

    def _merge_places(self, ids: np.ndarray, ranks: np.ndarray, best: np.int32) -> np.ndarray:
        """Merge places of the lowest rank from left to right, up to the first merge that makes a lower pair."""
        places = np.nonzero(ranks == best)[0]
        # places that follow each other overlap: of such a run every second one merges
        run_start = np.concatenate(([True], np.diff(places) > 1))
        in_run = np.arange(len(places)) - np.maximum.accumulate(np.where(run_start, np.arange(len(places)), 0))
        places = places[in_run % 2 == 0]
        before = np.where(places > 0, ids[places - 1], -1)
        touching = np.concatenate(([False], places[1:] == places[:-1] + 2))
        before = np.where(touching, best, before)
        after = np.where(places + 2 < len(ids), ids[np.minimum(places + 2, len(ids) - 1)], -1)
        merged = np.full(len(places), best)
        lower = (self.table.rank(before, merged) < best) | (self.table.rank(merged, after) < best)
        if lower.any():
            places = places[:int(lower.argmax()) + 1]
        ids = ids.copy()
        ids[places] = best
        return np.delete(ids, places + 1)


def concatenated(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges [start, start + length) of flat, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Ragged:
    """Rows of different lengths in one array."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def over(self, codes: "Ragged") -> "Ragged":
        """Rows of codes, each code replaced by the row that it stands for."""
        lengths = self.lengths[codes.flat]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return Ragged(concatenated(self.flat, self.starts[codes.flat], lengths),
                      total[codes.starts + codes.lengths] - total[codes.starts])


#: White space right before a space, or a space at the start: the space then belongs to a longer run.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LONG_SPACE = f"[{SPACES}] |^ "
RUN_AND_REST = regex.compile(r"\s*\S+|\s+")


class Encoder:
    """Encodes batches of whole texts.

    No match of the pattern goes from a character that is not white space to one that is, so a text may be cut there first. Pieces
    cut at spaces repeat much within a batch: only the distinct ones go through the pattern, all in one string, and of the
    pre-tokens found only the distinct ones are merged.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.token_bytes = Ragged(np.frombuffer(b"".join(vocabulary.tokens), np.uint8), np.array([len(t) for t in vocabulary.tokens]))

    def encode(self, texts: pa.Array) -> Ragged:
        """Ids of every text; null counts as empty."""
        names, codes = self._cut(texts.fill_null("").cast(pa.large_string()))
        return self._encode_pieces(names).over(codes)

    def _cut(self, texts: pa.Array) -> tuple[list[str], Ragged]:
        """Distinct pieces, and every text as a row of their numbers."""
        dirty = pc.match_substring_regex(texts, LONG_SPACE)
        split = pc.split_pattern(texts.filter(pc.invert(dirty)), " ")
        offsets = split.offsets.to_numpy()
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        names = [" " + piece for piece in coded.dictionary.to_pylist()]
        flat = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = offsets[:-1] - offsets[0]
        # the first piece of a text has no space before it, and texts with longer runs are cut by pattern: numbered on their own
        heads = split.values.take(pa.array(offsets[:-1])).to_pylist()
        other = [[head] for head in heads] + [RUN_AND_REST.findall(text) for text in texts.filter(dirty).to_pylist()]
        number = {piece: len(names) + i for i, piece in enumerate(dict.fromkeys(p for pieces in other for p in pieces))}
        names += number
        flat[starts] = [number[head] for head in heads]
        rest = [np.fromiter((number[p] for p in pieces), np.int64, len(pieces)) for pieces in other[len(heads):]]
        # back into the order of the texts
        lengths = np.zeros(len(texts), np.int64)
        is_dirty = dirty.to_numpy(zero_copy_only=False).astype(bool)
        lengths[~is_dirty], lengths[is_dirty] = np.diff(offsets), [len(r) for r in rest]
        if not rest:
            return names, Ragged(flat, lengths)
        pool = Ragged(np.concatenate((flat, *rest)), np.concatenate((lengths[~is_dirty], lengths[is_dirty])))
        order = np.argsort(np.concatenate((np.nonzero(~is_dirty)[0], np.nonzero(is_dirty)[0])))
        return names, Ragged(concatenated(pool.flat, pool.starts[order], pool.lengths[order]), lengths)

    def _encode_pieces(self, pieces: list[str]) -> Ragged:
        joinable = [bool(p) and p[0].isspace() and not p[-1].isspace() for p in pieces]
        joined = [p for p, j in zip(pieces, joinable, strict=True) if j]
        tokens = self.vocabulary.pattern.findall("".join(joined))
        token_ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        piece_ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        counts = np.zeros(len(pieces), np.int64)
        is_joined = np.array(joinable, bool)
        counts[is_joined] = np.diff(np.searchsorted(token_ends, piece_ends, side="right"), prepend=0)
        apart = [self.vocabulary.pattern.findall(p) for p, j in zip(pieces, joinable, strict=True) if not j]
        counts[~is_joined] = [len(found) for found in apart]
        coded = pa.array(tokens + [t for found in apart for t in found], pa.large_string()).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # rows of joined pieces come first in `code`; put them in the order of the pieces
        starts = np.empty(len(pieces), np.int64)
        for mask in (is_joined, ~is_joined):
            starts[mask] = np.cumsum(counts[mask]) - counts[mask]
        starts[~is_joined] += len(tokens)
        rows = Ragged(concatenated(code, starts, counts), counts)
        return self.vocabulary.encode_distinct(coded.dictionary).over(rows)

    def decode(self, ids: Ragged) -> Ragged:
        """Bytes that the ids of every row stand for."""
        return self.token_bytes.over(ids)


_encoders: dict[tuple, Encoder] = {}


def encoder_for(content: bytes, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary; building its tables takes about a second."""
    key = (hashlib.sha256(content).digest(), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(content, pattern))
    return _encoders[key]


#: Bytes of text that are encoded together, unless a single text is longer.
CHUNK_BYTES = 2 << 20


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `CHUNK_BYTES` of text."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
    number = np.cumsum(sizes) // CHUNK_BYTES
    edges = [0, *(np.nonzero(np.diff(number))[0] + 1).tolist(), len(texts)]
    return zip(edges[:-1], edges[1:], strict=True)


def _digests(rows: Ragged) -> pa.Array:
    raw, width = memoryview(rows.flat.view(np.uint8)), rows.flat.itemsize
    return pa.array([hashlib.sha256(raw[a * width:(a + n) * width]).hexdigest() for a, n in zip(rows.starts.tolist(), rows.lengths.tolist(), strict=True)],
                    pa.string())


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes; with keep_ids also the ids as array<int>.

    The rank file is read on the driver and sent to the workers (its size is that of the vocabulary)."""
    with open(vocabulary_path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(content.value, pattern)
        for batch in batches:
            names = batch.schema.names
            doc_ids, texts = batch.column(names.index("doc_id")), batch.column(names.index("text"))
            for start, end in _chunks(texts):
                ids = encoder.encode(texts.slice(start, end - start))
                columns = [doc_ids.slice(start, end - start), pa.array(ids.lengths), _digests(ids), _digests(encoder.decode(ids))]
                if keep_ids:
                    ends = np.concatenate(([0], np.cumsum(ids.lengths))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(ids.flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select("doc_id", F.col("text")).mapInArrow(run, T.StructType(fields))
