"""Token counts from distinct pre-tokens, without materialising the ids of a document.

Method. A SentencePiece BPE text falls into pre-tokens that no piece of the vocabulary crosses: a run of spaces followed by other
characters, and line ends on their own (`check_model` proves this for the model at hand). Every document is reduced to the
frequencies of its distinct pre-tokens; the pieces of each distinct pre-token are counted once; the two are joined and summed.

The join has two parts, by size. Pre-tokens that are common in a sample of documents, at most `COMMON` of at most `COMMON_CHARS`
characters, are counted once and sent to every worker: a table of bounded size that meets most of the text without a shuffle. The
others go, with document and frequency, to the partition of their hash: a distinct pre-token occurs in one partition only, is
counted there, and sums per document leave the partition. The sample only decides which way a pre-token takes, never the result.

Defined results: null counts as empty (0 bytes, 0 tokens); rows with equal id and text are counted once and returned as often as
they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from shelfline.llm.common import stored, uniform

COMMON = 1 << 18
COMMON_CHARS = 64
#: Documents sampled, about, to find the common pre-tokens.
SAMPLE_DOCUMENTS = 20_000
SPACE = "▁"  # how the model writes a space
#: Pre-tokens that a task counts at a time.
COUNT_BATCH = 50_000

_processors: dict[bytes, sentencepiece.SentencePieceProcessor] = {}


def processor_for(model: bytes) -> sentencepiece.SentencePieceProcessor:
    if model not in _processors:
        _processors[model] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _processors[model]


def check_model(processor: sentencepiece.SentencePieceProcessor) -> None:
    """Pre-tokens are independent if no piece has a space after another character and none has a line end, and if the model leaves
    texts as they are but for one space put before."""
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i):
            continue
        if "\n" in piece or SPACE in piece.lstrip(SPACE):
            raise ValueError(f"pieces of this model cross pre-tokens: {piece!r}")
    probe = "  a　 ﬁ\n b "
    if processor.decode(processor.encode(probe)).replace(SPACE, " ") != probe:
        raise ValueError("this model changes texts before it encodes them")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, spaces as they are; the space that the model puts before a text belongs to the first."""
    found = []
    for i, line in enumerate((" " + text.replace(SPACE, " ")).split("\n") if text else []):
        if i:
            found.append("\n")
        if "  " not in line:
            head, *rest = line.split(" ")
            found += [head] if head else []
            found += [" " + word for word in rest]
        else:
            run = ""
            for j, word in enumerate(line.split(" ")):
                run += " " if j else ""
                if word:
                    found.append(run + word)
                    run = ""
            found += [run] if run else []
    return found


def count_pieces(processor: sentencepiece.SentencePieceProcessor, tokens: list[str]) -> np.ndarray:
    """Pieces of each pre-token. The model puts a space before a text; before "\\n" it is a piece of its own, as is "\\n"."""
    return np.fromiter(map(len, processor.encode(["\n" + t for t in tokens], num_threads=1)), np.int64, len(tokens)) - 2


def common_counts(docs: DataFrame, model) -> dict[str, int]:
    """Pieces of the pre-tokens that are most frequent in a sample of documents."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(t for t in pre_tokens(text or "") if len(t) <= COMMON_CHARS)
        best = found.most_common(COMMON)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["token", "n"])

    rows = docs.count()
    sample = docs.filter(uniform(F.col("doc_id"), F.lit("common")) * F.lit(float(max(rows, 1))) < SAMPLE_DOCUMENTS).select("text")
    counted = stored(sample.mapInArrow(distinct, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "common")
    # the least frequency that no more than COMMON pre-tokens reach; one row per frequency
    least, reached = None, 0
    for level in counted.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).collect():
        reached += level.tokens
        if reached > COMMON:
            break
        least = level.n
    top = [] if least is None else [r.token for r in counted.filter(F.col("n") >= least).select("token").collect()]
    return dict(zip(top, count_pieces(processor_for(model.value), top).tolist(), strict=True))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    check_model(processor_for(model.value))
    common = docs.sparkSession.sparkContext.broadcast(common_counts(docs, model))
    id_type = docs.schema["doc_id"].dataType

    # one row per document (token null, with the sum of its common pre-tokens) and one per other distinct pre-token of it
    fields = T.StructType([T.StructField("doc_id", id_type), T.StructField("digest", T.LongType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("token", T.StringType()), T.StructField("n", T.LongType())])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        for batch in batches:
            row, tokens, counts = [], [], []
            texts = batch.column(3).to_pylist()
            for i, text in enumerate(texts):
                known = 0
                for token, n in Counter(pre_tokens(text or "")).items():
                    pieces = table.get(token)
                    if pieces is None:
                        row.append(i)
                        tokens.append(token)
                        counts.append(n)
                    else:
                        known += n * pieces
                row.append(i)
                tokens.append(None)
                counts.append(known)
                if len(row) > COUNT_BATCH or i == len(texts) - 1:
                    at = pa.array(row, pa.int32())
                    # the size goes with the document's own row only
                    size = pc.if_else(pa.array([t is None for t in tokens]), batch.column(2).take(at), pa.scalar(None, pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), size] + [pa.array(tokens, pa.string()), pa.array(counts, pa.int64())],
                                                     names=fields.names)
                    row, tokens, counts = [], [], []

    sums = T.StructType([T.StructField("doc_id", id_type), T.StructField("digest", T.LongType()), T.StructField("n_bytes", T.LongType()),
                         T.StructField("tokens", T.LongType()), T.StructField("copies", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = processor_for(model.value)
        for batch in batches:
            tokens = batch.column(3).dictionary_encode()
            pieces = count_pieces(processor, tokens.dictionary.to_pylist())
            is_doc = tokens.is_null().to_numpy(zero_copy_only=False)
            each = np.ones(len(batch), np.int64)
            if len(pieces):
                each[~is_doc] = pieces[tokens.indices.drop_null().to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)] + [pa.array(batch.column(4).to_numpy() * each), pa.array(is_doc.astype(np.int64))],
                                             names=sums.names)

    source = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    # documents' own rows have no token and go by document
    deal = F.when(F.col("token").isNull(), F.xxhash64("doc_id", "digest")).otherwise(F.xxhash64("token"))
    spread = source.mapInArrow(reduced, fields).repartition(deal).sortWithinPartitions("token")
    totals = spread.mapInArrow(counted, sums).groupBy("doc_id", "digest").agg(F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("tokens"), F.sum("copies").alias("copies"))
    per_copy = F.expr("tokens div copies")
    return totals.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id", "n_bytes", per_copy.alias("n_tokens"), (per_copy > limit).alias("over_limit"))
