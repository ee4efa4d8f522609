"""Token counts by a byte-fallback BPE model, huge documents in overlapping chunks.

A document of more than ``chunk`` bytes is encoded in chunks that overlap. Two
neighbours are spliced at a token that both hold at the same bytes. That place
is proven stable: BPE merges the best adjacent pair first, so a sequence of
tokens is the encoding of its text exactly if every two adjacent tokens are the
encoding of their own joined text, and each adjacent pair of the spliced
sequence comes from one of the two encodings. Where neighbours share no token
the document is encoded again with chunks and overlaps of twice the size, at
last as one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm._common import materialise

#: Bytes of text given to the library at once.
TEXTS_AT_ONCE = 1_000_000
_MARK = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("id", pa.int32()), ("index", pa.int64())])
_CHUNK = "key long, seq long, start long, next long, overlap long, body binary"
_ENDS = "key long, seq long, n long, head array<struct<begin:long,end:long,id:int,index:long>>, tail array<struct<begin:long,end:long,id:int,index:long>>"


@lru_cache(maxsize=2)
def model(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model at ``path``; an error unless it is BPE without normalisation,
    which the proof of the splice needs."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        spec.ParseFromString(file.read())
    if spec.trainer_spec.model_type != 2 or spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
        raise ValueError(f"{path}: chunks can be spliced for BPE models without normalisation only")
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _count_whole(vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model(vocabulary).encode
        for batch in batches:
            sizes, counts, waiting, held = batch.column("n_bytes").to_pylist(), [], [], 0
            for text, size in zip(batch.column("text"), sizes):
                waiting.append(text.as_py())
                held += size
                if held > TEXTS_AT_ONCE:
                    counts += map(len, encode(waiting, num_threads=1))
                    waiting, held = [], 0
            counts += map(len, encode(waiting, num_threads=1)) if waiting else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    return count


def chunks_of(data: bytes, chunk: int, overlap: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, start of the next, bytes): chunks of about ``chunk`` bytes and
    about ``overlap`` bytes of the next one, cut between characters only."""

    def cut(at: int) -> int:
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(data))

    start = 0
    while True:
        after = cut(start + chunk)
        yield start, after, data[start : cut(after + overlap)]
        if after >= len(data):
            return
        start = after


def _chop(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["key", "seq", "start", "next", "overlap", "body"]
    for frame in frames:
        for key, data, chunk, overlap in frame[["key", "data", "chunk", "overlap"]].itertuples(index=False):
            rows, held = [], 0
            for seq, (start, after, body) in enumerate(chunks_of(bytes(data), chunk, overlap)):
                rows.append((key, seq, start, after, overlap, body))
                held += len(body)
                if held > 16_000_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)


def _encode_chunks(vocabulary: str):
    """Per chunk: its number of tokens and those in the two zones shared with its neighbours."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "seq", "n", "head", "tail"]
        for batch in batches:
            numbers, heads, tails = [], [], []
            for body, start, after, overlap in zip(*(batch.column(c) for c in ("body", "start", "next", "overlap"))):
                start, after, overlap = start.as_py(), after.as_py(), overlap.as_py()
                pieces = model(vocabulary).encode(body.as_py().decode(), return_type="proto").pieces
                n, head, tail = len(pieces), [], []

                def mark(i):
                    p = pieces[i]
                    return {"begin": start + p.begin, "end": start + p.end, "id": p.id, "index": i}

                i = 0
                while i < n and pieces[i].begin < overlap:
                    head.append(mark(i))
                    i += 1
                i = n - 1
                while i >= 0 and start + pieces[i].begin >= after:
                    tail.append(mark(i))
                    i -= 1
                numbers.append(n)
                heads.append([m for m in head if m["begin"] < m["end"]])
                tails.append([m for m in reversed(tail) if m["begin"] < m["end"]])
            marks = pa.list_(_MARK)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("seq"), pa.array(numbers, pa.int64()), pa.array(heads, marks),
                 pa.array(tails, marks)], names
            )

    return encode


def _spliced(ends: DataFrame) -> DataFrame:
    """key, n_tokens, aligned: tokens between the splices of all chunks of a document."""
    after = ends.select("key", (F.col("seq") - 1).alias("seq"), F.col("head").alias("next_head"), F.lit(True).alias("followed"))
    seams = ends.join(after, ["key", "seq"], "left")

    def places(marks: str):
        return F.transform(marks, lambda m: F.struct(m["begin"], m["end"], m["id"]))

    shared = F.get(F.array_intersect(places("tail"), places("next_head")), F.lit(0))

    def index(marks: str):
        return F.get(F.col(marks), (F.array_position(places(marks), F.col("shared")) - 1).cast("int"))["index"]

    seams = seams.withColumn("shared", shared).withColumns({"last": index("tail"), "first": index("next_head")})
    counted = F.when(F.col("followed"), F.col("last") - F.col("first")).otherwise(F.col("n"))
    return seams.groupBy("key").agg(
        F.sum(counted).alias("n_tokens"), F.bool_and(F.col("followed").isNull() | F.col("shared").isNotNull()).alias("aligned")
    )


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    limit: int = 4096,
    chunk: int = 32_768,
    overlap: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens): one row per row.

    Counts are those of the whole text, without begin and end marks; strings of
    special tokens are plain text. Documents of at most ``chunk`` bytes are
    encoded whole where they are read; the chunks of longer ones are shared out
    over tasks. Null and empty texts have no bytes and no tokens; null ids and
    repeated rows are counted like any other; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("an overlap has at least one byte and at most as many as a chunk")
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    counted = source.where(F.col("n_bytes") <= chunk).mapInArrow(
        _count_whole(vocabulary), f"doc_id {id_type}, n_bytes long, n_tokens long"
    )
    huge = source.where(F.col("n_bytes") > chunk).select(
        F.monotonically_increasing_id().alias("key"), "doc_id", "n_bytes", F.encode("text", "UTF-8").alias("data")
    )
    open_ = huge = materialise(huge, "huge-texts")
    while not open_.isEmpty():
        texts = open_.select("key", "data", F.lit(chunk).alias("chunk"), F.lit(overlap).alias("overlap"))
        dealt = texts.mapInPandas(_chop, _CHUNK).repartition("key", "seq")
        tokens = materialise(_spliced(materialise(dealt.mapInArrow(_encode_chunks(vocabulary), _ENDS), "chunk-ends")), "spliced")
        whole = open_.select("key", "doc_id", "n_bytes").join(tokens.where("aligned"), "key")
        counted = counted.unionByName(whole.select("doc_id", "n_bytes", "n_tokens"))
        open_ = open_.join(tokens.where(~F.col("aligned")).select("key"), "key", "left_semi")
        chunk, overlap = 2 * chunk, 2 * overlap
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
