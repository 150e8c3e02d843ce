"""Concatenate-and-cut packing of documents into sequences of a fixed number of tokens.

First pass: each task tokenises its documents, each ended by an end id, and notes where they
start among the task's tokens; the result is written to the shared folder. The tasks' totals
are summed up to give each task its place among all tokens. Second pass: every document is cut
at the multiples of the sequence length. A piece that ends a sequence inside its document is a boundary record
(``continues``): the rest of the document opens the next sequence. Only the last sequence can be short.

Added tokens of a tokenizers file are matched in the texts themselves, as that library does by default.
Null texts are empty: they give the end id only. Repeated rows and ids are packed row by row;
other columns than those named are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.bpe import vocabulary_key
from tempora.llm.common import lean, materialize, small_batches

SEQUENCE = 2048
#: Tasks whose offsets are broadcast; more are joined by shuffle.
MAX_BROADCAST_TASKS = 1 << 18

_held: dict = {}


def read_added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers file, read on the driver; only those that are matched as they stand."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    for token in found:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"added token {token['content']!r} isn't matched as it stands")
    return {token["content"]: token["id"] for token in found}


def _number(ranks: dict[bytes, int], added: dict[str, int], end_id: int) -> str:
    return "<u2" if max(*ranks.values(), *added.values(), end_id) < 1 << 16 else "<u4"


def _encoding(key: str, ranks: dict[bytes, int], pattern: str, added: dict[str, int]):
    if key not in _held:
        _held.clear()
        _held[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return _held[key]


def tokenise(documents: DataFrame, ranks: dict[bytes, int], pattern: str, end_id: int, id_column: str, text: str, added: dict[str, int]) -> DataFrame:
    """(part, local_start, doc_id, n, ids) with ids as little-endian unsigned 16- or 32-bit numbers."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((vocabulary_key(ranks, pattern, added), ranks, pattern, added))  # one vocabulary
    kind = dict(documents.dtypes)[id_column]
    number = _number(ranks, added, end_id)

    def run(batches):
        encoding, part, at = _encoding(*shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            starts, counts, ids = [], [], []
            for data in batch.column(1).cast(pa.large_binary()).to_pylist():
                found = encoding.encode((data or b"").decode(errors="replace"), allowed_special="all", disallowed_special=())
                found.append(end_id)
                starts.append(at), counts.append(len(found)), ids.append(np.array(found, number).tobytes())
                at += len(found)
            columns = [pa.array([part] * len(starts), pa.int32()), pa.array(starts, pa.int64()), batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "local_start", "doc_id", "n", "ids"])

    return documents.select(F.col(id_column), F.col(text)).mapInArrow(lean(run), f"part int, local_start long, doc_id {kind}, n long, ids binary")


def offsets(tokenised: DataFrame) -> DataFrame:
    """(part, base): the tokens of all earlier tasks. One row per task of the first pass."""
    totals = tokenised.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))


def pack(documents: DataFrame, ranks: dict[bytes, int], pattern: str, end_id: int = 1, length: int = SEQUENCE, id_column: str = "doc_id", text: str = "text", with_ids: bool = True, added: dict[str, int] | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, continues, and ids (binary) if wanted."""
    spark = documents.sparkSession
    kind, added = dict(documents.dtypes)[id_column], added or {}
    tokenised = materialize(tokenise(documents, ranks, pattern, end_id, id_column, text, added))
    number = _number(ranks, added, end_id)
    bases = materialize(offsets(tokenised))
    if bases.count() <= MAX_BROADCAST_TASKS:
        bases = F.broadcast(bases)
    placed = tokenised.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("first"), "ids")

    def cut(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            docs, ids_out = [], []
            for i, (first, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                ids = np.frombuffer(data, number)
                at = 0
                while at < len(ids):
                    sequence, offset = divmod(first + at, length)
                    piece = ids[at : at + length - offset]
                    end = at + len(piece)
                    docs.append(i)
                    for column, value in zip(rows, (at, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids), sequence, offset, end < len(ids)), strict=False):
                        column.append(value)
                    ids_out.append(piece.astype("<u4").tobytes() if with_ids else None)
                    at = end
            columns = [batch.column(0).take(pa.array(docs, pa.int64())), *(pa.array(c, pa.int64()) for c in rows[:6]), pa.array(rows[6], pa.bool_()), pa.array(ids_out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continues", "ids"])

    small_batches(spark)
    pieces = placed.mapInArrow(lean(cut), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, continues boolean, ids binary")
    return pieces if with_ids else pieces.drop("ids")
