"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are quantised to integers and stored in blocks, ranges of consecutive rows. A block
keeps a forward index (its rows' components) and each component's largest and smallest
value. For a query the summed maxima bound every score in the block; blocks are scored in
the order of their bounds until the next bound falls below the query's kth score. Each task
prunes against its own kth scores; the tasks' candidates are then merged.

Queries are held by workers in fixed-size blocks of ``query_block`` rows; each query block is one
pass over all vectors, so what is broadcast never grows with the data.

Vectors that are null, or hold a null or non-finite component, take no part; nor do rows
without an id, and empty vectors. Vectors of different lengths are not compared. A query is not compared with rows
of its own id; repeated rows are candidates (and queries) one by one. With fewer than k candidates all are
returned. Other columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import materialize, small_batches

SCALE = 256
BLOCK_ROWS = 256
QUERY_BLOCK = 8192


def quantise(vectors: DataFrame, id_column: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id long, q array<long>) of the usable rows."""
    value = F.col(vector)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col(id_column).isNotNull() & value.isNotNull() & (F.size(value) > 0)).where(~bad)
    return usable.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(value, lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.diff(np.asarray(column.offsets)), np.asarray(column.flatten())


def _by_length(ids: np.ndarray, column: pa.Array):
    lengths, flat = _lists(column)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), ids[rows], flat[starts[rows][:, None] + np.arange(d)]


class Blocks:
    """Forward-indexed blocks of equally long integer vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block_rows: int = BLOCK_ROWS):
        # float64 products and sums are exact below 2**53; larger components stay integers
        self.exact = rows.size == 0 or float(np.abs(rows).max()) ** 2 * rows.shape[1] < 2**52
        self.ids, self.rows = ids, rows.astype(np.float64) if self.exact else rows
        self.cuts = np.arange(0, len(ids), block_rows)
        self.most = np.maximum.reduceat(self.rows, self.cuts)
        self.least = np.minimum.reduceat(self.rows, self.cuts)
        self.block_rows = block_rows

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Per query and block the sum over components of the largest product."""
        return np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray):
        """Yield (query index, ids, scores) of the best k per query, given scores that are already beaten (``floor``, updated)."""
        queries = queries.astype(self.rows.dtype) if self.exact else queries
        for first in range(0, len(queries), 1024):
            block_bounds = self.bounds(queries[first : first + 1024])
            orders = np.argsort(-block_bounds, axis=1, kind="stable")
            for row, (order, bound) in enumerate(zip(orders, block_bounds, strict=True)):
                at = first + row
                found_ids, found = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
                for b in order:
                    if bound[b] < floor[at]:
                        break
                    cut = slice(self.cuts[b], self.cuts[b] + self.block_rows)
                    ids, scores = self.ids[cut], self.rows[cut] @ queries[at]
                    keep = (scores >= floor[at]) & (ids != query_ids[at])
                    if not keep.any():
                        continue
                    found_ids, found = np.concatenate([found_ids, ids[keep]]), np.concatenate([found, scores[keep]])
                    best = np.lexsort((found_ids, -found))[:k]
                    found_ids, found = found_ids[best], found[best]
                    if len(found) == k:
                        floor[at] = max(floor[at], found[-1])
                if len(found):
                    yield at, found_ids, found


def _searcher(queries, k: int, block_rows: int, task_rows: int = 16384):
    def search(batches):
        by_length = queries.value
        floors = {d: np.full(len(ids), -np.inf) for d, (ids, _, _) in by_length.items()}
        held: dict[int, list] = {}

        def flush(d):
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            order = np.argsort(ids, kind="stable")
            query_ids, query_rows, numbers = by_length[d]
            at, found_ids, scores = [], [], []
            for q, i, s in Blocks(ids[order], rows[order], block_rows).search(query_ids, query_rows, k, floors[d]):
                at.append(np.full(len(i), q)), found_ids.append(i), scores.append(s)
            if at:
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[at]), pa.array(query_ids[at]), pa.array(np.concatenate(found_ids)), pa.array(np.concatenate(scores).astype(np.int64))], ["query_no", "query_id", "vec_id", "score"])

        for batch in batches:
            ids = np.asarray(batch.column(0))
            for d, some, rows in _by_length(ids, batch.column(1)):
                if d in by_length:
                    held.setdefault(d, []).append((some, rows))
                    if sum(len(x[0]) for x in held[d]) >= task_rows:
                        yield from flush(d)
        for d in list(held):
            yield from flush(d)

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", query_id: str = "vec_id", block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products per query row, ties to the smaller id."""
    spark = vectors.sparkSession
    small_batches(spark, 8192)
    rows = quantise(vectors, id_column, vector)
    asked = materialize(quantise(queries, query_id, vector).withColumn("query_no", F.monotonically_increasing_id()))
    n_blocks = -(-asked.count() // query_block)
    found = []
    bounds = asked.stat.approxQuantile("query_no", [i / n_blocks for i in range(1, n_blocks)], 0.1 / n_blocks) if n_blocks > 1 else []
    edges = [None, *sorted(set(bounds)), None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        block = asked
        if low is not None:
            block = block.where(F.col("query_no") >= int(low))
        if high is not None:
            block = block.where(F.col("query_no") < int(high))
        table = block.select("query_no", "vec_id", "q").toArrow()
        if not len(table):
            continue
        table = table.combine_chunks()
        numbers = np.asarray(table.column("query_no"))
        held = {}
        for d, some, values in _by_length(np.arange(len(table)), table.column("q").combine_chunks()):
            held[d] = (np.asarray(table.column("vec_id"))[some], values, numbers[some])
        scored = rows.mapInArrow(_searcher(spark.sparkContext.broadcast(held), k, block_rows), "query_no long, query_id long, vec_id long, score long")
        found.append(scored)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
