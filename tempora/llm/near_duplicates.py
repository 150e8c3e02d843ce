"""Jaccard self-join of texts over word n-grams, with Bayesian pruning of candidates.

A text is the set of its runs of five words (a shorter text: one run of all its words).
Texts with equal sets form a class; classes are compared, not rows. MinHash bands propose
which classes could be alike: classes that share a band belong to one neighbourhood, a connected
component of band buckets. A neighbourhood is dealt into blocks, and each pair of blocks
is compared in one task of bounded size: for every pair that shares a band, MinHash values are compared
in steps, and the pair is dropped once the posterior probability that its similarity
reaches the threshold falls below ``tolerance``; the rest is verified exactly on the sets.
A task returns sums of links by class and edges that span its links, never all pairs.

Texts without words (null, empty, white space) have no n-grams and no links: each row is its own class.
Repeated rows and ids are joined row by row. Other columns than those named are left out. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import chunks, give_back, lean, materialize, mix, small_batches, utf8, word_shingles
from tempora.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
STEP = 20
TOLERANCE = 1e-9
#: Classes of a neighbourhood in one block; a task compares two blocks.
BLOCK = 128


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (values[:n] >> np.uint64(32)).astype(np.uint32), (values[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray], n: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values (rows x n) of non-empty sets of 64-bit hashes."""
    flips, factors = _permutations(n)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), n), np.uint32)
    spare = np.empty_like(values)
    for i in range(n):
        np.bitwise_xor(values, flips[i], out=spare)
        np.multiply(spare, factors[i], out=spare)
        out[:, i] = np.minimum.reduceat(spare, starts)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """64-bit band keys (rows x BANDS)."""
    n = len(signature)
    parts = signature.reshape(n, -1, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, n: int = BANDS * ROWS, step: int = STEP) -> dict[int, int]:
    """For each number of values compared the fewest matches with which a pair goes on.

    With a uniform prior on the similarity the posterior after m matches of n is
    Beta(m + 1, n - m + 1); the pair is dropped where its mass above the threshold is under ``tolerance``.
    """
    grid = (np.arange(20000) + 0.5) / 20000
    out = {}
    for compared in range(step, n + 1, step):
        for m in range(compared + 1):
            density = m * np.log(grid) + (compared - m) * np.log1p(-grid)
            mass = np.exp(density - density.max())
            if mass[grid >= threshold].sum() / mass.sum() >= tolerance:
                out[compared] = m
                break
    return out


def _sets(column: pa.Array) -> list[np.ndarray]:
    data, offsets = utf8(column)
    out = []
    for i, j in chunks(offsets):
        out += word_shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WORDS)
    return out


def _described(batches):
    """(key, bands) of texts; nulls for a text without words."""
    for batch in batches:
        sets = _sets(batch.column("text"))
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        full = [s for s in sets if len(s)]
        found = iter(bands(_signed(full)).view(np.int64).tolist()) if full else iter(())
        columns = [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(keys, pa.binary()), pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "key", "bands"])


def _signed(sets: list[np.ndarray], most: int = 1 << 18) -> np.ndarray:
    out, held, size = [], [], 0
    for s in sets:
        held.append(s)
        size += len(s)
        if size >= most:
            out.append(signatures(held))
            held, size = [], 0
    if held:
        out.append(signatures(held))
    return np.concatenate(out)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], most: int = 1 << 14) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over ranges of the shared elements."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    out = np.zeros((len(left), len(right)), np.float32)
    columns = [[np.searchsorted(shared, s[np.isin(s, shared, assume_unique=True)]) for s in side] for side in (left, right)]
    for low in range(0, len(shared), most):
        matrices = []
        for side in columns:
            matrix = np.zeros((len(side), min(most, len(shared) - low)), np.float32)
            for row, c in enumerate(side):
                i, j = np.searchsorted(c, [low, low + most])
                matrix[row, c[i:j] - low] = 1
            matrices.append(matrix)
        out += matrices[0] @ matrices[1].T
    return out.astype(np.int64)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _compared(threshold: float, tolerance: float):
    fewest = fewest_matches(threshold, tolerance)

    def compare(table: pa.Table) -> pa.Table:
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        keys, blocks = table.column("key").to_pylist(), np.asarray(table.column("own_block"))
        copies = np.asarray(table.column("copies"))
        sets = _sets(table.column("text"))
        marks = _signed(sets)
        left = np.flatnonzero(blocks == first)
        right = left if first == second else np.flatnonzero(blocks == second)
        if not len(left) or not len(right):
            return _links([], [], [])
        sizes = np.array([len(s) for s in sets], np.int64)
        ratio = threshold * np.maximum(sizes[left][:, None], sizes[right][None, :])
        alive = np.minimum(sizes[left][:, None], sizes[right][None, :]) >= ratio - 1e-9
        if first == second:
            alive &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        keyed = bands(marks)
        together = np.zeros_like(alive)
        for b in range(keyed.shape[1]):
            together |= keyed[left, b][:, None] == keyed[right, b][None, :]
        alive &= together
        x, y = np.nonzero(alive)
        matches = np.zeros(len(x), np.int64)
        for compared in range(STEP, marks.shape[1] + 1, STEP):
            cut = slice(compared - STEP, compared)
            for at in range(0, len(x), 1 << 16):
                some = slice(at, at + (1 << 16))
                matches[some] += (marks[left[x[some]], cut] == marks[right[y[some]], cut]).sum(axis=1)
            on = matches >= fewest[compared]
            x, y, matches = x[on], y[on], matches[on]
        if not len(x):
            return _links([], [], [])
        rows, columns = np.unique(x), np.unique(y)
        common = _overlaps([sets[left[i]] for i in rows], [sets[right[i]] for i in columns])
        inter = common[np.searchsorted(rows, x), np.searchsorted(columns, y)]
        good = inter >= threshold / (1 + threshold) * (sizes[left[x]] + sizes[right[y]]) - 1e-9
        a, b = left[x[good]], right[y[good]]
        links = np.bincount(a, copies[b], len(keys)) + np.bincount(b, copies[a], len(keys))
        forest = _Forest(len(keys))
        edges = [(keys[i], keys[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True) if forest.join(i, j)]
        linked = np.flatnonzero(links)
        if table.nbytes > 4 << 20:
            give_back()
        return _links([keys[i] for i in linked], links[linked].astype(np.int64).tolist(), edges)

    return compare


def _links(keys: list, links: list, edges: list) -> pa.Table:
    a, b = [*keys, *(e[0] for e in edges)], [*[None] * len(keys), *(e[1] for e in edges)]
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "links": pa.array([*links, *[0] * len(edges)], pa.int64())})


def link(documents: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, k1 and k2 (its text's hashes), n_links (other rows at or over the threshold), class_key (of rows joined by links; null without words) and class_id (the class's smallest id)."""
    spark = documents.sparkSession
    small_batches(spark)
    kind = dict(documents.dtypes)[id_column]
    body = F.coalesce(F.col(text), F.lit(""))
    hashes = [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(7), body, F.octet_length(body)).alias("k2")]
    texts = documents.select(F.col(id_column).alias("doc_id"), body.alias("text"), *hashes)
    rows = materialize(texts.mapInArrow(lean(_described), f"doc_id {kind}, k1 long, k2 long, key binary, bands array<long>"))

    # classes of equal sets, each standing for itself by one of its texts
    worded = rows.where("key is not null").withColumn("node", F.xxhash64("key"))
    classes = materialize(worded.groupBy("key", "node").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "doc_id")).alias("stands"), F.min("doc_id").alias("first_id")))
    banded = worded.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band", "low")
    near = banded.join(buckets, "band").where("node != low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    hoods = components(near)

    # blocks of each neighbourhood, and the pairs of blocks
    size = hoods.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
    member = classes.select("key", "node", "copies", "stands.k1", "stands.k2", F.col("stands.doc_id").alias("stands_id")).join(hoods, "node").join(size, "component")
    member = member.withColumn("own_block", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int"))
    same_row = F.col("doc_id").eqNullSafe(F.col("stands_id")) & (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2"))
    member = texts.join(member.withColumnsRenamed({"k1": "m1", "k2": "m2"}), same_row).drop("doc_id", "stands_id", "k1", "k2", "m1", "m2")
    member = materialize(member.dropDuplicates(["key"]))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    dealt = member.select("*", other).select("component", F.least("own_block", "other").alias("i"), F.greatest("own_block", "other").alias("j"), "own_block", "key", "copies", "text")
    found = materialize(dealt.groupBy("component", "i", "j").applyInArrow(_compared(threshold, tolerance), "a binary, b binary, links long"))

    groups = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    described = classes.join(groups.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    described = described.select("key", F.coalesce("component", "key").alias("class_key"), "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    ids = described.groupBy("class_key").agg(F.min("first_id").alias("class_id"))
    described = described.join(ids, "class_key").select("key", "class_key", "class_id", "n_links")
    out = rows.select("doc_id", "k1", "k2", "key").join(described, "key", "left")
    return out.select("doc_id", "k1", "k2", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "class_key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(documents: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that of the smallest id (nulls last); texts without words are one class here. All columns stay."""
    linked = link(documents, id_column, text, threshold)
    columns = documents.columns
    body = F.coalesce(F.col(text), F.lit(""))
    firsts = linked.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("k1"), F.col("k2"))).alias("__first"))
    chosen = firsts.select(F.col("__first.doc_id").alias("__id"), F.col("__first.k1").alias("__k1"), F.col("__first.k2").alias("__k2"))
    marked = documents.withColumn("__h1", F.xxhash64(body)).withColumn("__h2", F.xxhash64(F.lit(7), body, F.octet_length(body)))
    kept = marked.join(chosen, (F.col(id_column).eqNullSafe(F.col("__id"))) & (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2")), "left_semi")
    return kept.dropDuplicates([id_column, "__h1", "__h2"]).select(*columns)
