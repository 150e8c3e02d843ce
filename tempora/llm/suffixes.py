"""Removal of repeated long byte strings with a difference-cover suffix array.

Texts are read as UTF-8 bytes. Every byte under a string of ``length`` bytes that also starts
anywhere else, in any text, is removed; matches never cross texts.

Two equal strings hold the same smallest hash of their 32-byte grams at the same place: their
anchor. Strings are dealt out by anchor, so equal strings always meet and no other need to: a run of
consecutive strings with one anchor is a fragment. Fragments whose anchor occurs once are out.
Equal fragments are aggregated first; where all fragments of an anchor are equal nothing is left
to sort. The suffixes of the other fragments are sorted part by part by the difference cover
modulo 3: triples at sampled places are sorted and named, the names' suffixes are sorted by
recursion, the remaining suffixes are merged in, and neighbours are compared over their first
``length`` bytes. Texts that occur more than once are repeated as wholes, so only one text of them is fragmented.

An anchor of many different fragments is dealt on: its strings are cut into blocks by their distance to the
anchor, and a block goes by the bytes that all its strings share. Blocks of one string, at the end, hold equal
strings only. So no key grows with the data, whatever the texts have in common.

Nulls are empty texts. Rows with equal texts repeat each other, whatever their ids. Other columns
than those named are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import RangeHash, chunks, lean, materialize, mix, small_batches, utf8

LENGTH = 200
GRAM = 32
#: Bytes of fragments that are sorted together; one key's fragments may be more.
POOL_BYTES = 5 << 19
#: Different fragments of a key that one task sorts; a key of more is dealt on, in blocks of so many strings.
MOST_FRAGMENTS = 256
BLOCKS = (32, 8, 1)


def difference_cover_sort(text: np.ndarray) -> np.ndarray:
    """The suffix array of an array of positive integers."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.zeros(n + 3, np.int64)
    s[:n] = text
    n0, n1 = (n + 2) // 3, (n + 1) // 3
    extra = n0 - n1  # one sampled place behind the end where the length is 1 modulo 3
    ones, twos = np.arange(1, n + extra, 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    bits = int(s.max()).bit_length()
    if 3 * bits <= 63:
        key = (((s[sample] << bits) | s[sample + 1]) << bits) | s[sample + 2]
        order = np.argsort(key)
        new = np.diff(key[order], prepend=-1) != 0
    else:
        order = np.lexsort((s[sample + 2], s[sample + 1], s[sample]))
        triples = np.stack([s[sample[order] + i] for i in range(3)])
        new = np.ones(len(order), bool)
        new[1:] = (triples[:, 1:] != triples[:, :-1]).any(axis=0)
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = difference_cover_sort(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sorted_sample = sample[order]
    if extra:
        sorted_sample = sorted_sample[sorted_sample < n]
    # the suffixes at multiples of 3, by their first value and the rank of what follows
    zeros = np.arange(0, n, 3)
    base = len(order) + 2
    zeros = zeros[np.argsort(s[zeros] * base + rank[zeros + 1])]
    after_one = sorted_sample[sorted_sample % 3 == 1]
    after_two = sorted_sample[sorted_sample % 3 == 2]
    one = lambda i: s[i] * base + rank[i + 1]
    less = np.searchsorted(one(after_one), one(zeros))
    top = int(s.max()) + 1
    if top * top * base < 2**63:
        two = lambda i: (s[i] * top + s[i + 1]) * base + rank[i + 2]
        less += np.searchsorted(two(after_two), two(zeros))
    else:
        both = np.concatenate([after_two, zeros])
        at = np.lexsort((np.arange(len(both)) < len(after_two), rank[both + 2], s[both + 1], s[both]))
        place = np.empty(len(both), np.int64)
        place[at] = np.cumsum(at < len(after_two))
        less += place[len(after_two) :]
    out = np.empty(n, np.int64)
    at = less + np.arange(len(zeros))
    out[at] = zeros
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sorted_sample
    return out


def repeated_starts(data: np.ndarray, starts: np.ndarray, weights: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of the marked starts, those whose next ``length`` bytes occur with a weight of 2 or more in all."""
    suffixes = difference_cover_sort(data.astype(np.int64) + 1)
    suffixes = suffixes[starts[suffixes]]
    same = _equal_windows(data, suffixes[:-1], suffixes[1:], length)
    group = np.concatenate([[0], np.cumsum(~same)])
    return suffixes[np.bincount(group, weights[suffixes])[group] >= 2]


def _equal_windows(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at a and at b are equal, eight at a time from the far end."""
    eight = np.zeros(len(data) + 8, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    for j in range(8):
        eight |= padded[j : j + len(eight)] << np.uint64(8 * j)
    left = np.arange(len(a))
    for at in sorted({*range(0, length - 7, 8), length - 8}, reverse=True):
        left = left[eight[a[left] + at] == eight[b[left] + at]]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def fragments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last string start of each fragment, its anchor's hash, and the anchor's place behind the first start."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none
    hashes = RangeHash(data).windows(gram)
    bits = np.uint64(max(22, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    size, width = 1, length - gram + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: n - length + 1], least[width - size : width - size + n - length + 1])
    anchor = (least[: n - length + 1] & low).astype(np.int64)
    valid = np.zeros(n - length + 2, np.int64)
    long = np.diff(offsets) >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    new[offsets[:-1][long]] = True
    first = np.flatnonzero(new)
    end = valid.copy()
    end[:-1] &= ~valid[1:] | new[1:]
    return first, np.flatnonzero(end), hashes[anchor[first]], anchor[first] - first


def _texts(batch: pa.RecordBatch, name: str = "text"):
    """(data, offsets, first row) by chunk of the batch."""
    data, offsets = utf8(batch.column(name))
    for i, j in chunks(offsets):
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i


def _anchors(length: int):
    """(anchor, k1, k2, n): the distinct anchors of each text with their number in it; a text that a task meets again is passed over."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            k1, k2 = np.asarray(batch.column("k1")), np.asarray(batch.column("k2"))
            for data, offsets, row in _texts(batch):
                first, _, hashes, _ = fragments(data, offsets, length)
                rows = np.searchsorted(offsets, first, "right") - 1 + row
                once = np.zeros(len(batch), bool)
                for i in range(row, row + len(offsets) - 1):
                    key = (int(k1[i]), int(k2[i]))
                    once[i] = key not in seen
                    seen.add(key)
                keep = once[rows]
                hashes, rows = hashes[keep], rows[keep]
                order = np.lexsort((hashes, rows))
                hashes, rows = hashes[order], rows[order]
                new = np.ones(len(rows), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
                cuts = np.flatnonzero(new)
                counts = np.diff([*cuts, len(rows)])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[cuts].view(np.int64)), pa.array(k1[rows[cuts]]), pa.array(k2[rows[cuts]]), pa.array(counts, pa.int64())], ["anchor", "k1", "k2", "n"])

    return run


def _fragmented(length: int):
    """The fragments of each text at its wanted anchors; ``content`` is a hash of the fragment's bytes."""
    names = ["anchor", "content", "k1", "k2", "first", "place", "data"]

    def run(batches):
        for batch in batches:
            k1, k2, lists = np.asarray(batch.column("k1")), np.asarray(batch.column("k2")), batch.column("anchors")
            data, offsets = utf8(batch.column("text"))
            hashes = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
            cuts = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
            held: list[tuple] = []
            size = 0
            for i in range(len(batch)):
                whole = data[offsets[i] : offsets[i + 1]]
                first, last, found, place = fragments(whole, np.array([0, len(whole)]), length)
                mine = np.flatnonzero(np.isin(found, hashes[cuts[i] : cuts[i + 1]]))
                ranges = RangeHash(whole)
                blob = whole.tobytes()
                for at in range(0, len(mine), 4096):  # a long text's fragments go out bit by bit
                    some = mine[at : at + 4096]
                    begin, end = first[some], last[some] + length
                    held.append((found[some].view(np.int64), ranges.of(begin, end).view(np.int64), np.full(len(some), k1[i]), np.full(len(some), k2[i]), begin, place[some], [blob[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]))
                    size += int((end - begin).sum())
                    if size > POOL_BYTES:
                        yield _batch_of(held, names)
                        held, size = [], 0
            if held:
                yield _batch_of(held, names)

    return run


def _batch_of(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Numbers and, last, byte strings."""
    *numbers, blobs = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c).astype(np.int64)) for c in numbers), pa.array([b for some in blobs for b in some], pa.binary())], names)


def _blocked(length: int, width: int):
    """Fragments cut into blocks of up to ``width`` strings by their distance to the anchor, each under the hash of its anchor and the bytes that all strings of the block share."""
    names = ["anchor", "content", "c2", "several", "key", "part", "begin", "place", "data"]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("data"))
            anchors, place = np.asarray(batch.column("anchor")), np.asarray(batch.column("place"))
            starts = np.diff(offsets) - length + 1
            row = np.repeat(np.arange(len(batch)), starts)
            start = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
            block = (place[row] - start) // width
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
            cut = np.flatnonzero(new)
            row, start, block = row[cut], start[cut], block[cut]
            n = np.diff([*cut, len(new)])
            base = offsets[row]
            last = base + place[row] - block * width  # the last start of the whole block
            ranges, blob = RangeHash(data), data.tobytes()
            shared = ranges.of(last, last - width + 1 + length)
            key = mix(mix(anchors[row].astype(np.int64).view(np.uint64) + block.astype(np.uint64) + np.uint64(width)) + shared)
            begin, end = base + start, base + start + n - 1 + length
            part = ranges.of(begin, end)
            take = pa.array(row)
            columns = [batch.column(c).take(take) for c in ("anchor", "content", "c2", "several")]
            columns += [pa.array(key.view(np.int64)), pa.array(part.view(np.int64)), pa.array(start.astype(np.int64)), pa.array(place[row] - start)]
            for at in range(0, len(row), 8192):
                some = slice(at, at + 8192)
                blobs = pa.array([blob[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c[some] for c in columns), blobs], names)

    return run


def _sorted_out(length: int):
    """Of fragments in order of their anchors: (anchor, content, c2, low, high), the ranges of starts that are repeated."""

    def work(anchors: np.ndarray, contents: np.ndarray, others: np.ndarray, several: np.ndarray, blobs: list[bytes]):
        sizes = np.diff([*np.flatnonzero(np.diff(anchors, prepend=anchors[0] - 1)), len(anchors)])
        alone = np.repeat(sizes == 1, sizes)
        rows = np.flatnonzero(alone & (several > 0))
        lows, highs = np.zeros(len(rows), np.int64), np.array([len(blobs[i]) - length for i in rows], np.int64)
        pool = np.flatnonzero(~alone)
        if len(pool):
            data = np.frombuffer(b"".join(blobs[i] for i in pool), np.uint8)
            lengths = np.array([len(blobs[i]) for i in pool])
            begins = np.concatenate([[0], np.cumsum(lengths)])
            own = np.repeat(np.arange(len(pool), dtype=np.int32), lengths)
            starts = np.arange(len(data)) <= begins[own + 1] - length
            found = np.sort(repeated_starts(data, starts, (1 + several[pool])[own], length))
            if len(found):
                new = np.ones(len(found), bool)
                new[1:] = (np.diff(found) != 1) | (own[found[1:]] != own[found[:-1]])
                first, last = found[new], found[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(found) - 1]])]
                i = own[first]
                rows, lows, highs = np.concatenate([rows, pool[i]]), np.concatenate([lows, first - begins[i]]), np.concatenate([highs, last - begins[i]])
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (anchors[rows], contents[rows], others[rows], lows, highs)], ["anchor", "content", "c2", "low", "high"])

    def run(batches):
        held: list[tuple] = []
        size, before = 0, None
        for batch in batches:
            anchors = np.asarray(batch.column("anchor"))
            numbers = [np.asarray(batch.column(c)) for c in ("content", "c2", "several")]
            blobs = batch.column("data").to_pylist()
            cuts = np.flatnonzero(np.diff(anchors, prepend=anchors[0] - 1)) if len(anchors) else []
            for i, j in zip(cuts, [*cuts[1:], len(anchors)], strict=True):
                if size >= POOL_BYTES and anchors[i] != before:
                    yield work(*_joined(held))
                    held, size = [], 0
                held.append((anchors[i:j], *(c[i:j] for c in numbers), blobs[i:j]))
                size, before = size + sum(map(len, blobs[i:j])), anchors[i]
        if held:
            yield work(*_joined(held))

    return run


def _joined(held: list[tuple]):
    *numbers, blobs = zip(*held, strict=True)
    return (*map(np.concatenate, numbers), [b for some in blobs for b in some])


_RANGES = "anchor long, content long, c2 long, low long, high long"


def _repeated(rows: DataFrame, length: int, most: int, widths: tuple[int, ...]) -> DataFrame:
    """(anchor, content, c2, low, high): the ranges of repeated string starts in fragments (anchor, content, c2, several, place, data), of which equal ones count together."""

    def different(some: DataFrame) -> DataFrame:
        several = F.when(F.count(F.lit(1)) > 1, 1).otherwise(F.max("several")).alias("several")
        return some.groupBy("anchor", "content", "c2").agg(F.first("data").alias("data"), F.first("place").alias("place"), several)

    def sort(some: DataFrame) -> DataFrame:
        found = different(some).select("anchor", "content", "c2", "several", "data")
        return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(_sorted_out(length)), _RANGES)

    if not widths:
        return sort(rows)
    often = materialize(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("anchor"))
    many = rows.select("anchor", "content", "c2").join(often, "anchor").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("anchor")
    many = materialize(many)
    if not many.limit(1).count():
        return sort(rows)
    few = sort(rows.join(many, "anchor", "left_anti"))
    hot = different(rows.join(many, "anchor")).select("anchor", "content", "c2", "several", "place", "data")
    blocks = hot.mapInArrow(lean(_blocked(length, widths[0])), "anchor long, content long, c2 long, several int, key long, part long, begin long, place long, data binary")
    blocks = materialize(blocks.withColumn("p2", F.xxhash64("data")))
    parts = blocks.select(F.col("key").alias("anchor"), F.col("part").alias("content"), F.col("p2").alias("c2"), "several", "place", "data")
    found = _repeated(parts, length, most, widths[1:]).select(F.col("anchor").alias("key"), F.col("content").alias("part"), F.col("c2").alias("p2"), "low", "high")
    back = blocks.drop("data", "place").join(found, ["key", "part", "p2"]).select("anchor", "content", "c2", (F.col("begin") + F.col("low")).alias("low"), (F.col("begin") + F.col("high")).alias("high"))
    return few.unionByName(back)


def _with_keys(documents: DataFrame, text: str) -> DataFrame:
    """Add __body, and __k1 and __k2 that identify it."""
    rows = documents.withColumn("__body", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return rows.withColumns({"__k1": F.xxhash64("__body"), "__k2": F.xxhash64(F.lit(7), "__body", F.octet_length("__body"))})


def repeats(documents: DataFrame, text: str = "text", length: int = LENGTH, most: int = MOST_FRAGMENTS) -> DataFrame:
    """(k1, k2, ranges): of each text that holds repeated strings the ranges (low, high) of their starts."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    small_batches(documents.sparkSession)
    texts = _with_keys(documents, text).select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("__body").alias("text")).where(F.octet_length("text") >= length)

    # anchors that occur in more than one place or text, and texts that occur more than once
    anchors = materialize(texts.mapInArrow(lean(_anchors(length)), "anchor long, k1 long, k2 long, n long"))
    often = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    wanted = anchors.drop("n").join(often, "anchor").groupBy("k1", "k2").agg(F.collect_set("anchor").alias("anchors"))
    copies = texts.select("k1", "k2", F.octet_length("text").alias("n")).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")).where("copies > 1")
    copies = copies.select("k1", "k2", F.lit(0).cast("long").alias("low"), (F.col("n") - length).cast("long").alias("high"))

    single = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    found = single.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "anchors").mapInArrow(lean(_fragmented(length)), "anchor long, content long, k1 long, k2 long, first long, place long, data binary")
    found = materialize(found.withColumn("c2", F.xxhash64("data")))
    ranges = _repeated(found.select("anchor", "content", "c2", F.lit(0).alias("several"), "place", "data"), length, most, BLOCKS)
    spans = found.drop("data", "place").join(ranges, ["anchor", "content", "c2"]).select("k1", "k2", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    both = spans.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("whole", F.lit(True)))
    one = F.struct("low", "high")
    both = both.groupBy("k1", "k2").agg(F.max(F.when(F.col("whole"), one)).alias("whole"), F.collect_set(one).alias("ranges"))
    return both.select("k1", "k2", F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.array_sort("ranges")).alias("ranges"))


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _runs(ranges: Column, length: int) -> Column:
    """The maximal removed runs (a, b) of ascending ranges of starts, which don't overlap."""

    def merged(r):
        joins = lambda i: r[i]["low"] <= r[i - 1]["high"] + length
        firsts = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.when(i > 0, ~joins(i)).otherwise(True))

        def run(firsts):
            last = lambda k: F.coalesce(F.get(firsts, k + 1), F.size(r)) - 1
            return F.transform(firsts, lambda i, k: F.struct(r[i]["low"].alias("a"), (r[last(k)]["high"] + length).alias("b")))

        return _let(firsts, run)

    return _let(ranges, merged)


def _is_inner(data: Column, at: Column) -> Column:
    """Whether the byte at this place, counted from 0, continues a character."""
    return F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF")


def _kept(body: Column, runs: Column, whole_characters: bool) -> Column:
    """The bytes of a string outside the runs, as a string whose bytes they are."""

    def pieces(data, runs):
        def piece(i):
            a = F.when(i > 0, runs[i - 1]["b"]).otherwise(F.lit(0)).cast("int")
            b = F.when(i < F.size(runs), F.get(runs, i)["a"]).otherwise(F.octet_length(data)).cast("int")
            if whole_characters:
                a = F.when(~_is_inner(data, a), a).when(~_is_inner(data, a + 1), a + 1).when(~_is_inner(data, a + 2), a + 2).otherwise(a + 3)
                b = F.when(~_is_inner(data, b), b).when(~_is_inner(data, b - 1), b - 1).when(~_is_inner(data, b - 2), b - 2).otherwise(b - 3)
            return F.substring(data, a + 1, F.greatest(b - a, F.lit(0))).cast("string")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(runs)), piece), "")

    return _let(body.cast("binary"), lambda data: _let(runs, lambda r: pieces(data, r)))


def deduplicate(documents: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, with_kept: bool = True, most: int = MOST_FRAGMENTS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and the kept bytes if wanted."""
    rows = _with_keys(documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text")
    found = repeats(documents, text, length, most).withColumnsRenamed({"k1": "__k1", "k2": "__k2"}).withColumn("runs", _runs(F.col("ranges"), length)).drop("ranges")
    joined = rows.join(found, ["__k1", "__k2"], "left")
    joined = joined.withColumn("kept", F.when(F.col("runs").isNull(), F.col("__body")).otherwise(_kept(F.col("__body"), F.col("runs"), False)).cast("binary"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    out = joined.select(
        "doc_id", F.octet_length("__body").cast("long").alias("n_bytes"), F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept",
    )
    return out if with_kept else out.drop("kept")


def rewrite(documents: DataFrame, text: str = "text", length_column: str | None = "n_chars", length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings taken out of their texts, with all their columns.

    What is left of a character at a cut goes too; ``length_column``, where there is one, gets the new length.
    A null text stays null. A text without repeated strings passes as it is.
    """
    columns = documents.columns
    row = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns if c != text)).alias("__row"), F.col(f"`{text}`").alias("__text")) if len(columns) > 1 else documents.select(F.lit(None).alias("__row"), F.col(f"`{text}`").alias("__text"))
    found = repeats(documents, text, length).withColumnsRenamed({"k1": "__k1", "k2": "__k2"}).withColumn("__runs", _runs(F.col("ranges"), length)).drop("ranges")
    joined = _with_keys(row, "__text").join(found, ["__k1", "__k2"], "left")
    body = F.when(F.col("__runs").isNull(), F.col("__text")).otherwise(_kept(F.col("__body"), F.col("__runs"), True))
    joined = joined.withColumn("__new", body)
    values = {c: F.col("__new") if c == text else F.col(f"__row.`{c}`") for c in columns}
    if length_column in columns:
        values[length_column] = F.length("__new").cast(dict(documents.dtypes)[length_column])
    return joined.select(*(values[c].alias(c) for c in columns))
