"""Prediction by partial matching over bytes, and a word unigram model beside it.

Texts are lower-cased (A-Z), cut into words and joined by single spaces, closed by a line feed.
A byte's context is the ``order`` bytes before it (line feeds before the start). The trie of
contexts, with the counts of the bytes that follow, is learnt from the training documents.
A byte seen n times among the N of its longest known context has probability (2n - 1) / 2N there; otherwise
an escape (method D: d / 2N for d distinct bytes) leads to the context shorter by one, where bytes of the longer context are excluded; below the empty context the bytes
never seen are equally likely. The code length of a document is the sum over its bytes.

Nothing of the corpus is broadcast. Documents belong to blocks, parts of a file of equal size whatever the file's; a block's distinct
words and byte runs (context and byte) go with their counts to the part that their hash names,
where they are summed over all blocks. Runs go by their context, so that a part has all of a context.
Runs that training has never seen descend to shorter contexts by joins of tables. Each block gets back
one number per own key, in the order of its sorted keys, and scores its documents. Each byte's log10
probability comes back as a 32-bit float (relative error below 6e-8), and is summed as a double.

Nulls are read as empty texts, of one end token. A null id counts as training. Repeated rows
are scored (and learnt from) one by one; other columns than those named are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import RangeHash, materialize, mix, small_batches

ORDER = 5
#: Text bytes of a block of documents.
BLOCK_BYTES = 8 << 20
#: Text bytes of a scoring task, which takes its blocks one by one.
TASK_BYTES = 64 << 20
_WORDS, _RUNS, _OWN_RUNS, _TOTALS = 0, 1, 2, 3
#: Distinct keys that a task holds per block before it merges them.
_MERGE_AT = 1 << 20
_END = np.uint64(1)


class _Block:
    """The words and byte runs of some texts, as arrays."""

    def __init__(self, texts: list[bytes | None], order: int):
        pad = b"\n" * order
        words = [(text or b"").lower().split() for text in texts]
        streams = [pad + b" ".join(w) + b"\n" for w in words]
        self.n_words = np.array([len(w) for w in words], np.int64)
        sizes = np.array([len(s) for s in streams], np.int64)
        data = np.frombuffer(b"".join(streams), np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        rows = np.repeat(np.arange(len(texts)), sizes)
        inside = np.arange(len(data)) - starts[rows] >= order
        # words: from after a space or the padding to the next space or line feed
        stops = np.flatnonzero(((data == 0x20) | (data == 0x0A)) & inside)
        lengths = np.fromiter((len(x) for w in words for x in w), np.int64, int(self.n_words.sum()))
        empty = self.n_words == 0
        last = starts[1:] - 1  # the closing line feeds
        if empty.any():
            stops = stops[~np.isin(stops, last[empty])]
        self.word_rows = np.repeat(np.arange(len(texts)), self.n_words)
        self.words = RangeHash(data).of(stops - lengths, stops) if len(stops) else np.zeros(0, np.uint64)
        self.words[self.words == _END] += np.uint64(1)
        #: each row's first run; every row has one, of its closing line feed
        self.run_starts = starts[:-1] - order * np.arange(len(texts))
        self.run_rows = rows[inside]
        runs = np.zeros(len(data) - order, np.uint64)
        for j in range(order + 1):
            runs <<= np.uint64(8)
            runs |= data[j : len(data) - order + j]
        self.runs = runs[inside[order:]]

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and rows of the words, then of the ends."""
        n = len(self.n_words)
        return np.concatenate([self.words, np.full(n, _END)]), np.concatenate([self.word_rows, np.arange(n)])


def _pieces(texts: list[bytes | None], order: int, most: int = 1 << 20):
    """(first row, _Block) of consecutive texts of about ``most`` bytes."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= most or i == len(texts) - 1:
            yield first, _Block(texts[first : i + 1], order)
            first, size = i + 1, 0


def _distinct(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, found = pd.factorize(keys)
    return codes, found, np.bincount(codes, weights, len(found)).astype(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, byte plane by byte plane."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack(numbers: np.ndarray) -> bytes:
    size = numbers.dtype.itemsize
    return zstandard.compress(numbers.view(np.uint8).reshape(-1, size).T.tobytes(), 1)


def _numbers(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _parts(kind: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """Words by hash, runs by the hash of their context."""
    mixed = mix(keys >> np.uint64(8) if kind == _RUNS else keys.copy())
    return (mixed >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _by_part(kind: int, keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by part and key, and (part, from, to) in it."""
    parts = _parts(kind, keys, bits)
    order = np.lexsort((keys, parts))
    cuts = np.flatnonzero(np.diff(parts[order], prepend=-1))
    return order, [(int(parts[order[i]]), int(i), int(j)) for i, j in zip(cuts, [*cuts[1:], len(keys)], strict=True)]


_BLOBS = "part long, kind int, block long, keys binary, numbers binary"


def _blobs(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=["part", "kind", "block", "keys", "numbers"])


def _counted(order: int, bits: int):
    def count(batches):
        held: dict[tuple[int, int], list] = {}
        sizes: dict[tuple[int, int], int] = {}

        def merged(key):
            _, keys, n = _distinct(*(np.concatenate(x) for x in zip(*held[key], strict=True)))
            held[key], sizes[key] = [(keys, n)], 0
            return keys, n

        for batch in batches:
            blocks = np.asarray(batch.column("block"))
            held_out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for block in np.unique(blocks).tolist():
                rows = np.flatnonzero(blocks == block)
                for first, some in _pieces([texts[i] for i in rows], order):
                    learnt = ~held_out[rows[first : first + len(some.n_words)]]
                    tokens, token_rows = some.tokens()
                    for kind, keys, weights in ((_WORDS, tokens, learnt[token_rows]), (_RUNS, some.runs, learnt[some.run_rows])):
                        held.setdefault((block, kind), []).append(_distinct(keys, weights)[1:])
                        sizes[block, kind] = sizes.get((block, kind), 0) + len(held[block, kind][-1][0])
                        if sizes[block, kind] > _MERGE_AT:
                            merged((block, kind))
        for block, kind in list(held):
            keys, n = merged((block, kind))
            del held[block, kind]
            at, parts = _by_part(kind, keys, bits)
            keys, n = keys[at], n[at].astype(np.uint32)
            yield from _blobs([(p, kind, block, _pack_keys(keys[i:j]), _pack(n[i:j])) for p, i, j in parts]).to_batches()

    return count


def _summed(table: pa.Table) -> pa.Table:
    """Totals by key over all blocks: a word's to each block that has it, a run's kept with the part and each block's own runs."""
    part = table.column("part")[0].as_py()
    kinds, blocks = np.asarray(table.column("kind")), np.asarray(table.column("block"))
    keys, numbers = table.column("keys").to_pylist(), table.column("numbers").to_pylist()
    rows = []
    for kind in (_WORDS, _RUNS):
        mine = np.flatnonzero(kinds == kind)
        if not len(mine):
            continue
        own: dict[int, list[np.ndarray]] = {}
        for i in mine:  # a block that more than one task has read comes more than once
            own.setdefault(int(blocks[i]), []).append(_keys(keys[i]))
        unpacked = [k for i in own for k in own[i]]
        counts = {b: [] for b in own}
        for i in mine:
            counts[int(blocks[i])].append(_numbers(numbers[i], np.uint32))
        _, found, totals = _distinct(np.concatenate(unpacked), np.concatenate([n for b in own for n in counts[b]]))
        at = np.argsort(found)
        found, totals = found[at], totals[at]
        if kind == _WORDS:
            rows.append((part, _TOTALS, -1, b"", np.array([totals.sum(), (totals > 0).sum()], np.int64).tobytes()))
        else:
            rows.append((part, _RUNS, -1, _pack_keys(found), _pack(totals)))
        for block, some in own.items():
            some = np.unique(np.concatenate(some)) if len(some) > 1 else some[0]
            if kind == _WORDS:
                rows.append((part, _WORDS, block, b"", _pack(totals[np.searchsorted(found, some)])))
            else:
                rows.append((part, _OWN_RUNS, block, _pack_keys(some), b""))
    return _blobs(rows)


def _unpack(batches):
    """(part, run, n, total, kinds, open): open where the context lacks some run that is asked for."""
    names = ["part", "run", "n", "total", "kinds", "open"]
    for batch in batches:
        for part, keys, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            keys, n = _keys(keys), _numbers(numbers, np.int64)
            total, kinds, lacking = _context_sums(keys, n)
            for at in range(0, len(keys), 1 << 16):
                cut = slice(at, at + (1 << 16))
                some = keys[cut].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part, np.int64)), pa.array(some), pa.array(n[cut]), pa.array(total[cut]), pa.array(kinds[cut]), pa.array(lacking[cut])], names)


def _context_sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sorted run's context: counts, distinct bytes, and whether a run of it has no count."""
    cuts = np.flatnonzero(np.diff(keys >> np.uint64(8), prepend=np.uint64((1 << 64) - 1)))
    sizes = np.diff([*cuts, len(keys)])
    return tuple(np.repeat(f.reduceat(x, cuts), sizes) for f, x in ((np.add, n), (np.add, (n > 0).astype(np.int64)), (np.logical_or, n == 0)))


def trie_tables(runs: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """By context length: (run, n), and (context, total, kinds, rest_total, rest_kinds); the longest contexts only where open.

    rest_*: what the context shorter by one has besides the bytes of this context.
    """
    counts: list = [None] * (order + 1)
    counts[order] = runs.where("n > 0").select("run", "n")
    for o in range(order - 1, -1, -1):
        mask = (1 << (8 * (o + 1))) - 1
        counts[o] = materialize(counts[o + 1].groupBy(F.col("run").bitwiseAND(F.lit(mask)).alias("run")).agg(F.sum("n").alias("n")))
    counts[order] = runs.where("n > 0 and open").select("run", "n")
    contexts: list = []
    for o in range(order + 1):
        named = counts[o].withColumn("context", F.shiftright("run", 8))
        if o == 0:
            contexts.append(named.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.lit(0).cast("long").alias("rest_total"), F.lit(0).cast("long").alias("rest_kinds")))
        else:
            mask = (1 << (8 * o)) - 1
            shorter = counts[o - 1].select(F.col("run").alias("__short"), F.col("n").alias("__n"))
            seen = named.withColumn("__short", F.col("run").bitwiseAND(F.lit(mask))).join(shorter, "__short")
            seen = seen.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("__n").alias("__excluded"))
            below = contexts[o - 1].select(F.col("context").alias("__short"), F.col("total").alias("__total"), F.col("kinds").alias("__kinds"))
            seen = seen.withColumn("__short", F.col("context").bitwiseAND(F.lit(mask >> 8))).join(below, "__short")
            contexts.append(seen.select("context", "total", "kinds", (F.col("__total") - F.col("__excluded")).alias("rest_total"), (F.col("__kinds") - F.col("kinds")).alias("rest_kinds")))
        contexts[o] = materialize(contexts[o])
    return counts, contexts


def unseen_scores(runs: DataFrame, order: int) -> DataFrame:
    """(part, run, score) of runs that training lacks: log10 probability of the last byte after the others."""
    counts, contexts = trie_tables(runs, order)
    no = F.lit(None).cast("long")
    now = runs.where("n = 0").select("part", "run", F.lit(0.0).alias("score"), F.lit(False).alias("found"), no.alias("total"), no.alias("kinds"))
    for o in range(order, -1, -1):
        mask = (1 << (8 * (o + 1))) - 1
        now = now.withColumn("__run", F.col("run").bitwiseAND(F.lit(mask))).withColumn("__context", F.shiftright("__run", 8))
        if o < order:
            now = now.join(counts[o].select(F.col("run").alias("__run"), F.col("n").alias("__n")), "__run", "left")
        else:
            now = now.withColumn("__n", no)
        here = contexts[o].select(F.col("context").alias("__context"), F.col("total").alias("__total"), F.col("kinds").alias("__kinds"), "rest_total", "rest_kinds")
        now = now.join(here, "__context", "left")
        total, kinds = F.coalesce("total", "__total"), F.coalesce("kinds", "__kinds")
        open_ = ~F.col("found") & F.col("__total").isNotNull()
        escape = F.when(total > 0, F.log10(kinds / (2 * total))).otherwise(0.0)
        gain = F.when(open_ & F.col("__n").isNotNull(), F.log10((2 * F.col("__n") - 1) / (2 * total))).when(open_, escape).otherwise(0.0)
        now = now.select(
            "part",
            "run",
            (F.col("score") + gain).alias("score"),
            (F.col("found") | (F.col("__n").isNotNull() & F.col("__total").isNotNull())).alias("found"),
            F.when(open_, F.col("rest_total")).otherwise(F.col("total")).alias("total"),
            F.when(open_, F.col("rest_kinds")).otherwise(F.col("kinds")).alias("kinds"),
            F.coalesce("__kinds", F.lit(0)).alias("__known"),
        )
    never = F.when(~F.col("found"), -F.log10(256 - F.col("__known"))).otherwise(0.0)
    return now.select("part", "run", (F.col("score") + never).alias("score"))


def _matched(left: pa.Table, right: pa.Table) -> pa.Table:
    """The scores of each block's own runs, in their order."""
    rows, own = [], []
    found = scores = None
    for part, kind, block, keys, numbers in zip(*(left.column(c).to_pylist() for c in ("part", "kind", "block", "keys", "numbers")), strict=True):
        if kind == _OWN_RUNS:
            own.append((part, block, keys))
        else:
            found, n = _keys(keys), _numbers(numbers, np.int64)
            total, _, _ = _context_sums(found, n)
            with np.errstate(divide="ignore", invalid="ignore"):
                scores = np.log10((2 * n - 1) / (2 * total))
    if found is not None and len(right):
        scores[np.searchsorted(found, np.asarray(right.column("run")).astype(np.uint64))] = np.asarray(right.column("score"))
    for part, block, keys in own:
        rows.append((part, _OWN_RUNS, block, b"", _pack(scores[np.searchsorted(found, _keys(keys))].astype(np.float32))))
    return _blobs(rows)


def _given(kind: int, keys: np.ndarray, bits: int, numbers: dict[tuple[int, int], bytes], number) -> np.ndarray:
    """What came back for these distinct keys, in their order."""
    out = np.zeros(len(keys), number)
    order, parts = _by_part(kind, keys, bits)
    for part, i, j in parts:
        out[order[i:j]] = _numbers(numbers[_OWN_RUNS if kind == _RUNS else kind, part], number)
    return out


def _scored(order: int, bits: int, n_train: int, vocabulary: int):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("text").cast(pa.large_binary()).to_pylist()
        numbers = {(k, p): n for k, p, n in zip(right.column("kind").to_pylist(), right.column("part").to_pylist(), right.column("numbers").to_pylist(), strict=True)}
        n_docs, n_words = len(texts), np.zeros(len(texts), np.int64)
        tokens, rows, pieces = [], [], []
        for first, some in _pieces(texts, order):
            n_words[first : first + len(some.n_words)] = some.n_words
            mine, mine_rows = some.tokens()
            tokens.append(mine), rows.append(mine_rows + first)
            codes, runs = pd.factorize(some.runs)
            pieces.append((first, codes.astype(np.int32), runs, some.run_starts))
        distinct = pd.unique(np.concatenate([runs for _, _, runs, _ in pieces]))
        scores, index = _given(_RUNS, distinct, bits, numbers, np.float32).astype(np.float64), pd.Index(distinct)
        ppm = np.zeros(n_docs)
        for first, codes, runs, starts in pieces:
            ppm[first : first + len(starts)] = np.add.reduceat(scores[index.get_indexer(runs)][codes], starts)
        tokens, rows = np.concatenate(tokens), np.concatenate(rows)
        codes, found = pd.factorize(tokens)
        counts = _given(_WORDS, found, bits, numbers, np.int64)[codes]
        base = np.bincount(rows, np.log10((counts + 0.5) / (n_train + 0.5 * (vocabulary + 1))), n_docs)
        known = np.bincount(rows, counts > 0, n_docs).astype(np.int64)
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": n_words + 1, "n_known": known, "train_tokens": np.full(n_docs, n_train, np.int64), "base_score": base, "score": ppm})

    return score


def score(documents: DataFrame, held_out: str | None = None, id_column: str = "doc_id", text: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every whole text.

    ``held_out``: a SQL expression that is true for documents not learnt from; by default every
    fifth by the CRC-32 of the id as text. ``order``: 1 to 6 bytes of context.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be from 1 to 6")
    small_batches(documents.sparkSession)
    left_out = F.expr(held_out) if held_out else F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 1
    body = F.coalesce(F.col(text), F.lit(""))
    kind = dict(documents.dtypes)[id_column]
    sized = documents.select(F.input_file_name().alias("__file"), (F.octet_length(body) + F.lit(8)).alias("n"))
    files = materialize(sized.groupBy("__file").agg(F.sum("n").alias("n"), F.ceil(F.sum("n") / block_bytes).alias("__parts")))
    total, n_blocks = files.agg(F.sum("n"), F.sum("__parts")).first()
    bits = int(n_blocks or 1).bit_length()
    docs = documents.select(F.col(id_column).alias("doc_id"), F.coalesce(left_out, F.lit(False)).alias("held_out"), body.alias("text"), F.input_file_name().alias("__file"))
    docs = docs.join(files.select("__file", "__parts"), "__file")  # broadcast below Spark's threshold; beyond it AQE splits a large file
    docs = docs.withColumn("block", F.xxhash64("__file", F.pmod(F.xxhash64("doc_id", "text"), "__parts"))).drop("__file", "__parts")
    n_tasks = (total or 0) // TASK_BYTES

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.repartition(n_tasks, "block") if n_tasks > int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) else frame

    counted = docs.select("held_out", "text", "block").mapInArrow(_counted(order, bits), _BLOBS)
    summed = materialize(counted.groupBy("part").applyInArrow(_summed, _BLOBS))
    totals = summed.where(F.col("kind") == _TOTALS).select("numbers").mapInArrow(_totals, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n_train, vocabulary = totals[0] or 0, totals[1] or 0
    runs = summed.where(F.col("kind") == _RUNS).select("part", "keys", "numbers")
    runs = materialize(runs.mapInArrow(_unpack, "part long, run long, n long, total long, kinds long, open boolean"))
    unseen = unseen_scores(runs, order)
    own = summed.where(F.col("kind").isin(_RUNS, _OWN_RUNS))
    matched = own.groupBy("part").cogroup(unseen.groupBy("part")).applyInArrow(_matched, _BLOBS)
    back = summed.where(F.col("kind") == _WORDS).unionByName(matched)
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt(docs).groupBy("block").cogroup(dealt(back).groupBy("block")).applyInArrow(_scored(order, bits, n_train, vocabulary), schema)


def _totals(batches):
    for batch in batches:
        pairs = np.array([np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["n", "v"])
