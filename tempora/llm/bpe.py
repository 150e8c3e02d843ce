"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A text is cut by a pattern; each match is read byte by byte by a transducer. The encoding of
every prefix of a word has one last token: the token that ends there, is itself stable under
the merges and may follow the last token of the rest (two tokens may stand side by side if
the merges keep them apart). A state is the last settled token with the bytes that follow it;
a token is emitted once every way the word can go on shares it, which a vocabulary's longest token
bounds. States and transitions are made when first met and dropped when too many are held.

Decoding joins token bytes and follows UTF-8 with an incremental state machine, so that ids
can arrive in pieces that end inside a character.

Nulls are read as empty texts and have no ids; repeated rows and ids are encoded row by row;
other columns than those named are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import small_batches

MAX_STATES = 500_000
MAX_WORDS = 300_000
LONGEST_CACHED = 48
#: Bytes of a word whose way through the states is kept.
HEAD = 6


def read_ranks(lines: list[str]) -> dict[bytes, int]:
    """Ranks by token from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_BYTES = [bytes([i]) for i in range(256)]


class _State:
    """The settled token, the bytes after it, the token that ends each prefix of them, where each prefix's first token
    ends, and the places at which a longer token may have begun."""

    __slots__ = ("settled", "pending", "last", "heads", "alive", "next", "final")

    def __init__(self, settled: int, pending: bytes, last: list[int], heads: list[int], alive: list[int], final: list[int]):
        self.settled, self.pending, self.last, self.heads, self.alive, self.final = settled, pending, last, heads, alive, final
        self.next: dict[int, tuple[_State, list[int]]] = {}


class Transducer:
    """Encoder of single words for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.max_states = max_states
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[int, bool] = {}
        #: (rank or -1, whether a longer token begins so) of all stable tokens and beginnings of tokens
        self.known: dict[bytes, tuple[int, bool]] = {token[:i]: (-1, True) for token in ranks for i in range(1, len(token))}
        for token, rank in ranks.items():
            if self.halves(rank) is not None:
                self.known[token] = (rank, token in self.known)
        self._clear()

    def _clear(self) -> None:
        if hasattr(self, "states"):
            for state in self.states.values():  # states refer to each other; undone, they go at once
                state.next.clear()
        self.states: dict[tuple[int, bytes], _State] = {}
        self.heads: dict[bytes, tuple[_State, list[int]]] = {}
        self.start = self.states[-1, b""] = _State(-1, b"", [], [], [], [])

    def _merge(self, word: bytes, stop: int = 1) -> list[bytes]:
        """The merges in order of rank, until ``stop`` parts are left or none applies."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > stop:
            found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in self.ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the merge that makes a token; itself twice for a byte, None if the merges never make it."""
        if token not in self._halves:
            word = self.bytes[token]
            if len(word) == 1:
                self._halves[token] = (token, token)
            else:
                parts = self._merge(word, 2)
                whole = len(parts) == 2
                self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if whole else None
        return self._halves[token]

    def apart(self, left: int, right: int) -> bool:
        """True if the merges leave these two stable tokens side by side."""
        found = self._never_joined(left, right)
        if len(self._apart) >= 4 * self.max_states:
            self._apart.clear()
        self._apart[left << 32 | right] = found
        return found

    def _never_joined(self, left: int, right: int) -> bool:
        # Undo merges from the youngest back: at each moment the tokens touching the border
        # must not have had a merge of their own that would have come before the next one.
        # Of two equal tokens the merges make the left one first, so the right one is undone first.
        words, halves, rank_of, never = self.bytes, self._halves, self.ranks.get, 1 << 62
        before, a, b = never, words[left], words[right]
        while True:
            if rank_of(a + b, never) < before:
                return False
            if len(a) > 1 and (len(b) == 1 or left > right):
                before, left = left, halves[left][1]
                a = words[left]
            elif len(b) > 1:
                before, right = right + 1, halves[right][0]
                b = words[right]
            else:
                return True

    def _step(self, state: _State, byte: int) -> tuple[_State, list[int]]:
        known, size, is_apart = self.known, self.size, self._apart.get
        pending, settled, last, heads = state.pending + _BYTES[byte], state.settled, state.last, state.heads
        end = len(pending)
        # the token that ends here began where a longer token could, or is the byte
        token, begin, alive = -1, 0, []
        for start in [*state.alive, end - 1]:
            found = known.get(pending[start:])
            if found is None:
                continue
            rank, longer = found
            if longer:
                alive.append(start)
            if token < 0 <= rank:
                previous = last[start - 1] if start else settled
                if previous >= 0:
                    apart = is_apart(previous << 32 | rank)
                    if not (self.apart(previous, rank) if apart is None else apart):
                        continue
                token, begin = rank, start
        if token < 0:
            raise ValueError("a byte has no token")
        head = heads[begin - 1] if begin else end
        last, heads = [*last, token], [*heads, head]
        # settle first tokens on which the whole word so far and all that may begin agree
        out: list[int] = []
        while pending:
            head = heads[-1]
            if alive and (alive[0] < head or any([heads[a - 1] != head for a in alive])):
                break
            settled = last[head - 1]
            out.append(settled)
            pending = pending[head:]
            if not pending:
                last, heads, alive = [], [], []
                break
            if len(pending) == 1:
                last, heads, alive = [token], [1], [0] if alive else []
                continue
            last, alive, heads = last[head:], [a - head for a in alive], []
            for at, t in enumerate(last, 1):
                back = at - size[t]
                heads.append(heads[back - 1] if back > 0 else at)
        key = (settled, pending)
        target = self.states.get(key)
        if target is None:
            if len(self.states) >= self.max_states:
                self._clear()
            final, at = [], len(pending)
            while at:
                t = last[at - 1]
                final.append(t)
                at -= size[t]
            final.reverse()
            target = self.states[key] = _State(settled, pending, last, heads, alive, final)
        edge = state.next[byte] = (target, out)
        return edge

    def encode(self, word: bytes) -> list[int]:
        """Ids of a word; the way through its first bytes is kept, as many words share it."""
        head = word[:HEAD]
        known = self.heads.get(head)
        if known is None:
            known = self._run(self.start, head, [])
            if len(self.heads) < self.max_states:
                self.heads[head] = known
        state, ids = known
        if len(word) > HEAD:
            state, ids = self._run(state, word[HEAD:], ids)
        return ids + state.final

    def _run(self, state: _State, data: bytes, ids: list[int]) -> tuple[_State, list[int]]:
        ids = ids[:]
        for byte in data:
            edge = state.next.get(byte)
            if edge is None:
                edge = self._step(state, byte)
            state, out = edge
            if out:
                ids += out
        return state, ids


class _Words(dict):
    """Ids of words as bytes, encoded when first asked for."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.run = transducer.encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", self.run(word.encode())).tobytes()
        if len(word) <= LONGEST_CACHED:
            if len(self) >= MAX_WORDS:  # words that are met again move over, the others go next time
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit bytes)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.words = _Words(Transducer(ranks))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(text)))


#: UTF-8 by state: 0 between characters, 1 to 3 that many continuation bytes to come, 4 to 7
#: the second bytes that E0, ED, F0 and F4 restrict; -1 is an error.
def _utf8_machine() -> list[list[int]]:
    table = [[-1] * 256 for _ in range(8)]
    table[0][0x00:0x80] = [0] * 128
    table[0][0xC2:0xE0] = [1] * 30
    table[0][0xE0:0xF0] = [4, *[2] * 12, 5, 2, 2]
    table[0][0xF0:0xF5] = [6, 3, 3, 3, 7]
    for state, (low, high, then) in {1: (0x80, 0xC0, 0), 2: (0x80, 0xC0, 1), 3: (0x80, 0xC0, 2), 4: (0xA0, 0xC0, 1), 5: (0x80, 0xA0, 1), 6: (0x90, 0xC0, 2), 7: (0x80, 0x90, 2)}.items():
        table[state][low:high] = [then] * (high - low)
    return table


_MACHINE = _utf8_machine()
_BEYOND_ASCII = re.compile(rb"[\x80-\xff]+")
_complete: set[bytes] = set()


class StreamingDecoder:
    """Ids in pieces to text; bytes of an unfinished character wait for the next piece, wrong ones become U+FFFD."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.waiting = tokens, b""

    def feed(self, ids: list[int]) -> str:
        data = self.waiting + b"".join(map(self.tokens.__getitem__, ids))
        self.waiting = b""
        wrong = False
        if data and data[-1] > 0x7F and (cut := self._unfinished(data[-3:])):
            data, self.waiting = data[:-cut], data[-cut:]
        for run in () if data.isascii() else set(_BEYOND_ASCII.findall(data)):  # equal runs take equal ways through the machine
            wrong |= run not in _complete and not self._whole(run)
        return data.decode(errors="replace" if wrong else "strict")

    @staticmethod
    def _whole(run: bytes) -> bool:
        state = 0
        for byte in run:
            state = _MACHINE[state][byte]
            if state < 0:
                return False
        if not state and len(_complete) < 10_000:
            _complete.add(run)
        return not state

    @staticmethod
    def _unfinished(tail: bytes) -> int:
        """Bytes of a character that the last bytes begin and do not end."""
        for begun in range(len(tail) - 1, -1, -1):
            if tail[begun] >= 0xC0:
                state = 0
                for byte in tail[begun:]:
                    state = _MACHINE[state][byte]
                    if state < 0:
                        return 0
                return len(tail) - begun if state else 0
        return 0

    def finish(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode(errors="replace")


_held: dict = {}


def _encoder(token: str, ranks: dict[bytes, int], pattern: str) -> tuple[Encoder, list[bytes]]:
    if token not in _held:
        tokens = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            tokens[rank] = word
        _held.clear()
        _held[token] = (Encoder(ranks, pattern), tokens)
    return _held[token]


def vocabulary_key(ranks: dict[bytes, int], pattern: str, added: dict[str, int] | None = None) -> str:
    """A digest of the whole vocabulary, by which a worker keeps what it has built from it."""
    return hashlib.sha256(repr((pattern, sorted(ranks.items()), sorted((added or {}).items()))).encode()).hexdigest()


def read_rank_file(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A vocabulary file is read on the driver; it has a fixed size."""
    with open(path) as file:
        return read_ranks(file.read().splitlines())


def encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text: str = "text", with_ids: bool = True, piece: int = 4096) -> DataFrame:
    """(doc_id, n_tokens, ids binary if wanted, ids_sha256, decoded_sha256) of every whole text."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((ranks, pattern))  # one vocabulary
    key = vocabulary_key(ranks, pattern)
    kind = dict(documents.dtypes)[id_column]

    def run(batches):
        collects = gc.isenabled()
        gc.disable()  # the caches hold many objects and make no garbage in cycles
        try:
            yield from encoded(batches)
        finally:
            if collects:
                gc.enable()

    def encoded(batches):
        encoder, tokens = _encoder(key, *shared.value)
        for batch in batches:
            counts, all_ids, digests, decoded = [], [], [], []
            for data in batch.column(1).cast(pa.large_binary()).to_pylist():
                ids = encoder.encode((data or b"").decode(errors="replace"))
                numbers = np.frombuffer(ids, "<u4")
                decoder, digest = StreamingDecoder(tokens), hashlib.sha256()
                for at in range(0, len(numbers), piece):
                    digest.update(decoder.feed(numbers[at : at + piece].tolist()).encode())
                digest.update(decoder.finish().encode())
                counts.append(len(numbers)), all_ids.append(ids if with_ids else b""), digests.append(hashlib.sha256(ids).hexdigest()), decoded.append(digest.hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(all_ids, pa.binary()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    rows = documents.select(F.col(id_column), F.col(text)).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
    return rows if with_ids else rows.drop("ids")


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_column: str = "doc_id", ids: str = "ids", piece: int = 4096) -> DataFrame:
    """(doc_id, text) from little-endian unsigned 32-bit ids; null ids give the empty text."""
    spark = encoded.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((ranks, ""))
    kind = dict(encoded.dtypes)[id_column]

    def run(batches):
        tokens = [b""] * (max(shared.value[0].values()) + 1)
        for word, rank in shared.value[0].items():
            tokens[rank] = word
        for batch in batches:
            texts = []
            for data in batch.column(1).cast(pa.large_binary()).to_pylist():
                numbers, decoder = np.frombuffer(data or b"", "<u4"), StreamingDecoder(tokens)
                texts.append("".join([decoder.feed(numbers[at : at + piece].tolist()) for at in range(0, len(numbers), piece)]) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_column), F.col(ids)).mapInArrow(run, f"doc_id {kind}, text string")
