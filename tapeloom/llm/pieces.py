"""SentencePiece encoding as a shortest path in a weighted finite-state transducer, and decoding.

The model file is compiled once: the normaliser (blanks to the piece mark, a mark in front), the pieces as a trie over
characters, byte fallback for characters without a piece, and a weight for every step. Composed with a text the trie
gives the lattice of all its segmentations; the encoding is the path of least total weight (tropical semiring).

* For unigram models a piece weighs minus its score.
* For BPE models a piece weighs one, and a pair of neighbours weighs infinity unless merging the pair's text by rank
  gives back just that pair. A sequence all of whose neighbours pass is the BPE encoding, so exactly one path is finite.

No piece has the mark behind another character, so a text falls into independent stretches (marks and what follows
them). The lattices of all new stretches of a chunk of texts are built and relaxed together in numpy, one end position
at a time; a bounded memo keeps the ids of stretches seen before.

Cases: a null text gives null ids, an empty one none; unknown characters become bytes; the mark character itself
decodes to a blank, which is the one case in which decoding does not return the text. Repeated rows give the same ids.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import chunks, documents, short_batches
from tapeloom.llm.suite import query

MARK = "▁"
#: Model file of the registered query.
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Piece kinds of the model format: ordinary, unknown, control, byte.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stretches whose ids a worker keeps, the longest that is kept, pairs of pieces it keeps, bytes of text taken at once.
MEMO, MEMO_CHARS, PAIRS, CHUNK = 500_000, 64, 250_000, 1 << 18
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at:at + size]
            at += size


@dataclass(frozen=True)
class Model:
    """What a model file says: pieces with score and kind, whether it is BPE, and the normaliser's flags."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    prefix: bool
    squeeze: bool

    @staticmethod
    def parse(data: bytes) -> Model:
        pieces, scores, kinds, bpe, prefix, squeeze = [], [], [], False, True, True
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                pieces.append(got[1].decode())
                scores.append(struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0])
                kinds.append(got.get(3, NORMAL))
            elif number == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                rules = dict(_fields(value))
                prefix, squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
                if rules.get(2):
                    raise ValueError("only models without a character map are compiled")
        if USER in kinds:
            raise ValueError("only models without user-defined pieces are compiled")
        return Model(pieces, scores, kinds, bpe, prefix, squeeze)


class _Table:
    """A fixed hash table from 64-bit keys to numbers, looked up for whole arrays; missing keys give -1."""

    def __init__(self, items: dict[int, int]):
        self.shift = 64 - max(4, (4 * len(items)).bit_length())
        size = 1 << (64 - self.shift)
        self.keys, self.values, self.probes = np.full(size, -1, np.int64), np.full(size, -1, np.int32), 0
        for key, value in items.items():
            at, tries = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> self.shift, 1
            while self.keys[at] != -1:
                at, tries = (at + 1) & (size - 1), tries + 1
            self.keys[at], self.values[at], self.probes = key, value, max(self.probes, tries)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == keys
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            if not on.any():
                break
            left, keys, at = left[on], keys[on], (at[on] + 1) & (len(self.keys) - 1)
        return out


@dataclass
class Transducer:
    """The compiled model."""

    model: Model
    memo: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        m = self.model
        plain = [i for i, k in enumerate(m.kinds) if k == NORMAL]
        self.ids = {m.pieces[i]: i for i in plain}
        self.byte_ids = {int(m.pieces[i][3:5], 16): i for i, k in enumerate(m.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(m.kinds) if k == UNKNOWN), 0)
        self.local = not any(MARK in p.lstrip(MARK) for p in self.ids)
        letters = sorted({c for p in self.ids for c in p})
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        steps: dict[int, int] = {}
        final = [-1]
        for p, i in self.ids.items():
            state = 0
            for c in p:
                key = state * self.width + int(self.classes[ord(c)])
                if key not in steps:
                    steps[key] = len(final)
                    final.append(-1)
                state = steps[key]
            final[state] = i
        self.steps, self.final = _Table(steps), np.array(final, np.int32)
        self.weights = np.ones(len(m.pieces) + 1) if m.bpe else np.append(-np.array(m.scores), 10.0 - min(m.scores, default=0.0))
        self.barrier = len(m.pieces)  # stands for the bytes of a character without a piece
        self.pairs: dict[int, bool] = {}
        self.pair_keys, self.pair_fits = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.bytes_of = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode()
                         for p, k in zip(m.pieces, m.kinds, strict=True)]

        self.piece_sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _merged(self, text: str) -> list[int]:
        """Ids of a short text by merging its best-ranked neighbours again and again; leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.model.scores[i] > best):
                    best, at = self.model.scores[i], k
            if best is None:
                return [self.ids.get(p, -1) for p in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the pairs of pieces may be neighbours."""
        out = (left < 0) | (left == self.barrier) | (right == self.barrier)
        ask = np.flatnonzero(~out)
        keys = left[ask].astype(np.int64) * (self.barrier + 1) + right[ask]
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        miss = self.pair_keys[at] != keys
        if miss.any():
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            pieces = self.model.pieces
            new = np.unique(keys[miss])
            fits = np.empty(len(new), bool)
            for n, key in enumerate(new.tolist()):
                if key not in self.pairs:
                    a, b = divmod(key, self.barrier + 1)
                    self.pairs[key] = self._merged(pieces[a] + pieces[b]) == [a, b]
                fits[n] = self.pairs[key]
            got = np.empty(len(keys), bool)
            got[~miss] = self.pair_fits[at[~miss]]
            got[miss] = fits[np.searchsorted(new, keys[miss])]
            self.pair_keys[at[miss]], self.pair_fits[at[miss]] = keys[miss], got[miss]
        else:
            got = self.pair_fits[at]
        out[ask] = got
        return out

    def paths(self, stretches: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of each stretch: the shortest paths of all their lattices, found together."""
        if not stretches:
            return []
        sizes = np.array([len(s) for s in stretches])
        code = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        end_of = (begin + sizes)[owner]
        cls = self.classes[code].astype(np.int64)
        at, state, length = np.arange(len(code)), np.zeros(len(code), np.int64), 0
        starts, lengths, pieces = [np.flatnonzero(cls == 0)], [np.ones(int((cls == 0).sum()), np.int64)], [np.full(int((cls == 0).sum()), self.barrier, np.int32)]
        while len(at):
            state = self.steps.get(state * self.width + cls[at + length]).astype(np.int64)
            length += 1
            on = state >= 0
            at, state = at[on], state[on]
            piece = self.final[state]
            done = piece >= 0
            starts.append(at[done])
            lengths.append(np.full(int(done.sum()), length))
            pieces.append(piece[done])
            on = at + length < end_of[at]
            at, state = at[on], state[on]
        start, size, piece = np.concatenate(starts), np.concatenate(lengths), np.concatenate(pieces)
        # Nodes: position p of stretch k is node p + k; each stretch has one more node than characters.
        source = start + owner[start]
        target, relative = source + size, start + size - begin[owner[start]]
        order = np.argsort(relative, kind="stable")
        source, target, piece = source[order], target[order], piece[order]
        cuts = np.flatnonzero(np.diff(relative[order], prepend=0, append=np.iinfo(np.int64).max))
        nodes = len(code) + len(sizes)
        cost, arc, last = np.full(nodes, np.inf), np.full(nodes, -1), np.full(nodes, -1, np.int64)
        cost[begin + np.arange(len(sizes))] = 0
        weight = self.weights[piece]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            live = a + np.flatnonzero(cost[source[a:b]] < np.inf)
            if self.model.bpe:
                live = live[self._fit(last[source[live]], piece[live])]
            new, to = cost[source[live]] + weight[live], target[live]
            np.minimum.at(cost, to, new)
            best = live[new == cost[to]][::-1]  # of equal paths the longest last piece: longer ones were added later
            arc[target[best]], last[target[best]] = best, piece[best]
        return self._read(begin + np.arange(len(sizes)), sizes, arc, source, piece, code)

    def _read(self, first: np.ndarray, sizes: np.ndarray, arc: np.ndarray, source: np.ndarray, piece: np.ndarray, code: np.ndarray) -> list[bytes]:
        """Walk all paths back from their ends at once."""
        node, owner = first + sizes, np.arange(len(sizes))
        whose, what = [], []
        while len(node):
            step = arc[node]
            whose.append(owner)
            what.append(np.where(piece[step] == self.barrier, -1 - code[np.minimum(source[step] - owner, len(code) - 1)].astype(np.int64), piece[step]))
            node = source[step]
            on = node > first[owner]
            node, owner = node[on], owner[on]
        whose, what = np.concatenate(whose[::-1]), np.concatenate(what[::-1])
        order = np.argsort(whose, kind="stable")
        whose, what = whose[order], what[order]
        if (what < 0).any():
            text = [self._bytes(chr(-1 - w)) if w < 0 else (w,) for w in what.tolist()]
            counts = np.array([len(t) for t in text])
            whose, what = np.repeat(whose, counts), np.array([i for t in text for i in t])
        raw = what.astype("<i4").tobytes()
        ends = 4 * np.searchsorted(whose, np.arange(1, len(sizes) + 1))
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _bytes(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass"))

    def _stretches(self, text: str) -> list[str]:
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        text = text.replace(" ", MARK)
        if self.model.prefix and text:
            text = MARK + text
        return _STRETCH.findall(text) if self.local else [text] if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of each text."""
        cut = [self._stretches(t) for t in texts]
        seen = {s for c in cut for s in c}
        new = [s for s in seen if s not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            for s in list(islice(self.memo, len(self.memo) // 2)):  # the older half goes
                del self.memo[s]
            new = [s for s in seen if s not in self.memo]
        known = dict(zip(new, self.paths(new), strict=True))
        self.memo.update((s, ids) for s, ids in known.items() if len(s) <= MEMO_CHARS)
        memo, long = self.memo, {s: ids for s, ids in known.items() if len(s) > MEMO_CHARS}
        if long:
            return [b"".join([long[s] if s in long else memo[s] for s in c]) for c in cut]
        return [b"".join(map(memo.__getitem__, c)) for c in cut]

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many sequences of ids at once, and where each ends; ``ends`` are the sequences' ends among the ids."""
        sizes = self.piece_sizes[ids]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.piece_starts[ids] - upto[:-1], sizes) + np.arange(upto[-1])
        return self.piece_bytes[at], upto[ends]

    def gives_back(self, texts: list[str | None], ids: np.ndarray, ends: np.ndarray) -> list[bool | None]:
        """Whether each sequence of ids decodes to its text; null for a null text."""
        data, upto = self.decoded(ids, ends)
        given = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        front = b" " if self.model.prefix else b""
        raw, at, out = data.tobytes(), 0, []
        for text, own, end in zip(texts, given, upto.tolist(), strict=True):
            back = raw[at:end]
            out.append(None if text is None else (back[len(front):] if back.startswith(front) else back) == own)
            at = end
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence of ids; broken byte sequences become replacement characters."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text[:1] == " " else text


_compiled: dict[int, Transducer] = {}


def compiled(data: bytes) -> Transducer:
    """The transducer of a model file, compiled once per worker."""
    key = hash(data)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(Model.parse(data))
    return _compiled[key]


def model_bytes(path: str = MODEL) -> bytes:
    """The model file as the driver reads it; it is shipped to the tasks (half a megabyte for 32,000 pieces)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, keys: tuple[str, ...] = ("doc_id",), text: str = "text", verify: bool = False) -> DataFrame:
    """``keys``, n_tokens, n_bytes (byte pieces among them) and ids of every row; with ``verify`` also round_trip,
    whether decoding the ids gives the text again."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    given = short_batches(docs.select(*keys, F.col(text).alias("_text")))
    more = [T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    more += [T.StructField("round_trip", T.BooleanType())] if verify else []
    schema = T.StructType([*docs.select(*keys).schema.fields, *more])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(shipped.value)
        is_byte = np.zeros(transducer.barrier + 1, bool)
        is_byte[list(transducer.byte_ids.values())] = True
        for batch in chunks(batches, "_text", CHUNK):
            texts = batch.column("_text").to_pylist()
            raw = transducer.encode([t or "" for t in texts])
            counts = np.array([len(r) // 4 for r in raw], np.int64)
            ids = np.frombuffer(b"".join(raw), "<i4")
            ends = np.cumsum(counts)
            in_bytes = np.concatenate([[0], np.cumsum(is_byte[ids])])
            null = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids), mask=null)
            columns = [*(batch.column(k) for k in keys), pa.array(counts), pa.array(in_bytes[ends] - in_bytes[ends - counts]), lists]
            if verify:
                columns.append(pa.array(transducer.gives_back(texts, ids, ends), pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.mapInArrow(work, schema)


def decode(rows: DataFrame, model: bytes, keys: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keys`` and the text of every row's ids; null ids give a null text."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(shipped.value)
        for batch in batches:
            back = [None if i is None else transducer.decode(i) for i in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(back, pa.string())], names=schema.names)

    return short_batches(rows).select(*keys, F.col(ids).alias("_ids")).mapInArrow(work, schema)


@query("op5_pieces")
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), model_bytes(), verify=True)
