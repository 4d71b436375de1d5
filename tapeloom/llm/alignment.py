"""Alignment of two tokenizers by inverted pair bitmaps.

Every text is cut by both tokenizers. Byte offsets at which tokens of both end cut the text into groups; all pairs of an
A token and a B token in one group are linked. Which ids belong together is counted over the corpus: for each id pair
the index holds, for every block of up to 2^16 documents, a compressed bitmap of the documents that hold the pair
(sorted 16-bit positions, or a plain bitmap where these would be longer) and multiplicity planes: plane k has the
documents in whose multiplicity, less one, bit k - 1 is set. The postings of the chunks of a block are merged (OR-ed)
where they are made; document counts are popcounts of the bitmaps and link counts weighted popcounts of the planes,
summed over blocks. Scores go back the same way: every posting list adds its pair's count to the documents in its bits,
so a pair is one short row per block on the way and no row per document and pair is ever made.

A block is one task's, bounded in documents and in postings; a block number names the input partition and the block in
it, so a lost task makes the same blocks again. Groups without end (such as long runs of one character) are linked by
distinct ids and their counts, not token by token. What the tasks get from the driver are the two vocabulary files.

Cases: null and empty texts, and texts whose tokens do not give back their bytes (such as those with the mark of the
piece model), have no tokens, zeros and an empty groups string; every row is a document, repeated rows and repeated or
null ids too; texts of any length are taken whole; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tapeloom.llm.common import chunks, documents, keep, short_batches, texts_of
from tapeloom.llm.suite import query

#: Vocabulary files of the registered query.
BYTE_FILE = os.environ.get("BYTE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
PIECE_FILE = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Fixed value: the pattern by which byte-level vocabularies of this kind split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARK = "▁"
#: Documents and postings of a block, links of a group up to which it is linked token by token, bytes of a whole bitmap.
BLOCK_DOCS, BLOCK_POSTINGS, GROUP_LINKS, BITMAP_BYTES = 1 << 16, 1_000_000, 4096, 8192


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself where it prints, else the next unused one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """Byte-level BPE of a vocabulary file: ids are ranks, the lowest merges first."""

    def __init__(self, data: bytes):
        said = json.loads(data)
        alphabet, special = byte_alphabet(), {t["content"] for t in said["added_tokens"]}
        self.entries: list[bytes] = [b""] * (1 + max(said["model"]["vocab"].values()))
        ranks = {}
        for entry, i in said["model"]["vocab"].items():
            if entry not in special:
                self.entries[i] = bytes(alphabet[c] for c in entry)
                ranks[self.entries[i]] = i
        self.fast = tiktoken.Encoding("byte level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.data, self.slow = data, None

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the strings of special tokens are plain text."""
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as failed:  # the split pattern's engine gives up on endless white space
            if isinstance(failed, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self.slow is None:
                self.slow = Tokenizer.from_buffer(self.data)
                self.slow.encode_special_tokens = True
            return self.slow.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """A sentencepiece model; it puts the blank in front itself."""

    def __init__(self, data: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.entries = [b"" if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i)
                        else self.model.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def places(ends: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run, from the runs' sizes."""
    return np.arange(int(ends.sum())) - np.repeat(np.cumsum(ends) - ends, ends)


@dataclass
class Aligned:
    """Counts of some texts, their groups written out, and their links: key (pair << 16 | document) and multiplicity."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    keys: np.ndarray
    times: np.ndarray


class Aligner:
    """Both tokenizers and their tables; built once per worker."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        self.a, self.b = ByteTokens(byte_file), PieceTokens(piece_file)
        self.len_a, self.len_b = (np.array([len(e) for e in t.entries], np.int64) for t in (self.a, self.b))
        n, m = len(self.len_a), len(self.len_b)
        self.many_b = m
        # Written ids: of A within a group and at its end, of B within a group and at its end.
        self.written = [f"{i},".encode() for i in range(n)] + [f"{i}|".encode() for i in range(n)] + [f"{i},".encode() for i in range(m)] + [f"{i};".encode() for i in range(m)]

    def _tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        if text:
            whole = (" " + text).encode("utf-8", "surrogatepass")
            b = self.b.encode(text)
            if b"".join(map(self.b.entries.__getitem__, b)) == whole:
                a = self.a.encode(" " + text)
                if b"".join(map(self.a.entries.__getitem__, a)) == whole:
                    return a, b
        return [], []

    def align(self, texts: list[str | None]) -> Aligned:
        cut = [self._tokens(t) for t in texts]
        n_a, n_b = (np.array([len(c[side]) for c in cut], np.int64) for side in (0, 1))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(np.array(c[side], np.int64) for c in cut if c[0])]) for side in (0, 1))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        marks = np.zeros((2, (int(end_a[-1]) if len(a) else 0) + 1), bool)
        marks[0, end_a], marks[1, end_b] = True, True
        cut_a, cut_b = marks[1, end_a], marks[0, end_b]
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        many = int(cut_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=many), np.bincount(group_b, minlength=many)
        doc_a, docs = np.repeat(np.arange(len(texts)), n_a), len(texts)
        doc_of = doc_a[cut_a]
        links = in_a * in_b
        n_links = np.zeros(docs, np.int64)
        np.add.at(n_links, doc_of, links)
        keys, times = self._links(a, b, in_a, in_b, links, doc_of)
        return Aligned(n_a, n_b, np.bincount(doc_of, minlength=docs), n_links, self._written(a, b, cut_a, cut_b, group_a, group_b, in_a, in_b, n_a, n_b), keys, times)

    def _links(self, a, b, in_a, in_b, links, doc_of) -> tuple[np.ndarray, np.ndarray]:
        """Every (pair, document) once, in order, with the number of its links."""
        small = links <= GROUP_LINKS
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        each = np.where(small, in_b, 0)[np.repeat(np.arange(len(in_a)), in_a)]
        of_a = np.repeat(np.arange(len(a)), each)
        group = np.repeat(np.arange(len(in_a)), np.where(small, links, 0))
        of_b = first_b[group] + places(each)
        keys = np.sort(((a[of_a] * self.many_b + b[of_b]) << 16) | doc_of[group])
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, times = keys[new], np.diff(new, append=len(keys))
        if small.all():
            return keys, times
        more, more_times = [keys], [times]
        for g in np.flatnonzero(~small):
            ids_a, times_a = np.unique(a[first_a[g]:first_a[g] + in_a[g]], return_counts=True)
            ids_b, times_b = np.unique(b[first_b[g]:first_b[g] + in_b[g]], return_counts=True)
            more.append((((ids_a[:, None] * self.many_b + ids_b[None, :]) << 16) | doc_of[g]).reshape(-1))
            more_times.append((times_a[:, None] * times_b[None, :]).reshape(-1))
        keys, times = np.concatenate(more), np.concatenate(more_times)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[new], np.add.reduceat(times, new)

    def _written(self, a, b, cut_a, cut_b, group_a, group_b, in_a, in_b, n_a, n_b) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text: its A and B tokens laid out group by group, each with what follows it."""
        n, m = len(self.len_a), len(self.len_b)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + n * cut_a
        out[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = b + 2 * n + m * cut_b
        words, at, made = list(map(self.written.__getitem__, out.tolist())), 0, []
        for size in (n_a + n_b).tolist():
            made.append(b"".join(words[at:at + size])[:-1])
            at += size
        return made


def bitmaps(positions: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One compressed bitmap for each run of sorted positions below 2^16."""
    if (2 * sizes < BITMAP_BYTES).all():
        offsets = np.concatenate([first, [len(positions)]]) * 2
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(positions.astype("<u2").tobytes())])
    made = []
    for at, size in zip(first.tolist(), sizes.tolist(), strict=True):
        own = positions[at:at + size]
        if 2 * size < BITMAP_BYTES:
            made.append(own.astype("<u2").tobytes())
        else:
            bits = np.zeros(8 * BITMAP_BYTES, bool)
            bits[own] = True
            made.append(np.packbits(bits, bitorder="little").tobytes())
    return pa.array(made, pa.binary())


def members(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions in some compressed bitmaps, and for each the number of its bitmap."""
    sizes = np.asarray(pc.binary_length(bits), np.int64)
    plain = sizes == BITMAP_BYTES
    short = bits.filter(pa.array(~plain)) if plain.any() else bits
    data = b"".join(short.to_pylist())
    at, of = [np.frombuffer(data, "<u2").astype(np.int64)], [np.repeat(np.flatnonzero(~plain), sizes[~plain] // 2)]
    for i in np.flatnonzero(plain).tolist():
        own = np.flatnonzero(np.unpackbits(np.frombuffer(bits[i].as_py(), np.uint8), bitorder="little"))
        at.append(own)
        of.append(np.full(len(own), i))
    return np.concatenate(at), np.concatenate(of)


@dataclass
class Block:
    """Postings of one block, kept as sorted runs until it is full."""

    number: int
    many_b: int
    docs: int = 0
    size: int = 0
    runs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def add(self, keys: np.ndarray, times: np.ndarray, docs: int) -> None:
        self.runs.append((keys + self.docs, times))
        self.size += len(keys)
        self.docs += docs

    def planes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
        """Plane, pairs, popcounts and bitmaps: the merged runs, and a plane for each bit of the multiplicities."""
        keys, times = (np.concatenate([np.zeros(0, np.int64), *(r[i] for r in self.runs)]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        for plane in range(1 + max(int(times.max(initial=1)) - 1, 0).bit_length()):
            held = keys[(times - 1) >> (plane - 1) & 1 == 1] if plane else keys
            pair = held >> 16
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            sizes = np.diff(first, append=len(held))
            if len(held):
                yield plane, pair[first], sizes, bitmaps(held & 0xFFFF, first, sizes)


_aligner: dict[int, Aligner] = {}


def index(docs: DataFrame, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of two kinds: documents (block, place, ``key``, counts, sha-256 of the groups; bits null) and postings (block, plane, a, b, n, bits)."""
    with open(byte_file, "rb") as f, open(piece_file, "rb") as g:
        shipped = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    given = short_batches(docs).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    long = T.LongType()
    schema = T.StructType([T.StructField("block", long), T.StructField("place", T.IntegerType()), T.StructField(key, given.schema["_key"].dataType),
                           *(T.StructField(c, long) for c in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("groups_sha256", T.StringType()),
                           T.StructField("plane", T.IntegerType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", long),
                           T.StructField("bits", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = shipped.value
        if hash(files) not in _aligner:
            _aligner.clear()
            _aligner[hash(files)] = Aligner(*files)
        aligner = _aligner[hash(files)]
        block = Block(TaskContext.get().partitionId() << 32, aligner.many_b)

        def rows(many: int, **columns: pa.Array) -> pa.RecordBatch:
            kinds = {"block": pa.int64(), "place": pa.int32(), key: key_type, **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "n"), pa.int64()),
                     "groups_sha256": pa.string(), **dict.fromkeys(("plane", "a", "b"), pa.int32()), "bits": pa.binary()}
            made = {"block": pa.array(np.full(many, block.number)), **columns}
            return pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(many, kinds[c]) for c in schema.names], names=schema.names)

        def postings() -> Iterator[pa.RecordBatch]:
            for plane, pairs, sizes, bits in block.planes():
                a, b = pairs // aligner.many_b, pairs % aligner.many_b
                for at in range(0, len(pairs), 20_000):
                    to = at + 20_000
                    yield rows(len(pairs[at:to]), plane=pa.array(np.full(len(pairs[at:to]), plane, np.int32)), a=pa.array(a[at:to].astype(np.int32)),
                               b=pa.array(b[at:to].astype(np.int32)), n=pa.array(sizes[at:to].astype(np.int64)), bits=bits[at:to])

        for batch in chunks(batches, "_text"):
            key_type, many = batch.column("_key").type, batch.num_rows
            if block.docs + many > BLOCK_DOCS or block.size > BLOCK_POSTINGS:
                yield from postings()
                block = Block(block.number + 1, aligner.many_b)
            found = aligner.align(texts_of(batch.column("_text")))
            sha = [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups]
            place = pa.array(np.arange(block.docs, block.docs + many, dtype=np.int32))
            yield rows(many, place=place, **{key: batch.column("_key")}, n_a=pa.array(found.n_a), n_b=pa.array(found.n_b), n_groups=pa.array(found.n_groups.astype(np.int64)),
                       n_links=pa.array(found.n_links), groups_sha256=pa.array(sha))
            block.add(found.keys, found.times, many)
        if block.docs:
            yield from postings()

    return given.mapInArrow(work, schema)


def pair_counts(indexed: DataFrame) -> DataFrame:
    """a, b, docs and links of every id pair: popcounts of its bitmaps, and of its planes times their weights."""
    return (indexed.filter("plane IS NOT NULL").groupBy("a", "b")
            .agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("docs"), F.sum(F.col("n") * weight()).alias("links")))


def weight() -> Column:
    """Links that a document in a plane's bits stands for."""
    return F.pow(F.lit(2), F.greatest(F.col("plane") - 1, F.lit(0))).cast("long")


def align(docs: DataFrame, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    indexed = keep(index(docs, byte_file, piece_file, key, text))
    # The B ids of one A id are at most a vocabulary.
    best = F.col("docs") == F.max("docs").over(Window.partitionBy("a"))
    scores = pair_counts(indexed).select("a", "b", "docs", best.cast("long").alias("best"))
    scored = (indexed.filter("plane IS NOT NULL").join(scores, ["a", "b"])
              .select(F.col("block").alias("of_block"), (weight() * F.col("docs")).alias("count"), (weight() * F.col("best")).alias("best"), "bits"))
    told = indexed.filter("plane IS NULL").select("block", "place", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    schema = T.StructType([told.schema[key], *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                           T.StructField("groups_sha256", T.StringType())])

    def returned(rows: pa.Table, lists: pa.Table) -> pa.Table:
        """Every posting list of a block adds its scores to the documents in its bits."""
        sums = np.zeros((2, BLOCK_DOCS), np.int64)
        for part in lists.to_batches(max_chunksize=50_000):
            at, of = members(part.column("bits"))
            for row, name in zip(sums, ("best", "count"), strict=True):
                np.add.at(row, at, np.asarray(part.column(name), np.int64)[of])
        at = np.asarray(rows.column("place"), np.int64)
        made = {c: rows.column(c) for c in rows.column_names} | {"n_best": pa.array(sums[0][at]), "count_sum": pa.array(sums[1][at])}
        return pa.table([made[c] for c in schema.names], names=schema.names)

    return told.groupBy("block").cogroup(scored.groupBy("of_block")).applyInArrow(returned, schema)


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
