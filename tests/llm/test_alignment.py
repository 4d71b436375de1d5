"""Alignment of two tokenizers against plain Python over the libraries' own ids."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import sentencepiece
from test_texts import SCHEMA, odd_rows
from tokenizers import Tokenizer

from tapeloom.llm import alignment

TEXTS = ["the of and to in", "a", " a  b\n\n\tc", "日本語のテキスト 𝄞 naïve façade", "=" * 300, "x=" * 150 + " " * 97 + "y", "<|endoftext|> <s> <0x41> </s>", "a▁b", "", None, "\u0000 \u0001",
         "the of and to in", "réunion à l'école, it's 12345 o'clock!!!", "🙂🙃" * 40, "ﷺ ꙮ Ⅷ ﬁ", "don't DON'T we'll"]


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every text."""
    tokenizer = Tokenizer.from_file(alignment.BYTE_FILE)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_FILE)
    back = alignment.byte_alphabet()
    out, links, holds = [], [], Counter()
    for text in texts:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in tokenizer.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
        if text and not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        ends = [np.cumsum([len(x) for x in part]).tolist() for part in (bytes_a, bytes_b)]
        both = set(ends[0]) & set(ends[1])
        groups = [([], []) for _ in both]
        for side, ids in enumerate((a, b)):
            at = 0
            for i, end in zip(ids, ends[side], strict=True):
                groups[at][side].append(i)
                at += end in both
        own = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        holds.update(own.keys())
        links.append(own)
        out.append([len(a), len(b), len(groups), sum(own.values()), ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)])
    best = defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    return [(*o[:4], sum(k for (x, y), k in own.items() if holds[x, y] == best[x]), sum(k * holds[p] for p, k in own.items()), o[4]) for o, own in zip(out, links, strict=True)]


def check(got, texts):
    want = brute(texts)
    rows = sorted(((r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got), key=str)
    assert rows == sorted(((*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for w in want), key=str)


def test_rows_equal_plain_python(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    got = alignment.align(docs).collect()
    assert len(got) == len(TEXTS)
    check(got, TEXTS)


def test_whole_table_equals_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(alignment.op11_alignment(spark, "/root/testdata/sf0.001").collect(), [r["text"] for r in docs.collect()])


def test_small_blocks_and_large_groups(spark, monkeypatch):
    with open(alignment.BYTE_FILE, "rb") as f, open(alignment.PIECE_FILE, "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read())
    plain = aligner.align(TEXTS)
    monkeypatch.setattr(alignment, "GROUP_LINKS", 2)
    by_ids = aligner.align(TEXTS)
    assert (plain.keys == by_ids.keys).all() and (plain.times == by_ids.times).all() and plain.times.sum() == plain.n_links.sum()
    block = alignment.Block(0, aligner.many_b)
    block.add(plain.keys, plain.times, len(TEXTS))
    block.add(by_ids.keys, by_ids.times, len(TEXTS))
    sums = Counter()
    for plane, pairs, sizes, bits in block.planes():
        at, of = alignment.members(bits)
        assert np.bincount(of, minlength=len(pairs)).tolist() == sizes.tolist()
        for doc, pair in zip(at.tolist(), pairs[of].tolist(), strict=True):
            sums[pair << 16 | doc] += 1 << max(plane - 1, 0)
    assert sums == Counter(dict(zip((plain.keys).tolist(), plain.times.tolist(), strict=True))) + Counter(dict(zip((plain.keys + len(TEXTS)).tolist(), plain.times.tolist(), strict=True)))


def test_bitmaps_of_both_forms():
    rng = np.random.default_rng(1)
    runs = [np.sort(rng.choice(1 << 16, n, replace=False)) for n in (1, 5000, 4095, 4096, 7)]
    sizes = np.array([len(r) for r in runs])
    bits = alignment.bitmaps(np.concatenate(runs), np.cumsum(sizes) - sizes, sizes)
    assert max(len(x.as_py()) for x in bits) == alignment.BITMAP_BYTES
    at, of = alignment.members(pa.array(bits.to_pylist()))
    assert all((np.sort(at[of == i]) == r).all() for i, r in enumerate(runs))


def test_special_strings_are_plain_text_and_both_encoders_agree():
    with open(alignment.BYTE_FILE, "rb") as f:
        own = alignment.ByteTokens(f.read())
    library = Tokenizer.from_file(alignment.BYTE_FILE)
    library.encode_special_tokens = True
    for text in [t for t in TEXTS if t] + [" " * 5000, "\n \n" * 500, "a" * 3000, "ſ's 'S 'll'LL", " x　y"]:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_odd_and_empty_rows(spark):
    got = alignment.align(spark.createDataFrame(odd_rows(), SCHEMA)).collect()
    check(got, [r[1] for r in odd_rows()])
    none = alignment.align(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
