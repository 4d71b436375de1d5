"""Operators on texts against plain Python, library results, SQL and held-out labels."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import compare  # noqa: E402
from tapeloom.llm import fingerprints, language, mixture, neardup, pieces, quality, sharding, toxicity, urls  # noqa: E402
from tapeloom.llm.common import documents  # noqa: E402
from tapeloom.llm.shingles import fast_similarity_sketch, minhash_signatures, shingle_sets  # noqa: E402
from tapeloom.llm.suite import load_all  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, _id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SENTENCE = "the of and to in a that for with on river stone morning light over quiet hills where people walk slowly"


def odd_rows():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30000))
    return [(1, None, "en", "s", 0, 0.1, "a", "b"), (2, "", None, None, 0, 0.1, "a", "b"), (3, " \n\t ", "en", "s", 3, 0.1, "a", "b"),
            (4, long, "en", "s", len(long), 0.1, "a", "b"), (5, SENTENCE, "en", "s", 1, 0.1, "a", "b"), (5, SENTENCE, "en", "s", 1, 0.1, "a", "b"),
            (None, SENTENCE, "en", "t", 1, 0.1, "a", "b"), (7, "one two", "fr", "s", 7, 0.1, "a", "b"), (8, "日本 𝄞 \u0000", "ja", "u", 7, 0.1, "a", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op2_quality", "op6_neardup", "op7_mixture"])
def test_query_equals_sql(spark, name):
    queries, oracle = load_all()
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, cur = queries[name](spark, SF), con.execute(oracle[name])
    assert compare.rows_of(df.columns, df.collect()) == compare.rows_of([d[0] for d in cur.description], cur.fetchall())


# --- near duplicates and fingerprints

def shingles(text, size=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def test_shingle_sets_equal_plain_sets():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("AaBbcÉé") for _ in range(rng.randint(0, 40))) + rng.choice(["", " ", "\n"]) for _ in range(300)]
    flat, offsets = shingle_sets(texts)
    assert np.diff(offsets).tolist() == [len(shingles(t)) for t in texts]


def test_sketches_estimate_similarity_and_are_full():
    rng = np.random.default_rng(4)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (900, 150, 150))
    sets = [np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b])), common[:3]]
    flat, offsets = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for made in (fast_similarity_sketch(flat, offsets, 10), minhash_signatures(flat, offsets, 1024)):
        assert abs((made[0] == made[1]).mean() - 0.75) < 0.06
    assert (fast_similarity_sketch(flat, offsets, 7) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


@pytest.mark.parametrize("component", [lambda d: neardup.near_duplicates(d).select("doc_id", "component_id"), fingerprints.near_copies])
def test_near_copies_equal_all_pairs(spark, component):
    rng = random.Random(7)
    rows = []
    for family in range(6):
        base = [f"f{family}w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(25):
            words = [f"n{rng.random()}" if rng.random() < 0.008 * family else w for w in base]
            rows.append((len(rows), " ".join(words)))
    texts = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(texts[i] & texts[j]) >= 75 * len(texts[i] | texts[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = {r["doc_id"]: r["component_id"] for r in component(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == label and len(set(label)) > 6


def test_near_duplicates_of_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {
        (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (None, None, True), (7, 7, True), (8, 8, True)}
    assert len(got) == 9 and {r["doc_id"]: r["n_shingles"] for r in got}[7] == 1
    left = neardup.keep_one_of_each(odd)
    assert left.columns == odd.columns and left.filter("doc_id = 5").count() == 1 and left.count() == 8
    assert neardup.near_duplicates(none).count() == 0 and neardup.keep_one_of_each(none).count() == 0


def test_one_of_each_where_an_id_has_two_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + " more"), (4, c), (4, c + " more"), (5, ""), (5, c), (None, a), (None, a), (6, None), (6, " ")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    left = Counter((r["doc_id"], r["text"]) for r in neardup.keep_one_of_each(docs).collect())
    assert sum(n for (i, _), n in left.items() if i == 4) == 1 and sum(n for (i, _), n in left.items() if i == 6) == 1
    assert {k: n for k, n in left.items() if k[0] not in (4, 6)} == {(1, a): 1, (2, b): 1, (5, ""): 1, (None, a): 2}


def test_materialise_repeats_each_row_of_an_id_by_its_own_copies(spark):
    rows = [(i % 7 or None, f"t{i % 40} " * (1 + i % 5), "ab"[i % 3 == 0]) for i in range(280)] + [(None, "x y z", "c")] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = Counter()
    for r in mixture.scheduled(docs, text=F.col("text"), source=F.col("source"))[0].collect():
        wanted[r["doc_id"], r["text"], r["source"]] += r["copies"]
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in mixture.materialise(docs).collect())
    assert got == +wanted and wanted[None, "x y z", "c"] % 1000


def test_edited_likeness_equals_plain(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs, 7).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(text), shingles(edited)
        assert abs(got[i]["near_edited"] - len(a & b) / max(1, len(a | b))) < 0.25
    out = fingerprints.edited_likeness(odd, 3).collect()
    assert len(out) == 9 and len({r["fingerprint"] for r in out if r["doc_id"] in (1, 2, 3)}) == 1
    assert fingerprints.edited_likeness(none, 3).count() == 0
    assert fingerprints.edited_likeness(odd.filter("doc_id = 7"), 3).collect()[0]["near_next"] == 1.0
    assert fingerprints.fingerprints(odd).count() == 9


# --- quality

def plain_base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def plain_divergence(p, q):
    return sum(x / 2 * math.log2(2 * x / (x + y)) if x else 0 for x, y in zip(p, q)) + sum(y / 2 * math.log2(2 * y / (x + y)) if y else 0 for x, y in zip(p, q))


def test_quality_equals_plain(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*[F.col(c) for c in ("doc_id", "text")]).unionByName(odd.select("doc_id", "text").filter("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id") + 10 ** 6))
    limits = quality.Limits()
    measured = quality.measures(docs).persist()
    refs = quality.references(measured, limits)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in quality.judge(measured, refs, limits).collect():
        text = texts[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_base(text), r["doc_id"]
        w = WORD.findall(text)
        listed = Counter(x.strip(".,;:!?'\"()-").lower() for x in w)
        far = False
        if len(w) >= limits.least_words:
            mine = [listed[v] / len(w) for v in quality.VOCABULARY]
            mine.append(1 - sum(mine))
            want = min(plain_divergence(mine, q) for _, q in refs.values())
            assert abs(want - r["word_divergence"]) < 1e-6
            far |= want > limits.word_divergence + limits.word_slack / len(w)
        else:
            assert r["word_divergence"] is None
        assert sum(r["classes"]) == len(text)
        far |= (r["class_divergence"] or 0) > limits.class_divergence + limits.class_slack / max(1, len(text))
        assert r["kept"] == (not r["base_failed"] and not far)
    left = quality.keep_good(odd)
    assert left.columns == odd.columns and left.filter("length(text) < 20").count() == 0
    assert quality.quality(none).count() == 0 and quality.keep_good(none).count() == 0


def test_quality_agrees_with_labels(spark):
    got = quality.quality(documents(spark, "/root/testdata/sf0.01")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    good = got.filter("quality = 1 AND NOT base_failed")
    assert good.filter("NOT kept").count() == 0
    assert got.filter("quality = 0 AND kept").count() < 0.5 * got.filter("quality = 0").count()


# --- pieces

def test_pieces_equal_the_library(spark, odd, none):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(2)
    texts = ["".join(rng.choice("  aeinthsro.,-\nÉéß日Q9") for _ in range(rng.randint(0, 90))) for _ in range(400)] + [" " * k + "a" + " " * (k % 5) for k in range(40)] + ["x" * 5000]
    made = pieces.compiled(pieces.model_bytes())
    ids = [np.frombuffer(r, "<i4").tolist() for r in made.encode(texts)]
    assert ids == library.encode(texts) and [made.decode(i) for i in ids] == texts
    model = pieces.model_bytes()
    out = {(r["doc_id"], r["n_tokens"]): r for r in pieces.encode(odd, model, verify=True).collect()}
    assert out[(1, 0)]["ids"] is None and out[(2, 0)]["ids"] == [] and all(r["round_trip"] in (True, None) for r in out.values())
    back = pieces.decode(pieces.encode(odd, model), model).collect()
    assert sorted(r["text"] or "" for r in back) == sorted(t[1] or "" for t in odd_rows())
    assert pieces.encode(none, model).count() == 0


def test_models_with_user_defined_pieces_are_refused():
    piece = lambda text, kind: b"\x0a" + bytes([len(text) + 4]) + b"\x0a" + bytes([len(text)]) + text + b"\x18" + bytes([kind])
    assert pieces.Model.parse(piece(b"ab", 1) + piece(b"<s>", 3)).pieces == ["ab", "<s>"]
    with pytest.raises(ValueError):
        pieces.Model.parse(piece(b"ab", 1) + piece(b"<sep>", 4))


def test_unigram_weights_are_a_shortest_path():
    model = pieces.Model(["<unk>", "a", "b", "ab", "aba", "▁", "▁a"], [0, -1.0, -1.5, -2.0, -2.4, -0.5, -2.0], [2, 1, 1, 1, 1, 1, 1], False, True, False)
    made = pieces.Transducer(model)

    def best(rest):
        if not rest:
            return 0.0, []
        ways = [(best(rest[len(p):]), i) for p, i in made.ids.items() if rest.startswith(p)]
        return min(((cost - model.scores[i], [i, *path]) for (cost, path), i in ways), default=(math.inf, []))

    for text in ("ab", "aba", "abab", "baab", "ababa a ab"):
        ids = np.frombuffer(made.encode([text])[0], "<i4").tolist()
        assert abs(-sum(model.scores[i] for i in ids) - best("▁" + text.replace(" ", "▁"))[0]) < 1e-9


# --- language and toxicity

def test_language_on_held_out(spark, odd, none):
    queries, _ = load_all()
    got = queries["op8_language"](spark, "/root/testdata/sf0.01").join(documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.98 * len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    names, logp = language.fit(language.teaching(documents(spark, SF)))
    by_id = {r["doc_id"]: r for r in language.identify(odd, names, logp).collect()}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3)) and by_id[5]["lang_pred"] == "en"
    assert language.identify(odd, *language.fit(none)).filter("lang_pred <> 'und'").count() == 0
    assert language.keep_identified(odd).columns == odd.columns and language.keep_identified(none).count() == 0


def test_language_mixture_names_both(spark):
    names, logp = language.fit(language.teaching(documents(spark, SF)))
    by = {r["lang"]: r["text"] for r in documents(spark, SF).filter("length(text) between 1500 and 4000").collect()}
    both = spark.createDataFrame([(1, by["en"][:1500] + " " + by["de"][:1500])], "doc_id long, text string")
    assert {x.split(":")[0] for x in language.identify(both, names, logp).collect()[0]["langs"].split(",")} >= {"de", "en"}


def test_language_mixture_of_four_of_six(spark):
    draw = random.Random(5)
    common, *lists = [["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)] for _ in range(7)]
    lists = [common + own for own in lists]
    said = lambda k, n: " ".join(draw.choice(lists[k]) for _ in range(n))
    docs = spark.createDataFrame([(i, said(i % 6, 80), f"l{i % 6}") for i in range(120)], "doc_id long, text string, lang string")
    mixed = [(n, " ".join(said(k, 80) for k in range(n))) for n in range(1, 7)]
    names, logp = language.fit(docs)
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(mixed, "doc_id long, text string"), names, logp).collect()}
    for n, _ in mixed:
        assert [x.split(":")[0] for x in sorted(got[n]["langs"].split(","))] == [f"l{k}" for k in range(n)] and abs(got[n]["score"] - 1 / n) < 0.1


def test_toxicity_learns_words_and_misspellings(odd, none):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    bad = ["wretchedly", "scoundrel", "horrible", "blockhead"]

    def text(toxic):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 300))]
        for _ in range(4 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        return " ".join(words)

    labels = np.array([i % 2 for i in range(600)])
    scorer = toxicity.train([text(y) for y in labels], labels)
    held = scorer.scores([text(i % 2) for i in range(200)]) >= 0.5
    assert (held == np.arange(200) % 2).mean() > 0.95
    slips = scorer.scores([text(0) + " scoundrell horribel wretchedlyy blokhead " + text(0) for _ in range(20)])
    assert (slips > scorer.scores([text(0) for _ in range(20)]).mean() + 0.3).mean() > 0.8
    got = {r["doc_id"]: r for r in toxicity.score(odd, scorer).collect()}
    assert got[1]["score"] == got[2]["score"] == got[3]["score"] == 0.0 and toxicity.score(none, scorer).count() == 0
    assert toxicity.train(["a b"], np.array([1])).scores(["a b"]).tolist()[0] < 0.5


# --- mixture, shards, urls

def test_mixture_meets_targets(spark, odd, none):
    rows = mixture.mix(documents(spark, "/root/testdata/sf0.01")).join(documents(spark, "/root/testdata/sf0.01").select("doc_id", "source"), "doc_id").collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.5
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6 * sum(r["size"] for r in rows)
    again = mixture.mix(odd).collect()
    assert len(again) == 9 and sorted(map(str, again)) == sorted(map(str, mixture.mix(odd).collect())) and mixture.mix(none).count() == 0
    assert mixture.materialise(odd).columns == odd.columns and mixture.materialise(none).count() == 0


def test_mixture_meets_targets_of_small_sources(spark):
    rows = ([(i, "w " * (1000 + i % 7), f"a{i % 3}") for i in range(3000)] + [(3000 + i, "w " * 100, "b") for i in range(12)]
            + [(4000, "w " * 300, "c"), (4001, "w w w", "d"), (4002, "w", None)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source_of = {r[0]: r[2] for r in rows}
    for bits in (6, 10, 19, 20):
        got = mixture.mix(docs, bits).collect()
        assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
        for source in set(source_of.values()):
            mine = [r for r in got if source_of[r["doc_id"]] == source]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.5
    kept = Counter(r["doc_id"] for r in mixture.materialise(docs, 6).collect())
    assert kept == Counter({r["doc_id"]: r["copies"] for r in mixture.mix(docs, 6).collect() if r["copies"]}) and kept[4000] == kept[4001] == kept[4002] == 2


def test_schedule_is_spread(spark):
    targets = spark.createDataFrame([(0, 900, 600.0), (1, 600, 300.0), (2, 600, 124.0)], "source_no long, source_size long, target double")
    slots = sorted((r["slot"], r["source_no"], r["turn"]) for r in mixture.slots(targets, 1024.0, 10).collect())
    counts = Counter()
    for seen, (_, source, turn) in enumerate(slots, 1):
        assert turn == counts[source]
        counts[source] += 1
        assert abs(counts[0] - seen * 600 / 1024) < 8
    assert counts[0] == 600 and [s for s, _, _ in slots] == list(range(1024))


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_rows_lie_in_the_order_of_their_slots(spark, bits):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(90)] + [(200, "x y z", "s1")] * 3 + [(300, "w", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixture.mix(docs, bits).collect()
    first = {}
    for r in got:
        assert (r["first_slot"] is None) == (r["taken"] == 0)
        if r["taken"]:
            first.setdefault(r["doc_id"], r["first_slot"])
    laid = [r["doc_id"] for r in mixture.materialise(docs, bits).collect()]
    once = [d for d in laid if laid.count(d) == 1]
    assert [first[d] for d in once] == sorted(first[d] for d in once) and len(once) > 10
    source = {r[0]: r[2] for r in rows}
    third = len(laid) // 3
    assert bits < 20 or all(0.15 < sum(source[d] == "s0" for d in part) / third < 0.9 for part in (laid[:third], laid[third:2 * third], laid[2 * third:3 * third]))


def test_shards_are_even_and_gapless(spark, odd, none):
    rows = sharding.shard(documents(spark, "/root/testdata/sf0.01"), 4).collect()
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(4):
        mine = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 4) <= total / 256 + largest
    hot = spark.createDataFrame([(i, "same text", "x") for i in range(3000)] + [(i, f"text {i}", "x") for i in range(3000, 6000)], "doc_id long, text string, size string")
    sizes = Counter(r["shard"] for r in sharding.shard(hot, 4).collect())
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    got = {r["doc_id"]: r for r in sharding.shard(odd, 3).collect()}
    assert (got[1]["size"], got[1]["text_crc32"]) == (1, 0) and got[7]["text_crc32"] == zlib.crc32(b"one two") and sharding.shard(none).count() == 0


def test_shards_with_very_long_documents(spark):
    texts = [f"{i} " * 30000 if i % 100 == 0 else f"short {i}" for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, total = sharding.shard(docs, 4).collect(), sum(len(t) + 1 for t in texts)
    for s in range(4):
        mine = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 4) <= max(map(len, texts)) + total / 256
    light = sharding.keyed(docs).cache()
    splitters, ranges = sharding.splitters_for(light, 1024)
    keys = [r["key"] for r in light.select("key").collect()]
    assert dict(zip(ranges["range"], ranges["rows"], strict=True)) == Counter(np.searchsorted(splitters, keys, side="right").tolist())
    assert ((ranges["bytes"] <= 2 * total / 1024) | (ranges["rows"] == 1)).all()


def test_shards_of_rows_that_repeat(spark):
    rows = [(7, "the same text again and again " * 3)] * 2000 + [(100 + i, f"other {i} " * (3 + i % 19)) for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.02 * sum(sums.values()) / 4 and len(got) == 6000
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(4))


def test_urls_rules_and_mined_rules(spark):
    odd = [(1, None), (2, "no host"), (3, "http://WWW.Example.com/en/1?x=/net/"), (4, "https://a.example.com/en/"), (5, "http://example.net/fr/x#y"), (6, "x://com"), (7, "ftp://b.com/"), (7, "ftp://b.com/")]
    bad = [(100 + i, f"http://m{i % 7}.bad.org/{'deal' if i % 2 else 'news'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(odd + bad, "page_id long, url string").withColumn("rule", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in bad[:300]] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    got = urls.filter_urls(pages, labels).collect()
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(odd) + len(bad)
    assert by[1] == by[2] == ("", "", None, "allow")
    assert by[3] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and by[4][2:] == ("example.com/en/", "block")
    assert by[5] == ("example.net", "/fr/x", "net/fr/", "block") and by[6] == ("com", "", None, "allow") and by[7][2:] == ("com/", "allow")
    assert all(by[i][3] == ("block" if i % 2 else "allow") for i, _ in bad)
    assert urls.filter_urls(pages.limit(0), labels).count() == 0 and urls.filter_urls(pages, labels.limit(0)).filter("mined_confidence is not null").count() == 0
