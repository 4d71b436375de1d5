"""Mined url rules against plain enumeration of all token sets, and many shared tokens."""

import itertools
import random
import time

import pytest

from tapeloom.llm import urls


def plain(rows, bad, least, confidence, lift):
    """Best confidence of the minimal rules in each url's tokens, by counting every set of up to five tokens."""
    known = [(t, bad[p]) for p, t in rows if t and p in bad]
    base, rules = sum(b for _, b in known) / max(1, len(known)), {}
    subsets = {s for t, _ in known for n in range(1, 6) for s in itertools.combinations(sorted(t), n)}
    for s in sorted(subsets, key=len):
        hit = [b for t, b in known if set(s) <= set(t)]
        if sum(hit) >= least and sum(hit) / len(hit) >= confidence and sum(hit) / len(hit) / base >= lift and not any(set(r) < set(s) for r in rules):
            rules[s] = sum(hit) / len(hit)
    return {p: max((c for r, c in rules.items() if set(r) <= set(t)), default=None) for p, t in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_equal_plain_enumeration(spark, seed):
    rng = random.Random(seed)
    pages, labels = [], []
    for i in range(200):
        words = rng.sample(["ad", "buy", "cheap", "news", "blog"], rng.randint(0, 3))
        words += ["twin", "pair"] if i % 3 == 0 else []
        pages.append((i, f"http://h{rng.randint(0, 3)}.example.org/{'/'.join(words)}"))
        if i % 5:
            labels.append((i, 1, int(({"ad", "buy"} <= set(words) or "twin" in words and "news" in words) and rng.random() < 0.9)))
    df = spark.createDataFrame(pages, "page_id long, url string")
    tokens = {r["page_id"]: r["tokens"] for r in urls.tokenised(df).collect()}
    want = plain([(p, tokens[p]) for p, _ in pages], {p: t == 1 for p, _, t in labels}, 8, 0.6, 1.5)
    got = {r["page_id"]: r["mined_confidence"] for r in urls.filter_urls(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert sum(v is not None for v in want.values()) > 10
    assert {p: c and round(c, 9) for p, c in got.items()} == {p: c and round(c, 9) for p, c in want.items()}


def test_many_shared_tokens_are_one_item(spark):
    shared = "/".join(f"t{chr(97 + i)}" for i in range(26)) + "?" + "&".join(f"k{chr(97 + i)}=1" for i in range(10))
    pages = [(i, f"http://a.bad.org/{shared}") for i in range(40)] + [(100 + i, f"http://a.good.org/x{i % 3}") for i in range(80)]
    labels = [(p, 1, int(p < 100)) for p, _ in pages if p not in (7, 150)]
    start = time.time()
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r["page_id"] for r in got if r["mined_confidence"] is not None} == set(range(40)) and len(got) == 120
    assert time.time() - start < 40
