"""Personal data: anchor expansion against plain pattern search, SQL, and odd rows."""

import random
import re

import duckdb
import pandas as pd
from test_texts import SCHEMA, odd_rows

from tapeloom.llm import pii
from tapeloom.llm.suite import ORACLE

PLANTED = ["", "mail a.b+c@x-y.example.org.", "a@b@c.de", "10.0.0.255 and 10.0.0.256 1.2.3.4.5.6.7.8", "card 4929 3483-8514 6306 no 4929348385146307", "+1 (017) 555-7713 x +12 +1 2",
           "ssn: 123-45-6789 SSN 000-45-6789 pssn 123-45-6788", "IBAN DE89 3704 0044 0532 0130 00 and Iban: DE89370400440532013001", "account no. 12345678, Konto nr 99-88-77 acct 12",
           "https://user:secret@host.example/x http://plain.example/", "日本 +49 30 1234567 𝄞 é@è a@b.c", "social security number 219-09-9999", None]


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate({**pii.BASE, **pii.ADDED}.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            a, b = m.span() if kind in pii.BASE else m.span(1)
            if pii.VALID[kind](text[a:b]):
                out.append((a, k, b))
    return sorted(out)


def test_spans_equal_pattern_search():
    rng, finder, found = random.Random(3), pii.Finder(), 0
    bits = ["@", "a", "b.c", ".", "1", "23", "256", " ", "-", "+1", "(", "4929348385146306", "http", "://", "u:p@h.de", "ssn", "SSN: ", "123-45-6789", "IBAN ",
            "DE89 3704 0044 0532 0130 00", "account", " no. ", "12345678", "é", "\n", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(20000)] + [t for t in PLANTED if t]
    for text in texts:
        got = finder.spans(text)
        assert got == plain(text), text
        found += len(got)
    assert found > 5000


def test_checks():
    assert pii.luhn("4929348385146306") and not pii.luhn("4929348385146307")
    assert pii.is_ip("001.2.3.255") and not pii.is_ip("1.2.3.1000")
    assert pii.is_iban("DE89 3704 0044 0532 0130 00") and not pii.is_iban("DE88 3704 0044 0532 0130 00")
    assert not pii.is_ssn("666-10-1000") and not pii.is_ssn("123-00-1000") and pii.is_ssn("123-45-6789")


def test_query_equals_sql_on_planted_rows(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(PLANTED)] + [(0, PLANTED[1]), (None, PLANTED[3])]
    frame = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.op13_pii(spark, str(tmp_path))
    con = duckdb.connect()
    con.register("documents", frame)
    cur = con.execute(ORACLE["op13_pii"])
    assert got.columns == [d[0] for d in cur.description]
    key = lambda r: (str(r[0]), r[-1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(cur.fetchall(), key=key)
    kinds = {s.partition(":")[0] for r in got.collect() for s in r["spans"].split(",") if s}
    assert kinds == set(pii.KINDS)


def test_odd_and_empty_rows_and_masks(spark):
    long = "x" * 300000 + " 10.1.2.3 " + "1 " * 100000 + "@" * 50000
    rows = [*odd_rows(), (9, long, None, None, 1, 0.1, "a", "b")]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == got[2] == got[8] == [] and got[9] == [("ip", 300001, 300009)]
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0
    masked = pii.mask(spark.createDataFrame([(1, PLANTED[4], "c"), (2, None, "d")], "doc_id long, text string, `a.b` string"))
    assert masked.columns == ["doc_id", "text", "a.b"]
    assert [r["text"] for r in masked.sort("doc_id").collect()] == ["card [CARD] no 4929348385146307", None]
