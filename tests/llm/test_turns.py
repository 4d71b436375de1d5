"""Conversation repair: the search against all repairs, blocks against whole conversations, the query against SQL."""

import itertools
import random
import re

import duckdb
import pandas as pd
import pytest

from tapeloom.llm import turns
from tapeloom.llm.suite import ORACLE

SHAPE = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string, `a.b` string, place long, kind string"


def cheapest(kinds, prices):
    """(cost, edits) of the best repair, by trying all with at most two turns inserted at a place."""
    best = None
    for ways in itertools.product(itertools.product(range(3), "DKR"), repeat=len(kinds)):
        for tail in range(3):
            for roles, cost, edits in _spelled(kinds, ways, tail, prices):
                if SHAPE.match(roles) and (best is None or (cost, edits) < best):
                    best = (cost, edits)
    return best


def _spelled(kinds, ways, tail, prices):
    roles, cost, edits = "", 0, ""
    for kind, (many, edit) in zip(kinds, ways, strict=True):
        fault, initial = divmod(kind, 4)
        for _ in range(many):
            roles += "a" if roles.endswith("u") else "u"
        cost, edits = cost + many * prices.insert, edits + "I" * many + edit
        if edit == "D":
            cost += prices.delete
        elif fault in (1, 2):
            return
        else:
            roles += "suax"[initial] if edit == "K" else "a" if roles.endswith("u") else "u"
            cost += (prices.rerole if edit == "R" else 0) + (prices.truncated if fault == 3 else 0)
    for _ in range(tail):
        roles += "a" if roles.endswith("u") else "u"
    yield roles, cost + tail * prices.insert, edits + "I" * tail


@pytest.mark.parametrize("prices", [turns.Prices(), turns.Prices(3, 4, 1, 1), turns.Prices(1, 1, 1, 1), turns.Prices(2, 9, 2, 3)])
def test_search_finds_the_least_of_the_cheapest(prices):
    rng, search = random.Random(8), turns.Search(prices)
    for _ in range(40):
        kinds = [rng.choice([0, 1, 2, 3, 1, 2, 5, 9, 13, 14, 12]) for _ in range(rng.randint(0, 3))]
        emitted = []
        alive = search.run(kinds, turns.NOTHING, emitted)
        rest = {s: "".join(search.finish(leaf)) for s, (_, leaf) in alive.items()}
        end = search.last({s: c for s, (c, _) in alive.items()}, rest)
        got = (alive[end][0] + search.ends[end][0], "".join(emitted) + rest[end] + search.ends[end][1])
        assert got == cheapest(kinds, prices), kinds


def test_survivors_meet_so_that_little_is_held():
    rng, search = random.Random(2), turns.Search()
    for kinds in ([rng.choice([0, 1, 2, 3, 5, 9, 13]) for _ in range(3000)], [5] * 3000, [13, 14] * 1500, [1, 2] * 1500):
        emitted = []
        alive = search.run(kinds, turns.NOTHING, emitted)
        assert len(kinds) - len(emitted) < 40 and all(len(search.finish(leaf)) == len(kinds) - len(emitted) for _, leaf in alive.values())


@pytest.mark.parametrize("many", [20000, 20001])
def test_a_tie_that_only_the_end_settles(many):
    search, emitted = turns.Search(), []
    alive = search.run([1] * many, turns.NOTHING, emitted)
    rest = {s: "".join(search.finish(leaf)) for s, (_, leaf) in alive.items()}
    end = search.last({s: c for s, (c, _) in alive.items()}, rest)
    assert "".join(emitted) + rest[end] == ("D" if many % 2 else "") + "KR" * (many // 2)


def some_rows():
    rng, rows = random.Random(4), []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 14)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 2]), rng.choice(["user", "assistant", "system", "tool", "", None, "user"]),
                         rng.choice(["Yes.", "No!", "cut", "", " \n", None, "a.b.c? \t", "日本 é."]), "x", 1, "k"))
    rows += [(7, 3, "user", "Again.", "x", 1, "k")] * 5 + [(8, 0, "system", "w " * 200000 + " " * 100000, "x", 1, "k")]
    return rows


def test_blocks_equal_whole_conversations(spark, monkeypatch):
    rows = spark.createDataFrame(some_rows(), SCHEMA)
    columns = ["conv_id", "turn", "role", "text", "fault", "edits", "before", "after", "new_role"]
    whole = sorted(map(str, turns.repair(rows).select(*columns).collect()))
    monkeypatch.setattr(turns, "BLOCK_BITS", 1)
    assert sorted(map(str, turns.repair(rows).select(*columns).collect())) == whole and len(whole) == len(some_rows())


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    rows = [r[:4] for r in some_rows()]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    got, cur = turns.op12_turns(spark, str(tmp_path)), con.execute(ORACLE["op12_turns"])
    assert got.columns == [d[0] for d in cur.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(cur.fetchall(), key=str)


def test_empty_table(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert turns.repair(turns.damaged(rows)).count() == 0 and turns.digests(turns.repair(rows)).count() == 0
