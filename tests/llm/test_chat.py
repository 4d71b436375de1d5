"""Role repair against a search over all repairs, also across blocks."""

import itertools
import random

import pytest

from tapeloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, fragment string"


def best(roles):
    """Least cost and the first role sequence that reaches it, over all 3^n."""
    rules = chat.Automaton()
    found = None
    for way in itertools.product(range(3), repeat=len(roles)):
        cost, state = 0, chat.START
        for given, role in zip(roles, way):
            cost += int(rules.step[state, role]) + (0 if chat.ROLES[role] == given else rules.costs.relabel)
            state = role
        cost += int(rules.end[state])
        if found is None or cost < found[0]:
            found = (cost, [chat.ROLES[r] for r in way])
    return found[1]


@pytest.mark.parametrize("bits", [13, 1])
def test_repair_equals_search(spark, monkeypatch, bits):
    monkeypatch.setattr(chat, "BLOCK_BITS", bits)
    rng = random.Random(3)
    rows, want = [], {}
    for c in range(40):
        roles = [rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool"]) for _ in range(rng.randint(1, 7))]
        rows += [(c, t, r, f"t{t}", "clash") for t, r in enumerate(roles)]
        want[c] = best(roles)
    got = chat.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()
    for c, expected in want.items():
        mine = [r for r in got if r["conv_id"] == c]
        assert [r["new_role"] for r in mine] == expected
        assert [r["place"] for r in mine] == list(range(len(mine)))
        text = "".join(r["fragment"] for r in mine)
        turns = [part.split("\n", 1)[0] for part in text.split(chat.OPEN)[1:]]
        assert turns[-1] == "assistant" and all(a != b for a, b in zip(turns, turns[1:])) and "system" not in turns[1:]
        assert mine[-1]["out_turn"] <= len(turns) - 1
        assert text.count(chat.CLOSE) == len(turns)


def test_odd_rows(spark):
    rows = [(None, 0, "human", None, ""), (1, None, "user", "<|im_start|>x", ""), (1, None, "user", "<|im_start|>x", ""), (2, 0, "bot", "", "")]
    got = {(r["conv_id"], r["place"]): r for r in chat.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 4
    assert got[(None, 0)]["new_role"] == "user" and got[(1, 1)]["action"] == "merge" and "< |im_start" in got[(1, 0)]["fragment"]
    assert got[(2, 0)]["action"] == "insert user"
    assert chat.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_render_joins_the_fragments(spark):
    rows = [(5, 0, "user", "a", ""), (5, 1, "user", "b", "")]
    whole = chat.render(chat.repair(spark.createDataFrame(rows, SCHEMA))).collect()[0]["chat"]
    assert whole == "<|im_start|>user\na\n\nb<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
