"""Minimum-cost role repair of conversations, and their rendering.

A legal conversation is an automaton over the role of the last turn: at most one system turn first, then user and
assistant in turn, ending with the assistant. Each given turn takes a role (its own for free, another one at the cost
of a relabel), is merged into the turn before if that has its role, or is preceded by an empty turn of the one role
that makes it legal; the end may need an empty assistant turn. Dynamic programming over the automaton finds the repair
of least total cost; of equal ones that with the earliest role names in SYSTEM, USER, ASSISTANT order, turn by turn.

Conversations of any length: rows are laid out in ranges of (conv_id, turn), so a conversation may span many blocks,
one per range. A block's costs between any two states are a matrix (least-cost products); the matrices give every
block its cost to go, the cost to go decides the state in which each block begins, and then every block is repaired
on its own. What is gathered per conversation is one small row per block.

Output is one row per given turn: its repaired role, the action, the number of its turn in the repaired conversation,
and its rendered fragment; fragments in place order make the rendered conversation. Empty turns that a repair
inserts stand in the fragment of the turn that they precede, or at the end of the last one.

Cases: null and unknown roles cost as much as a relabel for any role; null text counts as empty; equal and null turn
numbers are ordered by role and text; rows with a null conv_id are one conversation of that name; repeated rows are
turns of their own and are usually merged; marks in a text that look like the frame's are broken by a blank. An empty
table gives an empty result. Other columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import keep
from tapeloom.llm.suite import query

#: States are the roles and, last, the beginning.
ROLES = ("system", "user", "assistant")
SYSTEM, USER, ASSISTANT, START = range(4)
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
OPEN, CLOSE, JOIN = "<|im_start|>", "<|im_end|>\n", "\n\n"
#: Legal successors: state -> roles.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 50
#: Rows of a block, as a power of two.
BLOCK_BITS = 13


@dataclass(frozen=True)
class Costs:
    """Costs of a repair's steps; a merge joins a turn to the one before."""

    merge: int = 1
    relabel: int = 5
    insert: int = 3


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-cost products of two rows of matrices."""
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(axis=2), FAR)


@dataclass
class Automaton:
    """Cost and inserted role of every step between states, and of every ending."""

    costs: Costs = field(default_factory=Costs)

    def __post_init__(self) -> None:
        self.step, self.between = np.full((4, 4), FAR, np.int64), np.full((4, 4), -1)
        for a in range(4):
            for b in range(3):
                if b in LEGAL[a]:
                    self.step[a, b] = 0
                elif a == b:
                    self.step[a, b] = self.costs.merge
                else:
                    for x in LEGAL[a]:
                        if b in LEGAL[x]:
                            self.step[a, b], self.between[a, b] = self.costs.insert, x
        self.end = np.array([2 * self.costs.insert, self.costs.insert, 0, 2 * self.costs.insert], np.int64)

    def matrices(self, roles: np.ndarray) -> np.ndarray:
        """Cost matrix of every turn: from the state before it to the state after it."""
        label = np.where(np.arange(4)[None, :] == roles[:, None], 0, self.costs.relabel)
        return np.minimum(self.step[None, :, :] + label[:, None, :], FAR)

    def block(self, roles: np.ndarray) -> np.ndarray:
        """Least-cost product of the turns' matrices, by halving."""
        m = self.matrices(roles)
        while len(m) > 1:
            even = len(m) - len(m) % 2
            m = np.concatenate([product(m[0:even:2], m[1:even:2]), m[even:]])
        return m[0]

    def states(self, roles: np.ndarray, starts: np.ndarray, begin: np.ndarray, after: np.ndarray) -> np.ndarray:
        """States after each turn of the least-cost ways of many stretches of turns, all stepped together; earliest roles first.

        Stretch k starts at ``starts[k]``, comes from state ``begin[k]`` and ends at the costs ``after[k]``.
        """
        table = self.matrices(np.arange(10))
        sizes = np.diff([*starts, len(roles)])
        order = np.argsort(-sizes, kind="stable")
        starts, state = starts[order], begin[order]
        running = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")  # stretches longer than j
        togo, out = np.empty((len(roles), 4), np.int64), np.empty(len(roles), np.int64)
        togo[starts + sizes[order] - 1] = after[order]
        for j in range(len(running) - 1, 0, -1):
            at = starts[:running[j]] + j
            togo[at - 1] = np.minimum((table[roles[at]] + togo[at][:, None, :]).min(axis=2), FAR)
        for j, n in enumerate(running):
            at = starts[:n] + j
            state[:n] = np.argmin(table[roles[at], state[:n]] + togo[at], axis=1)
            out[at] = state[:n]
        return out

    def turns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By state before and after: the action, what is written before the text, and how many turns that opens."""
        action, prefix, opened = np.empty((4, 4), object), np.empty((4, 4), object), np.zeros((4, 4), np.int64)
        for a in range(4):
            for b in range(3):
                extra = int(self.between[a, b])
                if a == b and b not in LEGAL[a]:
                    action[a, b], prefix[a, b] = "merge", JOIN
                else:
                    empty = "" if extra < 0 else f"{OPEN}{ROLES[extra]}\n{CLOSE}"
                    action[a, b] = "keep" if extra < 0 else f"insert {ROLES[extra]}"
                    prefix[a, b] = (CLOSE if a != START else "") + empty + f"{OPEN}{ROLES[b]}\n"
                    opened[a, b] = 1 if extra < 0 else 2
        return action, prefix, opened


#: What closes a conversation whose last turn is the state's.
ENDINGS = {state: CLOSE + "".join(f"{OPEN}{ROLES[x]}\n{CLOSE}" for x in missing)
           for state, missing in ((SYSTEM, (USER, ASSISTANT)), (USER, (ASSISTANT,)), (ASSISTANT, ()))}


def states_before(states: np.ndarray, starts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    before = np.concatenate([[START], states[:-1]]).astype(np.int64)[:len(states)]
    before[starts] = begin
    return before


def role_numbers(roles: pd.Series) -> np.ndarray:
    """Number of each role; 9 for null and unknown ones."""
    known = {**{r: i for i, r in enumerate(ROLES)}, **{a: ROLES.index(r) for a, r in ALIASES.items()}}
    return roles.fillna("").str.strip().str.lower().map(known).fillna(9).to_numpy(np.int64)


def run_starts(names: pd.Series) -> np.ndarray:
    """Where the stretches of equal names start."""
    values = names.to_numpy()
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """conv_id, turn, role, new_role, action, relabelled, out_turn, place and fragment of every row.

    Only roles go to Python, where all conversations of a block of rows are repaired together; texts of any length stay
    in the JVM and are joined to what is written around them.
    """
    rules = Automaton(costs)
    actions, prefixes, opens = rules.turns()
    name = F.when(F.col("conv_id").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("_conv")
    order = ["_conv", "turn", "role", "text"]
    laid = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), name)
    laid = laid.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = keep(laid.withColumn("_block", F.shiftright("_at", BLOCK_BITS)))

    def costs_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Matrices of the first and the last conversation, the only ones that other blocks can share."""
        pdf = pdf.sort_values("_at", ignore_index=True)
        roles, starts = role_numbers(pdf["role"]), run_starts(pdf["_conv"])
        bounds = [*starts.tolist(), len(pdf)]
        return pd.DataFrame([(pdf["_conv"][bounds[k]], pdf["_block"][0], rules.block(roles[bounds[k]:bounds[k + 1]]).reshape(-1).tolist())
                             for k in sorted({0, len(starts) - 1})], columns=["_conv", "_block", "matrix"])

    def costs_to_go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block", ascending=False, ignore_index=True)
        after, out = rules.end, []
        for matrix in pdf["matrix"]:
            out.append(after.tolist())
            after = np.minimum((np.array(matrix).reshape(4, 4) + after[None, :]).min(axis=1), FAR)
        return pdf[["_conv", "_block"]].assign(after=out)

    def ends_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", ignore_index=True)
        roles, after = role_numbers(pdf["role"]), np.array(pdf["after"][0])
        n, every = len(roles), np.arange(4)
        states = rules.states(np.tile(roles, 4), every * n, every, np.tile(after, (4, 1)))
        opened = opens[states_before(states, every * n, every), states].reshape(4, n).sum(axis=1)
        return pd.DataFrame([(pdf["_conv"][0], pdf["_block"][0], after.tolist(), states.reshape(4, n)[:, -1].tolist(), opened.tolist(), n)],
                            columns=["_conv", "_block", "after", "ends", "opened", "n"])

    def begins_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block", ignore_index=True)
        state, turn, begins, firsts = START, 0, [], []
        bases = pdf["n"].cumsum() - pdf["n"]
        for ends, opened in zip(pdf["ends"], pdf["opened"], strict=True):
            begins.append(state)
            firsts.append(turn)
            state, turn = int(ends[state]), turn + int(opened[state])
        return pdf[["_conv", "_block", "after"]].assign(begin=begins, first=firsts, base=bases, last=[*[False] * (len(pdf) - 1), True])

    def repaired(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", ignore_index=True)
        roles, starts = role_numbers(pdf["role"]), run_starts(pdf["_conv"])
        sizes = np.diff([*starts, len(roles)])
        known = pdf.iloc[starts]
        whole = known["begin"].isna().to_numpy()
        begin = known["begin"].fillna(START).to_numpy(np.int64)
        after = np.array([rules.end if w else a for w, a in zip(whole, known["after"], strict=True)], np.int64)
        states = rules.states(roles, starts, begin, after)
        before = states_before(states, starts, begin)
        opened = opens[before, states]
        total = np.cumsum(opened)
        first = known["first"].fillna(0).to_numpy(np.int64) - (total - opened)[starts]
        base = known["base"].fillna(0).to_numpy(np.int64) - starts
        suffix = np.full(len(roles), "", object)
        ends = (starts + sizes - 1)[whole | known["last"].eq(True).to_numpy()]
        suffix[ends] = [ENDINGS[s] for s in states[ends].tolist()]
        return pd.DataFrame({"_at": pdf["_at"], "new_role": np.array(ROLES, object)[states], "action": actions[before, states], "relabelled": states != roles,
                             "out_turn": np.repeat(first, sizes) + total - 1, "place": np.repeat(base, sizes) + np.arange(len(roles)),
                             "_before": prefixes[before, states], "_after": suffix})

    blocks = keep(laid.select("_conv", "_block", "_at", "role").groupBy("_block").applyInPandas(costs_of, "_conv string, _block long, matrix array<long>"))
    cut = keep(blocks.groupBy("_conv").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_conv"))
    togo = keep(blocks.join(cut, "_conv").groupBy("_conv").applyInPandas(costs_to_go, "_conv string, _block long, after array<long>"))
    ends = (laid.select("_conv", "_block", "_at", "role").join(togo, ["_conv", "_block"]).groupBy("_block", "_conv")
            .applyInPandas(ends_of, "_conv string, _block long, after array<long>, ends array<int>, opened array<long>, n long"))
    begins = keep(ends.groupBy("_conv").applyInPandas(begins_of, "_conv string, _block long, after array<long>, begin int, first long, base long, last boolean"))
    around = (laid.select("_conv", "_block", "_at", "role").join(begins, ["_conv", "_block"], "left").groupBy("_block").applyInPandas(
        repaired, "_at long, new_role string, action string, relabelled boolean, out_turn long, place long, _before string, _after string"))
    fragment = F.concat("_before", F.replace("text", F.lit("<|"), F.lit("< |")), "_after").alias("fragment")
    return laid.join(around, "_at").select("conv_id", "turn", "role", "new_role", "action", "relabelled", "out_turn", "place", fragment)


def render(repaired: DataFrame) -> DataFrame:
    """conv_id and chat: whole rendered conversations, for those short enough to be one string."""
    parts = F.array_sort(F.collect_list(F.struct("place", "fragment")))
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["fragment"]), "").alias("chat"))


@query("op1_chat")
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
