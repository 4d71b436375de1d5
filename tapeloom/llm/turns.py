"""Repair of damaged conversations by a Viterbi search whose decisions are emitted as soon as all survivors share them.

Turns may be kept, given another role, deleted, or preceded by empty turns, so that the roles read ``(s?(ua)+)?``. States
are the ways a conversation can stand: nothing yet, after a system turn, after a user turn, after an assistant turn. Each
state's cheapest way is a survivor, a leaf of a tree of back pointers in which every node knows its children. Once the
root has one child left, all survivors agree on that edit, and it is emitted; what is held is the stretch on which
they still differ. Of equal costs the way whose edits are least in ASCII survives, by comparing the complete stretches
that are not emitted; no way can be the beginning of another with the same turns and cost, so the order stands for good.
A survivor that costs more than another one plus what that would pay to follow it at most is given up (``FOLLOW``).

A conversation of any length is spread over blocks of rows. Those of cut conversations first give, for every state to
begin in, cost and order of the states they can end in (one small row a block); a search over these rows settles where
each block begins and ends, and then all blocks are repaired on their own. Faults are found by keys, not by
conversation: a row is a duplicate if another row of its conversation, role and text has an earlier place.

Cases: null ids, roles and texts read as one blank; null turn numbers come first; equal ones are ordered by role and
text; rows with a null conv_id are one conversation; repeated rows are duplicates; texts of any length never reach
the search, which sees one number a row; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import chunks, keep, short_batches
from tapeloom.llm.suite import query

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The role that an inserted or renamed turn gets in each state, and the state after it.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Kinds of a row: 4 * fault + initial, with faults none, blank, duplicate, truncated and initials s, u, a, other.
FAULTS, BLANKS = ("", "blank", "duplicate", "truncated"), " \t\n\x0b\x0c\r"
FAR = 1 << 60
#: Rows of a block, as a power of two.
BLOCK_BITS = 16


@dataclass(frozen=True)
class Prices:
    """Costs of edits; all are positive."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Node:
    """One row's edits on a survivor's way."""

    __slots__ = ("children", "edits", "parent")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.children = parent, edits, []


class Search:
    """The steps between states that a row of each kind allows, and the searches over rows."""

    def __init__(self, prices: Prices = Prices()):
        self.prices = prices
        self.steps = [self._steps(*divmod(kind, 4)) for kind in range(16)]
        more, cut = prices.insert, prices.delete
        #: FOLLOW[p][q]: what a survivor in p pays at most beyond one in q for any way to go on from q.
        self.follow = [[0, 0, 2 * more, 0], [2 * more + cut, 0, 2 * more, 2 * more], [more + cut, more, 0, more], [cut, 0, more, 0]]
        self.follow[SYSTEM][USER], self.follow[NOTHING][USER] = more, more
        self.ends = {NOTHING: (0, ""), SYSTEM: (2 * more, "II"), USER: (more, "I"), ASSISTANT: (0, "")}

    def _steps(self, fault: int, initial: int) -> list[tuple[int, int, int, str]]:
        """(from, to, cost, edits), the best for each pair of states: inserted turns, then the row's edit."""
        best: dict[tuple[int, int], tuple[int, str]] = {}
        late = self.prices.truncated if FAULTS[fault] == "truncated" else 0
        for start in range(4):
            state = start
            for inserted in range(3):
                ways = [(state, self.prices.delete, "D")]
                if FAULTS[fault] not in ("blank", "duplicate"):
                    ways.append((NEXT[state], self.prices.rerole + late, "R"))
                    if initial + 1 == NEXT[state] or (initial == 0 and state == NOTHING):
                        ways.append((initial + 1, late, "K"))
                for to, cost, edit in ways:
                    way = (inserted * self.prices.insert + cost, "I" * inserted + edit)
                    best[start, to] = min(best.get((start, to), (FAR, "")), way)
                state = NEXT[state]
        return [(a, b, cost, edits) for (a, b), (cost, edits) in best.items()]

    def run(self, kinds: list[int], begin: int, emitted: list[str]) -> dict[int, tuple[int, Node]]:
        """Survivors (cost, leaf) by state after all rows; edits that they share are in ``emitted``, a row's each."""
        root = Node(None, "")
        alive, rank = {begin: (0, root)}, {begin: 0}
        for kind in kinds:
            best: dict[int, tuple[int, int, str, Node]] = {}
            for a, b, cost, edits in self.steps[kind]:
                if a in alive:
                    way = (alive[a][0] + cost, rank[a], edits, alive[a][1])
                    if b not in best or way[:3] < best[b][:3]:
                        best[b] = way
            kept = [q for q, w in best.items() if not any(w[0] > v[0] + self.follow[p][q] for p, v in best.items())]
            rank = {q: i for i, q in enumerate(sorted(kept, key=lambda q: best[q][1:3]))}
            old, alive = alive, {}
            for q in kept:
                total, _, edits, node = best[q]
                leaf = Node(node, edits)
                node.children.append(leaf)
                alive[q] = (total, leaf)
            for _, node in old.values():
                while not node.children and node.parent is not None:
                    node.parent.children.remove(node)
                    node = node.parent
            while len(root.children) == 1 and not any(leaf is root for _, leaf in alive.values()):
                root = root.children[0]
                root.parent = None
                emitted.append(root.edits)
        return alive

    def finish(self, leaf: Node) -> list[str]:
        """The edits of a way that were not emitted, a row's each."""
        parts = []
        while leaf.parent is not None:
            parts.append(leaf.edits)
            leaf = leaf.parent
        return parts[::-1]

    def last(self, costs: dict[int, int], order: dict[int, object]) -> int:
        """The state in which the cheapest whole repair ends; ``order`` ranks the ways so far."""
        return min(costs, key=lambda s: (costs[s] + self.ends[s][0], order[s]))


def roles_of(kinds: list[int], edits: list[str], begin: int) -> tuple[list[int], int]:
    """State before each row, and the state in which the rows end, from their edits."""
    state, before = begin, []
    for kind, text in zip(kinds, edits, strict=True):
        before.append(state)
        for edit in text:
            state = state if edit == "D" else SYSTEM if edit == "K" and kind % 4 == 0 else NEXT[state]
    return before, state


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by the crc of ``conv_id:turn``; a repeated row has ``again`` 1."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20).alias("_lot")
    text = F.when(F.col("_lot") == 1, "").when(F.col("_lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), lot).filter("_lot <> 0")
            .select("conv_id", "turn", F.when(F.col("_lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("_lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")))


def conversation() -> Column:
    """Name of a row's conversation, also where its id is null."""
    return F.when(F.col("conv_id").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))


def placed(rows: DataFrame) -> DataFrame:
    """The rows with conversation, place, block, fault and kind, in ranges of conversation and turn."""
    order = ["conv", "turn", "role", "text", "again"]
    laid = rows.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
                       F.monotonically_increasing_id().alias("again"), conversation().alias("conv"))
    laid = keep(laid.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    solid = F.rtrim("text", F.lit(BLANKS))
    first = (laid.groupBy("conv", "role", F.sha2(F.col("text").cast("binary"), 256).alias("_sha")).agg(F.min("place").alias("place"))
             .select("place", F.lit(True).alias("_first")))
    fault = F.when(solid == "", 1).when(F.col("_first").isNull(), 2).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    return keep(laid.join(first, "place", "left").select("conv_id", "turn", "role", "text", "conv", "place", F.shiftright("place", BLOCK_BITS).alias("block"),
                                                         (4 * fault + initial).cast("int").alias("kind")))


def _runs(names: pd.Series) -> Iterator[tuple[int, int]]:
    """From and to of the stretches of equal names."""
    values = names.to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist() if len(values) else []
    yield from zip(cuts, [*cuts[1:], len(values)], strict=True)


def repair(rows: DataFrame, prices: Prices = Prices()) -> DataFrame:
    """conv_id, turn, role, text, place and fault of every row, with its edits (initials, the row's own in upper K, R or D,
    inserted turns I before it, and at the end of a conversation behind it), ``before`` and ``after`` (roles of inserted
    turns), and new_role (null if deleted)."""
    search = Search(prices)
    laid = placed(rows)
    slim = laid.select("conv", "block", "place", "kind")

    def ends_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        kinds, costs, ranks = pdf["kind"].tolist(), [], []
        for begin in range(4):
            emitted: list[str] = []
            alive = search.run(kinds, begin, emitted)
            order = sorted(alive, key=lambda s: "".join(search.finish(alive[s][1])))
            costs += [alive[s][0] if s in alive else FAR for s in range(4)]
            ranks += [order.index(s) if s in alive else 9 for s in range(4)]
        return pd.DataFrame({"conv": pdf["conv"].iloc[:1], "block": pdf["block"].iloc[:1], "costs": [costs], "ranks": [ranks]})

    def ways_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Begin and end of every block of a conversation: the same search over blocks instead of rows."""
        pdf = pdf.sort_values("block", ignore_index=True)
        costs, order, back = {NOTHING: 0}, {NOTHING: 0}, []
        for block_costs, ranks in zip(pdf["costs"], pdf["ranks"], strict=True):
            best = {q: min((costs[p] + int(block_costs[4 * p + q]), order[p], p) for p in costs) for q in range(4)}
            best = {q: w for q, w in best.items() if w[0] < FAR}
            ranked = sorted(best, key=lambda q: (best[q][1], ranks[4 * best[q][2] + q]))
            costs, order = {q: best[q][0] for q in ranked}, {q: i for i, q in enumerate(ranked)}
            back.append({q: best[q][2] for q in ranked})
        end, ways = search.last(costs, order), []
        for step in reversed(back):
            ways.append((step[end], end))
            end = step[end]
        begins, ends = zip(*reversed(ways), strict=True)
        return pdf[["conv", "block"]].assign(begin=begins, end=ends, last=[*[False] * (len(pdf) - 1), True])

    def repaired(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("place", ignore_index=True), []
        places, every = pdf["place"].tolist(), pdf["kind"].tolist()
        for a, b in _runs(pdf["conv"]):
            kinds, edits = every[a:b], []
            whole = pd.isna(pdf["begin"].iat[a])
            begin = NOTHING if whole else int(pdf["begin"].iat[a])
            alive = search.run(kinds, begin, edits)
            rest = {s: search.finish(leaf) for s, (_, leaf) in alive.items()}
            end = search.last({s: c for s, (c, _) in alive.items()}, {s: "".join(r) for s, r in rest.items()}) if whole else int(pdf["end"].iat[a])
            edits += rest[end]
            before, state = roles_of(kinds, edits, begin)
            trail = search.ends[end][1] if whole or bool(pdf["last"].iat[a]) else ""
            edits[-1] += trail
            for i, (kind, text, start) in enumerate(zip(kinds, edits, before, strict=True)):
                own = text.rstrip("I")
                ahead = []
                for _ in range(len(own) - 1):
                    start = NEXT[start]
                    ahead.append(NAMES[start])
                behind, at = [], state
                for _ in range(len(text) - len(own)):
                    at = NEXT[at]
                    behind.append(NAMES[at])
                out.append((places[a + i], text, ahead, behind, NAMES[NEXT[start]] if own[-1] == "R" else own[-1]))
        return pd.DataFrame(out, columns=["place", "edits", "before", "after", "own"])

    sizes = slim.groupBy("conv").agg(F.min("block").alias("_from"), F.max("block").alias("_to")).filter("_from < _to").select("conv")
    cut = slim.join(sizes, "conv", "left_semi")
    ends = keep(cut.groupBy("conv", "block").applyInPandas(ends_of, "conv string, block long, costs array<long>, ranks array<int>"))
    ways = keep(ends.groupBy("conv").applyInPandas(ways_of, "conv string, block long, begin int, end int, last boolean"))
    edits = slim.join(ways, ["conv", "block"], "left").groupBy("block").applyInPandas(repaired, "place long, edits string, before array<string>, after array<string>, own string")
    new_role = F.when(F.col("own") == "K", F.col("role")).when(F.col("own") != "D", F.col("own"))
    return laid.join(edits, "place").select("conv_id", "turn", "role", "text", "conv", "place", "kind", F.element_at(F.array(*map(F.lit, FAULTS)), (F.col("kind") / 4).cast("int") + 1).alias("fault"),
                                            "edits", "before", "after", new_role.alias("new_role"))


def digests(repaired: DataFrame, prices: Prices = Prices()) -> DataFrame:
    """Counts, audit and hash of every conversation of repaired rows.

    A hash over a whole text has one order, so each conversation's rows stream through one task, sorted by Spark and
    read a batch at a time; what is held is the hash and one letter an edit.
    """
    late = F.when((F.col("fault") == "truncated") & F.col("new_role").isNotNull(), prices.truncated).otherwise(0)
    own = F.when(F.col("new_role").isNull(), prices.delete).when(F.contains(F.col("edits"), F.lit("R")), prices.rerole).otherwise(0)
    empty = lambda roles: F.transform(roles, lambda r: F.concat(r, F.lit(":")))
    line = F.when(F.col("new_role").isNotNull(), F.array(F.concat_ws(":", "new_role", "text"))).otherwise(F.array().cast("array<string>"))
    rows = repaired.select("conv", "place", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "edits",
                           (own + late + prices.insert * (F.size("before") + F.size("after"))).cast("long").alias("cost"),
                           F.concat(empty("before"), line, empty("after")).alias("lines"), F.array_join(F.concat(empty("before"), line, empty("after")), "\n").alias("_text"))
    rows = rows.withColumn("some", F.size("lines") > 0).drop("lines")
    rows = short_batches(rows.repartition("conv").sortWithinPartitions("conv", "place"))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = f"conv string, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, out = None, []

        def told() -> None:
            gaps = 0 if low is None else high - low + 1 - distinct
            out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, "".join(audit), sha.hexdigest()))

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", *names, "audit", "repaired_sha256"])
            out.clear()
            return batch

        for batch in chunks(batches, "_text"):
            for row in batch.to_pylist():
                if row["conv"] != conv:
                    if conv is not None:
                        told()
                    conv, low, high, distinct, illegal, cost, audit, sha, any_line = row["conv"], None, None, 0, 0, 0, [], hashlib.sha256(), False
                    counts, before = dict.fromkeys(FAULTS, 0), None
                if row["turn"] is not None and row["turn"] != high:
                    low, high, distinct = row["turn"] if low is None else low, row["turn"], distinct + 1
                illegal += before is not None and before + row["initial"] not in ("su", "ua", "au")
                before = row["initial"]
                counts[row["fault"]] += 1
                cost += row["cost"]
                audit.append(row["edits"])
                if row["some"]:
                    sha.update(("\n" if any_line else "").encode() + row["_text"].encode("utf-8", "surrogatepass"))
                    any_line = True
            if len(out) >= 1000:
                yield made()
        if conv is not None:
            told()
        yield made()

    return rows.mapInArrow(work, schema)


def _sql() -> str:
    """The same search turn by turn: each state's cheapest (cost, edits), compared as pairs."""
    def inserted(way: str, times: int = 1) -> str:
        return f"{{'c': {way}.c + {5 * times}, 'e': {way}.e || '{'I' * times}'}}"

    return rf"""
WITH RECURSIVE
bytes AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
lots AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, c: list_reduce(list_prepend(xor(crc, c), list_transform(range(8), lambda i: 0::BIGINT)), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 20 AS lot FROM bytes),
hurt AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN lot = 3 THEN [0, 1] ELSE [0] END) AS again FROM lots WHERE lot <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS seen,
  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS solid, substr(role, 1, 1) AS i FROM hurt),
rows_ AS MATERIALIZED (SELECT *, CASE WHEN solid = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  i || coalesce(lead(i) OVER (PARTITION BY conv_id ORDER BY n), '') NOT IN ('su', 'ua', 'au') AND lead(n) OVER (PARTITION BY conv_id ORDER BY n) IS NOT NULL AS bad FROM placed),
-- Cheapest ways to stand at nothing, system, user, assistant: cost and edits, first without inserted turns, then with.
ways AS (
  SELECT conv_id, 0::BIGINT AS n, [{{'c': 0::BIGINT, 'e': ''}}, {{'c': 1000000000000::BIGINT, 'e': ''}}, {{'c': 1000000000000::BIGINT, 'e': ''}}, {{'c': 1000000000000::BIGINT, 'e': ''}}] AS w FROM (SELECT DISTINCT conv_id FROM rows_)
  UNION ALL
  SELECT conv_id, n, [
    {{'c': s[1].c + 2, 'e': s[1].e || 'D'}},
    list_min([{{'c': s[2].c + 2, 'e': s[2].e || 'D'}}, CASE WHEN fault IN (0, 3) AND i = 's' THEN {{'c': s[1].c + late, 'e': s[1].e || 'K'}} ELSE never END]),
    list_min([{{'c': t[3].c + 2, 'e': t[3].e || 'D'}}] || CASE WHEN fault IN (0, 3) THEN list_transform([t[1], t[2], t[4]], lambda x: {{'c': x.c + late + CASE WHEN i = 'u' THEN 0 ELSE 1 END, 'e': x.e || CASE WHEN i = 'u' THEN 'K' ELSE 'R' END}}) ELSE [never] END),
    list_min([{{'c': t[4].c + 2, 'e': t[4].e || 'D'}}] || CASE WHEN fault IN (0, 3) THEN [{{'c': t[3].c + late + CASE WHEN i = 'a' THEN 0 ELSE 1 END, 'e': t[3].e || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END}}] ELSE [never] END)]
  FROM (SELECT *, [s[1], s[2], list_min([s[3], {inserted('s[1]')}, {inserted('s[2]')}, {inserted('s[4]')}]), list_min([s[4], {inserted('s[3]')}, {inserted('s[1]', 2)}, {inserted('s[2]', 2)}])] AS t
    FROM (SELECT r.conv_id, r.n, r.i, r.fault, CASE WHEN r.fault = 3 THEN 5 ELSE 0 END AS late, w.w AS s, {{'c': 1000000000000::BIGINT, 'e': ''}} AS never FROM ways w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1))),
done AS (SELECT conv_id, list_min([w[1], w[4], {inserted('w[3]')}, {inserted('w[2]', 2)}]) AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS last FROM ways) WHERE last = 1),
letters AS (SELECT conv_id, j, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS n, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS m
  FROM (SELECT conv_id, j, best.e[j] AS e FROM (SELECT conv_id, best, unnest(range(1, len(best.e) + 1)) AS j FROM done))),
named AS (SELECT l.conv_id, l.j, l.e, l.m, r.role, r.text, max(CASE WHEN l.e = 'K' AND r.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS sys
  FROM letters l LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.n = l.n WHERE l.e <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role ELSE CASE WHEN (m - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS text FROM named GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (bad) AS illegal FROM rows_ GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op12_turns", sql=_sql())
def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    told = digests(repair(damaged(rows)))
    every = rows.select("conv_id", conversation().alias("conv")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(told, "conv", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
