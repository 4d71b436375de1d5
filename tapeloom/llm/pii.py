"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, schemes (``://``), cue words of identifiers, and the
short digit patterns without which no address or account number can be (two digits, also around a dot, a blank or a
hyphen, and plus before a digit). From an anchor a local parser expands to the left and the right as far as its kind
goes and validates what it found; anchors inside a stretch that is already expanded cost nothing more. A text without
anchors is read once and never parsed.

Kinds, in their order: email, ip, card (Luhn), phone, and those that the cues add: login (user and password in a url),
ssn, iban (remainder by 97) and account (number after a cue word). The first four equal leftmost non-overlapping matches
of ``BASE``; a match that fails its check is dropped and its characters are not tried again. The added ones are matches
of ``ADDED``, of which the last group is the span.

Cases: a null text counts as empty and has no spans; repeated rows give equal rows; a text of any length is searched
whole, in time that grows with its length; offsets are code points; an empty table gives an empty result; other columns
are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import chunks, documents, short_batches, texts_of
from tapeloom.llm.suite import query

#: The patterns of the four base kinds.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cue words, each also found capitalised and in capitals; none begins another.
CUES = {"ssn": ("ssn", "social security"), "iban": ("iban",), "account": ("account", "acct", "konto", "compte", "cuenta", "passport")}
AFTER = r"(?: (?:number|no|nr)\b\.?)?[\x20:#=]*"
NUMBERS = {"ssn": r"([0-9-]+)", "iban": r"([A-Z][A-Z][0-9][0-9][A-Z0-9]*(?: [A-Z0-9]*[0-9][A-Z0-9]*)*)", "account": r"([0-9]+(?:-[0-9]+)*)"}
LOGIN = r"[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20/?#@:]+:[^\x00-\x20/?#@]+@[A-Za-z0-9.-]+"


def forms(kind: str) -> list[str]:
    """The spellings of a kind's cues that are looked for."""
    return [f for c in CUES[kind] for f in (c, c.capitalize(), c.upper())]


ADDED = {"login": f"({LOGIN})", **{k: rf"\b(?:{'|'.join(forms(k))})\b{AFTER}{NUMBERS[k]}" for k in CUES}}
KINDS = (*BASE, *ADDED)

_EMAIL_LEFT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = frozenset("0123456789")
_WORD = _LETTERS | _DIGITS | {"_"}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_DIALLED = re.compile(BASE["phone"])
_LOGIN_REST = re.compile(LOGIN.partition("*")[2])
_NUMBER = {k: re.compile(rf"\b{AFTER}{p}", re.ASCII) for k, p in NUMBERS.items()}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in text.split(".")))


def is_card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 10 <= sum(c in _DIGITS for c in text) <= 15


def is_ssn(text: str) -> bool:
    """Three, two and four digits, none of them a group that is never given out."""
    return re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", text) is not None and text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"


def is_iban(text: str) -> bool:
    """15 to 34 characters that leave 1 by 97, the first four moved to the end and letters read as 10 to 35."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def is_account(text: str) -> bool:
    return 6 <= sum(c in _DIGITS for c in text) <= 17


VALID: dict[str, Callable[[str], bool]] = {"email": lambda t: True, "ip": is_ip, "card": is_card, "phone": is_phone, "login": lambda t: True, "ssn": is_ssn,
                                           "iban": is_iban, "account": is_account}


class Finder:
    """The automaton over all anchors, and the parsers behind them."""

    def __init__(self) -> None:
        digits = "0123456789"
        anchors: dict[str, set[str]] = {"@": {"email"}, "://": {"login"}}
        for a in digits:
            anchors["+" + a] = {"phone"}
            for b in digits:
                anchors[f"{a}.{b}"] = {"ip"}
                for between in ("", " ", "-"):
                    anchors[a + between + b] = {"card"}
        for kind in CUES:
            for form in forms(kind):
                anchors[form] = {kind}
        self.automaton = ahocorasick.Automaton()
        for word, kinds in anchors.items():
            self.automaton.add_word(word, (len(word), *kinds))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, kind number, end) of every span, in order."""
        out: list[tuple[int, int, int]] = []
        done = dict.fromkeys(KINDS, 0)  # where each kind goes on: behind the last stretch that it has expanded
        for last, (size, kind) in self.automaton.iter(text):
            at = last + 1 - size
            if at < done[kind] and kind != "email":
                continue
            for start, end in getattr(self, "_" + kind)(text, at, last + 1, done):
                if VALID[kind](text[start:end]):
                    out.append((start, KINDS.index(kind), end))
        return sorted(out)

    def _email(self, text: str, at: int, after: int, done: dict[str, int]) -> Iterator[tuple[int, int]]:
        """Left over the local part, but not into the match before; right over the labels of the domain."""
        start = at
        while start > done["email"] and text[start - 1] in _EMAIL_LEFT:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, after)):
            done["email"] = domain.end()
            yield start, domain.end()

    def _ip(self, text: str, at: int, after: int, done: dict[str, int]) -> Iterator[tuple[int, int]]:
        """The whole chain of numbers and dots around the anchor, four numbers at a time from its left end."""
        start = at
        while start > done["ip"] and (text[start - 1] in _DIGITS or (text[start - 1] == "." and start > 1 and text[start - 2] in _DIGITS and start - 1 > done["ip"])):
            start -= 1
        done["ip"] = end = _CHAIN.match(text, start).end()
        parts = text[start:end].split(".")
        for i in range(0, len(parts) - 3, 4):
            size = len(".".join(parts[i:i + 4]))
            yield start, start + size
            start += size + 1

    def _card(self, text: str, at: int, after: int, done: dict[str, int]) -> Iterator[tuple[int, int]]:
        """The whole run of digits with at most one blank or hyphen between two."""
        done["card"] = end = _RUN.match(text, at).end()  # the first anchor of a run stands at its left end
        yield at, end

    def _phone(self, text: str, at: int, after: int, done: dict[str, int]) -> Iterator[tuple[int, int]]:
        if found := _DIALLED.match(text, at):
            done["phone"] = found.end()
            yield at, found.end()

    def _login(self, text: str, at: int, after: int, done: dict[str, int]) -> Iterator[tuple[int, int]]:
        start = at
        while start > done["login"] and text[start - 1] in _SCHEME:
            start -= 1
        while start < at and text[start] not in _LETTERS:
            start += 1
        if start < at and (rest := _LOGIN_REST.match(text, at)):
            done["login"] = rest.end()
            yield start, rest.end()

    def _number(self, kind: str, text: str, at: int, after: int, done: dict[str, int]) -> Iterator[tuple[int, int]]:
        if (not at or text[at - 1] not in _WORD) and (found := _NUMBER[kind].match(text, after)):
            done[kind] = found.end()
            yield found.span(1)

    def _ssn(self, *where) -> Iterator[tuple[int, int]]:
        return self._number("ssn", *where)

    def _iban(self, *where) -> Iterator[tuple[int, int]]:
        return self._number("iban", *where)

    def _account(self, *where) -> Iterator[tuple[int, int]]:
        return self._number("account", *where)


_finder: list[Finder] = []


def finder() -> Finder:
    """The worker's finder, built once."""
    if not _finder:
        _finder.append(Finder())
    return _finder[0]


def find(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and spans, an array of (kind, start, end), of every row."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*docs.select(*keys).schema.fields, T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = finder().spans
        for batch in chunks(batches, "_text"):
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t)] for t in texts_of(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, kind)], names=schema.names)

    return short_batches(docs).select(*keys, F.col(text).alias("_text")).mapInArrow(work, schema)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span's characters replaced by ``[KIND]``; of overlapping spans the first, then the longest, counts."""
    rows = short_batches(docs).select(F.struct("*").alias("row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = finder().spans
        for batch in chunks(batches, f"row.{text}"):
            row, made = batch.column("row"), []
            for t in row.field(text).to_pylist():
                parts, at = [], 0
                for a, k, b in sorted(spans(t), key=lambda s: (s[0], -s[2])) if t else ():
                    if a >= at:
                        parts += [t[at:a], f"[{KINDS[k].upper()}]"]
                        at = b
                made.append(t if t is None else "".join([*parts, t[at:]]))
            fields = [pa.array(made, f.type) if f.name == text else row.field(f.name) for f in row.type]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type))], names=["row"])

    return rows.mapInArrow(work, rows.schema).select("row.*")


def _sql() -> str:
    """A match starts where the gaps and matches before it end; the span is the end of the match."""
    digits = "regexp_replace(s, '[^0-9]', '', 'g')"
    number = "list_sum(list_transform(range(len(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[len(d) - i] AS INT) ELSE (2 * CAST(d[len(d) - i] AS INT)) // 10 + (2 * CAST(d[len(d) - i] AS INT)) % 10 END))"
    letters = "list_aggregate(list_transform(string_split(substr(replace(s, ' ', ''), 5) || substr(s, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), 'string_agg', '')"
    valid = {
        "ip": "list_bool_and(list_transform(string_split(s, '.'), lambda p: len(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) <= 255))",
        "card": f"len(d) BETWEEN 14 AND 19 AND {number} % 10 = 0",
        "phone": "len(d) BETWEEN 10 AND 15",
        "ssn": "regexp_full_match(s, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND substr(s, 1, 3) NOT IN ('000', '666') AND s[1] <> '9' AND substr(s, 5, 2) <> '00' AND substr(s, 8) <> '0000'",
        "iban": f"len(replace(s, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split({letters}, ''), lambda c: CAST(c AS INT))), lambda a, b: (10 * a + b) % 97) = 1",
        "account": "len(d) BETWEEN 6 AND 17",
    }
    parts = []
    for at, (kind, pattern) in enumerate({**BASE, **ADDED}.items()):
        quoted = pattern.replace("'", "''")
        span = "m" if kind in BASE else f"regexp_extract(m, '{quoted}', 1)"
        parts.append(f"""
          SELECT r, {at} AS k, '{kind}' AS kind, e - len(s) AS a, e AS b FROM (
            SELECT r, e, {span} AS s, {digits.replace('(s,', f'({span},')} AS d FROM (
              SELECT r, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(list_sum(list_transform(gs[1:i], lambda x: len(x))) + list_sum(list_transform(ms[1:i], lambda x: len(x))) AS BIGINT))) AS e
              FROM (SELECT r, regexp_extract_all(text, '{quoted}') AS ms, string_split_regex(text, '{quoted}') AS gs FROM docs) WHERE len(ms) > 0))
          WHERE {valid.get(kind, 'true')}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
        WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        spans AS ({' UNION ALL '.join(parts)}),
        told AS (SELECT r, {counts}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < {len(BASE)}) AS base FROM spans GROUP BY r)
        SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN told USING (r)"""


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op13_pii", sql=_sql())
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(_count(k).alias(f"n_{k}") for k in BASE), F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
