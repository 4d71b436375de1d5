"""Quality rules by distribution divergence, in DataFrame functions only.

A document is reduced to two histograms: character classes (lower and upper ASCII letters, other letters, digits,
symbols, punctuation, white space, the rest) and common words (the listed words of every language, and one place for
all others). Both are compared with references by the Jensen-Shannon divergence (base 2, 0 to 1). There is a reference
per listed language: the summed histograms of all documents that pass the base rules and whose words are covered best
by that language's list. A document takes the least divergence over the languages. Each comparison applies only from a
minimum length on, since a short text has no distribution to speak of.

Cases: null counts as empty; an empty text fails the base rules (fewer than 20 words); repeated rows are judged alike;
an empty table has no references and nothing to judge. Other columns are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import SPACE, documents, keep, words
from tapeloom.llm.suite import query

#: Frequent function words of each language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "en": "the of and to in a is that for with on as are was be by this it or from at he an not".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo es como mi más".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur au pas avec il elle ce ne".split(),
}
VOCABULARY = sorted({w for listed in COMMON_WORDS.values() for w in listed})
#: Classes in the order in which they are taken out of the text; what stays is the last class.
CLASSES = {"lower": "[a-z]+", "space": SPACE + "+", "upper": "[A-Z]+", "letter": r"\p{L}+", "digit": r"\p{N}+",
           "symbol": "[#*$%&|<>]+", "mark": r"[.,;:!?'\"()\-]+"}
CLASS_NAMES = [*CLASSES, "rest"]


@dataclass(frozen=True)
class Limits:
    """Divergences above these reject; shorter texts than the guards are not compared.

    A short text diverges by chance, about as one over its length, so each limit has a slack divided by the length.
    """

    class_divergence: float = 0.075
    class_slack: float = 10.0
    word_divergence: float = 0.085
    word_slack: float = 5.0
    least_chars: int = 200
    least_words: int = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def with_class_counts(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the code points of each class, in the order of CLASS_NAMES. Every step reads only what the last one left."""
    rest = text
    for i, pattern in enumerate(CLASSES.values()):
        df = df.withColumn(f"_rest{i}", F.regexp_replace(rest, pattern, ""))
        rest = f"_rest{i}"
    sizes = [F.length(text), *[F.length(f"_rest{i}") for i in range(len(CLASSES))], F.lit(0)]
    counts = F.array(*[a - b for a, b in zip(sizes, sizes[1:])])
    return df.withColumn(name, counts).drop(*[f"_rest{i}" for i in range(len(CLASSES))])


def repeated_words(w: Column, width: int = 8) -> Column:
    """Words that lie in a window of ``width`` words found twice or more, by 64-bit hashes of the windows."""
    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.transform(F.filter(
            F.transform(s, lambda p, j: F.struct(p["i"].alias("i"), ((j > 0) & (F.get(s, j - 1)["h"] == p["h"])).alias("a"),
                                                 (F.get(s, j + 1)["h"] == p["h"]).alias("b"))),
            lambda p: p["a"] | F.coalesce(p["b"], F.lit(False))), lambda p: p["i"]))
        return let(F.array_sort(twice), lambda at: F.aggregate(
            F.transform(at, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - p, F.lit(width))).cast("long")),
            F.lit(0).cast("long"), lambda total, x: total + x))

    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda wh: F.transform(
        F.sequence(F.lit(0), F.size(wh) - width), lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(width)])))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(w) > width, some).otherwise(F.lit(0).cast("long"))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def common_counts(w: Column) -> Column:
    """(place in VOCABULARY from 1, count) of the listed words a text has, case and outer punctuation aside."""
    bare = F.transform(w, lambda x: F.lower(F.btrim(x, F.lit(".,;:!?'\"()-"))))
    listed = F.array_sort(F.filter(bare, lambda x: x.isin(VOCABULARY)))
    places = F.array(*[F.lit(v) for v in VOCABULARY])

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda p, j: F.struct(
            F.array_position(places, F.get(s, p)).cast("int").alias("place"),
            (F.coalesce(F.get(at, j + 1), F.size(s)) - p).alias("n"))))

    return let(listed, lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<struct<place:int,n:int>>")))


def measures(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` with the base measures and both histograms of every row; one pass over the texts, no shuffle."""
    given = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    given = with_class_counts(given, "_text", "classes").select(*keys, "_text", "classes", words(F.col("_text")).alias("_w"))
    out = given.select(*keys, F.size("_w").cast("long").alias("n_words"), "classes",
                       repeated_lines(F.col("_text")).alias("n_dup_lines"), repeated_words(F.col("_w")).alias("n_repeat_words"),
                       common_counts(F.col("_w")).alias("common"))
    at = {n: F.element_at("classes", i + 1).cast("long") for i, n in enumerate(CLASS_NAMES)}
    n_chars = F.aggregate("classes", F.lit(0), lambda a, x: a + x)
    out = out.withColumn("word_chars", (n_chars - at["space"]).cast("long")).withColumn("n_symbols", at["symbol"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def references(measured: DataFrame, limits: Limits) -> dict[str, tuple[list[float], list[float]]]:
    """Class and word shares of every listed language, summed over all its documents; bounded by the lists."""
    def covered(listed: list[str]) -> Column:
        places = [VOCABULARY.index(v) + 1 for v in listed]
        return F.aggregate(F.filter("common", lambda x: x["place"].isin(places)), F.lit(0), lambda a, x: a + x["n"])

    best = F.greatest(*[F.struct(covered(listed).alias("n"), F.lit(lang).alias("lang")) for lang, listed in COMMON_WORDS.items()])
    own = (measured.filter(~F.col("base_failed") & (F.col("n_words") >= limits.least_words)).select("n_words", "classes", "common", best.alias("_b"))
           .filter("_b.n > 0").select(F.col("_b.lang").alias("lang"), "n_words", "classes", "common"))
    cells = own.select("lang", F.explode(F.concat(
        F.transform("classes", lambda n, i: F.struct(F.lit("class").alias("kind"), i.cast("int").alias("place"), n.cast("long").alias("n"))),
        F.transform("common", lambda x: F.struct(F.lit("word").alias("kind"), x["place"].alias("place"), x["n"].cast("long").alias("n"))),
        F.array(F.struct(F.lit("all").alias("kind"), F.lit(0).alias("place"), F.col("n_words").alias("n"))))).alias("c"))
    sums = {(r["lang"], r["kind"], r["place"]): r["n"] for r in
            cells.groupBy("lang", "c.kind", "c.place").agg(F.sum("c.n").alias("n")).collect()}
    out = {}
    for lang in COMMON_WORDS:
        if (lang, "all", 0) not in sums:
            continue
        classes = [sums.get((lang, "class", i), 0) for i in range(len(CLASS_NAMES))]
        listed = [sums.get((lang, "word", i + 1), 0) for i in range(len(VOCABULARY))]
        total = sums[(lang, "all", 0)]
        out[lang] = ([c / max(1, sum(classes)) for c in classes], [n / total for n in listed] + [1 - sum(listed) / total])
    return out


def _term(p: Column, q: Column) -> Column:
    """Share of one place in the divergence; ``p`` is above 0."""
    half = F.when(q > 0, q / 2 * F.log2(2 * q / (p + q))).otherwise(F.lit(0.0))
    return p / 2 * F.log2(2 * p / (p + q)) + half


def divergence(shares: Column, reference: Sequence[float]) -> Column:
    """Jensen-Shannon divergence of sparse (place from 1, p > 0) shares from a reference over all places."""
    ref = F.array(*[F.lit(float(q)) for q in reference])
    seen = F.aggregate(shares, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q")), lambda a, x: F.struct(
        (a["d"] + _term(x["p"], F.element_at(ref, x["place"]))).alias("d"), (a["q"] + F.element_at(ref, x["place"])).alias("q")))
    return let(seen, lambda s: s["d"] + (F.lit(math.fsum(reference)) - s["q"]) / 2)


def judge(measured: DataFrame, refs: dict[str, tuple[list[float], list[float]]], limits: Limits) -> DataFrame:
    """Adds class_divergence, word_divergence (null below the guards or without references) and kept."""
    n_chars = F.aggregate("classes", F.lit(0), lambda a, x: a + x)
    of_class = F.filter(F.transform("classes", lambda n, i: F.struct((i + 1).cast("int").alias("place"), (n / n_chars).alias("p"))), lambda x: x["p"] > 0)
    others = F.col("n_words") - F.aggregate("common", F.lit(0), lambda a, x: a + x["n"])
    of_word = F.filter(F.concat(F.transform("common", lambda x: F.struct(x["place"].alias("place"), (x["n"] / F.col("n_words")).alias("p"))),
                                F.array(F.struct(F.lit(len(VOCABULARY) + 1).alias("place"), (others / F.col("n_words")).alias("p")))),
                       lambda x: x["p"] > 0)

    def least(shares: Column, which: int) -> Column:
        found = [divergence(shares, r[which]) for r in refs.values()]
        return F.array_min(F.array(*found)) if found else F.lit(None).cast("double")

    out = (measured.withColumn("class_divergence", F.when(n_chars >= limits.least_chars, let(of_class, lambda s: least(s, 0))))
           .withColumn("word_divergence", F.when(F.col("n_words") >= limits.least_words, let(of_word, lambda s: least(s, 1)))))
    far = (F.coalesce(F.col("class_divergence") > limits.class_divergence + limits.class_slack / n_chars, F.lit(False))
           | F.coalesce(F.col("word_divergence") > limits.word_divergence + limits.word_slack / F.col("n_words"), F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def quality(docs: DataFrame, keys: Sequence[str] = ("doc_id",), limits: Limits = Limits()) -> DataFrame:
    """``keys``, the base measures, the divergences and the verdict of every row. The measured rows are written once
    (no texts), since the references and the verdicts both read them."""
    measured = keep(measures(docs, keys))
    return judge(measured, references(measured, limits), limits)


def _oracle(limits: Limits = Limits()) -> str:
    """The same measures, references and divergences as joins over exploded words, windows and classes."""
    listed = ", ".join(f"('{lang}', '{word}', {VOCABULARY.index(word) + 1})" for lang, words_ in COMMON_WORDS.items() for word in words_)
    places = ", ".join(f"('{v}', {i + 1})" for i, v in enumerate(VOCABULARY))
    steps, rest = [], "t"
    for i, pattern in enumerate(CLASSES.values()):
        quoted = pattern.replace("\\'", "'").replace("'", "''")
        steps.append(f"c{i} AS (SELECT *, regexp_replace({rest}, '{quoted}', '', 'g') AS r{i} FROM {'w' if i == 0 else f'c{i - 1}'})")
        rest = f"r{i}"
    last = len(CLASSES) - 1
    sizes = ["length(t)", *[f"length(r{i})" for i in range(last + 1)], "0"]
    cells = " UNION ALL ".join(f"SELECT doc_id, 'class' AS kind, {i + 1} AS place, {a} - {b} AS n FROM c{last}" for i, (a, b) in enumerate(zip(sizes, sizes[1:])))
    return r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda x: x <> '') AS w FROM documents),
""" + ",\n".join(steps) + r""",
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(8) r(k) GROUP BY 1),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
base AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, length(t) AS n_chars, len(w) < 20 OR 100 * coalesce(cov.n, 0) > 30 * len(w) AS base_failed
 FROM w JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
vo(word, place) AS (VALUES @places), li(lang, word, place) AS (VALUES @listed),
tok AS (SELECT doc_id, lower(trim(x, '.,;:!?''"()-')) AS word FROM (SELECT doc_id, unnest(w) AS x FROM w)),
cm AS (SELECT doc_id, place, count(*) AS n FROM tok JOIN vo USING (word) GROUP BY ALL),
cell AS (@cells UNION ALL SELECT doc_id, 'word', place, n FROM cm
 UNION ALL SELECT doc_id, 'word', @other, n_words - coalesce((SELECT sum(n) FROM cm WHERE cm.doc_id = base.doc_id), 0) FROM base),
best AS (SELECT doc_id, max_by(lang, (n, lang)) AS lang FROM (SELECT doc_id, lang, sum(n) AS n FROM cm JOIN li USING (place) GROUP BY ALL) GROUP BY 1),
ref AS (SELECT lang, kind, place, sum(n) AS n FROM cell JOIN best USING (doc_id) JOIN base USING (doc_id) WHERE NOT base_failed AND n_words >= @words GROUP BY ALL),
share AS (SELECT lang, kind, place, n / sum(n) OVER (PARTITION BY lang, kind) AS q FROM ref),
p AS (SELECT doc_id, kind, place, n / CASE kind WHEN 'class' THEN n_chars ELSE n_words END AS p FROM cell JOIN base USING (doc_id)
 WHERE n > 0 AND CASE kind WHEN 'class' THEN n_chars >= @chars ELSE n_words >= @words END),
dv AS (SELECT doc_id, kind, l.lang, sum(p / 2 * log2(2 * p / (p + coalesce(q, 0))) + CASE WHEN q > 0 THEN q / 2 * log2(2 * q / (p + q)) ELSE 0 END) + (1 - sum(coalesce(q, 0))) / 2 AS d
 FROM p CROSS JOIN (SELECT DISTINCT lang FROM share) l LEFT JOIN share USING (lang, kind, place) GROUP BY ALL),
mn AS (SELECT doc_id, min(d) FILTER (WHERE kind = 'class') AS class_divergence, min(d) FILTER (WHERE kind = 'word') AS word_divergence FROM dv GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(class_divergence, 7) AS class_divergence, round(word_divergence, 7) AS word_divergence,
 NOT base_failed AND NOT coalesce(class_divergence > @cd + @cs / n_chars, false) AND NOT coalesce(word_divergence > @wd + @ws / n_words, false) AS kept
FROM base LEFT JOIN mn USING (doc_id)""".replace("@places", places).replace("@listed", listed).replace("@cells", cells).replace("@other", str(len(VOCABULARY) + 1)).replace(
        "@words", str(limits.least_words)).replace("@chars", str(limits.least_chars)).replace("@cd", str(limits.class_divergence)).replace(
        "@cs", str(limits.class_slack)).replace("@wd", str(limits.word_divergence)).replace("@ws", str(limits.word_slack))


@query("op2_quality", _oracle())
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_divergence", 7).alias("class_divergence"), F.round("word_divergence", 7).alias("word_divergence"))


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows that are kept, columns as they are. Rows are written once with their measures, so nothing is joined."""
    measured = keep(measures(docs.withColumn("_row", F.struct("*")), ("_row",), "text"))
    return judge(measured, references(measured, limits), limits).filter("kept").select("_row.*")
