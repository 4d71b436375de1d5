"""URL filters by association rules, in DataFrame functions and Spark's FP-growth only.

A url is a set of tokens: host labels (with their depth), the last two labels together, path words, query names. The
pages with a known label are the transactions; label 1 of the page's document (toxic, or quality 0) adds the token
``=block``. FP-growth mines the frequent sets; of the rules "these tokens => =block" those with enough support,
confidence and lift stay, unless a part of the tokens already has a rule. Tokens of the same labelled pages are one item
of a transaction, and a url has an item if it has any token of it, which says the same as all the rules over single
tokens. Urls are matched by an inverted index: a rule is filed under its rarest item, urls look it up under each of
theirs, and a hit counts if all its items are there. Urls are looked up once per distinct token set.

Fixed rules (host with all subdomains, and path prefix) go before the mined ones; the longest one that fits wins.

Cases: a null url or one without ``://`` has an empty host, path and token set and is allowed; repeated rows and
repeated labels count as they are; without labels no rules are mined; an empty table gives an empty result. Other
columns are passed over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import keep
from tapeloom.llm.suite import query

BLOCK, ALLOW = "block", "allow"
#: The token that stands for the label.
LABEL = "=block"
#: Fixed values: (verdict, host, path) rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without one."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(known, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(known, pattern, 2)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a url; numbers are left out, since they name single pages."""
    labels = F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != "")
    deep = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    site = F.when(F.size(labels) > 1, F.array(F.concat(F.lit("s:"), F.get(labels, F.lit(1)), F.lit("."), F.get(labels, F.lit(0))))).otherwise(F.array().cast("array<string>"))
    steps = F.transform(F.filter(F.split(F.lower(path), r"[/._\-]+"), lambda x: (x != "") & ~F.regexp_like(x, F.lit(r"^\p{N}+$"))), lambda x: F.concat(F.lit("p:"), x))
    asked = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(deep, site, steps, asked))))


def tokenised(pages: DataFrame) -> DataFrame:
    """page_id, host, path and tokens of every page."""
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    return cut.select("page_id", "host", "path", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))


def mined_rules(pages: DataFrame, labels: DataFrame, support: float, least: int, confidence: float, lift: float) -> tuple[DataFrame, DataFrame]:
    """The rules that stay (items, confidence, support), and the item of each token that is frequent enough for one.

    ``pages`` is tokenised. A rule needs ``support`` of the labelled pages and ``least`` of them at any size. Tokens of
    exactly the same labelled pages are one item, since a set with several of them says no more than a set with one.
    """
    bad = labels.filter("doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL)").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("_bad"))
    known = pages.filter(F.size("tokens") > 0).join(bad, "page_id").select("tokens", "_bad")
    known = keep(known.withColumn("_row", F.monotonically_increasing_id()))
    many = known.count()
    share = min(1.0, max(support, least / max(1, many)))
    # Two 64-bit hashes of the rows, summed by exclusive or, and their number stand for the set of a token's pages.
    each = known.select(F.explode("tokens").alias("token"), F.xxhash64("_row").alias("_x"), F.xxhash64(F.lit("again"), F.col("_row")).alias("_y"))
    said = each.groupBy("token").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor("_x").alias("_x"), F.bit_xor("_y").alias("_y")).filter(F.col("_n") >= F.lit(share * many))
    # At most (tokens of a page) / support tokens are left.
    items = keep(said.select("token", F.min("token").over(Window.partitionBy("_n", "_x", "_y")).alias("item")))
    baskets = (known.select("_row", "_bad", F.explode("tokens").alias("token")).join(items, "token").groupBy("_row").agg(F.collect_set("item").alias("items"), F.first("_bad").alias("_bad")))
    baskets = keep(known.select("_row").join(baskets, "_row", "left").select(
        F.concat(F.coalesce("items", F.array().cast("array<string>")), F.when(F.col("_bad"), F.array(F.lit(LABEL))).otherwise(F.array().cast("array<string>"))).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(baskets)
    found = model.associationRules.filter((F.size("consequent") == 1) & (F.get("consequent", F.lit(0)) == LABEL) & (F.col("lift") >= lift))
    rules = keep(found.select(F.array_sort("antecedent").alias("items"), "confidence", "support"))
    wider = rules.select(F.col("items").alias("_all"), F.explode("items").alias("item"))
    extra = (wider.join(filed(rules.withColumnRenamed("items", "_part"), "_part", wider.groupBy("item").count()), "item")
             .filter((F.size("_part") < F.size("_all")) & (F.size(F.array_except("_part", "_all")) == 0)).select(F.col("_all").alias("items")).distinct())
    return keep(rules.join(extra, "items", "left_anti")), items


def filed(rules: DataFrame, name: str, counts: DataFrame) -> DataFrame:
    """The rules under their rarest item, each once; ``counts``: item, count."""
    rarest = F.min(F.struct("count", "item"))
    return (rules.select(name, "confidence", F.explode(name).alias("item")).join(counts, "item").groupBy(name, "confidence").agg(rarest.alias("_r"))
            .select(name, "confidence", F.col("_r.item").alias("item")))


def blocked_sets(pages: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """The distinct token sets of ``pages`` that some rule blocks, with the best rule's confidence."""
    sets = pages.filter(F.size("tokens") > 0).select("tokens").distinct()
    known = keep(sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token").groupBy("tokens").agg(F.collect_set("item").alias("items")))
    asked = known.select("tokens", "items", F.explode("items").alias("item"))
    index = keep(filed(rules.withColumnRenamed("items", "rule"), "rule", asked.groupBy("item").count()))
    return asked.join(index, "item").filter(F.size(F.array_except("rule", "items")) == 0).groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def fixed_verdicts(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule (its host and path) and fixed (its verdict): of the rules that fit, the longest; null if none does."""
    fits = [F.when(((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path),
                   F.struct(F.lit(len(host + path)).alias("length"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")))
            for verdict, host, path in rules]
    return df.withColumn("_fit", F.array_max(F.array(*fits))).withColumns({"rule": F.col("_fit.rule"), "fixed": F.col("_fit.verdict")}).drop("_fit")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, support: float = 0.001,
                least: int = 8, confidence: float = 0.6, lift: float = 1.5) -> DataFrame:
    """page_id, host, path, rule, verdict and mined_confidence (of the best mined rule that fits, else null) of every page."""
    rows = tokenised(pages)
    hits = keep(blocked_sets(rows, *mined_rules(rows, labels, support, least, confidence, lift)))
    judged = fixed_verdicts(rows.join(hits, "tokens", "left"), rules)
    verdict = F.coalesce("fixed", F.when(F.col("confidence").isNotNull(), BLOCK).otherwise(ALLOW))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("confidence").alias("mined_confidence"))


@query("op3_urls")
def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
