"""Corporate-action texts, their confirmation on the tape, and back-adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.frames import ratio
from tapeloom.session import settle

# The wording of exchange announcements.
BONUS = r"(?i)bonus[^0-9]{0,8}(\d+)\s*:\s*(\d+)"
IS_SPLIT = r"(?i)split|sub-?division|\bspl"
FACE_PAIR = r"(?i)(?:rs\.?|re\.?)\s*(\d+(?:\.\d+)?)[^0-9]{0,24}?to\s*(?:rs\.?|re\.?)?\s*(\d+(?:\.\d+)?)"
FACE_BARE = r"(?i)(\d+(?:\.\d+)?)\s*(?:/-)?\s*to\s*(\d+(?:\.\d+)?)"
TOLERANCE = 0.25


def _parse(texts: DataFrame, text: str) -> DataFrame:
    t = F.col(text)

    def number(pattern: str, i: int):
        return F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))

    step = texts.withColumns({
        "_a": number(BONUS, 1), "_b": number(BONUS, 2),
        "_old": F.when(t.rlike(IS_SPLIT), F.coalesce(number(FACE_PAIR, 1), number(FACE_BARE, 1))),
        "_new": F.when(t.rlike(IS_SPLIT), F.coalesce(number(FACE_PAIR, 2), number(FACE_BARE, 2)))})
    a, b, old, new = (F.col(c).cast("double") for c in ("_a", "_b", "_old", "_new"))
    is_bonus, is_split = (a > 0) & (b > 0), (old > 0) & (new > 0) & (new < old)
    bonus, split = F.when(is_bonus, b / (a + b)), F.when(is_split, new / old)
    kind = F.concat_ws(" + ", F.when(is_bonus, F.concat(F.lit("bonus "), "_a", F.lit(":"), "_b")),
                       F.when(is_split, F.concat(F.lit("split "), "_old", F.lit("->"), "_new")))
    factor = F.when(bonus.isNotNull() | split.isNotNull(),
                    F.coalesce(bonus, F.lit(1.0)) * F.coalesce(split, F.lit(1.0)))
    return step.select(text, factor.alias("factor"), kind.alias("kind"))


def parse_action_factor(df: DataFrame, text: str = "subject") -> DataFrame:
    """Price factor and wording found in each announcement; null and blank when nothing is priceable.

    Announcements repeat their wording, so the patterns run once per distinct text; the parsed texts are settled, so
    that later plans hold no pattern and join them by their measured size.
    """
    parsed = settle(_parse(df.filter(F.col(text).isNotNull()).select(text).distinct(), text))
    return df.join(parsed, text, "left").select(*df.columns, "factor", F.coalesce("kind", F.lit("")).alias("kind"))


def actions_tidy(raw: DataFrame) -> DataFrame:
    """Parse ``dd-MMM-yyyy`` dates, drop rows without date or key, one row per (isin, date, subject): the least in its other columns."""
    day = F.try_to_timestamp("ex_date", F.lit("dd-MMM-yyyy")).cast("date")
    rows = raw.withColumn("ex_date", day).filter(F.col("ex_date").isNotNull() & F.col("isin").isNotNull())
    keys = ["isin", "ex_date", "subject"]
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def observed_ratios(prices: DataFrame, key: str) -> DataFrame:
    """close ÷ previous listed close of the key."""
    px = prices.filter(F.col("close").isNotNull()).select(key, "date", "close")
    prev = F.lag("close").over(Window.partitionBy(key).orderBy("date"))
    return px.select(key, F.col("date").alias("ex_date"), ratio(F.col("close"), prev).alias("observed"))


def action_price_join(actions: DataFrame, prices: DataFrame, key: str = "symbol") -> DataFrame:
    return actions.join(observed_ratios(prices, key), [key, "ex_date"], "left")


def confirm_actions(actions: DataFrame, prices: DataFrame, key: str = "symbol",
                    tolerance: float = TOLERANCE) -> DataFrame:
    """Priceable actions with confirmed / rejected / out_of_range."""
    m = action_price_join(actions.filter(F.col("factor").isNotNull()), prices, key)
    close_enough = F.abs(F.col("observed") - F.col("factor")) <= tolerance * F.col("factor")
    status = (F.when(F.col("observed").isNull(), "out_of_range").when(close_enough, "confirmed").otherwise("rejected"))
    return m.withColumn("status", status)


def confirmation_rate(checked: DataFrame) -> DataFrame:
    counts = checked.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "rejected", "out_of_range")])
    return counts.withColumn("rate", F.col("confirmed") / F.nullif(F.col("confirmed") + F.col("rejected"), F.lit(0)))


def back_adjust(prices: DataFrame, confirmed: DataFrame, fields: Sequence[str] = ("close", "open"),
                key: str = "symbol") -> DataFrame:
    """Multiply prices by every factor whose ex-date lies strictly after the bar.

    Factors are first multiplied per (key, ex-date), so a key has at most one action row per day and the
    descending running product stays within the calendar's size.
    """
    steps = confirmed.groupBy(key, F.col("ex_date").alias("date")).agg(F.product("factor").alias("_f"))
    bars = prices.withColumns({"_f": F.lit(1.0), "_is_action": F.lit(0)})
    both = bars.unionByName(steps.withColumn("_is_action", F.lit(1)), allowMissingColumns=True)
    later = (Window.partitionBy(key).orderBy(F.col("date").desc(), "_is_action")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = both.withColumn("adjustment", F.product("_f").over(later)).filter("_is_action = 0")
    return run.withColumns({f: F.col(f) * F.col("adjustment") for f in fields}).drop("_f", "_is_action")
