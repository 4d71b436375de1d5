"""Price hygiene: jumps no action explains, bad prints, price-only splits, and the composed panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions.frames import beside, lookback, median_of, ratio
from tapeloom.operators import actions as act
from tapeloom.operators import identity as ident
from tapeloom.operators.calendars import series_filter
from tapeloom.session import settle
from tapeloom.sources.tables import with_sessions

JUMP_DOWN, JUMP_UP = -0.42, 0.90
# Share ratios of common splits and bonuses.
SIMPLE_RATIOS = {"1/10": 0.1, "1/5": 0.2, "1/4": 0.25, "1/3": 1 / 3, "2/5": 0.4, "1/2": 0.5, "3/5": 0.6,
                 "2/1": 2.0, "5/1": 5.0, "10/1": 10.0}


def with_jumps(panel: DataFrame, key: str = "symbol", down: float = JUMP_DOWN, up: float = JUMP_UP) -> DataFrame:
    """Session-exact return and whether it lies beyond the jump limits."""
    ret = ratio(F.col("close"), lookback("close", 1, key)) - 1
    return panel.withColumn("_ret", ret).withColumn("_hit", F.coalesce((F.col("_ret") < down) | (F.col("_ret") > up), F.lit(False)))


def quarantine_jumps(panel: DataFrame, key: str = "symbol", down: float = JUMP_DOWN, up: float = JUMP_UP) -> DataFrame:
    """Blank open and close strictly before the last unexplained jump of each series."""
    cut = F.max(F.when(F.col("_hit"), F.col("session_no"))).over(Window.partitionBy(key))
    rows = with_jumps(panel, key, down, up).withColumn("_cut", cut)
    keep = F.col("_cut").isNull() | (F.col("session_no") >= F.col("_cut"))
    return rows.withColumns({c: F.when(keep, F.col(c)) for c in ("open", "close")}).drop("_ret", "_hit", "_cut")


def jump_report(panel: DataFrame, key: str = "symbol", down: float = JUMP_DOWN, up: float = JUMP_UP) -> DataFrame:
    hits = with_jumps(panel, key, down, up).filter("_hit")
    return hits.groupBy(key).agg(F.max("date").alias("last_jump"), F.count(F.lit(1)).alias("jumps"),
                                 F.max_by("_ret", "session_no").alias("last_return"))


def bad_prints(bars: DataFrame, move: float = 0.15, reversion: float = 0.60) -> DataFrame:
    """Flag bars whose move is undone by the next printed bar."""
    w = Window.partitionBy("symbol").orderBy("date")
    r = ratio(F.col("close"), F.lag("close").over(w)) - 1
    step = bars.withColumn("_r", r)
    nxt = F.lead("_r").over(w)
    bad = (F.abs("_r") > move) & (F.col("_r") * nxt < 0) & (F.abs(nxt) > reversion * F.abs("_r"))
    return step.withColumn("bad", F.coalesce(bad, F.lit(False))).drop("_r")


def mask_bad_prints(bars: DataFrame, move: float = 0.15, reversion: float = 0.60, most: int = 3) -> DataFrame:
    """Drop series with more than ``most`` bad prints; blank the bad bars of the others."""
    n = F.count_if("bad").over(Window.partitionBy("symbol"))
    kept = bad_prints(bars, move, reversion).withColumn("_n", n).filter(F.col("_n") <= most)
    return kept.withColumns({c: F.when(~F.col("bad"), F.col(c)) for c in ("open", "high", "low", "close", "volume")}).drop("_n")


def split_detect(bars: DataFrame, floor: float = 0.35, near: float = 0.05, open_near: float = 0.15) -> DataFrame:
    """Price-only split candidates: a jump of at least ``floor`` close to a simple ratio, already opened in the
    new scale, that neither undoes the bar before nor is undone by the next one. Textbook form; the depth floor is the
    documented limit."""
    w = Window.partitionBy("symbol").orderBy("date")
    prev, nxt = F.lag("close").over(w), F.lead("close").over(w)
    step = bars.withColumns({"_obs": ratio(F.col("close"), prev), "_open": ratio(F.col("open"), prev), "_stay": ratio(nxt, F.col("close"))})
    step = step.withColumn("_before", F.lag("_obs").over(w))
    table = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(k).alias("label")) for k, v in SIMPLE_RATIOS.items()])
    gaps = F.transform(table, lambda t: F.struct((F.abs(F.col("_obs") / t["value"] - 1)).alias("gap"),
                                                 t["value"].alias("value"), t["label"].alias("label")))
    best = step.withColumn("_best", F.array_min(gaps))
    ok = ((F.abs(F.col("_obs") - 1) >= floor) & (F.col("_best.gap") <= near)
          & (F.abs(F.col("_open") / F.col("_best.value") - 1) <= open_near) & (F.abs(F.col("_stay") - 1) < floor)
          & F.coalesce(F.abs(F.col("_before") - 1) < floor, F.lit(True)))
    return best.filter(ok).select("symbol", "date", F.col("_obs").alias("observed"), F.col("_best.label").alias("nearest"))


def panel_describe(panel: DataFrame) -> DataFrame:
    """Span and breadth of a panel; the median is over sessions, so its state is bounded by the calendar."""
    names = panel.agg(F.countDistinct("symbol").alias("names"))
    per = panel.groupBy("date").agg(F.count("close").alias("n"))
    return beside(per.agg(F.count(F.lit(1)).alias("sessions"), F.min("date").alias("first"), F.max("date").alias("last"),
                   F.min("n").alias("least"), median_of("n").alias("middle"), F.max("n").alias("most"),
                   F.min_by("n", "date").alias("at_start"), F.max_by("n", "date").alias("at_end")), names)


@dataclass(frozen=True)
class BuiltPanel:
    panel: DataFrame
    entities: ident.Entities
    checked: DataFrame


def build_panel(rows: DataFrame, actions: DataFrame, series: tuple[str, ...] = ("EQ",)) -> BuiltPanel:
    """Archive rows to the adjusted, quarantined long panel keyed by entity.

    Prices are adjusted, volume and turnover are left as traded (a split does not change turnover). The listed rows
    and the daily bars are read several times, so both are settled.
    """
    listed = settle(series_filter(rows, series))
    ents = ident.resolve_entities(listed)
    mapped = ident.entity_map_join(listed, ents)
    daily = settle(ident.entity_day_collapse(mapped, ["close", "open", "volume", "turnover"], ["isin"]))
    found = ident.entity_fallback_lookup(actions, ents).filter(F.col("entity").isNotNull())
    checked = act.confirm_actions(found, daily, "entity")
    confirmed = checked.filter(F.col("status") == "confirmed")
    adjusted = act.back_adjust(daily, confirmed, key="entity").drop("adjustment")
    return BuiltPanel(quarantine_jumps(with_sessions(adjusted), "entity"), ents, checked)
