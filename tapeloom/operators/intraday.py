"""Intraday features and entry rules as columns over all symbols and sessions.

Windows partition by (symbol, trade_date): the bars of one session, at most one per bar interval, whatever the
number of raw ticks behind them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.functions.frames import finite, median_of, ratio
from tapeloom.operators.calendars import round_tick
from tapeloom.plans.ordered import last_known

LONG, SHORT = "long", "short"
MIN_STOP_FRACTION, MAX_STOP_FRACTION = 0.0025, 0.030
SIGNAL_COLUMNS = ["symbol", "trade_date", "bar_ts", "side", "entry", "stop", "target", "strategy", "confidence"]


@dataclass(frozen=True)
class SessionTimes:
    market_open: str = "09:15"
    market_close: str = "15:30"
    opening_range_end: str = "09:30"
    entry_cutoff: str = "14:45"
    square_off: str = "15:10"

    @property
    def square_off_minute(self) -> int:
        h, m = self.square_off.split(":")
        return int(h) * 60 + int(m)


def session_window(*, upto: bool = False):
    w = Window.partitionBy("symbol", "trade_date").orderBy("bar_ts")
    return w.rowsBetween(Window.unboundedPreceding, 0) if upto else w


def clock() -> Column:
    return F.date_format("bar_ts", "HH:mm")


def daily_from_bars(bars: DataFrame) -> DataFrame:
    """Daily bars of an intraday table."""
    return bars.groupBy("symbol", "trade_date").agg(
        F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar_ts").alias("close"), F.sum("volume").alias("volume"))


def asof_strictly_before(daily: DataFrame, days: DataFrame, atr_length: int = 14, volume_window: int = 100) -> DataFrame:
    """Per (symbol, day): last close, ATR and median volume of daily bars dated before the day.

    Null when fewer than ``atr_length + 2`` such bars exist. Asked days and daily bars are merged into one ordered
    stream per symbol; an asked day sorts before the bar of the same date and so cannot see it.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date")
    cols = daily.withColumns({
        "_bars": F.row_number().over(w), "median_volume": median_of(F.coalesce("volume", F.lit(0.0))).over(w.rowsBetween(-(volume_window - 1), 0))})
    cols = ind.atr_wilder(cols, atr_length, order="trade_date", name="atr_daily")
    known = cols.filter((F.col("_bars") >= atr_length + 2) & (F.col("close") > 0)).select(
        "symbol", "trade_date", F.struct(F.col("close").alias("prev_close"), "atr_daily", "median_volume").alias("_ctx"), F.lit(1).alias("_kind"))
    asked = days.select("symbol", "trade_date").distinct().withColumn("_kind", F.lit(0))
    both = asked.unionByName(known, allowMissingColumns=True)
    carried = last_known(both, ["symbol"], ["trade_date", "_kind"], {"_seen": "_ctx"}, strictly=True)
    return carried.filter("_kind = 0").select("symbol", "trade_date", "_seen.prev_close", "_seen.atr_daily", "_seen.median_volume")


def asof_last_known_mark(bars: DataFrame) -> DataFrame:
    """Mark of every symbol at every bar time of its session from its first bar on; its latest earlier bar if it did
    not print. A session's timeline is one small array, exploded per symbol."""
    timeline = bars.groupBy("trade_date").agg(F.array_sort(F.collect_set("bar_ts")).alias("_times"))
    started = bars.groupBy("symbol", "trade_date").agg(F.min("bar_ts").alias("_first"))
    grid = started.join(timeline, "trade_date").select("symbol", "trade_date", "_first", F.explode("_times").alias("bar_ts"))
    marks = (grid.filter(F.col("bar_ts") >= F.col("_first"))
             .join(bars.select("symbol", "trade_date", "bar_ts", "close"), ["symbol", "trade_date", "bar_ts"], "left"))
    return last_known(marks.drop("_first"), ["symbol", "trade_date"], ["bar_ts"], {"mark": "close"})


def session_vwap() -> Column:
    """Running volume-weighted typical price; mean typical price while nothing has traded."""
    typical, vol, w = (F.col("high") + F.col("low") + F.col("close")) / 3, F.coalesce("volume", F.lit(0.0)), session_window(upto=True)
    total = F.sum(vol).over(w)
    return F.when(total > 0, F.sum(typical * vol).over(w) / total).otherwise(F.avg(typical).over(w))


def with_opening_range(bars: DataFrame, end: str) -> DataFrame:
    """High and low of the session's bars up to ``end``; only read after that time."""
    whole = Window.partitionBy("symbol", "trade_date")
    early = clock() <= end
    return bars.withColumns({"or_high": F.max(F.when(early, F.col("high"))).over(whole),
                             "or_low": F.min(F.when(early, F.col("low"))).over(whole)})


def with_intraday_atr(bars: DataFrame, length: int = 14) -> DataFrame:
    """Wilder ATR once the session has ``length`` bars, before that the mean true range; null for one bar.

    The recursion is folded over the session's true ranges inside the JVM.
    """
    tr = ind.true_range("symbol", "trade_date", order="bar_ts")
    w = session_window(upto=True)
    step = bars.withColumn("_tr", tr).withColumns({"_seen": F.collect_list("_tr").over(w), "_n": F.row_number().over(session_window()),
                                                   "_mean": F.avg("_tr").over(w)})
    fold = F.aggregate(F.slice("_seen", 2, F.size("_seen")), F.element_at("_seen", 1), lambda a, x: a + (x - a) / length)
    wilder = F.when((F.col("_n") >= length) & (F.size("_seen") > 0), fold)
    value = F.coalesce(F.when(wilder > 0, wilder), F.when((F.col("_n") >= 2) & (F.col("_mean") > 0), F.col("_mean")))
    return step.withColumn("atr", value).drop("_tr", "_seen", "_n", "_mean")


def relative_volume(look: int = 20) -> Column:
    vol = F.coalesce("volume", F.lit(0.0))
    base = median_of(vol).over(session_window().rowsBetween(-look, -1))
    return F.when((F.row_number().over(session_window()) >= 3) & (base > 0), vol / base)


def range_expansion(look: int = 20) -> Column:
    rng = F.col("high") - F.col("low")
    base = median_of(rng).over(session_window().rowsBetween(-look, -1))
    return F.when(base > 0, rng / base)


def with_features(bars: DataFrame, times: SessionTimes) -> DataFrame:
    """All columns the rules read; every window has the same partitioning and order, so one shuffle serves them."""
    w, run = session_window(), session_window(upto=True)
    f = with_intraday_atr(with_opening_range(bars, times.opening_range_end)).withColumns({
        "n": F.row_number().over(w), "vwap": session_vwap(), "rel_volume": relative_volume(), "range_ratio": range_expansion(),
        "session_high": F.max("high").over(run), "session_low": F.min("low").over(run),
        "leg_low": F.min("low").over(w.rowsBetween(-3, 0)), "leg_high": F.max("high").over(w.rowsBetween(-3, 0)),
        "first_open": F.first("open").over(run), "first_high": F.first("high").over(run), "first_low": F.first("low").over(run),
        "_closes": F.collect_list("close").over(run)})
    above = F.size(F.filter("_closes", lambda x: x > F.col("vwap"))) / F.size("_closes")
    return f.withColumn("side_fraction", above).drop("_closes")


def clamp_stop(entry: Column, stop: Column, side: str) -> Column:
    """Push a stop inside the noise out to the minimum distance."""
    far = ratio(F.abs(entry - stop), entry) >= MIN_STOP_FRACTION
    edge = entry - entry * MIN_STOP_FRACTION if side == LONG else entry + entry * MIN_STOP_FRACTION
    return F.when(far, stop).otherwise(edge)


def stop_is_sane(entry: Column, stop: Column, most: float = MAX_STOP_FRACTION) -> Column:
    return ratio(F.abs(entry - stop), entry).between(MIN_STOP_FRACTION, most)


def signal_validity(side: Column | None = None, entry: Column | None = None, stop: Column | None = None,
                    target: Column | None = None) -> Column:
    """Finite positive prices in the order the side demands; the columns default to those of a signal row."""
    side, entry, stop, target = (F.col(n) if c is None else c for n, c in
                                 (("side", side), ("entry", entry), ("stop", stop), ("target", target)))
    ok = F.lit(True)
    for c in (entry, stop, target):
        ok = ok & finite(c) & (c > 0)
    up = (stop < entry) & (entry < target)
    down = (target < entry) & (entry < stop)
    return F.coalesce(ok & F.when(side == LONG, up).when(side == SHORT, down).otherwise(False), F.lit(False))


def reward_risk() -> Column:
    return F.abs(F.col("target") - F.col("entry")) / F.nullif(F.abs(F.col("entry") - F.col("stop")), F.lit(0.0))


def split_valid(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) signals."""
    tagged = signals.withColumn("_ok", signal_validity())
    return tagged.filter("_ok").drop("_ok"), tagged.filter("NOT _ok").drop("_ok")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


@dataclass(frozen=True)
class Setup:
    """One side of a rule: when it holds, its stop from the entry, its target from entry and stop, its confidence.

    Prices are put on the tick grid by the registry; ``beyond`` asks that the target lies past the entry.
    """

    side: str
    cond: Column
    stop: Callable[[Column], Column]
    target: Callable[[Column, Column], Column]
    confidence: Column
    most: float = MAX_STOP_FRACTION
    beyond: bool = False

    def holds(self, entry: Column, stop: Column, target: Column) -> Column:
        ok = self.cond & (F.col("allows_long") if self.side == LONG else F.col("allows_short")) & stop_is_sane(entry, stop, self.most)
        if self.beyond:
            ok = ok & ((target > entry) if self.side == LONG else (target < entry))
        return F.coalesce(ok & signal_validity(F.lit(self.side), entry, stop, target), F.lit(False))


@dataclass(frozen=True)
class Rule:
    """An entry rule, the families it is valid in and the bars it needs first."""

    name: str
    setups: Callable[[], list[Setup]]
    families: tuple[str, ...] = ("trend", "range", "volatile")
    warmup_bars: int = 3

    def ready(self) -> Column:
        return F.col("family").isin(list(self.families)) & (F.col("n") >= self.warmup_bars)

    def generate(self, features: DataFrame) -> DataFrame:
        """Signals of this rule alone; use with ``features.transform(rule.generate)``."""
        return RuleRegistry({self.name: self}).run(features).drop("rule_no")


@dataclass
class RuleRegistry:
    """Named rules, filtered by regime family; registering a name twice is an error."""

    rules: dict[str, Rule] = field(default_factory=dict)

    def register(self, rule: Rule) -> Rule:
        if rule.name in self.rules:
            raise ValueError(f"rule {rule.name} is already registered")
        self.rules[rule.name] = rule
        return rule

    def for_family(self, family: str) -> list[Rule]:
        return [r for r in self.rules.values() if family in r.families]

    def run(self, features: DataFrame) -> DataFrame:
        """Signals of all rules in one pass over the features; ``rule_no`` is the registration order.

        Entry, stops and targets are columns of their own stages, so no price expression is evaluated twice.
        """
        setups = [(no, rule, s) for no, rule in enumerate(self.rules.values()) for s in rule.setups()]
        e = F.col("_entry")
        rows = features.withColumn("_entry", round_tick(F.col("close")))
        rows = rows.withColumns({f"_stop{i}": round_tick(clamp_stop(e, s.stop(e), s.side)) for i, (_, _, s) in enumerate(setups)})
        rows = rows.withColumns({f"_goal{i}": round_tick(s.target(e, F.col(f"_stop{i}"))) for i, (_, _, s) in enumerate(setups)})
        found = []
        for i, (no, rule, s) in enumerate(setups):
            stop, goal = F.col(f"_stop{i}"), F.col(f"_goal{i}")
            signal = F.struct(F.lit(s.side).alias("side"), e.alias("entry"), stop.alias("stop"), goal.alias("target"),
                              F.lit(rule.name).alias("strategy"), s.confidence.alias("confidence"), F.lit(no).alias("rule_no"))
            found.append(F.when(rule.ready() & s.holds(e, stop, goal), signal))
        out = rows.select("symbol", "trade_date", "bar_ts", F.explode(F.array_compact(F.array(*found))).alias("x"))
        return out.select("symbol", "trade_date", "bar_ts", "x.*")


def _both(most: float, long: dict, short: dict, beyond: bool = False) -> list[Setup]:
    return [Setup(LONG, most=most, beyond=beyond, **long), Setup(SHORT, most=most, beyond=beyond, **short)]


def _r_multiple(r: float, side: str):
    return (lambda e, s: e + r * (e - s)) if side == LONG else (lambda e, s: e - r * (s - e))


def opening_range_rule(times: SessionTimes, most: float = MAX_STOP_FRACTION, min_rel_volume: float = 1.3, target_r: float = 2.0,
                       max_gap: float = 1.5, buffer: float = 0.10) -> Rule:
    """Close beyond the completed opening range by a buffer on strong volume, unless the session gapped far."""
    name = "OpeningRangeBreakout"

    def setups() -> list[Setup]:
        far = F.coalesce((F.col("atr_daily") > 0) & (F.abs(F.col("first_open") - F.col("prev_close")) > max_gap * F.col("atr_daily")), F.lit(False))
        base = ((F.col("or_high") > F.col("or_low")) & (clock() > times.opening_range_end) & (F.col("atr") > 0) & ~far
                & (F.col("rel_volume") >= min_rel_volume))
        pad = buffer * F.col("atr")

        def conf(side: int) -> Column:
            c = F.least(0.35 + 0.15 * (F.col("rel_volume") - min_rel_volume), F.lit(0.75))
            return clip(c + F.when(F.col("direction") == side, 0.15).when(F.col("direction") == -side, -0.10).otherwise(0.0), 0.05, 0.95)
        return _both(most,
                     {"cond": base & (F.col("close") > F.col("or_high") + pad), "stop": lambda e: F.least("or_low", "session_low"),
                      "target": _r_multiple(target_r, LONG), "confidence": conf(1)},
                     {"cond": base & (F.col("close") < F.col("or_low") - pad), "stop": lambda e: F.greatest("or_high", "session_high"),
                      "target": _r_multiple(target_r, SHORT), "confidence": conf(-1)})
    return Rule(name, setups, ("trend",), 4)


def vwap_pullback_rule(most: float = MAX_STOP_FRACTION, min_side: float = 0.65, touch: float = 0.5, stop_atr: float = 0.8,
                       target_r: float = 2.0) -> Rule:
    """A one-sided session returns to its average price and the bar resumes."""
    name = "VWAPPullback"

    def setups() -> list[Setup]:
        dist = F.abs(F.col("close") - F.col("vwap")) / F.col("atr")
        up, down = F.col("side_fraction"), 1.0 - F.col("side_fraction")
        near = (F.col("atr") > 0) & (dist <= touch)

        def conf(frac: Column) -> Column:
            return clip(0.25 + 0.55 * (frac - min_side) / max(1 - min_side, 1e-9) + 0.15 * (1.0 - F.least(dist / max(touch, 1e-9), F.lit(1.0))), 0.05, 0.90)
        return _both(most,
                     {"cond": near & (up >= min_side) & (F.col("close") > F.col("open")), "stop": lambda e: F.least(F.col("leg_low"), e - stop_atr * F.col("atr")),
                      "target": _r_multiple(target_r, LONG), "confidence": conf(up)},
                     {"cond": near & (down >= min_side) & (F.col("close") < F.col("open")), "stop": lambda e: F.greatest(F.col("leg_high"), e + stop_atr * F.col("atr")),
                      "target": _r_multiple(target_r, SHORT), "confidence": conf(down)})
    return Rule(name, setups, ("trend",), 8)


def momentum_burst_rule(most: float = MAX_STOP_FRACTION, range_mult: float = 1.8, volume_mult: float = 2.0, stop_atr: float = 1.0,
                        target_r: float = 2.0, tolerance: float = 0.15) -> Rule:
    """A bar of unusual range and volume closing near the session extreme."""
    name = "MomentumBurst"

    def setups() -> list[Setup]:
        base = ((F.col("atr") > 0) & (F.col("high") > F.col("low")) & (F.col("range_ratio") >= range_mult) & (F.col("rel_volume") >= volume_mult))
        span = F.greatest(F.col("session_high") - F.col("session_low"), F.lit(1e-9))
        conf = 0.30 + 0.10 * (F.col("range_ratio") - range_mult) + 0.08 * (F.col("rel_volume") - volume_mult)
        conf = clip(conf - F.when(F.col("family") == "volatile", 0.15).otherwise(0.0), 0.05, 0.90)
        return _both(most,
                     {"cond": base & (F.col("close") > F.col("open")) & ((F.col("session_high") - F.col("close")) / span <= tolerance),
                      "stop": lambda e: F.least(F.col("low"), e - stop_atr * F.col("atr")), "target": _r_multiple(target_r, LONG), "confidence": conf},
                     {"cond": base & (F.col("close") < F.col("open")) & ((F.col("close") - F.col("session_low")) / span <= tolerance),
                      "stop": lambda e: F.greatest(F.col("high"), e + stop_atr * F.col("atr")), "target": _r_multiple(target_r, SHORT), "confidence": conf})
    return Rule(name, setups, ("trend", "volatile"), 6)


def vwap_reversion_rule(times: SessionTimes, most: float = MAX_STOP_FRACTION, entry_atr: float = 2.0, stop_atr: float = 1.2,
                        min_reject: float = 0.30, margin_minutes: int = 45) -> Rule:
    """A stretch away from the average price that the bar rejects; the average price is the target."""
    name = "VWAPReversion"

    def setups() -> list[Setup]:
        minute = F.hour("bar_ts") * 60 + F.minute("bar_ts")
        rng, ext = F.col("high") - F.col("low"), (F.col("close") - F.col("vwap")) / F.col("atr")
        base = (minute <= times.square_off_minute - margin_minutes) & (F.col("atr") > 0) & (rng > 0)
        low_rej, high_rej = (F.col("close") - F.col("low")) / rng, (F.col("high") - F.col("close")) / rng

        def conf(rej: Column) -> Column:
            return clip(0.30 + 0.12 * (F.abs(ext) - entry_atr) + 0.30 * rej, 0.05, 0.90)
        goal = lambda e, s: F.col("vwap")
        return _both(most,
                     {"cond": base & (ext <= -entry_atr) & (low_rej >= min_reject), "stop": lambda e: F.least(F.col("low"), e - stop_atr * F.col("atr")),
                      "target": goal, "confidence": conf(low_rej)},
                     {"cond": base & (ext >= entry_atr) & (high_rej >= min_reject), "stop": lambda e: F.greatest(F.col("high"), e + stop_atr * F.col("atr")),
                      "target": goal, "confidence": conf(high_rej)}, beyond=True)
    return Rule(name, setups, ("range",), 6)


def gap_fade_rule(most: float = MAX_STOP_FRACTION, min_gap: float = 0.75, max_gap: float = 3.0, stop_atr: float = 0.8, min_fill: float = 0.25) -> Rule:
    """An opening gap that failed: price is back through the first bar and has retraced part of it."""
    name = "GapFade"

    def setups() -> list[Setup]:
        gap = F.col("first_open") - F.col("prev_close")
        size = F.abs(gap) / F.col("atr_daily")
        base = (F.col("atr_daily") > 0) & F.col("prev_close").isNotNull() & size.between(min_gap, max_gap) & (F.col("atr") > 0)
        down, up = (F.col("first_open") - F.col("close")) / F.abs(gap), (F.col("close") - F.col("first_open")) / F.abs(gap)

        def conf(filled: Column) -> Column:
            return clip(0.45 + 0.30 * F.least(filled, F.lit(1.0)) - 0.10 * F.greatest(size - 1.5, F.lit(0.0)), 0.05, 0.90)
        goal = lambda e, s: F.col("prev_close")
        return _both(most,
                     {"cond": base & (gap < 0) & (F.col("close") > F.col("first_high")) & (up >= min_fill),
                      "stop": lambda e: F.least(F.col("session_low"), e - stop_atr * F.col("atr")), "target": goal, "confidence": conf(up)},
                     {"cond": base & (gap > 0) & (F.col("close") < F.col("first_low")) & (down >= min_fill),
                      "stop": lambda e: F.greatest(F.col("session_high"), e + stop_atr * F.col("atr")), "target": goal, "confidence": conf(down)}, beyond=True)
    return Rule(name, setups, ("range",), 4)


def default_registry(times: SessionTimes = SessionTimes(), most: float = MAX_STOP_FRACTION) -> RuleRegistry:
    reg = RuleRegistry()
    for rule in (opening_range_rule(times, most), vwap_pullback_rule(most), momentum_burst_rule(most),
                 vwap_reversion_rule(times, most), gap_fade_rule(most)):
        reg.register(rule)
    return reg


def route_signals(signals: DataFrame, times: SessionTimes) -> DataFrame:
    """One signal per (symbol, bar): none when both sides fire, else the rules' agreement.

    Agreement: confidence 1 − Π(1 − c) capped at 0.95, tightest stop, nearest target; an invalid merge falls back to
    the most confident rule. A group holds at most one row per rule and side.
    """
    timed = signals.filter((clock() >= times.opening_range_end) & (clock() < times.entry_cutoff))
    best = F.max_by(F.struct("side", "entry", "stop", "target", "strategy", "confidence"), F.struct("confidence", -F.col("rule_no")))
    g = timed.groupBy("symbol", "trade_date", "bar_ts").agg(
        F.countDistinct("side").alias("_sides"), F.count(F.lit(1)).alias("rules"), best.alias("b"),
        F.product(1.0 - clip(F.col("confidence"), 0.0, 0.99)).alias("_miss"),
        F.max("stop").alias("_smax"), F.min("stop").alias("_smin"), F.max("target").alias("_tmax"), F.min("target").alias("_tmin"),
        F.array_join(F.array_sort(F.collect_set("strategy")), "+").alias("_names"))
    one = g.filter("_sides = 1").select("symbol", "trade_date", "bar_ts", "rules", "b", "_miss", "_names", F.col("b.side").alias("side"), F.col("b.entry").alias("entry"),
                                        F.when(F.col("b.side") == LONG, F.col("_smax")).otherwise(F.col("_smin")).alias("stop"),
                                        F.when(F.col("b.side") == LONG, F.col("_tmin")).otherwise(F.col("_tmax")).alias("target"))
    merged = one.withColumn("_merge", (F.col("rules") > 1) & signal_validity())
    return merged.select(
        "symbol", "trade_date", "bar_ts", "side", "entry",
        F.when(F.col("_merge"), F.col("stop")).otherwise(F.col("b.stop")).alias("stop"),
        F.when(F.col("_merge"), F.col("target")).otherwise(F.col("b.target")).alias("target"),
        F.when(F.col("_merge"), F.col("_names")).otherwise(F.col("b.strategy")).alias("strategy"),
        F.when(F.col("_merge"), F.least(1.0 - F.col("_miss"), F.lit(0.95))).otherwise(F.col("b.confidence")).alias("confidence"), "rules")


def signals_latest_session(routed: DataFrame, bars: DataFrame) -> DataFrame:
    last = bars.groupBy("symbol").agg(F.max("trade_date").alias("trade_date"))
    return routed.join(last, ["symbol", "trade_date"], "left_semi")
