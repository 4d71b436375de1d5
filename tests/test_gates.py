"""Values that must never pass a gate, causes read whole, bounds taken from the request, and plans."""

import datetime as dt
import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.frames import cleaned
from tapeloom.operators import actions, audits, identity
from tapeloom.operators import statistics as st
from tapeloom.operators import xsection as xs
from tapeloom.operators.features import synthetic_panel
from tapeloom.plans import ordered
from tapeloom.sources import archive
from tapeloom.streaming.sinks import SignalSink

D = dt.date(2020, 1, 1)


def test_nan_and_infinite_prices_are_not_tidy(frame):
    rows = [(D, "INE000000001", "A", "EQ", o, "1", "1", c, "1", "1", "1") for o, c in (("1", "NaN"), ("1", "Infinity"), ("NaN", "2"), ("x", "3"), ("1", "-1"))]
    got = archive.archive_tidy(frame(rows, "date date, isin string, symbol string, series string, open string, high string, low string, close string, prev_close string, volume string, turnover string"))
    assert sorted((r["close"], r["open"]) for r in got.collect()) == [(2.0, None), (3.0, None)]


def test_cleaned_nulls_what_is_no_number(frame):
    got = cleaned(frame([(math.nan, 1), (math.inf, 2), (-math.inf, 3), (1.5, 4), (None, 5)], "x double, i int")).orderBy("i").collect()
    assert [r["x"] for r in got] == [None, None, None, 1.5, None]


def test_scores_that_are_no_numbers_never_rank(frame):
    rows = [(D, "A", math.nan, True), (D, "B", math.inf, True), (D, "C", 1.0, True), (D, "E", 2.0, True), (D, "F", None, True), (D, "G", 9.0, False)]
    got = xs.rank_top_n(frame(rows, "date date, symbol string, score double, eligible boolean"), 5).orderBy("rank").collect()
    assert [r["symbol"] for r in got] == ["E", "C"]


def test_nan_close_is_not_eligible(spark):
    panel = synthetic_panel(spark, 3, 60).withColumn("close", F.when(F.col("session_no") == 60, F.lit(math.nan)).otherwise(F.col("close")))
    got = xs.eligibility(panel, xs.ScreenParams(look=20, skip=2, turnover_window=10))
    assert got.filter("session_no = 60 AND eligible").count() == 0 and got.filter("session_no = 59 AND eligible").count() == 3


def test_causes_are_read_whole(frame):
    pad = "x" * 300
    lines = [f"2024-01-01 ERROR {pad} getaddrinfo failed", f"2024-01-02 ERROR {pad} DH-905", f"2024-01-03 ERROR {pad} DH-906", f"2024-01-03 INFO {pad}"]
    got = {r["bucket"]: (r["lines"], len(r["label"])) for r in audits.log_cause_groups(frame([(x,) for x in lines], "line string")).collect()}
    assert got == {"network": (1, 160), "vendor": (2, 160)}


def test_symbols_of_any_length_fail(frame):
    lines = [f"2024-01-0{d} WARNING {s} D 2024-01-08..2024-01-12" for s in ("A", "B" * 30) for d in (1, 2, 3)]
    got = {r["symbol"]: r["failures"] for r in audits.repeat_failures(frame([(x,) for x in lines], "line string")).collect()}
    assert got == {"A": 3, "B" * 30: 3}


def test_grid_ranks_as_deep_as_its_largest_cell(spark):
    scored = xs.eligibility(synthetic_panel(spark, 30, 80, seed=2), xs.ScreenParams(look=20, skip=2, turnover_window=10))
    cells = spark.range(1).select(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(10).alias("step"), F.lit(0).alias("phase")) for n in (5, 28)]))
    got = {r["n"]: r["total_pct"] for r in xs.grid_returns(scored, cells).collect()}
    wide = st.total_returns(scored, xs.targets(scored, 28, 10).withColumn("trial", F.lit(0)), 28, 10).first()["total_pct"]
    assert abs(got[28] - wide) < 1e-6


def test_strategy_and_null_share_one_engine(spark):
    scored = xs.eligibility(synthetic_panel(spark, 30, 80, seed=2), xs.ScreenParams(look=20, skip=2, turnover_window=10))
    last = xs.holdings_return_curve(scored, 5, 10, 20.0).orderBy(F.col("session_no").desc()).first()["curve"]
    assert abs(st.strategy_return(scored, 5, 10, 20.0).first()["total_pct"] - 100 * (last - 1)) < 1e-9
    drawn = st.random_targets(scored, 5, 10, 8)
    assert {r["c"] for r in drawn.groupBy("trial", "session_no").agg(F.countDistinct("symbol").alias("c")).collect()} == {5}


def test_tidy_actions_take_the_least_row(frame):
    rows = [(t, "I1", "01-Jan-2020", "Bonus 1:1", s) for t, s in (("B", "EQ"), ("A", "BE"), ("A", "EQ"))]
    got = actions.actions_tidy(frame(rows, "symbol string, isin string, ex_date string, subject string, series string")).collect()
    assert [(r["symbol"], r["series"]) for r in got] == [("A", "BE")]


def test_parsed_actions_leave_no_pattern_in_later_plans(frame):
    acts = actions.parse_action_factor(frame([("A", D, "Bonus 1:1")], "symbol string, ex_date date, subject string"))
    prices = frame([("A", dt.date(2019, 12, 31), 1, 10.0, 10.0), ("A", D, 2, 5.0, 5.0)], "symbol string, date date, session_no int, close double, open double")
    done = actions.back_adjust(prices, actions.confirm_actions(acts, prices).filter("status = 'confirmed'"))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 10
    assert [r["close"] for r in done.orderBy("date").collect()] == [5.0, 5.0]


def test_hub_symbol_is_scanned_in_ranges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "HUB").otherwise(F.concat(F.lit("S"), "id")).alias("symbol"), F.concat(F.lit("I"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("isin"),
                                    F.date_add(F.lit(D), (F.col("id") % 50).cast("int")).alias("first"), F.date_add(F.lit(D), (F.col("id") % 50).cast("int")).alias("last"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be joined again
    laid = ordered.lay_out(rows, ["symbol"], [F.col("first"), F.col("isin")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert laid.filter("symbol = 'HUB'").groupBy(ordered.PART).count().agg(F.max("count")).first()[0] < 1000
    late = rows.withColumn("last", F.when(F.col("isin") == "I000000", F.date_add("first", 10000)).otherwise(F.col("last"))).withColumn(
        "first", F.when(F.col("isin") == "I000048", F.date_add("first", 5000)).otherwise(F.col("first")))
    got = {r["isin"]: r["era"] for r in identity.symbol_eras(late).filter("symbol = 'HUB'").collect()}
    assert len(got) == 1000 and set(got.values()) == {0}


def test_signal_history_prunes_by_day(spark, tmp_path):
    schema = T.StructType([T.StructField("symbol", T.LongType()), T.StructField("trade_date", T.DateType())])
    rows = spark.createDataFrame([(1, D), (2, dt.date(2020, 1, 2))], schema)
    rows.write.partitionBy("trade_date").parquet(f"{tmp_path}/bars/batch=0")
    table = SignalSink(str(tmp_path), None, None, None).history(spark, schema).filter(F.col("trade_date").isin([D]))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "trade_date" in plan.split("PartitionFilters: [")[1].split("]")[0] and table.count() == 1
