"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = ["rank_top_n", "session_index", "archive_tidy", "resolve_entities", "confirm_actions", "quarantine_jumps", "atr_wilder", "compute_factors", "eligibility",
         "clenow_exit_reason", "target_holdings", "exit_mix", "leg_stats", "regime_table", "asof_strictly_before", "route_signals", "session_limit_audit",
         "open_exposure", "log_cause_groups", "findings_report", "build_features", "stream_confirmed_bars", "random_null", "percentile_of", "evaluator_hook", "fit_predict", "scan_json_store",
         "write_panel", "write_reports", "breadth", "symbol_eras", "select_universe_by_regime", "repeat_failures", "bucketed_panel", "upsert_by_range",
         "compared_by_digests", "route_signals_by_regime", "first_touch_by_blocks", "excursion_by_blocks", "stream_record_upsert"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    assert compare.rows_of(df.columns, df.collect()) == compare.rows_of([d[0] for d in cur.description], cur.fetchall())


def test_flagship_runs(spark):
    assert entry.entry(spark).columns == ["date", "symbol", "score", "rank"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 180
