"""Feature set and walk-forward evaluation on the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.frames import fixed
from tapeloom.operators import features as ft
from tapeloom.operators import network as nw
from tapeloom.operators.statistics import draw_number
from tapeloom.session import settle
from tapeloom.sources import tables as src
from tapeloom.suite import sqlparts as q
from tapeloom.suite.register import query

FP = ft.FeatureParams(momentum=(1, 2, 4), year=52, skip=4, vol=2, reversal=3, turnover=2, horizon=4)
FOLDS = ft.FoldParams(folds=4, holdout=0.2, horizon=4, min_train_dates=40, min_train_rows=200, min_test_rows=50)
LEAST = 5


def fsql(horizon):
    lags = {1: "a1", 2: "a2", 3: "a3", 4: "a4", 52: "a52"}
    joins = " ".join(f"LEFT JOIN panel {a} ON {a}.symbol=p.symbol AND {a}.session_no=p.session_no-{k}" for k, a in lags.items())
    names = ["mom_1", "mom_2", "mom_4", "mom_52", "vol", "rev", "turnover_log"]
    ranks = ", ".join(f"(rank() OVER (PARTITION BY date ORDER BY {n}) + (count(*) OVER (PARTITION BY date, {n})-1)/2)/count(*) OVER (PARTITION BY date)-0.5 AS {n}" for n in names)
    return q.PANEL + f""", fw AS (SELECT p.date, p.session_no, p.symbol, p.close/a1.close-1 AS mom_1, p.close/a2.close-1 AS mom_2, p.close/a4.close-1 AS mom_4, a4.close/a52.close-1 AS mom_52,
 abs((p.close/a1.close-1)-(a1.close/a2.close-1))/sqrt(2) AS vol, p.close/a3.close-1 AS rev, ln(1+(p.volume*p.close+a1.volume*a1.close)/2) AS turnover_log, h.close/p.close-1 AS y
 FROM panel p {joins} LEFT JOIN panel h ON h.symbol=p.symbol AND h.session_no=p.session_no+{horizon}),
fd AS (SELECT * FROM fw WHERE {' AND '.join(f'{n} IS NOT NULL' for n in names)} AND y IS NOT NULL),
fx AS (SELECT date, session_no, symbol, y, {ranks} FROM fd)"""


FSQL = fsql(4)


def feats(spark, sf, leak=False):
    return ft.build_features(src.panel(spark, sf), FP, leak)


def _show(df):
    return df.select("date", "symbol", *[fixed(F.col(c), 8).alias(c) for c in (*FP.names, "y")])


@query("build_features", f"WITH {FSQL} SELECT date, symbol, {', '.join(f'round({n}, 8)+0.0 AS {n}' for n in (*FP.names, 'y'))} FROM fx")
def _(spark, sf):
    return _show(feats(spark, sf))


@query("leaked_features", f"WITH {fsql(-4)} SELECT date, symbol, {', '.join(f'round({n}, 8)+0.0 AS {n}' for n in (*FP.names, 'y'))} FROM fx")
def _(spark, sf):
    return _show(feats(spark, sf, True))


FOLD = FSQL + """, pd AS (SELECT date, count(*) AS rows, row_number() OVER (ORDER BY date)-1 AS i FROM fx GROUP BY date), nn AS (SELECT count(*) AS n, greatest(1, CAST(floor(count(*)*0.2) AS BIGINT)) AS hold FROM pd),
bd AS (SELECT k AS fold, greatest(0, CAST(floor((n-hold)*0.4+(n-hold-(n-hold)*0.4)*(k-1)/4) AS BIGINT)-4) AS train_to, CAST(floor((n-hold)*0.4+(n-hold-(n-hold)*0.4)*(k-1)/4) AS BIGINT) AS test_from, CAST(floor((n-hold)*0.4+(n-hold-(n-hold)*0.4)*k/4) AS BIGINT) AS test_to FROM nn, range(1, 5) t(k)
 UNION ALL SELECT 0, greatest(0, n-hold-4), n-hold, n FROM nn),
fo AS (SELECT fold, max(date) FILTER (WHERE i<train_to) AS train_end, min(date) FILTER (WHERE i>=test_from AND i<test_to) AS test_start, max(date) FILTER (WHERE i>=test_from AND i<test_to) AS test_end,
 coalesce(sum(rows) FILTER (WHERE i<train_to), 0) AS n_train, coalesce(sum(rows) FILTER (WHERE i>=test_from AND i<test_to), 0) AS n_test FROM bd, pd WHERE fold=0 OR (test_to-test_from>=5 AND train_to>=40) GROUP BY fold),
fold AS (SELECT * FROM fo WHERE n_train>=200 AND n_test>=50)"""


@query("walk_forward_folds", f"WITH {FOLD} SELECT fold, train_end, test_start, test_end, CAST(n_train AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test FROM fold")
def _(spark, sf):
    return ft.walk_forward_folds(feats(spark, sf), FOLDS)


PRED = FOLD + """, pr AS (SELECT fold, date, symbol, y, -rev AS pred FROM fx JOIN fold ON date BETWEEN test_start AND test_end),
pk AS (SELECT *, count(*) OVER d AS n, rank() OVER (PARTITION BY fold, date ORDER BY pred)+(count(*) OVER (PARTITION BY fold, date, pred)-1)/2 AS rp, rank() OVER (PARTITION BY fold, date ORDER BY y)+(count(*) OVER (PARTITION BY fold, date, y)-1)/2 AS ry,
 row_number() OVER (PARTITION BY fold, date ORDER BY pred, symbol) AS rn FROM pr WINDOW d AS (PARTITION BY fold, date)),
ics AS (SELECT fold, date, corr(rp, ry) AS ic, avg(y) FILTER (WHERE rn<=greatest(1, n//10)) AS bottom, avg(y) FILTER (WHERE rn>n-greatest(1, n//10)) AS top FROM pk WHERE n>=5 GROUP BY ALL),
fsc AS (SELECT fold, avg(ic) AS ic, avg(top) AS top, avg(bottom) AS bottom, avg(top)-avg(bottom) AS spread FROM ics GROUP BY 1)"""


def hooked(spark, sf):
    """Fold predictions by short-term reversal instead of a fitted model."""
    x = settle(feats(spark, sf))
    return settle(ft.assign_folds(x, ft.walk_forward_folds(x, FOLDS), -F.col("rev")))


@query("rank_ic_deciles", f"WITH {PRED} SELECT fold, date, round(ic, 7)+0.0 AS ic, round(top, 8)+0.0 AS top, round(bottom, 8)+0.0 AS bottom FROM ics")
def _(spark, sf):
    r = ft.rank_ic_deciles(hooked(spark, sf), LEAST)
    return r.select("fold", "date", fixed(F.col("ic"), 7).alias("ic"), fixed(F.col("top"), 8).alias("top"), fixed(F.col("bottom"), 8).alias("bottom"))


@query("fold_report", f"""WITH {PRED} SELECT count(*) FILTER (WHERE fold>0) AS folds, round(avg(ic) FILTER (WHERE fold>0), 7) AS mean_ic, round(avg(ic) FILTER (WHERE fold>0)/(stddev_samp(ic) FILTER (WHERE fold>0)/sqrt(count(*) FILTER (WHERE fold>0))), 6) AS ic_t,
round(avg(spread) FILTER (WHERE fold>0), 8) AS mean_spread, round(max(ic) FILTER (WHERE fold=0), 7) AS holdout_ic, round(max(spread) FILTER (WHERE fold=0), 8) AS holdout_spread FROM fsc""")
def _(spark, sf):
    r = ft.fold_report(ft.fold_scores(ft.rank_ic_deciles(hooked(spark, sf), LEAST)))
    return r.select("folds", fixed(F.col("mean_ic"), 7).alias("mean_ic"), fixed(F.col("ic_t")).alias("ic_t"), fixed(F.col("mean_spread"), 8).alias("mean_spread"),
                    fixed(F.col("holdout_ic"), 7).alias("holdout_ic"), fixed(F.col("holdout_spread"), 8).alias("holdout_spread"))


def _regression(names):
    """Least squares per fold by residualising the features one after another on the training rows."""
    g = [f"g{i}" for i in range(len(names))]
    mean = lambda c: f"{c}-avg(CASE WHEN tr THEN {c} END) OVER w"
    out = f"""lr AS (SELECT fold, date, symbol, y, date<=train_end AS tr, date BETWEEN test_start AND test_end AS te, {', '.join(names)} FROM fx JOIN fold ON date<=train_end OR date BETWEEN test_start AND test_end),
l0 AS (SELECT fold, date, symbol, y, tr, te, avg(CASE WHEN tr THEN y END) OVER w AS p, {', '.join(f'{mean(n)} AS {x}' for n, x in zip(names, g))} FROM lr WINDOW w AS (PARTITION BY fold))"""
    for i, x in enumerate(g):
        later = "".join(f", {z}-{x}*sum(CASE WHEN tr THEN {z}*{x} END) OVER w/sum(CASE WHEN tr THEN {x}*{x} END) OVER w AS {z}" for z in g[i + 1:])
        out += f""",
l{i + 1} AS (SELECT fold, date, symbol, y, tr, te, p+{x}*sum(CASE WHEN tr THEN y*{x} END) OVER w/sum(CASE WHEN tr THEN {x}*{x} END) OVER w AS p{later} FROM l{i} WINDOW w AS (PARTITION BY fold))"""
    return out, f"l{len(g)}"


_OLS, _LAST = _regression(FP.names)


@query("fit_predict", f"WITH {FOLD}, {_OLS} SELECT fold, date, symbol, round(y, 7)+0.0 AS y, round(p, 6)+0.0 AS pred FROM {_LAST} WHERE te")
def _(spark, sf):
    x = settle(feats(spark, sf))
    p = ft.fit_predict(x, ft.walk_forward_folds(x, FOLDS), FP.names)
    return p.select("fold", "date", "symbol", fixed(F.col("y"), 7).alias("y"), fixed(F.col("pred")).alias("pred"))


@query("fit_predict_network")
def _(spark, sf):
    """Two hidden layers trained on every fold at once; no SQL, tests compare with plain numpy on gathered rows."""
    x = settle(feats(spark, sf))
    p = nw.fit_predict_network(x, ft.walk_forward_folds(x, FOLDS), FP.names, nw.NetworkParams(steps=20))
    return p.select("fold", "date", "symbol", fixed(F.col("y"), 7).alias("y"), fixed(F.col("pred")).alias("pred"))


def _mean_ic(leak, pred):
    """The oracle of one report's mean rank correlation."""
    return f"(WITH {(PRED.replace(FSQL, fsql(-4)) if leak else PRED).replace('-rev AS pred', pred + ' AS pred')} SELECT avg(ic) FILTER (WHERE fold>0) FROM fsc)"


@query("control_verdict", f"""SELECT round(planted_ic, 7) AS planted_ic, round(noise_ic, 7) AS noise_ic, round(real_ic, 7) AS real_ic, coalesce(planted_ic>0.02, false) AS found, coalesce(abs(noise_ic)<0.02, false) AS quiet,
coalesce(planted_ic>0.02, false) AND coalesce(abs(noise_ic)<0.02, false) AS readable
FROM (SELECT {_mean_ic(True, '-mom_4')} AS planted_ic, {_mean_ic(False, "CAST('0x' || substr(md5(concat_ws('|', CAST(date AS VARCHAR), symbol)), 1, 8) AS BIGINT)")} AS noise_ic, {_mean_ic(False, '-rev')} AS real_ic)""")
def _(spark, sf):
    """Controls from the panel itself: a leaked label must be found, a hashed prediction must not."""
    with src.shared_panel(spark, sf):
        real, leaked = settle(feats(spark, sf)), settle(feats(spark, sf, True))

    def reports(x, *preds):
        folds = settle(ft.walk_forward_folds(x, FOLDS))
        return [ft.fold_report(ft.fold_scores(ft.rank_ic_deciles(ft.assign_folds(x, folds, p), LEAST))) for p in preds]
    noise = draw_number(F.col("date"), F.col("symbol")).cast("double")
    (planted,), (hashed, reversal) = reports(leaked, -F.col("mom_4")), reports(real, noise, -F.col("rev"))
    v = ft.control_verdict(planted, hashed, reversal)
    return v.select(*[fixed(F.col(c), 7).alias(c) for c in ("planted_ic", "noise_ic", "real_ic")], "found", "quiet", "readable")
