"""The distributed learner against plain numpy on gathered rows."""

import datetime as dt
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeloom.operators import network as nw
from tapeloom.session import ensure_checkpoint_dir

P = nw.NetworkParams(hidden=(6, 4), steps=25, rate=0.02)
NAMES = ["a", "b", "c"]


def rows(spark, n=900):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, (n, 3)) + 5
    pdf = pd.DataFrame(x, columns=NAMES).assign(date=[dt.date(2026, 1, 1) + dt.timedelta(days=i % 40) for i in range(n)], symbol=[f"s{i}" for i in range(n)])
    pdf["y"] = np.maximum(x[:, 0] - 5, 0) * 0.5 - 0.2 * x[:, 1] + rng.normal(0, 0.01, n)
    pdf["b"] = pdf["b"].where(pdf["date"] > dt.date(2026, 1, 12), 3.0)  # no spread in the first fold
    folds = [(1, dt.date(2026, 1, 12), dt.date(2026, 1, 13), dt.date(2026, 1, 20)), (2, dt.date(2026, 1, 20), dt.date(2026, 1, 21), dt.date(2026, 1, 30)), (0, dt.date(2026, 1, 30), dt.date(2026, 1, 31), dt.date(2026, 2, 9))]
    return pdf, spark.createDataFrame(pdf).repartition(7), spark.createDataFrame(folds, "fold int, train_end date, test_start date, test_end date")


def gathered(pdf, folds):
    out = {}
    for fold, end, start, last in folds:
        tr, te = pdf[pdf["date"] <= end], pdf[pdf["date"].between(start, last)]
        x, y = tr[NAMES].to_numpy(), tr["y"].to_numpy()
        mean, sd = x.mean(axis=0), x.std(axis=0)
        sd = np.where(sd == 0, 1.0, sd)
        net = nw.Network(3, P.hidden)
        w = net.first(P.seed + fold)
        m = v = np.zeros(net.size)
        for t in range(1, P.steps + 1):
            g = net.gradient(w, (x - mean) / sd, y) / len(x) + P.penalty * net.penalty(w) / len(x)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - P.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        out |= {(fold, s): p for s, p in zip(te["symbol"], net.predict(w, (te[NAMES].to_numpy() - mean) / sd), strict=True)}
    return out


def test_equals_plain_numpy_and_itself(spark):
    pdf, df, folds = rows(spark)
    runs = [{(r["fold"], r["symbol"]): r["pred"] for r in nw.fit_predict_network(df, folds, NAMES, P).collect()} for _ in range(2)]
    want = gathered(pdf, [tuple(r) for r in folds.collect()])
    assert runs[0] == runs[1] and runs[0].keys() == want.keys() and len(want) > 400
    assert max(abs(runs[0][k] - want[k]) for k in want) < 1e-6
    assert not [f for f in os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")) if f.startswith("stored-")]


def test_gradient_equals_differences():
    rng, net = np.random.default_rng(3), nw.Network(3, (5, 4))
    w, x, y = net.first(2) + 0.05, rng.normal(0, 1, (30, 3)), rng.normal(0, 1, 30)
    grad = net.gradient(w, x, y)
    for i in range(0, net.size, 3):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        loss = [0.5 * ((net.predict(v, x) - y) ** 2).sum() for v in (up, down)]
        assert abs(grad[i] - (loss[0] - loss[1]) / 2e-6) < 1e-4


def test_training_lowers_the_error(spark):
    pdf, df, folds = rows(spark)
    errors = []
    for steps in (1, 40):
        pred = nw.fit_predict_network(df, folds, NAMES, nw.NetworkParams(hidden=(6, 4), steps=steps, rate=0.02))
        errors.append(pred.filter("fold = 0").agg(F.avg((F.col("pred") - F.col("y")) ** 2)).first()[0])
    assert errors[1] < 0.7 * errors[0]


def test_fold_without_training_rows_predicts_nothing(spark):
    _, df, _ = rows(spark)
    folds = spark.createDataFrame([(1, dt.date(2020, 1, 1), dt.date(2026, 1, 1), dt.date(2026, 1, 9)), (2, dt.date(2026, 1, 20), dt.date(2026, 1, 21), dt.date(2026, 1, 22))], "fold int, train_end date, test_start date, test_end date")
    got = nw.fit_predict_network(df, folds, NAMES, nw.NetworkParams(hidden=(2,), steps=2))
    assert {r["fold"] for r in got.select("fold").distinct().collect()} == {2}
