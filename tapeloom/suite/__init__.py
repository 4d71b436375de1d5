"""The registered queries; importing a module registers its entries."""

from __future__ import annotations

import importlib

from tapeloom.suite.register import ORACLE, QUERIES

MODULES = ("panel", "hygiene", "indicators", "ranking", "statistics", "regimes", "intraday", "records", "audits",
           "features", "streams")


def load_all():
    for name in MODULES:
        importlib.import_module(f"tapeloom.suite.{name}")
    return QUERIES, ORACLE
