"""All registered queries and their oracle SQL, gathered from the per-family modules."""

from __future__ import annotations

import importlib

FAMILIES = [
    "tabsmith.plans.profile_queries",
    "tabsmith.plans.step_queries",
    "tabsmith.plans.split_queries",
    "tabsmith.plans.metric_queries",
    "tabsmith.plans.model_queries",
    "tabsmith.plans.prep_queries",
    "tabsmith.plans.run_queries",
    "tabsmith.plans.io_queries",
    "tabsmith.plans.diag_queries",
    "tabsmith.plans.stream_queries",
]


def _mods():
    return [importlib.import_module(m) for m in FAMILIES]


def all_queries() -> dict:
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def all_oracle_sql() -> dict:
    out = {}
    for m in _mods():
        out.update(getattr(m, "ORACLE", {}))
    return out


def flagship(spark, sf_dir):
    from tabsmith.plans.flagship import flagship_plan

    return flagship_plan(spark, sf_dir)
