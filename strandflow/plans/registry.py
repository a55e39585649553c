"""All registered queries of the library and their oracle SQL; the query modules fill these."""

from __future__ import annotations

from collections.abc import Callable

from strandflow.plans.oracle import with_views

FLAGSHIP = "frozen_pipeline"
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with SQL over the named views if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


def load() -> None:
    from strandflow.plans import association, audits, cases, chain, checks, contests, detection, divisions, evaluation, fields, further, gaps, gates, graph, grids, policies, reproduction  # noqa: F401


load()
