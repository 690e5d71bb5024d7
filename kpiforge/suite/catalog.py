"""Collects every registered query module into one dict."""

from __future__ import annotations

import functools

from kpiforge.session import ensure_checkpoint_dir, ship_package


def _modules():
    from kpiforge.suite import queries  # noqa: F401
    return queries


def _wrap(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def queries():
    q = _modules()
    return {k: _wrap(v) for k, v in q.QUERIES.items()}


def oracle_sql():
    q = _modules()
    return dict(q.ORACLE)
