"""Named queries over the benchmark tables, each with the SQL that gives the same rows."""

from __future__ import annotations

FLAGSHIP = "profile_edge_bucket_median"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame callable under name, with its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
