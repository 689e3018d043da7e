"""Checks of schemas, keys and gates, as tables of findings rather than prose."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that are not there become null ones of the given type."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns})


def renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Only the mapped columns, {new: old}."""
    return require_columns(df, mapping.values()).select(*(F.col(old).alias(new) for new, old in mapping.items()))


def one_version(df: DataFrame, column: str, expected: str) -> DataFrame:
    found = [r[0] for r in df.select(column).distinct().limit(2).collect()]
    if found and found != [expected]:
        raise ValueError(f"{column} is {found}, not only {expected}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if row := duplicate_keys(df, keys).head():
        raise ValueError(f"not unique on {keys}: {row.asDict()}")
    return df


def keep_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has: an aggregate and a semi join, so that no key is gathered."""
    once = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return df.join(once, keys, "left_semi")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values of the child's column that no parent has, and their rows."""
    missing = child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
    return missing.groupBy(column).agg(F.count("*").alias("n"))


def key_conflicts(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys with more than one value in the column."""
    return df.groupBy(key).agg(F.count_distinct(column).alias("n")).where("n > 1")


def gate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row a check: its name and whether it holds over all rows (an aggregate condition)."""
    one = df.agg(*(c.alias(n) for n, c in checks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(False)).alias("passed")) for n in checks))).alias("c")).select("c.check", "c.passed")


def intake_status(blocking: Column, missing: Column) -> Column:
    """blocked, then validated_not_assignment_ready, then assignment_ready."""
    return F.when(blocking, "blocked").when(missing, "validated_not_assignment_ready").otherwise("assignment_ready")


def ordered_quantiles(*columns: str) -> Column:
    """Whether the columns never fall from one to the next."""
    out = F.lit(True)
    for a, b in zip(columns, columns[1:]):
        out = out & (F.col(a) <= F.col(b))
    return out


def overlapping_ranges(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Rows that begin no later than an earlier row of their group ends."""
    from pyspark.sql.window import Window

    before = F.max(end).over(Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("previous_end", before).where(F.col(start) <= F.col("previous_end"))


def only_row(df: DataFrame, condition: Column):
    """The one row for which the condition holds; none or several are an error."""
    found = df.where(condition).limit(2).collect()
    if len(found) != 1:
        raise LookupError("no row fits" if not found else "several rows fit")
    return found[0]


# What rows of the stored tables must satisfy. As in SQL, a check that is null holds; required columns are apart.
CHECKS = {
    "scenarios": {"revision": "revision >= 1", "archived": "archived IN (0, 1)"},
    "scenario_revisions": {"revision": "revision >= 1"},
    "simulation_runs": {
        "run_kind": "run_kind IN ('validation', 'regional_comparison')",
        "status": "status IN ('queued', 'running', 'completed', 'failed', 'cancel_requested', 'cancelled')",
    },
    "benchmark_trips": {
        "day_type": "day_type IN ('mon_thu', 'friday', 'saturday', 'sunday')",
        "actual_travel_seconds": "actual_travel_seconds > 0",
        "reported_no_traffic_seconds": "reported_no_traffic_seconds > 0",
        "incident_flag": "incident_flag IN (0, 1)",
        "ends": "(origin_node IS NOT NULL AND destination_node IS NOT NULL AND origin_zone IS NULL AND destination_zone IS NULL) OR (origin_node IS NULL AND destination_node IS NULL AND origin_zone IS NOT NULL AND destination_zone IS NOT NULL)",
    },
}
REQUIRED = {
    "scenarios": ["id", "name", "revision", "graph_version", "content_json", "archived", "created_at", "updated_at"],
    "scenario_revisions": ["scenario_id", "revision", "name", "graph_version", "content_json", "created_at"],
    "simulation_runs": ["id", "run_kind", "status", "run_key", "seed", "graph_version", "created_at"],
    "benchmark_trips": ["id", "graph_version", "departure_time", "day_type", "corridor_label", "actual_travel_seconds", "incident_flag", "created_at", "updated_at"],
}


def violations(df: DataFrame, checks: dict[str, str], required: Iterable[str] = ()) -> DataFrame:
    """Rows that break a check, with the names of all they break in _broken: a filter in one pass, no shuffle."""
    tests = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in required] + [F.when(~F.expr(e), F.lit(n)) for n, e in checks.items()]
    return df.withColumn("_broken", F.array_compact(F.array(*tests))).where(F.size("_broken") > 0)


def stored_faults(df: DataFrame, table: str) -> DataFrame:
    """The rows that a stored table (a name of CHECKS) may not have; columns that must be there and aren't are an error."""
    require_columns(df, REQUIRED[table])
    used = {n: e for n, e in CHECKS[table].items()}
    optional = {"benchmark_trips": {c: "string" for c in ("origin_node", "destination_node", "origin_zone", "destination_zone")} | {"reported_no_traffic_seconds": "double"}}
    return violations(with_optional(df, optional.get(table, {})), used, REQUIRED[table])


# What a campaign's configuration may hold.
CAMPAIGN = {
    "name": "coalesce(name, '') RLIKE '^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$'",
    "end_date": "end_date >= start_date",
    "days": "datediff(end_date, start_date) + 1 <= 1096",
    "highway_ids": "coalesce(size(highway_ids), 0) BETWEEN 1 AND 64 AND forall(highway_ids, x -> coalesce(x > 0, false))",
    "resolution": "coalesce(resolution, '00:15:00') IN ('00:15:00', '01:00:00')",
    "days_of_week": "days_of_week IS NULL OR (size(days_of_week) > 0 AND forall(days_of_week, x -> coalesce(x BETWEEN 1 AND 7, false)))",
    "chunk_days": "chunk_days BETWEEN 1 AND 7",
    "delay_ms": "delay_ms BETWEEN 100 AND 60000",
    "request_timeout_ms": "request_timeout_ms BETWEEN 10000 AND 600000",
    "max_retries": "max_retries BETWEEN 0 AND 10",
    "max_response_bytes": "max_response_bytes BETWEEN 1048576 AND 104857600",
    "max_groups_per_chunk": "max_groups_per_chunk BETWEEN 100 AND 1000000",
}


def campaign_faults(configs: DataFrame) -> DataFrame:
    """Configurations of campaigns that may not run, with what is wrong in _broken; a null that has a default holds."""
    return violations(configs, CAMPAIGN, ["start_date", "end_date"])


def first_status(df: DataFrame, keys: list[str], order: list[str], status: str = "status") -> DataFrame:
    """The status of each key's first row by order, ties by the status itself."""
    return df.groupBy(*keys).agg(F.min_by(status, F.struct(*order, status)).alias(status))
