"""Arm statistics, contract checks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def counters(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """group, counter and counts: how often each value of each column occurs, as a sorted map."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in columns))).alias("p")
    counts = rows.select(*group, pairs).select(*group, "p.*").groupBy(*group, "counter", "value").agg(F.count("*").alias("n"))
    return counts.groupBy(*group, "counter").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts"))


def counter_text(counts: Column) -> Column:
    """A counter as text: a=1;b=2."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


def arm_statistics(arms: DataFrame, events: DataFrame, calls: DataFrame, order: list[str]) -> DataFrame:
    """The measures of each method's traces: tokens, traces, tasks, recovery events, and what is in them.

    arms: method, trace, cost, task_key.  events: trace, error_type, user_assisted.
    calls: trace, tool and their order.  Sums by trace come first, so a trace that
    several methods have is counted once.
    """
    some = events.groupBy("trace").agg(F.count("*").alias("n"), F.sum(F.col("user_assisted").cast("long")).alias("assisted"))
    tools = calls.groupBy("trace").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "tool"))), lambda x: x["tool"]), ">").alias("tools"))
    rows = arms.join(some, "trace", "left").join(tools, "trace", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = rows.groupBy("method").agg(
        F.sum("cost").alias("estimated_tokens"),
        F.count("*").alias("traces"),
        F.countDistinct("task_key").alias("unique_tasks"),
        F.bround(F.sum("cost") / F.count("*").cast("double"), 1).alias("mean_trace_tokens"),
        F.sum((F.col("n") > 0).cast("long")).alias("recovery_traces"),
        F.sum("n").alias("recovery_events"),
        F.sum(F.col("n") - F.coalesce("assisted", F.lit(0))).alias("agent_initiated_events"),
        F.sum(F.coalesce("assisted", F.lit(0))).alias("user_assisted_events"),
        F.countDistinct(F.coalesce("tools", F.lit(""))).alias("tool_sequences"),
    )
    used = arms.select("method", "trace").distinct()
    types = used.join(events.select("trace", "error_type").distinct(), "trace").groupBy("method").agg(F.countDistinct("error_type").alias("error_types"))
    names = used.join(calls.select("trace", "tool").distinct(), "trace").groupBy("method").agg(F.countDistinct("tool").alias("tools"))
    return out.join(types, "method", "left").join(names, "method", "left").fillna(0, ["error_types", "tools"])


def drift(expected: dict[str, tuple[Column, Column]]) -> Column:
    """What differs from the contract, joined by "; ", or OK; expected: message and (observed, wanted)."""
    found = F.filter(F.array(*(F.when(~a.eqNullSafe(b), F.lit(m)) for m, (a, b) in expected.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.lit("OK")).otherwise(F.array_join(found, "; "))


def compare(arms: DataFrame, metrics: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for every arm: its metrics, status (missing, incompatible, complete) and errors."""
    joined = arms.join(metrics.withColumn("__found__", F.lit(True)), "arm", "left")
    errors = F.when(F.col("__found__").isNull(), F.lit("missing")).otherwise(drift(checks))
    out = joined.withColumn("errors", errors)
    status = F.when(F.col("errors") == "missing", "missing").when(F.col("errors") == "OK", "complete").otherwise("incompatible")
    return out.withColumn("status", status).drop("__found__")


def spread(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, least, most and whether all values are equal."""
    return rows.groupBy(*group).agg(F.min(value).alias("least"), F.max(value).alias("most"), (F.min(value) == F.max(value)).alias("equal"))


def percent(value: Column) -> Column:
    """A share as a percentage with two digits; a dash if null."""
    return F.when(value.isNull(), F.lit("—")).otherwise(F.format_string("%.2f%%", value * 100))


def interval(low: Column, high: Column) -> Column:
    """[low, high] in percent; a dash without one."""
    return F.when(low.isNull(), F.lit("—")).otherwise(F.format_string("[%.2f, %.2f]", low * 100, high * 100))


def markdown(rows: DataFrame, columns: list[str]) -> list[str]:
    """The lines of a table for a report of a few rows; cells are text already."""
    cells = [[str(r[c]) if r[c] is not None else "—" for c in columns] for r in rows.select(*columns).collect()]
    return [f"| {' | '.join(columns)} |", "|" + " --- |" * len(columns), *(f"| {' | '.join(c)} |" for c in cells)]


def require(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """rows, or an error as soon as one that doesn't meet the condition is read."""
    checked = F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return rows.where(checked)
