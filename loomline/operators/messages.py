"""Ordered-sequence operators over messages: events of error and repair, and what precedes a call.

A message row has trace, idx (its order), role, call (struct of name and args, null if
it makes none) and error (its error type, null if none).  Forward looks are windows in
descending order, so every frame grows by a row at a time and a trace costs one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def explode_messages(records: DataFrame, trace: str = "trace_id", traj: str = "traj") -> DataFrame:
    """Message rows of nested records, with their columns; idx counts from 0, calls without a name don't count."""
    rest = [c for c in records.columns if c != traj]
    return records.select(*rest, F.posexplode(traj).alias("idx", "m")).select(*rest, "idx", "m.*")


def named_calls(calls: Column) -> Column:
    """(name, arguments) of the calls that have a name."""
    some = F.filter(F.coalesce(calls, F.array()), lambda c: F.coalesce(c["function"]["name"], F.lit("")) != "")
    return F.transform(some, lambda c: F.struct(c["function"]["name"].alias("name"), F.coalesce(c["function"]["arguments"], F.lit("{}")).alias("args")))


def _before(order: list[str]):
    return Window.partitionBy("trace").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _after(order: list[str]):
    return Window.partitionBy("trace").orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)


def error_events(messages: DataFrame, order: list[str] = ["idx"]) -> DataFrame:  # noqa: B006
    """trace, idx, error_type, failed_tool, repair_tool, user_assisted of every error that a changed call follows.

    The failed call is the nearest before the error, the repair the nearest after it;
    a user message up to the repair, which itself may be the user's, assists.
    """
    place = F.struct(*order)
    used = messages.withColumns({"at": place, "made": F.when(F.col("call").isNotNull(), F.struct(place.alias("at"), "call"))})
    seen = used.withColumns(
        {
            "failed": F.last("call", True).over(_before(order)),
            "repair": F.last("made", True).over(_after(order)),
            "user_at": F.last(F.when(F.col("role") == "user", F.col("at")), True).over(_after(order)),
        }
    )
    errors = seen.where((F.col("role") == "tool") & F.col("error").isNotNull() & F.col("failed").isNotNull() & F.col("repair").isNotNull())
    changed = errors.where(~F.col("failed").eqNullSafe(F.col("repair.call")))
    assisted = F.coalesce(F.col("user_at") <= F.col("repair.at"), F.lit(False))
    return changed.select("trace", *order, F.col("error").alias("error_type"), F.col("failed.name").alias("failed_tool"), F.col("repair.call.name").alias("repair_tool"), assisted.alias("user_assisted"))


def prior_errors(messages: DataFrame, order: list[str] = ["idx"], targets: Column | None = None) -> DataFrame:  # noqa: B006
    """For every call: what the latest tool message before it says.

    trace, order, target_tool, prior_error_type (of that message, changed call or
    not), recovery_mode (none, agent_initiated, user_assisted), error_type,
    failed_tool and repair_tool (null unless recovered).  A tool message without an
    error ends an earlier one.  targets: which rows are calls to label, by default
    those with a call.
    """
    place = F.struct(*order)
    used = messages.withColumn("at", place).withColumn("failed", F.last("call", True).over(_before(order)))
    used = used.withColumn("said", F.when(F.col("role") == "tool", F.struct("at", "error", "failed")))
    seen = used.withColumns({"last_said": F.last("said", True).over(_before(order)), "last_user": F.last(F.when(F.col("role") == "user", F.col("at")), True).over(_before(order))})
    calls = seen.where(F.col("call").isNotNull() if targets is None else targets)
    said = F.col("last_said")
    recovered = F.coalesce(said["error"].isNotNull() & said["failed"].isNotNull() & ~said["failed"].eqNullSafe(F.col("call")), F.lit(False))
    mode = F.when(~recovered, "none").when(F.coalesce(F.col("last_user") > said["at"], F.lit(False)), "user_assisted").otherwise("agent_initiated")
    return calls.select(
        "trace",
        *order,
        F.col("call.name").alias("target_tool"),
        said["error"].alias("prior_error_type"),
        mode.alias("recovery_mode"),
        F.when(recovered, said["error"]).alias("error_type"),
        F.when(recovered, said["failed"]["name"]).alias("failed_tool"),
        F.when(recovered, F.col("call.name")).alias("repair_tool"),
    )


def recovery_features(labels: DataFrame, key: str = "trace") -> DataFrame:
    """key, feature and its largest weight, over the recovered calls of prior_errors()."""
    text = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    mode = F.col("recovery_mode")
    # The weights of a recovery's mode, error, transition and signature.
    pairs = F.array(
        F.struct(F.concat(F.lit("mode:"), mode).alias("feature"), F.when(mode == "agent_initiated", F.lit(4.0)).otherwise(F.lit(1.0)).alias("weight")),
        F.struct(F.concat(F.lit("error:"), text("error_type")).alias("feature"), F.lit(2.0).alias("weight")),
        F.struct(F.concat(F.lit("transition:"), text("failed_tool"), F.lit("->"), text("repair_tool")).alias("feature"), F.lit(3.0).alias("weight")),
        F.struct(F.concat(F.lit("signature:"), F.concat_ws("|", mode, text("error_type"), text("failed_tool"), text("repair_tool"))).alias("feature"), F.lit(5.0).alias("weight")),
    )
    rows = labels.where(mode != "none").select(key, F.explode(pairs).alias("p"))
    return rows.groupBy(key, F.col("p.feature").alias("feature")).agg(F.max("p.weight").alias("weight"))


def first_of_each(rows: DataFrame, signature: list[str], order: list[str]) -> DataFrame:
    """The first row in order of every signature.

    By a minimum over structs, which is combined before the shuffle, so a signature
    with very many copies doesn't gather in a task.
    """
    rest = [c for c in rows.columns if c not in order and c not in signature]
    least = F.min(F.struct(*order, *rest)).alias("r")
    return rows.groupBy(*signature).agg(least).select(*signature, "r.*").select(*rows.columns)
