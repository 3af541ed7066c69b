"""Scoring of predicted calls, grouped metrics and cluster-bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .lineage import cut
from .selection import hash_order, hash_part, running

METRICS = ["json_valid", "tool_name_correct", "arguments_exact", "full_call_exact"]
GROUPS = ["overall", "recovery", "agent_initiated", "user_assisted"]


def score(rows: DataFrame) -> DataFrame:
    """rows (pred_name, pred_args, name, args; canonical texts) with the four flags; a missing prediction is wrong."""
    valid = F.col("pred_name").isNotNull()
    name = F.coalesce(valid & (F.col("pred_name") == F.col("name")), F.lit(False))
    args = F.coalesce(valid & F.col("pred_args").eqNullSafe(F.col("args")), F.lit(False))
    return rows.withColumns({"json_valid": valid, "tool_name_correct": name, "arguments_exact": args, "full_call_exact": name & args})


def score_text(rows: DataFrame) -> DataFrame:
    """rows with tool_correct and call_exact where targets have their arguments as JSON text.

    A predicted call whose arguments are an object never equals such a target, whatever
    is in it; pred_text: whether the prediction's arguments are text.
    """
    name = F.coalesce(F.col("pred_name") == F.col("name"), F.lit(False))
    same = F.coalesce(F.col("pred_text") & (F.col("pred_args") == F.col("args")), F.lit(False))
    return rows.withColumns({"tool_correct": name, "call_exact": name & same})


def in_groups(scored: DataFrame, mode: str = "recovery_mode") -> DataFrame:
    """A row for each group that a prediction is in; groups overlap."""
    m = F.coalesce(F.col(mode), F.lit("none"))
    names = F.filter(F.array(F.lit("overall"), F.when(m != "none", "recovery"), F.when(m != "none", m)), lambda x: x.isNotNull())
    return scored.select("*", F.explode(names).alias("group"))


def group_metrics(scored: DataFrame, task: str = "task_key", metrics: list[str] = METRICS) -> DataFrame:
    """group, metric, examples, tasks, micro and task_macro (the mean of tasks' means); an empty group has 0 and nulls.

    Two levels of sums: by group and task, then by group, so overlapping groups cost
    one pass and no group's rows meet.
    """
    tasks = in_groups(scored).groupBy("group", task).agg(F.count("*").alias("n"), *(F.sum(F.col(m).cast("long")).alias(m) for m in metrics))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("hits")) for m in metrics))).alias("p")
    means = tasks.select("group", "n", pairs).select("group", "n", "p.*").groupBy("group", "metric")
    means = means.agg(F.sum("n").alias("examples"), F.count("*").alias("tasks"), (F.sum("hits") / F.sum("n")).alias("micro"), F.avg(F.col("hits") / F.col("n")).alias("task_macro"))
    spark = scored.sparkSession
    every = spark.createDataFrame([(g, m) for g in GROUPS for m in metrics], "group string, metric string")
    out = every.join(means, ["group", "metric"], "left")
    return out.select("group", "metric", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("examples", "tasks")), "micro", "task_macro")


def draw(seed: Column, sample: Column, slot: Column, n: Column) -> Column:
    """A reproducible draw below n: the first eight hex digits of a SHA-256, modulo n."""
    return F.conv(F.substring(F.sha2(F.concat_ws("/", seed, sample, slot), 256), 1, 8), 16, 10).cast("long") % n


def cluster_bootstrap(scored: DataFrame, task: str = "task_key", metrics: list[str] = METRICS, samples: int = 2000, seed: int = 20260722) -> DataFrame:
    """metric, ci_low, ci_high: 95 % percentile intervals of the mean when tasks are drawn with replacement.

    A draw needs only each task's count and sums, never its rows.  Tasks, not rows,
    are drawn, so their table is joined to samples x tasks draws by number.  Numbers
    follow a hash order, of which no task has more than a part.
    """
    stats = scored.groupBy(task).agg(F.count("*").alias("n"), *(F.sum(F.col(m).cast("long")).alias(m) for m in metrics))
    stats = cut(stats)
    order = hash_order(F.col(task), "bootstrap", seed)
    numbered = running(stats.withColumn("__o__", order), [], hash_part("__o__"), ["__o__", task], F.lit(1), "i").withColumn("i", F.col("i") - 1).drop(task, "__o__")
    size = stats.agg(F.count("*").alias("size")).first()["size"]
    spark = scored.sparkSession
    slots = spark.range(samples).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(max(size, 1) - 1))).alias("slot"))
    draws = slots.select("sample", draw(F.lit(str(seed)), F.col("sample").cast("string"), F.col("slot").cast("string"), F.lit(max(size, 1))).alias("i"))
    means = draws.join(numbered, "i").groupBy("sample").agg(*((F.sum(m) / F.sum("n")).alias(m) for m in metrics))
    ends = means.agg(*(F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias(m) for m in metrics))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m)[0].alias("ci_low"), F.col(m)[1].alias("ci_high")) for m in metrics))).alias("p")
    return ends.select(pairs).select("p.*")


def resume(examples: DataFrame, done: DataFrame, key: str = "example_id") -> DataFrame:
    """Examples that have no prediction yet."""
    return examples.join(done.select(key).distinct(), key, "left_anti")


def latest(done: DataFrame, key: str, order: str) -> DataFrame:
    """The last prediction of every key."""
    rest = [c for c in done.columns if c not in (key, order)]
    return done.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r")).select(key, "r.*")
