"""From trajectory files to selected, scheduled training examples and their statistics."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.calls import canonical_args, canonical_args_deep, compact, deep_value, shallow
from ..functions.errors import classify_error
from ..functions.prompt import CHARACTERS, Tokenizer, structured_prompts
from ..functions.text import compact_history, render, token_estimate
from ..operators import messages as M, selection as S
from ..operators.lineage import cut
from ..operators.report import counters, require
from ..sources.tables import TRAJECTORY, trajectories

# Token caps of a prompt, a completion and a sequence, and the accumulation of an optimizer step.
PROMPT_CAP, COMPLETION_CAP, SEQUENCE_CAP, ACCUMULATION = 1664, 384, 2048, 16
_TRAJ = TRAJECTORY.split("traj ", 1)[1]


def load(spark: SparkSession, folder: str, by_source: bool = True, pattern: str = "*retail.json") -> DataFrame:
    """Successful records, the first of those with equal task and calls (and source, if by_source)."""
    records = trajectories(spark, folder, pattern)
    return first_histories(records, by_source)


def first_histories(records: DataFrame, by_source: bool = True) -> DataFrame:
    """Records without later ones of the same signature: task, all calls in order, and source if by_source."""
    canonical = canonical_args_deep if by_source else canonical_args
    made = M.explode_messages(records.select("trace_id", "traj")).select("trace_id", "idx", F.posexplode(M.named_calls(F.col("tool_calls"))).alias("n", "c"))
    made = made.select("trace_id", F.struct("idx", "n", "c.name", canonical("c.args").alias("args")).alias("call"))
    calls = made.groupBy("trace_id").agg(F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list("call")), lambda c: F.struct(c["name"], c["args"]))), 256).alias("calls"))
    keyed = records.join(calls, "trace_id", "left").withColumn("calls", F.coalesce("calls", F.lit("")))
    # Only keys take part in the choice; records are joined to the chosen ids.
    signature = ["source", "task_key", "calls"] if by_source else ["task_key", "calls"]
    order = ["trace_id"] if by_source else ["source", "trace_id"]
    first = M.first_of_each(keyed.select("source", "task_key", "calls", "trace_id"), signature, order)
    return records.join(first.select("trace_id"), "trace_id", "left_semi")


def message_rows(records: DataFrame) -> DataFrame:
    """Message rows with canonical first calls, all calls' number and errors; see operators.messages."""
    rows = M.explode_messages(records.select("trace_id", "task_key", "source", "traj")).withColumn("calls", M.named_calls(F.col("tool_calls")))
    first = F.try_element_at("calls", F.lit(1))
    rows = rows.withColumns({"name_": first["name"], "args_": canonical_args_deep(first["args"]), "n_calls": F.size("calls")})
    return rows.select(
        F.col("trace_id").alias("trace"),
        "task_key",
        "source",
        "idx",
        "role",
        "content",
        "n_calls",
        F.when(F.col("name_").isNotNull(), F.struct(F.col("name_").alias("name"), F.col("args_").alias("args"))).alias("call"),
        F.when(F.col("role") == "tool", classify_error(F.col("content"))).alias("error"),
    )


@F.pandas_udf(T.LongType())
def _json_length(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True)))


def estimated_tokens(traj_json: Column) -> Column:
    """The token estimate of a trajectory's JSON text, written with sorted keys."""
    return token_estimate(_json_length(traj_json))


@F.pandas_udf(T.StringType())
def _shown_calls(calls: pd.Series) -> pd.Series:
    """Named calls, as JSON of (name, args), as the list that a history shows."""
    return calls.map(lambda t: json.dumps([{"name": c["name"], "arguments": shallow(c["args"])} for c in json.loads(t)], ensure_ascii=False, sort_keys=True))


@F.pandas_udf(T.StringType())
def _text_call(calls: pd.Series) -> pd.Series:
    """The first of such calls as a completion whose arguments are text; null without one."""
    first = calls.map(lambda t: next(iter(json.loads(t)), None))
    return first.map(lambda c: None if c is None else compact({"name": c["name"], "arguments": shallow(c["args"])}))


def examples_v1(records: DataFrame, max_chars: int = 12000) -> DataFrame:
    """An example for each assistant message with a call: a history within a character cap, and the first call."""
    labels = M.prior_errors(message_rows(records), targets=(F.col("role") == "assistant") & F.col("call").isNotNull())
    calls = F.to_json(M.named_calls(F.col("tool_calls")))
    rows = M.explode_messages(records.select("trace_id", "task_key", "traj"))
    called = F.concat(F.upper(F.coalesce(F.when(F.col("role") != "", F.col("role")), F.lit("unknown"))), F.lit("_TOOL_CALL: "), _shown_calls(calls))
    line = F.when(F.size(F.coalesce("tool_calls", F.array())) > 0, called).otherwise(render(F.col("role"), F.col("content"), F.col("name")))
    lines = rows.select("trace_id", "task_key", F.struct("idx", "role", line.alias("line"), _text_call(calls).alias("call")).alias("m"))
    whole = lines.groupBy("trace_id", "task_key").agg(F.array_sort(F.collect_list("m")).alias("all"))
    targets = labels.select(F.col("trace").alias("trace_id"), "idx", "target_tool", "prior_error_type").join(whole, "trace_id")

    def text(system: bool) -> Column:
        some = F.filter(F.slice("all", 1, F.col("idx")), lambda m: m["role"].eqNullSafe(F.lit("system")) if system else ~m["role"].eqNullSafe(F.lit("system")))
        return F.array_join(F.transform(some, lambda m: m["line"]), "\n")

    prompt = F.concat(compact_history(text(True), text(False), max_chars), F.lit("\nASSISTANT_TOOL_CALL:\n"))
    return targets.select(
        F.concat("trace_id", F.lit(":action"), F.col("idx").cast("string")).alias("example_id"),
        "trace_id",
        "task_key",
        prompt.alias("prompt"),
        F.col("all")[F.col("idx")]["call"].alias("completion"),
        "target_tool",
        F.col("prior_error_type").isNotNull().alias("is_error_resolution_target"),
        "prior_error_type",
    )


@F.pandas_udf(T.StringType())
def _call_json(names: pd.Series, args: pd.Series) -> pd.Series:
    return pd.Series([compact({"name": n, "arguments": deep_value(a)}) for n, a in zip(names, args, strict=True)])


def canonical_call(message: Column) -> Column:
    """The first named call of a message as compact JSON."""
    first = F.try_element_at(M.named_calls(message["tool_calls"]), F.lit(1))
    return _call_json(first["name"], first["args"])


def examples_v2(records: DataFrame, tokenizer: Tokenizer = CHARACTERS, prompt_cap: int = PROMPT_CAP, completion_cap: int = COMPLETION_CAP, sequence_cap: int = SEQUENCE_CAP, end: int = 1) -> DataFrame:
    """An example for each assistant call: a structured prompt, the call, token counts and the recovery label.

    Raises if an assistant message has several calls, the policy is missing or doesn't
    fit, or a completion or sequence is too long.  end: tokens that end a completion.
    """
    rows = message_rows(records)
    rows = require(rows, ~((F.col("role") == "assistant") & (F.col("n_calls") > 1)), "one call for each assistant message is expected")
    labels = M.prior_errors(rows, targets=(F.col("role") == "assistant") & F.col("call").isNotNull()).withColumnRenamed("trace", "trace_id").drop("prior_error_type")
    joined = labels.join(records.select("trace_id", "task_key", "source", "traj"), "trace_id")
    made = joined.select("*", canonical_call(F.col("traj")[F.col("idx")]).alias("completion"), F.slice("traj", 1, F.col("idx")).alias("messages")).drop("traj")
    built = structured_prompts(made, prompt_cap, tokenizer)

    @F.pandas_udf(T.IntegerType())
    def size(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(tokenizer.encode(t)) + end).astype("int32")

    sized = built.withColumn("completion_tokens", size("completion")).withColumn("sequence_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    sized = require(sized, (F.col("completion_tokens") <= completion_cap) & (F.col("sequence_tokens") <= sequence_cap), "an example is longer than its caps")
    named = sized.withColumnsRenamed({"idx": "target_message_index", "error_type": "prior_error_type"})
    return named.withColumns({"example_id": F.concat("trace_id", F.lit(":action"), F.col("target_message_index").cast("string")), "is_error_resolution_target": F.col("recovery_mode") != "none"})


def trace_costs(examples: DataFrame) -> DataFrame:
    """source, key, task_key, cost and features of every trace that has examples, as selection takes them."""
    features = M.recovery_features(examples.withColumnRenamed("prior_error_type", "error_type"), "trace_id")
    weights = features.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("features"))
    costs = examples.groupBy("trace_id", "task_key", "source").agg(F.sum("sequence_tokens").alias("cost"))
    joined = costs.join(weights, "trace_id", "left")
    return joined.select("source", F.col("trace_id").alias("key"), "task_key", "cost", F.coalesce("features", F.create_map().cast("map<string,double>")).alias("features"))


def prepare(records: DataFrame, fraction: float = 0.3, **options) -> dict[str, DataFrame]:
    """The whole build: examples, split, selection (equal budgets by source) and schedules."""
    examples = cut(examples_v2(records, **options))
    split = S.task_split(records)
    costs = trace_costs(examples).join(split.where("split = 'train'").select("task_key"), "task_key", "left_semi")
    chosen = cut(S.equal_selection(costs.drop("task_key"), fraction))
    selected = chosen.select("arm", F.col("key").alias("trace_id")).join(examples, "trace_id")
    largest = selected.groupBy("arm").count().agg(F.max("count")).first()[0] or 0
    microbatches = -(-largest // ACCUMULATION) * ACCUMULATION
    return {"examples": examples, "split": split, "selection": chosen, "schedule": S.schedule(selected, "example_id", "arm", microbatches)}


def arm_stats(built: dict[str, DataFrame]) -> DataFrame:
    """Selected, example and schedule measures of every arm of prepare()."""
    chosen, schedule = built["selection"], built["schedule"]
    rows = chosen.select("arm", F.col("key").alias("trace_id")).join(built["examples"], "trace_id")
    a = chosen.groupBy("arm").agg(F.sum("cost").alias("selected_sft_tokens"), F.count("*").alias("trajectories"))
    b = rows.groupBy("arm").agg(
        F.countDistinct("task_key").alias("unique_tasks"),
        F.count("*").alias("examples"),
        F.sum((F.col("recovery_mode") != "none").cast("long")).alias("recovery_targets"),
        F.sum((F.col("recovery_mode") == "agent_initiated").cast("long")).alias("agent_initiated_targets"),
        F.sum((F.col("recovery_mode") == "user_assisted").cast("long")).alias("user_assisted_targets"),
        F.bround(F.avg("sequence_tokens"), 2).alias("mean_sequence_tokens"),
        F.sum(F.col("history_truncated").cast("long")).alias("truncated_context_examples"),
    )
    c = schedule.groupBy("arm").agg(
        F.count("*").alias("scheduled_microbatches"),
        F.countDistinct("example_id").alias("scheduled_unique_examples"),
        F.sum("sequence_tokens").alias("scheduled_nonpad_tokens"),
        F.sum("completion_tokens").alias("scheduled_loss_tokens"),
        (F.count("*") * SEQUENCE_CAP).alias("scheduled_padded_tokens"),
    )
    by_source = chosen.groupBy("arm", "source").agg(F.count("*").alias("n"), F.sum("cost").alias("tokens"))
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", v)))).alias(f"source_{k}_counts") for k, v in (("trajectory", "n"), ("token", "tokens"))]
    return a.join(b, "arm").join(c, "arm").join(by_source.groupBy("arm").agg(*maps), "arm")


def target_tools(examples: DataFrame, group: list[str]) -> DataFrame:
    """group and counts, a map of how often each tool is the target of an example."""
    return counters(examples, group, ["target_tool"]).select(*group, "counts")
