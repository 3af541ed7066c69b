"""Contracts between the steps of an experiment: what a build fixes, and whether later steps keep to it.

A contract is a small JSON document.  What depends on tables (counts, digests,
duplicates, missing ids) is computed by Spark, and only the answers come to the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import json_document, write_document
from .selection import running

# The frozen counts of the first build, and the protocol and settings of the second.
BUILD_V1 = {"seed": 20260722, "validation_examples": 361, "test_examples": 900}
PROTOCOL, LOADING, ACCUMULATION, PADDED, PROMPT_TOKENS = "qlora_v2", "nf4_4bit", 16, 2048, 1664
GENERATION = {"do_sample": False, "max_new_tokens": 128, "batch_size": 1}


class ContractError(RuntimeError):
    """A step doesn't keep to what an earlier one fixed."""


def frozen_counts(summary: dict, expected: dict = BUILD_V1) -> dict:
    """summary, if its seed and split sizes are those that are frozen."""
    found = {"seed": summary.get("seed")} | {k: v for k, v in (summary.get("splits") or {}).items() if k in expected}
    if wrong := {k: found.get(k) for k, v in expected.items() if found.get(k) != v}:
        raise ContractError(f"not the frozen build: {wrong}")
    return summary


def training_contract(build: dict) -> dict:
    """build, if its protocol, step size, padding, number of steps and the arms' tokens fit together."""
    training = build.get("training") or {}
    steps, tokens = training.get("optimizer_steps"), {a.get("selected_sft_tokens") for a in build.get("arms") or []}
    faults = {
        "another protocol": build.get("protocol") != PROTOCOL,
        f"gradient_accumulation isn't {ACCUMULATION}": training.get("gradient_accumulation") != ACCUMULATION,
        f"pad_to_max_sequence_tokens isn't {PADDED}": training.get("pad_to_max_sequence_tokens") != PADDED,
        "microbatches aren't steps times accumulation": steps is None or training.get("microbatches") != ACCUMULATION * steps,
        f"arms have different token totals: {sorted(tokens, key=str)}": len(tokens) != 1,
    }
    if found := [text for text, wrong in faults.items() if wrong]:
        raise ContractError("; ".join(found))
    return build


def open_run(spark: SparkSession, contract_path: str, contract: dict, has_predictions: bool) -> bool:
    """Whether a run goes on, under the same contract; a new run's contract is written.

    Predictions made under another contract, or under none, are never mixed with new ones.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(contract_path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        if json_document(spark, contract_path) != json.loads(json.dumps(contract)):
            raise ContractError("the output belongs to a run under another contract")
        return True
    if has_predictions:
        raise ContractError("the output has predictions without a contract")
    write_document(spark, contract, contract_path)
    return False


def dry_run(rows: DataFrame, recovery: Column) -> dict:
    """How many examples a run would evaluate, without predicting anything."""
    found = rows.agg(F.count("*").alias("examples"), F.coalesce(F.sum(recovery.cast("long")), F.lit(0)).alias("recovery_examples")).first()
    return found.asDict() | {"mode": "dry_run_no_model_loaded"}


def limited(rows: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """The first rows in order, or all without a limit."""
    return rows if not limit else rows.orderBy(*order).limit(limit)


def schedule_length(rows: DataFrame, steps: int, batch: int = 1, accumulation: int = ACCUMULATION) -> DataFrame:
    """rows, if there are exactly as many as the steps take."""
    if (found := rows.count()) != steps * batch * accumulation:
        raise ContractError(f"a schedule of {steps * batch * accumulation} rows has {found}")
    return rows


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on several rows, with n, how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def distinct_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, if no key is on several."""
    if some := repeated(rows, keys).limit(3).collect():
        raise ContractError(f"selected more than once: {[tuple(r) for r in some]}")
    return rows


def manifest(ids: DataFrame, key: str) -> DataFrame:
    """key and pos, from 1 in order of the keys; numbered by parts of the keys, so no task has them all."""
    return running(ids.select(key), [], F.substring(key, 1, 7), [key], F.lit(1), "pos").select(F.col("pos").cast("long").alias("pos"), key)


def manifest_rows(listed: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The records of a manifest (pos, key); an error as soon as an id without a record is met."""
    found = listed.join(records.withColumn("__found__", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no record of "), F.col(key))).cast("boolean")
    return found.where(F.coalesce("__found__", missing)).drop("__found__")


def arm_drift(metrics: DataFrame, arms: DataFrame, build: DataFrame, manifests: DataFrame, selections: DataFrame, base: str = "base_model") -> DataFrame:
    """arm, status (missing, incompatible, complete) and errors (OK, or what differs from the build) of every arm.

    arms: arm.  build: one row of test_examples, revision, test_sha256,
    validation_sha256, pad, steps, accumulation, and a map of schedule_sha256 by arm.
    metrics: arm, protocol, limited, evaluated, revision, test_sha256, prompt_tokens,
    generation (JSON text), loading.  manifests: arm, train_protocol, train_revision,
    max_seq_len, max_steps, batch_size, grad_accum, smoke_test, train_sha256,
    train_validation_sha256.  selections: arm, selected_sft_tokens.  The base arm isn't
    trained.  All are tables of a row an arm.
    """
    rows = arms.join(metrics.withColumn("__m__", F.lit(True)), "arm", "left").join(manifests.withColumn("__t__", F.lit(True)), "arm", "left")
    rows = rows.join(selections.withColumn("__s__", F.lit(True)), "arm", "left").crossJoin(build.select(*(F.col(c).alias(f"build_{c}") for c in build.columns)))
    c = F.col
    differs = lambda a, b: ~a.eqNullSafe(b)
    evaluation = [
        (differs(c("protocol"), F.lit(PROTOCOL)), F.lit("wrong protocol")),
        (F.coalesce("limited", F.lit(False)) | differs(c("evaluated"), c("build_test_examples")), F.concat(F.lit("incomplete formal test: "), F.coalesce(c("evaluated").cast("string"), F.lit("None")), F.lit("/"), c("build_test_examples").cast("string"))),
        (differs(c("revision"), c("build_revision")), F.lit("model revision drift")),
        (differs(c("test_sha256"), c("build_test_sha256")), F.lit("test file hash drift")),
        (differs(c("prompt_tokens"), F.lit(PROMPT_TOKENS)) | differs(c("generation"), F.lit(json.dumps(GENERATION, sort_keys=True))), F.lit("evaluation context/generation drift")),
        (differs(c("loading"), F.lit(LOADING)), F.lit("base loading drift")),
    ]
    untrained = c("__t__").isNull() | c("__s__").isNull()
    training = [(untrained, F.lit("missing training or selection manifest"))]
    wanted = {
        "protocol": ("train_protocol", F.lit(PROTOCOL)),
        "model_revision": ("train_revision", c("build_revision")),
        "max_seq_len": ("max_seq_len", c("build_pad")),
        "max_steps": ("max_steps", c("build_steps")),
        "batch_size": ("batch_size", F.lit(1)),
        "grad_accum": ("grad_accum", c("build_accumulation")),
        "smoke_test": ("smoke_test", F.lit(False)),
    }
    training += [(~untrained & differs(c(column), value), F.lit(f"training {name} drift")) for name, (column, value) in wanted.items()]
    training.append((~untrained & differs(c("train_sha256"), F.element_at("build_schedule_sha256", c("arm"))), F.lit("training schedule hash drift")))
    training.append((~untrained & c("build_validation_sha256").isNotNull() & differs(c("train_validation_sha256"), c("build_validation_sha256")), F.lit("validation file hash drift")))
    found = [F.when(wrong, text) for wrong, text in evaluation] + [F.when((c("arm") != base) & wrong, text) for wrong, text in training]
    errors = F.filter(F.array(*found), lambda x: x.isNotNull())
    shown = F.when(c("__m__").isNull(), F.lit("missing")).when(F.size(errors) == 0, F.lit("OK")).otherwise(F.array_join(errors, "; "))
    status = F.when(c("errors") == "missing", "missing").when(c("errors") == "OK", "complete").otherwise("incompatible")
    return rows.withColumn("errors", shown).select("arm", status.alias("status"), "errors")


def uniform(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n, how many different values the columns together have in rows of trained arms: tokens selected, or environments."""
    return rows.agg(F.countDistinct(F.struct(*columns)).alias("n"))


def numbered(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """rows with i, from 0 in a hash order of their keys, numbered by parts of it."""
    placed = running(rows.withColumn("__o__", order), [], F.substring("__o__", 1, 3), ["__o__", key], F.lit(1), "i")
    return placed.withColumn("i", F.col("i") - 1).drop("__o__")


