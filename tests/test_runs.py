"""Contracts between the steps of an experiment."""

import pytest
from pyspark.sql import functions as F

from loomline.operators import contracts as K

BUILD = {"protocol": K.PROTOCOL, "training": {"gradient_accumulation": 16, "pad_to_max_sequence_tokens": 2048, "optimizer_steps": 3, "microbatches": 48}, "arms": [{"selected_sft_tokens": 70}, {"selected_sft_tokens": 70}]}


def test_frozen_counts():
    summary = {"seed": 20260722, "splits": {"validation_examples": 361, "test_examples": 900, "other": 1}}
    assert K.frozen_counts(summary) is summary
    with pytest.raises(K.ContractError, match="test_examples"):
        K.frozen_counts(summary | {"splits": {"validation_examples": 361}})


@pytest.mark.parametrize(
    ("change", "fault"),
    [({"protocol": "x"}, "protocol"), ({"training": BUILD["training"] | {"microbatches": 47}}, "microbatches"), ({"training": {}}, "accumulation"), ({"arms": [{"selected_sft_tokens": 1}, {"selected_sft_tokens": 2}]}, "totals")],
)
def test_training_contract(change, fault):
    assert K.training_contract(BUILD) is BUILD
    with pytest.raises(K.ContractError, match=fault):
        K.training_contract(BUILD | change)


def test_runs_go_on_under_their_own_contract_only(spark, tmp_path):
    place, contract = f"file://{tmp_path}/run.contract.json", {"protocol": K.PROTOCOL, "generation": K.GENERATION, "limited": False}
    with pytest.raises(K.ContractError, match="without a contract"):
        K.open_run(spark, place, contract, True)
    assert not K.open_run(spark, place, contract, False) and K.open_run(spark, place, contract, True)
    with pytest.raises(K.ContractError, match="another contract"):
        K.open_run(spark, place, contract | {"limited": True}, True)


def test_counts_and_ids(spark):
    rows = spark.createDataFrame([("b", True), ("a", False), ("c", True)], "key string, hit boolean")
    assert K.dry_run(rows, F.col("hit")) == {"examples": 3, "recovery_examples": 2, "mode": "dry_run_no_model_loaded"}
    assert [r["key"] for r in K.limited(rows, ["key"], 2).collect()] == ["a", "b"] and K.limited(rows, ["key"], None).count() == 3
    with pytest.raises(K.ContractError, match="16 rows has 3"):
        K.schedule_length(rows, 1)
    assert K.schedule_length(rows, 3, accumulation=1) is rows
    with pytest.raises(K.ContractError, match="more than once"):
        K.distinct_ids(rows.union(rows), ["key"])
    listed = K.manifest(rows, "key")
    assert [tuple(r) for r in K.manifest_rows(listed, K.distinct_ids(rows, ["key"]), "key").orderBy("pos").select("pos", "key", "hit").collect()] == [(1, "a", False), (2, "b", True), (3, "c", True)]
    with pytest.raises(Exception, match="no record of b"):
        K.manifest_rows(listed, rows.where("key <> 'b'"), "key").collect()
    assert K.uniform(rows, ["hit"]).first()["n"] == 2
