"""The build from trajectory files to schedules."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.functions.prompt import CHARACTERS
from loomline.operators import selection as S
from loomline.plans import pipelines as P


def call(name, args):
    return {"role": "assistant", "content": None, "tool_calls": [{"function": {"name": name, "arguments": json.dumps(args)}}]}


def record(task, extra=(), reward=1):
    traj = [{"role": "system", "content": "policy"}, {"role": "user", "content": f"do {task}"}, call("reserve", {"room": 100 + task, "nights": 2}), {"role": "tool", "content": f"room {100 + task} is already taken"}, *extra, call("reserve", {"nights": 2, "room": 200 + task}), {"role": "tool", "content": "LATER"}]
    return {"task_id": task, "reward": reward, "traj": traj}


@pytest.fixture
def folder(tmp_path):
    one = [record(i, [{"role": "user", "content": "another one " + "x" * i}] if i % 2 else []) for i in range(24)]
    again = [record(0) | {"trial": 1}, record(99, reward=0)]
    (tmp_path / "one-retail.json").write_text(json.dumps(one + again))
    (tmp_path / "two-retail.json").write_text(json.dumps([record(0), *(record(i, [{"role": "assistant", "content": "hm " * i}]) for i in range(24, 44))]))
    return str(tmp_path)


def test_dedup_within_and_across_sources(spark, folder):
    assert P.load(spark, folder).count() == 45 and P.load(spark, folder, by_source=False).count() == 44


def test_examples(spark, folder):
    rows = {r["example_id"]: r for r in P.examples_v2(P.load(spark, folder)).where("task_key IN ('retail:2', 'retail:3')").collect()}
    assert len(rows) == 4
    agent, user = rows["one-retail:task2:trial0:action4"], rows["one-retail:task3:trial0:action5"]
    assert agent["recovery_mode"] == "agent_initiated" and user["recovery_mode"] == "user_assisted" and agent["prior_error_type"] == "conflict"
    assert agent["completion"] == '{"arguments":{"nights":2,"room":202},"name":"reserve"}' and "LATER" not in agent["prompt"] and '"arguments":{"nights":2,"room":102}' in agent["prompt"]
    assert agent["prompt_tokens"] == len(agent["prompt"]) + 1 and agent["sequence_tokens"] == agent["prompt_tokens"] + len(agent["completion"]) + 1
    first = rows["one-retail:task2:trial0:action2"]
    assert first["recovery_mode"] == "none" and first["prior_error_type"] is None
    v1 = {r["example_id"]: r for r in P.examples_v1(P.load(spark, folder)).where("task_key = 'retail:2'").collect()}
    assert v1["one-retail:task2:trial0:action4"]["prior_error_type"] == "conflict" and v1["one-retail:task2:trial0:action4"]["prompt"].endswith("TOOL: room 102 is already taken\nASSISTANT_TOOL_CALL:\n")
    assert 'ASSISTANT_TOOL_CALL: [{"arguments": "{\\"nights\\":2,\\"room\\":102}", "name": "reserve"}]' in v1["one-retail:task2:trial0:action4"]["prompt"]


def test_caps_and_several_calls_raise(spark, folder):
    records = P.load(spark, folder)
    with pytest.raises(Exception, match="longer than its caps"):
        P.examples_v2(records, completion_cap=5).collect()
    with pytest.raises(Exception, match="doesn't fit"):
        P.examples_v2(records, prompt_cap=20).collect()
    double = records.withColumn("traj", F.transform("traj", lambda m: m.withField("tool_calls", F.when(m["tool_calls"].isNotNull(), F.concat(m["tool_calls"], m["tool_calls"])))))
    with pytest.raises(Exception, match="one call"):
        P.examples_v2(double).collect()


def test_estimate(spark):
    text = '[{"b": 1, "a": "é"}]'
    got = spark.createDataFrame([(text,)], "t string").select(P.estimated_tokens(F.col("t")).alias("n")).first()["n"]
    assert got == -(-len(json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)) // 4)


def test_prepare(spark, folder):
    built = P.prepare(P.load(spark, folder), 0.5, tokenizer=CHARACTERS)
    stats = {r["arm"]: r for r in P.arm_stats(built).collect()}
    assert set(stats) == set(S.ARMS) and len({r["selected_sft_tokens"] for r in stats.values()}) == 1
    assert len({r["scheduled_microbatches"] for r in stats.values()}) == 1 and all(r["scheduled_microbatches"] % 16 == 0 for r in stats.values())
    assert all(r["scheduled_unique_examples"] == r["examples"] for r in stats.values())
    for r in stats.values():
        assert set(r["source_trajectory_counts"]) == {"one-retail", "two-retail"} and sum(r["source_trajectory_counts"].values()) == r["trajectories"]
        assert sum(r["source_token_counts"].values()) == r["selected_sft_tokens"]
    tools = {r["arm"]: r["counts"] for r in P.target_tools(built["schedule"], ["arm"]).collect()}
    assert all(tools[a] == {"reserve": r["scheduled_microbatches"]} for a, r in stats.items())
    train = {r["task_key"] for r in built["split"].where("split = 'train'").collect()}
    tasks = {r["task_key"] for r in built["schedule"].select("task_key").distinct().collect()}
    assert tasks <= train
