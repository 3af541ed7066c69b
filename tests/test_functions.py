"""Scalar functions and prompts on literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import calls, prompt
from loomline.functions.batches import encode_left_cut, pad
from loomline.functions.errors import classify_error
from loomline.functions.text import compact_history, render, token_estimate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_error_rules_take_the_first_match(spark):
    texts = ["Error: item not found", "ERROR - boom", "Missing field", "already done", "not permitted", "fine", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", classify_error(F.col("t")).alias("e")).orderBy("i").collect()
    assert [r["e"] for r in rows] == ["not_found", "generic_error", "invalid_argument", "conflict", "unauthorized", None, None]


def test_canonical_arguments():
    assert calls.shallow('{"b":"5","a":[1, 2.50]}') == '{"a":[1,2.5],"b":"5"}'
    assert calls.shallow(" not\t json\n") == "not json"
    assert calls.deep('{"a":"5","b":"{\\"c\\":\\"true\\"}"}') == '{"a":5,"b":{"c":true}}'
    assert calls.deep('{"x":1.0}') == '{"x":1.0}' and calls.deep(None) is None


def test_calls_in_noise():
    text = 'I will call {"name": "find", "arguments": "{\\"b\\": 1, \\"a\\": \\"x\\"}"} now {'
    assert calls.first_call(text) == {"name": "find", "arguments": {"a": "x", "b": 1}}
    assert calls.first_call('{"wrap": {"name": "f", "arguments": {}}}') == {"name": "f", "arguments": {}}
    assert calls.greedy_call('{"wrap": {"name": "f"}}') is None and calls.greedy_call('x {"name": "f"} y') == {"name": "f"}
    assert calls.first_call("{{{") is None and calls.first_call(None) is None and calls.greedy_call("{") is None


def test_token_estimate_and_render(spark):
    assert [one(spark, token_estimate(F.lit(n))) for n in (0, 1, 4, 5)] == [1, 1, 1, 2]
    assert one(spark, render(F.lit(None).cast("string"), F.lit(None).cast("string"))) == "UNKNOWN: "
    assert one(spark, render(F.lit("tool"), F.lit("x"), F.lit("n"))) == "TOOL name=n: x"


def test_compact_history(spark):
    history = lambda s, t, n: one(spark, compact_history(F.lit(s), F.lit(t), n))
    assert history("S", "abc", 100) == "S\nabc"
    assert history("S", "x" * 50 + "end", 43) == "S\n[TRUNCATED_OLDER_HISTORY]\n" + "x" * 7 + "end"
    assert history("S" * 20, "whole tail", 10) == "S" * 20 + "\n[TRUNCATED_OLDER_HISTORY]\nwhole tail"


def test_prompt_keeps_policy_and_whole_records():
    said = [("system", "Be brief."), ("user", "Which trains go to Ghent? " * 4), ("assistant", "z" * 700), ("tool", "two trains"), ("user", "and later?")]
    messages = [{"role": r, "content": c} for r, c in said]
    p = prompt.Prompt(messages, 420)
    assert "\nBe brief.\n" in p.text and prompt.CHARACTERS.size(p.text) <= 420
    shown = [json.loads(line) for line in p.text.split("\n") if line.startswith("{")]
    assert shown[0]["content"] == said[1][1] and shown[1]["role"] == "meta" and [m["content"] for m in shown[2:]] == ["two trains", "and later?"]
    assert p.kept == 3 and prompt.META in p.text
    assert prompt.Prompt(messages, 5000).kept == 4 and prompt.META not in prompt.Prompt(messages, 5000).text


def test_prompt_without_policy_or_room():
    assert prompt.Prompt([{"role": "user", "content": "x"}], 500).text is None
    assert prompt.Prompt([{"role": "system", "content": "x" * 600}], 500).text is None
    assert prompt.Prompt([{"role": "system", "content": "x"}], 500).text.startswith("<|system_policy|>\nx\n")


def test_clip():
    clip = lambda n, both: prompt.clip(prompt.CHARACTERS, "abcdefghij" * 5, n, both)
    assert clip(50, True) == "abcdefghij" * 5 and clip(0, True) == "[CONTENT_OMITTED]"
    assert clip(24, True) == "[CONTENT_TRUNCATED]abcij" and clip(24, False) == "[CONTENT_TRUNCATED]fghij" and clip(5, False) == "[CONTENT_TRUNCATED]"


def test_structured_prompts_raise_when_strict(spark):
    rows = spark.createDataFrame([(1, [("user", "x")])], "i int, messages array<struct<role:string,content:string>>")
    with pytest.raises(Exception, match="no system policy"):
        prompt.structured_prompts(rows, 100).collect()
    assert prompt.structured_prompts(rows, 100, strict=False).first()["prompt"] is None


def test_encode_and_pad(spark):
    ids, labels = encode_left_cut(F.array(*map(F.lit, range(1, 8))), F.array(F.lit(91), F.lit(92)), 5)
    assert one(spark, ids) == [5, 6, 7, 91, 92] and one(spark, labels) == [-100, -100, -100, 91, 92]
    wide = pad(ids, labels, 7, 0)
    assert [one(spark, x) for x in wide] == [[5, 6, 7, 91, 92, 0, 0], [-100, -100, -100, 91, 92, -100, -100], [1, 1, 1, 1, 1, 0, 0]]
