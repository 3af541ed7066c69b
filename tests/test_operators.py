"""Events, selection, evaluation and reports on small literal tables."""

import itertools
import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from loomline.operators import evaluate as E, messages as M, report as R, selection as S
from loomline.sources import tables as T

MESSAGE = "trace int, idx int, role string, call struct<name:string,args:string>, error string"


def run(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], MESSAGE)


CALL_A, CALL_B = ("assistant", ("find", '{"id":1}'), None), ("assistant", ("find", '{"id":2}'), None)
ERROR, OK, USER = ("tool", None, "not_found"), ("tool", None, None), ("user", None, None)


def events(spark, *rows):
    return [(r["idx"], r["user_assisted"]) for r in M.error_events(run(spark, *rows)).orderBy("idx").collect()]


def modes(spark, *rows):
    return [r["recovery_mode"] for r in M.prior_errors(run(spark, *rows)).orderBy("idx").collect()]


def test_events(spark):
    assert events(spark, CALL_A, ERROR, ERROR, CALL_B) == [(1, False), (2, False)]
    assert events(spark, CALL_A, ERROR, USER, CALL_B) == [(1, True)]
    assert events(spark, CALL_A, ERROR, CALL_A) == [] and events(spark, ERROR, CALL_A) == [] and events(spark, CALL_A, ERROR) == []
    assert events(spark, CALL_A, ERROR, ("user", ("find", "x"), None)) == [(1, True)]


def test_prior_errors(spark):
    assert modes(spark, CALL_A, ERROR, CALL_B) == ["none", "agent_initiated"]
    assert modes(spark, CALL_A, ERROR, USER, CALL_B) == ["none", "user_assisted"]
    assert modes(spark, CALL_A, ERROR, OK, CALL_B) == ["none", "none"] and modes(spark, CALL_A, ERROR, CALL_A) == ["none", "none"]
    last = M.prior_errors(run(spark, CALL_A, ERROR, CALL_A)).orderBy("idx").collect()[-1]
    assert last["prior_error_type"] == "not_found" and last["error_type"] is None


def test_features_keep_the_largest_weight(spark):
    labels = M.prior_errors(run(spark, CALL_A, ERROR, CALL_B, ERROR, USER, CALL_A))
    got = {r["feature"]: r["weight"] for r in M.recovery_features(labels).collect()}
    assert got["mode:agent_initiated"] == 4 and got["mode:user_assisted"] == 1 and got["error:not_found"] == 2 and got["transition:find->find"] == 3
    assert got["signature:user_assisted|not_found|find|find"] == 5


def test_nested_records(spark, tmp_path):
    call = lambda name, args: {"function": {"name": name, "arguments": args}}
    traj = [{"role": "user", "content": "hi"}, {"role": "assistant", "tool_calls": [call("", "{}"), call("f", {"b": 1}), call("g", '{"c":2}')]}, {"role": "tool", "content": None, "tool_calls": None}]
    records = [{"task_id": 7, "reward": 1.0, "traj": traj}, {"task_id": 8, "reward": True, "trial": 2, "traj": []}, {"task_id": 9, "reward": 0, "traj": []}, {"task_id": 10, "traj": []}]
    (tmp_path / "gpt-retail.json").write_text(json.dumps(records))
    (tmp_path / "other.json").write_text("[]")
    rows = T.trajectories(spark, str(tmp_path))
    assert sorted(r["trace_id"] for r in rows.collect()) == ["gpt-retail:task7:trial0", "gpt-retail:task8:trial2"]
    messages = M.explode_messages(rows.select("trace_id", "traj")).withColumn("calls", M.named_calls(F.col("tool_calls")))
    got = [[(c["name"], json.loads(c["args"])) for c in r["calls"]] for r in messages.orderBy("idx").collect()]
    assert got == [[], [("f", {"b": 1}), ("g", {"c": 2})], []]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "é"), (2, "x", "b")], "id int, a string, b string")
    T.write_json_lines(rows, f"{tmp_path}/l")
    assert sorted(map(tuple, T.json_lines(spark, f"{tmp_path}/l", "id int, a string, b string").collect()), key=str) == [(1, None, "é"), (2, "x", "b")]
    T.write_document(spark, {"k": [1, "é"]}, f"{tmp_path}/d")
    assert T.json_document(spark, f"{tmp_path}/d") == {"k": [1, "é"]}
    T.write_csv(rows, f"{tmp_path}/c", ["b", "id"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["b", "id"]
    first = T.append_new(rows, f"{tmp_path}/log", "id", None)
    assert first.count() == 2 and T.append_new(rows, f"{tmp_path}/log2", "id", spark.createDataFrame([(1,)], "id int")).count() == 1
    (tmp_path / "ad").mkdir()
    (tmp_path / "ad" / "adapter_config.json").write_text("{}")
    assert T.checkpoint_fingerprint(spark, None) == "base_model"
    with pytest.raises(FileNotFoundError):
        T.checkpoint_fingerprint(spark, f"{tmp_path}/ad")
    (tmp_path / "ad" / "adapter_model.safetensors").write_bytes(b"x")
    assert len(T.checkpoint_fingerprint(spark, f"{tmp_path}/ad")) == 64
    digests = [sorted(map(tuple, T.file_digests(spark, f"{tmp_path}/ad/*", whole).collect())) for whole in (0, 100)]
    assert digests[0] == digests[1] and len(digests[0]) == 2
    again = T.append_new(rows.union(rows), f"{tmp_path}/log3", "id", None)
    assert again.count() == 2


def test_row_set_digest_ignores_order(spark):
    rows = spark.createDataFrame([(1, "a", "g"), (2, None, "g"), (2, "b", "h")], "i int, t string, g string")
    a = {r["g"]: r["rows_sha256"] for r in T.row_set_digest(rows, ["i", "t"], "g").collect()}
    b = {r["g"]: r["rows_sha256"] for r in T.row_set_digest(rows.orderBy(F.desc("i")).repartition(3), ["i", "t"], "g").collect()}
    assert a == b and a["g"] != a["h"]


def test_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame([("b", "s", 1), ("a", "s", 2), ("a", "t", 3)], "k string, sig string, v int")
    assert sorted(map(tuple, M.first_of_each(rows, ["sig"], ["k"]).collect())) == [("a", "s", 2), ("a", "t", 3)]


def test_split_shares_and_parity(spark):
    rows = spark.createDataFrame([(f"t:{i % 5}",) for i in range(20)], "task_key string")
    for how in ("hash", "mersenne"):
        got = {r["task_key"]: r["split"] for r in S.task_split(rows, shuffle=how).collect()}
        assert sorted(got.values()) == ["test", "train", "train", "train", "train"] and len(got) == 5
    names = sorted(f"t:{i}" for i in range(5))
    random.Random(S.SEED).shuffle(names)
    assert got[names[4]] == "test"
    selected = spark.createDataFrame([(n,) for n in names], "task_key string")
    assert [r["task_key"] for r in S.leaks(selected, S.task_split(rows, shuffle="mersenne")).collect()] == [names[4]]


def greedy(costs, budget):
    used, taken = 0, []
    for i, c in costs:
        if used + c <= budget:
            used += c
            taken.append(i)
    return taken


def test_greedy_fill_skips_and_goes_on(spark):
    r = random.Random(4)
    rows = [(g, f"k{i:03d}", r.randint(1, 60)) for g in "xyz" for i in range(80)] + [("w", "a", 6), ("w", "b", 5), ("w", "c", 4)]
    df = spark.createDataFrame(rows, "g string, k string, cost long")
    budgets = spark.createDataFrame([("x", 700), ("y", 31), ("z", 0), ("w", 10)], "g string, budget long")
    got = S.greedy_fill(df, ["k"], "cost", budgets, "g").collect()
    for g, b in (("x", 700), ("y", 31), ("z", 0), ("w", 10)):
        assert sorted(r["k"] for r in got if r["g"] == g) == greedy([(k, c) for h, k, c in rows if h == g], b)


def test_length_cuts(spark):
    costs = [5, 1, 9, 9, 3, 7, 2]
    df = spark.createDataFrame([("g", c) for c in costs], "g string, cost int")
    cuts = S.length_cuts(df, "cost", ["g"]).first()["cuts"]
    assert cuts == [sorted(costs)[(len(costs) - 1) * q // 5] for q in range(1, 5)]


def test_best_subset():
    assert S.best_subset([9, 4, 6, 11], 20) == [0, 3] and S.best_subset([3, 3, 6, 6], 9) == [1, 3] and S.best_subset([5], 4) == [] and S.best_subset([], 3) == []
    r = random.Random(1)
    for _ in range(60):
        costs, cap = [r.randint(1, 30) for _ in range(r.randint(0, 8))], r.randint(0, 70)
        best = max(sum(c) for n in range(len(costs) + 1) for c in itertools.combinations(costs, n) if sum(c) <= cap)
        chosen = S.best_subset(costs, cap)
        assert sorted(set(chosen)) == chosen and sum(costs[i] for i in chosen) == best
        # Of the best subsets the one whose last candidates are the latest.
        equal = [c for n in range(len(costs) + 1) for c in itertools.combinations(range(len(costs)), n) if sum(costs[i] for i in c) == best]
        assert tuple(chosen) == max(equal, key=lambda c: c[::-1])


def test_best_subset_of_equal_costs():
    # Runs of equal costs, over whose sums one pass goes, against a table of which sums candidates up to each one make.
    r = random.Random(2)
    for _ in range(60):
        costs = [c for _ in range(r.randint(1, 6)) for c in [r.randint(1, 40) * r.choice([1, 1, 3])] * r.randint(1, 40)]
        cap = r.randint(1, sum(costs))
        made = [{0}]
        for c in costs:
            made.append(made[-1] | {s + c for s in made[-1] if s + c <= cap})
        rest, want = max(made[-1]), []
        for place in range(len(costs) - 1, -1, -1):
            if rest - costs[place] in made[place]:
                want.append(place)
                rest -= costs[place]
        assert S.best_subset(costs, cap) == want[::-1]


@pytest.mark.parametrize("ordered", [False, True])
def test_best_subset_of_many_candidates(ordered):
    # Work isn't candidates times capacity, which are 9e10 here.
    r = random.Random(4)
    costs = [int(r.lognormvariate(5.5, 1)) + 1 for _ in range(60000)]
    costs, cap, began = sorted(costs) if ordered else costs, 1_500_000, time.process_time()
    assert sum(costs[i] for i in S.best_subset(costs, cap)) == cap
    assert time.process_time() - began < 20


def test_coverage_order_is_greedy():
    r = random.Random(7)
    for _ in range(20):
        n = r.randint(1, 25)
        keys, costs = [f"k{i}" for i in range(n)], [r.randint(1, 9) for _ in range(n)]
        features = [{f"f{r.randint(0, 5)}": float(r.randint(1, 5)) for _ in range(r.randint(0, 3))} for _ in range(n)]
        seen, left, want = {}, set(range(n)), []
        while left:
            gain = lambda i: sum(w * (math.sqrt(seen.get(f, 0) + 1) - math.sqrt(seen.get(f, 0))) for f, w in features[i].items()) / costs[i]
            best = max(left, key=lambda i: (gain(i), -costs[i], keys[i]))
            left.remove(best)
            want.append(best)
            for f in features[best]:
                seen[f] = seen.get(f, 0) + 1
        assert S.coverage_order(keys, costs, features) == want


def test_coverage_order_of_rows_alike():
    # Rows of equal features gain alike and needn't be refreshed one by one.
    r = random.Random(8)
    n = 60000
    keys, costs = [f"k{i:05d}" for i in range(n)], [int(r.lognormvariate(5.5, 1)) + 1 for _ in range(n)]
    features = [{f"source:{i % 4}": 2.0, f"mode:{i % 7 == 0}": 5.0 if i % 7 == 0 else 1.0} for i in range(n)]
    began = time.process_time()
    order = S.coverage_order(keys, costs, features)
    assert time.process_time() - began < 10
    assert sorted(order) == list(range(n))
    for source in range(4):
        alike = [i for i in order if i % 4 == source and i % 7]
        assert alike == sorted(sorted(alike, reverse=True), key=costs.__getitem__)


def test_equal_selection(spark):
    r = random.Random(3)
    rows = [(s, f"{s}{i:03d}", r.randint(20, 90), {f"f{r.randint(0, 4)}": 2.0}) for s in "ab" for i in range(60)]
    got = S.equal_selection(spark.createDataFrame(rows, "source string, key string, cost long, features map<string,double>")).collect()
    for s in "ab":
        totals = {a: sum(r["cost"] for r in got if (r["source"], r["arm"]) == (s, a)) for a in S.ARMS}
        assert len(set(totals.values())) == 1 and 0 < totals["random_success"] <= 0.3 * sum(x[2] for x in rows if x[0] == s) + 1
    assert len({(r["arm"], r["key"]) for r in got}) == len(got)


def test_schedule(spark):
    df = spark.createDataFrame([("a", f"e{i}") for i in range(5)] + [("b", "x")], "arm string, id string")
    got = S.schedule(df, "id", "arm", 12).orderBy("arm", "schedule_index").collect()
    a = [r for r in got if r["arm"] == "a"]
    assert [r["schedule_index"] for r in a] == list(range(12)) and [r["schedule_pass"] for r in a] == [0] * 5 + [1] * 5 + [2] * 2
    assert len({r["id"] for r in a[:5]}) == 5 and sum(r["arm"] == "b" for r in got) == 12


def test_metrics_of_empty_groups(spark):
    rows = [("t1", "none", "f", "{}", "f", "{}"), ("t1", "none", None, None, "f", "{}"), ("t2", "user_assisted", "f", "[]", "f", "{}")]
    scored = E.score(spark.createDataFrame(rows, "task_key string, recovery_mode string, pred_name string, pred_args string, name string, args string"))
    got = {(r["group"], r["metric"]): r for r in E.group_metrics(scored).collect()}
    assert got["overall", "json_valid"]["micro"] == pytest.approx(2 / 3) and got["overall", "json_valid"]["task_macro"] == 0.75
    assert got["agent_initiated", "json_valid"]["examples"] == 0 and got["agent_initiated", "json_valid"]["micro"] is None
    assert got["recovery", "arguments_exact"]["micro"] == 0 and got["recovery", "tool_name_correct"]["micro"] == 1


def test_bootstrap_contains_the_mean(spark):
    r = random.Random(9)
    rows = [(f"t{i % 20}", r.random() < 0.6) for i in range(400)]
    df = spark.createDataFrame(rows, "task_key string, hit boolean")
    ci = E.cluster_bootstrap(df, metrics=["hit"], samples=300).first()
    assert ci["ci_low"] < sum(h for _, h in rows) / 400 < ci["ci_high"]
    assert tuple(E.cluster_bootstrap(df.repartition(3), metrics=["hit"], samples=300).first()) == tuple(ci)


def test_resume_and_latest(spark):
    done = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "example_id string, pos int, out string")
    assert [r["example_id"] for r in E.resume(spark.createDataFrame([("a",), ("b",)], "example_id string"), done).collect()] == ["b"]
    assert E.latest(done, "example_id", "pos").first()["out"] == "new"


def test_reports(spark):
    rows = spark.createDataFrame([("a", 0.5, 0.25, 0.75), ("b", None, None, None)], "arm string, x double, lo double, hi double")
    shown = rows.select("arm", R.percent(F.col("x")).alias("x"), R.interval(F.col("lo"), F.col("hi")).alias("ci")).orderBy("arm")
    assert R.markdown(shown, ["arm", "x", "ci"])[2:] == ["| a | 50.00% | [25.00, 75.00] |", "| b | — | — |"]
    with pytest.raises(Exception, match="too large"):
        R.require(rows, F.col("x") < 0.1, "too large").collect()
    assert [r["equal"] for r in R.spread(rows.fillna(0.5), [], "x").collect()] == [True]
