"""The registered queries over the flat tables, with their SQL counterparts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import calls as C
from ..functions.batches import encode_left_cut, pad
from ..functions.errors import classify_error
from ..functions.prompt import structured_prompts
from ..functions.text import compact_history, render
from ..operators import contracts as K, evaluate as E, messages as M, report as R, selection as S
from ..operators.lineage import cut, new_folder
from ..sources.tables import append_new, json_lines, row_set_digest, table, trajectories, write_csv, write_json_lines
from .bindings import MESSAGES_SQL, ORDER, POOL_SQL, SPLIT_SQL, TRACES_SQL, messages, traces

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- events, calls and labels -----------------------------------------------------------


def _events(spark, d):
    return M.error_events(messages(spark, d), ORDER)


def _labels(spark, d):
    return M.prior_errors(messages(spark, d), ORDER)


@query(f"WITH {MESSAGES_SQL} SELECT trace, event_id, error_type, failed_tool, repair_tool, user_assisted FROM ev")
def event_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).drop("ts")


@query(f"WITH {MESSAGES_SQL} SELECT error_type, user_assisted, count(*) AS n FROM ev GROUP BY ALL")
def event_counts_by_type(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("error_type", "user_assisted").agg(F.count("*").alias("n"))


@query(f"WITH {MESSAGES_SQL} SELECT failed_tool, repair_tool, count(*) AS n, count(DISTINCT trace) AS traces FROM ev GROUP BY ALL")
def repair_transitions(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("failed_tool", "repair_tool").agg(F.count("*").alias("n"), F.countDistinct("trace").alias("traces"))


@query(f"WITH {MESSAGES_SQL} SELECT trace, count(*) AS n_events, CAST(sum(user_assisted::INT) AS BIGINT) AS user_assisted, count(DISTINCT error_type) AS error_types FROM ev GROUP BY trace")
def user_assisted_split(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("trace").agg(F.count("*").alias("n_events"), F.sum(F.col("user_assisted").cast("long")).alias("user_assisted"), F.countDistinct("error_type").alias("error_types"))


@query(f"WITH {MESSAGES_SQL} SELECT trace, event_id, target_tool, recovery_mode, error_type, failed_tool, repair_tool FROM lab")
def prior_recovery_mode(spark, sf_dir):
    return _labels(spark, sf_dir).drop("ts", "prior_error_type")


@query(f"WITH {MESSAGES_SQL} SELECT trace, event_id, target_tool, prior_error_type, prior_error_type IS NOT NULL AS is_error_resolution_target FROM lab")
def prior_tool_error(spark, sf_dir):
    return _labels(spark, sf_dir).select("trace", "event_id", "target_tool", "prior_error_type", F.col("prior_error_type").isNotNull().alias("is_error_resolution_target"))


_FEATURES_SQL = f"""WITH {MESSAGES_SQL}, f AS (
  SELECT trace, unnest([
    {{'feature': 'mode:' || recovery_mode, 'weight': CASE recovery_mode WHEN 'agent_initiated' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END}},
    {{'feature': 'error:' || error_type, 'weight': 2.0::DOUBLE}},
    {{'feature': 'transition:' || failed_tool || '->' || repair_tool, 'weight': 3.0::DOUBLE}},
    {{'feature': 'signature:' || recovery_mode || '|' || error_type || '|' || failed_tool || '|' || repair_tool, 'weight': 5.0::DOUBLE}}]) AS x
  FROM lab WHERE recovery_mode <> 'none')"""


@query(_FEATURES_SQL + " SELECT trace, x.feature AS feature, max(x.weight) AS weight FROM f GROUP BY ALL")
def recovery_features(spark, sf_dir):
    return M.recovery_features(_labels(spark, sf_dir))


@query(f"""WITH {MESSAGES_SQL}, p AS (SELECT counter, value, count(*) AS n FROM (SELECT unnest(['error_type', 'failed_tool', 'repair_tool']) AS counter, unnest([error_type, failed_tool, repair_tool]) AS value FROM ev) GROUP BY ALL)
SELECT counter, string_agg(value || '=' || n, ';' ORDER BY value) AS counts FROM p GROUP BY counter""")
def event_counters(spark, sf_dir):
    counts = R.counters(_events(spark, sf_dir), [], ["error_type", "failed_tool", "repair_tool"])
    return counts.select("counter", R.counter_text(F.col("counts")).alias("counts"))


@query(f"WITH {MESSAGES_SQL} SELECT trace, string_agg(call_name, '>' ORDER BY idx) AS tools, count(*) AS n_calls FROM m WHERE call IS NOT NULL GROUP BY trace")
def call_sequences(spark, sf_dir):
    made = messages(spark, sf_dir).where("call IS NOT NULL").groupBy("trace").agg(F.array_sort(F.collect_list(F.struct(*ORDER, F.col("call.name").alias("name")))).alias("x"))
    return made.select("trace", F.array_join(F.col("x.name"), ">").alias("tools"), F.size("x").cast("long").alias("n_calls"))


# --- literal inputs -----------------------------------------------------------------------

_ERROR_TEXTS = ["Error: item not found", "Error - boom", "missing field", "already booked", "user does not exist", "FORBIDDEN", "all good", "", "  error : x", "invalid and unknown", "not available"]
_ERROR_NAMES = ["not_found", "generic_error", "invalid_argument", "conflict", "not_found", "unauthorized", None, None, "generic_error", "not_found", "conflict"]


def _literal(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _sql_text(x):
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _sql_list(texts):
    return "[" + ", ".join(map(_sql_text, texts)) + "]"


def _values_sql(columns, rows):
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(str(x) if isinstance(x, int) else _sql_text(x) for x in r) + ')' for r in rows)}) v({', '.join(columns)})"


_RULE = r"""SELECT i, CASE WHEN regexp_matches(text, '\b(not found|does not exist|unknown)\b', 'i') THEN 'not_found'
  WHEN regexp_matches(text, '\b(invalid|malformed|incorrect|must provide|missing)\b', 'i') THEN 'invalid_argument'
  WHEN regexp_matches(text, '\b(unauthorized|forbidden|not permitted)\b', 'i') THEN 'unauthorized'
  WHEN regexp_matches(text, '\b(conflict|already|not available)\b', 'i') THEN 'conflict'
  WHEN regexp_matches(text, '^\s*error\s*[:\-]', 'i') THEN 'generic_error' END AS error_type"""


@query(f"{_RULE} FROM ({_values_sql(['i', 'text'], list(enumerate(_ERROR_TEXTS)))})")
def error_rules_literal(spark, sf_dir):
    return _literal(spark, list(enumerate(_ERROR_TEXTS)), "i int, text string").select("i", classify_error(F.col("text")).alias("error_type"))


_ARGS = [
    ('{"b": 1, "a": "5"}', '{"a":"5","b":1}', '{"a":5,"b":1}'),
    ("not  json\n\there ", "not json here", '"not json here"'),
    ('{"x": "{\\"y\\": [1, \\"2\\"]}"}', '{"x":"{\\"y\\": [1, \\"2\\"]}"}', '{"x":{"y":[1,2]}}'),
    ("1.0", "1.0", "1.0"),
    ('"123"', '"123"', '"123"'),
    ('{"k": "true", "é": null}', '{"k":"true","é":null}', '{"k":true,"é":null}'),
    ("{}", "{}", "{}"),
]


@query(_values_sql(["i", "shallow", "deep"], [(i, s, d) for i, (_, s, d) in enumerate(_ARGS)]))
def canonical_args(spark, sf_dir):
    rows = _literal(spark, [(i, a) for i, (a, _, _) in enumerate(_ARGS)], "i int, args string")
    return rows.select("i", C.canonical_args("args").alias("shallow"), C.canonical_args_deep("args").alias("deep"))


_TEXTS = [
    ('sure: {"name": "find", "arguments": "{\\"id\\": \\"5\\"}"} done', "find", '"{\\"id\\": \\"5\\"}"', "find", '{"id":5}'),
    ('{"call": {"name": "x", "arguments": {}}}', None, None, "x", "{}"),
    ('{"name": "only"}', "only", "null", None, None),
    ("no call", None, None, None, None),
    ('{bad {"name": "y", "arguments": [1, "2"]}', None, None, "y", "[1,2]"),
]


@query(_values_sql(["i", "greedy_name", "greedy_args", "name", "args"], [(i, *r[1:]) for i, r in enumerate(_TEXTS)]))
def parse_call(spark, sf_dir):
    rows = _literal(spark, [(i, r[0]) for i, r in enumerate(_TEXTS)], "i int, text string")
    rows = rows.select("i", C.parse_call_greedy("text").alias("g"), C.parse_call("text").alias("p"))
    return rows.select("i", F.col("g.name").alias("greedy_name"), F.col("g.args").alias("greedy_args"), "p.name", "p.args")


# --- the same functions on tables -----------------------------------------------------------

_OPENINGS = ["Error: ", "item not found: ", "Missing field ", "already booked ", "error - ", "all good ", "Forbidden: ", "unknown, invalid "]


def _said(spark, d):
    """A tool's text for every event: an opening by the event's number, its type and properties."""
    opening = F.element_at(F.array(*map(F.lit, _OPENINGS)), (F.col("event_id") % len(_OPENINGS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", "event_type", "props", F.concat(opening, "event_type", F.lit(" "), "props").alias("text"))


_SAID_SQL = f"SELECT event_id AS i, ({_sql_list(_OPENINGS)})[event_id % {len(_OPENINGS)} + 1] || event_type || ' ' || props AS text FROM events"


@query(f"SELECT error_type, count(*) AS n, min(i) AS first FROM ({_RULE} FROM ({_SAID_SQL})) GROUP BY error_type")
def error_rules(spark, sf_dir):
    rows = _said(spark, sf_dir).select("event_id", classify_error(F.col("text")).alias("error_type"))
    return rows.groupBy("error_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("""SELECT event_id, replace(props, ' ', '') AS shallow, '{"args":' || replace(props, ' ', '') || ',"type":"' || event_type || '"}' AS deep FROM events""")
def canonical_event_args(spark, sf_dir):
    nested = F.to_json(F.struct("event_type", "props"))
    nested = F.regexp_replace(F.regexp_replace(nested, '^\\{"event_type"', '{"type"'), '"props"', '"args"')
    rows = table(spark, sf_dir, "events").select("event_id", "props", nested.alias("nested"))
    return rows.select("event_id", C.canonical_args("props").alias("shallow"), C.canonical_args_deep("nested").alias("deep"))


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS name, CASE WHEN event_id % 3 > 0 THEN replace(props, ' ', '') END AS args FROM events""")
def parse_event_calls(spark, sf_dir):
    call = F.concat(F.lit('{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("no call in {"), "props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("I'll do {x: "), call, F.lit(" now"))).otherwise(call)
    rows = table(spark, sf_dir, "events").select("event_id", C.parse_call(text).alias("p"))
    return rows.select("event_id", "p.name", "p.args")


# --- files, written and read again -----------------------------------------------------------


@query("SELECT 'retail:' || conv_id AS task_key, CAST(conv_id % 3 AS INT) AS trial, count(*) AS messages, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM conversations WHERE conv_id % 2 = 1 GROUP BY conv_id")
def trajectory_files(spark, sf_dir):
    # Files of JSON arrays with 64 conversations each, of which every other one is a success.
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(said, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("traj"))
    record = F.struct(F.col("conv_id").alias("task_id"), (F.col("conv_id") % 2).alias("reward"), (F.col("conv_id") % 3).alias("trial"), "traj")
    files = whole.groupBy(F.floor(F.col("conv_id") / 64).alias("file")).agg(F.to_json(F.collect_list(record)).alias("value"))
    folder = new_folder(spark)
    files.write.partitionBy("file").text(folder)
    rows = trajectories(spark, folder, "*.txt")
    chars = F.aggregate("traj", F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))
    return rows.select("task_key", "trial", F.size("traj").cast("long").alias("messages"), chars.alias("chars"))


@query("SELECT doc_id, quality, toxic FROM labels")
def json_lines_files(spark, sf_dir):
    folder, rows = new_folder(spark), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    write_json_lines(rows, folder)
    return json_lines(spark, folder, "doc_id long, quality long, toxic long")


@query(f"WITH {MESSAGES_SQL} SELECT error_type, count(*) AS n, round_even(count(*) * 100.0 / (SELECT count(*) FROM ev), 2) AS share FROM ev GROUP BY error_type")
def report_files(spark, sf_dir):
    folder, rows = new_folder(spark), _events(spark, sf_dir).groupBy("error_type").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("all"))
    write_csv(rows.crossJoin(total).select("error_type", "n", F.bround(F.col("n") * 100.0 / F.col("all"), 2).alias("share")), folder, ["error_type", "n", "share"])
    return spark.read.option("header", True).schema("error_type string, n long, share double").csv(folder)


@query("SELECT event_id, event_type FROM events")
def append_log(spark, sf_dir):
    folder, rows = new_folder(spark), table(spark, sf_dir, "events").select("event_id", "event_type")
    schema = "event_id long, event_type string"
    append_new(rows.where("event_id % 2 = 0"), folder, "event_id", None)
    append_new(rows, folder, "event_id", json_lines(spark, folder, schema))
    return json_lines(spark, folder, schema)


# --- traces: success, dedup, split, cost -----------------------------------------------------


def _deduped(spark, d):
    """The first successful trace of each text, without the text."""
    return M.first_of_each(traces(spark, d).where("reward = 1").drop("text"), ["signature"], ["task_key", "source", "trace_id"])


def _split(spark, d):
    return S.task_split(traces(spark, d))


def _pool(spark, d):
    return _deduped(spark, d).join(_split(spark, d).where("split = 'train'").select("task_key"), "task_key", "left_semi")


def _budgets(pool):
    return pool.groupBy("lang").agg(F.floor(F.lit(0.3) * F.sum("cost")).cast("long").alias("budget"))


_T = f"WITH {TRACES_SQL}"
_P = f"WITH {TRACES_SQL}, {SPLIT_SQL}, {POOL_SQL}"


@query(_T + ", x AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY task_key, source, trace_id) AS rn FROM t WHERE reward = 1) SELECT trace_id, task_key, source, cost FROM x WHERE rn = 1")
def success_dedup_global(spark, sf_dir):
    return _deduped(spark, sf_dir).select("trace_id", "task_key", "source", "cost")


@query(_T + ", x AS (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY task_key, trace_id) AS rn FROM t WHERE reward = 1) SELECT trace_id, task_key, source, cost FROM x WHERE rn = 1")
def success_dedup_by_source(spark, sf_dir):
    return M.first_of_each(traces(spark, sf_dir).where("reward = 1"), ["source", "text"], ["task_key", "trace_id"]).select("trace_id", "task_key", "source", "cost")


@query(f"{_T}, {SPLIT_SQL} SELECT task_key, split FROM split")
def task_split(spark, sf_dir):
    return _split(spark, sf_dir)


@query(f"{_T}, {SPLIT_SQL} SELECT split, count(DISTINCT task_key) AS tasks, count(*) AS traces, CAST(sum(cost) AS BIGINT) AS tokens FROM t JOIN split USING (task_key) GROUP BY split")
def split_counts(spark, sf_dir):
    rows = traces(spark, sf_dir).join(_split(spark, sf_dir), "task_key")
    return rows.groupBy("split").agg(F.countDistinct("task_key").alias("tasks"), F.count("*").alias("traces"), F.sum("cost").alias("tokens"))


@query(f"{_P} SELECT count(*) AS leaked FROM pool WHERE task_key NOT IN (SELECT task_key FROM split WHERE split = 'train')")
def split_leakage(spark, sf_dir):
    return S.leaks(_pool(spark, sf_dir), _split(spark, sf_dir)).agg(F.count("*").alias("leaked"))


@query(_T + " SELECT trace_id, lang, cost FROM t")
def token_cost(spark, sf_dir):
    return traces(spark, sf_dir).select("trace_id", "lang", "cost")


@query(_P + " SELECT lang, budget FROM budget")
def budget_by_source(spark, sf_dir):
    return _budgets(_pool(spark, sf_dir))


_CUTS_SQL = """s AS (SELECT lang, list(cost ORDER BY cost) AS xs FROM pool GROUP BY lang),
c AS (SELECT lang, unnest([1, 2, 3, 4]) AS q, xs FROM s), cuts AS (SELECT lang, q, xs[CAST(floor((len(xs) - 1) * q / 5.0) AS BIGINT) + 1] AS cut FROM c)"""


@query(f"{_P}, {_CUTS_SQL} SELECT lang, q, cut FROM cuts")
def length_quintile_cuts(spark, sf_dir):
    cuts = S.length_cuts(_pool(spark, sf_dir), "cost", ["lang"])
    return cuts.select("lang", F.posexplode("cuts").alias("q", "cut")).select("lang", (F.col("q") + 1).alias("q"), "cut")


@query(f"{_P}, {_CUTS_SQL}, b AS (SELECT p.trace_id, p.lang, (SELECT CAST(count(*) AS BIGINT) FROM cuts WHERE cuts.lang = p.lang AND cut < p.cost) AS bucket FROM pool p) SELECT lang, bucket, count(*) AS n FROM b GROUP BY ALL")
def length_bucket_counts(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    rows = pool.join(F.broadcast(S.length_cuts(pool, "cost", ["lang"])), "lang")
    return rows.groupBy("lang", S.length_bucket(F.col("cost"), F.col("cuts")).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


# --- arms -------------------------------------------------------------------------------------


def _fill_sql(rows, order, budget, name):
    """CTE of the trace ids that a greedy fill takes from rows (lang, trace_id, cost) in order."""
    return f"""{name}_l AS (SELECT lang, list({{'id': trace_id, 'cost': cost}} ORDER BY {order}) AS xs FROM {rows} GROUP BY lang),
{name}_r AS (SELECT lang, list_reduce(xs, lambda a, x: CASE WHEN a.used + x.cost <= budget THEN {{'used': a.used + x.cost, 'ids': list_append(a.ids, x.id), 'cost': 0::BIGINT, 'id': ''}} ELSE a END,
  {{'used': 0::BIGINT, 'ids': []::VARCHAR[], 'cost': 0::BIGINT, 'id': ''}}) AS s FROM (SELECT l.lang, list_transform(xs, lambda x: {{'used': 0::BIGINT, 'ids': []::VARCHAR[], 'cost': x.cost, 'id': x.id}}) AS xs, budget FROM {name}_l l JOIN {budget} b ON l.lang = b.lang)),
{name} AS (SELECT lang, unnest(s.ids) AS trace_id FROM {name}_r)"""


_RANDOM_SQL = _fill_sql("pool", "sha256('20260722:random:' || trace_id), trace_id", "budget", "arm_r")
_SHORT_SQL = _fill_sql("pool", "cost, trace_id", "budget", "arm_s")
_BALANCED_SQL = f"""{_CUTS_SQL}, pb AS (SELECT p.*, (SELECT count(*) FROM cuts WHERE cuts.lang = p.lang AND cut < p.cost) AS bucket FROM pool p),
pos AS (SELECT * FROM pb WHERE recovery = 1), b1 AS (SELECT lang, CAST(floor(budget * 0.3) AS BIGINT) AS budget FROM budget),
{_fill_sql("pos", "sha256('20260722:positive:' || trace_id), trace_id", "b1", "lead")},
spent AS (SELECT p.lang, CAST(sum(cost) AS BIGINT) AS spent FROM pool p JOIN lead USING (trace_id) GROUP BY p.lang),
b2 AS (SELECT budget.lang, budget - coalesce(spent, 0) AS budget FROM budget LEFT JOIN spent ON budget.lang = spent.lang),
rest AS (SELECT *, row_number() OVER (PARTITION BY lang, bucket ORDER BY sha256('20260722:rest:' || trace_id), trace_id) * 5 + bucket AS o FROM pb WHERE trace_id NOT IN (SELECT trace_id FROM lead)),
{_fill_sql("rest", "o, trace_id", "b2", "more")},
arm_b AS (SELECT lang, trace_id, 1 AS phase FROM lead UNION ALL SELECT lang, trace_id, 2 AS phase FROM more)"""


def _arm(spark, d, arm):
    pool = cut(_pool(spark, d))
    budgets = cut(_budgets(pool))
    if arm == "random":
        return S.greedy_fill(pool.withColumn("o", S.hash_order(F.col("trace_id"), "random")), ["o", "trace_id"], "cost", budgets, "lang").drop("o")
    if arm == "shortest":
        return S.greedy_fill(pool, ["cost", "trace_id"], "cost", budgets, "lang", F.struct("cost", F.substring("trace_id", 1, 7)))
    return S.balanced(pool, "trace_id", "cost", "recovery", "lang", budgets)


@query(f"{_P}, {_RANDOM_SQL} SELECT lang, trace_id FROM arm_r")
def arm_random(spark, sf_dir):
    return _arm(spark, sf_dir, "random").select("lang", "trace_id")


@query(f"{_P}, {_SHORT_SQL} SELECT lang, trace_id FROM arm_s")
def arm_shortest(spark, sf_dir):
    return _arm(spark, sf_dir, "shortest").select("lang", "trace_id")


@query(f"{_P}, {_BALANCED_SQL} SELECT lang, trace_id, phase FROM arm_b")
def arm_balanced(spark, sf_dir):
    return _arm(spark, sf_dir, "balanced").select("lang", "trace_id", "phase")


_USERS = 150  # a trace's events are those of the user with its number modulo this


@query(f"""{_P}, {_RANDOM_SQL}, {_SHORT_SQL}, {_BALANCED_SQL}, {MESSAGES_SQL},
arms AS (SELECT 'random_success' AS method, trace_id FROM arm_r UNION ALL SELECT 'shortest_success', trace_id FROM arm_s UNION ALL SELECT 'recovery_balanced', trace_id FROM arm_b),
tr AS (SELECT method, pool.*, CAST(substr(trace_id, 2) AS BIGINT) % {_USERS} AS usr FROM arms JOIN pool USING (trace_id)),
pe AS (SELECT trace AS usr, count(*) AS n, sum(user_assisted::INT) AS ua FROM ev GROUP BY trace),
tl AS (SELECT trace AS usr, string_agg(call_name, '>' ORDER BY idx) AS tools FROM m WHERE call IS NOT NULL GROUP BY trace),
one AS (SELECT method, CAST(sum(cost) AS BIGINT) AS estimated_tokens, count(*) AS traces, count(DISTINCT task_key) AS unique_tasks, round_even(sum(cost) / CAST(count(*) AS DOUBLE), 1) AS mean_trace_tokens,
  count(*) FILTER (coalesce(n, 0) > 0) AS recovery_traces, CAST(coalesce(sum(n), 0) AS BIGINT) AS recovery_events, CAST(coalesce(sum(n - ua), 0) AS BIGINT) AS agent_initiated_events, CAST(coalesce(sum(ua), 0) AS BIGINT) AS user_assisted_events,
  count(DISTINCT coalesce(tools, '')) AS tool_sequences FROM tr LEFT JOIN pe USING (usr) LEFT JOIN tl USING (usr) GROUP BY method),
ty AS (SELECT method, count(DISTINCT error_type) AS error_types FROM (SELECT DISTINCT method, usr FROM tr) JOIN ev ON ev.trace = usr GROUP BY method),
tn AS (SELECT method, count(DISTINCT call_name) AS tools FROM (SELECT DISTINCT method, usr FROM tr) JOIN m ON m.trace = usr WHERE call IS NOT NULL GROUP BY method)
SELECT one.*, coalesce(error_types, 0) AS error_types, coalesce(tools, 0) AS tools FROM one LEFT JOIN ty USING (method) LEFT JOIN tn USING (method)""")
def arm_stats_v1(spark, sf_dir):
    arms = None
    for arm, name in {"random": "random_success", "shortest": "shortest_success", "balanced": "recovery_balanced"}.items():
        rows = _arm(spark, sf_dir, arm).select(F.lit(name).alias("method"), "cost", "task_key", (F.substring("trace_id", 2, 9).cast("long") % _USERS).alias("trace"))
        arms = rows if arms is None else arms.unionByName(rows)
    made = messages(spark, sf_dir).where("call IS NOT NULL").select("trace", *ORDER, F.col("call.name").alias("tool"))
    return R.arm_statistics(arms, _events(spark, sf_dir), made, ORDER)


@query(f"""{_P}, {_BALANCED_SQL}, p AS (
SELECT lang, counter, value, count(*) AS n FROM (SELECT pool.lang AS lang, unnest(['source', 'recovery']) AS counter, unnest([source, CAST(recovery AS VARCHAR)]) AS value FROM arm_b JOIN pool USING (trace_id)) GROUP BY ALL)
SELECT lang, counter, string_agg(value || '=' || n, ';' ORDER BY value) AS counts FROM p GROUP BY lang, counter""")
def arm_audit(spark, sf_dir):
    rows = _arm(spark, sf_dir, "balanced").withColumn("recovery", F.col("recovery").cast("string"))
    counts = R.counters(rows, ["lang"], ["source", "recovery"])
    return counts.select("lang", "counter", R.counter_text(F.col("counts")).alias("counts"))


@query(f"""{_P}, {_RANDOM_SQL}, man AS (SELECT trace_id, row_number() OVER (ORDER BY trace_id) AS pos FROM arm_r)
SELECT pos, trace_id, pool.task_key, cost FROM man JOIN pool USING (trace_id)""")
def manifest_join(spark, sf_dir):
    listed = K.manifest(K.distinct_ids(_arm(spark, sf_dir, "random"), ["trace_id"]), "trace_id")
    return K.manifest_rows(listed, _pool(spark, sf_dir), "trace_id").select("pos", "trace_id", "task_key", "cost")


@query(f"{_P}, {_RANDOM_SQL}, {_SHORT_SQL}, a AS (SELECT trace_id FROM arm_r UNION ALL SELECT trace_id FROM arm_s) SELECT trace_id, count(*) AS n FROM a GROUP BY trace_id HAVING count(*) > 1")
def selected_twice(spark, sf_dir):
    both = _arm(spark, sf_dir, "random").select("trace_id").unionByName(_arm(spark, sf_dir, "shortest").select("trace_id"))
    return K.repeated(both, ["trace_id"])


def _sources(spark, d):
    """Traces of the training pool as (source, key, cost, features)."""
    features = F.create_map(F.concat(F.lit("source:"), "source"), F.lit(2.0), F.concat(F.lit("mode:"), "recovery", F.lit(":"), "source"), F.when(F.col("recovery") == 1, 5.0).otherwise(1.0))
    return _pool(spark, d).select(F.col("lang").alias("source"), F.col("trace_id").alias("key"), "cost", features.alias("features"))


@query()
def arm_coverage_order(spark, sf_dir):
    return S.coverage_ranks(_sources(spark, sf_dir))


@query()
def equal_budget_selection(spark, sf_dir):
    return S.equal_selection(_sources(spark, sf_dir))


@query(f"{_P} SELECT lang AS source, true AS equal, true AS within, CAST(3 AS BIGINT) AS arms, CAST(round_even(0.3 * sum(cost), 0) AS BIGINT) AS quota FROM pool GROUP BY lang")
def equal_budget_invariant(spark, sf_dir):
    rows = cut(_sources(spark, sf_dir))
    totals = S.equal_selection(rows).groupBy("source", "arm").agg(F.sum("cost").alias("tokens"))
    by_source = totals.groupBy("source").agg(F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.count("*").alias("arms"))
    quotas = rows.groupBy("source").agg(F.bround(F.lit(0.3) * F.sum("cost"), 0).cast("long").alias("quota"))
    return by_source.join(quotas, "source").select("source", (F.col("least") == F.col("most")).alias("equal"), (F.col("most") <= F.col("quota")).alias("within"), "arms", "quota")


@query(f"""{_P}, few AS (SELECT lang, cost, row_number() OVER (PARTITION BY lang ORDER BY cost, trace_id) AS i FROM pool),
w AS (SELECT * FROM few WHERE i <= 12), caps AS (SELECT lang, CAST(floor(sum(cost) * 0.4) AS BIGINT) AS capacity FROM w GROUP BY lang),
sums AS (SELECT lang, unnest(list_reduce(xs, lambda a, x: list_concat(a, list_transform(a, lambda y: y + x[1])), [0::BIGINT])) AS total FROM (SELECT lang, list([cost]) AS xs FROM w GROUP BY lang))
SELECT lang, capacity, max(total) AS best FROM sums JOIN caps USING (lang) WHERE total <= capacity GROUP BY lang, capacity""")
def subset_fill_sum(spark, sf_dir):
    w = Window.partitionBy("lang").orderBy("cost", "trace_id")
    few = _pool(spark, sf_dir).withColumn("i", F.row_number().over(w)).where("i <= 12")

    def best(pdf):
        costs = [int(c) for c in pdf["cost"]]
        capacity = int(sum(costs) * 0.4)
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "capacity": [capacity], "best": [sum(costs[i] for i in S.best_subset(costs, capacity))]})

    return few.select("lang", "cost").groupBy("lang").applyInPandas(best, "lang string, capacity long, best long")


# --- examples, prompts and schedules -----------------------------------------------------------

_RENDER_SQL = "upper(coalesce(nullif(role, ''), 'unknown')) || ': ' || coalesce(text, '')"


def _targets(spark, d):
    """A row for every assistant turn with the messages before it, in order."""
    c = table(spark, d, "conversations")
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    at = c.where("role = 'assistant'").select("conv_id", "turn")
    return at.join(whole, "conv_id").withColumn("all", F.filter("all", lambda m: m["turn"] < F.col("turn")))


@query(f"""WITH a AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'),
h AS (SELECT a.conv_id, a.turn, coalesce(string_agg({_RENDER_SQL}, chr(10) ORDER BY c.turn) FILTER (role = 'system'), '') AS sys, coalesce(string_agg({_RENDER_SQL}, chr(10) ORDER BY c.turn) FILTER (role IS DISTINCT FROM 'system'), '') AS tail
  FROM a LEFT JOIN conversations c ON a.conv_id = c.conv_id AND c.turn < a.turn GROUP BY a.conv_id, a.turn),
r AS (SELECT *, greatest(0, 400 - length(sys) - 32) AS room FROM h)
SELECT conv_id, turn, sha256(regexp_replace(sys || chr(10) || CASE WHEN length(tail) > room THEN '[TRUNCATED_OLDER_HISTORY]' || chr(10) || CASE WHEN room = 0 THEN tail ELSE right(tail, room) END ELSE tail END, '^\\s+|\\s+$', '', 'g')) AS prompt_sha256, length(tail) > room AS truncated FROM r""")
def history_v1(spark, sf_dir):
    def part(system):
        some = F.filter("all", lambda m: m["role"].eqNullSafe(F.lit("system")) if system else ~m["role"].eqNullSafe(F.lit("system")))
        return F.array_join(F.transform(some, lambda m: render(m["role"], m["text"])), "\n")

    rows = _targets(spark, sf_dir).select("conv_id", "turn", part(True).alias("sys"), part(False).alias("tail"))
    room = F.greatest(F.lit(0), F.lit(400) - F.length("sys") - 32)
    return rows.select("conv_id", "turn", F.sha2(compact_history(F.col("sys"), F.col("tail"), 400), 256).alias("prompt_sha256"), (F.length("tail") > room).alias("truncated"))


@query()
def structured_prompt(spark, sf_dir):
    rows = _targets(spark, sf_dir).select("conv_id", "turn", F.transform("all", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    return structured_prompts(rows, 1664, strict=False)


def _arm_examples(spark, d):
    """Calls as examples of two arms, by their trace's number."""
    rows = _labels(spark, d).select("event_id", "trace")
    return rows.select(F.format_string("e%09d", "event_id").alias("example_id"), F.concat(F.lit("arm"), (F.col("trace") % 2).cast("string")).alias("arm"))


_EXAMPLES_SQL = f"WITH {MESSAGES_SQL}, x AS (SELECT printf('e%09d', event_id) AS example_id, 'arm' || (trace % 2) AS arm FROM lab)"


_SCHEDULE_SQL = _EXAMPLES_SQL + """, b AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM x GROUP BY arm)), most AS (SELECT CAST(ceil(n / 16.0) * 16 AS BIGINT) AS most FROM b),
p AS (SELECT x.*, most, unnest(range(CAST(ceil(most / CAST(n AS DOUBLE)) AS BIGINT))) AS schedule_pass FROM (SELECT *, count(*) OVER (PARTITION BY arm) AS n FROM x) x, most),
s AS (SELECT example_id, arm, most, CAST(schedule_pass AS INT) AS schedule_pass, row_number() OVER (PARTITION BY arm ORDER BY schedule_pass, sha256('20260722:schedule:' || arm || ':' || schedule_pass || ':' || example_id), example_id) - 1 AS schedule_index FROM p)"""


def _schedule(spark, d):
    examples = _arm_examples(spark, d)
    largest = examples.groupBy("arm").count().agg(S.microbatch_count(F.max("count")).alias("most")).first()["most"]
    return S.schedule(examples, "example_id", "arm", largest)


@query(_SCHEDULE_SQL + " SELECT example_id, arm, schedule_pass, CAST(schedule_index AS INT) AS schedule_index FROM s WHERE schedule_index < most")
def fixed_schedule(spark, sf_dir):
    return _schedule(spark, sf_dir)


@query(_SCHEDULE_SQL + " SELECT arm, count(*) AS n, count(*) % 16 = 0 AS whole_steps, count(DISTINCT example_id) AS examples FROM s WHERE schedule_index < most GROUP BY arm")
def schedule_length(spark, sf_dir):
    return _schedule(spark, sf_dir).groupBy("arm").agg(F.count("*").alias("n"), (F.count("*") % 16 == 0).alias("whole_steps"), F.countDistinct("example_id").alias("examples"))


@query(_EXAMPLES_SQL + " SELECT arm, example_id FROM x ORDER BY example_id LIMIT 16")
def smoke_rows(spark, sf_dir):
    return K.limited(_arm_examples(spark, sf_dir), ["example_id"], 16).select("arm", "example_id")


@query(f"""WITH {MESSAGES_SQL}, p AS (SELECT 'arm' || (trace % 2) AS arm, target_tool AS value, count(*) AS n FROM lab GROUP BY ALL)
SELECT arm, 'target_tool' AS counter, string_agg(value || '=' || n, ';' ORDER BY value) AS counts FROM p GROUP BY arm""")
def target_tool_counts(spark, sf_dir):
    rows = _labels(spark, sf_dir).select(F.concat(F.lit("arm"), (F.col("trace") % 2).cast("string")).alias("arm"), "target_tool")
    return R.counters(rows, ["arm"], ["target_tool"]).select("arm", "counter", R.counter_text(F.col("counts")).alias("counts"))


@query(_EXAMPLES_SQL + ", c AS (SELECT arm, count(*) AS n FROM x GROUP BY arm) SELECT CAST(ceil(max(n) / 16.0) * 16 AS BIGINT) AS microbatches, CAST(ceil(max(n) / 16.0) AS BIGINT) AS steps FROM c")
def microbatch_count(spark, sf_dir):
    n = _arm_examples(spark, sf_dir).groupBy("arm").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    return n.select(S.microbatch_count(F.col("n")).alias("microbatches"), (S.microbatch_count(F.col("n")) / 16).cast("long").alias("steps"))


@query("""WITH e AS (SELECT conv_id, turn, length(text) AS n, least(length(text), 64) AS body FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CAST(128 AS INT) AS n_ids, CAST(body AS INT) AS n_loss, CAST(least(2 * n, 128) AS INT) AS n_mask FROM (SELECT conv_id, turn, n, CASE WHEN n < 128 THEN n ELSE 128 END AS body FROM e)""")
def padded_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.transform(F.split("text", ""), lambda c: F.ascii(c)).alias("body"))
    ids, labels = encode_left_cut(F.col("body"), F.col("body"), 128)
    ids, labels, mask = pad(ids, labels, 128, 0)
    loss = F.size(F.filter(labels, lambda x: x != -100))
    return rows.select("conv_id", "turn", F.size(ids).alias("n_ids"), loss.alias("n_loss"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("n_mask"))


# --- evaluation ----------------------------------------------------------------------------------


def _scored(spark, d):
    """Calls with a prediction guessed from a hash: most are right, some have a wrong tool, wrong arguments, or no call."""
    labels = _labels(spark, d)
    rows = messages(spark, d).where("call IS NOT NULL").select("event_id", F.col("call.name").alias("name"), F.col("call.args").alias("args"))
    rows = rows.join(labels.select("event_id", "trace", "recovery_mode"), "event_id")
    digit = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 2), 16, 10).cast("int")
    guess = rows.withColumns(
        {
            "task_key": F.concat(F.lit("task:"), (F.col("trace") % 37).cast("string")),
            "pred_name": F.when(digit < 16, F.lit(None)).when(digit < 64, F.lit("other")).otherwise(F.col("name")),
            "pred_args": F.when(digit < 16, F.lit(None)).when(digit % 4 == 0, F.lit("{}")).otherwise(F.col("args")),
        }
    )
    return E.score(guess)


_SCORED_SQL = f"""WITH {MESSAGES_SQL}, g AS (SELECT event_id, 'task:' || (trace % 37) AS task_key, recovery_mode, ('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 2))::INT AS digit FROM lab),
sc AS (SELECT event_id, task_key, recovery_mode, digit >= 16 AS json_valid, digit >= 64 AS tool_name_correct, digit >= 16 AND digit % 4 <> 0 AS arguments_exact, digit >= 64 AND digit % 4 <> 0 AS full_call_exact FROM g)"""


@query(_SCORED_SQL + " SELECT event_id, json_valid, tool_name_correct, arguments_exact, full_call_exact FROM sc")
def score_flags(spark, sf_dir):
    return _scored(spark, sf_dir).select("event_id", *E.METRICS)


@query(_SCORED_SQL + " SELECT event_id, tool_name_correct AS tool_correct, full_call_exact AND event_id % 2 = 0 AS call_exact FROM sc")
def score_flags_text(spark, sf_dir):
    # Predicted calls with an even number have their arguments as text, as targets do, the others as an object.
    rows = _scored(spark, sf_dir).withColumn("pred_text", F.col("event_id") % 2 == 0)
    return E.score_text(rows).select("event_id", "tool_correct", "call_exact")


_LONG_SQL = """, lg AS (SELECT unnest(['overall', CASE WHEN recovery_mode <> 'none' THEN 'recovery' END, CASE WHEN recovery_mode <> 'none' THEN recovery_mode END]) AS "group", sc.* FROM sc),
pt AS (SELECT "group", task_key, unnest(['json_valid', 'tool_name_correct', 'arguments_exact', 'full_call_exact']) AS metric, unnest([json_valid, tool_name_correct, arguments_exact, full_call_exact])::INT AS hit FROM lg WHERE "group" IS NOT NULL),
tk AS (SELECT "group", metric, task_key, count(*) AS n, sum(hit) AS hits FROM pt GROUP BY ALL)"""


@query(_SCORED_SQL + _LONG_SQL + """ SELECT "group", metric, CAST(sum(n) AS BIGINT) AS examples, count(*) AS tasks, round(sum(hits) / CAST(sum(n) AS DOUBLE), 9) AS micro, round(avg(hits / CAST(n AS DOUBLE)), 9) AS task_macro FROM tk GROUP BY "group", metric""")
def group_metrics(spark, sf_dir):
    out = E.group_metrics(_scored(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("micro", "task_macro")})


@query(_SCORED_SQL + """, tk AS (SELECT task_key, count(*) AS n, sum(full_call_exact::INT) AS hits FROM sc GROUP BY task_key)
SELECT count(*) AS tasks, round(avg(hits / CAST(n AS DOUBLE)), 9) AS full_call_exact FROM tk""")
def task_macro(spark, sf_dir):
    means = _scored(spark, sf_dir).groupBy("task_key").agg(F.avg(F.col("full_call_exact").cast("int")).alias("mean"))
    return means.agg(F.count("*").alias("tasks"), F.round(F.avg("mean"), 9).alias("full_call_exact"))


@query(_SCORED_SQL + """, st AS (SELECT task_key, count(*) AS n, sum(full_call_exact::INT) AS hits FROM sc GROUP BY task_key),
nu AS (SELECT *, row_number() OVER (ORDER BY sha256('20260722:bootstrap:' || task_key), task_key) - 1 AS i, count(*) OVER () AS size FROM st),
dr AS (SELECT s.range AS sample, ('0x' || substr(sha256('20260722/' || s.range || '/' || k.range), 1, 8))::BIGINT % (SELECT max(size) FROM nu) AS i FROM range(2000) s, range((SELECT max(size) FROM nu)) k),
me AS (SELECT sample, sum(hits) / CAST(sum(n) AS DOUBLE) AS mean FROM dr JOIN nu ON dr.i = nu.i GROUP BY sample)
SELECT 'full_call_exact' AS metric, round(quantile_cont(mean, 0.025), 9) AS ci_low, round(quantile_cont(mean, 0.975), 9) AS ci_high FROM me""")
def cluster_bootstrap(spark, sf_dir):
    out = E.cluster_bootstrap(_scored(spark, sf_dir), metrics=["full_call_exact"])
    return out.select("metric", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))


@query(_SCORED_SQL + " SELECT event_id FROM sc WHERE event_id % 3 <> 0")
def resume_antijoin(spark, sf_dir):
    scored = _scored(spark, sf_dir).select("event_id")
    return E.resume(scored, scored.where("event_id % 3 = 0"), "event_id")


_ARM_METRICS = [("base_model", "v2", 10, 1664, 0.25), ("random_success", "v2", 9, 1664, 0.5), ("shortest_success", "v1", 10, 512, None)]


@query("""SELECT * FROM (VALUES ('base_model', 'complete', 'OK', '25.00%'), ('random_success', 'incompatible', 'incomplete formal test', '50.00%'),
('shortest_success', 'incompatible', 'wrong protocol; evaluation context drift', '—'), ('recovery_coverage', 'missing', 'missing', '—')) v(arm, status, errors, full_call_exact)""")
def comparison(spark, sf_dir):
    arms = spark.createDataFrame([(a,) for a in ("base_model", *S.ARMS)], "arm string")
    metrics = spark.createDataFrame(_ARM_METRICS, "arm string, protocol string, evaluated int, cap int, exact double")
    checks = {
        "wrong protocol": (F.col("protocol"), F.lit("v2")),
        "incomplete formal test": (F.col("evaluated"), F.lit(10)),
        "evaluation context drift": (F.col("cap"), F.lit(1664)),
    }
    return R.compare(arms, metrics, checks).select("arm", "status", "errors", R.percent(F.col("exact")).alias("full_call_exact"))


_DRIFT_SQL = _SCORED_SQL + """, ar AS (SELECT event_id % 4 AS k, count(*) AS n, sum(full_call_exact::INT) AS hits FROM sc GROUP BY 1),
al AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest(['base_model', 'random_success', 'shortest_success', 'recovery_coverage', 'absent']) AS arm)"""


@query(_DRIFT_SQL + """ SELECT arm, CASE WHEN n IS NULL THEN 'missing' WHEN e = '' THEN 'complete' ELSE 'incompatible' END AS status, CASE WHEN n IS NULL THEN 'missing' WHEN e = '' THEN 'OK' ELSE e END AS errors
FROM (SELECT arm, n, concat_ws('; ', CASE WHEN n <> (SELECT max(n) FROM ar) THEN 'incomplete formal test: ' || n || '/' || (SELECT max(n) FROM ar) END,
  CASE WHEN al.k = 2 THEN 'model revision drift' END, CASE WHEN al.k = 3 THEN 'missing training or selection manifest' END,
  CASE WHEN al.k = 1 AND n % 2 = 1 THEN 'training max_steps drift' END, CASE WHEN al.k = 2 THEN 'training model_revision drift' END) AS e FROM al LEFT JOIN ar ON al.k = ar.k)""")
def contract_drift(spark, sf_dir):
    names = F.array(*map(F.lit, ("base_model", *S.ARMS)))
    scored = _scored(spark, sf_dir).groupBy((F.col("event_id") % 4).alias("k")).agg(F.count("*").alias("evaluated"))
    counts = cut(scored.withColumn("arm", F.element_at(names, (F.col("k") + 1).cast("int"))))
    generation = F.lit(json.dumps(K.GENERATION, sort_keys=True))
    revision = F.when(F.col("k") == 2, "other").otherwise("one")
    metrics = counts.select("arm", F.lit(K.PROTOCOL).alias("protocol"), F.lit(False).alias("limited"), "evaluated", revision.alias("revision"), F.lit("t").alias("test_sha256"), F.lit(K.PROMPT_TOKENS).alias("prompt_tokens"), generation.alias("generation"), F.lit(K.LOADING).alias("loading"))
    build = counts.agg(F.max("evaluated").alias("test_examples")).select("*", F.lit("one").alias("revision"), F.lit("t").alias("test_sha256"), F.lit("v").alias("validation_sha256"), F.lit(K.PADDED).alias("pad"), F.lit(68).alias("steps"), F.lit(K.ACCUMULATION).alias("accumulation"), F.map_from_arrays(names, F.transform(names, lambda x: F.sha2(x, 256))).alias("schedule_sha256"))
    steps = F.when((F.col("k") == 1) & (F.col("evaluated") % 2 == 1), 67).otherwise(68)
    trained = counts.where("k IN (1, 2)").select("arm", F.lit(K.PROTOCOL).alias("train_protocol"), revision.alias("train_revision"), F.lit(K.PADDED).alias("max_seq_len"), steps.alias("max_steps"), F.lit(1).alias("batch_size"), F.lit(K.ACCUMULATION).alias("grad_accum"), F.lit(False).alias("smoke_test"), F.sha2("arm", 256).alias("train_sha256"), F.lit("v").alias("train_validation_sha256"))
    selections = counts.select("arm", F.lit(1).alias("selected_sft_tokens"))
    arms = spark.createDataFrame([(a,) for a in ("base_model", *S.ARMS, "absent")], "arm string")
    return K.arm_drift(metrics, arms, build, trained, selections)


@query(f"{_P} SELECT lang, min(cost) AS least, max(cost) AS most, min(cost) = max(cost) AS equal FROM pool GROUP BY lang")
def cost_spread(spark, sf_dir):
    return R.spread(_pool(spark, sf_dir), ["lang"], "cost")


@query(f"""{_P}, {_RANDOM_SQL}, h AS (SELECT pool.lang AS lang, sha256(trace_id || chr(31) || cost) AS h FROM arm_r JOIN pool USING (trace_id)),
d AS (SELECT lang, count(*) AS n, {', '.join(f"sum(('0x' || substr(h, {1 + 12 * k}, 12))::BIGINT) AS s{k}" for k in range(4))} FROM h GROUP BY lang)
SELECT lang, sha256(concat_ws(':', n, s0, s1, s2, s3)) AS rows_sha256 FROM d""")
def selection_digest(spark, sf_dir):
    return row_set_digest(_arm(spark, sf_dir, "random"), ["trace_id", "cost"], "lang")
