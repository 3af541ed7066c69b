"""How the flat tables stand for trajectories, and the same in SQL.

events are tool trajectories: one for each user, in order of time; documents with
labels are traces with a reward, a cost and a recovery flag; conversations are message
histories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import token_estimate
from ..sources.tables import table

ORDER = ["ts", "event_id"]
#: Names of the error classes, by a number modulo 5.
CLASSES = ["not_found", "invalid_argument", "unauthorized", "conflict", "generic_error"]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message rows of events: errors and views are tool messages, clicks and purchases calls, signups users."""
    kind = F.col("event_type")
    role = F.when(kind.isin("error", "view"), "tool").when(kind == "signup", "user").otherwise("assistant")
    number = F.regexp_extract("props", r"(\d+)", 1).cast("int") % 5
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace"),
        *ORDER,
        role.alias("role"),
        F.when(kind.isin("click", "purchase"), F.struct(kind.alias("name"), F.col("props").alias("args"))).alias("call"),
        F.when(kind == "error", F.element_at(F.array(*map(F.lit, CLASSES)), number + 1)).alias("error"),
    )


_CLASS_CASE = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES))
MESSAGES_SQL = f"""
m AS (
  SELECT user_id AS trace, ts, event_id, user_id % 37 AS task,
    CASE WHEN event_type IN ('error', 'view') THEN 'tool' WHEN event_type = 'signup' THEN 'user' ELSE 'assistant' END AS role,
    CASE WHEN event_type IN ('click', 'purchase') THEN event_type || chr(1) || props END AS call,
    CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS call_name,
    CASE WHEN event_type = 'error' THEN CASE CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 5 {_CLASS_CASE} END END AS error,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx
  FROM events),
seen AS (
  SELECT *, last_value(call IGNORE NULLS) OVER b AS failed,
    last_value(CASE WHEN role = 'tool' THEN idx END IGNORE NULLS) OVER b AS tool_idx,
    last_value(CASE WHEN role = 'user' THEN idx END IGNORE NULLS) OVER b AS last_user,
    first_value(call IGNORE NULLS) OVER a AS repair,
    min(CASE WHEN call IS NOT NULL THEN idx END) OVER a AS repair_idx,
    min(CASE WHEN role = 'user' THEN idx END) OVER a AS next_user
  FROM m
  WINDOW b AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
ev AS (
  SELECT trace, ts, event_id, error AS error_type, split_part(failed, chr(1), 1) AS failed_tool, split_part(repair, chr(1), 1) AS repair_tool,
    coalesce(next_user <= repair_idx, false) AS user_assisted
  FROM seen
  WHERE role = 'tool' AND error IS NOT NULL AND failed IS NOT NULL AND repair IS NOT NULL AND failed <> repair),
prior AS (
  SELECT *, rec AND user_assisted_ AS ua FROM (
    SELECT c.trace, c.event_id, c.task, c.call, c.call_name AS target_tool, p.error AS prior_error_type, p.failed AS pfailed,
      coalesce(p.error IS NOT NULL AND p.failed IS NOT NULL AND p.failed <> c.call, false) AS rec,
      coalesce(c.last_user > c.tool_idx, false) AS user_assisted_
    FROM seen c LEFT JOIN seen p ON p.trace = c.trace AND p.idx = c.tool_idx
    WHERE c.call IS NOT NULL)),
lab AS (
  SELECT trace, event_id, task, call, target_tool, prior_error_type,
    CASE WHEN NOT rec THEN 'none' WHEN ua THEN 'user_assisted' ELSE 'agent_initiated' END AS recovery_mode,
    CASE WHEN rec THEN prior_error_type END AS error_type,
    CASE WHEN rec THEN split_part(pfailed, chr(1), 1) END AS failed_tool,
    CASE WHEN rec THEN target_tool END AS repair_tool
  FROM prior)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as traces: trace_id, task_key, source, lang, cost, recovery (0 or 1), reward, text, signature (the text's SHA-256).

    Signatures are made below the join, so what only tells texts apart shuffles none.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    docs = docs.withColumn("signature", F.unhex(F.sha2("text", 256)))
    return docs.join(labels, "doc_id").select(
        F.format_string("d%09d", "doc_id").alias("trace_id"),
        F.concat(F.lit("task:"), (F.col("doc_id") % 97).cast("string")).alias("task_key"),
        "source",
        "lang",
        token_estimate(F.col("n_chars")).alias("cost"),
        F.col("toxic").alias("recovery"),
        F.col("quality").alias("reward"),
        "text",
        "signature",
    )


TRACES_SQL = """
t AS (
  SELECT printf('d%09d', d.doc_id) AS trace_id, 'task:' || (d.doc_id % 97) AS task_key, source, lang,
    CAST(greatest(1, ceil(coalesce(n_chars, 0) / 4.0)) AS BIGINT) AS cost, toxic AS recovery, quality AS reward, text
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

SPLIT_SQL = """
k AS (SELECT DISTINCT task_key FROM t),
r AS (SELECT task_key, row_number() OVER (ORDER BY sha256('20260722::' || task_key), task_key) AS rank, count(*) OVER () AS n FROM k),
split AS (
  SELECT task_key, CASE WHEN rank <= CAST(round_even(0.7 * n, 0) AS BIGINT) THEN 'train'
    WHEN rank <= CAST(round_even(0.7 * n, 0) AS BIGINT) + CAST(round_even(0.1 * n, 0) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
  FROM r)"""

POOL_SQL = """
dd AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY task_key, source, trace_id) AS rn FROM t WHERE reward = 1) WHERE rn = 1),
pool AS (SELECT dd.* FROM dd JOIN split USING (task_key) WHERE split = 'train'),
budget AS (SELECT lang, CAST(floor(0.3 * sum(cost)) AS BIGINT) AS budget FROM pool GROUP BY lang)"""
