"""Readers and writers: nested trajectory files, JSON lines, manifests, reports and digests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

#: arguments stay text, as files have both JSON text and objects there; reward is text, as it may be a number or true.
TRAJECTORY = "task_id string, reward string, trial int, traj array<struct<role:string, name:string, content:string, tool_calls:array<struct<function:struct<name:string, arguments:string>>>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the flat Parquet tables in a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trajectories(spark: SparkSession, folder: str, pattern: str = "*retail.json") -> DataFrame:
    """Successful records of all matching files, each a JSON array, with source (the file's stem), task_key and trace_id."""
    raw = spark.read.schema(TRAJECTORY).option("multiLine", True).option("pathGlobFilter", pattern).json(folder)
    success = (F.lower("reward") == "true") | (F.expr("try_cast(reward AS DOUBLE)") == 1)
    source = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    rows = raw.select("*", source.alias("source")).where(success)
    trace = F.concat("source", F.lit(":task"), "task_id", F.lit(":trial"), F.coalesce("trial", F.lit(0)).cast("string"))
    return rows.withColumns({"task_key": F.concat(F.lit("retail:"), "task_id"), "trace_id": trace})


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines file; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str) -> dict:
    """A small JSON document, read through Spark so that any store will do."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines with nulls written out and non-ASCII characters as they are."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and fixed columns, in one file; for reports of a few rows."""
    rows.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_document(spark: SparkSession, value, path: str) -> None:
    """One pretty JSON document."""
    spark.createDataFrame([(json.dumps(value, indent=2, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_new(rows: DataFrame, path: str, key: str, done: DataFrame | None) -> DataFrame:
    """Appends the rows whose key isn't done yet and gives them; for logs that are resumed."""
    new = (rows if done is None else rows.join(done.select(key), key, "left_anti")).dropDuplicates([key])
    new.write.mode("append").json(path)
    return new


@F.pandas_udf(StringType())
def _streamed_sha256(paths: pd.Series) -> pd.Series:
    """SHA-256 of files, read a megabyte at a time."""

    def digest(uri: str) -> str:
        system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else "file://" + uri.removeprefix("file:"))
        out = hashlib.sha256()
        with system.open_input_stream(path) as f:
            while part := f.read(1 << 20):
                out.update(part)
        return out.hexdigest()

    return paths.map(digest)


def file_digests(spark: SparkSession, pattern: str, whole: int = 256 << 20) -> DataFrame:
    """name and SHA-256 of every matching file; those of over whole bytes are read in pieces, as a cell can't hold them."""
    files = spark.read.format("binaryFile").load(pattern)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    small = files.where(F.col("length") <= whole).select(name, F.sha2("content", 256).alias("sha256"))
    return small.union(files.where(F.col("length") > whole).select(name, _streamed_sha256("path").alias("sha256")))


def checkpoint_fingerprint(spark: SparkSession, folder: str | None, names: tuple[str, ...] = ("adapter_config.json", "adapter_model.safetensors")) -> str:
    """SHA-256 over the names and digests of a checkpoint's files; base_model without one; raises if a file is missing."""
    if folder is None:
        return "base_model"
    found = {r["name"]: r["sha256"] for r in file_digests(spark, f"{folder}/*").where(F.col("name").isin(*names)).collect()}
    if missing := [n for n in names if n not in found]:
        raise FileNotFoundError(f"incomplete checkpoint: {missing}")
    return hashlib.sha256("".join(n + found[n] for n in names).encode()).hexdigest()


def row_digest(*columns: str) -> Column:
    """SHA-256 of a row's values as text."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)


def row_set_digest(rows: DataFrame, columns: list[str], group: str) -> DataFrame:
    """A digest of each group's rows that doesn't depend on their order or files: counts and sums over rows' digests.

    The digests are added up in four parts, so no group's rows need to meet.
    """
    hashed = rows.select(group, row_digest(*columns).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    joined = F.concat_ws(":", F.count("*").cast("string"), *(p.cast("string") for p in parts))
    return hashed.groupBy(group).agg(joined.alias("sums")).select(group, F.sha2("sums", 256).alias("rows_sha256"))
