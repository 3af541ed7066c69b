"""A there-and-back exchange of keys: one global answer for every key of the corpus.

Counting n-grams, or encoding every distinct word once, needs each key's rows
together and the answer back at each text.  Moving a row for each occurrence costs
several times the corpus.  Here rows are read in batches of bounded bytes:

1. ``ask``: a batch writes its rows, compressed, to a file in the shared folder and
   sends each of its *distinct* keys once, sorted, cut by key range into packed
   slices.  So a key has at most one entry for each batch, however frequent it is, and
   no key can overload a task.
2. ``answer``: a range's slices meet; the global answer of each key is made once
   and sent back in the order in which its batch asked.
3. ``finish``: a batch reads its rows again from their address, which went along, and
   computes on with all their keys answered.

Nothing is collected, broadcast or capped, and texts are never shuffled.  Memory is
bounded by a batch and by a key range; the number of ranges follows the input's size.
Further steps that need a batch's texts go by its address as well; see gathered().

The input is scanned once, so it needn't be read alike twice (what isn't a plain scan is
written first, for its size to be known).  A repeated task writes a new file and sends
that file's address with its keys.

A slice holds a batch's keys of one range, so slices get smaller as the input grows:
with batches of 10 MB some hundred keys at 100 GB, and about one beyond 10 TB, where a
row's overhead counts more than its keys.  ``spark.loomline.exchange.batchBytes`` makes
batches larger on executors that have the memory (a task needs about 25 times as much).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .arrays import trim
from .files import Bundle, fetch

BATCH_BYTES = 10 << 20
#: Rows that steps send each other: where to, which batch they're about, their kind or place, and packed content.
ROUTED = "target long, batch long, part int, payload binary"
_SCHEMA = pa.schema([("target", pa.int64()), ("batch", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])
#: The part of a row that has the address of a batch's rows.
ADDRESS = -1


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir; only in local mode a temporary folder may stand in for that."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    _made.append(f"{root.rstrip('/')}/loomline-{uuid.uuid4().hex}")
    return _made[-1]


_made: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the folders that shared_dir() names within, at the end; what is read from them must be written by then."""
    first = len(_made)
    try:
        yield
    finally:
        for path in _made[first:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _made[first:]


@contextmanager
def tidy(spark: SparkSession):
    """What is written within leaves no shuffle files: they go when it's written, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before or "false")


def landed(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written to a folder, by default a new shared one, and read again: what follows has no lineage and doesn't recompute it."""
    path = path or shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stable(df: DataFrame) -> DataFrame:
    """df if it's a plain scan, else a landed copy, so that reading it several times computes it once."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return landed(df) if re.search(r"Join|Aggregate|Repartition|Window|Sort|Limit|Union|Sample|Generate|RDD|MapIn|Python|rand\(", plan) else df


def batches(stream: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows with about limit bytes of text at a time; a single row may have more."""
    held, size = [], 0
    for batch in stream:
        if not batch.num_rows:
            continue
        at, width = 0, max(1, batch.column(column).nbytes // max(1, batch.num_rows))
        while at < batch.num_rows:
            take = min(batch.num_rows - at, max(1, (limit - size) // width))
            held.append(batch.slice(at, take))
            size += take * width
            at += take
            if size >= limit * 15 // 16:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The record batches as one."""
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def to_bytes(rows: pa.RecordBatch) -> bytes:
    """rows as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def from_bytes(blob: bytes) -> pa.RecordBatch:
    """The rows of to_bytes()."""
    return next(iter(pa.ipc.open_stream(blob)))


def ranges(spark: SparkSession, bytes_in: int, per_range: int = 4 << 20) -> int:
    """Key ranges (a power of two) so that each answers for about per_range bytes of text at most."""
    want = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), bytes_in // per_range)
    return 1 << (want - 1).bit_length()


def input_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate; from file sizes for scans."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks(spark: SparkSession, bytes_in: int) -> int:
    """Partitions of a shuffle: as many as the session says, but more if they had over 64 MB of input each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), bytes_in >> 26)


def cut(keys: np.ndarray, n_ranges: int) -> np.ndarray:
    """Where each range begins and the last ends in sorted unsigned 64-bit keys."""
    shift = np.uint64(64 - (n_ranges.bit_length() - 1))
    return np.r_[np.searchsorted(keys, np.arange(n_ranges, dtype=np.uint64) << shift), len(keys)]


def routed(target, batch, part, payload) -> pa.RecordBatch:
    """Rows of ROUTED from four sequences; a single number stands for as many as there are payloads."""
    n = len(payload)
    number = lambda x, kind: pa.array(np.broadcast_to(np.asarray(x, np.int64), n), kind)
    return pa.RecordBatch.from_arrays([number(target, pa.int64()), number(batch, pa.int64()), number(part, pa.int32()), pa.array(payload, pa.binary())], schema=_SCHEMA)


def gathered(rows: DataFrame, parts: int, handle: Callable[[int, list[tuple[int, int, bytes]]], Iterator[pa.RecordBatch]], schema=ROUTED) -> DataFrame:
    """handle(target, [(batch, part, payload)] by part and batch) for the rows of every target, which meet in one of parts partitions."""

    def run(stream):
        at, held = None, []
        for block in stream:
            for target, batch, part, payload in zip(*(block[c].to_pylist() for c in _SCHEMA.names), strict=True):
                if target != at:
                    if held:
                        yield from handle(at, held)
                    at, held = target, []
                held.append((batch, part, payload))
        if held:
            yield from handle(at, held)
        held = None
        trim()

    return rows.select(*_SCHEMA.names).repartition(parts, "target").sortWithinPartitions("target", "part", "batch").mapInArrow(run, schema)


def exchange(
    docs: DataFrame,
    text: str,
    ask: Callable[[pa.RecordBatch], tuple[np.ndarray, Callable[[int, int], bytes]]],
    answer: Callable[[list[bytes]], list[bytes]],
) -> tuple[DataFrame, int]:
    """Rows for finish(): the answers to each batch's keys by range, and the address of its rows; and in how many partitions to finish.

    ask(rows) gives the sorted distinct keys and a function that packs the entries
    from one place to another; answer(slices) gives the answers to all slices of a
    range.
    """
    docs = stable(docs)
    spark, size = docs.sparkSession, input_bytes(docs)
    n_ranges, parts, folder = ranges(spark, size), tasks(spark, size), shared_dir(spark)
    limit = int(spark.conf.get("spark.loomline.exchange.batchBytes", str(BATCH_BYTES)))

    def questions(stream):
        first = TaskContext.get().partitionId() << 32
        with Bundle(folder) as out:
            for k, rows in enumerate(batches(stream, text, limit)):
                keys, slice_of = ask(rows)
                at = cut(keys, n_ranges)
                full = np.flatnonzero(np.diff(at))
                yield routed(full, first | k, full, [slice_of(int(at[p]), int(at[p + 1])) for p in full])
                yield routed(-1 - (first | k), first | k, ADDRESS, [out.add(to_bytes(rows))])
                del rows, keys, slice_of
                trim()

    def answers(target, slices):
        batch = [b for b, _, _ in slices]
        yield routed(batch, batch, [p for _, p, _ in slices], [x for _, _, x in slices] if target < 0 else answer([x for _, _, x in slices]))

    return gathered(docs.mapInArrow(questions, ROUTED), parts, answers), parts


def finish(answered: DataFrame, parts: int, compute: Callable[[pa.RecordBatch, list[bytes]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """compute(rows, answers in key order) for every batch of exchange()."""
    return addressed(answered, parts, lambda batch, address, rows, replies: compute(rows, replies), schema)


def addressed(answered: DataFrame, parts: int, compute: Callable[[int, bytes, pa.RecordBatch, list[bytes]], Iterator[pa.RecordBatch]], schema=ROUTED) -> DataFrame:
    """finish() for a function that also takes the batch's number and the address of its rows."""

    def run(batch, replies):
        if replies[0][1] != ADDRESS or len(replies) > 1 and replies[1][1] == ADDRESS:
            raise RuntimeError("a batch has no address, or several")
        yield from compute(batch, replies[0][2], from_bytes(fetch(replies[0][2])), [x for _, _, x in replies[1:]])
        trim()

    return gathered(answered, parts, run, schema)
