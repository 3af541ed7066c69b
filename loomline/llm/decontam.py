"""Benchmark decontamination by winnowed fingerprints.

Of every six neighbouring 8-word hashes of a text the smallest is kept, so any 13
words that a document shares with a benchmark item (8 + 6 - 1 = 13) share at least
one kept hash.  Documents' and items' kept hashes are joined, and each hit is
extended to the 13-word windows around it.  Items of fewer than 13 words are one
window each, looked for with hashes of their own length.

The benchmark is a stated query set: tasks index blocks of it, of bounded text, and write
them to the shared folder; documents' fingerprints meet the indexes where the documents
are, one index after the other, without a shuffle.  So neither the driver nor a broadcast
holds any of it.  Documents of any source, copies and common passages cost no more than
others, as rows never meet.

Words are told apart by 64-bit hashes, windows by two hashes of those.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrays import ALNUM_WORD, LOWER, blocks, mix, span_hashes, spans, text_buffers, windows
from .exchange import joined, shared_dir
from .files import Bundle, fetch

WINDOW, GRAM = 13, 8
#: Bytes of benchmark text in a block; an index takes about six times as much.
QUERY_BLOCK_BYTES = 4 << 20
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
_ADDED = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row); words: digits, a-z after lower-casing A-Z, all non-ASCII."""
    low = LOWER[data]
    starts, ends, first = spans(ALNUM_WORD[low], offsets)
    return span_hashes(low, starts, ends), first


def winnow(at: np.ndarray, hashes: np.ndarray, span: int) -> np.ndarray:
    """Places in at of the smallest (rightmost if tied) of every span neighbouring hashes of one row."""
    n = len(at) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place = hashes[span - 1 :].copy(), np.arange(span - 1, span - 1 + n)
    for j in range(span - 2, -1, -1):
        less = hashes[j : j + n] < best
        best = np.where(less, hashes[j : j + n], best)
        place = np.where(less, np.arange(j, j + n), place)
    keep = np.zeros(len(at), bool)
    keep[place[at[span - 1 :] - at[:n] == span - 1]] = True
    return np.flatnonzero(keep)


def windows_at(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """As windows(), for the given places only."""
    h, step = np.zeros(len(at), np.uint64), 1
    for j in range(k):
        h += hashes[at + j] * np.uint64(step)
        step = step * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    return mix(h + np.uint64(k))


class _Windows:
    """The distinct windows of some items: hash, second hash, and the items that have each."""

    def __init__(self, hashes: np.ndarray, second: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, hashes))
        hashes, second, items = hashes[order], second[order], items[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])
        hashes, second, self.items = hashes[new], second[new], items[new]
        self.hashes, at = np.unique(hashes, return_index=True)
        self.second, self.at = second[at], np.r_[at, len(hashes)]

    def find(self, hashes: np.ndarray, second) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes, windows) that are equal; second: gives the second hashes of places."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[place] == hashes)
        hit = hit[self.second[place[hit]] == second(hit)]
        return hit, place[hit]


def _second(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ np.uint64(0xA5A5F00DCAFE1234))


class Index:
    """Fingerprints and windows of a block of items."""

    def __init__(self, ids: list[str], texts: list[str | None]):
        data, offsets = text_buffers(pa.array(texts, pa.large_string()))
        hashes, first = word_hashes(data, offsets)
        other, lengths = _second(hashes), np.diff(first)
        self.ids = ids
        at, grams = windows(hashes, first, GRAM)
        self.kept = np.unique(grams[winnow(at, grams, WINDOW - GRAM + 1)])
        at, grams = windows(hashes, first, WINDOW)
        self.sets = {WINDOW: _Windows(grams, windows_at(other, at, WINDOW), np.searchsorted(first, at, "right") - 1)}
        for n in np.unique(lengths[(lengths > 0) & (lengths < WINDOW)]).tolist():
            rows = np.flatnonzero(lengths == n)
            self.sets[n] = _Windows(windows_at(hashes, first[rows], n), windows_at(other, first[rows], n), rows)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word of each row, hit words, rows and items of the distinct pairs)."""
        hashes, first = word_hashes(data, offsets)
        other, cover, pairs = _second(hashes), np.zeros(len(hashes) + 1, np.int64), []
        for n, known in self.sets.items():
            if n == WINDOW:
                at, grams = windows(hashes, first, GRAM)
                mine = winnow(at, grams, WINDOW - GRAM + 1)
                near = at[mine][np.isin(grams[mine], self.kept)]
                near = np.unique((near[:, None] - np.arange(WINDOW - GRAM + 1)).reshape(-1))
                near = near[near >= 0]
                row = np.searchsorted(first, near, "right") - 1
                at = near[near + WINDOW <= first[np.minimum(row + 1, len(first) - 1)]]
                grams = windows_at(hashes, at, WINDOW)
            else:
                at, grams = windows(hashes, first, n)
            place, which = known.find(grams, lambda p, at=at, n=n: windows_at(other, at[p], n))
            np.add.at(cover, at[place], 1)
            np.add.at(cover, at[place] + n, -1)
            counts = known.at[which + 1] - known.at[which]
            rows = np.repeat(np.searchsorted(first, at[place], "right") - 1, counts)
            items = known.items[np.repeat(known.at[which] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
            pairs.append(np.stack([rows, items], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        return first, np.cumsum(cover[:-1]) > 0, pairs[:, 0], pairs[:, 1]


def index_files(benchmark: DataFrame, item_id: str, text: str) -> list[str]:
    """Indexes blocks of the benchmark's items and gives the files' addresses, one for each block."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = shared_dir(spark)

    def run(stream):
        held = [b for b in stream if b.num_rows]
        if held:
            rows = joined(held)
            with Bundle(folder) as out:
                address = out.add(pickle.dumps(Index(rows["item"].to_pylist(), rows["text"].to_pylist())))
            yield pa.record_batch({"address": pa.array([address.decode()])})

    parts = -(-size // QUERY_BLOCK_BYTES)
    return sorted(r["address"] for r in items.repartition(max(1, parts), "item").mapInArrow(run, "address string").collect())


@lru_cache(2)
def _index(address: str) -> Index:
    return pickle.loads(fetch(address.encode()))


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, hit_spans (word positions, merged) and hit_items (sorted ids as strings).

    keep: the columns of docs to return, all by default; older columns with the added
    names go.  A null or empty text has no words and no hits; an item with a null id
    or without words is no item; one id on several rows is one item.  Repeated
    documents each get their row.  An empty benchmark leaves all documents clean.
    """
    added = [f.name for f in _ADDED]
    docs = docs.drop(*added)
    keep = [c for c in (keep or docs.columns) if c not in added]
    indexes = index_files(benchmark, item_id, item_text)

    def run(stream):
        for rows in stream:
            data, offsets = text_buffers(rows[text])
            cuts, found = list(blocks(data, offsets)), {}
            for address in indexes:
                index = _index(address)
                for a, _, part, offs in cuts:
                    first, hit, row, item = index.hits(part, offs)
                    old = found.setdefault(a, (first, np.zeros(len(hit), bool), [set() for _ in range(len(offs) - 1)]))
                    old[1][:] |= hit
                    for r, i in zip(row.tolist(), item.tolist(), strict=True):
                        old[2][r].add(index.ids[i])
            for a, b, part, offs in cuts:
                first, hit, items = found.get(a) or (word_hashes(part, offs)[1], None, [()] * (len(offs) - 1))
                piece = rows.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(piece[c] for c in keep), pa.array(np.diff(first)), _spans(first, hit), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=[*keep, *added])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *_ADDED]))


def _spans(first: np.ndarray, hit: np.ndarray | None) -> pa.Array:
    """The runs of hit words of each row, by their places in it."""
    starts, stops, at = spans(np.zeros(int(first[-1]), bool) if hit is None else hit, first)
    before = np.repeat(first[:-1], np.diff(at))
    runs = pa.StructArray.from_arrays([pa.array(starts - before, pa.int32()), pa.array(stops - before, pa.int32())], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs).cast(_ARROW_SPANS)


def n_hit():
    """Hit words of a row of mark()."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])


def contaminated():
    """The contamination rule on a row of mark(): some hit word, and a twentieth of the words at least."""
    return (n_hit() > 0) & (n_hit() * 20 >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of mark() for each document."""
    return mark(docs.select("doc_id", "text"), benchmark, keep=["doc_id"]).select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
