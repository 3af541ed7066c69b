"""Language-model scores by deleted interpolation.

A bigram model: P(w | v) = l2 c(vw)/c(v) + l1 c(w)/N + l0/(V + 1), with one set of
weights for each bucket of the context's frequency (powers of two).  Of the training
documents a ninth is held out; counts without it give the estimates, and expectation
maximisation learns the weights that make the held-out part most likely.  Scores use
the counts of all training documents with those weights.

All counts are exact and global: every batch asks for its distinct words and word
pairs (see exchange.py), so the work grows with the input and no frequent pair gathers
in a task.  The held-out counts are a table: how many held-out positions have a word, a
context and a pair that occur so often.  Each step of the maximisation is an aggregate of
that table by bucket, which gives three sums for each of at most 25 buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrays import LOWER, SPACE_WORD, blocks, distinct, mix, narrow, pack, span_hashes, spans, text_buffers, unpack
from .exchange import exchange, finish, landed

#: Buckets of contexts; steps of the maximisation at most, and the change of a weight at which it ends.
BUCKETS, ROUNDS, SETTLED = 25, 30, 1e-3
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)


class Tokens:
    """The tokens of a batch: words and one end for each text, with their keys and their pairs' keys.

    Word keys are odd and pair keys even, so a key tells its kind.
    """

    def __init__(self, column: pa.Array):
        data, offsets = text_buffers(column)
        parts, sizes = [], []
        for _, _, part, offs in blocks(data, offsets):
            low = LOWER[part]
            starts, ends, first = spans(SPACE_WORD[low], offs)
            parts.append(span_hashes(low, starts, ends))
            sizes.append(np.diff(first) + 1)
        size = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.first = np.r_[0, np.cumsum(size)]
        tokens = np.full(int(self.first[-1]), _END, np.uint64)
        words = np.ones(len(tokens), bool)
        words[self.first[1:] - 1] = False
        tokens[words] = np.concatenate([np.zeros(0, np.uint64), *parts])
        before = np.r_[_START, tokens[:-1]][: len(tokens)]
        before[self.first[:-1]] = _START
        word = mix(tokens) | np.uint64(1)
        pair = mix(before * np.uint64(0xD6E8FEB86659FD93) + mix(tokens)) & ~np.uint64(1)
        words, word = distinct(word)
        pairs, pair = distinct(pair)
        self.keys = np.sort(np.r_[words, pairs])
        odd = (self.keys & np.uint64(1)) == 1
        self.word, self.pair = np.flatnonzero(odd)[word], np.flatnonzero(~odd)[pair]
        self.row = np.repeat(np.arange(len(size)), size)

    def context(self, counts: np.ndarray) -> np.ndarray:
        """How often the context of each token occurs; texts begin as often as they end."""
        end = int(counts[self.word[-1]]) if len(self.word) else 0
        own = counts[self.word]
        out = np.r_[0, own[:-1]][: len(own)]
        out[self.first[:-1]] = end
        return out


def _ask(rows):
    tokens = Tokens(rows["text"])
    fold = rows["fold"].to_numpy()[tokens.row]
    counts = []
    for use in (fold > 1, fold == 1):
        n = len(tokens.keys)
        counts.append(np.bincount(tokens.word[use], minlength=n) + np.bincount(tokens.pair[use], minlength=n))

    def entries(a, b):
        return pack(np.diff(tokens.keys[a:b], prepend=np.uint64(0)), narrow(counts[0][a:b]), narrow(counts[1][a:b]))

    return tokens.keys, entries


def _answer(slices):
    """Global counts (kept, tuned) for each slice; the first also has the range's sums for words: types, tokens, kept tokens."""
    parts = [unpack(x) for x in slices]
    keys, place = distinct(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]))
    kept, tuned = (np.bincount(place, np.concatenate([p[i] for p in parts]).astype(np.float64)).astype(np.int64) for i in (1, 2))
    word = (keys & np.uint64(1)) == 1
    sums = np.array([(word & (kept + tuned > 0)).sum(), (kept + tuned)[word].sum(), kept[word].sum()], np.uint64)
    out, at = [], 0
    for i, p in enumerate(parts):
        mine = place[at : at + len(p[0])]
        at += len(p[0])
        out.append(pack(narrow(kept[mine]), narrow(tuned[mine]), sums if i == 0 else sums[:0]))
    return out


def _counts(tokens: Tokens, replies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    got = [unpack(x) for x in replies]
    kept, tuned = (np.concatenate([np.zeros(0, np.int64), *(g[i] for g in got)]).astype(np.int64) for i in (0, 1))
    if len(kept) != len(tokens.keys):
        raise RuntimeError("a batch wasn't read alike twice")
    return kept, tuned


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 and the power of two, up to the last bucket."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def held_out_counts(tokens: Tokens, kept: np.ndarray, use: np.ndarray) -> pa.RecordBatch:
    """(bucket, context, pair, word, n): how many of the positions in use have such counts.

    Without the pair the context counts by its bucket only, so it's 0 there.
    """
    context, pair, word = tokens.context(kept)[use], kept[tokens.pair[use]], kept[tokens.word[use]]
    slot = bucket(context)
    context = np.where(pair > 0, context, 0)
    order = np.lexsort((word, pair, context, slot))
    columns = [x[order] for x in (slot, context, pair, word)]
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(order)])
    return pa.RecordBatch.from_arrays([pa.array(x[at], pa.int64()) for x in columns] + [pa.array(n, pa.int64())], names=["bucket", "context", "pair", "word", "n"])


def learn_weights(counts: DataFrame, n_kept: int, uniform: float) -> np.ndarray:
    """Weights (pair, word, uniform) of each bucket from held_out_counts().

    Each weight gets half a position beforehand, so none is 0.  A bucket without
    held-out positions has the weights of the nearest lower one that has some, else of
    the nearest higher one.
    """
    weights = np.tile(np.array([0.4, 0.4, 0.2]), (BUCKETS, 1))
    estimates = (F.col("pair") / F.greatest("context", F.lit(1)), F.col("word") / F.lit(float(max(1, n_kept))))
    seen = np.zeros(BUCKETS, bool)
    for _ in range(ROUNDS):
        known = F.array(*(F.array(*map(F.lit, row)) for row in weights.tolist()))
        own = [F.element_at(F.element_at(known, (F.col("bucket") + 1).cast("int")), k + 1) for k in range(3)]
        parts = counts.select("bucket", "n", (own[0] * estimates[0]).alias("p"), (own[1] * estimates[1]).alias("w"), (own[2] * uniform).alias("u"))
        share = [F.sum(F.col("n") * F.col(c) / (F.col("p") + F.col("w") + F.col("u"))).alias(c) for c in "pwu"]
        before = weights.copy()
        for r in parts.groupBy("bucket").agg(*share).collect():
            gained = np.array([r["p"], r["w"], r["u"]]) + 0.5
            weights[r["bucket"]], seen[r["bucket"]] = gained / gained.sum(), True
        if np.abs(weights - before).max() < SETTLED:
            break
    for k in np.flatnonzero(~seen) if seen.any() else []:
        lower = np.flatnonzero(seen[:k])
        weights[k] = weights[lower[-1] if len(lower) else np.flatnonzero(seen)[0]]
    weights[0] = [0, weights[0][1] / (weights[0][1] + weights[0][2]), weights[0][2] / (weights[0][1] + weights[0][2])]
    return weights


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows whose crc32 of the id as text is divisible by ten are held out; of the others
    those with remainder 1 tune the weights.  A null id counts as an empty text there.
    Words are runs of characters other than the six ASCII white spaces, A-Z
    lower-cased; a null or empty text has its end only.  Without training texts all
    estimates are 0 and tokens are equally likely.  Repeated rows count repeatedly.
    """
    fold = (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 10).cast("int")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), fold.alias("fold"))
    joined, parts = exchange(slim, "text", _ask, _answer)
    joined = landed(joined)

    def sums(stream):
        for block in stream:
            for part, payload in zip(block["part"].to_pylist(), block["payload"].to_pylist(), strict=True):
                if part >= 0 and len(s := unpack(payload)[2]):
                    yield pa.record_batch([pa.array([int(x)]) for x in s], names=["types", "tokens", "kept"])

    total = joined.mapInArrow(sums, "types long, tokens long, kept long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "kept"))).first()
    n_types, n_train, n_kept = total["types"], total["tokens"], total["kept"]
    uniform = 1.0 / (n_types + 1)

    def tune(rows, replies):
        tokens = Tokens(rows["text"])
        kept, _ = _counts(tokens, replies)
        yield held_out_counts(tokens, kept, rows["fold"].to_numpy()[tokens.row] == 1)

    counts = finish(joined, parts, tune, "bucket long, context long, pair long, word long, n long")
    weights = learn_weights(landed(counts.groupBy("bucket", "context", "pair", "word").agg(F.sum("n").alias("n"))), n_kept, uniform)

    def judge(rows, replies):
        tokens = Tokens(rows["text"])
        kept, tuned = _counts(tokens, replies)
        counts = kept + tuned
        context, own = tokens.context(counts), counts[tokens.word]
        w = weights[bucket(context)]
        mixed = w[:, 0] * (counts[tokens.pair] / np.maximum(context, 1)) + w[:, 1] * (own / max(1, n_train)) + w[:, 2] * uniform
        base = np.log10((own + 0.1) / (n_train + 0.1 * (n_types + 1)))
        n, at = rows.num_rows, tokens.first[:-1]
        yield pa.RecordBatch.from_arrays(
            [
                rows["doc_id"],
                pa.array(rows["fold"].to_numpy() == 0),
                pa.array(np.diff(tokens.first)),
                pa.array(np.add.reduceat((own > 0).astype(np.int64), at)),
                pa.array(np.full(n, n_train, np.int64)),
                pa.array(np.add.reduceat(base, at)),
                pa.array(np.add.reduceat(np.log10(mixed), at)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    return finish(joined, parts, judge, schema)
