"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Pre-tokens are taken with their positions; every batch of texts sends each of its
distinct words once; where a word's copies meet it is encoded once; the ids go back
and take the places of the words (see exchange.py).  Decoding joins the token-byte
table by id, a fixed table of the vocabulary's size.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrays import blocks, distinct, gather, narrow, pack, same_spans, span_hashes, text_buffers, unpack
from .exchange import exchange, finish
from .pretokens import pretokens


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})._core_bpe.encode_single_piece


@lru_cache(2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = {i: t for t, i in ranks(path).items()}
    parts = [table.get(i, b"") for i in range(max(table, default=-1) + 1)]
    lengths = np.array([len(t) for t in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


class Words:
    """The pre-tokens of a column and which of them are the same.

    data: the texts' bytes; starts, ends: each pre-token; first: the first one of each
    row; keys: a number for each distinct one, in order; place: each one's key; at: a
    pre-token of each key.  Keys are 64-bit hashes, and the bytes are compared: should
    different words have one hash, all are numbered by BLAKE2b instead.
    """

    def __init__(self, column: pa.Array):
        self.data, offsets = text_buffers(column)
        starts, ends, first, hashes, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], [np.zeros(0, np.uint64)], 0
        for a, _, part, offs in blocks(self.data, offsets):
            s, e, f = pretokens(part, offs)
            hashes.append(span_hashes(part, s, e))
            first.append(f[1:] + n)
            starts.append(s + offsets[a])
            ends.append(e + offsets[a])
            n += len(s)
        self.starts, self.ends, self.first = map(np.concatenate, (starts, ends, first))
        self._number(np.concatenate(hashes))
        if not same_spans(self.data, self.starts, self.ends, self.at[self.place]):
            raw = self.data.tobytes()
            self._number(np.array([int.from_bytes(hashlib.blake2b(raw[s:e], digest_size=8).digest(), "little") for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True)], np.uint64))
            if not same_spans(self.data, self.starts, self.ends, self.at[self.place]):
                raise ValueError("two words with equal BLAKE2b")

    def _number(self, hashes: np.ndarray) -> None:
        self.keys, self.place = distinct(hashes)
        self.at = np.empty(len(self.keys), np.int64)
        self.at[self.place] = np.arange(len(self.place))

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of a pre-token of each key."""
        return self.starts[self.at], (self.ends - self.starts)[self.at]


def encode(docs: DataFrame, text: str, path: str, out: str = "ids") -> DataFrame:
    """docs with the ids of text in a binary column of little-endian unsigned 32-bit integers.

    path: the rank file, present on every machine.  A null or empty text has no ids;
    other columns, nulls and repeated rows stay as they are.  An existing column
    named out is replaced.
    """
    docs = docs.drop(out)

    def ask(rows):
        words = Words(rows[text])
        starts, lengths = words.spans()

        def entries(a, b):
            return pack(narrow(lengths[a:b]), gather(words.data, starts[a:b], lengths[a:b]))

        return words.keys, entries

    def answer(slices):
        one, known, replies = _encoder(path), {}, []
        for blob in slices:
            lengths, data = unpack(blob)
            data, at, ids, counts = data.tobytes(), 0, [], []
            for n in lengths.tolist():
                word = data[at : at + n]
                at += n
                if (got := known.get(word)) is None:
                    got = known[word] = one(word)
                ids += got
                counts.append(len(got))
            replies.append(pack(narrow(np.array(counts, np.int64)), narrow(np.array(ids, np.int64))))
        return replies

    def compute(rows, replies):
        words = Words(rows[text])
        first, place = words.first, words.place
        got = [unpack(x) for x in replies]
        none = np.zeros(0, np.int64)
        lengths = np.concatenate([none, *(x[0] for x in got)]).astype(np.int64)
        ids = np.concatenate([none, *(x[1] for x in got)]).astype("<u4")
        if len(lengths) != len(words.keys):
            raise RuntimeError("a batch wasn't read alike twice")
        starts = np.cumsum(lengths) - lengths
        step = max(1, rows.num_rows // max(1, len(place) >> 20))
        for a in range(0, rows.num_rows, step):
            b = min(a + step, rows.num_rows)
            use = place[first[a] : first[b]]
            flat = gather(ids, starts[use], lengths[use])
            ends = np.r_[0, np.cumsum(lengths[use])][first[a : b + 1] - first[a]]
            cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((ends * 4).astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([*(x for x in rows.slice(a, b - a).columns), cut.cast(pa.binary())], names=[*rows.schema.names, out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())])
    return finish(*exchange(docs, text, ask, answer), compute, schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with the bytes that its ids stand for in the binary column out; null ids stand for none."""
    coded = coded.drop(out)

    def run(stream):
        blob, starts, lengths = _token_bytes(path)
        for rows in stream:
            data, offsets = text_buffers(rows[ids])
            for a, b, part, offs in blocks(data, offsets, 2 << 20):
                use = np.frombuffer(part.tobytes(), "<u4")
                ends = np.r_[0, np.cumsum(lengths[use])][offs // 4]
                flat = gather(blob, starts[use], lengths[use])
                cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([*rows.slice(a, b - a).columns, cut.cast(pa.binary())], names=[*rows.schema.names, out])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, by encode() and decode()."""
    coded = decode(encode(docs.select("doc_id", "text"), "text", path).select("doc_id", "ids"), path)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
