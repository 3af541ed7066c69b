"""Token files with random access: directly addressable codes.

An id is cut into chunks of bits, lowest first.  Level k holds the k-th chunks of all
ids that have one, packed in as few bits as the level needs, and a bitmap that says
which of them go on; a directory of ones before every 512 bits of the bitmap gives a
chunk's place on the next level.  So any id is read by a few lookups, without decoding
its neighbours.  Chunk widths are chosen for each file to take the fewest bits.

File layout, little-endian: magic, version, counts, widths; document ids; first token
of each document; for each level its packed chunks and, but for the last, its bitmap
and rank directory.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.selection import running
from .arrays import blocks, gather, same_spans, text_buffers, trim
from .bpe import Words
from .exchange import input_bytes, landed, shared_dir, stable
from .files import read_file, write_file

_MAGIC, _RANK_BITS = b"LLDAC01\n", 512
#: Ids in a file, about; a longer single document makes its file longer.
FILE_IDS = 2 << 20
#: Distinct words whose ids a worker keeps between batches; beyond that it starts anew.
CACHED_WORDS = 500_000


# --- codes ---------------------------------------------------------------------------


def widths_for(ids: np.ndarray) -> list[int]:
    """Chunk widths, lowest first, with the least bits in all, bitmaps and directories included."""
    counts = np.bincount(np.maximum(np.frexp(ids.astype(np.float64))[1], 1), minlength=2)  # by length in bits
    top = len(counts) - 1
    longer = [int(counts[b + 1 :].sum()) for b in range(top + 1)]
    best: dict[int, tuple[float, list[int]]] = {top: (0.0, [])}
    for at in range(top - 1, -1, -1):
        options = []
        for w in range(1, min(24, top - at) + 1):
            bitmap = 1 + 32 / _RANK_BITS if at + w < top else 0
            options.append((longer[at] * (w + bitmap) + best[at + w][0], [w, *best[at + w][1]]))
        best[at] = min(options)
    return best[0][1]


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    """values in width bits each, lowest first; up to 16 bits, eight values at a time make width bytes."""
    if width > 16:
        out = []
        for a in range(0, len(values), 1 << 18):  # a multiple of 8 values, so pieces end at bytes
            piece = values[a : a + (1 << 18)]
            out.append(np.packbits((piece[:, None] >> np.arange(width, dtype=np.uint32)) & 1 == 1, bitorder="little").tobytes())
        return b"".join(out)
    eights = np.zeros((-(-len(values) // 8), 8), np.uint64)
    eights.reshape(-1)[: len(values)] = values
    low, high = (sum(eights[:, h + k] << np.uint64(k * width) for k in range(4)) for h in (0, 4))
    half = np.uint64(4 * width)
    if width == 16:
        both = np.stack([low, high], 1)
    else:
        both = np.stack([low | high << half, high >> (np.uint64(64) - half)], 1)
    packed = np.ascontiguousarray(both).view(np.uint8).reshape(-1, 16)[:, :width].tobytes()
    return packed[: (len(values) * width + 7) // 8]


class Level:
    """Packed chunks of one level, with the bitmap and directory that lead to the next."""

    def __init__(self, width: int, chunks: bytes, bitmap: bytes, ranks: bytes):
        self.width, self.mask = width, np.uint32((1 << width) - 1)
        self.chunks = np.frombuffer(chunks + bytes(8), np.uint8)
        self.bitmap = np.frombuffer(bitmap, np.uint8)
        self.ranks = np.frombuffer(ranks, np.uint32).astype(np.int64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.bitmap), dtype=np.int64)] if len(bitmap) else None

    def get(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.width
        word = np.ndarray((len(self.chunks) - 3,), "<u4", self.chunks, strides=(1,))[bit >> 3]
        return (word >> (bit & 7).astype(np.uint32)) & self.mask

    def follows(self, at: np.ndarray) -> np.ndarray:
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place: the directory's entry, then whole bytes of its stretch, then bits."""
        stretch = at // _RANK_BITS
        byte = at >> 3
        part = self.bitmap[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return self.ranks[stretch] + self.before[byte] - self.before[stretch * (_RANK_BITS // 8)] + np.bitwise_count(part)


def encode_file(doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents; known: false for a null document id; starts: first token of each, and the end."""
    widths, rest = widths_for(ids), ids.astype(np.uint32)
    head = _MAGIC + struct.pack("<QQB", len(doc_ids), len(ids), len(widths)) + bytes(widths)
    parts = [doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes()]
    for k, w in enumerate(widths):
        chunks = _pack_bits(rest & np.uint32((1 << w) - 1), w)
        bitmap = ranks = b""
        if k < len(widths) - 1:
            more = (rest >> np.uint32(w)) > 0
            bitmap = np.packbits(more, bitorder="little").tobytes()
            ranks = np.r_[0, np.cumsum(np.add.reduceat(more, np.arange(0, len(more), _RANK_BITS)))[:-1]].astype("<u4").tobytes() if len(more) else b""
            rest = (rest >> np.uint32(w))[more]
        parts += [chunks, bitmap, ranks]
    return head + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


class TokenFile:
    """Random access to the ids of a file of encode_file()."""

    def __init__(self, blob: bytes):
        if blob[:8] != _MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_ids, n_levels = struct.unpack_from("<QQB", blob, 8)
        widths = blob[25 : 25 + n_levels]
        sizes = struct.unpack_from(f"<{3 + 3 * n_levels}Q", blob, at := 25 + n_levels)
        parts, at = [], at + 8 * len(sizes)
        for n in sizes:
            parts.append(blob[at : at + n])
            at += n
        self.doc_ids, self.known = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], np.uint8).astype(bool)
        self.starts = np.frombuffer(parts[2], "<u8").astype(np.int64)
        self.levels = [Level(w, *parts[3 + 3 * k : 6 + 3 * k]) for k, w in enumerate(widths)]

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at any places, each by its own lookups."""
        out, at = np.zeros(len(at), np.uint32), np.asarray(at, np.int64)
        left, shift = np.arange(len(at)), 0
        for k, level in enumerate(self.levels):
            out[left] |= level.get(at) << np.uint32(shift)
            shift += level.width
            if k < len(self.levels) - 1:
                more = level.follows(at)
                left, at = left[more], level.rank(at[more])
        return out

    def document(self, k: int) -> np.ndarray:
        """All ids of the file's k-th document."""
        return self.get(np.arange(self.starts[k], self.starts[k + 1]))


# --- tokens --------------------------------------------------------------------------


@lru_cache(2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    steps = json.loads(out.to_str())
    if steps["model"]["type"] != "BPE" or steps["normalizer"] or (steps["pre_tokenizer"] or {}).get("type") != "ByteLevel" or steps["pre_tokenizer"]["add_prefix_space"] or not steps["pre_tokenizer"]["use_regex"]:
        raise ValueError("only byte-level BPE without normalisation is supported")
    added = {t.content: i for i, t in out.get_added_tokens_decoder().items()}
    if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in out.get_added_tokens_decoder().values()):
        raise ValueError("added tokens that depend on what is around them aren't supported")
    return out, added, {}


def token_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, first id of each row and the end) by the tokenizer file, as its library encodes whole texts.

    Added tokens within a text are one id each, and the texts between them are encoded
    by themselves.
    """
    added = _tokenizer(path)[1]
    found = np.zeros(len(column), bool)
    for token in added:
        found |= pc.match_substring(column, token).fill_null(False).to_numpy(zero_copy_only=False)
    if not found.any():
        return _plain_ids(column, path)
    cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")
    # Pieces of all rows; at odd places of a row the added tokens, whose pieces are empty.
    parts = [cut.split(x) if f else [x] for x, f in zip(column.to_pylist(), found.tolist(), strict=True)]
    first = np.r_[0, np.cumsum([len(p) for p in parts])]
    ids, begin = _plain_ids(pa.array(["" if k % 2 else x for p in parts for k, x in enumerate(p)], column.type), path)
    one = np.array([k % 2 for p in parts for k in range(len(p))], np.int64)
    at = np.flatnonzero(one)
    ids = np.insert(ids, begin[at], np.array([added[x] for p in parts for x in p[1::2]], ids.dtype))
    return ids, (begin + np.r_[0, np.cumsum(one)])[first]


class _Known:
    """Ids of words that a worker keeps between batches, found by hash and told apart by bytes."""

    def __init__(self):
        self.keys, self.ids, self.raw = np.zeros(0, np.uint64), np.zeros(0, "<u4"), np.zeros(0, np.uint8)
        self.starts = self.counts = self.at = self.sizes = np.zeros(0, np.int64)

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Places of the words, or -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        place[(self.keys[place] != keys) | (self.sizes[place] != lengths)] = -1
        found = np.flatnonzero(place >= 0)
        both = np.r_[data, self.raw]
        own = np.r_[starts[found], self.at[place[found]] + len(data)]
        n = len(found)
        if not same_spans(both, own, own + np.tile(lengths[found], 2), np.r_[np.arange(n) + n, np.arange(n) + n]):
            raw = both.tobytes()
            for k in range(n):
                if raw[own[k] : own[k] + lengths[found[k]]] != raw[own[k + n] : own[k + n] + lengths[found[k]]]:
                    place[found[k]] = -1
        return place

    def add(self, keys: np.ndarray, raw: bytes, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        at, starts = len(self.raw) + np.cumsum(sizes) - sizes, len(self.ids) + np.cumsum(counts) - counts
        self.raw, self.ids = np.r_[self.raw, np.frombuffer(raw, np.uint8)], np.r_[self.ids, ids]
        order = np.argsort(np.r_[self.keys, keys], kind="stable")
        self.keys, self.at, self.sizes, self.starts, self.counts = (np.r_[a, b][order] for a, b in ((self.keys, keys), (self.at, at), (self.sizes, sizes), (self.starts, starts), (self.counts, counts)))


def _letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it's printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


def _encode(tokenizer, raw: bytes, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each) of single pre-tokens of byte-level BPE, by the library's model itself."""
    letters, one, ids, counts = raw.decode("latin-1").translate(_letters()), tokenizer.model.tokenize, [], []
    for a, b in spans:
        got = one(letters[a:b])
        ids += [t.id for t in got]
        counts.append(len(got))
    return np.array(ids, "<u4"), np.array(counts, np.int64)


def _plain_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """token_ids() of texts without added tokens; each distinct pre-token is encoded once in a worker, while it's kept."""
    tokenizer, _, cache = _tokenizer(path)
    words = Words(column)
    starts, lengths = words.spans()
    known = cache.setdefault("known", _Known())
    place = known.find(words.keys, words.data, starts, lengths)
    new = np.flatnonzero(place < 0)
    if len(new):
        raw = gather(words.data, starts[new], lengths[new]).tobytes()
        ends = np.cumsum(lengths[new]).tolist()
        own = list(zip([0, *ends], ends, strict=False))
        ids, counts = _encode(tokenizer, raw, own)
        place[new] = len(known.keys) + np.arange(len(new))
        begin, count = np.r_[known.starts, len(known.ids) + np.cumsum(counts) - counts], np.r_[known.counts, counts]
        flat = np.r_[known.ids, ids]
        if len(known.keys) + len(new) > CACHED_WORDS:
            known = cache["known"] = _Known()
        known.add(words.keys[new], raw, lengths[new], ids, counts)
    else:
        begin, count, flat = known.starts, known.counts, known.ids
    begin, count = begin[place], count[place]
    use = words.place
    return gather(flat, begin[use], count[use]), np.r_[0, np.cumsum(count[use])][words.first]


def write_tokens(docs: DataFrame, vocab: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Writes all documents in ascending doc_id order to token files; gives a table of part, count, path, n_docs and n_ids, a row a file in the order of (part, count).

    Documents are dealt by ranges of doc_id and sorted, so files follow each other in
    order and a task streams through its range.  A null text is empty and has the end
    id only.  Null document ids come first; equal ones follow each other by text.
    """
    spark = docs.sparkSession
    docs = stable(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // (32 << 20))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(stream):
        part, held, size, count = TaskContext.get().partitionId(), [], 0, 0

        def close(count):
            path = f"{folder}/part-{part:07d}-{count:05d}.ltok"
            doc_ids, known = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            sizes, ids = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            write_file(path, [encode_file(doc_ids, known, np.r_[0, np.cumsum(sizes)], ids)])
            return pa.record_batch({"part": pa.array([part]), "count": pa.array([count]), "path": pa.array([path]), "n_docs": pa.array([len(doc_ids)]), "n_ids": pa.array([len(ids)])})

        for rows in stream:
            offsets = text_buffers(rows["text"])[1]
            for a, b, _, _ in blocks(np.zeros(0, np.uint8), offsets, 4 << 20):
                piece = rows.slice(a, b - a)
                ids, first = token_ids(piece["text"], vocab)
                sizes = np.diff(first) + 1
                whole = np.full(int(sizes.sum()), end_id, "<u4")
                keep = np.ones(len(whole), bool)
                keep[np.cumsum(sizes) - 1] = False
                whole[keep] = ids
                held.append((piece["doc_id"].fill_null(0).to_numpy(), piece["doc_id"].is_valid().to_numpy(zero_copy_only=False), sizes, whole))
                size += len(whole)
                if size >= FILE_IDS:
                    yield close(count)
                    held, size, count = [], 0, count + 1
        if held:
            yield close(count)
        trim()

    return landed(ordered.mapInArrow(run, "part long, count long, path string, n_docs long, n_ids long"))


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) and ids_crc32 of every document of the files of write_tokens().

    Each file's first place comes from running sums over the table of files.
    """
    spark = files.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long"
    table = running(files.select("part", "count", "path", "n_ids"), [], F.col("part"), ["part", "count"], F.col("n_ids"), "upto")
    table = table.select("path", (F.col("upto") - F.col("n_ids")).alias("base"))

    def run(stream):
        for rows in stream:
            for path, base in zip(rows["path"].to_pylist(), rows["base"].to_pylist(), strict=True):
                f = TokenFile(read_file(path))
                ids = np.concatenate([f.get(np.arange(a, min(a + (1 << 19), f.n_ids))) for a in range(0, f.n_ids, 1 << 19)] or [np.zeros(0, np.uint32)])
                docs = [ids[a:b].astype("<u4").tobytes() for a, b in zip(f.starts[:-1], f.starts[1:], strict=True)]
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(f.doc_ids, mask=~f.known),
                        "start": pa.array(f.starts[:-1] + base),
                        "n_tokens": pa.array(np.diff(f.starts)),
                        "ids": pa.array(docs, pa.binary()),
                        "ids_crc32": pa.array([zlib.crc32(d) for d in docs], pa.int64()),
                    }
                )

    return table.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def store_and_read(docs: DataFrame, vocab: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from its files in the shared folder."""
    files = write_tokens(docs, vocab, shared_dir(docs.sparkSession))
    return read_tokens(files).select("doc_id", "start", "n_tokens", "ids_crc32")
