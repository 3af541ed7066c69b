"""Near-duplicate classes of documents by an n-gram Jaccard join with adaptive prefixes.

A document is the set of its distinct word shingles.  Shingles are ordered by their
exact document frequency, rarest first.  Two sets as similar as asked share a shingle
within their first n - ceil(t n) + 1, and l of them within l - 1 more; each document
picks the l whose estimated cost, of reading its shingles' lists and of verifying what
is met l times, is least, and a pair is verified only if it shares as many prefix
shingles as the smaller l of the two.  Shingles of one document only can't match, so
most documents send nothing at all.

Classes are found without making all pairs of a group of copies: equal sets are one
set; every set is first verified against the leading set of its most shared shingles'
lists, first the one with the most frequent shingles, as an original has, then one by
chance; after joining what is linked, only pairs of *different* classes are made.
Pairs within a class need no verification, since they can't change the classes, so no
link between classes is lost.  A parity of each set, of 256 bits for the leading sets and
of about a bit a shingle for the pairs, bounds the shingles in which two sets differ from
below and drops most pairs that aren't similar enough before their texts meet.

Shingles and their words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .arrays import LOWER, SPACE_WORD, blocks, distinct, mix, narrow, pack, ranked, sorted_set, span_hashes, spans, text_buffers, unpack, windows
from .decontam import windows_at
from .exchange import ADDRESS, addressed, exchange, from_bytes, gathered, input_bytes, joined, landed, stable, tasks
from .files import fetch

GRAM, PERCENT, MAX_NEED = 4, 85, 4
#: What verifying a pair costs, in entries of a shingle's list.
VERIFY_COST = 16
#: Rounds of comparing sets with the leading set of a list before pairs of classes are made.
STARS = 2
#: Lists of more sets are dealt out by size of sets.
LONG_LIST = 4096
#: How many pairs of lists are compared, and how many of them held, at a time.
PAIRS = 1 << 19
_BITS = ["b0", "b1", "b2", "b3"]
_PLACED = ["batch", "place", "address", "digest"]
#: Document frequencies are counted by the top 48 bits of a shingle's hash; a collision may make a prefix less rare, never wrong.
_LOW_BITS = np.uint64(16)


def shingle_sets(column: pa.Array, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes of a column in order, place of each set's members in them, first member of each row).

    Words are runs of characters other than the six ASCII white spaces, A-Z
    lower-cased; a text of fewer than k words but some is one shingle.
    """
    data, offsets = text_buffers(column)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, _, part, offs in blocks(data, offsets):
        low = LOWER[part]
        starts, ends, first = spans(SPACE_WORD[low], offs)
        hashes, n = span_hashes(low, starts, ends), np.diff(first)
        at, h = windows(hashes, first, k)
        rows.append(np.searchsorted(first, at, "right") - 1 + a)
        found.append(h)
        for m in range(1, k):
            short = np.flatnonzero(n == m)
            rows.append(short + a)
            found.append(windows_at(hashes, first[short], m))
    keys, place = distinct(np.concatenate(found))
    found, scale = None, max(1, len(keys))
    place += np.concatenate(rows) * scale
    rows = None
    row, place = np.divmod(sorted_set(place), scale)
    return keys, place, np.searchsorted(row, np.arange(len(offsets)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[np.zeros(1, values.dtype), np.cumsum(values)][first])


def set_keys(keys: np.ndarray, place: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of each set of 64-bit hashes; null for an empty one."""
    with np.errstate(over="ignore"):
        halves = [_sums(mix(keys ^ np.uint64(salt))[place], first) for salt in (0x51ED270B7F4A7C15, 0xB492B66FBE98F273)]
    both = np.stack([mix(h + np.diff(first).astype(np.uint64)) for h in halves], 1).tobytes()
    return [both[16 * i : 16 * i + 16] if n else None for i, n in enumerate(np.diff(first).tolist())]


def parities(keys: np.ndarray, place: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """256 bits of each set in four words; each bit is the parity of the members that fall on it."""
    spot, full = (mix(keys ^ np.uint64(0x9A51)) >> np.uint64(56))[place], np.flatnonzero(np.diff(first))
    out = []
    for w in range(4):
        bit = np.where(spot >> np.uint64(6) == w, np.left_shift(np.uint64(1), spot & np.uint64(63)), np.uint64(0))
        words = np.zeros(len(first) - 1, np.uint64)
        if len(full):
            words[full] = np.bitwise_xor.reduceat(bit, first[full])
        out.append(words.view(np.int64))
    return out


def sketch(members: np.ndarray) -> bytes:
    """A parity of a set, of the power of two of bits that isn't less than its size, 256 at least and 2**16 at most."""
    bits = 1 << min(16, max(8, (len(members) - 1).bit_length()))
    spot = (mix(members ^ np.uint64(0x5E7C)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(spot, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: np.ndarray, b: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Bits in which the sketches of sets a and b differ, in pairs; the longer is folded to the shorter one's bits."""
    sizes, out = np.array([len(x) for x in sketches], np.int64), np.zeros(len(a), np.int64)
    least = np.minimum(sizes[a], sizes[b])
    for size in np.unique(least).tolist():
        pairs = np.flatnonzero(least == size)
        used, place = np.unique(np.concatenate([a[pairs], b[pairs]]), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[k], np.uint8).reshape(-1, size)) for k in used.tolist()]).view(np.uint64)
        for at in range(0, len(pairs), max(1, (8 << 20) // size)):
            some = np.arange(at, min(len(pairs), at + max(1, (8 << 20) // size)))
            out[pairs[some]] = np.bitwise_count(folded[place[some]] ^ folded[place[some + len(pairs)]]).sum(1)
    return out


def _frequencies(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys without their low bits, place of each key in them); keys are sorted."""
    cut = (keys >> _LOW_BITS) << _LOW_BITS
    new = np.ones(len(cut), bool)
    new[1:] = cut[1:] != cut[:-1]
    return cut[new], np.cumsum(new) - 1


def count_entries(keys: np.ndarray, counts: np.ndarray):
    """The entry packer of exchange() for sorted keys with counts."""
    return lambda a, b: pack(np.diff(keys[a:b], prepend=np.uint64(0)), narrow(counts[a:b]))


def add_counts(slices: list[bytes]) -> list[bytes]:
    """The answerer of exchange() that adds the counts of equal keys."""
    parts = [unpack(x) for x in slices]
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    _, place = np.unique(keys, return_inverse=True)
    totals = np.bincount(place, np.concatenate([p[1] for p in parts]).astype(np.float64)).astype(np.int64)
    ends = np.cumsum([len(p[0]) for p in parts])
    return [pack(narrow(totals[place[e - len(p[0]) : e]])) for p, e in zip(parts, ends, strict=True)]


def prefixes(first: np.ndarray, df: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix length, shared shingles that a pair needs) of each set; df: frequencies of the sets' members, rarest first."""
    n = np.diff(first)
    least = n - (n * percent + 99) // 100 + 1
    lists = np.r_[0, np.cumsum(df - 1)]
    length, need, best = least.copy(), np.ones(len(n), np.int64), None
    for extra in range(MAX_NEED):
        size = np.minimum(least + extra, n)
        read = lists[first[:-1] + size] - lists[first[:-1]]
        cost = read * (1 + VERIFY_COST / (extra + 1))
        better = (least + extra <= n) & (cost < best) if extra else np.ones(len(n), bool)
        best = np.where(better, cost, best) if extra else cost
        length, need = np.where(better, size, length), np.where(better, extra + 1, need)
    return np.where(n > 0, length, 0), need


def profiles(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, placed: bool = False) -> DataFrame:
    """doc_id, n, set_key, need, center (how frequent its shingles are), parity bits, tokens (prefix shingles of several documents) and, where there are some, the packed text.

    placed: also each row's batch and place in it, at place 0 the batch's address, and a
    digest of the text; the batches then have all columns of docs.
    """

    def ask(rows):
        keys, place, _ = shingle_sets(rows[text], k)
        asked, to = _frequencies(keys)
        return asked, count_entries(asked, np.bincount(to[place], minlength=len(asked)))

    def compute(batch, address, rows, replies):
        keys, place, first = shingle_sets(rows[text], k)
        asked, to = _frequencies(keys)
        totals = np.concatenate([np.zeros(0, np.int64), *(unpack(x)[0] for x in replies)]).astype(np.int64)
        if len(totals) != len(asked):
            raise RuntimeError("a batch wasn't read alike twice")
        df, n = totals[to[place]], np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        center = np.floor(16 * _sums(np.log2(np.maximum(df, 1)), first) / np.maximum(n, 1)).astype(np.int32)
        place = ranked(row, df, place, len(keys))
        df, tokens = totals[to[place]], keys[place]
        length, need = prefixes(first, df, percent)
        use = (np.arange(len(df)) - np.repeat(first[:-1], n) < np.repeat(length, n)) & (df > 1)
        ends = np.r_[0, np.cumsum(use)][first]
        some = np.flatnonzero(np.diff(ends))
        bodies, sketches, packer = [None] * len(n), [None] * len(n), zstandard.ZstdCompressor(level=3)
        for i, t in zip(some.tolist(), rows[text].take(pa.array(some)).to_pylist(), strict=True):
            bodies[i], sketches[i] = packer.compress(t.encode()), sketch(keys[place[first[i] : first[i + 1]]])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens[use].view(np.int64)))
        where = []
        if placed:
            digests = [None if t is None else hashlib.blake2b(t, digest_size=16).digest() for t in rows[text].cast(pa.binary()).to_pylist()]
            where = [pa.array(np.full(len(n), batch)), pa.array(np.arange(len(n)), pa.int32()), pa.array([address, *[None] * (len(n) - 1)], pa.binary()), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [rows[doc_id], pa.array(n), pa.array(set_keys(keys, place, first), pa.binary()), pa.array(need, pa.int32()), pa.array(center), *map(pa.array, parities(keys, place, first)), lists, pa.array(bodies, pa.binary()), pa.array(sketches, pa.binary()), *where],
            names=["doc_id", "n", "set_key", "need", "center", *_BITS, "tokens", "body", "sketch", *_PLACED[: len(where)]],
        )

    asked = docs if placed else docs.select(doc_id, text)
    own = T.StructType.fromDDL("n long, set_key binary, need int, center int, b0 long, b1 long, b2 long, b3 long, tokens array<long>, body binary, sketch binary").fields
    more = T.StructType.fromDDL("batch long, place int, address binary, digest binary").fields if placed else []
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *own, *more])
    return addressed(*exchange(asked, text, ask, add_counts), compute, schema)


def verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set numbers that are as similar as asked; sets: sid, n, body."""
    a = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("body").alias("ba"))
    b = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("body").alias("bb"))
    both = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "na", "nb", "ba", "bb")

    def run(stream):
        unzip = zstandard.ZstdDecompressor()
        for rows in stream:
            # Shingles, a few million at most unless a single pair has more, are in memory at once.
            for a, b, _, _ in blocks(np.zeros(0, np.uint8), np.r_[0, np.cumsum(rows["na"].to_numpy() + rows["nb"].to_numpy())], 1 << 20):
                piece = rows.slice(a, b - a)
                sides = []
                for c in ("ba", "bb"):
                    keys, place, first = shingle_sets(pa.array([unzip.decompress(x) for x in piece[c].to_pylist()], pa.binary()), k)
                    sides.append((np.repeat(np.arange(piece.num_rows), np.diff(first)), keys[place]))
                row, keys = (np.concatenate(x) for x in zip(*sides, strict=True))
                order = np.lexsort((keys, row))
                row, keys = row[order], keys[order]
                twice = (row[1:] == row[:-1]) & (keys[1:] == keys[:-1])
                shared = np.bincount(row[1:][twice], minlength=piece.num_rows)
                whole = piece["na"].to_numpy() + piece["nb"].to_numpy() - shared
                keep = pa.array(shared * 100 >= whole * percent)
                yield pa.RecordBatch.from_arrays([piece["a"].filter(keep), piece["b"].filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """sid and label, the smallest member of its class, of every set in links (a, b).

    In each round every node joins its smallest neighbour and the links between what
    is left are made anew, until none is; the graph shrinks geometrically.  All tables
    are written to the shared folder between rounds.
    """
    edges, labels = landed(links.where("a <> b").select("a", "b").distinct()), None
    while not edges.isEmpty() or labels is None:
        ways = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = landed(ways.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("y")))
        if labels is None:
            labels = to.select(F.col("x").alias("sid"), F.col("y").alias("label"))
        else:
            labels = landed(labels.join(to, F.col("label") == F.col("x"), "left").select("sid", F.coalesce("y", "label").alias("label")))
        moved = edges.join(to, F.col("a") == F.col("x")).select(F.col("y").alias("a"), "b")
        moved = moved.join(to, F.col("b") == F.col("x")).select("a", F.col("y").alias("b"))
        edges = landed(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


_SIDE = ["sid", "label", "n", "need", *_BITS]


def _side(live: DataFrame, s: str) -> DataFrame:
    return live.select("token", *(F.col(c).alias(f"{c}_{s}") for c in _SIDE))


def _fits(percent: int) -> Column:
    """What a pair must meet to be verified: different classes, lengths, and a parity that lets the sets be similar."""
    differ = sum((F.bit_count(F.col(f"{b}_l").bitwiseXOR(F.col(f"{b}_r"))) for b in _BITS[1:]), F.bit_count(F.col("b0_l").bitwiseXOR(F.col("b0_r"))))
    length = F.least("n_l", "n_r") * 100 >= F.greatest("n_l", "n_r") * percent
    return (F.col("label_l") != F.col("label_r")) & length & (differ * (100 + percent) <= (F.col("n_l") + F.col("n_r")) * (100 - percent))


def _mixed(live: DataFrame, labels: DataFrame) -> DataFrame:
    """live with the labels, of the shingles' lists that have several classes; size: how many sets a list has."""
    tagged = live.drop("label", "size").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    mixed = landed(tagged.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high").select("token", "size"))
    return landed(tagged.join(mixed, "token"))


def _across(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, need) of pairs of sets of different classes that a list has, and that length and sketches allow to be similar.

    Rows of a pair give parts of the prefix shingles that it shares.  Lists are sorted
    by size of sets, and each set meets those after it as long as sizes allow.  What the
    256 bits let pass is counted and compared by sketches, PAIRS at a time.  Lists of
    more than LONG_LIST sets are dealt out by classes of size first, of which only
    neighbours can match: a set meets those of its own class and of the next higher one.
    """
    step = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9).cast("int")
    own = F.array(F.struct(F.lit(-1).alias("step"), F.lit(True).alias("home")))
    both = F.array(F.struct(step.alias("step"), F.lit(True).alias("home")), F.struct((step + 1).alias("step"), F.lit(False).alias("home")))
    rows = live.select("token", *_SIDE, F.explode(F.when(F.col("size") > LONG_LIST, both).otherwise(own)).alias("x")).select("*", "x.*").drop("x")
    rows = rows.join(sets.select("sid", "sketch"), "sid")

    def run(stream):
        # Whole lists, until there's some megabytes of them.
        held, size = [], 0
        for block in stream:
            if not block.num_rows:
                continue
            held.append(block)
            size += block.nbytes
            if size > 8 << 20:
                table = joined(held)
                token, kind = table["token"].to_numpy(), table["step"].to_numpy()
                last = np.flatnonzero((token != token[-1]) | (kind != kind[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield from pairs(table.slice(0, cut))
                held = [table.slice(cut)]
                size = held[0].nbytes if cut else 0
        if held:
            yield from pairs(joined(held))

    def pairs(table):
        token, kind, sid, label, n, need = (table[c].to_numpy() for c in ("token", "step", "sid", "label", "n", "need"))
        bits = [table[c].to_numpy().view(np.uint64) for c in _BITS]
        home = table["home"].to_numpy(zero_copy_only=False)
        codes, where = np.unique(sid, return_index=True)
        number, sketches, size, least = np.searchsorted(codes, sid), table["sketch"].take(pa.array(where)).to_pylist(), n[where], need[where]
        # A row meets those after it in its list as long as sizes allow, some hundred thousand pairs at a time.
        which, scale = np.cumsum(np.r_[False, (token[1:] != token[:-1]) | (kind[1:] != kind[:-1])]), int(n.max()) * 100 + 1
        count = np.searchsorted(which * scale + n * percent, which * scale + n * 100, "right") - np.arange(len(n)) - 1
        upto, done, found, held = np.cumsum(count), 0, [], 0
        while done < len(n):
            past = int(upto[done - 1]) if done else 0
            stop = max(done + 1, int(np.searchsorted(upto, past + PAIRS, "right")))
            l = np.repeat(np.arange(done, stop), count[done:stop])  # noqa: E741
            r = l + 1 + np.arange(len(l)) - (upto[l] - count[l] - past)
            done = stop
            ok = (label[l] != label[r]) & (home[l] | home[r])
            l, r = l[ok], r[ok]  # noqa: E741
            differ, most = np.zeros(len(l), np.int64), (n[l] + n[r]) * (100 - percent) // (100 + percent)
            for b in bits:
                differ += np.bitwise_count(b[l] ^ b[r])
                ok = differ <= most
                l, r, differ, most = l[ok], r[ok], differ[ok], most[ok]  # noqa: E741
            found.append(np.minimum(number[l], number[r]) * len(codes) + np.maximum(number[l], number[r]))
            held += len(l)
            if held < PAIRS and done < len(n):
                continue
            both, shared = np.unique(np.concatenate(found), return_counts=True)
            a, b = np.divmod(both, len(codes))
            ok = differing(a, b, sketches) * (100 + percent) <= (size[a] + size[b]) * (100 - percent)
            a, b, shared, found, held = a[ok], b[ok], shared[ok], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(codes[a]), pa.array(codes[b]), pa.array(shared), pa.array(np.minimum(least[a], least[b]).astype(np.int32))], names=["a", "b", "shared", "need"])

    parts = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "token", "step").sortWithinPartitions("token", "step", "n", "sid", "home").mapInArrow(run, "a long, b long, shared long, need int")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, of every row.

    Two documents link if 100 * shared shingles >= percent * all their shingles.  A
    text without words, or null, links with nothing and is its own class.  Repeated
    rows get a row each; a null id is never the smallest unless its class has no other.
    """
    return _classed(landed(profiles(docs, doc_id, text, k, percent)), k, percent)


def firsts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose id is the smallest of a class, as classes() has them; rows that repeat an id and its text are one.

    Texts aren't shuffled: a batch reads its rows again and gives those kept of them.
    """
    docs = stable(docs)
    every = landed(profiles(docs, doc_id, text, k, percent, placed=True))
    rows = landed(_classed(every, k, percent, ["batch", "place", "digest"]))
    least = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("least")).distinct()
    kept = rows.join(least, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    kept = kept.groupBy("doc_id", "digest").agg(F.min(F.struct("batch", "place")).alias("at")).select("at.batch", "at.place", F.lit(b"").alias("payload"))
    routes = every.where("address IS NOT NULL").select("batch", F.lit(ADDRESS).alias("place"), F.col("address").alias("payload")).unionByName(kept)

    def give(batch, held):
        if held[0][1] != ADDRESS or len(held) > 1 and held[1][1] == ADDRESS:
            raise RuntimeError("a batch has no address, or several")
        if len(held) > 1:
            yield from_bytes(fetch(held[0][2])).take(pa.array([place for _, place, _ in held[1:]]))

    routes = routes.select(F.col("batch").alias("target"), "batch", F.col("place").alias("part"), "payload")
    return gathered(routes, tasks(docs.sparkSession, input_bytes(docs)), give, docs.schema)


def _classed(every: DataFrame, k: int, percent: int, besides: list[str] = []) -> DataFrame:  # noqa: B006
    """What classes() returns, and columns besides, of the rows of profiles(), which are written."""
    whole = ["n", "need", "center", *_BITS]
    some = every.where(F.size("tokens") > 0).groupBy("set_key").agg(*(F.first(c).alias(c) for c in (*whole, "tokens", "body", "sketch")))
    sets = landed(some.withColumn("sid", F.monotonically_increasing_id()))

    # The set nearest to one of n shingles has one more, so the smallest sets are only similar to equal ones.
    lists = sets.where(F.col("n") * 100 >= (F.col("n") + 1) * percent).select("sid", *whole, F.explode("tokens").alias("token"))
    shared = landed(lists.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token"))
    live = landed(lists.join(shared, "token", "left_semi")).withColumn("label", F.col("sid"))
    links, labels = None, None
    for turn in range(STARS):
        rank = F.col("center").cast("long") if turn == 0 else F.xxhash64("sid", F.lit(turn))
        heads = landed(live.groupBy("token").agg(F.max(F.struct(rank.alias("rank"), *_SIDE)).alias("h")).select("token", *(F.col(f"h.{c}").alias(f"{c}_r") for c in _SIDE)))
        near = _side(live, "l").join(heads, "token").where(_fits(percent)).groupBy(F.col("sid_l").alias("a"), F.col("sid_r").alias("b")).agg(F.count("*").alias("shared"))
        near = near.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", "best.b")
        more = landed(verified(near, sets, k, percent))
        links = more if links is None else links.union(more)
        labels = components(links)
        live = _mixed(live, labels)

    across = _across(live, sets, percent).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("need").alias("need")).where("shared >= need").select("a", "b")
    more = landed(verified(across, sets, k, percent))
    if not more.isEmpty():
        labels = components(links.union(more))

    member = landed(sets.select("set_key", "sid").join(labels, "sid", "left").select("set_key", F.coalesce("label", "sid").alias("class")))
    rows = landed(every.select("doc_id", "n", "set_key", *besides).join(member, "set_key", "left"))
    least = landed(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least")))
    out = rows.join(least, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), *besides)
