"""Line dedup by an exact set-similarity join.

A line is the set of its distinct words.  Equal sets are found, and the lines that
have each word counted, in one exchange of keys; only the first line of each set goes
on.  Its words are ordered by rarity, and words of one line only are left out.  Two
lines as similar as asked share most of their *pairs of neighbours* in that order: with
o words in common, at least 3 o - 1 - n - m pairs.  So they share a pair within a
prefix of each line's pairs, of 0.4 n + 1 at most, and lines are listed by the pairs of
their prefixes.  A list of two words together doesn't grow with a vocabulary's frequent
words.  Lines of a list are compared if their lengths and the pair's places in both
allow it, and are verified on the words of both.  A line that matches an earlier one is
removed; lines are ordered by document id and place.

Lists are made and compared in packed arrays, where a line is an id and a place; texts
stay where the exchange wrote them, by batch.  A line is first compared with the FIRST
lines of each of its lists, and only lines that these don't remove with all earlier lines
of their lists.  So copies make no pairs among each other, and since a removed line stays
a possible match for later ones, no match is lost.  A parity of each line's words in 128
bits bounds the words in which two lines differ from below; only for pairs that it lets
pass a text is sent, from the earlier line's batch to the later one's.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .arrays import LOWER, SPACE_WORD, blocks, distinct, gather, mix, narrow, pack, ranked, sorted_set, span_hashes, spans, text_buffers, unpack
from .exchange import ADDRESS, addressed, cut, exchange, fetch, from_bytes, gathered, landed, routed

#: Every line with a word counts; lines of fewer different words than asked are left alone.
MIN_WORDS, PERCENT = 1, 80
#: Every line of a list is compared with so many of the list's earliest lines first.
FIRST = 4
#: Lists are told apart by the top 48 bits of a pair's hash; other lines in a list make candidates only.
_LIST_BITS = np.uint64(16)
_NULL_ID = np.int64(-(1 << 63))
#: An id and what tells rows of one id apart, beside a row's own columns.
_D, _TH = "__dedup_id__", "__dedup_text__"
#: Kinds of the rows that steps send each other, by their part.
_EQUAL, _SKETCHES, _POSTS, _CANDIDATES, _LISTED, _LIST, _WANTED, _TEXTS, _MATCHED, _ASKED = range(10)


class Lines:
    """The lines of a batch that count, as sets of words.

    keys: distinct word hashes in order; place, first: each set's members in them;
    row, line: where each set's line is; key: a hash of each set; words: lines with
    words of each row.
    """

    def __init__(self, column: pa.Array, min_words: int):
        data, offsets = text_buffers(column)
        hashes, rows, lines = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, _, part, offs in blocks(data, offsets):
            low = LOWER[part]
            starts, ends, first = spans(SPACE_WORD[low], offs)
            hashes.append(span_hashes(low, starts, ends))
            row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
            breaks = np.r_[0, np.cumsum(part == 10)]
            rows.append(row + a)
            lines.append(breaks[starts] - breaks[offs[row]])
        words, row, line = np.concatenate(hashes), np.concatenate(rows), np.concatenate(lines)
        new = np.ones(len(words), bool)
        new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
        at = np.flatnonzero(new)
        self.words = np.bincount(row[at], minlength=len(offsets) - 1)
        self.keys, place = distinct(words)
        scale = max(1, len(self.keys))
        which, place = np.divmod(sorted_set((np.cumsum(new) - 1) * scale + place), scale)
        size = np.bincount(which, minlength=len(at))
        keep = size >= min_words
        self.place, self.row, self.line = place[keep[which]], row[at[keep]], line[at[keep]]
        self.size = size[keep]
        self.first = np.r_[0, np.cumsum(self.size)]
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(self.keys)[self.place], dtype=np.uint64)]
        self.key = mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(np.uint64)) & ~np.uint64(1)


    def parity(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set in two words, each bit the parity of the words that fall on it."""
        spot, out = mix(self.keys ^ np.uint64(0x7061)) >> np.uint64(57), []
        for half in (0, 1):
            bits = np.where(spot >> np.uint64(6) == half, np.left_shift(np.uint64(1), spot & np.uint64(63)), np.uint64(0))
            out.append(np.bitwise_xor.reduceat(bits[self.place], self.first[:-1]) if len(self.size) else np.zeros(0, np.uint64))
        return out[0], out[1]


class Places:
    """Where lines are: document id, what tells rows of an id apart, and the line's number."""

    def __init__(self, d: np.ndarray, th: np.ndarray, line: np.ndarray):
        self.d, self.th, self.line = d, th, line

    def __getitem__(self, at) -> Places:
        return Places(self.d[at], self.th[at], self.line[at])

    def __len__(self) -> int:
        return len(self.d)

    def names(self) -> np.ndarray:
        """A 64-bit hash of each."""
        return mix(_row_names(self.d, self.th) * np.uint64(0xD6E8FEB86659FD93) + self.line.astype(np.uint64))

    def arrays(self) -> list[np.ndarray]:
        """Four unsigned arrays, for pack()."""
        d = self.d.view(np.uint64)
        least = d.min(keepdims=True) if len(d) else d
        return [least, narrow(d - least) if len(d) else d, self.th.view(np.uint64), narrow(self.line)]

    @staticmethod
    def of(least: np.ndarray, d: np.ndarray, th: np.ndarray, line: np.ndarray) -> Places:
        """The places of arrays()."""
        return Places((d.astype(np.uint64) + (least if len(d) else 0)).view(np.int64), th.view(np.int64), line.astype(np.int64))

    @staticmethod
    def joined(parts: list[Places]) -> Places:
        none = np.zeros(0, np.int64)
        return Places(*(np.concatenate([none, *(getattr(p, c) for p in parts)]) for c in ("d", "th", "line")))


def _row_names(d: np.ndarray, th: np.ndarray) -> np.ndarray:
    return mix(mix(d.view(np.uint64)) + th.view(np.uint64))


def _places(rows: pa.RecordBatch, lines: Lines) -> Places:
    return Places(rows[_D].to_numpy()[lines.row], rows[_TH].to_numpy()[lines.row], lines.line)


def _keys(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    """(the id, the least number for null; what tells rows of one id apart: a hash of the text, or 0 if no id repeats)."""
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit(int(_NULL_ID)))
    repeats = not docs.select(d.alias("d")).groupBy("d").count().where("count > 1").isEmpty()
    return d, F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if repeats else F.lit(0).cast("long")


@lru_cache(8)
def _longest(top: int, percent: int) -> np.ndarray:
    out = np.zeros(top + 1, np.int64)
    for n in range(1, top + 1):
        m = np.arange(-(-n * percent // 100), n * 100 // percent + 1)
        shared = -(-percent * (n + m) // (100 + percent))
        out[n] = (2 * n + m - 3 * shared + 1).max()
    return out


def prefix_pairs(n: np.ndarray, unique: np.ndarray, percent: int) -> np.ndarray:
    """Pairs in the prefix of sets of n words, unique of which no other set has.

    With m words in the other set and o in common, n - unique - 1 pairs of which
    3 o - 1 - (n - unique) - m at least are shared; the longest prefix over all m counts.
    """
    longest = _longest(1 << int(n.max(initial=1)).bit_length(), percent)
    return np.clip(longest[n] - 2 * unique, 0, np.maximum(n - unique - 1, 0))


def _posted(docs: DataFrame, text: str, min_words: int, percent: int) -> tuple[DataFrame, int]:
    """For each batch its address and equal lines, and the prefixes' pairs by range of their keys; and the number of ranges."""

    def asked(rows):
        lines = Lines(rows[text], min_words)
        at = _places(rows, lines)
        order = np.lexsort((at.line, at.th, at.d, lines.key))
        new = np.ones(len(order), bool)
        new[1:] = lines.key[order][1:] != lines.key[order][:-1]
        lead = order[new]
        words = mix(lines.keys) | np.uint64(1)
        both = np.r_[words, lines.key[lead]]
        sort = np.argsort(both)
        none = np.zeros(len(words), np.int64)
        counts = np.r_[np.bincount(lines.place, minlength=len(words)), np.ones(len(lead), np.int64)]
        return lines, both[sort], counts[sort], Places(*(np.r_[none, x[lead]][sort] for x in (at.d, at.th, at.line))), sort

    def ask(rows):
        _, keys, counts, at, _ = asked(rows)
        return keys, lambda a, b: pack(np.diff(keys[a:b], prepend=np.uint64(0)), narrow(counts[a:b]), *at[a:b].arrays())

    def answer(slices):
        parts = [unpack(x) for x in slices]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        counts, at = np.concatenate([p[1] for p in parts]), Places.joined([Places.of(*p[2:]) for p in parts])
        sets = np.flatnonzero((keys & np.uint64(1)) == 0)
        _, place = distinct(keys)
        totals = np.bincount(place, counts.astype(np.float64)).astype(np.int64)[place]
        order = sets[np.lexsort((at.line[sets], at.th[sets], at.d[sets], keys[sets]))]
        lead = np.zeros(len(keys), bool)
        if len(order):
            new = np.ones(len(order), bool)
            new[1:] = keys[order][1:] != keys[order][:-1]
            head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            lead[order] = (at.d[order] == at.d[head]) & (at.th[order] == at.th[head]) & (at.line[order] == at.line[head])
        ends = np.cumsum([len(p[0]) for p in parts])
        return [pack(narrow(totals[e - len(p[0]) : e]), lead[e - len(p[0]) : e].astype(np.uint8)) for p, e in zip(parts, ends, strict=True)]

    def compute(batch, address, rows, replies):
        lines, keys, _, lead_at, sort = asked(rows)
        got = [unpack(x) for x in replies]
        totals, lead = (np.concatenate([np.zeros(0, np.int64), *(g[i] for g in got)]).astype(np.int64) for i in (0, 1))
        if len(totals) != len(keys):
            raise RuntimeError("a batch wasn't read alike twice")
        back = np.empty(len(sort), np.int64)
        back[sort] = np.arange(len(sort))
        df = totals[back[: len(lines.keys)]]
        # The first line of a set: its batch's leading place, and that is the set's leading place.
        sets = back[len(lines.keys) :]
        sets = sets[np.argsort(keys[sets])]
        mine = sets[np.searchsorted(keys[sets], lines.key)] if len(sets) else np.zeros(0, np.int64)
        at = _places(rows, lines)
        leads = (lead[mine] == 1) & (lead_at.d[mine] == at.d) & (lead_at.th[mine] == at.th) & (lead_at.line[mine] == at.line)
        gone = np.flatnonzero(~leads)
        equal = pack(narrow(lines.words), narrow(lines.row[gone]), narrow(lines.line[gone]))
        yield routed(-1 - batch, batch, [ADDRESS, _EQUAL], [address, equal])

        n, which = lines.size, np.repeat(np.arange(len(lines.size)), lines.size)
        place = ranked(which, df[lines.place], lines.place, len(lines.keys))
        nth = np.arange(len(place)) - np.repeat(lines.first[:-1], n)
        unique = np.bincount(which[df[place] == 1], minlength=len(n))
        # The set nearest to one of n words has one word more, so of the shortest only equal sets match, which are found above.
        pairs = np.where(leads & (n * 100 >= (n + 1) * percent), prefix_pairs(n, unique, percent), 0)
        some = np.flatnonzero(pairs)
        yield routed(-1 - batch, batch, _SKETCHES, [pack(*at[some].arrays(), narrow(n[some]), *(x[some] for x in lines.parity()))])
        use = np.flatnonzero((nth >= np.repeat(unique, n)) & (nth < np.repeat(unique + pairs, n)))
        word = lines.keys[place]
        key = mix(mix(word[use]) + word[use + 1]) >> _LIST_BITS << _LIST_BITS
        order = np.argsort(key)
        key, of, nth = key[order], which[use][order], nth[use][order]
        ends = cut(key, n_ranges)
        full = np.flatnonzero(np.diff(ends))
        packed = [pack(np.diff(key[a:b], prepend=np.uint64(0)), narrow(n[of[a:b]]), narrow(nth[a:b]), *at[of[a:b]].arrays()) for a, b in zip(ends[full].tolist(), ends[full + 1].tolist(), strict=True)]
        yield routed(full, batch, _POSTS, packed)

    answered, parts = exchange(docs, text, ask, answer)
    n_ranges = 1 << (2 * parts - 1).bit_length()
    return addressed(answered, parts, compute), parts


def _may_match(n_l, n_r, at_l, at_r, percent: int) -> np.ndarray:
    """The length filter and, by the place of a shared word in both orders, the positional filter."""
    length = 100 * np.minimum(n_l, n_r) >= percent * np.maximum(n_l, n_r)
    least = -(-percent * (n_l + n_r) // (100 + percent))
    return length & (np.minimum(at_l, at_r) + np.minimum(n_l - at_l, n_r - at_r) >= least)


def _to_batches(batch: np.ndarray, source: int, part: int, arrays):
    """Rows for the batches, in order, of what arrays(a, b) gives of each stretch."""
    if not len(batch):
        return
    at = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]])
    stretches = list(zip(at.tolist(), [*at[1:].tolist(), len(batch)], strict=True))
    yield routed(batch[at], source, part, [pack(*arrays(a, b)) for a, b in stretches])


def _lists(percent: int):
    """The handler of a range's posts: candidates for each later line of a list, and lists of more lines than those."""

    def handle(target, rows):
        if target < 0:
            yield routed([b for b, _, _ in rows], [b for b, _, _ in rows], [p for _, p, _ in rows], [x for _, _, x in rows])
            return
        parts = [unpack(x) for _, _, x in rows]
        key = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]  # lists of several posts
        key, n, nth = key[order], *(np.concatenate([p[i] for p in parts])[order].astype(np.int64) for i in (1, 2))
        batch = np.repeat([b for b, _, _ in rows], [len(p[0]) for p in parts])[order]
        at = Places.joined([Places.of(*p[3:]) for p in parts])[order]
        parts = order = None
        order = np.lexsort((at.line, at.th, at.d, key))
        key, n, nth, batch, at = key[order], n[order], nth[order], batch[order], at[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(key)])
        head, place = np.repeat(first, size), np.arange(len(key)) - np.repeat(first, size)
        found = [np.zeros((2, 0), np.int64)]
        for k in range(FIRST):
            r = np.flatnonzero(place > k)
            l = head[r] + k  # noqa: E741
            ok = _may_match(n[l], n[r], nth[l], nth[r], percent) & ((at.d[l] != at.d[r]) | (at.th[l] != at.th[r]) | (at.line[l] != at.line[r]))
            found.append(np.stack([l[ok], r[ok]]))
        l, r = np.concatenate(found, axis=1)  # noqa: E741
        order = np.argsort(batch[r], kind="stable")
        l, r = l[order], r[order]  # noqa: E741
        yield from _to_batches(batch[r], target, _CANDIDATES, lambda a, b: (*at[r[a:b]].arrays(), batch[l[a:b]].view(np.uint64), *at[l[a:b]].arrays()))
        long = size > FIRST + 1
        if long.any():
            keep = np.repeat(long, size)
            number = np.repeat(np.cumsum(long) - 1, size)
            yield routed([target], target, _LIST, [pack(size[long], narrow(n[keep]), narrow(nth[keep]), batch[keep].view(np.uint64), *at[keep].arrays())])
            r = np.flatnonzero(keep & (place > FIRST))
            r = r[np.argsort(batch[r], kind="stable")]
            yield from _to_batches(batch[r], target, _LISTED, lambda a, b: (*at[r[a:b]].arrays(), narrow(number[r[a:b]]), narrow(place[r[a:b]])))

    return handle


def _matched(rows) -> np.ndarray:
    """The names of the lines that are matched, in order."""
    return np.sort(Places.joined([Places.of(*unpack(x)) for _, p, x in rows if p == _MATCHED]).names())


class _Sketches:
    """Sizes and parities of a batch's lines by their places."""

    def __init__(self, rows):
        parts = [unpack(x) for _, p, x in rows if p == _SKETCHES]
        names = Places.joined([Places.of(*p[:4]) for p in parts]).names()
        self.order = np.argsort(names)
        self.names = names[self.order]
        self.n, self.one, self.two = (np.concatenate([np.zeros(0, np.uint64), *(p[i].astype(np.uint64) for p in parts)]) for i in (4, 5, 6))

    def get(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(size, the parity's two words) of each named line."""
        at = self.order[np.searchsorted(self.names, names)]
        return self.n[at].astype(np.int64), self.one[at], self.two[at]


def _chosen(target, rows):
    """The handler of a batch's candidates: wants the earlier lines for those of its lines that aren't matched yet."""
    parts = [unpack(x) for _, p, x in rows if p == _CANDIDATES]
    if not parts:
        return
    r, l = (Places.joined([Places.of(*p[i : i + 4]) for p in parts]) for i in (0, 5))  # noqa: E741
    batch = np.concatenate([p[4] for p in parts]).view(np.int64)
    right, left = r.names(), l.names()
    keep = np.flatnonzero(~np.isin(right, _matched(rows)))
    order = keep[np.lexsort((left[keep], right[keep]))]
    new = np.ones(len(order), bool)
    new[1:] = (right[order][1:] != right[order][:-1]) | (left[order][1:] != left[order][:-1])
    order = order[new]
    order = order[np.argsort(batch[order], kind="stable")]
    n, one, two = _Sketches(rows).get(right[order])
    yield from _to_batches(batch[order], target, _WANTED, lambda a, b: (*l[order[a:b]].arrays(), *r[order[a:b]].arrays(), narrow(n[a:b]), one[a:b], two[a:b]))


class _Texts:
    """The lines of a batch's rows by their places."""

    def __init__(self, address: bytes, text: str):
        self.rows = from_bytes(fetch(address))
        self.data, self.offsets = text_buffers(self.rows[text])
        self.breaks = np.flatnonzero(self.data == 10)
        self.before = np.searchsorted(self.breaks, self.offsets)
        self.names = _row_names(self.rows[_D].to_numpy(), self.rows[_TH].to_numpy())
        self.order = np.argsort(self.names, kind="stable")

    def get(self, at: Places) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the lines one after the other, length of each)."""
        row = self.order[np.searchsorted(self.names, _row_names(at.d, at.th), sorter=self.order)]
        nth = self.before[row] + at.line
        breaks = np.r_[self.breaks, len(self.data)]
        start = np.where(at.line > 0, breaks[nth - 1] + 1, self.offsets[row])
        length = np.where(nth < self.before[row + 1], breaks[np.minimum(nth, len(breaks) - 1)], self.offsets[row + 1]) - start
        return gather(self.data, start, length), length


def _fetched(text: str, percent: int):
    """The handler of a batch's wanted lines: sends the texts of those that parities let match to the batches that want them."""

    def handle(target, rows):
        wanted = [(batch, unpack(x)) for batch, p, x in rows if p == _WANTED]
        if not wanted:
            return
        l, r = (Places.joined([Places.of(*p[i : i + 4]) for _, p in wanted]) for i in (0, 4))  # noqa: E741
        n_r, one, two = (np.concatenate([p[i].astype(np.uint64) for _, p in wanted]) for i in (8, 9, 10))
        batch = np.repeat([b for b, _ in wanted], [len(p[8]) for _, p in wanted])
        n, mine, other = _Sketches(rows).get(l.names())
        n += n_r.astype(np.int64)
        differ = np.bitwise_count(mine ^ one).astype(np.int64) + np.bitwise_count(other ^ two)
        keep = np.flatnonzero(differ <= n - 2 * -(-percent * n // (100 + percent)))
        if not len(keep):
            return
        l, r, batch = l[keep], r[keep], batch[keep]  # noqa: E741
        data, lengths = _Texts(rows[0][2], text).get(l)
        ends = np.r_[0, np.cumsum(lengths)]
        at = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1], True])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield routed([batch[a]], target, _TEXTS, [pack(*r[a:b].arrays(), narrow(lengths[a:b]), data[ends[a] : ends[b]])])

    return handle


def similar(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Whether lines of two series (bytes, lengths) have word sets as similar as asked, in pairs."""
    sides = []
    for data, lengths in (one, two):
        offsets, hashes, rows = np.r_[0, np.cumsum(lengths)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, _, part, offs in blocks(data, offsets):
            low = LOWER[part]
            starts, ends, first = spans(SPACE_WORD[low], offs)
            hashes.append(span_hashes(low, starts, ends))
            rows.append(np.repeat(np.arange(len(offs) - 1), np.diff(first)) + a)
        sides.append((np.concatenate(rows), np.concatenate(hashes)))
    keys, place = distinct(np.concatenate([h for _, h in sides]))
    cut, scale = len(sides[0][0]), max(1, len(keys))
    a, b = sorted_set(sides[0][0] * scale + place[:cut]), sorted_set(sides[1][0] * scale + place[cut:])
    n = len(one[1])
    shared = np.bincount(np.intersect1d(a, b, assume_unique=True) // scale, minlength=n)
    return shared * 100 >= percent * (np.bincount(a // scale, minlength=n) + np.bincount(b // scale, minlength=n) - shared)


def _verified(text: str, percent: int):
    """The handler of the texts that a batch got for its lines: the lines that are similar to one."""

    def handle(target, rows):
        if len(rows) == 1:
            return
        texts, found = _Texts(rows[0][2], text), []
        for a in range(1, len(rows), 64):
            parts = [unpack(x) for _, _, x in rows[a : a + 64]]
            at = Places.joined([Places.of(*p[:4]) for p in parts])
            theirs = np.concatenate([p[5] for p in parts]), np.concatenate([p[4] for p in parts]).astype(np.int64)
            found.append(at[similar(texts.get(at), theirs, percent)])
        found = Places.joined(found)
        if len(found):
            yield routed(target, target, _MATCHED, [pack(*found[np.unique(found.names(), return_index=True)[1]].arrays())])

    return handle


def _unmatched(target, rows):
    """The handler of a batch's places in long lists: asks for the candidates of those lines that aren't matched."""
    listed = [(source, unpack(x)) for source, p, x in rows if p == _LISTED]
    if not listed:
        return
    at = Places.joined([Places.of(*p[:4]) for _, p in listed])
    number, place = (np.concatenate([p[i] for _, p in listed]) for i in (4, 5))
    source = np.repeat([b for b, _ in listed], [len(p[4]) for _, p in listed])
    left = np.flatnonzero(~np.isin(at.names(), _matched(rows)))
    yield from _to_batches(source[left], target, _ASKED, lambda a, b: (*at[left[a:b]].arrays(), narrow(number[left[a:b]]), narrow(place[left[a:b]])))


def _expanded(percent: int):
    """The handler of a range's long lists: all lines before those that were asked for, but for the FIRST ones."""

    def handle(target, rows):
        size, n, nth, batch, *at = unpack(next(x for _, p, x in rows if p == _LIST))
        n, nth, batch, at, first = n.astype(np.int64), nth.astype(np.int64), batch.view(np.int64), Places.of(*at), np.r_[0, np.cumsum(size.astype(np.int64))]
        asked = [(b, unpack(x)) for b, p, x in rows if p == _ASKED]
        own = np.concatenate([first[p[4].astype(np.int64)] + p[5].astype(np.int64) for _, p in asked])
        count = np.concatenate([p[5].astype(np.int64) for _, p in asked]) - FIRST
        asker = np.repeat([b for b, _ in asked], [len(p[4]) for _, p in asked])
        upto, done = np.cumsum(count), 0
        while done < len(own):  # some million comparisons at a time
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + (1 << 22))))
            r = np.repeat(np.arange(done, stop), count[done:stop])
            l = own[r] - 1 - (np.arange(len(r)) - np.repeat(upto[done:stop] - count[done:stop] - (upto[done - 1] if done else 0), count[done:stop]))  # noqa: E741
            line = own[r]
            ok = _may_match(n[l], n[line], nth[l], nth[line], percent) & ((at.d[l] != at.d[line]) | (at.th[l] != at.th[line]) | (at.line[l] != at.line[line]))
            line, l, to = line[ok], l[ok], asker[r[ok]]  # noqa: E741
            yield from _to_batches(to, target, _CANDIDATES, lambda a, b, line=line, l=l: (*at[line[a:b]].arrays(), batch[l[a:b]].view(np.uint64), *at[l[a:b]].arrays()))  # noqa: E741
            done = stop

    return handle


def _near(made: DataFrame, parts: int, text: str, percent: int) -> list[DataFrame]:
    """The rows of matched lines by batch: those that the first lines of lists match, and the others."""
    kind = lambda *p: made.where(F.col("part").isin(*p))

    def step(candidates):
        wanted = gathered(kind(_SKETCHES).union(candidates), parts, _chosen)
        texts = gathered(kind(ADDRESS, _SKETCHES).union(wanted), parts, _fetched(text, percent))
        return landed(gathered(kind(ADDRESS).union(texts), parts, _verified(text, percent)))

    done = step(kind(_CANDIDATES))
    asked = landed(gathered(kind(_LISTED).union(done), parts, _unmatched))
    if asked.isEmpty():
        return [done]
    lists = kind(_LIST).join(asked.select("target").distinct(), "target", "left_semi").select(*asked.columns)
    return [done, step(gathered(lists.union(asked), parts, _expanded(percent)))]


def _removed(docs: DataFrame, doc_id: str, text: str, min_words: int, percent: int, give, schema) -> DataFrame:
    """give(rows, lines with words of each row, rows and lines of what is removed) for all batches of docs."""
    if percent < 75:
        raise ValueError("lines less similar than 75 % needn't share neighbouring words")
    d, th = _keys(docs, doc_id, text)
    made, parts = _posted(docs.withColumns({_D: d, _TH: th}), text, min_words, percent)
    made = landed(gathered(made, parts, _lists(percent)))
    rows = made.where(F.col("part").isin(ADDRESS, _EQUAL))
    for more in _near(made, parts, text, percent):
        rows = rows.union(more)

    def handle(target, rows):
        whole = from_bytes(fetch(rows[0][2]))
        words, row, line = unpack(rows[1][2])
        row, line = [row.astype(np.int64)], [line.astype(np.int64)]
        gone = Places.joined([Places.of(*unpack(x)) for _, p, x in rows if p == _MATCHED])
        names = _row_names(whole[_D].to_numpy(), whole[_TH].to_numpy())
        order = np.argsort(names, kind="stable")
        mine = _row_names(gone.d, gone.th)
        first, past = (np.searchsorted(names, mine, side, sorter=order) for side in ("left", "right"))
        row.append(gather(order, first, past - first))  # rows that repeat an id and its text lose the same lines
        line.append(np.repeat(gone.line, past - first))
        row, line = np.concatenate(row), np.concatenate(line)
        top = int(line.max(initial=0)) + 1
        row, line = np.divmod(sorted_set(row * top + line), top)
        yield from give(whole, words.astype(np.int64), row, line)

    return gathered(rows, parts, handle, schema)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines (with words), removed (line numbers from 0, in order) and n_removed of every row.

    A line is removed if an earlier one has the same words, or a Jaccard similarity
    of percent (75 at least) with it.  Lines of fewer than min_words different words
    stay.  Ids are integers, or texts of integers.  A null or empty text has no lines;
    a null id comes before all others; rows of one id are ordered by a hash of their
    texts, and equal rows don't remove each other's lines.  Other columns don't matter.
    """

    def give(rows, words, row, line):
        ends = np.searchsorted(row, np.arange(rows.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(line, pa.int32()))
        yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(words), lists, pa.array(np.diff(ends))], names=["doc_id", "n_lines", "removed", "n_removed"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL("n_lines long, removed array<int>, n_removed long").fields])
    return _removed(slim, "doc_id", "text", min_words, percent, give, schema)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the removed lines, as find() has them; a text that had words and lost all of them is empty.

    All other columns stay as they are, whatever their names.
    """

    def give(rows, words, row, line):
        changed = np.unique(row)
        texts = rows[text].take(pa.array(changed)).to_pylist()
        ends = np.searchsorted(row, np.r_[changed, rows.num_rows])
        for k, t in enumerate(texts):
            gone = set(line[ends[k] : ends[k + 1]].tolist())
            texts[k] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        mask = np.zeros(rows.num_rows, bool)
        mask[changed] = True
        left = pc.replace_with_mask(rows[text], pa.array(mask), pa.array(texts, rows[text].type))
        yield pa.RecordBatch.from_arrays([left if c == text else rows[c] for c in names], names=names)

    names = docs.columns
    return _removed(docs, doc_id, text, min_words, percent, give, docs.schema)
