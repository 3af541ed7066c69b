"""Plain Python versions of the joins, the language model's base and the pipeline, for tests."""

import math
import zlib
from collections import Counter, defaultdict

import brute


def shingles(text, k=4):
    w = brute.space_words(brute.lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def op10(docs, k=4, percent=85):
    """Rows of (doc_id, n_shingles, component_id) of (doc_id, text) rows, in order."""
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    near = {(a, b) for ids in by.values() for j, a in enumerate(ids) for b in ids[j + 1 :]}
    for a, b in near:
        same = len(sets[a] & sets[b])
        if 100 * same >= percent * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)].append(d)
    return [(d, len(sets[i]), d if not sets[i] else min(least[root(i)], default=None)) for i, (d, _) in enumerate(docs)]


def op3(docs, key, min_words=1, percent=80):
    """Removed line numbers of every row; key: a row's place in the order."""
    lines = []
    for i, (_, text) in enumerate(docs):
        for n, line in enumerate((text or "").split("\n")):
            words = frozenset(brute.space_words(brute.lower(line)))
            if len(words) >= min_words:
                lines.append(((*key(docs[i]), n), i, words))
    first = {}
    for place, _, words in lines:
        first[words] = min(first.get(words, place), place)
    by = defaultdict(list)
    for words in first:
        for w in words:
            by[w].append(words)
    gone = [set() for _ in docs]
    for place, i, words in lines:
        seen = Counter(o for w in words for o in by[w] if first[o] < place)
        if any(100 * n >= percent * (len(words) + len(o) - n) for o, n in seen.items()):
            gone[i].add(place[-1])
    return [sorted(g) for g in gone]


def op1_base(docs):
    """Rows of (doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10 == 0
    tokens = [[*brute.space_words(brute.lower(t)), None] for _, t in docs]
    c = Counter(w for (d, _), ws in zip(docs, tokens, strict=True) if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (d, _), ws in zip(docs, tokens, strict=True)]


def op1_score(docs, rounds=30, settled=1e-3, buckets=25):
    """The model's log10 probability of every text, position by position."""
    fold = [zlib.crc32(str("" if d is None else d).encode()) % 10 for d, _ in docs]
    tokens = [[*brute.space_words(brute.lower(t)), None] for _, t in docs]

    def counts(of):
        word, pair = Counter(), Counter()
        for f, ws in zip(fold, tokens, strict=True):
            if of(f):
                word.update(ws)
                pair.update(zip(["", *ws], ws, strict=False))
        return word, pair

    def parts(word, pair, ws, n, uniform):
        for v, w in zip(["", *ws], ws, strict=False):
            context = word[None] if v == "" else word[v]
            yield min(math.frexp(context)[1], buckets - 1), (pair[v, w] / max(1, context), word[w] / max(1, n), uniform)

    word, pair = counts(lambda f: f > 0)
    uniform, kept = 1 / (len(word) + 1), counts(lambda f: f > 1)
    held = [x for f, ws in zip(fold, tokens, strict=True) if f == 1 for x in parts(*kept, ws, sum(kept[0].values()), uniform)]
    weights = {b: (0.4, 0.4, 0.2) for b in range(buckets)}
    for _ in range(rounds):
        gained = {b: [0.5] * 3 for b, _ in held}
        for b, p in held:
            share = [w * x for w, x in zip(weights[b], p, strict=True)]
            gained[b] = [g + x / sum(share) for g, x in zip(gained[b], share, strict=True)]
        new = {b: tuple(x / sum(g) for x in g) for b, g in gained.items()}
        change = max((abs(x - y) for b in new for x, y in zip(new[b], weights[b], strict=True)), default=0)
        weights |= new
        if change < settled:
            break
    seen = sorted({b for b, _ in held})
    for b in set(range(buckets)) - set(seen) if seen else ():
        weights[b] = weights[max((x for x in seen if x < b), default=seen[0])]
    weights[0] = (0, weights[0][1] / sum(weights[0][1:]), weights[0][2] / sum(weights[0][1:]))
    n = sum(word.values())
    return [sum(math.log10(sum(w * x for w, x in zip(weights[b], p, strict=True))) for b, p in parts(word, pair, ws, n, uniform)) for ws in tokens]


def pipeline(docs, items):
    """Rows of the pipeline over (doc_id, source, text) rows with different ids."""
    keep = brute.op9_kept([(d, s, t) for d, s, t in docs], 20, 0.05)
    docs = [(d, t) for (d, _, t), k in zip(docs, keep, strict=True) if k]
    gone = op3(docs, lambda r: (r[0],), min_words=1)
    docs = [(d, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g)) for (d, t), g in zip(docs, gone, strict=True)]
    docs = [(d, t) for d, t in docs if brute.space_words(t)]
    docs = [(d, t) for (d, t), (_, _, c) in zip(docs, op10(docs), strict=True) if c == d]
    docs = [(d, t) for (d, t), r in zip(docs, brute.op5(docs, items), strict=True) if not r[5]]
    return brute.op6(docs)
