"""Plain Python versions of the operators' contracts, for tests."""

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_LOW)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def op2(docs):
    """Rows of (doc_id, start, n_tokens, ids_crc32); docs: (doc_id, text)."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def op5(docs, items):
    known = defaultdict(set)
    for i, text in items:
        w = alnum_words(text)
        if i is None or not w:
            continue
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            known[tuple(w[k : k + n])].add(str(i))
    sizes, out = {len(k) for k in known}, []
    for i, text in docs:
        w = alnum_words(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := known.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def op6(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, text in docs:
        ids = enc.encode_ordinary(text or "")
        out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return out


def op7(pages):
    first = {}
    for i, html in pages:
        d = (html or "").encode()
        if i is not None and len(d) >= 100:
            first[d] = min(first.get(d, i), i)
    out = []
    for i, html in pages:
        d = (html or "").encode()
        to = first.get(d) if len(d) >= 100 else None
        again = to is not None and to != i
        out.append((i, len(d), hashlib.sha256(d).hexdigest(), "revisit" if again else "response", to if again else None))
    return out


def pieces(word, vocab, longest=None):
    """Greedy longest-match pieces of a word's symbols; vocab: set of symbol tuples."""
    symbols, at, n, longest = [*word, 256], 0, 0, longest or max(map(len, vocab))
    while at < len(symbols) and symbols[at:] != [256]:
        at += next((k for k in range(min(longest, len(symbols) - at), 1, -1) if tuple(symbols[at : at + k]) in vocab), 1)
        n += 1
    return n


def op8(docs, vocab):
    known, out, longest = set(vocab), [], max(map(len, vocab))
    for i, text in docs:
        words = space_words(lower(text))
        out.append((i, len(words), sum(pieces(w.encode(), known, longest) for w in words)))
    return out


def op9_base(docs):
    """Rows of (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    out = []
    for i, text in docs:
        text = text or ""
        w = space_words(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if space_words(line):
                dup += line in seen
                seen.add(line)
        runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = set()
        for k in range(len(w) - 7):
            if runs[tuple(w[k : k + 8])] > 1:
                inside |= set(range(k, k + 8))
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w)))
    return out


def op9_kept(docs, max_texts, max_share, min_words=20, min_left=0.5):
    """Verdicts of (doc_id, host, text) rows, in order."""
    having, hosts = defaultdict(list), Counter(host or "" for _, host, _ in docs)
    norm = lambda line: " ".join(space_words(lower(line)))
    for _, host, text in docs:
        for line in {norm(x) for x in (text or "").split("\n")} - {""}:
            having[host or "", line].append(text or "")
    bad = {k for k, v in having.items() if len(set(v)) > max_texts and len(v) > hosts[k[0]] * max_share}
    out = []
    for (_, host, text), base in zip(docs, op9_base([(d[0], d[2]) for d in docs]), strict=True):
        left = sum(len(space_words(line)) for line in (text or "").split("\n") if (host or "", norm(line)) not in bad)
        out.append(not base[6] and left >= min_words and left >= base[1] * min_left)
    return out
