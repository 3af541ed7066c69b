"""Word-piece lengths of texts by a linear longest-match automaton.

The vocabulary is a trie with a failure link and a count of popped tokens at each
node: when no edge fits, the tokens that the path so far stands for are counted
without being built, and matching goes on from the failure link's node.  Each byte
is read once.  All distinct words of a batch run through the automaton side by side.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .arrays import LOWER, SPACE_WORD, blocks, span_hashes, spans, text_buffers

#: Symbols are bytes; this one ends a word.
END = 256


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """The pieces of a tokenizer file as symbols; "</w>" at a piece's end is END."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, mark, out = byte_letters(), model.get("end_of_word_suffix") or "</w>", []
    for token in model["vocab"]:
        body, last = (token[: -len(mark)], (END,)) if token.endswith(mark) and token != mark else (token, ())
        if body and all(c in letters for c in body):
            out.append((*(letters[c] for c in body), *last))
    return out


class Automaton:
    """The trie of some pieces with failure links and popped-token counts.

    Every byte is a piece of its own too, so matching never fails; an END that no
    piece takes along is dropped.
    """

    def __init__(self, pieces):
        edges: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in [*((b,) for b in range(256)), *pieces]:
            at = 0
            for s in piece:
                if s not in edges[at]:
                    edges[at][s] = len(edges)
                    edges.append({})
                    whole.append(False)
                at = edges[at][s]
            whole[at] = True
        fail, popped = [-1] * len(edges), [0] * len(edges)
        queue = [0]
        for u in queue:
            for s, v in edges[u].items():
                queue.append(v)
                if whole[v]:
                    fail[v], popped[v] = 0, 1
                    continue
                z, n = fail[u], popped[u]
                while z >= 0 and s not in edges[z]:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], popped[v] = edges[z][s], n
        pairs = sorted((u * 257 + s, v) for u, e in enumerate(edges) for s, v in e.items())
        self.keys, self.to = np.array([k for k, _ in pairs]), np.array([v for _, v in pairs])
        self.fail, self.popped = np.array(fail), np.array(popped)

    def _step(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        want = at * 257 + symbol
        place = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[place] == want, self.to[place], -1)

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Pieces of each word, END included in its last piece where the vocabulary has it so."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        at, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for p in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -p, "left"))
            self._read(at, count, np.arange(n), data[starts[:n] + p].astype(np.int64))
        self._read(at, count, np.flatnonzero(lengths > 0), END)
        left = np.flatnonzero(at > 0)
        while len(left):
            count[left] += self.popped[at[left]]
            at[left] = self.fail[at[left]]
            left = left[at[left] > 0]
        out = np.empty(len(order), np.int64)
        out[order] = count
        return out

    def _read(self, at: np.ndarray, count: np.ndarray, left: np.ndarray, symbol) -> None:
        symbol = np.broadcast_to(np.asarray(symbol, np.int64), left.shape)
        while len(left):
            to = self._step(at[left], symbol)
            done = to >= 0
            at[left[done]] = to[done]
            stuck = ~done & (at[left] > 0)
            left, symbol = left[stuck], symbol[stuck]
            count[left] += self.popped[at[left]]
            at[left] = self.fail[at[left]]


@lru_cache(2)
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


def count(docs: DataFrame, vocab: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_words and n_pieces, the greedy longest-match pieces of their words.

    Words are runs of characters other than the six ASCII white spaces, A-Z
    lower-cased.  keep: the columns of docs to return, all by default; older columns
    with the added names go.  A null or empty text has no words and no pieces.
    """
    docs = docs.drop("n_words", "n_pieces")
    keep = [c for c in (keep or docs.columns) if c not in ("n_words", "n_pieces")]

    def run(stream):
        machine = automaton(vocab)
        for rows in stream:
            data, offsets = text_buffers(rows[text])
            for a, b, part, offs in blocks(data, offsets, 4 << 20):
                low = LOWER[part]
                starts, ends, first = spans(SPACE_WORD[low], offs)
                _, at, place = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
                pieces = np.r_[0, np.cumsum(machine.counts(low, starts[at], (ends - starts)[at])[place])]
                piece = rows.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(piece[c] for c in keep), pa.array(np.diff(first)), pa.array(np.diff(pieces[first]))], names=[*keep, "n_words", "n_pieces"])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("n_pieces", T.LongType())]))
