"""Token arrays of training examples: joined, masked, cut and padded in-row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: the label that a loss ignores.
IGNORED = -100


def encode_left_cut(prompt: Column, completion: Column, limit: int) -> tuple[Column, Column]:
    """(ids, labels) of at most limit tokens; the prompt loses its beginning, its labels are ignored."""
    body = F.slice(completion, 1, limit)
    room = F.lit(limit) - F.size(body)
    kept = F.when(room <= 0, F.slice(prompt, 1, 0)).when(F.size(prompt) <= room, prompt).otherwise(F.slice(prompt, F.size(prompt) - room + 1, room))
    return F.concat(kept, body), F.concat(F.array_repeat(F.lit(IGNORED), F.size(kept)), body)


def pad(ids: Column, labels: Column, limit: int, filler: int) -> tuple[Column, Column, Column]:
    """(ids, labels, attention mask) of exactly limit tokens."""
    missing = F.greatest(F.lit(0), F.lit(limit) - F.size(ids))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), missing))
    return F.concat(ids, F.array_repeat(F.lit(filler), missing)), F.concat(labels, F.array_repeat(F.lit(IGNORED), missing)), mask
