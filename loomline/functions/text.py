"""Token estimates, message rendering and bounded histories as in-row expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the history format.
OLDER, MARGIN = "[TRUNCATED_OLDER_HISTORY]\n", 32


def token_estimate(chars: Column) -> Column:
    """A quarter of the characters, rounded up, one at least; null counts as none."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(chars, F.lit(0)) / 4)).cast("long")


def render(role: Column, content: Column, name: Column | None = None) -> Column:
    """ROLE name=x: text; a missing role is UNKNOWN and missing text is empty."""
    shown = F.upper(F.coalesce(F.when(role != "", role), F.lit("unknown")))
    named = F.lit("") if name is None else F.coalesce(F.when(name != "", F.concat(F.lit(" name="), name)), F.lit(""))
    return F.concat(shown, named, F.lit(": "), F.coalesce(content, F.lit("")))


def compact_history(system: Column, tail: Column, limit: int) -> Column:
    """All system text, then the last characters of the rest that fit into limit.

    If the system text alone leaves no room, the whole rest stays after the marker.
    White space at both ends goes.
    """
    room = F.greatest(F.lit(0), F.lit(limit) - F.length(system) - MARGIN)
    last = F.when(room == 0, tail).otherwise(F.right(tail, room))
    cut = F.when(F.length(tail) > room, F.concat(F.lit(OLDER), last)).otherwise(tail)
    return F.regexp_replace(F.concat(system, F.lit("\n"), cut), r"(?U)^\s+|\s+\z", "")
