"""Ordered error rules over tool messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The rules' names and patterns, in order of priority; case is ignored.
ERROR_RULES = [
    ("not_found", r"\b(not found|does not exist|unknown)\b"),
    ("invalid_argument", r"\b(invalid|malformed|incorrect|must provide|missing)\b"),
    ("unauthorized", r"\b(unauthorized|forbidden|not permitted)\b"),
    ("conflict", r"\b(conflict|already|not available)\b"),
    ("generic_error", r"^\s*error\s*[:\-]"),
]


def classify_error(text: Column, rules: list[tuple[str, str]] = ERROR_RULES) -> Column:
    """The first rule that a text meets, or null; a null text meets none.

    Word characters and white space are Unicode's, so that accented letters and
    no-break spaces count as in the rules' origin.
    """
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in rules:
        out = out.when(F.coalesce(text, F.lit("")).rlike(f"(?iU){pattern}"), F.lit(name))
    return out
