"""Tool calls in one canonical form, and calls found in generated text.

JSON text needs Python's reading: numbers keep their digits, nested JSON strings are
decoded, and keys are sorted.  So these are Arrow-batched functions; all comparing and
grouping afterwards is done on the canonical text, inside the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T

_CALL = T.StructType([T.StructField("name", T.StringType()), T.StructField("args", T.StringType())])


def compact(value) -> str:
    """JSON with sorted keys, no spaces, and all characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def squeeze(text: str) -> str:
    """Text with each run of white space as one blank."""
    return " ".join(text.split())


def shallow(text: str | None) -> str | None:
    """Canonical text of arguments decoded once; squeezed if it isn't JSON."""
    if text is None:
        return None
    try:
        return compact(json.loads(text))
    except ValueError:
        return squeeze(text)


def deep_value(value):
    """A value with every JSON string inside decoded; a string that decodes to a string isn't decoded again."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return squeeze(value)
    if isinstance(value, dict):
        return {k: deep_value(v) for k, v in value.items()}
    return [deep_value(v) for v in value] if isinstance(value, list) else value


def deep(text: str | None) -> str | None:
    return None if text is None else compact(deep_value(text))


def greedy_call(text: str | None) -> dict | None:
    """The object between the first and the last brace of a text, if it's JSON with a name."""
    found = re.search(r"\{.*\}", text or "", re.S)
    try:
        value = json.loads(found[0]) if found else None
    except ValueError:
        return None
    return value if isinstance(value, dict) and "name" in value else None


def first_call(text: str | None) -> dict | None:
    """The first object in a text, at whatever brace it begins, that has a string name and arguments."""
    reader, text = json.JSONDecoder(), text or ""
    for at in (m.start() for m in re.finditer(r"\{", text)):
        try:
            value, _ = reader.raw_decode(text, at)
        except ValueError:
            continue
        if isinstance(value.get("name"), str) and "arguments" in value:
            return {"name": value["name"], "arguments": deep_value(value["arguments"])}
    return None


def _call_row(call: dict | None) -> dict:
    if call is None:
        return {"name": None, "args": None}
    name = call["name"]
    return {"name": name if isinstance(name, str) else compact(name), "args": compact(call.get("arguments"))}


def _each(one):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: one(None if t is None or t != t else t))

    return run


def _rows(one):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([_call_row(one(None if t is None or t != t else t)) for t in texts], columns=["name", "args"])

    return run


canonical_args = F.pandas_udf(_each(shallow), T.StringType())
canonical_args_deep = F.pandas_udf(_each(deep), T.StringType())
parse_call_greedy = F.pandas_udf(_rows(greedy_call), _CALL)
parse_call = F.pandas_udf(_rows(first_call), _CALL)
