"""Typed fields out of JSON text with a single parse per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def _steps(path: str) -> list[str | int]:
    return [int(i) if i else name for name, i in _STEP.findall(path)]


def _add(tree: dict, steps: list[str | int], path: str) -> None:
    """Record a path in a nested dict; array steps share the key ``[]``."""
    for step in steps:
        key = "[]" if isinstance(step, int) else step
        if tree and ("[]" in tree) != (key == "[]"):
            raise ValueError(f"{path!r} reads a field both as array and as object")
        tree = tree.setdefault(key, {})


def _type(tree: dict) -> T.DataType:
    if not tree:
        return T.StringType()
    if "[]" in tree:
        return T.ArrayType(_type(tree["[]"]))
    return T.StructType([T.StructField(k, _type(v)) for k, v in tree.items()])


def json_project(
    df: DataFrame, col: str, fields: dict[str, tuple[str, str]], keep: list[str] | None = None
) -> DataFrame:
    """Add ``fields`` = ``{name: (path, type)}``; paths look like ``a.b`` or ``kids[0]``.

    A type ending in ``[]`` reads an array of that type. Every leaf is read as
    text first, so a number kept as text and a number cast alike. Casts follow
    the session's ANSI setting: where failing is not wanted, validate first.
    """
    tree: dict = {}
    for path, kind in fields.values():
        _add(tree, _steps(path) + ([0] if kind.endswith("[]") else []), path)
    parsed = "__json"
    kept = df.columns if keep is None else keep
    # Exploding a one-element array keeps later filters above the parse. Pushed
    # below it, each filtered field would parse the text again.
    document = F.from_json(F.col(col), _type(tree))
    source = df.select(*kept, F.explode(F.array(document)).alias(parsed))
    columns = []
    for name, (path, kind) in fields.items():
        value: Column = F.col(parsed)
        for step in _steps(path):
            value = F.get(value, F.lit(step)) if isinstance(step, int) else value.getField(step)
        cast_to = f"array<{kind[:-2]}>" if kind.endswith("[]") else kind
        columns.append((value if cast_to == "string" else value.cast(cast_to)).alias(name))
    return source.select(*kept, *columns)


def is_json(col: Column | str) -> Column:
    """True when the text is exactly one well-formed JSON document.

    Spark's parsers stop at the end of the first document. As the only element of
    an array and the only value of an object, text after it cannot go unseen.
    """
    col = F.col(col) if isinstance(col, str) else col
    as_element = F.json_array_length(F.concat(F.lit("["), col, F.lit("]")))
    as_value = F.json_object_keys(F.concat(F.lit('{"v":'), col, F.lit("}")))
    return F.coalesce((as_element == 1) & as_value.isNotNull(), F.lit(False))
