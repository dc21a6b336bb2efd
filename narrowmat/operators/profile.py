"""Which types of values a column of JSON or variants holds, and where."""

from __future__ import annotations

import json
import re
from datetime import date, datetime
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Distinct paths that a task counts before it hands on what it has so far.
HELD_PATHS = 100_000

_PLAIN = re.compile(r"[\w-]+")
_COUNTS = "path string, type string, count long, min_len int, max_len int"


def _field(path: str, name: str) -> str:
    if _PLAIN.fullmatch(name):
        return f"{path}.{name}"
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return f"{path}['{quoted}']"


def _kind(value) -> str:
    """Name of the type of a value that is no object, array or string."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer" if -(2**63) <= value < 2**63 else "double"
    if isinstance(value, (bytes, bytearray)):
        return "binary"
    if isinstance(value, datetime):
        return "timestamp"
    return "date" if isinstance(value, date) else "double"


def _walk(root, max_depth: int | None):
    """Path, type and length of a value and of all there is inside."""
    todo = [("$", root, 0)]
    while todo:
        path, value, depth = todo.pop()
        if isinstance(value, str):
            yield path, "string", len(value)
        elif isinstance(value, (dict, list)):
            yield path, "object" if isinstance(value, dict) else "array", len(value)
            if depth == max_depth:
                if value:
                    yield path, "unopened", len(value)
            elif isinstance(value, dict):
                todo.extend((_field(path, k), v, depth + 1) for k, v in value.items())
            else:
                todo.extend((path + "[]", v, depth + 1) for v in value)
        else:
            yield path, _kind(value), None


def _json_values(batch):
    """Yields one-element tuples; an empty tuple stands for text that is no JSON."""
    decoder = json.JSONDecoder(strict=False)
    for text, valid in zip(batch.column("value").to_pylist(), batch.column("valid").to_pylist()):
        if text is None:
            yield (None,)
        elif valid:
            yield (decoder.raw_decode(text.lstrip())[0],)
        else:
            yield ()


def _variant_values(batch):
    for value in batch.column("value").to_pylist():
        yield (None if value is None else T.VariantVal(value["value"], value["metadata"]).toPython(),)


def _counted(held: dict) -> pa.RecordBatch:
    paths = [path.encode("utf-8", "replace").decode() for path, _ in held]
    numbers = [pa.array(x, kind) for x, kind in zip(zip(*held.values()), (pa.int64(), pa.int32(), pa.int32()))]
    kinds = pa.array([kind for _, kind in held], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), kinds, *numbers], names=["path", "type", "count", "min_len", "max_len"])


def _profile(values_of, max_depth, batches):
    held: dict[tuple[str, str], list] = {}
    for batch in batches:
        for found in values_of(batch):
            for path, kind, size in _walk(found[0], max_depth) if found else [("$", "invalid", None)]:
                entry = held.get((path, kind))
                if entry is None:
                    held[path, kind] = [1, size, size]
                    continue
                entry[0] += 1
                if size is not None:
                    entry[1], entry[2] = min(entry[1], size), max(entry[2], size)
            if len(held) >= HELD_PATHS:
                yield _counted(held)
                held = {}
    if held:
        yield _counted(held)


def profile_values(df: DataFrame, col: str, max_depth: int | None = None) -> DataFrame:
    """Counts of values by path and type: ``path, type, count, min_len, max_len``.

    The whole value is at ``$``, fields at ``.name`` (names with anything but
    letters, digits, ``_`` and ``-`` at ``['name']``) and array elements at
    ``[]`` below it, at any depth. Lengths are those of strings, arrays and
    objects. A row without a value counts as ``null`` at ``$``, text that the
    engine cannot parse as ``invalid``. With ``max_depth``, objects and arrays
    that are not empty count at that level as ``unopened`` once more.
    The table is read once; tasks hand on counts, not values.
    """
    if max_depth is not None and max_depth < 0:
        raise ValueError("max_depth must be 0 or more")
    value = F.col(col)
    if isinstance(df.schema[col].dataType, T.VariantType):
        values, read = df.select(value.alias("value")), _variant_values
    else:
        text = value.cast("string")
        values, read = df.select(text.alias("value"), F.try_parse_json(text).isNotNull().alias("valid")), _json_values
    counts = values.mapInArrow(partial(_profile, read, max_depth), _COUNTS)
    return counts.groupBy("path", "type").agg(
        F.sum("count").alias("count"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len")
    )
