"""Canonical JSON: keys sorted, ASCII, no blanks, shortest float forms; and hashes of it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":"), allow_nan=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def config_digest(config: dict, defaults: dict, fixed: dict | None = None) -> str:
    """The identity of a configuration: keys that are as by default don't count, and `fixed` ones count as given (a rank, say)."""
    return digest({k: v for k, v in (config | (fixed or {})).items() if k not in defaults or defaults[k] != v})


def _canonical_lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for lines in batches:
        yield pa.array([None if x is None else _is_canonical(x) for x in lines.to_pylist()], pa.bool_())


def _is_canonical(line: str) -> bool:
    try:
        value = json.loads(line)
        return isinstance(value, dict) and canonical(value) == line
    except ValueError:
        return False


def is_canonical(lines: Column) -> Column:
    """Whether a line is an object in canonical form. Python, as Spark's own JSON writer sorts and escapes otherwise."""
    return F.arrow_udf(_canonical_lines, "boolean")(lines)
