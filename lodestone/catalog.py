"""Every query of the library by name, and the DuckDB SQL that says the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def byte_id(byte: str) -> str:
    """SQL for the id of a byte: its place among the bytes' printable characters, of which the unprinted ones come last, plus 8."""
    return f"""(8 + CASE WHEN {byte} BETWEEN 33 AND 126 THEN {byte} - 33 WHEN {byte} BETWEEN 161 AND 172 THEN {byte} - 67 WHEN {byte} >= 174 THEN {byte} - 68
                     WHEN {byte} <= 32 THEN {byte} + 188 WHEN {byte} <= 160 THEN {byte} + 94 ELSE 255 END)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL to check it by, if SQL can say it."""

    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are called {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


for _name in ("text", "chat", "selection", "shards", "metrics", "reports", "tensors", "tokenizer", "streams", "sources"):
    importlib.import_module(f"lodestone.plans.{_name}")
