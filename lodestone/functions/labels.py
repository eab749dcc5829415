"""Names and display forms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fragments of attention kernel names, in the order in which they are looked for.
KERNELS = (("flash", "flash"), ("efficient", "efficient"), ("cudnn", "cudnn"), ("math", "math"))


def step_id(step: Column) -> Column:
    return F.concat(F.lit("step-"), F.lpad(step.cast("string"), 12, "0"))


def step_of(name: Column) -> Column:
    """The step of a well-formed id, else null."""
    return F.when(name.rlike("^step-[0-9]{12}\\z"), F.substring(name, 6, 12).cast("long"))


def slug(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit("-"))


def kernel_family(operator: Column) -> Column:
    out = None
    for fragment, family in KERNELS:
        found = F.contains(F.lower(operator), F.lit(fragment))
        out = F.when(found, family) if out is None else out.when(found, family)
    return out.otherwise("other")


def utilisation(cpu_seconds: Column, wall_seconds: Column, cores: Column) -> Column:
    return F.when((wall_seconds > 0) & (cores > 0), cpu_seconds / (wall_seconds * cores))


def _compact(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in values:
        yield pa.array([None if x is None else next((f"{x / size:.1f}{unit}" for size, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")) if abs(x) >= size), f"{x:.2f}") for x in batch.to_pylist()], pa.string())


def compact(value: Column) -> Column:
    """1.5K, 2.0M, 3.2B; small numbers with two places. Python, as Java rounds the shortest decimal form and not the number."""
    return F.arrow_udf(_compact, "string")(value.cast("double"))
