"""Column-name helpers shared by the operators.

Panel column names come from data (funding sources, registry attributes) and
may hold spaces, dots or parentheses, so every reference is back-quoted.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str | Column) -> Column:
    if isinstance(name, Column):
        return name
    return F.col("`" + name.replace("`", "``") + "`")


def as_list(value: str | Sequence[str] | None) -> list[str]:
    if value is None:
        return []
    if isinstance(value, str):
        return [value]
    return list(value)


def others(columns: Iterable[str], exclude: Iterable[str]) -> list[str]:
    skip = set(exclude)
    return [c for c in columns if c not in skip]


def value(x) -> Column:
    """A literal, or a Column passed through (e.g. a scalar subquery from ``DataFrame.scalar()``,
    so a target found from the data stays inside the plan)."""
    return x if isinstance(x, Column) else F.lit(x)
