"""Columns that travel with a result, whatever they are called.

The rule for all operators: inside, kept columns have names of their own, so no name can clash with the operator's.
In the result they have their names again; one that the result's own columns have (upper and lower case are alike)
comes back as ``input_<name>``, with as many ``input_`` as make it different.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def carry(keep: Sequence[str], own: Sequence[str]) -> tuple[list[Column], list[str], Callable[[DataFrame], DataFrame]]:
    """The kept columns under inner names, these names, and what gives a result (with columns ``own``) the outer names."""
    inner = [f"carried_{i}" for i in range(len(keep))]
    taken, outer = {c.lower() for c in own}, []
    for name in keep:
        while name.lower() in taken:
            name = f"input_{name}"
        taken.add(name.lower())
        outer.append(name)

    def back(result: DataFrame) -> DataFrame:
        return result.select(*[F.col(i).alias(o) for i, o in zip(inner, outer, strict=True)], *own)

    return [col(c).alias(i) for c, i in zip(keep, inner, strict=True)], inner, back


def types_of(df: DataFrame) -> str:
    """The columns of ``df`` as a schema text."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
