"""A projection step whose results are computed exactly once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Like ``withColumns``, but later steps read the results instead of the expressions.

    A filter on a computed column is normally pushed below its projection with the whole
    expression copied into it, and copied again by every step after that. Long text
    expressions grow without bound that way. Unpacking a one-element array is a generator,
    which neither filters nor projections are merged through. The results are columns before
    they are packed: a projection compiles long expressions in short pieces, a generator in one.
    """
    names = {name: f"_once_{name}" for name in columns}
    kept = [c for c in df.columns if c not in columns]
    computed = df.select(*kept, *[expr.alias(names[name]) for name, expr in columns.items()])
    packed = F.array(F.struct(*[F.col(at).alias(name) for name, at in names.items()]))
    order = df.columns + [name for name in columns if name not in df.columns]
    return computed.select(*kept, F.inline(packed)).select(*order)
