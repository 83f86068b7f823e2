"""Element-wise tables over Structured Streaming.

The reference model has no streams; what needs no row order (projection, masks,
scalar functions, grouped aggregates without positional picks) works on a
streaming DataFrame as it does on a batch one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade import kinds
from colonnade.frame import Frame, fresh
from colonnade.vector import Vector


def stream_table(df: DataFrame):
    """A table without row order over a streaming DataFrame; ``to_spark()`` gives the stream to write."""
    from colonnade.table import Table

    cols, made = [], []
    for field in df.schema:
        kind, goal = kinds.kind_of(field.dataType)
        name = fresh()
        cols.append(F.col(f"`{field.name}`").cast(goal).alias(name))
        made.append((name, kind, field.nullable, field.name))
    frame = Frame(df.select(*cols), [])
    return Table.of(frame, [Vector.of(frame, F.col(p), k, null, n, None, True) for p, k, null, n in made])
