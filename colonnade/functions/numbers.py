"""Element methods of int and float columns by name: function(column, *args) -> (Column, kind)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def _each(f, returns, kind):
    def build(c, *args):
        def run(values: pd.Series) -> pd.Series:
            return pd.Series([None if pd.isna(v) else f(v, *args) for v in values], dtype=object)

        return F.pandas_udf(run, returns)(c), kind

    return build


INT = {
    "bit_length": lambda c: (F.when(c == 0, F.lit(0)).otherwise(F.length(F.bin(F.abs(c)))).cast("long"), int),
    "bit_count": lambda c: (F.bit_count(F.abs(c)).cast("long"), int),
    "to_bytes": lambda c, length=1, byteorder="big": _each(
        lambda v: int(v).to_bytes(length, byteorder), "binary", bytes
    )(c),
    "is_integer": lambda c: (F.when(c.isNotNull(), F.lit(True)), bool),
}
FLOAT = {
    "is_integer": lambda c: (
        F.when(c.isNotNull(), ~F.isnan(c) & (F.abs(c) != float("inf")) & (F.rint(c) == c)), bool
    ),
    "hex": _each(lambda v: float(v).hex(), "string", str),
    "as_integer_ratio": _each(lambda v: list(map(str, float(v).as_integer_ratio())), "array<string>", list),
}
PROPERTIES = {
    int: {"real": lambda c: (c, int), "imag": lambda c: (F.when(c.isNotNull(), F.lit(0).cast("long")), int)},
    float: {"real": lambda c: (c, float), "imag": lambda c: (F.when(c.isNotNull(), F.lit(0.0)), float)},
}
