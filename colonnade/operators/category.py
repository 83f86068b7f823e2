"""Ordered categoricals: int codes and a domain kept beside the column."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.errors import ColumnTypeError, ColumnValueError


def categorize(vector, categories=None):
    """Codes into ``categories``; None takes the values in order of first appearance (one job)."""
    c = vector.value_column
    if vector._kind is not str:
        raise ColumnTypeError("only str columns have categories")
    if categories is None:
        categories = [v for v in vector.unique().to_list() if v is not None]
    else:
        if isinstance(categories, (set, frozenset)):
            raise ColumnTypeError("a set has no order")
        categories = list(categories)
        if any(not isinstance(x, str) for x in categories):
            raise ColumnTypeError("categories are strings")
        if len(set(categories)) != len(categories):
            raise ColumnValueError("duplicate categories")
        stray = vector._frame.df.select(c.alias("v")).filter(F.col("v").isNotNull() & ~F.col("v").isin(categories))
        found = stray.first()
        if found:
            raise ColumnValueError(f"{found[0]!r} is no category")
    domain = F.array(*[F.lit(x) for x in categories]) if categories else F.array().cast("array<string>")
    code = F.when(c.isNotNull(), (F.array_position(domain, c) - 1).cast("int"))
    return vector._with(code, str, name=vector._name, categories=tuple(categories))


def compare(vector, op, other):
    """By category order; labels outside the domain and other domains are only unequal."""
    ops = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
           "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    if isinstance(other, str):
        if other in vector._categories:
            return vector._with(ops[op](vector._col, F.lit(vector._categories.index(other))), bool)
        if op in ("==", "!="):
            return vector._with(F.when(vector._col.isNotNull(), F.lit(op == "!=")), bool)
        raise ColumnValueError(f"{other!r} is no category")
    if getattr(other, "_kind", None) is not str:
        raise ColumnTypeError("a categorical is compared with strings")
    if other._categories == vector._categories:
        frame, _, nullable = vector._operand(other)
        return type(vector).of(frame, ops[op](vector._col, other._col), bool, vector._nullable or nullable)
    if op not in ("==", "!="):
        raise ColumnTypeError("categories differ")
    return vector._with(vector._label(), str)._compare(op, other._with(other.value_column, str))
