"""Equi-joins with stated cardinality; a null in any key part matches nothing."""

from __future__ import annotations

import datetime as dt
from functools import reduce as fold

from pyspark.sql import functions as F

from colonnade.errors import ColumnTypeError, ColumnValueError
from colonnade.frame import Frame, fresh

JOINABLE = (int, str, bool, dt.date, dt.datetime, object)


def _key_vectors(table, spec):
    return table._keys(spec)


def check_unique(frame: Frame, keys: list, side: str) -> None:
    """One job: a non-null key that stands twice raises."""
    names = [fresh("k") for _ in keys]
    df = frame.bare.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)])
    df = df.filter(fold(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))
    twice = df.groupBy(*names).count().filter("count > 1").first()
    if twice:
        shown = tuple(twice[n] for n in names)
        raise ColumnValueError(f"{side} key {shown if len(shown) > 1 else shown[0]!r} stands {twice['count']} times")


def join(how, left, right, left_on, right_on, expect_left_unique, expect_right_unique, validate="eager"):
    from colonnade.table import Table
    from colonnade.vector import Vector

    lk, rk = _key_vectors(left, left_on), _key_vectors(right, right_on)
    if len(lk) != len(rk) or not lk:
        raise ColumnValueError("as many right keys as left keys, and at least one")
    for a, b in zip(lk, rk, strict=True):
        for v in (a, b):
            if v._kind not in JOINABLE:
                raise ColumnTypeError(f"{v._kind.__name__} keys are not joined")
        if a._kind is not b._kind:
            raise ColumnTypeError(f"key kinds differ: {a._kind.__name__} and {b._kind.__name__}")
    if validate == "eager":
        if expect_right_unique:
            check_unique(right._frame, [v.value_column for v in rk], "right")
        if expect_left_unique:
            check_unique(left._frame, [v.value_column for v in lk], "left")
    # Own physical names on both sides, so that a table can be joined with itself.
    lo, ro = fresh("o"), fresh("o")
    lkeys, rkeys = [fresh("k") for _ in lk], [fresh("k") for _ in rk]
    lcols, rcols = [fresh() for _ in left._columns], [fresh() for _ in right._columns]

    def side(table, order, keys, key_vectors, cols, plain=False):
        rank = None if plain else table._frame.rank()
        return (table._frame.bare if plain else table._frame.df).select(
            *([] if plain else [rank.alias(order)]),
            *[v.value_column.alias(k) for v, k in zip(key_vectors, keys, strict=True)],
            *[v._col.alias(c) for v, c in zip(table._columns, cols, strict=True)],
        )

    a, b = side(left, lo, lkeys, lk, lcols), side(right, ro, rkeys, rk, rcols)
    match = fold(lambda x, y: x & y, [F.col(p) == F.col(q) for p, q in zip(lkeys, rkeys, strict=True)])
    df = a.join(b, match, how)
    # Left rows in order, their matches in right order, unmatched right rows last.
    frame = Frame(df, [(lo, True, True), (ro, True, True)])
    plain = [side(left, lo, lkeys, lk, lcols, True), side(right, ro, rkeys, rk, rcols, True)]
    frame.plain = plain[0].join(plain[1], match, how)
    made = [
        Vector.of(frame, F.col(c), v._kind, v._nullable or how == "full", v._name, v._categories, True)
        for v, c in zip(left._columns, lcols, strict=True)
    ]
    dropped = {
        id(q) for p, q in zip(lk, rk, strict=True) if p._name is not None and p._name == q._name and any(q is c for c in right._columns)
    }
    made += [
        Vector.of(frame, F.col(c), v._kind, v._nullable or how != "inner", v._name, v._categories, True)
        for v, c in zip(right._columns, rcols, strict=True)
        if id(v) not in dropped
    ]
    return Table.of(frame, made)
