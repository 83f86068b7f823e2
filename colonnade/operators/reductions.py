"""Reductions by name: function(column, kind, rank, **arguments) -> (aggregate Column, kind).

Nulls are skipped.  ``rank`` rises along the rows; only positional reductions use it.
"""

from __future__ import annotations

import math
from functools import reduce as fold

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from colonnade.errors import ColumnTypeError, ColumnValueError
from colonnade.kinds import spark_type
from colonnade.operators.elementwise import fail_if

L = F.lit


def _number(c, kind):
    if kind is bool:
        return c.cast("long"), int
    return c, kind


def _d(c):
    return c.cast("double")


def truth(c: Column, kind) -> Column:
    if kind is bool:
        return c
    if kind in (int, float):
        return c != 0
    if kind is str:
        return F.length(c) > 0
    return F.when(c.isNotNull(), L(True))


def _sum(c, kind, rank):
    c, kind = _number(c, kind)
    if kind not in (int, float) and kind.__name__ != "Decimal":
        raise ColumnTypeError(f"sum of {kind.__name__}")
    zero = L(0.0) if kind is float else L(0)
    return F.coalesce(F.sum(c), zero), kind


def _stdev(c, kind, rank, population=False):
    value = F.stddev_pop(_d(c)) if population else F.stddev_samp(_d(c))
    return F.when(F.count(c) >= 2, value), float


def _extreme(f):
    def build(c, kind, rank):
        return f(c), kind

    return build


def _positional(f):
    def build(c, kind, rank):
        return f(c, rank), kind

    return build


def _verdict(f, default):
    def build(c, kind, rank, on_empty=None):
        return F.coalesce(f(truth(c, kind)), L(default if on_empty is None else on_empty)), bool

    return build


BASIC = {
    "sum": _sum,
    "count": lambda c, kind, rank: (F.count(c), int),
    "min": _extreme(F.min),
    "max": _extreme(F.max),
    "mean": lambda c, kind, rank: (F.avg(_d(_number(c, kind)[0])), float),
    "std": _stdev,
    "stdev": _stdev,
    "all": _verdict(F.bool_and, True),
    "any": _verdict(F.bool_or, False),
    "first": _positional(F.min_by),
    "last": _positional(F.max_by),
}


def _geometric(c, kind, rank):
    bad = F.bool_or(c <= 0)
    return fail_if(bad, "geometric mean of values that are not positive", F.exp(F.avg(F.ln(F.when(c > 0, _d(c)))))), float


def _harmonic(c, kind, rank, weights=None):
    w = L(1.0) if weights is None else _d(weights)
    ok = c.isNotNull() & w.isNotNull()
    c = F.when(ok, _d(c))
    total = F.sum(F.when(ok, w))
    value = total / F.sum(w / F.when(c != 0, c))
    value = F.when(F.bool_or(c == 0), L(0.0)).otherwise(value)
    return fail_if(F.bool_or(c < 0), "harmonic mean of negative values", value), float


def _median_side(high):
    def build(c, kind, rank):
        # Of an even number of values this is the lower middle one; of the negated ones, the upper.
        low = lambda x: F.call_function("percentile_approx", x, L(0.5), L(2147483647))
        return (-low(-c) if high else low(c)), kind

    return build


def check_pieces(n=4, method="exclusive"):
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ColumnValueError("n must be at least 1")
    if method not in ("inclusive", "exclusive"):
        raise ColumnValueError(f"unknown method: {method!r}")
    return n


def _quantiles(c, kind, rank, n=4, method="inclusive"):
    """Inclusive quantiles; exclusive ones are made of counts, see ``exclusive_cuts``."""
    n = check_pieces(n, method)
    out = F.percentile(_d(c), F.array(*[L(i / n) for i in range(1, n)])) if n > 1 else F.array().cast("array<double>")
    return F.when(F.count(c) >= 2, out), list


def exclusive_cuts(value, upto, count, total, n):
    """Array of the n - 1 cuts, over rows of distinct values: up to which place each stands, its count, and the total."""

    def at(place):
        return F.max(F.when((upto >= place) & (upto - count < place), value))

    cuts = []
    for i in range(1, n):
        j = F.least(F.greatest(F.floor(i * (total + 1) / n), L(1)), total - 1)
        delta = F.max(i * (total + 1) - j * n)
        cuts.append((at(j) * (n - delta) + at(j + 1) * delta) / n)
    return F.when(F.max(total) >= 2, F.array(*cuts) if cuts else F.array().cast("array<double>"))


def _spread(root, population):
    def build(c, kind, rank, mu=None, xbar=None):
        center = mu if population else xbar
        x = _d(c)
        if center is not None:
            total = F.sum((x - center) * (x - center))
            n = F.count(c) if population else F.count(c) - 1
            value = F.when(n > 0, total / F.when(n > 0, n))
            value = F.sqrt(value) if root else value
        else:
            f = {(0, 0): F.var_samp, (0, 1): F.var_pop, (1, 0): F.stddev_samp, (1, 1): F.stddev_pop}[root, population]
            value = f(x)
        return F.when(F.count(c) >= (1 if population else 2), value), float

    return build


def _paired(f):
    def build(c, kind, rank, other=None):
        return f(_d(c), _d(other))

    return build


def _covariance(x, y):
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), L(1)))
    return F.when(both >= 2, F.covar_samp(x, y)), float


def _varies(x, y):
    both = x.isNotNull() & y.isNotNull()
    return F.min(F.when(both, x)) != F.max(F.when(both, x)), F.count(F.when(both, L(1)))


def _correlation(x, y):
    vx, n = _varies(x, y)
    vy, _ = _varies(y, x)
    sound = F.coalesce(vx & vy, L(False))
    return F.when(n >= 2, fail_if(~sound, "at least one of the inputs is constant", F.when(sound, F.corr(x, y)))), float


def _regression(x, y):
    vx, n = _varies(x, y)
    sound = F.coalesce(vx, L(False))
    line = F.array(F.regr_slope(y, x), F.regr_intercept(y, x))
    return F.when(n >= 2, fail_if(~sound, "x is constant", line)), list


STATS = {
    "mean": BASIC["mean"],
    "fmean": BASIC["mean"],
    "geometric_mean": _geometric,
    "harmonic_mean": _harmonic,
    "median": lambda c, kind, rank: (F.median(_d(c)), float),
    "median_low": _median_side(False),
    "median_high": _median_side(True),
    "mode": None,
    "multimode": None,
    "quantiles": _quantiles,
    "pvariance": _spread(0, 1),
    "variance": _spread(0, 0),
    "pstdev": _spread(1, 1),
    "stdev": _spread(1, 0),
    "covariance": _paired(_covariance),
    "correlation": _paired(_correlation),
    "linear_regression": _paired(_regression),
}


#: Parts of a group in a reduction that Python makes.
PARTS = 64


def _exact_parts(values):
    """Doubles whose exact sum is that of ``values``, few of them."""
    parts = []
    for x in values:
        if not math.isfinite(x):
            parts.append(x)
            continue
        kept = 0
        for k in range(len(parts)):
            y = parts[k]
            if not math.isfinite(y):
                parts[kept] = y
                kept += 1
                continue
            if abs(x) < abs(y):
                x, y = y, x
            total = x + y
            rest = y - (total - x)
            if rest:
                parts[kept] = rest
                kept += 1
            x = total
        parts[kept:] = [x]
    # Infinities and NaN stand once each.
    odd = list({repr(p): p for p in parts if not math.isfinite(p)}.values())
    return [p for p in parts if math.isfinite(p)] + odd


def _bounded(value):
    if abs(value) >= 1 << 63:
        raise OverflowError("past 64 bits")
    return value


def _product_part(values):
    """The product as text; ``big`` past 64 bits, which only a zero elsewhere can mend."""
    out = 0 if 0 in values else 1
    for v in values:
        if abs(out) >= 1 << 63:
            return "big"
        out *= v
    return "big" if abs(out) >= 1 << 63 else str(out)


def _product_whole(parts):
    if "0" in parts:
        return 0
    if "big" in parts:
        raise OverflowError("past 64 bits")
    return _bounded(fold(lambda a, b: a * int(b), parts, 1))


def _lcm_part(values):
    return str(math.lcm(*values))


#: Type of a part's result, how it is made, the type of the whole, and how that is made of the parts.
_GATHERED = {
    "fsum": ("array<double>", _exact_parts, "double", lambda parts: math.fsum(x for p in parts for x in p)),
    "prod": ("string", _product_part, "long", _product_whole),
    "gcd": ("long", lambda xs: math.gcd(*xs), "long", lambda parts: math.gcd(*parts)),
    "lcm": ("string", _lcm_part, "long", lambda parts: _bounded(math.lcm(*map(int, parts)))),
}


def gathered(df, keys: list[str], c: Column, kind, name: str, out: str):
    """DataFrame (keys, out): each group is dealt into PARTS parts; the parts' results give the whole."""
    part_type, part, whole_type, whole = _GATHERED[name]
    convert = float if name == "fsum" else int

    def first(values: pd.Series):
        return part([convert(v) for v in values])

    def second(values: pd.Series):
        return whole(values.tolist())

    first.__annotations__ = {"values": pd.Series, "return": list if part_type.startswith("array") else str if part_type == "string" else int}
    second.__annotations__ = {"values": pd.Series, "return": convert}
    value, lot, made = "_value", "_lot", "_made"
    rows = df.select(*keys, c.alias(value))
    # Nulls are no values; a group of nothing else still has its row.
    groups = rows.select(*keys).distinct() if keys else None
    rows = rows.filter(F.col(value).isNotNull()).withColumn(lot, (F.monotonically_increasing_id() % PARTS).cast("int"))
    parts = rows.groupBy(*keys, lot).agg(F.pandas_udf(first, part_type)(value).alias(made))
    found = parts.groupBy(*keys).agg(F.pandas_udf(second, whole_type)(made).alias(out))
    nothing = L({"fsum": 0.0, "prod": 1, "gcd": 0, "lcm": 1}[name])
    if groups is None:
        return found.agg(F.coalesce(F.max(out), nothing).alias(out))
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    side = found.withColumnsRenamed(names)
    match = fold(lambda a, b: a & b, [groups[k].eqNullSafe(side[v]) for k, v in names.items()])
    return groups.join(side, match, "left").select(*keys, F.coalesce(out, nothing).alias(out))


def _prod(c, kind, rank):
    # Just above zero a product one row at a time is rounded back to where it was; the logarithms tell that it is gone.
    out = F.coalesce(F.product(c), L(1.0))
    gone = (F.abs(out) < 2.0**-1022) & (F.sum(F.ln(F.abs(_d(c)))) < -1075 * math.log(2.0))
    return F.when(gone, out * 0.0).otherwise(out), float


def _only_gathered(c, kind, rank):
    raise ColumnTypeError("not among built-in aggregates")


MATH = {
    "fsum": _only_gathered,
    "prod": _prod,
    "gcd": _only_gathered,
    "lcm": _only_gathered,
    "hypot": lambda c, kind, rank: (F.sqrt(F.coalesce(F.sum(_d(c) * _d(c)), L(0.0))), float),
    "dist": lambda c, kind, rank, other=None: (
        F.sqrt(F.coalesce(F.sum((_d(c) - _d(other)) * (_d(c) - _d(other))), L(0.0))), float
    ),
}

#: Reductions that count values first, and so need two aggregations.
TWO_LEVEL = {"mode", "multimode"}


def constant(value, dtype=None):
    kind = dtype or type(value)
    return L(value).cast(spark_type(kind)), kind
