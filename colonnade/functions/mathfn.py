"""Math functions by name: function(column, kind, *operands) -> (Column, kind).

Where Python's ``math`` raises, the job fails: a domain check stands around each
built-in that would give null, NaN or infinity.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from colonnade.operators.elementwise import fail_if

L = F.lit
INF = float("inf")
_DOMAIN, _RANGE = "math domain error", "math range error"


def _d(c):
    return c.cast("double")


def _real(f, bad=None):
    """A float function; ``bad(x)`` says where Python raises a domain error."""

    def build(c, kind):
        x = _d(c)
        if bad is None:
            return f(x), float
        return fail_if(bad(x), _DOMAIN, f(x)), float

    return build


def _bounded(f):
    """A float function that overflows: an infinite result of a finite value fails."""

    def build(c, kind):
        x = _d(c)
        out = f(x)
        return fail_if((F.abs(out) == INF) & (F.abs(x) != INF), _RANGE, out), float

    return build


def _each(f, returns, kind):
    """Python's function over Arrow batches."""

    def build(c, own, *operands):
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series(
                [None if any(pd.isna(v) and not (isinstance(v, float) and math.isnan(v) and own is float) for v in row)
                 else f(*row) for row in zip(*columns)],
                dtype=object,
            )

        udf = F.pandas_udf(_annotated(run, 1 + len(operands)), returns)
        return udf(c, *operands), kind

    return build


def _annotated(run, n):
    if n == 1:
        def one(a: pd.Series) -> pd.Series:
            return run(a)

        return one

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return two


def _present(c, out):
    return F.when(c.isNotNull(), out)


def _whole(f):
    def build(c, kind):
        if kind is float:
            c = fail_if(F.isnan(c) | (F.abs(c) == INF), "cannot convert float NaN or infinity to integer", c)
        return f(c).cast("long"), int

    return build


def _factorial(c, kind):
    bad = (c < 0) | (c > 20)
    return fail_if(bad, "factorial of a negative value, or past 64 bits", F.factorial(F.when(~bad, c).cast("int"))), int


def _isqrt(c, kind):
    root = F.floor(F.sqrt(_d(F.when(c >= 0, c)))).cast("long")
    root = F.when(root * root > c, root - 1).when((root + 1) * (root + 1) <= c, root + 1).otherwise(root)
    return fail_if(c < 0, "isqrt of a negative value", root), int


def _modf(c, kind):
    x = _d(c)
    # Past 2**52 every double is whole; the cast to long is exact below.
    whole = F.when(F.abs(x) < float(1 << 52), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")).otherwise(x)
    part = F.when(F.abs(x) == INF, L(0.0)).otherwise(x - whole)
    return _present(c, F.array(part, whole)), list


def _asinh(x):
    """Exact near zero as well, where a logarithm of 1 + x loses digits."""
    size = F.abs(x)
    large = F.ln(size) + math.log(2.0)
    small = F.log1p(size + size * size / (1.0 + F.sqrt(1.0 + size * size)))
    return F.signum(x) * F.when(size > float(1 << 28), large).otherwise(small)


def _copysign(c, kind, sign):
    x, y = _d(c), _d(sign)
    # The text of a zero shows its sign.
    negative = (y < 0) | ((y == 0) & (y.cast("string") == "-0.0"))
    return F.when(y.isNotNull(), F.when(negative, -F.abs(x)).otherwise(F.abs(x))), float


UNARY = {
    "ceil": _whole(F.ceil),
    "floor": _whole(F.floor),
    "trunc": _whole(lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))),
    "factorial": _factorial,
    "isqrt": _isqrt,
    "fabs": _real(F.abs),
    "frexp": _each(lambda v: list(map(float, math.frexp(v))), "array<double>", list),
    "isfinite": lambda c, k: (_present(c, ~F.isnan(_d(c)) & (F.abs(_d(c)) != INF)), bool),
    "isinf": lambda c, k: (_present(c, F.abs(_d(c)) == INF), bool),
    "isnan": lambda c, k: (_present(c, F.isnan(_d(c))), bool),
    "modf": _modf,
    "ulp": _each(math.ulp, "double", float),
    "exp": _bounded(F.exp),
    "expm1": _bounded(F.expm1),
    "log1p": _real(F.log1p, lambda x: x <= -1),
    "log2": _real(F.log2, lambda x: x <= 0),
    "log10": _real(F.log10, lambda x: x <= 0),
    "sqrt": _real(F.sqrt, lambda x: x < 0),
    "degrees": _real(F.degrees),
    "radians": _real(F.radians),
    "acos": _real(F.acos, lambda x: F.abs(x) > 1),
    "asin": _real(F.asin, lambda x: F.abs(x) > 1),
    "atan": _real(F.atan),
    "cos": _real(F.cos, lambda x: F.abs(x) == INF),
    "sin": _real(F.sin, lambda x: F.abs(x) == INF),
    "tan": _real(F.tan, lambda x: F.abs(x) == INF),
    "acosh": _real(F.acosh, lambda x: x < 1),
    "asinh": _real(_asinh),
    "atanh": _real(F.atanh, lambda x: F.abs(x) >= 1),
    "cosh": _bounded(F.cosh),
    "sinh": _bounded(F.sinh),
    "tanh": _real(F.tanh),
    "erf": _each(lambda v: math.erf(v), "double", float),
    "erfc": _each(lambda v: math.erfc(v), "double", float),
    "gamma": _each(lambda v: math.gamma(v), "double", float),
    "lgamma": _each(lambda v: math.lgamma(v), "double", float),
}


def _log(c, kind, base=None):
    bad = _d(c) <= 0
    out = F.ln(_d(c))
    if base is not None:
        wrong = (_d(base) <= 0) | (_d(base) == 1)
        return fail_if(bad | wrong, _DOMAIN, out / F.ln(F.when(~wrong, _d(base)))), float
    return fail_if(bad, _DOMAIN, out), float


def _comb(f):
    def run(n, k):
        value = f(int(n), int(k))
        if value >= 1 << 63:
            raise OverflowError("past 64 bits")
        return value

    return run


def _perm(c, kind, k=None):
    return _each(_comb(math.perm), "long", int)(c, int, c if k is None else k)


def _isclose(c, kind, other, rel_tol=1e-9, abs_tol=0.0):
    a, b = _d(c), _d(other)
    near = F.abs(a - b) <= F.greatest(L(rel_tol) * F.greatest(F.abs(a), F.abs(b)), L(float(abs_tol)))
    infinite = (F.abs(a) == INF) | (F.abs(b) == INF)
    out = F.when(F.isnan(a) | F.isnan(b), L(False)).when(infinite, a == b).otherwise(near)
    return F.when(a.isNotNull() & b.isNotNull(), out), bool


def _remainder(c, kind, divisor):
    return _each(lambda x, y: math.remainder(x, y), "double", float)(_d(c), float, _d(divisor))


def _pow(c, kind, exponent):
    x, y = _d(c), _d(exponent)
    out = F.pow(x, y)
    bad = (F.isnan(out) & ~F.isnan(x) & ~F.isnan(y)) | ((x == 0) & (y < 0))
    over = (F.abs(out) == INF) & (F.abs(x) != INF) & (F.abs(y) != INF)
    return fail_if(bad, _DOMAIN, fail_if(over, _RANGE, out)), float


def _fmod(c, kind, divisor):
    x, y = _d(c), _d(divisor)
    bad = (y == 0) | (F.abs(x) == INF)
    return fail_if(bad, _DOMAIN, x % y), float


BINARY = {
    "comb": lambda c, kind, k: _each(_comb(math.comb), "long", int)(c, int, k),
    "copysign": _copysign,
    "fmod": _fmod,
    "ldexp": lambda c, kind, e: (_d(c) * F.pow(L(2.0), _d(e)), float),
    "nextafter": lambda c, kind, to: _each(lambda a, b: float(np.nextafter(a, b)), "double", float)(_d(c), float, _d(to)),
    "remainder": _remainder,
    "pow": _pow,
    "atan2": lambda c, kind, x: (F.atan2(_d(c), _d(x)), float),
}
OPTIONAL = {"log": _log, "perm": _perm}
CLOSE = _isclose

Built = tuple[Column, type]
