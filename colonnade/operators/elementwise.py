"""Python value semantics as Spark columns: comparison, logic, arithmetic.

Every builder takes and returns (Column, kind).  Null in any operand gives null,
but for Kleene ``&`` and ``|``.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from colonnade.errors import ColumnTypeError
from colonnade.kinds import NUMERIC, promote, spark_type

Typed = tuple[Column, type]


def typed(col: Column, kind, goal) -> Column:
    return col if kind is goal else col.cast(spark_type(goal))


def fail_if(bad: Column, message: str, value: Column) -> Column:
    """``value``, unless ``bad`` holds: then the job fails with ``message``."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def common(left: Typed, right: Typed, what: str) -> tuple[Column, Column, type]:
    (a, ka), (b, kb) = left, right
    goal = promote(ka, kb)
    if goal is None:
        if {ka, kb} == {Decimal, int}:
            return a, b, Decimal
        if {ka, kb} == {dt.date, str}:  # ISO text beside a date
            return a.cast("date"), b.cast("date"), dt.date
        raise ColumnTypeError(f"{what}: {ka.__name__} and {kb.__name__} do not go together")
    return typed(a, ka, goal), typed(b, kb, goal), goal


def compare(op: str, left: Typed, right: Typed) -> Typed:
    """==, !=, <, <=, >, >=; NaN is unequal to everything and never smaller or larger."""
    meet = promote(left[1], right[1]) is not None or {left[1], right[1]} in ({dt.date, str}, {Decimal, int})
    if op in ("==", "!=") and not meet:
        # Values of kinds that never meet are unequal.
        present = left[0].isNotNull() & right[0].isNotNull()
        return F.when(present, F.lit(op == "!=")), bool
    a, b, kind = common(left, right, op)
    out = {
        "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b,
        "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
    }[op]()
    if kind is float:
        nan = F.isnan(a) | F.isnan(b)
        out = F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(nan, F.lit(op == "!=")).otherwise(out)
    return out, bool


def logical(op: str, left: Typed, right: Typed) -> Typed:
    (a, ka), (b, kb) = left, right
    if ka is bool and kb is bool:
        return {"&": lambda: a & b, "|": lambda: a | b, "^": lambda: a != b}[op](), bool
    if ka in (bool, int) and kb in (bool, int):
        a, b = typed(a, ka, int), typed(b, kb, int)
        return {"&": a.bitwiseAND, "|": a.bitwiseOR, "^": a.bitwiseXOR}[op](b), int
    raise ColumnTypeError(f"{op}: {ka.__name__} and {kb.__name__}")


def invert(value: Typed) -> Typed:
    if value[1] is bool:
        return ~value[0], bool
    if value[1] is int:
        return F.bitwise_not(value[0]), int
    raise ColumnTypeError(f"~ of {value[1].__name__}")


def shift(op: str, left: Typed, right: Typed) -> Typed:
    """Python shifts: a negative count fails, bits that leave 64 fail to the left and are 0 or -1 to the right."""
    (a, ka), (n, kn) = left, right
    if ka not in (bool, int) or kn not in (bool, int):
        raise ColumnTypeError(f"{op}: {ka.__name__} and {kn.__name__}")
    a, n = typed(a, ka, int), typed(n, kn, int)
    count = F.least(F.greatest(n, F.lit(0)), F.lit(63)).cast("int")
    if op == ">>":
        out = F.call_function("shiftright", a, count)
        return fail_if(n < 0, "negative shift count", out), int
    out = F.call_function("shiftleft", a, count)
    lost = (F.call_function("shiftright", out, count) != a) | ((n > 63) & (a != 0))
    return fail_if(n < 0, "negative shift count", fail_if(lost, "integer overflow in <<", out)), int


def modulo(a: Column, b: Column, kind=int) -> Column:
    """Remainder with the sign of the divisor; 0 fails (ANSI)."""
    rest = a % b
    out = F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
    if kind is float:
        # A zero has the divisor's sign.
        out = F.when(rest == 0, F.when(b < 0, -F.abs(rest)).otherwise(F.abs(rest))).otherwise(out)
    return out


def floor_quotient(a: Column, b: Column, kind) -> Column:
    """Quotient rounded down; 0 fails (ANSI)."""
    if kind is float:
        # As Python's divmod: the truncated remainder makes the quotient nearly whole, and half a unit decides.
        rest = a % b
        near = (a - rest) / b
        near = F.when((rest != 0) & ((rest < 0) != (b < 0)), near - 1.0).otherwise(near)
        # Past 2**52 every double is whole; below, rounding to long and back is exact.
        low = F.when(F.abs(near) < float(1 << 52), F.floor(near).cast("double")).otherwise(near)
        return F.when(near - low > 0.5, low + 1.0).otherwise(low)
    whole = F.call_function("div", a, b)
    down = (whole * b != a) & ((a < 0) != (b < 0))
    return whole - down.cast("long")


def whole_power(a: Column, n: int) -> Column:
    """a ** n of ints by squaring; overflow fails (ANSI)."""
    out, square = None, a
    while n:
        if n & 1:
            out = square if out is None else out * square
        n >>= 1
        if n:
            square = square * square
    return F.when(a.isNotNull(), F.lit(1).cast("long")) if out is None else out


def power(a: Column, b: Column, kind) -> Column:
    out = F.pow(a.cast("double"), b.cast("double"))
    bad_zero = (a == 0) & (b < 0)
    if kind is float:
        out = fail_if(F.isnan(out) & ~F.isnan(a) & ~F.isnan(b), "power outside the real numbers", out)
        return fail_if(bad_zero, "zero to a negative power", out)
    big = F.abs(out) >= F.lit(float(1 << 53))
    exact = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.when(big, b).otherwise(F.lit(0)), F.lit(0)).cast("int") + 1),
        F.lit(1).cast("long"),
        lambda acc, k: F.when((k <= b) & big, acc * a).otherwise(acc),
    )
    whole = F.when(big, exact).otherwise(out.cast("bigint"))
    return fail_if(bad_zero, "zero to a negative power", fail_if(b < 0, "int to a negative power is no int", whole))


def arithmetic(op: str, left: Typed, right: Typed) -> Typed:
    (a, ka), (b, kb) = left, right
    if op == "+" and ka is str and kb is str:
        return F.concat(a, b), str
    if op == "*" and {ka, kb} <= {str, int} and ka is not kb:
        text, times = (a, b) if ka is str else (b, a)
        return F.repeat(text, F.greatest(times, F.lit(0)).cast("int")), str
    if dt.date in (ka, kb) or dt.datetime in (ka, kb) or dt.timedelta in (ka, kb):
        return _temporal(op, left, right)
    if Decimal in (ka, kb) and {ka, kb} <= {Decimal, int} and op in "+-*/":
        value = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[op]()
        return value, Decimal
    if ka not in NUMERIC or kb not in NUMERIC:
        raise ColumnTypeError(f"{op}: {ka.__name__} and {kb.__name__}")
    goal = promote(promote(ka, kb), int)
    if op == "/":
        goal = float
    a, b = typed(a, ka, goal), typed(b, kb, goal)
    if op == "/":
        return a / b, float
    if op == "//":
        return floor_quotient(a, b, goal), goal
    if op == "%":
        return modulo(a, b, goal), goal
    if op == "**":
        return power(a, b, goal), goal
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[op](), goal


def _temporal(op: str, left: Typed, right: Typed) -> Typed:
    (a, ka), (b, kb) = left, right
    if ka is dt.date and kb is int and op in "+-":
        return (F.date_add if op == "+" else F.date_sub)(a, b.cast("int")), dt.date
    if ka is dt.date and kb is dt.timedelta and op in "+-":
        days = F.date_part(F.lit("DAY"), b).cast("int")
        return (F.date_add if op == "+" else F.date_sub)(a, days), dt.date
    if ka is dt.timedelta and kb is dt.date and op == "+":
        return _temporal("+", right, left)
    if op == "-" and ka is dt.date and kb in (dt.date, str):
        return F.datediff(a, b.cast("date")).cast("bigint"), int
    if op == "-" and ka is str and kb is dt.date:
        return F.datediff(a.cast("date"), b).cast("bigint"), int
    if op == "-" and ka is dt.datetime and kb is dt.datetime:
        return a - b, dt.timedelta
    if op in "+-" and ka is dt.datetime and kb is dt.timedelta:
        return (a + b if op == "+" else a - b), dt.datetime
    if op == "+" and ka is dt.timedelta and kb is dt.datetime:
        return b + a, dt.datetime
    if op in "+-" and ka is dt.timedelta and kb is dt.timedelta:
        return (a + b if op == "+" else a - b), dt.timedelta
    raise ColumnTypeError(f"{op}: {ka.__name__} and {kb.__name__}")


def negate(value: Typed) -> Typed:
    if value[1] not in (int, float, dt.timedelta):
        raise ColumnTypeError(f"- of {value[1].__name__}")
    return -value[0], value[1]


def positive(value: Typed) -> Typed:
    if value[1] not in NUMERIC:
        raise ColumnTypeError(f"+ of {value[1].__name__}")
    return value


def absolute(value: Typed) -> Typed:
    if value[1] not in (int, float):
        raise ColumnTypeError(f"abs of {value[1].__name__}")
    return F.abs(value[0]), value[1]
