"""Kinds of columns: Python types, their Spark types, inference and promotion."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from colonnade.errors import ColumnTypeError, ColumnValueError

SPARK = {
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bytes: T.BinaryType(),
    dt.date: T.DateType(),
    dt.datetime: T.TimestampNTZType(),
    dt.timedelta: T.DayTimeIntervalType(),
    object: T.StringType(),
    Decimal: T.DecimalType(38, 10),
    complex: T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
}
NUMERIC = (bool, int, float)
_LADDERS = ((bool, int, float, complex), (dt.date, dt.datetime))


def spark_type(kind) -> T.DataType:
    if isinstance(kind, T.DataType):
        return kind
    if kind is Decimal:
        return T.DecimalType(38, 10)
    return SPARK[kind]


def kind_of(data_type: T.DataType):
    """Kind and the Spark type that columns of this type are widened to."""
    if isinstance(data_type, T.BooleanType):
        return bool, T.BooleanType()
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return int, T.LongType()
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return float, T.DoubleType()
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return str, T.StringType()
    if isinstance(data_type, T.BinaryType):
        return bytes, data_type
    if isinstance(data_type, T.DateType):
        return dt.date, data_type
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return dt.datetime, T.TimestampNTZType()
    if isinstance(data_type, T.DayTimeIntervalType):
        return dt.timedelta, data_type
    if isinstance(data_type, T.DecimalType):
        return Decimal, data_type
    if isinstance(data_type, T.ArrayType):
        return list, data_type
    if isinstance(data_type, T.MapType):
        return dict, data_type
    if isinstance(data_type, T.StructType):
        return tuple, data_type
    return object, data_type


def promote(left, right):
    """The wider of two kinds of one ladder, or None."""
    if left is right:
        return left
    for ladder in _LADDERS:
        if left in ladder and right in ladder:
            return max(left, right, key=ladder.index)
    return None


def infer(values) -> tuple[type, bool]:
    """(kind, nullable) of Python values; nulls only set nullable, mixes are object."""
    kind, nullable = None, False
    for v in values:
        if v is None:
            nullable = True
            continue
        own = type(v)
        kind = own if kind is None else (promote(kind, own) or object)
    return (object, True) if kind is None else (kind if kind in SPARK or kind in (Decimal, list, dict, tuple) else object, nullable)


_NAMES = {k.__name__: k for k in (bool, int, float, str, bytes, dt.date, dt.datetime, dt.timedelta, Decimal, list, dict)}


def name_of(value) -> str:
    """The name of a value's kind, as UDFs report it; numpy's numbers count as Python's."""
    if value is None:
        return ""
    value = value.item() if hasattr(value, "item") else value
    own = type(value).__name__
    if own == "int" and not -(1 << 63) <= value < 1 << 63:
        return "object"
    return own if own in _NAMES else "object"


def named(names) -> type:
    """The kind that holds values of all these kinds; object if there is none, or no value."""
    found = [_NAMES.get(n, object) for n in names if n]
    kind = found[0] if found else object
    for other in found[1:]:
        kind = promote(kind, other) or object
    return kind if kind in SPARK else object


def exactly(value, kind):
    """A Python value as a column of ``kind`` holds it; raises where that would change it."""
    if value is None:
        return None
    value = value.item() if hasattr(value, "item") else value
    if kind is object:
        return value if isinstance(value, str) else str(value)
    if not isinstance(kind, type) or type(value) is kind:
        return value
    if promote(type(value), kind) is kind:
        return convert(value, kind)
    raise ColumnTypeError(f"{value!r} is no {kind.__name__}; name its kind with returns=")


def check_values(values, kind, nullable: bool) -> None:
    for k, v in enumerate(values):
        if v is None:
            if not nullable:
                raise ColumnTypeError(f"null at {k} in a column that holds none")
        elif kind is not object and promote(kind, type(v)) is not kind:
            raise ColumnTypeError(f"{v!r} at {k} is no {kind.__name__}")


def fits(value, kind):
    """Kind that holds both ``kind`` and ``value``; raises if there is none."""
    own = type(value)
    found = own if kind is object else promote(kind, own)
    if found is None:
        raise ColumnValueError(f"{value!r} does not fit {kind.__name__}")
    return found


def convert(value, kind):
    if value is None or type(value) is kind:
        return value
    if kind is dt.datetime and type(value) is dt.date:
        return dt.datetime(value.year, value.month, value.day)
    if kind is object:
        return str(value)
    return kind(value) if kind in (int, float) else value
