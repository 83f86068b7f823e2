"""A typed column: an expression over a frame, not data."""

from __future__ import annotations

import datetime as dt
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import kinds
from colonnade.errors import (
    ColumnIndexError, ColumnKeyError, ColumnTypeError, ColumnValueError, EmptyReductionWarning,
)
from colonnade.frame import Frame, aligned, fresh, session
from colonnade.functions import dates, mathfn, numbers, strings
from colonnade.operators import elementwise as E
from colonnade.operators import reductions as R

_KEEP = object()


class Schema(tuple):
    """(kind, nullable)."""

    def __new__(cls, kind, nullable):
        return super().__new__(cls, (kind, nullable))

    kind = property(lambda self: self[0])
    nullable = property(lambda self: self[1])


class Constant:
    """An aggregation that gives one fixed value for each group."""

    def __init__(self, value, dtype=None):
        self.value, self.dtype = value, dtype


class Vector:
    def __new__(cls, initial=(), dtype=None, name=None):
        if isinstance(initial, (list, tuple)) and initial and all(isinstance(v, Vector) for v in initial):
            from colonnade.table import Table

            return Table(list(initial))
        return super().__new__(cls)

    def __init__(self, initial=(), dtype=None, name=None):
        values = list(initial)
        kind, nullable = kinds.infer(values)
        if dtype is not None:
            kind, nullable = dtype if isinstance(dtype, tuple) else (dtype, False)
            kinds.check_values(values, kind, nullable)
        frame, cols = memory_frame([values], [kind])
        self._set(frame, F.col(cols[0]), kind, nullable, name)

    def _set(self, frame, col, kind, nullable=True, name=None, categories=None, owned=False):
        self._frame, self._col, self._kind, self._nullable = frame, col, kind, nullable
        self._name, self._categories, self._owned = name, categories, owned
        return self

    @classmethod
    def of(cls, frame, col, kind, nullable=True, name=None, categories=None, owned=False) -> Vector:
        return object.__new__(cls)._set(frame, col, kind, nullable, name, categories, owned)

    @classmethod
    def filled(cls, value, length, name=None) -> Vector:
        if isinstance(length, bool) or not isinstance(length, int) or length < 0:
            raise ColumnValueError("length must be an int that is not negative")
        kind, nullable = kinds.infer([value])
        order, out = fresh("o"), fresh()
        df = session().range(length).select(F.col("id").alias(order), F.lit(value).cast(kinds.spark_type(kind)).alias(out))
        return cls.of(Frame(df, [(order, True, True)], length, dense=order), F.col(out), kind, nullable, name)

    # Metadata ---------------------------------------------------------------

    def schema(self) -> Schema:
        return Schema(self._kind, self._nullable)

    dtype = property(schema)

    @property
    def vector_name(self):
        return self._name

    @vector_name.setter
    def vector_name(self, name):
        self.alias(name)

    def alias(self, name) -> Vector:
        if self._owned:
            raise ColumnTypeError("a table's column is renamed by the table")
        self._name = name
        return self

    def copy(self, name=_KEEP) -> Vector:
        return self._with(self._col, self._kind, self._nullable, self._name if name is _KEEP else name, self._categories)

    def _with(self, col, kind=None, nullable=None, name=None, categories=None) -> Vector:
        return Vector.of(
            self._frame, col, self._kind if kind is None else kind,
            self._nullable if nullable is None else nullable, name, categories,
        )

    def __len__(self):
        return self._frame.count()

    def __bool__(self):
        raise ColumnTypeError("a vector has no truth value; use .all(), .any(), & and |")

    __hash__ = None

    @property
    def value_column(self) -> Column:
        """The values as a Spark column of the frame (labels for a categorical)."""
        return self._label() if self._categories is not None else self._col

    def _label(self) -> Column:
        return F.get(F.array(*[F.lit(c) for c in self._categories]), self._col)

    # Alignment --------------------------------------------------------------

    def _operand(self, other):
        """(frame, own column, (column, kind), nullable) for an operand of any form."""
        if isinstance(other, Vector):
            if other._frame is self._frame:
                return self._frame, (other.value_column, other._kind), other._nullable
            return aligned(self._frame, other._frame), (other.value_column, other._kind), other._nullable
        if isinstance(other, (list, tuple, range)):
            return self._operand(Vector(other))
        kind = type(other)
        if kind not in kinds.SPARK and other is not None:
            raise ColumnTypeError(f"{other!r} is no column value")
        if kind is str and self._kind is dt.date:
            try:
                return self._frame, (F.lit(dt.date.fromisoformat(other)), dt.date), False
            except ValueError as error:
                raise ColumnValueError(str(error)) from None
        if kind is dt.datetime:
            return self._frame, (F.lit(other).cast("timestamp_ntz"), kind), False
        if kind is int:
            return self._frame, (F.lit(other).cast("long"), int), False
        return self._frame, (F.lit(other), kind), False

    def _binary(self, build, op, other, swap=False, name=None) -> Vector:
        if other is None:
            kind = bool if op in ("==", "!=", "<", "<=", ">", ">=") else self._kind
            return self._with(F.lit(None).cast(kinds.spark_type(kind)), kind, True)
        frame, right, nullable = self._operand(other)
        left = (self.value_column, self._kind)
        col, kind = build(op, right, left) if swap else build(op, left, right)
        return Vector.of(frame, col, kind, self._nullable or nullable, name)

    # Comparison -------------------------------------------------------------

    def _compare(self, op, other):
        from colonnade.table import Table

        if isinstance(other, Table):
            return NotImplemented
        if other is None and op in ("==", "!="):
            warnings.warn(f"{op} None tests for missing values; use is_na()", stacklevel=3)
            return self.is_na() if op == "==" else ~self.is_na()
        if self._categories is not None:
            from colonnade.operators.category import compare

            return compare(self, op, other)
        return self._binary(E.compare, op, other)

    def __eq__(self, other):
        return self._compare("==", other)

    def __ne__(self, other):
        return self._compare("!=", other)

    def __lt__(self, other):
        return self._compare("<", other)

    def __le__(self, other):
        return self._compare("<=", other)

    def __gt__(self, other):
        return self._compare(">", other)

    def __ge__(self, other):
        return self._compare(">=", other)

    def is_na(self) -> Vector:
        return self._with(self._col.isNull(), bool, False)

    def is_in(self, members) -> Vector:
        """Membership; null stays null unless None is a member. Members of another column: a semi-join flag."""
        if isinstance(members, (str, bytes)):
            raise ColumnTypeError("members must be a collection, not one string")
        if isinstance(members, Vector):
            return self._is_in_column(members)
        members = list(members)
        with_null = any(m is None for m in members)
        valid, dead = [], []
        for m in members:
            if m is not None:
                (valid if kinds.promote(self._kind, type(m)) is not None else dead).append(m)
        if dead:
            warnings.warn(f"members {dead[:3]!r} can never equal a {self._kind.__name__}", stacklevel=2)
        valid = [m for m in valid if not (isinstance(m, float) and m != m)]
        c = self.value_column
        found = c.isin(valid) if valid else F.when(c.isNotNull(), F.lit(False))
        if with_null:
            return self._with(F.coalesce(found, F.lit(False)) | c.isNull(), bool, False)
        return self._with(found, bool, self._nullable)

    def _is_in_column(self, members: Vector) -> Vector:
        """A left join with the distinct members gives the flag."""
        flag, key = fresh("m"), fresh("k")
        side = members._frame.bare.select(members.value_column.alias(key)).filter(F.col(key).isNotNull()).distinct()
        side = side.withColumn(flag, F.lit(True))
        df = self._frame.df.join(side, self.value_column == F.col(key), "left")
        frame = Frame(df, list(self._frame.order), self._frame.rows)
        if self._frame.plain is not None:
            frame.plain = self._frame.plain.join(side, self.value_column == F.col(key), "left")
        col = F.when(self.value_column.isNotNull(), F.coalesce(F.col(flag), F.lit(False)))
        return Vector.of(frame, col, bool, self._nullable)

    def isin(self, values) -> Vector:
        """Label membership of a categorical; null is False."""
        if self._categories is None:
            raise AttributeError("isin")
        return self._with(F.coalesce(self._label().isin([v for v in values if v is not None]), F.lit(False)), bool, False)

    def is_type(self, types) -> Vector:
        same = issubclass(self._kind, types if isinstance(types, tuple) else (types,))
        return self._with(self._col.isNotNull() & F.lit(same), bool, False)

    # Logic and arithmetic ---------------------------------------------------

    def __and__(self, o):
        return self._binary(E.logical, "&", o)

    def __or__(self, o):
        return self._binary(E.logical, "|", o)

    def __xor__(self, o):
        return self._binary(E.logical, "^", o)

    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__

    def __invert__(self):
        return self._with(*E.invert((self._col, self._kind)))

    def bit_lshift(self, n):
        return self._binary(E.shift, "<<", n)

    def bit_rshift(self, n):
        return self._binary(E.shift, ">>", n)

    def __neg__(self):
        return self._with(*E.negate((self._col, self._kind)))

    def __pos__(self):
        return self._with(*E.positive((self._col, self._kind)))

    def __abs__(self):
        return self._with(*E.absolute((self._col, self._kind)))

    def __matmul__(self, other):
        """Dot product; a null on either side fails."""
        from colonnade.table import Table

        if isinstance(other, Table):
            return other._dots(self)
        product = self * other
        bad = product._frame.bare.agg(F.count_if(product._col.isNull()), F.sum(product._col)).first()
        if bad[0]:
            raise ColumnTypeError("null in a dot product")
        return bad[1] if bad[1] is not None else 0

    # Null tools and casts ---------------------------------------------------

    def fillna(self, value) -> Vector:
        if self._categories is not None:
            if value not in self._categories:
                raise ColumnValueError(f"{value!r} is no category")
            filled = F.coalesce(self._col, F.lit(self._categories.index(value)))
            return self._with(filled, nullable=False, categories=self._categories, name=self._name)
        kind = kinds.fits(value, self._kind)
        _, (lit, own), _ = self._operand(kinds.convert(value, kind))
        col = F.coalesce(E.typed(self._col, self._kind, kind), E.typed(lit, own, kind))
        return self._with(col, kind, False, self._name)

    def coalesce(self, *others) -> Vector:
        """First value present, by position."""
        if not others:
            raise ColumnTypeError("coalesce needs a fallback")
        out = self
        for other in others:
            kind = kinds.promote(out._kind, other._kind) if isinstance(other, Vector) else None
            if kind is None:
                raise ColumnTypeError("coalesce of kinds that do not go together")
            frame, (col, own), nullable = out._operand(other)
            left = E.typed(out.value_column, out._kind, kind)
            out = Vector.of(frame, F.coalesce(left, E.typed(col, own, kind)), kind, out._nullable and nullable, self._name)
        return out

    def cast(self, goal, returns=None) -> Vector:
        """To a kind by Python's rules, or through any callable (``returns``: its kind, else found on all values)."""
        if not isinstance(goal, type):
            return self._through(goal, returns)
        c, kind = self.value_column, self._kind
        text = E.typed(c, kind, str) if kind is str else c
        if goal is kind:
            out = c
        elif goal is str:
            if kind is bool:
                out = F.when(c, "True").when(~c, "False")
            elif kind is float:
                return self._through(str, str)
            elif kind is dt.datetime:
                out = F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.000000$", "")
            else:
                out = c.cast("string")
        elif goal is bool:
            out = R.truth(c, kind)
        elif goal in (int, float):
            # Python allows single underscores between digits.
            digits = F.regexp_replace(F.trim(text), "(?<=[0-9])_(?=[0-9])", "") if kind is str else c
            out = digits.cast(kinds.spark_type(goal))
        elif goal in (dt.date, dt.datetime):
            out = c.cast(kinds.spark_type(goal))
        elif goal is object:
            out = c
        else:
            return self._through(goal, goal)
        return self._with(out, goal, self._nullable, self._name)

    def _through(self, fn, returns) -> Vector:
        """Any callable, value by value; without ``returns`` a first pass over all values finds the kind."""
        kind, goal = self._kind, returns

        def applied(v):
            if v is None or v is pd.NaT or kind is not float and isinstance(v, float) and v != v:
                return None
            # pandas shows ints beside nulls as floats, and has moments and spans of its own.
            if isinstance(v, pd.Timestamp):
                v = v.to_pydatetime()
            elif isinstance(v, pd.Timedelta):
                v = v.to_pytimedelta()
            return fn(int(v) if kind is int else v)

        if goal is None:

            def tell(values: pd.Series, present: pd.Series) -> pd.Series:
                return pd.Series([kinds.name_of(applied(v)) if p else "" for v, p in zip(values, present)], dtype=object)

            c = self.value_column
            told = F.pandas_udf(tell, "string")(c, c.isNotNull())
            goal = kinds.named(r[0] for r in self._frame.bare.select(told).distinct().collect())

        def run(values: pd.Series, present: pd.Series) -> pd.Series:
            return pd.Series([kinds.exactly(applied(v), goal) if p else None for v, p in zip(values, present)], dtype=object)

        udf = F.pandas_udf(run, kinds.spark_type(goal))
        return self._with(udf(self.value_column, self.value_column.isNotNull()), goal, self._nullable, self._name)

    def to_object(self) -> Vector:
        return self._with(self.value_column, object, self._nullable, self._name)

    # Rows -------------------------------------------------------------------

    def _rows(self):
        from colonnade.table import Table

        return Table.of(self._frame, [self])

    def _only(self, table) -> Vector:
        v = table._columns[0]
        return v.copy(self._name)

    def __getitem__(self, key):
        if isinstance(key, int) and not isinstance(key, bool):
            n = len(self)
            if not -n <= key < n:
                raise ColumnIndexError(f"position {key} of {n}")
            row = self._frame.df.select(self.value_column.alias("v"), *[c for c, _, _ in self._frame.order])
            return Frame(row, self._frame.order).sorted().offset(key % n).limit(1).first()[0]
        return self._only(self._rows()[key])

    def __iter__(self):
        yield from self.to_list()

    def to_list(self) -> list:
        order = [c for c, _, _ in self._frame.order]
        df = Frame(self._frame.df.select(self.value_column.alias("v"), *order), self._frame.order).sorted()
        return [r[0] for r in df.collect()]

    def dropna(self) -> Vector:
        out = self._only(self._rows().dropna())
        out._nullable = False
        return out

    def unique(self) -> Vector:
        return self._only(self._rows().unique())

    def sort_by(self, reverse=False, na_last=True) -> Vector:
        return self._only(self._rows()._sorted_by([(self, self._col)], reverse, na_last))

    def __lshift__(self, other):
        from colonnade.table import Table

        if not isinstance(other, Vector):
            other = Vector(other if isinstance(other, (list, tuple, range)) else [other])
        return self._only(Table.of(self._frame, [self]) << Table.of(other._frame, [other]))

    def __rlshift__(self, other):
        return Vector(other if isinstance(other, (list, tuple, range)) else [other]) << self

    def __rshift__(self, other):
        return self._rows() >> other

    def __setitem__(self, key, value):
        if self._owned:
            raise ColumnTypeError("a table's column is assigned through the table")
        from colonnade.operators.mutation import assigned

        new = assigned(self, key, value)
        self._set(new._frame, new._col, new._kind, new._nullable, self._name, new._categories)

    # Categories -------------------------------------------------------------

    def categorize(self, categories=None) -> Vector:
        from colonnade.operators.category import categorize

        return categorize(self, categories)

    @property
    def categories(self):
        if self._categories is None:
            raise AttributeError("categories")
        return self._categories

    def set_categories(self, categories) -> Vector:
        from colonnade.operators.category import categorize

        return categorize(self._with(self._label(), str, name=self._name), categories)

    # Reductions -------------------------------------------------------------

    def _reduce(self, name, registry=R.BASIC, **arguments):
        from colonnade.operators.grouping import Output, reduce_all

        frame = self._frame
        for k, v in arguments.items():
            if isinstance(v, Vector):
                if v._frame is not frame:
                    if len(v) != len(self):
                        raise ColumnValueError("lengths differ")
                    frame = aligned(frame, v._frame)
                arguments[k] = v._col
        if name in ("all", "any") and arguments.get("on_empty") is None:
            if not frame.bare.select(F.count(self._col)).first()[0]:
                warnings.warn(f"{name}() of no values", EmptyReductionWarning, stacklevel=3)
        return reduce_all(frame, [Output(name, self._on(frame), name, registry, arguments)])[0]

    def _on(self, frame):
        return Vector.of(frame, self.value_column, self._kind, self._nullable, self._name)

    def sum(self):
        return self._reduce("sum")

    def count(self, sub=None):
        if sub is not None:
            if self._kind is not str:
                raise AttributeError("count")
            return self._with(*strings.METHODS["count"](self.value_column, sub))
        return self._reduce("count")

    def min(self):
        return self._reduce("min")

    def max(self):
        return self._reduce("max")

    def mean(self):
        return self._reduce("mean")

    def std(self):
        return self._reduce("std")

    def stdev(self, population=False):
        return self._reduce("stdev", population=population)

    def all(self, on_empty=None):
        return self._reduce("all", on_empty=on_empty)

    def any(self, on_empty=None):
        return self._reduce("any", on_empty=on_empty)

    def first(self):
        return self._reduce("first")

    def last(self):
        return self._reduce("last")

    def constant(self, value, dtype=None, nullable=None):
        return Constant(value, dtype)

    # Element methods --------------------------------------------------------

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        kind = self._kind
        if name in ("stats", "math"):
            if kind not in (int, float):
                raise AttributeError(f"{name} is for int and float columns")
            return Stats(self) if name == "stats" else Math(self)
        if self._categories is None:
            c = self._col
            properties = dates.PROPERTIES if kind is dt.date else numbers.PROPERTIES.get(kind, {})
            if name in properties:
                return self._with(*properties[name](c))
            methods = {str: strings.METHODS, dt.date: dates.METHODS, int: numbers.INT, float: numbers.FLOAT}.get(kind, {})
            if name in methods:
                return lambda *args, **kwargs: self._with(*methods[name](c, *args, **kwargs))
        raise AttributeError(f"{kind.__name__} column has no {name!r}")

    def __repr__(self):
        from colonnade.display import vector_text

        return vector_text(self)


def _arithmetic(op):
    def forward(self, other):
        from colonnade.table import Table

        if isinstance(other, Table):
            return NotImplemented
        if op == "**" and self._kind is int and type(other) is int and 0 <= other <= 64:
            return self._with(E.whole_power(self._col, other), int)
        return self._binary(E.arithmetic, op, other)

    def backward(self, other):
        return self._binary(E.arithmetic, op, other, swap=True)

    return forward, backward


for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("truediv", "/"), ("floordiv", "//"), ("mod", "%"), ("pow", "**")):
    _f, _b = _arithmetic(_op)
    setattr(Vector, f"__{_name}__", _f)
    setattr(Vector, f"__r{_name}__", _b)


class Stats:
    """``v.stats``: statistics of the values present."""

    registry = R.STATS

    def __init__(self, vector):
        self.vector = vector


class Math:
    """``v.math``: element functions and reductions."""

    registry = R.MATH

    def __init__(self, vector):
        self.vector = vector

    def log(self, base=None):
        return self._optional("log", base)

    def perm(self, k=None):
        return self._optional("perm", k)

    def _optional(self, name, operand):
        v = self.vector
        if operand is None:
            return v._with(*mathfn.OPTIONAL[name](v._col, v._kind))
        frame, (col, _), nullable = v._operand(operand)
        return Vector.of(frame, *mathfn.OPTIONAL[name](v._col, v._kind, col), v._nullable or nullable)

    def isclose(self, other, rel_tol=1e-9, abs_tol=0.0):
        v = self.vector
        frame, (col, _), nullable = v._operand(other)
        return Vector.of(frame, *mathfn.CLOSE(v._col, v._kind, col, rel_tol, abs_tol), v._nullable or nullable)


def _reducer(name, positional):
    def method(self, *args, **kwargs):
        if len(args) > len(positional):
            raise TypeError(f"{name}() takes {len(positional)} positional arguments, {len(args)} given")
        kwargs |= dict(zip(positional, args, strict=False))
        return self.vector._reduce(name, self.registry, **kwargs)

    method.__name__ = name
    return method


_POSITIONAL = {"harmonic_mean": ("weights",), "covariance": ("other",), "correlation": ("other",),
               "linear_regression": ("other",), "dist": ("other",), "pvariance": ("mu",), "pstdev": ("mu",),
               "variance": ("xbar",), "stdev": ("xbar",)}
for _cls in (Stats, Math):
    for _name in _cls.registry:
        setattr(_cls, _name, _reducer(_name, _POSITIONAL.get(_name, ())))


def _unary(name):
    def method(self):
        v = self.vector
        return v._with(*mathfn.UNARY[name](v._col, v._kind))

    return method


def _operand_function(name):
    def method(self, operand):
        v = self.vector
        frame, (col, _), nullable = v._operand(operand)
        return Vector.of(frame, *mathfn.BINARY[name](v._col, v._kind, col), v._nullable or nullable)

    return method


for _name in mathfn.UNARY:
    setattr(Math, _name, _unary(_name))
for _name in mathfn.BINARY:
    setattr(Math, _name, _operand_function(_name))


def memory_frame(columns: list[list], column_kinds: list) -> tuple[Frame, list[str]]:
    """A frame of Python values, with their positions as its order."""
    n = len(columns[0]) if columns else 0
    names, order = [fresh() for _ in columns], fresh("o")
    fields = [T.StructField(c, _field_type(k, v), True) for c, k, v in zip(names, column_kinds, columns, strict=True)]
    rows = [
        (i, *[kinds.convert(v[i], k) if not isinstance(v[i], complex) else (v[i].real, v[i].imag) for v, k in zip(columns, column_kinds, strict=True)])
        for i in range(n)
    ]
    df = session().createDataFrame(rows, T.StructType([T.StructField(order, T.LongType(), False), *fields]))
    return Frame(df, [(order, True, True)], n, dense=order), names


def _field_type(kind, values):
    if kind in kinds.SPARK:
        return kinds.SPARK[kind]
    if kind in (list, tuple):
        own, _ = kinds.infer([x for v in values if v is not None for x in v])
        return T.ArrayType(kinds.spark_type(own))
    if kind is dict:
        pairs = [p for v in values if v is not None for p in v.items()]
        return T.MapType(kinds.spark_type(kinds.infer([k for k, _ in pairs])[0]), kinds.spark_type(kinds.infer([v for _, v in pairs])[0]))
    return kinds.spark_type(kind)


__all__ = ["ColumnKeyError", "Constant", "Math", "Schema", "Stats", "Vector", "memory_frame"]
