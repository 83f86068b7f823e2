"""Aggregation and window: declared outputs to one Spark aggregation."""

from __future__ import annotations

import datetime as dt
import types
import warnings
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce as fold

import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from colonnade import kinds
from colonnade.errors import ColumnTypeError, ColumnValueError, EmptyReductionWarning
from colonnade.frame import Frame, fresh
from colonnade.naming import unique_names
from colonnade.operators import elementwise as E
from colonnade.operators import reductions as R
from colonnade.operators.local import ColumnVector, LocalTable, LocalVector


@dataclass
class Output:
    name: str
    vector: object
    reduction: str
    registry: dict
    arguments: dict = field(default_factory=dict)

    @property
    def gathered(self) -> bool:
        """Runs as a Python aggregate over parts of a group, and then over the parts' results."""
        v = self.vector
        return self.registry is R.MATH and (
            self.reduction in ("fsum", "gcd", "lcm") or self.reduction == "prod" and v._kind is int
        )

    @property
    def two_level(self) -> bool:
        """Counts the values first."""
        exclusive = self.reduction == "quantiles" and self.arguments.get("method", "exclusive") == "exclusive"
        return self.registry is R.STATS and (self.reduction in R.TWO_LEVEL or exclusive)

    def column(self, rank) -> tuple[Column, type]:
        return self.registry[self.reduction](self.vector.value_column, self.vector._kind, rank, **self.arguments)


class AggExpr:
    """An aggregate of a symbolic group; arithmetic and comparison build on it."""

    apart = False  # whether it counts distinct values, for which rows are grouped by these first

    def __init__(self, col, kind, whole=None):
        self.col, self.kind = col, kind

    def _with(self, build, op, other, swap=False):
        if not isinstance(other, AggExpr):
            other = AggExpr(F.lit(other), type(other))
        left, right = (other, self) if swap else (self, other)
        return AggExpr(*build(op, (left.col, left.kind), (right.col, right.kind)))

    def __neg__(self):
        return AggExpr(*E.negate((self.col, self.kind)))

    def __bool__(self):
        raise _Untraceable

    __hash__ = None


for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("truediv", "/"), ("floordiv", "//"), ("mod", "%"), ("pow", "**")):
    setattr(AggExpr, f"__{_name}__", lambda self, o, op=_op: self._with(E.arithmetic, op, o))
    setattr(AggExpr, f"__r{_name}__", lambda self, o, op=_op: self._with(E.arithmetic, op, o, True))
for _name, _op in (("eq", "=="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    setattr(AggExpr, f"__{_name}__", lambda self, o, op=_op: self._with(E.compare, op, o))


class _Untraceable(Exception):
    pass


def _traced(table, fn, rank, returns=None) -> AggExpr | None:
    """The callable's aggregate expression, if it only uses reductions, lengths and arithmetic on them."""
    from colonnade.vector import Vector

    apart = []

    class GroupVector(Vector):
        _masked = False  # nulls stand for rows that a mask leaves out: reductions skip both alike
        _where = None  # the mask
        _distinct = False  # only for its length

        def _reduce(self, name, registry=R.BASIC, **arguments):
            if self._distinct or name in R.TWO_LEVEL or self._masked and name in ("first", "last"):
                raise _Untraceable
            if self._masked and any(isinstance(v, Vector) for v in arguments.values()):
                raise _Untraceable
            if any(getattr(v, "_distinct", False) for v in arguments.values()):
                raise _Untraceable
            arguments = {k: v._col if isinstance(v, Vector) else v for k, v in arguments.items()}
            out = Output(name, self, name, registry, arguments)
            if out.gathered or out.two_level:
                raise _Untraceable
            return AggExpr(*out.column(rank))

        def _with(self, col, kind=None, nullable=None, name=None, categories=None):
            if self._masked or self._distinct:
                raise _Untraceable
            base = Vector._with(self, col, kind, nullable, name, categories)
            return object.__new__(GroupVector)._set(base._frame, base._col, base._kind, base._nullable, name, categories)

        def _binary(self, *args, **kwargs):
            if any(getattr(a, "_masked", False) or getattr(a, "_distinct", False) for a in (self, *args)):
                raise _Untraceable
            base = Vector._binary(self, *args, **kwargs)
            if base._frame is not self._frame:
                raise _Untraceable
            return object.__new__(GroupVector)._set(base._frame, base._col, base._kind, base._nullable)

        def _operand(self, other):
            if self._distinct or getattr(other, "_distinct", False):
                raise _Untraceable
            return Vector._operand(self, other)

        def __getitem__(self, key):
            if not isinstance(key, GroupVector) or key._kind is not bool or key._masked or self._masked or self._categories:
                raise _Untraceable
            if self._distinct or key._distinct:
                raise _Untraceable
            out = object.__new__(GroupVector)._set(self._frame, F.when(key._col, self._col), self._kind, True)
            out._masked, out._where = True, key._col
            return out

        def unique(self):
            if self._kind not in _HASHED or self._categories or self._distinct:
                raise _Untraceable
            out = object.__new__(GroupVector)._set(self._frame, self._col, self._kind, True)
            out._masked, out._where, out._distinct = self._masked, self._where, True
            return out

        def _length(self):
            rows = F.lit(True) if self._where is None else self._where
            if not self._distinct:
                return AggExpr(F.count_if(rows), int)
            apart.append(self)
            # A null is one value, and each NaN is its own.
            c = self._col
            more = F.coalesce(F.max(F.when(rows & c.isNull(), F.lit(1))), F.lit(0)).cast("long")
            if self._kind is float:
                more += F.count_if(rows & c.isNotNull() & F.isnan(c))
                c = F.when(~F.isnan(c), c + 0.0)
            return AggExpr(F.count_distinct(c) + more, int)

        def _forbidden(self, *args, **kwargs):
            raise _Untraceable

        __len__ = __iter__ = to_list = dropna = sort_by = _rows = _is_in_column = _forbidden

    class GroupTable(type(table)):
        _mask = None

        def __getitem__(self, key):
            if isinstance(key, str):
                return self._grouped(super().__getitem__(key))
            if isinstance(key, GroupVector) and self._mask is None:
                out = object.__new__(GroupTable)
                out._frame, out._columns, out._table_name, out._mask = self._frame, self._columns, None, key
                return out
            raise _Untraceable

        def __getattr__(self, name):
            return self._grouped(super().__getattr__(name))

        def _grouped(self, v):
            out = object.__new__(GroupVector)._set(v._frame, v._col, v._kind, v._nullable, v._name, v._categories, True)
            return out if self._mask is None else out[self._mask]

        def _length(self):
            key = self._mask
            if key is not None and (key._kind is not bool or key._masked or key._distinct):
                raise _Untraceable
            return AggExpr(F.count(F.lit(1)) if key is None else F.count_if(key._col), int)

        def __len__(self):
            raise _Untraceable

    def length(x):
        if isinstance(x, (GroupVector, GroupTable)):
            return x._length()
        if isinstance(x, (Vector, type(table))):
            raise _Untraceable
        return len(x)

    group = object.__new__(GroupTable)
    group._frame, group._columns, group._table_name = table._frame, table._columns, None
    try:
        found = _with_length(fn, length)(group)
    except Exception:
        return None
    if isinstance(found, AggExpr):
        found.apart = bool(apart)
        return _declared(found, returns)
    return None


#: Kinds whose distinct values are the same for Spark and for a dict.
_HASHED = (bool, int, float, str, bytes, dt.date, dt.datetime, dt.timedelta, Decimal)


def _with_length(fn, length):
    """The function with another ``len``, as Python's own gives nothing but ints."""
    if not isinstance(fn, types.FunctionType) or fn.__globals__.get("len", len) is not len:
        return fn
    out = types.FunctionType(fn.__code__, {**fn.__globals__, "len": length}, fn.__name__, fn.__defaults__, fn.__closure__)
    out.__kwdefaults__ = fn.__kwdefaults__
    return out


def _declared(found: AggExpr, kind) -> AggExpr | None:
    """Of the kind that the caller names; None if that does not hold the values."""
    if kind is None or kind is found.kind:
        return found
    if found.kind in (bool, int) and kind in (int, float):
        found.col, found.kind = E.typed(found.col, found.kind, kind), kind
        return found
    return None


def _udaf(table, fn, keys: list[str], order: str, returns, out: str):
    """groupBy(keys).applyInArrow: the callable over each group as a local table, rows in order.

    Spark sorts the rows; a worker holds its group in Arrow's form and shows
    as Python values what the callable looks at.  Without ``returns`` the callable runs over all groups twice: first to find
    the kind that holds every value.
    """
    from pyspark.sql import types as T

    names = [c._name for c in table._columns]
    physical = [fresh() for _ in names]
    df = table._frame.df.select(
        *[F.col(k) for k in keys], table._frame.rank().alias(order), *[c.value_column.alias(p) for c, p in zip(table._columns, physical, strict=True)]
    )

    # Groups are dealt and sorted by their keys; the sort by these is kept, and within a group by the order.
    dealt = df.repartition(*keys) if keys else df.repartition(1)
    df = dealt.sortWithinPartitions(*keys, order).drop(order)

    def value_of(group):
        value = fn(LocalTable(names, [ColumnVector(group[p]) for p in physical]))
        if isinstance(value, (list, LocalVector, LocalTable)):
            raise ColumnTypeError("an aggregation gives one value for each group")
        return value

    if returns is None:

        def tell(group):
            return pa.table({"kind": [kinds.name_of(value_of(group))]})

        returns = kinds.named(r[0] for r in df.groupBy(*keys).applyInArrow(tell, "kind string").distinct().collect())
    goal = kinds.spark_type(returns)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(out, goal, True)])

    def run(group):
        value = kinds.exactly(value_of(group), returns)
        columns = [group[k].slice(0, 1) for k in keys]
        return pa.table([*columns, pa.array([value], to_arrow_type(goal))], names=[*keys, out])

    return df.groupBy(*keys).applyInArrow(run, schema), returns


def parse_outputs(table, aggregations) -> list:
    """(name, what) in order; blocks become one output for each column."""
    from colonnade.table import Table
    from colonnade.vector import Constant, Math, Stats, Vector

    found = []
    for name, what in (aggregations or {}).items():
        owner, method = getattr(what, "__self__", None), getattr(what, "__name__", "")
        if isinstance(owner, Table) and method in R.BASIC:
            for c in owner._columns:
                found.append((f"{name}{c._name}", Output(method, c, method, R.BASIC, {})))
        elif isinstance(owner, Vector) and method in R.BASIC:
            found.append((name, Output(method, owner, method, R.BASIC, {})))
        elif isinstance(owner, (Stats, Math)) and method in owner.registry:
            found.append((name, Output(method, owner.vector, method, owner.registry, {})))
        elif what is len or isinstance(what, (Constant, Output)) or callable(what):
            found.append((name, what))
        else:
            raise ColumnTypeError(f"{name}: pass an unbound reduction such as t.{name}.sum, len or a callable; got {what!r}")
    names = unique_names([n for n, _ in found])
    return [(n, w) for n, (_, w) in zip(names, found, strict=True)]


def check_frames(table, outputs) -> None:
    for name, what in outputs:
        if isinstance(what, Output) and what.vector._frame is not table._frame:
            raise ColumnValueError(f"{name}: the column belongs to another table")


def reduce_all(frame: Frame, outputs: list[Output]) -> list:
    """Values of reductions over a whole frame: one job (two for counted ones)."""
    from colonnade.table import Table

    out = {}
    native = [o for o in outputs if not o.gathered and not o.two_level]
    if native:
        positional = any(o.reduction in ("first", "last") for o in native)
        rank = frame.rank() if positional else None
        columns = [o.column(rank)[0].alias(f"r{i}") for i, o in enumerate(native)]
        row = (frame.df if positional else frame.bare).agg(*columns).first()
        out |= {id(o): v for o, v in zip(native, row, strict=True)}
    for o in outputs:
        if o.gathered:
            out[id(o)] = R.gathered(frame.bare, [], o.vector.value_column, o.vector._kind, o.reduction, "r").first()["r"]
        elif o.two_level:
            df, name, _ = _two_level(Table.of(frame, []), [], o)
            row = df.first()
            value = row[name] if row else None
            out[id(o)] = [] if value is None and o.reduction == "multimode" else value
    return [out[id(o)] for o in outputs]


def _two_level(table, keys: list[str], out: Output):
    """(DataFrame by keys, column, kind) of a reduction over the counts of distinct values.

    mode and multimode: the most frequent values, first seen first; quantiles:
    the values at given places of the sorted ones.  No group is held in memory.
    """
    name, value, n, at, top = (fresh() for _ in range(5))
    frame = table._frame
    c, kind = out.vector.value_column, out.vector._kind
    if out.reduction == "quantiles":
        pieces = R.check_pieces(**out.arguments)
        rows = frame.bare.select(*keys, c.cast("double").alias(value)).filter(F.col(value).isNotNull())
        counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))
        totals = counts.groupBy(*keys).agg(F.sum(n).alias(top))
        if keys:
            renamed = {k: fresh("g") for k in keys}
            totals = totals.withColumnsRenamed(renamed)
            joined = counts.join(totals, _null_safe(counts, totals, list(renamed.items()))).drop(*renamed.values())
        else:
            joined = counts.withColumn(top, totals.scalar())
        upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        places = joined.withColumn(at, F.sum(n).over(upto))
        found = R.exclusive_cuts(F.col(value), F.col(at), F.col(n), F.col(top), pieces)
        return places.groupBy(*keys).agg(found.alias(name)), name, list
    rank = frame.rank()
    rows = frame.df.select(*keys, c.alias(value), rank.alias(at)).filter(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(at))
    if out.reduction == "mode":
        best = F.struct((-F.col(n)).alias("n"), F.col(at).alias("at"))
        return counts.groupBy(*keys).agg(F.min_by(value, best).alias(name)), name, kind
    # Only the most frequent values of a group are listed.
    most = counts.groupBy(*keys).agg(F.max(n).alias(top))
    renamed = {k: fresh("g") for k in keys}
    most = most.withColumnsRenamed(renamed)
    kept = counts.join(most, _null_safe(counts, most, list(renamed.items())) & (F.col(n) == F.col(top)), "left_semi")
    listed = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))))
    return kept.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias(name)), name, list


def _null_safe(left, right, keys: list[tuple[str, str]]):
    return fold(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in keys], F.lit(True))


def aggregate(table, groupby, aggregations, returns=None):
    """One row for each group in order of first appearance; without groupby exactly one row."""
    from colonnade.table import Table
    from colonnade.vector import Constant, Vector

    if isinstance(groupby, dict) and aggregations is None:
        groupby, aggregations = None, groupby
    key_vectors = table._keys(groupby) if groupby is not None else []
    outputs = parse_outputs(table, aggregations)
    check_frames(table, outputs)
    keys = [fresh("g") for _ in key_vectors]
    frame = table._frame
    rank = frame.rank()
    order = fresh("o")
    # The frame with its group keys, under which every kind of output is computed.
    keyed = Frame(frame.df.select("*", *[v._col.alias(k) for v, k in zip(key_vectors, keys, strict=True)]), frame.order, frame.rows)
    view = Table.of(keyed, table._columns)
    columns, joined, verdicts = [], [], []
    native, sides = [F.min(rank).alias(order)], []
    ordered = False  # whether an output follows the order of the rows
    for name, what in outputs:
        out = fresh()
        categories = None
        if what is len:
            native.append(F.count(F.lit(1)).alias(out))
            kind = int
        elif isinstance(what, Constant):
            col, kind = R.constant(what.value, what.dtype)
            columns.append((name, out, kind, None, col))
            continue
        elif isinstance(what, Output):
            if what.two_level:
                df, out, kind = _two_level(view, keys, what)
                sides.append(df)
            elif what.gathered:
                kind = float if what.reduction == "fsum" else int
                sides.append(R.gathered(keyed.df, keys, what.vector.value_column, what.vector._kind, what.reduction, out))
            else:
                ordered |= what.reduction in ("first", "last")
                col, kind = what.column(rank)
                categories = what.vector._categories if what.reduction in ("first", "last", "min", "max") else None
                native.append(col.alias(out))
                if what.reduction in ("all", "any"):
                    hidden = fresh("n")
                    native.append(F.count(what.vector._col).alias(hidden))
                    verdicts.append((name, hidden))
        else:
            found = _traced(table, what, rank, (returns or {}).get(name))
            if found is not None and found.apart:
                sides.append(keyed.df.groupBy(*keys).agg(found.col.alias(out)))
                kind = found.kind
            elif found is not None:
                native.append(found.col.alias(out))
                kind, ordered = found.kind, True
            else:
                side, kind = _udaf(view, what, keys, fresh("o"), (returns or {}).get(name), out)
                sides.append(side)
        columns.append((name, out, kind, None, None))
    df = keyed.df.groupBy(*keys).agg(*native) if keys else keyed.df.agg(*native)
    for side in sides:
        renamed = {k: fresh("g") for k in keys}
        side = side.withColumnsRenamed(renamed)
        if keys:
            df = df.join(side, _null_safe(df, side, list(renamed.items())), "left")
        else:
            df = df.join(side.withColumn(one := fresh(), F.lit(1)), F.lit(1) == F.col(one), "left")
    result = Frame(df, [(order, True, True)], None, verdicts)
    if frame.plain is not None and not sides and not ordered and (keys or native[1:]):
        named = frame.plain.select("*", *[v._col.alias(k) for v, k in zip(key_vectors, keys, strict=True)])
        if native[1:]:
            result.plain = (named.groupBy(*keys) if keys else named).agg(*native[1:])
        else:
            result.plain = named.select(*keys).distinct()
    made = [
        Vector.of(result, F.col(k), v._kind, v._nullable, v._name, v._categories, True) for v, k in zip(key_vectors, keys, strict=True)
    ]
    for name, out, kind, _, const in columns:
        made.append(Vector.of(result, F.col(out) if const is None else const, kind, True, name, None, True))
    return Table.of(result, made)


def window(table, groupby, aggregations, returns=None):
    """Each group's value on each of its rows: key columns and the declared outputs, in row order."""
    from colonnade.table import Table
    from colonnade.vector import Constant, Vector

    if groupby is None:
        raise ColumnTypeError("window needs groupby")
    key_vectors = table._keys(groupby)
    for what in (aggregations or {}).values():
        if isinstance(getattr(what, "__self__", None), Table):
            raise ColumnTypeError("a block has no window form")
    outputs = parse_outputs(table, aggregations)
    check_frames(table, outputs)
    frame = table._frame
    keys = [fresh("g") for _ in key_vectors]
    late, columns = {}, []
    for name, what in outputs:
        if isinstance(what, Constant):
            col, kind = R.constant(what.value, what.dtype)
            columns.append((name, col, kind))
        else:
            late[name] = what
            columns.append((name, None, None))
    # Aggregated once, then back by null-safe keys: small results are broadcast, and no task holds a whole group.
    side = aggregate(table, groupby, late, returns) if late else None
    named = [v._col.alias(k) for v, k in zip(key_vectors, keys, strict=True)]
    df = frame.df.select("*", *named)
    plain = None if frame.plain is None else frame.plain.select("*", *named)
    if late:
        renamed = [fresh("g") for _ in keys]
        values = {c._name: (fresh(), c) for c in side._columns[len(keys):]}
        sdf = side._frame.bare.select(
            *[c._col.alias(r) for c, r in zip(side._columns, renamed, strict=False)], *[c._col.alias(n) for n, c in values.values()]
        )
        match = list(zip(keys, renamed, strict=True))
        df = df.join(sdf, _null_safe(df, sdf, match), "left")
        plain = None if plain is None else plain.join(sdf, _null_safe(plain, sdf, match), "left")
        columns = [(n, F.col(values[n][0]), values[n][1]._kind) if c is None else (n, c, k) for n, c, k in columns]
    result = Frame(df, list(frame.order), frame.rows, plain=plain)
    made = [
        Vector.of(result, F.col(k), v._kind, v._nullable, v._name, v._categories, True) for v, k in zip(key_vectors, keys, strict=True)
    ]
    made += [Vector.of(result, c, kind, True, n, None, True) for n, c, kind in columns]
    return Table.of(result, made)


def warn_verdicts(table) -> None:
    """One warning for each verdict output, naming up to eight groups without a value."""
    for name, hidden in table._frame.verdicts:
        empty = table._frame.df.filter(F.col(hidden) == 0).limit(8).collect()
        if empty:
            keys = [c._name for c in table._columns[:1]]
            warnings.warn(f"{name}: no values in {len(empty)} groups or more (by {keys})", EmptyReductionWarning, stacklevel=3)
