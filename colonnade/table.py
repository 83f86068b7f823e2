"""Tables: columns of one frame."""

from __future__ import annotations

import warnings
from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade import kinds
from colonnade.errors import ColumnIndexError, ColumnKeyError, ColumnTypeError, ColumnValueError
from colonnade.frame import Frame, aligned, fresh
from colonnade.naming import accessors, unique_names
from colonnade.operators import elementwise as E
from colonnade.operators import grouping, joins, mutation
from colonnade.operators import reductions as R
from colonnade.vector import Vector, memory_frame


class Table:
    _batch = None

    def __init__(self, initial=(), dtype=None, name=None):
        self._table_name = name
        if isinstance(initial, DataFrame):
            from colonnade.sources.parquet import wrap

            made = wrap(initial)
            self._frame, self._columns = made._frame, made._columns
            return
        if isinstance(initial, dict):
            names, columns = list(initial), list(initial.values())
        else:
            columns = list(initial)
            names = [c._name if isinstance(c, Vector) else None for c in columns]
            if columns and not any(isinstance(c, Vector) for c in columns):
                if len({len(r) for r in columns}) == 1:  # rows
                    columns = [list(c) for c in zip(*columns)]
                names = [None] * len(columns)
        if any(isinstance(c, Table) for c in columns):
            raise ColumnTypeError("tables do not nest")
        if columns and all(isinstance(c, Vector) for c in columns):
            made = Table.of(columns[0]._frame, [])
            for n, c in zip(names, columns, strict=True):
                made = made._appended(n, c)
            self._frame, self._columns = made._frame, made._columns
            return
        columns = [c.to_list() if isinstance(c, Vector) else list(c) for c in columns]
        if len({len(c) for c in columns}) > 1:
            raise ColumnValueError("columns differ in length")
        found = [kinds.infer(c) for c in columns]
        self._frame, physical = memory_frame(columns, [k for k, _ in found])
        self._columns = [
            Vector.of(self._frame, F.col(p), k, null, n, None, True) for p, (k, null), n in zip(physical, found, names, strict=True)
        ]

    @classmethod
    def of(cls, frame: Frame, columns, name=None) -> Table:
        self = object.__new__(Table)
        self._frame, self._table_name = frame, name
        self._columns = [
            c if c._owned and c._frame is frame else Vector.of(frame, c._col, c._kind, c._nullable, c._name, c._categories, True)
            for c in columns
        ]
        return self

    @classmethod
    def from_parquet(cls, path):
        from colonnade.sources.parquet import read_parquet

        return read_parquet(path)

    @classmethod
    def filled(cls, *args, **kwargs):
        raise ColumnTypeError("filled is for vectors")

    def to_parquet(self, path):
        from colonnade.sources.parquet import write_parquet

        write_parquet(self, path)

    # Metadata ---------------------------------------------------------------

    table_name = property(lambda self: self._table_name, lambda self, n: setattr(self, "_table_name", n))

    def column_names(self):
        return [c._name for c in self._columns]

    @property
    def shape(self):
        return len(self), len(self._columns)

    def __len__(self):
        return self._frame.count()

    __hash__ = None

    def __bool__(self):
        raise ColumnTypeError("a table has no truth value")

    def copy(self):
        return Table.of(self._frame, self._columns, self._table_name)

    @property
    def _(self):
        from colonnade.display import schema_text

        return schema_text(self)

    def _accessors(self):
        return accessors(self.column_names(), _RESERVED)

    def _position(self, key):
        names = self.column_names()
        if isinstance(key, int) and not isinstance(key, bool):
            if not -len(names) <= key < len(names):
                raise ColumnKeyError(f"column {key} of {len(names)}")
            return key % len(names)
        if key in names:
            return names.index(key)
        spelled = self._accessors()
        if key in spelled:
            return spelled[key]
        raise ColumnKeyError(f"no column {key!r}")

    def cols(self, key=slice(None)):
        if isinstance(key, slice):
            return tuple(self._columns[key])
        return self._columns[self._position(key)]

    def _keys(self, spec) -> list[Vector]:
        if isinstance(spec, (str, Vector)):
            spec = [spec]
        out = []
        for k in spec:
            if isinstance(k, Vector):
                if k._frame is not self._frame:
                    raise ColumnValueError("the key is no column of this table")
                out.append(k)
            else:
                out.append(self._columns[self._position(k)])
        if not out:
            raise ColumnValueError("no keys")
        return out

    # Selection --------------------------------------------------------------

    def __getattr__(self, name):
        if name.startswith("__") or name in ("_frame", "_columns"):
            raise AttributeError(name)
        try:
            return self._columns[self._position(name)]
        except ColumnKeyError:
            raise AttributeError(f"no column {name!r}") from None

    def __setattr__(self, name, value):
        if name.startswith("_") or name in ("table_name",):
            object.__setattr__(self, name, value)
            return
        try:
            k = self._position(name)
        except ColumnKeyError:
            raise AttributeError(f"no column {name!r}") from None
        v = value if isinstance(value, Vector) else Vector(list(value))
        self._replace(k, v)

    def _replace(self, k, v):
        """Column k gets v's values and keeps its name."""
        name, old = self._columns[k]._name, self._frame
        if v._frame is not old:
            self._frame = v._frame if _extends(v._frame, old) else aligned(old, v._frame)
        columns = list(self._columns)
        columns[k] = Vector.of(self._frame, v._col, v._kind, v._nullable, name, v._categories, True)
        self._columns = [Vector.of(self._frame, c._col, c._kind, c._nullable, c._name, c._categories, True) for c in columns]

    def __getitem__(self, key):
        if isinstance(key, str):
            return self._columns[self._position(key)]
        if isinstance(key, tuple) and len(key) == 2 and not all(isinstance(k, str) for k in key):
            rows, cols = (key[1], key[0]) if _is_columns(key[0]) and not _is_columns(key[1]) else key
            picked = self._pick(cols)
            if isinstance(rows, int) and not isinstance(rows, bool):
                if isinstance(picked, Vector):
                    return picked[rows]
                return picked[rows]
            out = self[rows]
            return out._pick(cols)
        if isinstance(key, tuple) and len(key) > 2 and not all(isinstance(k, str) for k in key):
            raise ColumnKeyError("two axes at most")
        if isinstance(key, (tuple, list)) and key and all(isinstance(k, str) for k in key):
            return self._pick(list(key))
        if isinstance(key, int) and not isinstance(key, bool):
            return self._row(key)
        if isinstance(key, slice):
            return self._slice(key)
        if isinstance(key, Vector):
            if key._kind is bool:
                return self._filter(key)
            if key._kind is int:
                if key._nullable and key._frame.df.filter(key._col.isNull()).limit(1).count():
                    raise ColumnTypeError("nullable positions")
                return self._take(key)
            raise ColumnTypeError(f"no rows by {key._kind.__name__}")
        if isinstance(key, list):
            if all(isinstance(k, bool) for k in key) and key:
                return self._filter(Vector(key))
            return self._take(Vector(key, int) if key else Vector([], int))
        raise ColumnKeyError(f"unsupported selection {key!r}")

    def _pick(self, cols):
        if isinstance(cols, (str, int)):
            return self._columns[self._position(cols)]
        if isinstance(cols, slice):
            return Table.of(self._frame, self._columns[cols])
        return Table.of(self._frame, [self._columns[self._position(c)] for c in cols])

    def projected(self, df_of, order=None, rows=None, name=None, positional=False) -> Table:
        """A new frame: ``df_of`` the frame's DataFrame with this table's columns under new physical names.

        ``positional``: ``df_of`` needs the order of the rows.
        """
        names = [fresh() for _ in self._columns]
        keep = [c for c, _, _ in self._frame.order]
        renamed = {c: fresh("o") for c in keep}
        df = self._frame.df
        plain = df_of(df).select(
            *[c._col.alias(n) for c, n in zip(self._columns, names, strict=True)], *[F.col(a).alias(b) for a, b in renamed.items()]
        )
        frame = Frame(plain, order or [(renamed[c], up, last) for c, up, last in self._frame.order], rows)
        if self._frame.plain is not None and not positional:
            frame.plain = df_of(self._frame.plain).select(*[c._col.alias(n) for c, n in zip(self._columns, names, strict=True)])
        made = [Vector.of(frame, F.col(n), c._kind, c._nullable, c._name, c._categories, True) for c, n in zip(self._columns, names, strict=True)]
        return Table.of(frame, made, name)

    def _filter(self, mask: Vector) -> Table:
        view, col = self, mask._col
        if mask._frame is not self._frame:
            if _extends(mask._frame, self._frame):
                view = Table.of(mask._frame, self._columns)
            else:
                view = Table.of(aligned(self._frame, mask._frame), self._columns)
        return view.projected(lambda df: df.filter(col))

    def _slice(self, s: slice) -> Table:
        start, stop, step = s.start, s.stop, s.step
        simple = step in (None, 1) and all(x is None or x >= 0 for x in (start, stop))
        if simple and stop is not None:
            lo = start or 0
            return self._through(lambda df: _limited(Frame(df, self._frame.order).sorted(), lo, max(stop - lo, 0)), self._table_name)
        r = range(len(self))[s]
        place = self._frame.numbered()
        c = F.col(place)
        if not len(r):
            return self._through(lambda df: df.filter(F.lit(False)), self._table_name)
        low, high = min(r[0], r[-1]), max(r[0], r[-1])
        inside = (c >= low) & (c <= high) & ((c - low) % abs(r.step) == 0)
        out = self.projected(lambda df: df.filter(inside), rows=len(r), name=self._table_name, positional=True)
        if r.step < 0:
            out._frame.order = [(out._frame.order[0][0], False, True)]
        return out

    def _through(self, df_of, name=None) -> Table:
        return self.projected(df_of, name=name, positional=True)

    def _row(self, i):
        from colonnade.display import RowView

        return RowView(self, i)

    def _take(self, positions: Vector) -> Table:
        n = len(self)
        place = self._frame.numbered()
        index, at = fresh("p"), fresh("o")
        wanted = positions._frame.df.select(positions._col.alias(index), positions._frame.rank().alias(at))
        stray = wanted.filter((F.col(index) >= n) | (F.col(index) < -n)).first()
        if stray:
            raise ColumnIndexError(f"position {stray[0]} of {n}")
        wanted = wanted.withColumn(index, F.when(F.col(index) < 0, F.col(index) + n).otherwise(F.col(index)))
        df = self._frame.df.join(wanted, F.col(place) == F.col(index))
        view = Table.of(Frame(df, [(at, True, True)], positions._frame.rows), self._columns)
        return view.projected(lambda d: d)

    def __iter__(self):
        from colonnade.display import Row

        names = self.column_names()
        for r in self._ordered_values().toLocalIterator():
            yield Row(names, list(r))

    def _ordered_values(self):
        names = [fresh("x") for _ in self._columns]
        order = [c for c, _, _ in self._frame.order]
        df = self._frame.df.select(*[c.value_column.alias(n) for c, n in zip(self._columns, names, strict=True)], *order)
        return Frame(df, self._frame.order).sorted().select(*names)

    def to_dict(self) -> dict:
        names = [n if n is not None else f"col{i}_" for i, n in enumerate(self.column_names())]
        if len(set(names)) != len(names):
            raise ColumnValueError("column names repeat")
        grouping.warn_verdicts(self)
        rows = self._ordered_values().collect()
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    def to_spark(self) -> DataFrame:
        """The columns as a DataFrame under their names (unnamed: col{i}_); rows in no promised order."""
        names = unique_names([n if n is not None else f"col{i}_" for i, n in enumerate(self.column_names())])
        return self._frame.bare.select(*[c.value_column.alias(n) for c, n in zip(self._columns, names, strict=True)])

    @property
    def T(self):
        """Rows as columns; for small tables."""
        rows = [list(r) for r in self]
        return Table([Vector(r) for r in rows]) if rows else Table()

    # Columns ----------------------------------------------------------------

    def _appended(self, name, v) -> Table:
        if isinstance(v, Table):
            out = self
            for c in v._columns:
                out = out._appended(c._name, c)
            return out
        if not isinstance(v, Vector):
            if isinstance(v, (str, bytes)) or not hasattr(v, "__iter__"):
                raise ColumnTypeError("a column is made of values, not of one scalar")
            v = Vector(list(v))
        if name is not None and name in self.column_names():
            warnings.warn(f"column {name!r} stands twice", stacklevel=3)
        frame = self._frame
        if not self._columns:
            frame = v._frame
        elif v._frame is not frame:
            frame = v._frame if _extends(v._frame, frame) else aligned(frame, v._frame)
        return Table.of(frame, [*self._columns, Vector.of(frame, v._col, v._kind, v._nullable, name, v._categories, True)], self._table_name)

    def __rshift__(self, other) -> Table:
        if isinstance(other, dict):
            out = self
            for n, v in other.items():
                out = out._appended(n, v)
            return out
        return self._appended(getattr(other, "_name", None), other)

    def drop(self, *names) -> Table:
        for n in names:
            if n not in self.column_names():
                raise ColumnKeyError(f"no column {n!r}")
        return Table.of(self._frame, [c for c in self._columns if c._name not in names], self._table_name)

    def rename_columns(self, mapping) -> Table:
        names = self.column_names()
        new = list(names)
        for old, to in mapping.items():
            if isinstance(old, bool):
                raise ColumnKeyError("a bool names no column")
            if isinstance(old, int):
                new[self._position(old)] = to
            elif names.count(old) != 1:
                raise ColumnKeyError(f"{old!r} names {names.count(old)} columns")
            else:
                new[names.index(old)] = to
        made = [Vector.of(self._frame, c._col, c._kind, c._nullable, n, c._categories, True) for c, n in zip(self._columns, new, strict=True)]
        return Table.of(self._frame, made, self._table_name)

    # Lifted element-wise operators -------------------------------------------

    def _lifted(self, fn) -> Table:
        made = []
        for c in self._columns:
            v = fn(c)
            made.append(Vector.of(v._frame, v._col, v._kind, v._nullable, c._name, v._categories, True))
        return _joined_columns(made)

    def _lift(self, op, other, keep_left) -> Table:
        if not isinstance(other, Table):
            return self._lifted(lambda c: op(c, other))
        if len(other._columns) != len(self._columns):
            raise ColumnValueError("tables differ in width")
        made, mismatch = [], False
        for a, b in zip(self._columns, other._columns, strict=True):
            v = op(a, b)
            name = a._name if keep_left or a._name == b._name else None
            mismatch |= name is None and a._name is not None
            made.append(Vector.of(v._frame, v._col, v._kind, v._nullable, name, v._categories, True))
        if mismatch:
            warnings.warn("column names differ and are dropped", stacklevel=3)
        return _joined_columns(made)

    def __invert__(self):
        return self._lifted(lambda c: ~c)

    def __neg__(self):
        return self._lifted(lambda c: -c)

    def __pos__(self):
        return self._lifted(lambda c: +c)

    def __abs__(self):
        return self._lifted(abs)

    def cast(self, goal):
        return self._lifted(lambda c: c.cast(goal))

    def to_object(self):
        return self._lifted(lambda c: c.to_object())

    def fillna(self, value):
        return self._lifted(lambda c: c.fillna(value))

    def is_na(self):
        return self._lifted(lambda c: c.is_na())

    def is_in(self, members):
        return self._lifted(lambda c: c.is_in(members))

    def is_type(self, types):
        return self._lifted(lambda c: c.is_type(types))

    def bit_lshift(self, n):
        return self._lifted(lambda c: c.bit_lshift(n))

    def bit_rshift(self, n):
        return self._lifted(lambda c: c.bit_rshift(n))

    def coalesce(self, *tables):
        out = self
        for t in tables:
            if len(t._columns) != len(self._columns):
                raise ColumnValueError("tables differ in shape")
            out = out._lift(lambda a, b: a.coalesce(b), t, True)
        return out

    def __matmul__(self, other):
        """Linear combination of the columns (vector), or one for each column of a table."""
        if isinstance(other, Table):
            made = [(self @ c).alias(c._name) for c in other._columns]
            return _joined_columns(made)
        weights = other.to_list() if isinstance(other, Vector) else list(other)
        if len(weights) != len(self._columns):
            raise ColumnValueError("as many weights as columns")
        return fold(lambda a, b: a + b, [c * w for c, w in zip(self._columns, weights, strict=True)])

    def _dots(self, v: Vector):
        return Vector([v @ c for c in self._columns])

    # Rows -------------------------------------------------------------------

    def dropna(self) -> Table:
        if not self._columns:
            return self
        present = fold(lambda a, b: a & b, [c._col.isNotNull() for c in self._columns])
        out = self.projected(lambda df: df.filter(present))
        for c in out._columns:
            c._nullable = False
        return out

    def unique(self) -> Table:
        """The first of each distinct row, in order: one aggregation."""
        rank = self._frame.rank()
        names, order = [fresh() for _ in self._columns], fresh("o")
        rows = self._frame.df.select(*[c._col.alias(n) for c, n in zip(self._columns, names, strict=True)], rank.alias(order))
        df = rows.groupBy(*names).agg(F.min(order).alias(order))
        frame = Frame(df, [(order, True, True)])
        if self._frame.plain is not None:
            frame.plain = self._frame.plain.select(*[c._col.alias(n) for c, n in zip(self._columns, names, strict=True)]).distinct()
        made = [Vector.of(frame, F.col(n), c._kind, c._nullable, c._name, c._categories, True) for c, n in zip(self._columns, names, strict=True)]
        return Table.of(frame, made)

    def __lshift__(self, other) -> Table:
        """Rows of both, columns paired by position."""
        if isinstance(other, (list, tuple)):
            other = Table(list(other))
        if len(other._columns) != len(self._columns):
            raise ColumnValueError("tables differ in width")
        names, goals, sides = [fresh() for _ in self._columns], [], []
        for a, b in zip(self._columns, other._columns, strict=True):
            goals.append(kinds.promote(a._kind, b._kind) or object)
        domains = [a._categories if a._categories == b._categories else None for a, b in zip(self._columns, other._columns, strict=True)]
        order, plain = [fresh("o"), fresh("o")], []
        for side, t in enumerate((self, other)):
            cols = []
            for c, n, goal, domain in zip(t._columns, names, goals, domains, strict=True):
                col = c._col if domain is not None else E.typed(c.value_column, c._kind, goal)
                cols.append(col.alias(n))
            place = t._frame.rank() if len(t._frame.order) == 1 and t._frame.order[0][1] else F.monotonically_increasing_id()
            sides.append(t._frame.sorted().select(*cols, F.lit(side).alias(order[0]), place.cast("long").alias(order[1])))
            plain.append(t._frame.bare.select(*cols))
        frame = Frame(sides[0].unionAll(sides[1]), [(o, True, True) for o in order], plain=plain[0].unionAll(plain[1]))
        made = [
            Vector.of(frame, F.col(n), g, a._nullable or b._nullable, a._name, d, True)
            for n, g, a, b, d in zip(names, goals, self._columns, other._columns, domains, strict=True)
        ]
        return Table.of(frame, made, self._table_name)

    def sort_by(self, by, reverse=False, na_last=True) -> Table:
        """Stable; ``reverse`` for all keys or one for each; nulls last or first whatever the direction.

        Categoricals sort by their labels (a vector of its own: by the order of its categories).
        """
        return self._sorted_by([(k, k.value_column) for k in self._keys(by)], reverse, na_last)

    def _sorted_by(self, keys, reverse, na_last) -> Table:
        flags = list(reverse) if isinstance(reverse, (list, tuple)) else [reverse] * len(keys)
        if len(flags) != len(keys):
            raise ColumnValueError("as many directions as keys")
        names = [fresh("s") for _ in keys]
        view = Table.of(
            Frame(self._frame.df.select("*", *[c.alias(n) for (_, c), n in zip(keys, names, strict=True)]), self._frame.order, self._frame.rows, plain=self._frame.plain),
            self._columns,
        )
        order = [(n, not f, na_last) for n, f in zip(names, flags, strict=True)] + list(self._frame.order)
        view._frame.order = order
        return view.projected(lambda df: df, rows=self._frame.rows, name=self._table_name)

    # Joins, groups ----------------------------------------------------------

    def inner_join(self, other, left_on, right_on, expect_left_unique=False, expect_right_unique=True, validate="eager"):
        return joins.join("inner", self, other, left_on, right_on, expect_left_unique, expect_right_unique, validate)

    def left_join(self, other, left_on, right_on, expect_left_unique=False, expect_right_unique=True, validate="eager"):
        return joins.join("left", self, other, left_on, right_on, expect_left_unique, expect_right_unique, validate)

    def full_join(self, other, left_on, right_on, expect_left_unique=False, expect_right_unique=False, validate="eager"):
        return joins.join("full", self, other, left_on, right_on, expect_left_unique, expect_right_unique, validate)

    def aggregate(self, groupby=None, aggregations=None, returns=None) -> Table:
        return grouping.aggregate(self, groupby, aggregations, returns)

    def window(self, groupby, aggregations=None, returns=None) -> Table:
        return grouping.window(self, groupby, aggregations, returns)

    # Mutation ---------------------------------------------------------------

    def __setitem__(self, key, value):
        if isinstance(key, str):
            self.__setattr__(key, value)
            return
        if not isinstance(key, tuple) or len(key) != 2:
            key = (key, slice(None))
        rows, cols = key
        picked = [self._position(cols)] if isinstance(cols, (str, int)) else (
            list(range(len(self._columns)))[cols] if isinstance(cols, slice) else [self._position(c) for c in cols]
        )
        if isinstance(value, Table):
            values = list(value._columns)
        elif isinstance(value, (list, tuple)) and len(picked) > 1:
            values = list(value)
        else:
            values = [value] * len(picked)
        if len(values) != len(picked):
            raise ColumnValueError(f"{len(values)} values for {len(picked)} columns")
        # All columns are made before any is put in place.
        staged, work = [], self.copy()
        for k, v in zip(picked, values, strict=True):
            new = mutation.assigned(work._columns[k], rows, v)
            staged.append((k, new))
            work._replace(k, new)
        self._frame, self._columns = work._frame, work._columns

    def batch(self):
        return mutation.Batch(self)

    def __repr__(self):
        from colonnade.display import table_text

        return table_text(self)


def _limited(df, lo, n):
    return df.offset(lo).limit(n) if lo else df.limit(n)


def _is_columns(key):
    return isinstance(key, str) or isinstance(key, (list, tuple)) and bool(key) and all(isinstance(k, str) for k in key)


def _extends(frame: Frame, base: Frame) -> bool:
    """The frame keeps all columns and rows of ``base`` (a flag, an alignment or an edit joined on)."""
    return set(base.df.columns) <= set(frame.df.columns)


def _joined_columns(columns) -> Table:
    frame = columns[0]._frame
    for c in columns[1:]:
        if c._frame is not frame and not _extends(frame, c._frame):
            frame = c._frame if _extends(c._frame, frame) else aligned(frame, c._frame)
    return Table.of(frame, [Vector.of(frame, c._col, c._kind, c._nullable, c._name, c._categories, True) for c in columns])


def _pointwise(name, op, keep_left):
    def method(self, other):
        return self._lift(op, other, keep_left)

    setattr(Table, name, method)


import operator as _op  # noqa: E402

for _n in ("eq", "ne", "lt", "le", "gt", "ge"):
    _pointwise(f"__{_n}__", getattr(_op, _n), True)
for _n in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow"):
    _pointwise(f"__{_n}__", getattr(_op, _n), False)
    setattr(Table, f"__r{_n}__", lambda self, o, f=getattr(_op, _n): self._lifted(lambda c: f(o, c)))
for _n in ("and", "or", "xor"):
    _pointwise(f"__{_n}__", getattr(_op, f"__{_n}__"), False)


def _block(name):
    def method(self, *args, **kwargs):
        return Vector([getattr(c, name)(*args, **kwargs) for c in self._columns])

    method.__name__ = name
    setattr(Table, name, method)


for _n in R.BASIC:
    _block(_n)

_RESERVED = frozenset(n for n in dir(Table) if not n.startswith("_"))
