"""A group's rows as Python values, for callables that cannot be traced.

``LocalTable`` and ``LocalVector`` have the surface of ``Table`` and ``Vector``
that a callable over one group needs: selection, masks, comparison, logic,
arithmetic, reductions, ``stats``, ``math`` and the methods of the values.
"""

from __future__ import annotations

import datetime as dt
import math
import operator
import statistics

import pyarrow as pa

from colonnade.errors import ColumnIndexError, ColumnKeyError, ColumnTypeError, ColumnValueError


class LocalVector:
    __hash__ = None

    def __init__(self, values=()):
        self._values = list(values)

    def __len__(self):
        return len(self._values)

    def __iter__(self):
        return iter(self._values)

    def __bool__(self):
        raise ColumnTypeError("a vector has no truth value; use .all(), .any(), & and |")

    def to_list(self):
        return list(self)

    def __getitem__(self, key):
        if isinstance(key, (int, slice)) and not isinstance(key, bool):
            try:
                found = self._values[key]
            except IndexError:
                raise ColumnIndexError(f"position {key} of {len(self)}") from None
            return LocalVector(found) if isinstance(key, slice) else found
        return LocalVector(self._values[i] for i in _places(key, len(self)))

    def _pairs(self, other):
        if isinstance(other, (LocalVector, list, tuple)):
            if len(other) != len(self):
                raise ColumnValueError(f"lengths differ: {len(self)} and {len(other)}")
            return zip(self, other, strict=True)
        return ((v, other) for v in self)

    def _binary(self, fn, other, swap=False):
        return LocalVector(
            None if a is None or b is None else (fn(b, a) if swap else fn(a, b)) for a, b in self._pairs(other)
        )

    def _present(self):
        return [v for v in self if v is not None]

    def is_na(self):
        return LocalVector(v is None for v in self)

    def is_in(self, members):
        members = list(members)
        with_null = any(m is None for m in members)
        return LocalVector((True if with_null else None) if v is None else v in members for v in self)

    def fillna(self, value):
        return LocalVector(value if v is None else v for v in self)

    def dropna(self):
        return LocalVector(self._present())

    def unique(self):
        return LocalVector(dict.fromkeys(self))

    def sort_by(self, reverse=False, na_last=True):
        found = sorted(self._present(), reverse=reverse)
        gone = [None] * (len(self) - len(found))
        return LocalVector(found + gone if na_last else gone + found)

    def cast(self, goal):
        return LocalVector(None if v is None else goal(v) for v in self)

    def __and__(self, other):
        return LocalVector(_kleene_and(a, b) for a, b in self._pairs(other))

    def __or__(self, other):
        return LocalVector(_kleene_or(a, b) for a, b in self._pairs(other))

    def __xor__(self, other):
        return self._binary(operator.xor, other)

    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__

    def __invert__(self):
        return LocalVector(None if v is None else not v if isinstance(v, bool) else ~v for v in self)

    def __neg__(self):
        return LocalVector(None if v is None else -v for v in self)

    def __pos__(self):
        return LocalVector(self)

    def __abs__(self):
        return LocalVector(None if v is None else abs(v) for v in self)

    def __matmul__(self, other):
        pairs = list(self._pairs(other))
        if any(a is None or b is None for a, b in pairs):
            raise ColumnTypeError("null in a dot product")
        return sum(a * b for a, b in pairs)

    def sum(self):
        return sum(self._present())

    def count(self, *sub):
        return self._method("count", *sub) if sub else len(self._present())

    def min(self):
        return min(self._present(), default=None)

    def max(self):
        return max(self._present(), default=None)

    def mean(self):
        found = self._present()
        return math.fsum(found) / len(found) if found else None

    def stdev(self, population=False):
        found = self._present()
        if len(found) < 2:
            return None
        return (statistics.pstdev if population else statistics.stdev)(found)

    std = stdev

    def first(self):
        return self._values[0] if self._values else None

    def last(self):
        return self._values[-1] if self._values else None

    def all(self, on_empty=True):
        found = self._present()
        return all(found) if found else on_empty

    def any(self, on_empty=False):
        found = self._present()
        return any(found) if found else on_empty

    @property
    def stats(self):
        return _Functions(self, statistics)

    @property
    def math(self):
        return _Functions(self, math)

    def _method(self, name, *args, **kwargs):
        return LocalVector(None if v is None else getattr(v, name)(*args, **kwargs) for v in self)

    def __getattr__(self, name):
        found = self._present()
        if name.startswith("_") or found and not hasattr(found[0], name):
            raise AttributeError(name)
        if found and not callable(getattr(found[0], name)):
            return LocalVector(None if v is None else getattr(v, name) for v in self)
        return lambda *args, **kwargs: self._method(name, *args, **kwargs)


for _name in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow"):
    setattr(LocalVector, f"__{_name}__", lambda self, o, f=getattr(operator, _name): self._binary(_dated(f), o))
    setattr(LocalVector, f"__r{_name}__", lambda self, o, f=getattr(operator, _name): self._binary(_dated(f), o, True))
for _name in ("eq", "ne", "lt", "le", "gt", "ge"):
    setattr(LocalVector, f"__{_name}__", lambda self, o, f=getattr(operator, _name): self._binary(f, o))


def _dated(fn):
    """Dates meet whole days as ints."""

    def run(a, b):
        if isinstance(a, dt.date) and isinstance(b, int):
            b = dt.timedelta(days=b)
        out = fn(a, b)
        return out.days if isinstance(out, dt.timedelta) and type(a) is dt.date and type(b) is dt.date else out

    return run


def _kleene_and(a, b):
    if a is False or b is False:
        return False
    return None if a is None or b is None else a & b


def _kleene_or(a, b):
    if a is True or b is True:
        return True
    return None if a is None or b is None else a | b


class ColumnVector(LocalVector):
    """A group's column in Arrow's form: its values are made lot by lot, and kept only for access by position."""

    LOT = 1 << 14

    def __init__(self, column, mask=None):
        self._column, self._mask, self._kept = column, mask, None

    def _arrow(self):
        if self._mask is not None:
            self._column, self._mask = self._column.filter(self._mask), None
        return self._column

    @property
    def _values(self):
        if self._kept is None:
            self._kept = self._arrow().to_pylist()
        return self._kept

    def __len__(self):
        return len(self._arrow())

    def __iter__(self):
        return self._lots() if self._kept is None else iter(self._kept)

    def _lots(self):
        for chunk in self._arrow().chunks:
            for at in range(0, len(chunk), self.LOT):
                yield from chunk.slice(at, self.LOT).to_pylist()

    def __getitem__(self, key):
        chosen = key if isinstance(key, (int, slice)) else _chosen(key, len(self))
        return ColumnVector(self._arrow(), chosen) if isinstance(chosen, pa.Array) else super().__getitem__(chosen)

    def first(self):
        return self._arrow()[0].as_py() if len(self) else None

    def last(self):
        return self._arrow()[len(self) - 1].as_py() if len(self) else None


def _chosen(key, n):
    """A mask as an Arrow array, positions as a list."""
    if isinstance(key, pa.Array):
        return key
    key = list(key)
    if len(key) != n or not any(isinstance(k, bool) or k is None for k in key):
        return _places(key, n)
    return pa.array([bool(k) for k in key], pa.bool_())


def _places(key, n) -> list[int]:
    """Positions that a mask or a list of positions selects; a null in a mask selects nothing."""
    key = key.to_pylist() if isinstance(key, pa.Array) else list(key)
    if any(isinstance(k, bool) or k is None for k in key):
        if len(key) != n:
            raise ColumnValueError(f"lengths differ: {n} and {len(key)}")
        return [i for i, k in enumerate(key) if k]
    for k in key:
        if not -n <= k < n:
            raise ColumnIndexError(f"position {k} of {n}")
    return key


class _Functions:
    """``stats`` and ``math`` of a local vector: the standard library's, on the values present."""

    #: Of these the standard library takes all values at once, and fewer give no value.
    LEAST = {
        "mean": 1, "fmean": 1, "geometric_mean": 1, "harmonic_mean": 1, "median": 1, "median_low": 1, "median_high": 1,
        "mode": 1, "multimode": 0, "quantiles": 2, "pvariance": 1, "pstdev": 1, "variance": 2, "stdev": 2,
    }
    PAIRS = ("covariance", "correlation", "linear_regression")
    WHOLE = ("fsum", "prod", "gcd", "lcm")

    def __init__(self, vector, module):
        self._vector, self._module = vector, module

    def __getattr__(self, name):
        vector, module = self._vector, self._module
        fn = getattr(module, name, None)
        if fn is None or name.startswith("_"):
            raise AttributeError(name)
        if module is statistics:
            if name in self.PAIRS:
                return lambda other: self._paired(fn, other)
            if name in self.LEAST:

                def reduce(**kwargs):
                    found = vector._present()
                    return fn(found, **kwargs) if len(found) >= self.LEAST[name] else None

                return reduce
            raise AttributeError(name)
        if name in self.WHOLE:
            return lambda: fn(*vector._present()) if name in ("gcd", "lcm") else fn(vector._present())
        if name == "hypot":
            return lambda: math.hypot(*vector._present())
        if name == "dist":
            return lambda other: math.dist(*zip(*self._both(other))) if self._both(other) else 0.0

        def each(*operands, **kwargs):
            if operands and isinstance(operands[0], LocalVector):
                return vector._binary(fn, operands[0])
            return LocalVector(None if v is None else fn(v, *operands, **kwargs) for v in vector)

        return each

    def _both(self, other):
        return [(a, b) for a, b in self._vector._pairs(other) if a is not None and b is not None]

    def _paired(self, fn, other):
        pairs = self._both(other)
        if len(pairs) < 2:
            return None
        found = fn(*map(list, zip(*pairs)))
        return list(found) if isinstance(found, tuple) else found


class LocalTable:
    __hash__ = None

    def __init__(self, names, columns):
        self._names, self._columns = list(names), [c if isinstance(c, LocalVector) else LocalVector(c) for c in columns]

    def column_names(self):
        return list(self._names)

    def cols(self):
        return tuple(self._columns)

    def __getitem__(self, key):
        if isinstance(key, str):
            try:
                return self._columns[self._names.index(key)]
            except ValueError:
                raise ColumnKeyError(key) from None
        if isinstance(key, (tuple, list)) and key and all(isinstance(k, str) for k in key):
            return LocalTable(key, [self[k] for k in key])
        if isinstance(key, int) and not isinstance(key, bool):
            return tuple(c[key] for c in self._columns)
        key = key if isinstance(key, slice) else _chosen(key, len(self))
        return LocalTable(self._names, [c[key] for c in self._columns])

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        try:
            return self[name]
        except ColumnKeyError:
            raise AttributeError(name) from None

    def __len__(self):
        return len(self._columns[0]) if self._columns else 0

    def __iter__(self):
        return zip(*self._columns) if self._columns else iter(())

    @property
    def shape(self):
        return len(self), len(self._columns)

    def dropna(self):
        return self[[all(v is not None for v in row) for row in self] or slice(0)]

    def sort_by(self, by, reverse=False, na_last=True):
        keys = [by] if isinstance(by, (str, LocalVector)) else list(by)
        flags = list(reverse) if isinstance(reverse, (list, tuple)) else [reverse] * len(keys)
        order = list(range(len(self)))
        for key, down in reversed(list(zip(keys, flags, strict=True))):
            values = (key if isinstance(key, LocalVector) else self[key]).to_list()
            present = [i for i in order if values[i] is not None]
            gone = [i for i in order if values[i] is None]
            present.sort(key=values.__getitem__, reverse=down)
            order = present + gone if na_last else gone + present
        return LocalTable(self._names, [LocalVector(c._values[i] for i in order) for c in self._columns])
