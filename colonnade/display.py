"""Rows, and what tables and vectors print."""

from __future__ import annotations


from colonnade.errors import ColumnIndexError
from colonnade.frame import Frame

_settings = {"rows": 12, "columns": 10}


def set_repr_rows(n: int) -> None:
    _settings["rows"] = n


def kind_text(v) -> str:
    base = f"category({len(v._categories)})" if v._categories is not None else getattr(v._kind, "__name__", str(v._kind))
    return base + ("?" if v._nullable else "")


class Row:
    """One row's values, by position or column name."""

    def __init__(self, names, values):
        self._names, self._values = names, values

    def __getitem__(self, key):
        return self._values[self._names.index(key)] if isinstance(key, str) else self._values[key]

    def __getattr__(self, name):
        if name.startswith("_") or name not in self._names:
            raise AttributeError(name)
        return self[name]

    def __iter__(self):
        return iter(self._values)

    def __len__(self):
        return len(self._values)

    def __eq__(self, other):
        return list(self._values) == list(other)

    __hash__ = None

    def __repr__(self):
        return f"Row({', '.join(f'{n}={v!r}' for n, v in zip(self._names, self._values, strict=True))})"


class RowView(Row):
    """A row that is read when a cell is asked for; an absent position fails then."""

    def __init__(self, table, i):
        self._table, self._i = table, i
        self._names = table.column_names()

    def __getattr__(self, name):
        if name == "_values":
            n = len(self._table)
            if not -n <= self._i < n:
                raise ColumnIndexError(f"position {self._i} of {n}")
            self._values = list(self._table._ordered_values().offset(self._i % n).limit(1).first())
            return self._values
        return super().__getattr__(name)


def schema_text(table) -> str:
    """Accessor, kind and name of each column; no job."""
    spelled = {i: a for a, i in table._accessors().items()}
    return "\n".join(f"{spelled[i]}: {kind_text(c)}  {c._name!r}" for i, c in enumerate(table._columns))


def _cells(frame: Frame, cols, n: int, half: int) -> tuple[list, bool]:
    if n <= _settings["rows"]:
        return [list(r) for r in Frame(frame.df, frame.order).sorted().select(*cols).collect()], False
    order = [(c, not up, not last) for c, up, last in frame.order]
    head = Frame(frame.df, frame.order).sorted().limit(half).select(*cols).collect()
    tail = Frame(frame.df, order).sorted().limit(half).select(*cols).collect()[::-1]
    return [list(r) for r in [*head, *tail]], True


def table_text(table) -> str:
    if not table._columns:
        return "Table 0 x 0"
    n = len(table)
    shown = table._columns if len(table._columns) <= _settings["columns"] else [*table._columns[:5], *table._columns[-5:]]
    half = _settings["rows"] // 2
    rows, cut = _cells(table._frame, [c.value_column.alias(f"c{i}") for i, c in enumerate(shown)], n, half)
    lines = [[str(c._name) for c in shown], [f"<{kind_text(c)}>" for c in shown], *[[repr(x) for x in r] for r in rows]]
    if cut:
        lines.insert(2 + half, ["..."] * len(shown))
    widths = [max(len(line[i]) for line in lines) for i in range(len(shown))]
    body = "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in lines)
    return f"{body}\n\n{n} x {len(table._columns)} table <{', '.join(dict.fromkeys(kind_text(c) for c in table._columns))}>"


def vector_text(vector) -> str:
    n = len(vector)
    half = _settings["rows"] // 2
    rows, cut = _cells(vector._frame, [vector.value_column.alias("v")], n, half)
    cells = [repr(r[0]) for r in rows]
    if cut:
        cells.insert(half, "...")
    return "\n".join([*([str(vector._name)] if vector._name else []), *cells, f"\n{n} element vector <{kind_text(vector)}>"])


__all__ = ["Row", "RowView", "kind_text", "schema_text", "set_repr_rows", "table_text", "vector_text"]
