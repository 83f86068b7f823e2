"""Assignment as new expressions: the frame's data stays as it is."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade import kinds
from colonnade.errors import ColumnIndexError, ColumnTypeError, ColumnValueError
from colonnade.frame import Frame, fresh


def positions_of(key, n: int):
    """Positions that an int, slice or list of ints names; None for a mask."""
    if isinstance(key, bool):
        raise ColumnTypeError("a bool is no position")
    if isinstance(key, int):
        if not -n <= key < n:
            raise ColumnIndexError(f"position {key} of {n}")
        return [key % n]
    if isinstance(key, slice):
        return range(n)[key]
    if isinstance(key, (list, tuple, range)):
        if key and all(isinstance(k, bool) for k in key):
            if len(key) != n:
                raise ColumnValueError("mask length differs")
            return [i for i, k in enumerate(key) if k]
        return [positions_of(k, n)[0] for k in key]
    return None


def assigned(vector, key, value):
    """``vector`` with ``value`` at ``key``: positions, a slice, or a mask (null assigns nothing)."""
    from colonnade.vector import Vector

    cats = vector._categories

    def coded(x):
        if cats is None or x is None:
            return x
        if x not in cats:
            raise ColumnValueError(f"{x!r} is no category")
        return cats.index(x)

    if isinstance(key, Vector) and key._kind is bool:
        frame, (mask, _), _ = vector._operand(key)
        return _masked(vector, frame, mask, value, coded)
    if isinstance(key, Vector):
        if key._nullable:
            raise ColumnTypeError("nullable positions")
        key = key.to_list()
    n = len(vector)
    places = positions_of(key, n)
    if places is None:
        raise ColumnTypeError(f"unsupported position {key!r}")
    values = value.to_list() if isinstance(value, Vector) else value
    if not isinstance(values, (list, tuple, range)):
        values = [values] * len(places)
    if len(values) != len(places):
        raise ColumnValueError(f"{len(values)} values for {len(places)} places")
    return write_points(vector, dict(zip(places, map(coded, values), strict=True)))


def _masked(vector, frame, mask, value, coded):
    from colonnade.vector import Vector

    if isinstance(value, (list, tuple, Vector)):
        places = [i for i, m in enumerate(Vector.of(frame, mask, bool).to_list()) if m]
        values = value.to_list() if isinstance(value, Vector) else list(value)
        if len(values) == len(places):
            return write_points(vector, dict(zip(places, map(coded, values), strict=True)))
        raise ColumnValueError(f"{len(values)} values for {len(places)} places")
    kind, value = (vector._kind, coded(value)) if vector._categories is not None else _target(vector, [value])
    goal = "int" if vector._categories is not None else kinds.spark_type(kind)
    new = F.when(mask, F.lit(kinds.convert(value, kind) if vector._categories is None else value).cast(goal)).otherwise(vector._col.cast(goal))
    return Vector.of(frame, new, kind, vector._nullable or value is None, vector._name, vector._categories)


def _target(vector, values):
    kind = vector._kind
    for v in values:
        if v is not None:
            wider = kinds.promote(kind, type(v))
            if wider is None:
                raise ColumnTypeError(f"{v!r} is no {kind.__name__}")
            kind = wider
    return kind, values[0] if len(values) == 1 else None


def write_points(vector, points: dict[int, object]):
    """Edits by position, as one join with a small frame of edits."""
    from colonnade.frame import session
    from colonnade.vector import Vector

    if not points:
        return vector.copy()
    cats = vector._categories
    kind = vector._kind if cats is not None else _target(vector, list(points.values()))[0]
    goal = "int" if cats is not None else kinds.spark_type(kind)
    at, new = fresh("p"), fresh()
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(at, T.LongType()), T.StructField(new, T.IntegerType() if cats is not None else goal)])
    rows = [(p, v if cats is not None else kinds.convert(v, kind)) for p, v in points.items()]
    edits = session().createDataFrame(rows, schema).withColumn(hit := fresh("h"), F.lit(True))
    frame = vector._frame
    place = frame.numbered()
    df = frame.df.join(edits, F.col(place) == F.col(at), "left")
    col = F.when(F.col(hit), F.col(new)).otherwise(vector._col.cast(goal))
    nullable = vector._nullable or any(v is None for v in points.values())
    return Vector.of(Frame(df, list(frame.order), frame.rows, dense=place), col, kind, nullable, vector._name, cats)


class Batch:
    """Point writes gathered on the driver and applied once at the end of the scope; no rollback, no nesting."""

    def __init__(self, table):
        self.table, self.points = table, {}

    def __enter__(self):
        if self.table._batch is not None:
            raise ColumnTypeError("batches do not nest")
        self.table._batch = self
        return self

    def __setitem__(self, key, value):
        row, name = key
        position = positions_of(row, len(self.table))[0]
        self.points.setdefault(self.table._position(name), {})[position] = value

    def __exit__(self, *error):
        self.table._batch = None
        for k, points in self.points.items():
            self.table._replace(k, write_points(self.table._columns[k], points))
