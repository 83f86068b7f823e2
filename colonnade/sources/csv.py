"""CSV: all cells as text, kinds by rule from one aggregation over the file."""

from __future__ import annotations

import csv
import io

from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.errors import ColumnValueError
from colonnade.frame import Frame, fresh, session
from colonnade.vector import Vector

#: What reads as a number, and what makes a whole column text (a leading zero).
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"
IDENTIFIER = r"^[+-]?0[0-9]+$"


def _spans_lines(spark, path: str) -> bool:
    """Whether a quoted cell may hold a line end: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).filter(quotes % 2 == 1).limit(1).count())


def _of_object(source, delimiter: str, encoding: str):
    """(first row, DataFrame maker) of an open file's rows: the driver holds them already."""
    text = source.read()
    if isinstance(text, bytes):
        text = text.decode(encoding)
    lines = [r for r in csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""), delimiter=delimiter) if r]

    def rows(schema, skip):
        width = len(schema.fields)
        made = [tuple([*r, *[None] * (width - len(r))][:width]) for r in lines[skip:]]
        return session().createDataFrame(made, schema)

    return (lines[0] if lines else None), rows


def read_csv(path, *, delimiter: str = ",", has_header: bool = True, encoding: str = "utf-8-sig"):
    """A table from a path or from an open file (text or bytes); one job finds the kinds.

    Files are read in parallel pieces unless a quoted cell may hold a line end.

    Blank cells are null, cells are stripped, short rows end in nulls and long
    rows fail.  A column with an integer that begins with 0 is text as a whole;
    numbers beside text make an object column, kept as text.
    """
    from colonnade.table import Table

    spark = session()
    if hasattr(path, "read"):
        header, rows_of = _of_object(path, delimiter, encoding)
        if header is None:
            return Table()
    else:
        charset = "UTF-8" if encoding.lower().startswith("utf-8") else encoding
        # Only where bytes of quotes and line ends are those of ASCII can lines be looked at alone.
        plain = not charset.lower().startswith(("utf-16", "utf-32", "utf16", "utf32"))
        reader = spark.read.option("sep", delimiter).option("encoding", charset).option("escape", '"')
        reader = reader.option("multiLine", not plain or _spans_lines(spark, path))
        first = reader.option("header", False).option("inferSchema", False).csv(path).limit(1).collect()
        if not first:
            return Table()
        header = [c for c in first[0]]
    if has_header:
        names = [(c or "").strip().removeprefix("﻿") for c in header]
    else:
        names = [f"col_{i}" for i in range(len(header))]
    width = len(names)
    raw = [fresh("r") for _ in names]
    extra, order = fresh("x"), fresh("o")
    schema = T.StructType([T.StructField(r, T.StringType()) for r in [*raw, extra]])
    if hasattr(path, "read"):
        rows = rows_of(schema, int(has_header))
    else:
        rows = reader.option("header", has_header).option("enforceSchema", True).option("mode", "PERMISSIVE").schema(schema).csv(path)
    cells = [F.nullif(F.regexp_replace(F.col(r), r"^\s+|\s+$", ""), F.lit("")) for r in raw]
    flags = [F.max(F.col(extra).isNotNull()).alias("long")]
    for i, c in enumerate(cells):
        flags += [
            F.max(~c.rlike(NUMBER)).alias(f"text{i}"), F.max(c.rlike(IDENTIFIER)).alias(f"ident{i}"),
            F.max(c.rlike(NUMBER)).alias(f"number{i}"), F.max(c.rlike(NUMBER) & ~c.rlike(INTEGER)).alias(f"float{i}"),
            F.max(c.isNull()).alias(f"null{i}"), F.count(F.lit(1)).alias(f"n{i}"),
        ]
    found = rows.agg(*flags).first()
    if found["long"]:
        raise ColumnValueError(f"a row has more than {width} cells")
    physical, columns = [fresh() for _ in names], []
    for i, c in enumerate(cells):
        if found[f"ident{i}"]:
            kind, value = str, c
        elif found[f"text{i}"]:
            kind, value = (object if found[f"number{i}"] else str), c
        elif found[f"number{i}"]:
            kind = float if found[f"float{i}"] else int
            value = c.cast("double" if kind is float else "bigint")
        else:
            kind, value = object, c
        columns.append((value.alias(physical[i]), kind, bool(found[f"null{i}"]) or not found[f"n{i}"]))
    frame = Frame(rows.select(*[c for c, _, _ in columns], F.monotonically_increasing_id().alias(order)), [(order, True, True)])
    return Table.of(frame, [Vector.of(frame, F.col(p), k, null, n, None, True) for p, (_, k, null), n in zip(physical, columns, names, strict=True)])
