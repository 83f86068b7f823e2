"""Parquet: lazy reads through Spark's scan, whole-file writes that replace the target at the end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import kinds
from colonnade.errors import ColumnTypeError
from colonnade.frame import Frame, fresh, session
from colonnade.vector import Vector

#: Up to so many files get a numeric row order: file number and row number in one long.
NUMBERED_FILES = 256
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _gate(schema: T.StructType, nested: bool) -> None:
    for field in schema:
        if isinstance(field.dataType, _NESTED) and not nested:
            raise ColumnTypeError(f"{field.name}: nested columns are refused; pass nested=True to keep them")


def _refuse_unsigned(spark, files: list[str], schema: T.StructType) -> None:
    """Spark reads unsigned 64-bit numbers as decimal(20, 0); only a footer tells them from decimals."""
    if not files or not any(f.dataType == T.DecimalType(20, 0) for f in schema):
        return
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(files[0]), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        lines = reader.getFooter().getFileMetaData().getSchema().toString().splitlines()
    finally:
        reader.close()
    bad = [line.split()[2] for line in lines if "INTEGER(64,false)" in line]
    if bad:
        raise ColumnTypeError(f"{bad[0]}: unsigned 64-bit columns are refused")


def read_parquet(path: str, nested: bool = False):
    """A table over the files; no job runs. Widens to int64, float64 and naive timestamps."""
    spark = session()
    df = spark.read.parquet(path)
    _gate(df.schema, nested)
    files = sorted(df.inputFiles())
    _refuse_unsigned(spark, files, df.schema)
    row = F.col("_metadata.row_index")
    if len(files) == 1:
        return _table(df, row, True)
    if not files:
        order = row
    elif len(files) <= NUMBERED_FILES:
        numbers = F.create_map(*[x for k, f in enumerate(files) for x in (F.lit(f.rsplit("/", 1)[-1]), F.lit(k).cast("long"))])
        order = F.call_function("shiftleft", numbers[F.col("_metadata.file_name")], F.lit(40)) + row
        if len({f.rsplit("/", 1)[-1] for f in files}) < len(files):
            order = F.struct("_metadata.file_path", "_metadata.row_index")
    else:
        order = F.struct("_metadata.file_path", "_metadata.row_index")
    return _table(df, order)


def wrap(df: DataFrame):
    """A table over any DataFrame, in the order in which Spark hands its rows out."""
    return _table(df, F.monotonically_increasing_id())


def _table(df: DataFrame, order, dense: bool = False):
    from colonnade.table import Table

    position = fresh("o")
    names, columns, cols = [], [], []
    for field in df.schema:
        kind, goal = kinds.kind_of(field.dataType)
        name = fresh()
        c = F.col(f"`{field.name}`")
        cols.append((c if goal == field.dataType else c.cast(goal)).alias(name))
        names.append(field.name)
        columns.append((name, kind, field.nullable))
    frame = Frame(df.select(*cols, order.alias(position)), [(position, True, True)], plain=df.select(*cols), dense=position if dense else None)
    return Table.of(frame, [Vector.of(frame, F.col(p), k, null, n, None, True) for (p, k, null), n in zip(columns, names, strict=True)])


def write_parquet(table, path: str) -> None:
    """Types are checked first; the data goes to a folder beside the target, which is then replaced."""
    for c in table._columns:
        if c._kind in (object, complex) or c._categories is not None:
            raise ColumnTypeError(f"{c._name}: {'categorical' if c._categories else c._kind.__name__} columns are not written")
    names = table.column_names()
    if len(set(names)) != len(names) or None in names:
        raise ColumnTypeError("columns need names of their own")
    spark = session()
    staged = f"{path}.{uuid.uuid4().hex}"
    values = table._frame.sorted().select(*[c._col.alias(n) for c, n in zip(table._columns, names, strict=True)])
    values.write.parquet(staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    goal, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staged)
    fs = goal.getFileSystem(conf)
    fs.delete(goal, True)
    fs.rename(source, goal)
