"""Typed vectors and tables over Spark DataFrames."""

from colonnade.display import set_repr_rows
from colonnade.errors import (
    ColonnadeError, ColumnIndexError, ColumnKeyError, ColumnTypeError, ColumnValueError, EmptyReductionWarning,
)
from colonnade.sources.csv import read_csv
from colonnade.sources.parquet import read_parquet, write_parquet
from colonnade.table import Table
from colonnade.vector import Schema, Vector

__all__ = [
    "ColonnadeError", "ColumnIndexError", "ColumnKeyError", "ColumnTypeError", "ColumnValueError",
    "EmptyReductionWarning", "Schema", "Table", "Vector", "read_csv", "read_parquet", "set_repr_rows", "write_parquet",
]
