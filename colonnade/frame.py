"""The DataFrame behind a table, with the order of its rows."""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ids = itertools.count()
#: Up to so many rows are numbered by one task; more are sorted, written and numbered file by file.
ONE_TASK = 1 << 20


def fresh(prefix: str = "v") -> str:
    """A physical name that no other frame uses, so that frames can be joined as they are."""
    return f"{prefix}{next(_ids)}"


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    return found or SparkSession.builder.getOrCreate()


@dataclass
class Frame:
    """``order``: (column, ascending, nulls last) in turn; the rows' positions follow it.

    ``plain`` is the same rows without what makes the order (a file's row
    numbers), for whatever needs none.  ``dense`` names the order's column if it
    counts the rows from 0.
    """

    df: DataFrame
    order: list[tuple[str, bool, bool]]
    rows: int | None = None
    verdicts: list[tuple[str, str]] = field(default_factory=list)
    plain: DataFrame | None = None
    dense: str | None = None

    @property
    def bare(self) -> DataFrame:
        return self.df if self.plain is None else self.plain

    def count(self) -> int:
        if self.rows is None:
            self.rows = self.bare.count()
        return self.rows

    def sort_columns(self) -> list[Column]:
        out = []
        for name, up, last in self.order:
            c = F.col(name)
            out.append((c.asc_nulls_last() if last else c.asc_nulls_first()) if up
                       else (c.desc_nulls_last() if last else c.desc_nulls_first()))
        return out

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.sort_columns()) if self.order else self.df

    def rank(self) -> Column:
        """One orderable column that rises along the rows.

        A sort by falling keys gets a number from the sorted partitions: ids
        rise from each partition to the next.
        """
        if len(self.order) == 1 and self.order[0][1]:
            return F.col(self.order[0][0])
        if self.order and all(up for _, up, _ in self.order):
            parts = []
            for name, _, last in self.order:
                parts += [F.col(name).isNull() if last else F.col(name).isNotNull(), F.col(name)]
            return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])
        name = fresh("o")
        self.df = self.sorted().withColumn(name, F.monotonically_increasing_id())
        self.order = [(name, True, True)]
        return F.col(name)

    def numbered(self) -> str:
        """Name of a column with dense positions from 0."""
        name = fresh("p")
        if self.dense is not None:
            self.df = self.df.withColumn(name, F.col(self.dense).cast("long"))
        elif self.count() <= ONE_TASK:
            window = Window.orderBy(*self.sort_columns()) if self.order else Window.orderBy(F.lit(0))
            self.df = self.df.withColumn(name, F.row_number().over(window).cast("long") - 1)
        else:
            self.df = _numbered_files(self.sorted(), name)
        self.order, self.dense = [(name, True, True)], name
        return name


def _numbered_files(df: DataFrame, name: str) -> DataFrame:
    """Rows in their order, written once: a row's position is its place in its file behind the files before."""
    from colonnade.runtime import scratch_dir

    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    file, place, before = fresh("f"), fresh("r"), fresh("b")
    rows = spark.read.schema(df.schema).parquet(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(place))
    # One row a file; names rise with the partitions.
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(file).count().collect())
    starts = itertools.accumulate([0, *[n for _, n in sizes[:-1]]])
    offsets = spark.createDataFrame([(f, s) for (f, _), s in zip(sizes, starts, strict=True)], f"{file} string, {before} long")
    joined = rows.join(F.broadcast(offsets), file)
    return joined.withColumn(name, F.col(before) + F.col(place)).drop(file, before, place)


def aligned(left: Frame, right: Frame) -> Frame:
    """Both frames' columns side by side, row by position; lengths must agree."""
    from colonnade.errors import ColumnValueError

    if left.count() != right.count():
        raise ColumnValueError(f"lengths differ: {left.count()} and {right.count()}")
    a = left.numbered()
    b = right.numbered()
    # A name on both sides is one column of a frame that both come from.
    other = right.df.drop(*(set(left.df.columns) & set(right.df.columns)))
    joined = left.df.join(other, F.col(a) == F.col(b))
    return Frame(joined, [(a, True, True)], left.count(), dense=a)
