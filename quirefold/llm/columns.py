"""Helpers to add computed columns to a table of texts in one Arrow pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from . import textkernel as K


def append(df: DataFrame, text: str, fields: list[StructField], make: Callable[[list[str]], list]) -> DataFrame:
    """``df`` with the columns that ``make`` computes from a list of texts (null as empty).

    A column of ``df`` whose name clashes with a new one, in any case of letters, is replaced by it;
    every other column is passed through unread.
    """
    taken = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in taken or c.lower() == text.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    passed = [f for f in source.schema.fields[:-1] if f.name.lower() not in taken]
    at = [i for i, f in enumerate(source.schema.fields[:-1]) if f.name.lower() not in taken]
    schema = StructType(passed + fields)
    arrow = to_arrow_schema(StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            made = make(b.column(b.num_columns - 1).to_pylist())
            new = [pa.array(v, type=f.type) if not isinstance(v, pa.Array) else v for v, f in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in at], *new], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with a prefix that makes them differ from every column of ``df``."""
    taken, prefix = {c.lower() for c in df.columns}, "__"
    while any(prefix + n.lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def dropping(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names in any case of letters."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def most_frequent(counted: DataFrame, most: int, n: str = "n", tie: str | None = None) -> DataFrame:
    """The ``most`` rows of highest count, ties in order of another column, of a table that is written already.

    How many rows have each count tells which count is the last to be taken, so a task sends the driver only rows that
    may be among the result, however many tasks there are.
    """
    sizes = counted.groupBy(n).agg(F.count("*").alias("rows")).orderBy(F.desc(n)).collect()  # a row for each distinct count
    total, last = 0, 0
    for r in sizes:
        total, last = total + r["rows"], r[n]
        if total >= most:
            break
    return counted.where(F.col(n) >= last).orderBy(F.desc(n), *([tie] if tie else [])).limit(most)
