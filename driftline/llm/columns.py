"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: The characters that the operators call white space, as a class for regular expressions.
BLANK = r"[\x20\x09-\x0D]"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact name.

    Extra columns go, also those whose names differ only in case or repeat
    another one (the first column of a name counts).
    """
    places = [df.columns.index(name) for name in names]
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select([F.col(f"_{i}").alias(name) for i, name in zip(places, names, strict=True)])


def with_whole_row(df: DataFrame, *names: str) -> DataFrame:
    """The whole rows as a struct ``doc`` whose fields are numbered, and the named columns beside it."""
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    named = [F.col(f"_{df.columns.index(name)}").alias(name) for name in names]
    return numbered.select(F.struct(*numbered.columns).alias("doc"), *named)


def whole_rows(df: DataFrame, like: DataFrame) -> DataFrame:
    """The rows that ``doc`` holds, under the names of the table they came from."""
    return df.select([F.col(f"doc._{i}").alias(name) for i, name in enumerate(like.columns)])


def arrow_type(kind: DataType) -> pa.DataType:
    return to_arrow_type(kind)


#: A table of so many rows at most goes to every executor; a row of a few numbers takes about 100 bytes there.
BROADCAST_ROWS = 500_000


def join_checked(large: DataFrame, small: DataFrame, on, how: str = "inner", size: int | None = None) -> DataFrame:
    """A join that sends ``small`` to every executor if it has BROADCAST_ROWS rows or fewer, else by a shuffle.

    ``size`` is what bounds the small side, by default its rows, which are
    counted; so ``small`` should be a written table.
    """
    size = small.count() if size is None else size
    return large.join(F.broadcast(small) if size <= BROADCAST_ROWS else small, on, how)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows whose texts a Python worker holds as objects at a time.
TOGETHER = 1_000


def slices(batches: Iterable[pa.RecordBatch], rows: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_texts(
    df: DataFrame,
    work: Callable[[], Callable[[list[Any]], dict[str, Any]]],
    schema: str,
    arrow: pa.Schema,
    text: str = "text",
    as_bytes: bool = False,
) -> DataFrame:
    """Run Python over the texts of each Arrow batch and put its columns beside the others.

    ``work`` is called once in each task and gives the function that turns a
    list of TOGETHER texts at most (null: empty) into the new columns. ``schema`` and ``arrow``
    describe the whole result, ``text`` is left out of it.
    """
    empty: Any = b"" if as_bytes else ""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for batch in slices(batches):
            at = batch.schema.get_field_index(text)
            column = batch.column(at)
            if as_bytes:
                column = column.cast(pa.binary())
            made = function([t if t is not None else empty for t in column.to_pylist()])
            kept = {batch.schema.field(i).name: batch.column(i) for i in range(batch.num_columns) if i != at}
            kept.update(made)
            columns = []
            for field in arrow:
                value = kept[field.name]
                if not isinstance(value, pa.Array):
                    value = pa.array(value, type=field.type)
                columns.append(value if value.type == field.type else value.cast(field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)
