"""Small tables of fixed size, looked up inside a row by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a table that are put together in one row on their way to the driver.
_ROW = 1024


def byte_table(values: DataFrame, size: int) -> bytes:
    """``size`` bytes from rows of ``place`` (0 to size - 1) and ``value`` (0 to 127); 0 where there is no row.

    The driver gets size / 1024 rows, whatever the input.
    """
    spark = values.sparkSession
    every = spark.range(0, size, 1, max(1, size // 2**17)).select(F.col("id").alias("place"), F.lit(0).alias("value"))
    full = every.unionByName(values.select(F.col("place").cast("bigint"), F.col("value").cast("int")))
    full = full.groupBy("place").agg(F.max("value").alias("value"))
    rows = full.groupBy(F.floor(F.col("place") / _ROW).alias("at")).agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("entries"))
    digits = F.array_join(F.transform("entries", lambda e: F.lpad(F.hex(e["value"]), 2, "0")), "")
    found = rows.select("at", digits.alias("digits")).collect()
    return bytes.fromhex("".join(r["digits"] for r in sorted(found, key=lambda r: r["at"])))


def byte_at(table: bytes, place: Column) -> Column:
    """The byte at a place of the table, as a number up to 127."""
    return F.ascii(F.substring(F.lit(table), place.cast("int") + 1, F.lit(1)).cast("string"))
