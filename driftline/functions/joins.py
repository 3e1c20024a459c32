"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters, with some for each value, up to which a table is left to Spark to broadcast.
SMALL = 10_000_000


def _size(table: DataFrame) -> int:
    """About how many bytes the values of a table have; computed texts and repeated rows are what they are."""
    values = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c in table.columns]
    return table.agg(F.sum(reduce(add, values))).first()[0] or 0


def measured(per_key: DataFrame, *columns: str) -> DataFrame:
    """A table that a join may broadcast only if its values, those of ``columns`` where the rest is dear to compute, are small.

    Spark's estimate comes from the size of compressed files and counts neither
    the length of computed texts nor how well keys were packed: a table of a row
    for each key is taken for small when it has millions of rows, and goes
    through the driver. One that is larger is merged, never broadcast.
    """
    return per_key.hint("merge") if _size(per_key.select(*columns or "*")) > SMALL else per_key


def salted_left_join(
    rows: DataFrame, per_key: DataFrame, keys: list[str], spread_by: list[str], salts: int = 16
) -> DataFrame:
    """Left join ``rows`` to a table with one row per key.

    Rows of a key are spread over ``salts`` join keys by a hash of ``spread_by``
    and the one-row side is repeated per salt, so no task gets a whole hot key;
    what is still too large for one task is split further by the adaptive skew
    join. Rows without a key match nothing and are spread without limit. A small
    ``per_key`` is broadcast by Spark, after its size was measured: an estimate
    counts neither the repetition nor the length of computed texts, and the
    driver would get millions of rows. A larger one is merged, never broadcast.
    """
    anywhere = F.xxhash64(*spread_by)
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    salt = F.when(no_key, anywhere).otherwise(F.pmod(anywhere, F.lit(salts).cast("bigint")))
    spread = rows.withColumn("__salt", salt)
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    repeated = per_key.withColumn("__salt", F.explode(every))
    if salts * _size(per_key) > SMALL:
        repeated = repeated.hint("merge")
    return spread.join(repeated, [*keys, "__salt"], "left").drop("__salt")


#: Rows of a key from which its row is broadcast, and the most rows that are broadcast that way.
FREQUENT, MOST_FREQUENT = 10_000, 100_000


def join_frequent(rows: DataFrame, per_key: DataFrame, key: str, count: str, frequent: int | None = None) -> DataFrame:
    """Inner join of ``rows`` to a table with one row per key and the number of rows that have it.

    Keys of more rows than a bound are broadcast, so their rows stay where they
    are; the others meet by a shuffle. The bound rises with the sum of all
    counts, so never more than MOST_FREQUENT keys are above it. ``frequent`` is
    a lower bound for tables whose rows are short.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) > max(FREQUENT if frequent is None else min(frequent, FREQUENT), total // MOST_FREQUENT)
    sent = per_key.filter(often).withColumn("__often", F.lit(True))
    marked = rows.join(F.broadcast(sent), key, "left")
    near = marked.filter(F.col("__often")).drop("__often")
    rest = marked.filter(F.col("__often").isNull()).select(*rows.columns).join(per_key.filter(~often), key)
    return near.unionByName(rest.select(*near.columns))
