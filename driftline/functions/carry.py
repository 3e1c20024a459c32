"""Carry the last seen value forward in time, per key, without one task per key.

A plain window over (key, time) puts all rows of a key into one task, which a
hot key would overload. Here rows are windowed per (key, time bucket); a second,
small window over one row per bucket brings in what earlier buckets ended with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(
    rows: DataFrame,
    key: str,
    order: list[str],
    bucket: Column,
    values: dict[str, Column],
    including_self: bool = True,
) -> DataFrame:
    """Add, per name in ``values``, the last non-null value up to each row.

    ``order`` must be a total order within a key whose buckets follow it; key and
    bucket must not be null. With ``including_self`` false a row sees earlier rows
    only. Rows are shuffled once, by (key, bucket), for window and join alike.
    """
    tmp = {name: f"__{name}" for name in values}
    rows = rows.withColumns({"__bucket": bucket, **{tmp[n]: v for n, v in values.items()}})

    upto = Window.currentRow if including_self else -1
    within = (
        Window.partitionBy(key, "__bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, upto)
    )
    local = rows.withColumns(
        {name: F.last(F.col(tmp[name]), ignorenulls=True).over(within) for name in values}
    )

    # one row per (key, bucket): the last value seen in it, combined map-side
    ordinal = F.struct(*order)
    ends = rows.groupBy(key, "__bucket").agg(
        *[
            F.max_by(F.col(tmp[n]), F.when(F.col(tmp[n]).isNotNull(), ordinal)).alias(n)
            for n in values
        ]
    )
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        key,
        "__bucket",
        *[F.last(F.col(n), ignorenulls=True).over(before).alias(f"__in_{n}") for n in values],
    )
    joined = local.join(carried, [key, "__bucket"])
    return joined.withColumns(
        {n: F.coalesce(F.col(n), F.col(f"__in_{n}")) for n in values}
    ).drop("__bucket", *tmp.values(), *[f"__in_{n}" for n in values])
