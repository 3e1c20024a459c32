"""Small array helpers on Columns, all evaluated inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def empty(element: str) -> Column:
    """An empty array of the given element type."""
    return F.array().cast(f"array<{element}>")


def explode_rows(df: DataFrame, keys: list[str], array: Column, name: str) -> DataFrame:
    """One row per array element, with its position as ``pos``.

    A plain explode makes Spark filter on the array's size below the projection
    that computes it, which runs that computation twice; the outer form does not.
    """
    rows = df.select(*keys, F.posexplode_outer(array).alias("pos", name))
    return rows.filter(F.col("pos").isNotNull())


def scan(
    values: Column,
    state: Column,
    emitted: str,
    step: Callable[[Column, Column], tuple[Column, Column]],
    block: int = 256,
) -> Column:
    """Fold ``values`` left to right, collecting what each step emits.

    ``step(state, x)`` gives the next state and an array of outputs. Appending
    to an array copies it, so the fold runs in blocks: a row with n values costs
    about n * (block + n / block) copies instead of n * n.
    """

    def acc(st: Column, out: Column) -> Column:
        return F.struct(st.alias("state"), out.alias("out"))

    def advance(a: Column, x: Column) -> Column:
        nxt, out = step(a["state"], x)
        return acc(nxt, F.concat(a["out"], out))

    def run(items: Column, start: Column) -> Column:
        return F.aggregate(items, acc(start, empty(emitted)), advance)

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        parts = F.transform(starts, lambda b: F.slice(v, b * block + 1, F.lit(block)))
        return F.aggregate(
            parts,
            acc(state, empty(emitted)),
            lambda a, part: let(
                run(part, a["state"]),
                lambda r: acc(r["state"], F.concat(a["out"], r["out"])),
            ),
        )["out"]

    return let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(empty(emitted)))
