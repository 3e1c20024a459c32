"""All queries and their SQL checks in one place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.plans import activity, alignment, fleet, guardian, history_search, live
from driftline.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
_AREAS = (guardian, history_search, fleet, alignment, activity, live)


def _prepared(query: Query) -> Query:
    """The query on a session in UTC that has a checkpoint folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        shared_dir(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


def queries() -> dict[str, Query]:
    return {name: _prepared(q) for area in _AREAS for name, q in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in _AREAS for name, sql in area.ORACLE.items()}
