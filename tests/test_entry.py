import __spark_entry__ as entry_points

from driftline.plans import registry


def test_entry_gives_flags(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and any(r.flag_count for r in rows)


def test_queries_and_checks_are_listed():
    queries, checks = entry_points.queries(), entry_points.oracle_sql()
    assert set(checks) <= set(queries)
    assert set(registry.queries()) <= set(checks)
    assert all(callable(q) for q in queries.values())
