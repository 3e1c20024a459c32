"""Questions about the audit log, and rows derived from tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.sources import audit_log


def recent(lines: DataFrame, order: list[str], limit: int = 100, line: str = "line") -> DataFrame:
    """Entries among the last ``limit`` lines, newest last; malformed lines use up the limit."""
    last = lines.orderBy(*[F.desc(c) for c in order]).limit(limit)
    return audit_log.parse(last.orderBy(*order), line)


def recent_in_log(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """Entries among the last ``limit`` lines of a stored log in the order of its lines; malformed lines use up the limit."""
    return audit_log.parse(audit_log.last_lines(spark, path, limit)).orderBy(*audit_log.PLACE).drop(*audit_log.PLACE)


def incidents_in_log(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The first incidents of a stored log in the order of its lines."""
    found = audit_log.first_entries(spark, path, is_incident(), limit)
    return found.orderBy(*audit_log.PLACE).drop(*audit_log.PLACE)


def of_stored_traces(spark: SparkSession, name: str, traces: DataFrame) -> DataFrame:
    """All entries of the traces in a table, from a log stored by trace: only the traces are moved."""
    return of_traces(spark.table(name), traces)


def of_trace(entries: DataFrame, trace_id: str) -> DataFrame:
    """All entries of one trace."""
    return entries.filter(F.col("trace_id") == trace_id)


def of_traces(entries: DataFrame, traces: DataFrame) -> DataFrame:
    """All entries of the traces in a table."""
    return entries.join(traces.select("trace_id").distinct(), "trace_id", "left_semi")


def is_incident() -> Column:
    """Personal data, injection or a risk above one half."""
    return F.col("pii_detected") | F.col("injection_detected") | (F.col("risk_score") > 0.5)


def security_incidents(entries: DataFrame, order: list[str], limit: int = 50) -> DataFrame:
    """The first incidents in log order."""
    return entries.filter(is_incident()).orderBy(*order).limit(limit)


def tool_calls(results: DataFrame) -> DataFrame:
    """Audit rows of tool results (tool_name, security_flags, status and more).

    The flags are read literally: no flag text contains the word injection, so
    injection flags raise the risk but not ``injection_detected``.
    """
    flags = F.coalesce("security_flags", F.array().cast("array<string>"))
    derived = {
        "action": F.concat(F.lit("tool:"), "tool_name"),
        "risk_score": F.size(flags) * F.lit(0.2),
        "pii_detected": F.exists(
            flags, lambda f: F.contains(f, F.lit("PII")) | F.contains(f, F.lit("EMAIL"))
        ),
        "injection_detected": F.exists(flags, lambda f: F.contains(F.lower(f), F.lit("injection"))),
        "status": F.coalesce("status", F.lit("ok")),
        "security_flag_count": F.size(flags),
    }
    return results.withColumns(derived).drop("tool_name", "security_flags")


def _present(pairs: dict[str, Column]) -> Column:
    entries = [
        F.when(v.isNotNull() & (v.cast("string") != ""), F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")))
        for k, v in pairs.items()
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def span_attributes(
    entries: DataFrame, namespace: str = "flow", task_id: str | None = None
) -> DataFrame:
    """Span name, status and attribute map per tool call; optional keys only when set.

    Entry metadata becomes attributes below the namespace.
    """
    tool = F.regexp_replace("action", "^tool:", "")
    standard = _present(
        {
            fv.SPAN_AGENT: F.col("agent_id"),
            fv.SPAN_ACTION: F.lit("tool_call"),
            fv.SPAN_TOOL: tool,
            f"{namespace}.repo_path": F.col("repo_path"),
            fv.SPAN_TASK: F.lit(None).cast("string") if task_id is None else F.col(task_id),
            fv.SPAN_PII: F.col("pii_detected"),
            fv.SPAN_INJECTION: F.col("injection_detected"),
            f"{namespace}.risk_score": F.col("risk_score"),
        }
    )
    taken = F.map_keys(standard)
    extra = F.transform_keys(
        F.coalesce("metadata", F.create_map().cast("map<string,string>")),
        lambda k, v: F.concat(F.lit(f"{namespace}."), k),
    )
    extra = F.map_filter(extra, lambda k, v: ~F.array_contains(taken, k) & v.isNotNull())
    return entries.withColumns(
        {
            "span_name": F.concat(F.lit(f"{namespace}."), tool),
            "span_status": F.when(F.col("status") == "error", "ERROR").otherwise("OK"),
            "attributes": F.map_concat(standard, extra),
        }
    )


def flow_attributes(states: DataFrame, namespace: str = "flow") -> DataFrame:
    """Flow-state attributes per repository."""
    return states.withColumn(
        "attributes",
        _present(
            {
                f"{namespace}.status": F.col("status"),
                f"{namespace}.minutes_since_commit": F.col("minutes_since_last_commit"),
                f"{namespace}.uncommitted_lines": F.col("uncommitted_lines"),
            }
        ),
    )
