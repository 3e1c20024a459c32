"""Queries over the audit log and agent sessions, with their SQL checks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.operators import audit, injection, sessions as ses
from driftline.plans.guardian import ORACLE as _  # noqa: F401  registers the scan views
from driftline.plans.views import VIEWS, quote, with_views
from driftline.session import scratch_path
from driftline.sources import audit_log
from driftline.sources.derived import agent_events, content

TRACE = hashlib.md5(b"7").hexdigest()
COUNTED = ["tool:purchase", "tool:view"]


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Events as audit entries, calls inside a session stamped with it."""
    return ses.session_stamp(agent_events(spark, sf))


def _plain(entries: DataFrame) -> DataFrame:
    """Entry rows with time and metadata as text."""
    return entries.withColumns(
        {
            "ts": audit_log.iso(F.col("ts")),
            "risk_score": F.round("risk_score", 6),
            "metadata": F.col("metadata")["k"],
        }
    )


FIELDS = [
    "ts",
    "trace_id",
    "action",
    "agent_id",
    "session_id",
    "risk_score",
    "pii_detected",
    "injection_detected",
    "status",
    "repo_path",
    "duration_ms",
    "metadata",
]


def audit_write(spark: SparkSession, sf: str) -> DataFrame:
    """The written lines, taken apart field by field."""
    lines = _entries(spark, sf).select("event_id", audit_log.to_line().alias("line"))
    get = lambda path: F.get_json_object("line", path)
    keys = F.json_object_keys("line")
    return lines.select(
        "event_id",
        get("$.timestamp").alias("timestamp"),
        get("$.trace_id").alias("trace_id"),
        get("$.action").alias("action"),
        F.round(get("$.risk_score").cast("double"), 6).alias("risk_score"),
        get("$.repo_path").alias("repo_path"),
        get("$.session_id").alias("session_id"),
        get("$.duration_ms").cast("bigint").alias("duration_ms"),
        get("$.metadata.k").alias("metadata_k"),
        F.array_contains(keys, "repo_path").alias("has_repo_path"),
        F.array_contains(keys, "session_id").alias("has_session_id"),
        F.array_contains(keys, "duration_ms").alias("has_duration_ms"),
    )


def audit_read(spark: SparkSession, sf: str) -> DataFrame:
    """Write the log to the shared folder with broken lines in between, read it back."""
    entries = _entries(spark, sf)
    path = scratch_path(spark, "audit")
    audit_log.write(entries, path)
    broken = entries.filter(F.col("kind") == "end").select(
        F.left(audit_log.to_line(), F.lit(40)).alias("value"), F.to_date("ts").alias("day")
    )
    broken.hint("rebalance", "day").write.mode("append").partitionBy("day").text(path)
    return _plain(audit_log.read(spark, path)).select(*FIELDS)


def audit_recent(spark: SparkSession, sf: str) -> DataFrame:
    line = audit_log.to_line()
    cut = F.when(F.col("event_id") % 17 == 0, F.left(line, F.lit(40))).otherwise(line)
    lines = _entries(spark, sf).select(F.col("ts").alias("at"), "event_id", cut.alias("line"))
    recent = audit.recent(lines, ["at", "event_id"], 100)
    return _plain(recent).select("event_id", *FIELDS)


def audit_trace(spark: SparkSession, sf: str) -> DataFrame:
    entries = agent_events(spark, sf).withColumn("session_id", F.lit(None).cast("string"))
    return _plain(audit.of_trace(entries, TRACE)).select("event_id", "ts", "action", "risk_score")


def audit_traces(spark: SparkSession, sf: str) -> DataFrame:
    """All entries of every trace with an error."""
    entries = agent_events(spark, sf).withColumn("session_id", F.lit(None).cast("string"))
    found = audit.of_traces(entries, entries.filter(F.col("status") == "error"))
    return _plain(found).select("event_id", "ts", "action", "risk_score")


def security_incidents(spark: SparkSession, sf: str) -> DataFrame:
    found = audit.security_incidents(agent_events(spark, sf), ["ts", "event_id"])
    return _plain(found).select("event_id", "ts", "risk_score", "pii_detected")


def _written_log(spark: SparkSession, sf: str) -> str:
    """A log of two appends, with many equal times and every 17th line cut short."""
    path = scratch_path(spark, "audit")
    entries = _entries(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    line = audit_log.to_line()
    lines = entries.withColumn("value", F.when(F.col("event_id") % 17 == 0, F.left(line, F.lit(40))).otherwise(line))
    for rest in (0, 1):
        audit_log.write_lines(lines.filter(F.col("event_id") % 2 == rest), path, ["ts", "event_id"])
    return path


def audit_recent_log(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(audit.recent_in_log(spark, _written_log(spark, sf), 100)).select(*FIELDS)


def security_incidents_log(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(audit.incidents_in_log(spark, _written_log(spark, sf))).select(*FIELDS)


def audit_traces_stored(spark: SparkSession, sf: str) -> DataFrame:
    """As audit_traces, from a log that is stored by trace."""
    entries = agent_events(spark, sf).withColumn("session_id", F.lit(None).cast("string"))
    path = scratch_path(spark, "clustered")
    name = "log_" + path.rsplit("-", 1)[1]
    audit_log.write_clustered(entries, name, path, 8)
    found = audit.of_stored_traces(spark, name, entries.filter(F.col("status") == "error"))
    return _plain(found).select("event_id", "ts", "action", "risk_score")


def tool_call_audit(spark: SparkSession, sf: str) -> DataFrame:
    flagged = injection.with_security_flags(content(spark, sf)).select(
        "doc_id",
        F.lit("get_flow_state").alias("tool_name"),
        F.col("source").alias("repo_path"),
        "security_flags",
        F.lit(None).cast("string").alias("status"),
    )
    rows = audit.tool_calls(flagged)
    return rows.withColumn("risk_score", F.round("risk_score", 6))


def span_attributes(spark: SparkSession, sf: str) -> DataFrame:
    spans = audit.span_attributes(agent_events(spark, sf))
    rows = spans.select(
        "event_id", "span_name", "span_status", F.explode("attributes").alias("attribute", "value")
    )
    risk = F.format_string("%.6f", F.col("value").try_cast("double"))
    return rows.withColumn(
        "value", F.when(F.col("attribute") == "flow.risk_score", risk).otherwise(F.col("value"))
    )


def session_rows(rows: DataFrame) -> DataFrame:
    times = [c for c in ("started_at", "ended_at", "last_activity", "ts") if c in rows.columns]
    shown = {c: audit_log.iso(F.col(c)) for c in times}
    if "metadata" in rows.columns:
        shown["metadata"] = F.col("metadata")["k"]
    return rows.withColumns(shown)


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return session_rows(ses.sessions(_entries(spark, sf)))


def sessions_counted(spark: SparkSession, sf: str) -> DataFrame:
    return session_rows(ses.sessions(_entries(spark, sf), COUNTED))


def session_stamp(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).select("event_id", "agent_id", "session_id")


def session_stamp_auto(spark: SparkSession, sf: str) -> DataFrame:
    stamped = ses.session_stamp(agent_events(spark, sf), auto_create=True)
    return stamped.select("event_id", "agent_id", "session_id")


def session_info(spark: SparkSession, sf: str) -> DataFrame:
    stamped = _entries(spark, sf)
    return session_rows(ses.session_info(stamped, ses.sessions(stamped)))


def session_end_report(spark: SparkSession, sf: str) -> DataFrame:
    stamped = _entries(spark, sf)
    return session_rows(ses.session_end_report(stamped, ses.sessions(stamped)))


QUERIES = {
    f.__name__: f
    for f in (
        audit_write,
        audit_read,
        audit_recent,
        audit_trace,
        audit_traces,
        security_incidents,
        audit_recent_log,
        security_incidents_log,
        audit_traces_stored,
        tool_call_audit,
        span_attributes,
        sessions,
        sessions_counted,
        session_stamp,
        session_stamp_auto,
        session_info,
        session_end_report,
    )
}

# --- SQL checks -----------------------------------------------------------------


def _iso(ts: str) -> str:
    return (
        f"CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'"
    )


VIEWS["activity"] = (
    [],
    """SELECT event_id, ts, CAST(user_id AS VARCHAR) AS agent_id,
         CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'end' ELSE 'call' END AS kind,
         'tool:' || event_type AS action, md5(CAST(user_id AS VARCHAR)) AS trace_id,
         round(least(1.0::DOUBLE, value / 500), 6) AS risk_score,
         least(1.0::DOUBLE, value / 500) AS exact_risk,
         event_type = 'view' AND value > 400 AS pii_detected, FALSE AS injection_detected,
         CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status,
         CASE WHEN event_type <> 'click' THEN 'repo' || (user_id % 10) END AS repo_path,
         CASE WHEN event_type <> 'view' THEN CAST(trunc(value) AS BIGINT) * 100000000 END AS duration_ms,
         json_extract_string(props, '$.k') AS metadata FROM events""",
)


def _stamp_view(opening: str) -> str:
    """The session of every event, given the rule for events that open one."""
    return f"""SELECT * EXCLUDE (before, own), CASE WHEN opens THEN own ELSE nullif(before, '') END
                 AS session_id
               FROM (SELECT *, last_value(CASE WHEN opens THEN own WHEN kind = 'end' THEN '' END
                       IGNORE NULLS) OVER (PARTITION BY agent_id ORDER BY ts, event_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
                     FROM (SELECT *, {opening} AS opens,
                             left(md5(agent_id || '|' || event_id), 16) AS own
                           FROM (SELECT *, lag(kind) OVER (PARTITION BY agent_id
                                   ORDER BY ts, event_id) AS previous FROM activity)))"""


VIEWS["stamped"] = (["activity"], _stamp_view("kind = 'start'"))
VIEWS["stamped_auto"] = (
    ["activity"],
    _stamp_view("kind = 'start' OR (kind = 'call' AND coalesce(previous, 'end') = 'end')"),
)


def _sessions_view(counted: str) -> str:
    return f"""SELECT agent_id, session_id, started_at, ended_at, tool_calls,
                 coalesce(last_call, started_at) AS last_activity,
                 CAST(trunc((epoch_us(coalesce(last_call, started_at)) - epoch_us(started_at))
                   / 1000000) AS BIGINT) AS duration_seconds, metadata
               FROM (SELECT agent_id, session_id,
                       any_value(metadata) FILTER (WHERE opens) AS metadata,
                       min(ts) FILTER (WHERE opens) AS started_at,
                       max(ts) FILTER (WHERE kind = 'end') AS ended_at,
                       count(*) FILTER (WHERE {counted}) AS tool_calls,
                       max(ts) FILTER (WHERE {counted}) AS last_call
                     FROM stamped WHERE session_id IS NOT NULL GROUP BY agent_id, session_id)"""


VIEWS["all_sessions"] = (["stamped"], _sessions_view("kind = 'call'"))
SESSION_COLUMNS = f"""agent_id, session_id, {_iso('started_at')} AS started_at,
  {_iso('ended_at')} AS ended_at, tool_calls, {_iso('last_activity')} AS last_activity,
  duration_seconds, metadata"""
_FIELDS = f"""{_iso('ts')} AS ts, trace_id, action, agent_id, session_id, risk_score, pii_detected,
  injection_detected, status, repo_path, duration_ms, metadata"""


def _attribute(name: str, value: str) -> str:
    return f"""SELECT event_id, action, status, '{name}' AS attribute, {value} AS value
               FROM activity"""


_ATTRIBUTES = " UNION ALL ".join(
    _attribute(n, v)
    for n, v in (
        (fv.SPAN_AGENT, "agent_id"),
        (fv.SPAN_ACTION, "'tool_call'"),
        (fv.SPAN_TOOL, "replace(action, 'tool:', '')"),
        ("flow.repo_path", "repo_path"),
        (fv.SPAN_PII, "CAST(pii_detected AS VARCHAR)"),
        (fv.SPAN_INJECTION, "CAST(injection_detected AS VARCHAR)"),
        ("flow.risk_score", "printf('%.6f', exact_risk)"),
        ("flow.k", "metadata"),
    )
)

_IN_LOG = "CAST(ts AS DATE), event_id % 2, date_trunc('hour', ts), event_id"
_FIELDS_IN_LOG = _FIELDS.replace(_iso("ts"), _iso("date_trunc('hour', ts)"))

ORACLE = {
    "audit_recent_log": with_views(
        ["stamped"],
        f"""SELECT {_FIELDS_IN_LOG} FROM (
              SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_IN_LOG}) AS line FROM stamped)
              ORDER BY line DESC LIMIT 100)
            WHERE event_id % 17 <> 0""",
    ),
    "security_incidents_log": with_views(
        ["stamped"],
        f"""SELECT {_FIELDS_IN_LOG} FROM (
              SELECT * FROM stamped WHERE event_id % 17 <> 0 AND (pii_detected OR exact_risk > 0.5)
              ORDER BY {_IN_LOG} LIMIT 50)""",
    ),
    "audit_traces_stored": with_views(
        ["activity"],
        f"""SELECT event_id, {_iso('ts')} AS ts, action, risk_score FROM activity
            WHERE trace_id IN (SELECT trace_id FROM activity WHERE status = 'error')""",
    ),
    "audit_write": with_views(
        ["stamped"],
        f"""SELECT event_id, {_iso('ts')} AS timestamp, trace_id, action, risk_score, repo_path,
              session_id, duration_ms, metadata AS metadata_k, TRUE AS has_repo_path,
              session_id IS NOT NULL AS has_session_id, duration_ms IS NOT NULL AS has_duration_ms
            FROM stamped""",
    ),
    "audit_read": with_views(["stamped"], f"SELECT {_FIELDS} FROM stamped"),
    "audit_recent": with_views(
        ["stamped"],
        f"""SELECT event_id, {_FIELDS} FROM (
              SELECT * FROM stamped ORDER BY ts DESC, event_id DESC LIMIT 100)
            WHERE event_id % 17 <> 0""",
    ),
    "audit_trace": with_views(
        ["activity"],
        f"""SELECT event_id, {_iso('ts')} AS ts, action, risk_score FROM activity
            WHERE trace_id = '{TRACE}'""",
    ),
    "audit_traces": with_views(
        ["activity"],
        f"""SELECT event_id, {_iso('ts')} AS ts, action, risk_score FROM activity
            WHERE trace_id IN (SELECT trace_id FROM activity WHERE status = 'error')""",
    ),
    "security_incidents": with_views(
        ["activity"],
        f"""SELECT event_id, {_iso('ts')} AS ts, risk_score, pii_detected FROM (
              SELECT * FROM activity WHERE pii_detected OR exact_risk > 0.5
              ORDER BY ts, event_id LIMIT 50)""",
    ),
    "tool_call_audit": with_views(
        ["scan_flags"],
        """SELECT doc_id, 'tool:get_flow_state' AS action, source AS repo_path, 'ok' AS status,
             round(len(flags) * 0.2::DOUBLE, 6) AS risk_score,
             len(list_filter(flags, lambda f: contains(f, 'PII') OR contains(f, 'EMAIL'))) > 0
               AS pii_detected,
             len(list_filter(flags, lambda f: contains(lower(f), 'injection'))) > 0
               AS injection_detected,
             CAST(len(flags) AS INTEGER) AS security_flag_count FROM scan_flags""",
        recursive=True,
    ),
    "span_attributes": with_views(
        ["activity"],
        f"""SELECT event_id, 'flow.' || replace(action, 'tool:', '') AS span_name,
              CASE status WHEN 'error' THEN 'ERROR' ELSE 'OK' END AS span_status, attribute, value
            FROM ({_ATTRIBUTES}) WHERE value IS NOT NULL""",
    ),
    "sessions": with_views(["all_sessions"], f"SELECT {SESSION_COLUMNS} FROM all_sessions"),
    "sessions_counted": with_views(
        ["stamped"],
        f"""SELECT {SESSION_COLUMNS} FROM ({_sessions_view("kind = 'call' AND action IN ("
            + ", ".join(quote(c) for c in COUNTED) + ")")})""",
    ),
    "session_stamp": with_views(["stamped"], "SELECT event_id, agent_id, session_id FROM stamped"),
    "session_stamp_auto": with_views(
        ["stamped_auto"], "SELECT event_id, agent_id, session_id FROM stamped_auto"
    ),
    "session_info": with_views(
        ["all_sessions"],
        f"""SELECT agent_id, session_id, {_iso('started_at')} AS started_at, tool_calls,
              {_iso('last_activity')} AS last_activity, duration_seconds, metadata,
              session_id IS NOT NULL AS active,
              CASE WHEN session_id IS NULL THEN {quote(fv.NO_SESSION)} END AS message
            FROM (SELECT agent_id, max_by(struct_pack(v := CASE WHEN opens THEN session_id END),
                      (ts, event_id)) FILTER (WHERE opens OR kind = 'end') AS s
                  FROM stamped GROUP BY agent_id) a
            LEFT JOIN (SELECT agent_id AS a2, * EXCLUDE (agent_id) FROM all_sessions) o
              ON o.a2 = a.agent_id AND o.session_id = a.s.v""",
    ),
    "session_end_report": with_views(
        ["all_sessions"],
        f"""SELECT agent_id, {_iso('ended_at')} AS ts, session_id, tool_calls, duration_seconds,
              {quote(fv.SESSION_ENDED)} AS message FROM all_sessions WHERE ended_at IS NOT NULL
            UNION ALL
            SELECT agent_id, {_iso('ts')}, NULL, NULL, NULL, {quote(fv.NO_SESSION_TO_END)}
            FROM stamped WHERE kind = 'end' AND session_id IS NULL""",
    ),
}
