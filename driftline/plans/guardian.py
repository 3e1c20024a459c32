"""Queries over sensitive data and prompt injection, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.arrays import explode_rows
from driftline.operators import injection, sensitive
from driftline.plans.views import VIEWS, quote, with_views
from driftline.sources.derived import content

KEY = ["doc_id"]


def sensitive_quick_filter(spark: SparkSession, sf: str) -> DataFrame:
    return sensitive.quick_filter(content(spark, sf)).select("doc_id", "source")


def sensitive_findings(spark: SparkSession, sf: str) -> DataFrame:
    return sensitive.findings(content(spark, sf), KEY)


def sensitive_spans_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return sensitive.resolved_spans(content(spark, sf), KEY)


def redacted_items(spark: SparkSession, sf: str) -> DataFrame:
    return sensitive.redacted_items(content(spark, sf), KEY)


def redacted_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return sensitive.sanitize(content(spark, sf)).select("doc_id", "sanitized.sanitized_text")


def high_entropy_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return sensitive.high_entropy_secrets(content(spark, sf), KEY)


def sanitization_summary(spark: SparkSession, sf: str) -> DataFrame:
    return sensitive.summary(content(spark, sf), KEY)


def sensitive_report(spark: SparkSession, sf: str) -> DataFrame:
    return sensitive.report(content(spark, sf), "doc_id", "source")


def injection_findings(spark: SparkSession, sf: str) -> DataFrame:
    return injection.findings(content(spark, sf), KEY, sensitivity="high")


def injection_by_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return injection.by_sensitivity(content(spark, sf), "source")


def injection_risk(spark: SparkSession, sf: str) -> DataFrame:
    scored = injection.risk(content(spark, sf), KEY)
    return scored.withColumn("risk_score", F.round("risk_score", 6))


def injection_quick_filter(spark: SparkSession, sf: str) -> DataFrame:
    return injection.quick_filter(content(spark, sf)).select("doc_id")


def injection_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = explode_rows(content(spark, sf), KEY, injection.flags(F.col("text")), "flag")
    return rows.select("doc_id", F.col("pos").alias("n"), "flag")


def security_scan(spark: SparkSession, sf: str) -> DataFrame:
    flagged = injection.with_security_flags(content(spark, sf))
    return flagged.select(
        "doc_id",
        F.size("security_flags").alias("flag_count"),
        F.array_join("security_flags", "|").alias("security_flags"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        sensitive_quick_filter,
        sensitive_findings,
        sensitive_spans_resolved,
        redacted_items,
        redacted_corpus,
        high_entropy_secrets,
        sanitization_summary,
        sensitive_report,
        injection_findings,
        injection_by_sensitivity,
        injection_risk,
        injection_quick_filter,
        injection_flags,
        security_scan,
    )
}

# --- SQL checks -----------------------------------------------------------------

_PRIVATE_IP = r"^(127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0)"


def _matches_sql(ordinal: int, kind: str, pattern: str, group: int) -> str:
    """All matches of one pattern with their 0-based start."""
    keep = ""
    if kind == "ip_address":  # this dialect has no look-ahead
        pattern = pattern[: pattern.index("(?!")] + pattern[pattern.index("))") + 2 :]
        keep = f"WHERE NOT regexp_matches(v, {quote(_PRIVATE_IP)})"
    p = quote(pattern)
    return f"""SELECT doc_id, {ordinal} AS ordinal, '{kind}' AS type, v AS value,
      CAST(before + length(w) - length(v)
        - CASE WHEN {group} > 0 AND right(w, 1) IN ('"', '''') THEN 1 ELSE 0 END AS INTEGER) AS start
      FROM (SELECT doc_id, i, w, v, sum(length(g)) OVER (PARTITION BY doc_id ORDER BY i)
              + coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM (SELECT doc_id, unnest(ws) AS w, unnest(vs) AS v, unnest(gs[1:len(ws)]) AS g,
                         unnest(range(len(ws))) AS i
                  FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS ws,
                               regexp_extract_all(text, {p}, {group}) AS vs,
                               string_split_regex(text, {p}) AS gs
                        FROM content WHERE regexp_matches(text, {p}))))
      {keep}"""


_HITS = " UNION ALL ".join(
    _matches_sql(i, kind, p, g) for i, (kind, p, g) in enumerate(fv.SENSITIVE_PATTERNS)
)
_LINE = "CAST(length(left(text, start)) - length(replace(left(text, start), chr(10), '')) + 1 AS INTEGER)"
VIEWS["hits"] = (
    ["content"],
    f"""SELECT h.doc_id, ordinal, type, start, {_LINE} AS line_number,
          CAST(length(value) AS INTEGER) AS original_length, value
        FROM ({_HITS}) h JOIN content USING (doc_id)""",
)
# the greedy choice, one span per step
VIEWS["ranked_hits"] = (
    ["hits"],
    "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, ordinal) AS rn FROM hits",
)
VIEWS["walk"] = (
    ["ranked_hits"],
    """SELECT doc_id, rn, TRUE AS kept, start + original_length AS last_end
       FROM ranked_hits WHERE rn = 1
       UNION ALL
       SELECT h.doc_id, h.rn, h.start >= w.last_end,
              CASE WHEN h.start >= w.last_end THEN h.start + h.original_length ELSE w.last_end END
       FROM walk w JOIN ranked_hits h ON h.doc_id = w.doc_id AND h.rn = w.rn + 1""",
)
VIEWS["kept"] = (
    ["walk"],
    """SELECT h.* FROM ranked_hits h JOIN walk w ON h.doc_id = w.doc_id AND h.rn = w.rn
       WHERE w.kept""",
)
VIEWS["tokens_kept"] = (
    ["kept"],
    """SELECT doc_id, start, type, line_number, original_length,
         start + original_length AS finish,
         '[REDACTED_' || upper(type) || '_' || row_number() OVER (
            PARTITION BY doc_id, type ORDER BY start DESC) || ']' AS token,
         row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS n
       FROM kept""",
)
VIEWS["pattern_text"] = (
    ["tokens_kept"],
    """SELECT c.doc_id, coalesce(r.head || substr(c.text, r.finish + 1), c.text) AS text
       FROM content c LEFT JOIN (
         SELECT doc_id, string_agg(piece || token, '' ORDER BY start) AS head, max(finish) AS finish
         FROM (SELECT t.doc_id, t.start, t.finish, t.token,
                 substr(text, prev + 1, t.start - prev) AS piece
               FROM (SELECT *, coalesce(lag(finish) OVER (PARTITION BY doc_id ORDER BY start), 0)
                       AS prev FROM tokens_kept) t JOIN content USING (doc_id))
         GROUP BY doc_id) r USING (doc_id)""",
)
VIEWS["entropy_words"] = (
    ["pattern_text"],
    f"""SELECT doc_id, line_number, value,
          row_number() OVER (PARTITION BY doc_id ORDER BY line_number, pos) AS i
        FROM (SELECT doc_id, line_number, unnest(words) AS value, unnest(range(len(words))) AS pos
              FROM (SELECT doc_id, line_number,
                      regexp_extract_all(line, {quote(fv.ENTROPY_WORD)}) AS words
                    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                            unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number
                          FROM pattern_text)))
        WHERE (SELECT -sum(n / length(value) * log2(n / length(value)))
               FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(value, '')) AS c)
                     GROUP BY c)) >= {fv.ENTROPY_THRESHOLD}""",
)
VIEWS["entropy_items"] = (
    ["entropy_words"],
    """SELECT e.doc_id, CAST(e.line_number AS INTEGER) AS line_number, e.value, e.i,
         CAST(length(e.value) AS INTEGER) AS original_length,
         '[REDACTED_SECRET_' || (coalesce(s.n, 0) + e.i) || ']' AS token
       FROM entropy_words e LEFT JOIN (
         SELECT doc_id, count(*) AS n FROM tokens_kept WHERE type = 'secret' GROUP BY doc_id) s
       USING (doc_id)""",
)
VIEWS["rewrite"] = (
    ["pattern_text", "entropy_items"],
    """SELECT doc_id, CAST(0 AS BIGINT) AS i, text FROM pattern_text
       UNION ALL
       SELECT r.doc_id, e.i, left(r.text, instr(r.text, e.value) - 1) || e.token
                || substr(r.text, instr(r.text, e.value) + length(e.value))
       FROM rewrite r JOIN entropy_items e ON e.doc_id = r.doc_id AND e.i = r.i + 1""",
)
_SECRET_LIST = ", ".join(quote(t) for t in fv.SECRET_TYPES)
VIEWS["summary"] = (
    ["tokens_kept", "entropy_items"],
    f"""SELECT c.doc_id, CAST(count(t.type) AS INTEGER) AS redacted_count,
          coalesce(bool_or(t.type NOT IN ({_SECRET_LIST})), FALSE) AS pii_detected,
          coalesce(bool_or(t.type IN ({_SECRET_LIST})), FALSE) AS secrets_detected
        FROM content c LEFT JOIN (SELECT doc_id, type FROM tokens_kept
          UNION ALL SELECT doc_id, 'secret' FROM entropy_items) t USING (doc_id)
        GROUP BY c.doc_id""",
)

_VALUES = ", ".join(
    f"({i}, '{kind}', '{severity}', {quote(fv.INJECTION_DESCRIPTIONS[kind])})"
    for i, (kind, _, severity) in enumerate(fv.INJECTION_PATTERNS)
)
_LINE_HITS = " UNION ALL ".join(
    f"""SELECT doc_id, line_number, {i} AS ordinal, unnest(m) AS value, unnest(range(len(m))) AS pos
        FROM (SELECT doc_id, line_number, regexp_extract_all(line, {quote(p)}) AS m FROM lines
              WHERE regexp_matches(line, {quote(p)}))"""
    for i, (_, p, _) in enumerate(fv.INJECTION_PATTERNS)
)
VIEWS["lines"] = (
    ["content"],
    """SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number FROM content""",
)
VIEWS["injections"] = (
    ["lines"],
    f"""SELECT h.*, p.type, p.severity, p.description FROM ({_LINE_HITS}) h
        JOIN (VALUES {_VALUES}) p(ordinal, type, severity, description) USING (ordinal)""",
)
VIEWS["injection_flag_rows"] = (
    ["injections"],
    """SELECT doc_id, ordinal, '⚠️ ' || upper(severity) || ': ' || description
         || ' (line ' || line_number || ')' AS flag
       FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type
               ORDER BY ordinal, line_number, pos) AS k
             FROM injections WHERE severity <> 'low')
       WHERE k = 1""",
)


def _any_sql(patterns: list[str]) -> str:
    return " OR ".join(f"regexp_matches(text, {quote(p)})" for p in patterns)


_MEDIUM = [p for _, p, s in fv.INJECTION_PATTERNS if s != "low"]
_LEVELS = " UNION ALL ".join(
    f"SELECT '{level}' AS sensitivity, '{s}' AS severity"
    for level, severities in fv.SENSITIVITY_LEVELS.items()
    for s in severities
)
VIEWS["gate"] = (["hits"], "SELECT DISTINCT doc_id FROM hits")
VIEWS["scan_flags"] = (
    ["summary", "gate", "injection_flag_rows"],
    f"""SELECT c.doc_id, c.source, list_concat(
          CASE WHEN g.doc_id IS NOT NULL AND s.secrets_detected
               THEN [{quote(fv.SECRETS_FLAG)}] ELSE [] END,
          CASE WHEN g.doc_id IS NOT NULL AND s.pii_detected
               THEN [{quote(fv.PII_FLAG)}] ELSE [] END,
          coalesce(f.flags, [])) AS flags
        FROM content c JOIN summary s USING (doc_id) LEFT JOIN gate g USING (doc_id)
        LEFT JOIN (SELECT doc_id, list(flag ORDER BY ordinal) AS flags
                   FROM injection_flag_rows GROUP BY doc_id) f USING (doc_id)""",
)

ORACLE = {
    "sensitive_quick_filter": with_views(
        ["hits"], "SELECT DISTINCT doc_id, source FROM hits JOIN content USING (doc_id)"
    ),
    "sensitive_findings": with_views(["hits"], "SELECT * FROM hits"),
    "sensitive_spans_resolved": with_views(
        ["kept"], "SELECT * EXCLUDE (rn) FROM kept", recursive=True
    ),
    "redacted_items": with_views(
        ["tokens_kept", "entropy_items"],
        """SELECT doc_id, CAST(n AS INTEGER) AS n, type, line_number, original_length, token
           FROM tokens_kept
           UNION ALL
           SELECT e.doc_id, CAST(coalesce(k.n, 0) + i - 1 AS INTEGER), 'secret', line_number,
             original_length, token
           FROM entropy_items e LEFT JOIN (
             SELECT doc_id, count(*) AS n FROM tokens_kept GROUP BY doc_id) k USING (doc_id)""",
        recursive=True,
    ),
    "redacted_corpus": with_views(
        ["rewrite"],
        "SELECT doc_id, max_by(text, i) AS sanitized_text FROM rewrite GROUP BY doc_id",
        recursive=True,
    ),
    "high_entropy_secrets": with_views(
        ["entropy_items"],
        "SELECT doc_id, line_number, original_length, value, token FROM entropy_items",
        recursive=True,
    ),
    "sanitization_summary": with_views(["summary"], "SELECT * FROM summary", recursive=True),
    "sensitive_report": with_views(
        ["tokens_kept", "entropy_items"],
        """SELECT source, type, count(*) AS findings, count(DISTINCT doc_id) AS texts
           FROM (SELECT doc_id, type FROM tokens_kept
                 UNION ALL SELECT doc_id, 'secret' FROM entropy_items)
           JOIN content USING (doc_id) GROUP BY ROLLUP (source, type)""",
        recursive=True,
    ),
    "injection_findings": with_views(
        ["injections"],
        """SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, type, severity,
             CAST(line_number AS INTEGER) AS line_number,
             CASE WHEN length(value) > 50 THEN left(value, 50) || '...' ELSE value END
               AS matched_text, description
           FROM injections""",
    ),
    "injection_by_sensitivity": with_views(
        ["injections"],
        f"""SELECT sensitivity, source, type, count(*) AS findings
            FROM injections JOIN ({_LEVELS}) l USING (severity) JOIN content USING (doc_id)
            GROUP BY sensitivity, source, type""",
    ),
    "injection_risk": with_views(
        ["injections"],
        """SELECT doc_id, count(severity) = 0 AS is_safe,
             CAST(count(severity) AS INTEGER) AS injection_count,
             round(least(1.0::DOUBLE, coalesce(sum(CASE severity WHEN 'high' THEN 1.0::DOUBLE
               WHEN 'medium' THEN 0.5::DOUBLE END), 0) / 3), 6) AS risk_score
           FROM content LEFT JOIN (SELECT * FROM injections WHERE severity <> 'low')
             USING (doc_id) GROUP BY doc_id""",
    ),
    "injection_quick_filter": with_views(
        ["content"], f"SELECT doc_id FROM content WHERE {_any_sql(_MEDIUM)}"
    ),
    "injection_flags": with_views(
        ["injection_flag_rows"],
        """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1
             AS INTEGER) AS n, flag FROM injection_flag_rows""",
    ),
    "security_scan": with_views(
        ["scan_flags"],
        """SELECT doc_id, CAST(len(flags) AS INTEGER) AS flag_count,
             array_to_string(flags, '|') AS security_flags FROM scan_flags""",
        recursive=True,
    ),
}
