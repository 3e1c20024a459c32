"""Queries over flow health and settings, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.operators import ancestry, audit, flow, ignore_rules, injection, settings
from driftline.plans.guardian import ORACLE as _  # noqa: F401  registers the scan views
from driftline.plans.views import VIEWS, quote, with_views
from driftline.session import materialise
from driftline.sources import derived as src


def _history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    commits = materialise(src.history(spark, sf), "history")
    refs = src.refs(commits)
    return commits, src.commit_parents(commits), refs, src.heads(refs)


def minutes_since_commit(spark: SparkSession, sf: str) -> DataFrame:
    commits, _, _, heads = _history(spark, sf)
    return flow.minutes_since_commit(heads, commits, src.AS_OF)


def branch_age_days(spark: SparkSession, sf: str) -> DataFrame:
    commits, _, _, heads = _history(spark, sf)
    return flow.branch_age_days(heads, commits, src.AS_OF)


def branch_age_days_head(spark: SparkSession, sf: str) -> DataFrame:
    commits, _, _, heads = _history(spark, sf)
    return flow.branch_age_days(heads, commits, src.AS_OF, mode="head")


def commits_behind_main(spark: SparkSession, sf: str) -> DataFrame:
    commits, edges, refs, heads = _history(spark, sf)
    return ancestry.commits_behind_main(heads, refs, edges, commits)


def uncommitted_stats(spark: SparkSession, sf: str) -> DataFrame:
    return flow.uncommitted_stats(src.worktree_changes(spark, sf))


def lines_from_stat_log(spark: SparkSession, sf: str) -> DataFrame:
    return flow.lines_from_stat_log(src.stat_log(spark, sf))


def ignore_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = flow.without_ignored(src.worktree_changes(spark, sf), src.ignore_files(spark, sf))
    return kept.select("repo", "path", "kind", "insertions", "deletions")


def ignore_filter_many(spark: SparkSession, sf: str) -> DataFrame:
    """Hundreds of patterns and more in each of some repositories."""
    changes = src.worktree_changes(spark, sf)
    kept = ignore_rules.without_matches(changes, src.many_ignore_patterns(spark, sf))
    return kept.select("repo", "path", "kind", "insertions", "deletions")


def effective_config(spark: SparkSession, sf: str) -> DataFrame:
    return settings.effective_config(
        src.repos(spark, sf), src.config_files(spark, sf), src.GLOBAL_CONFIG
    )


def config_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return settings.config_warnings(src.config_files(spark, sf), src.GLOBAL_CONFIG)


def config_updates(spark: SparkSession, sf: str) -> DataFrame:
    current = settings.thresholds(effective_config(spark, sf))
    return settings.config_updates(src.config_requests(spark, sf), current)


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    commits, edges, refs, heads = _history(spark, sf)
    return flow.repo_metrics(
        src.repos(spark, sf),
        heads,
        refs,
        commits,
        edges,
        src.worktree_changes(spark, sf),
        src.ignore_files(spark, sf),
        src.AS_OF,
    )


def repo_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


def _states(spark: SparkSession, sf: str) -> DataFrame:
    flags = injection.with_security_flags(src.repo_diffs(spark, sf))
    limits = settings.thresholds(effective_config(spark, sf))
    return flow.flow_state(_metrics(spark, sf), limits, flags)


def flow_status(spark: SparkSession, sf: str) -> DataFrame:
    limits = settings.thresholds(effective_config(spark, sf))
    return flow.flow_state(_metrics(spark, sf), limits).select("repo", "status")


def flow_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Flow states as span attributes, one row each."""
    limits = settings.thresholds(effective_config(spark, sf))
    spans = audit.flow_attributes(flow.flow_state(_metrics(spark, sf), limits))
    return spans.select("repo", F.explode("attributes").alias("attribute", "value"))


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    limits = settings.thresholds(effective_config(spark, sf))
    states = flow.flow_state(_metrics(spark, sf), limits)
    return states.select("repo", F.array_join("recommendations", "|").alias("recommendations"))


def flow_state(spark: SparkSession, sf: str) -> DataFrame:
    states = _states(spark, sf)
    return states.drop("recommendations").withColumn(
        "security_flags", F.array_join("security_flags", "|")
    )


def health_gate(spark: SparkSession, sf: str) -> DataFrame:
    return flow.health_gate(_states(spark, sf))


def recommendations_secure(spark: SparkSession, sf: str) -> DataFrame:
    return flow.secure_recommendations(_states(spark, sf)).select(
        "repo",
        F.array_join("recommendations", "|").alias("recommendations"),
        "status",
        F.size("security_flags").alias("flag_count"),
        "summary.branch_name",
    )


QUERIES = {
    f.__name__: f
    for f in (
        minutes_since_commit,
        branch_age_days,
        branch_age_days_head,
        commits_behind_main,
        uncommitted_stats,
        lines_from_stat_log,
        ignore_filter,
        ignore_filter_many,
        repo_metrics,
        flow_status,
        flow_attributes,
        recommendations,
        flow_state,
        effective_config,
        config_warnings,
        config_updates,
        health_gate,
        recommendations_secure,
    )
}

# --- SQL checks -----------------------------------------------------------------

VIEWS["lined_orders"] = (
    [],
    """SELECT *, CASE WHEN o_orderkey % 3 = 0 AND rn > 1 THEN 'feature' ELSE 'main' END AS line
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
               ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)""",
)
VIEWS["history"] = (
    ["lined_orders"],
    """SELECT repo, commit, branch, ts, rn, CASE WHEN branch = 'main' THEN last_main
         ELSE coalesce(last_feature, last_main) END AS parent
       FROM (SELECT o_custkey AS repo, o_orderkey AS commit, line AS branch, o_orderdate AS ts, rn,
               max(CASE WHEN line = 'main' THEN rn * 100000000 + o_orderkey END) OVER w % 100000000
                 AS last_main,
               max(CASE WHEN line = 'feature' THEN rn * 100000000 + o_orderkey END) OVER w
                 % 100000000 AS last_feature
             FROM lined_orders WINDOW w AS (PARTITION BY o_custkey ORDER BY rn
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
VIEWS["tips"] = (
    ["history"],
    "SELECT repo, branch, max_by(commit, rn) AS tip FROM history GROUP BY repo, branch",
)
VIEWS["active"] = (
    ["tips"],
    """SELECT repo, CASE WHEN repo % 17 <> 3 THEN branch END AS branch, tip FROM tips
       QUALIFY row_number() OVER (PARTITION BY repo ORDER BY branch) = 1""",
)
_AS_OF = f"TIMESTAMP '{src.AS_OF}'"
VIEWS["minutes"] = (
    ["active", "history"],
    f"""SELECT a.repo, CAST(trunc(epoch({_AS_OF} - h.ts) / 60) AS INTEGER)
          AS minutes_since_last_commit
        FROM active a JOIN history h ON h.repo = a.repo AND h.commit = a.tip""",
)


def _age(pick: str) -> str:
    return f"""SELECT a.repo,
                 CAST(coalesce(greatest(0, floor(epoch({_AS_OF} - {pick}(h.ts)) / 86400)), 0) AS INTEGER)
                 AS branch_age_days
               FROM active a LEFT JOIN history h ON h.repo = a.repo AND h.branch = a.branch
               GROUP BY a.repo"""


VIEWS["age"] = (["active", "history"], _age("min"))
VIEWS["reach"] = (
    ["active", "history"],
    """SELECT t.repo, t.branch AS label, t.tip AS commit FROM tips t
       WHERE t.repo IN (SELECT repo FROM active WHERE branch = 'feature')
       UNION
       SELECT r.repo, r.label, h.parent FROM reach r JOIN history h
         ON h.repo = r.repo AND h.commit = r.commit WHERE h.parent IS NOT NULL""",
)
VIEWS["behind"] = (
    ["active", "reach"],
    """SELECT a.repo, CAST(coalesce(n, 0) AS INTEGER) AS behind_main_by_commits
       FROM active a LEFT JOIN (
         SELECT m.repo, count(*) AS n FROM reach m
         WHERE m.label = 'main' AND NOT EXISTS (SELECT 1 FROM reach f WHERE f.label = 'feature'
           AND f.repo = m.repo AND f.commit = m.commit) GROUP BY m.repo) USING (repo)""",
)
VIEWS["changes"] = (
    [],
    """SELECT o_custkey AS repo, 'p' || l_partkey || '.py' AS path,
         ['staged', 'unstaged', 'untracked'][l_linenumber % 3 + 1] AS kind,
         CAST(l_quantity AS INTEGER) AS insertions, l_linenumber AS deletions
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
VIEWS["ignores"] = (
    [],
    """SELECT repo, unnest(globs) AS glob FROM (
         SELECT c_custkey AS repo, CASE c_custkey % 4 WHEN 0 THEN ['p1*.py']
           WHEN 1 THEN ['p' || (c_custkey % 100) || '?.py', '*9.py']
           WHEN 2 THEN ['vendor/', 'p[2-4]*'] ELSE [] END AS globs FROM customer)""",
)
VIEWS["many_ignores"] = (
    [],
    """SELECT c_custkey AS repo, unnest(['p' || p_partkey || '.py', '*' || p_partkey || '7.py', 'p' || p_partkey || '0*',
         'p?' || p_partkey || '*y']) AS glob
       FROM customer JOIN part ON p_partkey % 7 = c_custkey % 7 WHERE c_custkey % 50 = 1""",
)
VIEWS["kept_changes"] = (
    ["changes", "ignores"],
    """SELECT * FROM changes c WHERE NOT EXISTS (
         SELECT 1 FROM ignores i WHERE i.repo = c.repo AND c.path GLOB i.glob)""",
)
_STATS = """SELECT repo, CAST(count(DISTINCT path) AS INTEGER) AS uncommitted_files,
  CAST(coalesce(sum(CASE WHEN kind <> 'untracked' THEN insertions + deletions END), 0) AS BIGINT)
    AS uncommitted_lines"""
VIEWS["metrics"] = (
    ["active", "minutes", "age", "behind", "kept_changes"],
    f"""SELECT c_custkey AS repo, coalesce(branch, 'HEAD') AS branch_name,
          coalesce(minutes_since_last_commit, 0) AS minutes_since_last_commit,
          coalesce(uncommitted_lines, 0) AS uncommitted_lines,
          coalesce(uncommitted_files, 0) AS uncommitted_files,
          coalesce(branch_age_days, 0) AS branch_age_days,
          coalesce(behind_main_by_commits, 0) AS behind_main_by_commits
        FROM customer LEFT JOIN active a ON a.repo = c_custkey
        LEFT JOIN minutes m ON m.repo = c_custkey LEFT JOIN age g ON g.repo = c_custkey
        LEFT JOIN behind b ON b.repo = c_custkey
        LEFT JOIN ({_STATS} FROM kept_changes GROUP BY repo) u ON u.repo = c_custkey""",
)
VIEWS["limits"] = (
    [],
    """SELECT c_custkey AS repo,
         CASE c_custkey % 5 WHEN 0 THEN 30 + c_custkey % 90 WHEN 2 THEN 45 ELSE 90 END AS mins,
         CASE c_custkey % 5 WHEN 1 THEN 100 + c_custkey % 900 WHEN 2 THEN 200 + c_custkey % 300
           ELSE 500 END AS lines FROM customer""",
)


def _nudge(text: str, *args: str) -> str:
    parts = [quote(t) for t in text.replace("%s", "%d").split("%d")]
    out = parts[0]
    for arg, part in zip(args, parts[1:]):
        out += f" || {arg} || {part}"
    return out


_SPENT = """CASE WHEN minutes_since_last_commit >= 60
  THEN (minutes_since_last_commit // 60) || 'h ' || (minutes_since_last_commit % 60) || 'm'
  ELSE (minutes_since_last_commit % 60) || ' minutes' END"""
VIEWS["states"] = (
    ["metrics", "limits"],
    f"""SELECT *, CASE
          WHEN minutes_since_last_commit > 1.5 * mins OR uncommitted_lines > 1.5 * lines THEN 'danger'
          WHEN minutes_since_last_commit > mins OR uncommitted_lines > lines THEN 'warning'
          ELSE 'ok' END AS status,
          coalesce(nullif(concat_ws('|',
            CASE WHEN minutes_since_last_commit > mins THEN {_nudge(fv.NUDGE_TIME, _SPENT)} END,
            CASE WHEN uncommitted_lines > lines
                 THEN {_nudge(fv.NUDGE_LINES, "uncommitted_lines")} END,
            CASE WHEN uncommitted_lines > 2 * lines THEN {quote(fv.NUDGE_VERY_LARGE)} END,
            CASE WHEN uncommitted_files > 10
                 THEN {_nudge(fv.NUDGE_FILES, "uncommitted_files")} END,
            CASE WHEN branch_age_days > 7 THEN {_nudge(fv.NUDGE_AGE, "branch_age_days")} END,
            CASE WHEN behind_main_by_commits > 10
                 THEN {_nudge(fv.NUDGE_BEHIND, "behind_main_by_commits")} END), ''),
            {quote(fv.NUDGE_HEALTHY)}) AS recommendations
        FROM metrics JOIN limits USING (repo)""",
)
VIEWS["flagged_states"] = (
    ["states", "scan_flags"],
    """SELECT s.*, coalesce(flags, []) AS flags FROM states s
       LEFT JOIN scan_flags f ON f.doc_id = s.repo""",
)
_METRIC_COLUMNS = "repo, branch_name, " + ", ".join(flow.METRICS)

ORACLE = {
    "minutes_since_commit": with_views(["minutes"], "SELECT * FROM minutes"),
    "branch_age_days": with_views(["age"], "SELECT * FROM age"),
    "branch_age_days_head": with_views(["active", "history"], _age("max")),
    "commits_behind_main": with_views(["behind"], "SELECT * FROM behind", recursive=True),
    "uncommitted_stats": with_views(["changes"], f"{_STATS} FROM changes GROUP BY repo"),
    "lines_from_stat_log": """SELECT l_suppkey AS repo, CAST(sum(CASE l_linenumber
        WHEN 1 THEN CAST(l_quantity AS INTEGER) WHEN 2 THEN l_linenumber WHEN 3 THEN 0
        ELSE CAST(l_quantity AS INTEGER) + l_linenumber END) AS BIGINT) AS uncommitted_lines
      FROM lineitem GROUP BY l_suppkey""",
    "ignore_filter_many": with_views(
        ["changes", "many_ignores"],
        """SELECT * FROM changes c WHERE NOT EXISTS (
             SELECT 1 FROM many_ignores i WHERE i.repo = c.repo AND c.path GLOB i.glob)""",
    ),
    "ignore_filter": with_views(["kept_changes"], "SELECT * FROM kept_changes"),
    "repo_metrics": with_views(["metrics"], f"SELECT {_METRIC_COLUMNS} FROM metrics", recursive=True),
    "flow_status": with_views(["states"], "SELECT repo, status FROM states", recursive=True),
    "flow_attributes": with_views(
        ["states"],
        """SELECT repo, 'flow.' || name AS attribute, value
           FROM (UNPIVOT (SELECT repo, status, CAST(minutes_since_last_commit AS VARCHAR) AS minutes_since_commit,
                            CAST(uncommitted_lines AS VARCHAR) AS uncommitted_lines FROM states)
                 ON status, minutes_since_commit, uncommitted_lines INTO NAME name VALUE value)""",
        recursive=True,
    ),
    "recommendations": with_views(
        ["states"], "SELECT repo, recommendations FROM states", recursive=True
    ),
    "flow_state": with_views(
        ["flagged_states"],
        f"""SELECT {_METRIC_COLUMNS}, status, array_to_string(flags, '|') AS security_flags
            FROM flagged_states""",
        recursive=True,
    ),
    "effective_config": """SELECT c_custkey AS repo, key,
        CASE key WHEN 'max_minutes_without_commit' THEN CAST(CASE c_custkey % 5
            WHEN 0 THEN 30 + c_custkey % 90 WHEN 2 THEN 45 ELSE 90 END AS VARCHAR)
          ELSE CAST(CASE c_custkey % 5 WHEN 1 THEN 100 + c_custkey % 900
            WHEN 2 THEN 200 + c_custkey % 300 ELSE 500 END AS VARCHAR) END AS value,
        CASE WHEN c_custkey % 5 = 2 OR (key = 'max_minutes_without_commit' AND c_custkey % 5 = 0)
            OR (key = 'max_lines_uncommitted' AND c_custkey % 5 = 1) THEN 'repo'
          WHEN key = 'max_minutes_without_commit' THEN 'global' ELSE 'default' END AS layer
      FROM customer, (VALUES ('max_minutes_without_commit'), ('max_lines_uncommitted')) k(key)""",
    "config_warnings": """SELECT c_custkey AS repo,
        'Repo config malformed (' || c_custkey || ')' AS warning
      FROM customer WHERE c_custkey % 5 = 3""",
    "config_updates": with_views(
        ["limits"],
        f"""SELECT repo, error IS NULL AS success, error,
              CASE WHEN error IS NULL THEN 'Updated ' || n || ' configuration value(s).' END
                AS message,
              CAST(CASE WHEN error IS NULL AND repo % 6 = 4 THEN 15 ELSE mins END AS DOUBLE)
                AS max_minutes_without_commit,
              CAST(CASE WHEN error IS NULL AND repo % 6 IN (0, 4) THEN repo ELSE lines END AS DOUBLE)
                AS max_lines_uncommitted
            FROM (SELECT *, CASE repo % 6 WHEN 4 THEN 2 ELSE 1 END AS n,
                CASE WHEN repo % 6 = 3 THEN {quote(fv.CONFIG_NO_KEYS)}
                  WHEN repo % 6 IN (1, 2)
                    THEN 'Invalid value for max_minutes_without_commit: must be a positive integer.'
                  WHEN repo % 6 = 5 OR repo = 0
                    THEN 'Invalid value for max_lines_uncommitted: must be a positive integer.'
                END AS error FROM limits)""",
    ),
    "health_gate": with_views(
        ["flagged_states"],
        """SELECT repo, CASE WHEN len(flags) > 0 THEN 2 WHEN status <> 'ok' THEN 1 ELSE 0 END
             AS exit_code FROM flagged_states""",
        recursive=True,
    ),
    "recommendations_secure": with_views(
        ["flagged_states"],
        f"""SELECT repo, CASE WHEN len(flags) > 0 THEN {quote(fv.NUDGE_SECURITY + '|')} ELSE '' END
              || recommendations AS recommendations, status,
              CAST(len(flags) AS INTEGER) AS flag_count, branch_name FROM flagged_states""",
        recursive=True,
    ),
}
