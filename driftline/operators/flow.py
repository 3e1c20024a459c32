"""Flow health of a fleet of repositories.

Inputs are tables about many repositories; the moment of observation is always a
parameter. Large inputs (changes, commits) are aggregated before they meet the
one-row-per-repository tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.globs import ignore_regex
from driftline.functions.joins import measured, salted_left_join
from driftline.operators.ancestry import commits_behind_main

METRICS = [
    "minutes_since_last_commit",
    "uncommitted_lines",
    "uncommitted_files",
    "branch_age_days",
    "behind_main_by_commits",
]


def _seconds_before(as_of: str, ts: str) -> Column:
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    micros = at(F.lit(as_of)) - at(F.col(ts))
    return micros / 1_000_000


def current_branches(repos: DataFrame, heads: DataFrame) -> DataFrame:
    """Active branch per repository, HEAD when detached."""
    return repos.join(heads, "repo", "left").select(
        "repo", F.coalesce("branch_name", F.lit("HEAD")).alias("branch_name")
    )


def minutes_since_commit(heads: DataFrame, commits: DataFrame, as_of: str) -> DataFrame:
    """Whole minutes since the checked-out commit, on a branch or not; 0 without one."""
    at_head = (
        heads.select("repo", "commit")
        .join(commits.select("repo", "commit", "ts"), ["repo", "commit"])
        .select("repo", (_seconds_before(as_of, "ts") / 60).cast("int").alias("minutes"))
    )
    return heads.join(at_head, "repo", "left").select(
        "repo", F.coalesce("minutes", F.lit(0)).alias("minutes_since_last_commit")
    )


def branch_age_days(
    heads: DataFrame, commits: DataFrame, as_of: str, mode: str = "first"
) -> DataFrame:
    """Whole days since the first commit of the active branch.

    ``mode="head"`` measures from its newest commit instead.
    """
    pick = F.max if mode == "head" else F.min
    ends = commits.groupBy("repo", F.col("branch").alias("branch_name")).agg(pick("ts").alias("ts"))
    days = F.greatest(F.lit(0), F.floor(_seconds_before(as_of, "ts") / 86400)).cast("int")
    return heads.join(ends, ["repo", "branch_name"], "left").select(
        "repo", F.coalesce(days, F.lit(0)).alias("branch_age_days")
    )


def without_ignored(changes: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """Changes whose path no pattern of the repository's ignore file matches."""
    patterns = ignore_files.select("repo", ignore_regex(F.col("content")).alias("__ignored"))
    patterns = patterns.filter(F.col("__ignored").isNotNull())
    joined = salted_left_join(changes, patterns, ["repo"], ["path"])
    kept = F.col("__ignored").isNull() | ~F.regexp_like("path", F.col("__ignored"))
    return joined.filter(kept).drop("__ignored")


def uncommitted_stats(changes: DataFrame) -> DataFrame:
    """Changed files and changed lines per repository; untracked files add no lines."""
    lines = F.when(F.col("kind") != "untracked", F.col("insertions") + F.col("deletions"))
    return changes.groupBy("repo").agg(
        F.countDistinct("path").cast("int").alias("uncommitted_files"),
        F.coalesce(F.sum(lines), F.lit(0)).cast("bigint").alias("uncommitted_lines"),
    )


def lines_from_stat_log(stats: DataFrame, stat: str = "stat") -> DataFrame:
    """Total lines per repository from short diff statistics in words."""
    part = lambda word: F.coalesce(
        F.regexp_extract(stat, rf"([0-9]+) {word}", 1).try_cast("int"), F.lit(0)
    )
    return stats.groupBy("repo").agg(
        F.sum(part("insertion") + part("deletion")).alias("uncommitted_lines")
    )


def repo_metrics(
    repos: DataFrame,
    heads: DataFrame,
    refs: DataFrame,
    commits: DataFrame,
    edges: DataFrame,
    changes: DataFrame,
    ignore_files: DataFrame,
    as_of: str,
) -> DataFrame:
    """One row per repository with its branch and all five metrics."""
    rows = current_branches(repos, heads)
    for part in (
        minutes_since_commit(heads, commits, as_of),
        uncommitted_stats(without_ignored(changes, ignore_files)),
        branch_age_days(heads, commits, as_of),
        commits_behind_main(heads, refs, edges, commits),
    ):
        rows = rows.join(part, "repo", "left")
    return rows.select(
        "repo", "branch_name", *[F.coalesce(m, F.lit(0)).alias(m) for m in METRICS]
    )


def status(
    minutes: Column, lines: Column, max_minutes: Column, max_lines: Column
) -> Column:
    """danger above 1.5 times a threshold, warning above it, else ok."""
    over = lambda factor: (
        (minutes > max_minutes * factor) | (lines > max_lines * factor)
    )
    return F.when(over(fv.DANGER_FACTOR), "danger").when(over(1.0), "warning").otherwise("ok")


def recommendations(max_minutes: Column, max_lines: Column) -> Column:
    """Nudges in a fixed order, or the one saying that all is well."""
    minutes, lines = F.col("minutes_since_last_commit"), F.col("uncommitted_lines")
    hours = F.floor(minutes / 60).cast("int")
    spent = F.when(hours > 0, F.format_string("%dh %dm", hours, minutes % 60)).otherwise(
        F.format_string("%d minutes", minutes % 60)
    )
    say = lambda text, *args: F.format_string(text, *args) if args else F.lit(text)
    nudges = F.array_compact(
        F.array(
            F.when(minutes > max_minutes, say(fv.NUDGE_TIME, spent)),
            F.when(lines > max_lines, say(fv.NUDGE_LINES, lines)),
            F.when(lines > max_lines * 2, say(fv.NUDGE_VERY_LARGE)),
            F.when(F.col("uncommitted_files") > 10, say(fv.NUDGE_FILES, F.col("uncommitted_files"))),
            F.when(F.col("branch_age_days") > 7, say(fv.NUDGE_AGE, F.col("branch_age_days"))),
            F.when(
                F.col("behind_main_by_commits") > 10,
                say(fv.NUDGE_BEHIND, F.col("behind_main_by_commits")),
            ),
        )
    )
    return F.when(F.size(nudges) == 0, F.array(F.lit(fv.NUDGE_HEALTHY))).otherwise(nudges)


def _limits() -> tuple[Column, Column]:
    return (
        F.coalesce(fv.CONFIG_KEYS[0], F.lit(float(fv.DEFAULT_MAX_MINUTES))),
        F.coalesce(fv.CONFIG_KEYS[1], F.lit(float(fv.DEFAULT_MAX_LINES))),
    )


def flow_state(metrics: DataFrame, thresholds: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Metrics, status, recommendations and security flags per repository.

    ``flags`` has repo and security_flags, at most one row per repository.
    """
    limits = _limits()
    rows = metrics.join(measured(thresholds), "repo", "left")
    none = F.array().cast("array<string>")
    if flags is None:
        rows = rows.withColumn("security_flags", none)
    else:
        rows = rows.join(measured(flags.select("repo", "security_flags"), "repo"), "repo", "left")
    rows = rows.withColumns(
        {
            "status": status(
                F.col("minutes_since_last_commit"), F.col("uncommitted_lines"), *limits
            ),
            "recommendations": recommendations(*limits),
            "security_flags": F.coalesce("security_flags", none),
        }
    )
    return rows.select("repo", "branch_name", *METRICS, "status", "recommendations", "security_flags")


def secure_recommendations(states: DataFrame) -> DataFrame:
    """Recommendations with the security line in front, and a summary struct."""
    first = F.when(F.size("security_flags") > 0, F.array(F.lit(fv.NUDGE_SECURITY)))
    return states.select(
        "repo",
        F.concat(F.coalesce(first, F.array().cast("array<string>")), "recommendations").alias(
            "recommendations"
        ),
        "status",
        "security_flags",
        F.struct(
            "minutes_since_last_commit", "uncommitted_lines", "uncommitted_files", "branch_name"
        ).alias("summary"),
    )


def health_gate(states: DataFrame) -> DataFrame:
    """Exit code per repository: 2 security, 1 warning or danger, 0 ok, 3 unknown."""
    code = (
        F.when(F.size("security_flags") > 0, 2)
        .when(F.col("status").isin("warning", "danger"), 1)
        .when(F.col("status") == "ok", 0)
        .otherwise(3)
    )
    return states.select("repo", code.alias("exit_code"))
