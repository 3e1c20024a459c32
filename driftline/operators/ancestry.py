"""Reachability in commit graphs of any depth.

A commit has one first parent, so following first parents is a chain: chains are
closed with jump tables whose reach grows fourfold per round, in log4(depth)
rounds. Other parents (merges) add new starting points, so the whole closure takes
as many passes as merges are nested, not as many as there are commits. All joins are on (repo, commit), so a very
large repository spreads like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import materialise


_LEVELS_PER_PLAN = 4


def _jump_tables(edges: DataFrame) -> list[DataFrame]:
    """Per k, each commit's ancestors 4**k, 2 * 4**k and 3 * 4**k first parents away."""
    step = edges.filter(F.col("parent_no") == 1).select(
        "repo", F.col("child").alias("commit"), F.col("parent").alias("up1")
    )
    tables = []
    while True:
        wide = step
        for n in (1, 2, 3):
            onward = step.select(
                "repo", F.col("commit").alias(f"up{n}"), F.col("up1").alias(f"up{n + 1}")
            )
            wide = wide.join(onward, ["repo", f"up{n}"], "left")
        wide = materialise(wide, "jumps")
        tables.append(wide.select("repo", "commit", "up1", "up2", "up3"))
        step = wide.filter(F.col("up4").isNotNull()).select(
            "repo", "commit", F.col("up4").alias("up1")
        )
        if step.isEmpty():
            return tables


def _follow(frontier: DataFrame, jumps: DataFrame) -> DataFrame:
    """The frontier and where the jumps lead from it."""
    reached = F.array_compact(F.array("commit", "up1", "up2", "up3"))
    joined = frontier.join(jumps, ["repo", "commit"], "left")
    return joined.select("repo", "label", F.explode(reached).alias("commit")).distinct()


def ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All (repo, label, commit) reachable from the seeds, seeds included.

    ``edges`` has repo, child, parent and parent_no (1 for the first parent);
    ``seeds`` has repo, label and commit.
    """
    key = ["repo", "label", "commit"]
    tables = _jump_tables(edges)
    merges = edges.filter(F.col("parent_no") > 1).select(
        "repo", F.col("child").alias("commit"), "parent"
    )
    linear = merges.isEmpty()
    frontier = seeds.select(*key).distinct()
    marked = None
    while True:
        for level, jumps in enumerate(tables, 1):
            # after level k every ancestor fewer than 4**k steps away is in
            frontier = _follow(frontier, jumps)
            if level % _LEVELS_PER_PLAN == 0:
                frontier = materialise(frontier, "reached")
        marked = frontier if marked is None else marked.unionByName(frontier).distinct()
        marked = materialise(marked, "marked")
        if linear:
            return marked
        found = marked.join(merges, ["repo", "commit"]).select(
            "repo", "label", F.col("parent").alias("commit")
        )
        frontier = materialise(found.distinct().join(marked, key, "left_anti"), "frontier")
        if frontier.isEmpty():
            return marked


def commits_behind_main(
    heads: DataFrame, refs: DataFrame, edges: DataFrame, commits: DataFrame
) -> DataFrame:
    """Per repository, commits on main (or master) after the merge base.

    ``heads`` has repo and branch_name, ``refs`` repo, name and tip, ``commits``
    repo, commit and ts. On main itself, without a main branch and without a
    common ancestor the count is 0.
    """
    tips = refs.select("repo", "name", "tip")
    mains = (
        tips.filter(F.col("name").isin("main", "master"))
        .groupBy("repo")
        .agg(F.min(F.struct("name", "tip")).alias("m"))  # "main" sorts before "master"
        .select("repo", F.col("m.name").alias("main_name"), F.col("m.tip").alias("main_tip"))
    )
    pairs = (
        heads.join(mains, "repo")
        .filter(F.col("branch_name") != F.col("main_name"))
        .join(tips.withColumnRenamed("name", "branch_name"), ["repo", "branch_name"])
    )
    seeds = pairs.select(
        "repo",
        F.explode(
            F.array(
                F.struct(F.lit("main").alias("label"), F.col("main_tip").alias("commit")),
                F.struct(F.lit("branch").alias("label"), F.col("tip").alias("commit")),
            )
        ).alias("s"),
    ).select("repo", "s.label", "s.commit")
    # only repositories that are off their main branch have anything to follow
    edges = edges.join(pairs.select("repo").distinct(), "repo", "left_semi")
    reached = (
        ancestors(edges, seeds)
        .groupBy("repo", "commit")
        .agg(
            F.bool_or(F.col("label") == "main").alias("on_main"),
            F.bool_or(F.col("label") == "branch").alias("on_branch"),
        )
    )
    common = reached.filter("on_main AND on_branch").select("repo", "commit")
    below = edges.join(
        common.withColumnRenamed("commit", "child"), ["repo", "child"], "left_semi"
    ).select("repo", F.col("parent").alias("commit"))
    # merge bases: common ancestors that no other common ancestor descends to
    bases = materialise(common.join(below, ["repo", "commit"], "left_anti"), "bases")
    counts = (
        reached.filter("on_main AND NOT on_branch").groupBy("repo").agg(F.count("*").alias("n"))
    )
    found = bases.groupBy("repo").agg(F.count("*").alias("bases"))
    several = found.filter("bases > 1").select("repo")
    if not several.isEmpty():
        # criss-cross merges: count from the newest base alone
        newest = (
            bases.join(several, "repo", "left_semi")
            .join(commits.select("repo", "commit", "ts"), ["repo", "commit"])
            .groupBy("repo")
            .agg(F.max_by("commit", F.struct("ts", "commit")).alias("commit"))
        )
        under = ancestors(edges, newest.withColumn("label", F.lit("base")))
        over = (
            reached.filter("on_main")
            .join(several, "repo", "left_semi")
            .join(under.select("repo", "commit"), ["repo", "commit"], "left_anti")
            .groupBy("repo")
            .agg(F.count("*").alias("n"))
        )
        counts = counts.join(several, "repo", "left_anti").unionByName(over)
    return (
        heads.select("repo")
        .join(found, "repo", "left")
        .join(counts, "repo", "left")
        .select(
            "repo",
            F.when(F.col("bases") >= 1, F.coalesce("n", F.lit(0)))
            .otherwise(0)
            .cast("int")
            .alias("behind_main_by_commits"),
        )
    )
