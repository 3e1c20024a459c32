"""The commit index: projection, full and incremental builds, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.regex import stripped
from driftline.functions.terms import VECTOR, Vocabulary
from driftline.operators import vocabulary as voc

_SALTS = 64


def projection(
    history: DataFrame, message_chars: int | None = None, max_files: int | None = None
) -> DataFrame:
    """History rows (sha, message, author, committed_at, files, ...) as index rows.

    Messages and file lists are whole unless a limit is asked for.
    """
    message = stripped(F.col("message"))
    return history.select(
        F.left("sha", F.lit(fv.HASH_CHARS)).alias("commit_hash"),
        (message if message_chars is None else F.left(message, F.lit(message_chars))).alias("message"),
        F.coalesce("author", F.lit(fv.UNKNOWN_AUTHOR)).alias("author"),
        F.timestamp_seconds("committed_at").alias("ts"),
        F.col("files") if max_files is None else F.slice("files", 1, max_files).alias("files"),
        F.format_string(
            "+%d/-%d",
            F.coalesce("insertions", F.lit(0)),
            F.coalesce("deletions", F.lit(0)),
        ).alias("diff_summary"),
        "repo",
    )


def index_text() -> Column:
    """What is indexed of a commit: its message and file names."""
    return F.concat(F.col("message"), F.lit(" "), F.array_join("files", " "))


def newest_per_repo(commits: DataFrame, max_commits: int | None) -> DataFrame:
    """The newest ``max_commits`` of every repository; all of them for None.

    Only keys are ranked, a repository in ``_SALTS`` parts first, so no task gets
    more than that many times ``max_commits`` keys of one repository.
    """
    if max_commits is None:
        return commits
    newest = [F.desc("ts"), F.asc("commit_hash")]
    salt = F.pmod(F.xxhash64("commit_hash"), F.lit(_SALTS))
    keys = commits.select("repo", "ts", "commit_hash", salt.alias("__salt"))
    for part in (["repo", "__salt"], ["repo"]):
        place = F.row_number().over(Window.partitionBy(*part).orderBy(*newest))
        keys = keys.withColumn("__rn", place).filter(F.col("__rn") <= max_commits).drop("__rn")
    same = [commits[c].eqNullSafe(keys[c]) for c in ("repo", "ts", "commit_hash")]
    return commits.join(keys, same, "left_semi")


def latest(rows: DataFrame, order: Column) -> DataFrame:
    """One row per commit hash, the one last in ``order``; last write wins."""
    rest = [c for c in rows.columns if c != "commit_hash"]
    kept = rows.groupBy("commit_hash").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return kept.select("commit_hash", *[f"r.{c}" for c in rest])


def newest_first() -> Column:
    """A number that orders commits: time in seconds, newest first, then the hash."""
    number = lambda c: c.cast("decimal(38,0)")
    return number(-F.unix_timestamp("ts")) * number(F.lit(16**fv.HASH_CHARS)) + number(F.conv("commit_hash", 16, 10))


def fit(commits: DataFrame, size: int = fv.VOCABULARY_SIZE) -> DataFrame:
    """Vocabulary of a set of commits, newest commit first."""
    return voc.fit(commits.withColumn("text", index_text()), newest_first(), size=size)


def vectorise(commits: DataFrame, vocabulary: Vocabulary | None) -> DataFrame:
    """Add vectors; NULL vectors while no vocabulary has been fitted."""
    if vocabulary is None:
        return commits.withColumn("vector", F.lit(None).cast(VECTOR))
    return commits.withColumn("vector", vocabulary.vector(index_text()))


def index_full(
    history: DataFrame,
    vocabulary: Vocabulary | None = None,
    existing: DataFrame | None = None,
    max_commits: int | None = None,
) -> DataFrame:
    """Index the newest commits of every repository over an existing index.

    A vocabulary passed in is kept as it is (it is fitted once, ever); without
    one it is fitted on this batch. A commit found in several repositories keeps
    the row of the last repository by name.
    """
    batch = newest_per_repo(projection(history), max_commits)
    if vocabulary is None:
        vocabulary = voc.freeze(fit(batch))
    new = vectorise(latest(batch, F.struct("repo", "ts")), vocabulary)
    if existing is None:
        return new
    both = existing.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)))
    return latest(both, F.col("__batch")).drop("__batch")


def index_incremental(
    history: DataFrame,
    existing: DataFrame,
    vocabulary: Vocabulary | None = None,
    max_commits: int | None = None,
) -> DataFrame:
    """The commits to append: those that the index lacks or holds without a vector.

    Without a vocabulary one is fitted on these commits, as on a first run.
    """
    batch = newest_per_repo(projection(history), max_commits)
    known = existing.filter(F.col("vector").isNotNull()) if "vector" in existing.columns else existing
    new = batch.join(known.select("commit_hash"), "commit_hash", "left_anti")
    new = latest(new, F.struct("repo", "ts"))
    return vectorise(new, vocabulary or voc.freeze(fit(new)))


def index_single(commit: DataFrame, existing: DataFrame, vocabulary: Vocabulary | None) -> DataFrame:
    """One commit, if the index lacks it; its vector is NULL while no vocabulary is fitted."""
    new = projection(commit).join(existing.select("commit_hash"), "commit_hash", "left_anti")
    return vectorise(new, vocabulary)


def incremental_stats(
    history: DataFrame, existing: DataFrame, max_commits: int | None = None
) -> DataFrame:
    """Per repository, how many of the newest commits are new or skipped."""
    batch = newest_per_repo(projection(history), max_commits)
    known = existing.select("commit_hash", F.lit(True).alias("known")).distinct()
    seen = batch.join(known, "commit_hash", "left")
    return seen.groupBy("repo").agg(
        F.count_if(F.col("known").isNull()).alias("indexed_count"),
        F.count_if(F.col("known")).alias("skipped_count"),
    )


def recent_commits(index: DataFrame, repo: str | None = None, limit: int = 100) -> DataFrame:
    """Newest commits first."""
    rows = index if repo is None else index.filter(F.col("repo") == repo)
    return rows.orderBy(F.desc("ts"), "commit_hash").limit(limit)


def indexed_count(index: DataFrame) -> DataFrame:
    """Commits per repository."""
    return index.groupBy("repo").agg(F.count("*").alias("commits"))


def last_indexed(index: DataFrame) -> DataFrame:
    """Newest commit hash per repository; of equal times the first by hash, as in recent_commits."""
    return index.groupBy("repo").agg(
        F.min_by("commit_hash", F.struct(-F.unix_micros("ts"), "commit_hash")).alias("commit_hash")
    )


def is_indexed(hashes: DataFrame, index: DataFrame, sha: str = "sha") -> DataFrame:
    """The given hashes that are in the index, compared by their first characters."""
    short = F.left(sha, F.lit(fv.HASH_CHARS))
    return hashes.join(index.select("commit_hash"), short == F.col("commit_hash"), "left_semi")
