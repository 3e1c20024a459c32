"""Term statistics of the commit index, kept up to date by batches instead of fitted again.

Each batch stores what it says of each commit's terms (how often, and the first
place) and the statistics after it: those before, more what its commits bring,
less what the versions brought that they replace. Counts are plain differences.
A first place may leave with the commit that had it; only for such terms it is
looked for again among the stored rows of live commits. No text is read twice.
A batch that is run again after a failure replaces its own folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.arrays import explode_rows
from driftline.functions.joins import join_frequent
from driftline.functions.terms import term_places, tokens
from driftline.operators import commit_index, vocabulary

ROW = "commit_hash string, term string, n bigint, at decimal(38,0)"
STATE = "term string, n bigint, df bigint, first decimal(38,0)"
COMMITS = "commit_hash string"


def term_rows(commits: DataFrame) -> DataFrame:
    """How often each term of each commit occurs in it, and its first place in the order of all commits."""
    begin = vocabulary.places(commit_index.newest_first())
    keyed = commits.select("commit_hash", begin.alias("begin"), commit_index.index_text().alias("text"))
    rows = explode_rows(keyed, ["commit_hash", "begin"], term_places(tokens(F.col("text"))), "t")
    first = (F.col("begin") + F.get("t.places", F.lit(0))).cast("decimal(38,0)")
    return rows.select("commit_hash", "t.term", F.size("t.places").cast("bigint").alias("n"), first.alias("at"))


def _batches(spark: SparkSession, path: str, name: str, schema: str, before: int) -> DataFrame:
    if before == 0:
        return spark.createDataFrame([], f"{schema}, batch bigint")
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/{name}")
    return rows.filter(F.col("batch") < before)


def state(spark: SparkSession, path: str, after: int) -> DataFrame:
    """The statistics after a batch; before the first one there are none."""
    return spark.createDataFrame([], STATE) if after < 0 else spark.read.schema(STATE).parquet(f"{path}/state/batch={after}")


def _newest(commits: DataFrame) -> DataFrame:
    return commits.groupBy("commit_hash").agg(F.max("batch").alias("batch"))


def add_batch(commits: DataFrame, path: str, batch: int) -> None:
    """Add index rows (unique commit hashes) as a batch; commits that earlier batches had are replaced."""
    spark = commits.sparkSession
    term_rows(commits).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    commits.select("commit_hash").write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")
    added = spark.read.schema(ROW).parquet(f"{path}/rows/batch={batch}")
    own = spark.read.schema(COMMITS).parquet(f"{path}/commits/batch={batch}")

    held = _batches(spark, path, "commits", COMMITS, batch)
    replaced = _newest(held.join(own, "commit_hash", "left_semi"))
    rows = _batches(spark, path, "rows", ROW, batch)
    removed = rows.join(replaced, ["commit_hash", "batch"], "left_semi").select("commit_hash", "term", "n", "at")

    before = state(spark, path, batch - 1)
    # terms whose first place leaves: the places of what is left of them are read, of no other term
    leaving = before.join(removed.select("term", F.col("at").alias("first")), ["term", "first"], "left_semi").select("term", "df")
    live = _newest(held.join(own, "commit_hash", "left_anti"))
    left = join_frequent(rows, leaving, "term", "df").join(live, ["commit_hash", "batch"], "left_semi")

    nothing = F.lit(None).cast("decimal(38,0)")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    kept_first = before.join(leaving.select("term", F.lit(True).alias("gone")), "term", "left")
    parts = [
        kept_first.select("term", "n", "df", F.when(F.col("gone").isNull(), F.col("first")).alias("first")),
        added.select("term", "n", one.alias("df"), F.col("at").alias("first")),
        removed.select("term", (-F.col("n")).alias("n"), (-one).alias("df"), nothing.alias("first")),
        left.select("term", none.alias("n"), none.alias("df"), F.col("at").alias("first")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    merged = every.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.min("first").alias("first"))
    merged.filter("df > 0").write.mode("overwrite").parquet(f"{path}/state/batch={batch}")


def vocabulary_after(spark: SparkSession, path: str, batch: int, size: int | None = None) -> DataFrame:
    """The leading terms after a batch, from its statistics only."""
    docs = _batches(spark, path, "commits", COMMITS, batch + 1).select("commit_hash").distinct().count()
    stats = state(spark, path, batch)
    return vocabulary.leading(stats, docs) if size is None else vocabulary.leading(stats, docs, size)
