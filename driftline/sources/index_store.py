"""The commit index as a parquet folder to which batches are appended.

Nothing is overwritten in place: a batch adds its own folder of rows and one of
keys, and reading keeps the last row written per commit. A batch that is run
again after a failure replaces its own folders only. The keys lie by the first
characters of the hash, sorted, with Bloom filters, so asking for some commits
opens only files that can hold them. Folding writes the index so far as one base
and then notes it; from then on reading starts there, so the number of folders
that are read does not grow with the number of batches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.terms import VECTOR

COMMIT = (
    "commit_hash string, message string, author string, ts timestamp, files array<string>, "
    f"diff_summary string, repo string, vector {VECTOR}"
)
KEY = "commit_hash string, fitted boolean, bucket string"
_FOLDED = "upto bigint"
#: Characters of a hash that name its folder, and so many keys at most stand in a filter that is handed to the files.
BUCKET_CHARS, IN_FILTER = 1, 1_000
#: Distinct hashes that a Bloom filter of a file is made for.
EXPECTED = 100_000


def _bucket() -> Column:
    return F.left("commit_hash", F.lit(BUCKET_CHARS))


def _write(index: DataFrame, path: str, name: str) -> None:
    """Rows in ranges of (repo, ts), so that a search in one repository skips most files; keys by hash.

    The rows are written as they come first: the ranges are found in a sample, for
    which every vector would be made a second time. What is needed of that folder
    until the ranges are written is one batch; it is left empty.
    """
    reader = index.sparkSession.read.schema(index.schema)
    rows, keys, unsorted = f"{path}/{name}", f"{path}/keys/{name}", f"{path}/unsorted/{name}"
    index.write.mode("overwrite").parquet(unsorted)
    ranged = reader.parquet(unsorted).repartitionByRange("repo", "ts").sortWithinPartitions("repo", "ts")
    ranged.write.mode("overwrite").parquet(rows)
    index.limit(0).write.mode("overwrite").parquet(unsorted)
    written = reader.parquet(rows)
    hashes = written.select("commit_hash", F.col("vector").isNotNull().alias("fitted"), _bucket().alias("bucket"))
    hashes = hashes.repartitionByRange("bucket", "commit_hash").sortWithinPartitions("bucket", "commit_hash")
    (
        hashes.write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#commit_hash", "true")
        .option("parquet.bloom.filter.expected.ndv#commit_hash", str(EXPECTED))
        .partitionBy("bucket")
        .parquet(keys)
    )


def write_batch(index: DataFrame, path: str, batch: int) -> None:
    """Write the rows of one batch and their keys."""
    _write(index, path, f"batch={batch}")


def _read(spark: SparkSession, path: str, schema: str, base: str | None = None) -> DataFrame:
    """The rows of a folder, or of all that a pattern names below ``base``; none where there is nothing."""
    reader = spark.read.schema(schema)
    try:
        return (reader if base is None else reader.option("basePath", base)).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def folded(spark: SparkSession, path: str) -> int:
    """The last batch that the newest base holds, -1 without a base."""
    newest = _read(spark, f"{path}/folded", _FOLDED).agg(F.max("upto")).first()[0]
    return -1 if newest is None else newest


def _parts(spark: SparkSession, path: str, schema: str, below: str = "") -> DataFrame:
    """The base, as the batch it reaches up to, and the batches after it."""
    upto = folded(spark, path)
    later = _read(spark, f"{path}{below}/batch=*", f"{schema}, batch bigint", f"{path}{below}").filter(F.col("batch") > upto)
    if upto < 0:
        return later
    base = _read(spark, f"{path}{below}/base={upto}", schema)
    return base.withColumn("batch", F.lit(upto).cast("bigint")).unionByName(later)


def read_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All rows with their batch, those of the base with the last one it holds; with ``before``, of earlier batches.

    A folder without any batch yet gives no rows.
    """
    rows = _parts(spark, path, COMMIT)
    return rows if before is None else rows.filter(F.col("batch") < before)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index: the last row written per commit.

    A batch, and a base, hold a commit once. An index of one of them is read as
    it is, so filters reach the files; over several the last row of each commit
    is looked for among keys only.
    """
    rows = read_batches(spark, path)
    batches = rows.select("batch").distinct().limit(2).collect()
    if len(batches) < 2:
        return rows.drop("batch")
    last = rows.groupBy("commit_hash").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["commit_hash", "batch"], "left_semi").drop("batch")


def known(spark: SparkSession, path: str, commits: DataFrame, before: int | None = None) -> DataFrame:
    """``commit_hash`` of those commits that the store holds with a vector.

    Only keys are read, of the folders that the asked hashes name. Up to
    IN_FILTER hashes go to the files as a filter, which their statistics and
    Bloom filters answer; more are joined.
    """
    wanted = commits.select("commit_hash").distinct()
    keys = _parts(spark, path, KEY, "/keys").filter("fitted")
    keys = keys if before is None else keys.filter(F.col("batch") < before)
    few = [r["commit_hash"] for r in wanted.limit(IN_FILTER + 1).collect()]
    if len(few) <= IN_FILTER:
        buckets = sorted({h[:BUCKET_CHARS] for h in few if h is not None})
        asked = [h for h in few if h is not None]
        return keys.filter(F.col("bucket").isin(buckets) & F.col("commit_hash").isin(asked)).select("commit_hash").distinct()
    return keys.join(wanted, "commit_hash", "left_semi").select("commit_hash").distinct()


def fold(spark: SparkSession, path: str, upto: int) -> None:
    """Write the index up to a batch as one base and note it.

    The note comes last: a run that fails before leaves the index as it was.
    Folders that the base replaces are no longer read.
    """
    rows = read_batches(spark, path, before=upto + 1)
    last = rows.groupBy("commit_hash").agg(F.max("batch").alias("batch"))
    kept = rows.join(last, ["commit_hash", "batch"], "left_semi").drop("batch")
    _write(kept, path, f"base={upto}")
    spark.createDataFrame([(upto,)], _FOLDED).coalesce(1).write.mode("append").parquet(f"{path}/folded")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the index as one batch below ``target``."""
    write_batch(read(spark, path), target, 0)
