"""Exact duplicates by content, combined in three steps so that no group of copies lands in one task.

1. Copies inside an input partition meet before the shuffle, in the partial
   aggregation of the first grouping.
2. What is left is grouped by digest, salt (the input partition's number) and
   content, so a digest that is everywhere is spread over as many groups.
3. One row for each digest, salt and content goes on to the final grouping by
   digest and content.

Content is a grouping key beside the digest at every step; texts that share a
digest but differ stay apart. The result goes back to the rows the same way: to
the salted groups first, then to the rows of each salted group.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.columns import BLANK, pick
from driftline.session import materialise


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


#: One more character outweighs any difference of keys in a row's rank; a null key counts as ``_LAST``.
_CHARACTER, _LAST = Decimal(2**66), Decimal(2**64)


def _groups(rows: DataFrame) -> DataFrame:
    """Size and best rank of each digest, and how many different contents share it."""
    rank = F.col("n_chars").cast("decimal(10,0)") * F.lit(_CHARACTER) - F.coalesce(
        F.col("doc_id").cast("decimal(20,0)"), F.lit(_LAST)
    )
    salted = (
        rows.select("salt", "digest", "norm", rank.cast("decimal(38,0)").alias("rank"))
        .groupBy("salt", "digest", "norm")
        .agg(F.max("rank").alias("best"), F.count(F.lit(1)).alias("n"))
    )
    contents = salted.repartition("digest").groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    found = contents.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.max("best").alias("best"), F.max("n").alias("group_size")
    )
    n_chars = F.round(F.col("best") / F.lit(_CHARACTER)).cast("decimal(10,0)")
    key = n_chars * F.lit(_CHARACTER) - F.col("best")
    return found.select(
        "digest",
        "contents",
        "group_size",
        F.when(key < F.lit(_LAST), key.cast("bigint")).alias("keep_id"),
    )


def _back(rows: DataFrame, groups: DataFrame, salts: int) -> DataFrame:
    """Every row with its group: large groups from a small table, the others by a join on the digest.

    A group is large from a share of 1 in 4 x ``salts`` of all rows on, so there
    are at most 4 x ``salts`` of them.
    """
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    large = max(1000, total // (4 * salts))
    hot = groups.filter(F.col("group_size") >= large).select(
        F.col("digest").alias("hot_digest"), F.col("keep_id").alias("hot_keep"), F.col("group_size").alias("hot_size")
    )
    cold = groups.filter(F.col("group_size") < large).select(F.col("digest").alias("place"), "keep_id", "group_size")
    marked = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    marked = marked.select(
        "doc_id",
        "text_sha256",
        "digest",
        "hot_size",
        "hot_keep",
        F.when(F.col("hot_size").isNull(), F.col("digest"))
        .otherwise(F.concat_ws("/", F.lit("hot"), "salt", F.xxhash64("doc_id")))
        .alias("place"),
    )
    return marked.join(cold, "place", "left").select(
        "doc_id",
        "digest",
        F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_keep")).alias("keep_id"),
        F.coalesce("group_size", "hot_size").alias("group_size"),
        "text_sha256",
    )


def exact_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    blank: str = BLANK,
    digest: Callable[[Column], Column] = sha256,
    salts: int | None = None,
) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, for every row of ``docs``.

    Texts are equal if they are after deleting every ``blank`` character; null
    counts as empty. Of equal texts the row with the most code points stays,
    then the one with the smallest integer key; a null key comes after all
    others, and of repeated rows one stays. ``salts`` is over how many groups a
    digest may be spread, by default the number of shuffle partitions.
    """
    salts = salts or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        pick(docs, key, text)
        .toDF("doc_id", "text")
        .select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.length(whole).alias("n_chars"),
            F.regexp_replace(whole, f"{blank}+", "").alias("norm"),
            F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        )
        .select("*", digest(F.col("norm")).alias("digest"), F.sha2("norm", 256).alias("text_sha256"))
    )
    groups = materialise(_groups(rows), "exact-groups")
    clashes = groups.filter("contents > 1").select("digest")
    if clashes.isEmpty():
        found = _back(rows, groups, salts)
    else:  # different texts under one digest: there the content itself takes the digest's place
        mixed = rows.join(clashes, "digest", "left_semi").withColumn("digest", F.concat(F.lit("text:"), "norm"))
        alone = groups.filter("contents = 1")
        found = _back(rows.join(clashes, "digest", "left_anti"), alone, salts)
        found = found.unionByName(_back(mixed, materialise(_groups(mixed), "exact-groups"), salts))
    copies = Window.partitionBy("digest", "doc_id").orderBy("text_sha256")
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(copies) == 1)).alias("kept"),
        "text_sha256",
    )
