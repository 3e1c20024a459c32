"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of ``links`` (``a``, ``b``).

    Two steps in turn until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller ones. Each round is written
    to the shared folder, so a lost executor costs one round.
    """
    spark = links.sparkSession
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "links")
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter(F.col("u") != F.col("v")).distinct(), "links")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter(F.col("u") != F.col("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct(), "links")
        found = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == state:
            break
        state = found
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return materialise(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components") if state[0] else (
        spark.createDataFrame([], roots.schema)
    )
