"""Vocabulary, inverse document frequencies and TF-IDF vectors of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.arrays import explode_rows
from driftline.functions.terms import Vocabulary, idf, term_counts, tokens

SCHEMA = "idx int, term string, n bigint, df bigint, idf double"
_PLACES = 2**31  # more places than a text can have tokens


def token_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per token with its place among the text's tokens."""
    return explode_rows(docs, [key], tokens(F.col(text)), "term")


def weights(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every text's unit vector under the vocabulary of all terms, in long form: key, term, weight.

    Terms are counted inside the row, so the corpus is exploded to one row per
    text and term; a term that is everywhere is combined before the shuffle and
    its rows are split by the adaptive skew join.
    """
    counts = explode_rows(docs, [key], term_counts(tokens(F.col(text))), "t").select(key, "t.term", "t.n")
    corpus_size = docs.agg(F.count("*")).scalar()
    known = counts.groupBy("term").agg(F.count("*").alias("df"))
    scaled = counts.join(known, "term").select(key, "term", (F.col("n") * idf(corpus_size, F.col("df"))).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return scaled.select(key, "term", (F.col("w") / length).alias("weight"))


def places(rank: Column) -> Column:
    """The number of a text's first place among the places of all texts in the order of ``rank``."""
    return (rank.cast("decimal(25,0)") * F.lit(_PLACES)).cast("decimal(38,0)")


def statistics(docs: DataFrame, rank: Column, text: str = "text") -> DataFrame:
    """For every term how often it occurs (``n``), in how many texts (``df``), and its ``first`` place.

    Counts, document counts and first places come from a single pass. All three
    are plain numbers, which lets Spark combine them in a hash table before the
    shuffle.
    """
    words = docs.select(places(rank).alias("at"), tokens(F.col(text)).alias("words"))
    both = F.array(F.col("words"), F.array_distinct("words"))
    rows = words.select("at", F.posexplode_outer(both).alias("distinct", "words")).select(
        "at", "distinct", F.posexplode_outer("words").alias("pos", "term")
    )
    every = F.col("distinct") == 0
    return (
        rows.filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(
            F.count_if(every).alias("n"),
            F.count_if(~every).alias("df"),
            F.min(F.when(every, (F.col("at") + F.col("pos")).cast("decimal(38,0)"))).alias("first"),
        )
    )


def leading(stats: DataFrame, corpus_size: int, size: int = fv.VOCABULARY_SIZE) -> DataFrame:
    """The ``size`` leading terms of term statistics: technical terms first, then by count, then by first place."""
    tech = F.col("term").isin(fv.TECH_TERMS)
    top = stats.orderBy(F.desc(tech), F.desc("n"), "first").limit(size)
    # at most ``size`` rows from here on
    entry = F.struct((~tech).alias("t"), (-F.col("n")).alias("m"), "first", "term", "n", "df")
    ranked = top.agg(F.sort_array(F.collect_list(entry)).alias("terms")).select(
        F.posexplode("terms").alias("idx", "v")
    )
    weight = idf(F.lit(corpus_size), F.col("v.df"))
    return ranked.select("idx", "v.term", "v.n", "v.df", weight.alias("idf"))


def fit(
    docs: DataFrame, rank: Column, text: str = "text", size: int = fv.VOCABULARY_SIZE
) -> DataFrame:
    """The ``size`` leading terms: technical terms first, then by count.

    Equal counts are ordered by first appearance, so ``rank`` must number the
    texts uniquely (a whole number of at most 82 bits). Only the top ``size``
    terms leave the sort.
    """
    return leading(statistics(docs, rank, text), docs.count(), size)


def freeze(vocabulary: DataFrame, size: int = fv.VOCABULARY_SIZE) -> Vocabulary:
    """Bring a fitted vocabulary to the driver, after checking that it is small."""
    rows = vocabulary.select("idx", "term", "idf").limit(size + 1).collect()
    if len(rows) > size:
        raise ValueError(f"the vocabulary has more than {size} terms")
    rows.sort()
    return Vocabulary([r.term for r in rows], [r.idf for r in rows])


def save(vocabulary: DataFrame, path: str) -> None:
    """Write a fitted vocabulary for later runs."""
    vocabulary.coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str, size: int = fv.VOCABULARY_SIZE) -> Vocabulary:
    """Read a vocabulary written by :func:`save`."""
    return freeze(spark.read.schema(SCHEMA).parquet(path), size)


def vectors(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """Add every text's unit vector; no row leaves its partition."""
    return docs.withColumn("vector", vocabulary.vector(F.col(text)))


def postings(vectors_: DataFrame, key: str, vocabulary: Vocabulary) -> DataFrame:
    """Vectors in long form: key, term, weight."""
    rows = explode_rows(vectors_, [key], F.col("vector"), "v")
    return rows.select(key, vocabulary.term(F.col("v.idx")).alias("term"), "v.weight")
