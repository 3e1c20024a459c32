"""Ranked search over the commit index.

The query side is a handful of weights in a scalar subquery, so a search is one
scan of the index that keeps a running top-k: no shuffle of the index, no
candidate cap. ``candidates`` restores the newest-N limit where it is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.arrays import let
from driftline.functions.terms import Vocabulary, dot
from driftline.operators import commit_index
from driftline.operators import vocabulary as voc

RESULT = ["commit_hash", "message", "author", "ts", "files", "score", "matched_terms"]


def _candidates(index: DataFrame, repo: str | None, newest: int | None) -> DataFrame:
    if newest is not None:
        return commit_index.recent_commits(index, repo, newest)
    return index if repo is None else index.filter(F.col("repo") == repo)


def _top(scored: DataFrame, k: int, counts: Column) -> DataFrame:
    """The best ``k`` rows of those that count.

    Rows that do not count come last and are dropped at the end: a filter before
    the limit would be pushed below the projections, and every vector and score
    be made once for it and once more for the result.
    """
    marked = scored.withColumn("counts", F.coalesce(counts, F.lit(False)))
    # equal scores: newest first, as a stable sort over newest-first rows gives
    order = [F.desc("counts"), F.desc(F.round("score", 9)), F.desc("ts"), F.asc("commit_hash")]
    return marked.orderBy(*order).limit(k).filter("counts").select(*RESULT)


def _query_weights(spark, vocabulary: Vocabulary, query: str) -> Column:
    """The query's vector as an idx -> weight map, computed once per search."""
    vector = vocabulary.vector(F.lit(query))
    return spark.range(1).select(F.map_from_entries(vector)).scalar()


def matched_terms(query: str, text: Column, limit: int | None = None) -> Column:
    """Query words over two characters that occur anywhere in the text; all, or the first ``limit``."""
    words = sorted({w for w in query.lower().split() if len(w) > 2})
    if not words:
        return F.array().cast("array<string>")
    found = let(F.lower(text), lambda t: F.filter(F.lit(words), lambda w: F.contains(t, w)))
    return found if limit is None else F.slice(found, 1, limit)


def search(
    index: DataFrame,
    vocabulary: Vocabulary,
    query: str,
    repo: str | None = None,
    top_k: int = 5,
    min_score: float = fv.MIN_SCORE,
    candidates: int | None = None,
    max_terms: int | None = None,
) -> DataFrame:
    """Cosine similarity, raised for every matched term, best ``top_k`` first."""
    weights = _query_weights(index.sparkSession, vocabulary, query)
    return ranked(index, weights, "idx", query, repo, top_k, min_score, candidates, max_terms)


def ranked(
    index: DataFrame,
    weights: Column,
    field: str,
    query: str,
    repo: str | None,
    top_k: int,
    min_score: float,
    candidates: int | None,
    max_terms: int | None,
) -> DataFrame:
    """A search whose query is a map from ``field`` of the vectors' entries to its weight."""
    rows = _candidates(index, repo, candidates).withColumns(
        {"weights": weights, "matched_terms": matched_terms(query, commit_index.index_text(), max_terms)}
    )
    cosine = dot(F.col("vector"), F.col("weights"), field)
    boost = F.size("matched_terms") * fv.TERM_BOOST
    score = F.when(boost > 0, F.least(F.lit(1.0), cosine + boost)).otherwise(cosine)
    scored = rows.withColumn("score", F.when(F.col("vector").isNotNull(), score))
    return _top(scored, top_k, F.col("score") >= min_score)


def similar_commits(
    index: DataFrame,
    commit_hash: str,
    repo: str | None = None,
    top_k: int = 5,
    candidates: int | None = None,
    field: str = "idx",
) -> DataFrame:
    """Commits closest to the newest commit whose hash starts like ``commit_hash``."""
    rows = _candidates(index, repo, candidates)
    named = rows.filter(F.col("commit_hash").startswith(commit_hash[: fv.HASH_PREFIX]))
    source = named.orderBy(F.desc("ts"), "commit_hash").limit(1)
    weights = F.map_from_entries("vector").alias("weights")
    found = rows.withColumn("source", source.select(F.struct("commit_hash", weights)).scalar())
    others = found.filter(F.col("commit_hash") != F.col("source.commit_hash"))
    scored = others.withColumns(
        {
            "score": dot(F.col("vector"), F.col("source.weights"), field),
            "matched_terms": F.array().cast("array<string>"),
        }
    )
    return _top(scored, top_k, F.col("score") > fv.MIN_SCORE)


def search_by_files(
    index: DataFrame,
    file_patterns: list[str],
    repo: str | None = None,
    top_k: int = 10,
    candidates: int | None = None,
    max_terms: int | None = None,
) -> DataFrame:
    """Commits touching files whose names contain the patterns, most hits first."""
    wanted = F.array(*[F.lit(p.lower()) for p in file_patterns]).cast("array<string>")
    hits = F.flatten(
        F.transform(
            wanted,
            lambda p: F.filter(F.col("files"), lambda f: F.contains(F.lower(f), p)),
        )
    )
    rows = _candidates(index, repo, candidates).withColumn("hits", hits)
    scored = rows.withColumns(
        {
            "score": F.least(F.lit(1.0), F.size("hits") * fv.FILE_SCORE),
            "matched_terms": F.col("hits") if max_terms is None else F.slice("hits", 1, max_terms),
        }
    )
    return _top(scored, top_k, F.size("hits") > 0)


def search_or_index(
    history: DataFrame,
    index: DataFrame | None,
    vocabulary: Vocabulary | None,
    query: str,
    repo: str,
    top_k: int = 5,
    max_commits: int | None = None,
) -> DataFrame:
    """Search one repository, indexing its commits first if it has none."""
    if index is None or index.filter(F.col("repo") == repo).isEmpty():
        own = history.filter(F.col("repo") == repo)
        batch = commit_index.projection(own)
        if max_commits is not None:
            batch = commit_index.recent_commits(batch, repo, max_commits)
        vocabulary = vocabulary or voc.freeze(commit_index.fit(batch))
        index = commit_index.vectorise(commit_index.latest(batch, F.struct("repo", "ts")), vocabulary)
    return search(index, vocabulary, query, repo, top_k)
