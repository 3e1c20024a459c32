"""The commit index under all terms of its texts, and search over it.

The vocabulary is a table of document frequencies, not a list that travels to
every task, so it has no limit: commits that share only a rare word find each
other. Texts meet it in a join on the term; a query looks up its own few terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.arrays import explode_rows
from driftline.functions.joins import join_frequent
from driftline.functions.terms import dot, idf, term_counts, tokens, unit
from driftline.operators import commit_index, search
from driftline.session import materialise, scratch_path

VECTOR = "array<struct<term:string,weight:double>>"
#: Texts from which a term is broadcast, as most terms of a text are; their number stays bounded.
FREQUENT_TERM = 200


@dataclass(frozen=True)
class TermStatistics:
    """How many of a corpus's texts hold each term: a table of term and df, and the number of texts."""

    table: DataFrame
    docs: int

    def idf_of(self, df: Column) -> Column:
        return idf(F.lit(self.docs), df)

    def query_weights(self, query: str) -> dict[str, float]:
        """The unit vector of a query; terms that no text holds count nothing."""
        spark = self.table.sparkSession
        counts = spark.range(1).select(F.explode(term_counts(tokens(F.lit(query)))).alias("t")).select("t.term", "t.n")
        wanted = {r["term"]: r["n"] for r in counts.collect()}
        known = self.table.filter(F.col("term").isin(list(wanted))).collect() if wanted else []
        weights = {r["term"]: wanted[r["term"]] * (math.log((self.docs + 1) / (r["df"] + 1)) + 1) for r in known}
        length = math.sqrt(sum(w * w for w in weights.values()))
        return {term: w / length for term, w in weights.items()}


def _term_rows(commits: DataFrame) -> DataFrame:
    counts = explode_rows(commits, ["commit_hash"], term_counts(tokens(commit_index.index_text())), "t")
    return counts.select("commit_hash", "t.term", "t.n")


def fit(commits: DataFrame) -> TermStatistics:
    """The statistics of index rows, one hash aggregation over their terms."""
    table = _term_rows(commits).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return TermStatistics(table, commits.count())


def save(statistics: TermStatistics, path: str) -> None:
    """Write the statistics, terms in ranges, so that looking up a few terms reads few files."""
    ranged = statistics.table.repartitionByRange("term").sortWithinPartitions("term")
    ranged.write.mode("overwrite").parquet(f"{path}/terms")
    spark = statistics.table.sparkSession
    spark.createDataFrame([(statistics.docs,)], "docs bigint").write.mode("overwrite").parquet(f"{path}/docs")


def load(spark: SparkSession, path: str) -> TermStatistics:
    table = spark.read.schema("term string, df bigint").parquet(f"{path}/terms")
    return TermStatistics(table, spark.read.schema("docs bigint").parquet(f"{path}/docs").first()["docs"])


def vectorise(commits: DataFrame, statistics: TermStatistics) -> DataFrame:
    """Add each commit's unit vector as (term, weight) entries by term; empty where it has no known term.

    Commit hashes must be unique. A term that is everywhere does not land in
    one task: the most frequent ones, whose number is bounded, are broadcast.
    """
    known = join_frequent(_term_rows(commits), statistics.table, "term", "df", FREQUENT_TERM)
    entry = F.struct("term", (F.col("n") * statistics.idf_of(F.col("df"))).alias("weight"))
    gathered = known.groupBy("commit_hash").agg(F.sort_array(F.collect_list(entry)).alias("vector"))
    vectors = gathered.withColumn("vector", unit(F.col("vector"), "term"))
    joined = commits.drop("vector").join(vectors, "commit_hash", "left")
    return joined.withColumn("vector", F.coalesce("vector", F.array().cast(VECTOR)))


def index_full(
    history: DataFrame,
    statistics: TermStatistics | None = None,
    existing: DataFrame | None = None,
    max_commits: int | None = None,
) -> DataFrame:
    """Index the newest commits of every repository over an existing index, as the form with leading terms does."""
    batch = commit_index.newest_per_repo(commit_index.projection(history), max_commits)
    rows = commit_index.latest(batch, F.struct("repo", "ts"))
    new = vectorise(rows, statistics or fit(rows))
    if existing is None:
        return new
    # the hashes of the rows without their vectors, which would be made a second time for them
    return existing.join(rows.select("commit_hash"), "commit_hash", "left_anti").unionByName(new)


def index_incremental(
    history: DataFrame, existing: DataFrame, statistics: TermStatistics | None = None, max_commits: int | None = None
) -> DataFrame:
    """The commits to append: those that the index lacks. Without statistics these are fitted on them."""
    batch = commit_index.newest_per_repo(commit_index.projection(history), max_commits)
    new = commit_index.latest(batch.join(existing.select("commit_hash"), "commit_hash", "left_anti"), F.struct("repo", "ts"))
    return vectorise(new, statistics or fit(new))


def find(
    index: DataFrame,
    statistics: TermStatistics,
    query: str,
    repo: str | None = None,
    top_k: int = 5,
    min_score: float = fv.MIN_SCORE,
    candidates: int | None = None,
    max_terms: int | None = None,
) -> DataFrame:
    """Cosine similarity under all terms, raised for every matched term, best ``top_k`` first: one scan, no shuffle."""
    weights = statistics.query_weights(query)
    lookup = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]).cast("map<string,double>")
    return search.ranked(index, lookup, "term", query, repo, top_k, min_score, candidates, max_terms)


def find_or_index(
    history: DataFrame, index: DataFrame | None, statistics: TermStatistics | None, query: str, repo: str, top_k: int = 5
) -> DataFrame:
    """Search one repository, indexing its commits first if the index has none of it."""
    if index is None or statistics is None or index.filter(F.col("repo") == repo).isEmpty():
        batch = commit_index.projection(history.filter(F.col("repo") == repo))
        rows = commit_index.latest(batch, F.struct("repo", "ts"))
        statistics = statistics or fit(rows)
        index = vectorise(rows, statistics)
    return find(index, statistics, query, repo, top_k)


def similar_to(index: DataFrame, commit_hash: str, repo: str | None = None, top_k: int = 5, candidates: int | None = None) -> DataFrame:
    """Commits closest under all terms to the newest commit whose hash starts like ``commit_hash``."""
    return search.similar_commits(index, commit_hash, repo, top_k, candidates, field="term")


# --- many sources at once --------------------------------------------------------------------------------------------

#: Sources that are compared with all commits in one scan, and the most terms they may have together.
BLOCK, BLOCK_TERMS = 2_048, 1_000_000
#: A term is multiplied as a row of a dense matrix if one in so many sources of a block has it, and by its list of sources otherwise.
DENSE_SHARE = 12
#: Numbers that a task multiplies at a time.
CELLS = 2_000_000
_PAIR = "source_hash string, commit_hash string, score double, ts timestamp"
_RANKED = _PAIR + ", rank int"


@dataclass(frozen=True)
class _Block:
    """The vectors of some sources: terms of many of them as a dense matrix, the others as lists of sources.

    ``terms`` has the dense ones first; ``starts`` says where the list of each other term begins in ``columns`` and ``weights``.
    """

    names: list[str]
    terms: list[str]
    dense: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    weights: np.ndarray


def _block(sources: list) -> _Block:
    found: dict[str, list[tuple[int, float]]] = {}
    for column, (_, vector) in enumerate(sources):
        for entry in vector:
            found.setdefault(entry["term"], []).append((column, entry["weight"]))
    terms = sorted(found, key=lambda t: -len(found[t]))
    often = sum(len(found[t]) * DENSE_SHARE >= len(sources) for t in terms)
    dense = np.zeros((often, len(sources)))
    for row, term in enumerate(terms[:often]):
        for column, weight in found[term]:
            dense[row, column] = weight
    rest = [pair for t in terms[often:] for pair in found[t]]
    starts = np.cumsum([0, *(len(found[t]) for t in terms[often:])])
    columns, weights = (np.array([pair[i] for pair in rest], dtype=kind) for i, kind in enumerate((np.int64, np.float64)))
    return _Block([name for name, _ in sources], terms, dense, starts, columns, weights)


def _scores(block: _Block, places: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The dot products of some commits (rows) and all sources of a block; ``places`` are those of the commits' terms in the block, -1 for others."""
    commits, sources, often = len(offsets) - 1, len(block.names), len(block.dense)
    rows = np.repeat(np.arange(commits), np.diff(offsets))
    near = (places >= 0) & (places < often)
    own = np.bincount(rows[near] * often + places[near], weights[near], commits * often).reshape(commits, often)
    scores = own @ block.dense
    far = places >= often
    rows, places, weights = rows[far], places[far] - often, weights[far]
    sizes = block.starts[places + 1] - block.starts[places]
    ends = np.cumsum(sizes)
    flat, begin = scores.reshape(-1), 0
    while begin < len(places):
        # so many lists that they have CELLS entries, one list at least
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + CELLS, side="right")))
        size = sizes[begin:end]
        at = np.arange(size.sum()) + np.repeat(block.starts[places[begin:end]] - (ends[begin:end] - size - before), size)
        cells = np.repeat(rows[begin:end] * sources, size) + block.columns[at]
        # rows ascend, so the piece lies in these commits
        low, high = rows[begin] * sources, (rows[end - 1] + 1) * sources
        flat[low:high] += np.bincount(cells - low, np.repeat(weights[begin:end], size) * block.weights[at], high - low)
        begin = end
    return scores


def _scan(block: list, top_k: int, min_score: float):
    """A function over batches of commits that keeps the best ``top_k`` of its task for every source of a block."""
    sources = _block(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(sources.terms, type=pa.string())
        own: dict[str, list[int]] = {}
        for column, name in enumerate(sources.names):
            own.setdefault(name, []).append(column)
        best: list[list] = [[] for _ in sources.names]
        # what a score must exceed to change the best of its source; equal scores are told apart by the heap
        least = np.full(len(best), float(min_score))
        together = max(1, CELLS // (len(best) + len(sources.dense)))

        def keep(hashes: list, times: list, scores: np.ndarray) -> None:
            enters = scores > least
            if np.count_nonzero(enters) > top_k * len(best) and len(hashes) > top_k:
                # of so many, those below the last of the best of these commits alone cannot stay
                enters &= scores >= np.partition(scores, -top_k, axis=0)[-top_k] - 1e-9
            for i, column in zip(*(x.tolist() for x in np.nonzero(enters)), strict=True):
                score, heap = float(scores[i, column]), best[column]
                if score <= least[column]:
                    continue
                # the order of the result: score, then newest, then hash
                rank = (round(score, 9), -1 if times[i] is None else times[i], _backwards(hashes[i]))
                row = (rank, hashes[i], score, times[i])
                (heappush if len(heap) < top_k else heappushpop)(heap, row)
                if len(heap) == top_k:
                    # ranks are rounded: a score less by under 1e-9 may have the same rank
                    least[column] = max(min_score, heap[0][0][0] - 1e-9)

        for batch in batches:
            hashes, times = batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist()
            vectors = batch.column(2)
            offsets = vectors.offsets.to_numpy()
            entries = vectors.values
            weights = entries.field("weight").to_numpy()
            places = pc.fill_null(pc.index_in(entries.field("term"), value_set=terms), -1).to_numpy().astype(np.int64)
            for first in range(0, len(hashes), together):
                last = min(first + together, len(hashes))
                low, high = offsets[first], offsets[last]
                scores = _scores(sources, places[low:high], weights[low:high], offsets[first : last + 1] - low)
                hits = np.concatenate([[0], np.cumsum(places[low:high] >= 0)])[offsets[first : last + 1] - low]
                scores[np.diff(hits) == 0] = -np.inf
                for i, name in enumerate(hashes[first:last]):
                    if name in own:
                        scores[i, own[name]] = -np.inf
                keep(hashes[first:last], times[first:last], scores)
        rows = [(sources.names[c], name, score, at) for c, heap in enumerate(best) for _, name, score, at in heap]
        columns = [*zip(*rows, strict=True)] or [[]] * 4
        kinds = [pa.string(), pa.string(), pa.float64(), pa.timestamp("us", tz="UTC")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, type=pa.int64()).cast(k) if pa.types.is_timestamp(k) else pa.array(v, type=k) for v, k in zip(columns, kinds, strict=True)],
            names=["source_hash", "commit_hash", "score", "ts"],
        )

    return run


def _backwards(name: str) -> tuple:
    return tuple(-ord(c) for c in name)


def similar_to_many(
    index: DataFrame, sources: DataFrame, top_k: int = 10, min_score: float = fv.MIN_SCORE, block: int = BLOCK
) -> DataFrame:
    """For every commit of ``sources`` (``commit_hash``) the closest ``top_k`` of all commits: source_hash, commit_hash, score, rank.

    Exact: sources are dealt into blocks of about ``block`` and at most about
    BLOCK_TERMS entries, every commit is compared with a whole block in one
    scan, as products of matrices, and each task keeps the best of its commits,
    so what is shuffled is ``top_k`` rows for a source and task. Only one
    block's vectors are on the driver at a time; they go out in parts of
    BLOCK_TERMS entries, or of one source.
    """
    spark = index.sparkSession
    rows = index.filter(F.col("vector").isNotNull())
    chosen = rows.join(sources.select("commit_hash").distinct(), "commit_hash", "left_semi").select("commit_hash", "vector")
    chosen = materialise(chosen, "sources")
    total = chosen.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("terms")).first()
    blocks = max(-(-total["rows"] // block), -(-total["terms"] // BLOCK_TERMS))
    path = scratch_path(spark, "similar")
    order = Window.partitionBy("source_hash").orderBy(F.desc(F.round("score", 9)), F.desc("ts"), "commit_hash")
    spark.createDataFrame([], _RANKED).write.parquet(path)
    for number in range(blocks):
        own = chosen.filter(F.pmod(F.xxhash64("commit_hash"), F.lit(blocks)) == number)
        for part in _parts([(r["commit_hash"], r["vector"]) for r in own.collect()]):
            scanned = rows.select("commit_hash", "ts", "vector").mapInArrow(_scan(part, top_k, min_score), _PAIR)
            best = scanned.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
            best.write.mode("append").parquet(path)
    return spark.read.schema(_RANKED).parquet(path)


def _parts(block: list) -> Iterator[list]:
    """Sources of a block that go out together."""
    part, total = [], 0
    for source in block:
        if part and total + len(source[1]) > BLOCK_TERMS:
            yield part
            part, total = [], 0
        part.append(source)
        total += len(source[1])
    if part:
        yield part
