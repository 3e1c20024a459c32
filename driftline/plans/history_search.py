"""Queries over tokens, vocabulary, the commit index and search, with SQL checks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.terms import Vocabulary
from driftline.operators import commit_index, search, term_index, vocabulary
from driftline.plans.views import VIEWS, quote, with_views
from driftline.session import scratch_path
from driftline.sources import gram_store, index_store, term_store
from driftline.sources.derived import labelled_ids, raw_commits
from driftline.sources.tables import text_table

QUERY = "Fix login bug in the thion tests"
FILE_PATTERNS = ["SRC1", "tests/3"]
SOURCE_HASH = hashlib.md5(b"20").hexdigest()
REPO = "src3"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return text_table(spark, sf, "documents")


def _doc_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.fit(_docs(spark, sf), F.col("doc_id"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.token_rows(_docs(spark, sf), "doc_id")


def vocabulary_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_vocabulary(spark, sf).select("idx", "term", "n")


def idf(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_vocabulary(spark, sf).select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_postings(spark: SparkSession, sf: str) -> DataFrame:
    rows = vocabulary.weights(_docs(spark, sf), "doc_id")
    return rows.withColumn("weight", F.round("weight", 6))


def leading_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Under the leading terms only, as a saved vocabulary that a later run loads."""
    path = scratch_path(spark, "vocabulary")
    vocabulary.save(_doc_vocabulary(spark, sf), path)
    words = vocabulary.load(spark, path)
    vectors = vocabulary.vectors(_docs(spark, sf), words)
    rows = vocabulary.postings(vectors, "doc_id", words)
    return rows.withColumn("weight", F.round("weight", 6))


def _flat(index: DataFrame) -> DataFrame:
    """Index rows with arrays and times as text."""
    columns = {
        "ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        "files": F.array_join("files", "|"),
    }
    if "matched_terms" in index.columns:
        columns["matched_terms"] = F.array_join("matched_terms", "|")
        columns["score"] = F.round("score", 3)
    return index.withColumns(columns)


def commit_projection(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(commit_index.projection(raw_commits(spark, sf)))


def _indexed_history(spark: SparkSession, sf: str) -> DataFrame:
    """Raw commits that an earlier run is taken to have indexed, from a fork."""
    known = raw_commits(spark, sf).join(labelled_ids(spark, sf), "doc_id", "left_semi")
    return known.withColumn("repo", F.concat(F.lit("fork/"), "repo"))


def commit_vocabulary(spark: SparkSession, sf: str) -> Vocabulary:
    commits = commit_index.projection(raw_commits(spark, sf))
    return vocabulary.freeze(commit_index.fit(commits))


def _index(spark: SparkSession, sf: str, words: Vocabulary) -> DataFrame:
    return commit_index.index_full(raw_commits(spark, sf), words, max_commits=None)


def index_full(spark: SparkSession, sf: str) -> DataFrame:
    words = commit_vocabulary(spark, sf)
    old = commit_index.index_full(_indexed_history(spark, sf), words, max_commits=None)
    index = commit_index.index_full(raw_commits(spark, sf), words, old)
    total = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v["weight"] * (v["idx"] + 1))
    return _flat(index).select(
        "commit_hash",
        "author",
        "ts",
        "files",
        "diff_summary",
        "repo",
        F.size("vector").alias("terms"),
        F.round(total, 5).alias("weight_sum"),
    )


def index_incremental(spark: SparkSession, sf: str) -> DataFrame:
    known = commit_index.projection(_indexed_history(spark, sf))
    return commit_index.incremental_stats(raw_commits(spark, sf), known)


def index_incremental_rows(spark: SparkSession, sf: str) -> DataFrame:
    words = commit_vocabulary(spark, sf)
    known = commit_index.projection(_indexed_history(spark, sf))
    new = commit_index.index_incremental(raw_commits(spark, sf), known, words, max_commits=None)
    return new.select("commit_hash", "repo", F.size("vector").alias("terms"))


def index_incremental_first(spark: SparkSession, sf: str) -> DataFrame:
    """A first incremental run: nothing is fitted yet, so it fits on what it indexes."""
    known = commit_index.projection(_indexed_history(spark, sf))
    new = commit_index.index_incremental(raw_commits(spark, sf), known)
    total = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v["weight"] * (v["idx"] + 1))
    return new.select("commit_hash", "repo", F.size("vector").alias("terms"), F.round(total, 5).alias("weight_sum"))


def index_single_commit(spark: SparkSession, sf: str) -> DataFrame:
    """Every commit by itself, while no vocabulary is fitted."""
    known = commit_index.projection(_indexed_history(spark, sf))
    new = commit_index.index_single(raw_commits(spark, sf), known, None)
    return new.select("commit_hash", "repo", F.col("vector").isNull().alias("unfitted"))


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, Vocabulary]:
    """An index and its vocabulary as an earlier run has written them."""
    path = scratch_path(spark, "index")
    commits = commit_index.projection(raw_commits(spark, sf))
    vocabulary.save(commit_index.fit(commits), f"{path}/vocabulary")
    words = vocabulary.load(spark, f"{path}/vocabulary")
    index_store.write_batch(_index(spark, sf, words), f"{path}/index", 0)
    return index_store.read(spark, f"{path}/index"), vocabulary.load(spark, f"{path}/vocabulary")


def search_stored(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(search.search(*_stored(spark, sf), QUERY))


def search_stored_in_repo(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(search.search(*_stored(spark, sf), QUERY, repo=REPO, top_k=20))


def search_already_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """A repository that the index holds is searched as it is."""
    return _flat(search.search_or_index(raw_commits(spark, sf), *_stored(spark, sf), QUERY, REPO))


def recent_commits(spark: SparkSession, sf: str) -> DataFrame:
    rows = commit_index.recent_commits(commit_index.projection(raw_commits(spark, sf)))
    return _flat(rows).select("commit_hash", "ts", "repo")


def recent_commits_of_repo(spark: SparkSession, sf: str) -> DataFrame:
    rows = commit_index.recent_commits(commit_index.projection(raw_commits(spark, sf)), REPO, 20)
    return _flat(rows).select("commit_hash", "ts", "repo")


def indexed_count(spark: SparkSession, sf: str) -> DataFrame:
    return commit_index.indexed_count(commit_index.projection(raw_commits(spark, sf)))


def last_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return commit_index.last_indexed(commit_index.projection(raw_commits(spark, sf)))


def is_indexed(spark: SparkSession, sf: str) -> DataFrame:
    known = commit_index.projection(_indexed_history(spark, sf))
    return commit_index.is_indexed(raw_commits(spark, sf), known).select("sha")


def matched_terms(spark: SparkSession, sf: str) -> DataFrame:
    commits = commit_index.projection(raw_commits(spark, sf))
    terms = search.matched_terms(QUERY, commit_index.index_text())
    return commits.select("commit_hash", F.array_join(terms, "|").alias("matched_terms"))


def search_history(spark: SparkSession, sf: str) -> DataFrame:
    words = commit_vocabulary(spark, sf)
    return _flat(search.search(_index(spark, sf, words), words, QUERY))


def search_history_in_repo(spark: SparkSession, sf: str) -> DataFrame:
    words = commit_vocabulary(spark, sf)
    return _flat(search.search(_index(spark, sf, words), words, QUERY, repo=REPO, top_k=20))


def similar_commits(spark: SparkSession, sf: str) -> DataFrame:
    words = commit_vocabulary(spark, sf)
    return _flat(search.similar_commits(_index(spark, sf, words), SOURCE_HASH, top_k=10))


def search_by_files(spark: SparkSession, sf: str) -> DataFrame:
    commits = commit_index.projection(raw_commits(spark, sf))
    return _flat(search.search_by_files(commits, FILE_PATTERNS))


def search_or_index(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(search.search_or_index(raw_commits(spark, sf), None, None, QUERY, REPO))


#: A query whose rarer words are in few commits.
RARE_QUERY = "tests of thion endio lodon login"


def _every_term(spark: SparkSession, sf: str) -> tuple[DataFrame, term_index.TermStatistics]:
    """An index under all terms and its statistics, as an earlier run has written them."""
    path = scratch_path(spark, "index")
    commits = commit_index.projection(raw_commits(spark, sf))
    term_index.save(term_index.fit(commits), f"{path}/statistics")
    statistics = term_index.load(spark, f"{path}/statistics")
    old = term_index.index_full(_indexed_history(spark, sf), statistics)
    term_index.index_full(raw_commits(spark, sf), statistics, old).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index"), statistics


def term_index_full(spark: SparkSession, sf: str) -> DataFrame:
    index, _ = _every_term(spark, sf)
    total = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v["weight"] * F.length(v["term"]))
    return index.select("commit_hash", "repo", F.size("vector").alias("terms"), F.round(total, 5).alias("weight_sum"))


def term_index_incremental(spark: SparkSession, sf: str) -> DataFrame:
    known = commit_index.projection(_indexed_history(spark, sf))
    new = term_index.index_incremental(raw_commits(spark, sf), known)
    total = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v["weight"] * F.length(v["term"]))
    return new.select("commit_hash", "repo", F.size("vector").alias("terms"), F.round(total, 5).alias("weight_sum"))


def search_all_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(term_index.find(*_every_term(spark, sf), RARE_QUERY, top_k=20))


def search_all_terms_in_repo(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(term_index.find_or_index(raw_commits(spark, sf), *_every_term(spark, sf), RARE_QUERY, REPO, top_k=20))


def search_all_terms_or_index(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(term_index.find_or_index(raw_commits(spark, sf), None, None, RARE_QUERY, REPO))


def similar_all_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(term_index.similar_to(_every_term(spark, sf)[0], SOURCE_HASH, top_k=10))


def similar_to_many(spark: SparkSession, sf: str) -> DataFrame:
    """The sources are the commits of every fiftieth document."""
    sources = raw_commits(spark, sf).filter(F.col("doc_id") % 50 == 0).select("sha")
    sources = sources.select(F.left("sha", F.lit(fv.HASH_CHARS)).alias("commit_hash"))
    found = term_index.similar_to_many(_every_term(spark, sf)[0], sources)
    return found.select("source_hash", "commit_hash", F.round("score", 6).alias("score"), "rank")


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of some texts, ends of some paths, and short and unknown ones."""
    docs = raw_commits(spark, sf)
    pieces = docs.filter(F.col("doc_id") % 20 == 7).select(F.lit("text").alias("field"), F.upper(F.substring("message", 30, 9)).alias("pattern"))
    ends = docs.select(F.lit("path").alias("field"), F.substring(F.get("files", F.lit(0)), -6, 6).alias("pattern"))
    few = spark.createDataFrame([("text", "xq"), ("text", "no such words"), ("path", "3.p"), ("path", ""), ("text", None)], "field string, pattern string")
    return pieces.unionByName(ends).unionByName(few)


def vocabulary_by_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches: some commits with other texts than they have in the end, the rest, and the first ones as they are."""
    commits = commit_index.latest(commit_index.projection(raw_commits(spark, sf)), F.struct("repo", "ts"))
    kind = F.pmod(F.conv(F.left("commit_hash", F.lit(4)), 16, 10).cast("bigint"), F.lit(4))
    early = commits.withColumn("message", F.when(kind == 0, F.reverse(F.left("message", F.lit(300)))).otherwise(F.col("message")))
    path = scratch_path(spark, "terms")
    term_store.add_batch(early.filter(kind < 2), path, 0)
    term_store.add_batch(commits.filter(kind >= 2), path, 1)
    term_store.add_batch(commits.filter(kind == 0), path, 2)
    return term_store.vocabulary_after(spark, path, 2).withColumn("idf", F.round("idf", 6))


def substring_search(spark: SparkSession, sf: str) -> DataFrame:
    """All patterns at once, from a stored index."""
    path = scratch_path(spark, "grams")
    gram_store.write(commit_index.projection(raw_commits(spark, sf)), path)
    return gram_store.find(spark, path, _patterns(spark, sf))


QUERIES = {
    "tokens": tokens,
    "vocabulary": vocabulary_terms,
    "idf": idf,
    **{
        f.__name__: f
        for f in (
            tfidf_postings,
            leading_postings,
            commit_projection,
            index_full,
            index_incremental,
            index_incremental_rows,
            index_incremental_first,
            index_single_commit,
            search_stored,
            search_stored_in_repo,
            search_already_indexed,
            recent_commits,
            recent_commits_of_repo,
            indexed_count,
            last_indexed,
            is_indexed,
            matched_terms,
            search_history,
            search_history_in_repo,
            similar_commits,
            search_by_files,
            search_or_index,
            term_index_full,
            term_index_incremental,
            search_all_terms,
            search_all_terms_in_repo,
            search_all_terms_or_index,
            similar_all_terms,
            similar_to_many,
            substring_search,
            vocabulary_by_batches,
        )
    },
}

# --- SQL checks -----------------------------------------------------------------

TECH = ", ".join(quote(t) for t in fv.TECH_TERMS)
VIEWS["raw_commits"] = (
    [],
    """SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS sha,
         CASE WHEN doc_id % 10 = 0 THEN 'fix login bug ' ELSE '' END || text AS message,
         CASE WHEN doc_id % 11 <> 0 THEN lang END AS author, source AS repo,
         1704067200 + doc_id * 60 AS committed_at,
         [lang || '/' || source || '.py', 'tests/' || (doc_id % 7) || '.py'] AS files,
         n_chars % 97 AS insertions, n_chars % 31 AS deletions FROM documents""",
)
VIEWS["commits"] = (
    ["raw_commits"],
    """SELECT doc_id, left(sha, 12) AS commit_hash,
         regexp_replace(message, '^\\s+|\\s+$', '', 'g') AS message,
         coalesce(author, 'Unknown') AS author, to_timestamp(committed_at) AS ts, files,
         '+' || insertions || '/-' || deletions AS diff_summary, repo FROM raw_commits""",
)


def token_list(text: str) -> str:
    return (
        f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), "
        "lambda x: regexp_matches(x, '^[a-z][a-z0-9_]{1,20}$'))"
    )


def _token_view(source: str, key: str, text: str) -> str:
    return f"""SELECT {key}, unnest(w) AS term, unnest(range(len(w))) AS pos
               FROM (SELECT {key}, {token_list(text)} AS w FROM {source})"""


def _vocabulary_view(toks: str, source: str, order: str) -> str:
    """Top terms with idx, counts and idf over the token view ``toks``."""
    return f"""SELECT term, n, df, row_number() OVER (ORDER BY tech DESC, n DESC, first) - 1 AS idx,
                 ln((docs + 1) / (df + 1)) + 1 AS idf
               FROM (SELECT term, count(*) AS n, count(DISTINCT key) AS df,
                       min(({order}, pos)) AS first, term IN ({TECH}) AS tech
                     FROM {toks} GROUP BY term),
                    (SELECT count(*) AS docs FROM {source})
               QUALIFY idx < {fv.VOCABULARY_SIZE}"""


def _weights_view(toks: str, words: str) -> str:
    return f"""SELECT key, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS weight
               FROM (SELECT key, term, idx, count(*) * idf AS w
                     FROM {toks} JOIN {words} USING (term) GROUP BY key, term, idx, idf)"""


VIEWS["doc_tokens"] = ([], _token_view("documents", "doc_id AS key", "text").replace(
    "SELECT doc_id AS key, unnest", "SELECT key, unnest"))
VIEWS["doc_words"] = (["doc_tokens"], _vocabulary_view("doc_tokens", "documents", "key"))
VIEWS["doc_weights"] = (["doc_tokens", "doc_words"], _weights_view("doc_tokens", "doc_words"))
VIEWS["doc_terms"] = (
    ["doc_tokens"],
    """SELECT term, term AS idx, ln((docs + 1) / (df + 1)) + 1 AS idf
       FROM (SELECT term, count(DISTINCT key) AS df FROM doc_tokens GROUP BY term),
            (SELECT count(*) AS docs FROM documents)""",
)
VIEWS["all_weights"] = (["doc_tokens", "doc_terms"], _weights_view("doc_tokens", "doc_terms"))


def _terms_view(toks: str, source: str) -> str:
    """All terms of a token view with their idf; a term stands for its own number."""
    return f"""SELECT term, term AS idx, ln((docs + 1) / (df + 1)) + 1 AS idf
               FROM (SELECT term, count(DISTINCT key) AS df FROM {toks} GROUP BY term),
                    (SELECT count(*) AS docs FROM {source})"""


VIEWS["commit_texts"] = (
    ["commits"],
    """SELECT *, commit_hash AS key, message || ' ' || array_to_string(files, ' ') AS text
       FROM commits""",
)
VIEWS["commit_tokens"] = (
    ["commit_texts"],
    f"""SELECT key, rank, unnest(w) AS term, unnest(range(len(w))) AS pos
        FROM (SELECT key, -doc_id AS rank, {token_list('text')} AS w FROM commit_texts)""",
)
VIEWS["words"] = (["commit_tokens"], _vocabulary_view("commit_tokens", "commits", "rank"))
VIEWS["weights"] = (["commit_tokens", "words"], _weights_view("commit_tokens", "words"))
VIEWS["commit_terms"] = (["commit_tokens"], _terms_view("commit_tokens", "commits"))
VIEWS["commit_weights"] = (["commit_tokens", "commit_terms"], _weights_view("commit_tokens", "commit_terms"))


def _query_weights(words: str, query: str) -> str:
    return f"""SELECT idx, w / sqrt(sum(w * w) OVER ()) AS weight FROM (
                 SELECT idx, count(*) * idf AS w
                 FROM (SELECT unnest({token_list(quote(query))}) AS term)
                 JOIN {words} USING (term) GROUP BY idx, idf)"""


def _matched_view(query: str) -> tuple[list[str], str]:
    return (
        ["commit_texts"],
        f"""SELECT *, list_sort(list_filter(list_distinct(string_split_regex({quote(query.lower())}, '\\s+')),
              lambda w: length(w) > 2 AND contains(lower(text), w))) AS matched
            FROM commit_texts""",
    )


VIEWS["terms_matched"] = _matched_view(QUERY)
VIEWS["rare_terms_matched"] = _matched_view(RARE_QUERY)


def _search_sql(words: str, weights: str, where: str, k: int, query: str = QUERY, matched: str = "terms_matched") -> str:
    return f"""SELECT commit_hash, message, author, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
        array_to_string(files, '|') AS files, round(score, 3) AS score,
        array_to_string(matched, '|') AS matched_terms
      FROM (SELECT t.*, CASE WHEN len(matched) > 0
              THEN least(1.0::DOUBLE, coalesce(dot, 0) + len(matched) * 0.1::DOUBLE)
              ELSE coalesce(dot, 0) END AS score
            FROM {matched} t LEFT JOIN (
              SELECT w.key, sum(w.weight * q.weight) AS dot
              FROM {weights} w JOIN ({_query_weights(words, query)}) q USING (idx) GROUP BY w.key) d
            ON d.key = t.commit_hash)
      WHERE score >= 0.1 {where}
      ORDER BY round(score, 9) DESC, ts DESC, commit_hash LIMIT {k}"""


VIEWS["newest_of_repo"] = (
    ["commits"],
    f"""SELECT * FROM commits WHERE repo = '{REPO}'
""",
)
VIEWS["repo_tokens"] = (
    ["commit_tokens", "newest_of_repo"],
    "SELECT * FROM commit_tokens WHERE key IN (SELECT commit_hash FROM newest_of_repo)",
)
VIEWS["repo_words"] = (
    ["repo_tokens"], _vocabulary_view("repo_tokens", "newest_of_repo", "rank")
)
VIEWS["repo_weights"] = (["repo_tokens", "repo_words"], _weights_view("repo_tokens", "repo_words"))
VIEWS["known"] = (
    ["commits"],
    """SELECT * REPLACE ('fork/' || repo AS repo) FROM commits
       WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
VIEWS["new_commits"] = (
    ["commits", "known"],
    "SELECT * FROM commits WHERE commit_hash NOT IN (SELECT commit_hash FROM known)",
)
VIEWS["new_tokens"] = (
    ["commit_tokens", "new_commits"],
    "SELECT * FROM commit_tokens WHERE key IN (SELECT commit_hash FROM new_commits)",
)
VIEWS["new_terms"] = (["new_tokens"], _terms_view("new_tokens", "new_commits"))
VIEWS["new_term_weights"] = (["new_tokens", "new_terms"], _weights_view("new_tokens", "new_terms"))
VIEWS["repo_terms"] = (["repo_tokens"], _terms_view("repo_tokens", "newest_of_repo"))
VIEWS["repo_term_weights"] = (["repo_tokens", "repo_terms"], _weights_view("repo_tokens", "repo_terms"))
VIEWS["new_words"] = (["new_tokens"], _vocabulary_view("new_tokens", "new_commits", "rank"))
VIEWS["new_weights"] = (["new_tokens", "new_words"], _weights_view("new_tokens", "new_words"))
_FLAT = """commit_hash, author, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
  array_to_string(files, '|') AS files, diff_summary, repo"""

ORACLE = {
    "tokens": with_views(
        ["doc_tokens"], "SELECT key AS doc_id, CAST(pos AS INTEGER) AS pos, term FROM doc_tokens"
    ),
    "vocabulary": with_views(
        ["doc_words"], "SELECT CAST(idx AS INTEGER) AS idx, term, n FROM doc_words"
    ),
    "idf": with_views(["doc_words"], "SELECT term, df, round(idf, 6) AS idf FROM doc_words"),
    "tfidf_postings": with_views(
        ["all_weights"], "SELECT key AS doc_id, term, round(weight, 6) AS weight FROM all_weights"
    ),
    "leading_postings": with_views(
        ["doc_weights"], "SELECT key AS doc_id, term, round(weight, 6) AS weight FROM doc_weights"
    ),
    "commit_projection": with_views(["commits"], f"SELECT message, {_FLAT} FROM commits"),
    "index_full": with_views(
        ["weights", "known"],
        f"""SELECT {_FLAT}, CAST(coalesce(terms, 0) AS INTEGER) AS terms,
              round(coalesce(weight_sum, 0), 5) AS weight_sum
            FROM (SELECT * FROM commits UNION ALL
                  SELECT * FROM known WHERE commit_hash NOT IN (SELECT commit_hash FROM commits)) c
            LEFT JOIN (SELECT key, count(*) AS terms, sum(weight * (idx + 1)) AS weight_sum
                       FROM weights GROUP BY key) w ON w.key = c.commit_hash""",
    ),
    "index_incremental": with_views(
        ["known", "commits"],
        """SELECT repo, count(*) FILTER (WHERE NOT k) AS indexed_count,
              count(*) FILTER (WHERE k) AS skipped_count
            FROM (SELECT repo, commit_hash IN (SELECT commit_hash FROM known) AS k FROM commits)
            GROUP BY repo""",
    ),
    "index_incremental_rows": with_views(
        ["known", "weights"],
        """SELECT commit_hash, repo, CAST(count(w.key) AS INTEGER) AS terms
           FROM commits c LEFT JOIN weights w ON w.key = c.commit_hash
           WHERE commit_hash NOT IN (SELECT commit_hash FROM known) GROUP BY commit_hash, repo""",
    ),
    "index_incremental_first": with_views(
        ["new_weights", "new_commits"],
        """SELECT commit_hash, repo, CAST(coalesce(terms, 0) AS INTEGER) AS terms,
             round(coalesce(weight_sum, 0), 5) AS weight_sum
           FROM new_commits c
           LEFT JOIN (SELECT key, count(*) AS terms, sum(weight * (idx + 1)) AS weight_sum
                      FROM new_weights GROUP BY key) w ON w.key = c.commit_hash""",
    ),
    "index_single_commit": with_views(
        ["new_commits"], "SELECT commit_hash, repo, TRUE AS unfitted FROM new_commits"
    ),
    "search_stored": with_views(
        ["weights", "terms_matched"], _search_sql("words", "weights", "", 5)
    ),
    "search_stored_in_repo": with_views(
        ["weights", "terms_matched"],
        _search_sql("words", "weights", f"AND repo = '{REPO}'", 20),
    ),
    "search_already_indexed": with_views(
        ["weights", "terms_matched"],
        _search_sql("words", "weights", f"AND repo = '{REPO}'", 5),
    ),
    "recent_commits": with_views(
        ["commits"],
        """SELECT commit_hash, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, repo FROM commits
           ORDER BY commits.ts DESC, commit_hash LIMIT 100""",
    ),
    "recent_commits_of_repo": with_views(
        ["commits"],
        f"""SELECT commit_hash, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, repo FROM commits
            WHERE repo = '{REPO}' ORDER BY commits.ts DESC, commit_hash LIMIT 20""",
    ),
    "indexed_count": with_views(
        ["commits"], "SELECT repo, count(*) AS commits FROM commits GROUP BY repo"
    ),
    "last_indexed": with_views(
        ["commits"],
        "SELECT repo, min_by(commit_hash, (-epoch_us(ts), commit_hash)) AS commit_hash FROM commits GROUP BY repo",
    ),
    "is_indexed": with_views(
        ["known", "raw_commits"],
        "SELECT sha FROM raw_commits WHERE left(sha, 12) IN (SELECT commit_hash FROM known)",
    ),
    "matched_terms": with_views(
        ["terms_matched"],
        "SELECT commit_hash, array_to_string(matched, '|') AS matched_terms FROM terms_matched",
    ),
    "search_history": with_views(
        ["weights", "terms_matched"], _search_sql("words", "weights", "", 5)
    ),
    "search_history_in_repo": with_views(
        ["weights", "terms_matched"],
        _search_sql("words", "weights", f"AND repo = '{REPO}'", 20),
    ),
    "similar_commits": with_views(
        ["weights", "commits"],
        f"""SELECT commit_hash, message, author, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
              array_to_string(files, '|') AS files, round(score, 3) AS score, '' AS matched_terms
            FROM (SELECT o.key, sum(o.weight * s.weight) AS score
                  FROM weights o JOIN weights s ON o.idx = s.idx
                  WHERE s.key = '{SOURCE_HASH[:12]}' AND o.key <> s.key GROUP BY o.key) d
            JOIN commits ON commit_hash = d.key WHERE score > 0.1
            ORDER BY round(score, 9) DESC, commits.ts DESC, commit_hash LIMIT 10""",
    ),
    "search_by_files": with_views(
        ["commits"],
        f"""SELECT commit_hash, message, author, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
              array_to_string(files, '|') AS files, round(score, 3) AS score,
              array_to_string(hits, '|') AS matched_terms
            FROM (SELECT *, least(1.0::DOUBLE, len(hits) * 0.2::DOUBLE) AS score
                  FROM (SELECT *, list_concat({", ".join(
                      f"list_filter(files, lambda f: contains(lower(f), {quote(p.lower())}))"
                      for p in FILE_PATTERNS)}) AS hits FROM commits))
            WHERE len(hits) > 0
            ORDER BY score DESC, ts DESC, commit_hash LIMIT 10""",
    ),
    "search_or_index": with_views(
        ["repo_weights", "terms_matched"],
        _search_sql(
            "repo_words",
            "repo_weights",
            "AND commit_hash IN (SELECT commit_hash FROM newest_of_repo)",
            5,
        ),
    ),
    "term_index_full": with_views(
        ["commit_weights", "known"],
        """SELECT commit_hash, repo, CAST(coalesce(terms, 0) AS INTEGER) AS terms,
             round(coalesce(weight_sum, 0), 5) AS weight_sum
           FROM (SELECT * FROM commits UNION ALL
                 SELECT * FROM known WHERE commit_hash NOT IN (SELECT commit_hash FROM commits)) c
           LEFT JOIN (SELECT key, count(*) AS terms, sum(weight * length(term)) AS weight_sum
                      FROM commit_weights GROUP BY key) w ON w.key = c.commit_hash""",
    ),
    "term_index_incremental": with_views(
        ["new_term_weights", "new_commits"],
        """SELECT commit_hash, repo, CAST(coalesce(terms, 0) AS INTEGER) AS terms,
             round(coalesce(weight_sum, 0), 5) AS weight_sum
           FROM new_commits c
           LEFT JOIN (SELECT key, count(*) AS terms, sum(weight * length(term)) AS weight_sum
                      FROM new_term_weights GROUP BY key) w ON w.key = c.commit_hash""",
    ),
    "search_all_terms": with_views(
        ["commit_weights", "rare_terms_matched"],
        _search_sql("commit_terms", "commit_weights", "", 20, RARE_QUERY, "rare_terms_matched"),
    ),
    "search_all_terms_in_repo": with_views(
        ["commit_weights", "rare_terms_matched"],
        _search_sql("commit_terms", "commit_weights", f"AND repo = '{REPO}'", 20, RARE_QUERY, "rare_terms_matched"),
    ),
    "search_all_terms_or_index": with_views(
        ["repo_term_weights", "rare_terms_matched"],
        _search_sql(
            "repo_terms",
            "repo_term_weights",
            "AND commit_hash IN (SELECT commit_hash FROM newest_of_repo)",
            5,
            RARE_QUERY,
            "rare_terms_matched",
        ),
    ),
    "similar_all_terms": with_views(
        ["commit_weights", "commits"],
        f"""SELECT commit_hash, message, author, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
              array_to_string(files, '|') AS files, round(score, 3) AS score, '' AS matched_terms
            FROM (SELECT o.key, sum(o.weight * s.weight) AS score
                  FROM commit_weights o JOIN commit_weights s ON o.idx = s.idx
                  WHERE s.key = '{SOURCE_HASH[:12]}' AND o.key <> s.key GROUP BY o.key) d
            JOIN commits ON commit_hash = d.key WHERE score > 0.1
            ORDER BY round(score, 9) DESC, commits.ts DESC, commit_hash LIMIT 10""",
    ),
    "similar_to_many": with_views(
        ["commit_weights", "commits"],
        """SELECT source_hash, commit_hash, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
             SELECT source_hash, commit_hash, score, row_number() OVER (
                      PARTITION BY source_hash ORDER BY round(score, 9) DESC, c.ts DESC, commit_hash) AS rank
             FROM (SELECT s.key AS source_hash, o.key, sum(o.weight * s.weight) AS score
                   FROM commit_weights s JOIN commit_weights o ON o.idx = s.idx AND o.key <> s.key
                   WHERE s.key IN (SELECT commit_hash FROM commits WHERE doc_id % 50 = 0) GROUP BY s.key, o.key) d
             JOIN commits c ON c.commit_hash = d.key WHERE score > 0.1)
           WHERE rank <= 10""",
    ),
    "substring_search": with_views(
        ["commit_texts"],
        """SELECT DISTINCT field, lower(pattern) AS pattern, commit_hash
           FROM (SELECT 'text' AS field, lower(substr(message, 30, 9)) AS pattern FROM raw_commits WHERE doc_id % 20 = 7
                 UNION SELECT 'path', lower(right(files[1], 6)) FROM raw_commits
                 UNION SELECT 'text', 'xq' UNION SELECT 'path', '3.p')
           JOIN commit_texts ON (field = 'text' AND contains(lower(text), pattern))
             OR (field = 'path' AND len(list_filter(files, lambda f: contains(lower(f), pattern))) > 0)
           WHERE pattern <> ''""",
    ),
    "vocabulary_by_batches": with_views(
        ["words"], "SELECT CAST(idx AS INTEGER) AS idx, term, n, df, round(idf, 6) AS idf FROM words"
    ),
}
