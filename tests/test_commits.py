import datetime as dt
import hashlib
import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.operators import commit_index as ci
from driftline.functions import joins
from driftline.functions.terms import Vocabulary
from driftline.operators import search, term_index
from driftline.operators import vocabulary as voc
from driftline.session import materialise, settings
from driftline.sources import gram_store, index_store, term_store

RAW = (
    "sha string, message string, author string, repo string, committed_at bigint, "
    "files array<string>, insertions int, deletions int"
)
ROWS = [
    ("a" * 40, " \n\tfix login bug \n", "Ann", "r1", 1000, ["src/login.py", "tests/test_login.py"], 10, 5),
    ("b" * 40, "add session cache", None, "r1", 2000, ["src/cache.py"], None, None),
    ("c" * 40, "update docs", "Cid", "r1", 3000, [f"f{i}.md" for i in range(30)], 1, 0),
    ("d" * 40, "x" * 600, "Dee", "r2", 4000, [], 0, 0),
    ("a" * 40, "fix login bug (fork)", "Ann", "r2", 1000, ["src/login.py"], 10, 5),
]


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame(ROWS, RAW)


@pytest.fixture(scope="module")
def built(history):
    words = voc.freeze(ci.fit(ci.projection(history)))
    return ci.index_full(history, words), words


def test_projection(history):
    rows = {(r.commit_hash, r.repo): r for r in ci.projection(history).collect()}
    first = rows["a" * 12, "r1"]
    assert (first.message, first.diff_summary) == ("fix login bug", "+10/-5")
    assert first.ts == dt.datetime(1970, 1, 1, 0, 16, 40)
    second = rows["b" * 12, "r1"]
    assert (second.author, second.diff_summary) == ("Unknown", "+0/-0")
    assert len(rows["c" * 12, "r1"].files) == 30
    assert len(rows["d" * 12, "r2"].message) == 600
    cut = ci.projection(history, fv.MESSAGE_CHARS, fv.MAX_FILES)
    cut = {(r.commit_hash, r.repo): r for r in cut.collect()}
    assert len(cut["c" * 12, "r1"].files) == 20
    assert len(cut["d" * 12, "r2"].message) == 500


def test_messages_lose_the_whitespace_at_their_ends(spark):
    blanks = ["", " ", "\n", "\t\r\x0b\x0c", "\x1c\x1f", "\x85\xa0", "\u1680\u2028", "\u3000", "\u200b"]
    texts = [a + t + b for a in blanks for b in blanks for t in ("", "x", "x \n y", "\U0001f600", "\u200b z")]
    rows = [(f"{i:012d}", t, None, "r", i, [], 0, 0) for i, t in enumerate([*texts, None])]
    found = {r.commit_hash: r.message for r in ci.projection(spark.createDataFrame(rows, RAW)).collect()}
    assert found == {name: None if t is None else t.strip() for name, t, *_ in rows}


def test_scores_on_the_bound_and_missing_vectors(spark):
    entry = [{"idx": 0, "weight": 1.0}]
    rows = [(f"{i:012d}", f"m{i}", [], 100 + i, [{"idx": 0, "weight": w}] if w is not None else None) for i, w in enumerate([fv.MIN_SCORE, 0.5, None, 0.05])]
    rows.append(("f" * 12, "source", [], 50, entry))
    schema = "commit_hash string, message string, files array<string>, at bigint, vector array<struct<idx:int,weight:double>>"
    index = spark.createDataFrame(rows, schema).select("*", F.timestamp_seconds("at").alias("ts"), F.lit("a").alias("author"), F.lit("r").alias("repo"))
    assert [r.message for r in search.similar_commits(index, "f" * 12, top_k=10).collect()] == ["m1"]
    words = voc.Vocabulary(["login"], [1.0])
    assert [r.message for r in search.search(index, words, "login", top_k=10).collect()] == ["source", "m1", "m0"]
    assert [r.message for r in search.search(index, words, "login m2", top_k=10, min_score=0.0).collect()][-1] == "m3"


def test_last_write_wins_across_repos(built):
    rows = {r.commit_hash: r for r in built[0].collect()}
    assert len(rows) == 4 and rows["a" * 12].repo == "r2"


def test_full_index_over_an_existing_one(history, built):
    index, words = built
    newer = history.filter(F.col("repo") == "r1").withColumn("author", F.lit("New"))
    rows = {r.commit_hash: r for r in ci.index_full(newer, words, index).collect()}
    assert {h: r.author for h, r in rows.items()} == {
        "a" * 12: "New", "b" * 12: "New", "c" * 12: "New", "d" * 12: "Dee",
    }


def test_newest_per_repo(history):
    assert ci.newest_per_repo(ci.projection(history), None).count() == 5
    rows = ci.newest_per_repo(ci.projection(history), 1).collect()
    assert {(r.repo, r.commit_hash[0]) for r in rows} == {("r1", "c"), ("r2", "d")}


def test_incremental(history, built, spark):
    known = built[0].filter(F.col("commit_hash") != "b" * 12)
    new = ci.index_incremental(history, known, built[1]).collect()
    assert [r.commit_hash for r in new] == ["b" * 12] and new[0].vector
    stats = {r.repo: (r.indexed_count, r.skipped_count) for r in ci.incremental_stats(history, known).collect()}
    assert stats == {"r1": (1, 2), "r2": (0, 2)}
    first = ci.index_incremental(history, known, None).collect()
    assert len(first[0].vector) == 5  # its words, fitted on this commit alone
    single = ci.index_single(history, known, None)
    assert {r.vector for r in single.collect()} == {None}
    # a row without a vector is filled in by a later run
    again = ci.index_incremental(history, known.unionByName(single), built[1]).collect()
    assert [r.commit_hash for r in again] == ["b" * 12] and again[0].vector
    assert search.search(known.unionByName(ci.index_incremental(history, known, built[1])), built[1], "cache").collect()


def test_lookups(history, built, spark):
    index = built[0]
    assert [r.commit_hash[0] for r in ci.recent_commits(index, limit=2).collect()] == ["d", "c"]
    assert {r.repo: r.commits for r in ci.indexed_count(index).collect()} == {"r1": 2, "r2": 2}
    assert {r.repo: r.commit_hash[0] for r in ci.last_indexed(index).collect()} == {"r1": "c", "r2": "d"}
    asked = spark.createDataFrame([("a" * 40,), ("e" * 40,)], "sha string")
    assert [r.sha[0] for r in ci.is_indexed(asked, index).collect()] == ["a"]


def _text(r):
    return r.message + " " + " ".join(r.files)


@pytest.mark.parametrize("query", ["login bug", "Session  CACHE zzz", "py", "the", "nothing known"])
def test_search_scores(built, query):
    index, words = built
    idf = dict(zip(words.terms, words.idfs))
    want = {}
    for r in index.collect():
        matched = sorted({w for w in query.lower().split() if len(w) > 2 and w in _text(r).lower()})
        score = brute.cosine(query, _text(r), idf)
        if matched:
            score = min(1.0, score + 0.1 * len(matched))
        if score >= 0.1:
            want[r.commit_hash] = (round(score, 9), matched)
    rows = search.search(index, words, query).collect()
    assert {r.commit_hash: (round(r.score, 9), r.matched_terms) for r in rows} == want
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_term_boost_alone_admits_a_commit(built):
    # "ogi" is no token of any commit, but part of "login"
    rows = search.search(*built, "ogi").collect()
    assert [r.score for r in rows] == pytest.approx([0.1])


def test_similar(built):
    index, words = built
    idf = dict(zip(words.terms, words.idfs))
    texts = {r.commit_hash: _text(r) for r in index.collect()}
    rows = search.similar_commits(index, "a" * 40).collect()
    want = {
        h: brute.cosine(texts["a" * 12], t, idf)
        for h, t in texts.items()
        if h != "a" * 12 and brute.cosine(texts["a" * 12], t, idf) > 0.1
    }
    assert {r.commit_hash: r.score for r in rows} == pytest.approx(want)
    assert search.similar_commits(index, "zzz").collect() == []


def test_by_files(history):
    rows = search.search_by_files(ci.projection(history), ["LOGIN", ".md"], repo="r1").collect()
    assert [(r.commit_hash[0], round(r.score, 3), len(r.matched_terms)) for r in rows] == [
        ("c", 1.0, 30), ("a", 0.4, 2),
    ]
    few = search.search_by_files(ci.projection(history), [".md"], max_terms=fv.MATCHED_TERMS).collect()
    assert [len(r.matched_terms) for r in few] == [5]


def test_search_or_index(history, built):
    fresh = search.search_or_index(history, None, None, "login", "r1").collect()
    assert fresh[0].commit_hash == "a" * 12
    newest = search.search_or_index(history, None, None, "login", "r1", max_commits=2).collect()
    assert newest == []
    kept = search.search_or_index(history, *built, "login", "r2").collect()
    assert kept[0].message == "fix login bug (fork)"


def test_empty_index(spark, built):
    assert search.search(built[0].limit(0), built[1], "login").collect() == []


def test_a_batch_is_made_once_when_it_is_written(tmp_path, spark):
    made = spark.sparkContext.accumulator(0)

    def count(message):
        made.add(1)
        return message

    rows = spark.range(200).selectExpr(
        "lpad(string(id), 12, '0') AS commit_hash", "'m' AS message", "'a' AS author", "timestamp_seconds(id) AS ts",
        "array('f') AS files", "'' AS diff_summary", "string(id % 3) AS repo", "array(struct(1 AS idx, 1D AS weight)) AS vector",
    )
    index_store.write_batch(rows.withColumn("message", F.udf(count)("message")), str(tmp_path), 0)
    assert made.value == 200  # not once more for a sample of the keys
    assert index_store.read(spark, str(tmp_path)).count() == 200
    assert spark.read.schema(rows.schema).parquet(f"{tmp_path}/unsorted/batch=0").isEmpty()


def test_terms_are_found_by_halving(spark):
    for n in (1, 2, 3, 7, 8, 9, 500):
        terms = [f"t{i * 7919 % 1009}" for i in range(n)]
        words = Vocabulary(terms, [1.0 + i for i in range(n)])
        vector = spark.range(1).select(words.vector(F.lit(" ".join([*terms, "t2000", terms[0]])))).first()[0]
        weights = [2.0 if not i else 1.0 + i for i in range(n)]
        length = math.sqrt(sum(w * w for w in weights))
        assert [v.idx for v in vector] == list(range(n))
        assert [v.weight for v in vector] == pytest.approx([w / length for w in weights])


def test_store_keeps_the_last_write(history, built, tmp_path, spark):
    path = str(tmp_path / "index")
    assert index_store.read(spark, path).count() == 0
    index, words = built
    index_store.write_batch(index, path, 0)
    newer = ci.index_full(history.filter(F.col("repo") == "r1").withColumn("author", F.lit("New")), words)
    for _ in range(2):  # a batch may be run again
        index_store.write_batch(newer, path, 1)
    rows = {r.commit_hash[0]: r.author for r in index_store.read(spark, path).collect()}
    assert rows == {"a": "New", "b": "New", "c": "New", "d": "Dee"}
    index_store.compact(spark, path, f"{path}-compact")
    compact = index_store.read(spark, f"{path}-compact")
    assert {r.commit_hash[0]: r.author for r in compact.collect()} == rows
    found = search.search(compact, words, "login bug").collect()
    assert found[0].commit_hash == "a" * 12


def scanned(df):
    """The numbers of files and rows that the scans of a query have read, run without re-planning."""
    with settings(df.sparkSession, {"spark.sql.adaptive.enabled": "false"}):
        again = df.select("*")
        again.collect()
        leaves = again._jdf.queryExecution().executedPlan().collectLeaves()
    found = {"numFiles": 0, "numOutputRows": 0}
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        for name in found:
            if metrics.contains("numFiles") and metrics.contains(name):
                found[name] += metrics.get(name).get().value()
    return found["numFiles"], found["numOutputRows"]


@pytest.fixture(scope="module")
def many_batches(spark, tmp_path_factory):
    """A store of 50 batches, of which later ones repeat some commits of earlier ones."""
    path = str(tmp_path_factory.mktemp("store") / "index")
    for n in range(50):
        names = [hashlib.md5(str(i).encode()).hexdigest()[:12] for i in range(n * 4, n * 4 + 6)]
        rows = [(h, f"m{n}", "a", dt.datetime(2024, 1, 1), [], "", "r", [(0, 1.0)] if n % 2 else None) for h in names]
        index_store.write_batch(spark.createDataFrame(rows, index_store.COMMIT).coalesce(1), path, n)
    return path


def test_a_batch_opens_only_files_that_can_hold_its_commits(spark, many_batches):
    names = [hashlib.md5(str(i).encode()).hexdigest()[:12] for i in (6, 17, 1_000)]  # in batches 1; 3 and 4; none
    asked = spark.createDataFrame([(n,) for n in names + ["", None]], "commit_hash string")
    found = index_store.known(spark, many_batches, asked)
    assert sorted(r.commit_hash for r in found.collect()) == sorted(names[:2])
    every = index_store._parts(spark, many_batches, index_store.KEY, "/keys")
    files, rows = scanned(found)
    assert files <= 3 * 50 and files < scanned(every)[0] / 3
    assert rows < scanned(every)[1] / 10  # what the files' statistics let through
    assert "In(commit_hash" in found._jdf.queryExecution().executedPlan().toString()
    before = index_store.known(spark, many_batches, asked, before=3)
    assert [r.commit_hash for r in before.collect()] == [names[0]]


def test_many_commits_are_joined(spark, many_batches, monkeypatch):
    asked = spark.createDataFrame([(hashlib.md5(str(i).encode()).hexdigest()[:12],) for i in range(60)], "commit_hash string")
    few = {r.commit_hash for r in index_store.known(spark, many_batches, asked).collect()}
    monkeypatch.setattr(index_store, "IN_FILTER", 5)
    assert {r.commit_hash for r in index_store.known(spark, many_batches, asked).collect()} == few and few


def test_folding_changes_no_result(spark, many_batches):
    whole = {r.commit_hash: r.message for r in index_store.read(spark, many_batches).collect()}
    keys = {r.commit_hash for r in index_store._parts(spark, many_batches, index_store.KEY, "/keys").collect()}
    index_store.fold(spark, many_batches, 40)
    assert index_store.folded(spark, many_batches) == 40
    assert {r.commit_hash: r.message for r in index_store.read(spark, many_batches).collect()} == whole
    rows = index_store._parts(spark, many_batches, index_store.KEY, "/keys")
    assert {r.commit_hash for r in rows.collect()} == keys
    assert {r.batch for r in rows.collect()} == set(range(40, 50))
    index_store.fold(spark, many_batches, 49)
    assert {r.commit_hash: r.message for r in index_store.read(spark, many_batches).collect()} == whole


def test_odd_inputs(history, built, spark):
    commits = ci.projection(history)
    assert search.search_by_files(commits, []).collect() == []
    assert search.search(*built, "").collect() == []
    nothing = voc.freeze(ci.fit(commits.limit(0)))
    assert nothing.terms == []
    bare = ci.index_full(history, nothing)
    assert {r.vector for r in bare.collect()} == {None}
    assert search.search(bare, nothing, "login").collect() == []
    assert search.similar_commits(bare, "a" * 12).collect() == []


# --- substrings ------------------------------------------------------------------


@pytest.fixture(scope="module")
def grams(spark, tmp_path_factory):
    texts = ["Fix the Login", "login 😀😀 page", "", "İstanbul ß", "a.b*c", "naïve café\nline"]
    rows = [(*r[:5], [f"Src/{i}.PY", "docs/a b.md"] if i % 2 else [], 1, 1) for i, r in enumerate(history_of(texts))]
    commits = ci.projection(spark.createDataFrame(rows, RAW))
    path = str(tmp_path_factory.mktemp("grams") / "g")
    gram_store.write(commits, path)
    return commits, path


def test_found_substrings_are_contained(spark, grams):
    commits, path = grams
    rows = commits.select("commit_hash", "message", "files").collect()
    patterns = ["login", "LOG", "n", "in", "😀", "😀😀", "gin 😀", "ß", "café\nl", "b*c", ".b", "xyz", "log1n", "", "src/1", "a b", "py docs", None]
    patterns += [r.message[i : i + 4] for r in rows for i in range(0, len(r.message), 3)]
    asked = spark.createDataFrame([(f, p) for f in gram_store.FIELDS for p in patterns], "field string, pattern string")
    lower = {p: spark.range(1).select(F.lower(F.lit(p))).first()[0] for p in set(patterns) if p}
    texts = {r.commit_hash: r for r in commits.select("commit_hash", F.lower(ci.index_text()).alias("text"), F.transform("files", F.lower).alias("files")).collect()}
    want = set()
    for p in lower.values():
        for h, r in texts.items():
            if p in r.text:
                want.add(("text", p, h))
            if any(p in f for f in r.files):
                want.add(("path", p, h))
    found = [tuple(r) for r in gram_store.find(spark, path, asked).collect()]
    assert set(found) == want and len(found) == len(want)


def test_a_pattern_reads_few_folders(spark, grams):
    _, path = grams
    runs = gram_store.pattern_runs(spark.createDataFrame([("text", "logi")], "field string, pattern string"))
    table = spark.read.schema(gram_store.GRAM).parquet(f"{path}/grams")
    read = gram_store._only(table, runs, "gram")
    buckets = {r.bucket for r in runs.collect()}
    assert scanned(read)[0] <= 2 * len(buckets) and scanned(read)[0] < scanned(table)[0] / 4
    assert {r.gram for r in read.collect()} == {"log", "ogi"}


@pytest.mark.parametrize("together", [3, 50_000])
def test_runs_are_packed_and_pairs_are_only_made_where_found(spark, tmp_path, monkeypatch, together):
    monkeypatch.setattr(gram_store, "TOGETHER", together)
    draw, path = random.Random(3), str(tmp_path / "g")
    texts = ["".join(draw.choices("aB é😀\0", k=draw.randrange(40))) + " common" for _ in range(300)]
    rows = history_of(texts)
    rows += [(*rows[5][:1], "other aab text", *rows[5][2:5], ["Other/a.py", None], 1, 1), (None, *rows[6][1:])]
    commits = ci.projection(spark.createDataFrame(rows, RAW).repartition(3))
    gram_store.write(commits, path)
    table = spark.read.schema(gram_store.GRAM).parquet(f"{path}/grams")
    # a row for a run and block, not one for each text that has it
    assert table.count() < table.agg(F.sum("n")).first()[0] / 2
    lower = lambda t: spark.range(1).select(F.lower(F.lit(t))).first()[0]
    values = [(r.commit_hash, r.text) for r in commits.select("commit_hash", F.lower(ci.index_text()).alias("text")).collect() if r.commit_hash]
    patterns = ["a", "b\0", "aab", "common", "é😀", "on", "other/a", "zz"] + [lower(t[3:12]) for t in texts[::20]]
    asked = spark.createDataFrame([("text", p) for p in patterns] + [("path", "R/A")], "field string, pattern string")
    want = {("text", p, h) for p in patterns if p for h, t in values if p in t} | {("path", "r/a", rows[5][0][:12])}
    found = [tuple(r) for r in gram_store.find(spark, path, asked).collect()]
    assert set(found) == want and len(found) == len(want)


@pytest.mark.parametrize(("chars", "pairs"), [(1, 1), (50, 400), (10**6, 10**6)])
def test_packed_runs_are_those_of_the_texts(monkeypatch, chars, pairs):
    monkeypatch.setattr(gram_store, "CHARS", chars)
    monkeypatch.setattr(gram_store, "PAIRS", pairs)
    draw = random.Random(4)
    rows = [(i // 900, i % 900, ["".join(draw.choices("ab😀\0", k=draw.randrange(6))) for _ in range(i % 3)]) for i in range(1_200)]
    batches = [
        pa.record_batch([pa.array(["text"] * len(part)), *(pa.array(c) for c in zip(*part, strict=True))], names=["field", "block", "place", "values"])
        for part in (rows[:500], rows[500:])
    ]
    want, got = set(), []
    for block, place, values in rows:
        want |= {(block, v[i : i + n], place) for v in values for n in (1, 2, 3) for i in range(len(v) - n + 1)}
    for batch in gram_store._postings(iter(batches)):
        for field, gram, block, n, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bits = gram_store._bits(held)
            places = [p for p in range(gram_store.PLACES) if bits[p // 8] >> p % 8 & 1]
            assert field == "text" and len(places) == n and len(held) == min(2 * n, 512)
            got += [(block, gram, p) for p in places]
    assert set(got) == want and len(got) == len(want)


def test_patterns_are_matched_by_their_heads(monkeypatch):
    draw = random.Random(5)
    texts = ["".join(draw.choices("ab\0é", k=30)) for _ in range(20)]
    patterns = [t[i : i + n] for t in texts[:4] for i in range(0, 20, 3) for n in (1, 3, 8, 9, 12)] + ["zz", texts[0], texts[0] + "a"]
    values = [texts[i : i + 2] for i in range(0, 20, 2)]
    batch = pa.record_batch([pa.array(["text"] * 10), pa.array(list("0123456789")), pa.array(values)], names=["field", "commit_hash", "values"])
    want = {("text", p, str(i)) for p in patterns for i, v in enumerate(values) if any(p in t for t in v)}
    for few in (0, 10**6):
        monkeypatch.setattr(gram_store, "FEW", few)
        asked = [("text", p) for p in set(patterns)] + [("path", "a")]
        found = [r for out in gram_store._match(asked)(iter([batch])) for r in zip(*(c.to_pylist() for c in out.columns))]
        assert set(found) == want and len(found) == len(want)


# --- statistics by batches ----------------------------------------------------------


def test_statistics_by_batches_equal_a_full_fit(spark, tmp_path):
    draw, path, now = random.Random(6), str(tmp_path / "terms"), {}
    words = ["fix", "bug", "alpha", "beta", "gamma", "delta", "Zeta", "x1"]
    for batch in range(4):
        chosen = draw.sample(range(40), 15)
        rows = [
            (hashlib.md5(str(i).encode()).hexdigest(), " ".join(draw.choices(words, k=draw.randrange(6))), "x", "r", draw.choice([5, 60 * i]), [], 1, 1)
            for i in chosen
        ]
        now |= {r[0]: r for r in rows}
        term_store.add_batch(ci.projection(spark.createDataFrame(rows, RAW)), path, batch)
        live = ci.projection(spark.createDataFrame(list(now.values()), RAW))
        want = ci.fit(live, 100).collect()
        assert term_store.vocabulary_after(spark, path, batch, 100).collect() == want
    term_store.add_batch(ci.projection(spark.createDataFrame(rows, RAW)), path, 3)  # run again
    assert term_store.vocabulary_after(spark, path, 3, 100).collect() == want


# --- all terms ------------------------------------------------------------------


def history_of(texts):
    """Raw commits of these messages, a minute apart, without files."""
    return [
        (hashlib.md5(str(i).encode()).hexdigest(), t, "x", "r", 1_704_067_200 + 60 * i, [], 1, 1) for i, t in enumerate(texts)
    ]


@pytest.fixture(scope="module")
def wide(spark):
    """More terms than a vocabulary of leading terms has; two commits share one rare word only."""
    texts = ["zeta kilo rareword", "rareword lima mike"]
    texts += [f"alpha beta rare{i // 2} " + " ".join(f"w{i}x{j} w{i}x{j}" for j in range(4)) for i in range(200)]
    texts += ["", "?", "alpha " * 50]
    history = spark.createDataFrame(history_of(texts), RAW)
    rows = ci.projection(history)
    index = term_index.vectorise(rows, term_index.fit(rows))
    return texts, history, index


def unit_vectors(texts):
    counts = [Counter(re.findall(r"(?<!\w)[a-z][a-z0-9_]{1,20}(?!\w)", t.lower())) for t in texts]
    df = Counter(w for c in counts for w in c)
    rows = [{w: n * (math.log((len(texts) + 1) / (df[w] + 1)) + 1) for w, n in c.items()} for c in counts]
    return [{w: x / math.sqrt(sum(v * v for v in r.values())) for w, x in r.items()} for r in rows]


def test_vectors_have_every_term(wide):
    texts, _, index = wide
    want = {hashlib.md5(str(i).encode()).hexdigest()[:12]: v for i, v in enumerate(unit_vectors(texts))}
    got = {r.commit_hash: dict(r.vector) for r in index.collect()}
    assert set(got) == set(want)
    for name, vector in want.items():
        assert got[name] == pytest.approx(vector)


def test_a_rare_word_finds_its_commits(spark, wide, tmp_path):
    texts, history, index = wide
    term_index.save(term_index.fit(ci.projection(history)), str(tmp_path / "s"))
    statistics = term_index.load(spark, str(tmp_path / "s"))
    found = term_index.find(index, statistics, "rare7 unknown", top_k=5, min_score=0.2).collect()
    assert sorted(r.message for r in found) == sorted(texts[16:18])
    leading = voc.freeze(ci.fit(ci.projection(history)))
    assert "rare7" not in leading.terms and "rareword" not in leading.terms
    near = term_index.similar_to(index, hashlib.md5(b"0").hexdigest(), top_k=1).first()
    assert near.message == texts[1]
    assert term_index.find(index, statistics, "unknown words", min_score=0.01).collect() == []
    new = term_index.find_or_index(history, index, statistics, "rare7", "r", 2).collect()
    assert [r.message for r in new] == [r.message for r in term_index.find_or_index(history, None, None, "rare7", "r", 2).collect()]


def test_frequent_and_rare_terms_meet_alike(wide, monkeypatch):
    _, history, index = wide
    rows = ci.projection(history)
    for frequent, most in ((1, 10**9), (10**9, 1)):
        monkeypatch.setattr(joins, "FREQUENT", frequent)
        monkeypatch.setattr(joins, "MOST_FREQUENT", most)
        again = term_index.vectorise(rows, term_index.fit(rows))
        assert {r.commit_hash: r.vector for r in again.collect()} == {r.commit_hash: r.vector for r in index.collect()}


def test_incremental_and_full_runs_over_all_terms(spark, wide):
    _, history, index = wide
    known = index.orderBy("commit_hash").limit(50)
    rest = term_index.index_incremental(history, known, term_index.fit(ci.projection(history)))
    assert {r.commit_hash: r.vector for r in rest.union(known.select(*rest.columns)).collect()} == {
        r.commit_hash: r.vector for r in index.collect()
    }
    other = spark.createDataFrame([(hashlib.md5(b"0").hexdigest(), "changed", "x", "r", 5, [], 1, 1)], RAW)
    full = {r.commit_hash: r.message for r in term_index.index_full(other, None, index).collect()}
    assert len(full) == index.count() and full[hashlib.md5(b"0").hexdigest()[:12]] == "changed"


@pytest.mark.parametrize("block_terms", [10, 10**6])
def test_many_sources_equal_all_pairs(spark, wide, monkeypatch, block_terms):
    monkeypatch.setattr(term_index, "BLOCK_TERMS", block_terms)
    texts, _, index = wide
    names = [hashlib.md5(str(i).encode()).hexdigest()[:12] for i in range(len(texts))]
    vectors = unit_vectors(texts)
    chosen = [*range(0, len(texts), 20), len(texts) - 1, len(texts) - 3]
    sources = spark.createDataFrame([(names[i],) for i in [*chosen, chosen[0]]] + [("unknown",)], "commit_hash string")
    found = term_index.similar_to_many(index, sources, top_k=3, block=4).collect()
    want = set()
    for i in chosen:
        scores = [(round(sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), 9), j) for j in range(len(texts)) if j != i]
        best = sorted(scores, key=lambda s: (-s[0], -s[1]))[:3]
        want |= {(names[i], names[j], rank + 1) for rank, (score, j) in enumerate(best) if score > 0.1}
    assert {(r.source_hash, r.commit_hash, r.rank) for r in found} == want
    assert len(found) == len(want)


@pytest.mark.parametrize(("share", "cells"), [(1, 1), (4, 70), (12, 10**6), (10**9, 10**6)])
def test_products_of_matrices_are_dot_products(monkeypatch, share, cells):
    monkeypatch.setattr(term_index, "DENSE_SHARE", share)
    monkeypatch.setattr(term_index, "CELLS", cells)
    draw = random.Random(7)
    vectors = [{f"t{draw.randrange(60) // draw.randrange(1, 30)}": draw.random() for _ in range(draw.randrange(12))} for _ in range(60)]
    block = term_index._block([(str(i), [{"term": t, "weight": w} for t, w in v.items()]) for i, v in enumerate(vectors[:25])])
    terms = [block.terms.index(t) if t in block.terms else -1 for v in vectors for t in v]
    weights, offsets = [w for v in vectors for w in v.values()], [0]
    for v in vectors:
        offsets.append(offsets[-1] + len(v))
    scores = term_index._scores(block, *(np.array(x) for x in (terms, weights, offsets)))
    for i, row in enumerate(vectors):
        assert list(scores[i]) == pytest.approx([sum(x * v.get(t, 0) for t, x in row.items()) for v in vectors[:25]])


@pytest.mark.parametrize("share", [1, 12, 10**9])
def test_many_sources_meet_all_commits_in_one_scan(spark, wide, monkeypatch, share):
    monkeypatch.setattr(term_index, "DENSE_SHARE", share)
    scans, scan = [], term_index._scan
    monkeypatch.setattr(term_index, "_scan", lambda part, *rest: scans.append(len(part)) or scan(part, *rest))
    texts, _, index = wide
    vectors = unit_vectors(texts)
    names = [hashlib.md5(str(i).encode()).hexdigest()[:12] for i in range(len(texts))]
    sources = spark.createDataFrame([(names[i],) for i in range(150)], "commit_hash string")
    found = {(r.source_hash, r.commit_hash, r.rank): r.score for r in term_index.similar_to_many(index, sources, top_k=4).collect()}
    want = {}
    for i in range(150):
        scores = [(round(sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), 9), j) for j in range(len(texts)) if j != i]
        for rank, (score, j) in enumerate(sorted(scores, reverse=True)[:4]):
            if score > 0.1:
                want[names[i], names[j], rank + 1] = score
    assert found.keys() == want.keys() and found == pytest.approx(want)
    assert scans == [150]


def test_only_scores_that_can_enter_are_ranked(monkeypatch):
    ranked = []
    push = term_index.heappushpop
    monkeypatch.setattr(term_index, "heappushpop", lambda heap, row: ranked.append(row) or push(heap, row))
    vector = lambda w: [{"term": "a", "weight": w}]
    rows = [("s", 9, vector(1.0)), *((f"c{i:03}", i, vector(1 - i // 2 / 400)) for i in range(300))]
    kinds = pa.schema([("h", pa.string()), ("t", pa.timestamp("us")), ("v", pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())])))])
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)
    (found,) = term_index._scan([("s", vector(1.0))], 3, 0.1)([batch])
    # of equal scores the newer one stays
    assert sorted(found.column(1).to_pylist()) == ["c000", "c001", "c003"]
    assert len(ranked) <= 3


def test_the_full_index_makes_its_vectors_once(wide):
    _, history, index = wide
    rows = ci.projection(history)
    statistics = term_index.fit(rows)
    statistics = term_index.TermStatistics(materialise(statistics.table, "statistics"), statistics.docs)
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("posexplode")
    existing = materialise(index, "existing")
    assert count(term_index.index_full(history, statistics, existing)) == count(term_index.index_full(history, statistics))
