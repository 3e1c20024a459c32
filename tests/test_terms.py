import random

import brute
import pytest
from pyspark.sql import functions as F

from driftline.functions.terms import term_counts, term_places, tokens
from driftline.operators import vocabulary as voc

DOCS = [
    "fix the bug behind a slow login page",
    "add new feature for user profile, user profile",
    "refactor how the database pool is sized",
    "naïve été x xy a1_b2 9lives _under café's İstanbul ǅ",
    "a" * 21 + " " + "b" * 22 + " " + "c" * 23,
    "",
    "tie1 tie2 tie3 tie3 tie2 tie1 Kelvin",
    "café one² two½ three_Ⅰ",
]


def test_tokens(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, text string")
    got = {r.id: r.t for r in df.select("id", tokens(F.col("text")).alias("t")).collect()}
    assert got == {i: brute.tokens(d) for i, d in enumerate(DOCS)}


def test_counts_and_places(spark):
    rng = random.Random(1)
    docs = [[rng.choice("abcdefg") for _ in range(n)] for n in (0, 1, 2, 50, 400)]
    df = spark.createDataFrame([(d,) for d in docs], "w array<string>")
    for row in df.select("w", term_counts(F.col("w")).alias("c"), term_places(F.col("w")).alias("p")).collect():
        assert [(x.term, x.n) for x in row.c] == [(t, row.w.count(t)) for t in sorted(set(row.w))]
        assert [(x.term, x.places) for x in row.p] == [
            (t, [i for i, w in enumerate(row.w) if w == t]) for t in sorted(set(row.w))
        ]


@pytest.mark.parametrize("size", [3, 10, 500])
def test_fit_and_vectors(spark, size):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, text string").repartition(3)
    fitted = voc.fit(df, F.col("id"), size=size)
    want = brute.fit(DOCS, size)
    rows = sorted(fitted.collect())
    assert [r.term for r in rows] == list(want)
    assert [r.idx for r in rows] == list(range(len(want)))
    assert [r.idf for r in rows] == pytest.approx(list(want.values()))
    frozen = voc.freeze(fitted, size)
    vectors = {r.id: r.vector for r in voc.vectors(df, frozen).collect()}
    for i, d in enumerate(DOCS):
        got = {frozen.terms[e.idx]: e.weight for e in vectors[i]}
        assert got == pytest.approx(brute.vector(d, want))


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([(1, "test document"), (2, "another doc")], "id int, text string")
    fitted = voc.fit(df, F.col("id"))
    voc.save(fitted, str(tmp_path / "v"))
    assert voc.load(spark, str(tmp_path / "v")) == voc.freeze(fitted)
    with pytest.raises(ValueError):
        voc.load(spark, str(tmp_path / "v"), size=2)


def test_no_shuffle_for_vectors(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, text string")
    frozen = voc.freeze(voc.fit(df, F.col("id")))
    plan = voc.vectors(df, frozen)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
