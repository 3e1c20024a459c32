import random

import brute
import pytest
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.operators import intent


@pytest.mark.parametrize(
    "url,slug",
    [
        ("git@github.com:owner/repo.git", "owner/repo"),
        ("https://github.com/owner/repo", "owner/repo"),
        ("https://github.com/owner/repo.git", "owner/repo"),
        ("https://git.example.org/owner/repo.git", None),
        (None, None),
    ],
)
def test_slug(spark, url, slug):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(intent.repo_slug(F.col("u"))).first()[0] == slug


def random_text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_alignment(spark):
    rng = random.Random(4)
    many = [f"w{i}x" for i in range(900)] + list(fv.TECH_TERMS)
    pairs = [
        ("fix login bug", "fix the login bug now"),
        ("", "abc def"),
        ("abc", ""),
        ("", ""),
        ("one two", "three four"),
        *[(random_text(rng, many, a), random_text(rng, many, b)) for a, b in ((20, 60), (300, 900), (2000, 2500), (3, 4000))],
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    rows = df.select("id", intent.alignment(F.col("a"), F.col("b")).alias("s")).collect()
    want = [brute.cosine(a, b, brute.fit([a, b], None)) for a, b in pairs]
    assert [r.s for r in sorted(rows)] == pytest.approx(want)
    few = df.select("id", intent.alignment(F.col("a"), F.col("b"), fv.VOCABULARY_SIZE).alias("s")).collect()
    assert [r.s for r in sorted(few)] == pytest.approx([brute.cosine(a, b, brute.fit([a, b])) for a, b in pairs])
    assert any(len(set(brute.tokens(a + " " + b))) > 500 for a, b in pairs)


@pytest.fixture(scope="module")
def pairs(spark):
    tickets = spark.createDataFrame(
        [(1, "o/r", "Fix login bug", "The login form breaks"), (2, "o/r", "Cleanup", None)],
        "ticket_id int, repo string, title string, body string",
    )
    remote = "git@github.com:o/r.git"
    diffs = spark.createDataFrame(
        [
            (10, 1, remote, "fix login bug in the login form", None),
            (11, 1, remote, "REFACTOR and cleanup of colours", ""),
            (12, 2, remote, "cleanup only", None),
            (13, 3, remote, "whatever", None),
            (14, None, remote, "whatever", None),
            (15, 1, "https://git.example.org/o/r.git", "whatever", None),
            (16, 1, remote, "ignored diff with refactor", "login form"),
        ],
        "id int, ticket_id int, remote_url string, diff string, context string",
    )
    return intent.with_tickets(diffs, tickets, "id")


def test_verdicts(pairs):
    got = {r.id: r for r in intent.verdicts(pairs).collect()}
    assert len(got) == 7
    assert got[10].is_aligned and got[10].alignment_score > 0.3 and got[10].scope_creep_warnings == []
    assert not got[11].is_aligned and got[11].scope_creep_warnings == [w for _, w in fv.SCOPE_WORDS]
    assert got[12].scope_creep_warnings == [] and got[12].ticket_summary == "Cleanup"
    for i in (13, 15):
        assert (got[i].alignment_score, got[i].is_aligned) == (0.5, True)
        assert got[i].scope_creep_warnings == [fv.TICKET_MISSING_WARNING]
    assert got[13].ticket_summary == "Issue #3 (Data not fetched)"
    assert (got[14].alignment_score, got[14].is_aligned, got[14].missing_criteria) == (0.0, False, [fv.NO_TICKET])
    assert got[16].diff == "login form" and got[16].scope_creep_warnings == []


def test_prompts(pairs, spark):
    long = "a@bb.com " + "x" * 13000
    whole = intent.judge_prompts(pairs.withColumn("diff", F.lit(long))).collect()
    assert {r.id for r in whole} == {10, 11, 12, 16} and all("x" * 13000 in r.prompt for r in whole)
    rows = intent.judge_prompts(pairs.withColumn("diff", F.lit(long)), fv.PROMPT_CHARS).collect()
    text = ("[REDACTED_EMAIL_1] " + "x" * 13000)[:12000] + "\n...[TRUNCATED]"
    first = next(r for r in rows if r.id == 10)
    assert first.prompt == fv.PROMPT_TEMPLATE % ("Fix login bug", "The login form breaks", fv.PROMPT_DIFF_STAT, text)


REPLIES = {
    '{"aligned": true, "scope_creep": false, "reason": "good"}': (True, True, 1.0, [], "good"),
    ' ```json\n{"aligned": false, "scope_creep": true}\n``` ': (True, False, 0.4, [fv.JUDGE_SCOPE_CREEP], fv.JUDGE_NO_REASON),
    '```\n{"reason": "plain"}\n```': (True, True, 1.0, [], "plain"),
    "{}": (True, True, 1.0, [], fv.JUDGE_NO_REASON),
    '{"aligned": 0, "scope_creep": "yes"}': (True, False, 0.4, [fv.JUDGE_SCOPE_CREEP], fv.JUDGE_NO_REASON),
    '{"aligned": null}': (True, False, 0.4, [], fv.JUDGE_NO_REASON),
    '{"aligned": tru': (False, None, None, None, None),
    "no json": (False, None, None, None, None),
    "[1]": (False, None, None, None, None),
    "": (False, None, None, None, None),
}


def test_judge_verdicts(spark):
    df = spark.createDataFrame([(k,) for k in REPLIES], "raw_reply string")
    for r in intent.judge_verdicts(df).collect():
        assert (r.parsed, r.judge_aligned, r.judge_score, r.judge_warnings, r.judge_reason) == REPLIES[r.raw_reply]


def test_fallback(pairs, spark):
    replies = spark.createDataFrame(
        [(10, '{"aligned": false, "reason": "no"}'), (11, "broken"), (13, '{"aligned": false}')], "id int, raw_reply string"
    )
    out = intent.with_fallback(intent.verdicts(pairs), intent.judge_verdicts(replies), "id")
    got = {r.id: r for r in out.collect()}
    assert (got[10].alignment_score, got[10].is_aligned, got[10].reasoning) == (0.4, False, "no")
    assert got[11].reasoning == fv.FALLBACK_REASON and not got[11].is_aligned
    assert got[12].reasoning == fv.FALLBACK_REASON
    assert (got[13].alignment_score, got[13].reasoning) == (0.5, "")
