"""Plan properties that keep the jobs balanced on large inputs."""

import re

import pytest
from pyspark.sql import functions as F
from test_activity import EVENT, random_events
from test_commits import RAW, ROWS

from driftline import fixed_values as fv
from driftline.operators import commit_index as ci
from driftline.operators import flow, injection, intent, search, sensitive, settings
from driftline.operators import sessions as ses
from driftline.operators import vocabulary as voc


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "a@bb.com")], "id int, text string")


@pytest.mark.parametrize(
    "job",
    [
        lambda t: sensitive.quick_filter(t),
        lambda t: sensitive.findings(t, ["id"]),
        lambda t: sensitive.sanitize(t),
        lambda t: sensitive.summary(t, ["id"]),
        lambda t: injection.findings(t, ["id"]),
        lambda t: injection.risk(t, ["id"]),
        lambda t: injection.with_security_flags(t),
        lambda t: voc.token_rows(t, "id"),
        lambda t: t.select(intent.alignment(F.col("text"), F.col("text"))),
    ],
)
def test_work_on_one_text_moves_no_rows(texts, job):
    assert "Exchange" not in plan(job(texts))


def test_each_text_is_scanned_once(texts):
    # a filter on the array's size below the projection would compute it twice
    text = plan(sensitive.findings(texts, ["id"]))
    assert "Filter (size(" not in text and text.count("Generate ") == 1


def test_newest_per_repo_ranks_keys_in_parts(spark):
    commits = ci.projection(spark.createDataFrame(ROWS, RAW))
    text = plan(ci.newest_per_repo(commits, 2))
    assert text.count("WindowGroupLimit") == 4 and "__salt" in text
    assert not any("message" in line for line in text.splitlines() if "Window" in line)


def test_search_keeps_a_running_top_k(spark):
    history = spark.createDataFrame(ROWS, RAW)
    words = voc.freeze(ci.fit(ci.projection(history)))
    commits = ci.vectorise(ci.projection(history), words)
    text = plan(search.search(commits, words, "login"))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text.split("Subquery")[0]


def test_a_search_makes_each_vector_once(spark):
    # a filter on the score below the limit would be pushed to the scan, and make texts into vectors for itself
    commits = ci.projection(spark.createDataFrame(ROWS, RAW))
    words = voc.freeze(ci.fit(commits))
    made = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    vectors = ci.vectorise(commits, words)
    assert made(vectors) == 1
    # the query and the source of a comparison have a vector of their own
    assert made(search.search(vectors, words, "login")) == 2
    assert made(search.similar_commits(vectors, "a" * 12)) == 3


def test_only_messages_with_whitespace_at_an_end_are_trimmed(spark):
    message = ci.projection(spark.createDataFrame(ROWS, RAW)).select("message")
    text = message._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"CASE WHEN RLIKE\(concat\(.*THEN regexp_replace", text, re.S)


def test_events_are_shuffled_by_agent_and_time(spark):
    events = spark.createDataFrame(random_events(50, 1), EVENT)
    text = plan(ses.session_stamp(events))
    wide = re.findall(r"Window \[last\(.*?\], \[(.*?)\], \[ts#", text)
    assert wide and all("__bucket" in keys for keys in wide)


def test_hot_repositories_are_salted(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changes = spark.createDataFrame([("r", "a.py")], "repo string, path string")
        files = spark.createDataFrame([("r", "*.py")], "repo string, content string")
        text = plan(flow.without_ignored(changes, files))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("__salt" in keys for keys in re.findall(r"hashpartitioning\((.*?)\)", text))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_a_side_that_repetition_makes_large_is_not_broadcast(spark):
    # the estimate knows 2 numbers for each of 30,000 rows; repeated with their texts they are far over Spark's limit
    changes = spark.range(30_000).select(F.col("id").alias("repo"), F.lit("a.py").alias("path"))
    files = spark.range(30_000).select(F.col("id").alias("repo"), F.concat(F.lit("*.p"), F.col("id").cast("string")).alias("content"))
    out = flow.without_ignored(changes, files)
    text = plan(out)
    assert "BroadcastHashJoin" not in text and "BroadcastExchange" not in text and "SortMergeJoin" in text
    assert out.count() == 30_000
    few = flow.without_ignored(changes, files.filter("repo < 100"))
    assert "BroadcastHashJoin" in plan(few) and few.count() == 30_000


def test_settings_and_thresholds_of_many_repositories_are_not_broadcast(spark):
    # Spark takes 300,000 rows of a number for 2 MB; their texts and values have more
    repos = spark.range(300_000).select(F.col("id").alias("repo"))
    files = repos.select("repo", F.format_string('{"max_lines_uncommitted": %d}', F.col("repo") + 1).alias("content"))
    limits = repos.select("repo", *[F.lit(9.0).alias(k) for k in fv.CONFIG_KEYS])
    metrics = repos.select("repo", F.lit("b").alias("branch_name"), *[F.lit(1).alias(m) for m in flow.METRICS])
    flags = repos.select("repo", F.array(F.lit("x")).alias("security_flags"))
    big = lambda out: "BroadcastHashJoin" not in plan(out) and "BroadcastExchange" not in plan(out)
    assert big(settings.effective_config(repos, files))
    assert big(flow.flow_state(metrics, limits))
    assert big(settings.config_updates(repos.withColumn("request", F.lit("{}")), limits))
    few = [t.filter("repo < 100") for t in (limits, flags)]
    assert plan(flow.flow_state(metrics, *few)).count("BroadcastHashJoin") == 2
