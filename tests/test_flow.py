import datetime as dt
import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.globs import ignore_regex
from driftline.operators import flow, ignore_rules, settings

METRIC_SCHEMA = (
    "repo string, branch_name string, minutes_since_last_commit int, uncommitted_lines int, "
    "uncommitted_files int, branch_age_days int, behind_main_by_commits int"
)
LIMIT_SCHEMA = "repo string, max_minutes_without_commit double, max_lines_uncommitted double"


def states(spark, metrics, limits=(), flags=None):
    rows = [(f"r{i}", "b", *m) for i, m in enumerate(metrics)]
    flagged = None
    if flags is not None:
        flagged = spark.createDataFrame(flags, "repo string, security_flags array<string>")
    out = flow.flow_state(
        spark.createDataFrame(rows, METRIC_SCHEMA),
        spark.createDataFrame(list(limits), LIMIT_SCHEMA),
        flagged,
    )
    return out


def test_status_boundaries(spark):
    cases = [((60, 500), "ok"), ((61, 0), "warning"), ((90, 0), "warning"), ((91, 0), "danger"),
             ((0, 501), "warning"), ((0, 750), "warning"), ((0, 751), "danger")]
    out = states(spark, [(m, l, 0, 0, 0) for (m, l), _ in cases])
    got = {r.repo: r.status for r in out.collect()}
    assert [got[f"r{i}"] for i in range(len(cases))] == [s for _, s in cases]


def test_own_limits(spark):
    out = states(spark, [(20, 0, 0, 0, 0)], [("r0", 10.0, None)])
    assert out.first().status == "danger"


def test_recommendations(spark):
    out = states(spark, [(0, 0, 10, 7, 10), (125, 1001, 11, 8, 11), (61, 501, 0, 0, 0), (59, 0, 0, 0, 0)],
                 [("r3", 30.0, None)])
    got = {r.repo: r.recommendations for r in out.collect()}
    assert got["r0"] == [fv.NUDGE_HEALTHY]
    assert got["r1"] == [
        fv.NUDGE_TIME % "2h 5m", fv.NUDGE_LINES % 1001, fv.NUDGE_VERY_LARGE,
        fv.NUDGE_FILES % 11, fv.NUDGE_AGE % 8, fv.NUDGE_BEHIND % 11,
    ]
    assert got["r2"] == [fv.NUDGE_TIME % "1h 1m", fv.NUDGE_LINES % 501]
    assert got["r3"] == [fv.NUDGE_TIME % "59 minutes"]


def test_gate_and_security_line(spark):
    out = states(spark, [(0, 0, 0, 0, 0), (70, 0, 0, 0, 0), (0, 0, 0, 0, 0)], flags=[("r2", ["x"])])
    assert {r.repo: r.exit_code for r in flow.health_gate(out).collect()} == {"r0": 0, "r1": 1, "r2": 2}
    odd = out.withColumn("status", F.lit(None).cast("string"))
    assert {r.exit_code for r in flow.health_gate(odd).collect()} == {3, 2}
    got = {r.repo: r for r in flow.secure_recommendations(out).collect()}
    assert got["r2"].recommendations == [fv.NUDGE_SECURITY, fv.NUDGE_HEALTHY]
    assert got["r0"].summary.branch_name == "b"


def test_times(spark):
    ts = dt.datetime
    commits = spark.createDataFrame(
        [("r", 1, "work", ts(2024, 1, 1)), ("r", 2, "work", ts(2024, 1, 9, 23, 59, 30)), ("r", 3, "main", ts(2024, 1, 5))],
        "repo string, commit int, branch string, ts timestamp",
    )
    heads = spark.createDataFrame(
        [("r", "work", 2), ("empty", "main", None)], "repo string, branch_name string, commit int"
    )
    loose = spark.createDataFrame([("r", None, 3)], "repo string, branch_name string, commit int")
    as_of = "2024-01-10 00:01:29"
    minutes = flow.minutes_since_commit(heads, commits, as_of).collect()
    assert dict(map(tuple, minutes)) == {"r": 1, "empty": 0}
    # a checked-out commit counts without a branch
    assert flow.minutes_since_commit(loose, commits, as_of).first()[1] == 5 * 24 * 60 + 1
    for mode, days in (("first", 9), ("head", 0)):
        got = flow.branch_age_days(heads, commits, as_of, mode).collect()
        assert dict(map(tuple, got)) == {"r": days, "empty": 0}
    future = flow.branch_age_days(heads, commits, "2023-01-01 00:00:00").collect()
    assert dict(map(tuple, future)) == {"r": 0, "empty": 0}
    repos = spark.createDataFrame([("r",), ("detached",)], "repo string")
    assert dict(map(tuple, flow.current_branches(repos, heads).collect())) == {"r": "work", "detached": "HEAD"}


def test_uncommitted(spark):
    rows = [("r", "a.py", "staged", 3, 1), ("r", "a.py", "unstaged", 2, 0), ("r", "new.py", "untracked", 50, 0),
            ("u", "only.py", "untracked", 9, 0)]
    df = spark.createDataFrame(rows, "repo string, path string, kind string, insertions int, deletions int")
    got = {r.repo: (r.uncommitted_files, r.uncommitted_lines) for r in flow.uncommitted_stats(df).collect()}
    assert got == {"r": (2, 6), "u": (1, 0)}


def test_stat_log(spark):
    rows = [("r", " 1 file changed, 3 insertions(+), 4 deletions(-)"), ("r", " 1 file changed, 1 insertion(+)"),
            ("r", " 2 files changed, 1 deletion(-)"), ("r", ""), ("s", "")]
    got = flow.lines_from_stat_log(spark.createDataFrame(rows, "repo string, stat string")).collect()
    assert dict(map(tuple, got)) == {"r": 9, "s": 0}


PATHS = ["a.py", "dir/a.py", "dir/sub/b.txt", "dirx/a.py", "x.log", "deep/x.log", "file[1].txt", "file1.txt", "a+b.c", "docs"]
PATTERNS = ["dir", "dir/", "*.log", "file[1].txt", "file[!2].txt", "d?r/*", "a+b.c", "*", "doc?", "a.p", "[", "x[", "a[^x]py"]


def excluded(path, pattern):
    """A path is excluded as file, below a directory, or by a whole-path wildcard."""
    literal = path == pattern or path.startswith(pattern if pattern.endswith("/") else pattern + "/")
    wild = any(c in pattern for c in "*?[") and not pattern.rstrip().endswith("[")
    return literal or (wild and fnmatch.fnmatchcase(path, pattern.replace("[^", "[!")))


@pytest.mark.parametrize("pattern", PATTERNS)
def test_ignore_patterns(spark, pattern):
    changes = spark.createDataFrame([("r", p) for p in PATHS], "repo string, path string")
    files = spark.createDataFrame([("r", f"# note\n\n  {pattern} \n"), ("other", "*")], "repo string, content string")
    got = {r.path for r in flow.without_ignored(changes, files).collect()}
    assert got == {p for p in PATHS if not excluded(p, pattern)}


@pytest.mark.parametrize("seed", [1, 2])
def test_patterns_taken_apart_give_the_same_rows(spark, seed):
    draw = random.Random(seed)
    parts = ["a", "b.py", "dir", "sub", "x.log", "[1]", "a+b"]
    paths = PATHS + ["/".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(80)] + ["", "a/"]
    changes = spark.createDataFrame([(r, p, i) for i, p in enumerate(paths) for r in ("r", "s", "t", None)], "repo string, path string, n int")
    some = PATTERNS + ["**", "*.py", "dir*", "*a*", "sub/", "dir/sub", "# c", "", "é*", "*/b.py"]
    files = spark.createDataFrame([(r, "\n".join(draw.sample(some, 6))) for r in ("r", "s")], "repo string, content string")
    want = sorted(map(repr, flow.without_ignored(changes, files).collect()))
    assert sorted(map(repr, ignore_rules.without_ignored(changes, files).collect())) == want
    assert 0 < len(want) < changes.count()


def test_ten_thousand_patterns(spark):
    content = "\n".join(f"src/f{i}.py\n*_{i}.log\ngen{i}*" for i in range(3_400))
    files = spark.createDataFrame([("r", content)], "repo string, content string")
    paths = [f"src/f{i}.py" for i in range(3_390, 3_410)] + ["a_12.log", "a_x.log", "gen7/b", "src/f1.pyc", "src/f1.py/below"]
    got = ignore_rules.without_ignored(spark.createDataFrame([("r", p) for p in paths], "repo string, path string"), files)
    assert {r.path for r in got.collect()} == {f"src/f{i}.py" for i in range(3_400, 3_410)} | {"a_x.log", "src/f1.pyc"}


def test_ignore_file_without_patterns(spark):
    df = spark.createDataFrame([("# only\n\n",), (None,)], "content string")
    assert [r[0] for r in df.select(ignore_regex(F.col("content"))).collect()] == [None, None]


def test_effective_config(spark):
    repos = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "repo string")
    files = spark.createDataFrame(
        [("a", '{"max_lines_uncommitted": 5, "intent": {"provider": "x"}}'), ("b", '{"broken": '), ("c", "[1]")],
        "repo string, content string",
    )
    rows = settings.effective_config(repos, files, '{"max_minutes_without_commit": 30, "extra": "e"}').collect()
    got = {(r.repo, r.key): (r.value, r.layer) for r in rows}
    assert got["a", "max_lines_uncommitted"] == ("5", "repo")
    assert got["a", "max_minutes_without_commit"] == ("30", "global")
    assert got["a", "intent"] == ('{"provider":"x"}', "repo")
    assert got["d", "extra"] == ("e", "global")
    for repo in "bcd":
        assert got[repo, "max_lines_uncommitted"] == ("500", "default")
    warned = settings.config_warnings(files).collect()
    assert {r.repo for r in warned} == {"b", "c"}
    assert len(settings.config_warnings(files, "{").collect()) == 5


def test_config_updates(spark):
    cases = {
        '{"max_lines_uncommitted": 7, "colour": 1}': (True, None, 60.0, 7.0),
        '{"max_lines_uncommitted": 7, "max_minutes_without_commit": 8}': (True, None, 8.0, 7.0),
        '{"max_lines_uncommitted": "7"}': (False, "max_lines_uncommitted", 60.0, 500.0),
        '{"max_lines_uncommitted": 7.0}': (False, "max_lines_uncommitted", 60.0, 500.0),
        '{"max_lines_uncommitted": 0}': (False, "max_lines_uncommitted", 60.0, 500.0),
        '{"max_minutes_without_commit": 5, "max_lines_uncommitted": null}': (False, "max_lines_uncommitted", 60.0, 500.0),
        '{"max_minutes_without_commit": -1, "max_lines_uncommitted": -1}': (False, "max_minutes_without_commit", 60.0, 500.0),
        '{"max_lines_uncommitted": -1, "max_minutes_without_commit": -1}': (False, "max_lines_uncommitted", 60.0, 500.0),
        '{"colour": 1}': (False, "", 60.0, 500.0),
        "{}": (False, "", 60.0, 500.0),
    }
    requests = spark.createDataFrame([(str(i), q) for i, q in enumerate(cases)], "repo string, request string")
    current = spark.createDataFrame([(str(i), 60.0, 500.0) for i in range(len(cases))], LIMIT_SCHEMA)
    got = {r.repo: r for r in settings.config_updates(requests, current).collect()}
    for i, (ok, key, minutes, lines) in enumerate(cases.values()):
        r = got[str(i)]
        assert (r.success, r.max_minutes_without_commit, r.max_lines_uncommitted) == (ok, minutes, lines)
        if not ok:
            assert r.error == (fv.CONFIG_BAD_VALUE % key if key else fv.CONFIG_NO_KEYS)


def test_patterns_with_wildcards_inside_are_looked_up_by_their_heads(spark):
    patterns = [f"s?c{i}*y" for i in range(300)] + ["ab?[0-9]*x", "é?é*z", "a?c[", "?*?", "#a?b*c", "a b?c*d"]
    rows = spark.createDataFrame([("r", p) for p in patterns] + [(None, "src*y?")], "repo string, pattern string")
    paths = ["src7.py", "s?c8y", "src300.px", "src12", "ab+5.x", "ab+a.x", "é😀é.z", "a?c[", "a?c[/b", "ac", "x", "", None]
    changes = spark.createDataFrame([(r, p) for r in ("r", "s", None) for p in paths], "repo string, path string")
    kinds = ignore_rules._kinds(rows)
    assert ignore_rules._rest(kinds).count() == 1 and kinds.filter("head IS NOT NULL").count() == 304
    some = rows.filter("pattern != '?*?'")
    got = sorted(map(repr, ignore_rules.without_matches(changes, some).collect()))
    files = spark.createDataFrame([("r", "\n".join(p for p in patterns if p != "?*?"))], "repo string, content string")
    want = flow.without_ignored(changes.filter("path IS NOT NULL"), files).unionByName(changes.filter("path IS NULL"))
    assert got == sorted(map(repr, want.collect())) and len(got) == 39 - 6


@pytest.mark.parametrize("repos", [1, 8_192])
def test_only_patterns_that_some_piece_may_equal_are_joined(spark, monkeypatch, repos):
    monkeypatch.setattr(ignore_rules, "_REPOS", repos)
    asked, keys = [], ignore_rules._keys
    monkeypatch.setattr(ignore_rules, "_keys", lambda *args: asked.append(keys(*args)) or asked[-1])
    patterns = [w for i in range(500) for w in (f"p{i}.py", f"*{i}.py", f"src/p{i}*", f"p?{i}*y", f"?{i}?*[x-z]")] + ["*", "x y*z", "p[0-9]", "", None]
    rows = [(r, p) for r in ("a", "b", "none", None) for p in patterns if (r, p) != ("b", "*")]
    paths = ["p7.py", "p499.py", "p500.py", "src/p12/x", "px33.y", "q", "p5", "x yz", "x1000.y", None]
    changes = spark.createDataFrame([(r, p) for r in ("a", "b", "other", None) for p in paths], "repo string, path string")
    got = ignore_rules.without_matches(changes, spark.createDataFrame(rows, "repo string, pattern string")).collect()
    assert sum(part.count() for part in asked) < len(rows) / 20
    files = [(r, "\n".join(p for q, p in rows if q == r and p)) for r in ("a", "b")]
    some = changes.filter("path IS NOT NULL")
    want = flow.without_ignored(some, spark.createDataFrame(files, "repo string, content string")).unionByName(changes.filter("path IS NULL"))
    assert sorted(map(repr, got)) == sorted(map(repr, want.collect()))
    assert len(asked) == (2 if repos == 1 else 1)
