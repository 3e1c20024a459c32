import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.carry import carry_forward
from driftline.operators import audit, sessions as ses
from driftline.session import settings
from driftline.sources import audit_log

ENTRY = (
    "ts timestamp, trace_id string, action string, agent_id string, session_id string, "
    "risk_score double, pii_detected boolean, injection_detected boolean, status string, "
    "repo_path string, duration_ms bigint, metadata map<string,string>"
)
NOON = dt.datetime(2024, 1, 1, 12, 0, 0)
ROWS = [
    (NOON, "t1", "tool:a", "x", "s1", 0.2, False, False, "ok", "/r", 12, {"k": 'quo"te\nß'}),
    (NOON + dt.timedelta(microseconds=5), "t2", "tool:b", "y", "", 0.6, False, False, "error", None, None, {}),
    (NOON + dt.timedelta(days=1), "t1", "tool:c", "x", None, 0.5, True, False, "ok", "", 0, {"k": "v"}),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ROWS, ENTRY)


def test_lines(entries):
    lines = [json.loads(r.l) for r in entries.select("ts", audit_log.to_line().alias("l")).orderBy("ts").collect()]
    assert list(lines[0]) == audit_log.REQUIRED + ["session_id", "duration_ms"]
    assert lines[0]["timestamp"] == "2024-01-01T12:00:00+00:00"
    assert lines[0]["metadata"] == {"k": 'quo"te\nß'}
    assert list(lines[1]) == audit_log.REQUIRED and lines[1]["repo_path"] is None
    assert lines[1]["timestamp"] == "2024-01-01T12:00:00.000005+00:00"
    assert "session_id" not in lines[2] and lines[2]["duration_ms"] == 0


def test_write_and_read(spark, entries, tmp_path):
    path = str(tmp_path / "log")
    audit_log.write(entries, path)
    minimal = '{"timestamp": "2024-01-03T00:00:00+00:00", "trace_id": "t", "action": "a", "agent_id": "g"}'
    spark.createDataFrame([('{"timestamp": "2024',), ("",), ("[]",), (minimal,)], "value string").write.mode(
        "append"
    ).text(f"{path}/day=2024-01-03")
    rows = {r.ts: r for r in audit_log.read(spark, path).collect()}
    assert len(rows) == 4
    assert rows[NOON].metadata == {"k": 'quo"te\nß'} and rows[NOON].duration_ms == 12
    assert rows[ROWS[1][0]].session_id is None
    defaults = rows[dt.datetime(2024, 1, 3)]
    assert (defaults.risk_score, defaults.pii_detected, defaults.status, defaults.metadata) == (0.0, False, "ok", {})


def log_of(spark, path, appends):
    """Write texts as lines of a log, one append after the other, each in several files, and give them in their order."""
    schema = "ts timestamp, n int, value string"
    for number, lines in enumerate(appends):
        rows = [(NOON + dt.timedelta(days=n % 2), n, line) for n, line in enumerate(lines)]
        audit_log.write_lines(spark.createDataFrame(rows, schema).repartition(3), path, ["n"])
    return [line for day in (0, 1) for lines in appends for n, line in enumerate(lines) if n % 2 == day]


def test_lines_of_a_log_have_an_order(spark, tmp_path):
    path = str(tmp_path / "a log + more")
    appends = [[f"{k} {i}" * (i % 5) for i in range(60)] for k in "xy"]
    want = log_of(spark, path, appends)
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "60"}):  # files in several splits
        listed = audit_log.files(spark, path)
        assert listed.count() >= 4
        rows = audit_log.ordered_lines(spark, listed).orderBy(*audit_log.PLACE).collect()
        assert [r.value for r in rows] == want
        last = audit_log.last_lines(spark, path, 7).orderBy(*audit_log.PLACE).collect()
        assert [r.value for r in last] == want[-7:]
        assert [r.value for r in audit_log.last_lines(spark, path, 1_000).orderBy(*audit_log.PLACE).collect()] == want


def test_recent_entries_and_incidents_in_the_order_of_the_log(spark, tmp_path):
    path = str(tmp_path / "log")
    line = '{"timestamp": "2024-01-01T00:00:00+00:00", "trace_id": "t", "action": "%s", "agent_id": "g", "risk_score": %s}'
    texts = [["{broken" if i % 5 == 0 else line % (f"{k}{i}", 0.9 if i % 3 == 0 else 0.1) for i in range(40)] for k in "xy"]
    want = [json.loads(t) for t in log_of(spark, path, texts) if t != "{broken"]
    everything = log_of(spark, str(tmp_path / "copy"), texts)
    got = [r.action for r in audit.recent_in_log(spark, path, 10).collect()]
    assert got == [json.loads(t)["action"] for t in everything[-10:] if t != "{broken"]
    incidents = [e["action"] for e in want if e["risk_score"] > 0.5]
    assert [r.action for r in audit.incidents_in_log(spark, path, 6).collect()] == incidents[:6]
    assert [r.action for r in audit.incidents_in_log(spark, path, 999).collect()] == incidents


def test_a_tail_opens_the_last_files_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    for day in range(4):
        rows = [(NOON + dt.timedelta(days=day), i, f"{day} {i}") for i in range(20)]
        audit_log.write_lines(spark.createDataFrame(rows, "ts timestamp, n int, value string").coalesce(1), path, ["n"])
    opened, whole = [], audit_log.ordered_lines

    def recorded(spark, listed):
        opened.extend(r.day for r in listed.collect())
        return whole(spark, listed)

    monkeypatch.setattr(audit_log, "ordered_lines", recorded)
    assert audit_log.last_lines(spark, path, 5).count() == 5
    assert opened == ["2024-01-04"]


def test_a_log_stored_by_trace_stays_where_it_is(spark, entries, tmp_path):
    audit_log.write_clustered(entries, "log_of_test", str(tmp_path / "log"), 4)
    some = spark.createDataFrame([("t2",), ("t1",), ("t2",)], "trace_id string")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        found = audit.of_stored_traces(spark, "log_of_test", some)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 3
    assert "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "log_of_test" not in plan[plan.index("Exchange") :]


def test_recent_counts_broken_lines(spark, entries):
    good = audit_log.to_line()
    lines = entries.select(F.unix_micros("ts").alias("n"), F.when(F.col("status") == "error", "{").otherwise(good).alias("line"))
    assert [r.action for r in audit.recent(lines, ["n"], 2).collect()] == ["tool:c"]


def test_trace_and_incidents(spark, entries):
    assert {r.action for r in audit.of_trace(entries, "t1").collect()} == {"tool:a", "tool:c"}
    some = spark.createDataFrame([("t2",), ("t2",)], "trace_id string")
    assert [r.action for r in audit.of_traces(entries, some).collect()] == ["tool:b"]
    assert [r.action for r in audit.security_incidents(entries, ["ts"]).collect()] == ["tool:b", "tool:c"]
    assert [r.action for r in audit.security_incidents(entries, ["ts"], 1).collect()] == ["tool:b"]


def test_tool_calls(spark):
    rows = [("scan", [fv.PII_FLAG, "prompt INJECTION", "EMAIL"], None), ("scan", [], "danger"), ("scan", None, "ok")]
    df = spark.createDataFrame(rows, "tool_name string, security_flags array<string>, status string")
    got = [tuple(r) for r in audit.tool_calls(df).select(
        "action", "security_flag_count", "risk_score", "pii_detected", "injection_detected", "status").collect()]
    assert got == [("tool:scan", 3, 3 * 0.2, True, True, "ok"), ("tool:scan", 0, 0.0, False, False, "danger"),
                   ("tool:scan", 0, 0.0, False, False, "ok")]


def test_span_attributes(entries, spark):
    got = {r.action: r for r in audit.span_attributes(entries, "ns", task_id="trace_id").collect()}
    a = got["tool:a"]
    assert (a.span_name, a.span_status) == ("ns.a", "OK")
    assert a.attributes == {
        "gen_ai.agent.id": "x", "gen_ai.action.type": "tool_call", "gen_ai.tool.name": "a", "ns.repo_path": "/r",
        "gen_ai.task.id": "t1", "gen_ai.safety.pii": "false", "gen_ai.safety.injection_detected": "false",
        "ns.risk_score": "0.2", "ns.k": 'quo"te\nß',
    }
    assert got["tool:b"].span_status == "ERROR" and "ns.repo_path" not in got["tool:b"].attributes
    assert "ns.repo_path" not in got["tool:c"].attributes
    df = spark.createDataFrame([("ok", 5, 7)], "status string, minutes_since_last_commit int, uncommitted_lines int")
    assert audit.flow_attributes(df).first().attributes == {
        "flow.status": "ok", "flow.minutes_since_commit": "5", "flow.uncommitted_lines": "7"
    }


@pytest.mark.parametrize("including_self", [True, False])
def test_carry_forward(spark, including_self):
    rng = random.Random(5)
    rows = [
        (rng.choice("aaab"), NOON + dt.timedelta(minutes=rng.randrange(3000)), i, rng.choice([None, None, rng.randrange(9)]))
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, v int")
    out = carry_forward(df, "k", ["ts", "id"], F.date_trunc("hour", "ts"), {"last": F.col("v")}, including_self)
    last, want = {}, {}
    for k, ts, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        before = last.get(k)
        last[k] = v if v is not None else before
        want[i] = last[k] if including_self else before
    assert {r.id: r.last for r in out.collect()} == want


EVENT = "agent_id string, event_id long, ts timestamp, kind string, action string"


def random_events(n, seed, agents="aaaaabc"):
    rng = random.Random(seed)
    return [
        (rng.choice(agents), i, NOON + dt.timedelta(seconds=rng.randrange(400_000)),
         rng.choice(["start", "end", "call", "call", "call"]), rng.choice(["tool:p", "tool:q"]))
        for i in range(n)
    ]


def walk(events, auto=False):
    """Session (as number of its opening event) per event, and the sessions."""
    stamp, open_, found = {}, {}, {}
    for agent, i, ts, kind, action in sorted(events, key=lambda e: (e[2], e[1])):
        if kind == "start" or (auto and kind == "call" and open_.get(agent) is None):
            open_[agent] = i
            found[i] = dict(agent=agent, start=ts, end=None, calls=[])
        s = open_.get(agent)
        stamp[i] = s
        if s is not None and kind == "call":
            found[s]["calls"].append((ts, action))
        if s is not None and kind == "end":
            found[s]["end"] = ts
        if kind == "end":
            open_[agent] = None
    return stamp, found, open_


@pytest.mark.parametrize("auto", [False, True])
def test_stamp(spark, auto):
    events = random_events(600, 1)
    out = ses.session_stamp(spark.createDataFrame(events, EVENT), auto).collect()
    stamp, _, _ = walk(events, auto)
    opening = {r.session_id: r.event_id for r in out if r.opens}
    assert {r.event_id: opening.get(r.session_id) for r in out} == stamp


@pytest.mark.parametrize("counted", [None, ["tool:p"]])
def test_sessions(spark, counted):
    events = random_events(600, 2)
    stamped = ses.session_stamp(spark.createDataFrame(events, EVENT))
    rows = ses.sessions(stamped, counted).collect()
    _, found, _ = walk(events)
    want = set()
    for s in found.values():
        calls = [t for t, a in s["calls"] if counted is None or a in counted]
        last = max(calls, default=s["start"])
        want.add((s["agent"], s["start"], s["end"], len(calls), last, int((last - s["start"]).total_seconds())))
    got = {(r.agent_id, r.started_at, r.ended_at, r.tool_calls, r.last_activity, r.duration_seconds) for r in rows}
    assert got == want and len(rows) == len(found)


def test_sessions_carry_the_metadata_of_their_start(spark):
    rows = [
        ("a", 1, NOON, "start", "t", {"k": "first"}),
        ("a", 2, NOON, "call", "t", {"k": "of a call"}),
        ("a", 3, NOON, "start", "t", None),
        ("b", 4, NOON, "call", "t", {"k": "opened by a call"}),
        ("c", 5, NOON, "start", "t", {"k": "ended"}),
        ("c", 6, NOON, "end", "t", {"k": "of an end"}),
    ]
    stamped = ses.session_stamp(spark.createDataFrame(rows, EVENT + ", metadata map<string,string>"), auto_create=True)
    everything = ses.sessions(stamped)
    got = sorted((r.agent_id, r.ended_at is None, sorted(r.metadata.items())) for r in everything.collect())
    assert got == [("a", True, []), ("a", True, [("k", "first")]), ("b", True, []), ("c", False, [("k", "ended")])]
    info = {r.agent_id: r.metadata for r in ses.session_info(stamped, everything).collect()}
    assert info == {"a": {}, "b": {}, "c": None}


def test_events_without_a_time_are_kept(spark):
    rows = [("a", 1, None, "call", "t"), ("a", 2, NOON, "start", "t"), ("a", 3, NOON, "call", "t")]
    out = ses.session_stamp(spark.createDataFrame(rows, EVENT)).collect()
    assert {r.event_id: r.session_id is not None for r in out} == {1: False, 2: True, 3: True}


def test_many_events_without_a_time_are_dealt_by_their_numbers(spark):
    kinds = {0: "start", 70_000: "end", 200_000: "start"}
    rows = [("a", i, None, kinds.get(i, "call"), "t") for i in range(0, 300_000, 10_000)] + [("a", None, None, "call", "t")]
    out = ses.session_stamp(spark.createDataFrame(rows, EVENT)).collect()
    inside = {r.event_id for r in out if r.session_id is not None}
    assert inside == {i for i in range(0, 300_000, 10_000) if i <= 70_000 or i >= 200_000}
    assert len({r.session_id for r in out}) == 3


def test_info_and_end_report(spark):
    events = random_events(300, 3) + [("solo", 9000, NOON, "call", "tool:p"), ("", 9001, NOON, "start", "tool:p")]
    stamped = ses.session_stamp(spark.createDataFrame(events, EVENT))
    everything = ses.sessions(stamped)
    _, found, open_ = walk([("anonymous" if not e[0] else e[0], *e[1:]) for e in events])
    info = {r.agent_id: r for r in ses.session_info(stamped, everything).collect()}
    assert set(info) == {"a", "b", "c", "solo", "anonymous"}
    for agent, r in info.items():
        s = open_.get(agent)
        assert r.active == (s is not None)
        if s is None:
            assert r.message == fv.NO_SESSION and r.session_id is None
        else:
            assert (r.started_at, r.tool_calls) == (found[s]["start"], len(found[s]["calls"]))
    report = ses.session_end_report(stamped, everything).collect()
    assert len(report) == sum(e[3] == "end" for e in events)
    closed = [r for r in report if r.message == fv.SESSION_ENDED]
    assert len(closed) == sum(s["end"] is not None for s in found.values())
