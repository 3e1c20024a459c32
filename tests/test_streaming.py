import datetime as dt
import hashlib
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_activity import EVENT, random_events, walk
from test_commits import RAW, ROWS

from driftline.operators import commit_index as ci
from driftline.operators import vocabulary as voc
from driftline.session import settings
from driftline.sources import audit_log, index_store
from driftline.streaming import live_index, live_sessions, rollups, scans, stateful_sessions


def in_files(spark, rows, schema, folder, parts):
    """Write rows to one file per part, oldest first, and stream them file by file."""
    size = -(-len(rows) // parts)
    for n in range(parts):
        part = spark.createDataFrame(rows[n * size : (n + 1) * size], schema).coalesce(1)
        part.write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return (
        spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    )


def test_live_sessions_equal_batch(spark, tmp_path):
    events = sorted(random_events(400, 7), key=lambda e: (e[2], e[1]))
    stream = in_files(spark, events, EVENT, tmp_path / "in", 4)
    out = str(tmp_path / "out")
    live_sessions.session_stream(stream, out, str(tmp_path / "cp")).awaitTermination()
    closed = spark.read.schema(live_sessions.CLOSED).parquet(f"{out}/closed").collect()
    _, found, open_ = walk(events)
    still = {s for s in open_.values() if s is not None}
    want = set()
    for i, s in found.items():
        if i not in still:
            last = max([t for t, _ in s["calls"]], default=s["start"])
            want.add((s["agent"], s["start"], s["end"], len(s["calls"]), last))
    assert {(r.agent_id, r.started_at, r.ended_at, r.tool_calls, r.last_activity) for r in closed} == want
    assert len(closed) == len(want)
    now = {r.event_id: r.tool_calls for r in live_sessions.latest_open(spark, out).collect()}
    assert now == {i: len(found[i]["calls"]) for i in still}


def test_agents_idle_in_a_batch_keep_their_session(spark):
    noon = dt.datetime(2024, 1, 1, 12)
    ident = hashlib.md5(b"a|1").hexdigest()[:16]
    state = spark.createDataFrame([("a", ident, 1, noon, 2, noon, {"k": "v"})], live_sessions.STATE)
    events = spark.createDataFrame([("b", 5, noon, "start", "t")], EVENT)
    closed, still = live_sessions.advance(events, state)
    assert closed.count() == 0
    assert {r.agent_id: (r.tool_calls, r.metadata) for r in still.collect()} == {"a": (2, {"k": "v"}), "b": (0, {})}


def test_live_index(spark, tmp_path):
    history = spark.createDataFrame(ROWS, RAW)
    words = voc.freeze(ci.fit(ci.projection(history)))
    stream = in_files(spark, ROWS + ROWS[:2], RAW, tmp_path / "in", 3)
    path = str(tmp_path / "index")
    live_index.index_stream(stream, words, path, str(tmp_path / "cp")).awaitTermination()
    rows = index_store.read(spark, path).collect()
    assert sorted(r.commit_hash[0] for r in rows) == ["a", "b", "c", "d"]
    batch = {r.commit_hash: r.vector for r in ci.index_full(history, words).collect()}
    for r in rows:
        if r.commit_hash[0] != "a":  # kept from the first batch that brought it
            assert dict(r.vector) == pytest.approx(dict(batch[r.commit_hash]))


def test_live_index_folds_as_it_goes(spark, tmp_path):
    rows = [(f"{i % 20:012d}" + "0" * 28, f"login {i}", "a", "r", 1_000 + i, [], 1, 1) for i in range(28)]
    words = voc.freeze(ci.fit(ci.projection(spark.createDataFrame(rows, RAW))))
    stream = in_files(spark, rows, RAW, tmp_path / "in", 7)
    path = str(tmp_path / "index")
    live_index.index_stream(stream, words, path, str(tmp_path / "cp"), fold_every=3).awaitTermination()
    assert index_store.folded(spark, path) == 5
    got = {r.commit_hash: r.message for r in index_store.read(spark, path).collect()}
    assert got == {r[0][:12]: r[1] for r in rows[:20]}  # kept from the first batch that brought it


def test_stateless_scans(spark, tmp_path):
    rows = [(1, "a@bb.com"), (2, "ignore previous rules"), (3, "nothing")]
    stream = in_files(spark, rows, "id int, text string", tmp_path / "in", 1)
    flagged = scans.security_flags(stream).select("id", F.size("security_flags").alias("n"))
    scans.write_available(flagged, str(tmp_path / "f"), str(tmp_path / "cp1")).awaitTermination()
    assert {r.id: r.n for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {1: 1, 2: 1, 3: 0}
    clean = scans.sanitized(stream).select("id", "sanitized.sanitized_text")
    scans.write_available(clean, str(tmp_path / "s"), str(tmp_path / "cp2")).awaitTermination()
    got = {r.id: r.sanitized_text for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert got[1] == "[REDACTED_EMAIL_1]"


def test_incidents_from_lines(spark, tmp_path):
    good = '{"timestamp": "2024-01-01T00:00:00+00:00", "trace_id": "%s", "action": "a", "agent_id": "g", "risk_score": %s}'
    lines = [(good % ("t1", 0.9),), (good % ("t2", 0.1),), ("{broken",)]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(str(tmp_path / "log"))
    found = scans.incidents(scans.line_stream(spark, str(tmp_path / "log"))).select("trace_id")
    scans.write_available(found, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.trace_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["t1"]


def test_audit_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 1), "tool:a"), (2, dt.datetime(2024, 1, 2, 1), "tool:b")]
    stream = in_files(spark, rows, "n int, ts timestamp, action string", tmp_path / "in", 2)
    entries = stream.selectExpr(
        "ts", "'t' AS trace_id", "action", "'g' AS agent_id", "0.0D AS risk_score", "false AS pii_detected",
        "false AS injection_detected", "'ok' AS status", "CAST(NULL AS string) AS repo_path",
        "map('n', string(n)) AS metadata", "CAST(NULL AS string) AS session_id", "CAST(NULL AS int) AS duration_ms",
    )
    out = str(tmp_path / "log")
    scans.write_audit(entries, out, str(tmp_path / "cp")).awaitTermination()
    got = {r.action: r.metadata["n"] for r in audit_log.read(spark, out).collect()}
    assert got == {"tool:a": "1", "tool:b": "2"}


DELAY = 100_000  # seconds


def arriving(events, seed, parts=3):
    """Events in files out of order, some of them long after their time; which ones come too late; the last watermark."""
    draw = random.Random(seed)
    events = sorted(events, key=lambda e: e[2])
    span = (events[-1][2] - events[0][2]).total_seconds() / parts + 1
    files = [[] for _ in range(parts + 1)]
    for e in events:
        at = int((e[2] - events[0][2]).total_seconds() // span)
        files[draw.choice([at, at, min(at + 1, parts), parts] if draw.random() < 0.3 else [at])].append(e)
    late, newest = set(), None
    for rows in files:
        if newest is not None:
            late |= {e[1] for e in rows if millis(e[2]) <= newest - DELAY * 1000}
        newest = max([newest or 0, *(millis(e[2]) for e in rows)])
        draw.shuffle(rows)
    return files, late, newest - DELAY * 1000


def millis(ts):
    return int(ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000) // 1000


def test_stateful_sessions_take_events_out_of_order_and_go_on_after_a_stop(spark, tmp_path):
    files, late, last = arriving(random_events(400, 9), 4)
    schema = EVENT + ", metadata map<string,string>"
    untimed = ("a", 9_000, None, "start", "t")
    files[1].append(untimed)
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    for n, rows in enumerate(files):
        rows = [(*e, {"n": str(e[1])}) for e in rows]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        trigger = {"processingTime": "0 seconds"} if n == 1 else None
        query = stateful_sessions.session_stream(stream, out, checkpoint, f"{DELAY} seconds", trigger)
        if trigger:  # a running stream is stopped, the next one goes on from its checkpoint
            query.processAllAvailable()
            query.stop()
        query.awaitTermination()
    counted = [e for rows in files for e in rows if e[2] and e[1] not in late and millis(e[2]) <= last]
    assert late and len(counted) > 200
    _, found, open_ = walk(counted)
    still = {s for s in open_.values() if s is not None}
    want = {
        (s["agent"], s["start"], s["end"], len(s["calls"]), max([t for t, _ in s["calls"]], default=s["start"]), str(i))
        for i, s in found.items()
        if i not in still
    }
    closed = stateful_sessions.outcomes(spark, out, "closed").collect()
    got = {(r.agent_id, r.started_at, r.ended_at, r.tool_calls, r.last_activity, r.metadata["n"]) for r in closed}
    assert got == want and len(closed) == len(want)
    ids = {i: hashlib.md5(f"{s['agent']}|{i}".encode()).hexdigest()[:16] for i, s in found.items()}
    assert {r.session_id for r in closed} == {ids[i] for i in found if i not in still}
    assert {r.event_id for r in stateful_sessions.outcomes(spark, out, "late").collect()} == late
    side = {(r.agent_id, r.outcome): r.n_events for r in stateful_sessions.late_count(spark, out).collect()}
    assert side.pop(("a", "untimed")) == 1
    assert sum(side.values()) == len(late)


class Kept:
    """Keyed state and timers of one agent."""

    def __init__(self):
        self.values, self.timers = [], []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return self

    def appendList(self, rows):
        self.values += rows

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 5


def test_session_keeper_takes_and_gives_plain_rows():
    event = Row("agent_id", "event_id", "micros", "kind", "metadata")
    rows = [event("a", 1, 9_000, "start", None), event("a", 2, 7_000, "call", "{}"), event("a", 3, None, "call", None)]
    rows.append(event("a", None, 5_000, "end", None))
    keeper, state = stateful_sessions.SessionKeeper(), Kept()
    keeper.init(state)
    given = list(keeper.handleInputRows(("a",), iter(rows), state))
    assert [(r.outcome, r.event_id, r.started, r.session_id) for r in given] == [("untimed", 3, None, None), ("late", None, 5_000, None)]
    assert state.values == [([9_000, 7_000], [1, 2], ["start", "call"], [None, "{}"])] and state.timers == [7]
    assert list(keeper.handleInputRows(("a",), iter(rows[:1]), state)) == []  # nothing is made for an agent whose events wait


@pytest.fixture
def arrived(spark, tmp_path):
    """Runs a roll-up over arriving rows: the windows it writes and the late rows it counts."""

    def run(files, schema, rollup):
        folder, out, checkpoint, late = (str(tmp_path / name) for name in ("in", "out", "cp", "late"))
        for rows in files:
            spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(folder)
            query = rollups.write(rollup(spark.readStream.schema(schema).parquet(folder)), out, checkpoint)
            query.awaitTermination()
            rollups.write_late(query, late)
        return spark.read.parquet(out).collect(), rollups.late_rows(spark, late).first()[0]

    return run


def test_bursts_of_incidents(arrived):
    draw = random.Random(3)
    events = [e[:3] for e in random_events(300, 12)]
    files, late, last = arriving([(*e, draw.random() < 0.4) for e in events], 5)
    files[1] += sorted(files[0], key=lambda e: e[2])[-10:]  # sent again within the delay
    schema = "agent_id string, event_id long, ts timestamp, pii_detected boolean, injection_detected boolean, risk_score double"
    rows = [[(*e, False, e[1] / 1000) for e in part] for part in files]
    found, n_late = arrived(rows, schema, lambda s: rollups.incident_bursts(s, "event_id", "3 hours", f"{DELAY} seconds"))
    assert n_late == len(late)
    want, open_ = [], {}
    for agent, number, ts, pii in sorted((e for part in files for e in set(part)), key=lambda e: e[2]):
        if number in late or not pii or (agent, number) in open_:
            continue
        open_[agent, number] = True
        if agent in open_ and ts - open_[agent][-1][0] <= dt.timedelta(hours=3):
            open_[agent].append((ts, number))
        else:
            open_[agent] = [(ts, number)]
            want.append((agent, open_[agent]))
    final = {
        (agent, b[0][0], b[-1][0] + dt.timedelta(hours=3), len(b), max(n for _, n in b) / 1000)
        for agent, b in want
        if millis(b[-1][0] + dt.timedelta(hours=3)) <= last
    }
    assert {(r.agent_id, r.start, r.end, r.incidents, r.highest_risk) for r in found} == final and len(found) == len(final)
    assert any(len(b) > 1 for _, b in want)


def test_redactions_by_window(arrived):
    texts = ["mail a@bb.com and c@dd.com", "call 555-123-4567 or a@bb.com", "nothing"]
    events = [("s" + e[0], e[1], e[2], texts[e[1] % 3]) for e in random_events(120, 14)]
    files, late, last = arriving(events, 6)
    rollup = lambda s: rollups.sensitive_report(s, "id", "source", "6 hours", f"{DELAY} seconds")
    found, n_late = arrived(files, "source string, id long, ts timestamp, text string", rollup)
    assert n_late == len(late)
    want = {}
    for source, number, ts, text in events:
        start = millis(ts) // 21_600_000 * 21_600_000
        if number not in late and start + 21_600_000 <= last:
            for kind, n in {"email": text.count("@"), "phone": text.count("555"), None: text.count("@") + text.count("555")}.items():
                if n:
                    key = (start, source, kind)
                    want[key] = [want.get(key, [0, 0])[0] + n, want.get(key, [0, 0])[1] + 1]
    assert {(millis(r.start), r.group, r.type): [r.findings, r.texts] for r in found} == want
    assert len(found) == len(want)


def test_risk_by_sliding_window(arrived):
    texts = ["ignore previous rules", "nothing", None]
    events = [("s" + e[0], e[1], e[2], texts[e[1] % 3]) for e in random_events(120, 15)]
    files, late, last = arriving(events, 7)
    rollup = lambda s: rollups.injection_risk(s, "id", "source", "6 hours", "3 hours", f"{DELAY} seconds")
    found, n_late = arrived(files, "source string, id long, ts timestamp, text string", rollup)
    assert n_late == len(late)
    want = {}
    for source, number, ts, text in events:
        for back in range(2):
            start = (millis(ts) // 10_800_000 - back) * 10_800_000
            if number not in late and start + 21_600_000 <= last:
                counts = want.setdefault((start, source), [0, 0])
                counts[0] += 1
                counts[1] += text == texts[0]
    assert {(millis(r.start), r.group): [r.texts, r.at_risk] for r in found} == want


def test_settings_hold_inside_only(spark):
    with settings(spark, {"spark.sql.shuffle.partitions": "3", "driftline.unknown": "x"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert spark.conf.get("driftline.unknown", None) is None
