"""Agent sessions as keyed state: events wait for the watermark, then count in the order of their times.

An agent's events wait in its state until the watermark has passed them. A timer
on the earliest one wakes the agent, which then takes all that the watermark has
passed, in order, so files may arrive in any order within the delay. An event
that the watermark had passed before it came is not counted; it goes to a side
table, as does an event without a time. Nothing but the waiting events and one
open session per agent is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from driftline.operators import sessions as ses
from driftline.session import settings

#: What leaves the state: a closed session, or an event that was not counted and why.
CLOSED, LATE, UNTIMED = "closed", "late", "untimed"

#: Waiting events, many to an entry, because each entry is carried into the state and out of it by itself.
_EVENTS = "micros array<bigint>, event_id array<bigint>, kind array<string>, metadata array<string>"
TOGETHER = 1_000
_OPEN = "session_id string, started bigint, calls bigint, last_call bigint, metadata string"
_OUT = (
    "outcome string, agent_id string, event_id bigint, session_id string, started bigint, ended bigint, "
    "tool_calls bigint, last_activity bigint, metadata string"
)
_Out = Row(*[c.split(" ")[0] for c in _OUT.split(", ")])
#: Keyed state with timers needs RocksDB.
ROCKS_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def _order(event: tuple) -> tuple:
    """By time, then number; an event without a number comes first."""
    return event[0], event[1] is not None, event[1] or 0


def _packed(events: list[tuple]) -> list[tuple]:
    """Events as entries of TOGETHER events at most."""
    parts = (events[at : at + TOGETHER] for at in range(0, len(events), TOGETHER))
    return [tuple(map(list, zip(*part, strict=True))) for part in parts]


class SessionKeeper(StatefulProcessor):
    """The sessions of one agent.

    It takes and gives plain rows: an agent has a few events in a batch, and frames
    made for each agent would cost far more than its events.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENTS)
        self.session = handle.getValueState("session", _OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        kept = []
        for _, number, micros, kind, metadata in rows:
            if micros is None:
                yield _Out(UNTIMED, key[0], number, *[None] * 6)
            elif micros // 1000 <= passed:
                yield _Out(LATE, key[0], number, None, micros, *[None] * 4)
            else:
                kept.append((micros, number, kind, metadata))
        if kept:
            self.waiting.appendList(_packed(kept))
            wake = min(k[0] for k in kept) // 1000
            timers = [t for (t,) in self._timers()]
            if not timers or wake < min(timers):
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(wake)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = sorted((e for entry in self.waiting.get() for e in zip(*entry, strict=True)), key=_order)
        due = [e for e in events if e[0] // 1000 <= passed]
        rest = events[len(due) :]
        before = self.session.get()
        open_ = list(before) if before else None
        out = []

        def close(ended: int | None) -> None:
            session, started, calls, last_call, metadata = open_
            out.append(_Out(CLOSED, key[0], None, session, started, ended, calls, started if last_call is None else last_call, metadata))

        for micros, number, kind, metadata in due:
            if kind == "start":
                if open_:
                    close(None)
                name = f"{key[0]}|{number}" if number is not None else key[0]
                open_ = [hashlib.md5(name.encode()).hexdigest()[:16], micros, 0, None, metadata]
            elif kind == "end" and open_:
                close(micros)
                open_ = None
            elif kind == "call" and open_:
                open_[2], open_[3] = open_[2] + 1, micros
        if open_:
            self.session.update(tuple(open_))
        elif before:
            self.session.clear()
        if rest:
            self.waiting.put(_packed(rest))
            self.handle.registerTimer(rest[0][0] // 1000)
        else:
            self.waiting.clear()
        yield from out

    def _timers(self) -> list[tuple[int]]:
        return [(int(t[0] if isinstance(t, tuple) else t),) for t in self.handle.listTimers()]

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, delay: str) -> DataFrame:
    """Closed sessions and uncounted events of a stream of agent events.

    ``events`` has agent_id, event_id, ts, kind (start, end or call) and,
    perhaps, metadata. An event counts if it comes before the watermark, the
    newest time seen less ``delay``, has reached its time. Sessions are those of
    the batch operators over all events that count and whose time the watermark
    has reached.
    """
    agent = F.coalesce(F.nullif("agent_id", F.lit("")), F.lit("anonymous"))
    metadata = F.to_json("metadata") if "metadata" in events.columns else F.lit(None).cast("string")
    rows = events.withWatermark("ts", delay).select(
        agent.alias("agent_id"),
        "event_id",
        F.unix_micros("ts").alias("micros"),  # a plain number, so that Spark hands over late events too
        "kind",
        metadata.alias("metadata"),
    )
    found = rows.groupBy("agent_id").transformWithState(
        statefulProcessor=SessionKeeper(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime"
    )
    seconds = (F.col("last_activity") - F.col("started")) / 1_000_000
    closed = F.col("outcome") == CLOSED
    moment = lambda name: F.timestamp_micros(F.col(name))
    carried = F.coalesce(F.from_json("metadata", ses.METADATA), F.create_map().cast(ses.METADATA))
    return found.select(
        "outcome",
        "agent_id",
        "event_id",
        F.when(~closed, moment("started")).alias("ts"),
        "session_id",
        F.when(closed, moment("started")).alias("started_at"),
        moment("ended").alias("ended_at"),
        "tool_calls",
        moment("last_activity").alias("last_activity"),
        F.when(closed, seconds.cast("long")).alias("duration_seconds"),
        F.when(closed, carried).alias("metadata"),
    )


def session_stream(events: DataFrame, path: str, checkpoint: str, delay: str, trigger: dict | None = None) -> StreamingQuery:
    """Append closed sessions and uncounted events below ``path``, one folder per outcome, exactly once.

    ``trigger`` is a trigger of Spark's, by default all that is available now.
    """
    with settings(events.sparkSession, ROCKS_STATE):
        return (
            closed_sessions(events, delay)
            .writeStream.format("parquet")
            .partitionBy("outcome")
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(**(trigger or {"availableNow": True}))
            .start(path)
        )


def outcomes(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    """The rows of one outcome that the stream has written."""
    schema = (
        "agent_id string, event_id bigint, ts timestamp, session_id string, started_at timestamp, ended_at timestamp, "
        "tool_calls bigint, last_activity timestamp, duration_seconds bigint, metadata map<string,string>, outcome string"
    )
    return spark.read.schema(schema).parquet(path).filter(F.col("outcome") == outcome).drop("outcome")


def late_count(spark: SparkSession, path: str) -> DataFrame:
    """Uncounted events by agent and outcome."""
    rows = outcomes(spark, path, LATE).withColumn("outcome", F.lit(LATE))
    rows = rows.unionByName(outcomes(spark, path, UNTIMED).withColumn("outcome", F.lit(UNTIMED)))
    return rows.groupBy("agent_id", "outcome").agg(F.count(F.lit(1)).alias("n_events"))
