"""Agent sessions kept up to date from a stream of events.

Every batch runs the batch operators over its events, preceded by one start event
per agent whose session was open before. So a busy agent is spread over tasks here
as well. Events are expected in time order from one batch to the next; an event
that arrives in a later batch than its successors is placed by its time within its
own batch only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.operators import sessions as ses

STATE = (
    "agent_id string, session_id string, event_id bigint, started_at timestamp, "
    "tool_calls bigint, last_call timestamp, metadata map<string,string>"
)
CLOSED = (
    "agent_id string, session_id string, started_at timestamp, ended_at timestamp, "
    "tool_calls bigint, last_activity timestamp, duration_seconds bigint, metadata map<string,string>"
)


def advance(events: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closed sessions of a batch and the sessions open after it.

    ``state`` has one row per agent with an open session.
    """
    opened = state.select(
        "agent_id",
        "event_id",
        F.col("started_at").alias("ts"),
        F.lit("start").alias("kind"),
        F.lit("carried").alias("action"),
        "metadata",
    )
    if "metadata" not in events.columns:
        events = events.withColumn("metadata", F.lit(None).cast(ses.METADATA))
    rows = events.select("agent_id", "event_id", "ts", "kind", "action", "metadata").unionByName(opened)
    stamped = ses.session_stamp(rows).filter(F.col("session_id").isNotNull())
    is_call = F.col("kind") == "call"
    parts = stamped.groupBy("agent_id", "session_id").agg(
        F.min(F.when(F.col("opens"), F.col("event_id"))).alias("event_id"),
        F.min(F.when(F.col("opens"), F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("kind") == "end", F.col("ts"))).alias("ended_at"),
        F.count_if(is_call).alias("tool_calls"),
        F.max(F.when(is_call, F.col("ts"))).alias("last_call"),
        ses.started_with(stamped).alias("metadata"),
    )
    before = state.select(
        "session_id",
        F.col("tool_calls").alias("calls_before"),
        F.col("last_call").alias("call_before"),
    )
    merged = parts.join(before, "session_id", "left").withColumns(
        {
            "tool_calls": F.col("tool_calls") + F.coalesce("calls_before", F.lit(0)),
            "last_call": F.greatest("last_call", "call_before"),
        }
    )
    # the newest session of an agent stays open unless it was ended
    newest = parts.groupBy("agent_id").agg(
        F.max_by("session_id", F.struct("started_at", "event_id")).alias("session_id")
    )
    marked = newest.withColumn("is_newest", F.lit(True))
    known = merged.join(marked, ["agent_id", "session_id"], "left")
    is_open = F.col("ended_at").isNull() & F.col("is_newest").isNotNull()
    last = F.coalesce("last_call", "started_at")
    seconds = (F.unix_micros(last) - F.unix_micros("started_at")) / 1_000_000
    closed = known.filter(~is_open).select(
        "agent_id",
        "session_id",
        "started_at",
        "ended_at",
        "tool_calls",
        last.alias("last_activity"),
        seconds.cast("long").alias("duration_seconds"),
        "metadata",
    )
    still_open = known.filter(is_open).select(
        "agent_id", "session_id", "event_id", "started_at", "tool_calls", "last_call", "metadata"
    )
    return closed, still_open


def session_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write closed sessions to ``path/closed`` and open ones to ``path/open``.

    Both get one folder per batch; a batch that is run again after a failure
    reads the state of the batch before it and replaces its own folders.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            state = spark.createDataFrame([], STATE)
        else:
            state = spark.read.schema(STATE).parquet(f"{path}/open/batch={number - 1}")
        closed, still_open = advance(batch, state)
        closed.write.mode("overwrite").parquet(f"{path}/closed/batch={number}")
        still_open.write.mode("overwrite").parquet(f"{path}/open/batch={number}")

    return (
        events.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_open(spark, path: str) -> DataFrame:
    """The sessions open after the newest batch."""
    rows = spark.read.schema(STATE + ", batch bigint").parquet(f"{path}/open")
    newest = rows.agg(F.max("batch")).scalar()
    return rows.filter(F.col("batch") == newest).drop("batch")
