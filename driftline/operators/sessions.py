"""Agent sessions rebuilt from start, end and call events.

A start opens a session and replaces an open one, an end closes it. Whether a
session is open at an event depends on the last start or end before it, which is
carried forward in time buckets, so one very busy agent is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.carry import carry_forward

ORDER = ["ts", "event_id"]
METADATA = "map<string,string>"


def started_with(rows: DataFrame) -> Column:
    """The metadata of the start among the rows of a session; empty where nothing started it or nothing came with it."""
    empty = F.create_map().cast(METADATA)
    if "metadata" not in rows.columns:
        return F.first(empty)
    given = F.when(F.col("opens") & (F.col("kind") == "start"), F.col("metadata"))
    return F.coalesce(F.first(given, ignorenulls=True), empty)


def session_stamp(
    events: DataFrame, auto_create: bool = False, bucket: str = "hour"
) -> DataFrame:
    """Add session_id: the session open at each event, NULL outside of sessions.

    Starts get the session they open, ends the one they close. ``events`` has
    agent_id, event_id, ts and kind (start, end or call). With ``auto_create`` a
    call outside of a session opens one. ``bucket`` is the time span of one agent
    that a single task may work on.
    """
    # events without a time come first in order, so they share the earliest spans, by ranges of their numbers
    timeless = F.when(F.col("ts").isNull(), F.coalesce(F.shiftright(F.col("event_id").cast("bigint"), 16), F.lit(-(2**48))))
    earliest = F.timestamp_seconds(F.lit(-62135596800))
    span = F.struct(F.coalesce(F.date_trunc(bucket, "ts"), earliest).alias("at"), F.coalesce(timeless, F.lit(0)).alias("n"))
    agent = F.coalesce(F.nullif("agent_id", F.lit("")), F.lit("auto" if auto_create else "anonymous"))
    rows = events.withColumn("agent_id", agent)
    opens = F.col("kind") == "start"
    if auto_create:
        # any event but an end leaves a session open behind it
        rows = carry_forward(
            rows, "agent_id", ORDER, span, {"__before": F.col("kind")}, including_self=False
        )
        idle = F.coalesce(F.col("__before"), F.lit("end")) == "end"
        opens = opens | ((F.col("kind") == "call") & idle)
    rows = rows.withColumn("opens", opens)
    own = F.left(
        F.md5(F.concat_ws("|", "agent_id", F.col("event_id").cast("string"))), F.lit(16)
    )
    boundary = F.when(F.col("opens"), own).when(F.col("kind") == "end", "")
    rows = carry_forward(
        rows, "agent_id", ORDER, span, {"__open": boundary}, including_self=False
    )
    stamp = F.when(F.col("opens"), own).otherwise(F.nullif("__open", F.lit("")))
    return rows.withColumn("session_id", stamp).drop("__open", "__before")


def sessions(
    stamped: DataFrame, counted: list[str] | None = None, action: str = "action"
) -> DataFrame:
    """One row per session: start, end, counted calls, last activity, duration, metadata of the start.

    ``counted`` names the actions that count as tool calls; all calls for None.
    """
    is_call = F.col("kind") == "call"
    if counted is not None:
        is_call = is_call & F.col(action).isin(counted)
    rows = stamped.filter(F.col("session_id").isNotNull())
    grouped = rows.groupBy("agent_id", "session_id").agg(
        F.min(F.when(F.col("opens"), F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("kind") == "end", F.col("ts"))).alias("ended_at"),
        F.count_if(is_call).alias("tool_calls"),
        F.max(F.when(is_call, F.col("ts"))).alias("last_call"),
        started_with(rows).alias("metadata"),
    )
    last = F.coalesce("last_call", "started_at")
    seconds = (F.unix_micros(last) - F.unix_micros("started_at")) / 1_000_000
    return grouped.withColumns(
        {"last_activity": last, "duration_seconds": seconds.cast("long")}
    ).drop("last_call")


def session_info(stamped: DataFrame, all_sessions: DataFrame) -> DataFrame:
    """Per agent, its open session or the record that there is none."""
    bounds = stamped.filter(F.col("opens") | (F.col("kind") == "end"))
    last = bounds.groupBy("agent_id").agg(
        F.max_by(F.when(F.col("opens"), F.col("session_id")), F.struct(*ORDER)).alias("session_id")
    )
    agents = stamped.select("agent_id").distinct().join(last, "agent_id", "left")
    open_now = all_sessions.drop("ended_at")
    info = agents.join(open_now, ["agent_id", "session_id"], "left")
    active = F.col("session_id").isNotNull()
    return info.withColumns(
        {"active": active, "message": F.when(~active, fv.NO_SESSION)}
    )


def session_end_report(stamped: DataFrame, all_sessions: DataFrame) -> DataFrame:
    """Final statistics for every end event, also for those that closed nothing."""
    closed = all_sessions.filter(F.col("ended_at").isNotNull()).select(
        "agent_id",
        F.col("ended_at").alias("ts"),
        "session_id",
        "tool_calls",
        "duration_seconds",
        F.lit(fv.SESSION_ENDED).alias("message"),
    )
    idle = stamped.filter((F.col("kind") == "end") & F.col("session_id").isNull()).select(
        "agent_id",
        "ts",
        "session_id",
        F.lit(None).cast("long").alias("tool_calls"),
        F.lit(None).cast("long").alias("duration_seconds"),
        F.lit(fv.NO_SESSION_TO_END).alias("message"),
    )
    return closed.unionByName(idle)
