"""Counts over windows of event time, final as soon as the watermark has passed a window.

Each row counts once, also when it is sent again within the delay. A row that
comes after the watermark has passed its time counts nowhere; such rows are
dropped before any window, one by one, and their number is kept in a table.
Rows without a time belong to no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.operators import audit, injection, sensitive
from driftline.session import settings

LATE = "batch bigint, run string, late_rows bigint"
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a busy agent's incidents are put together before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def in_time(stream: DataFrame, key: str, delay: str, ts: str = "ts") -> DataFrame:
    """The rows that come before the watermark has passed their time, each key once."""
    timed = stream.filter(F.col(ts).isNotNull())
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def _by_type(items: Column) -> Column:
    """The items of one text counted by type, and all of them under no type."""
    types = F.array_distinct(F.transform(items, lambda i: i["type"]))
    counts = F.transform(types, lambda t: F.struct(t.alias("type"), F.size(F.filter(items, lambda i: i["type"] == t)).alias("n")))
    total = F.array(F.struct(F.lit(None).cast("string").alias("type"), F.size(items).alias("n")))
    return F.when(F.size(items) > 0, F.concat(counts, total)).otherwise(F.slice(total, 1, 0))


def sensitive_report(
    texts: DataFrame, key: str, group: str, width: str, delay: str, text: str = "text", ts: str = "ts"
) -> DataFrame:
    """Redactions by window, group and type; under no type all of the group.

    Windows of ``width`` follow each other without a gap.
    """
    rows = sensitive.sanitize(in_time(texts, key, delay, ts), text)
    counted = rows.select(F.window(ts, width).alias("window"), F.col(group).alias("group"), F.inline(_by_type(F.col("sanitized.items"))))
    return counted.groupBy("window", "group", "type").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("texts"))


def injection_risk(
    texts: DataFrame, key: str, group: str, width: str, slide: str, delay: str, text: str = "text", ts: str = "ts"
) -> DataFrame:
    """Texts, texts at risk, injections and the highest risk by window and group; a window begins every ``slide``."""
    rows = in_time(texts, key, delay, ts)
    rows = rows.select(ts, F.col(group).alias("group"), injection.matches(F.col(text)).alias("found"))
    rows = rows.select(ts, "group", F.size("found").alias("n"), injection.risk_score(F.col("found")).alias("risk"))
    return rows.groupBy(F.window(ts, width, slide).alias("window"), "group").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.col("n") > 0).alias("at_risk"),
        F.sum("n").alias("injections"),
        F.max("risk").alias("highest_risk"),
    )


def incident_bursts(entries: DataFrame, key: str, gap: str, delay: str, ts: str = "ts") -> DataFrame:
    """Incidents of an agent that follow each other within ``gap``, as one row from the first to ``gap`` after the last."""
    found = in_time(entries, key, delay, ts).filter(audit.is_incident())
    return found.groupBy(F.session_window(ts, gap).alias("window"), "agent_id").agg(
        F.count(F.lit(1)).alias("incidents"),
        F.count_if("pii_detected").alias("with_pii"),
        F.max("risk_score").alias("highest_risk"),
    )


def write(rollup: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append final windows to a parquet folder, exactly once; ``trigger`` is Spark's, by default all that is available."""
    flat = rollup.select("window.start", "window.end", *[c for c in rollup.columns if c != "window"])
    with settings(rollup.sparkSession, _CONF):
        return (
            flat.writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(**(trigger or {"availableNow": True}))
            .start(path)
        )


def write_late(query: StreamingQuery, path: str) -> None:
    """Add the number of rows that each of a stopped query's batches dropped as late to a table of counts.

    The first operator with state sees single rows, so its count is one of rows.
    """
    found = [(p["batchId"], str(p["runId"]), p["stateOperators"][-1]["numRowsDroppedByWatermark"]) for p in query.recentProgress if p["stateOperators"]]
    SparkSession.active().createDataFrame(found, LATE).write.mode("append").parquet(path)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The number of late rows, as a table of one row."""
    return spark.read.schema(LATE).parquet(path).agg(F.coalesce(F.sum("late_rows"), F.lit(0)).alias("late_rows"))
