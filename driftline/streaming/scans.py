"""Stateless jobs on streams: the batch operators, fed by a streaming source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from driftline.operators import audit, injection, sensitive
from driftline.sources import audit_log


def text_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet"
) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of text files in a folder as a stream."""
    return spark.readStream.text(folder)


def security_flags(stream: DataFrame, text: str = "text") -> DataFrame:
    """Security flags of every arriving text."""
    return injection.with_security_flags(stream, text)


def sanitized(stream: DataFrame, text: str = "text") -> DataFrame:
    """Redacted form of every arriving text."""
    return sensitive.sanitize(stream, text)


def incidents(lines: DataFrame, line: str = "value") -> DataFrame:
    """Security incidents among arriving audit lines; malformed lines are skipped."""
    return audit_log.parse(lines, line).filter(audit.is_incident())


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is available now to a parquet folder, exactly once."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def write_audit(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append audit entries to a JSON Lines log, one folder per day."""
    lines = entries.select(audit_log.to_line().alias("value"), F.to_date("ts").alias("day"))
    return (
        lines.writeStream.format("text")
        .partitionBy("day")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
