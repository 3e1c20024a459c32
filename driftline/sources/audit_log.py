"""The audit log as JSON Lines: writing, reading and parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = (
    "timestamp string, trace_id string, action string, agent_id string, session_id string, "
    "risk_score double, pii_detected boolean, injection_detected boolean, status string, "
    "repo_path string, duration_ms bigint, metadata map<string,string>"
)
REQUIRED = [
    "timestamp",
    "trace_id",
    "action",
    "agent_id",
    "risk_score",
    "pii_detected",
    "injection_detected",
    "status",
    "repo_path",
    "metadata",
]


def iso(ts: Column) -> Column:
    """A timestamp as ISO 8601 text in UTC; whole seconds carry no fraction."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.unix_micros(ts) % 1_000_000 == 0
    text = F.when(whole, F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    return F.concat(text, F.lit("+00:00"))


def to_line() -> Column:
    """One entry as a JSON object.

    A missing session or duration leaves its key out; other missing values are
    written as null.
    """
    fields = [iso(F.col("ts")).alias(c) if c == "timestamp" else F.col(c) for c in REQUIRED]
    base = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    optional = F.to_json(F.struct(F.nullif("session_id", F.lit("")).alias("session_id"), "duration_ms"))
    return F.when(optional == "{}", base).otherwise(
        F.concat(F.regexp_replace(base, r"\}\z", ","), F.substring(optional, F.lit(2), F.length(optional)))
    )


def write(entries: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Append entries below ``path``, one folder per day.

    The rebalance hint lets Spark split a crowded day over several files and
    merge quiet ones, instead of one file per task and day. With ``order`` the
    files of a day hold ranges of it, so the lines of an append stand in that
    order within each day.
    """
    write_lines(entries.withColumn("value", to_line()), path, order)


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Append the texts in ``value`` as lines, by the day of ``ts``; see :func:`write`."""
    kept = order or []
    dated = lines.select("value", F.to_date("ts").alias("day"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(kept)])
    if order:
        keys = ["day", *[f"__{i}" for i in range(len(kept))]]
        dated = dated.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value", "day")
    else:
        dated = dated.hint("rebalance", "day")
    dated.write.mode("append").partitionBy("day").text(path)


def write_clustered(entries: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Store entries as a table bucketed and sorted by trace, for joins on the trace that do not move the log."""
    rows = entries.repartition(buckets, "trace_id")
    rows.write.bucketBy(buckets, "trace_id").sortBy("trace_id").option("path", path).mode("overwrite").saveAsTable(name)


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """Entries of JSON lines; malformed and empty lines are skipped, defaults filled in.

    Of a repeated key the last value counts.
    """
    broken = F.from_json(line, "_broken string", {"columnNameOfCorruptRecord": "_broken"})["_broken"]
    good = lines.filter(F.startswith(F.ltrim(line), F.lit("{")) & broken.isNull())
    rest = [c for c in lines.columns if c != line]
    rows = good.withColumn("e", F.from_json(line, ENTRY))
    empty = F.create_map().cast("map<string,string>")
    return rows.select(
        *rest,
        F.try_to_timestamp("e.timestamp").alias("ts"),
        "e.trace_id",
        "e.action",
        "e.agent_id",
        "e.session_id",
        F.coalesce("e.risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("e.pii_detected", F.lit(False)).alias("pii_detected"),
        F.coalesce("e.injection_detected", F.lit(False)).alias("injection_detected"),
        F.coalesce("e.status", F.lit("ok")).alias("status"),
        "e.repo_path",
        "e.duration_ms",
        F.coalesce("e.metadata", empty).alias("metadata"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """All entries below ``path``."""
    return parse(spark.read.text(path).select("value"))


# --- the order of the log ------------------------------------------------------

#: The place of a line: its day, its append, its file and its place there.
PLACE = ["day", "appended", "file", "start", "line_no"]
_FILE = r"(?:day=(\d{4}-\d\d-\d\d)/)?(part-\d+)-([^/.]*)[^/]*$"


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a log in its order: day, then append, then the files of an append as it numbered them.

    Only the listing is read. An append is as old as the oldest of its files;
    files of other names come by their own age.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*")
    rows = listed.load(path).select("path", F.unix_micros("modificationTime").alias("written"), "length")
    part = lambda i: F.regexp_extract("path", _FILE, i)
    job = F.when(part(3) != "", part(3)).otherwise(F.col("path"))
    rows = rows.select("path", "written", "length", part(1).alias("day"), job.alias("job"))
    oldest = F.min("written").over(Window.partitionBy("day", "job"))
    # an append has one row of a day's listing for each of its files, so the window is small
    return rows.select("path", "length", "day", oldest.alias("appended"))


def ordered_lines(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """The lines of some files of :func:`files` with their PLACE in the log, malformed and empty ones too.

    Spark reads a file in splits, each from its first line on; the running row
    number of a task orders the lines of a split.
    """
    chosen = [r["path"] for r in listed.select("path").collect()]
    if not chosen:
        return spark.createDataFrame([], "value string, day string, appended bigint, file string, start bigint, line_no bigint")
    lines = spark.read.text(chosen).select(
        "value",
        _plain_path("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line_no"),
    )
    known = listed.select(_plain_path("path").alias("file"), "day", "appended")
    return lines.join(known, "file").select("value", *PLACE)


def _plain_path(name: str) -> Column:
    """A path as both listings and rows give it: local ones without a scheme, no characters escaped."""
    return F.url_decode(F.replace(F.regexp_replace(name, "^file:/*", "/"), F.lit("+"), F.lit("%2B")))


def _some(listed: DataFrame, n: int, newest: bool) -> DataFrame:
    order = [F.col("day"), F.col("appended"), F.col("path")]
    return listed.orderBy(*[c.desc() for c in order] if newest else order).limit(n)


def last_lines(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The last ``limit`` lines of a log with their PLACE; opens the last files only, twice as many until they suffice."""
    listed, n = files(spark, path), 1
    total = listed.count()
    while True:
        lines = ordered_lines(spark, _some(listed, n, newest=True))
        if n >= total or lines.limit(limit).count() >= limit:
            return lines.orderBy(*[F.desc(c) for c in PLACE]).limit(limit)
        n *= 2


def first_entries(spark: SparkSession, path: str, wanted: Column, limit: int) -> DataFrame:
    """The first ``limit`` entries of a log that fulfil ``wanted``, with their PLACE; opens files from the front until they suffice."""
    listed, n = files(spark, path), 1
    total = listed.count()
    while True:
        found = parse(ordered_lines(spark, _some(listed, n, newest=False))).filter(wanted)
        if n >= total or found.limit(limit).count() >= limit:
            return found.orderBy(*PLACE).limit(limit)
        n *= 2
