"""Mixing sources to target weights by thresholds on a hash of each document.

A source takes whole copies of itself as often as its target allows and, for
the rest, the documents whose hash lies below a threshold. The threshold is
found from sums of sizes over hash buckets: the bucket in which the running sum
passes the budget is split into finer buckets, and only its documents are read
for that. Nothing is sorted but the buckets of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.columns import BLANK, join_checked, pick, whole_rows, with_whole_row
from driftline.llm.ranks import row_numbers
from driftline.session import materialise

#: Bits of the hash, bits by which each level splits a bucket, and the number of levels.
HASH_BITS, LEVEL_BITS, LEVELS = 60, 10, 3
#: Parts in which a group of equal rows is numbered.
SALTS = 64
_SOURCE = ["source", "unnamed"]


def word_count(text: Column) -> Column:
    """The number of runs of characters that are no white space."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{BLANK[1:-1]}]+{BLANK}*", "x")
    return F.length(F.regexp_replace(runs, f"^{BLANK}+", "")).cast("bigint")


def _bits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def document_hash(key: Column, text: Column) -> Column:
    """60 bits of the MD5 of a key and the MD5 of a text, nulls counting as empty; the same on every run."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return _bits(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), digest))


def _numbered(rows: DataFrame, same: list[str]) -> DataFrame:
    """Add ``copy``: 0, 1, 2 and so on for the rows that agree in ``same``; which row gets which number is open.

    Rows are numbered within SALTS parts of a group, and each part begins where
    the ones before it end, so a group of very many rows is spread.
    """
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    within = Window.partitionBy(*same, "salt").orderBy(F.lit(0))
    salted = materialise(salted.withColumn("copy", F.row_number().over(within) - 1), "mix-copies")
    counts = salted.groupBy(*same, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*same).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(*same, "salt", F.coalesce(before, F.lit(0)).alias("before"))
    joined = salted.join(shifts, [*same, "salt"])
    return joined.select(*rows.columns, (F.col("copy") + F.col("before")).alias("copy"))


def _repeated(sized: DataFrame) -> DataFrame:
    """Sources and hashes of rows that agree in source, key and text with others."""
    counts = sized.groupBy(*_SOURCE, "hash").agg(F.count(F.lit(1)).alias("n"))
    return materialise(counts.filter("n > 1").select(*_SOURCE, "hash"), "mix-repeated")


def _told_apart(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` with a hash of its own for each of equal rows: the first keeps the one they share."""
    same = [*_SOURCE, "hash"]
    if repeated.isEmpty():
        return rows
    single = join_checked(rows, repeated, same, "left_anti").select(*rows.columns)
    several = _numbered(join_checked(rows, repeated, same, "left_semi").select(*rows.columns), same)
    own = F.when(F.col("copy") == 0, F.col("hash")).otherwise(_bits(F.concat_ws(":", "hash", "copy")))
    return single.unionByName(several.withColumn("hash", own).select(*rows.columns))


def water_level(sources: DataFrame, share: float, most: float) -> float:
    """The words for each unit of weight once no source's target is above its limit.

    Every round fixes the sources above their limit at it and shares out what
    is left by weight. A round sends two sums to the driver.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.lit(float(most))
    level = -1.0
    while True:
        full = limit < F.col("weight") * F.lit(level)
        fixed, weight = sources.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        found = (share * total - (fixed or 0.0)) / weight if weight else level
        if found == level:
            return max(level, 0.0)
        level = found


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Each source's size, target, whole copies and the budget that remains for single documents."""
    ranked = row_numbers(sizes, [F.col("unnamed"), F.col("source")], "place")
    weight = F.lit(0)
    for i, w in enumerate(weights):
        weight = F.when(F.col("place") % len(weights) == i, F.lit(w)).otherwise(weight)
    ranked = materialise(ranked.select(*_SOURCE, "source_size", weight.cast("double").alias("weight")), "mix-sources")
    level = water_level(ranked, share, most)
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(level))
    aimed = ranked.select(*_SOURCE, "source_size", target.alias("target"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aimed = aimed.withColumn("copies", copies.cast("bigint"))
    return aimed.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))


def _bucket(level: int) -> Column:
    return F.shiftright("hash", HASH_BITS - LEVEL_BITS * (level + 1))


def thresholds(sized: DataFrame, aimed: DataFrame) -> DataFrame:
    """For each source the finest bucket in which the running sum passes the budget, and whether to take it.

    All buckets below are taken; that last one is, if the sum comes nearer to the budget with it.
    """
    within, edge = sized, None
    for level in range(LEVELS):
        if edge is not None:
            within = sized.withColumn("bucket", _bucket(level - 1)).join(edge.select(*_SOURCE, "bucket"), [*_SOURCE, "bucket"])
        sums = within.select(*_SOURCE, "size", _bucket(level).alias("bucket")).groupBy(*_SOURCE, "bucket").agg(F.sum("size").alias("n"))
        known = aimed.select(*_SOURCE, "budget", F.lit(0).cast("bigint").alias("before")) if edge is None else edge.select(*_SOURCE, "budget", "before")
        running = F.sum("n").over(Window.partitionBy(*_SOURCE).orderBy("bucket"))
        sums = sums.withColumn("running", running).join(known, _SOURCE).withColumn("upto", F.col("before") + F.col("running"))
        passes = (F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("n") <= F.col("budget"))
        edge = sums.filter(passes).select(*_SOURCE, "bucket", "budget", (F.col("upto") - F.col("n")).alias("before"), "n")
        edge = materialise(edge, "mix-edge")
    nearer = F.col("before") + F.col("n") - F.col("budget") < F.col("budget") - F.col("before")
    return edge.select(*_SOURCE, F.col("bucket").alias("last_bucket"), nearer.alias("with_last"))


def _plan(sized: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """For each source and first bucket with documents: size, target, copies and the threshold of the source."""
    # by bucket first, so that a source that is everywhere is spread, and its documents can be joined by bucket
    spread = sized.groupBy(*_SOURCE, _bucket(0).alias("bucket")).agg(F.sum("size").alias("n"))
    aimed = targets(spread.groupBy(*_SOURCE).agg(F.sum("n").alias("source_size")), weights, share, most)
    aimed = materialise(aimed, "mix-targets")
    plan = aimed.join(thresholds(sized, aimed), _SOURCE, "left")
    joined = spread.select(*_SOURCE, "bucket").join(plan, _SOURCE)
    return materialise(joined.select(*_SOURCE, "bucket", F.struct(*plan.columns[2:]).alias("plan")), "mix-plan")


def _copies(hashed: Column) -> Column:
    """How often a document is taken, from its hash and the ``plan`` of its source."""
    last = F.shiftright(hashed, HASH_BITS - LEVEL_BITS * LEVELS)
    extra = (last < F.col("plan.last_bucket")) | ((last == F.col("plan.last_bucket")) & F.col("plan.with_last"))
    return F.col("plan.copies") + F.when(F.coalesce(extra, F.lit(False)), F.lit(1)).otherwise(0)


def _named(source: Column) -> list[Column]:
    return [F.coalesce(source, F.lit("")).alias("source"), source.isNull().alias("unnamed")]


def mix(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    most: float = 2.0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` for every row of ``docs``.

    Sources in order of their code points, null last, weigh ``weights``, again
    and again. Together they get ``share`` of all words; a target stops at
    ``most`` times its source's words, and what is over goes to the others by
    weight. ``taken`` is how many of a document's words the mix takes, repeats
    counted: 0, 1 or more times its size. A null text has 0 words. Each row
    counts by itself, also where others agree with it in key, text and source;
    which of equal rows is taken more often is open. A source's sum is off its
    target by half of what shares the last bucket of 30 bits at most: mostly
    half a document.
    """
    sized = _sized(pick(docs, key, text, source).toDF("doc_id", "text", "source"), "doc_id")
    sized = materialise(_told_apart(sized, _repeated(sized)), "mix-told")
    joined = sized.withColumn("bucket", _bucket(0)).join(_plan(sized, weights, share, most), [*_SOURCE, "bucket"])
    taken = (_copies(F.col("hash")) * F.col("size")).cast("bigint")
    return joined.select("doc_id", "size", "plan.source_size", "plan.target", taken.alias("taken"))


def _sized(rows: DataFrame, *more: str) -> DataFrame:
    size, hashed = word_count(F.col("text")), document_hash(F.col("doc_id"), F.col("text"))
    return materialise(rows.select(*more, *_named(F.col("source")), size.alias("size"), hashed.alias("hash")), "mix-sizes")


def take_mix(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    most: float = 2.0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as ``mix`` takes it; texts without words go.

    Columns may have any names, also such that differ from the named ones only in case.
    """
    sized = _sized(pick(docs, key, text, source).toDF("doc_id", "text", "source"))
    repeated = _repeated(sized)
    plan = _plan(materialise(_told_apart(sized, repeated), "mix-told"), weights, share, most)
    rows = with_whole_row(docs, key, text, source).toDF("doc", "key", "text", "source")
    rows = rows.filter(F.coalesce("text", F.lit("")).rlike(f"[^{BLANK[1:-1]}]"))
    rows = rows.select("doc", *_named(F.col("source")), document_hash(F.col("key"), F.col("text")).alias("hash"))
    # rows without words have no size, so which of equal rows they are does not matter above
    marked = _told_apart(rows, repeated).withColumn("bucket", _bucket(0))
    joined = marked.join(plan, [*_SOURCE, "bucket"])
    copies = joined.select("doc", F.explode(F.array_repeat(F.lit(1), _copies(F.col("hash")).cast("int"))))
    return whole_rows(copies, docs)
