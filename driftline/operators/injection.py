"""Prompt-injection phrases across a corpus of texts.

Matches are taken line by line, as one pass of a line-bounded pattern over the
whole text; the quick check looks at the text as a whole, so a phrase broken
over two lines is seen by the check only. Overlapping matches all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.arrays import explode_rows, let
from driftline.functions.redaction import high_entropy_words, numbered, replace_spans, without_overlaps
from driftline.functions.regex import jvm
from driftline.functions.spans import Pattern, any_found, spans
from driftline.operators.sensitive import PATTERNS as SENSITIVE


# What a match of each pattern needs: one of some words, or a cheaper regex.
_NEEDS = [
    (("ignore",), ""),
    (("disregard",), ""),
    (("forget",), ""),
    (("override",), ""),
    (("bypass",), ""),
    (("instruction",), ""),
    (("instruction",), ""),
    (("now",), ""),
    (("different", "unrestricted"), ""),
    (("pretend",), ""),
    (("roleplay",), ""),
    (("switch",), ""),
    (("enable",), ""),
    (("system",), ""),
    (("actually",), ""),
    (("previous",), ""),
    (("start",), ""),
    (("reset",), ""),
    (("clear",), ""),
    (("```",), ""),
    (("<|",), ""),
    (("inst]",), ""),
    (("sys>>",), ""),
    (("### ",), ""),
    (("human:", "assistant:", "system:"), ""),
    (("decode",), ""),
    (("execute",), ""),
    ((), "[A-Za-z0-9+/]{50}"),
]


def patterns(sensitivity: str = "medium", by_line: bool = True) -> list[Pattern]:
    """Patterns in force at a sensitivity; an unknown name means medium."""
    levels = fv.SENSITIVITY_LEVELS.get(sensitivity, fv.SENSITIVITY_LEVELS["medium"])
    return [
        Pattern(i, kind, jvm(regex, by_line), 0, severity, words, shape)
        for i, ((kind, regex, severity), (words, shape)) in enumerate(
            zip(fv.INJECTION_PATTERNS, _NEEDS, strict=True)
        )
        if severity in levels
    ]


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


def _display(value: Column) -> Column:
    return F.when(F.length(value) > 50, F.concat(F.left(value, F.lit(50)), F.lit("..."))).otherwise(
        value
    )


def matches(text: Column, sensitivity: str = "medium") -> Column:
    """Array of match structs of one text."""
    return spans(text, patterns(sensitivity))


def findings(
    content: DataFrame, keys: list[str], text: str = "text", sensitivity: str = "medium"
) -> DataFrame:
    """One row per match."""
    rows = explode_rows(content, keys, matches(F.col(text), sensitivity), "m")
    return rows.select(
        *keys,
        F.col("m.ordinal").alias("ordinal"),
        F.col("m.type").alias("type"),
        F.col("m.severity").alias("severity"),
        F.col("m.line_number").alias("line_number"),
        _display(F.col("m.value")).alias("matched_text"),
        _lookup(fv.INJECTION_DESCRIPTIONS, F.col("m.type")).alias("description"),
    )


def by_sensitivity(content: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Match counts by group and type at every sensitivity.

    The texts are scanned once, with all patterns; counts per severity are then
    added up for the levels that include it.
    """
    counts = (
        findings(content, [group], text, "high")
        .groupBy(group, "type", "severity")
        .agg(F.count("*").alias("n"))
    )
    levels = F.array(
        *[
            F.when(F.col("severity").isin(severities), F.lit(level))
            for level, severities in fv.SENSITIVITY_LEVELS.items()
        ]
    )
    spread = counts.select(group, "type", "n", F.explode(F.array_compact(levels)).alias("sensitivity"))
    return spread.groupBy("sensitivity", group, "type").agg(F.sum("n").alias("findings"))


def risk_score(found: Column) -> Column:
    """Severity weights added up, a third each, at most 1."""
    total = F.aggregate(
        found, F.lit(0.0), lambda acc, m: acc + _lookup(fv.SEVERITY_WEIGHTS, m["severity"])
    )
    return F.least(F.lit(1.0), total / 3.0)


def risk(
    content: DataFrame, keys: list[str], text: str = "text", sensitivity: str = "medium"
) -> DataFrame:
    """Safety, match count and risk score per text, safe texts included."""
    found = content.select(*keys, matches(F.col(text), sensitivity).alias("m"))
    return found.select(
        *keys,
        (F.size("m") == 0).alias("is_safe"),
        F.size("m").alias("injection_count"),
        risk_score(F.col("m")).alias("risk_score"),
    )


def is_safe(text: Column, sensitivity: str = "medium") -> Column:
    """True where no pattern matches the text as a whole."""
    return ~any_found(text, patterns(sensitivity, by_line=False))


def quick_filter(content: DataFrame, text: str = "text", sensitivity: str = "medium") -> DataFrame:
    """Rows that fail the quick check."""
    return content.filter(~is_safe(F.col(text), sensitivity))


def flags(text: Column, sensitivity: str = "medium") -> Column:
    """One flag text per injection type, from its first match in pattern order."""

    def describe(m: Column) -> Column:
        return F.format_string(
            fv.INJECTION_FLAG,
            F.upper(m["severity"]),
            _lookup(fv.INJECTION_DESCRIPTIONS, m["type"]),
            m["line_number"],
        )

    def first_per_type(found: Column) -> Column:
        return F.transform(
            F.array_distinct(F.transform(found, lambda m: m["type"])),
            lambda kind: describe(F.filter(found, lambda m: m["type"] == kind)[0]),
        )

    by_pattern = F.sort_array(
        F.transform(
            matches(text, sensitivity),
            lambda m: F.struct(m["ordinal"], m["start"], m["type"], m["severity"], m["line_number"]),
        )
    )
    return let(by_pattern, first_per_type)


def with_security_flags(diffs: DataFrame, text: str = "text", into: str = "security_flags") -> DataFrame:
    """Add the combined flag list: secrets, personal data, then injection types.

    Only texts that some sensitive pattern matches get a secrets or personal-data
    flag, so a text whose only secret is a high-entropy word gets none.
    """

    t = F.col(text)
    return diffs.withColumn(into, F.concat(let(t, sensitive_flags), flags(t)))


def sensitive_flags(text: Column) -> Column:
    """The secrets and personal-data flags of a text.

    Entropy is only looked at where a pattern hit but none of a secret, and the
    redacted text is only made for that.
    """
    is_secret = lambda s: s["type"].isin(fv.SECRET_TYPES)

    def of(kept: Column) -> Column:
        by_entropy = F.size(high_entropy_words(replace_spans(text, numbered(kept)))) > 0
        secret = (
            F.when(F.size(kept) == 0, F.lit(False))
            .when(F.exists(kept, is_secret), F.lit(True))
            .otherwise(by_entropy)
        )
        personal = F.exists(kept, lambda s: ~is_secret(s))
        return F.array_compact(
            F.array(F.when(secret, F.lit(fv.SECRETS_FLAG)), F.when(personal, F.lit(fv.PII_FLAG)))
        )

    return let(without_overlaps(spans(text, SENSITIVE)), of)
