"""Personal data and secrets across a corpus of texts.

Every job is a narrow projection over the rows: nothing is shuffled until a
roll-up is asked for. ``keys`` are the columns carried along with each result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.arrays import explode_rows
from driftline.functions.redaction import sanitized, without_overlaps
from driftline.functions.regex import jvm
from driftline.functions.spans import Pattern, any_found, spans

# What a match of each pattern needs: one of some words, and a cheaper regex.
_NEEDS = [
    (("apikey", "api_key", "api-key"), ""),
    (("authtoken", "auth_token", "auth-token", "bearer"), ""),
    (("akia", "abia", "acca", "asia"), ""),
    (("secretaccess", "secret_access", "secret-access"), ""),
    (("ghp_",), ""),
    (("gho_",), ""),
    (("ghu_",), ""),
    (("ghs_",), ""),
    (("ghr_",), ""),
    (("private key",), ""),
    (("private key",), ""),
    (("secret", "passw", "pwd"), ""),
    (("clientsecret", "client_secret", "client-secret"), ""),
    (("passw", "pwd"), ""),
    (("@",), ""),
    ((), "(?s)[0-9]{3}.{0,2}[0-9]{3}"),
    (("+",), r"\+[0-9]"),
    ((), "(?s)[0-9]{3}.?[0-9]{2}.?[0-9]{4}"),
    ((), "[0-9]{13}"),
    ((), r"[0-9]\.[0-9]{1,3}\.[0-9]"),
]
# The characters a match can begin with. The test for the edge of a word looks to both
# sides of every place of a text; with this in front it is made at few of them.
_FIRST = {15: "[0-9+(]", 16: r"\+", 17: "[0-9]", 18: "[3-6]", 19: "[0-9]"}
PATTERNS = [
    Pattern(i, kind, jvm(f"(?={_FIRST[i]})" + regex if i in _FIRST else regex), group, words=words, shape=shape)
    for i, ((kind, regex, group), (words, shape)) in enumerate(
        zip(fv.SENSITIVE_PATTERNS, _NEEDS, strict=True)
    )
]


def is_sensitive(text: Column) -> Column:
    """True where any pattern matches; entropy is not looked at."""
    return any_found(text, PATTERNS)


def quick_filter(content: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text holds any sensitive pattern."""
    return content.filter(is_sensitive(F.col(text)))


def _span_rows(content: DataFrame, keys: list[str], found: Column) -> DataFrame:
    return explode_rows(content, keys, found, "s").select(
        *keys,
        F.col("s.ordinal").alias("ordinal"),
        F.col("s.type").alias("type"),
        F.col("s.start").alias("start"),
        F.col("s.line_number").alias("line_number"),
        F.length("s.value").alias("original_length"),
        F.col("s.value").alias("value"),
    )


def findings(content: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every match of every pattern, overlapping ones included."""
    return _span_rows(content, keys, spans(F.col(text), PATTERNS))


def resolved_spans(content: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The matches that survive overlap removal."""
    return _span_rows(content, keys, without_overlaps(spans(F.col(text), PATTERNS)))


def sanitized_text(text: Column, with_entropy: bool = True) -> Column:
    """Struct of sanitized_text, items, redacted_count and two flags for one text."""
    return sanitized(text, PATTERNS, with_entropy)


def sanitize(
    content: DataFrame, text: str = "text", with_entropy: bool = True, into: str = "sanitized"
) -> DataFrame:
    """Add the result of :func:`sanitized_text` as a column."""
    return content.withColumn(into, sanitized_text(F.col(text), with_entropy))


def redacted_items(content: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per redaction, pattern hits first, then high-entropy words."""
    rows = explode_rows(sanitize(content, text), keys, F.col("sanitized.items"), "i")
    return rows.select(
        *keys, F.col("pos").alias("n"), "i.type", "i.line_number", "i.original_length", "i.token"
    )


def high_entropy_secrets(content: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Words flagged by entropy alone on the text that pattern redaction left."""
    s = F.col("sanitized")
    tokens = F.slice(
        s["items"], F.size(s["items"]) - F.size(s["entropy_words"]) + 1, F.size(s["entropy_words"])
    )
    pairs = F.arrays_zip(s["entropy_words"].alias("w"), tokens.alias("t"))
    return explode_rows(sanitize(content, text), keys, pairs, "p").select(
        *keys,
        F.col("p.w.line_number").alias("line_number"),
        F.length("p.w.value").alias("original_length"),
        F.col("p.w.value").alias("value"),
        F.col("p.t.token").alias("token"),
    )


def summary(content: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Redaction count and flags per text, clean texts included."""
    names = ["redacted_count", "pii_detected", "secrets_detected"]
    return sanitize(content, text).select(*keys, *[f"sanitized.{n}" for n in names])


def report(content: DataFrame, key: str, group: str, text: str = "text") -> DataFrame:
    """Redactions by group and type with sub-totals (NULL marks a total)."""
    items = redacted_items(content, [key, group], text)
    return items.rollup(group, "type").agg(
        F.count("*").alias("findings"), F.countDistinct(key).alias("texts")
    )
