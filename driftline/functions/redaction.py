"""Overlap removal, token numbering and redaction inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.arrays import let, scan
from driftline.functions.regex import jvm
from driftline.functions.spans import SPAN, Pattern, spans

ITEM = "struct<start:int,end:int,type:string,line_number:int,original_length:int,token:string>"


def without_overlaps(found: Column) -> Column:
    """Keep a span when it starts at or after the end of the last kept one.

    ``found`` is ordered by (start, ordinal), so of two spans that start
    together the earlier pattern wins.
    """

    def step(last_end: Column, s: Column) -> tuple[Column, Column]:
        keep = s["start"] >= last_end
        none = F.array().cast(f"array<{SPAN}>")
        return (
            F.when(keep, s["end"]).otherwise(last_end),
            F.when(keep, F.array(s)).otherwise(none),
        )

    return scan(found, F.lit(0), SPAN, step)


def _token(kind: Column, n: Column) -> Column:
    return F.format_string(fv.REDACTION_TOKEN, F.upper(kind), n)


def numbered(kept: Column) -> Column:
    """Kept spans as redaction items; numbers per type run from the last span back."""

    def of_type(spans: Column, kind: Column) -> Column:
        return let(
            F.filter(spans, lambda s: s["type"] == kind),
            lambda same: F.transform(
                same,
                lambda s, i: F.struct(
                    s["start"],
                    s["end"],
                    s["type"],
                    s["line_number"],
                    F.length(s["value"]).alias("original_length"),
                    _token(kind, F.size(same) - i).alias("token"),
                ),
            ),
        )

    return let(
        kept,
        lambda k: F.sort_array(
            F.flatten(
                F.transform(
                    F.array_distinct(F.transform(k, lambda s: s["type"])),
                    lambda kind: of_type(k, kind),
                )
            )
        ),
    )


# Put in front of every piece, so that decoding never eats a mark of the text itself.
_BOM = bytearray(b"\x00\x00\xfe\xff")


def replace_spans(text: Column, items: Column) -> Column:
    """``text`` with each item's span replaced by its token.

    The text is cut in UTF-32, where any character range is a constant-time
    slice; cutting UTF-8 would walk the text from its start for every span.
    """

    def cut(wide: Column, start: Column, end: Column) -> Column:
        piece = F.substring(wide, start * 4 + 1, (end - start) * 4)
        return F.decode(F.concat(F.lit(_BOM), piece), "UTF-32")

    def join(wide: Column, its: Column) -> Column:
        def before(item: Column, i: Column) -> Column:
            prev_end = F.when(i > 0, F.get(its, i - 1)["end"]).otherwise(F.lit(0))
            return F.concat(cut(wide, prev_end, item["start"]), item["token"])

        tail = cut(wide, F.element_at(its, -1)["end"], F.length(wide).cast("int") / 4)
        return F.concat(F.array_join(F.transform(its, before), ""), tail)

    wide = F.encode(text, "UTF-32")
    return let(
        items,
        lambda its: F.when(F.size(its) == 0, text).otherwise(let(wide, lambda w: join(w, its))),
    )


def entropy(value: Column) -> Column:
    """Shannon entropy of a string over its characters; 0 when empty."""

    def of(chars: Column) -> Column:
        total = F.size(chars).cast("double")
        runs = F.transform(
            F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / total
        )
        return F.aggregate(runs, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(let(F.split(value, ""), of))


def sanitized(text: Column, patterns: list[Pattern], with_entropy: bool = True) -> Column:
    """Struct of redacted text, redaction items and the two detection flags."""

    def result(items: Column, redacted: Column, words: Column) -> Column:
        secrets = F.size(F.filter(items, lambda s: s["type"] == "secret"))
        extra = F.transform(
            words,
            lambda w, i: F.struct(
                F.lit(None).cast("int").alias("start"),
                F.lit(None).cast("int").alias("end"),
                F.lit("secret").alias("type"),
                w["line_number"],
                F.length(w["value"]).alias("original_length"),
                _token(F.lit("secret"), secrets + 1 + i).alias("token"),
            ),
        )
        is_secret = lambda s: s["type"].isin(fv.SECRET_TYPES)
        return F.struct(
            replace_words(redacted, words, secrets + 1).alias("sanitized_text"),
            F.concat(items, extra).alias("items"),
            (F.size(items) + F.size(words)).alias("redacted_count"),
            F.exists(items, lambda s: ~is_secret(s)).alias("pii_detected"),
            (F.exists(items, is_secret) | (F.size(words) > 0)).alias("secrets_detected"),
            redacted.alias("pattern_text"),
            words.alias("entropy_words"),
        )

    def with_words(items: Column, redacted: Column) -> Column:
        none = F.array().cast("array<struct<line_number:int,value:string>>")
        words = high_entropy_words(redacted) if with_entropy else none
        return let(words, lambda w: result(items, redacted, w))

    def of(t: Column) -> Column:
        return let(
            numbered(without_overlaps(spans(t, patterns))),
            lambda items: let(replace_spans(t, items), lambda r: with_words(items, r)),
        )

    return let(text, of)


# A word needs this many characters before its entropy can reach the threshold.
_SHORTEST = int(2**fv.ENTROPY_THRESHOLD) + 1
# A run of so many of a word's characters; it is looked for only where a run begins.
_LONG = r"(?<![a-zA-Z0-9_\-/+=])[a-zA-Z0-9_\-/+=]{%d}" % _SHORTEST


def high_entropy_words(text: Column) -> Column:
    """Array of (line_number, value) of high-entropy words in text order."""
    word = jvm(fv.ENTROPY_WORD)

    none = F.array().cast("array<struct<line_number:int,value:string>>")

    def in_line(line: Column, i: Column) -> Column:
        hits = F.filter(
            F.regexp_extract_all(line, F.lit(word), F.lit(0)),
            lambda v: (F.length(v) >= _SHORTEST) & (entropy(v) >= fv.ENTROPY_THRESHOLD),
        )
        found = F.transform(
            hits, lambda v: F.struct((i + 1).alias("line_number"), v.alias("value"))
        )
        return F.when(F.regexp_like(line, F.lit(_LONG)), found).otherwise(none)

    found = F.flatten(F.transform(F.split(text, "\n"), in_line))
    return F.when(F.regexp_like(text, F.lit(_LONG)), found).otherwise(none)


def replace_words(text: Column, words: Column, first_number: Column) -> Column:
    """Replace the first occurrence of each word in turn, numbering upward."""
    numbered_words = F.transform(
        words,
        lambda w, i: F.struct(
            w["value"].alias("value"), _token(F.lit("secret"), first_number + i).alias("token")
        ),
    )
    return F.aggregate(
        numbered_words,
        text,
        lambda t, w: let(
            F.position(w["value"], t),
            lambda at: F.when(at == 0, t).otherwise(
                F.overlay(t, w["token"], at, F.length(w["value"]))
            ),
        ),
    )
