"""Where patterns match inside a text, as array-of-struct Columns.

Spark returns matches without offsets. The gaps between matches come from
``split`` with the same pattern, so a running sum over gaps and matches gives
every offset. All offsets are 0-based and count characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.arrays import let, scan
from driftline.functions.regex import folded

SPAN = (
    "struct<start:int,ordinal:int,end:int,type:string,value:string,severity:string,line_number:int>"
)


@dataclass(frozen=True)
class Pattern:
    """One row of a pattern table; ``regex`` is in the JVM dialect."""

    ordinal: int
    type: str
    regex: str
    group: int = 0
    severity: str = ""
    words: tuple[str, ...] = ()  # a match needs one of these in the folded text
    shape: str = ""  # a match needs this cheaper regex to match, too

    def possible_in(self, text: Column, fold: Column) -> Column:
        """False where cheap tests rule a match out."""
        tests = []
        if self.words:
            hit = F.contains(fold, F.lit(self.words[0]))
            for word in self.words[1:]:
                hit = hit | F.contains(fold, F.lit(word))
            tests.append(hit)
        if self.shape:
            tests.append(F.regexp_like(text, F.lit(self.shape)))
        possible = tests[0] if tests else F.lit(True)
        for test in tests[1:]:
            possible = possible & test
        return possible

    def hits(self, text: Column, fold: Column) -> Column:
        """The pattern's fields and all its matches, NULL where a match is ruled out."""
        return F.when(
            self.possible_in(text, fold),
            F.struct(
                F.lit(self.ordinal).alias("ordinal"),
                F.lit(self.type).alias("type"),
                F.lit(self.regex).alias("regex"),
                F.lit(self.group).alias("group"),
                F.lit(self.severity).alias("severity"),
                F.regexp_extract_all(text, F.lit(self.regex), F.lit(0)).alias("whole"),
            ),
        )


def any_found(text: Column, patterns: list[Pattern]) -> Column:
    """True where at least one pattern matches."""

    def either(fold: Column) -> Column:
        found = F.lit(False)
        for p in patterns:
            found = found | (p.possible_in(text, fold) & F.regexp_like(text, F.lit(p.regex)))
        return found

    return let(folded(text), either)


def _patterns_found(text: Column, patterns: list[Pattern]) -> Column:
    """The patterns that match, with their matches; empty for most texts."""
    return let(
        folded(text),
        lambda fold: F.filter(
            F.array(*[p.hits(text, fold) for p in patterns]), lambda p: F.size(p["whole"]) > 0
        ),
    )


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _matches(text: Column, p: Column) -> Column:
    """The spans of one pattern's matches, left to right."""
    whole = p["whole"]
    inner = F.when(p["group"] > 0, F.regexp_extract_all(text, p["regex"], p["group"])).otherwise(
        whole
    )
    gaps = F.split(text, p["regex"], -1)

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        after = at["pos"] + F.length(m["gap"]) + F.length(m["whole"])
        # a captured group is followed by one closing quote at most
        quote = F.when(
            (p["group"] > 0) & F.substring(m["whole"], -1, 1).isin('"', "'"), 1
        ).otherwise(0)
        start = after - quote - F.length(m["value"])
        first_line = at["line"] + _newlines(m["gap"])
        line = first_line + _newlines(
            F.substring(m["whole"], F.lit(1), start - at["pos"] - F.length(m["gap"]))
        )
        span = F.struct(
            start.alias("start"),
            p["ordinal"].alias("ordinal"),
            (after - quote).alias("end"),
            p["type"].alias("type"),
            m["value"].alias("value"),
            p["severity"].alias("severity"),
            line.alias("line_number"),
        )
        state = F.struct(
            after.alias("pos"), (first_line + _newlines(m["whole"])).alias("line")
        )
        return state, F.array(span)

    zipped = F.arrays_zip(
        F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"),
        whole.alias("whole"),
        inner.alias("value"),
    )
    start = F.struct(F.lit(0).alias("pos"), F.lit(1).alias("line"))
    return scan(zipped, start, SPAN, step)


def spans(text: Column, patterns: list[Pattern]) -> Column:
    """Every match of every pattern, ordered by (start, ordinal).

    Cheap tests rule out most patterns; only the few that hit pay for offsets.
    """
    return let(
        text,
        lambda t: F.sort_array(
            F.flatten(F.transform(_patterns_found(t, patterns), lambda p: _matches(t, p)))
        ),
    )
