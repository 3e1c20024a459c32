"""Licence statements in texts, by ordered signature rules.

A text is cut into words once. The words decide which rules are tried at all: a
rule needs a word of each of its keyword sets. Where rules find overlapping
places, a place goes if it lies wholly inside one that a rule of higher
priority found, or a longer one of its own priority.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftline.llm.columns import arrow_type, map_texts, pick
from driftline.llm.license_rules import BASE, RULES, Rule

#: A-Z in lower case; words are runs of digits, letters and everything beyond ASCII, all else is a space.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())])


class Scanner:
    """The base phrases and the rules, over one text at a time."""

    def __init__(self, rules: Sequence[Rule] = RULES, base: dict[bytes, str] = BASE):
        self.rules = rules
        self.base = [(b" " + phrase + b" ", label, frozenset(phrase.split())) for phrase, label in base.items()]
        keywords = {k for rule in rules for group in rule.keywords for k in group}
        self.keywords = frozenset(keywords | {w for _, _, words in self.base for w in words})

    def scan(self, text: bytes) -> tuple[int, list[tuple], list[tuple]]:
        """The number of words, the base places and the places of the rules, as (first, last word, label, confidence)."""
        words = text.translate(_WORD_BYTES).split()
        present = self.keywords.intersection(words)
        if not present:
            return len(words), [], []
        phrases = [(p, label) for p, label, needed in self.base if needed <= present]
        rules = [r for r in self.rules if all(not group.isdisjoint(present) for group in r.keywords)]
        if not phrases and not rules:
            return len(words), [], []
        joined = b" " + b" ".join(words) + b" "
        begins = np.fromiter(accumulate((len(w) + 1 for w in words), initial=1), dtype=np.int64, count=len(words) + 1)

        def place(start: int, end: int) -> tuple[int, int]:
            """First and last word of the characters from start to end."""
            return int(np.searchsorted(begins, start)), int(np.searchsorted(begins, end) - 1)

        found = []
        for phrase, label in phrases:
            at = joined.find(phrase)
            while at >= 0:
                found.append((*place(at + 1, at + len(phrase) - 1), label, 1.0))
                at = joined.find(phrase, at + 1)
        places = []
        for rule in rules:
            for m in rule.pattern.finditer(joined):
                places.append((-rule.priority, *place(*m.span()), rule.number, rule.label, rule.confidence))
        return len(words), sorted(found), uncontained(places)


def uncontained(places: list[tuple]) -> list[tuple]:
    """The places that lie in no place of a higher priority and in no longer one of their own.

    Of equal places of one priority the first rule's stays.
    """
    kept: list[tuple] = []
    for _, tier in groupby(sorted(places, key=lambda p: (p[0], p[1], -p[2], p[3])), key=lambda p: p[0]):
        starts = [k[0] for k in kept]
        reach = list(accumulate((k[1] for k in kept), max))
        new, furthest = [], -1
        for _, first, last, _, label, confidence in tier:
            i = np.searchsorted(starts, first, side="right") if starts else 0
            if last > furthest and (not i or reach[i - 1] < last):
                new.append((first, last, label, confidence))
            furthest = max(furthest, last)
        kept = sorted(kept + new)
    return kept


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``base_places`` and ``places`` (arrays of first and last word, label, confidence).

    One row for every row of ``docs``. Null and empty texts have no words and no
    places. Repeated rows and null keys are kept; other columns are left out.
    Whole texts, no shuffle: one pass.
    """

    def work():
        scanner = Scanner()

        def scan(texts: list[bytes]) -> dict:
            found = [scanner.scan(t) for t in texts]
            spans = [
                pa.array([[dict(zip(("first", "last", "label", "confidence"), s, strict=True)) for s in f[k]] for f in found], pa.list_(_SPAN))
                for k in (1, 2)
            ]
            return {"n_words": [f[0] for f in found], "base_places": spans[0], "places": spans[1]}

        return scan

    chosen = pick(docs, key, text)
    kind = chosen.schema[key].dataType
    span = "array<struct<first:bigint,last:bigint,label:string,confidence:double>>"
    return map_texts(
        chosen,
        work,
        f"`{key}` {kind.simpleString()}, n_words bigint, base_places {span}, places {span}",
        pa.schema([(key, arrow_type(kind)), ("n_words", pa.int64()), ("base_places", pa.list_(_SPAN)), ("places", pa.list_(_SPAN))]),
        text,
        as_bytes=True,
    )
