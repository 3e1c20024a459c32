"""Tokens, term counts and sparse TF-IDF vectors inside one row."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.arrays import let
from driftline.functions.regex import WORD

VECTOR = "array<struct<idx:int,weight:double>>"


def tokens(text: Column) -> Column:
    """Lower-case words of 2 to 21 ASCII letters, digits and underscores.

    A token is a whole word, so words that are longer or hold other letters
    give none: each match takes a whole word, and one that is no token is empty.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({fv.TOKEN}+)(?!{WORD})|{WORD}++"), F.lit(1))
    return F.filter(words, lambda w: w != "")


def _runs(s: Column, same: Column, entry) -> Column:
    """One entry per run of a sorted array; ``same`` says where two neighbours agree."""
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~same(i))
    return let(
        starts,
        lambda f: F.transform(
            f, lambda b, j: entry(F.get(s, b), b, F.coalesce(F.get(f, j + 1), F.size(s)))
        ),
    )


def term_counts(words: Column) -> Column:
    """Distinct terms as (term, n), sorted by term.

    Sorting puts equal words side by side, so counting takes one pass over the
    sorted words rather than one per term.
    """
    none = F.array().cast("array<struct<term:string,n:int>>")

    def runs(s: Column) -> Column:
        return _runs(
            s,
            lambda i: F.get(s, i) == F.get(s, i - 1),
            lambda term, b, end: F.struct(term.alias("term"), (end - b).alias("n")),
        )

    return let(F.sort_array(words), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))


def term_places(words: Column) -> Column:
    """Distinct terms as (term, places), the places of each term ascending."""
    none = F.array().cast("array<struct<term:string,places:array<int>>>")

    def runs(s: Column) -> Column:
        return _runs(
            s,
            lambda i: F.get(s, i)["term"] == F.get(s, i - 1)["term"],
            lambda first, b, end: F.struct(
                first["term"].alias("term"),
                F.transform(F.slice(s, b + 1, end - b), lambda x: x["place"]).alias("places"),
            ),
        )

    tagged = F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("place")))
    return let(F.sort_array(tagged), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))


def idf(docs: Column, df: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((docs + 1) / (df + 1)) + 1


def unit(vector: Column, name: str = "idx") -> Column:
    """Scale (``name``, weight) entries to length 1; a zero vector stays as it is."""

    def scaled(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x["weight"] * x["weight"])
        return let(
            F.sqrt(total),
            lambda length: F.transform(
                v,
                lambda x: F.struct(
                    x[name].alias(name),
                    F.when(length > 0, x["weight"] / length).otherwise(x["weight"]).alias("weight"),
                ),
            ),
        )

    return let(vector, scaled)


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vocabulary: terms in index order with their weights.

    It has a bounded number of terms, so it travels as literals inside
    expressions, and texts become vectors without a join or a shuffle.
    """

    terms: Sequence[str]
    idfs: Sequence[float]

    def _places(self) -> Column:
        # one literal, folded to an array at planning time
        return F.split(F.lit(" ".join(self.terms)), " ")

    def _sorted(self) -> list[int]:
        """The numbers of the terms, the first of equal ones, in the order of the terms."""
        first = {term: i for i, term in reversed(list(enumerate(self.terms)))}
        return [first[term] for term in sorted(first)]

    def vector(self, text: Column) -> Column:
        """Unit vector of a text as (idx, weight) entries, ordered by idx.

        NULL under a vocabulary without terms, as for a missing vocabulary.
        """
        if not self.terms:
            return F.lit(None).cast(VECTOR)
        known = F.filter(tokens(text), lambda w: w.isin(list(self.terms)))
        order = self._sorted()
        ascending = F.split(F.lit(" ".join(self.terms[i] for i in order)), " ")
        numbers = F.from_json(F.lit(json.dumps(order)), "array<int>")
        weights = F.from_json(F.lit(json.dumps([self.idfs[i] for i in order])), "array<double>")
        halves = F.array(*[F.lit(2**b) for b in reversed(range(len(order).bit_length()))])

        def place(term: Column) -> Column:
            """Where a known term stands among the ascending ones, by halving."""

            def half(at: Column, step: Column) -> Column:
                further = F.coalesce(F.get(ascending, at + step) <= term, F.lit(False))
                return F.when(further, at + step).otherwise(at)

            return F.aggregate(halves, F.lit(0), half)

        def entry(t: Column, at: Column) -> Column:
            weight = t["n"] * F.get(weights, at)
            return F.struct(F.get(numbers, at).alias("idx"), weight.alias("weight"))

        entries = F.transform(term_counts(known), lambda t: let(place(t["term"]), lambda at: entry(t, at)))
        return unit(F.sort_array(entries))

    def term(self, idx: Column) -> Column:
        return F.get(self._places(), idx)


def dot(vector: Column, weights: Column, name: str = "idx") -> Column:
    """Dot product of a (``name``, weight) array with a map from name to weight."""
    return F.aggregate(
        vector,
        F.lit(0.0),
        lambda a, x: a + x["weight"] * F.coalesce(F.try_element_at(weights, x[name]), F.lit(0.0)),
    )
