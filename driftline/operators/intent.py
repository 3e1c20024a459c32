"""How well diffs match their tickets.

A diff meets its ticket in one join, after which everything about the pair is in
one row: the two-text vocabulary, the similarity and the warnings are computed
there without a further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.functions.arrays import let
from driftline.functions.joins import salted_left_join
from driftline.functions.regex import WHITESPACE, jvm
from driftline.functions.terms import idf, term_counts, term_places, tokens
from driftline.operators.sensitive import sanitized_text

_STRINGS = "array<string>"


def repo_slug(url: Column) -> Column:
    """owner/name of a hosted remote, NULL for other remotes."""
    return F.nullif(F.regexp_extract(url, jvm(fv.REMOTE_SLUG), 1), F.lit(""))


def with_tickets(diffs: DataFrame, tickets: DataFrame, key: str) -> DataFrame:
    """Diffs with their ticket's title and body, and whether one was found.

    ``diffs`` has ticket_id, remote_url, diff and optionally context, which
    stands in for the diff where it is not empty. ``tickets`` has ticket_id,
    repo, title and body.
    """
    rows = diffs.withColumn("repo", repo_slug(F.col("remote_url")))
    if "context" in diffs.columns:
        rows = rows.withColumn("diff", F.coalesce(F.nullif("context", F.lit("")), F.col("diff")))
    known = tickets.select(
        "repo",
        "ticket_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("body", F.lit("")).alias("body"),
        F.lit(True).alias("found"),
    )
    joined = salted_left_join(rows, known, ["repo", "ticket_id"], [key])
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def ticket_text() -> Column:
    return F.concat_ws(" ", "title", "body")


def lookup_outcome() -> dict[str, Column]:
    """Score, summary and messages where there is no ticket to compare with."""
    ident = F.col("ticket_id").cast("string")
    unnamed = F.coalesce(ident, F.lit("")) == ""
    empty = F.array().cast(_STRINGS)
    return {
        "alignment_score": F.when(unnamed, F.lit(0.0)).when(~F.col("found"), F.lit(0.5)),
        "is_aligned": F.when(unnamed, F.lit(False)).when(~F.col("found"), F.lit(True)),
        "ticket_summary": F.when(unnamed, F.lit(""))
        .when(~F.col("found"), F.format_string(fv.TICKET_MISSING, ident))
        .otherwise(F.col("title")),
        "missing_criteria": F.when(unnamed, F.array(F.lit(fv.NO_TICKET))).otherwise(empty),
        "scope_creep_warnings": F.when(
            ~unnamed & ~F.col("found"), F.array(F.lit(fv.TICKET_MISSING_WARNING))
        ).otherwise(empty),
    }


def _cosine(terms: Column) -> Column:
    """Cosine of (a, b) weight pairs; 0 when one side has no weight."""
    zero = F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))
    return F.aggregate(
        terms,
        zero,
        lambda s, t: F.struct(
            (s["ab"] + t["a"] * t["b"]).alias("ab"),
            (s["aa"] + t["a"] * t["a"]).alias("aa"),
            (s["bb"] + t["b"] * t["b"]).alias("bb"),
        ),
        lambda s: F.when(
            (s["aa"] > 0) & (s["bb"] > 0), s["ab"] / F.sqrt(s["aa"]) / F.sqrt(s["bb"])
        ).otherwise(F.lit(0.0)),
    )


def _weights(in_first: Column, in_second: Column) -> Column:
    """Weights of a term with the given counts in the two texts."""
    texts = (in_first > 0).cast("int") + (in_second > 0).cast("int")
    return let(
        idf(F.lit(2), texts),
        lambda scale: F.struct(
            (in_first * scale).alias("a"), (in_second * scale).alias("b")
        ),
    )


def alignment(first: Column, second: Column, size: int | None = None) -> Column:
    """Cosine similarity of two texts under a vocabulary fitted on just these two.

    All terms count, or the ``size`` leading ones.
    """

    def all_terms(a: Column, b: Column) -> Column:
        def of_counts(ca: Column, cb: Column) -> Column:
            count = lambda counts, term: F.coalesce(
                F.try_element_at(counts, term), F.lit(0)
            )
            terms = F.array_union(F.map_keys(ca), F.map_keys(cb))
            return F.transform(terms, lambda t: _weights(count(ca, t), count(cb, t)))

        as_map = lambda words: F.map_from_entries(term_counts(words))
        return let(as_map(a), lambda ca: let(as_map(b), lambda cb: of_counts(ca, cb)))

    def leading_terms(a: Column, b: Column) -> Column:
        # technical terms first, then by count, then by first place in both texts
        def ranked(g: Column) -> Column:
            in_first = F.size(F.filter(g["places"], lambda p: p < F.size(a)))
            return F.struct(
                (~g["term"].isin(fv.TECH_TERMS)).alias("plain"),
                (-F.size(g["places"])).alias("minus_count"),
                g["places"][0].alias("place"),
                _weights(in_first, F.size(g["places"]) - in_first).alias("w"),
            )

        groups = F.sort_array(F.transform(term_places(F.concat(a, b)), ranked))
        return F.transform(F.slice(groups, 1, size), lambda g: g["w"])

    def of_words(a: Column, b: Column) -> Column:
        return _cosine(all_terms(a, b) if size is None else leading_terms(a, b))

    return let(tokens(first), lambda a: let(tokens(second), lambda b: of_words(a, b)))


def scope_creep(ticket: Column, diff: Column) -> Column:
    """Warnings for work words that the diff has and the ticket lacks."""
    lowered = F.lower(ticket), F.lower(diff)
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.contains(lowered[1], F.lit(word)) & ~F.contains(lowered[0], F.lit(word)),
                    F.lit(warning),
                )
                for word, warning in fv.SCOPE_WORDS
            ]
        )
    )


def verdicts(pairs: DataFrame) -> DataFrame:
    """Score, warnings and verdict for every row of :func:`with_tickets`."""
    outcome = lookup_outcome()
    score = F.when(F.col("found"), alignment(ticket_text(), F.col("diff")))
    creep = F.when(F.col("found"), scope_creep(ticket_text(), F.col("diff")))
    rows = pairs.withColumns({"__score": score, "__creep": creep})
    found = F.col("found")
    by_text = (F.col("__score") >= fv.ALIGNED_AT) | (F.size("__creep") == 0)
    return rows.withColumns(
        {
            **outcome,
            "alignment_score": F.when(found, F.col("__score")).otherwise(outcome["alignment_score"]),
            "is_aligned": F.when(found, by_text).otherwise(outcome["is_aligned"]),
            "scope_creep_warnings": F.when(found, F.col("__creep")).otherwise(
                outcome["scope_creep_warnings"]
            ),
            "reasoning": F.lit(""),
        }
    ).drop("__score", "__creep")


def judge_prompts(pairs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Prompts for the pairs with a ticket: the redacted diff, whole or cut after ``max_chars``."""
    cut = sanitized_text(F.col("diff"))["sanitized_text"]
    if max_chars is not None:
        marked = lambda t: F.concat(F.left(t, F.lit(max_chars)), F.lit(fv.PROMPT_CUT))
        cut = let(cut, lambda t: F.when(F.length(t) > max_chars, marked(t)).otherwise(t))
    prompt = F.format_string(
        fv.PROMPT_TEMPLATE, F.col("title"), F.col("body"), F.lit(fv.PROMPT_DIFF_STAT), cut
    )
    return pairs.filter("found").withColumn("prompt", prompt)


def _truthy(value: Column, default: bool) -> Column:
    """A reply field (a variant) as Python would read it as a condition; a missing one is the default.

    A text is true unless it is empty, whatever it says.
    """
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    empty = text.isin("", "[]", "{}")
    return (
        F.when(value.isNull(), F.lit(default))
        .when(F.is_variant_null(value), F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind.rlike("^(STRING|ARRAY|OBJECT)"), ~empty)
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )


def judge_verdicts(replies: DataFrame, reply: str = "raw_reply") -> DataFrame:
    """Parse raw judge replies: fences are stripped, unreadable ones marked."""
    strip = lambda c: F.regexp_replace(c, f"^{WHITESPACE}+|{WHITESPACE}+\\z", "")
    cleaned = strip(F.col(reply))
    for fence in ("^```json", "^```", "```\\z"):
        cleaned = F.regexp_replace(cleaned, fence, "")
    rows = replies.withColumn("__json", strip(cleaned))
    text = F.col("__json")
    fields = F.from_json(
        text,
        "aligned variant, scope_creep variant, reason variant, _broken string",
        {"columnNameOfCorruptRecord": "_broken"},
    )
    rows = rows.withColumn("__fields", fields)
    found = F.col("__fields")
    parsed = F.startswith(text, F.lit("{")) & found.isNotNull() & found["_broken"].isNull()
    rows = rows.withColumn("parsed", F.coalesce(parsed, F.lit(False)))
    only = lambda c: F.when(F.col("parsed"), c)
    aligned = _truthy(found["aligned"], True)
    creep = F.when(_truthy(found["scope_creep"], False), F.array(F.lit(fv.JUDGE_SCOPE_CREEP)))
    reason = F.when(
        found["reason"].isNotNull(), F.try_variant_get(found["reason"], "$", "string")
    ).otherwise(F.lit(fv.JUDGE_NO_REASON))
    return rows.withColumns(
        {
            "judge_aligned": only(aligned),
            "judge_score": only(F.when(aligned, fv.JUDGE_ALIGNED).otherwise(fv.JUDGE_NOT_ALIGNED)),
            "judge_warnings": only(F.coalesce(creep, F.array().cast(_STRINGS))),
            "judge_reason": only(reason),
        }
    ).drop("__json", "__fields")


def with_fallback(verdicts_: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """The judge's verdict where it can be read, else the one by text similarity.

    ``judged`` comes from :func:`judge_verdicts`, at most one row per ``key``. A
    judge is only asked about diffs whose ticket was found.
    """
    readable = judged.filter("parsed").select(
        key, "judge_aligned", "judge_score", "judge_warnings", "judge_reason"
    )
    rows = verdicts_.join(readable, key, "left")
    use = F.col("judge_aligned").isNotNull() & F.col("found")
    pick = lambda judge, local: F.when(use, F.col(judge)).otherwise(F.col(local))
    note = F.when(F.col("found"), fv.FALLBACK_REASON).otherwise("")
    return rows.withColumns(
        {
            "alignment_score": pick("judge_score", "alignment_score"),
            "is_aligned": pick("judge_aligned", "is_aligned"),
            "scope_creep_warnings": pick("judge_warnings", "scope_creep_warnings"),
            "reasoning": F.when(use, F.col("judge_reason")).otherwise(note),
        }
    ).drop("judge_aligned", "judge_score", "judge_warnings", "judge_reason")
