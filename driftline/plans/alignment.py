"""Queries over ticket and diff alignment, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import fixed_values as fv
from driftline.operators import intent
from driftline.plans.guardian import ORACLE as _  # noqa: F401  registers the redaction views
from driftline.plans.history_search import TECH, token_list
from driftline.plans.views import VIEWS, quote, with_views
from driftline.sources.derived import diffs, judge_replies, tickets

KEY = "doc_id"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return intent.with_tickets(diffs(spark, sf), tickets(spark, sf), KEY)


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(
        KEY,
        "ticket_id",
        F.round("alignment_score", 6).alias("alignment_score"),
        "is_aligned",
        "ticket_summary",
        F.array_join("missing_criteria", "|").alias("missing_criteria"),
        F.array_join("scope_creep_warnings", "|").alias("scope_creep_warnings"),
        "reasoning",
    )


def ticket_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf).withColumns(intent.lookup_outcome())
    return rows.select(
        KEY,
        "ticket_id",
        "repo",
        "found",
        "alignment_score",
        "is_aligned",
        "ticket_summary",
        F.array_join("missing_criteria", "|").alias("missing_criteria"),
        F.array_join("scope_creep_warnings", "|").alias("scope_creep_warnings"),
    )


def intent_alignment(spark: SparkSession, sf: str) -> DataFrame:
    score = intent.alignment(intent.ticket_text(), F.col("diff"))
    return _pairs(spark, sf).filter("found").select(KEY, F.round(score, 6).alias("alignment_score"))


def scope_creep(spark: SparkSession, sf: str) -> DataFrame:
    warnings = intent.scope_creep(intent.ticket_text(), F.col("diff"))
    rows = _pairs(spark, sf).filter("found").select(KEY, F.explode(warnings).alias("warning"))
    return rows


def intent_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(intent.verdicts(_pairs(spark, sf)))


def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return intent.judge_prompts(_pairs(spark, sf)).select(KEY, "prompt")


def judge_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = intent.judge_verdicts(judge_replies(spark, sf))
    return rows.select(
        KEY,
        "parsed",
        "judge_aligned",
        "judge_score",
        F.array_join("judge_warnings", "|").alias("judge_warnings"),
        "judge_reason",
    )


def verdict_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    judged = intent.judge_verdicts(judge_replies(spark, sf))
    return _flat(intent.with_fallback(intent.verdicts(_pairs(spark, sf)), judged, KEY))


QUERIES = {
    f.__name__: f
    for f in (
        ticket_join,
        intent_alignment,
        scope_creep,
        intent_verdict,
        judge_prompts,
        judge_verdicts,
        verdict_with_fallback,
    )
}

# --- SQL checks -----------------------------------------------------------------

VIEWS["pairs"] = (
    ["content"],
    """SELECT c.doc_id, CASE WHEN c.doc_id % 13 <> 0 THEN c.doc_id % 50 END AS ticket_id,
         CASE WHEN c.doc_id % 3 < 2 THEN 'acme/widgets' END AS repo,
         c.text || CASE WHEN c.doc_id % 5 = 0 THEN ' refactor module' ELSE '' END AS diff,
         b.item_id IS NOT NULL AS found, left(b.text, 40) AS title, b.text AS body,
         left(b.text, 40) || ' ' || b.text AS ticket
       FROM content c LEFT JOIN benchmark b ON b.item_id = c.doc_id % 50
         AND c.doc_id % 13 <> 0 AND c.doc_id % 3 < 2""",
)
VIEWS["pair_tokens"] = (
    ["pairs"],
    f"""SELECT doc_id, side, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (
          SELECT doc_id, 0 AS side, {token_list('ticket')} AS w FROM pairs WHERE found
          UNION ALL
          SELECT doc_id, 1, {token_list('diff')} FROM pairs WHERE found)""",
)
VIEWS["pair_terms"] = (
    ["pair_tokens"],
    """SELECT *, ln(3 / (df + 1)) + 1 AS idf FROM (
          SELECT doc_id, term, count(*) FILTER (WHERE side = 0) AS na,
            count(*) FILTER (WHERE side = 1) AS nb, count(DISTINCT side) AS df
          FROM pair_tokens GROUP BY doc_id, term)""",
)
VIEWS["pair_scores"] = (
    ["pair_terms"],
    """SELECT p.doc_id, coalesce(score, 0) AS score FROM pairs p LEFT JOIN (
         SELECT doc_id, CASE WHEN sum(na) > 0 AND sum(nb) > 0 THEN
           sum(na * nb * idf * idf) / sqrt(sum(na * na * idf * idf))
             / sqrt(sum(nb * nb * idf * idf)) END AS score
         FROM pair_terms GROUP BY doc_id) USING (doc_id) WHERE found""",
)
_CREEP = ", ".join(
    f"CASE WHEN contains(lower(diff), '{w}') AND NOT contains(lower(ticket), '{w}') THEN {quote(t)} END"
    for w, t in fv.SCOPE_WORDS
)
VIEWS["verdicts"] = (
    ["pair_scores"],
    f"""SELECT doc_id, ticket_id, found,
          CASE WHEN found THEN score WHEN ticket_id IS NULL THEN 0::DOUBLE ELSE 0.5::DOUBLE END
            AS score,
          CASE WHEN found THEN score >= 0.3 OR creep = '' ELSE ticket_id IS NOT NULL END AS aligned,
          CASE WHEN found THEN title WHEN ticket_id IS NULL THEN ''
            ELSE 'Issue #' || ticket_id || ' (Data not fetched)' END AS summary,
          CASE WHEN ticket_id IS NULL THEN {quote(fv.NO_TICKET)} ELSE '' END AS missing,
          CASE WHEN found THEN creep WHEN ticket_id IS NULL THEN ''
            ELSE {quote(fv.TICKET_MISSING_WARNING)} END AS warnings
        FROM (SELECT p.*, s.score, concat_ws('|', {_CREEP}) AS creep
              FROM pairs p LEFT JOIN pair_scores s USING (doc_id))""",
)
VIEWS["judged"] = (
    [],
    f"""SELECT doc_id, parsed, CASE WHEN parsed THEN aligned END AS judge_aligned,
          CASE WHEN parsed AND aligned THEN 1::DOUBLE WHEN parsed THEN 0.4::DOUBLE END AS judge_score,
          CASE WHEN parsed AND creep THEN {quote(fv.JUDGE_SCOPE_CREEP)} WHEN parsed THEN '' END AS judge_warnings,
          CASE WHEN parsed THEN coalesce(nullif(left(text, 60), ''), {quote(fv.JUDGE_NO_REASON)}) END AS judge_reason
        FROM (SELECT doc_id, text, doc_id % 6 <> 0 AS parsed, coalesce(quality = 1, TRUE) AS aligned,
                coalesce(toxic = 1, FALSE) AS creep
              FROM documents LEFT JOIN (
                SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id))""",
)
# the redaction views over the pairs' diffs instead of the documents
_DIFF_TEXTS = {
    "content": (
        [],
        f"""SELECT doc_id, '' AS source, diff AS text, title, body FROM (
              WITH content AS ({VIEWS["content"][1]}) {VIEWS["pairs"][1]}) WHERE found""",
    )
}
_PART = [quote(p) for p in fv.PROMPT_TEMPLATE.split("%s")]
_CUT = "safe"

ORACLE = {
    "ticket_join": with_views(
        ["verdicts", "pairs"],
        """SELECT doc_id, ticket_id, repo, found,
             CASE WHEN NOT found THEN score END AS alignment_score,
             CASE WHEN NOT found THEN aligned END AS is_aligned, summary AS ticket_summary,
             missing AS missing_criteria,
             CASE WHEN found THEN '' ELSE warnings END AS scope_creep_warnings
           FROM verdicts JOIN (SELECT doc_id, repo FROM pairs) USING (doc_id)""",
    ),
    "intent_alignment": with_views(
        ["pair_scores"], "SELECT doc_id, round(score, 6) AS alignment_score FROM pair_scores"
    ),
    "scope_creep": with_views(
        ["pairs"],
        f"""SELECT doc_id, warning FROM (
              SELECT doc_id, unnest([{_CREEP}]) AS warning FROM pairs WHERE found)
            WHERE warning IS NOT NULL""",
    ),
    "intent_verdict": with_views(
        ["verdicts"],
        """SELECT doc_id, ticket_id, round(score, 6) AS alignment_score, aligned AS is_aligned,
             summary AS ticket_summary, missing AS missing_criteria,
             warnings AS scope_creep_warnings, '' AS reasoning FROM verdicts""",
    ),
    "judge_prompts": with_views(
        ["rewrite", "content"],
        f"""SELECT doc_id, {_PART[0]} || title || {_PART[1]} || body || {_PART[2]}
              || {quote(fv.PROMPT_DIFF_STAT)} || {_PART[3]} || {_CUT} || {_PART[4]} AS prompt
            FROM content JOIN (SELECT doc_id, max_by(text, i) AS safe FROM rewrite GROUP BY doc_id)
              USING (doc_id)""",
        recursive=True,
        replaced=_DIFF_TEXTS,
    ),
    "judge_verdicts": with_views(["judged"], "SELECT * FROM judged"),
    "verdict_with_fallback": with_views(
        ["verdicts", "judged"],
        f"""SELECT doc_id, ticket_id,
              round(CASE WHEN j THEN judge_score ELSE score END, 6) AS alignment_score,
              CASE WHEN j THEN judge_aligned ELSE aligned END AS is_aligned,
              summary AS ticket_summary, missing AS missing_criteria,
              CASE WHEN j THEN judge_warnings ELSE warnings END AS scope_creep_warnings,
              CASE WHEN j THEN judge_reason WHEN found THEN {quote(fv.FALLBACK_REASON)} ELSE '' END
                AS reasoning
            FROM (SELECT v.*, g.* EXCLUDE (doc_id), found AND coalesce(parsed, FALSE) AS j
                  FROM verdicts v LEFT JOIN judged g USING (doc_id))""",
    ),
}
