"""URL filter: rules first, then the ratio of two character language models.

The rules decide the URLs they fit. All different URLs that they accept and
reject train two Markov models of variable order: each mixes
what follows the longest known context with what follows its shorter ones, the
weight by how many different characters followed (Witten-Bell). Any other URL
is accepted if the difference of its log-likelihoods, divided by its length, is
above the bound that divided held-out URLs best.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.joins import join_frequent
from driftline.llm.columns import pick
from driftline.session import materialise

#: The verdicts, each with a model.
CLASSES = ("allow", "block")
#: Characters of context at most, and the characters among which an unknown one is a guess.
ORDER, ALPHABET = 5, 256
#: One in so many of the different URLs is held out for the bound.
HELD_OUT = 4
#: Parts of a nat in which log-likelihoods are added, and ranges in which scores are counted.
UNIT, RANGES = 2**36, 64
#: Characters of a text that are cut at a time.
BLOCK = 256
_START = "\x02"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    begins = F.locate("://", url)
    return F.when(begins > 0, F.substr(url, begins + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of name and verdict; null if none does."""
    found = []
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found.append(F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))))
    return F.coalesce(F.lit(None).cast("struct<name:string,verdict:string>"), *found)


class Model:
    """What ``chances`` computes, by its definition: log P(character | up to ORDER characters before it), from counts of strings of 1 to ORDER + 1 characters."""

    def __init__(self, counts: dict[str, int]):
        total: dict[str, int] = defaultdict(int)
        kinds: dict[str, int] = defaultdict(int)
        for gram, n in counts.items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        self.fallback = {c: log(kinds[c] / (total[c] + kinds[c])) for c in total}
        seen: dict[str, float] = {}
        for gram in sorted(counts, key=len):
            context = gram[:-1]
            shorter = seen[gram[1:]] if context else 1 / ALPHABET
            seen[gram] = (counts[gram] + kinds[context] * shorter) / (total[context] + kinds[context])
        self.seen = {gram: log(p) for gram, p in seen.items()}

    def score(self, text: str) -> float:
        padded, sum_ = _START * ORDER + text, 0.0
        for i in range(ORDER, len(padded)):
            gram = padded[i - ORDER : i + 1]
            while gram not in self.seen:
                if len(gram) == 1:
                    sum_ += self.fallback.get("", 0.0) - log(ALPHABET)
                    break
                sum_ += self.fallback.get(gram[:-1], 0.0)
                gram = gram[1:]
            else:
                sum_ += self.seen[gram]
        return sum_


def best_bound(accepted: list[float], rejected: list[float]) -> float:
    """The middle between two neighbouring scores that parts the classes with the highest mean of both rates."""
    if not accepted or not rejected:
        return 0.0
    scores = np.unique(np.concatenate([accepted, rejected]))
    edges = np.concatenate([[scores[0] - 1], (scores[1:] + scores[:-1]) / 2, [scores[-1] + 1]])
    passed = 1 - np.searchsorted(np.sort(accepted), edges) / len(accepted)
    stopped = np.searchsorted(np.sort(rejected), edges) / len(rejected)
    quality = passed + stopped
    best = np.flatnonzero(quality == quality.max())
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def _places(texts: DataFrame, kept: str) -> DataFrame:
    """A row for each character of ``url_text``: it is at ``at`` in ``t``, after ORDER characters of context at least.

    Long texts are cut into blocks first, as looking up a place takes time in proportion to what precedes it.
    """
    padded = F.concat(F.lit(_START * ORDER), F.col("url_text"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("url_text"), F.lit(1)), F.lit(BLOCK))
    blocks = texts.select(kept, F.explode(F.transform(starts, lambda s: F.substr(padded, s, F.lit(BLOCK + ORDER)))).alias("t"))
    ends = F.filter(F.sequence(F.lit(ORDER + 1), F.greatest(F.length("t"), F.lit(ORDER + 1))), lambda at: at <= F.length("t"))
    return blocks.select(kept, "t", F.explode(ends).alias("at"))


def counts(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``verdict`` and ``url_text``: how often each string of 1 to ORDER + 1 characters ends at a character, and how
    many and how many different characters follow each context; an ``allow_`` and a ``block_`` column each."""
    ends = _places(train, "verdict")
    pieces = F.array(*[F.substr("t", F.col("at") - F.lit(k), F.lit(k + 1)) for k in range(ORDER + 1)])
    of = lambda verdict: F.count_if(F.col("verdict") == verdict)
    grams = ends.select("verdict", F.explode(pieces).alias("gram")).groupBy("gram")
    grams = materialise(grams.agg(of("allow").alias("allow_n"), of("block").alias("block_n")), "url-grams")
    context = F.left("gram", F.length("gram") - 1).alias("context")
    sums = [f(v) for v in CLASSES for f in (lambda v: F.sum(f"{v}_n").alias(f"{v}_total"), lambda v: F.count_if(F.col(f"{v}_n") > 0).alias(f"{v}_kinds"))]
    return grams, materialise(grams.groupBy(context).agg(*sums), "url-contexts")


def chances(asked: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """For each ``gram`` of ORDER + 1 characters and its ``rows``: ``gain``, by how much more likely one model finds its last character.

    The chances of shorter strings come first and are looked up by the longer ones that end with them, so no
    string meets more rows than there are different characters.
    """
    known = None
    for k in range(1, ORDER + 2):
        level = asked.select(F.right("gram", F.lit(k)).alias("gram")).distinct()
        level = level.withColumns({"context": F.left("gram", F.lit(k - 1)), "shorter": F.right("gram", F.lit(k - 1))})
        level = level.join(grams, "gram", "left").join(contexts, "context", "left")
        if known is None:
            level = level.withColumns({f"{v}_before": F.lit(1 / ALPHABET) for v in CLASSES})
        else:
            level = level.join(known.select(F.col("gram").alias("shorter"), *[F.col(v).alias(f"{v}_before") for v in CLASSES]), "shorter")
        mixed = lambda v: (
            F.when(
                F.col(f"{v}_kinds") > 0,
                (F.coalesce(f"{v}_n", F.lit(0)) + F.col(f"{v}_kinds") * F.col(f"{v}_before")) / (F.col(f"{v}_total") + F.col(f"{v}_kinds")),
            ).otherwise(F.col(f"{v}_before"))
        )
        known = materialise(level.select("gram", *[mixed(v).alias(v) for v in CLASSES]), "url-chances")
    return asked.join(known, "gram").select("gram", "rows", (F.log("allow") - F.log("block")).alias("gain"))


def scored(texts: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """Adds ``score`` to a table of different ``url_text``: the difference of the log-likelihoods for each character; 0 for nothing."""
    places = _places(texts, "url_text").select("url_text", F.substr("t", F.col("at") - F.lit(ORDER), F.lit(ORDER + 1)).alias("gram"))
    asked = materialise(places.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")), "url-asked")
    met = join_frequent(places, materialise(chances(asked, grams, contexts), "url-gains"), "gram", "rows")
    # whole numbers, whose sum does not depend on the order
    whole = F.sum(F.round(F.col("gain") * UNIT).cast("bigint")) / UNIT
    sums = met.groupBy("url_text").agg((whole / F.length("url_text")).alias("score"))
    return texts.join(sums, "url_text", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def bound_of(held: DataFrame) -> float:
    """``best_bound`` of a table of ``verdict`` and ``score``: counts below each score, in ranges of scores."""
    of = lambda verdict: F.count_if(F.col("verdict") == verdict)
    steps = materialise(held.groupBy("score").agg(of("allow").alias("accepted"), of("block").alias("rejected")), "url-steps")
    totals = steps.agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).first()
    if not totals["a"] or not totals["r"]:
        return 0.0
    cuts = steps.agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0]
    part = F.size(F.filter(F.lit(sorted(set(cuts))), lambda cut: cut <= F.col("score")))
    parted = steps.withColumn("part", part)
    # one row for each range reaches the window over all
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = parted.groupBy("part").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"), F.max("score").alias("last"))
    ranges = ranges.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "ar"], F.max("last").over(before).alias("last"))
    inside = Window.partitionBy("part").orderBy("score")
    below = lambda c, start: F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col(start)
    edges = parted.join(ranges, "part").select(
        below("accepted", "a_before").alias("a"),
        below("rejected", "r_before").alias("r"),
        ((F.col("score") + F.coalesce(F.lag("score").over(inside), "last")) / 2).alias("edge"),
        "score",
    )
    # below the first score, between each and the one before it, and above the last
    edges = edges.select("a", "r", F.coalesce("edge", F.col("score") - 1).alias("edge"))
    above = steps.agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"), (F.max("score") + 1).alias("edge"))
    quality = 1 - F.col("a") / totals["a"] + F.col("r") / totals["r"]
    return edges.unionByName(above).orderBy(F.desc(quality), F.abs("edge"), "edge").first()["edge"]


def fit(texts: DataFrame) -> tuple[DataFrame, float]:
    """Every different ``url_text`` with its ``score``, and the bound; ``verdict`` is that of the rules, null without one.

    Every different URL that the rules decide counts once: one in HELD_OUT, by
    its hash, for the bound and the others for the models.
    """
    judged = F.col("verdict").isNotNull() & (F.col("url_text") != "")
    held = F.pmod(F.xxhash64("url_text"), F.lit(HELD_OUT)) == 0
    found = materialise(scored(texts, *counts(texts.filter(judged & ~held))), "url-scores")
    return found, bound_of(found.filter(judged & held))


def url_filter(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score``, for every row of ``pages``.

    A null URL or one without ``://`` has an empty host and path; it fits no
    rule, scores 0 and is allowed, as nothing speaks against it. Where the
    rules leave one class without a URL, that model is uniform and the bound 0.
    Repeated rows and null keys are kept. Only the URLs are read.
    """
    if len(rules) > 500:
        raise ValueError("rules become one expression; more than 500 need a table")
    chosen = pick(pages, key, url).toDF("page_id", "url")
    parts = chosen.select("page_id", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"))
    parts = parts.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules))
    parts = parts.select("page_id", "host", "path", F.col("fits.name").alias("rule"), F.col("fits.verdict").alias("verdict"))
    texts = parts.select("page_id", "host", "path", "rule", "verdict", F.concat("host", "path").alias("url_text"))
    # a path begins with a slash, so equal texts have equal hosts, paths and verdicts
    different = texts.groupBy("url_text").agg(F.count(F.lit(1)).alias("copies"), F.max("verdict").alias("verdict"))
    found, bound = fit(materialise(different, "url-texts"))
    judge = F.coalesce("verdict", F.when((F.col("url_text") == "") | (F.col("score") > bound), "allow").otherwise("block"))
    met = join_frequent(texts, found.drop("verdict"), "url_text", "copies")
    return met.select("page_id", "host", "path", "rule", judge.alias("verdict"), "score")
