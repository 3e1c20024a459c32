"""Document fingerprints: hashes of the terms of middling rarity, over many random subsets of the lexicon.

A term counts if its inverse document frequency lies in a band. The distinct
terms of a text that do are sorted and hashed, not all together but as far as
they lie in a random subset of the lexicon, for many subsets of six sizes. An
edit changes only the hashes of subsets that hold a changed term, so the share
of equal hashes tells how near two texts are: among the sparsest subsets of
which enough hold a term at all. A text may have no term in the band, so a
fingerprint has a second part over all terms; two fingerprints of which either
has an empty first part are compared by the second.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.columns import arrow_type, map_texts, pick, slices
from driftline.session import materialise

#: The band: terms in at least the one and at most the other share of all documents, ln(1/share) being their IDF.
#: So the lexicon has at most 20,000 times as many terms as a text has distinct ones on average.
RAREST, COMMONEST = 5e-5, 0.05
#: Subsets of each size, and the sizes: a subset of size s holds 1 in 2 ** s terms. The second part of a
#: fingerprint, over all terms, has fewer subsets.
SUBSETS, SIZES = 32, (1, 3, 5, 7, 9, 11)
WHOLE_SUBSETS = 16
BAND_BYTES = len(SIZES) * SUBSETS
#: Subsets of one size that must hold a term of one of two texts for their share to count.
ENOUGH = 8
#: Terms gathered in a task before their counts are sent on.
GATHERED = 2_000_000

_TERM = re.compile(r"\w+")
_SEEDS = np.random.default_rng(20).integers(1, 2**63, SUBSETS).astype(np.uint64)


def terms(text: str) -> np.ndarray:
    """64-bit hashes of the distinct terms (runs of letters, digits and underscores, in lower case)."""
    found = set(_TERM.findall(text.lower()))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term`` (its hash) and ``df``, over all documents. Counted in each task first."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def sums() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
            return pa.record_batch({"term": pa.array(found.astype(np.uint64).view(np.int64)), "df": pa.array(n.astype(np.int64))})

        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                if t:
                    held.append(terms(t))
                    size += len(held[-1])
                if size >= GATHERED:
                    yield sums()
                    held, size = [], 0
        yield sums()

    return pick(docs, text).mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    n = docs.count()
    upper = max(1, int(commonest * n))
    counted = document_frequencies(docs, text).filter(F.col("df").between(rarest * n, max(upper, 1)))
    counted = materialise(counted.select("term"), "lexicon")
    return np.sort(np.ascontiguousarray(counted.toArrow().column(0).to_numpy()).view(np.uint64))


def _subset_hashes(h: np.ndarray, owner: np.ndarray, n: int, subsets: int) -> np.ndarray:
    """A byte for each of n texts and subset, 0 where it holds no term; ``h`` are terms, sorted within their ``owner``."""
    out = np.zeros((n, len(SIZES) * subsets), dtype=np.uint8)
    value = _mix(h + np.uint64(0x9E3779B97F4A7C15))
    for j, seed in enumerate(_SEEDS[:subsets]):
        draw = _mix(h ^ seed)
        at = np.arange(len(h))
        for level, size in enumerate(SIZES):
            at = at[(draw[at] & np.uint64(2**size - 1)) == 0]
            if not len(at):
                break
            who = owner[at]
            begins = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            rank = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
            weights = (rank.astype(np.uint64) << np.uint64(1)) | np.uint64(1)
            hashed = _mix(np.add.reduceat(value[at] * weights, begins))
            out[who[begins], level * subsets + j] = (hashed >> np.uint64(32)) % np.uint64(255) + np.uint64(1)
    return out


class Fingerprints:
    """Fingerprints by one lexicon: bytes over the terms in the band, then bytes over all terms."""

    def __init__(self, words: np.ndarray):
        self.words = words
        low = np.uint64(2**22 - 1)
        self.low = low
        self.maybe = np.zeros(2**22, dtype=bool)
        self.maybe[(words & low).astype(np.int64)] = True

    def _known(self, h: np.ndarray) -> np.ndarray:
        known = self.maybe[(h & self.low).astype(np.int64)]
        at = np.flatnonzero(known)
        if len(at):
            place = np.searchsorted(self.words, h[at])
            known[at] = self.words[np.minimum(place, len(self.words) - 1)] == h[at]
        return known

    def of(self, texts: list[str]) -> np.ndarray:
        """A row of bytes for each text; it depends on the text and the lexicon alone."""
        each = [np.sort(terms(t)) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(e) for e in each])
        h = np.concatenate(each) if each else np.zeros(0, np.uint64)
        known = self._known(h)
        band = _subset_hashes(h[known], owner[known], len(texts), SUBSETS)
        return np.hstack([band, _subset_hashes(h, owner, len(texts), WHOLE_SUBSETS)])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 0 to 1 for each pair of fingerprints, by their first parts where both have one, else by their second."""
    first, second = (_share(a[:, part], b[:, part]) for part in (slice(0, BAND_BYTES), slice(BAND_BYTES, None)))
    return np.where(a[:, :BAND_BYTES].any(axis=1) & b[:, :BAND_BYTES].any(axis=1), first, second)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal hashes among the sparsest subsets of which ENOUGH hold a term of either; 1 for nothing at all."""
    shape = (len(a), len(SIZES), a.shape[1] // len(SIZES))
    a, b = a.reshape(shape), b.reshape(shape)
    telling = ((a != 0) | (b != 0)).sum(axis=2)
    equal = ((a == b) & (a != 0)).sum(axis=2)
    enough = telling >= ENOUGH
    level = np.where(enough.any(axis=1), len(SIZES) - 1 - enough[:, ::-1].argmax(axis=1), telling.argmax(axis=1))
    rows = np.arange(len(a))
    n = telling[rows, level]
    return np.where(n == 0, 1.0, equal[rows, level] / np.maximum(n, 1))


def as_hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def fingerprint(docs: DataFrame, words: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` (hex, two digits for each subset), for every row of ``docs``.

    Null and empty texts and those without a term have a fingerprint of zeros.
    Equal texts have equal fingerprints. Repeated rows and null keys are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def work():
        prints = Fingerprints(shared.value)
        return lambda texts: {"fingerprint": as_hex(prints.of(texts))}

    chosen = pick(docs, key, text)
    kind = chosen.schema[key].dataType
    schema = pa.schema([(key, arrow_type(kind)), ("fingerprint", pa.string())])
    return map_texts(chosen, work, f"`{key}` {kind.simpleString()}, fingerprint string", schema, text)


def edited(text: str, other: str) -> str:
    """The last quarter of the text gives way to as many first characters of the other one."""
    n = len(text) // 4
    return text[: len(text) - n] + other[:n]


def _places(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key, by halving."""
    known, steps = F.array(*[F.lit(b) for b in bounds]), []
    step = 1 << max(0, len(bounds).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1

    def halve(low: Column, s: Column) -> Column:
        at = low + s
        return F.when((at <= len(bounds)) & (F.get(known, F.least(at, F.lit(len(bounds))) - 1) <= key), at).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve) if bounds else F.lit(0)


def compare_with_next(docs: DataFrame, words: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text ends with the beginning of the next document by ``key``
    (ascending, null keys last, rows of one key by their texts; after the last
    comes the first). Documents are dealt out by ranges of their keys, and the
    first row of each range goes to the range before as well, so each task sees
    every neighbour it needs. Gives ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    Likeness is a function of two fingerprints.
    """
    spark = docs.sparkSession
    rows = pick(docs, key, text).toDF("doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = 4 * max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * ranges))).first()[0]
    bounds = sorted(set(found or []))
    last = len(bounds) + 1  # the range of null keys
    placed = rows.withColumn("place", F.when(F.col("doc_id").isNull(), last).otherwise(_places(F.col("doc_id"), bounds)))
    firsts = {r["place"]: r["first"] for r in placed.groupBy("place").agg(F.min("doc_id").alias("first")).collect()}
    used = sorted(firsts)
    before = {p: used[i - 1] for i, p in enumerate(used)}  # before the first range comes the last one
    first = F.array(*[F.lit(firsts.get(p)).cast("bigint") for p in range(last + 1)])
    to = F.array(*[F.lit(before.get(p, 0)) for p in range(last + 1)])
    here = F.struct(F.col("place"), F.lit(0).alias("extra"))
    there = F.struct(F.get(to, F.col("place")).alias("place"), F.lit(1).alias("extra"))
    heads = F.col("doc_id").eqNullSafe(F.get(first, F.col("place")))
    copies = placed.select("doc_id", "text", F.explode(F.when(heads, F.array(here, there)).otherwise(F.array(here))).alias("at"))
    dealt = copies.select("doc_id", "text", "at.place", "at.extra").repartition("place")
    dealt = dealt.sortWithinPartitions("place", "extra", "doc_id", "text")
    shared = spark.sparkContext.broadcast(words)
    kind = rows.schema["doc_id"].dataType
    schema = pa.schema(
        [("doc_id", arrow_type(kind)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
        + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def pairs(batches):
        from hashlib import sha256

        prints = Fingerprints(shared.value)
        waiting = None  # the last document so far, with its fingerprint, until the next one is known
        for batch in slices(batches, 500):
            some = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            left, right, texts = [], [], []
            for row, mark in zip(some, prints.of([r[1] for r in some]), strict=True):
                if waiting is not None and waiting[0][2] == row[2]:
                    left.append(waiting)
                    right.append((row, mark))
                    texts.append(edited(waiting[0][1], row[1]))
                waiting = None if row[3] else (row, mark)  # an extra row is only somebody's neighbour
            if not left:
                continue
            own, nexts = (np.array([m for _, m in side]) for side in (left, right))
            changed = prints.of(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r, _ in left], schema.field("doc_id").type),
                    pa.array([len(r[1]) for r, _ in left], pa.int64()),
                    pa.array([sha256(t.encode()).hexdigest() for t in texts]),
                    pa.array(as_hex(own)),
                    pa.array(as_hex(changed)),
                    pa.array(likeness(own, changed)),
                    pa.array(likeness(own, nexts)),
                ],
                schema=schema,
            )

    return dealt.mapInArrow(
        pairs,
        f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
