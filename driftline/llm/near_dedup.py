"""Near-duplicates by ProbMinHash of weighted five-word shingles, banding and verification.

Each distinct shingle of a text is a Poisson process whose rate is how often the
text has it; its arrivals hit random registers, and a register keeps the shingle
that arrived first. A shingle stops once its next arrival is later than what
every register holds. Two texts agree in a register with their probability
Jaccard similarity, by which links are verified, too.

Texts that share four registers of a band are candidates. Within a bucket every
text is compared with the one that shares the most buckets with others; whole
groups of copies are joined that way without all their pairs. Texts in buckets
that still hold several components are candidates of each other, and these are
narrowed down exactly: texts as similar as that share one of the rarest
shingles that make up more than what they may differ by, and not too much of
either comes before the first one. The texts of such a
shingle stand in a list; each is compared with the first of the list, then with
the next two, the next four and so on, as long as the two are in different
components. So no candidate link between two components stays untested.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.joins import join_frequent
from driftline.llm.columns import arrow_type, map_texts, pick, slices, whole_rows, with_whole_row
from driftline.llm.components import components
from driftline.session import materialise

#: Words in a shingle and the similarity from which texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands of so many registers: 0.8 ** 4 = 0.41 a band, so 1 pair in 300,000 shares none.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: What sums of floating-point numbers may be off by.
ROUNDING = 1e-9

_WORD = re.compile(r"\w+")
_ODD = np.random.default_rng(5).integers(1, 2**62, SHINGLE).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(found: list[str]) -> dict[tuple[str, ...], int]:
    """How often a text has each run of five words; all words together where there are fewer."""
    if len(found) <= SHINGLE:
        return {tuple(found): 1} if found else {}
    return Counter(zip(*(found[i:] for i in range(SHINGLE)), strict=False))


def similarity(a: dict, b: dict) -> float:
    """Probability Jaccard: over the common shingles, 1 by the sum over all shingles of the larger of both ratios of weights.

    0 where nothing is common. With the ratio t = b_i / a_i of a common shingle
    the sum over j of max(a_j / a_i, b_j / b_i) is 1 / b_i times what b has of
    shingles with a higher ratio and t times what a has of the others, so one
    pass over the ratios from the highest down does for all shingles.
    """
    common = a.keys() & b.keys()
    if not common:
        return 0.0
    in_a, in_b = sum(a.values()), sum(b.values())
    if len(a) == in_a and len(b) == in_b:
        return len(common) / (len(a) + len(b) - len(common))
    by_ratio: dict[float, list[int]] = {}
    for s in common:
        both = by_ratio.setdefault(b[s] / a[s], [0, 0])
        both[0] += a[s]
        both[1] += b[s]
    above = in_b - sum(both[1] for both in by_ratio.values())
    rest, total = in_a, 0.0
    for ratio in sorted(by_ratio, reverse=True):
        own_a, own_b = by_ratio[ratio]
        total += own_b / (above + ratio * rest)
        above += own_b
        rest -= own_a
    return total


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def weighted_shingles(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, 64-bit hash and weight (how often it occurs) of each distinct shingle of each text that has words."""
    hashes, owners = [], []
    for i, found in enumerate(texts):
        if not found:
            continue
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
        n = max(1, len(h) - SHINGLE + 1)
        whole = np.zeros(n, dtype=np.uint64)
        for k in range(min(SHINGLE, len(h))):
            whole += _mix(h[k : k + n] * _ODD[k])
        hashes.append(whole)
        owners.append(np.full(n, i))
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    h, owner = _mix(np.concatenate(hashes)), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    return owner[first], h[first], np.diff(np.r_[first, len(h)]).astype(np.float64)


def prob_minhash(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first in each register of each text; 0 for texts without shingles.

    Round by round every shingle that is still of use makes its next arrival.
    """
    earliest = np.full(n_texts * registers, np.inf)
    holder = np.zeros(n_texts * registers, dtype=np.uint64)
    time = np.zeros(len(h))
    turn = 0
    while len(h):
        turn += 1
        draw = _mix(h + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / weight
        at = owner * registers + (_mix(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, at, time)
        first = time == earliest[at]
        holder[at[first]] = h[first]
        latest = earliest.reshape(n_texts, registers).max(axis=1)
        useful = time < latest[owner]
        owner, h, weight, time = owner[useful], h[useful], weight[useful], time[useful]
    return holder.reshape(n_texts, registers)


def _prints(docs: DataFrame) -> DataFrame:
    """For each row (``doc_id``, ``text``, ``row``): the digest of its words and its buckets."""

    def work():
        def prints(texts: list[str]) -> dict:
            nodes, buckets = [], []
            found = [words(t) for t in texts]
            held = prob_minhash(*weighted_shingles(found), len(found))
            bands = held.reshape(len(found), BANDS, ROWS)
            mixed = np.zeros(bands.shape[:2], dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for k in range(ROWS):
                mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
            for i, w in enumerate(found):
                nodes.append(xxhash.xxh3_128_digest(" ".join(w)) if w else None)
                buckets.append(mixed[i].view(np.int64).tolist() if w else [])
            return {"node": nodes, "buckets": buckets}

        return prints

    kind = docs.schema["doc_id"].dataType
    return map_texts(
        docs,
        work,
        f"doc_id {kind.simpleString()}, row bigint, node binary, buckets array<bigint>",
        pa.schema([("doc_id", arrow_type(kind)), ("row", pa.int64()), ("node", pa.binary()), ("buckets", pa.list_(pa.int64()))]),
    )


def _shares(texts: DataFrame) -> DataFrame:
    """For each text of ``texts`` (``node``, ``text``) its distinct shingles and the share of its weight that each has."""

    def run(batches):
        for batch in slices(batches):
            names, found = batch.column(0), [words(t) for t in batch.column(1).to_pylist()]
            owner, h, weight = weighted_shingles(found)
            whole = np.bincount(owner, weight, len(found))
            yield pa.record_batch(
                {"node": names.take(pa.array(owner)), "shingle": pa.array(h.view(np.int64)), "share": pa.array(weight / whole[owner])}
            )

    return texts.mapInArrow(run, "node binary, shingle bigint, share double")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs of nodes (``a``, ``b``) whose texts have a similarity of ``least`` or more."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def check(batches):
        known = lru_cache(maxsize=64)(lambda t: shingles(words(t)))
        for batch in slices(batches):
            left, right = (c.to_pylist() for c in batch.columns[2:])
            alike = [similarity(known(x), known(y)) >= least - ROUNDING for x, y in zip(left, right, strict=True)]
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(alike, pa.bool_()))

    return both.mapInArrow(check, "a binary, b binary")


def row_of(key: Column, text: Column) -> Column:
    """What tells a row from others; equal rows share it."""
    return F.xxhash64(key, text)


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``class_id``, ``class_size``, ``links``, ``kept`` and ``row``, for every row of ``docs``.

    Texts are linked if the probability Jaccard similarity of their five-word
    shingles (words in lower case), each weighing as often as it occurs, is
    ``least`` or more: for texts without repeated shingles that is the Jaccard
    similarity. A class is what links connect,
    and texts with the same words are always in one class. ``class_id`` is the
    smallest key in the class, ``links`` the number of verified links of the
    document's text to different texts (of a group of copies not all pairs are
    tested), and ``kept`` marks one row of each class: the one with ``class_id``.
    Null keys come after all others. A text of one to four words is one shingle.
    A null, empty or wordless text is a class by itself. ``row`` is ``row_of``.
    """
    rows = pick(docs, key, text).toDF("doc_id", "text").select("doc_id", "text", row_of(F.col("doc_id"), F.col("text")).alias("row"))
    prints = materialise(_prints(rows), "prints")
    worded = prints.filter(F.col("node").isNotNull())
    nodes = worded.groupBy("node").agg(
        F.min("row").alias("row"),
        F.min("doc_id").alias("first_id"),
        F.count(F.lit(1)).alias("copies"),
        F.first("buckets").alias("buckets"),
    )
    nodes = materialise(nodes, "nodes")
    links, roots = _links(rows, nodes, least)
    ends = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node")))
    degrees = ends.groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    grouped = nodes.select("node", "first_id", "copies").join(roots, "node", "left").join(degrees, "node", "left")
    grouped = grouped.select("node", "first_id", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    grouped = materialise(grouped, "grouped")
    classes = grouped.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = materialise(grouped.select("node", "root", "links", "copies").join(materialise(classes, "classes"), "root"), "named")
    found = join_frequent(worded.select("doc_id", "row", "node"), named, "node", "copies")
    once = F.row_number().over(Window.partitionBy("root", "doc_id").orderBy("row"))
    found = found.select(
        "doc_id", "class_id", "class_size", "links", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (once == 1)).alias("kept"), "row"
    )
    alone = prints.filter(F.col("node").isNull()).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(0).cast("bigint").alias("links"), F.lit(True).alias("kept"), "row"
    )
    return found.unionByName(alone)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``near_dedup`` keeps; rows that repeat key and text count once.

    Columns may have any names, also such that differ from the key's or the text's only in case.
    """
    kept = near_dedup(docs, key, text, least).filter("kept").select("doc_id", "row")
    kept = materialise(kept, "kept").alias("kept")
    marked = with_whole_row(docs, key, text).toDF("doc", "key", "text")
    marked = marked.select("doc", "key", row_of(F.col("key"), F.col("text")).alias("row")).alias("marked")
    same = (F.col("marked.row") == F.col("kept.row")) & F.col("marked.key").eqNullSafe(F.col("kept.doc_id"))
    return whole_rows(marked.join(kept, same, "left_semi").dropDuplicates(["key", "row"]), docs)


def _links(rows: DataFrame, nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """All verified links, and the root of every node that has one."""
    members = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("n"))
    shared = materialise(shared.filter(F.col("least") != F.col("most")).select("bucket", "n"), "buckets")
    members = materialise(members.join(shared, "bucket"), "members")
    # who shares the most buckets with others is the likeliest origin of a group
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    weights = materialise(weights, "weights")
    texts = rows.join(nodes.select("row", "node").join(weights.select("node"), "node", "left_semi"), "row")
    texts = materialise(texts.groupBy("node").agg(F.first("text").alias("text")), "texts")
    ranked = materialise(members.select("node", "bucket").join(weights, "node"), "ranked")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("top"))
    centres = materialise(centres.select("bucket", F.col("top.node").alias("b")), "centres")
    stars = ranked.select("bucket", F.col("node").alias("a")).join(centres, "bucket").filter(F.col("a") != F.col("b"))
    stars = materialise(stars.select("a", "b").distinct(), "stars")
    links = materialise(_verified(stars, texts, least), "links")
    roots = components(links)

    placed = members.select("node", "bucket").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") != F.col("high"))
    open_ = materialise(placed.join(several, "bucket", "left_semi").select("node").distinct(), "open")
    more = _open_links(texts.join(open_, "node", "left_semi"), roots, least)
    if more is None:
        return links, roots
    links = links.unionByName(more)
    return links, components(links)


def _rare_shingles(texts: DataFrame, least: float) -> DataFrame:
    """For each text its rarest shingles, up to more than the share by which similar texts may differ, and the share ``before`` each.

    A probability Jaccard similarity is never above the share of weight that two
    texts have in common, so of two similar texts the first common shingle, in
    the order of rarity, is among these on both sides.
    """
    shares = materialise(_shares(texts), "shares")
    counts = materialise(shares.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingles")
    known = join_frequent(shares, counts, "shingle", "n")
    before = F.sum("share").over(Window.partitionBy("node").orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1))
    rare = known.withColumn("before", F.coalesce(before, F.lit(0.0))).filter(F.col("before") <= 1 - least + ROUNDING)
    place = F.row_number().over(Window.partitionBy("shingle").orderBy("node")) - 1
    return materialise(rare.filter("n > 1").select("shingle", "node", "before").withColumn("place", place), "rare")


def _apart(least: float) -> Column:
    """Whether the shares before a shingle rule out that it is the first common one of similar texts (``x``, ``y``).

    Of texts with shares u and v that the other one lacks the similarity is at
    most 1 / (1 / (1 - u) + 1 / (1 - v) - 1): the terms of its sum are a concave
    function, homogeneous of degree 1, of the weights of the common shingles, so
    it is largest where these are in proportion.
    """
    return 1 / (1 - F.col("x.before")) + 1 / (1 - F.col("y.before")) > 1 + 1 / least + ROUNDING


def _merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """The roots after some links: the larger root of a link gives way to the smallest it is linked with.

    One step only, which spares comparisons within a group; what is connected is found out in the end.
    """
    of = lambda end: F.coalesce(F.col(f"{end}_root"), F.col(end))
    ends = found.join(roots.toDF("a", "a_root"), "a", "left").join(roots.toDF("b", "b_root"), "b", "left")
    ends = ends.select(F.greatest(of("a"), of("b")).alias("root"), F.least(of("a"), of("b")).alias("now"))
    moved = materialise(ends.filter(F.col("root") != F.col("now")).groupBy("root").agg(F.min("now").alias("now")), "moved")
    known = roots.join(moved, "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    new = moved.toDF("node", "root").join(roots, "node", "left_anti")
    return materialise(known.unionByName(new), "roots")


def _open_links(texts: DataFrame, roots: DataFrame, least: float) -> DataFrame | None:
    """Verified links between texts of different components, or None."""
    index = _rare_shingles(texts, least)
    longest = index.agg(F.max("place")).first()[0] or 0
    links, tested, begin = None, None, 0
    while begin < longest:
        end = 2 * begin + 1
        rooted = index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        late = rooted.filter(F.col("place") > begin).alias("x")
        early = rooted.filter((F.col("place") >= begin) & (F.col("place") < end)).alias("y")
        meet = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("y.place") < F.col("x.place")) & (F.col("x.root") != F.col("y.root"))
        meet = meet & ~_apart(least)
        pairs = late.join(early, meet).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "open-pairs")
        begin = end
        if pairs.isEmpty():
            continue
        found = materialise(_verified(pairs, texts, least), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            roots = _merged(roots, found)
    return links
