"""Line deduplication by an exact set-similarity join on the words of lines.

1. Words are counted over all texts, in a table of fixed size by their hashes.
2. The distinct words of each line are sorted by rarity. Lines with the same
   words are one class, which stands for all of them from here on.
3. Similar lines share a word among the first few: that prefix is an index, and
   lines that share an entry are candidates if their lengths, the entry's
   places and the parities of their words allow enough common words.
4. First it is only asked which classes have a candidate at all. Their words are
   read again, as 64-bit hashes. The classes of an entry stand in the order of
   their first lines; every class is compared with the first one of each of its
   entries, what is still open with the next two, then the next four and so on,
   and every pair is verified by its words. So a group of similar lines is
   settled by its first lines, without all its pairs.
5. A line goes if an earlier line has the same words or enough of them.

Everything is a DataFrame operation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.columns import BLANK, join_checked, pick
from driftline.llm.ranks import row_numbers
from driftline.llm.tables import byte_at, byte_table
from driftline.session import materialise

#: Entries of the word-count table. It stands in the plan of one stage, so it is kept small; frequent words show in it
#: at any size of the corpus, and among the rare ones the order decides nothing but speed.
COUNTS = 2**18

#: Words from which on a line has a second number of 64 parities.
LONG = 32
#: Numbers of 64 parities each in which the words of a candidate are told apart; long lines fill 64.
WIDE = 4

_CLASS = ["c1", "c2"]
_LINE = ["doc_id", "row", "line_no"]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), f"{BLANK}+"), "")


def _place(h: Column, size: int) -> Column:
    return F.pmod(h, F.lit(size).cast("bigint"))


def word_counts(docs: DataFrame) -> bytes:
    """For each hash of words, how often they occur, as 4 x log2 of the count plus 1."""
    words = docs.select(F.explode(F.split(F.lower("text"), f"{BLANK}+")).alias("word")).filter("word != ''")
    counted = words.groupBy(_place(F.xxhash64("word"), COUNTS).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.lit(127), F.floor(4 * F.log2("n")) + 1)
    return byte_table(counted.select("place", level.alias("value")), COUNTS)


class Similarity:
    """A Jaccard similarity as a fraction, and what it asks of two lines of n and m words."""

    def __init__(self, top: int, bottom: int):
        self.top, self.bottom = top, bottom

    def prefix(self, n: Column) -> Column:
        """How many of the rarest words may be the first common one. Up to this length only equal lines are similar: 0."""
        least = F.floor((n * self.top + self.bottom - 1) / self.bottom)
        alone = self.top * (n + 1) > self.bottom * n
        return F.when(alone, 0).otherwise(n - least + 1).cast("int")

    def common(self, n: Column, m: Column) -> Column:
        """The least number of common words."""
        both = self.top + self.bottom
        return F.floor(((n + m) * self.top + both - 1) / both)

    def lengths(self, n: Column, m: Column) -> Column:
        return F.least(n, m) * self.bottom >= F.greatest(n, m) * self.top

    def reached(self, common: Column, n: Column, m: Column) -> Column:
        return common * self.bottom >= (n + m - common) * self.top


def _keyed(docs: DataFrame, key: str, text: str, others: Sequence[str]) -> DataFrame:
    rows = pick(docs, key, text, *others).toDF("doc_id", "text", *[f"other_{i}" for i in range(len(others))])
    return rows.withColumn("row", F.xxhash64("doc_id", "text"))


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _lines(rows: DataFrame, counts: bytes, alike: Similarity) -> DataFrame:
    """The class of each line that has words, the number of its words and its prefix."""

    def ranked(h: Column) -> Column:
        rank = byte_at(counts, _place(h, COUNTS)).cast("bigint")
        return F.call_function("shiftleft", rank, F.lit(56)) + F.shiftrightunsigned(h, 8)

    words = F.sort_array(F.array_distinct(F.transform(_words(F.col("line")), lambda w: ranked(F.xxhash64(w)))))
    # the test on the text keeps the costly words from being made a second time for a filter on them
    lines = _exploded(rows).filter(F.col("line").rlike(f"[^{BLANK[1:-1]}]")).select(*_LINE, words.alias("words"))
    # each word turns one of 64 bits over, so two lines differ in no more bits than words
    parity = F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a.bitwiseXOR(_bit(w)))
    # of long lines, which fill 64 bits, also the share of every second word in them
    half = F.aggregate(
        "words", F.lit(0).cast("bigint"), lambda a, w: F.when(w.bitwiseAND(F.lit(64)) != 0, a.bitwiseXOR(_bit(w))).otherwise(a)
    )
    n = F.size("words")
    return lines.select(
        *_LINE,
        F.xxhash64("words").alias("c1"),
        parity.alias("c2"),
        F.when(n > LONG, half).alias("half"),
        n.alias("n"),
        F.slice("words", F.lit(1), alike.prefix(n)).alias("prefix"),
    )


def _bit(word: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), word.bitwiseAND(F.lit(63)).cast("int"))


def _order() -> Column:
    """The order of lines: by document key (null last), for equal keys by the row's hash, then by place."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "line_no")


def _low(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(2**32 - 1))


def _index(classes: DataFrame) -> DataFrame:
    """A row for each entry of each class: half of the class's hash and the number of words share a number."""
    return classes.select(
        "c2", "half", _low(F.col("c1")).alias("low"), "n", F.posexplode("prefix").alias("at", "entry")
    ).select("entry", "c2", "half", (F.call_function("shiftleft", "low", F.lit(32)) + F.col("n")).alias("low_n"), "at")


def _enough(a: dict[str, Column], b: dict[str, Column], odd: Column, alike: Similarity) -> Column:
    """What the numbers of words, an entry's places and the bits that differ must be for two lines to be similar."""
    common = alike.common(a["n"], b["n"])
    reach = F.least(a["n"] - a["at"], b["n"] - b["at"])
    return alike.lengths(a["n"], b["n"]) & (reach >= common) & (odd <= a["n"] + b["n"] - 2 * common)


def _sides(n, *names: str) -> list[dict[str, Column]]:
    return [{"n": n(s), **{name: F.col(f"{s}.{name}") for name in names}} for s in ("a", "b")]


def _candidates(classes: DataFrame, alike: Similarity) -> DataFrame:
    """``c2`` and ``low`` of the classes that share an entry with another one that may be similar."""
    index = _index(classes)
    a, b = _sides(lambda s: F.col(f"{s}.low_n").bitwiseAND(F.lit(2**32 - 1)).cast("int"), "entry", "c2", "half", "low_n", "at")
    both, half = a["c2"].bitwiseXOR(b["c2"]), a["half"].bitwiseXOR(b["half"])
    odd = F.coalesce(F.bit_count(half) + F.bit_count(both.bitwiseXOR(half)), F.bit_count(both))
    other = (both != 0) | (a["low_n"] != b["low_n"])
    found = index.alias("a").join(index.alias("b"), (a["entry"] == b["entry"]) & other & _enough(a, b, odd, alike), "left_semi")
    return found.select("c2", F.shiftrightunsigned("low_n", 32).alias("low")).distinct()


def _words_of(known: DataFrame, rows: DataFrame) -> DataFrame:
    """The words of each class, by its ``number``, read from its first line, and their parities in 256 bits."""
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.row") == F.col("y.row")) & (F.col("x.line_no") == F.col("y.line_no"))
    again = join_checked(_exploded(rows).alias("x"), known.select("number", *_LINE).alias("y"), same)
    hashes = F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))
    found = again.select("number", hashes.alias("words")).dropDuplicates(["number"])
    own = lambda w, i: F.shiftright(w, 6).bitwiseAND(F.lit(WIDE - 1)) == i
    parity = lambda i: F.aggregate(
        "words", F.lit(0).cast("bigint"), lambda a, w: F.when(own(w, i), a.bitwiseXOR(_bit(w))).otherwise(a)
    )
    return found.select("number", "words", F.array(*[parity(i) for i in range(WIDE)]).alias("parities"))


def _similar(pairs: DataFrame, words: DataFrame, alike: Similarity) -> DataFrame:
    """The later class of each pair (``number`` and the ``earlier`` one) that is similar."""
    ends = materialise(pairs.select("number").union(pairs.select("earlier")).distinct(), "line-ends")
    words = join_checked(words, ends, "number", "left_semi")
    sides = pairs.join(words.withColumnRenamed("words", "late"), "number").join(words.toDF("earlier", "early"), "earlier")
    common = F.size(F.array_intersect("early", "late"))
    return sides.filter(alike.reached(common, F.size("early"), F.size("late"))).select("number").distinct()


def _settled(index: DataFrame, words: DataFrame, alike: Similarity) -> DataFrame:
    """The numbers of classes that are similar to an earlier one.

    ``index`` has the classes of each entry in their order. A round compares the
    open classes with the next places of each entry, twice as many as before, so
    there are as many rounds as the longest list has bits.
    """
    of_entry = Window.partitionBy("entry")
    index = index.withColumn("size", F.count(F.lit(1)).over(of_entry)).filter("size > 1").drop("size")
    index = materialise(index.withColumn("place", F.row_number().over(of_entry.orderBy("number")) - 1), "line-index")
    longest = index.agg(F.max("place")).first()[0] or 0
    gone = index.sparkSession.createDataFrame([], "number bigint")
    begin = 0
    while begin < longest:
        end = 2 * begin + 1
        late = join_checked(index.filter(F.col("place") > begin), gone, "number", "left_anti")
        early = index.filter((F.col("place") >= begin) & (F.col("place") < end))
        a, b = _sides(lambda s: F.col(f"{s}.n"), "entry", "number", "at")
        odd = sum(F.bit_count(F.col("a.parities")[i].bitwiseXOR(F.col("b.parities")[i])) for i in range(WIDE))
        meet = (a["entry"] == b["entry"]) & (b["number"] < a["number"]) & _enough(a, b, odd, alike)
        pairs = late.alias("a").join(early.alias("b"), meet)
        pairs = materialise(pairs.select("a.number", F.col("b.number").alias("earlier")).distinct(), "line-pairs")
        gone = materialise(gone.unionByName(_similar(pairs, words, alike)), "line-gone")
        begin = end
    return gone


def removed_lines(rows: DataFrame, alike: Similarity) -> DataFrame:
    """``doc_id``, ``row``, ``line_no`` of every line that an earlier line makes superfluous."""
    lines = materialise(_lines(rows, word_counts(rows), alike), "lines")
    classes = lines.groupBy(*_CLASS).agg(
        F.min(_order()).alias("first"), F.count(F.lit(1)).alias("size"), *[F.first(c).alias(c) for c in ("half", "n", "prefix")]
    )
    classes = materialise(classes, "line-classes")
    candidates = materialise(_candidates(classes, alike), "line-candidates")

    # only classes of several lines and candidates are of interest from here on
    marked = candidates.withColumn("candidate", F.lit(True))
    known = join_checked(classes.withColumn("low", _low(F.col("c1"))), marked, ["c2", "low"]).select(*_CLASS, "first.*", "n", "prefix")
    known = materialise(row_numbers(known, [F.col(c) for c in ("unnamed", *_LINE)], "number"), "line-known")
    words = materialise(_words_of(known, rows), "line-words")
    index = join_checked(known.select("number", "n", F.posexplode("prefix").alias("at", "entry")), words.select("number", "parities"), "number")
    gone = _settled(index, words.select("number", "words"), alike)

    gone = join_checked(known, gone, "number", "left_semi").select(*_CLASS, F.lit(True).alias("gone"))
    several = classes.filter("size > 1").select(*_CLASS, "first")
    state = several.join(gone, _CLASS, "full").select(*_CLASS, "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    state = materialise(state, "line-state")
    placed = join_checked(lines.select(*_LINE, *_CLASS), state, _CLASS)
    return placed.filter(F.col("gone") | (F.col("first") != _order())).select(*_LINE)


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", others: Sequence[str] = (), alike: Similarity | None = None
) -> DataFrame:
    """``doc_id``, ``row``, ``text`` without superfluous lines, ``n_lines``, ``n_removed`` and ``others``, for every row of ``docs``.

    Lines end at line feeds; their words are what white space separates, in
    lower case, each counted once. A line goes if a line before it, in the same
    document or in one with a smaller key, has the same words or a Jaccard
    similarity of ``alike`` (4/5) or more to its words. Lines without words stay.
    A null text stays null and has no lines, an empty one has one line. Null
    keys come last. Rows that repeat key and text count as one document and are
    cut alike; a document may lose all its lines, its text is then empty.
    ``row`` is a hash of key and text.
    """
    alike = alike or Similarity(4, 5)
    rows = _keyed(docs, key, text, others)
    named = [F.col(f"other_{i}").alias(name) for i, name in enumerate(others)]
    gone = materialise(removed_lines(rows.select("doc_id", "text", "row"), alike).distinct(), "line-removed")
    listed = gone.groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone"))
    lines = F.split("text", "\n", -1)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.row") == F.col("y.row"))
    cut = join_checked(rows.alias("x"), listed.alias("y"), same, "left", size=gone.count()).select("x.*", "gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    return cut.withColumn("lines", F.when(F.col("gone").isNotNull(), lines)).select(
        "doc_id",
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        n_lines.alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"),
        *named,
    )
