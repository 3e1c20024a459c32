"""Texts and paths of commits with an index of their character grams, for finding substrings without reading the rest.

Below a folder: ``texts`` (what is searched, numbered in blocks), ``grams``
(which texts of a block hold a run of one to three characters, by a hash of the
run) and ``counts`` (how many texts do). A substring's texts hold all its runs
of three, so its rarest runs are intersected in every block, and only texts that
some pattern leaves are read, once for all patterns.

What a run has in a block is packed (``held``): the places of its texts as
two-byte numbers, or a bit for each place where that is shorter. So the index
takes about a bit for each text and run, and pairs of patterns and texts are
made only where a text holds the pattern.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.arrays import explode_rows, let
from driftline.operators import commit_index
from driftline.session import materialise

#: Characters of a run, folders of each table, and how many of a pattern's rarest runs are intersected.
SIZE, BUCKETS, RAREST = 3, 64, 4
#: So many values at most stand in a filter that is handed to the files.
IN_FILTER = 1_000
#: Places of a block (a power of two), characters that are cut at a time, and pairs of run and text that are packed at a time.
PLACES, CHARS, PAIRS = 4_096, 1_000_000, 4_000_000
#: Patterns that are looked for together and their characters; by how many a text is looked up, if more than a few patterns begin differently.
TOGETHER, PATTERN_CHARS, HEAD, FEW = 50_000, 5_000_000, 8, 64
#: Heads are told from other characters by a hash of so many bits first.
HASH_BITS = 20

TEXT = "field string, commit_hash string, values array<string>, block bigint, place int, bucket int"
GRAM = "field string, gram string, block bigint, n int, held binary, bucket int"
COUNT = "field string, gram string, n bigint, bucket int"
FIELDS = ("text", "path")
_POSTING = "field string, gram string, block bigint, n int, held binary"
_LEFT = "field string, block bigint, words array<bigint>"
_FOUND = "field string, pattern string, commit_hash string"


def _bucket(*names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int")


def _runs(value: Column, sizes: list[int]) -> Column:
    """The distinct runs of each of some numbers of code points of a text, made from its list of code points in one pass."""

    def of_size(p: Column, n: int) -> Column:
        # the places that have a whole run after them; those of an empty text have none
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(p) - n, F.lit(0))), lambda i: i + n <= F.size(p))
        return F.array_distinct(F.transform(places, lambda i: F.concat(*[F.get(p, i + k) for k in range(n)])))

    points = F.filter(F.split(value, ""), lambda c: c != "")
    return let(points, lambda p: F.flatten(F.array(*[of_size(p, n) for n in sizes])))


def searched(commits: DataFrame) -> DataFrame:
    """What is searched of index rows, in lower case: message and paths together, and the paths; a row for each field and commit."""
    text = commits.select(F.lit("text").alias("field"), "commit_hash", F.array(F.lower(commit_index.index_text())).alias("values"))
    paths = commits.select(F.lit("path").alias("field"), "commit_hash", F.transform("files", F.lower).alias("values"))
    rows = text.unionByName(paths).withColumn("values", F.filter("values", lambda v: v.isNotNull()))
    rows = rows.filter(F.col("commit_hash").isNotNull() & (F.size("values") > 0))
    # few hashes, if any, come more than once; only their rows are gathered
    often = commits.groupBy("commit_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("commit_hash")
    often = materialise(often, "repeated")
    gathered = rows.join(often, "commit_hash", "left_semi").groupBy("field", "commit_hash")
    gathered = gathered.agg(F.flatten(F.collect_list("values")).alias("values"))
    return rows.join(often, "commit_hash", "left_anti").select(*gathered.columns).unionByName(gathered)


def write(commits: DataFrame, path: str) -> None:
    """Store the texts of index rows and the index over them.

    Files are sorted by what they are looked up by, so a look-up reads a few
    blocks of a few folders.
    """
    number = F.monotonically_increasing_id()
    rows = searched(commits).withColumn("number", number).withColumns(
        {"block": F.floor(F.col("number") / PLACES), "place": (F.col("number") % PLACES).cast("int")}
    )
    rows = rows.drop("number").withColumn("bucket", _bucket("block")).sortWithinPartitions("bucket", "block", "place")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/texts")
    texts = commits.sparkSession.read.schema(TEXT).parquet(f"{path}/texts")
    grams = texts.select("field", "block", "place", "values").mapInArrow(_postings, _POSTING)
    grams = materialise(grams.withColumn("bucket", _bucket("field", "gram")), "grams")
    _store(grams, "gram", f"{path}/grams")
    # a text is packed at one place, so no text counts twice
    counts = grams.groupBy("field", "gram", "bucket").agg(F.sum("n").alias("n"))
    _store(counts, "gram", f"{path}/counts")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of texts (``field``, ``block``, ``place``, ``values``), packed for each field and block."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    of, texts, chars = None, [], 0
    for batch in batches:
        for *block, place, values in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if block != of or chars > CHARS:
                if texts:
                    pairs.append(_pairs(texts))
                texts, chars = [], 0
                if pairs and (block != of or sum(len(keys) for keys, _ in pairs) > PAIRS):
                    yield _packed(*of, pairs)
                    pairs = []
                of = block
            texts += [(place, value) for value in values]
            chars += sum(map(len, values))
    if texts:
        pairs.append(_pairs(texts))
    if pairs:
        yield _packed(*of, pairs)


def _pairs(texts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of texts and the places of these, each pair once; a run is the code points, plus one, of its characters in 21 bits each."""
    lengths = [len(value) for _, value in texts]
    points = _points("".join(value for _, value in texts)).astype(np.int64) + 1
    number = np.repeat(np.arange(len(texts)), lengths)
    key, keys, numbers = np.zeros(len(points), dtype=np.int64), [], []
    for n in range(SIZE):
        # runs of one more character, where the text has one
        whole = np.flatnonzero(number[n:] == number[: len(number) - n]) if n < len(points) else np.array([], dtype=np.int64)
        key[whole] |= points[whole + n] << (21 * (SIZE - 1 - n))
        keys.append(key[whole])
        numbers.append(number[whole])
    places = np.array([place for place, _ in texts], dtype=np.int64)
    return _distinct(np.concatenate(keys), places[np.concatenate(numbers)])


def _distinct(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs once each, those of a key together and by place."""
    codes = pa.array(keys).dictionary_encode()
    # sorted: np.unique hashes, which is slower where most are distinct
    cells = np.sort(codes.indices.to_numpy().astype(np.int64) * PLACES + places)
    cells = cells[np.concatenate([[True], cells[1:] != cells[:-1]])] if len(cells) else cells
    return codes.dictionary.to_numpy()[cells // PLACES], cells % PLACES


def _packed(field: str, block: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, places = _distinct(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], dtype=np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    mask = (1 << 21) - 1
    shifts = [21 * (SIZE - 1 - n) for n in range(SIZE)]
    grams = ["".join(chr(c - 1) for shift in shifts if (c := key >> shift & mask)) for key in keys[starts].tolist()]
    two_bytes = places.astype("<u2")
    held = []
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        if 16 * size < PLACES:
            held.append(two_bytes[start : start + size].tobytes())
        else:
            bits = np.zeros(PLACES, dtype=bool)
            bits[places[start : start + size]] = True
            held.append(np.packbits(bits, bitorder="little").tobytes())
    count = len(grams)
    return pa.RecordBatch.from_arrays(
        [pa.array([field] * count, pa.string()), pa.array(grams, pa.string()), pa.array([block] * count, pa.int64()), pa.array(sizes, pa.int32()), pa.array(held, pa.binary())],
        names=["field", "gram", "block", "n", "held"],
    )


def _bits(held: bytes) -> np.ndarray:
    """What ``held`` packs as a bit for each place, in bytes."""
    if 8 * len(held) == PLACES:
        return np.frombuffer(held, dtype=np.uint8)
    bits = np.zeros(PLACES, dtype=bool)
    bits[np.frombuffer(held, dtype="<u2")] = True
    return np.packbits(bits, bitorder="little")


def _store(rows: DataFrame, key: str, path: str) -> None:
    ranged = rows.repartitionByRange("bucket", key).sortWithinPartitions("bucket", key)
    ranged.write.mode("overwrite").partitionBy("bucket").parquet(path)


def _only(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The folders of a table that ``wanted`` (``bucket``, ``key``) names and, if it names few keys, only those.

    The driver gets the numbers of folders and at most IN_FILTER keys.
    """
    buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
    table = table.filter(F.col("bucket").isin(buckets)) if buckets else table.limit(0)
    keys = wanted.select(key).distinct().limit(IN_FILTER + 1).collect()
    return table.filter(F.col(key).isin([r[key] for r in keys])) if 0 < len(keys) <= IN_FILTER else table


def pattern_runs(patterns: DataFrame) -> DataFrame:
    """The runs of each pattern (``field``, ``pattern``, lower case): those of three characters, or a shorter pattern itself."""
    pattern = F.col("pattern")
    cut = F.when(F.length(pattern) >= SIZE, _runs(pattern, [SIZE])).otherwise(F.array(pattern))
    runs = explode_rows(patterns, ["field", "pattern"], cut, "gram")
    return runs.select("field", "pattern", "gram", _bucket("field", "gram").alias("bucket"))


def find(spark: SparkSession, path: str, patterns: DataFrame) -> DataFrame:
    """``field``, ``pattern`` and ``commit_hash`` where a commit's text, or one of its paths, holds the pattern.

    ``patterns`` has ``field`` (text or path) and ``pattern``; case does not
    count, repeated patterns count once, an empty or null pattern is in nothing.
    Results equal a scan with ``contains``. All patterns are answered together,
    or TOGETHER at a time: the driver gets those, and what moves are packed runs.
    """
    wanted = patterns.select("field", F.lower("pattern").alias("pattern")).filter(F.length("pattern") > 0).distinct()
    runs = materialise(pattern_runs(wanted), "runs")
    counts = _only(spark.read.schema(COUNT).parquet(f"{path}/counts"), runs, "gram")
    known = runs.join(counts.drop("bucket"), ["field", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("field", "pattern").orderBy("n", "gram")
    rare = known.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= RAREST)
    # a run that no commit has rules its pattern out
    asked = rare.groupBy("field", "pattern").agg(F.min("n").alias("least"), F.collect_list("gram").alias("grams"))
    asked = materialise(asked.filter("least > 0").drop("least"), "asked")

    size = asked.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-size["rows"] // TOGETHER), -(-size["chars"] // PATTERN_CHARS))
    found = []
    for number in range(parts):
        part = asked.filter(F.pmod(F.xxhash64("field", "pattern"), F.lit(parts)) == number)
        found.append(_find_together(spark, path, part))
    return reduce(DataFrame.unionByName, found)


def _find_together(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """``find`` for so many patterns (``field``, ``pattern``, ``grams``) as fit in every task."""
    rows = [(r["field"], r["pattern"], r["grams"]) for r in asked.collect()]
    grams = asked.select("field", F.explode("grams").alias("gram")).distinct()
    grams = materialise(grams.withColumn("bucket", _bucket("field", "gram")), "rare-runs")
    held = _only(spark.read.schema(GRAM).parquet(f"{path}/grams"), grams, "gram")
    # RAREST runs of each of the patterns at most, which the driver has as well
    held = held.join(F.broadcast(grams.drop("bucket")), ["field", "gram"], "left_semi").select("field", "block", "gram", "held")
    left = held.groupBy("field", "block").applyInArrow(_intersect(rows), _LEFT)
    left = materialise(left.withColumn("bucket", _bucket("block")), "candidates")

    texts = _only(spark.read.schema(TEXT).parquet(f"{path}/texts"), left, "block")
    both = texts.drop("bucket").join(left.drop("bucket"), ["field", "block"])
    word = F.get("words", F.floor(F.col("place") / 64).cast("int"))
    both = both.filter(F.bit_get(word, F.col("place") % 64) == 1)
    return both.select("field", "commit_hash", "values").mapInArrow(_match([row[:2] for row in rows]), _FOUND)


def _intersect(asked: list):
    """A function over the packed runs of a field in a block that leaves the places where one of the patterns has all its runs."""
    numbers: dict[tuple[str, str], int] = {}
    of: dict[str, list[list[int]]] = {}
    for field, _, grams in asked:
        own = [numbers.setdefault((field, gram), len(numbers)) for gram in grams]
        of.setdefault(field, []).append((own * RAREST)[:RAREST])
    wanted = {field: np.unique(np.array(rows, dtype=np.int32), axis=0) for field, rows in of.items()}

    def run(block: pa.Table) -> pa.Table:
        field = block["field"][0].as_py()
        rows = np.full(len(numbers), -1)
        bits: list[np.ndarray] = []
        for gram, held in zip(block["gram"].to_pylist(), block["held"].to_pylist(), strict=True):
            number = numbers[field, gram]
            if rows[number] < 0:
                rows[number] = len(bits)
                bits.append(_bits(held))
            else:  # what one task packed of a block, and another one
                bits[rows[number]] = bits[rows[number]] | _bits(held)
        packed, at = np.stack(bits), rows[wanted[field]]
        at = at[(at >= 0).all(axis=1)]
        left = np.zeros(PLACES // 8, dtype=np.uint8)
        for first in range(0, len(at), PLACES):
            here = at[first : first + PLACES]
            left |= np.bitwise_or.reduce(reduce(np.bitwise_and, (packed[here[:, i]] for i in range(RAREST))), axis=0)
        count = int(left.any())
        return pa.table(
            [pa.array([field] * count, pa.string()), pa.array([block["block"][0].as_py()] * count, pa.int64()), pa.array([left.view("<i8").tolist()] * count, pa.list_(pa.int64()))],
            names=["field", "block", "words"],
        )

    return run


def _match(asked: list):
    """A function over texts (``field``, ``commit_hash``, ``values``) that gives the patterns in each, looked up by their first HEAD characters."""
    heads: dict[str, dict[int, dict[str, list[str]]]] = {}
    for field, pattern in asked:
        head = pattern[:HEAD]
        heads.setdefault(field, {}).setdefault(len(head), {}).setdefault(head, []).append(pattern)

    marks = {(field, size): _marks(known) for field, sizes in heads.items() for size, known in sizes.items() if len(known) > FEW}

    def held(field: str, values: list[str]) -> set[str]:
        found = set()
        for value in values:
            points = None
            for size, known in heads.get(field, {}).items():
                if len(known) <= FEW:
                    here = [head for head in known if head in value]
                else:
                    points = _points(value) if points is None else points
                    places = np.flatnonzero(marks[field, size][_hashes(points, size)]).tolist()
                    here = known.keys() & {value[i : i + size] for i in places}
                for head in here:
                    found.update(p for p in known[head] if len(p) == size or p in value)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, str, str]] = []
            for field, commit, values in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                rows += [(field, pattern, commit) for pattern in held(field, values)]
                if len(rows) > 100_000:
                    yield _strings(rows)
                    rows = []
            yield _strings(rows)

    return run


def _points(value: str) -> np.ndarray:
    return np.frombuffer(value.encode("utf-32-le"), dtype=np.uint32)


def _hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A number below 2^HASH_BITS for every run of ``size`` characters."""
    count = max(0, len(points) - size + 1)
    hashes = np.zeros(count, dtype=np.uint32)
    for i in range(size):
        hashes *= np.uint32(2_654_435_761)
        hashes += points[i : i + count]
    hashes *= np.uint32(2_654_435_761)
    return hashes >> np.uint32(32 - HASH_BITS)


def _marks(heads: dict[str, list[str]]) -> np.ndarray:
    """Which hashes the heads, all of one length, have."""
    marks = np.zeros(1 << HASH_BITS, dtype=bool)
    for head in heads:
        marks[_hashes(_points(head), len(head))] = True
    return marks


def _strings(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["field", "pattern", "commit_hash"])
