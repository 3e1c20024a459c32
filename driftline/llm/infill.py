"""Fill-in-middle: texts cut in three and put together with the middle at the end.

The three cuts of a text and its form follow from a hash of its key. The text
is one bytearray: sentinels are inserted at the cuts, and the parts change
places by rotations of two neighbouring segments, each made of three reversals.
A text with its form is restored by finding the sentinels, rotating back and
taking the sentinels out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.columns import arrow_type, pick, slices

#: The sentinels, and the shares (in 100) of texts that are changed and, of those, put suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FIM_RATE, SPM_RATE = 50, 80
SEED = "42"

_SENTINELS = (PREFIX, SUFFIX, MIDDLE)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(data: bytes | bytearray) -> np.ndarray:
    """Where each unit ends: a word with the white space before it, or white space up to the end of the text."""
    blank = _BLANK[np.frombuffer(data, dtype=np.uint8)]
    if not len(blank):
        return np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(blank))


def rotate(data: bytearray, begin: int, middle: int, end: int) -> None:
    """Exchange the neighbouring segments [begin, middle) and [middle, end) by three reversals."""
    for a, b in ((begin, middle), (middle, end), (begin, end)):
        data[a:b] = data[a:b][::-1]


def code_points(data: bytes | bytearray) -> int:
    """The number of code points in UTF-8 bytes: all bytes but continuation bytes."""
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


def transform(data: bytearray, form: str, first: int, second: int) -> None:
    """Put a text that is cut at two byte offsets into its form, in place."""
    for place, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        data[place:place] = sentinel
    # <P>prefix<M>middle<S>suffix
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(data, middle if form == "psm" else 0, suffix, len(data))


def restore(data: bytearray, form: str) -> None:
    """Turn the output of ``transform`` back into the text, in place."""
    if form == "plain":
        return
    if form == "psm":
        suffix, middle = data.index(SUFFIX), data.index(MIDDLE)
        rotate(data, suffix, middle, len(data))
    else:
        rotate(data, 0, data.index(PREFIX), len(data))
    # <P>prefix<M>middle<S>suffix again; no part holds a sentinel
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        place = data.index(sentinel)
        del data[place : place + len(sentinel)]


def infill(text: str, draws: list[int]) -> tuple:
    """``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` and ``restored`` of one text and its four draws."""
    data = bytearray(text.encode())
    ends = unit_ends(data)
    n = len(ends)
    if not data or draws[2] % 100 >= FIM_RATE or any(s in data for s in _SENTINELS):
        return n, "plain", None, None, text, text
    first, second = (int(ends[units - 1]) if units else 0 for units in sorted(d % (n + 1) for d in draws[:2]))
    form = "spm" if draws[3] % 100 < SPM_RATE else "psm"
    sizes = code_points(data[:first]), code_points(data[first:second])
    transform(data, form, first, second)
    output = data.decode()
    restore(data, form)
    return n, form, *sizes, output, data.decode()


def draws_of(key: Column, seed: str = SEED) -> Column:
    """Four numbers of 32 bits from the SHA-256 of the seed and the key; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """``key``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` and ``restored``, for every row of ``docs``.

    ``n`` is the number of units; ``form`` is plain (the text as it is), psm or
    spm. A text stays plain if it is empty or null (n = 0), holds a sentinel or
    is not drawn. Rows that repeat a key get the same draws; a null key is drawn
    as the empty one. Texts are taken whole; other columns are left out. No
    shuffle: one pass over the texts.
    """
    chosen = pick(docs, key, text).toDF("key", "text").select("key", "text", draws_of(F.col("key"), seed).alias("draws"))
    kind = chosen.schema["key"].dataType
    schema = pa.schema(
        [
            ("key", arrow_type(kind)),
            ("n", pa.int64()),
            ("form", pa.string()),
            ("prefix_chars", pa.int64()),
            ("middle_chars", pa.int64()),
            ("output", pa.string()),
            ("restored", pa.string()),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, draws = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            made = list(zip(*map(infill, (t or "" for t in texts), draws), strict=True)) or [[]] * 6
            columns = [pa.array(values, type=field.type) for values, field in zip(made, list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), *columns], schema=schema)

    spark_schema = (
        f"key {kind.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string"
    )
    return chosen.mapInArrow(run, spark_schema).withColumnRenamed("key", key)
