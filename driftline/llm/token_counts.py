"""Token counts of texts, huge ones in overlapping chunks that are spliced where both agree.

A text of at most ``chunk`` characters goes to the library whole. A longer one
is encoded in chunks that overlap. Two neighbours are spliced at a place inside
their overlap where both begin a token and where any split of the text begins a
pre-token: a single space between two characters that are no white space. No
pre-token reaches over such a place from the left, as only its first character
may be a space and runs of white space need white space on both sides; no
special string holds a space. So what follows is encoded alike whatever came
before. Where an overlap has no such place, it is widened, at last to the whole
text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftline.llm.columns import arrow_type, map_texts, pick

#: Characters in a chunk of a huge document, and in the overlap of two chunks at first.
CHUNK, OVERLAP = 32_768, 256
#: Texts given to the library at a time.
TOGETHER = 256


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer, once in each Python worker; Spark runs the tasks side by side already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _starts(tokenizer, text: str, begin: int, end: int) -> np.ndarray:
    """Where the tokens of a chunk begin in the whole text."""
    offsets = tokenizer.encode(text[begin:end], add_special_tokens=False).offsets
    return np.fromiter((a for a, _ in offsets), dtype=np.int64, count=len(offsets)) + begin


def _stable(text: str, place: int) -> bool:
    return text[place] == " " and not text[place - 1].isspace() and place + 1 < len(text) and not text[place + 1].isspace()


def _splice(text: str, left: np.ndarray, right: np.ndarray, after: int, before: int) -> int | None:
    """The first stable place in the overlap where both chunks begin a token."""
    common = np.intersect1d(left[(left > after) & (left < before)], right)
    return next((int(p) for p in common if _stable(text, int(p))), None)


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text, from overlapping chunks."""
    size = len(text)
    end = min(size, chunk)
    left = _starts(tokenizer, text, 0, end)
    done = total = 0  # everything before the character ``done`` is counted
    while end < size:
        wide, place = overlap, None
        while end - wide > done:
            begin = end - wide
            right_end = min(size, begin + max(chunk, 2 * wide))
            right = _starts(tokenizer, text, begin, right_end)
            place = _splice(text, left, right, begin, end - 1)
            if place is not None:
                break
            wide *= 2
        if place is None:  # nothing to hold on to since the last splice: a longer left chunk
            end = min(size, done + 2 * (end - done))
            left = _starts(tokenizer, text, done, end)
            continue
        total += int(np.searchsorted(left, place) - np.searchsorted(left, done))
        done, left, end = place, right, right_end
    return total + int(len(left) - np.searchsorted(left, done))


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 512,
    key: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens), for every row.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null keys
    are kept; other columns are left out. No shuffle: one pass over the texts.
    """

    def work():
        tokenizer = load(path)

        def count(texts: list[str]) -> dict:
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for at in range(0, len(short), TOGETHER):
                some = short[at : at + TOGETHER]
                for i, found in zip(some, tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
                    counts[i] = len(found)
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    counts[i] = count_long(tokenizer, t, chunk, overlap)
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return count

    chosen = pick(docs, key, text)
    kind = chosen.schema[key].dataType
    return map_texts(
        chosen,
        work,
        f"`{key}` {kind.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean",
        pa.schema([(key, arrow_type(kind)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]),
        text,
    )
