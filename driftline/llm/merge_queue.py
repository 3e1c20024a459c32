"""Byte-level BPE by a priority queue of merge ranks over a doubly linked list of symbols.

The symbols of a pre-token are linked both ways. Every pair of neighbours that
can merge waits in a queue by the rank of its merge, then its place. A pair
that is no longer there when its turn comes is skipped; a merge unlinks the
right symbol and queues the two new pairs. Decoding joins the vocabulary's
strings.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from driftline.llm.bpe import byte_characters
from driftline.llm.columns import arrow_type, map_texts, pick

#: Pre-tokens whose ids a worker remembers before it starts anew, and the most characters of one that it remembers.
REMEMBERED, LONGEST = 400_000, 64
#: Characters of a text whose pre-tokens are listed all at once, and pre-tokens taken at a time from a longer one.
AT_ONCE, STRETCH = 1_000_000, 100_000


class MergeQueue(dict):
    """Ids of pre-tokens by a ranked list of merges; remembers them as a dictionary."""

    def __init__(self, symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]):
        """``symbols`` has the id of each byte, ``merges`` the rank and the new id of each pair of ids."""
        super().__init__()
        self.symbols = symbols
        self.merges = merges

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.merge(piece.encode()))  # tuples of numbers cost the garbage collector nothing
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def merge(self, data: bytes) -> list[int]:
        merges = self.merges
        ids = [*map(self.symbols.__getitem__, data)]
        size = len(ids)
        # a queued pair is one number: its rank, then the place of its left symbol
        queue = [found[0] * size + i for i, pair in enumerate(zip(ids, ids[1:])) if (found := merges.get(pair))]
        if not queue:
            return ids
        heapify(queue)
        before, after = [*range(-1, size - 1)], [*range(1, size + 1)]
        while queue:
            rank, left = divmod(heappop(queue), size)
            right = after[left]
            if right >= size:
                continue
            found = merges.get((ids[left], ids[right]))
            if not found or found[0] != rank:  # stale: one of the two has merged since
                continue
            ids[left], ids[right] = found[1], -1
            after[left] = following = after[right]
            after[right] = size  # an unlinked symbol has no neighbour any more
            if following < size:
                before[following] = left
                if found := merges.get((ids[left], ids[following])):
                    heappush(queue, found[0] * size + left)
            if (previous := before[left]) >= 0 and (found := merges.get((ids[previous], ids[left]))):
                heappush(queue, found[0] * size + previous)
        return [i for i in ids if i >= 0]


class Codec:
    """Encodes and decodes by a tokenizer file that holds a byte-level BPE vocabulary, its merges and added tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as lines:
            description = json.load(lines)
        model = description["model"]
        known = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = {(known[a], known[b]): (rank, known[a + b]) for rank, (a, b) in enumerate(pairs)}
        characters = byte_characters()
        self.pieces = MergeQueue([known[c] for c in characters], merges)
        self.pattern = regex.compile(pattern)
        self.added = {token["content"]: token["id"] for token in description["added_tokens"] or []}
        # the longest of the added tokens that begin at a place counts
        by_length = sorted(self.added, key=len, reverse=True)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        byte_of = {c: b for b, c in enumerate(characters)}
        self.strings = {i: bytes(byte_of[c] for c in token) for token, i in known.items()}
        self.strings |= {i: content.encode() for content, i in self.added.items()}

    def _stretches(self, text: str):
        if len(text) <= AT_ONCE:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while some := [m.group() for m in islice(found, STRETCH)]:
            yield some

    def _encode_plain(self, text: str, ids: list[int]) -> None:
        for some in self._stretches(text):
            ids += chain.from_iterable(map(self.pieces.__getitem__, some))
            if len(self.pieces) > REMEMBERED:
                self.pieces.clear()

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if not self.splitter or not any(token in text for token in self.added):
            self._encode_plain(text, ids)
            return ids
        for i, part in enumerate(self.splitter.split(text)):
            if i % 2:
                ids.append(self.added[part])
            else:
                self._encode_plain(part, ids)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec in each Python worker."""
    return Codec(path, pattern)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array of int) and ``decoded`` (string), for every row of ``docs``.

    Strings of added tokens inside a text become those tokens. Null and empty
    texts give no ids and the empty string. Repeated rows and null keys are kept
    as they are; other columns are left out. Every text is taken whole. No
    shuffle: one pass over the texts.
    """

    def work():
        own = codec(path, pattern)

        def both(texts: list[str]) -> dict:
            ids = [own.encode(t) for t in texts]
            return {"ids": ids, "decoded": [own.decode(i) for i in ids]}

        return both

    chosen = pick(docs, key, text)
    kind = chosen.schema[key].dataType
    return map_texts(
        chosen,
        work,
        f"`{key}` {kind.simpleString()}, ids array<int>, decoded string",
        pa.schema([(key, arrow_type(kind)), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]),
        text,
    )
