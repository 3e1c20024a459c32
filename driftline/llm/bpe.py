"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

The model holds one piece for each rank, its bytes mapped to printable
characters, with the negative rank as its score, and changes nothing in its
input. Merging the best-scored pair first is then merging the lowest rank first.
Texts are cut into pre-tokens, each is encoded by itself, and ids go back to
bytes by the inverse of the mapping.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from driftline.llm.columns import arrow_type, map_texts, pick

#: Pre-tokens whose ids a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Pre-tokens taken from a text at a time, so that a very long text needs no list of all of them.
STRETCH = 100_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it has a glyph, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model with the ranks as ids and one unknown piece after them."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must count from 0 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte needs a rank")
    characters = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [("".join(characters[b] for b in token), -float(rank), normal) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(("<unk>", 0.0, unknown))
    out = [_block(1, _block(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind)) for p, score, kind in pieces]
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(ranks))
    trainer += b"".join(_number(field, -1) for field in (41, 42, 43))  # no begin, end or padding piece
    unchanged = _block(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))
    return b"".join(out) + _block(2, trainer) + _block(3, unchanged)


class Codec:
    """Encodes and decodes texts by a rank file and the pattern of its pre-tokens."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.ranks = ranks
        self.tokens = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.pattern = regex.compile(pattern)
        self.table = dict(enumerate(byte_characters()))
        self.known: dict[str, list[int]] = {}

    def _encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        rank = self.ranks.get(data)  # a whole pre-token in the vocabulary is one token, whatever its merges
        ids = [rank] if rank is not None else self.model.encode(data.decode("latin-1").translate(self.table))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(piece) <= 64:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        found = self.pattern.finditer(text)
        known = self.known
        while stretch := [m.group() for m in islice(found, STRETCH)]:
            for piece in stretch:
                ids += known.get(piece) or self._encode_piece(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec in each Python worker."""
    return Codec(path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array of int) and ``decoded`` (binary), for every row of ``docs``.

    Null and empty texts give no ids and no bytes. Repeated rows and null keys
    are kept as they are; other columns are left out. Every text is taken whole.
    No shuffle: one pass over the texts.
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
        f"`{key}` {kind.simpleString()}, ids array<int>, decoded binary",
        pa.schema([(key, arrow_type(kind)), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]),
        text,
    )

