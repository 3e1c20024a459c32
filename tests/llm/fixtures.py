"""Small corpora with the cases that operators must stand."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
AWKWARD = [
    "",
    None,
    " \t\n\x0b\x0c\r",
    "\n\n\n",
    "a",
    "ÀÉ ß 中文 😀 ​ \x85 \x1c",
    "<|endoftext|> x <|endoftext|><|endoftext|>",
    "one two three",
    "Tab\tseparated\twords and\r\nline ends\r\n",
    "x" * 5_000,
    " ".join(f"w{i}" for i in range(3_000)),
]


def table(spark: SparkSession, rows: list[tuple], schema: str = SCHEMA) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def docs_of(spark: SparkSession, texts: list, extra: bool = False) -> DataFrame:
    """Documents from texts; null keys and sources, repeated rows and, on request, columns whose names clash."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += rows[:2] + [(None, "a row without a key", "en", None, None), (None, None, None, None, None)]
    if not extra:
        return table(spark, rows)
    clash = "Text string, n_tokens string, ids bigint, row string, bucket string, kept string, words string, hash string"
    return table(spark, [(*r, "T", "x", 7, "r", "b", "k", "w", "h") for r in rows], f"{SCHEMA}, {clash}")


def invented(n: int, seed: int = 1, words: int = 80) -> list[str]:
    """Texts of invented words, a third of them copies of others with a few words changed."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 6))) for _ in range(800)]
    texts: list[str] = []
    for _ in range(n):
        if texts and draw.random() < 0.35:
            lines = [line.split(" ") for line in draw.choice(texts).split("\n")]
            for _ in range(draw.randint(0, 3)):
                line = draw.choice(lines)
                line[draw.randrange(len(line))] = draw.choice(vocabulary)
        else:
            lines = [[draw.choice(vocabulary) for _ in range(draw.randint(1, words // 4))] for _ in range(draw.randint(1, 8))]
        texts.append("\n".join(" ".join(line) for line in lines))
    return texts


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
