"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text knows every string that
occurs in it. A text is cut, from left to right, into the longest phrases that
occur there; few phrases mean that the text repeats what the language has. With
n characters of labelled text a phrase costs log2(n) bits, so phrases x log2(n)
for each character estimates the cross entropy, and the smallest one wins.

All languages and all texts of a batch are parsed side by side, in blocks of a
few thousand characters each, so a huge text takes no more steps than a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.columns import arrow_type, map_texts, pick, slices

#: Bounds of the labelled sample: documents and characters for each language, characters of one document,
#: characters of all languages.
SAMPLE_DOCS, SAMPLE_CHARS, DOC_CHARS, ALL_CHARS = 100, 20_000, 2_000, 1_000_000
#: Characters, the commonest ones, that have a column in the table of transitions, and characters in a block.
#: The automata know all other characters of the samples by a sorted list of transitions.
ALPHABET, BLOCK = 127, 2_048
#: From so many letters on, a text that needs as many bits as random letters is in no known language.
ENOUGH_LETTERS = 200
#: What a text without letters is.
UNDETERMINED = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    """Lower case, with one space for whatever lies between letters."""
    return _NO_LETTERS.sub(" ", text.lower()).strip()


def transitions(codes: list[int]) -> list[dict[int, int]]:
    """The automaton of all substrings of ``codes``: for each state the next one by code. The first state is the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def split(step: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions as a table, a row for each state and -1 where there is none, and those by codes from ``width`` on as rows of state, code, next state."""
    table = np.full((len(step), width), -1, dtype=np.int32)
    rare = []
    for state, nexts in enumerate(step):
        for c, target in nexts.items():
            if c < width:
                table[state, c] = target
            else:
                rare.append((state, c, target))
    return table, np.array(rare, dtype=np.int64).reshape(-1, 3)


def suffix_automaton(codes: list[int], width: int) -> np.ndarray:
    """The table of the automaton of ``codes``, all of them less than ``width``."""
    return split(transitions(codes), width)[0]


@dataclass(frozen=True)
class Languages:
    """The automata of all languages in one table, each with its own root.

    ``alphabet`` has all characters of the samples, the commonest first. Those
    beyond the table's columns go by ``keys``, sorted, of state and code, and
    the states in ``targets``. ``different`` counts each language's characters.
    """

    names: list[str]
    alphabet: str
    table: np.ndarray
    keys: np.ndarray
    targets: np.ndarray
    roots: np.ndarray
    bits: np.ndarray
    different: np.ndarray

    @classmethod
    def learn(cls, samples: dict[str, str]) -> Languages:
        names = sorted(samples)
        counts: dict[str, int] = {}
        for text in samples.values():
            for c in text:
                counts[c] = counts.get(c, 0) + 1
        alphabet = "".join(sorted(sorted(counts), key=lambda c: -counts[c]))
        code = {c: i + 1 for i, c in enumerate(alphabet)}  # 0: a character of no sample, in no phrase
        width = min(len(alphabet), ALPHABET) + 1
        tables, rare, roots, size = [], [np.zeros((0, 3), np.int64)], [], 0
        for name in names:
            table, others = split(transitions([code[c] for c in samples[name]]), width)
            tables.append(np.where(table >= 0, table + size, -1).astype(np.int32))
            rare.append(others + np.array([size, 0, size]))
            roots.append(size)
            size += len(table)
        joined = np.concatenate(tables) if tables else np.zeros((0, 1), np.int32)
        state, by, target = np.concatenate(rare).T
        keys = state * (len(alphabet) + 1) + by
        order = np.argsort(keys)
        bits = np.array([np.log2(max(2, len(samples[n]))) for n in names])
        different = np.array([len(set(samples[n])) for n in names], dtype=np.int64)
        return cls(names, alphabet, joined, keys[order], target[order].astype(np.int32), np.array(roots, dtype=np.int64), bits, different)

    def random_bits(self) -> np.ndarray:
        """What a random letter costs in each language: one of its own, or of the commonest ALPHABET where it has fewer."""
        return np.log2(np.maximum(np.maximum(self.different, min(len(self.alphabet), ALPHABET)), 2))

    def rare_steps(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after codes beyond the table's columns; -1 where there is none."""
        wanted = state.astype(np.int64) * (len(self.alphabet) + 1) + code
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.targets[at], np.int32(-1))

    def coder(self) -> np.ndarray:
        codes = np.zeros(0x110000, dtype=np.uint32)
        codes[[ord(c) for c in self.alphabet]] = np.arange(1, len(self.alphabet) + 1)
        return codes

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """The number of phrases of each text (codes of its characters) in each language."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        n_blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        first = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        lengths = np.minimum(BLOCK, sizes[owner] - first * BLOCK)
        begins = (np.cumsum(sizes) - sizes)[owner] + first * BLOCK
        order = np.argsort(-lengths, kind="stable")
        owner, lengths, begins = owner[order], lengths[order], begins[order]
        found = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        flat = np.concatenate(texts) if len(texts) else np.zeros(0, np.uint32)
        width = self.table.shape[1]
        columns = np.where(flat < width, flat, 0)
        steps, root_steps = self.table.ravel(), self.table[self.roots]
        roots = self.roots.astype(np.int32)[:, None]
        restart = np.where(root_steps >= 0, root_steps, roots)  # where a new phrase is after its first character
        state = np.repeat(roots, len(owner), axis=1)
        counts = np.ones((len(self.names), len(owner)), dtype=np.int32)
        # how many blocks are longer than each step
        active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        for step, n in enumerate(active):
            at = begins[:n] + step
            code = columns[at]
            after, again = steps.take(state[:, :n] * width + code), restart[:, code]
            rare = np.flatnonzero(flat[at] >= width)
            if len(rare):
                by = flat[at[rare]]
                after[:, rare] = self.rare_steps(state[:, rare], by)
                first_steps = self.rare_steps(roots, by)
                again[:, rare] = np.where(first_steps >= 0, first_steps, roots)
            ended = after < 0
            counts[:, :n] += ended
            state[:, :n] = np.where(ended, again, after)
        np.add.at(found, owner, counts.T)
        return found

    def judge(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """Language, score and bits for each character of texts."""
        plain = [normalise(t) for t in texts]
        usable = [i for i, t in enumerate(plain) if any(map(str.isalpha, t))] if self.names else []
        out = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        coder = self.coder()
        codes = [coder[np.frombuffer(plain[i].encode("utf-32-le"), dtype=np.uint32)] for i in usable]
        rates = self.phrases(codes) * self.bits
        for i, c, rate in zip(usable, codes, rates, strict=True):
            best = int(np.argmin(rate))
            second = float(np.delete(rate, best).min()) if len(rate) > 1 else 2 * float(rate[best])
            score = (second - float(rate[best])) / second if second else 0.0
            out[i] = (self.names[best], min(1.0, max(0.0, score)), float(rate[best]) / len(c))
        return out


def learn(
    labelled: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
) -> Languages:
    """Automata from a bounded sample of the labelled rows: for each language the documents with the smallest hashes.

    Rows without a language or a text count for nothing. The driver gets at most
    ``sample_docs`` texts of DOC_CHARS characters for each language; only this
    sample is cut short, texts that are judged are not.
    """
    rows = pick(labelled, key, text, lang).toDF("key", "text", "lang").filter("text is not null and lang is not null")
    rows = rows.select("lang", F.substring("text", 1, DOC_CHARS).alias("text"), F.xxhash64("text", "key").alias("order"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    chosen = rows.withColumn("n", first).filter(F.col("n") <= sample_docs).select("lang", "n", "text")
    texts: dict[str, dict[str, None]] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], r["n"])):
        texts.setdefault(row["lang"], {})[normalise(row["text"])] = None
    most = min(sample_chars, ALL_CHARS // max(1, len(texts)))
    samples = {name: " ".join(found)[:most] for name, found in texts.items()}
    return Languages.learn({name: sample for name, sample in samples.items() if sample.strip()})


def identify(docs: DataFrame, languages: Languages, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` (0 to 1) and ``bits`` for each character, for every row of ``docs``.

    A null text or one without a letter is ``und`` with score 0. The score says
    by how much the winner needs fewer bits than the next language. Ties go to
    the first language by name. Repeated rows and null keys are kept; other
    columns are left out. Whole texts, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def work():
        known = shared.value

        def judge(texts: list[str]) -> dict:
            found = known.judge(texts)
            return {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "bits": [f[2] for f in found]}

        return judge

    chosen = pick(docs, key, text)
    kind = chosen.schema[key].dataType
    return map_texts(
        chosen,
        work,
        f"`{key}` {kind.simpleString()}, lang_pred string, score double, bits double",
        pa.schema([(key, arrow_type(kind)), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())]),
        text,
    )


def keep_known(docs: DataFrame, languages: Languages, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a known language.

    Texts without letters go, and texts of ENOUGH_LETTERS or more that parse in
    the likeliest language no better than random letters of it do. Shorter texts stay. Without a
    single language to compare with, nothing can be told and only texts without
    letters go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        random = dict(zip(known.names, known.random_bits().tolist(), strict=True))
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            mask = []
            for t, (name, _, bits) in zip(texts, known.judge(texts), strict=True):
                if known.names:
                    strange = bits >= random.get(name, 0.0) and sum(map(str.isalpha, t)) >= ENOUGH_LETTERS
                    mask.append(name != UNDETERMINED and not strange)
                else:
                    mask.append(any(map(str.isalpha, t)))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
