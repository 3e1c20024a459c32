"""Operators that work on one text at a time: tokens, licences, languages."""

import random
import re
from dataclasses import replace
from hashlib import sha256
from re import _parser

import public_tokenizers
import pytest
import tiktoken
from fixtures import AWKWARD, docs_of, invented, table

from driftline.llm import bpe, language_id, license_scan, token_counts
from driftline.llm.license_rules import BASE, RULES, Rule

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


def random_texts(n: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    signs = "abcXYZ  \n\t\r\x0b\x0c\x1c\x85  'sté😀中文ß123.,;<|>​؀"
    return ["".join(draw.choice(signs) for _ in range(draw.randrange(60))) for _ in range(n)]


def test_every_token_of_the_vocabulary_is_reached():
    codec = bpe.Codec(MULTI, public_tokenizers.PATTERN)
    table_ = codec.table
    assert all(codec.model.encode(t.decode("latin-1").translate(table_)) == [r] for t, r in codec.ranks.items())


def test_ids_equal_the_library_and_decode_to_the_text(library):
    codec = bpe.Codec(MULTI, public_tokenizers.PATTERN)
    for text in [t or "" for t in AWKWARD] + random_texts(3_000, 1) + invented(20):
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_forgetting_and_stretches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "STRETCH", 7)
    codec = bpe.Codec(MULTI, public_tokenizers.PATTERN)
    for text in invented(5):
        assert codec.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("ranks", [{b"a": 0}, {bytes([b]): b + 1 for b in range(256)}])
def test_ranks_with_gaps_are_refused(ranks):
    with pytest.raises(ValueError):
        bpe.model_proto(ranks)


def test_round_trip_keeps_every_row(spark, library):
    docs = docs_of(spark, AWKWARD, extra=True)
    found = bpe.round_trip(docs, MULTI, public_tokenizers.PATTERN).collect()
    want = sorted((repr(r[0]), tuple(library.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in docs.collect())
    assert sorted((repr(r["doc_id"]), tuple(r["ids"]), bytes(r["decoded"])) for r in found) == want
    assert bpe.round_trip(docs.limit(0), MULTI, public_tokenizers.PATTERN).collect() == []


def test_counts_equal_the_library(spark):
    tokenizer = token_counts.load(PLAIN)
    docs = docs_of(spark, AWKWARD + random_texts(50, 2), extra=True)
    found = token_counts.token_counts(docs, PLAIN, limit=3, chunk=40, overlap=4).collect()
    want = []
    for row in docs.collect():
        text = row[1] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        want.append((repr(row[0]), len(text.encode()), n, n > 3))
    assert sorted((repr(r[0]), *r[1:]) for r in found) == sorted(want)
    assert token_counts.token_counts(docs.limit(0), PLAIN).collect() == []


@pytest.mark.parametrize("chunk,overlap", [(16, 2), (50, 10), (400, 64)])
def test_chunks_of_any_size_give_the_whole_count(chunk, overlap):
    tokenizer = token_counts.load(PLAIN)
    texts = random_texts(300, 3) + [" ".join(random_texts(12, s)) for s in range(40)]
    texts += ["x" * 1_000, " " * 500 + "y", "ab" * 300 + " cd" * 300, "<|endoftext|>" * 30, "中" * 200, "a  b" * 200, "\n" * 90 + "z " * 50]
    for text in texts:
        assert token_counts.count_long(tokenizer, text, chunk, overlap) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def words_of(text: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_base_places_equal_brute_force(spark):
    draw = random.Random(4)
    parts = ["the", "under", "MIT", "license", "apache", "License,", "version", "2", "2.0", "cc", "by-nc", "by", "nc", "é", "中", "-", "under the MIT license"]
    texts = AWKWARD + [" ".join(draw.choice(parts) for _ in range(draw.randrange(40))) for _ in range(300)]
    docs = docs_of(spark, texts, extra=True)
    for row in license_scan.license_scan(docs.filter("doc_id is not null"), "doc_id").collect():
        words = words_of(texts[row["doc_id"]] or "")
        want = []
        for phrase, label in BASE.items():
            p = phrase.decode().split(" ")
            want += [(i, i + len(p) - 1, label, 1.0) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        assert row["n_words"] == len(words)
        assert [tuple(s) for s in row["base_places"]] == sorted(want)


def test_rules_find_statements_and_longer_places_hide_shorter_ones():
    scan = license_scan.Scanner().scan
    labels = lambda text: [p[2] for p in scan(text.encode())[2]]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("GNU Lesser General Public License v3") == ["lgpl-3.0"]
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == ["bsd-3-clause"]
    assert labels("Licensed under CC BY-NC-SA 4.0") == ["cc-by-nc-sa"]
    assert labels("placed in the public domain. MIT License") == ["public-domain", "mit"]
    assert labels("Er fuhr mit der Bahn, version 2, ohne Lizenz.") == []
    assert len(RULES) > 200


def test_a_place_goes_only_inside_one_of_its_priority_or_higher():
    def rule(number, priority, expression):
        return Rule(number, str(number), priority, 0.5, (frozenset([b"b"]),), re.compile(expression))

    rules = [rule(0, 2, rb"(?<= )b c(?= )"), rule(1, 1, rb"(?<= )a b c d(?= )"), rule(2, 1, rb"(?<= )c d(?= )"), rule(3, 1, rb"(?<= )b(?= )"), rule(4, 1, rb"(?<= )a b c d(?= )")]
    scanner = license_scan.Scanner(rules, {})
    assert [(p[:3]) for p in scanner.scan(b"a b c d e")[2]] == [(0, 3, "1"), (1, 2, "0")]


def spoken(draw: random.Random, parsed) -> str:
    """A random text that an expression matches."""
    out = ""
    for kind, value in parsed:
        match str(kind):
            case "LITERAL":
                out += chr(value)
            case "IN":
                one, of = draw.choice(value)
                out += draw.choice("12") if str(one) == "CATEGORY" else chr(draw.randint(*of) if str(one) == "RANGE" else of)
            case "ANY":
                out += draw.choice("ab ")
            case "MAX_REPEAT" | "MIN_REPEAT":
                least, most, inner = value
                out += "".join(spoken(draw, inner) for _ in range(draw.randint(least, min(most, least + 3))))
            case "SUBPATTERN":
                out += spoken(draw, value[3])
            case "BRANCH":
                out += spoken(draw, draw.choice(value[1]))
            case "ASSERT" | "ASSERT_NOT":
                pass
            case _:
                raise AssertionError(kind)
    return out


def test_keywords_skip_only_rules_that_cannot_match():
    draw = random.Random(8)
    scanner = license_scan.Scanner()
    every = license_scan.Scanner([replace(r, keywords=(frozenset([b"everywhere"]),)) for r in RULES])
    texts = [spoken(draw, _parser.parse(r.pattern.pattern.decode())) for r in RULES for _ in range(30)]
    parts = ["gplv3", "GPLv2", "gpl3", "LGPLv2.1", "lgpl3", "AGPLv3", "MPL2", "mplv1.1", "EPLv2", "EUPLv1.2", "CDDL1", "Licence:", "license", "under the", "released under", "MIT", "is", "the", "2", "1", "ISC"]
    texts += [" ".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(500)]
    for at in range(0, len(texts), 3):
        text = f" everywhere {' and so '.join(texts[at : at + 3])} ".encode()
        assert scanner.scan(text) == every.scan(text)


@pytest.mark.parametrize("rule", RULES, ids=lambda r: f"{r.number}-{r.label}")
def test_each_rule_finds_what_no_other_does(rule):
    """Without the rule some place of a text that it matches is missed, or gets another label or confidence."""
    draw = random.Random(rule.number)
    rest = license_scan.Scanner([r for r in RULES if r.number != rule.number])
    scanner = license_scan.Scanner()
    for _ in range(60):
        text = f" {spoken(draw, _parser.parse(rule.pattern.pattern.decode())).strip()} ".encode()
        if scanner.scan(text)[2] != rest.scan(text)[2]:
            return
    raise AssertionError(rule)


def test_joined_versions_and_both_spellings_are_found():
    scan = license_scan.Scanner().scan
    labels = lambda text: [p[2] for p in scan(text.encode())[2]]
    for name, label in [("GPLv3", "gpl-3.0"), ("LGPLv2.1", "lgpl-2.1"), ("AGPLv3", "agpl-3.0"), ("MPL2", "mpl-2.0")]:
        assert labels(f"licensed under the {name}") == [label]
    assert labels("Licence: MIT") == ["mit"]


def test_many_places_equal_pairwise_containment():
    draw = random.Random(5)
    places = [(-draw.randint(1, 3), a := draw.randrange(60), a + draw.randrange(9), n, str(n), 0.5) for n in range(400)]
    def hidden(p):
        return any(
            q is not p and q[1] <= p[1] and p[2] <= q[2]
            and (q[0] < p[0] or q[0] == p[0] and (q[1:3] != p[1:3] or q[3] < p[3]))
            for q in places
        )
    want = sorted((p[1], p[2], p[4], p[5]) for p in places if not hidden(p))
    assert license_scan.uncontained(places) == want


def test_scan_of_nothing(spark):
    assert license_scan.license_scan(docs_of(spark, []).limit(0)).collect() == []


def test_automaton_knows_exactly_the_substrings():
    draw = random.Random(6)
    text = [draw.randint(1, 3) for _ in range(60)]
    table_ = language_id.suffix_automaton(text, 4)
    substrings = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, min(61, i + 7))}
    for length in range(1, 5):
        for _ in range(200):
            word = tuple(draw.randint(1, 3) for _ in range(length))
            state = 0
            for c in word:
                state = table_[state, c] if state >= 0 else -1
            assert (state >= 0) == (word in substrings)


def phrases(text: str, sample: str) -> int:
    """The number of longest phrases of a text, block by block."""
    n = 0
    for at in range(0, len(text), language_id.BLOCK):
        block = text[at : at + language_id.BLOCK]
        n, phrase = n + 1, ""
        for c in block:
            if phrase + c in sample:
                phrase += c
            else:
                n, phrase = n + 1, c if c in sample else ""
    return n


def test_phrases_equal_a_search_in_the_samples(monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", 50)
    texts = [language_id.normalise(t) for t in invented(30) if t]
    samples = {"a": texts[0] + " " + texts[1], "b": texts[2], "c": "中文"}
    known = language_id.Languages.learn(samples)
    coder = known.coder()
    import numpy as np

    found = known.phrases([coder[np.array([ord(c) for c in t], dtype=np.uint32)] for t in texts])
    assert found.tolist() == [[phrases(t, samples[n]) for n in known.names] for t in texts]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from driftline.llm.queries import op10_language_id

    found = {r["doc_id"]: r for r in op10_language_id(spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in docs.collect() if found[r["doc_id"]]["held_out"]]
    right = sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert len(found) == docs.count() and len(held) > 100
    assert right / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_languages_of_awkward_texts(spark):
    docs = docs_of(spark, AWKWARD + ["12 34", "½ ²", "the cat sat on the mat " * 20], extra=True)
    labelled = table(spark, [(1, "the cat sat on the mat and the dog", "en", "s", 1), (2, "der hund und die katze", "de", "s", 1), (3, None, "fr", "s", 1), (4, "x", None, "s", 1)])
    languages = language_id.learn(labelled)
    assert languages.names == ["de", "en"]
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, languages).collect() if r["doc_id"] is not None}
    n = len(AWKWARD)
    assert [found[i] for i in (0, 1, 2, 3, n, n + 1)] == ["und"] * 6
    assert found[n + 2] == "en" and found[4] != "und"
    nothing = language_id.learn(labelled.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), languages).collect() == []


def test_only_texts_in_no_language_are_dropped(spark):
    draw = random.Random(7)
    noise = "".join(draw.choice("bcdfghjklmnpqrstvwxyzßüäöéè") for _ in range(3_000))
    prose = "the cat sat on the mat and the dog lay by the door of the old house"
    docs = docs_of(spark, [prose, noise, noise[:50], "", None, "42"])
    languages = language_id.learn(table(spark, [(1, prose, "en", "s", 1)]))
    kept = [r["doc_id"] for r in language_id.keep_known(docs, languages).collect()]
    assert sorted(k for k in kept if k is not None) == [0, 0, 2] and kept.count(None) == 1
    assert language_id.keep_known(docs, languages).columns == docs.columns


def many_characters(first: int, n: int, seed: int) -> list[str]:
    """Texts in a script of ``n`` characters, of words of one to three of them, some far commoner than others."""
    draw = random.Random(seed)
    words = ["".join(chr(first + draw.randrange(n)) for _ in range(draw.randint(1, 3))) for _ in range(1_500)]
    shares = [1 / (i + 1) for i in range(len(words))]
    return ["".join(draw.choices(words, shares, k=400)) for _ in range(60)]


def test_all_characters_of_the_samples_are_known(spark):
    scripts = {"en": invented(30), "zh": many_characters(0x4E00, 2_000, 1), "ko": many_characters(0xAC00, 1_800, 2)}
    rows = [(i, t, lang, "s", len(t)) for lang, texts in scripts.items() for i, t in enumerate(texts[:-10])]
    languages = language_id.learn(table(spark, rows))
    assert all(languages.different[languages.names.index(n)] > 1_000 for n in ("ko", "zh"))
    held = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate((t, lang) for lang, texts in scripts.items() for t in texts[-10:])]
    draw = random.Random(9)
    noise = ["".join(chr(0x4E00 + draw.randrange(2_000)) for _ in range(600)), "".join(draw.choice("bcdfghjklmnpqrstvwxyzßüäöéè") for _ in range(3_000))]
    docs = table(spark, held + [(100 + i, t, None, "s", len(t)) for i, t in enumerate(noise)])
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, languages).collect()}
    assert all(found[i] == lang for i, _, lang, _, _ in held)
    assert {r["doc_id"] for r in language_id.keep_known(docs, languages).collect()} == {i for i, *_ in held}


def test_phrases_of_wide_scripts_equal_a_search_in_the_samples():
    import numpy as np

    texts = [*many_characters(0x4E00, 400, 3)[:4], *invented(4), "\u0e01\u0e02"]
    samples = {"a": texts[0] + " " + texts[4][:300], "b": texts[1], "c": texts[5]}
    known = language_id.Languages.learn(samples)
    assert len(known.alphabet) > language_id.ALPHABET
    coder = known.coder()
    plain = [language_id.normalise(t) for t in texts]
    found = known.phrases([coder[np.array([ord(c) for c in t], dtype=np.uint32)] for t in plain])
    assert found.tolist() == [[phrases(t, samples[n]) for n in known.names] for t in plain]


def test_digests_of_the_contract(spark, library):
    from driftline.llm.queries import op4_bpe

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for row in op4_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == sha256(texts[row["doc_id"]].encode()).hexdigest()
