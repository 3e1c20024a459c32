"""Merge-queue BPE, fill-in-middle and the conversation trie, against the library and plain Python."""

import json
import math
import random
import re
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import numpy as np
import public_tokenizers
import pytest
from fixtures import AWKWARD, docs_of, invented
from test_texts import random_texts
from tokenizers import Tokenizer

from driftline.llm import infill, merge_queue, prefix_trie, queries

PLAIN = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


# --- merge queue -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PLAIN)


def texts_with_specials(n: int) -> list[str]:
    draw = random.Random(3)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "word", "\n", "é"]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(library):
    codec = merge_queue.Codec(PLAIN, public_tokenizers.PATTERN)
    for text in [t or "" for t in AWKWARD] + random_texts(3_000, 5) + invented(20) + texts_with_specials(300):
        ids = codec.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_parts_of_characters_decode_as_the_library_does(library):
    codec = merge_queue.Codec(PLAIN, public_tokenizers.PATTERN)
    draw = random.Random(8)
    for _ in range(200):
        ids = [draw.randrange(50_257) for _ in range(draw.randrange(6))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_forgetting_and_stretches_change_no_ids(library, monkeypatch):
    for name, value in {"REMEMBERED": 3, "LONGEST": 2, "AT_ONCE": 50, "STRETCH": 7}.items():
        monkeypatch.setattr(merge_queue, name, value)
    codec = merge_queue.Codec(PLAIN, public_tokenizers.PATTERN)
    for text in invented(5) + texts_with_specials(20):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def naive_merge(symbols, merges, data):
    ids = [symbols[b] for b in data]
    while True:
        found = [(merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges]
        if not found:
            return ids
        i = min(found)[1]
        ids[i : i + 2] = [merges[ids[i], ids[i + 1]][1]]


def test_the_queue_merges_as_a_scan_for_the_lowest_rank_does():
    symbols = [b % 3 for b in range(256)]
    merges = {(0, 0): (2, 3), (3, 3): (0, 4), (0, 1): (1, 5), (5, 2): (3, 6), (4, 0): (4, 7), (1, 1): (5, 8), (8, 8): (6, 9)}
    queue = merge_queue.MergeQueue(symbols, merges)
    draw = random.Random(2)
    for _ in range(2_000):
        data = bytes(draw.choice(b"\0\0\1\2") for _ in range(draw.randrange(14)))
        assert queue.merge(data) == naive_merge(symbols, merges, data)


def test_the_longest_added_token_counts(tmp_path):
    with open(PLAIN, encoding="utf-8") as lines:
        description = json.load(lines)
    first = description["added_tokens"][0]
    description["added_tokens"] = [first | {"id": 50_256, "content": "<a>"}, first | {"id": 50_257, "content": "<a><b>"}]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(description), encoding="utf-8")
    codec = merge_queue.Codec(str(path), public_tokenizers.PATTERN)
    assert codec.encode("<a><b><a>") == Tokenizer.from_file(str(path)).encode("<a><b><a>", add_special_tokens=False).ids


def test_encoding_keeps_every_row(spark, library):
    docs = docs_of(spark, AWKWARD + ["y" * 1_100_000 + " end"], extra=True)
    found = merge_queue.encode_and_decode(docs, PLAIN, public_tokenizers.PATTERN).collect()
    want = [(repr(r[0]), tuple(library.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in docs.collect()]
    assert sorted((repr(r["doc_id"]), tuple(r["ids"]), r["decoded"]) for r in found) == sorted(want)
    assert merge_queue.encode_and_decode(docs.limit(0), PLAIN, public_tokenizers.PATTERN).collect() == []


# --- fill in the middle ----------------------------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(key, text):
    text = text or ""
    digest = sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_forms_equal_plain_string_work(spark):
    odd = ["<P>", "a <S> b", "<M", "P> <", "< P><S", "<<S", " lead", "trail ", "é 😀\n\n中 文 "]
    texts = AWKWARD + odd * 6 + random_texts(300, 9) + invented(20) + ["<P>"] * 20
    docs = docs_of(spark, texts, extra=True)
    found = infill.fill_in_middle(docs).collect()
    want = [(r[0], *plain_infill(r[0], r[1])) for r in docs.collect()]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.limit(0)).collect() == []


def test_rotations_are_undone():
    draw = random.Random(6)
    for text in random_texts(500, 10):
        data = text.replace("<", "").encode()
        ends = [0, *infill.unit_ends(data)]
        first, second = sorted(int(draw.choice(ends)) for _ in range(2))
        for form in ("psm", "spm"):
            work = bytearray(data)
            infill.transform(work, form, first, second)
            assert len(work) == len(data) + 9
            infill.restore(work, form)
            assert work == data


# --- the trie of conversations ---------------------------------------------------------------------------------------


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [t[3:] for t in sorted(found)] for c, found in turns.items()}
    out = {}
    for c, own in turns.items():
        head = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:head] + own[head:]
    return out


def plain_trie(rows):
    members = defaultdict(list)
    convs = rebuilt(rows)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (
            (
                min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(children[node]), leaves[node], saved[node],
                sha256(",".join(str(c) for c in sorted(found) if len(convs[c]) == len(node)).encode()).hexdigest(),
            )
            for node, found in members.items()
        ),
        key=repr,
    )


def random_conversations(seed, n=150, longest=9):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-120, 420), n) + [100, 200]:
        for turn in range(draw.randrange(1, longest)):
            rows.append((c, turn if draw.random() < 0.95 else draw.choice([None, turn - 1]), draw.choice(["user", "bot", None]), draw.choice(["a", "bb", "é", None, ""])))
    return rows


def trie_of(spark, rows, **parts):
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS))
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.fixture
def small_parts(monkeypatch):
    for name, value in {"SHARD_TURNS": 40, "PIECE_TURNS": 4, "HOT_CHILDREN": 2}.items():
        monkeypatch.setattr(prefix_trie, name, value)


def test_trie_equals_plain_python(spark):
    rows = random_conversations(1)
    assert trie_of(spark, rows) == plain_trie(rows)


def test_shards_pieces_and_hot_parents_change_nothing(spark, small_parts):
    rows = random_conversations(2, longest=30)
    assert trie_of(spark, rows) == plain_trie(rows)


def test_one_conversation_and_one_beginning_hold_most_rows(spark, small_parts):
    long = [(7, t, "user", f"x{t % 3}") for t in range(500)]
    near = [(907, t, "user", f"x{t % 3}") for t in range(499)] + [(907, 499, "bot", "other")]
    copies = [(1000 + c, t, "user", f"y{t}") for c in range(80) for t in range(3)]
    begun = [(2000 + c, t, "user", "same" if t < 2 else f"z{c}") for c in range(40) for t in range(8)]
    repeated = [(3100, 1, "user", "again")] * 60 + [(3100, None, None, None)] * 30
    rows = long + near + copies + begun + repeated
    assert trie_of(spark, rows) == plain_trie(rows)


def test_conversations_with_nothing_in_them(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "no conversation")]) == []
    short = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 > 2)
    assert trie_of(spark, [(short, 1, "user", "gone")]) == plain_trie([(short, 1, "user", "gone")]) == [
        (short, 0, None, 1, 0, 1, 0, sha256(str(short).encode()).hexdigest())
    ]


def test_clashing_columns_are_left_out(spark):
    rows = [(1, 1, "user", "a", "x", 1, 2), (2, 1, "user", "a", "x", 1, 2)]
    table = spark.createDataFrame(rows, f"{CONVERSATIONS}, Text string, part int, pos int")
    found = sorted(map(tuple, prefix_trie.prefix_trie(table).collect()), key=repr)
    assert found == plain_trie([r[:4] for r in rows])


def test_slots_are_minimal_perfect_and_verified():
    draw = np.random.default_rng(4)
    for n in (0, 1, 2, 1_000, 20_000):
        digests = np.unique(draw.integers(0, 2**63, size=(n, 2)).astype(np.uint64), axis=0)
        table = prefix_trie.SlotTable(digests)
        assert sorted(table.slots(digests)) == list(range(len(digests)))
    with pytest.raises(ValueError):
        table.slots(np.array([[1, 2]], dtype=np.uint64))


@pytest.mark.parametrize("name", ["op11_merge_queue", "op12_fill_in_middle", "op13_prefix_trie"])
def test_queries_cover_their_tables(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    if name == "op13_prefix_trie":
        assert rows and sum(r["depth"] == 0 for r in rows) == 1
    else:
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
