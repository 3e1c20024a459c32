"""Exact copies, near copies, lines and fingerprints."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from fixtures import AWKWARD, docs_of, invented, rows_of, table
from pyspark.sql import functions as F

from driftline.llm import columns, exact_dedup, fingerprints, line_dedup, near_dedup
from driftline.llm.components import components
from driftline.llm.tables import byte_at, byte_table


def last(key):
    """Null keys come after all others."""
    return (key is None, key or 0)


def exact_brute(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), last(key), key))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:2])
        for i, m in enumerate(members):
            out.append((m[2], members[0][2], len(members), i == 0, sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def short_digest(content):
    return F.substring(F.sha2(content, 256), 1, 1)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, short_digest])
@pytest.mark.parametrize("salts", [1, 3])
def test_exact_groups_equal_brute_force(spark, digest, salts):
    texts = AWKWARD + ["a b", "ab", "a\tb ", " ab", "AB"] + invented(60)
    docs = docs_of(spark, texts, extra=True).repartition(5)
    found = rows_of(exact_dedup.exact_dedup(docs, digest=digest, salts=salts))
    assert found == exact_brute([(r[0], r[1]) for r in docs.collect()])


def test_a_group_that_holds_most_rows(spark):
    rows = [(i, "same  text" if i % 3 else f"other {i}", "en", "s", 1) for i in range(6_000)]
    docs = table(spark, rows).repartition(7)
    assert rows_of(exact_dedup.exact_dedup(docs, salts=4)) == exact_brute([(r[0], r[1]) for r in rows])


def test_no_rows(spark):
    none = docs_of(spark, []).limit(0)
    assert exact_dedup.exact_dedup(none).collect() == []
    assert near_dedup.near_dedup(none).collect() == []
    assert line_dedup.dedup_lines(none).collect() == []
    words = fingerprints.lexicon(none)
    assert len(words) == 0 and fingerprints.fingerprint(none, words).collect() == []
    assert fingerprints.compare_with_next(none, words).collect() == []


def near_brute(rows, least=0.8):
    """The classes of rows (key, text), as sorted lists of row numbers."""
    sets = [near_dedup.shingles(near_dedup.words(t or "")) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and near_dedup.similarity(sets[i], sets[j]) >= least:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_near_classes_equal_brute_force(spark):
    texts = AWKWARD + invented(150, seed=2, words=300) + ["one two", "One, two!", "three"]
    docs = docs_of(spark, texts, extra=True).repartition(3)
    rows = [(r[0], r[1]) for r in docs.collect()]
    roots = near_brute(rows)
    least = {root: min((rows[i][0] for i, r in enumerate(roots) if r == root), key=last) for root in roots}
    sizes = Counter(roots)
    want = sorted((repr(key), repr(least[root]), sizes[root]) for (key, _), root in zip(rows, roots, strict=True))
    found = near_dedup.near_dedup(docs).collect()
    assert sorted((repr(r["doc_id"]), repr(r["class_id"]), r["class_size"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(sizes)
    assert all(r["kept"] is False or r["doc_id"] == r["class_id"] for r in found)


def test_a_large_group_of_near_copies(spark):
    """Copies of one text, each with other words changed: most pairs are less alike than each is to the original."""
    import random

    draw = random.Random(3)
    origin = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(origin)]
    for i in range(250):
        words = list(origin)
        for at in draw.sample(range(150), 2):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    found = near_dedup.near_dedup(table(spark, rows)).collect()
    roots = near_brute([(r[0], r[1]) for r in rows])
    assert len(set(roots)) == 1
    assert {(r["class_id"], r["class_size"]) for r in found} == {(0, 251)}


def probability_jaccard(a, b):
    """By its definition: for each common shingle the sum over all shingles of the larger ratio."""
    every = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in a.keys() & b.keys())


def test_similarity_is_probability_jaccard():
    import random

    draw = random.Random(4)
    for _ in range(300):
        a, b = ({s: draw.choice([1, 1, 2, 5]) for s in draw.sample(range(12), draw.randrange(1, 10))} for _ in range(2))
        assert near_dedup.similarity(a, b) == pytest.approx(probability_jaccard(a, b))
        both = sum(min(a[s] / sum(a.values()), b[s] / sum(b.values())) for s in a.keys() & b.keys())
        assert near_dedup.similarity(a, b) <= both + 1e-9  # what the rarest shingles rely on
        u, v = (1 - sum(x[s] for s in a.keys() & b.keys()) / sum(x.values()) for x in (a, b))
        if u < 1:
            assert near_dedup.similarity(a, b) <= 1 / (1 / (1 - u) + 1 / (1 - v) - 1) + 1e-9  # and what comes before them
    assert near_dedup.similarity({}, {}) == 0.0


def repeated_passages(n):
    """Texts of which some passages are repeated, and copies with other numbers of repeats or with words changed."""
    import random

    draw = random.Random(12)
    texts = []
    for _ in range(n):
        passage, rest = ([f"w{draw.randrange(5_000)}" for _ in range(draw.randrange(6, 40))] for _ in range(2))
        for _ in range(4):
            again, own = draw.choice([1, 2, 8]), list(rest)
            if draw.random() < 0.5:
                own[draw.randrange(len(own))] = f"v{draw.randrange(5_000)}"
            texts.append(" ".join(passage * again + own))
    return texts


def test_weights_count_in_classes(spark):
    texts = repeated_passages(60)
    rows = [(i, t) for i, t in enumerate(texts)]
    roots = near_brute(rows)
    found = near_dedup.near_dedup(docs_of(spark, texts)).filter("doc_id is not null").collect()
    least = {root: min(i for i, r in enumerate(roots) if r == root) for root in roots}
    assert {r["doc_id"]: r["class_id"] for r in found} == {i: least[root] for i, root in enumerate(roots)}
    assert 60 < len(set(roots)) < 240


def test_texts_less_alike_than_linked_ones_need_no_pairs(spark, monkeypatch):
    """A group of copies of a missing origin: what is not linked is told apart by rare shingles, without all pairs."""
    import random

    draw = random.Random(5)
    origin = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(200):
        words = list(origin)
        for at in draw.sample(range(150), 5):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    texts += [t + " more" for t in texts[:5]]
    tested = []
    whole = near_dedup._verified

    def counted(pairs, *rest):
        tested.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    roots = near_brute([(i, t) for i, t in enumerate(texts)])
    found = near_dedup.near_dedup(table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()
    assert len({r["class_id"] for r in found}) == len(set(roots)) == 200
    assert sum(tested) < 205 * 204 / 2 / 10


def test_rare_shingles_hold_a_common_one_of_similar_texts(spark):
    texts = repeated_passages(20)
    table_ = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "node binary, text string")
    held = defaultdict(set)
    for r in near_dedup._rare_shingles(table_, 0.8).collect():
        held[r["node"][0]].add(r["shingle"])
    sets = [near_dedup.shingles(near_dedup.words(t)) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if 0.8 <= near_dedup.similarity(sets[i], sets[j])]
    assert len(alike) > 20 and all(held[i] & held[j] for i, j in alike)


def test_keep_one_stands_clashing_columns(spark):
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "other words of a text"], extra=True)
    rows = [(*r, "T", 1, 2, "n") for r in docs.collect()]
    kinds = [f"`{n}` {k.dataType.simpleString()}" for n, k in zip(docs.columns, docs.schema, strict=True)]
    clashing = spark.createDataFrame(rows, ", ".join([*kinds, "`TEXT` string, `_key` int, `_row` int, `key` string"]))
    kept = near_dedup.keep_one(clashing)
    assert kept.columns == clashing.columns
    got = [tuple(r) for r in kept.collect()]
    assert set(got) <= set(rows) and {r[0] for r in got} >= {0, 2}


def test_registers_agree_as_often_as_probability_jaccard():
    words = [f"w{i}" for i in range(60)]
    texts = [words * 3, words[:45] + [f"v{i}" for i in range(15)] + words[:30]]
    sets = [near_dedup.shingles(t) for t in texts]
    held = near_dedup.prob_minhash(*near_dedup.weighted_shingles(texts), 2, registers=20_000)
    assert abs((held[0] == held[1]).mean() - near_dedup.similarity(*sets)) < 0.02


def repeated(i: int, times: int, both: bool) -> list[str]:
    """Two texts of 200 common shingles; the rest is a passage repeated in each or in one of them."""
    common = [f"c{i}x{j}" for j in range(204)]
    passages = [[f"p{i}y{j}" for j in range(18 if both else 36)] * times, [f"q{i}y{j}" for j in range(18)] * times if both else []]
    return [" ".join(common + p) for p in passages]


def test_registers_agree_by_what_links_are_verified_by():
    for both in (True, False):
        texts = [near_dedup.words(t) for t in repeated(0, 300, both)]
        held = near_dedup.prob_minhash(*near_dedup.weighted_shingles(texts), 2, registers=20_000)
        want = near_dedup.similarity(*(near_dedup.shingles(t) for t in texts))
        assert abs((held[0] == held[1]).mean() - want) < 0.02


def test_pairs_with_repeated_passages_equal_brute_force(spark):
    # a passage that weighs more than all else makes texts differ, once it does not
    texts = [t for i in range(30) for t in repeated(i, 300 if i % 3 == 0 else 1, both=i % 2 == 0)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(table(spark, rows)).collect()}
    roots = near_brute([(r[0], r[1]) for r in rows])
    assert len(set(roots)) == 40
    assert found == {i: roots.index(root) for i, root in enumerate(roots)}


def test_registers_follow_the_weights():
    owner = np.array([0, 0, 1, 1])
    h = np.array([7, 8, 7, 9], dtype=np.uint64)
    weight = np.array([1.0, 3.0, 1.0, 1.0])
    held = near_dedup.prob_minhash(owner, h, weight, 2, registers=20_000)
    assert abs((held[0] == 8).mean() - 0.75) < 0.02 and abs((held[1] == 7).mean() - 0.5) < 0.02
    # the shares 1/4 and 1/2 of what they have in common: 1 / (1/0.25 x ...) by the definition of probability Jaccard
    x, y = np.array([0.25, 0.75, 0]), np.array([0.5, 0, 0.5])
    want = 1 / sum(max(a / x[0], b / y[0]) for a, b in zip(x, y, strict=True))
    assert abs((held[0] == held[1]).mean() - want) < 0.02


def test_keep_one_of_each(spark):
    texts = ["a b c d e f", "a b c d e f", "A b c d e f!", "other words here", "", ""]
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)] * 2)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5]


@pytest.mark.parametrize("shape", ["chain", "star", "mixed"])
def test_components(spark, shape):
    n = 60
    links = {"chain": [(i, i + 1) for i in range(n)], "star": [(n - i, 0) for i in range(n)], "mixed": [(i, i + 7) for i in range(n)] + [(3, 3)]}[shape]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert found == {x: find(x) for x in parent}


def lines_brute(rows, top=4, bottom=5):
    """For each row (key, text): the text that is left and the number of removed lines."""
    order = sorted({(last(k), k, t) for k, t in rows if t is not None}, key=lambda r: (r[0], r[2]))
    seen: list[set] = []
    out = {}
    for _, key, text in order:
        kept, n = [], 0
        for line in text.split("\n"):
            words = {w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w}
            if words and any((c := len(words & s)) * bottom >= (len(words) + len(s) - c) * top for s in seen):
                n += 1
            else:
                kept.append(line)
            if words:
                seen.append(words)
        out[key, text] = ("\n".join(kept), n, len(text.split("\n")))
    return out


@pytest.mark.parametrize("rows_sent", [0, 500_000])
def test_lines_equal_brute_force(spark, monkeypatch, rows_sent):
    monkeypatch.setattr(columns, "BROADCAST_ROWS", rows_sent)
    texts = [t for t in AWKWARD if t is None or len(t) < 10_000] + invented(80, seed=4, words=120) + ["B a\nc d e f g\nc d e f\nc d e", "a b"]
    # rows of one key in the order of a hash, which brute force does not know: keys are distinct here
    rows = [(i, t, "en", f"s{i}", 1) for i, t in enumerate(texts)] + [(None, "a b\nlast of all", "en", None, 1)]
    docs = table(spark, rows).repartition(3)
    want = lines_brute([(r[0], r[1]) for r in rows])
    found = line_dedup.dedup_lines(docs, others=("source",)).collect()
    assert len(found) == len(rows)
    assert sum(r["n_removed"] for r in found) > 50
    for r in found:
        old = next(x for x in rows if x[0] == r["doc_id"])
        if old[1] is None:
            assert (r["text"], r["n_lines"], r["n_removed"]) == (None, 0, 0)
        else:
            assert (r["text"], r["n_removed"], r["n_lines"]) == want[old[0], old[1]]
        assert r["source"] == old[3]


def test_repeated_rows_and_clashing_names_in_lines(spark):
    docs = docs_of(spark, ["one two three four\nfive", "one two three four\nsix seven"], extra=True)
    found = rows_of(line_dedup.dedup_lines(docs).select("doc_id", "text", "n_removed"))
    assert found.count((0, "one two three four\nfive", 0)) == 2
    assert found.count((1, "six seven", 1)) == 2


@pytest.mark.parametrize("top,bottom", [(4, 5), (1, 2), (9, 10)])
def test_prefix_filter_loses_no_pair(top, bottom):
    """What two similar sets must share, for all small sizes."""
    alike = line_dedup.Similarity(top, bottom)
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    cases = [(n, m, c) for n in range(1, 14) for m in range(1, 14) for c in range(min(n, m) + 1) if c * bottom >= (n + m - c) * top]
    rows = spark.createDataFrame(cases, "n int, m int, c int").select(
        "n", "m", "c", alike.prefix(F.col("n")).alias("p"), alike.prefix(F.col("m")).alias("q"),
        alike.common(F.col("n"), F.col("m")).alias("least"), alike.lengths(F.col("n"), F.col("m")).alias("fit"),
    ).collect()
    for r in rows:
        assert r["fit"] and r["c"] >= r["least"]
        if r["c"] < max(r["n"], r["m"]):
            # the last c words of either may be the common ones: the first of them is still in the prefix
            assert r["n"] - r["c"] < r["p"] and r["m"] - r["c"] < r["q"]


def test_byte_tables(spark):
    values = spark.range(0, 5_000, 7).select(F.col("id").alias("place"), (F.col("id") % 128).alias("value"))
    made = byte_table(values, 8_192)
    assert list(made) == [i % 128 if i < 5_000 and i % 7 == 0 else 0 for i in range(8_192)]
    found = spark.range(8_192).select(byte_at(made, F.col("id")).alias("b")).collect()
    assert [r["b"] for r in found] == list(made)


def test_lexicon_is_the_band(spark):
    texts = invented(40) + AWKWARD
    docs = docs_of(spark, texts)
    n = docs.count()
    counts = Counter(int(h) for r in docs.collect() for h in fingerprints.terms(r["text"] or ""))
    want = sorted(t for t, c in counts.items() if 0.05 * n <= c <= int(0.3 * n))
    assert fingerprints.lexicon(docs, rarest=0.05, commonest=0.3).tolist() == want


def test_fingerprints_of_equal_near_and_other_texts(spark):
    texts = invented(60, words=400) + AWKWARD + ["x y z", "x y z"]
    docs = docs_of(spark, texts, extra=True)
    words = fingerprints.lexicon(docs)
    found = defaultdict(set)
    for r in fingerprints.fingerprint(docs, words).collect():
        if r["doc_id"] is not None:
            found[texts[r["doc_id"]] or ""].add(r["fingerprint"])
    assert all(len(f) == 1 for f in found.values())
    assert set(found[""].pop()) == {"0"}


def test_subsets_hash_what_they_hold():
    """Every byte against a plain loop over the sorted terms."""
    texts = invented(6)
    words = np.sort(np.unique(np.concatenate([fingerprints.terms(t) for t in texts[:3]])))
    made = fingerprints.Fingerprints(words).of(texts)
    mask = 2**64 - 1
    mix = lambda x: int(fingerprints._mix(np.array([x], dtype=np.uint64))[0])
    for text, row in zip(texts, made, strict=True):
        own = sorted(int(t) for t in fingerprints.terms(text))
        known = [t for t in own if t in set(words.tolist())]
        parts = [(known, fingerprints.SUBSETS, 0), (own, fingerprints.WHOLE_SUBSETS, fingerprints.BAND_BYTES)]
        for of, subsets, begin in parts:
            for j in range(0, subsets, 5):
                for level, size in enumerate(fingerprints.SIZES):
                    held = [t for t in of if mix(t ^ int(fingerprints._SEEDS[j])) % 2**size == 0]
                    total = sum(mix((t + 0x9E3779B97F4A7C15) & mask) * (2 * i + 1) for i, t in enumerate(held)) & mask
                    want = (mix(total) >> 32) % 255 + 1 if held else 0
                    assert row[begin + level * subsets + j] == want


def test_neighbours_over_many_ranges(spark):
    texts = AWKWARD + invented(120)
    rows = [((i * 7919) % 5_003 - 900, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "no key", "en", "s", 1), (-900, "tie", "en", "s", 1)]
    docs = table(spark, rows).repartition(6)
    words = fingerprints.lexicon(docs)
    found = fingerprints.compare_with_next(docs, words).collect()
    order = sorted(((last(k), t or "", k) for k, t, *_ in rows), key=lambda r: r[:2])
    want = []
    for i, (_, text, key) in enumerate(order):
        other = order[(i + 1) % len(order)][1]
        n = len(text) // 4
        want.append((repr(key), len(text), sha256((text[: len(text) - n] + other[:n]).encode()).hexdigest()))
    assert sorted((repr(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    long = [r for r in found if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.2


def test_one_document_is_its_own_neighbour(spark):
    docs = table(spark, [(5, "abcdefgh", "en", "s", 1)])
    row = fingerprints.compare_with_next(docs, fingerprints.lexicon(docs)).first()
    assert row["edited_sha256"] == sha256(b"abcdefab").hexdigest() and row["near_next"] == 1.0


def test_edited_copies_of_a_large_group_stay_alike(spark):
    """Copies on a third of all rows have no term in the band, the texts that follow them have."""
    words = [f"word{i}" for i in range(120)]
    rows = [(i, " ".join(words) if i % 3 == 0 else " ".join(f"t{(i * 131 + j * 17) % 4_999}" for j in range(100)), "en", "s", 1) for i in range(300)]
    docs = table(spark, rows)
    known = fingerprints.lexicon(docs)
    assert len(known) and not np.isin(fingerprints.terms(rows[0][1]), known).any()
    found = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs, known).collect()}
    near = [found[i]["near_edited"] for i in range(0, 300, 3)]
    assert np.mean(near) > 0.4 and min(near) > 0.1
    assert max(found[i]["near_next"] for i in range(0, 300, 3)) < 0.1
    assert len({found[i]["fingerprint"] for i in range(0, 300, 3)}) == 1


def test_a_pair_is_compared_by_all_terms_if_either_is_bare():
    a, b = " ".join(f"a{i}" for i in range(90)), " ".join([f"a{i}" for i in range(90)] + ["rare"])
    left, right = fingerprints.Fingerprints(fingerprints.terms("rare")).of([a, b])[:, None]
    assert not left[0, : fingerprints.BAND_BYTES].any() and right[0, : fingerprints.BAND_BYTES].any()
    assert fingerprints.likeness(left, right)[0] == fingerprints.likeness(right, left)[0] > 0.8


def test_likeness_follows_from_two_fingerprints(spark):
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(invented(50) + ["", "x", "x y"])])
    found = fingerprints.compare_with_next(docs, fingerprints.lexicon(docs)).orderBy("doc_id").collect()
    rows = lambda name: np.array([list(bytes.fromhex(r[name])) for r in found], dtype=np.uint8)
    own = rows("fingerprint")
    assert fingerprints.likeness(own, rows("edited_fingerprint")).tolist() == [r["near_edited"] for r in found]
    assert fingerprints.likeness(own, np.roll(own, -1, axis=0)).tolist() == [r["near_next"] for r in found]
