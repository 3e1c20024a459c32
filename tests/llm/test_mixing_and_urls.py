"""Mixing by hash thresholds, and the URL filter."""

import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from fixtures import AWKWARD, docs_of, invented, table
from pyspark.sql import functions as F

from driftline.llm import mixing, url_filter
from driftline.llm.queries import URL_RULES
from driftline.llm.ranks import row_numbers

WEIGHTS = [3, 1, 2]


def fill(sizes: dict, weights=WEIGHTS, share=1.5, most=2.0) -> dict:
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        level = rest / max(1e-9, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and weight[s] * level > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_sums(spark):
    texts = AWKWARD + invented(300)
    docs = docs_of(spark, texts, extra=True).repartition(3)
    rows = docs.collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
        largest[r[3]] = max(largest[r[3]], words(r[1]))
    want = fill(sizes)
    found = mixing.mix(docs, WEIGHTS).collect()
    assert len(found) == len(rows)
    by_key = {r[0]: r for r in rows}
    for r in found:
        source = by_key[r["doc_id"]][3]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["doc_id"] is None or r["size"] == words(by_key[r["doc_id"]][1])
        if r["doc_id"] is not None:
            assert r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6 * max(1, want[source])
        taken[source] += r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= largest[source]
    again = mixing.mix(docs.repartition(5), WEIGHTS).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_nothing_to_mix(spark):
    docs = docs_of(spark, [])
    assert mixing.mix(docs.limit(0), WEIGHTS).collect() == []
    assert mixing.take_mix(docs.limit(0), WEIGHTS).collect() == []
    empty = table(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)])
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(empty, WEIGHTS).collect()] == [(0, 0.0, 0)] * 2


def test_rows_are_taken_as_often_as_the_mix_says(spark):
    docs = table(spark, [(i, t, "en", f"s{i % 4}", 1) for i, t in enumerate(invented(200))])
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs, WEIGHTS).collect()}
    got = defaultdict(int)
    taken = mixing.take_mix(docs, WEIGHTS)
    assert taken.columns == docs.columns
    for r in taken.collect():
        got[r["doc_id"]] += 1
    assert {k: n for k, n in want.items() if n} == dict(got)


def test_rows_without_a_key_and_equal_rows_are_dealt_one_by_one(spark):
    texts = invented(200)
    rows = [(i if i % 2 else None, t, "en", f"s{i % 2}", 1) for i, t in enumerate(texts)]
    rows += [(7, "one two three four", "en", "s1", 1)] * 90 + [(None, "five six", "en", None, 1)] * 70
    docs = table(spark, rows).repartition(3)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
        largest[r[3]] = max(largest[r[3]], words(r[1]))
    by_size = {sizes[s]: s for s in sizes}
    found = mixing.mix(docs, WEIGHTS).collect()
    for r in found:
        taken[by_size[r["source_size"]]] += r["taken"]
    for source, target in fill(sizes).items():
        assert abs(taken[source] - target) <= largest[source]
    assert Counter(map(tuple, mixing.mix(docs.repartition(7), WEIGHTS).collect())) == Counter(map(tuple, found))
    whole = mixing.take_mix(docs, WEIGHTS).collect()
    assert sum(words(r["text"]) for r in whole) == sum(taken.values())


def test_take_mix_stands_clashing_columns(spark):
    texts = invented(40)
    docs = docs_of(spark, texts, extra=True)
    names = [*docs.columns, "Source", "_key", "_row", "hash", "doc", "bucket"]
    rows = [(*r, "S", 1, 2, 3, "d", 4) for r in docs.collect()]
    kinds = [f"`{n}` {k.dataType.simpleString()}" for n, k in zip(docs.columns, docs.schema, strict=True)]
    clashing = spark.createDataFrame(rows, ", ".join([*kinds, "`Source` string, `_key` int, `_row` int, `hash` int, `doc` string, `bucket` int"]))
    taken = mixing.take_mix(clashing, WEIGHTS)
    assert taken.columns == names
    got = {tuple(r) for r in taken.collect()}
    assert got and got <= set(rows)


def test_words_equal_the_pattern(spark):
    texts = AWKWARD + ["  lead", "trail  ", "a\x0bb\x0cc", " ", "x y"]
    found = docs_of(spark, texts).select("text", mixing.word_count(F.col("text")).alias("n")).collect()
    assert all(r["n"] == words(r["text"]) for r in found)


def test_row_numbers_are_a_total_order(spark):
    draw = random.Random(8)
    values = [draw.randrange(50) for _ in range(500)]
    found = row_numbers(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), [F.col("v")]).collect()
    assert sorted(r["row_number"] for r in found) == list(range(500))
    assert [r["v"] for r in sorted(found, key=lambda r: r["row_number"])] == sorted(values)


URLS = [
    None, "", "no scheme", "://", "http://", "http://Example.ORG", "http://example.org/", "HTTP://A.B.Example.org/es/x?y#z",
    "https://example.org/en/12", "https://example.org/en/21", "x://notexample.org/es/1", "http://a.com/fr/1", "http://a.com/fr", "http://com/de/",
    "http://acom/de/", "http://u:p@h.org:80/a", "a://b://c/d", "http://x.org?q=/es/", "http://x.org#/y", "http://é.org/ü", "ftp://q.net/\nline",
    "http://example.org/es/", "http://example.org/es", "//x.org/",
]


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host_end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    path_end = min([i for i in (rest.find(c, host_end) for c in "?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:host_end])
    return host, rest[host_end:path_end]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "x", "y") for i, u in enumerate(URLS)], "page_id bigint, url string, html string, host string, Rule string")
    found = {r["page_id"]: r for r in url_filter.url_filter(pages, URL_RULES).collect()}
    assert len(found) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parts(url)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best.name if best else None)
        assert r["verdict"] == (best.verdict if best else r["verdict"]) and r["verdict"] in ("allow", "block")
        if not host + path:
            assert (r["verdict"], r["score"]) == ("allow", 0.0)


def plain_log_likelihood(train, text):
    """Witten-Bell by its definition, counted anew for every character."""
    order, start = url_filter.ORDER, url_filter._START * url_filter.ORDER
    padded = [start + t for t in train]

    def chance(c, context):
        after = Counter(t[i] for t in padded for i in range(order, len(t)) if t[i - len(context) : i] == context)
        if not after:
            return chance(c, context[1:]) if context else 1 / url_filter.ALPHABET
        shorter = chance(c, context[1:]) if context else 1 / url_filter.ALPHABET
        return (after[c] + len(after) * shorter) / (sum(after.values()) + len(after))

    whole = start + text
    return sum(math.log(chance(whole[i], whole[i - order : i])) for i in range(order, len(whole)))


def test_scores_equal_plain_counts(spark):
    draw = random.Random(9)
    ends = ["com/fr/", "com/de/", "org/", "net/", "example.org/es/"]
    urls = [f"http://{draw.choice('abc')}{draw.choice(['.', 'x.'])}{draw.choice(ends)}{draw.choice('pqr') * draw.randrange(4)}" for _ in range(60)]
    urls += [urls[0]] * 40 + ["http://net/" + "z" * 700]  # copies count once, the last one is too long to learn from
    rows = [(i, u) for i, u in enumerate(urls)]
    found = url_filter.url_filter(spark.createDataFrame(rows, "page_id bigint, url string"), URL_RULES).collect()
    texts = {(r["verdict"], r["host"] + r["path"]) for r in found if r["rule"]}
    is_held = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - (xxhash.xxh64_intdigest(t.encode(), 42) >> 63 << 64)
    train = {v: [t for w, t in texts if w == v and is_held(t) % url_filter.HELD_OUT] for v in ("allow", "block")}
    held = {v: [t for w, t in texts if w == v and not is_held(t) % url_filter.HELD_OUT] for v in ("allow", "block")}
    assert all(train.values()) and all(held.values())
    score = lambda t: (plain_log_likelihood(train["allow"], t) - plain_log_likelihood(train["block"], t)) / len(t)
    by_text = {r["host"] + r["path"]: r for r in found}
    for text in [t for t in by_text if len(t) < 100]:
        assert by_text[text]["score"] == pytest.approx(score(text))
    bound = url_filter.best_bound(*([score(t) for t in held[v]] for v in ("allow", "block")))
    assert all(r["verdict"] == ("allow" if r["score"] > bound else "block") for r in found if not r["rule"])


def test_no_pages_and_no_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (None, None)], "page_id bigint, url string")
    assert url_filter.url_filter(pages.limit(0), URL_RULES).collect() == []
    assert len(url_filter.url_filter(pages, []).collect()) == 2
    assert {r["rule"] for r in url_filter.url_filter(pages, URL_RULES).collect()} == {None}


def test_probabilities_of_a_context_add_up():
    counts = defaultdict(int)
    text = url_filter._START * url_filter.ORDER + "abracadabra"
    for i in range(url_filter.ORDER, len(text)):
        for k in range(url_filter.ORDER + 1):
            counts[text[i - k : i + 1]] += 1
    model = url_filter.Model(dict(counts))
    from math import exp

    for context in ("", "a", "br", "zz"):
        padded = url_filter._START * url_filter.ORDER + context
        total = 0.0
        for c in range(3, 3 + url_filter.ALPHABET - 5):
            total += exp(model.score(context + chr(c)) - model.score(context))
        assert total < 1.0 + 1e-9, padded
    seen = sum(exp(model.score("a" + c) - model.score("a")) for c in "abrcd")
    unseen = (url_filter.ALPHABET - 5) * exp(model.score("az") - model.score("a"))
    assert abs(seen + unseen - 1) < 1e-9


def test_models_tell_held_out_urls_apart(spark):
    draw = random.Random(9)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(8))
    rows = [(i, f"http://{word('abcde')}.org/{word('aeiou')}" if i % 2 else f"http://{word('vwxyz')}.com/de/{word('qxz')}") for i in range(800)]
    test = [(1_000 + i, f"http://{word('abcde')}.net/{word('aeiou')}" if i % 2 else f"http://{word('vwxyz')}.net/de/{word('qxz')}") for i in range(200)]
    pages = spark.createDataFrame(rows + test, "page_id bigint, url string")
    found = {r["page_id"]: r for r in url_filter.url_filter(pages, URL_RULES).collect()}
    right = sum((found[i]["verdict"] == "allow") == bool(i % 2) for i, _ in test)
    assert all(found[i]["rule"] is None for i, _ in test) and right > 190


@pytest.mark.parametrize("accepted,rejected,low,high", [([1, 2, 3], [-3, -2], -2, 1), ([1.0], [], 0, 0), ([0.0, 5], [1, -1], -1, 5)])
def test_bound(accepted, rejected, low, high):
    assert low <= url_filter.best_bound(accepted, rejected) <= high


def test_every_judged_url_trains_the_models(spark):
    # URLs of 700 characters were left out, and of each class all but a number of the others
    urls = [f"http://{c}.org/{c * 700}{i}" for i, c in enumerate("abcd" * 3)] + [f"http://{c}.com/de/{i}" for i, c in enumerate("vwxy" * 3)] + ["http://q.net/abab"]
    found = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), URL_RULES).collect()
    is_held = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) % url_filter.HELD_OUT == 0
    train = {v: [r["host"] + r["path"] for r in found if r["rule"] and r["verdict"] == v and not is_held(r["host"] + r["path"])] for v in ("allow", "block")}
    (new,) = (r for r in found if not r["rule"])
    text = new["host"] + new["path"]
    likelihood = {v: plain_log_likelihood(train[v], text) for v in train}
    assert any(len(t) > 512 for t in train["allow"])
    assert new["score"] == pytest.approx((likelihood["allow"] - likelihood["block"]) / len(text))


def test_the_bound_over_ranges_is_the_best_bound(spark):
    draw = random.Random(12)
    for size, of in ((0, 5), (1, 1), (7, 5), (300, 40), (2_000, 1_000)):
        rows = [(draw.choice(["allow", "block", "allow"]), draw.randrange(-of, of) / 7) for _ in range(size)]
        sides = [[s for v, s in rows if v == verdict] for verdict in ("allow", "block")]
        held = spark.createDataFrame(rows, "verdict string, score double")
        assert url_filter.bound_of(held) == pytest.approx(url_filter.best_bound(*sides), abs=1e-12)
