"""The stages of the pipeline, and the queries of the operators against their SQL."""

from collections import Counter, defaultdict
from hashlib import md5, sha256

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from compare import compare, connect
from fixtures import docs_of, invented, table
from test_dedup import lines_brute, near_brute
from test_mixing_and_urls import fill, words

from driftline.llm import bpe, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE[name])[1] == ""


def test_stages_over_awkward_documents(spark):
    texts = ["", None, "42", *invented(40, seed=11, words=200)]
    docs = docs_of(spark, texts, extra=True)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "bpe":
            assert docs.columns == COLUMNS
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != "mixing" and name != "bpe":
            assert 0 < docs.count() <= n
            n = docs.count()
    assert all(r["n_tokens"] == len(r["ids"]) for r in docs.collect())


def test_stages_over_nothing(spark):
    docs = docs_of(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_run_leaves_no_near_copies_and_no_repeated_lines(spark):
    from driftline.llm import near_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    kept = docs.collect()
    sets = [near_dedup.shingles(near_dedup.words(r["text"])) for r in kept]
    assert not any(near_dedup.similarity(a, b) >= 0.8 for i, a in enumerate(sets) for b in sets[:i])
    lines = [line.lower() for r in kept for line in r["text"].split("\n") if line.strip()]
    assert len(lines) == len(set(lines))
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in final} <= {r["doc_id"] for r in kept}
    assert len({r["doc_id"] for r in final}) > len(kept) / 2


def mixed_brute(rows):
    """How often each row (key, text, source) is taken: whole copies, then the lowest hashes up to what is left."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    targets, taken = fill(sizes), Counter()
    for source, target in targets.items():
        copies = int(target // sizes[source])
        budget, total = target - copies * sizes[source], 0
        buckets = defaultdict(list)
        for key, text, own in rows:
            if own == source:
                taken[key] += copies
                digest = md5(f"{key}:{md5(text.encode()).hexdigest()}".encode()).hexdigest()
                buckets[int(digest[:15], 16) >> 30].append((key, words(text)))
        for bucket in sorted(buckets):
            size = sum(n for _, n in buckets[bucket])
            if total + size > budget and not total + size - budget < budget - total:
                break
            taken.update(key for key, _ in buckets[bucket])
            if total + size > budget:
                break
            total += size
    return +taken


def test_final_documents_equal_brute_force(spark):
    texts = invented(120, seed=21, words=120)
    texts += [t + " and more" for t in texts[:10]] + [texts[3], texts[4] + "\n" + texts[5]]
    # near copies of which no line is like another's: the same words, some changed, in lines of other lengths
    for i in range(12):
        own = [f"{w}{i}" for w in " ".join(texts[i : i + 3]).split()][:60]
        for size in (20, 7, 30):
            own = own if size == 20 else own[:size] + ["other"] + own[size + 1 :]
            texts.append("\n".join(" ".join(own[at : at + size]) for at in range(0, len(own), size)))
    docs = table(spark, [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)])
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    known = stages[0](spark, docs, SF).collect()
    assert len(known) > 100  # languages have a test of their own
    source = {r["doc_id"]: r["source"] for r in known}
    cut = lines_brute([(r["doc_id"], r["text"]) for r in known])
    left = [(key, text) for (key, _), (text, n, _) in cut.items() if not n or text.strip()]
    roots = near_brute(left)
    first = {root: min(k for (k, _), r in zip(left, roots, strict=True) if r == root) for root in roots}
    kept = [(k, t, source[k]) for (k, t), root in zip(left, roots, strict=True) if k == first[root]]
    assert len(kept) < len(left) < len(known)
    want = mixed_brute(kept)
    found = spark.createDataFrame(known, docs.schema)
    for stage in stages[1:]:
        found = stage(spark, found, SF)
    rows = found.collect()
    assert Counter(r["doc_id"] for r in rows) == want and max(want.values()) == 2
    path, texts_of = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), {k: t for k, t, _ in kept}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in rows:
        assert list(r["ids"]) == library.encode_ordinary(texts_of[r["doc_id"]])
        assert r["decoded_sha256"] == sha256(texts_of[r["doc_id"]].encode()).hexdigest()
