"""The queries of the operators, over the whole of their tables, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import (
    bpe,
    columns,
    exact_dedup,
    fingerprints,
    infill,
    language_id,
    license_scan,
    line_dedup,
    merge_queue,
    mixing,
    near_dedup,
    prefix_trie,
    token_counts,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns.documents(spark, sf_dir)
    return fingerprints.compare_with_next(docs, fingerprints.lexicon(docs))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(columns.documents(spark, sf_dir))
    base = F.array_sort(F.array_distinct("base_places.label"))
    every = F.array_sort(F.array_distinct(F.concat("base_places.label", "places.label")))
    confidence = F.array_max(F.concat("base_places.confidence", "places.confidence"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("bigint").alias("n_base"),
        F.array_min("base_places.first").alias("first_word"),
        F.array_max("base_places.first").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce(confidence, F.lit(0.0)).alias("score"),
        "places",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(columns.documents(spark, sf_dir))
    text = F.coalesce("text", F.lit(""))
    return found.select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.col("n_removed").cast("bigint").alias("n_removed"),
        F.length(text).cast("bigint").alias("n_chars_kept"),
        F.sha2(text, 256).alias("kept_sha256"),
    )


OP3_SQL = r"""
WITH l AS MATERIALIZED (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents),
w AS (
  SELECT DISTINCT doc_id, line_no, word
  FROM (SELECT doc_id, line_no, unnest(string_split_regex(lower(line), '[ 	-
]+')) AS word FROM l)
  WHERE word <> ''),
t AS MATERIALIZED (SELECT doc_id, line_no, list(word ORDER BY word) AS words FROM w GROUP BY doc_id, line_no),
c AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY min((doc_id, line_no))) AS class, words, len(words) AS n FROM t GROUP BY words),
e AS (SELECT class, n, unnest(words) AS word FROM c),
r AS (SELECT *, count(*) OVER (PARTITION BY word) AS freq FROM e),
i AS MATERIALIZED (
  SELECT class, n, word FROM r
  QUALIFY row_number() OVER (PARTITION BY class ORDER BY freq, word) <= n - (4 * n + 4) // 5 + 1),
p AS (
  SELECT DISTINCT a.class AS late, b.class AS early
  FROM i a JOIN i b ON a.word = b.word AND b.class < a.class
  WHERE least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4),
g AS (
  SELECT DISTINCT late
  FROM (SELECT late, len(list_intersect(a.words, b.words)) AS common, a.n + b.n AS n_both
        FROM p JOIN c a ON a.class = late JOIN c b ON b.class = early)
  WHERE common * 5 >= (n_both - common) * 4),
k AS (
  SELECT t.doc_id, t.line_no,
         c.class IN (SELECT late FROM g)
         OR row_number() OVER (PARTITION BY c.class ORDER BY t.doc_id, t.line_no) > 1 AS gone
  FROM t JOIN c ON t.words = c.words),
o AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (k.gone) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (NOT coalesce(k.gone, FALSE)), '') AS kept
  FROM l LEFT JOIN k ON l.doc_id = k.doc_id AND l.line_no = k.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       length(coalesce(kept, '')) AS n_chars_kept, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(
        columns.documents(spark, sf_dir),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(columns.documents(spark, sf_dir))


OP5_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM rows
WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        columns.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(columns.documents(spark, sf_dir)).drop("row")


#: The rules that come before the models.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


#: The weights of the sources in their order, again and again.
SOURCE_WEIGHTS = [3, 1, 2]


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(columns.documents(spark, sf_dir), SOURCE_WEIGHTS)


OP9_SQL = r"""
WITH h AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash
  FROM documents),
d AS (
  SELECT doc_id, source, size,
         CASE WHEN copy = 0 THEN hash ELSE CAST('0x' || substr(md5(hash || ':' || copy), 1, 15) AS BIGINT) END >> 30 AS bucket
  FROM (SELECT *, row_number() OVER (PARTITION BY source, hash) - 1 AS copy FROM h)),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS lim FROM s),
r AS (
  SELECT lim / weight AS ratio,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM w)
          - coalesce((SELECT sum(x.lim) FROM w x WHERE x.lim / x.weight < w.lim / w.weight), 0))
         / (SELECT sum(x.weight) FROM w x WHERE x.lim / x.weight >= w.lim / w.weight) AS level
  FROM w),
t AS (
  SELECT source, source_size,
         least(lim, weight * (SELECT arg_min(level, ratio) FROM r WHERE level <= ratio)) AS target
  FROM w),
c AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
b AS (
  SELECT source, bucket, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket) AS upto
  FROM d GROUP BY source, bucket),
e AS (
  SELECT c.source, min_by(b.bucket, b.bucket) AS last_bucket,
         min_by(b.upto - (c.target - c.copies * c.source_size)
                < (c.target - c.copies * c.source_size) - (b.upto - b.n), b.bucket) AS with_last
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
  WHERE b.upto > c.target - c.copies * c.source_size
  GROUP BY c.source)
SELECT d.doc_id, d.size, c.source_size, c.target,
       CAST(d.size * (c.copies + CASE WHEN d.bucket < e.last_bucket OR (d.bucket = e.last_bucket AND e.with_last)
                                      THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


def held_out(key: Column) -> Column:
    """A fifth of the documents, from which nothing is learned; rows without a key are among them."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns.documents(spark, sf_dir)
    labelled = docs.filter(~held_out(F.col("doc_id")))
    found = language_id.identify(docs, language_id.learn(labelled))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")


def _digests(found: DataFrame, ids: str, decoded: str) -> list[Column]:
    return [
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    ]


def op11_merge_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge_queue.encode_and_decode(
        columns.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )
    return found.select("doc_id", *_digests(found, "ids", "decoded"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.fill_in_middle(columns.documents(spark, sf_dir))
    digests = [F.sha2(F.col(name).cast("binary"), 256).alias(f"{name}_sha256") for name in ("output", "restored")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
h AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (len(units) + 1) AS c1,
         CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (len(units) + 1) AS c2,
         text <> '' AND NOT contains(text, '<P>') AND NOT contains(text, '<S>') AND NOT contains(text, '<M>')
         AND CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 < 50 AS changed,
         CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 < 80 AS suffix_first
  FROM d),
p AS (
  SELECT *, array_to_string(units[1:least(c1, c2)], '') AS prefix,
         array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(units[greatest(c1, c2) + 1:], '') AS suffix
  FROM h)
SELECT doc_id, n, CASE WHEN NOT changed THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN changed THEN length(prefix) END AS prefix_chars,
       CASE WHEN changed THEN length(middle) END AS middle_chars,
       sha256(CASE WHEN NOT changed THEN text
                   WHEN suffix_first THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
WITH t AS MATERIALIZED (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place,
         digest, chars
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
               md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (
  SELECT conv, xor(list_reduce(
           flatten(list_transform(string_split(CAST(conv AS VARCHAR), ''), lambda s: [ascii(s), -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END,
           4294967295), 4294967295) % 6 AS head
  FROM (SELECT DISTINCT CAST(conv AS BIGINT) AS conv FROM t)),
r AS MATERIALIZED (
  SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY own, place) AS depth, digest, chars
  FROM (SELECT c.conv, FALSE AS own, place, digest, chars FROM c JOIN t ON t.conv = c.conv - c.conv % 100 AND place <= head
        UNION ALL
        SELECT c.conv, TRUE, place, digest, chars FROM c JOIN t ON t.conv = c.conv AND place > head)),
q AS (
  SELECT conv, depth, chars, md5(string_agg(digest, ',') OVER (PARTITION BY conv ORDER BY depth)) AS node FROM r),
p AS MATERIALIZED (
  SELECT conv, depth, chars, node, lag(node, 1, '') OVER (PARTITION BY conv ORDER BY depth) AS parent,
         depth = count(*) OVER (PARTITION BY conv) AS ends
  FROM q
  UNION ALL
  SELECT conv, 0, 0, '', NULL, conv NOT IN (SELECT conv FROM r) FROM c),
n AS MATERIALIZED (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv) AS conv, count(*) AS n_convs,
         (count(*) - 1) * any_value(chars) AS saved,
         bool_and(ends) AS leaf,
         sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY node),
s AS (
  SELECT p.node, count(*) FILTER (n.leaf) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM p JOIN n ON n.conv = p.conv AND n.depth >= p.depth GROUP BY p.node),
k AS (SELECT parent, count(*) AS n_children FROM n GROUP BY parent)
SELECT n.conv AS conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv AS parent_conv_id, n.n_convs,
       coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN n up ON up.node = n.parent LEFT JOIN k ON k.parent = n.node
"""


QUERIES: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_bpe": op4_bpe,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_near_dedup": op7_near_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_merge_queue": op11_merge_queue,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op9_mixing": OP9_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
