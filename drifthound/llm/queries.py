"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .bpe import decode_ids, encode_texts
from .common import id_crc, table
from .decontam import find_contamination
from .dialogue_trie import conversation_trie
from .hard_negatives import hard_negatives
from .license_scan import PHRASES, TEMPLATES, scan_licenses, template_grams
from .mixing import SLOPES, mix
from .ngram_join import link_components
from .sharding import shard_by_bytes
from .token_ids import token_ids
from .topk import top_k
from .warc import archive_round_trip


def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.pmod(id_crc("doc_id"), F.lit(5)) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hex digits are four base-32 digits.
OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST('0x' || h[5 * (i // 4) + 1:5 * (i // 4) + 5] AS BIGINT) >> (5 * (3 - i % 4)) AS BIGINT) % 32 + 1, 1)), '') AS payload_digest,
  row_number() OVER (PARTITION BY h ORDER BY page_id) AS n, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 THEN f END AS refers_to FROM b
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), "contaminated", F.col("longest").alias("longest_match"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
q AS (SELECT item_id, k, j, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM k)),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, w, s.k, unnest(range(1, len(w) - s.k + 2)) AS i FROM d, (SELECT DISTINCT k FROM k) s WHERE len(w) >= s.k)),
h AS (SELECT doc_id, i, k, item_id, j FROM p JOIN q USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM h GROUP BY doc_id),
r AS (SELECT doc_id, item_id, i - j AS g, k, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM h),
m AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, count(*) - 1 + max(k) AS n FROM r GROUP BY doc_id, item_id, g, run) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op4_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: crc32 in SQL: the table of 256 remainders, then a fold over the bytes.
OP4_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
h AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hex FROM documents),
r AS (
  SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(regexp_extract_all(hex, '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32
  FROM h, crc),
s AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(size) OVER () AS total,
    row_number() OVER (ORDER BY doc_id, text_crc32, size) AS n FROM r),
p AS (SELECT *, CAST(least(7, ((2 * before + size) * 8) // (2 * total)) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""


def op5_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def _sql_rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


OP5_SQL = rf"""
WITH g(t, label, base, n, j, a, b, c) AS (VALUES {_sql_rows(template_grams(PHRASES, TEMPLATES))}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
r AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w),
v AS (SELECT doc_id, t, label, base, n, i - 1 - j AS d, j FROM r JOIN g ON w[i] = a AND w[i + 1] = b AND w[i + 2] = c),
m AS (SELECT doc_id, t, label, base, n, d, bit_or(CAST(1 AS BIGINT) << j) AS mask FROM v GROUP BY ALL),
o AS (SELECT *, CASE WHEN d - lag(d) OVER q <= 3 THEN 0 ELSE 1 END AS opened FROM m WINDOW q AS (PARTITION BY doc_id, t ORDER BY d)),
s AS (SELECT *, sum(opened) OVER (PARTITION BY doc_id, t ORDER BY d) AS span, base AND bit_count(mask) = n AS exact FROM o),
k AS (SELECT doc_id, label, base, bit_count(bit_or(mask)) / n AS part, count(*) FILTER (exact) AS places,
        min(d) FILTER (exact) AS first, max(d) FILTER (exact) AS last
      FROM s GROUP BY doc_id, t, label, base, n, span),
f AS (SELECT *, base AND places > 0 AS found FROM k),
d AS (SELECT doc_id, sum(places) FILTER (found) AS n_base, min(first) AS first_word, max(last) AS last_word,
        list(DISTINCT label) FILTER (found) AS base_labels, list(DISTINCT label) FILTER (found OR (NOT base AND part >= 0.6)) AS labels,
        max(CASE WHEN found THEN 1.0 WHEN NOT base THEN part ELSE 0.0 END) AS score FROM f GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(labels), ','), '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN d USING (doc_id)
"""


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        F.round(F.try_element_at("positions", F.lit(1)), 6).alias("first_position"),
    ).orderBy("first_position", "doc_id")


OP8_SQL = rf"""
WITH r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(CAST(doc_id AS VARCHAR)) AS o FROM documents),
p AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size,
    CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM r),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM r GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][i % 3 + 1] AS DOUBLE) AS w, CAST([{', '.join(map(str, SLOPES))}][i % 3 + 1] AS DOUBLE) AS slope, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER q AS n,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW q AS (ORDER BY cap / w, i)),
f AS (SELECT min(n) AS first_n, arg_min(level, n) AS first_level FROM l WHERE level * w <= cap),
t AS (SELECT source, slope, CASE WHEN first_n IS NULL OR n < first_n THEN cap ELSE first_level * w END AS target FROM l, f),
b AS (SELECT p.*, target, slope, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size > 0 THEN CAST(base AS BIGINT) + CAST(before * 2 + size < (target - base * source_size) * 2 AS BIGINT) ELSE 0 END AS copies,
    least(1, (before + size / 2) / target) AS u FROM b)
SELECT doc_id, size, source_size, target, copies * size AS taken,
  CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) ** 2 + 4 * slope * u) - (1 - slope)) / (2 * slope) END, 6) END AS first_position
FROM c
"""


def op6_ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


#: Sets as whole lists of words, every pair that shares a shingle, then components by a recursive walk.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_distinct([w[i:i + 3] for i in range(1, len(w) - 2)]) END AS s FROM d),
c AS MATERIALIZED (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
g AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep
      AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a),
m AS (SELECT y AS rep, min(x) AS least FROM r GROUP BY y)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.least, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON m.rep = c.rep
"""


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.pmod(id_crc("doc_id"), F.lit(3)) == 1
    model = quality.fit(docs, table(spark, sf_dir, "labels"), keep=~held_out)
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), tokenizer_path()).drop("shard")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: Prefixes as whole lists of turns; crc32 as in OP4_SQL.
OP11_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
r AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ' ' || role || text)) - 1 AS pos FROM r),
h AS (SELECT c, c - c % 100 AS b,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, x: xor(a >> 8, tbl[(xor(a, x) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 6 AS h FROM (SELECT DISTINCT c FROM t), crc),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, role, text FROM (
    SELECT h.c, 0 AS part, pos, role, text FROM h JOIN t ON t.c = b AND pos < h
    UNION ALL SELECT h.c, 1, pos, role, text FROM h JOIN t ON t.c = h.c AND pos >= h)),
p AS (SELECT c, d, text, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS k FROM q
    UNION ALL SELECT c, 0, '', [] FROM h),
n AS MATERIALIZED (SELECT d, k, min(c) AS id, count(*) AS n, length(any_value(text)) AS chars FROM p GROUP BY d, k),
m AS MATERIALIZED (SELECT p.c, p.d, n.id, max(p.d) OVER (PARTITION BY p.c) AS last FROM p JOIN n ON p.d = n.d AND p.k = n.k),
a AS (SELECT n.id, n.d, n.n, n.chars, u.id AS parent FROM n LEFT JOIN m u ON u.c = n.id AND u.d = n.d - 1),
x AS (SELECT parent AS id, d - 1 AS d, count(*) AS kids FROM a WHERE d > 0 GROUP BY ALL),
v AS (SELECT a.*, coalesce(kids, 0) AS kids FROM a LEFT JOIN x USING (id, d)),
s AS (SELECT u.id, u.d, count(*) FILTER (v.kids = 0) AS leaves, sum((v.n - 1) * v.chars) AS saved FROM v JOIN m u ON u.c = v.id AND u.d <= v.d GROUP BY ALL),
e AS (SELECT id, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM m WHERE d = last GROUP BY ALL)
SELECT v.id AS conv_id, CAST(v.d AS BIGINT) AS depth, v.parent AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM v JOIN s USING (id, d) LEFT JOIN e USING (id, d)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op13_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    read = decode_ids(encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxic_segments": op1_toxic_segments,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_decontaminate": op3_decontaminate,
    "op4_shard_by_bytes": op4_shard_by_bytes,
    "op5_license_diagonals": op5_license_diagonals,
    "op6_ngram_components": op6_ngram_components,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_mix_sources": op8_mix_sources,
    "op9_quality_network": op9_quality_network,
    "op10_token_ids": op10_token_ids,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_bpe_transducer": op13_bpe_transducer,
}
ORACLES: dict[str, str] = {
    "op2_warc_round_trip": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op4_shard_by_bytes": OP4_SQL,
    "op5_license_diagonals": OP5_SQL,
    "op6_ngram_components": OP6_SQL,
    "op7_exact_top_k": OP7_SQL,
    "op8_mix_sources": OP8_SQL,
    "op11_conversation_trie": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
