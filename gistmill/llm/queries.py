"""Registered queries of the pipeline operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, classifier, conversations, language, mixing, packing, paragraphs, partenum, rules, secrets, suffix, variants, warc
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents")).drop("shuffle_key").withColumn("mix_rate", F.round("mix_rate", 6))


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(spark, warc.write(table(spark, sf_dir, "pages")))


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op6_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_sorted_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op10_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.trie(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def op13_language_by_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (
        op1_secret_scan, op2_poisson_mixing, op3_warc_segments, op4_sum_of_squares_packing, op5_partenum_join, op6_adaptive_quality_rules, op7_paragraph_minhash,
        op8_quality_classifier, op9_suffix_sorted_repeats, op10_ball_tree_top_k, op11_conversation_prefix_trie, op12_spelling_variants, op13_language_by_partial_matching,
    )
    return {f.__name__: f for f in numbered}


OP2 = """
WITH RECURSIVE s AS (SELECT coalesce(source, '') AS src, sum(coalesce(length(text), 0) + 1) AS size FROM documents GROUP BY 1),
w AS (SELECT src, size, pow(CAST(size AS DOUBLE), 0.5) AS weight FROM s),
r AS (SELECT src, round(weight / (SELECT sum(weight) FROM w) * CAST((SELECT sum(size) FROM w) AS DOUBLE) / CAST(size AS DOUBLE), 9) AS rate FROM w),
h AS (SELECT src, rate, CAST(greatest(ceil(rate - 32), 0) AS INTEGER) AS whole FROM r),
c AS (SELECT src, rate - whole AS m, 0 AS k, exp(whole - rate) AS p, exp(whole - rate) AS upto FROM h
  UNION ALL SELECT src, m, k + 1, p * m / (k + 1), upto + p * m / (k + 1) FROM c WHERE k < 120),
d AS (SELECT *, coalesce(source, '') AS src, CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS point FROM documents),
i AS (SELECT DISTINCT src, point FROM d),
n AS (SELECT i.src, i.point, count(*) AS n FROM i JOIN c ON c.src = i.src AND c.upto <= i.point GROUP BY 1, 2)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(unnest(range(CAST(h.whole + coalesce(n.n, 0) AS BIGINT))) AS INTEGER) AS copy, round(h.rate, 6) AS mix_rate
FROM d JOIN h USING (src) LEFT JOIN n ON n.src = d.src AND n.point = d.point
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT digest, max(page_id) AS first_id FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN NULL ELSE first_id END AS refers_to, TRUE AS ok
FROM p LEFT JOIN r USING (digest)
"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: The table by which SQL makes CRC-32 of bytes, from its rule.
CRC = """t AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS step FROM t WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, where `crc` is joined."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda j: CAST('0x' || substr(hex(encode({text})), 2 * j + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda a, b: xor(a >> 8, crc.step[(xor(a, b) & 255) + 1])))"


OP11 = f"""
WITH RECURSIVE {CRC},
o AS (SELECT conv_id, list(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS turns,
  list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS sizes FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT o.*, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM o, crc),
r AS (SELECT h.conv_id, list_concat(coalesce(f.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns, list_concat(coalesce(f.sizes, [])[1:h.h], h.sizes[h.h + 1:]) AS sizes
  FROM h LEFT JOIN o f ON f.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, turns, sizes, unnest(range(len(turns) + 1)) AS depth FROM r),
k AS (SELECT conv_id, depth, array_to_string(turns[1:depth], ' ') AS key, array_to_string(turns[1:depth - 1], ' ') AS parent, CASE WHEN depth = 0 THEN 0 ELSE sizes[depth] END AS size, turns, depth = len(turns) AS ends FROM p),
n AS (SELECT depth, key, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size, arg_min(turns[1:depth], conv_id) AS turns,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM k GROUP BY depth, key),
c AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, key)),
up AS (SELECT d AS depth, array_to_string(turns[1:d], ' ') AS key, CAST(n_children = 0 AS BIGINT) AS leaf, (n_convs - 1) * size AS saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM m)),
s AS (SELECT depth, key, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY 1, 2)
SELECT m.conv_id, m.depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s USING (depth, key) LEFT JOIN n a ON a.depth = m.depth - 1 AND a.key = m.parent
"""

OP12 = f"""
WITH RECURSIVE {CRC},
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS mark, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{6,}}')) AS run FROM documents) GROUP BY 1, 2),
h AS (SELECT run, times, {crc32_sql("mark")} AS h FROM r, crc),
w AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT times, CASE WHEN h % 199 = 0 THEN run[1:CAST(h % length(run) AS INTEGER)] || run[CAST(h % length(run) AS INTEGER) + 2:] ELSE run END AS word FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
d AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM w)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM d a JOIN d b USING (less, i) WHERE a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON w.word = d.less UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON w.word = d.less),
f AS (SELECT word, n, count(*) AS n_near, arg_min(other, {{'n': -other_n, 'word': other}}) AS form, max(other_n) AS form_n FROM near GROUP BY 1, 2),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM w LEFT JOIN f USING (word)),
z AS (SELECT word, word AS root FROM g UNION ALL SELECT z.word, g.form FROM z JOIN g ON g.word = z.root WHERE g.form IS NOT NULL)
SELECT g.*, z.root FROM g JOIN z USING (word) JOIN g e ON e.word = z.root WHERE e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_poisson_mixing": OP2, "op3_warc_segments": OP3, "op10_ball_tree_top_k": OP10, "op11_conversation_prefix_trie": OP11, "op12_spelling_variants": OP12}
