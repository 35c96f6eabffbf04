"""The registered queries of the training-data operators, and the SQL of those that SQL can express.

Every query runs its operator over the whole of its table, with the operator's own defaults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, fingerprints, language_id, licenses, line_dedup, near_dedup, packing, token_counts, warc
from .shared import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_lines", "deleted_lines", "text")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    names = ["byte_bpe_50k", "byte_bpe_multi_50k"]
    versions = [(name, public_tokenizers.path(f"{name}.tiktoken")) for name in names]
    return token_counts.maintained(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), versions, public_tokenizers.PATTERN)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.groups(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.pages(table(spark, sf_dir, "pages", "page_id", "url", "html"), table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: Base32 of the SHA-1 of a page's html: 20 bits, five hexadecimal digits, make four letters.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, {5 * i + 1}, 5))::BIGINT >> {5 * (3 - j)}) & 31)::INT, 1)" for i in range(8) for j in range(4))
_OP3 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
_OP6 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
  r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
  c AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, least AS component_id, vec_id = least AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""

#: Exact probability Jaccard of all pairs that can reach 0.8: it is at most the sum of the lesser shares. With shingles in
#: falling order of x / y, the sum over e of max(x_e / x_d, y_e / y_d) is a running sum of x and what is left of y.
_OP1 = r"""WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
  w AS (SELECT id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM t),
  g AS (SELECT id, unnest([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS sh FROM w WHERE len(w) > 0),
  z AS (SELECT id, count(*) AS total FROM g GROUP BY id),
  s AS (SELECT id, sh, count(*) / any_value(total)::DOUBLE AS share FROM g JOIN z USING (id) GROUP BY id, sh),
  o AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY ALL HAVING sum(least(a.share, b.share)) >= 0.7999),
  u AS (SELECT a, b, sh, sum(x) AS x, sum(y) AS y FROM (SELECT a, b, sh, share AS x, 0.0::DOUBLE AS y FROM o JOIN s ON s.id = o.a UNION ALL SELECT a, b, sh, 0.0::DOUBLE, share FROM o JOIN s ON s.id = o.b) GROUP BY ALL),
  k AS (SELECT *, sum(x) OVER v AS above, 1 - sum(y) OVER v AS below FROM u WINDOW v AS (PARTITION BY a, b ORDER BY CASE WHEN y = 0 THEN 1e300 ELSE x / y END DESC)),
  j AS (SELECT a, b FROM k WHERE x > 0 AND y > 0 GROUP BY ALL HAVING sum(1 / (above / x + below / y)) >= 0.8 - 1e-9),
  l AS (SELECT a, b FROM j UNION ALL SELECT b, a FROM j),
  r AS (SELECT id AS a, id AS b FROM t UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
  c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, doc_id = coalesce(class_id, doc_id) AS kept FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN c ON c.a = t.id"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have it; the others' models, sketches, tokenisers and alignments have none."""
    return {"op1_minhash_near_dedup": _OP1, "op3_warc": _OP3, "op6_embedding_near_dedup": _OP6}
