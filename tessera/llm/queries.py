"""The queries of this subpackage over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import knn, quality, toxicity, warc
from tessera.llm.bpe import encoded
from tessera.llm.decontaminate import judged, overlaps
from tessera.llm.html_wrapper import main_text
from tessera.llm.minhash import near_duplicates
from tessera.llm.substring_dedup import repeated_words
from tessera.llm.token_shards import slots, write_shards


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_words(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return found.select(F.col("__id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return slots(spark, write_shards(_table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("word_bpe_49k.json")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(_table(spark, sf_dir, "pages"))
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85).withColumnRenamed("id", "doc_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(overlaps(docs, _table(spark, sf_dir, "benchmark")))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scored(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return found.select(F.col("__id").alias("doc_id"), "held_out", "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return found.select(F.col("__id").alias("doc_id"), "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_shards": op2_token_shards,
    "op3_warc": op3_warc,
    "op4_html_wrapper": op4_html_wrapper,
    "op5_voronoi_knn": op5_voronoi_knn,
    "op6_minhash": op6_minhash,
    "op7_bpe": op7_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}

_OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w WHERE len(ws) >= 13),
wins AS (SELECT doc_id, p, sha256(array_to_string(ws[p:p + 12], ' ')) AS h FROM starts),
low AS (SELECT h, min(doc_id) AS d FROM wins GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM wins JOIN low USING (h) WHERE d < doc_id),
cut AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(qs), 0) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: qs IS NULL OR NOT list_contains(qs, i)), lambda i: ws[i]), ' ')) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id)
"""

_OP3 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS m FROM p GROUP BY h),
j AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, m FROM p JOIN f USING (h)),
q AS (SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(x, 5 * g + 1, 5))::BIGINT) AS v FROM j)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(v, lambda n: array_to_string(list_transform([n // 32768, n // 1024 % 32, n // 32 % 32, n % 32], lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', d + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM q
"""

_OP5 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e::DOUBLE[], x.e::DOUBLE[])::BIGINT AS score FROM v q, v x WHERE q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON x = doc_id
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT item_id, ws[p:p + 12] AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS p FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(w) AS n FROM win),
spans AS (SELECT doc_id, p, n, ws[p:p + n - 1] AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n)),
occ AS (SELECT doc_id, p, n, item_id FROM spans JOIN win USING (w)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op3_warc": _OP3, "op5_voronoi_knn": _OP5, "op6_minhash": _OP6, "op8_decontamination": _OP8}
