"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seekstone.llm import chat, decontamination, html_text, idblocks, negatives, ngram_join, packing, pii, ppm, sortmeans, topk, toxicity, warc
from seekstone.sources.tables import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: A conversation whose texts hold control strings (a fixed value).
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages, without their hosts' templates."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte PPM and single-token scores of all documents."""
    return ppm.score(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one full of control strings; digests read back from the output."""
    extra = spark.sql(f"SELECT -1L AS conv_id, t.turn, t.role, '{CONTROL_TEXT}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.digests(chat.format_conversations(messages))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a string-kernel machine learned from two thirds of the labels."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector against all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items found in all documents."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base spans and those that boosted trees add."""
    return pii.digests(pii.find_in_documents(table(spark, sf_dir, "documents")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard similarity of their shingles."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as an archive with revisit records, and read it back."""
    return warc.page_digests(warc.archive_pages(table(spark, sf_dir, "pages")))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of eight centroids over all vectors of 64 components."""
    found, centres = sortmeans.sort_means(table(spark, sf_dir, "embeddings"))
    return sortmeans.digests(spark, found, centres)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector's positives; each seventh vector has a shifted label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


def op13_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as files of coded token ids, and read them back."""
    return idblocks.digests(idblocks.write_documents(table(spark, sf_dir, "documents"), TOKENIZER))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_ppm": op2_ppm,
    "op3_chat_format": op3_chat_format,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_exact_topk": op6_exact_topk,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_ngram_join": op9_ngram_join,
    "op10_warc": op10_warc,
    "op11_sort_means": op11_sort_means,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_blocks": op13_token_blocks,
}


def sort_means_sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """Lloyd rounds in SQL, one query a round; every vector meets every centroid."""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::INTEGER AS c, x FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, x, m.c AS c, m.d AS d FROM (SELECT vec_id, any_value(v.x) AS x, min({{'d': list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c}}) AS m
  FROM v CROSS JOIN c{r} GROUP BY vec_id))""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT c, i, sum(y) AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(x) AS y, unnest(range({dims})) AS i FROM a{r}) GROUP BY c, i),
n{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN n{r} ON n{r}.c = c{r}.c)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(f.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} f ON f.c = a.c"""

ESCAPED_SQL = r"""regexp_replace(regexp_replace(regexp_replace(replace({0}, '\', '\5c'), '<(\||/?s>)', '\\3c\1', 'g'), '<(</?SYS>>)', '\\3c\1', 'g'), '\[(/?INST\])', '\\5b\1', 'g')"""

ORACLE_SQL = {
    "op3_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length({ESCAPED_SQL.format('role')}) + length({ESCAPED_SQL.format('text')}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id""",
    "op6_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op9_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op11_sort_means": sort_means_sql(),
    "op12_hard_negatives": """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
    list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM
  (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE alike) WHERE r <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
