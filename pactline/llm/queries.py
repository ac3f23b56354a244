"""The operators applied to their whole tables, one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embed_dedup, html_text, line_dedup, packing, pii, simhash, token_counts, toxicity
from .common import scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> bytes:
    """A public vocabulary file's bytes, read on the driver; executors get them with the job."""
    return Path(public_tokenizers.path(name)).read_bytes()


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    counted = token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "byte_bpe_50k")
    ledger = token_counts.Ledger(spark, scratch(spark, "token-ledger"))
    ledger.commit("load", token_counts.inserts(counted))
    return ledger.totals()


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 20 = 0"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = line_dedup.remove(docs.select("doc_id", "text", F.length("text").alias("chars_before")))
    kept = F.coalesce(F.length("text"), F.lit(0))
    return rows.select(
        "doc_id", (F.coalesce("chars_before", F.lit(0)) - kept).cast("long").alias("chars_removed"), kept.cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.decode(bpe.encode(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_embedding_dedup, op3_pii, op4_toxicity, op5_packing, op6_html_text, op7_token_counts, op8_ann, op9_line_dedup, op10_bpe, pipeline)
    return {f.__name__: f for f in own}


#: Links by every pair of a label, components by walking them.
_OP2_SQL = """
WITH RECURSIVE good AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.98 ELSE FALSE END
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM good
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), roots AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
), numbers AS (
    SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(r.component_id, e.vec_id) AS BIGINT) AS component_id,
    coalesce(e.vec_id = coalesce(r.component_id, e.vec_id), TRUE) AS kept
FROM embeddings e LEFT JOIN numbers n ON n.vec_id = e.vec_id LEFT JOIN roots r ON r.vec_id = e.vec_id
"""

#: The shortest runs of lines with 50 words from and to each line, compared as texts.
_OP9_SQL = """
WITH lines AS (
    SELECT doc_id, k, line, len(regexp_extract_all(line, '[^\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+')) AS words
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k
        FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), filled AS (
    SELECT doc_id, k, sum(words) OVER w - words AS before, sum(words) OVER w AS upto
    FROM lines WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), runs AS (
    SELECT a.doc_id, a.k AS k, b.k AS last FROM filled a ASOF JOIN filled b ON a.doc_id = b.doc_id AND a.before + 50 <= b.upto
    UNION
    SELECT b.doc_id, a.k AS k, b.k AS last FROM filled b ASOF JOIN filled a ON b.doc_id = a.doc_id AND b.upto - 50 >= a.before
), chunks AS (
    SELECT r.doc_id, r.k, r.last, array_to_string(string_split(d.text, chr(10))[r.k : r.last], chr(10)) AS chunk
    FROM runs r JOIN documents d ON d.doc_id = r.doc_id
), apart AS (
    SELECT doc_id, chunk, size, unnest(list_reduce(list_transform(ks, lambda x: [x]), lambda kept, x: CASE WHEN x[1] >= kept[-1] + size THEN list_concat(kept, x) ELSE kept END)) AS k
    FROM (SELECT doc_id, chunk, min(last - k + 1) AS size, list(k ORDER BY k) AS ks FROM chunks GROUP BY doc_id, chunk)
), ranked AS (
    SELECT doc_id, k, size, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) AS place FROM apart
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS k FROM ranked WHERE place > 1
), rest AS (
    SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE g.k IS NULL), '') AS text
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k
    GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(length(d.text), 0) - coalesce(length(t), 0) AS BIGINT) AS chars_removed, CAST(coalesce(length(t), 0) AS BIGINT) AS n_chars, sha256(t) AS text_sha256
FROM (SELECT d.doc_id, d.text, coalesce(r.text, d.text) AS t FROM documents d LEFT JOIN rest r ON r.doc_id = d.doc_id) d
"""


def oracle_sql() -> dict[str, str]:
    """op2 and op9 in SQL. Fingerprints, learnt models, merges and parsers have no equal there: tests hold those against brute force."""
    return {"op2_embedding_dedup": _OP2_SQL, "op9_line_dedup": _OP9_SQL}
