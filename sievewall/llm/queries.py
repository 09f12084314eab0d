"""The queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import embed_dedup, html, licenses, line_dedup, near_dedup, packing, pii, quality, sampling, syncmers, tokens
from ._io import table

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def heavy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that is worked on row by row: if it is so small that a few tasks would read it, dealt out over all cores."""
    return spread(table(spark, sf_dir, name))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(heavy(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_embeddings(heavy(spark, sf_dir, "embeddings"), 0.95)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.digests(heavy(spark, sf_dir, "documents"), tokens.public_path(PIECES))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_components(heavy(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = syncmers.fingerprints(heavy(spark, sf_dir, "documents"))
    return out.withColumns({c: F.sha2(c, 256) for c in ("fingerprint", "edited_fingerprint")})


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(heavy(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(heavy(spark, sf_dir, "documents"), tokens.public_path(BPE))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = heavy(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(heavy(spark, sf_dir, "documents"), k=4)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(heavy(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_embedding_near_dedup, op3_sentencepiece, op4_line_dedup, op5_fingerprints, op6_html_extraction, op7_packing, op8_quality, op9_minhash_near_dedup, op10_license_scan)
}

#: Equal texts apart, only this operator's contract is one that SQL states in full.
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (
            SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ),
        reach AS (
            SELECT vec_id AS i, vec_id AS j FROM embeddings
            UNION
            SELECT reach.i, links.j FROM reach JOIN links ON links.i = reach.j
        ),
        least AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i),
        counts AS (SELECT i, count(*) AS n FROM links GROUP BY i)
        SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
        FROM embeddings e JOIN least l ON l.i = e.vec_id LEFT JOIN counts c ON c.i = e.vec_id
    """,
}
