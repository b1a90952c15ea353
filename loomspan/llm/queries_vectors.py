"""Query over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import neighbours as nn
from loomspan.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a cosine of 0.90 or more of which one is among the ten nearest of the other."""
    found = nn.neighbours(table(spark, sf_dir, "emb_quill"), "chunk_id", "embedding", min_similarity=0.9, probes=2, rerank=4)
    return found.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector, however weakly similar."""
    return nn.neighbours(table(spark, sf_dir, "emb_quill"), "chunk_id", "embedding").select(F.col("id").alias("chunk_id"), "neighbour", F.round("similarity", 6).alias("similarity"))


def p5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for those whose id is divisible by 100."""
    rows = table(spark, sf_dir, "emb_quill")
    found = nn.search(rows, rows.where(F.col("chunk_id") % 100 == 0), "chunk_id", "embedding", rerank=100)
    return found.select(F.col("id").alias("chunk_id"), "neighbour")


QUERIES = {"p5_found": p5_found, "p5_nearest": p5_nearest, "p5_search": p5_search}
ORACLES = {
    "p5_search": """
    WITH v AS (SELECT chunk_id, embedding::DOUBLE[] AS v FROM emb_quill WHERE length(embedding) = 64
      AND length(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND length(list_filter(embedding, lambda x: x <> 0)) > 0)
    SELECT a.chunk_id, b.chunk_id AS neighbour FROM v a JOIN v b ON a.chunk_id <> b.chunk_id WHERE a.chunk_id % 100 = 0
    QUALIFY row_number() OVER (PARTITION BY a.chunk_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.chunk_id) <= 10""",
    "p5_found": """
    WITH v AS (SELECT chunk_id, embedding::DOUBLE[] AS v FROM emb_quill WHERE length(embedding) = 64
      AND length(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND length(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.chunk_id <> b.chunk_id),
    n AS (SELECT a, b, s FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10)
    SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM n WHERE s >= 0.9""",
}
