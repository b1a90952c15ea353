"""Hybrid retrieval: vector and full-text candidates under one set of filters, fused by reciprocal ranks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import fts, vectors
from loomspan.operators.records import in_sources

# Candidates of each engine, of the binary stage, and the constant of rank fusion.
DEPTH, BINARY_FACTOR, FUSE = 200, 4, 60
DIRECTIONS = ("sent", "received")


@dataclass
class Filters:
    """What a search may see. ``policy`` is applied before any ranking; if it fails, the search fails.

    ``sources`` (source_id) lets through documents of these sources and, with ``links`` (doc_id, source_id), those
    linked to one of them besides their own.
    """

    classes: Sequence[str] = ()
    tiers: Sequence[str] = ()
    sources: DataFrame | None = None
    links: DataFrame | None = None
    policy: Callable[[DataFrame], DataFrame] | None = None

    def apply(self, docs: DataFrame) -> DataFrame:
        docs = docs.where("state = 'ok'")
        if self.classes:
            docs = docs.where(F.col("corpus_class").isin(*self.classes))
        if self.tiers:
            docs = docs.where(F.col("trust_tier").isin(*self.tiers))
        if self.sources is not None:
            docs = in_sources(docs, self.links, self.sources) if self.links is not None else docs.join(self.sources, "source_id", "left_semi")
        return self.policy(docs) if self.policy else docs


def written_by(rows: DataFrame, people: DataFrame, name: str = "", direction: str | None = None) -> DataFrame:
    """Rows (author_id, and direction where they have one) by people whose name holds a pattern, sent or received.

    Wildcards in the name are not escaped. Rows without a direction of their own are sent if their author is the owner.
    """
    if direction is not None and direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    if name:
        rows = rows.join(people.where(F.col("display_name").ilike(f"%{name}%")).select(F.col("id").alias("author_id")), "author_id", "left_semi")
    if direction is None:
        return rows
    if "direction" in rows.columns:
        return rows.where(F.col("direction") == direction)
    owner = people.where("is_self").select(F.col("id").alias("author_id"))
    return rows.join(owner, "author_id", "left_semi" if direction == "sent" else "left_anti")


def _ranked(candidates: DataFrame, order: list[Column], depth: int, name: str) -> DataFrame:
    """The first ``depth`` rows with their rank; only these rows come to one task."""
    top = candidates.orderBy(*order).limit(depth)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def near(chunks: DataFrame, query: Sequence[float], kind: str = "cosine", depth: int = DEPTH) -> DataFrame:
    """``chunk_id, distance, vec_rank`` of the nearest chunks; ties by id. Input: chunk_id, embedding."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.select("chunk_id", F.round(vectors.distance(kind, F.col("embedding"), q), 9).alias("distance"))
    return _ranked(scored, [F.col("distance"), F.col("chunk_id")], depth, "vec_rank")


def near_binary(chunks: DataFrame, query: Sequence[float], width: int, depth: int = DEPTH, factor: int = BINARY_FACTOR) -> DataFrame:
    """As ``near`` by cosine, in two stages: the nearest by sign bits, reranked exactly.

    Input: chunk_id, embedding and, optionally, ``part``; the first stage takes its share of every part.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    parts = chunks if "part" in chunks.columns else chunks.withColumn("part", F.lit(0))
    bits = parts.select("part", "chunk_id", "embedding", vectors.hamming(vectors.signs(F.col("embedding"), width), vectors.signs(q, width)).alias("bits"))
    first = bits.withColumn("_b", F.row_number().over(Window.partitionBy("part").orderBy("bits", "chunk_id"))).where(F.col("_b") <= depth * factor)
    return near(first.select("chunk_id", "embedding"), query, "cosine", depth)


def mentioning(chunks: DataFrame, terms: Sequence[str], depth: int = DEPTH, words: Column | None = None) -> DataFrame:
    """``chunk_id, hits, fts_rank`` of chunks that hold a term, most occurrences first; ties by id. Input: chunk_id, text."""
    found = chunks.select("chunk_id", fts.occurrences(words if words is not None else fts.tokens(F.col("text")), list(terms)).alias("hits")).where("hits > 0")
    return _ranked(found, [F.desc("hits"), F.col("chunk_id")], depth, "fts_rank")


def mentioned(found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """As ``mentioning``, of texts found by an index: ``key, hits``."""
    return _ranked(found.select(F.col("key").alias("chunk_id"), "hits"), [F.desc("hits"), F.col("chunk_id")], depth, "fts_rank")


def fuse(vec: DataFrame, text: DataFrame, limit: int = 10) -> DataFrame:
    """``chunk_id, score, matched_by``: the sum of 1 / (60 + rank) over the engines that found a chunk."""
    both = vec.select("chunk_id", "vec_rank").join(text.select("chunk_id", "fts_rank"), "chunk_id", "full")
    part = lambda c: F.coalesce(F.lit(1.0) / (FUSE + F.col(c)), F.lit(0.0))
    by = F.when(F.col("vec_rank").isNotNull() & F.col("fts_rank").isNotNull(), "both").when(F.col("vec_rank").isNotNull(), "vector").otherwise("keyword")
    scored = both.select("chunk_id", F.round(part("vec_rank") + part("fts_rank"), 6).alias("score"), by.alias("matched_by"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(limit)


def hybrid(docs: DataFrame, embeddings: DataFrame, query: Sequence[float], terms: Sequence[str], filters: Filters | None = None, kind: str = "cosine", limit: int = 10, depth: int = DEPTH) -> DataFrame:
    """Fused hits with title and snippet. Rank on ids and short columns; text is joined to the hits last."""
    seen = (filters or Filters()).apply(docs)
    chunks = seen.select(F.col("doc_id").alias("chunk_id"), "text")
    vec = near(embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), query, kind, depth)
    hits = fuse(vec, mentioning(chunks, terms, depth), limit)
    about = docs.select(F.col("doc_id").alias("chunk_id"), "title", F.replace(F.substring("text", 1, 300), F.lit("\n"), F.lit(" ")).alias("snippet"))
    return about.join(F.broadcast(hits), "chunk_id").select("chunk_id", "score", "matched_by", "title", "snippet")
