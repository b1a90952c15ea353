"""The engine as users call it: search, listings and prompts over one corpus of tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import fts, vectors
from loomspan.operators import graph, search
from loomspan.session import table

MODES = ("hybrid", "vector", "fts")


@dataclass
class Engine:
    """A corpus in a folder of tables. ``embed`` turns a query into a vector; without it only full-text search works."""

    spark: SparkSession
    folder: str
    embed: Callable[[str], Sequence[float]] | None = None
    width: int = 64
    policy: Callable[[DataFrame], DataFrame] | None = None

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def chunks(self, within: str, filters: search.Filters, author: str = "", direction: str | None = None) -> DataFrame:
        """What is searched: ``chunk_id, text, title`` of documents, messages or turns."""
        if within == "documents":
            if author or direction:
                raise ValueError("documents have no author or direction; search messages or turns")
            return filters.apply(self.table("documents")).select(F.col("doc_id").alias("chunk_id"), "text", "title")
        if within == "messages":
            rows = self.table("messages").select("id", "author_id", F.col("body").alias("text"), F.get_json_object("meta", "$.subject").alias("title"), F.col("conversation_id").alias("_of"))
            of = self.table("conversations").select(F.col("id").alias("_of"), "source_id")
        elif within == "turns":
            rows = self.table("session_turns").select("id", "author_id", "direction", F.col("content").alias("text"), F.col("role").alias("title"), F.col("session_id").alias("_of"))
            of = self.table("sessions").select(F.col("id").alias("_of"), "source_id")
        else:
            raise ValueError(f"unknown corpus {within!r}")
        rows = search.written_by(rows, self.table("authors"), author, direction)
        if filters.sources is not None:
            rows = rows.join(of.join(filters.sources, "source_id", "left_semi"), "_of", "left_semi")
        rows = rows.select(F.col("id").alias("chunk_id"), "text", "title")
        return filters.policy(rows) if filters.policy else rows

    def search(self, query: str, mode: str = "hybrid", limit: int = 10, classes: Sequence[str] = (), tiers: Sequence[str] = (), sources: Sequence[str] = (), distance: str = "cosine", *, within: str = "documents", author: str = "", direction: str | None = None, links: DataFrame | None = None, binary: bool = False, facts: bool = False) -> DataFrame:
        """Hits for a query: ``chunk_id, score, matched_by, title, snippet``. A blank query has none.

        ``links`` (doc_id, source_id) widens ``sources``; ``author`` and ``direction`` filter messages and turns;
        ``binary`` finds vectors by their signs first and reranks them; ``facts`` lets fact vectors compete, their ids
        come out as -1 - id, without title and snippet.
        """
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; choose one of {', '.join(MODES)}")
        if not query.strip():
            return self.spark.createDataFrame([], "chunk_id long, score double, matched_by string, title string, snippet string")
        wanted = self.table("sources").where(F.col("slug").isin(*sources)).select(F.col("id").alias("source_id")) if sources else None
        found = self.chunks(within, search.Filters(classes, tiers, wanted, links, self.policy), author, direction)
        none = self.spark.createDataFrame([], "chunk_id long, vec_rank int, fts_rank int")
        vec, text = none.select("chunk_id", "vec_rank"), none.select("chunk_id", "fts_rank")
        if mode != "fts" and within == "documents":
            if self.embed is None:
                raise ValueError("vector search needs an embedder")
            stored = self.table("emb_quill").where(vectors.usable(F.col("embedding"), self.width)).select("chunk_id", "embedding").join(found.select("chunk_id"), "chunk_id", "left_semi").withColumn("part", F.lit(0))
            if facts:
                own = self.table("embeddings").where(vectors.usable(F.col("embedding"), self.width))
                stored = stored.unionByName(own.select((-1 - F.col("vec_id")).alias("chunk_id"), "embedding", F.lit(1).alias("part")))
            asked = self.embed(query)
            vec = search.near_binary(stored, asked, self.width) if binary else search.near(stored.drop("part"), asked, distance)
        if mode != "vector":
            mentions = self._mentions(found, fts.parse(query), within)
            text = text if mentions is None else mentions
        hits = search.fuse(vec, text, limit)
        about = found.select("chunk_id", "title", F.replace(F.substring("text", 1, 300), F.lit("\n"), F.lit(" ")).alias("snippet"))
        out = about.join(F.broadcast(hits), "chunk_id").select("chunk_id", "score", "matched_by", "title", "snippet")
        if facts:
            nothing = F.lit(None).cast("string")
            out = out.unionByName(hits.where("chunk_id < 0").select("chunk_id", "score", "matched_by", nothing.alias("title"), nothing.alias("snippet")))
        return out.orderBy(F.desc("score"), "chunk_id")

    def _stored(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def index(self) -> None:
        """Writes the words of all documents as a table that searches then read; to be called again when documents change."""
        fts.build_index(self.table("documents"), "doc_id", "text").write.mode("overwrite").parquet(f"{self.folder}/postings.parquet")

    def _mentions(self, found: DataFrame, parsed: list, within: str) -> DataFrame | None:
        """Ranked mentions among ``found``: by the index where there is one; texts are read only to check phrases and exclusions."""
        words = fts.positive_words(parsed)
        if not words:
            return None
        checked = found.where(fts.matches(fts.tokens(F.col("text")), parsed))
        if within != "documents" or not self._stored("postings"):
            return search.mentioning(checked.select("chunk_id", "text"), words)
        hits = fts.look_up(self.table("postings"), words)
        plain = all(len(terms) == 1 and not terms[0][0] and len(terms[0][1]) == 1 for terms in parsed)
        seen = found if plain else checked.join(hits.select(F.col("key").alias("chunk_id")), "chunk_id", "left_semi")
        return search.mentioned(hits.join(seen.select(F.col("chunk_id").alias("key")), "key", "left_semi"))

    def get_document(self, doc_id: int, most: int = 100_000) -> DataFrame:
        d = self.policy(self.table("documents")) if self.policy else self.table("documents")
        return d.where(F.col("doc_id") == doc_id).select("doc_id", "title", "uri", "corpus_class", "trust_tier", F.substring("content", 1, most).alias("content"), (F.length("content") > most).alias("truncated"))

    def sources(self) -> DataFrame:
        counts = self.table("documents").groupBy("source_id").agg(F.count("*").alias("documents"))
        return self.table("sources").join(counts, F.col("id") == F.col("source_id"), "left").select("slug", "kind", "enabled", F.coalesce("documents", F.lit(0)).alias("documents"))

    def authors(self, name: str = "") -> DataFrame:
        return self.table("authors").where(F.col("display_name").ilike(f"%{name}%")).select("id", "display_name", "is_self").orderBy("id")

    def stats(self) -> DataFrame:
        return self.table("documents").groupBy("corpus_class", "trust_tier", "state").agg(F.count("*").alias("documents"))

    def prompt(self, question: str, hits: int = 6, remote: bool = True) -> tuple[str, list[int]]:
        """A prompt with numbered excerpts, and the documents cited. A remote model is never shown communication."""
        found = self.search(question, "hybrid" if self.embed else "fts", hits, ("document", "code") if remote else ())
        rows = found.collect()  # at most ``hits`` rows
        shown = "\n\n".join(f"[{i}] {r.title or 'untitled'}\n{r.snippet}" for i, r in enumerate(rows, 1))
        return f"Answer from the excerpts and cite their numbers.\n\n{shown}\n\nQuestion: {question}\nAnswer:", [r.chunk_id for r in rows]

    def graph(self) -> tuple[DataFrame, DataFrame]:
        from loomspan.plans.knowledge import _graph

        return _graph(self.spark, self.folder)

    def find_vertices(self, words: str, limit: int = 25) -> DataFrame:
        return graph.find(self.graph()[0], words, limit)

    def neighbours(self, gid: str, hops: int = 1, labels: list[str] | None = None, limit: int | None = 200) -> DataFrame:
        v, e = self.graph()
        return graph.neighbourhood(v, e, v.where(F.col("gid") == gid), hops, labels, limit)
