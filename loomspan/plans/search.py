"""Search queries. One chunk is one document; its vector is the row of the same id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import fts, vectors
from loomspan.operators import search
from loomspan.session import table

WIDTH, TERMS = 64, ("lighthouse", "ledger", "archive")


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "emb_quill")
    return e.where(vectors.usable(F.col("embedding"), WIDTH)).select("chunk_id", "embedding")


def fact_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query of these searches: the usable vector with the smallest id (one row)."""
    return list(chunk_vectors(spark, sf_dir).orderBy("chunk_id").first().embedding)


def _hybrid(spark, sf_dir, filters=None, **options):
    hits = search.hybrid(table(spark, sf_dir, "documents"), chunk_vectors(spark, sf_dir), query_vector(spark, sf_dir), TERMS, filters, **options)
    return hits.select("chunk_id", "score", "matched_by", "title", "snippet")


def search_hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir)


def search_filtered(spark, sf_dir):
    """Class, tier and source filters, inside both engines."""
    wanted = table(spark, sf_dir, "sources").where("enabled and kind = 'filesystem'").select(F.col("id").alias("source_id"))
    return _hybrid(spark, sf_dir, search.Filters(["document", "code"], ["authored", "reference"], wanted))


def search_access_policy(spark, sf_dir):
    """A policy that hides received documents of mixed sources, applied before fusion."""
    return _hybrid(spark, sf_dir, search.Filters(policy=lambda d: d.where("trust_tier <> 'received' or corpus_class = 'document'")))


def _near(kind):
    def run(spark, sf_dir):
        return search.near(chunk_vectors(spark, sf_dir), query_vector(spark, sf_dir), kind).select("chunk_id", F.round("distance", 5).alias("distance"), "vec_rank")

    return run


def search_bq_rerank(spark, sf_dir):
    """Sign bits first, from chunks and facts each, then exact cosine."""
    both = chunk_vectors(spark, sf_dir).withColumn("part", F.lit(0)).unionByName(fact_vectors(spark, sf_dir).select((-1 - F.col("chunk_id")).alias("chunk_id"), "embedding", F.lit(1).alias("part")))
    return search.near_binary(both, query_vector(spark, sf_dir), WIDTH).select("chunk_id", F.round("distance", 5).alias("distance"), "vec_rank")


def search_union_facts(spark, sf_dir):
    """Chunks and facts as candidates of one ranking; facts have negative ids."""
    both = chunk_vectors(spark, sf_dir).unionByName(fact_vectors(spark, sf_dir).select((-1 - F.col("chunk_id")).alias("chunk_id"), "embedding"))
    return search.near(both, query_vector(spark, sf_dir)).select("chunk_id", "vec_rank")


def search_fts_or(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("state = 'ok'").select(F.col("doc_id").alias("chunk_id"), "text")
    return search.mentioning(docs, TERMS)


def search_postings(spark, sf_dir):
    """``search_fts_or`` by an index of words."""
    docs = table(spark, sf_dir, "documents").where("state = 'ok'")
    return search.mentioned(fts.look_up(fts.build_index(docs, "doc_id", "text"), list(TERMS)))


def search_websearch(spark, sf_dir):
    """Phrases, alternatives and exclusions over all documents."""
    parsed = fts.parse('"tide table" -flood or "orchard log" winter')
    return table(spark, sf_dir, "documents").where(fts.matches(fts.tokens(F.col("text")), parsed)).select("doc_id")


STEMMED = ("archives", "returning", "passages")


def search_stemmed(spark, sf_dir):
    """Documents by stems of the query, with the frequency rank: each distinct word of the corpus is stemmed once."""
    found = fts.stemmed_counts(table(spark, sf_dir, "documents"), "doc_id", "text", [fts.stem(w) for w in STEMMED])
    return found.select("doc_id", F.round("rank", 5).alias("rank")).orderBy(F.desc("rank"), F.desc("doc_id")).limit(search.DEPTH)


def search_direction(spark, sf_dir):
    """Turns that the owner sent."""
    turns = table(spark, sf_dir, "session_turns").where("direction = 'sent'").select(F.col("id").alias("chunk_id"), F.col("content").alias("text"))
    return search.mentioning(turns, TERMS)


def search_author(spark, sf_dir):
    """Messages by authors whose name holds a pattern (its wildcards are not escaped)."""
    people = table(spark, sf_dir, "authors").where(F.col("display_name").ilike("%" + "a_el" + "%")).select(F.col("id").alias("author_id"))
    found = table(spark, sf_dir, "messages").join(people, "author_id", "left_semi")
    return search.mentioning(found.select(F.col("id").alias("chunk_id"), F.col("body").alias("text")), TERMS)


def search_hit_authors(spark, sf_dir):
    """The first messages that mention a term, with all who write in their thread."""
    messages = table(spark, sf_dir, "messages")
    hits = search.mentioning(messages.select(F.col("id").alias("chunk_id"), F.col("body").alias("text")), TERMS, 20)
    threads = messages.select(F.col("id").alias("chunk_id"), "conversation_id").join(F.broadcast(hits), "chunk_id")
    people = messages.join(F.broadcast(threads.select("conversation_id").distinct()), "conversation_id", "left_semi").select("conversation_id", "author_id").distinct()
    named = people.join(table(spark, sf_dir, "authors").select(F.col("id").alias("author_id"), "display_name"), "author_id", "left").groupBy("conversation_id").agg(F.array_join(F.array_sort(F.collect_set("display_name")), "; ").alias("authors"))
    return threads.join(named, "conversation_id", "left").select("chunk_id", "fts_rank", F.coalesce("authors", F.lit("")).alias("authors"))


QUERIES = {f.__name__: f for f in (search_hybrid_rrf, search_filtered, search_access_policy, search_bq_rerank, search_union_facts, search_fts_or, search_postings, search_websearch, search_stemmed, search_direction, search_author, search_hit_authors)}
QUERIES |= {"search_vector_cosine": _near("cosine"), "search_vector_l2": _near("l2"), "search_vector_ip": _near("ip")}

_V = """usable AS (SELECT chunk_id, embedding::DOUBLE[] AS v FROM emb_quill WHERE length(embedding) = 64
    AND length(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND length(list_filter(embedding, lambda x: x <> 0)) > 0),
    q AS (SELECT v AS qv FROM usable ORDER BY chunk_id LIMIT 1)"""
_IN = ", ".join(f"'{t}'" for t in TERMS)
_HITS = lambda c: f"length(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda x: x IN ({_IN})))"


def _fused(where: str) -> str:
    return f"""WITH {_V}, docs AS (SELECT doc_id AS chunk_id, title, text FROM documents d WHERE state = 'ok' AND {where}),
    vec AS (SELECT chunk_id, row_number() OVER (ORDER BY d, chunk_id) AS vr FROM (SELECT chunk_id, round(1 - list_cosine_similarity(v, qv), 9) AS d FROM usable SEMI JOIN docs USING (chunk_id), q ORDER BY d, chunk_id LIMIT 200)),
    fts AS (SELECT chunk_id, row_number() OVER (ORDER BY h DESC, chunk_id) AS fr FROM (SELECT chunk_id, {_HITS('text')} AS h FROM docs WHERE h > 0 ORDER BY h DESC, chunk_id LIMIT 200)),
    top AS (SELECT chunk_id, round(coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + fr), 0), 6) AS score, CASE WHEN vr IS NOT NULL AND fr IS NOT NULL THEN 'both' WHEN vr IS NOT NULL THEN 'vector' ELSE 'keyword' END AS matched_by
      FROM vec FULL JOIN fts USING (chunk_id) ORDER BY score DESC, chunk_id LIMIT 10)
    SELECT chunk_id, score, matched_by, title, replace(left(text, 300), chr(10), ' ') AS snippet FROM top JOIN docs USING (chunk_id)"""


def _near_sql(distance: str) -> str:
    return f"WITH {_V}, t AS (SELECT chunk_id, round({distance}, 9) AS d FROM usable, q ORDER BY d, chunk_id LIMIT 200) SELECT chunk_id, round(d, 5) AS distance, row_number() OVER (ORDER BY d, chunk_id)::INTEGER AS vec_rank FROM t"


_MENTION = lambda source, key, text, where: f"WITH t AS (SELECT {key} AS chunk_id, {_HITS(text)}::INTEGER AS hits FROM {source} WHERE {where}), k AS (SELECT * FROM t WHERE hits > 0 ORDER BY hits DESC, chunk_id LIMIT 200) SELECT chunk_id, hits, row_number() OVER (ORDER BY hits DESC, chunk_id)::INTEGER AS fts_rank FROM k"
_LINE = "' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' '"
ORACLES = {
    "search_hybrid_rrf": _fused("true"),
    "search_filtered": _fused("corpus_class IN ('document', 'code') AND trust_tier IN ('authored', 'reference') AND source_id IN (SELECT id FROM sources WHERE enabled AND kind = 'filesystem')"),
    "search_access_policy": _fused("(trust_tier <> 'received' OR corpus_class = 'document')"),
    "search_vector_cosine": _near_sql("1 - list_cosine_similarity(v, qv)"),
    "search_vector_l2": _near_sql("list_distance(v, qv)"),
    "search_vector_ip": _near_sql("-list_inner_product(v, qv)"),
    "search_union_facts": f"WITH {_V}, b AS (SELECT chunk_id, v FROM usable UNION ALL SELECT -1 - vec_id, embedding::DOUBLE[] FROM embeddings), t AS (SELECT chunk_id, round(1 - list_cosine_similarity(v, qv), 9) AS d FROM b, q ORDER BY d, chunk_id LIMIT 200) SELECT chunk_id, row_number() OVER (ORDER BY d, chunk_id)::INTEGER AS vec_rank FROM t",
    "search_bq_rerank": f"""WITH {_V}, b AS (SELECT 0 AS part, chunk_id, v FROM usable UNION ALL SELECT 1, -1 - vec_id, embedding::DOUBLE[] FROM embeddings),
        h AS (SELECT part, chunk_id, v, length(list_filter(list_zip(v, qv), lambda z: (z[1] > 0) <> (z[2] > 0))) AS bits FROM b, q), f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY part ORDER BY bits, chunk_id) <= 800),
        t AS (SELECT chunk_id, round(1 - list_cosine_similarity(v, qv), 9) AS d FROM f, q ORDER BY d, chunk_id LIMIT 200) SELECT chunk_id, round(d, 5) AS distance, row_number() OVER (ORDER BY d, chunk_id)::INTEGER AS vec_rank FROM t""",
    "search_fts_or": _MENTION("documents", "doc_id", "text", "state = 'ok'"),
    "search_postings": _MENTION("documents", "doc_id", "text", "state = 'ok'"),
    "search_stemmed": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents), s AS (SELECT doc_id, CASE WHEN w IN ('archiv', 'archive', 'archives', 'archived', 'archiving') THEN 1 WHEN w IN ('return', 'returns', 'returned', 'returning') THEN 2 WHEN w IN ('passage', 'passages') THEN 3 END AS s FROM w),
        c AS (SELECT doc_id, s, count(*) AS n FROM s WHERE s IS NOT NULL GROUP BY ALL) SELECT doc_id, round(sum(list_sum(list_transform(range(1, n + 1), lambda i: 1::DOUBLE / (i * i))) / 1.64493406685::DOUBLE) / 3, 5) AS rank FROM c GROUP BY 1 ORDER BY rank DESC, doc_id DESC LIMIT 200""",
    "search_websearch": f"SELECT doc_id FROM documents WHERE (contains({_LINE}, ' tide table ') AND NOT contains({_LINE}, ' flood ')) OR (contains({_LINE}, ' orchard log ') AND contains({_LINE}, ' winter '))",
    "search_direction": _MENTION("session_turns", "id", "content", "direction = 'sent'"),
    "search_author": _MENTION("messages", "id", "body", "author_id IN (SELECT id FROM authors WHERE display_name ILIKE '%a_el%')"),
    "search_hit_authors": f"""WITH t AS (SELECT id AS chunk_id, conversation_id, {_HITS('body')} AS hits FROM messages), k AS (SELECT * FROM t WHERE hits > 0 ORDER BY hits DESC, chunk_id LIMIT 20)
        SELECT chunk_id, row_number() OVER (ORDER BY hits DESC, chunk_id)::INTEGER AS fts_rank, coalesce((SELECT string_agg(DISTINCT display_name, '; ' ORDER BY display_name) FROM messages m JOIN authors a ON a.id = m.author_id WHERE m.conversation_id = k.conversation_id), '') AS authors FROM k""",
}
