"""Queries over metadata facts, staleness, identities and authorship."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import text
from loomspan.operators import enrich
from loomspan.session import table


def metadata_facts(spark, sf_dir):
    found = enrich.mail_facts(table(spark, sf_dir, "messages"), table(spark, sf_dir, "authors"))
    return found.groupBy("fact_class", "key").agg(F.count("*").alias("n"), F.min("fact").alias("fact"))


def stale_prompts(spark, sf_dir):
    """Prompts due: runs are known for documents as they were first read under the same title."""
    d = table(spark, sf_dir, "documents").where("title is not null")
    docs = d.select(F.col("doc_id").alias("document_id"), "corpus_class", F.col("content_sha256").alias("content_sha"), "state")
    prompts = spark.createDataFrame([("all", None, "p1", "m"), ("code", "code", "p2", "m")], "prompt string, corpus_class string, prompt_sha string, model string")
    runs = docs.where("state = 'ok'").select("document_id", F.lit("all").alias("prompt"), F.lit("p1").alias("prompt_sha"), "content_sha", F.lit("m").alias("model"))
    return enrich.stale(docs, prompts, runs)


def identity_resolution(spark, sf_dir):
    """Authors that share a handle or a folded name are one person."""
    a = table(spark, sf_dir, "authors")
    by_handle = a.select(F.col("id").alias("author_id"), F.lit("handle").alias("kind"), text.handle_key(F.col("display_name")).alias("value"))
    by_name = a.select(F.col("id").alias("author_id"), F.lit("name").alias("kind"), F.lower(F.trim("display_name")).alias("value"))
    people = enrich.same_people(by_handle.unionByName(by_name))
    return enrich.adopt_names(a, people).join(people.groupBy("person").agg(F.count("*").alias("authors")), "person")


def git_authorship(spark, sf_dir):
    """Authorship from tallies: suppliers stand for committers, parts for paths, line items for commits."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("path"), F.concat(F.lit("dev"), F.col("l_suppkey").cast("string")).alias("name"), F.lit(1).alias("commits"))
    return enrich.git_authorship(t, F.col("name") == "dev1").select("path", "name", "role", "confidence", "self_share")


QUERIES = {f.__name__: f for f in (metadata_facts, stale_prompts, identity_resolution, git_authorship)}

_SUBJECT = rf"lower(trim(regexp_replace(regexp_replace(json_extract_string(meta, '$.subject'), '(?i)^(\s*((({'|'.join(text.SUBJECT_MARKS)})\s*(\[\d+\])?\s*:)|\[[^\]]*\])\s*)+', ''), '\s+', ' ', 'g')))"
_KEY = r"CASE WHEN contains(n, '@') THEN lower(n) WHEN length(regexp_replace(n, '[^0-9]', '', 'g')) >= 7 THEN regexp_replace(n, '[^0-9]', '', 'g') END"
ORACLES = {
    "metadata_facts": f"""SELECT fact_class, key, count(*) AS n, min(fact) AS fact FROM (SELECT 'subject' AS fact_class, 'subject:' || {_SUBJECT} AS key, json_extract_string(meta, '$.subject') AS fact FROM messages WHERE trim(json_extract_string(meta, '$.subject')) <> ''
        UNION ALL SELECT 'sender', 'sender:' || author_id, 'Sent by ' || trim(display_name) FROM messages m JOIN authors a ON a.id = m.author_id) GROUP BY ALL""",
    "stale_prompts": "SELECT doc_id AS document_id, 'all' AS prompt FROM documents WHERE title IS NOT NULL AND (state <> 'ok' OR content_sha256 IS NULL) UNION ALL SELECT doc_id, 'code' FROM documents WHERE title IS NOT NULL AND corpus_class = 'code'",
    "identity_resolution": f"""WITH a AS (SELECT id, display_name, lower(trim(display_name)) AS name, {_KEY} AS key FROM (SELECT *, regexp_replace(display_name, '^\\s+|\\s+$', '', 'g') AS n FROM authors)),
        l AS (SELECT x.id AS a, y.id AS b FROM a x JOIN a y ON x.name = y.name OR x.key = y.key), r AS (WITH RECURSIVE r AS (SELECT id AS a, id AS b FROM a UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b) SELECT * FROM r),
        p AS (SELECT a AS id, min(b) AS person FROM r GROUP BY 1)
        SELECT person, arg_min(trim(display_name), (CASE WHEN contains(display_name, '@') OR key IS NOT NULL THEN 1 ELSE 0 END, id)) AS display_name, count(*) AS authors FROM p JOIN a USING (id) GROUP BY 1""",
    "git_authorship": """WITH t AS (SELECT l_partkey::VARCHAR AS path, 'dev' || l_suppkey AS name, count(*) AS c FROM lineitem GROUP BY ALL), s AS (SELECT path, sum(c) AS total, coalesce(sum(c) FILTER (name = 'dev1'), 0) AS own FROM t GROUP BY 1)
        SELECT path, name, CASE WHEN r = 1 THEN 'author' ELSE 'committer' END AS role, round_even(c / total, 3) AS confidence, round_even(own / total, 3) AS self_share FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY c DESC, name) AS r FROM t) JOIN s USING (path) WHERE r <= 6""",
}
