"""Vector, deduplication and graph queries. Facts here are the rows of embeddings, classed by label."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import text, vectors
from loomspan.operators import cluster, graph
from loomspan.session import table

#: Cosine at which the facts of these tables count as alike (their vectors are nearly independent).
ALIKE = 0.3


def _facts(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def distilled_centroids(spark, sf_dir):
    means = vectors.mean_vectors(_facts(spark, sf_dir), "label", "embedding")
    return means.select("label", "n", F.posexplode("mean").alias("pos", "x")).select("label", "n", "pos", F.round("x", 6).alias("x"))


def truncate_mrl(spark, sf_dir):
    short = _facts(spark, sf_dir).select("vec_id", F.posexplode(vectors.truncated(F.col("embedding"), 16)).alias("pos", "x"))
    return short.select("vec_id", "pos", F.round("x", 6).alias("x"))


def binary_signs(spark, sf_dir):
    b = _facts(spark, sf_dir).select("vec_id", F.posexplode(vectors.signs(F.col("embedding"), 64)).alias("word", "bits"))
    return b.select("vec_id", "word", F.bit_count("bits").alias("ones"))


def knn_per_row(spark, sf_dir):
    """The ten nearest of its class for every row whose id is divisible by 100, against all rows."""
    f = _facts(spark, sf_dir)
    found = cluster.nearest(f, f.where("vec_id % 100 = 0"), "vec_id", "label", "embedding", 10)
    return found.select("query", "neighbour", "rank")


def pairs_above_threshold(spark, sf_dir):
    """Links between similar facts: per fact how many, and how close the closest is."""
    p = cluster.similar_pairs(_facts(spark, sf_dir), "vec_id", "label", "embedding", ALIKE)
    both = p.select("a", "similarity").unionByName(p.select(F.col("b").alias("a"), "similarity"))
    return both.groupBy(F.col("a").alias("vec_id")).agg(F.count("*").alias("links"), F.round(F.max("similarity"), 6).alias("closest"))


def group_variability(spark, sf_dir):
    v = cluster.variability(_facts(spark, sf_dir), "label", "embedding")
    return v.select("label", "n", F.round("spread", 6).alias("spread"), F.round("radius", 6).alias("radius"), F.round(vectors.tight_radius(F.col("n"), 0.97), 6).alias("tight"), vectors.needs_model(F.col("radius"), F.col("n"), 0.97).alias("loose"))


def restatement_components(spark, sf_dir):
    """Facts that are linked, directly or not, with the smallest of their component."""
    return cluster.components(cluster.similar_pairs(_facts(spark, sf_dir), "vec_id", "label", "embedding", ALIKE))


def _signed(spark, sf_dir):
    """Facts with what the first line of the document of their id claims: numbers, time and negation."""
    line = F.substring_index("text", "\n", 1)
    said = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.to_json(text.claim_signature(F.coalesce(line, F.lit("")))).alias("sig"))
    return _facts(spark, sf_dir).join(said, "vec_id", "left").withColumn("sig", F.coalesce("sig", F.lit("none")))


def guarded_clusters(spark, sf_dir):
    """Components split by average linkage among facts with the same signature."""
    f = _signed(spark, sf_dir)
    p = cluster.similar_pairs(f, "vec_id", "label", "embedding", ALIKE)
    return cluster.linked_groups(p, f.select(F.col("vec_id").alias("node"), F.col("sig").alias("signature"), F.col("embedding").alias("v")), ALIKE)


def cluster_full(spark, sf_dir):
    """All facts regrouped by growth from dense seeds."""
    f = _signed(spark, sf_dir)
    return cluster.regroup(f, "vec_id", "label", "embedding", "sig", ALIKE)


def guarded_holds(spark, sf_dir):
    """Of the guarded clusters: how many facts they place, groups of several classes or signatures, and groups whose average similarity is below the threshold."""
    f = _signed(spark, sf_dir).select(F.col("vec_id").alias("node"), "label", "sig", vectors.normalized(vectors.doubles(F.col("embedding"))).alias("v"))
    g = guarded_clusters(spark, sf_dir).join(f, "node")
    mixed = g.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.countDistinct("sig").alias("sigs"))
    sums = g.select("grp", F.posexplode("v").alias("at", "x")).groupBy("grp", "at").agg(F.sum("x").alias("x")).groupBy("grp").agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    loose = (F.col("n") > 1) & ((F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1)) < ALIKE - 1e-9)
    return mixed.join(sums, "grp").agg(F.sum("n").alias("facts"), F.count_if((F.col("labels") > 1) | (F.col("sigs") > 1)).alias("mixed"), F.count_if(loose).alias("loose"))


def cluster_full_holds(spark, sf_dir):
    """Of the regrouped facts: each stands in one group, of one class and signature, named by its smallest member."""
    f = _signed(spark, sf_dir).select(F.col("vec_id").alias("node"), "label", "sig")
    g = cluster_full(spark, sf_dir).join(f, "node")
    per = g.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("node").alias("nodes"), F.min("node").alias("least"), F.countDistinct("label", "sig").alias("kinds"))
    return per.agg(F.sum("n").alias("facts"), F.sum("nodes").alias("nodes"), F.count_if(F.col("kinds") > 1).alias("mixed"), F.count_if(F.col("least") != F.col("grp")).alias("misnamed"))


def cluster_incremental(spark, sf_dir):
    """Facts placed at the centroid of the class they are nearest to, where near enough."""
    f = _facts(spark, sf_dir)
    centres = vectors.mean_vectors(f, "label", "embedding").select(F.col("label").cast("long").alias("node"), F.lit("all").alias("cls"), F.lit("one").alias("sig"), F.col("mean").alias("v"))
    new = f.select(F.col("vec_id").alias("node"), F.lit("all").alias("cls"), F.lit("one").alias("sig"), F.col("embedding").alias("v"))
    return cluster.place(new, centres, ALIKE, 5)


def join_anchors(spark, sf_dir):
    """Facts at the class centroid that is their anchor, among all classes."""
    f = _facts(spark, sf_dir)
    fixed = vectors.mean_vectors(f, "label", "embedding").select(F.col("label").cast("long").alias("node"), F.lit("all").alias("cls"), F.lit("one").alias("sig"), F.col("mean").alias("v"))
    facts = f.select(F.col("vec_id").alias("node"), F.lit("all").alias("cls"), F.lit("one").alias("sig"), F.col("embedding").alias("v"))
    return cluster.join_anchors(facts, fixed, ALIKE).select("node", "grp", F.round("similarity", 6).alias("similarity"))


def finish_links(spark, sf_dir):
    """Documents as facts: copies stand for the first of their text, texts with one claim form a group."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("node"), F.sha2("text", 256).alias("body"), F.sha2(text.normalize_fact(F.col("text")), 256).alias("claim"))
    copies = d.groupBy("body").agg(F.min("node").alias("stands_for"))
    restated = d.join(copies, "body").where("node <> stands_for").select("node", "stands_for")
    claims = d.groupBy("claim").agg(F.min("node").alias("grp"), F.countDistinct("body").alias("bodies"))
    return cluster.finish(d, d.join(claims, "claim").where("bodies > 1").select("node", "grp"), restated)


def cluster_totals(spark, sf_dir):
    return cluster.totals(finish_links(spark, sf_dir))


def representatives(spark, sf_dir):
    """Documents with the same claim: the longest text stands for them."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.sha2(text.normalize_fact(F.col("text")), 256).alias("claim"))
    return cluster.representatives(d, "claim", "doc_id", "text")


def members_sha256(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(text.normalize_fact(F.col("text")), 256).alias("claim"))
    return cluster.members_hash(d, "claim", "doc_id")


def anchors(spark, sf_dir):
    """Metadata facts: the first mail of each subject stands for all of them."""
    m = table(spark, sf_dir, "messages").select("id", "sent_at", text.normalize_subject(F.get_json_object("meta", "$.subject")).alias("subject")).where("subject is not null")
    return m.groupBy("subject").agg(F.min_by("id", F.struct("sent_at", "id")).alias("anchor"), F.count("*").alias("members"))


def _graph(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    v = [
        graph.vertices("Source", t("sources"), "id", F.col("slug"), "kind", "enabled"), graph.vertices("Author", t("authors"), "id", F.col("display_name"), "is_self"), graph.vertices("Document", t("documents"), "doc_id", F.col("title"), "corpus_class", "state"),
        graph.vertices("Conversation", t("conversations"), "id", F.col("external_id"), "message_count"), graph.vertices("Session", t("sessions"), "id", F.col("title"), "provider"),
    ]
    s = lambda label, c: graph.gid(label, F.col(c))
    e = [
        graph.edges("FROM_SOURCE", t("documents"), s("Document", "doc_id"), s("Source", "source_id")), graph.edges("FROM_SOURCE", t("conversations"), s("Conversation", "id"), s("Source", "source_id")), graph.edges("FROM_SOURCE", t("sessions"), s("Session", "id"), s("Source", "source_id")),
        graph.edges("WROTE", t("messages"), s("Author", "author_id"), s("Conversation", "conversation_id")), graph.edges("RECEIVED", t("conversations"), s("Author", "other_author_id"), s("Conversation", "id")), graph.edges("SPAWNED", t("sessions"), s("Session", "parent_session_id"), s("Session", "id")),
    ]
    vertices = graph.union(v)
    return vertices, graph.attached(graph.union(e), vertices)


def graph_vertices(spark, sf_dir):
    return _graph(spark, sf_dir)[0].select("gid", "label", "key", "title")


def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


def graph_label_counts(spark, sf_dir):
    v, e = _graph(spark, sf_dir)
    return v.groupBy("label").agg(F.count("*").alias("n")).unionByName(e.groupBy("label").agg(F.count("*").alias("n")))


def graph_find(spark, sf_dir):
    return graph.find(_graph(spark, sf_dir)[0], "lighthouse", 40).select("gid", "label", "title")


def graph_neighborhood(spark, sf_dir):
    """Two steps around the authors called Felix, through authors, threads and sources."""
    v, e = _graph(spark, sf_dir)
    seeds = v.where(F.col("title").ilike("felix%") & (F.col("label") == "Author"))
    return graph.neighbourhood(v, e, seeds, 2, ["Author", "Conversation", "Source"])


QUERIES = {f.__name__: f for f in (distilled_centroids, truncate_mrl, binary_signs, knn_per_row, pairs_above_threshold, group_variability, restatement_components, guarded_clusters, guarded_holds, cluster_full, cluster_full_holds, cluster_incremental, join_anchors, finish_links, cluster_totals, representatives, members_sha256, anchors, graph_vertices, graph_edges, graph_label_counts, graph_find, graph_neighborhood)}

_MEAN = """m AS (SELECT label, pos, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY ALL), nm AS (SELECT label, max(n) AS n, list(x ORDER BY pos) AS v, sqrt(sum(x * x)) AS size FROM m GROUP BY 1)"""
_PAIRS = f"p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE s >= {ALIKE})"
_FOLD = "translate(lower(text), 'ſςµ', 'sσμ')"
for _a, _b in (("ß", "ss"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st")):
    _FOLD = f"replace({_FOLD}, '{_a}', '{_b}')"
_CLAIM = rf"sha256(trim(regexp_replace(trim(regexp_replace({_FOLD}, '[\s\x0B]+', ' ', 'g')), '[.!?;:,]+$', '')))"
_FINISH = f"""WITH d AS (SELECT doc_id AS node, text AS body, {_CLAIM} AS claim FROM documents WHERE text IS NOT NULL), g AS (SELECT claim, min(node) AS grp FROM d GROUP BY 1 HAVING count(DISTINCT body) > 1),
    r AS (SELECT node, min(node) OVER (PARTITION BY body) AS f, grp FROM d LEFT JOIN g USING (claim))
    SELECT node, CASE WHEN f < node THEN coalesce(grp, f) ELSE coalesce(grp, node) END AS claim, CASE WHEN f < node THEN 'restatement' WHEN grp IS NOT NULL THEN 'group' ELSE 'single' END AS via FROM r"""
_VERTEX = lambda label, tbl, key, title: f"SELECT '{label}:' || {key} AS gid, '{label}' AS label, {key}::VARCHAR AS key, coalesce(nullif(trim({title}), ''), '{label} ' || {key}) AS title FROM {tbl}"
_GRAPH = "v AS (" + " UNION ALL ".join(_VERTEX(*x) for x in (("Source", "sources", "id", "slug"), ("Author", "authors", "id", "display_name"), ("Document", "documents", "doc_id", "title"), ("Conversation", "conversations", "id", "external_id"), ("Session", "sessions", "id", "title"))) + """),
    e0 AS (SELECT 'FROM_SOURCE' AS label, 'Document:' || doc_id AS src, 'Source:' || source_id AS dst FROM documents UNION SELECT 'FROM_SOURCE', 'Conversation:' || id, 'Source:' || source_id FROM conversations UNION SELECT 'FROM_SOURCE', 'Session:' || id, 'Source:' || source_id FROM sessions
      UNION SELECT 'WROTE', 'Author:' || author_id, 'Conversation:' || conversation_id FROM messages UNION SELECT 'RECEIVED', 'Author:' || other_author_id, 'Conversation:' || id FROM conversations UNION SELECT 'SPAWNED', 'Session:' || parent_session_id, 'Session:' || id FROM sessions),
    e AS (SELECT DISTINCT * FROM e0 WHERE src IN (SELECT gid FROM v) AND dst IN (SELECT gid FROM v))"""
_SUBJECT = rf"lower(trim(regexp_replace(regexp_replace(json_extract_string(meta, '$.subject'), '(?i)^(\s*((({'|'.join(text.SUBJECT_MARKS)})\s*(\[\d+\])?\s*:)|\[[^\]]*\])\s*)+', ''), '\s+', ' ', 'g')))"
ORACLES = {
    "distilled_centroids": f"WITH {_MEAN} SELECT label, n, (generate_subscripts(v, 1) - 1)::INTEGER AS pos, round(unnest(v) / size, 6) AS x FROM nm",
    "truncate_mrl": "WITH t AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS v FROM embeddings), s AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM t) SELECT vec_id, (generate_subscripts(v, 1) - 1)::INTEGER AS pos, round(unnest(v) / size, 6) AS x FROM s",
    "binary_signs": "SELECT vec_id, w::INTEGER AS word, length(list_filter(embedding[32 * w + 1:32 * w + 32], lambda x: x > 0))::INTEGER AS ones FROM embeddings, (VALUES (0), (1)) t(w)",
    "knn_per_row": "SELECT q.vec_id AS query, b.vec_id AS neighbour, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id)::INTEGER AS rank FROM embeddings q JOIN embeddings b ON q.label = b.label AND q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10",
    "pairs_above_threshold": f"WITH {_PAIRS} SELECT vec_id, count(*) AS links, round(max(s), 6) AS closest FROM (SELECT a AS vec_id, s FROM p UNION ALL SELECT b, s FROM p) GROUP BY 1",
    "group_variability": f"WITH {_MEAN} SELECT label, n, round(avg(d), 6) AS spread, round(max(d), 6) AS radius, round(1 - sqrt((1 + (n - 1) * 0.97) / n), 6) AS tight, max(d) > 1 - sqrt((1 + (n - 1) * 0.97) / n) AS loose FROM (SELECT label, n, 1 - list_cosine_similarity(embedding::DOUBLE[], v) AS d FROM embeddings JOIN nm USING (label)) GROUP BY label, n",
    "restatement_components": f"WITH {_PAIRS}, l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (WITH RECURSIVE r AS (SELECT DISTINCT a AS node, a AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other) SELECT * FROM r) SELECT node, min(other) AS component FROM r GROUP BY 1",
    "cluster_incremental": f"WITH {_MEAN}, c AS (SELECT vec_id AS node, nm.label AS grp, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS s FROM embeddings, nm QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nm.label) = 1) SELECT node, CASE WHEN s >= {ALIKE} THEN grp END AS grp FROM c",
    "join_anchors": f"WITH {_MEAN}, c AS (SELECT vec_id AS node, nm.label AS grp, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS s FROM embeddings, nm QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nm.label) = 1) SELECT node, grp, round(s, 6) AS similarity FROM c WHERE s >= {ALIKE}",
    "guarded_holds": f"WITH {_PAIRS} SELECT count(*) AS facts, 0 AS mixed, 0 AS loose FROM (SELECT a FROM p UNION SELECT b FROM p)",
    "cluster_full_holds": "SELECT count(*) AS facts, count(*) AS nodes, 0 AS mixed, 0 AS misnamed FROM embeddings",
    "finish_links": _FINISH,
    "cluster_totals": f"SELECT coalesce(sum(n), 0)::BIGINT AS facts, count(*) AS claims, count(*) FILTER (n > 1) AS clusters, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS clustered, count(*) FILTER (n = 1) AS singles FROM (SELECT claim, count(*) AS n FROM ({_FINISH}) GROUP BY 1)",
    "representatives": f"SELECT {_CLAIM} AS claim, arg_max(doc_id, (length(text), -doc_id)) AS representative, count(*) AS members FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "members_sha256": f"SELECT {_CLAIM} AS claim, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS members_sha256 FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "anchors": f"SELECT {_SUBJECT} AS subject, arg_min(id, (sent_at, id)) AS anchor, count(*) AS members FROM messages WHERE json_extract_string(meta, '$.subject') IS NOT NULL GROUP BY 1",
    "graph_vertices": f"WITH {_GRAPH} SELECT * FROM v",
    "graph_edges": f"WITH {_GRAPH} SELECT * FROM e",
    "graph_label_counts": f"WITH {_GRAPH} SELECT label, count(*) AS n FROM v GROUP BY 1 UNION ALL SELECT label, count(*) FROM e GROUP BY 1",
    "graph_find": f"WITH {_GRAPH} SELECT gid, label, title FROM v WHERE title ILIKE '%lighthouse%' OR key = 'lighthouse' ORDER BY label, title, gid LIMIT 40",
    "graph_neighborhood": f"""WITH {_GRAPH}, ok AS (SELECT gid FROM v WHERE label IN ('Author', 'Conversation', 'Source')), l AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
        s0 AS (SELECT gid, 0 AS hops FROM v WHERE label = 'Author' AND title ILIKE 'felix%'), s1 AS (SELECT DISTINCT b AS gid, 1 AS hops FROM s0 JOIN l ON a = gid WHERE b IN (FROM ok) AND b NOT IN (SELECT gid FROM s0)),
        s2 AS (SELECT DISTINCT b AS gid, 2 AS hops FROM s1 JOIN l ON a = gid WHERE b IN (FROM ok) AND b NOT IN (SELECT gid FROM s0) AND b NOT IN (SELECT gid FROM s1))
        SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2""",
}
