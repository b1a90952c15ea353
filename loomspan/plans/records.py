"""Queries over keyed records: links, people, turns, groups, outcomes, chunks and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import chunkers, fts, text, vectors
from loomspan.operators import cluster, graph, ingest, records
from loomspan.operators.prefix import running_sum
from loomspan.plans import corpus, knowledge, search
from loomspan.session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def linked_sources(spark, sf_dir):
    """Documents of enabled file systems, or with a copy in one."""
    d = _docs(spark, sf_dir)
    held = d.select("content_sha256", F.col("source_id").alias("_s")).distinct()
    links = d.join(held, "content_sha256").where("_s <> source_id").select("doc_id", F.col("_s").alias("source_id"))
    wanted = table(spark, sf_dir, "sources").where("enabled and kind = 'filesystem'").select(F.col("id").alias("source_id"))
    return records.in_sources(d, links, wanted).select("doc_id")


def link_merge(spark, sf_dir):
    """The first document of each content, with the titles its copies may have."""
    d = _docs(spark, sf_dir).where("content_sha256 is not null").select("doc_id", "content_sha256", "title", "ingested_at")
    owners = ingest.latest(d, ["content_sha256"], [F.asc("ingested_at"), F.asc("doc_id")])
    links = d.join(owners.select("doc_id"), "doc_id", "left_anti")
    return records.merge_links(owners, links, "content_sha256", ["ingested_at", "doc_id"]).select("doc_id", "title", "links")


def orphan_vectors(spark, sf_dir):
    """Vectors without a document, and searchable documents without a usable vector."""
    v, d = table(spark, sf_dir, "emb_quill"), _docs(spark, sf_dir)
    lost = records.orphans(v, d, "chunk_id", "doc_id").withColumn("what", F.lit("vector"))
    missing = records.orphans(d.where("state = 'ok'"), v.where(vectors.usable(F.col("embedding"), 64)), "doc_id", "chunk_id").withColumn("what", F.lit("document"))
    return lost.unionByName(missing)


def bulk_update(spark, sf_dir):
    """Names of authors who have notes, written again in capitals."""
    a = table(spark, sf_dir, "authors").select("id", "display_name")
    new = table(spark, sf_dir, "authors").where("notes is not null").select("id", F.upper(F.trim("display_name")).alias("display_name"))
    return records.bulk_update(a, new, "id", ["display_name"])


def author_resolution(spark, sf_dir):
    """Authors as they come in again: known by handle, by name, or new (with another name)."""
    a = table(spark, sf_dir, "authors").select("id", "display_name", text.handle_key(F.col("display_name")).alias("key"), F.lower(F.trim("display_name")).alias("name"))
    again = a.select(F.col("id").cast("string").alias("ref"), "key", "name")
    other = a.select(F.concat(F.lit("new "), "id").alias("ref"), F.lit(None).cast("string").alias("key"), F.concat(F.lit("new "), "name").alias("name"))
    return records.resolve_people(again.unionByName(other), a.select("key", F.col("id").alias("author_id")), a.select("name", F.col("id").alias("author_id")))


def adopted_links(spark, sf_dir):
    """Who writes in which thread, authors of one name merged into the first."""
    a = table(spark, sf_dir, "authors").select("id", F.lower(F.trim("display_name")).alias("name"))
    first = a.groupBy("name").agg(F.min("id").alias("now"))
    links = table(spark, sf_dir, "messages").select("conversation_id", "author_id", F.lit("author").alias("role"))
    others = table(spark, sf_dir, "conversations").select(F.col("id").alias("conversation_id"), F.col("other_author_id").alias("author_id"), F.lit("recipient").alias("role"))
    return records.rewrite_links(links.unionByName(others), a.join(first, "name").select(F.col("id").alias("was"), "now"), "author_id")


def turn_sync(spark, sf_dir):
    """First readings without tool turns as stored, last readings without system turns as the payload."""
    t = table(spark, sf_dir, "session_turns").select("id", "session_id", "external_id", "parent_external_id", "role", "content")
    keys = ["session_id", "external_id"]
    stored = ingest.latest(t.where("role <> 'tool'"), keys, [F.asc("id")])
    payload = ingest.latest(t.where("role <> 'system'"), keys, [F.desc("id")])
    return records.sync_turns(stored, payload, keys, "parent_external_id", ["role", "content"])


def complete_means(spark, sf_dir):
    """Means of four vectors in a row, where all four are usable."""
    rows = table(spark, sf_dir, "emb_quill").select(F.floor(F.col("chunk_id") / 4).alias("grp"), "embedding")
    return records.complete_means(rows, "grp", "embedding", 64).select("grp", F.posexplode("mean").alias("pos", "x")).select("grp", "pos", F.round("x", 5).alias("x"))


def parse_instants(spark, sf_dir):
    """Times of events written as seconds, milliseconds and ISO text, read again."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    kinds = F.explode(F.array(F.struct(F.lit("s").alias("kind"), F.floor(F.col("us") / 1000000).cast("string").alias("t")), F.struct(F.lit("ms").alias("kind"), F.floor(F.col("us") / 1000).cast("string").alias("t")), F.struct(F.lit("iso").alias("kind"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("t"))))
    return e.select("event_id", kinds.alias("k")).select("event_id", "k.kind", F.unix_micros(text.parse_instant(F.col("k.t"))).alias("us"))


def remembered_failures(spark, sf_dir):
    """Readings that failed before are not tried again with the same bytes and reader."""
    d = _docs(spark, sf_dir).where("title is not null").select("doc_id", "source_id", "title", "state", "ingested_at", F.col("content_sha256").alias("bytes_sha"), F.coalesce("mime", F.lit("")).alias("revision"))
    keys = ["source_id", "title"]
    newest = ingest.latest(d, keys, [F.desc("ingested_at"), F.desc("doc_id")])
    return records.remembered(newest, d.where("state = 'extract_failed'"), keys).select("doc_id", "action")


FILES = "corpus_class = 'document'"


def materialize_stalls(spark, sf_dir):
    """Files to fetch where placeholders stall and failed extractions are not charged."""
    d = _docs(spark, sf_dir).select("doc_id", "source_id", "n_chars", "state")
    return ingest.within_budget(d, "source_id", ["doc_id"], F.col("n_chars"), 60_000, failed=F.col("state") == "extract_failed", stalled=F.col("state") == "placeholder").select("doc_id")


def _claims(spark, sf_dir, where):
    d = _docs(spark, sf_dir).where("text is not null").where(where).select("doc_id", F.sha2(text.normalize_fact(F.col("text")), 256).alias("claim"))
    grouped = d.groupBy("claim").agg(F.min("doc_id").alias("grp"), F.count("*").alias("n"))
    return grouped.join(cluster.members_hash(d, "claim", "doc_id"), "claim")


def reuse_groups(spark, sf_dir):
    """Groups of documents with one claim; those of files alone are the stored ones."""
    return records.reuse_groups(_claims(spark, sf_dir, "true"), _claims(spark, sf_dir, FILES))


def membership_drift(spark, sf_dir):
    """Groups of files' claims that other documents have joined since."""
    old = _claims(spark, sf_dir, FILES).withColumn("grp", F.col("claim"))
    now = _claims(spark, sf_dir, "true").withColumn("grp", F.col("claim"))
    return records.drifted(now, old)


def fact_search(spark, sf_dir):
    """Facts of documents and mails of enabled sources that hold one of two words, or a piece of text; the best 300."""
    f = corpus.facts(spark, sf_dir).where(F.col("corpus_class").isin("document", "communication"))
    on = table(spark, sf_dir, "sources").where("enabled").select(F.col("id").alias("source_id"))
    found = records.matching_facts(f.join(on, "source_id", "left_semi"), fts.tokens(F.col("fact")), search.TERMS, "_ ")
    return found.orderBy(F.desc("hits"), F.desc("doc_id"), F.desc("ord")).limit(300).select("doc_id", "ord", "hits")


def model_stats(spark, sf_dir):
    """Vectors of each model and the documents it has still to see."""
    sizes = table(spark, sf_dir, "emb_quill").where("embedding is not null").select(F.lit("quill").alias("model"), F.size("embedding").alias("width")).unionByName(table(spark, sf_dir, "embeddings").select(F.lit("facts").alias("model"), F.size("embedding").alias("width")))
    per = sizes.groupBy("model", "width").agg(F.count("*").alias("vectors"))
    all_ = _docs(spark, sf_dir).where("state = 'ok'").agg(F.count("*").alias("_all"))
    return per.crossJoin(F.broadcast(all_)).select("model", "width", "vectors", F.greatest(F.col("_all") - F.col("vectors"), F.lit(0)).alias("pending"))


#: Characters of a message chunk.
MESSAGE_SIZE = 1000


def message_chunks(spark, sf_dir):
    """Messages in the document of their thread, one chunk each, longer ones cut; told by what holds of the chunks of each message."""
    m = table(spark, sf_dir, "messages").select("id", "conversation_id", "sent_at", "body", F.length("body").alias("chars"))
    placed = running_sum(m, "conversation_id", ["sent_at", "id"], F.col("chars") + 2, "char_start")
    pieces = placed.select("id", "chars", "char_start", F.posexplode(chunkers.spans(F.col("body"), MESSAGE_SIZE)).alias("ord", "s"))
    return pieces.groupBy("id").agg(
        F.min(F.col("char_start") + F.col("s.start")).alias("char_start"), F.max(F.col("char_start") + F.col("s.end")).alias("char_end"),
        F.sum(F.col("s.end") - F.col("s.start")).alias("covered"), (F.max(F.col("s.end") - F.col("s.start")) <= MESSAGE_SIZE).alias("fits"), (F.count("*") > 1).alias("cut"),
    )


def chunk_holds(spark, sf_dir):
    """What holds of the chunks of every document: within the size, numbered without repeats, in order, and nothing but white space left out."""
    out = None
    for kind, size in (("prose", chunkers.SIZE), ("code", chunkers.CODE_SIZE), ("table", chunkers.SIZE)):
        d = _docs(spark, sf_dir).where("content is not null")
        c = chunkers.chunk_documents(d, "doc_id", "content", F.lit(kind), text.extension(F.col("uri")))
        black = lambda x: F.length(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", ""))
        per = c.groupBy("doc_id").agg((F.max(F.length("chunk")) <= size).alias("fits"), (F.countDistinct("ord") == F.count("*")).alias("numbered"), F.sum(black(F.col("chunk"))).alias("kept"))
        rows = d.join(per, "doc_id").select(F.lit(kind).alias("kind"), "doc_id", "fits", "numbered", (F.col("kept") >= black(F.col("content"))).alias("whole"))
        out = rows if out is None else out.unionByName(rows)
    return out


def graph_fact_edges(spark, sf_dir):
    """Facts in the graph: documents state them, repeated ones restate the first of their claim, claims are supported by all."""
    f = corpus.facts(spark, sf_dir).select("doc_id", "ord", F.sha2(text.normalize_fact(F.col("fact")), 256).alias("claim")).withColumn("fact_id", F.concat_ws("/", "doc_id", "ord"))
    first = f.groupBy("claim").agg(F.min(F.struct("doc_id", "ord")).alias("b")).select("claim", F.concat_ws("/", "b.doc_id", "b.ord").alias("first"))
    known = f.join(first, "claim")
    states = f.select(F.lit("STATES").alias("label"), graph.gid("Document", F.col("doc_id")).alias("src"), graph.gid("Fact", F.col("fact_id")).alias("dst"))
    restates = known.where("fact_id <> first").select(F.lit("RESTATES").alias("label"), graph.gid("Fact", F.col("fact_id")).alias("src"), graph.gid("Fact", F.col("first")).alias("dst"))
    supports = known.select(F.lit("SUPPORTS").alias("label"), graph.gid("Fact", F.col("fact_id")).alias("src"), graph.gid("Claim", F.col("claim")).alias("dst"))
    return states.unionByName(restates).unionByName(supports)


#: Labels that relations may carry; others become RELATED_TO.
RELATIONS = ("MAILED", "TALKED_TO")


def graph_relations(spark, sf_dir):
    """Relations named by the texts of their ends: who wrote to whom, each end found among authors first, then sources, by the smallest id."""
    people = table(spark, sf_dir, "authors").select("id", "display_name")
    c = table(spark, sf_dir, "conversations").select(F.col("id").alias("conversation_id"), "external_id", F.col("other_author_id").alias("_o"))
    m = table(spark, sf_dir, "messages").select("conversation_id", "author_id").distinct().join(c, "conversation_id")
    named = m.join(people.select(F.col("id").alias("author_id"), F.col("display_name").alias("subject")), "author_id").join(people.select(F.col("id").alias("_o"), F.col("display_name").alias("object")), "_o")
    label = F.when(F.col("external_id").startswith("iMessage;"), "talked to").when(F.col("external_id").startswith("SMS;"), "texted").otherwise("mailed")
    v, _ = knowledge._graph(spark, sf_dir)
    ends = v.where(F.col("label").isin("Author", "Source")).select("gid", F.lower(F.trim("title")).alias("name"), F.struct((F.col("label") != "Author").cast("int").alias("k"), F.col("key").cast("long").alias("i")).alias("rank"))
    return graph.relations(named.select("subject", text.relation_label(label).alias("label"), "object"), ends, RELATIONS)


def graph_limited(spark, sf_dir):
    """One step around the authors called Felix, up to fifty vertices, and whether more were left out."""
    v, e = knowledge._graph(spark, sf_dir)
    seeds = v.where(F.col("title").ilike("felix%") & (F.col("label") == "Author"))
    seen, truncated = graph.neighbourhood_within(v, e, seeds, 1, ["Author", "Conversation", "Source"], 50)
    return seen.withColumn("truncated", F.lit(truncated))


QUERIES = {f.__name__: f for f in (linked_sources, link_merge, orphan_vectors, bulk_update, author_resolution, adopted_links, turn_sync, complete_means, parse_instants, remembered_failures, materialize_stalls, reuse_groups, membership_drift, fact_search, model_stats, message_chunks, chunk_holds, graph_fact_edges, graph_relations, graph_limited)}

_OK = "coalesce(length(embedding) = 64 AND length(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND length(list_filter(embedding, lambda x: x <> 0)) > 0, false)"
_TEXT = corpus._FOLD.replace("fact", "text")
_CLAIM = rf"sha256(trim(regexp_replace(trim(regexp_replace({_TEXT}, '[\s\x0B]+', ' ', 'g')), '[.!?;:,]+$', '')))"
_FACT_CLAIM = rf"sha256(trim(regexp_replace(trim(regexp_replace({corpus._FOLD}, '[\s\x0B]+', ' ', 'g')), '[.!?;:,]+$', '')))"
_GROUPS = lambda where: f"(SELECT {_CLAIM} AS claim, min(doc_id) AS grp, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS sha FROM documents WHERE text IS NOT NULL AND {where} GROUP BY 1)"
_STORED = _GROUPS(FILES)
_BLANKS = r"[\s\x0B\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ORACLES = {
    "linked_sources": "WITH w AS (SELECT id FROM sources WHERE enabled AND kind = 'filesystem') SELECT doc_id FROM documents d WHERE source_id IN (FROM w) OR EXISTS (SELECT 1 FROM documents o WHERE o.content_sha256 = d.content_sha256 AND o.source_id <> d.source_id AND o.source_id IN (FROM w))",
    "link_merge": """WITH d AS (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY ingested_at, doc_id) AS r FROM documents WHERE content_sha256 IS NOT NULL)
        SELECT doc_id, coalesce(CASE WHEN trim(title) <> '' THEN title END, t) AS title, coalesce(n, 0) AS links FROM d LEFT JOIN (SELECT content_sha256 AS c, count(*) AS n, arg_min(title, (ingested_at, doc_id)) FILTER (trim(title) <> '') AS t FROM d WHERE r > 1 GROUP BY 1) ON c = content_sha256 WHERE r = 1""",
    "orphan_vectors": f"SELECT chunk_id AS id, 'vector' AS what FROM emb_quill WHERE chunk_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'document' FROM documents WHERE state = 'ok' AND doc_id NOT IN (SELECT chunk_id FROM emb_quill WHERE {_OK})",
    "bulk_update": "SELECT id, CASE WHEN notes IS NOT NULL THEN upper(trim(display_name, ' ')) ELSE display_name END AS display_name FROM authors",
    "author_resolution": f"""WITH a AS (SELECT id, lower(trim(display_name, ' ')) AS name, {corpus._KEY} AS key FROM (SELECT *, regexp_replace(display_name, '^\\s+|\\s+$', '', 'g') AS n FROM authors))
        SELECT id::VARCHAR AS ref, CASE WHEN key IS NOT NULL THEN (SELECT min(b.id) FROM a b WHERE b.key = a.key) ELSE (SELECT min(b.id) FROM a b WHERE b.name = a.name) END AS author_id, CASE WHEN key IS NOT NULL THEN 'identity' ELSE 'name' END AS how FROM a
        UNION ALL SELECT 'new ' || id, NULL, 'create' FROM a""",
    "adopted_links": """WITH r AS (SELECT id, min(id) OVER (PARTITION BY lower(trim(display_name, ' '))) AS now FROM authors), l AS (SELECT conversation_id, author_id, 'author' AS role FROM messages UNION ALL SELECT id, other_author_id, 'recipient' FROM conversations)
        SELECT DISTINCT conversation_id, coalesce(now, author_id) AS author_id, role FROM l LEFT JOIN r ON r.id = author_id""",
    "turn_sync": """WITH o AS (SELECT * FROM session_turns WHERE role <> 'tool' QUALIFY row_number() OVER (PARTITION BY session_id, external_id ORDER BY id) = 1), p AS (SELECT * FROM session_turns WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY session_id, external_id ORDER BY id DESC) = 1)
        SELECT coalesce(o.session_id, p.session_id) AS session_id, coalesce(o.external_id, p.external_id) AS external_id, CASE WHEN p.id IS NULL THEN 'delete' WHEN o.id IS NULL THEN 'insert' WHEN o.role IS NOT DISTINCT FROM p.role AND o.content IS NOT DISTINCT FROM p.content THEN 'keep' ELSE 'update' END AS action, u.id AS parent
        FROM o FULL JOIN p ON o.session_id = p.session_id AND o.external_id = p.external_id LEFT JOIN p u ON u.session_id = p.session_id AND u.external_id = p.parent_external_id""",
    "complete_means": f"""WITH e AS (SELECT chunk_id // 4 AS grp, embedding::DOUBLE[] AS v, {_OK} AS ok FROM emb_quill), g AS (SELECT grp FROM e GROUP BY 1 HAVING bool_and(ok)), m AS (SELECT grp, pos, avg(x) AS x FROM (SELECT grp, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e SEMI JOIN g USING (grp)) GROUP BY ALL)
        SELECT grp, pos::INTEGER AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY grp)), 5) AS x FROM m""",
    "parse_instants": "SELECT event_id, kind, CASE WHEN kind = 'ms' THEN epoch_us(ts) // 1000 * 1000 ELSE epoch_us(ts) // 1000000 * 1000000 END AS us FROM events, (VALUES ('s'), ('ms'), ('iso')) k(kind)",
    "remembered_failures": """WITH n AS (SELECT * FROM documents WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id, title ORDER BY ingested_at DESC, doc_id DESC) = 1)
        SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents f WHERE f.state = 'extract_failed' AND f.source_id = n.source_id AND f.title = n.title AND f.content_sha256 = n.content_sha256 AND coalesce(f.mime, '') = coalesce(n.mime, '')) THEN 'skip_failed' ELSE 'try' END AS action FROM n""",
    "materialize_stalls": """SELECT doc_id FROM (SELECT doc_id, coalesce(sum(CASE WHEN state IN ('extract_failed', 'placeholder') THEN 0 ELSE n_chars END) OVER w, 0) AS b, coalesce(sum((state = 'placeholder')::INTEGER) OVER w, 0) AS h FROM documents WINDOW w AS (PARTITION BY source_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE b < 60000 AND h < 4""",
    "reuse_groups": f"SELECT grp, (SELECT min(o.grp) FROM {_STORED} o WHERE o.sha = g.sha) AS kept FROM {_GROUPS('true')} g",
    "membership_drift": f"SELECT o.claim AS grp, o.n AS before, g.n AS now FROM {_STORED} o LEFT JOIN {_GROUPS('true')} g USING (claim) WHERE g.sha IS DISTINCT FROM o.sha",
    "fact_search": f"WITH {corpus._FACTS}, h AS (SELECT doc_id, ord, fact, length(list_filter(regexp_extract_all(lower(fact), '[\\p{{L}}\\p{{N}}]+'), lambda x: x IN ({search._IN}))) AS hits FROM facts WHERE corpus_class IN ('document', 'communication') AND source_id IN (SELECT id FROM sources WHERE enabled)) SELECT doc_id, ord::INTEGER AS ord, hits::INTEGER AS hits FROM h WHERE hits > 0 OR contains(lower(fact), '_ ') ORDER BY hits DESC, doc_id DESC, ord DESC LIMIT 300",
    "model_stats": "WITH v AS (SELECT 'quill' AS model, length(embedding) AS width FROM emb_quill WHERE embedding IS NOT NULL UNION ALL SELECT 'facts', length(embedding) FROM embeddings) SELECT model, width::INTEGER AS width, count(*) AS vectors, greatest((SELECT count(*) FROM documents WHERE state = 'ok') - count(*), 0) AS pending FROM v GROUP BY 1, 2",
    "message_chunks": f"SELECT id, char_start::BIGINT AS char_start, (char_start + length(body))::BIGINT AS char_end, length(body) AS covered, true AS fits, length(body) > {MESSAGE_SIZE} AS cut FROM (SELECT *, coalesce(sum(length(body) + 2) OVER (PARTITION BY conversation_id ORDER BY sent_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM messages) WHERE length(body) > 0",
    "chunk_holds": f"SELECT kind, doc_id, true AS fits, true AS numbered, true AS whole FROM documents, (VALUES ('prose'), ('code'), ('table')) k(kind) WHERE length(regexp_replace(content, '{_BLANKS}+', '', 'g')) > 0",
    "graph_fact_edges": f"""WITH {corpus._FACTS}, f AS (SELECT doc_id, ord, doc_id || '/' || ord AS id, {_FACT_CLAIM} AS claim FROM facts), k AS (SELECT *, first_value(id) OVER (PARTITION BY claim ORDER BY doc_id, ord) AS f1 FROM f)
        SELECT 'STATES' AS label, 'Document:' || doc_id AS src, 'Fact:' || id AS dst FROM f UNION ALL SELECT 'RESTATES', 'Fact:' || id, 'Fact:' || f1 FROM k WHERE id <> f1 UNION ALL SELECT 'SUPPORTS', 'Fact:' || id, 'Claim:' || claim FROM f""",
    "graph_relations": f"""WITH {knowledge._GRAPH}, n AS (SELECT arg_min(gid, (label <> 'Author', key::BIGINT)) AS gid, lower(trim(title)) AS name FROM v WHERE label IN ('Author', 'Source') GROUP BY 2)
        SELECT DISTINCT CASE WHEN c.external_id LIKE 'iMessage;%' THEN 'TALKED_TO' WHEN c.external_id LIKE 'SMS;%' THEN 'RELATED_TO' ELSE 'MAILED' END AS label, s.gid AS src, o.gid AS dst
        FROM messages m JOIN conversations c ON c.id = m.conversation_id JOIN authors a ON a.id = m.author_id JOIN authors b ON b.id = c.other_author_id JOIN n s ON s.name = lower(trim(a.display_name)) JOIN n o ON o.name = lower(trim(b.display_name))""",
    "graph_limited": f"""WITH {knowledge._GRAPH}, ok AS (SELECT gid FROM v WHERE label IN ('Author', 'Conversation', 'Source')), l AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), s0 AS (SELECT gid FROM v WHERE label = 'Author' AND title ILIKE 'felix%'),
        s1 AS (SELECT DISTINCT b AS gid FROM s0 JOIN l ON a = gid WHERE b IN (FROM ok) AND b NOT IN (FROM s0)), kept AS (SELECT gid FROM s1 ORDER BY gid LIMIT (SELECT greatest(0, 50 - count(*)) FROM s0)), flag AS (SELECT (SELECT count(*) FROM s1) > (SELECT count(*) FROM kept) AS truncated)
        SELECT gid, 0 AS hops, truncated FROM s0, flag UNION ALL SELECT gid, 1, truncated FROM kept, flag""",
}
