"""Listings, statistics, ingest and session queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import text, vectors
from loomspan.operators import hierarchy, ingest
from loomspan.operators.prefix import running_sum
from loomspan.session import cut, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "sources")


def corpus_overview(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("corpus_class", "trust_tier").agg(F.countDistinct("content_sha256").alias("contents"), F.count("*").alias("documents"))


def list_sources(spark, sf_dir):
    counts = _docs(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("documents"), F.count(F.when(F.col("state") == "ok", 1)).alias("searchable"))
    return _sources(spark, sf_dir).join(counts, F.col("id") == F.col("source_id"), "left").select("slug", "kind", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("searchable", F.lit(0)).alias("searchable"))


def list_authors(spark, sf_dir):
    """Authors with messages, threads and the kinds of thread they write in."""
    m = table(spark, sf_dir, "messages").join(table(spark, sf_dir, "conversations").select(F.col("id").alias("conversation_id"), F.when(F.col("external_id").rlike("^(iMessage|SMS);"), "chat").otherwise("mail").alias("kind")), "conversation_id")
    per = m.groupBy("author_id").agg(F.count("*").alias("messages"), F.countDistinct("conversation_id").alias("threads"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return table(spark, sf_dir, "authors").join(per, F.col("id") == F.col("author_id"), "left").select("id", "display_name", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("threads", F.lit(0)).alias("threads"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def corpus_stats(spark, sf_dir):
    d = _docs(spark, sf_dir).agg(F.count("*").alias("documents"), F.count_if(F.col("state") == "placeholder").alias("placeholders"), F.count_if(F.col("state") == "extract_failed").alias("failed"))
    v = table(spark, sf_dir, "emb_quill").agg(F.count("*").alias("vectors"), F.count_if(vectors.usable(F.col("embedding"), 64)).alias("usable"))
    a = table(spark, sf_dir, "authors").agg(F.count("*").alias("authors"))
    return d.crossJoin(v).crossJoin(a).withColumn("pending", F.greatest(F.col("documents") - F.col("vectors"), F.lit(0)))


def source_stats(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source_id", "state").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.unix_micros(F.max("ingested_at")).alias("last"))


def list_documents(spark, sf_dir):
    """A page of documents by title or address, newest first, with the copies each has."""
    docs = _docs(spark, sf_dir)
    copies = docs.groupBy("content_sha256").agg(F.count("*").alias("copies"))
    found = docs.where((F.col("title").ilike("%ledger%") | F.col("uri").ilike("%ledger%")) & F.col("corpus_class").isin("document", "communication"))
    page = found.orderBy(F.desc("ingested_at"), F.desc("doc_id")).limit(70).offset(20)
    return page.join(copies, "content_sha256", "left").select("doc_id", "title", "uri", F.coalesce("copies", F.lit(1)).alias("copies"))


def get_document(spark, sf_dir):
    most = 2000
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.substring("text", 1, most), 256).alias("shown"), (F.length("text") > most).alias("truncated"))


def facts(spark, sf_dir):
    """Potential facts: the non-blank lines of all documents."""
    lines = _docs(spark, sf_dir).select("doc_id", "source_id", "corpus_class", "text", F.posexplode(F.split("text", "\n")).alias("ord", "fact"))
    return lines.where(F.col("fact").rlike(r"\S"))


def list_facts(spark, sf_dir):
    found = facts(spark, sf_dir).where(F.lower("fact").contains("50") & (F.col("corpus_class") == "document"))
    return found.orderBy(F.desc("doc_id"), "ord").limit(500).select("doc_id", "ord", "fact")


def fact_excerpts(spark, sf_dir):
    """Where each mention stands, with 200 characters around it."""
    at = F.locate("lighthouse", F.lower("text"))
    return _docs(spark, sf_dir).where(at > 0).select("doc_id", (at - 1).alias("start"), F.sha2(F.substring(F.col("text"), F.greatest(at - 200, F.lit(1)), at + 10 + 200 - F.greatest(at - 200, F.lit(1))), 256).alias("excerpt"))


def list_facts_collapsed(spark, sf_dir):
    """One fact of each set that says the same: the longest, then the first."""
    f = facts(spark, sf_dir).select("doc_id", "ord", "fact", F.sha2(text.normalize_fact(F.col("fact")), 256).alias("claim"))
    best = F.max_by(F.struct("doc_id", "ord"), F.struct(F.length("fact"), -F.col("doc_id"), -F.col("ord")))
    return f.groupBy("claim").agg(best.alias("b"), F.count("*").alias("n")).select("claim", F.col("b.doc_id").alias("doc_id"), F.col("b.ord").alias("ord"), "n")


def fact_stats(spark, sf_dir):
    f = facts(spark, sf_dir).groupBy("corpus_class", F.xxhash64("fact").alias("k")).agg(F.count("*").alias("n"))
    return f.groupBy("corpus_class").agg(F.sum("n").alias("facts"), F.count("*").alias("claims"), F.count_if(F.col("n") > 1).alias("repeated"))


def fact_facets(spark, sf_dir):
    return facts(spark, sf_dir).where(F.lower("fact").contains("winter")).groupBy("corpus_class", "source_id").agg(F.count("*").alias("n"))


def pending_chunks(spark, sf_dir):
    """Documents without a vector that may be sent to a remote provider."""
    docs = _docs(spark, sf_dir).where("state = 'ok' and corpus_class <> 'communication'").select("doc_id")
    return docs.join(table(spark, sf_dir, "emb_quill").where("embedding is not null").select(F.col("chunk_id").alias("doc_id")), "doc_id", "left_anti")


def _versions(spark, sf_dir):
    return _docs(spark, sf_dir).where("title is not null").select("doc_id", "source_id", "title", "mtime", F.col("n_chars").alias("size"), F.col("content_sha256").alias("bytes_sha"), F.sha2("text", 256).alias("text_sha"), F.col("mime").alias("chunker"), "ingested_at")


def skip_ladder(spark, sf_dir):
    """The newest reading of each (source, title) against the oldest one."""
    v = _versions(spark, sf_dir)
    keys = ["source_id", "title"]
    new = ingest.latest(v, keys, [F.desc("ingested_at"), F.desc("doc_id")])
    old = ingest.latest(v, keys, [F.asc("ingested_at"), F.asc("doc_id")])
    return ingest.skip_ladder(new, old.drop("doc_id", "ingested_at"), keys).select("source_id", "title", "action")


def _chunks(v):
    lines = F.split("text", "\n\n")
    return v.select(F.col("key").alias("document_id"), F.posexplode(lines).alias("ord", "t"), "mime").select("document_id", "ord", F.sha2("t", 256).alias("sha"), F.coalesce("mime", F.lit("text")).alias("chunker"))


def chunk_merge_actions(spark, sf_dir):
    d = _docs(spark, sf_dir).where("title is not null and text is not null").withColumn("key", F.concat_ws("/", "source_id", "title"))
    return ingest.chunk_actions(_chunks(ingest.latest(d, ["key"], [F.asc("ingested_at"), F.asc("doc_id")])), _chunks(ingest.latest(d, ["key"], [F.desc("ingested_at"), F.desc("doc_id")])))


def document_upsert(spark, sf_dir):
    return ingest.latest(_docs(spark, sf_dir), ["source_id", "title"], [F.desc("ingested_at"), F.desc("doc_id")]).select("source_id", "title", "doc_id")


def ownership_promotion(spark, sf_dir):
    claims = _docs(spark, sf_dir).join(_sources(spark, sf_dir).where("enabled").select(F.col("id").alias("source_id"), "kind"), "source_id").withColumnRenamed("ingested_at", "linked_at")
    return ingest.latest(claims, ["content_sha256"], [(F.col("kind") == "spotlight").asc(), F.asc("linked_at"), F.asc("source_id"), F.asc("doc_id")]).select("content_sha256", "source_id", "doc_id")


def reconcile_candidates(spark, sf_dir):
    """Documents older than a source's last thousand days count as not seen."""
    docs = _docs(spark, sf_dir)
    last = docs.groupBy("source_id").agg(F.max("ingested_at").alias("last"))
    seen = docs.join(last, "source_id").where(F.datediff("last", "ingested_at") <= 1000).select("source_id", "uri")
    return ingest.reconcile(docs, seen, ["source_id", "uri"]).select("doc_id", "source_id", "allowed")


def materialize_budget(spark, sf_dir):
    return ingest.within_budget(_docs(spark, sf_dir).select("doc_id", "source_id", "n_chars"), "source_id", ["doc_id"], F.col("n_chars"), 30_000).select("doc_id")


def contact_lookup(spark, sf_dir):
    """Names of handles in an address book that writes phone numbers with another prefix: mail addresses match whole, numbers by their last ten digits."""
    a = table(spark, sf_dir, "authors").select("id", text.handle_key(F.col("display_name")).alias("key")).where("key is not null")
    book = F.when(F.col("key").contains("@"), F.col("key")).otherwise(F.concat(F.lit("00"), "key"))
    return ingest.lookup_contacts(a, a.select(book.alias("key"), F.concat(F.lit("contact "), F.col("key")).alias("name"))).select("id", "name")


def _lineage(t, ends):
    """Turns on the way from each session's end (session_id, node) up to its root, or to where the way leaves the session; those with text of user and assistant numbered."""
    way = hierarchy.paths(t, "id", "parent_turn_id", wanted=ends).join(ends, "node")
    steps = way.select("session_id", F.col("path").isNull().alias("circled"), F.posexplode(F.coalesce("path", F.array("node"))).alias("at", "id")).join(t.select("id", F.col("session_id").alias("_s"), "role", "said"), "id")
    left = steps.where("_s <> session_id").groupBy("session_id").agg(F.max("at").alias("_left"))
    shown = steps.join(left, "session_id", "left").where(F.col("_left").isNull() | (F.col("at") > F.col("_left"))).where(F.col("said") & F.col("role").isin("user", "assistant"))
    shown = shown.select("id", "session_id", F.when(F.col("circled"), -1).otherwise(F.col("at")).alias("depth"))
    return running_sum(shown, "session_id", ["depth", "id"], F.lit(1), "active_ord").select("id", "session_id", F.col("active_ord").cast("long").alias("active_ord"))


def _said(spark, sf_dir):
    return table(spark, sf_dir, "session_turns").select("id", "session_id", "parent_turn_id", "ord", "role", F.coalesce(F.col("content").rlike(r"\S"), F.lit(False)).alias("said"))


def _last(t):
    return cut(t.groupBy("session_id").agg(F.max_by("id", F.struct("ord", "id")).alias("node")))


def active_lineage(spark, sf_dir):
    """The way up from each session's last turn."""
    t = _said(spark, sf_dir)
    return _lineage(t, _last(t))


def leaf_lineage(spark, sf_dir):
    """The way up from each session's last turn that nothing answers, as exports without a current turn have it."""
    t = _said(spark, sf_dir)
    return _lineage(t, _last(t.join(t.where("parent_turn_id is not null").select(F.col("parent_turn_id").alias("id")).distinct(), "id", "left_anti")))


def message_offsets(spark, sf_dir):
    """Each message of a thread as one chunk of the thread's document, with its offsets there."""
    m = table(spark, sf_dir, "messages").select("id", "conversation_id", "sent_at", F.length("body").alias("chars"))
    placed = running_sum(m, "conversation_id", ["sent_at", "id"], F.col("chars") + 2, "char_start")
    return placed.select("id", "conversation_id", "char_start", (F.col("char_start") + F.col("chars")).alias("char_end"))


def session_titles(spark, sf_dir):
    t = table(spark, sf_dir, "session_turns").where("active_ord is not null and role = 'user' and content is not null")
    line = F.get(F.filter(F.transform(F.split("content", "\n"), F.trim), lambda x: x != ""), F.lit(0))
    first = t.select("session_id", "active_ord", "id", line.alias("line")).where("line is not null").groupBy("session_id").agg(F.min_by("line", F.struct("active_ord", "id")).alias("line"))
    s = table(spark, sf_dir, "sessions").select(F.col("id").alias("session_id"), F.nullif(F.trim("title"), F.lit("")).alias("title"), "external_id")
    return s.join(first, "session_id", "left").select("session_id", F.coalesce(F.substring("title", 1, 200), F.substring("line", 1, 100), F.col("external_id")).alias("title"))


def session_sync(spark, sf_dir):
    """One row a (source, external id), the newest, with its parent found by external id."""
    s = ingest.latest(table(spark, sf_dir, "sessions"), ["source_id", "external_id"], [F.desc("updated_at"), F.desc("id")])
    up = s.select("source_id", F.col("external_id").alias("parent_external_id"), F.col("id").alias("found"))
    return s.join(up, ["source_id", "parent_external_id"], "left").select("id", F.coalesce("parent_session_id", "found").alias("parent"))


def config_sync(spark, sf_dir):
    s = _sources(spark, sf_dir)
    fields = ["kind", "root", "default_class", "default_trust", "enabled"]
    declared = s.select("slug", "kind", F.when(F.col("kind") == "filesystem", F.col("root")).otherwise("/elsewhere").alias("root"), "default_class", "default_trust", "enabled").unionByName(s.select(F.concat(F.lit("new-"), "slug").alias("slug"), *fields))
    return ingest.sync_sources(declared, s, fields)


QUERIES = {f.__name__: f for f in (corpus_overview, list_sources, list_authors, corpus_stats, source_stats, list_documents, get_document, list_facts, fact_excerpts, list_facts_collapsed, fact_stats, fact_facets, pending_chunks, skip_ladder, chunk_merge_actions, document_upsert, ownership_promotion, reconcile_candidates, materialize_budget, contact_lookup, active_lineage, leaf_lineage, message_offsets, session_titles, session_sync, config_sync)}

_FACTS = "facts AS (SELECT doc_id, source_id, corpus_class, ord - 1 AS ord, fact FROM (SELECT doc_id, source_id, corpus_class, unnest(string_split(text, chr(10))) AS fact, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents) WHERE regexp_matches(fact, '\\S'))"
_FOLD = "translate(lower(fact), 'ſςµ', 'sσμ')"
for _a, _b in (("ß", "ss"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st")):
    _FOLD = f"replace({_FOLD}, '{_a}', '{_b}')"
_KEY = r"CASE WHEN contains(n, '@') THEN lower(n) WHEN length(regexp_replace(n, '[^0-9]', '', 'g')) >= 7 THEN regexp_replace(n, '[^0-9]', '', 'g') END"
_VERSIONS = "v AS (SELECT doc_id, source_id, title, mtime, n_chars, content_sha256, sha256(text) AS tsha, mime, ingested_at FROM documents WHERE title IS NOT NULL)"
_CHUNK = lambda order: f"(SELECT key, i - 1 AS ord, sha256(c) AS sha, coalesce(mime, 'text') AS chunker FROM (SELECT key, mime, unnest(string_split(text, chr(10) || chr(10))) AS c, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM (SELECT source_id || '/' || title AS key, text, mime FROM documents WHERE title IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id || '/' || title ORDER BY {order}) = 1)))"
ORACLES = {
    "corpus_overview": "SELECT corpus_class, trust_tier, count(DISTINCT content_sha256) AS contents, count(*) AS documents FROM documents GROUP BY ALL",
    "list_sources": "SELECT slug, kind, count(doc_id) AS documents, count(doc_id) FILTER (state = 'ok') AS searchable FROM sources s LEFT JOIN documents d ON d.source_id = s.id GROUP BY ALL",
    "list_authors": "SELECT a.id, display_name, count(m.id) AS messages, count(DISTINCT m.conversation_id) AS threads, coalesce(string_agg(DISTINCT CASE WHEN m.id IS NULL THEN NULL WHEN regexp_matches(c.external_id, '^(iMessage|SMS);') THEN 'chat' ELSE 'mail' END, ',' ORDER BY CASE WHEN m.id IS NULL THEN NULL WHEN regexp_matches(c.external_id, '^(iMessage|SMS);') THEN 'chat' ELSE 'mail' END), '') AS kinds FROM authors a LEFT JOIN messages m ON m.author_id = a.id LEFT JOIN conversations c ON c.id = m.conversation_id GROUP BY ALL",
    "corpus_stats": "SELECT *, greatest(documents - vectors, 0) AS pending FROM (SELECT count(*) AS documents, count(*) FILTER (state = 'placeholder') AS placeholders, count(*) FILTER (state = 'extract_failed') AS failed FROM documents), (SELECT count(*) AS vectors, count(*) FILTER (length(embedding) = 64 AND length(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND length(list_filter(embedding, lambda x: x <> 0)) > 0) AS usable FROM emb_quill), (SELECT count(*) AS authors FROM authors)",
    "source_stats": "SELECT source_id, state, count(*) AS n, sum(n_chars)::BIGINT AS chars, epoch_us(max(ingested_at)) AS last FROM documents GROUP BY ALL",
    "list_documents": "WITH p AS (SELECT * FROM documents WHERE (title ILIKE '%ledger%' OR uri ILIKE '%ledger%') AND corpus_class IN ('document', 'communication') ORDER BY ingested_at DESC, doc_id DESC LIMIT 50 OFFSET 20) SELECT doc_id, title, uri, (SELECT count(*) FROM documents d WHERE d.content_sha256 = p.content_sha256) AS copies FROM p",
    "get_document": "SELECT doc_id, sha256(left(text, 2000)) AS shown, length(text) > 2000 AS truncated FROM documents",
    "list_facts": f"WITH {_FACTS} SELECT doc_id, ord::INTEGER AS ord, fact FROM facts WHERE contains(lower(fact), '50') AND corpus_class = 'document' ORDER BY doc_id DESC, ord LIMIT 500",
    "fact_excerpts": "SELECT doc_id, (at_ - 1)::INTEGER AS start, sha256(substr(text, greatest(at_ - 200, 1)::INTEGER, (at_ + 210 - greatest(at_ - 200, 1))::INTEGER)) AS excerpt FROM (SELECT doc_id, text, strpos(lower(text), 'lighthouse') AS at_ FROM documents) WHERE at_ > 0",
    "list_facts_collapsed": rf"WITH {_FACTS}, c AS (SELECT doc_id, ord, fact, sha256(trim(regexp_replace(trim(regexp_replace({_FOLD}, '[\s\x0B]+', ' ', 'g')), '[.!?;:,]+$', ''))) AS claim FROM facts) SELECT claim, doc_id, ord::INTEGER AS ord, n FROM (SELECT *, count(*) OVER (PARTITION BY claim) AS n FROM c QUALIFY row_number() OVER (PARTITION BY claim ORDER BY length(fact) DESC, doc_id, ord) = 1)",
    "fact_stats": f"WITH {_FACTS} SELECT corpus_class, sum(n)::BIGINT AS facts, count(*) AS claims, count(*) FILTER (n > 1) AS repeated FROM (SELECT corpus_class, fact, count(*) AS n FROM facts GROUP BY ALL) GROUP BY 1",
    "fact_facets": f"WITH {_FACTS} SELECT corpus_class, source_id, count(*) AS n FROM facts WHERE contains(lower(fact), 'winter') GROUP BY ALL",
    "pending_chunks": "SELECT doc_id FROM documents WHERE state = 'ok' AND corpus_class <> 'communication' AND doc_id NOT IN (SELECT chunk_id FROM emb_quill WHERE embedding IS NOT NULL)",
    "skip_ladder": f"""WITH {_VERSIONS}, n AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY source_id, title ORDER BY ingested_at DESC, doc_id DESC) = 1), o AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY source_id, title ORDER BY ingested_at, doc_id) = 1)
        SELECT n.source_id, n.title, CASE WHEN n.mtime = o.mtime AND n.n_chars = o.n_chars THEN 'skip_stat' WHEN n.content_sha256 IS NOT DISTINCT FROM o.content_sha256 THEN 'skip_bytes' WHEN n.tsha IS NOT DISTINCT FROM o.tsha AND n.mime IS NOT DISTINCT FROM o.mime THEN 'refresh_stat' ELSE 'replace' END AS action FROM n JOIN o USING (source_id, title)""",
    "chunk_merge_actions": f"""SELECT coalesce(o.key, n.key) AS document_id, coalesce(o.ord, n.ord)::INTEGER AS ord, CASE WHEN n.key IS NULL THEN 'delete' WHEN o.key IS NULL THEN 'insert' WHEN o.sha = n.sha AND o.chunker = n.chunker THEN 'keep' ELSE 'replace' END AS action
        FROM {_CHUNK('ingested_at, doc_id')} o FULL JOIN {_CHUNK('ingested_at DESC, doc_id DESC')} n ON o.key = n.key AND o.ord = n.ord""",
    "document_upsert": "SELECT source_id, title, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source_id, title ORDER BY ingested_at DESC, doc_id DESC) = 1",
    "ownership_promotion": "SELECT content_sha256, source_id, doc_id FROM documents d JOIN sources s ON s.id = d.source_id AND s.enabled QUALIFY row_number() OVER (PARTITION BY content_sha256 ORDER BY s.kind = 'spotlight', d.ingested_at, source_id, doc_id) = 1",
    "reconcile_candidates": """WITH l AS (SELECT source_id, max(ingested_at) AS last FROM documents GROUP BY 1), seen AS (SELECT source_id, uri FROM documents JOIN l USING (source_id) WHERE date_diff('day', ingested_at::DATE, last::DATE) <= 1000),
        gone AS (SELECT * FROM documents d WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.source_id = d.source_id AND s.uri = d.uri))
        SELECT doc_id, source_id, (SELECT count(*) FROM gone h WHERE h.source_id = g.source_id) <= 0.25 * (SELECT count(*) FROM documents d WHERE d.source_id = g.source_id) AS allowed FROM gone g""",
    "materialize_budget": "SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 30000",
    "contact_lookup": f"""WITH a AS (SELECT id, {_KEY} AS key FROM (SELECT id, regexp_replace(display_name, '^\\s+|\\s+$', '', 'g') AS n FROM authors)), b AS (SELECT right('00' || key, 10) AS tail, min(key) AS k FROM a WHERE NOT contains(key, '@') AND length(key) >= 8 GROUP BY 1 HAVING count(DISTINCT key) = 1)
        SELECT id, 'contact ' || CASE WHEN contains(key, '@') THEN key WHEN EXISTS (SELECT 1 FROM a x WHERE '00' || x.key = a.key) THEN substr(a.key, 3) WHEN length(key) >= 10 THEN b.k END AS name FROM a LEFT JOIN b ON length(key) >= 10 AND b.tail = right(key, 10) WHERE key IS NOT NULL""",
    "active_lineage": r"""WITH t AS (SELECT a.id, a.session_id, a.ord, a.role, coalesce(regexp_matches(a.content, '[^\s\x0B]'), false) AS said, b.id AS parent FROM session_turns a LEFT JOIN session_turns b ON b.id = a.parent_turn_id AND b.session_id = a.session_id),
        down AS (WITH RECURSIVE d AS (SELECT id, 0 AS depth FROM session_turns x WHERE NOT EXISTS (SELECT 1 FROM session_turns y WHERE y.id = x.parent_turn_id) UNION ALL SELECT s.id, depth + 1 FROM d JOIN session_turns s ON s.parent_turn_id = d.id) SELECT * FROM d),
        u AS (SELECT t.* EXCLUDE (parent), CASE WHEN depth IS NOT NULL THEN parent END AS parent, depth FROM t LEFT JOIN down USING (id)),
        up AS (WITH RECURSIVE r AS (SELECT arg_max(id, (ord, id)) AS id FROM u GROUP BY session_id UNION SELECT u.parent FROM r JOIN u ON u.id = r.id WHERE u.parent IS NOT NULL) SELECT * FROM r)
        SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(depth, -1), id) - 1 AS active_ord FROM u SEMI JOIN up USING (id) WHERE said AND role IN ('user', 'assistant')""",
    "message_offsets": "SELECT id, conversation_id, char_start::BIGINT AS char_start, (char_start + length(body))::BIGINT AS char_end FROM (SELECT *, coalesce(sum(length(body) + 2) OVER (PARTITION BY conversation_id ORDER BY sent_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM messages)",
    "session_titles": """WITH f AS (SELECT session_id, arg_min(line, (active_ord, id)) AS line FROM (SELECT session_id, active_ord, id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS line FROM session_turns WHERE active_ord IS NOT NULL AND role = 'user' AND content IS NOT NULL) WHERE line IS NOT NULL GROUP BY 1)
        SELECT s.id AS session_id, coalesce(left(nullif(trim(title), ''), 200), left(line, 100), external_id) AS title FROM sessions s LEFT JOIN f ON f.session_id = s.id""",
    "session_sync": "WITH s AS (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY updated_at DESC, id DESC) = 1) SELECT a.id, coalesce(a.parent_session_id, b.id) AS parent FROM s a LEFT JOIN s b ON b.source_id = a.source_id AND b.external_id = a.parent_external_id",
    "config_sync": "SELECT slug, CASE WHEN kind = 'filesystem' OR root = '/elsewhere' THEN 'unchanged' ELSE 'updated' END AS action FROM sources UNION ALL SELECT 'new-' || slug, 'created' FROM sources",
}
ORACLES["leaf_lineage"] = ORACLES["active_lineage"].replace("FROM u GROUP BY session_id", "FROM u WHERE id NOT IN (SELECT parent_turn_id FROM session_turns WHERE parent_turn_id IS NOT NULL) GROUP BY session_id")
