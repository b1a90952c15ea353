"""Queries over text rules: normalisation, titles, classification, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import quality, text
from loomspan.session import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def stem(uri):
    return F.regexp_extract(uri, r"([^/]*?)(?:\.[A-Za-z0-9_]+)?$", 1)


def normalize_text(spark, sf_dir):
    d = documents(spark, sf_dir).where("content is not null")
    plain = text.normalize(F.col("content"))
    return d.select("doc_id", F.sha2(plain, 256).alias("sha"), F.length(plain).alias("chars"))


def normalize_code(spark, sf_dir):
    plain = text.normalize_code(F.col("content"))
    return documents(spark, sf_dir).where("content is not null").select("doc_id", F.sha2(plain, 256).alias("sha"))


def guess_title(spark, sf_dir):
    return documents(spark, sf_dir).where("content is not null").select("doc_id", text.guess_title(text.normalize_code(F.col("content")), stem(F.col("uri"))).alias("guessed"))


def content_hashes(spark, sf_dir):
    d = documents(spark, sf_dir).where("text is not null")
    return d.select("doc_id", F.sha2("text", 256).alias("text_sha"), text.token_estimate(F.col("text")).alias("tokens"), (F.sha2("content", 256) == F.col("content_sha256")).alias("content_same"))


def quality_metrics(spark, sf_dir):
    d = documents(spark, sf_dir).where("content is not null")
    return d.select("doc_id", quality.assess(F.col("content"), F.col("content")).alias("q")).select("doc_id", "q.lines", "q.repetition", "q.timestamped", "q.dumpish", "q.hex_per_line", "q.base64_per_line", "q.alpha_ratio")


def quality_verdict(spark, sf_dir):
    d = documents(spark, sf_dir).where("content is not null")
    return d.select("doc_id", "source_id", quality.assess(F.col("content"), F.col("content"))["machine"].alias("machine")).groupBy("source_id", "machine").agg(F.count("*").alias("documents"))


def normalize_subject(spark, sf_dir):
    subject = F.get_json_object("meta", "$.subject")
    return table(spark, sf_dir, "messages").where(subject.isNotNull()).groupBy(text.normalize_subject(subject).alias("subject")).agg(F.count("*").alias("messages"), F.countDistinct("conversation_id").alias("threads"))


def handle_keys(spark, sf_dir):
    return table(spark, sf_dir, "authors").select("id", text.handle_key(F.col("display_name")).alias("handle_key"))


def claim_signature(spark, sf_dir):
    d = documents(spark, sf_dir).where("text is not null").select(text.claim_signature(F.col("text")).alias("s"))
    return d.groupBy("s.numbers", "s.temporal", "s.negated").agg(F.count("*").alias("n"))


def normalize_fact(spark, sf_dir):
    return documents(spark, sf_dir).where("text is not null").groupBy(F.sha2(text.normalize_fact(F.col("text")), 256).alias("fact_key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def reader_dispatch(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("reader", text.reader_for(F.col("uri")))
    return d.withColumn("found_class", text.corpus_class(F.col("reader"), F.lit("document"))).groupBy("reader", "found_class").agg(F.count("*").alias("n"))


def classify_path(spark, sf_dir):
    roots = table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), "root", "default_trust")
    d = documents(spark, sf_dir).join(roots, "source_id").withColumn("path", F.regexp_replace("uri", "^file://", ""))
    relative = F.when(F.col("path").startswith(F.concat("root", F.lit("/"))), F.substring("path", F.length("root") + 2, F.length("path"))).otherwise(F.regexp_extract("path", "([^/]*)$", 1))
    return d.select("doc_id", text.path_trust(relative, F.col("default_trust")).alias("t")).select("doc_id", "t.trust", "t.label")


def classify_tool(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(text.tool_kind(F.col("event_type")).alias("kind"), text.tool_argument(F.col("props"), text.TOOL_PATHS, 1024).alias("target"), text.tool_argument(F.col("props"), text.TOOL_COMMANDS, 4000).alias("command")).groupBy("kind", "target", "command").agg(F.count("*").alias("n"))


def output_preview(spark, sf_dir):
    t = table(spark, sf_dir, "session_turns").where("role = 'tool' and content is not null")
    return t.select("id", text.output_preview(F.col("content")).alias("preview"), F.octet_length("content").alias("bytes"))


def scan_counts(spark, sf_dir):
    """Items per source and extension, as a scan before ingest reports them."""
    return documents(spark, sf_dir).groupBy("source_id", text.extension(F.col("uri")).alias("ext")).agg(F.count("*").alias("items"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).alias("bytes"))


def glob_filter(spark, sf_dir):
    """Documents that a glob with ``*`` over slashes names."""
    return documents(spark, sf_dir).where(F.col("uri").rlike(text.glob_regex("file:///home/*/[!s]*-docs/?*.md"))).select("doc_id", "uri")


def home_paths(spark, sf_dir):
    s = table(spark, sf_dir, "sources")
    return s.select("id", text.home_tilde(F.col("root"), "/home/owner").alias("short"), text.tilde_home(text.home_tilde(F.col("root"), "/home/owner"), "/home/owner").alias("root"))


def slugs(spark, sf_dir):
    return table(spark, sf_dir, "sources").select("slug", text.table_slug(F.col("slug")).alias("table_name"), text.relation_label(F.col("slug")).alias("label"))


QUERIES = {f.__name__: f for f in (normalize_text, normalize_code, guess_title, content_hashes, quality_metrics, quality_verdict, normalize_subject, handle_keys, claim_signature, normalize_fact, reader_dispatch, classify_path, classify_tool, output_preview, scan_counts, glob_filter, home_paths, slugs)}

_NL = r"replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_EXT = r"lower(regexp_extract(uri, '[^/]\.([A-Za-z0-9_]+)$', 1))"
_WORDS = lambda ws: ", ".join(f"'{w}'" for w in ws)


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FOLD = "translate(lower(text), 'ſςµ', 'sσμ')"
for _a, _b in (("ß", "ss"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st")):
    _FOLD = f"replace({_FOLD}, '{_a}', '{_b}')"
_READER = "CASE " + " ".join(f"WHEN {_EXT} IN ({_WORDS(ws.split())}) THEN '{r}'" for r, ws in text.READERS.items()) + f" WHEN {_EXT} IN ({_WORDS(text.LEGACY_OFFICE)}) THEN 'none: legacy binary format' WHEN {_EXT} IN ({_WORDS(text.CONTAINERS)}) THEN 'none: binary container' ELSE 'none: no extractor' END"
_QUALITY = f"""
    WITH d AS (SELECT doc_id, source_id, content, list_filter(regexp_split_to_array(content, '\\r\\n|\\r|\\n'), lambda x: regexp_matches(x, '\\S')) AS ls FROM documents WHERE content IS NOT NULL),
    m AS (SELECT doc_id, source_id, length(ls) AS lines,
        1 - length(list_distinct(list_transform(ls, lambda x: regexp_replace(left(x, 120), '\\d+', '#', 'g')))) / length(ls) AS repetition,
        length(list_filter(ls, lambda x: regexp_matches(x, {_re(quality.TIMESTAMP)}))) / length(ls) AS timestamped,
        length(list_filter(ls, lambda x: regexp_matches(x, {_re(quality.DUMP)}))) / length(ls) AS dumpish,
        length(regexp_extract_all(content, {_re(quality.HEX)})) / length(ls) AS hex_per_line,
        length(regexp_extract_all(content, {_re(quality.BASE64)})) / length(ls) AS base64_per_line,
        length(list_filter(ls, lambda x: regexp_matches(trim(x), {_re('^' + quality.HEX)}) OR regexp_matches(trim(x), {_re('^' + quality.BASE64)}))) / length(ls) AS hashes,
        length(regexp_replace(content, '[^\\p{{L}}\\s\\x{{0B}}\\x{{1c}}-\\x{{1f}}]', '', 'g')) / length(content) AS alpha FROM d)"""
ORACLES = {
    "normalize_text": rf"""SELECT doc_id, sha256(n) AS sha, length(n)::INTEGER AS chars FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
        replace(replace(replace(nfc_normalize(content), chr(0), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\f\x0B]+(\n|$)', '\1', 'g'), '\n\n\n\n+', E'\n\n\n', 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS n FROM documents WHERE content IS NOT NULL)""",
    "normalize_code": f"SELECT doc_id, sha256({_NL}) AS sha FROM documents WHERE content IS NOT NULL",
    "guess_title": rf"""WITH d AS (SELECT doc_id, uri, string_split({_NL}, chr(10)) AS ls FROM documents WHERE content IS NOT NULL)
        SELECT doc_id, coalesce(regexp_replace(list_filter(ls[1:40], lambda x: regexp_matches(x, '^#\s+\S'))[1], '^#\s+|\s+$', '', 'g'),
          list_filter(list_transform(ls[1:10], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) BETWEEN 3 AND 200)[1],
          regexp_extract(uri, '([^/]*?)(?:\.[A-Za-z0-9_]+)?$', 1)) AS guessed FROM d""",
    "content_hashes": "SELECT doc_id, sha256(text) AS text_sha, greatest(length(text) // 4, 1)::INTEGER AS tokens, sha256(content) = content_sha256 AS content_same FROM documents WHERE text IS NOT NULL",
    "quality_metrics": _QUALITY + """ SELECT doc_id, lines::INTEGER AS lines, CASE WHEN lines >= 40 THEN round_even(repetition, 3) END AS repetition, CASE WHEN lines >= 40 THEN round_even(timestamped, 3) END AS timestamped,
        CASE WHEN lines >= 40 THEN round_even(dumpish, 3) END AS dumpish, CASE WHEN lines >= 40 THEN round_even(hex_per_line, 3) END AS hex_per_line, CASE WHEN lines >= 40 THEN round_even(base64_per_line, 3) END AS base64_per_line,
        CASE WHEN lines >= 40 THEN round_even(alpha, 3) END AS alpha_ratio FROM m""",
    "quality_verdict": _QUALITY + """ SELECT source_id, CASE WHEN lines >= 40 THEN timestamped > 0.6 OR hex_per_line > 1 OR dumpish > 0.7 OR repetition > 0.82
          OR (timestamped > 0.45)::INT + (repetition > 0.65)::INT + (dumpish > 0.4)::INT + (hex_per_line > 0.6)::INT + (base64_per_line > 0.4)::INT + (alpha < 0.55)::INT >= 2
        ELSE lines > 0 AND coalesce(hashes > 0.8, false) END AS machine, count(*) AS documents FROM m GROUP BY ALL""",
    "normalize_subject": rf"""SELECT lower(trim(regexp_replace(regexp_replace(json_extract_string(meta, '$.subject'), '(?i)^(\s*((({'|'.join(text.SUBJECT_MARKS)})\s*(\[\d+\])?\s*:)|\[[^\]]*\])\s*)+', ''), '\s+', ' ', 'g'))) AS subject,
        count(*) AS messages, count(DISTINCT conversation_id) AS threads FROM messages WHERE json_extract_string(meta, '$.subject') IS NOT NULL GROUP BY 1""",
    "handle_keys": r"""SELECT id, CASE WHEN contains(n, '@') THEN lower(n) WHEN length(regexp_replace(n, '[^0-9]', '', 'g')) >= 7 THEN regexp_replace(n, '[^0-9]', '', 'g') END AS handle_key
        FROM (SELECT id, regexp_replace(display_name, '^\s+|\s+$', '', 'g') AS n FROM authors)""",
    "claim_signature": rf"""WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') AS ws, list_transform(regexp_extract_all(lower(text), '\d+(?:[.,]\d+)*'), lambda x: replace(x, ',', '')) AS ns FROM documents WHERE text IS NOT NULL)
        SELECT coalesce(array_to_string(list_sort(list_distinct(ns)), ' '), '') AS numbers, coalesce(array_to_string(list_sort(list_distinct(list_filter(ws, lambda x: x IN ({_WORDS(text.TEMPORAL)})))), ' '), '') AS temporal,
          length(list_filter(ws, lambda x: x IN ({_WORDS(text.NEGATION)}) OR ends_with(x, 'n''t'))) > 0 AS negated, count(*) AS n FROM w GROUP BY ALL""",
    "normalize_fact": rf"SELECT sha256(trim(regexp_replace(trim(regexp_replace({_FOLD}, '[\s\x0B]+', ' ', 'g')), '[.!?;:,]+$', ''))) AS fact_key, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "reader_dispatch": f"SELECT reader, CASE WHEN reader = 'mail' THEN 'communication' WHEN reader = 'code' THEN 'code' ELSE 'document' END AS found_class, count(*) AS n FROM (SELECT {_READER} AS reader FROM documents) GROUP BY ALL",
    "classify_path": f"""WITH p AS (SELECT doc_id, default_trust, root, replace(uri, 'file://', '') AS path FROM documents d JOIN sources s ON s.id = d.source_id),
        r AS (SELECT doc_id, default_trust, CASE WHEN starts_with(path, root || '/') THEN substr(path, length(root) + 2) ELSE regexp_extract(path, '([^/]*)$', 1) END AS rel FROM p),
        t AS (SELECT doc_id, CASE WHEN list_has_any(string_split(rel, '/'), [{_WORDS(text.VENDORED)}]) THEN 'reference|path:vendored'
          {' '.join(f"WHEN regexp_matches(rel, {_re(text.glob_regex(p))}) THEN '{t}|{label}'" for p, t, label in text.PATH_RULES)}
          {' '.join(f"WHEN list_contains(string_split(lower(rel), '/'), '{c}') THEN 'reference|path:component:{c}'" for c in text.REFERENCE_PARTS)}
          ELSE default_trust || '|path:default' END AS x FROM r)
        SELECT doc_id, split_part(x, '|', 1) AS trust, split_part(x, '|', 2) AS label FROM t""",
    "classify_tool": f"""SELECT CASE {' '.join(f"WHEN lower(trim(event_type)) IN ({_WORDS(ws.split())})" + ''.join(f" OR starts_with(lower(trim(event_type)), '{s}')" for s in text.TOOL_STARTS.get(k, ())) + f" THEN '{k}'" for k, ws in text.TOOLS.items())} ELSE 'other' END AS kind,
        coalesce({', '.join(f"nullif(left(trim(json_extract_string(props, '$.{k}')), 1024), '')" for k in text.TOOL_PATHS)}) AS target,
        coalesce({', '.join(f"nullif(left(trim(json_extract_string(props, '$.{k}')), 4000), '')" for k in text.TOOL_COMMANDS)}) AS command, count(*) AS n FROM events GROUP BY ALL""",
    "output_preview": r"SELECT id, nullif(left(regexp_replace(content, '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), 1000), '') AS preview, strlen(content)::INTEGER AS bytes FROM session_turns WHERE role = 'tool' AND content IS NOT NULL",
    "scan_counts": f"SELECT source_id, {_EXT} AS ext, count(*) AS items, sum(coalesce(strlen(content), 0))::BIGINT AS bytes FROM documents GROUP BY ALL",
    "glob_filter": f"SELECT doc_id, uri FROM documents WHERE regexp_matches(uri, {_re(text.glob_regex('file:///home/*/[!s]*-docs/?*.md'))})",
    "home_paths": "SELECT id, CASE WHEN root = '/home/owner' THEN '~' WHEN starts_with(root, '/home/owner/') THEN '~' || substr(root, 12) ELSE root END AS short, root FROM sources",
    "slugs": r"SELECT slug, left('emb_' || regexp_replace(regexp_replace(lower(trim(slug)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 63) AS table_name, upper(regexp_replace(regexp_replace(trim(slug), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS label FROM sources",
}
