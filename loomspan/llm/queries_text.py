"""Queries over documents: splitting, leaks and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import languages, leakage, splitting
from loomspan.session import table

#: Limit and overlap of problem 1.
PROSE, CODE = (1000, 150), (1200, 100)


def pieces(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    code = F.col("corpus_class") == "code"
    pick = lambda i: F.when(code, CODE[i]).otherwise(PROSE[i])
    return splitting.split_oversized(docs, "doc_id", "content", pick(0), pick(1), code, with_text)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized documents, and whether some cut of theirs had to be forced."""
    parts = pieces(spark, sf_dir, with_text=False)
    return parts.groupBy("doc_id").agg(F.when(F.max(F.col("cut_at") == "forced"), "forced").otherwise("natural").alias("cut"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of oversized documents, in order."""
    return pieces(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of an evaluation item."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where("kind = 'exact'").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of leaks, word for word and with other names and numbers."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents whose label is missing or wrong, or that mix several."""
    docs = table(spark, sf_dir, "documents").where(~F.coalesce(F.col("corpus_class") == "code", F.lit(False)))
    return languages.wrong_labels(languages.identify(docs))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language and confidence, and those of its segments, in order."""
    found = languages.identify(table(spark, sf_dir, "documents"))
    rows = found.select("doc_id", "label", F.col("main").alias("document_language"), F.round("confidence", 4).alias("document_confidence"), F.posexplode_outer("segments").alias("segment", "s"))
    return rows.select("doc_id", "label", "document_language", "document_confidence", "segment", "s.language", "s.sentences", "s.letters", F.round("s.confidence", 4).alias("confidence"))


_CLASS = r"\t\n\x0B\f\r\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}。！？、"
#: SQL has no compatibility decomposition; this covers the forms that stand in the tables.
_WIDE = "".join(chr(c) for a, b in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(a, b))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
_COMPAT = f"replace(replace(translate(text, '{_WIDE}', '{_NARROW}'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p7_found, p7_leaks, p9_found, p9_segments)}
ORACLES = {
    "p1_found": f"""
    WITH d AS (SELECT doc_id, content, CASE WHEN corpus_class = 'code' THEN 1200 ELSE 1000 END AS most FROM documents)
    SELECT doc_id, CASE WHEN list_max(list_transform(regexp_split_to_array(content, '[{_CLASS}]'), lambda x: length(x))) > most
                        THEN 'forced' ELSE 'natural' END AS cut
    FROM d WHERE length(content) > most""",
    "p7_found": rf"""
    WITH t AS (
      SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items
    ), w AS (
      SELECT side, id, list_filter(regexp_split_to_array(replace(replace(lower(regexp_replace(strip_accents({_COMPAT}), '[\p{{M}}\p{{Cf}}]', '', 'g')), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM t
    ), g AS (
      SELECT side, id, list_aggregate(ws[i:i + 9], 'string_agg', ' ') AS gram
      FROM w, LATERAL (SELECT unnest(range(1, length(ws) - 8)) AS i)
    )
    SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM g a JOIN g b ON a.gram = b.gram WHERE a.side = 'd' AND b.side = 'i'""",
}
