"""Queries: mixing and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import conversations, mixing
from loomspan.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions to drop, with the first reason."""
    return conversations.rebuild(table(spark, sf_dir, "session_turns"), table(spark, sf_dir, "sessions"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their target share: the mix repeats all they have as often as it may and still holds too little of them."""
    _, report = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return report.where("short").select("source")


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source, what holds of the copies of its documents: how many break the cap, the quota or the target by more than one document."""
    copies, report = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    both = report.select("source", "quota", "max_repeats", "target_share", "reachable", "corpus_tokens", "mixed_tokens").join(copies.drop("doc_id"), "source", "left")
    off = (F.col("copies") < F.floor("quota")) | (F.col("copies") > F.ceil("quota"))
    per = both.groupBy("source").agg(
        F.count("copies").alias("documents"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_cap"), F.count_if(off).alias("off_quota"),
        F.max("tokens").alias("largest"), F.first("mixed_tokens").alias("mixed"), F.first(F.col("target_share") * F.col("corpus_tokens")).alias("goal"), F.first("reachable").alias("reachable"),
    )
    return per.select("source", "documents", "over_cap", "off_quota", (F.col("reachable") & (F.abs(F.col("mixed") - F.col("goal")) > F.coalesce("largest", F.lit(0)))).alias("off_target"))


def p6_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that are whole, turn by turn."""
    return conversations.ordered(table(spark, sf_dir, "session_turns"), table(spark, sf_dir, "sessions"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    _, report = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return report.select("source", "target_share", "max_repeats", "documents", "tokens", "capacity", "reachable", F.round("quota", 6).alias("quota"), "mixed_tokens", F.round("mixed_share", 6).alias("mixed_share"), F.round("planned_share", 6).alias("planned_share"))


QUERIES = {f.__name__: f for f in (p6_found, p6_conversations, p8_found, p8_copies, p8_report)}
_SOURCE = r"nullif(replace(lower(regexp_replace({}, '^[\s\x{{85}}\x{{A0}}]+|[\s\x{{85}}\x{{A0}}]+$', '', 'g')), '_', '-'), '')"
ORACLES = {
    "p8_copies": f"""
    SELECT t.source, count(d.doc_id) AS documents, 0 AS over_cap, 0 AS off_quota, FALSE AS off_target
    FROM (SELECT DISTINCT {_SOURCE.format("source")} AS source FROM mix_targets) t LEFT JOIN documents d ON {_SOURCE.format("d.source")} = t.source
    WHERE t.source IS NOT NULL GROUP BY t.source""",
    "p6_found": r"""
    WITH t AS (
      SELECT session_id, id, CASE WHEN external_id <> '' THEN external_id ELSE 'row ' || id END AS ext,
             nullif(parent_external_id, '') AS parent, role, regexp_matches(coalesce(content, ''), '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]') AS said FROM session_turns
    ), m AS (
      SELECT session_id, ext, bool_or(said AND role = 'user') AS asks, bool_or(said AND role = 'assistant') AS answers,
             arg_min(parent, id) FILTER (WHERE parent IS NOT NULL) AS parent FROM t GROUP BY ALL
    ), gaps AS (
      SELECT DISTINCT session_id FROM t WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.session_id = t.session_id AND m.ext = t.parent)
    ), reached AS (
      WITH RECURSIVE r AS (
        SELECT session_id, ext FROM m WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM m n WHERE n.session_id = m.session_id AND n.ext = m.parent)
        UNION SELECT m.session_id, m.ext FROM r JOIN m ON m.session_id = r.session_id AND m.parent = r.ext
      ) SELECT * FROM r
    ), circled AS (
      SELECT DISTINCT session_id FROM m WHERE NOT EXISTS (SELECT 1 FROM reached r WHERE r.session_id = m.session_id AND r.ext = m.ext)
    ), heard AS (
      WITH RECURSIVE h AS (
        SELECT session_id, parent AS ext FROM m WHERE answers AND parent IS NOT NULL
        UNION SELECT m.session_id, m.parent FROM h JOIN m ON m.session_id = h.session_id AND m.ext = h.ext WHERE m.parent IS NOT NULL
      ) SELECT * FROM h
    ), open AS (
      SELECT DISTINCT session_id FROM m WHERE asks AND NOT EXISTS (SELECT 1 FROM heard h WHERE h.session_id = m.session_id AND h.ext = m.ext)
    ), says AS (SELECT DISTINCT session_id FROM m WHERE asks OR answers), s AS (SELECT id FROM sessions UNION SELECT session_id FROM session_turns)
    SELECT * FROM (
      SELECT id AS session_id, CASE WHEN id NOT IN (FROM says) THEN 'empty' WHEN id IN (FROM gaps) OR id IN (FROM circled) THEN 'broken'
                                    WHEN id IN (FROM open) THEN 'unanswered' END AS reason FROM s
    ) WHERE reason IS NOT NULL""",
}
ORACLES["p6_conversations"] = f"""
    WITH t AS (
      SELECT session_id, id, CASE WHEN external_id <> '' THEN external_id ELSE 'row ' || id END AS ext, nullif(parent_external_id, '') AS parent FROM session_turns
    ), m AS (
      SELECT session_id, ext, min(id) AS node, arg_min(parent, id) FILTER (WHERE parent IS NOT NULL) AS parent FROM t GROUP BY ALL
    ), l AS (
      SELECT m.session_id, m.node, p.node AS up FROM m LEFT JOIN m p ON p.session_id = m.session_id AND p.ext = m.parent
    ), s AS (
      SELECT l.*, CASE WHEN count(*) OVER (PARTITION BY up) = 1 THEN up END AS single FROM l
    ), w AS (
      WITH RECURSIVE r AS (
        SELECT node, 0 AS at_ FROM s WHERE single IS NULL
        UNION ALL SELECT s.node, r.at_ + 1 FROM r JOIN s ON s.single = r.node
      ) SELECT * FROM r
    )
    SELECT s.session_id, row_number() OVER (PARTITION BY s.session_id ORDER BY a.ord NULLS FIRST, at_, s.node) - 1 AS position, s.node, a.role, a.content
    FROM s JOIN w ON w.node = s.node JOIN session_turns a ON a.id = s.node
    WHERE s.session_id NOT IN (SELECT session_id FROM ({ORACLES["p6_found"]}))"""
