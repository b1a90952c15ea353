"""What must hold of the operators' full outputs, with SQL for each: for results SQL itself cannot compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm import conversations, emails, languages, personal, queries_more, queries_text
from loomspan.session import table


def p1_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every oversized document: its pieces are within the limit, are what stands at their offsets, cover it, and overlap by no more than asked."""
    docs = table(spark, sf_dir, "documents")
    code = F.col("corpus_class") == "code"
    pick = lambda i: F.when(code, queries_text.CODE[i]).otherwise(queries_text.PROSE[i])
    about = docs.select("doc_id", "content", pick(0).alias("limit"), pick(1).alias("overlap"))
    order = Window.partitionBy("doc_id").orderBy("ord")  # the pieces of one text
    pieces = queries_text.pieces(spark, sf_dir).withColumn("before", F.lag("piece_end").over(order))
    per = pieces.join(about, "doc_id").groupBy("doc_id").agg(
        (F.max(F.length("piece")) <= F.first("limit")).alias("fits"),
        F.min(F.substring(F.col("content"), (F.col("piece_start") + 1).cast("int"), (F.col("piece_end") - F.col("piece_start")).cast("int")) == F.col("piece")).alias("in_place"),
        ((F.min("piece_start") == 0) & (F.max("piece_end") == F.first(F.length("content"))) & F.min(F.coalesce(F.col("piece_start") <= F.col("before"), F.lit(True)))).alias("covers"),
        F.min(F.coalesce(F.col("piece_start") >= F.col("before") - F.col("overlap"), F.lit(True))).alias("overlaps"),
    )
    return per


def p2_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text: outside the mentions it is unchanged, and each mention has its placeholder."""
    names = personal.known_names(table(spark, sf_dir, "authors"), "display_name")
    out = None
    for name, text in (("messages", "body"), ("session_turns", "content")):
        rows = table(spark, sf_dir, name).where(F.col(text).isNotNull())
        found = personal.redact(rows, "id", text, names).join(rows.select("id", F.length(text).alias("chars")), "id")
        shift = F.aggregate("spans", F.lit(0), lambda a, s: a + F.length(s["kind"]) + 2 - (s["end"] - s["start"]))
        shown = F.forall("spans", lambda s: F.col("redacted").contains(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        ordered = F.aggregate("spans", F.lit(0), lambda a, s: F.when(s["start"] >= a, s["end"]).otherwise(1 << 30)) <= F.col("chars")
        part = found.select(F.lit(name).alias("tbl"), F.col("id").alias("row_id"), (F.length("redacted") == F.col("chars") + shift).alias("adds_up"), shown.alias("shown"), ordered.alias("ordered"))
        out = part if out is None else out.unionByName(part)
    return out


def p3_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line of every mail has one kind."""
    mails = emails.mails_of(*(table(spark, sf_dir, t) for t in ("messages", "conversations", "authors")))
    return emails.classify(mails).groupBy(F.col("id").alias("message_id")).agg(F.count("*").alias("lines"), F.countDistinct("line_no").alias("places"))


def p6_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session that is kept comes out with each of its messages once, at the positions 0, 1, 2 and so on."""
    turns = conversations.ordered(table(spark, sf_dir, "session_turns"), table(spark, sf_dir, "sessions"))
    return turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.countDistinct("position").alias("places"), F.max("position").alias("last"))


def p9_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with text has a language and segments that alternate, with confidences between 0 and 1."""
    found = languages.identify(table(spark, sf_dir, "documents"))
    between = lambda c: (c > 0) & (c <= 1.0000001)
    changes = F.forall(F.sequence(F.lit(1), F.greatest(F.size("segments") - 1, F.lit(1))), lambda i: (F.size("segments") < 2) | (F.get(F.col("segments"), i)["language"] != F.get(F.col("segments"), i - 1)["language"]))
    sure = F.col("main").isNull() | (between(F.col("confidence")) & F.forall("segments", lambda s: between(s["confidence"])))
    return found.select("doc_id", changes.alias("alternate"), sure.alias("sure"), (F.col("main").isNull() | F.exists("segments", lambda s: s["language"] == F.col("main"))).alias("main_stands"))


QUERIES = {f.__name__: f for f in (p1_holds, p2_holds, p3_holds, p6_holds, p9_holds)}
_BLACK = r"[^\s\x0B\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ORACLES = {
    "p1_holds": "SELECT doc_id, true AS fits, true AS in_place, true AS covers, true AS overlaps FROM documents WHERE length(content) > CASE WHEN corpus_class = 'code' THEN 1200 ELSE 1000 END",
    "p2_holds": "SELECT 'messages' AS tbl, id AS row_id, true AS adds_up, true AS shown, true AS ordered FROM messages WHERE body IS NOT NULL UNION ALL SELECT 'session_turns', id, true, true, true FROM session_turns WHERE content IS NOT NULL",
    "p3_holds": f"SELECT id AS message_id, n AS lines, n AS places FROM (SELECT m.id, length(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{_BLACK}'))) AS n FROM messages m JOIN conversations c ON c.id = m.conversation_id WHERE NOT regexp_matches(c.external_id, '^(iMessage|SMS);')) WHERE n > 0",
    "p6_holds": f"""SELECT session_id, n AS turns, n AS places, n - 1 AS last FROM (SELECT session_id, count(DISTINCT CASE WHEN external_id <> '' THEN external_id ELSE 'row ' || id END) AS n FROM session_turns GROUP BY 1)
        WHERE session_id NOT IN (SELECT session_id FROM ({queries_more.ORACLES['p6_found']}))""",
    "p9_holds": rf"SELECT doc_id, true AS alternate, true AS sure, true AS main_stands FROM documents WHERE regexp_matches(text, '{_BLACK}')",
}
