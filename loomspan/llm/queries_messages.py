"""Queries over messages and turns: personal information and mails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import emails, personal
from loomspan.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of personal information in each message and turn."""
    names = personal.known_names(table(spark, sf_dir, "authors"), "display_name")
    found = None
    for name, text in (("messages", "body"), ("session_turns", "content")):
        part = personal.redact(table(spark, sf_dir, name), "id", text, names, with_text=False)
        part = part.select(F.lit(name).alias("tbl"), F.col("id").alias("row_id"), F.explode("kinds").alias("kind"))
        found = part if found is None else found.unionByName(part)
    return found


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message and turn with typed placeholders."""
    names = personal.known_names(table(spark, sf_dir, "authors"), "display_name")
    parts = [personal.redact(table(spark, sf_dir, name), "id", text, names).select(F.lit(name).alias("tbl"), F.col("id").alias("row_id"), "redacted", "mentions") for name, text in (("messages", "body"), ("session_turns", "content"))]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of mails that their sender did not newly write."""
    mails = emails.mails_of(*(table(spark, sf_dir, t) for t in ("messages", "conversations", "authors")))
    return emails.classify(mails).where("kind <> 'new'").select(F.col("id").alias("message_id"), "line_no")


def p3_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mail reduced to the lines its sender newly wrote."""
    mails = emails.mails_of(*(table(spark, sf_dir, t) for t in ("messages", "conversations", "authors")))
    return emails.new_text(mails).withColumnRenamed("id", "message_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_redacted, p3_found, p3_new_text)}
ORACLES = {}
