"""Facts about documents and people: metadata facts, staleness of extraction, identities, authorship."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text
from loomspan.operators.cluster import components

#: What a document can be.
CLASSES = ("document", "code", "communication")


def mail_facts(messages: DataFrame, people: DataFrame) -> DataFrame:
    """Facts that mail headers state: ``document_id, fact_class, key, fact``, one a subject and one a sender.

    ``messages``: id, author_id, meta (JSON with a subject); ``people``: id, display_name.
    """
    subject = F.get_json_object("meta", "$.subject")
    about = messages.where(F.coalesce(F.trim(subject), F.lit("")) != "").select(F.col("id").alias("document_id"), F.lit("subject").alias("fact_class"), F.concat(F.lit("subject:"), text.normalize_subject(subject)).alias("key"), subject.alias("fact"))
    named = messages.join(people.select(F.col("id").alias("author_id"), "display_name"), "author_id")
    sent = named.select(F.col("id").alias("document_id"), F.lit("sender").alias("fact_class"), F.concat(F.lit("sender:"), F.col("author_id").cast("string")).alias("key"), F.concat(F.lit("Sent by "), F.trim("display_name")).alias("fact"))
    return about.unionByName(sent)


def stale(documents: DataFrame, prompts: DataFrame, runs: DataFrame) -> DataFrame:
    """``document_id, prompt`` for which extraction must run: never run, or with another prompt, content or model.

    ``documents``: document_id, corpus_class, content_sha; ``prompts``: prompt, corpus_class (null for all),
    prompt_sha, model; ``runs``: document_id, prompt, prompt_sha, content_sha, model.
    """
    every = F.array(*map(F.lit, CLASSES))
    scope = prompts.select("prompt", "prompt_sha", "model", F.explode(F.when(F.col("corpus_class").isNull(), every).otherwise(F.array("corpus_class"))).alias("corpus_class"))
    due = documents.join(scope, "corpus_class")
    return due.join(runs, ["document_id", "prompt", "prompt_sha", "content_sha", "model"], "left_anti").select("document_id", "prompt")


def extract_facts(documents: DataFrame, extractor: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """Runs an extractor (text to pairs of fact class and text) where the data is; ungrounded facts are dropped.

    A fact is grounded if its text stands in the document, white space and case aside. Columns
    ``document_id, ord, fact_class, fact, char_start, char_end`` (of the first exact place, else null).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, body in zip(batch["document_id"], batch["text"]):
                plain = " ".join((body or "").split()).casefold()
                kept = [(c, f) for c, f in extractor(body or "") if f.strip() and " ".join(f.split()).casefold() in plain]
                for i, (cls, fact) in enumerate(kept):
                    at = body.find(fact)
                    rows.append((key, i, cls, fact, at if at >= 0 else None, at + len(fact) if at >= 0 else None))
            yield pd.DataFrame(rows, columns=["document_id", "ord", "fact_class", "fact", "char_start", "char_end"]).astype({"char_start": "Int32", "char_end": "Int32"})

    return documents.select("document_id", "text").mapInPandas(run, "document_id long, ord int, fact_class string, fact string, char_start int, char_end int")


def same_people(identities: DataFrame) -> DataFrame:
    """``author_id, person``: authors that share an identity (kind, value) are one person, named by the smallest id.

    Each identity is tied to its smallest author (a star), so a value shared by very many gives no pairs
    among them. ``identities``: author_id, kind, value; null and blank values tie nobody.
    """
    known = identities.where(F.coalesce(F.trim("value"), F.lit("")) != "")
    first = known.groupBy("kind", "value").agg(F.min("author_id").alias("b"))
    pairs = known.join(first, ["kind", "value"]).select(F.col("author_id").alias("a"), "b").where("a <> b").distinct()
    comp = components(pairs).withColumnRenamed("node", "author_id")
    return identities.select("author_id").distinct().join(comp, "author_id", "left").select("author_id", F.coalesce("component", "author_id").alias("person"))


def adopt_names(authors: DataFrame, people: DataFrame) -> DataFrame:
    """``person, display_name``: the name of each person, a real name before a handle, then of the smallest id."""
    handle = F.col("display_name").contains("@") | text.handle_key(F.col("display_name")).isNotNull()
    rows = people.join(authors.select(F.col("id").alias("author_id"), "display_name"), "author_id")
    return rows.groupBy("person").agg(F.min_by(F.trim("display_name"), F.struct(handle.cast("int"), "author_id")).alias("display_name"))


def git_authorship(tallies: DataFrame, own: Column) -> DataFrame:
    """Who wrote each path, from commit counts: ``path, name, role, confidence, evidence``.

    The top committer is the author, up to five others are committers; ties by name. ``tallies``: path,
    name, commits; ``own`` marks rows of the owner; ``self_share`` is the owner's part of the commits.
    """
    per = tallies.groupBy("path", "name").agg(F.sum("commits").alias("commits"), F.max(own).alias("own"))
    totals = per.groupBy("path").agg(F.greatest(F.sum("commits"), F.lit(1)).alias("total"), F.sum(F.when(F.col("own"), F.col("commits")).otherwise(0)).alias("self"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("commits"), "name"))).where("r <= 6").join(totals, "path")
    role = F.when(F.col("r") == 1, "author").otherwise("committer")
    evidence = F.concat(F.lit("git-log:"), F.when(F.col("r") == 1, "top-committer").otherwise("committer"), F.lit(":"), F.col("commits").cast("string"), F.lit("/"), F.col("total").cast("string"))
    return ranked.select("path", "name", role.alias("role"), F.bround(F.col("commits") / F.col("total"), 3).alias("confidence"), evidence.alias("evidence"), F.bround(F.col("self") / F.col("total"), 3).alias("self_share"))


#: People named for one document at most, of senders and of hints.
MOST_NAMED = 5


def sender_authors(senders: Column) -> Column:
    """Up to five senders of a message as authors, each at 0.9: the name, or the address where there is none."""
    parsed = F.transform(F.slice(F.coalesce(senders, F.array().cast("array<string>")), 1, MOST_NAMED), _parse_sender)
    return F.filter(parsed, lambda x: x["name"] != "")


def _parse_sender(x: Column) -> Column:
    address = F.trim(F.coalesce(F.nullif(F.regexp_extract(x, r"<([^<>]*)>", 1), F.lit("")), F.when(x.contains("@") & ~x.contains("<"), x), F.lit("")))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.when(~x.contains("<") & x.contains("@"), F.lit("")).otherwise(x), r"<[^<>]*>", ""), r"^\s*\"|\"\s*$", ""))
    return F.struct(F.when(name != "", name).otherwise(address).alias("name"), F.lit(0.9).alias("confidence"))


def hint_authors(hints: Column) -> Column:
    """Up to five metadata hints as authors: 0.8 for the first, 0.5 for the others."""
    return F.transform(F.slice(F.coalesce(hints, F.array().cast("array<string>")), 1, MOST_NAMED), lambda x, i: F.struct(x.alias("name"), F.when(i == 0, 0.8).otherwise(0.5).alias("confidence")))


def attribute(git: Column, senders: Column, hints: Column, path: Column, communication: Column, owner: list[str]) -> Column:
    """``trust, evidence, authors`` of a document: by git history, else by senders (of communication), else by metadata, else by path.

    ``git``: struct of the same fields or null; ``path``: struct of trust and label. Metadata that names the owner is
    authored, other metadata reference, as is all in a reference path; its evidence names the path rule too. A path
    that is authored names the owner at 0.6.
    """
    own = F.exists(hints, lambda h: F.lower(F.trim(h)).isin(*[o.strip().lower() for o in owner])) if owner else F.lit(False)
    people = lambda x: x.cast("array<struct<name:string,confidence:double>>")
    result = lambda trust, evidence, authors: F.struct(trust.alias("trust"), evidence.alias("evidence"), people(authors).alias("authors"))
    from_ = sender_authors(senders)
    self_sent = F.exists(from_, lambda a: F.lower(a["name"]).isin(*[o.strip().lower() for o in owner])) if owner else F.lit(False)
    sent = result(F.when(self_sent, "authored").otherwise("received"), F.when(self_sent, "message-sender:self").otherwise("message-sender:third-party"), from_)
    named = result(F.when((path["trust"] == "reference") | ~own, "reference").otherwise("authored"), F.concat(F.lit("document-metadata:"), F.when(own, "self").otherwise("third-party"), F.lit("+"), path["label"]), hint_authors(hints))
    placed = result(path["trust"], path["label"], F.when((path["trust"] == "authored") & F.lit(bool(owner)), F.array(F.struct(F.lit(owner[0] if owner else None).alias("name"), F.lit(0.6).alias("confidence")))).otherwise(F.array()))
    return F.when(git.isNotNull(), git).when(communication & (F.size(from_) > 0), sent).when(F.size(F.coalesce(hints, F.array())) > 0, named).otherwise(placed)
