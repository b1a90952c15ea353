"""Merges, filters and resolutions over keyed records: links, people, turns, groups and remembered outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import vectors


def in_sources(docs: DataFrame, links: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of the wanted sources, or linked to one of them besides their own.

    ``links``: key, source_id; ``wanted``: source_id. Each document comes out once.
    """
    own = wanted.select("source_id", F.lit(True).alias("_own")).distinct()
    linked = links.join(wanted.select("source_id").distinct(), "source_id", "left_semi").select(key, F.lit(True).alias("_linked")).distinct()
    return docs.join(own, "source_id", "left").join(linked, key, "left").where(F.col("_own") | F.col("_linked")).select(*docs.columns)


def merge_links(owners: DataFrame, links: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Owners with what further sources know of them: a blank title is filled by the first link that has one, ``links`` counts them.

    Both hold the key and ``title``; links are ordered by ``order``. The owner's other columns, and so its chunks, stay as they are.
    """
    title = F.when(F.trim("title") != "", F.col("title"))
    more = links.groupBy(key).agg(F.count("*").cast("long").alias("links"), F.min(F.when(title.isNotNull(), F.struct(*order, "title"))).alias("_first"))
    return owners.join(more, key, "left").withColumn("title", F.coalesce(title, "_first.title")).withColumn("links", F.coalesce("links", F.lit(0))).drop("_first")


def orphans(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` does not hold."""
    return left.select(F.col(left_key).alias("id")).join(right.select(F.col(right_key).alias("id")), "id", "left_anti")


def bulk_update(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with new values from ``updates`` (key and columns, one row a key); null values change nothing."""
    new = updates.select(key, *[F.col(c).alias("_" + c) for c in columns])
    changed = {c: F.coalesce("_" + c, c) for c in columns}
    return rows.join(new, key, "left").withColumns(changed).select(*rows.columns)


def resolve_people(incoming: DataFrame, identities: DataFrame, names: DataFrame) -> DataFrame:
    """``ref, author_id, how``: who an incoming person is: by identity, else by name, else to be created (null id).

    ``incoming``: ref, key, name; ``identities``: key, author_id; ``names``: name, author_id. Of several the smallest id.
    """
    by_key = identities.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("author_id").alias("_by_key"))
    by_name = names.where(F.col("name") != "").groupBy("name").agg(F.min("author_id").alias("_by_name"))
    found = incoming.join(by_key, "key", "left").join(by_name, "name", "left")
    how = F.when(F.col("_by_key").isNotNull(), "identity").when(F.col("_by_name").isNotNull(), "name").otherwise("create")
    return found.select("ref", F.coalesce("_by_key", "_by_name").alias("author_id"), how.alias("how"))


def rewrite_links(links: DataFrame, rewrite: DataFrame, column: str) -> DataFrame:
    """Links with merged authors renamed (``rewrite``: was, now), each link once."""
    named = links.join(rewrite.select(F.col("was").alias(column), "now"), column, "left")
    return named.withColumn(column, F.coalesce("now", column)).select(*links.columns).distinct()


def sync_turns(stored: DataFrame, payload: DataFrame, keys: list[str], parent: str, fields: list[str]) -> DataFrame:
    """What a sync does to each turn: ``keys, action, parent``.

    ``payload`` is all that the source has of the sessions: stored turns it lacks are deleted, others are
    inserted, updated where a field differs, or kept. ``parent`` is the id of the payload's turn that the last key
    names in the same session, found after all are in, so order does not matter.
    """
    old = stored.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias("_" + c) for c in fields])
    up = payload.select(*keys[:-1], F.col(keys[-1]).alias(parent), F.col("id").alias("parent"))
    new = payload.join(up, [*keys[:-1], parent], "left").select(*keys, F.lit(True).alias("_new"), "parent", *fields)
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col("_" + c))
    action = F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull(), "insert").when(same, "keep").otherwise("update")
    return old.join(new, keys, "full").select(*keys, action.alias("action"), "parent")


def complete_means(df: DataFrame, group: str, vector: str, width: int) -> DataFrame:
    """Normalised means of the groups every member of which has a usable vector; other groups have none."""
    whole = df.groupBy(group).agg(F.min(F.coalesce(vectors.usable(F.col(vector), width), F.lit(False))).alias("_all")).where("_all").select(group)
    return vectors.mean_vectors(df.join(whole, group, "left_semi"), group, vector)


def remembered(listing: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Listing with ``action``: skip_failed where the same bytes already failed under the same revision of the extractor, else try.

    Both hold the keys, ``bytes_sha`` and ``revision``; a new revision or new bytes are tried again.
    """
    known = outcomes.select(*keys, "bytes_sha", "revision", F.lit(True).alias("_failed")).distinct()
    return listing.join(known, [*keys, "bytes_sha", "revision"], "left").select(*listing.columns, F.when(F.col("_failed"), "skip_failed").otherwise("try").alias("action"))


def reuse_groups(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``grp, kept``: for each new group the stored group with the very same members, whose row (and text) is kept; null if none.

    Both: grp, members_sha256. Of several stored ones the smallest.
    """
    old = stored.groupBy("members_sha256").agg(F.min("grp").alias("kept"))
    return new.join(old, "members_sha256", "left").select("grp", "kept")


def drifted(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``grp, before, now``: stored groups whose members are no longer those they were built from (null: gone).

    Both: grp, n, members_sha256.
    """
    old = stored.select("grp", F.col("n").alias("before"), F.col("members_sha256").alias("_old"))
    both = old.join(current.select("grp", F.col("n").alias("now"), "members_sha256"), "grp", "left")
    return both.where(~F.col("members_sha256").eqNullSafe(F.col("_old"))).select("grp", "before", "now")


def matching_facts(facts: DataFrame, words: Column, wanted: list[str], part: str) -> DataFrame:
    """Facts that hold one of the wanted words or the part as it stands (wildcards mean nothing), with ``hits``, the number of words."""
    from loomspan.functions import fts

    counted = facts.withColumn("hits", fts.occurrences(words, wanted))
    return counted.where((F.col("hits") > 0) | F.lower("fact").contains(part.lower()))
