"""Incremental ingest as keyed merges: what changed, what is kept, what may be deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.prefix import running_sum

#: Share of a source's documents that one reconcile may delete.
DELETE_SHARE = 0.25
#: Stalled reads after which no more are begun.
MOST_STALLED = 4


def skip_ladder(listing: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Listing with ``action``: the first test that shows a file needs no work, from cheap to dear.

    Both hold the keys, ``mtime, size, bytes_sha, text_sha, chunker``. Actions: skip_stat, skip_bytes,
    refresh_stat (same text and chunker, new bytes), replace, insert.
    """
    old = state.select(*keys, *[F.col(c).alias("_" + c) for c in ("mtime", "size", "bytes_sha", "text_sha", "chunker")], F.lit(True).alias("_known"))
    same = lambda c: F.col(c).eqNullSafe(F.col("_" + c))
    action = F.when(F.col("_known").isNull(), "insert").when(same("mtime") & same("size"), "skip_stat").when(same("bytes_sha"), "skip_bytes").when(same("text_sha") & same("chunker"), "refresh_stat").otherwise("replace")
    return listing.join(old, keys, "left").select(*listing.columns, action.alias("action"))


def chunk_actions(old: DataFrame, new: DataFrame) -> DataFrame:
    """``document_id, ord, action``: keep a chunk only if its place, hash and chunker are the same; else delete and insert."""
    a = old.select("document_id", "ord", F.col("sha").alias("_sha"), F.col("chunker").alias("_chunker"), F.lit(True).alias("_old"))
    both = a.join(new.select("document_id", "ord", "sha", "chunker", F.lit(True).alias("_new")), ["document_id", "ord"], "full")
    action = F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull(), "insert").when(F.col("sha").eqNullSafe(F.col("_sha")) & F.col("chunker").eqNullSafe(F.col("_chunker")), "keep").otherwise("replace")
    return both.select("document_id", "ord", action.alias("action"))


def latest(rows: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """One row a key: the newest version (upsert). The top of each key is taken before rows are shuffled."""
    top = Window.partitionBy(*keys).orderBy(*version)
    return rows.withColumn("_r", F.row_number().over(top)).where("_r = 1").drop("_r")


def owners(claims: DataFrame, key: str, weak_kind: str = "spotlight") -> DataFrame:
    """Which source owns a document that several hold: real sources before system indexes, then the first to link it."""
    return latest(claims, [key], [(F.col("kind") == weak_kind).asc(), F.col("linked_at").asc(), F.col("source_id").asc()])


def reconcile(documents: DataFrame, seen: DataFrame, keys: list[str], share: float = DELETE_SHARE) -> DataFrame:
    """Documents a completed run did not see, with ``allowed``: false where too large a part of the source would go."""
    gone = documents.join(seen, keys, "left_anti")
    sizes = documents.groupBy("source_id").agg(F.count("*").alias("_all"))
    lost = gone.groupBy("source_id").agg(F.count("*").alias("_gone"))
    guard = sizes.join(lost, "source_id").select("source_id", (F.col("_gone") <= share * F.col("_all")).alias("allowed"))
    return gone.join(guard, "source_id")


def within_budget(files: DataFrame, group: str, order: list[str], size: Column, cap: int, files_cap: int = 0, failed: Column | None = None, stalled: Column | None = None, most_stalled: int = MOST_STALLED) -> DataFrame:
    """Files to fetch before a byte and a file budget is spent (0: no limit); the last one may go over it.

    ``failed`` and ``stalled`` tell how the fetch of a file ends: only successes are charged, and after
    ``most_stalled`` stalled reads of a group the rest is left for a later run.
    """
    lost = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    hung = F.coalesce(stalled, F.lit(False)) if stalled is not None else F.lit(False)
    charged = ~lost & ~hung
    summed = running_sum(files, group, order, F.when(charged, size).otherwise(0), "_bytes")
    if files_cap:
        summed = running_sum(summed, group, order, charged.cast("int"), "_files").where(F.col("_files") < files_cap).drop("_files")
    if stalled is not None:
        summed = running_sum(summed, group, order, hung.cast("int"), "_hung").where(F.col("_hung") < most_stalled).drop("_hung")
    return (summed.where(F.col("_bytes") < cap) if cap else summed).drop("_bytes")


def lookup_contacts(handles: DataFrame, contacts: DataFrame, national: int = 10) -> DataFrame:
    """Adds ``name`` to handles (column ``key``): by the whole key, else by the last digits if only one name has them.

    ``contacts``: ``key, name``. Mail addresses match whole only.
    """
    exact = contacts.groupBy("key").agg(F.min("name").alias("_exact"))
    phones = contacts.where(~F.col("key").contains("@") & (F.length("key") >= national)).select(F.substring("key", -national, national).alias("_end"), "name")
    ends = phones.groupBy("_end").agg(F.countDistinct("name").alias("_n"), F.min("name").alias("_by_end")).where("_n = 1").drop("_n")
    with_end = handles.withColumn("_end", F.when(~F.col("key").contains("@") & (F.length("key") >= national), F.substring("key", -national, national)))
    return with_end.join(exact, "key", "left").join(ends, "_end", "left").withColumn("name", F.coalesce("_exact", "_by_end")).drop("_end", "_exact", "_by_end")


def sync_sources(declared: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """``slug, action`` of each declared source: created, updated or unchanged; stored ones alone are left alone."""
    old = stored.select("slug", *[F.col(c).alias("_" + c) for c in fields], F.lit(True).alias("_known"))
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col("_" + c))
    return declared.join(old, "slug", "left").select("slug", F.when(F.col("_known").isNull(), "created").when(same, "unchanged").otherwise("updated").alias("action"))
