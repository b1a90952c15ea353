"""The corpus as a property graph: vertices, edges, label counts, lookup and neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import cut

MOST_HOPS = 6


def gid(label: str, key: Column) -> Column:
    return F.concat(F.lit(label + ":"), key.cast("string"))


def vertices(label: str, df: DataFrame, key: str, title: Column, *properties: str) -> DataFrame:
    """``gid, label, key, title, properties`` of one kind of row; blank titles fall back to the key."""
    shown = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.concat(F.lit(label + " "), F.col(key).cast("string")))
    body = F.to_json(F.struct(*properties)) if properties else F.lit("{}")
    return df.select(gid(label, F.col(key)).alias("gid"), F.lit(label).alias("label"), F.col(key).cast("string").alias("key"), shown.alias("title"), body.alias("properties"))


def edges(label: str, df: DataFrame, src: Column, dst: Column) -> DataFrame:
    """``label, src, dst`` without repeats."""
    return df.select(F.lit(label).alias("label"), src.alias("src"), dst.alias("dst")).where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def attached(edge_rows: DataFrame, vertex_rows: DataFrame) -> DataFrame:
    """Edges both ends of which are vertices."""
    ids = vertex_rows.select("gid")
    return edge_rows.join(ids.withColumnRenamed("gid", "src"), "src", "left_semi").join(ids.withColumnRenamed("gid", "dst"), "dst", "left_semi").select("label", "src", "dst")


def find(vertex_rows: DataFrame, words: str, limit: int = 25, labels: list[str] | None = None) -> DataFrame:
    """Vertices whose title holds the words, or whose key is the number; titles first."""
    hit = F.col("title").ilike(f"%{words}%") | (F.col("key") == words)
    rows = vertex_rows.where(hit & F.col("label").isin(*labels)) if labels else vertex_rows.where(hit)
    return rows.orderBy("label", "title", "gid").limit(limit)


def relations(rows: DataFrame, ends: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Edges ``label, src, dst`` of relations named by text: ``subject, label, object``.

    An end is the vertex of that name (case and outer blanks aside) with the smallest ``rank``; relations without
    two known ends are dropped, labels that are not allowed become RELATED_TO. ``ends``: gid, name, rank.
    """
    known = ends.groupBy("name").agg(F.min_by("gid", "rank").alias("gid"))
    end = lambda c, to: known.select(F.col("name").alias(c), F.col("gid").alias(to))
    label = F.when(F.col("label").isin(*allowed), F.col("label")).otherwise("RELATED_TO")
    named = rows.select(label.alias("label"), *[F.lower(F.trim(c)).alias(c) for c in ("subject", "object")]).distinct()
    return named.join(end("subject", "src"), "subject").join(end("object", "dst"), "object").select("label", "src", "dst").distinct()


def neighbourhood(vertex_rows: DataFrame, edge_rows: DataFrame, seeds: DataFrame, hops: int, labels: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """``neighbourhood_within`` without the flag."""
    return neighbourhood_within(vertex_rows, edge_rows, seeds, hops, labels, limit)[0]


def neighbourhood_within(vertex_rows: DataFrame, edge_rows: DataFrame, seeds: DataFrame, hops: int, labels: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, bool]:
    """``gid, hops`` of vertices within ``hops`` steps of the seeds, edges taken both ways, breadth first; and whether some were left out.

    Vertices of other labels are neither shown nor walked through; edges are narrowed to the labels asked for before
    they are walked. With ``limit``, the nearest (then smallest) ids are kept at each hop.
    """
    if not 0 <= hops <= MOST_HOPS:
        raise ValueError(f"hops must be between 0 and {MOST_HOPS}")
    allowed = vertex_rows.where(F.col("label").isin(*labels)).select("gid") if labels else vertex_rows.select("gid")
    inner = edge_rows
    if labels:  # ids begin with their label
        begins = lambda c: F.substring_index(c, ":", 1).isin(*labels)
        inner = edge_rows.where(begins("src") & begins("dst"))
    links = inner.select(F.col("src").alias("gid"), F.col("dst").alias("to")).unionByName(inner.select(F.col("dst").alias("gid"), F.col("src").alias("to")))
    seen = cut(seeds.select("gid").distinct().join(allowed, "gid", "left_semi").withColumn("hops", F.lit(0)))
    truncated, count = False, seen.count() if limit is not None else 0
    for hop in range(1, hops + 1):
        edge = seen.where(F.col("hops") == hop - 1)
        new = links.join(edge.select("gid"), "gid", "left_semi").select(F.col("to").alias("gid")).distinct().join(allowed, "gid", "left_semi").join(seen, "gid", "left_anti")
        if limit is not None:
            room = max(0, limit - count)
            new = cut(new.orderBy("gid").limit(room + 1))
            found = new.count()
            truncated |= found > room
            new = new.orderBy("gid").limit(room)
            count += min(found, room)
        seen = cut(seen.unionByName(new.withColumn("hops", F.lit(hop))))
    return seen, truncated
