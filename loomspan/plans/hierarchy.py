"""Queries over parent-child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import hierarchy
from loomspan.session import table

#: Table and parent column of each forest.
FORESTS = (("session_turns", "parent_turn_id"), ("sessions", "parent_session_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every turn and session that names a parent; circles have depth -1."""
    found = None
    for name, parent in FORESTS:
        rows = table(spark, sf_dir, name).select("id", parent)
        trees = hierarchy.resolve(rows, "id", parent)
        named = rows.where(F.col(parent).isNotNull()).select(F.col("id").alias("node")).distinct()
        part = trees.join(named, "node", "left_semi").select(F.lit(name).alias("tbl"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")
        found = part if found is None else found.unionByName(part)
    return found


def p4_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns and sessions with root, depth and the walk interval that holds exactly their descendants."""
    found = None
    for name, parent in FORESTS:
        part = hierarchy.intervals(table(spark, sf_dir, name).select("id", parent), "id", parent)
        part = part.select(F.lit(name).alias("tbl"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", "enter", "leave", (F.col("leave") - F.col("enter") - 1).alias("descendants"))
        found = part if found is None else found.unionByName(part)
    return found


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns and sessions with their path, the ids from the root down to the row; null in or under a circle."""
    found = None
    for name, parent in FORESTS:
        part = hierarchy.paths(table(spark, sf_dir, name).select("id", parent), "id", parent)
        part = part.select(F.lit(name).alias("tbl"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", "path")
        found = part if found is None else found.unionByName(part)
    return found


def _forest_sql(name: str, parent: str) -> str:
    return f"""
    SELECT '{name}' AS tbl, node AS node_id,
           CASE WHEN depth < 0 THEN lo ELSE top END AS root_id, depth::INTEGER AS depth
    FROM (
      WITH RECURSIVE link AS (
        SELECT a.id, min(b.id) AS up FROM {name} a LEFT JOIN {name} b ON a.{parent} = b.id GROUP BY a.id
      ), good AS (
        SELECT id AS node, id AS top, 0 AS depth FROM link WHERE up IS NULL
        UNION ALL
        SELECT l.id, g.top, g.depth + 1 FROM good g JOIN link l ON l.up = g.node
      ), bad AS (
        SELECT * FROM link WHERE id NOT IN (SELECT node FROM good)
      ), reach AS (
        SELECT id AS node, up AS top FROM bad
        UNION
        SELECT r.node, b.up FROM reach r JOIN bad b ON b.id = r.top
      ), lows AS (
        SELECT r.node, min(r.top) AS lo FROM reach r
        WHERE r.top IN (SELECT node FROM reach WHERE node = top) GROUP BY r.node
      )
      SELECT node, top, depth, NULL AS lo FROM good
      UNION ALL SELECT node, NULL, -1, lo FROM lows
    ) WHERE node IN (SELECT id FROM {name} WHERE {parent} IS NOT NULL)"""


def _interval_sql(name: str, parent: str) -> str:
    return f"""
    SELECT '{name}' AS tbl, t.id AS node_id, coalesce(g.top, b.root_id) AS root_id, coalesce(g.depth, -1)::INTEGER AS depth,
           g.enter, g.enter + g.n AS leave, g.n - 1 AS descendants
    FROM {name} t LEFT JOIN (
      WITH RECURSIVE link AS (
        SELECT a.id, min(b.id) AS up FROM {name} a LEFT JOIN {name} b ON a.{parent} = b.id GROUP BY a.id
      ), good AS (
        SELECT id AS node, id AS top, 0 AS depth, [id] AS path FROM link WHERE up IS NULL
        UNION ALL
        SELECT l.id, g.top, g.depth + 1, list_append(g.path, l.id) FROM good g JOIN link l ON l.up = g.node
      ), below AS (
        SELECT unnest(path) AS node, count(*) AS n FROM good GROUP BY 1
      )
      SELECT good.node, top, depth, row_number() OVER (PARTITION BY top ORDER BY path) - 1 AS enter, n FROM good JOIN below USING (node)
    ) g ON g.node = t.id LEFT JOIN ({_forest_sql(name, parent)}) b ON b.node_id = t.id"""


def _path_sql(name: str, parent: str) -> str:
    return f"""
    SELECT '{name}' AS tbl, t.id AS node_id, coalesce(g.top, b.root_id) AS root_id, coalesce(g.depth, -1)::INTEGER AS depth, g.path
    FROM (SELECT DISTINCT id FROM {name} WHERE id IS NOT NULL) t LEFT JOIN (
      WITH RECURSIVE link AS (
        SELECT a.id, min(b.id) AS up FROM {name} a LEFT JOIN {name} b ON a.{parent} = b.id GROUP BY a.id
      ), good AS (
        SELECT id AS node, id AS top, 0 AS depth, [id] AS path FROM link WHERE up IS NULL
        UNION ALL
        SELECT l.id, g.top, g.depth + 1, list_append(g.path, l.id) FROM good g JOIN link l ON l.up = g.node
      )
      SELECT * FROM good
    ) g ON g.node = t.id LEFT JOIN ({_forest_sql(name, parent)}) b ON b.node_id = t.id"""


QUERIES = {"p4_found": p4_found, "p4_intervals": p4_intervals, "p4_paths": p4_paths}
ORACLES = {"p4_found": " UNION ALL ".join(f"SELECT * FROM ({_forest_sql(*f)})" for f in FORESTS), "p4_intervals": " UNION ALL ".join(f"SELECT * FROM ({_interval_sql(*f)})" for f in FORESTS), "p4_paths": " UNION ALL ".join(f"SELECT * FROM ({_path_sql(*f)})" for f in FORESTS)}
