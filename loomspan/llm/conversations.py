"""Rebuilding conversations from message rows.

Every turn is an overlapping export fragment of two messages, the one it answers and itself; a fragment's
prefix is matched with other fragments' suffix by the hash of (session, external id). The overlap graph is
compacted along unambiguous paths (a message with one answer) by the hierarchy operator, which finds head and
position of every message of a path however long it is; what is left is the graph of branchings. A session
with a fragment whose prefix no suffix has, or a circle, has a gap and is dropped; so are empty sessions and
sessions in which a question has no answer below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators import hierarchy
from loomspan.session import cut

#: Turns of a session that are numbered by one task; longer sessions are numbered block by block.
BLOCK = 4096


def blank(text: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(~text.rlike(r"(?U)[^\s]"), F.lit(True))


def fragments(turns: DataFrame) -> DataFrame:
    """One row a message: ``session_id, node, up, gap, asks, answers``.

    Rows with the same external id in a session are one message, known by its smallest row id; rows without an
    external id are messages of their own. ``up`` is the message its first named parent is, ``gap`` tells
    that some row names a parent the session does not have.
    """
    named = lambda c: F.when(F.col(c) != "", F.xxhash64("session_id", c))
    rows = turns.select(
        F.col("session_id").cast("long").alias("session_id"), F.col("id").cast("long").alias("id"),
        F.coalesce(named("external_id"), F.xxhash64("session_id", "id", F.lit("row"))).alias("suffix"),
        named("parent_external_id").alias("prefix"), "role",
        (~blank(F.col("content"))).alias("said"),
    ).where(F.col("session_id").isNotNull() & F.col("id").isNotNull())
    has = lambda role: F.max(F.col("said") & (F.col("role") == role))
    messages = rows.groupBy("session_id", "suffix").agg(
        F.min("id").alias("node"), F.min(F.when(F.col("prefix").isNotNull(), F.struct("id", "prefix"))).alias("named"),
        F.coalesce(has("user"), F.lit(False)).alias("asks"), F.coalesce(has("assistant"), F.lit(False)).alias("answers"), F.collect_set("prefix").alias("prefixes"),
    )
    messages = cut(messages.select("session_id", "suffix", "node", F.col("named.prefix").alias("prefix"), F.when(F.size("prefixes") > 1, F.col("prefixes")).alias("prefixes"), "asks", "answers"))
    known = messages.select("session_id", F.col("suffix").alias("prefix"), F.col("node").alias("up"))
    joined = messages.join(known, ["session_id", "prefix"], "left")
    # rows of one message that name several parents are few; each parent is looked up
    more = messages.where(F.col("prefixes").isNotNull()).select("session_id", "node", F.explode("prefixes").alias("prefix"))
    lost = more.join(known, ["session_id", "prefix"], "left_anti").select("node", F.lit(True).alias("lost")).distinct()
    joined = joined.join(lost, "node", "left")
    return joined.select("session_id", "node", "up", ((F.col("prefix").isNotNull() & F.col("up").isNull()) | F.coalesce("lost", F.lit(False))).alias("gap"), "asks", "answers")


def paths_of(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with ``head`` and ``at`` of their unambiguous path, and the graph of paths.

    The second table: ``session_id, head, above`` (head of the path this one answers), ``circle``,
    ``last_ask``, ``last_answer`` (positions, null for none).
    """
    answers = messages.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n"))
    single = answers.where("n = 1").select(F.col("node").alias("up"), F.lit(True).alias("single"))
    linked = cut(messages.join(single, "up", "left"))
    runs = hierarchy.resolve(linked.select("node", F.when(F.col("single"), F.col("up")).alias("up")), "node", "up", unique=True)
    placed = cut(linked.drop("single").join(runs.select("node", F.col("root").alias("head"), F.col("depth").alias("at"), "circle"), "node"))
    graph = placed.groupBy("session_id", "head").agg(
        F.max(F.when(F.col("node") == F.col("head"), F.col("up"))).alias("up"), F.min("circle").alias("circle"),
        F.max(F.when(F.col("asks"), F.col("at"))).alias("last_ask"), F.max(F.when(F.col("answers"), F.col("at"))).alias("last_answer"),
    )
    tops = graph.where(F.col("up").isNotNull()).select("up", "head")
    above = tops.join(placed.select(F.col("node").alias("up"), F.col("head").alias("above")), "up").select("head", "above")
    return placed, cut(graph.join(above, "head", "left").select("session_id", "head", F.when(F.col("circle").isNull(), F.col("above")).alias("above"), "circle", "last_ask", "last_answer"))


def answered_below(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads of paths below which some path holds an answer, and heads on or under a circle.

    Marks climb by doubling: in each round a mark reaches twice as far, so the rounds are the logarithm of
    the depth of branching.
    """
    trees = cut(hierarchy.resolve(graph, "head", "above", unique=True))
    circles = trees.where(F.col("circle").isNotNull()).select(F.col("node").alias("head"))
    deepest = trees.agg(F.max("depth")).first()[0] or 0
    jump = graph.join(circles, "head", "left_anti").where(F.col("above").isNotNull()).select("head", "above")
    marks = cut(jump.join(graph.where(F.col("last_answer").isNotNull()).select("head"), "head", "left_semi").select(F.col("above").alias("head")).distinct())
    for _ in range(max(0, int(deepest)).bit_length()):
        marks = cut(marks.unionByName(jump.join(marks, "head", "left_semi").select(F.col("above").alias("head"))).distinct())
        up = jump.select(F.col("head").alias("above"), F.col("above").alias("_above"))
        jump = cut(jump.join(up, "above").select("head", F.col("_above").alias("above")))
    return marks, circles


def rebuild(turns: DataFrame, sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Messages placed in their conversations, and the sessions to drop.

    Placed: ``session_id, node, up, head, at``. Dropped: ``session_id, reason`` with the first
    reason that holds of ``empty`` (no user or assistant turn says anything; sessions without turns too),
    ``broken`` (a parent no turn of the session has, or a circle) and ``unanswered`` (a user turn that says
    something has no assistant turn that does among its descendants). Rows without session or id are left
    out, repeated rows are one message, ties in ord go by id, other columns are ignored.
    """
    messages = fragments(turns)
    placed, graph = paths_of(messages)
    marks, circles = answered_below(graph)
    open_ = graph.where(F.col("last_ask").isNotNull() & (F.col("last_answer").isNull() | (F.col("last_answer") <= F.col("last_ask")))).join(marks, "head", "left_anti")
    flags = placed.groupBy("session_id").agg(F.max(F.col("asks") | F.col("answers")).alias("says"), F.max(F.col("gap") | F.col("circle").isNotNull()).alias("broken"))
    bad = graph.join(circles, "head", "left_semi").select("session_id", F.lit(True).alias("circled")).distinct()
    late = open_.select("session_id", F.lit(True).alias("open")).distinct()
    all_ = flags.join(bad, "session_id", "left").join(late, "session_id", "left")
    if sessions is not None:
        all_ = sessions.select(F.col("id").cast("long").alias("session_id")).distinct().join(all_, "session_id", "full")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = F.when(~is_("says"), "empty").when(is_("broken") | is_("circled"), "broken").when(is_("open"), "unanswered")
    return placed.select("session_id", "node", "up", "head", "at"), all_.select("session_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def ordered(turns: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """The conversations that are whole: ``session_id, position, node, role, content``, positions from 0.

    Turns come in the order of ord, ties by their place on the path and their id. Sessions are numbered in
    blocks of ``BLOCK`` values of ord, so no task holds a whole long session.
    """
    placed, dropped = rebuild(turns, sessions)
    about = turns.select(F.col("id").cast("long").alias("node"), "role", F.col("ord").cast("long").alias("ord")).dropDuplicates(["node"])
    kept = cut(placed.join(dropped, "session_id", "left_anti").join(about, "node").withColumn("block", F.floor(F.coalesce("ord", F.lit(0)) / BLOCK)))
    from pyspark.sql import Window

    sizes = kept.groupBy("session_id", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("session_id", "block").orderBy(F.col("ord").asc_nulls_first(), "at", "node"))
    said = turns.select(F.col("id").cast("long").alias("node"), "content").dropDuplicates(["node"])
    return kept.withColumn("inside", inside).join(before, ["session_id", "block"]).join(said, "node").select("session_id", (F.col("before") + F.col("inside") - 1).alias("position"), "node", "role", "content")
