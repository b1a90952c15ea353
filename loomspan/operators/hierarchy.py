"""Parent-child rows to hierarchies of unknown depth.

Weighted disjoint-set forests: every range of ids links its own rows first (``_link``, vectorised over the
partition), each row then knows the topmost ancestor inside its range and its offset below it. Only the rows
that other ranges point at ("ports") enter the next, coarser merge, with the offsets as weights. Every merge
has as many ranges as keep each of them under ``top_rows`` rows, so none is one task's whole; where merging
does not shrink the ports, pointer doubling by joins takes over. Roots, depths and circles come back down by
one join per level, and paths by walking the parent index of each range and joining the ports' paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import cut, shuffle_width

#: Rows that one partition may link, at any level of the merge tree (about 100 bytes a row).
TOP_ROWS = 1_000_000
#: Resolved ports that may be broadcast (about 40 bytes a row); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Ids of ports' paths that may be broadcast (8 bytes each).
BROADCAST_IDS = 2_000_000
#: Ids of paths that are built at once in a task.
PATH_IDS = 500_000
_LINKED = "node long, top long, off long, ext long, circle long, lo long, step long, up long"


def _link(node, parent, has, weight, lo, top, base, circle, looped):
    """Links the rows of one partition by pointer doubling over offsets; returns the columns of ``_LINKED``.

    ``has`` marks rows with a parent, ``looped`` those known to end in the circle ``circle``. Of repeated
    nodes the smallest parent counts, a missing one last.
    """
    order = np.lexsort((np.where(has, parent, np.iinfo(np.int64).max), node))
    node, parent, has, weight, lo, top, base, circle, looped = (a[order] for a in (node, parent, has, weight, lo, top, base, circle, looped))
    first = np.ones(len(node), bool)
    first[1:] = node[1:] != node[:-1]
    node, parent, has, weight, lo, top, base, circle, looped = (a[first] for a in (node, parent, has, weight, lo, top, base, circle, looped))
    n = len(node)
    has = has & ~looped
    at = np.minimum(np.searchsorted(node, parent), max(n - 1, 0))
    inside = has & (node[at] == parent) if n else has
    jump = np.where(inside, at, np.arange(n))
    off = np.where(inside, weight, 0)
    low = lo.copy()
    for _ in range(int(n).bit_length() + 1):
        if not inside[jump].any():
            break
        low = np.minimum(low, low[jump])
        off = off + off[jump]
        jump = jump[jump]
    round_ = inside[jump]  # still pointing on after more jumps than there are rows: it runs in a circle
    low_end = np.minimum(low, low[jump])
    ends = np.where(round_, low[jump], circle[jump])
    ext = np.where(has[jump] & ~round_, parent[jump], 0)
    has_ext = has[jump] & ~round_
    step = weight[jump] - base[jump]  # from the top of the own range to its parent in another
    return node, top[jump], off + base[jump], ext, has_ext, ends, round_ | looped[jump], low_end, step, parent, has


def _batches(it: Iterator[pa.RecordBatch]) -> pa.Table | None:
    parts = list(it)
    return pa.Table.from_batches(parts) if parts else None


def _link_partition(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = _batches(it)
    if t is None or not t.num_rows:
        return
    get = lambda c: t.column(c).fill_null(0).to_numpy()
    has = t.column("parent").is_valid().to_numpy()
    looped = t.column("circle").is_valid().to_numpy()
    node, top, off, ext, has_ext, circle, in_circle, lo, step, up, has_up = _link(get("node"), get("parent"), has, get("weight"), get("lo"), get("top"), get("base"), get("circle"), looped)
    arrays = [pa.array(node), pa.array(top), pa.array(off), pa.array(ext, mask=~has_ext), pa.array(circle, mask=~in_circle), pa.array(lo), pa.array(step), pa.array(up, mask=~has_up)]
    yield from pa.Table.from_arrays(arrays, ["node", "top", "off", "ext", "circle", "lo", "step", "up"]).to_batches(max_chunksize=100_000)


def _double(edges: DataFrame) -> DataFrame:
    """Roots by pointer doubling with joins, for ports that merging does not shrink. Columns as ``_merge``.

    Rows that have arrived point at themselves, so no key gathers them.
    """
    known = edges.select(F.col("node").alias("_n"))
    on = F.col("circle").isNull() & F.col("_n").isNotNull()
    start = edges.join(known, F.coalesce("parent", "node") == F.col("_n"), "left").withColumn("_n", F.when(F.col("parent").isNotNull(), F.col("_n")))
    state = cut(start.select("node", F.when(on, F.col("_n")).otherwise(F.col("node")).alias("ptr"), F.when(on, F.col("weight")).otherwise(F.col("base")).alias("off"), "top", "circle", "lo", F.col("parent").alias("up"), on.alias("on")))
    for _ in range(max(1, int(state.count()).bit_length() + 1)):
        if state.where("on").isEmpty():
            break
        over = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"), F.col("off").alias("_o"), F.col("top").alias("_t"), F.col("circle").alias("_c"), F.col("lo").alias("_l"), F.col("on").alias("_on"))
        pick = lambda new, old: F.when(F.col("on"), new).otherwise(F.col(old))
        state = cut(
            state.join(over, "ptr").select(
                "node", pick(F.when(F.col("_on"), F.col("_p")).otherwise(F.col("node")), "ptr").alias("ptr"), pick(F.col("off") + F.col("_o"), "off").alias("off"), pick(F.col("_t"), "top").alias("top"),
                pick(F.coalesce("_c", "circle"), "circle").alias("circle"), pick(F.least("lo", "_l"), "lo").alias("lo"), "up", (F.col("on") & F.col("_on")).alias("on"),
            )
        )
    # what still points on runs in a circle; the row it points at lies on it and has seen all of it
    ends = state.where("on").select(F.col("node").alias("ptr"), F.col("lo").alias("_round"))
    circle = F.when(F.col("on"), F.coalesce("circle", "_round")).otherwise(F.col("circle"))
    return state.join(ends, "ptr", "left").select("node", F.col("top").alias("root"), F.col("off").alias("depth"), circle.alias("circle"), "up")


def _ranges(parts: int, rows: int, top_rows: int) -> int:
    """Ranges of a merge: ``parts``, or more where these would hold more than ``top_rows`` rows each."""
    return max(parts, -(-rows // max(1, top_rows)))


def _merge(edges: DataFrame, parts: int, rows: int, top_rows: int, fan_in: int) -> DataFrame:
    """Columns node, root, depth, circle, up for all nodes of ``edges``, of which there are ``rows``."""
    last = rows <= top_rows and parts <= 1
    placed = edges.repartition(1) if last else edges.repartitionByRange(_ranges(parts, rows, top_rows), "node")
    linked = placed.mapInArrow(_link_partition, _LINKED)
    done = lambda x: x.select("node", F.col("top").alias("root"), F.col("off").alias("depth"), "circle", "up")
    if last:
        return done(linked)
    linked = cut(linked)
    ports = linked.where(F.col("ext").isNotNull()).select(F.col("ext").alias("node")).distinct()
    inner = linked.join(ports, "node", "left_semi").select("node", F.col("ext").alias("parent"), (F.col("off") + F.col("step")).alias("weight"), "lo", "top", F.col("off").alias("base"), "circle")
    inner = cut(inner)
    left = inner.count()
    if left > top_rows and left > 0.8 * rows:
        above = _double(inner)
    else:
        above = _merge(inner, 1 if left <= top_rows else max(2, parts // fan_in), left, top_rows, fan_in)
    above = above.select(F.col("node").alias("ext"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("circle").alias("_circle"))
    # rows that stay in their range are not joined; they are most, and have no key to spread them by
    hanging = linked.where(F.col("ext").isNotNull()).join(F.broadcast(above) if left <= BROADCAST_ROWS else above, "ext", "left")
    met = hanging.select(
        "node",
        F.coalesce("_root", "top").alias("root"),
        F.when(F.col("_root").isNotNull(), F.col("off") + F.col("step") + F.col("_depth")).otherwise(F.col("off")).alias("depth"),
        F.coalesce("circle", "_circle").alias("circle"),
        "up",
    )
    return met.unionByName(done(linked.where(F.col("ext").isNull())))


def _edges(df: DataFrame, node: Column, parent: Column, weight: Column) -> DataFrame:
    rows = df.select(node.cast("long").alias("node"), parent.cast("long").alias("parent"), weight.cast("long").alias("weight")).where(F.col("node").isNotNull())
    return rows.select("*", F.col("node").alias("lo"), F.col("node").alias("top"), F.lit(0).cast("long").alias("base"), F.lit(None).cast("long").alias("circle"))


def _resolve(df: DataFrame, node: str | Column, parent: str | Column, parts: int | None, top_rows: int, fan_in: int, unique: bool = False) -> DataFrame:
    """``resolve`` with ``up``, the parent of each row that has one in the table."""
    node, parent = (F.col(c) if isinstance(c, str) else c for c in (node, parent))
    links = df.select(node.cast("long").alias("node"), parent.cast("long").alias("parent")).where(F.col("node").isNotNull())
    rows = links.count()
    if not unique:
        links = links.groupBy("node").agg(F.min("parent").alias("parent"))  # a node repeated often is one row before it is placed
    out = _merge(_edges(links, F.col("node"), F.col("parent"), F.lit(1)), parts or shuffle_width(df.sparkSession), rows, top_rows, fan_in)
    looped = F.col("circle").isNotNull()
    depth = F.when(looped, F.lit(-1)).otherwise(F.col("depth")).cast("int")
    return out.select("node", F.when(looped, F.col("circle")).otherwise(F.col("root")).alias("root"), depth.alias("depth"), "circle", F.when(looped | (F.col("depth") > 0), F.col("up")).alias("up"))


def resolve(df: DataFrame, node: str | Column, parent: str | Column, *, unique: bool = False, parts: int | None = None, top_rows: int = TOP_ROWS, fan_in: int = 8) -> DataFrame:
    """Root and depth of every row: columns ``node, root, depth, circle``.

    A parent id that no row has counts as no parent. Where the parents run into a circle, ``depth`` is -1 and
    both ``root`` and ``circle`` are the smallest id on it; else ``circle`` is null. Rows whose node is null
    are left out, repeated nodes come out once with the smallest parent named for them. Other columns of the
    input are ignored, so their names cannot clash. An empty table gives no rows. No task links more than about
    ``top_rows`` rows. ``unique`` says that no node is repeated, which saves a shuffle.
    """
    return _resolve(df, node, parent, parts, top_rows, fan_in, unique).drop("up")


def _local_paths(it: Iterator[pa.RecordBatch], wanted: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of one range (node, up, root, depth, want), all or the wanted ones, with ``ext`` (the parent in another range the row hangs from, if any) and the path below it."""
    t = _batches(it)
    if t is None or not t.num_rows:
        return
    t = t.take(pa.compute.sort_indices(t, [("node", "ascending")]))
    node, up, has = t.column("node").to_numpy(), t.column("up").fill_null(0).to_numpy(), t.column("up").is_valid().to_numpy()
    n = len(node)
    at = np.minimum(np.searchsorted(node, up), n - 1)
    inside = has & (node[at] == up)
    above = np.where(inside, at, -1)
    jump, lengths = np.where(inside, at, np.arange(n)), inside.astype(np.int64)
    while inside[jump].any():
        lengths = lengths + lengths[jump]
        jump = jump[jump]
    lengths += 1
    ext, has_ext = up[jump], (has & ~inside)[jump]
    shown = np.flatnonzero(t.column("want").to_numpy()) if wanted else np.arange(n)
    ends = np.cumsum(lengths[shown])
    start = 0
    while start < len(shown):  # as many rows as PATH_IDS ids fill, one at least
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PATH_IDS, "right")))
        rows = at = shown[start:stop]
        offsets = np.concatenate([[0], np.cumsum(lengths[rows])])
        ids, write = np.zeros(offsets[-1], np.int64), offsets[1:] - 1
        while len(rows):
            ids[write] = node[rows]
            rows, write = above[rows], write - 1
            rows, write = rows[rows >= 0], write[rows >= 0]
        part = t.take(pa.array(at))
        arrays = [*(part.column(c).combine_chunks() for c in ("node", "root", "depth")), pa.array(ext[at], mask=~has_ext[at]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))]
        yield pa.RecordBatch.from_arrays(arrays, ["node", "root", "depth", "ext", "path"])
        start = stop


def paths(df: DataFrame, node: str, parent: str, *, wanted: DataFrame | None = None, parts: int | None = None, top_rows: int = TOP_ROWS, fan_in: int = 8) -> DataFrame:
    """``resolve`` with ``path``, the ids from the root down to the row, null where there is a circle; of all rows, or those ``wanted`` (column node).

    Each range of ids walks its own parent index; only the paths of ports, the rows that other ranges hang
    from, are then put together, by joins that double them, and set before the paths that hang from them.
    """
    trees = _resolve(df, node, parent, parts, top_rows, fan_in)
    asked = F.lit(True)
    if wanted is not None:
        trees = trees.join(wanted.select("node", F.lit(True).alias("_want")).distinct(), "node", "left")
        asked = F.coalesce("_want", F.lit(False))
    trees = trees.select("node", "root", "depth", "circle", "up", asked.alias("want"))
    trees = cut(trees.repartitionByRange(parts or shuffle_width(df.sparkSession), "node"))  # its partitions stay as they are below
    schema = "node long, root long, depth int, ext long, path array<long>"
    sound = trees.where(F.col("depth") >= 0).select("node", "up", "root", "depth", "want")
    local = sound.mapInArrow(_local_paths, schema)
    hang = cut(local.where(F.col("ext").isNotNull()).select("node", "ext"))
    ports = cut(hang.select(F.col("ext").alias("node")).distinct())
    few = ports.count() <= BROADCAST_ROWS
    of_ports = local.join(F.broadcast(ports) if few else ports, "node", "left_semi")
    state = cut(of_ports.select("node", F.coalesce("ext", "node").alias("ptr"), "path"))
    while not state.where("ptr <> node").isEmpty():
        over = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"), F.col("path").alias("_path"))
        up = F.when(F.col("_p") == F.col("ptr"), F.col("node")).otherwise(F.col("_p"))  # arrived: points at itself
        state = cut(state.join(over, "ptr").select("node", F.when(F.col("ptr") == F.col("node"), F.col("node")).otherwise(up).alias("ptr"), F.when(F.col("ptr") == F.col("node"), F.col("path")).otherwise(F.concat("_path", "path")).alias("path")))
    before = state.select(F.col("node").alias("ext"), F.col("path").alias("_path"))
    if few and (before.agg(F.sum(F.size("_path"))).first()[0] or 0) <= BROADCAST_IDS:
        before = F.broadcast(before)
    nothing = F.lit(None).cast("long")
    local = sound.mapInArrow(lambda it: _local_paths(it, True), schema)
    met = local.where(F.col("ext").isNotNull()).join(before, "ext").select("node", "root", "depth", nothing.alias("circle"), F.concat("_path", "path").alias("path"))
    own = local.where(F.col("ext").isNull()).select("node", "root", "depth", nothing.alias("circle"), "path")
    looped = trees.where((F.col("depth") < 0) & F.col("want")).select("node", "root", "depth", "circle", F.lit(None).cast("array<long>").alias("path"))
    return met.unionByName(own).unionByName(looped)


def descendants(walked: DataFrame) -> DataFrame:
    """From the result of ``paths``: one row for each node and each of its descendants, with their distance."""
    up = walked.where(F.col("depth") > 0).select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return up.where(F.col("at") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def descendant_counts(walked: DataFrame) -> DataFrame:
    """From the result of ``paths``: each row with its number of descendants."""
    return walked.join(descendants(walked).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_descendants")), "node", "left").fillna(0, ["n_descendants"])


def _local_sums(node: np.ndarray, parent: np.ndarray, has: np.ndarray, weight: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of weights over the subtrees inside each range: order, top, its parent outside (or none), sum.

    Rows must form a forest without repeats. Levels are added from the deepest up.
    """
    order = np.argsort(node, kind="stable")
    node, parent, has, weight, part = (a[order] for a in (node, parent, has, weight, part))
    n = len(node)
    at = np.minimum(np.searchsorted(node, parent), max(n - 1, 0))
    inside = has & (node[at] == parent) & (part[at] == part) if n else has
    jump, off = np.where(inside, at, np.arange(n)), inside.astype(np.int64)
    while n and inside[jump].any():
        off = off + off[jump]
        jump = jump[jump]
    total = weight.copy()
    deepest_first = np.argsort(-off, kind="stable")
    starts = np.flatnonzero(np.diff(off[deepest_first], prepend=-1)) if n else np.zeros(0, int)
    for a, b in zip(starts, [*starts[1:], n]):
        rows = deepest_first[a:b]
        if off[rows[0]] == 0:
            break
        np.add.at(total, at[rows], total[rows])
    return order, node[jump], parent[jump], (has & ~inside)[jump], total


def _sum_partition(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = _batches(it)
    if t is None or not t.num_rows:
        return
    get = lambda c: t.column(c).fill_null(-1).to_numpy()
    order, top, ext, has_ext, total = _local_sums(get("node"), get("parent"), t.column("parent").is_valid().to_numpy(), get("weight"), get("part"))
    rows = t.take(pa.array(order))
    arrays = [rows.column("node"), rows.column("parent"), rows.column("weight"), rows.column("part"), pa.array(top), pa.array(ext, mask=~has_ext), pa.array(total)]
    yield from pa.Table.from_arrays(arrays, ["node", "parent", "weight", "part", "top", "ext", "total"]).to_batches(max_chunksize=100_000)


def _doubled_sums(forest: DataFrame) -> DataFrame:
    """``node, total`` by doubling: in each round a row's sum takes in what hangs twice as far below it."""
    state = cut(forest.select("node", F.coalesce("parent", "node").alias("ptr"), F.col("weight").alias("total")))
    while not (moving := state.where("ptr <> node")).isEmpty():
        gain = moving.groupBy("ptr").agg(F.sum("total").alias("_gain")).withColumnRenamed("ptr", "node")
        over = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"))
        up = F.when((F.col("ptr") == F.col("node")) | (F.col("_p") == F.col("ptr")), F.col("node")).otherwise(F.col("_p"))
        state = cut(state.join(over, "ptr").select("node", up.alias("ptr"), "total").join(gain, "node", "left").select("node", "ptr", (F.col("total") + F.coalesce("_gain", F.lit(0))).alias("total")))
    return state.select("node", "total")


def _subtree_sums(edges: DataFrame, parts: int, rows: int, top_rows: int, fan_in: int) -> DataFrame:
    """``node, total`` of a forest of ``rows`` rows: node, parent, weight; no circles, no repeats, every parent a node.

    Ranges add up their own subtrees; the tops of ranges, hanging from nodes of other ranges, form a smaller
    forest whose sums are found the same way and then added below the nodes they hang from.
    """
    run = lambda x: x.mapInArrow(_sum_partition, "node long, parent long, weight long, part int, top long, ext long, total long")
    if rows <= top_rows and parts <= 1:
        return run(edges.repartition(1).withColumn("part", F.lit(0))).select("node", "total")
    parts = _ranges(parts, rows, top_rows)
    first = cut(run(edges.repartitionByRange(parts, "node").withColumn("part", F.spark_partition_id())))
    hanging = first.where((F.col("node") == F.col("top")) & F.col("ext").isNotNull()).select("node", "ext", "total")
    above = first.select(F.col("node").alias("ext"), F.col("top").alias("parent"))
    tops = first.where((F.col("node") == F.col("top")) & F.col("ext").isNull()).select("node", F.lit(None).cast("long").alias("parent"), F.col("total").alias("weight"))
    smaller = hanging.join(above, "ext").select("node", "parent", F.col("total").alias("weight"))
    used = smaller.select(F.col("parent").alias("node")).distinct()
    inner = cut(smaller.unionByName(tops.join(used, "node", "left_semi")))
    count = inner.count()
    if not count:
        return first.select("node", "total")
    if count > top_rows and count > 0.8 * rows:
        whole = _doubled_sums(inner)
    else:
        whole = _subtree_sums(inner, 1 if count <= top_rows else max(2, parts // fan_in), count, top_rows, fan_in)
    added = hanging.select("node", "ext").join(whole, "node").groupBy(F.col("ext").alias("node")).agg(F.sum("total").alias("_add"))
    again = first.join(added, "node", "left").select("node", "parent", (F.col("weight") + F.coalesce("_add", F.lit(0))).alias("weight"), "part")
    return run(again.repartition(parts, "part")).select("node", "total")  # the same ranges again


def intervals(df: DataFrame, node: str, parent: str, *, parts: int | None = None, top_rows: int = TOP_ROWS, fan_in: int = 8) -> DataFrame:
    """``resolve`` with ``enter`` and ``leave``: the descendants of a row are the rows of its root whose enter lies between.

    A walk of each tree, children by id, visits a row at ``enter`` and has done its subtree by ``leave``
    (so leave - enter - 1 is the number of descendants). It says all ancestors and descendants of every row
    in two numbers, where paths grow with the depth. Both are null for rows in or under a circle.
    """
    width = parts or shuffle_width(df.sparkSession)
    trees = cut(_resolve(df, node, parent, parts, top_rows, fan_in))
    forest = trees.where(F.col("depth") >= 0).select("node", F.col("up").alias("parent"))
    rows = forest.count()
    sizes = cut(_subtree_sums(forest.select("node", "parent", F.lit(1).cast("long").alias("weight")), width, rows, top_rows, fan_in))
    children = forest.where(F.col("parent").isNotNull()).join(sizes, "node")
    from loomspan.operators.prefix import running_sum

    before = running_sum(children, "parent", ["node"], F.col("total"), "before").select("node", (F.col("before") + 1).alias("weight"))
    edges = _edges(forest.join(before, "node", "left"), F.col("node"), F.col("parent"), F.coalesce("weight", F.lit(1)))
    walked = _merge(edges, width, rows, top_rows, fan_in)
    seen = walked.select("node", F.col("depth").alias("enter")).join(sizes, "node").select("node", "enter", (F.col("enter") + F.col("total")).alias("leave"))
    return trees.join(seen, "node", "left").select("node", "root", "depth", "circle", "enter", "leave")


def on_the_way_up(links: DataFrame, seeds: DataFrame, deepest: int) -> DataFrame:
    """``node`` of the seeds and all their ancestors. ``links``: node, parent of trees without circles.

    Marks climb by doubling: each round they reach twice as far, and links are squared.
    """
    jump = links.where(F.col("parent").isNotNull()).select("node", "parent")
    marks = cut(seeds.select("node").distinct())
    for _ in range(int(max(0, deepest)).bit_length()):
        marks = cut(marks.unionByName(jump.join(marks, "node", "left_semi").select(F.col("parent").alias("node"))).distinct())
        up = jump.select(F.col("node").alias("parent"), F.col("parent").alias("_p"))
        jump = cut(jump.join(up, "parent").select("node", F.col("_p").alias("parent")))
    return marks
