"""Semantic deduplication of facts: similar pairs, components, linkage, anchors and grown groups."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import cut

#: Rows of one block of a similarity join, and queries that travel to every task at a time.
BLOCK, QUERY_BLOCK = 8_000, 100_000


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Unit vectors in double precision; zero vectors stay zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, width or 1))
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def similar_pairs(df: DataFrame, key: str, group: str, vector: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """``a, b, similarity`` with a < b: pairs of one group whose cosine reaches the threshold.

    A group is cut into blocks by a hash, every pair of blocks is one task's matrix product, and only pairs
    at the threshold leave it. Groups are documents or classes; null groups and null vectors take no part.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(group).alias("grp"), F.col(vector).cast("array<double>").alias("v")).where(F.col("grp").isNotNull() & F.col("v").isNotNull())
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    placed = rows.join(sizes, "grp").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "own", "v")

    def compare(group_key: tuple, t: pa.Table) -> pa.Table:
        i, j = group_key[1].as_py(), group_key[2].as_py()
        keys, own, x = t.column("key").to_numpy(), t.column("own").to_numpy(), _matrix(t.column("v"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for s in range(0, len(left), 1024):
            part = left[s : s + 1024]
            sim = x[part] @ x[right].T
            a, b = np.nonzero(sim >= threshold - 1e-12)
            p, q = keys[part[a]], keys[right[b]]
            keep = (p < q) if i == j else (p != q)
            out.append((np.minimum(p, q)[keep], np.maximum(p, q)[keep], sim[a, b][keep]))
        a, b, s = (np.concatenate(c) for c in zip(*out))
        return pa.table([pa.array(a), pa.array(b), pa.array(s)], ["a", "b", "similarity"])

    return spread.groupBy("grp", "i", "j").applyInArrow(compare, "a long, b long, similarity double").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node in a pair, by star contraction.

    Alternates large and small stars; each halves long paths, so rounds grow with the logarithm of the
    diameter. Every round is checkpointed in the shared folder.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    before = None
    while True:
        # large star: larger neighbours of u are tied to the smallest of u and its neighbours
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return nodes.join(edges.select(F.col("u").alias("node"), "v"), "node", "left").groupBy("node").agg(F.coalesce(F.min("v"), F.first("node")).alias("component"))


def average_linkage(x: np.ndarray, links: list[tuple[int, int]], threshold: float) -> list[list[int]]:
    """Groups of the rows of ``x`` (unit vectors) by average similarity; the most similar two merge first, then the smallest.

    The average over all pairs of two groups is the product of their vector sums over the product of their sizes, so no
    pair needs to be given but those at the threshold (``links``): two groups whose average reaches it have one.
    """
    n = len(x)
    total, size, near = x.astype(np.float64).copy(), np.ones(n), [set() for _ in range(n)]
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    groups: list[list[int] | None] = [[i] for i in range(n)]
    age = [0] * n  # merges of a group so far: entries of the heap from before one are void
    mean = lambda i, j: float(total[i] @ total[j]) / (size[i] * size[j])
    heap = [(-mean(a, b), a, b, 0, 0) for a in range(n) for b in near[a] if a < b]
    heapq.heapify(heap)
    while heap:
        worth, i, j, at_i, at_j = heapq.heappop(heap)
        if -worth < threshold - 1e-12:
            break
        if groups[i] is None or groups[j] is None or age[i] != at_i or age[j] != at_j:
            continue
        groups[i] += groups[j]
        groups[j] = None
        total[i] += total[j]
        size[i] += size[j]
        age[i] += 1
        for c in near[j]:
            near[c].discard(j)
            if c != i:
                near[c].add(i)
                near[i].add(c)
        near[j] = set()
        for c in near[i]:
            a, b = min(i, c), max(i, c)
            heapq.heappush(heap, (-mean(a, b), a, b, age[a], age[b]))
    return [sorted(g) for g in groups if g]


def linked_groups(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``node, grp``: components split by average linkage over all their pairs, within equal signatures, whatever their size.

    ``nodes``: node, signature, v. One task links a part, in memory that grows with its rows and links, not with their square.
    """
    comp = components(pairs)
    marked = cut(comp.join(nodes, "node").select("node", "v", F.concat_ws("|", F.col("component").cast("string"), F.col("signature")).alias("part")))
    inner = pairs.join(marked.select(F.col("node").alias("a"), "part"), "a").join(marked.select(F.col("node").alias("b"), F.col("part").alias("_p")), "b").where("part = _p").select(F.col("_p").alias("_part"), "a", "b")

    def link(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("node")
        ids = left["node"].tolist()
        place = {v: i for i, v in enumerate(ids)}
        x = np.stack(left["v"].to_list()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        groups = average_linkage(x, [(place[a], place[b]) for a, b in zip(right["a"], right["b"])], threshold)
        return pd.DataFrame([(ids[i], ids[g[0]]) for g in groups for i in g], columns=["node", "grp"])

    return marked.groupBy("part").cogroup(inner.groupBy("_part")).applyInPandas(link, "node long, grp long")


def representatives(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """The longest text of each group, then the lowest id."""
    return df.groupBy(group).agg(F.max_by(F.col(key), F.struct(F.length(text), -F.col(key))).alias("representative"), F.count("*").alias("members"))


def members_hash(df: DataFrame, group: str, key: str) -> DataFrame:
    """A hash of each group's sorted member ids."""
    return df.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), ","), 256).alias("members_sha256"))


def _best(ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query its k nearest other rows, some queries at a time."""
    for s in range(0, len(ids), 512):
        ask = slice(s, s + 512)
        sim = np.round(q[ask] @ x.T, 9)
        sim[ids[ask][:, None] == own[None, :]] = -9
        if 8 * k < sim.shape[1]:  # only rows that may be among the k are sorted; ties with the last of them stay in
            least = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
            rows, columns = np.nonzero(sim >= least)
            order = np.lexsort((own[columns], -sim[rows, columns], rows))
            rows, columns = rows[order], columns[order]
            first = np.searchsorted(rows, rows)
            keep = np.arange(len(rows)) - first < k
            rows, columns = rows[keep], columns[keep]
        else:
            order = np.lexsort((np.broadcast_to(own, sim.shape), -sim), axis=1)[:, :k]
            rows, columns = np.repeat(np.arange(len(sim)), order.shape[1]), order.ravel()
        best = sim[rows, columns]
        keep = best > -9
        yield ids[ask][rows][keep], own[columns][keep], best[keep]


def nearest(rows: DataFrame, queries: DataFrame, key: str, group: str, vector: str, k: int, query_block: int = QUERY_BLOCK, block: int = 2 * BLOCK) -> DataFrame:
    """``query, neighbour, similarity, rank``: the k nearest rows of the same group for each query, exactly.

    Whichever side is small (its size is counted) travels to every task, which keeps k a query; if neither is,
    queries and rows of a group meet in blocks. Ties by the smaller id; null vectors take no part.
    """
    pick = lambda d: d.select(F.col(key).cast("long").alias("key"), F.col(group).cast("string").alias("grp"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    data, asked = pick(rows), pick(queries)
    schema = "query long, neighbour long, similarity double"
    few_queries = asked.count() <= query_block
    if few_queries or data.count() <= query_block:
        small, large = (asked, data) if few_queries else (data, asked)
        sent = small.toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((sent.column("key").to_numpy(), np.array(sent.column("grp").to_pylist(), object), _matrix(sent.column("v"))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, groups, x = shared.value
            for batch in batches:
                keys, kind, y = batch.column("key").to_numpy(), np.array(batch.column("grp").to_pylist(), object), _matrix(batch.column("v"))
                for g in sorted(set(x for x in kind.tolist() if x is not None) & set(groups.tolist())):
                    here, there = np.flatnonzero(groups == g), np.flatnonzero(kind == g)
                    sides = (ids[here], x[here], keys[there], y[there]) if few_queries else (keys[there], y[there], ids[here], x[here])
                    for found in _best(*sides, k):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query", "neighbour", "similarity"])

        out = large.mapInArrow(scan, schema)
    else:
        sizes = lambda d, name: d.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int").alias(name))
        counts = sizes(data, "_rb").join(sizes(asked, "_qb"), "grp")
        own = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = data.join(counts, "grp").select("grp", own("_rb").alias("i"), every("_qb").alias("j"), F.lit(False).alias("asks"), "key", "v")
        right = asked.join(counts, "grp").select("grp", every("_rb").alias("i"), own("_qb").alias("j"), F.lit(True).alias("asks"), "key", "v")

        def meet(t: pa.Table) -> pa.Table:
            keys, x, asks = t.column("key").to_numpy(), _matrix(t.column("v")), t.column("asks").to_numpy()
            found = list(_best(keys[asks], x[asks], keys[~asks], x[~asks], k)) if asks.any() and not asks.all() else []
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.table([pa.array(c) for c in columns], ["query", "neighbour", "similarity"])

        out = left.unionByName(right).groupBy("grp", "i", "j").applyInArrow(lambda t: meet(t), schema)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")))
    return ranked.where(F.col("rank") <= k)


def variability(members: DataFrame, group: str, vector: str) -> DataFrame:
    """``grp, n, spread, radius``: mean and largest cosine distance of members to their normalised mean."""
    from loomspan.functions import vectors

    centre = vectors.mean_vectors(members, group, vector).select(F.col(group), "n", "mean")
    return members.join(centre, group).groupBy(group).agg(F.max("n").alias("n"), F.avg(vectors.distance("cosine", F.col(vector), F.col("mean"))).alias("spread"), F.max(vectors.distance("cosine", F.col(vector), F.col("mean"))).alias("radius"))


def grow(vectors_: np.ndarray, signatures: list[str], dense: list[int], weights: np.ndarray, threshold: float, rounds: int = 4) -> list[list[int]]:
    """Groups grown from dense seeds: a walk over the nearest to the centroid stops at the first refusal.

    Densest seeds first (then place). A walk goes over all free facts of the seed's signature, nearest first to
    the centroid it starts from. After each walk members below the threshold leave and the walk starts again, at
    most ``rounds`` times. A fact counts in the centroid with its weight, the number of its copies.
    """
    n = len(vectors_)
    taken = np.zeros(n, bool)
    unit = lambda t: t / (np.linalg.norm(t) or 1.0)
    free: dict[str, np.ndarray] = {}
    for sig in set(signatures):
        free[sig] = np.array([i for i in range(n) if signatures[i] == sig], np.int64)
    groups = []
    for s in sorted(range(n), key=lambda i: (-dense[i], i)):
        if taken[s]:
            continue
        rest = free[signatures[s]]
        rest = free[signatures[s]] = rest[~taken[rest]]
        x = vectors_[rest]
        members, centre = [s], vectors_[s]
        for _ in range(rounds):
            start = list(members)
            total = (vectors_[members] * weights[members, None]).sum(0)
            near = x @ centre
            near[np.searchsorted(rest, members)] = -9
            if near.max() >= threshold:
                for j in rest[np.lexsort((rest, -near))[: int((near > -9).sum())]]:
                    if float(vectors_[j] @ centre) < threshold:
                        break
                    members.append(int(j))
                    total = total + weights[j] * vectors_[j]
                    centre = unit(total)
            members = [j for j in members if j == s or float(vectors_[j] @ centre) >= threshold]
            centre = unit((vectors_[members] * weights[members, None]).sum(0))
            if members == start:
                break
        taken[members] = True
        groups.append(sorted(members))
    return groups


def regroup(df: DataFrame, key: str, group: str, vector: str, signature: str, threshold: float = 0.9, seed: float = 0.95) -> DataFrame:
    """``node, grp``: all facts regrouped. Growth runs within components of the neighbour graph at the threshold.

    A member must reach the threshold to the centroid of members that reach it, so growth never leaves a
    component of pairs somewhat below it; components, unlike classes, stay small. Equal vectors of one class and
    signature are one fact that weighs as many, and come out in one group. Seeds are the facts with most others
    (copies too) at ``seed``.
    """
    floor = 2 * threshold - 1 if threshold > 0.5 else 0.0
    rows = df.select(F.col(key).cast("long").alias("node"), F.col(group).alias("cls"), F.col(vector).cast("array<double>").alias("v"), F.col(signature).cast("string").alias("sig"))
    size = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    usable = F.col("cls").isNotNull() & F.coalesce((size > 0) & (size < float("inf")), F.lit(False))
    copies = cut(rows.where(usable).groupBy("cls", "sig", F.xxhash64("v").alias("_h"), "v").agg(F.min("node").alias("node"), F.count("*").alias("weight")))
    pairs = cut(similar_pairs(copies, "node", "cls", "v", max(floor, 0.0)))
    comp = components(pairs)
    close = pairs.where(F.col("similarity") >= max(seed, threshold))
    both = close.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(close.select(F.col("b").alias("node"), F.col("a").alias("other")))
    density = both.join(copies.select(F.col("node").alias("other"), "weight"), "other").groupBy("node").agg(F.sum("weight").alias("around"))
    inside = copies.select("node", "v", "sig", "weight").join(comp, "node").join(density, "node", "left").withColumn("dense", F.coalesce("around", F.lit(0)) + F.col("weight") - 1)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("node")
        ids = t["node"].tolist()
        x = np.stack(t["v"].to_list()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        groups = grow(x, t["sig"].tolist(), t["dense"].tolist(), t["weight"].to_numpy(float), threshold)
        return pd.DataFrame([(ids[i], ids[g[0]]) for g in groups for i in g], columns=["node", "grp"])

    grown = inside.select("component", "node", "v", "sig", "weight", "dense").groupBy("component").applyInPandas(run, "node long, grp long")
    stands = copies.select("cls", "sig", "v", F.col("node").alias("first")).join(grown.withColumnRenamed("node", "first"), "first", "left").withColumn("grp", F.coalesce("grp", "first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("cls", "sig", "v")]
    placed = rows.where(usable).alias("r").join(stands.alias("s"), same).select("r.node", "s.grp")
    return placed.unionByName(rows.where(~usable).select("node", F.col("node").alias("grp")))


def place(new: DataFrame, centres: DataFrame, threshold: float = 0.9, candidates: int = 5) -> DataFrame:
    """Incremental placement: ``node, grp`` of new facts, the nearest group of the same class and signature that reaches the threshold, else null.

    ``new``: node, cls, sig, v; ``centres``: node (the group), cls, sig, v.
    """
    found = nearest(centres, new, "node", "cls", "v", candidates)
    signed = found.join(new.select(F.col("node").alias("query"), F.col("sig").alias("_a")), "query").join(centres.select(F.col("node").alias("neighbour"), F.col("sig").alias("_b")), "neighbour")
    best = signed.where(F.col("_a").eqNullSafe(F.col("_b")) & (F.col("similarity") >= threshold)).groupBy("query").agg(F.min_by("neighbour", "rank").alias("grp"))
    return new.select("node").join(best.withColumnRenamed("query", "node"), "node", "left")


def join_anchors(facts: DataFrame, anchors: DataFrame, threshold: float = 0.9, candidates: int = 5) -> DataFrame:
    """``node, grp, similarity``: facts that belong to a fixed anchor of their class; of the nearest ``candidates`` the first with the same signature that reaches the threshold. Columns as ``place``."""
    found = nearest(anchors, facts, "node", "cls", "v", candidates)
    signed = found.join(facts.select(F.col("node").alias("query"), F.col("sig").alias("_a")), "query").join(anchors.select(F.col("node").alias("neighbour"), F.col("sig").alias("_b")), "neighbour")
    good = signed.where(F.col("_a").eqNullSafe(F.col("_b")) & (F.col("similarity") >= threshold))
    return good.groupBy(F.col("query").alias("node")).agg(F.min_by("neighbour", "rank").alias("grp"), F.min_by("similarity", "rank").alias("similarity"))


def finish(facts: DataFrame, groups: DataFrame, restated: DataFrame) -> DataFrame:
    """``node, claim, via``: the claim of every fact once groups are known.

    ``groups``: node, grp; ``restated``: node, stands_for. A restatement takes the claim of the fact it
    stands for, a grouped fact its group, any other is a claim of its own.
    """
    own = facts.select("node").join(groups.select("node", "grp"), "node", "left").join(restated.select("node", "stands_for"), "node", "left")
    of = groups.select(F.col("node").alias("stands_for"), F.col("grp").alias("_claim"))
    linked = own.join(of, "stands_for", "left")
    via = F.when(F.col("stands_for").isNotNull(), "restatement").when(F.col("grp").isNotNull(), "group").otherwise("single")
    return linked.select("node", F.coalesce(F.when(F.col("stands_for").isNotNull(), F.coalesce("_claim", "stands_for")), "grp", "node").alias("claim"), via.alias("via"))


def totals(finished: DataFrame) -> DataFrame:
    """One row: ``facts, claims, clusters`` (claims with more than one fact), ``clustered`` facts and ``singles``."""
    per = finished.groupBy("claim").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("facts"), F.count("*").alias("claims"), F.count_if(F.col("n") > 1).alias("clusters"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("clustered"), F.count_if(F.col("n") == 1).alias("singles"))


def confirmation(answer: str) -> tuple[bool, str] | None:
    """What a model said about a loose group: (yes, sentence) or (no, ""), null if it said neither first."""
    words = answer.strip().split(None, 1)
    head = words[0].strip(".,:;!*-").upper() if words else ""
    if head == "NO":
        return False, ""
    if head != "YES":
        return None
    lines = [x.strip() for x in (words[1] if len(words) > 1 else "").splitlines() if x.strip()]
    return True, lines[0] if lines else ""


def confirm(groups: DataFrame, texts: DataFrame, ask, loose: DataFrame) -> DataFrame:
    """Groups after a model has seen the loose ones: rejected groups fall apart, a failed call keeps its group.

    ``ask`` takes the texts of a group and gives an answer; it runs where the data is, one call a loose
    group. ``groups``: node, grp; ``texts``: node, text; ``loose``: grp.
    """
    asked = groups.join(loose.select("grp").distinct(), "grp", "left_semi").join(texts.select("node", "text"), "node")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("node")
        try:
            said = confirmation(ask(t["text"].tolist()))
        except Exception:
            return t[["node", "grp"]]
        return t[["node", "grp"]] if said and said[0] else t.assign(grp=t["node"])[["node", "grp"]]

    return groups.join(loose.select("grp").distinct(), "grp", "left_anti").select("node", "grp").unionByName(asked.groupBy("grp").applyInPandas(run, "node long, grp long"))


def must_regroup(stored: dict | None, wanted: dict) -> bool:
    """Whether groups must be built anew: never built, or by other parameters."""
    return stored is None or {k: stored.get(k) for k in wanted} != wanted
