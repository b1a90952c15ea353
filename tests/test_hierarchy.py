import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import hierarchy

SCHEMA = "id long, up long, root string"


def walk(links):
    """Brute force: {node: (root, depth)} with -1 for circles."""
    up = {}
    for node, parent in links:
        if node is not None:
            old = up.get(node)
            up[node] = parent if old is None else old if parent is None else min(old, parent)
    out = {}
    for node in up:
        seen, at = [node], node
        while up[at] is not None and up[at] in up:
            at = up[at]
            if at in seen:
                out[node] = (min(seen[seen.index(at):]), -1)
                break
            seen.append(at)
        else:
            out[node] = (at, len(seen) - 1)
    return out


def random_links(n, seed):
    rnd = random.Random(seed)
    links = [(i, rnd.choice([None, rnd.randrange(n), max(0, i - 1), i - 1 if i else None, n + 5])) for i in range(n)]
    return links + [(3, 1), (None, 4), (n + 9, n + 9), (7, None), (-5, -6), (-6, -5), (-7, -5), (-8, 0), (-9, -8)]


@pytest.mark.parametrize("options", [{}, {"parts": 6, "top_rows": 25, "fan_in": 2}, {"parts": 8, "top_rows": 40, "fan_in": 2}])
def test_resolve_matches_walk(spark, options):
    for seed in (1, 2):
        links = random_links(300, seed)
        df = spark.createDataFrame([(*x, "clash") for x in links], SCHEMA)
        got = {r.node: (r.root, r.depth) for r in hierarchy.resolve(df, "id", "up", **options).collect()}
        assert got == walk(links)


def test_scattered_chain_uses_doubling(spark):
    ids = list(range(500))
    random.Random(4).shuffle(ids)
    links = [(a, b) for a, b in zip(ids[1:], ids)] + [(ids[0], None), (900, 901), (901, 900)]
    df = spark.createDataFrame([(*x, "") for x in links], SCHEMA)
    got = {r.node: (r.root, r.depth) for r in hierarchy.resolve(df, "id", "up", parts=16, top_rows=20, fan_in=1).collect()}
    assert got == walk(links)


def test_paths_and_descendants(spark):
    links = random_links(120, 7)
    df = spark.createDataFrame([(*x, "") for x in links], SCHEMA)
    walked = hierarchy.paths(df, "id", "up", parts=3)
    rows = walked.collect()
    expected = walk(links)
    for r in rows:
        root, depth = expected[r.node]
        if depth < 0:
            assert r.path is None
        else:
            assert r.path[0] == root and r.path[-1] == r.node and len(r.path) == depth + 1
    closure = {(r.ancestor, r.descendant, r.distance) for r in hierarchy.descendants(walked).collect()}
    assert closure == {(a, r.node, r.depth - i) for r in rows if r.path for i, a in enumerate(r.path[:-1])}
    counts = {r.node: r.n_descendants for r in hierarchy.descendant_counts(walked).collect()}
    assert all(counts[n] == sum(a == n for a, _, _ in closure) for n in expected)


def test_no_task_links_more_than_its_share(spark, monkeypatch):
    """Scattered parents do not shrink in the merge, and still no range holds more than about top_rows rows."""
    ids = list(range(600))
    random.Random(4).shuffle(ids)
    links = [(a, b) for a, b in zip(ids[1:], ids)] + [(ids[0], None)] + [(5, 700)] * 300
    df = spark.createDataFrame([(*x, "") for x in links], SCHEMA)
    seen = []
    kept = hierarchy.cut

    def cut_and_look(x):
        done = kept(x)
        if "step" in done.columns:
            seen.extend(r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect())
        return done

    monkeypatch.setattr(hierarchy, "cut", cut_and_look)
    got = {r.node: (r.root, r.depth) for r in hierarchy.resolve(df, "id", "up", parts=8, top_rows=30).collect()}
    assert got == walk(links)
    assert max(seen) <= 60


def test_scattered_paths_and_sums(spark):
    ids = list(range(300))
    random.Random(9).shuffle(ids)
    links = [(a, b) for a, b in zip(ids[1:], ids)] + [(ids[0], None)]
    df = spark.createDataFrame([(*x, "") for x in links], SCHEMA)
    options = {"parts": 8, "top_rows": 40}
    got = {r.node: r.path for r in hierarchy.paths(df, "id", "up", **options).collect()}
    assert got == {n: ids[: i + 1] for i, n in enumerate(ids)}
    sums = {r.node: (r.enter, r.leave) for r in hierarchy.intervals(df, "id", "up", **options).collect()}
    assert sums == {n: (i, 300) for i, n in enumerate(ids)}


def test_empty(spark):
    assert hierarchy.resolve(spark.createDataFrame([], SCHEMA), "id", "up").count() == 0
    assert hierarchy.paths(spark.createDataFrame([], SCHEMA), "id", "up").count() == 0


@pytest.mark.parametrize("options", [{}, {"parts": 6, "top_rows": 25, "fan_in": 2}, {"parts": 8, "top_rows": 40, "fan_in": 2}])
def test_intervals_name_all_descendants(spark, options):
    links = random_links(250, 11)
    ids = list(range(1000, 1200))
    random.Random(4).shuffle(ids)
    links += list(zip(ids[1:], ids)) + [(ids[0], None)] + [(2000 + i, 2000) for i in range(1, 60)] + [(2000, None)]
    df = spark.createDataFrame([(*x, "") for x in links], SCHEMA)
    rows = {r.node: r for r in hierarchy.intervals(df, "id", "up", **options).collect()}
    expected = walk(links)
    up = {}
    for node, parent in links:
        if node is not None:
            old = up.get(node)
            up[node] = parent if old is None else old if parent is None else min(old, parent)
    below = {n: set() for n in expected}
    for n, (_, depth) in expected.items():
        at = n
        for _ in range(depth):
            at = up[at]
            below[at].add(n)
    assert set(rows) == set(expected)
    for n, (root, depth) in expected.items():
        r = rows[n]
        assert (r.root, r.depth) == (root, depth)
        if depth < 0:
            assert r.enter is None and r.leave is None
        else:
            assert below[n] == {m for m, x in rows.items() if x.root == root and x.enter is not None and r.enter < x.enter < r.leave}
            assert r.leave - r.enter - 1 == len(below[n])


def test_paths_of_both_tables_are_put_out(spark, tmp_path):
    from loomspan.plans.hierarchy import FORESTS, QUERIES

    links = [(1, None), (2, 1), (3, 2), (4, 9), (5, 6), (6, 5), (7, 6)]
    for name, parent in FORESTS:
        spark.createDataFrame(links, f"id long, {parent} long").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r.tbl, r.node_id): (r.root_id, r.depth, r.path) for r in QUERIES["p4_paths"](spark, str(tmp_path)).collect()}
    one = {1: (1, 0, [1]), 2: (1, 1, [1, 2]), 3: (1, 2, [1, 2, 3]), 4: (4, 0, [4]), 5: (5, -1, None), 6: (5, -1, None), 7: (5, -1, None)}
    assert got == {(name, node): x for name, _ in FORESTS for node, x in one.items()}
