import random

import numpy as np
import pytest

from loomspan.functions import vectors
from loomspan.operators import cluster, graph
from pyspark.sql import functions as F


def golden(spark):
    """Eight facts with the outcome worked out by hand."""
    rows = [
        (1, "A", "Acme Corp was founded in 1998 by Jane Doe.", {0: 1}), (2, "A", "Acme was founded in 1998.", {0: 1, 1: 0.1}), (3, "A", "The company has 42 employees.", {2: 1}),
        (4, "B", "Acme Corporation was founded in 1998.", {0: 1, 1: 0.08, 3: 0.05}), (5, "B", "The company has 45 employees.", {2: 1, 3: 0.1}), (7, "C", "Lunch is at noon.", {5: 1}),
    ]
    data = [(i, d, "fact", t, [float(v.get(k, 0)) for k in range(8)], "".join(c for c in t if c.isdigit())) for i, d, t, v in rows]
    return spark.createDataFrame(data, "id long, doc string, cls string, text string, v array<double>, sig string")


def test_restatements_and_groups(spark):
    facts = golden(spark)
    pairs = cluster.similar_pairs(facts, "id", "doc", "v", 0.92).collect()
    assert [(p.a, p.b) for p in pairs] == [(1, 2)]
    groups = {}
    for r in cluster.regroup(facts, "id", "cls", "v", "sig").collect():
        groups.setdefault(r.grp, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 4], [3], [5], [7]]  # 42 and 45 stay apart
    linked = cluster.linked_groups(cluster.similar_pairs(facts, "id", "cls", "v", 0.9), facts.select(F.col("id").alias("node"), F.col("sig").alias("signature"), "v"), 0.9).collect()
    assert {(r.node, r.grp) for r in linked} == {(1, 1), (2, 1), (4, 1), (3, 3), (5, 5)}
    best = {r.doc: r.representative for r in cluster.representatives(facts, "doc", "id", "text").collect()}
    assert best == {"A": 1, "B": 4, "C": 7}


def test_regroup_takes_whole_groups(spark):
    """100 copies, 60 facts near one point, a lone pair of copies, null and zero vectors: no group is cut at ten."""
    rnd = np.random.default_rng(8)
    rows = [(i, "fact", [1.0] + [0.0] * 15, "x") for i in range(100)]
    rows += [(100 + i, "fact", [0.0, 1.0, *(rnd.normal(size=14) * 0.02).tolist()], "x") for i in range(60)]
    rows += [(200, "fact", [0.0] * 15 + [1.0], None), (201, "fact", [0.0] * 15 + [1.0], None), (202, "fact", [0.0] * 15 + [1.0], "y")]
    rows += [(300, "fact", None, "x"), (301, "fact", [0.0] * 16, "x"), (302, "fact", [0.0] * 16, "x"), (303, None, [1.0] + [0.0] * 15, "x")]
    facts = spark.createDataFrame(rows, "id long, cls string, v array<double>, sig string")
    groups = {}
    for r in cluster.regroup(facts, "id", "cls", "v", "sig").collect():
        groups.setdefault(r.grp, []).append(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(100)), list(range(100, 160)), [200, 201], [202], [300], [301], [302], [303]]


def test_placing(spark):
    facts = golden(spark)
    centres = spark.createDataFrame([(10, "fact", "1998", [1.0] + [0.0] * 7), (11, "fact", "42", [0.0, 0.0, 1.0] + [0.0] * 5)], "node long, cls string, sig string, v array<double>")
    new = facts.select(F.col("id").alias("node"), "cls", "sig", "v")
    assert {r.node: r.grp for r in cluster.place(new, centres).collect()} == {1: 10, 2: 10, 4: 10, 3: 11, 5: None, 7: None}


@pytest.mark.parametrize("block", [2000, 7])
def test_pairs_match_brute_force(spark, block):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(80, 6))
    df = spark.createDataFrame([(i, i % 3 if i else None, [float(v) for v in row]) for i, row in enumerate(x)], "id long, g long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a in range(1, 80) for b in range(a + 1, 80) if a % 3 == b % 3 and u[a] @ u[b] >= 0.6}
    assert {(r.a, r.b) for r in cluster.similar_pairs(df, "id", "g", "v", 0.6, block).collect()} == want
    known = df.where("g is not null")
    for asked, limit in ((known, 100), (known, 30), (known.where("id < 40"), 45), (known, 79)):  # queries travel, blocks meet, rows travel
        near = cluster.nearest(known if limit != 45 else known, asked, "id", "g", "v", 3, query_block=limit, block=20).collect()
        for a in {r.id for r in asked.collect()}:
            best = sorted((round(-(u[a] @ u[b]), 9), b) for b in range(1, 80) if b != a and a % 3 == b % 3)[:3]
            assert [r.neighbour for r in sorted(near, key=lambda r: r.rank) if r.query == a] == [b for _, b in best]
    fewer = cluster.nearest(known.where("id < 20"), known, "id", "g", "v", 3, query_block=30).collect()
    assert {r.query for r in fewer} == set(range(1, 80)) and all(r.neighbour < 20 for r in fewer)


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1400)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    import sys

    sys.setrecursionlimit(5000)
    want = {x: find(x) for a, b in links for x in (a, b) if a != b}
    got = {r.node: r.component for r in cluster.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert cluster.components(spark.createDataFrame([], "a long, b long")).count() == 0


def naive_linkage(x, threshold):
    """All averages over all pairs of groups, each time."""
    groups, table = [[i] for i in range(len(x))], x @ x.T
    while len(groups) > 1:
        scores = {(i, j): table[np.ix_(groups[i], groups[j])].mean() for i in range(len(groups)) for j in range(i + 1, len(groups))}
        (i, j), best = max(scores.items(), key=lambda y: (y[1], (-y[0][0], -y[0][1])))
        if best < threshold:
            break
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


def test_average_linkage_matches_brute_force_over_all_pairs():
    for seed in range(12):
        rnd = np.random.default_rng(seed)
        n = 26
        x = rnd.normal(size=(5, 8))[rnd.integers(0, 5, n)] + rnd.normal(size=(n, 8)) * 0.8
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        least = (0.3, 0.5, 0.1)[seed % 3]
        links = [(a, b) for a in range(n) for b in range(a + 1, n) if x[a] @ x[b] >= least]  # pairs below it count in the averages and are not given
        assert cluster.average_linkage(x, links, least) == naive_linkage(x, least)
    assert cluster.average_linkage(np.ones((4, 1)), [(0, 1), (1, 2), (2, 3), (0, 2)], 0.9) == [[0, 1, 2, 3]]


def test_large_parts_are_linked(spark):
    """A component of 400 facts, two dense halves held together by one pair, is two groups."""
    vectors_ = [[1.0, 0.0] if i < 200 else [0.0, 1.0] for i in range(400)]
    vectors_[5], vectors_[205] = [1.0, 0.5], [0.5, 1.0]
    nodes = spark.createDataFrame([(i, "s", v) for i, v in enumerate(vectors_)], "node long, signature string, v array<double>")
    pairs = cluster.similar_pairs(nodes, "node", "signature", "v", 0.5)
    got = {r.node: r.grp for r in cluster.linked_groups(pairs, nodes, 0.6).collect()}
    assert got == {i: i // 200 * 200 for i in range(400)}


def test_neighbourhood(spark):
    v = spark.createDataFrame([(f"A:{i}", "A" if i != 3 else "B") for i in range(8)], "gid string, label string")
    e = spark.createDataFrame([("x", f"A:{i}", f"A:{i + 1}") for i in range(7)], "label string, src string, dst string")
    seeds = v.where("gid = 'A:1'")
    assert {r.gid: r.hops for r in graph.neighbourhood(v, e, seeds, 3).collect()} == {"A:1": 0, "A:0": 1, "A:2": 1, "A:3": 2, "A:4": 3}
    assert {r.gid for r in graph.neighbourhood(v, e, seeds, 5, ["A"]).collect()} == {"A:0", "A:1", "A:2"}
    assert graph.neighbourhood(v, e, seeds, 3, limit=3).count() == 3
    with pytest.raises(ValueError):
        graph.neighbourhood(v, e, seeds, 7)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.l2(F.col("a"), F.col("b")).alias("l"), vectors.truncated(F.col("a"), 1).alias("t"), vectors.usable(F.col("a"), 2).alias("u")).collect()
    assert [round(r.c, 6) for r in rows] == [0.96, 0.0] and [r.u for r in rows] == [True, False] and list(rows[0].t) == [1.0]
    assert vectors.plan_storage(1024, False)[1:] == ("vector", "whole") and vectors.plan_storage(4096, True)[0] == 4000 and vectors.plan_storage(4096, False)[2] == "binary"
    with pytest.raises(ValueError):
        vectors.distance("other", F.col("a"), F.col("b"))


def test_confirmation(spark):
    assert cluster.confirmation("YES\nAcme was founded in 1998.") == (True, "Acme was founded in 1998.")
    assert cluster.confirmation("No, they differ") == (False, "") and cluster.confirmation("maybe") is None and cluster.confirmation("") is None
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)], "node long, grp long")
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["", "a", "b", "no", "d", "fail", "f"])], "node long, text string")

    def ask(found):
        if "fail" in found:
            raise RuntimeError("model down")
        return "NO" if "no" in found else "YES fine"

    got = {r.node: r.grp for r in cluster.confirm(groups, texts, ask, groups.select("grp")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
    assert cluster.must_regroup(None, {"t": 1}) and not cluster.must_regroup({"t": 1, "x": 2}, {"t": 1}) and cluster.must_regroup({"t": 2}, {"t": 1})


def test_finish(spark):
    facts = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    groups = spark.createDataFrame([(1, 1), (3, 1)], "node long, grp long")
    restated = spark.createDataFrame([(2, 1), (5, 4)], "node long, stands_for long")
    done = cluster.finish(facts, groups, restated)
    assert {r.node: (r.claim, r.via) for r in done.collect()} == {1: (1, "group"), 2: (1, "restatement"), 3: (1, "group"), 4: (4, "single"), 5: (4, "restatement"), 6: (6, "single")}
    assert tuple(cluster.totals(done).first()) == (6, 3, 2, 5, 1)
