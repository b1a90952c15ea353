import os

import numpy as np
import pytest

from loomspan.llm import neighbours as nn, queries_vectors

TABLES = "/root/testdata/sf0.01"

SCHEMA = "chunk_id long, embedding array<float>, similarity string"


def vectors(n, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, 64))
    x = centres[rnd.integers(0, 12, n)] * 0.7 + rnd.normal(size=(n, 64))
    x[: n // 5] = x[n // 5 : 2 * (n // 5)] + rnd.normal(size=(n // 5, 64)) * 0.15
    return x.astype(np.float32)


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in row], "clash") for i, row in enumerate(x)] + list(extra), SCHEMA).repartition(4)


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s, np.argsort(-s, axis=1)[:, :k]


@pytest.mark.parametrize("options", [{}, {"block_rows": 50, "query_rows": 80}])
def test_close_pairs_are_found(spark, options):
    x = vectors(1500)
    bad = [(9001, None, ""), (9002, [0.0] * 64, ""), (9003, [float("nan")] * 64, ""), (9004, [1.0] * 32, ""), (9005, [], ""), (9006, [float("inf")] + [1.0] * 63, ""), (None, [1.0] * 64, "")]
    s, _ = exact(x, 10)
    want = {(i, j) for i, j in zip(*np.nonzero(s >= 0.9))}
    rows = nn.neighbours(frame(spark, x * 3, bad), "chunk_id", "embedding", min_similarity=0.9, **options).collect()
    got = {(r.id, r.neighbour) for r in rows}
    assert len(rows) == len(got) and got <= want and len(got) >= 0.98 * len(want)
    assert all(abs(r.similarity - s[r.id, r.neighbour]) < 1e-5 for r in rows)


def test_recall_of_ten_nearest(spark):
    x = vectors(2000, 3)
    _, best = exact(x, 10)
    df = frame(spark, x)
    hit = lambda rows, ids: np.mean([(r.neighbour in best[r.id]) for r in rows]) * len(rows) / (10 * len(ids))
    every = nn.neighbours(df, "chunk_id", "embedding", probes=12).collect()
    assert hit(every, range(2000)) >= 0.9
    asked = [i for i in range(2000) if i % 100 == 0]
    rows = nn.search(df, df.where("chunk_id % 100 = 0"), "chunk_id", "embedding").collect()
    assert len(rows) == 10 * len(asked) and hit(rows, asked) >= 0.9


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
def test_recall_of_the_registered_query(spark):
    rows = spark.read.parquet(f"{TABLES}/emb_quill.parquet").select("chunk_id", "embedding").toArrow()
    at, x = nn.unit_rows(rows.column("embedding"), 64)
    ids = rows.column("chunk_id").to_numpy()[at]
    s, _ = exact(x, 10)
    tenth = dict(zip(ids.tolist(), np.sort(s, axis=1)[:, -10]))
    found = queries_vectors.QUERIES["p5_nearest"](spark, TABLES).collect()
    assert len(found) == len({(r.chunk_id, r.neighbour) for r in found}) <= 10 * len(ids)
    assert sum(r.similarity >= tenth[r.chunk_id] - 1e-5 for r in found) >= 0.9 * 10 * len(ids)
    assert [nn.default_probes(c) for c in (9, 98, 313, 2048)] == [4, 4, 8, 19]  # grows with the cells


def test_copies_ties_and_repeats(spark):
    x = vectors(60, 5)
    x[10:40] = x[10]
    rows = nn.neighbours(frame(spark, x, [(50, [float(v) for v in x[50]], "again")]), "chunk_id", "embedding", min_similarity=0.9).collect()
    twins = {}
    for r in rows:
        twins.setdefault(r.id, []).append(r.neighbour)
    for i in range(10, 40):
        assert sorted(twins[i]) == [j for j in range(10, 40) if j != i][:10]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nn.neighbours(df, "chunk_id", "embedding").count() == 0 and nn.search(df, df, "chunk_id", "embedding").count() == 0
    lone = spark.createDataFrame([(1, None, "")], SCHEMA)
    assert nn.neighbours(lone, "chunk_id", "embedding").count() == 0
