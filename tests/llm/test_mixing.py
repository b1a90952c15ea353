import random

import numpy as np
import pytest

from loomspan.llm import mixing


def test_pivot_keeps_mass_and_expectation():
    rnd = np.random.default_rng(1)
    mass, prob = rnd.integers(1, 50, 30).astype(float), rnd.random(30)
    total, runs = np.zeros(30), 3000
    for _ in range(runs):
        out, left = mixing._pivot(np.arange(30), mass, prob, rnd.random(30))
        assert abs((out * mass).sum() - (prob * mass).sum()) < 1e-6
        assert sum(0 < p < 1 for p in out) <= 1 and (left < 0 or 0 < out[left] < 1)
        total += out
    assert np.abs(total / runs - prob).max() < 0.06


def test_mix_reaches_targets(spark):
    rnd = random.Random(3)
    docs = [(i, " ".join(["tide"] * rnd.randrange(1, 60)), rnd.choice(["Big_One", " big-one ", "mid", "mid", "small", "other", None, " "] if i % 11 else ["small"])) for i in range(900)]
    docs += [(1000, None, "mid"), (1001, "", "mid"), docs[0], docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    targets = spark.createDataFrame([("big-one", 0.2, 2), ("mid", 0.3, 3), ("small", 0.5, 1), ("gone", 0.1, 5), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    copies, report = mixing.mix(df, targets)
    rows, report = copies.collect(), {r.source: r for r in report.collect()}
    assert len(rows) == sum(mixing_key(d[2]) in ("big-one", "mid", "small") for d in docs)
    count = lambda t: len(mixing._encoder(None).encode_ordinary(t or ""))
    total = sum(count(d[1]) for d in docs if mixing_key(d[2]))
    for source, r in report.items():
        tokens = sum(count(d[1]) for d in docs if mixing_key(d[2]) == source)
        assert (r.tokens, r.corpus_tokens) == (tokens, total)
        assert r.reachable == (tokens * r.max_repeats >= r.target_share * total)
        mine = [x for x in rows if x.source == source]
        assert all(int(r.quota) <= x.copies <= min(r.max_repeats, int(r.quota) + 1) for x in mine)
        largest = max([x.tokens for x in mine], default=0)
        assert abs(sum(x.tokens * x.copies for x in mine) - r.quota * tokens) <= largest
        assert r.mixed_tokens == sum(x.tokens * x.copies for x in mine)
        assert r.short == (not r.reachable)
    assert not report["small"].reachable and not report["gone"].reachable and report["zero"].reachable
    again = mixing.mix(df.repartition(3), targets)[0].collect()  # another layout of the files
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_tree_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    monkeypatch.setattr(mixing, "BUCKET_SOURCES", 1)
    docs = [(i, "tide " * (1 + i % 9), "ab"[i % 3 == 0]) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.45, 2), ("b", 0.55, 2)], "source string, target_share double, max_repeats int")
    copies, report = mixing.mix(df, targets)
    assert copies.count() == 300
    for r in report.collect():
        assert abs(r.mixed_tokens - r.target_share * r.corpus_tokens) <= 10


def mixing_key(source):
    return (source or "").strip().lower().replace("_", "-") or None


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    copies, report = mixing.mix(df, targets)
    assert copies.count() == 0 and [(r.source, r.reachable, r.mixed_share) for r in report.collect()] == [("a", True, None)]
