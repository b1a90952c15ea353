import random

from pyspark.sql import functions as F

from loomspan.llm import leakage, queries_text
from loomspan.llm.words import words


def brute(docs, items, n=10):
    grams = lambda t: {tuple(w[i:i + n]) for w in [words(t or "")] for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}


def data(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_exact_leaks_match_brute_force(spark):
    rnd = random.Random(2)
    vocab = ["Alpha", "beta", "Gämma", "délta", "7", "kg", "Straße", "ｗｉｄｅ", "in", "the", "Mill"] + [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocab, k=25))) for i in range(12)] + [(50, None), (51, "short")]
    docs = []
    for d in range(60):
        parts = rnd.choices(vocab, k=30)
        source = items[rnd.randrange(12)][1].split(" ")
        cut = rnd.randrange(8, 13)
        at = rnd.randrange(len(source) - cut)
        docs.append((d, " ".join(parts) + ",\n" + "; ".join(source[at:at + cut]).upper() + " " + " ".join(parts)))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (102, docs[0][1])]
    d, i = data(spark, docs, items)
    for bound in (leakage.BROADCAST_WINDOWS, 1):  # broadcast, and by a shuffle
        found = leakage.leaks(d, i, broadcast_windows=bound) if bound > 1 else leakage.leaks(d, i, broadcast_windows=bound)
        rows = found.where("kind = 'exact'").collect()
        assert sorted((r.doc_id, r.item_id) for r in rows) == sorted(brute(docs, items))


def test_reparameterised(spark):
    item = "If Anna buys 12 apples and Bert buys 7 apples how many apples are there when Anna gives 3 away today"
    same = item.replace("Anna", "Clara").replace("12", "40").replace("Bert", "Dora")
    broken = item.replace("gives", "keeps").replace("Anna buys", "Eve buys").replace("many apples", "many pears")
    d, i = data(spark, [(1, "So: " + same), (2, broken), (3, item)], [(9, "Now " + item + " for Clara and Dora and Eve")])
    found = {r.doc_id: r.kind for r in leakage.leaks(d, i).collect()}
    assert found[1] == "reparameterised" and found[3] == "exact"


def test_both_kinds_are_put_out_and_names_are_never_dropped(spark, tmp_path):
    item = "If Anna buys 12 apples and Bert buys 7 apples how many apples are there when Anna gives 3 away today"
    d, i = data(spark, [(1, item.replace("Anna", "Clara").replace("Bert", "Dora")), (3, item)], [(9, "Now " + item + " for Clara and Dora")])
    d.write.parquet(str(tmp_path / "documents.parquet"))
    i.write.parquet(str(tmp_path / "eval_items.parquet"))
    assert {r.doc_id: r.kind for r in queries_text.QUERIES["p7_leaks"](spark, str(tmp_path)).collect()} == {1: "reparameterised", 3: "exact"}
    rows = lambda **o: sorted(map(str, leakage.leaks(d, i, **o).collect()))
    assert rows(broadcast_names=1) == rows() == rows(broadcast_names=1, broadcast_windows=1)


def test_tables_of_numbers_stay_linear(spark):
    """Windows of numbers alone meet only their equals, however many there are."""
    rnd = random.Random(8)
    numbers = lambda n: " ".join(str(rnd.randrange(10**6)) for _ in range(n))
    docs = [(d, numbers(2000)) for d in range(20)]
    items = [(k, numbers(2000)) for k in range(10)] + [(99, docs[4][1][-140:])]
    d, i = data(spark, docs, items)
    w = leakage._windows(d.selectExpr("doc_id as id", "text"), set(), None, 10).select("window_hash", "id")
    v = leakage._windows(i.selectExpr("item_id as id", "text"), set(), None, 10).select("window_hash", F.col("id").alias("item"))
    met = w.join(v, "window_hash")
    assert {(r.id, r.item) for r in met.collect()} == {(4, 99)} and met.count() < 40
    assert [(r.doc_id, r.item_id, r.kind) for r in leakage.leaks(d, i).collect()] == [(4, 99, "exact")]


def test_empty(spark):
    d, i = data(spark, [(1, "a b c d e f g h i j k")], [])
    assert leakage.leaks(d, i).count() == 0
    assert leakage.leaks(d.limit(0), d.withColumnRenamed("doc_id", "item_id")).count() == 0
