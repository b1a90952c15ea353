import pytest
from pyspark.sql import functions as F

from loomspan.engine import Engine
from loomspan.operators import enrich, models


@pytest.fixture
def engine(spark, tmp_path):
    docs = [(1, "Heat pumps", "heat pump efficiency rises with mild winters", "document", "authored", 1), (2, "Bread", "sourdough needs a warm kitchen", "document", "reference", 1), (3, "Mail", "the heat pump broke, says the letter", "communication", "received", 2)]
    write = lambda name, df: df.write.parquet(str(tmp_path / f"{name}.parquet"))
    write("documents", spark.createDataFrame([(i, t, x, x, c, r, s, "ok", f"u{i}") for i, t, x, c, r, s in docs], "doc_id long, title string, text string, content string, corpus_class string, trust_tier string, source_id long, state string, uri string"))
    write("emb_quill", spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.5, 0.5]), (4, None)], "chunk_id long, embedding array<float>"))
    write("sources", spark.createDataFrame([(1, "notes", "filesystem", True), (2, "mail", "mail", True)], "id long, slug string, kind string, enabled boolean"))
    write("authors", spark.createDataFrame([(1, "Ada", True)], "id long, display_name string, is_self boolean"))
    return Engine(spark, str(tmp_path), embed=lambda q: [1.0, 0.1], width=2)


def test_search(engine):
    for distance in ("cosine", "l2", "ip"):
        hits = engine.search("heat pump efficiency", distance=distance).collect()
        assert [h.chunk_id for h in hits][0] == 1 and hits[0].matched_by == "both" and hits[0].score == round(2 / 61, 6)
    assert [h.chunk_id for h in engine.search("heat", "fts").collect()] == [1, 3]
    assert [h.chunk_id for h in engine.search('"heat pump" -letter', "fts").collect()] == [1]
    assert {h.chunk_id for h in engine.search("heat", sources=["mail"]).collect()} == {3}
    assert {h.chunk_id for h in engine.search("heat", tiers=["reference"]).collect()} == {2}
    assert engine.search("  ").count() == 0
    engine.policy = lambda d: d.where("doc_id <> 1")
    assert 1 not in {h.chunk_id for h in engine.search("heat pump").collect()} and engine.get_document(1).count() == 0
    with pytest.raises(ValueError):
        engine.search("x", "other")


def test_search_by_author_direction_links_and_facts(engine, spark):
    write = lambda name, df: df.write.parquet(f"{engine.folder}/{name}.parquet")
    write("messages", spark.createDataFrame([(1, 10, 1, "the heat pump hums", "{}"), (2, 10, 2, "which heat pump", '{"subject": "Pump"}')], "id long, conversation_id long, author_id long, body string, meta string"))
    write("conversations", spark.createDataFrame([(10, 2)], "id long, source_id long"))
    write("session_turns", spark.createDataFrame([(7, 1, 3, "sent", "user", "heat the pump"), (8, 1, None, "received", "assistant", "heat is fine")], "id long, author_id long, session_id long, direction string, role string, content string"))
    write("sessions", spark.createDataFrame([(3, 1)], "id long, source_id long"))
    write("embeddings", spark.createDataFrame([(5, [1.0, 0.1])], "vec_id long, embedding array<float>"))
    ids = lambda *a, **k: [h.chunk_id for h in engine.search(*a, **k).collect()]
    assert ids("heat", within="messages") == [1, 2] and ids("heat", within="messages", direction="sent") == [1] and ids("heat", within="messages", direction="received") == [2]
    assert ids("heat", within="messages", author="_d") == [1] and ids("heat", within="turns", direction="sent") == [7] and ids("heat", within="messages", sources=["notes"]) == []
    links = spark.createDataFrame([(1, 2)], "doc_id long, source_id long")
    assert set(ids("heat", sources=["mail"], links=links)) == {1, 3}
    assert ids("heat", "vector", facts=True)[0] == -6 and ids("heat", "vector", facts=True, binary=True)[0] == -6
    with pytest.raises(ValueError):
        engine.search("heat", author="Ada")


def test_search_by_index(engine):
    queries = ("heat", "heat pump efficiency", '"heat pump" -letter', '"heat pump" or kitchen', "nothing", "-heat")
    seen = lambda: [[(h.chunk_id, h.score) for h in engine.search(q, "fts", tiers=t).collect()] for q in queries for t in ((), ("authored", "received"))]
    before = seen()
    engine.index()
    assert seen() == before and before[0]


def test_prompt_keeps_mail_home(engine):
    text, cited = engine.prompt("heat pump")
    assert 3 not in cited and "[1]" in text and "letter" not in text
    assert 3 in engine.prompt("heat pump", remote=False)[1]
    assert [r.documents for r in engine.sources().orderBy("slug").collect()] == [1, 2] and engine.authors("a").count() == 1


def test_models(spark):
    reg = models.Registry()
    reg.register(models.Model("a", 2))
    reg.register(models.Model("b", 4096, shortens=True))
    assert reg.default().slug == "a" and reg.models["b"].stored_width == 4000
    reg.set_default("b")
    reg.drop("b")
    assert reg.default().slug == "a"
    with pytest.raises(ValueError):
        reg.register(models.Model("a", 3))
    with pytest.raises(ValueError):
        models.Model("x", 2, distance="far")
    chunks = spark.createDataFrame([(1, "x", None, "document"), (2, "yy", None, "communication"), (3, "", "image", "document")], "chunk_id long, text string, chunker string, corpus_class string")
    vectors = spark.createDataFrame([(9, [0.0, 0.0])], "chunk_id long, embedding array<float>")
    remote = models.Model("r", 2, remote=True)
    assert {r.chunk_id for r in models.pending(chunks, vectors, remote).collect()} == {1}
    local = models.Model("l", 2)
    new = models.backfill(models.pending(chunks, vectors, local), lambda ts: [[len(t), 1] for t in ts], local)
    done = models.upsert(vectors, new)
    assert {r.chunk_id for r in done.collect()} == {1, 2, 9} and models.pending(chunks, done, local).count() == 0
    assert [list(r.embedding) for r in models.upsert(done, spark.createDataFrame([(1, [5.0, 5.0])], vectors.schema), False).where("chunk_id = 1").collect()] == [[1.0, 1.0]]


def test_enrich(spark):
    docs = spark.createDataFrame([(1, "Acme was founded in 1998. It  grew."), (2, None)], "document_id long, text string")
    got = enrich.extract_facts(docs, lambda t: [("fact", "acme was founded in 1998."), ("fact", "It grew."), ("fact", "It shrank.")] if t else []).collect()
    assert [(r.ord, r.fact, r.char_start) for r in got] == [(0, "acme was founded in 1998.", None), (1, "It grew.", None)]
    ids = spark.createDataFrame([(1, "mail", "a@x"), (2, "mail", "a@x"), (2, "phone", "5"), (3, "phone", "5"), (4, "mail", ""), (5, "mail", None), (6, "phone", "6")], "author_id long, kind string, value string")
    assert {r.author_id: r.person for r in enrich.same_people(ids).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    tallies = spark.createDataFrame([("p", "Ada", 13), ("p", "Bo", 2), ("p", "Cy", 1), ("q", "Bo", 1)], "path string, name string, commits int")
    top = {(r.path, r.role): (r.name, r.confidence, r.evidence) for r in enrich.git_authorship(tallies, F.col("name") == "Bo").where("role = 'author'").collect()}
    assert top == {("p", "author"): ("Ada", 0.812, "git-log:top-committer:13/16"), ("q", "author"): ("Bo", 1.0, "git-log:top-committer:1/1")}
    hints = spark.createDataFrame([(["a", "b"],), (None,)], "h array<string>").select(enrich.hint_authors(F.col("h")).alias("a")).collect()
    assert [x.confidence for x in hints[0].a] == [0.8, 0.5] and list(hints[1].a) == []


def test_attribution(spark):
    rows = [(1, "g", ["x <y@z.example>"], ["Ada"], "authored", True), (2, None, ['"Bo M" <b@m.example>', "c@d.example", "", "e", "f", "g"], ["Ada"], "authored", True), (3, None, None, ["Ada ", "Bo"], "authored", False), (4, None, ["Bo"], ["Bo", "C"], "received", False), (5, None, None, ["ada"], "reference", False), (6, None, [], None, "authored", True), (7, None, None, [], "received", False)]
    df = spark.createDataFrame(rows, "id long, git string, senders array<string>, hints array<string>, trust string, mail boolean")
    git = F.when(F.col("git").isNotNull(), F.struct(F.lit("authored").alias("trust"), F.lit("git").alias("evidence"), F.array(F.struct(F.lit("Ada").alias("name"), F.lit(0.8).alias("confidence"))).alias("authors")))
    path = F.struct(F.col("trust"), F.lit("path:x").alias("label"))
    got = {r.id: (r.a.trust, r.a.evidence, [(x.name, x.confidence) for x in r.a.authors]) for r in df.select("id", enrich.attribute(git, F.col("senders"), F.col("hints"), path, F.col("mail"), ["Ada"]).alias("a")).collect()}
    assert got == {
        1: ("authored", "git", [("Ada", 0.8)]), 2: ("received", "message-sender:third-party", [("Bo M", 0.9), ("c@d.example", 0.9), ("e", 0.9), ("f", 0.9)]),
        3: ("authored", "document-metadata:self+path:x", [("Ada ", 0.8), ("Bo", 0.5)]), 4: ("reference", "document-metadata:third-party+path:x", [("Bo", 0.8), ("C", 0.5)]),
        5: ("reference", "document-metadata:self+path:x", [("ada", 0.8)]), 6: ("authored", "path:x", [("Ada", 0.6)]), 7: ("received", "path:x", []),
    }


def test_backfill_goes_on_until_nothing_is_pending(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "x" * (i % 5 + 1), "prose", "document") for i in range(25)], "chunk_id long, text string, chunker string, corpus_class string")
    store, model, seen = str(tmp_path / "v"), models.Model("m", 2), []
    read = lambda: spark.read.schema("chunk_id long, embedding array<float>").parquet(store) if (tmp_path / "v").exists() else spark.createDataFrame([], "chunk_id long, embedding array<float>")
    write = lambda df: df.write.mode("append").parquet(store)
    assert models.backfill_all(chunks, read, write, lambda ts: [[1, len(t)] for t in ts], model, rows=10, tell=seen.append) == 3
    assert seen == [25, 15, 5, 0] and read().count() == 25
    with pytest.raises(Exception):
        models.backfill_all(chunks.selectExpr("chunk_id + 100 as chunk_id", "text", "chunker", "corpus_class"), read, write, lambda ts: [[1]], model)
    assert read().count() == 25


def test_progress(spark):
    from loomspan.streaming import progress

    told = []
    with pytest.raises(ValueError):
        progress.staged("rebuild", [("a", lambda: None), ("b", lambda: int("x"))], told.append)
    assert [(p.done, p.note.split(" ")[0]) for p in told] == [(0, "a"), (1, "b"), (1, "b")]
    listener = progress.watch(spark, told.append)
    query = spark.readStream.format("rate").load().writeStream.format("noop").trigger(once=True).start()
    query.awaitTermination()
    import time

    for _ in range(50):
        if any(p.note == "done" for p in told):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert any(p.note == "done" for p in told)
