import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomspan.functions import chunkers
from loomspan.operators import ingest
from loomspan.operators.prefix import running_sum
from loomspan.sources import connectors, files, readers, sessions
from loomspan.streaming import ingest as stream


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    (root / "node_modules").mkdir(parents=True)
    (root / "notes").mkdir()
    (root / "notes" / "bridge.md").write_text("---\ntitle: The Bridge\nauthor: [Ada, Microsoft Word]\n---\n# Other\nA brindled heron stands here.\n")
    (root / "notes" / "old.txt").write_bytes("caf\xe9 bridge".encode("cp1252"))
    (root / "notes" / "mail.eml").write_text("From: Ada L <ada@x.example>\nSubject: Lantern\nTo: b@x.example\n\nThe heron festival.\n")
    (root / "notes" / "tide.rs").write_text("fn tide() {}\n")
    (root / "notes" / "empty.md").write_text("")
    (root / "notes" / "pic.doc").write_bytes(b"x")
    (root / "node_modules" / "x.md").write_text("no")
    return str(root)


def test_scan_and_read(spark, corpus):
    listed = files.listing(spark, corpus).withColumn("why", files.skip_reason(F.col("relative"), F.col("size")))
    assert {r.relative: r.why for r in listed.collect()} == {"notes/bridge.md": None, "notes/old.txt": None, "notes/mail.eml": None, "notes/tide.rs": "code", "notes/pic.doc": "no reader", "node_modules/x.md": "excluded folder"}
    out = {r.path.rsplit("/", 1)[1]: r for r in readers.extract(files.contents(spark, corpus)).collect()}
    assert out["bridge.md"].title == "The Bridge" and out["bridge.md"].authors == ["Ada"] and out["bridge.md"].text.startswith("# Other")
    assert out["old.txt"].text == "café bridge" and out["mail.eml"].authors == ["Ada L <ada@x.example>"] and "heron" in out["mail.eml"].text
    assert out["pic.doc"].problem == "no extractor for 'doc'" and out["pic.doc"].text is None


def test_connectors(spark, corpus, tmp_path):
    connectors.register(spark)
    rows = spark.read.format("remote").option("root", corpus).option("page", "2").load().collect()
    assert len(rows) == 7 and len({r.hash for r in rows}) == 7
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE chat (id INTEGER, name TEXT)")
        con.executemany("INSERT INTO chat VALUES (?, ?)", [(i, f"n{i}") for i in range(10)])
    assert [(r.name, r.rows) for r in spark.read.format("sqlite").option("path", db).load().collect()] == [("chat", 10)]
    assert {r.name for r in spark.read.format("sqlite").option("path", db).option("table", "chat").load().collect()} == {f"n{i}" for i in range(10)}
    assert connectors.is_message_store({"chat", "message", "handle", "x"}) and not connectors.is_message_store({"chat"})


def test_hashes():
    assert connectors.quick_xor_hash(b"") == "AAAAAAAAAAAAAAAAAAAAAAAAAAA="
    assert connectors.block_hash(b"abcdef", 4) != connectors.block_hash(b"abcdef", 3)
    one = connectors.quick_xor_hash(b"a" + bytes(159) + b"b")
    assert one != connectors.quick_xor_hash(b"b" + bytes(159) + b"c") and len(one) == 28


def test_front_matter():
    assert readers.front_matter("no matter") == ({}, "no matter")
    assert readers.front_matter("---\na: 1\nb:\n  - x\n  - 'y z'\n---\nbody") == ({"a": "1", "b": ["x", "y z"]}, "body")
    assert readers.front_matter("---\njust text\n---\nx")[0] == {}
    assert readers.decode("é".encode("utf-16")) == "é" and readers.decode(b"\xef\xbb\xbfx") == "x" and readers.decode(b"\x81") == "\x81"


def test_chunkers(spark):
    assert chunkers.split("one two three four five", [" ", ""], 10, 4) and all(len(c) <= 10 for c in chunkers.split("one two three four five", [" ", ""], 10, 4))
    text = "# Boot\nintro\n## SEP\n" + "A sentence of words. " * 100 + "\n```\n# no heading\n```\n# Next\nend"
    got = chunkers.chunk("markdown", text)
    assert [c[0] for c in got] == list(range(len(got))) and {c[2] for c in got} == {"Boot", "Boot > SEP", "Next"}
    assert all(len(c[1]) <= chunkers.SIZE for c in got)
    for _, piece, _, a, b, _ in got:
        assert a is None or text[a:b] == piece or piece.split("\n")[0].strip() in text[a:b]
    assert all(len(c[1]) <= chunkers.CODE_SIZE for c in chunkers.chunk("code", "def f():\n    pass\n\n" * 300, "py"))
    assert chunkers.chunk("prose", "x" * 5000)[0][1] == "x" * 1000 or len(chunkers.chunk("prose", "x" * 5000)[0][1]) <= 1000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 1000)], "id long, content string")
    assert {r.id for r in chunkers.chunk_documents(df, "id", "content", F.lit("prose"), F.lit("txt")).collect()} == {3}


def test_session_exports(spark):
    lines = [{"sessionId": "s", "uuid": "a", "type": "user", "timestamp": "2026-04-12T10:15:30Z", "message": {"role": "user", "content": "hi"}}, {"sessionId": "s", "uuid": "b", "parentUuid": "a", "type": "assistant", "message": {"role": "assistant", "model": "m", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "yes"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls"}}]}}, {"type": "summary"}]
    rows = {r.external_id: r for r in sessions.log_turns(spark.createDataFrame([(json.dumps(x),) for x in lines] + [("broken",)], "value string")).collect()}
    assert set(rows) == {"a", "b"} and rows["b"].content == "yes" and rows["b"].thinking == "hm" and rows["b"].tools[0].name == "Bash"
    chat = {"id": "c", "current_node": "n2", "mapping": {"n1": {"id": "n1", "parent": None, "message": {"author": {"role": "user"}, "create_time": 1.5, "content": {"parts": ["q"]}}}, "n2": {"id": "n2", "parent": "n1", "message": {"author": {"role": "assistant"}, "content": {"parts": ["a", "b"]}}}, "n0": {"id": "n0"}}}
    rows = {r.external_id: r for r in sessions.map_turns(spark.createDataFrame([(json.dumps(chat),)], "value string")).collect()}
    assert set(rows) == {"n1", "n2"} and rows["n2"].content == "a\nb" and rows["n2"].current and rows["n2"].parent_external_id == "n1"
    feeds = spark.createDataFrame([('{"items": [1, 2]}',), ("<rss><item/><item>x</item></rss>",), ("<a:entry >",), ("nothing",)], "x string")
    assert [r.n for r in feeds.select(sessions.feed_items(F.col("x")).alias("n")).collect()] == [2, 2, 1, 0]


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, 1, "h1", "t1", "c"), ("b", 1, 1, "h2", "t2", "c"), ("c", 1, 1, "h3", "t3", "c"), ("d", 1, 1, "h4", "t4", "c")], "k string, mtime int, size int, bytes_sha string, text_sha string, chunker string")
    new = spark.createDataFrame([("a", 1, 1, "h1", "t1", "c"), ("b", 2, 1, "h2", "t2", "c"), ("c", 2, 1, "hX", "t3", "c"), ("d", 2, 1, "hX", "tX", "c"), ("e", 1, 1, None, None, None)], old.schema)
    assert {r.k: r.action for r in ingest.skip_ladder(new, old, ["k"]).collect()} == {"a": "skip_stat", "b": "skip_bytes", "c": "refresh_stat", "d": "replace", "e": "insert"}
    contacts = spark.createDataFrame([("15551234567", "A"), ("445551234567", "B"), ("5550001111", "C"), ("a@x", "M")], "key string, name string")
    handles = spark.createDataFrame([("5551234567",), ("15550001111",), ("a@x",), ("z@x",)], "key string")
    assert {r.key: r.name for r in ingest.lookup_contacts(handles, contacts).collect()} == {"5551234567": None, "15550001111": "C", "a@x": "M", "z@x": None}
    rows = spark.createDataFrame([(g, i, (i * 7) % 5 if i % 9 else None) for g in ("x", "y", None) for i in range(50)], "g string, i int, v int")
    got = {(r.g, r.i): r.s for r in running_sum(rows, "g", ["i"], F.col("v"), "s", parts=6).collect()}
    assert all(got[g, i] == sum((j * 7) % 5 if j % 9 else 0 for j in range(i)) for g in ("x", "y", None) for i in range(50))


def test_streaming_state(spark, tmp_path):
    source, state = str(tmp_path / "in"), stream.State(spark, str(tmp_path / "state"))
    (tmp_path / "state").mkdir()
    first = spark.createDataFrame([(1, "u1", "a"), (1, "u2", "a")], "v int, uri string, body string")
    first.write.parquet(source + "/1")
    read = lambda: spark.readStream.schema(first.schema).option("recursiveFileLookup", True).parquet(source)
    stream.ingest_stream(read(), state, str(tmp_path / "cp"), ["uri"], "v").awaitTermination()
    spark.createDataFrame([(2, "u2", "b"), (1, "u3", "c")], first.schema).write.parquet(source + "/2")
    stream.ingest_stream(read(), state, str(tmp_path / "cp"), ["uri"], "v").awaitTermination()
    again = state.version()
    stream.ingest_stream(read(), state, str(tmp_path / "cp"), ["uri"], "v").awaitTermination()
    assert state.version() == again and {(r.uri, r.body) for r in state.read().collect()} == {("u1", "a"), ("u2", "b"), ("u3", "c")}
