import datetime as dt

from pyspark.sql import functions as F

from loomspan.functions import fts, quality, text


def values(spark, expression, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", expression(F.col("x")).alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    assert values(spark, text.normalize, ["a  \r\nb\t\rc\n\n\n\n\nd\0 ", None, "", "é"]) == ["a\nb\nc\n\n\nd", None, "", "é"]
    assert values(spark, text.normalize_subject, ["Re: [ext] FWD: Re[2]: The  Plan", "Answer: no", None]) == ["the plan", "answer: no", None]
    assert values(spark, text.normalize_fact, ["  Straße  IS open!?; ", "x.y.", None]) == ["strasse is open", "x.y", None]


def test_handles_and_owners(spark):
    assert values(spark, text.handle_key, ["(555) 123-4567", " ADA@Example.com ", "12345", "", None]) == ["5551234567", "ada@example.com", None, None, None]
    assert values(spark, text.remote_owner, ["https://host.example/ada/tools.git", "git@host.example:ada/tools.git", "host.example/ada/tools", "", None]) == ["ada", "ada", "ada", None, None]
    assert values(spark, text.table_slug, ["BGE-M3", "  nomic/embed-text:v1.5 ", "---", "a" * 80]) == ["emb_bge_m3", "emb_nomic_embed_text_v1_5", None, "emb_" + "a" * 59]


def test_claims(spark):
    got = values(spark, text.claim_signature, ["It was not 1,000 on Monday in May", "1000 monday, don't", "plain"])
    assert [(r.numbers, r.temporal, r.negated) for r in got] == [("1000", "monday", True), ("1000", "monday", True), ("", "", False)]


def test_instants(spark):
    at = dt.datetime(2026, 4, 12, 10, 15, 30)
    got = values(spark, text.parse_instant, ["1775988930", "1775988930000", "2026-04-12T10:15:30Z", "2026-04-12 10:15:30", "soon", "", None, "-3"])
    assert got == [at, at, at, at, None, None, None, None]


def test_paths_and_tools(spark):
    got = values(spark, lambda x: text.path_trust(x, F.lit("received")), ["Projects/a.md", "x/vendor/a.md", "Notes/b/c.txt", "lib/Books/x.pdf", "other/manuals/y", "z"])
    assert [(r.trust, r.label) for r in got] == [("authored", "path:Projects"), ("reference", "path:vendored"), ("authored", "path:Notes"), ("reference", "path:Books"), ("reference", "path:component:manuals"), ("received", "path:default")]
    assert values(spark, text.tool_kind, ["Bash", "mcp__x", "browser_open", "Read", "grep", "swarm", "apply_patch", "?"]) == ["exec", "mcp", "browser", "read", "search", "subagent", "write", "other"]
    assert values(spark, lambda x: text.tool_argument(x, text.TOOL_PATHS, 4), ['{"path": "  /abcdef"}', '{"cwd": "x", "file_path": " "}', "no json"]) == ["/abc", "x", None]
    assert values(spark, text.reader_for, ["a/b.MD", "c.doc", "d.zip", "e", "f.py"]) == ["markdown", "none: legacy binary format", "none: binary container", "none: no extractor", "code"]


def test_globs(spark):
    import re

    for pattern, hit, miss in (("**/Papers/*", "a/b/Papers/c/d", "Papers"), ("*.m?", "x/y.md", "x.m"), ("[!a]b*", "cbx", "ab"), ("a.b", "a.b", "axb")):
        assert re.match(text.glob_regex(pattern), hit) and not re.match(text.glob_regex(pattern), miss)


def test_quality(spark):
    log = "\n".join(f"2026-07-27 11:{i:02d}:00 INFO step {i} done" for i in range(60))
    prose = "\n".join(f"Paragraph about the {w} harbour and its people, written by hand for number {w}." for w in [chr(97 + i % 26) * (i // 26 + 2) for i in range(60)])
    hashes = "\n".join(f"{i:040x}  file{i}" for i in range(12))
    got = values(spark, quality.assess, [log, prose, hashes, "short", "", None])
    assert [r.machine for r in got] == [True, False, True, False, False, False]
    assert got[0].timestamped == 1.0 and got[3].repetition is None
    assert values(spark, lambda x: F.length(quality.sample_of(x, 10, 3)), ["a" * 100 + "\nb\nc\nd" + "e" * 900, "l\nm\nn\n" + "x" * 100]) == [640, 10]


def test_stems_and_queries(spark):
    words = "consistency relational archives running flies happily hopping generously national troubled cries dying agreed plastered motoring conflated sized failing skis university".split()
    want = "consist relat archiv run fli happili hop generous nation troubl cri die agre plaster motor conflat size fail ski univers".split()
    assert [fts.stem(w) for w in words] == want
    assert fts.parse("tide table") == [[(False, ["tide"])], [(False, ["table"])]]
    assert fts.parse('"tide table" -flood or log') == [[(False, ["tide", "table"]), (True, ["flood"])], [(False, ["log"])]]
    got = values(spark, lambda x: fts.matches(fts.tokens(x), fts.parse('"tide table" -flood or log')), ["The Tide, table.", "tide table flood", "a log", "table tide", None])
    assert got == [True, False, True, False, None] or got == [True, False, True, False, False]
