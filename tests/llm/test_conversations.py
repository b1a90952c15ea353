import random

from loomspan.llm import conversations

SCHEMA = "id long, session_id long, external_id string, parent_external_id string, ord int, role string, content string, node string"


def brute(rows, sessions):
    by = {s: {} for s in sessions}
    for r in rows:
        if r[1] is not None and r[0] is not None:
            by.setdefault(r[1], {}).setdefault(r[2] or f"row {r[0]}", []).append(r)
    out = {}
    for s, turns in by.items():
        said = {k: {r[5] for r in v if r[6] and r[6].strip()} for k, v in turns.items()}
        if not any(x & {"user", "assistant"} for x in said.values()):
            out[s] = "empty"
            continue
        named = {k: [p for _, p in sorted((r[0], r[3]) for r in v if r[3])] for k, v in turns.items()}
        up = {k: v[0] if v else None for k, v in named.items()}
        heard, broken = set(), any(p not in turns for v in named.values() for p in v)
        for k in turns:
            seen, at = set(), up[k]
            while at in turns and at not in seen:
                seen.add(at)
                if "assistant" in said[k]:
                    heard.add(at)
                at = up[at]
            broken |= at in seen
        if broken:
            out[s] = "broken"
        elif any("user" in said[k] and k not in heard for k in turns):
            out[s] = "unanswered"
    return out


def made(seed, n=40):
    rnd, rows, key = random.Random(seed), [], 0
    for s in range(n):
        for i in range(rnd.choice([0, 1, 2, 5, 30])):
            key += 1
            parent = rnd.choice([None, ""] if i == 0 else [str(i - 1)] * 8 + [str(rnd.randrange(i))])
            if rnd.random() < 0.03:
                parent = rnd.choice(["lost", str(i), str(i + 1)])
            row = (key, s, str(i) if rnd.random() < 0.97 else rnd.choice([None, ""]), parent, rnd.choice([i, i, None, 3]), rnd.choice(["user", "assistant", "assistant", "tool", None]), rnd.choice(["hi", "there", " \n", None, "x" * 9000]), "clash")
            rows.append(row)
            if rnd.random() < 0.1:
                key += 1
                rows.append((key, *row[1:]))
    return [*rows, rows[-1], (None, 3, "z", None, 0, "user", "q", ""), (10**6, None, "z", None, 0, "user", "q", "")]


def test_dropped_sessions_match_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        sessions = spark.createDataFrame([(i,) for i in range(42)], "id long")
        _, dropped = conversations.rebuild(spark.createDataFrame(rows, SCHEMA), sessions)
        got = [(r.session_id, r.reason) for r in dropped.collect()]
        assert len(got) == len(dict(got)) and dict(got) == brute(rows, range(42))


def test_long_branching_session(spark):
    rows = []
    for i in range(700):
        rows.append((i, 1, f"m{i}", f"m{i - 1}" if i else None, i, "user" if i % 2 == 0 else "assistant", "text", ""))
    for i in range(0, 600, 50):  # side branches, one of which ends in a question
        rows.append((1000 + i, 1, f"b{i}", f"m{i + 1}", i, "user", "and?", ""))
        if i != 300:
            rows.append((1001 + i, 1, f"c{i}", f"b{i}", i, "assistant", "so", ""))
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.session_id, r.reason) for r in conversations.rebuild(df)[1].collect()} == {(1, "unanswered")}
    whole = spark.createDataFrame(rows + [(5000, 1, "c300", "b300", 7, "assistant", "so", "")], SCHEMA)
    assert conversations.rebuild(whole)[1].count() == 0
    said = conversations.ordered(whole).orderBy("position").collect()
    assert [r.position for r in said] == list(range(len(rows) + 1))
    placed = {r.node: i for i, r in enumerate(said)}
    assert all(placed[i] > placed[i - 1] for i in range(1, 700))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.rebuild(df)[1].count() == 0 and conversations.ordered(df).count() == 0
