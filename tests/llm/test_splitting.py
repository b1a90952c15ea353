import random
import re

import pytest
from pyspark.sql import functions as F

from loomspan.llm import splitting

WS = "".join(map(chr, splitting.WHITE_SPACE))


def greedy_checks(text, limit, overlap, code=False):
    starts, ends, rank = splitting.cuts(text, limit, overlap, code)
    assert starts[0] == 0 and ends[-1] == len(text)
    assert all(0 < e - s <= limit for s, e in zip(starts, ends))
    for i in range(1, len(starts)):
        assert starts[i] <= ends[i - 1] < ends[i]  # covers without gaps
        shared = ends[i - 1] - starts[i]
        assert shared == min(overlap, ends[i - 1]) or ends[i] - starts[i] == limit
    stretch = max(map(len, re.split(f"[{re.escape(WS)}。！？、]", text)))
    assert (0 in rank) == (stretch > limit)
    return starts, ends, rank


@pytest.mark.parametrize("seed", range(40))
def test_invariants(seed):
    rnd = random.Random(seed)
    unit = ["word", " ", "\n\n", ". ", "。", "x" * rnd.choice([3, 30, 99, 100, 101, 180]), "\r\n", "# Head\n", "　", "🙂"]
    text = "".join(rnd.choice(unit) for _ in range(rnd.randrange(1, 400)))
    greedy_checks(text, 100, rnd.choice([0, 15, 60]), rnd.random() < 0.3)


def test_prefers_strong_boundaries():
    text = "One sentence here. " * 4 + "\n\n" + "Second part goes on. " * 6 + "\n\n# Heading\n" + "tail words " * 20
    starts, ends, rank = greedy_checks(text, 120, 20)
    assert text[ends[0]:].startswith("Second part")
    assert any(text[e:].startswith("# Heading") for e in ends)
    assert "# not" not in [text[e:e + 5] for e in splitting.boundaries("```\n# not\n```\n\n# yes\n")[0][splitting.boundaries("```\n# not\n```\n\n# yes\n")[1] == 5]]


def test_successors_match_step_by_step():
    rnd = random.Random(5)
    text = " ".join("w" * rnd.randrange(1, 12) for _ in range(3000))
    starts, ends, _ = splitting.cuts(text, 200, 30)
    at, rank = splitting.boundaries(text)
    at = [*at.tolist(), len(text)]
    end, expected = 0, []
    while end < len(text):
        begin = max(0, end - 30)
        end = max(p for p in at if p <= begin + 200)
        expected.append(end)
    assert ends.tolist() == expected


def test_operator_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x" * 50, "c"), (4, "ab cd " * 30, "d"), (4, "ab cd " * 30, "d"), (5, "y" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, content string, piece string")
    out = splitting.split_oversized(df, "doc_id", "content", 50, 10).collect()
    assert {r.doc_id for r in out} == {4, 5}
    assert {r.cut_at for r in out if r.doc_id == 5} == {"forced", "end"}
    assert sum(r.doc_id == 4 and r.ord == 0 for r in out) == 2
    for r in out:
        assert r.piece == rows[r.doc_id - 1 if r.doc_id < 5 else 5][1][r.piece_start:r.piece_end]
    assert splitting.split_oversized(df.limit(0), "doc_id", "content", 50, 10).count() == 0
    with pytest.raises(ValueError):
        splitting.cuts("abc", 5, 5)
