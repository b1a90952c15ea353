"""Splitting oversized items at natural boundaries, with overlap.

Every place where a text may be cut is a boundary of some rank (heading, paragraph, sentence, line, word).
Each boundary is joined to its farthest legal successor, and the successor tables are squared until all
greedy cuts from the start of the text are known (pointer doubling): a text of n boundaries and p pieces
needs log2(p) rounds of array lookups instead of p dependent steps. A text is one row, so its boundary
table never leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that Unicode gives the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The full-width marks after which a text without spaces may be cut.
WIDE_MARKS = "。！？、"
SENTENCE_ENDS = ".!?…。！？"
CLOSERS = "\"')]}»”’"
RANKS = ("forced", "word", "line", "sentence", "paragraph", "heading")
#: Whole pieces end at a strong boundary only beyond this part of the limit, so that they do not get tiny.
LEAST_FILL = 0.5


def _flags(characters) -> np.ndarray:
    out = np.zeros(0x10000, bool)
    out[[c if isinstance(c, int) else ord(c) for c in characters]] = True
    return out


_WS, _WIDE, _ENDS, _CLOSE = (_flags(x) for x in (WHITE_SPACE, WIDE_MARKS, SENTENCE_ENDS, CLOSERS))
_FULL_ENDS = _flags("。！？")


def boundaries(text: str, code: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions 0 < p < len(text) at which a cut falls between two words or better, and their ranks (1 to 5)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ch = np.minimum(points, 0xFFFF)
    n = len(ch)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ws, wide = _WS[ch], _WIDE[ch]
    rank = np.zeros(n, np.int64)  # rank[p]: of a cut before character p
    rank[1:][ws[1:] | ws[:-1] | wide[1:] | wide[:-1]] = 1
    newline = (ch == 10) | ((ch == 13) & np.append(ch[1:] != 10, True))
    after_line = np.zeros(n, bool)
    after_line[1:] = newline[:-1]
    solid = np.where(~ws, np.arange(n), -1)
    before = np.empty(n, np.int64)  # the last solid character before p
    before[0], before[1:] = -1, np.maximum.accumulate(solid)[:-1]
    starts = ~ws & (before >= 0) & (before < np.arange(n) - 1)  # a word begins here, after white space
    end = before.copy()
    for _ in range(2):  # step over closing quotes and brackets
        end = np.where((end >= 1) & _CLOSE[ch[np.maximum(end, 0)]], end - 1, end)
    sentence = starts & _ENDS[ch[np.maximum(end, 0)]]
    sentence[1:] |= _FULL_ENDS[ch[:-1]] & ~_CLOSE[ch[1:]]
    lines = np.concatenate([[0], np.cumsum(newline)])[:n]  # line ends before p
    breaks = lines - lines[np.minimum(before + 1, n - 1)]
    paragraph = starts & (breaks >= 2)
    line_rank, sentence_rank = (3, 2) if code else (2, 3)
    rank[after_line] = np.maximum(rank[after_line], line_rank)
    rank[sentence] = np.maximum(rank[sentence], sentence_rank)
    rank[paragraph] = 4
    at_line = np.flatnonzero(after_line & ((ch == 35) | (ch == 96)))
    fenced = False
    for p in at_line:  # a # inside a code fence is no heading
        if text.startswith("```", p):
            fenced = not fenced
        elif not fenced and text[p] == "#" and not code:
            mark = text[p : p + 7].lstrip("#")
            if mark[:1] in (" ", "\t") and len(mark) < 7:
                rank[p] = 5
    at = np.flatnonzero(rank)
    return at, rank[at]


def cuts(text: str, limit: int, overlap: int, code: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a text, and the rank at which each ends (0 forced, 6 the end of the text).

    Every piece is at most ``limit`` long, the pieces cover the text, each starts ``overlap`` before the end
    of the one before; less where the next place to cut at would else be out of reach.
    """
    n = len(text)
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    at, rank = boundaries(text, code)
    at, rank = np.concatenate([[0], at, [n]]), np.concatenate([[6], rank, [6]])
    wide = np.flatnonzero(np.diff(at) > limit)
    if len(wide):  # stretches with nowhere to cut get forced places
        step = limit - overlap
        extra = np.concatenate([np.arange(at[i] + step, at[i + 1], step) for i in wide])
        at, rank = np.concatenate([at, extra]), np.concatenate([rank, np.zeros(len(extra), np.int64)])
        order = np.argsort(at, kind="stable")
        at, rank = at[order], rank[order]
    m = len(at)
    begin = np.maximum(at - overlap, 0)
    begin[0] = 0
    far = np.searchsorted(at, begin + limit, "right") - 1
    index = np.arange(m)
    succ = np.maximum(far, np.minimum(index + 1, m - 1))
    chosen = succ == m - 1
    for level in (5, 4, 3, 2, 1):
        last = np.maximum.accumulate(np.where(rank >= level, index, 0))[far]
        least = begin + limit * LEAST_FILL if level > 1 else at
        good = ~chosen & (last > index) & (at[last] > np.maximum(least, at))
        succ = np.where(good, last, succ)
        chosen |= good
    reach, jump = np.array([0]), succ
    while reach[-1] != m - 1:
        reach = np.union1d(reach, jump[reach])
        jump = jump[jump]
    ends = at[reach[1:]]
    starts = np.maximum(begin[reach[:-1]], ends - limit)
    return starts, ends, rank[reach[1:]]


def split_oversized(df: DataFrame, key: str, text: str, limit: Column | int, overlap: Column | int, code: Column | None = None, with_text: bool = True) -> DataFrame:
    """The pieces of every text longer than its limit (in code points).

    Columns: key, ``ord`` from 0, ``piece_start`` and ``piece_end`` as offsets of code points, ``cut_at`` (the
    rank of the piece's end: heading, paragraph, sentence, line, word, forced or end) and, unless
    ``with_text`` is false, ``piece``. Null, empty and short texts give no rows; a repeated row is cut again
    on its own. Only these columns are read, so others cannot clash.
    """
    one = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), one(limit).cast("int").alias("limit"), one(overlap).cast("int").alias("overlap"), (F.coalesce(code, F.lit(False)) if code is not None else F.lit(False)).alias("code")).where(F.length("text") > F.col("limit"))
    key_type = df.schema[key].dataType.simpleString()
    names = [*RANKS, "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ords, starts, ends, kinds, pieces = [], [], [], [], [], []
            for i, (content, most, shared, is_code) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "limit", "overlap", "code")))):
                a, b, rank = cuts(content, most, shared, is_code)
                keys += [i] * len(a)
                ords += range(len(a))
                starts += a.tolist()
                ends += b.tolist()
                kinds += [names[r] for r in rank.tolist()]
                if with_text:
                    pieces += [content[x:y] for x, y in zip(a.tolist(), b.tolist())]
            columns = [batch.column("key").take(pa.array(keys, pa.int64())), pa.array(ords, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string())]
            fields = ["key", "ord", "piece_start", "piece_end", "cut_at"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.string())] * with_text, fields + ["piece"] * with_text)

    schema = f"key {key_type}, ord int, piece_start long, piece_end long, cut_at string" + ", piece string" * with_text
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
