"""The quality gate: tells machine output from text a person may want to find, by the shape of its lines.

Lines are split and counted once a text, in Arrow batches; shares, thresholds and verdict are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The sample, thresholds and line patterns of the gate.
SAMPLE, LEAST_LINES = 65_536, 40
TIMESTAMP = r"^\s*(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|\d{2}:\d{2}:\d{2}[.,]\d+|\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}|\[\d+\.\d+\]|\d{10,13}\b)"
HEX, BASE64 = r"\b[0-9a-fA-F]{16,}\b", r"\b[A-Za-z0-9+/]{40,}={0,2}\b"
DUMP = r"^\s*(?:[+|`\-]{1,4}[o\-]|\{|\}|<\w+ |0x[0-9a-f]{6,})"
LIMITS = {"timestamped": 0.45, "repetition": 0.65, "dumpish": 0.4, "hex_per_line": 0.6, "base64_per_line": 0.4}
DECISIVE = {"timestamped": 0.6, "hex_per_line": 1.0, "dumpish": 0.7, "repetition": 0.82}
ALPHA = 0.55


_COUNTS = "lines shapes timestamped dumpish hex base64 letters chars hashes".split()
_SPACE = " \t\n\x0b\f\r"
_TIME, _DUMP, _HEX, _BASE64, _HASH = (re.compile(x, re.ASCII) for x in (TIMESTAMP, DUMP, HEX, BASE64, f"(?:{HEX}|{BASE64})"))
_DIGITS = re.compile("[0-9]+")
_KEPT = bytes(c for c in range(128) if chr(c).isalpha() or chr(c) in _SPACE or 0x1C <= c < 0x20)
_OTHER = regex.compile(r"[^\p{L} \t\n\x0b\f\r\x1c-\x1f]+")


def counts_of(text: str) -> tuple[int, ...]:
    """What the gate counts in a text, as ``_COUNTS``."""
    lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip(_SPACE)]
    letters = len(text) - len(text.encode().translate(None, _KEPT)) if text.isascii() else len(_OTHER.sub("", text))
    few = sum(_HASH.match(x.strip(" ")) is not None for x in lines) if len(lines) < LEAST_LINES else 0
    return (
        len(lines), len({_DIGITS.sub("#", x[:120]) for x in lines}), sum(_TIME.match(x) is not None for x in lines), sum(_DUMP.match(x) is not None for x in lines),
        len(_HEX.findall(text)), len(_BASE64.findall(text)), letters, len(text), few,
    )


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS]))
def _counts(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in it:
        rows = [counts_of(t) if t is not None else (None,) * len(_COUNTS) for t in texts]
        yield pd.DataFrame(rows, columns=_COUNTS).astype("Int64")


def sample_of(text: Column, size: int = SAMPLE, least: int = LEAST_LINES) -> Column:
    """The first ``size`` characters; eight times as many while they hold fewer than ``least`` non-blank lines."""
    out = text
    for k in (3, 2, 1, 0):
        part = F.substring(text, 1, size * 8**k)
        enough = (F.size(F.filter(F.split(part, r"\r\n|\r|\n"), lambda x: x.rlike(r"\S"))) >= least) | (F.length(text) <= size * 8**k)
        out = F.when(enough, part).otherwise(out)
    return out


def assess(text: Column, sample: Column | None = None) -> Column:
    """``machine``, the number of lines, and the signals rounded to three places, half to even (null for short texts).

    Judged is ``sample_of(text)``, a beginning of the text, as the gate's rule has it; pass the text itself as
    ``sample`` to judge all of it. ``reasons`` names the signals beyond their limits.
    """
    found = _counts(sample_of(text) if sample is None else sample)
    n, chars = found["lines"], found["chars"]
    per = lambda c: F.try_divide(found[c].cast("double"), n.cast("double"))
    signal = {"repetition": 1 - per("shapes"), "timestamped": per("timestamped"), "dumpish": per("dumpish"), "hex_per_line": per("hex"), "base64_per_line": per("base64")}
    alpha = F.try_divide(found["letters"].cast("double"), chars.cast("double"))
    judged = n >= LEAST_LINES
    over = {**{k: signal[k] > v for k, v in LIMITS.items()}, "alpha_ratio": alpha < ALPHA}
    decisive = F.lit(False)
    for k, v in DECISIVE.items():
        decisive = decisive | (signal[k] > v)
    machine = F.when(judged, decisive | (sum((x.cast("int") for x in over.values()), F.lit(0)) >= 2)).otherwise(F.coalesce(per("hashes") > 0.8, F.lit(False)) & (n > 0))
    reasons = F.when(judged, F.array_compact(F.array(*[F.when(x, k) for k, x in over.items()])))
    return F.struct(
        F.coalesce(machine, F.lit(False)).alias("machine"), n.cast("int").alias("lines"),
        *[F.when(judged, F.bround(signal[k], 3)).alias(k) for k in signal], F.when(judged, F.bround(alpha, 3)).alias("alpha_ratio"), reasons.alias("reasons"),
    )
