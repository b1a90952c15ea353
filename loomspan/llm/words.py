"""Words of a text: the longest runs of letters and digits after decomposition and case folding."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ASCII = re.compile(r"[a-z0-9]+")
_ANY = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1)
def _dropped() -> re.Pattern:
    """Combining marks and invisible format characters, as ranges."""
    ranges, start = [], None
    for point in range(0x110000):
        hit = unicodedata.category(chr(point)) in ("Mn", "Mc", "Me", "Cf")
        if hit and start is None:
            start = point
        elif not hit and start is not None:
            ranges.append((start, point - 1))
            start = None
    if start is not None:
        ranges.append((start, sys.maxunicode))
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]+")


def fold(text: str) -> str:
    """NFKD without combining marks and format characters, case folded."""
    if text.isascii():
        return text.lower()
    return _dropped().sub("", unicodedata.normalize("NFKD", text)).casefold()


def words(text: str) -> list[str]:
    folded = fold(text)
    return (_ASCII if folded.isascii() else _ANY).findall(folded)


def with_own_words(rows: DataFrame, text: str, words_of: Callable[[str], Iterable[str]], known: DataFrame) -> DataFrame:
    """Adds ``own``: those of the words of each text that the table ``known`` (column word) holds, null for none.

    Words of distinct texts are joined with the table, so it may be larger than what can travel to every task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(set(words_of(t))) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["_t", "words"])

    marked = rows.withColumn("_t", F.sha2(text, 256))
    texts = marked.where(F.col(text).isNotNull()).groupBy("_t").agg(F.first(text).alias("text"))
    asked = texts.mapInArrow(run, "_t string, words array<string>").select("_t", F.explode("words").alias("word"))
    own = asked.join(known.select("word").distinct(), "word").groupBy("_t").agg(F.collect_list("word").alias("own"))
    return marked.join(own, "_t", "left").drop("_t")
