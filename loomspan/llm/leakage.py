"""Evaluation passages inside a training corpus.

Words become templates (numbers, names and units turn into typed placeholders), every window of ten template
words is hashed, and document windows are hash-joined with item windows. A window with few plain words is joined
by its own words instead, as a template of little but placeholders would meet all others of its kind. Each
window also carries a hash of its own words and the hashes of what stands in its slots: equal words are an exact
leak, slots that differ but map one to one a re-parameterised item. A template is a function of the folded word
alone, so equal words always meet in the join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import xxhash

from loomspan.llm.words import with_own_words, words

WINDOW = 10
#: A window must hold this many plain words to be joined by its template; others are joined by their own words.
LEAST_PLAIN = 6
#: Item windows (16 bytes each) that may travel to every task; beyond, document windows are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Names of items that may travel to every task (about 60 bytes each); of more, each text gets those it holds by a join.
NAMES = 200_000
#: Units that stand for one placeholder.
UNITS = frozenset("kg g mg lb oz km m cm mm mi ft in l ml s ms min h hr hrs kb mb gb tb euro euros dollar dollars pound pounds meter meters metre metres kilometre kilometres kilometer kilometers gram grams kilogram kilograms litre litres liter liters second seconds minute minutes hour hours day days week weeks month months year years percent coin coins tag tage tagen stunde stunden jour jours heure heures dia dias hora horas dag dagen uur".split())
_BASE, _OWN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)
_NAME = re.compile(r"(?<=[\w,;:] )[^\W\d_a-zß-öø-ÿ][^\W\d_]+")
_ROWS = "id long, pos int, window_hash long, exact_hash long, slots array<long>"
_NUMBER, _UNIT, _PERSON = (np.uint64(xxhash.xxh64_intdigest(k)) for k in ("\0number", "\0unit", "\0name"))


def names_in(texts: list[str]) -> set[str]:
    """Folded words that stand capitalised inside a sentence of these texts."""
    return {w for t in texts for m in _NAME.findall(t) if not m[0].islower() for w in words(m)}


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


class Templates:
    """Hashes of words as templates, remembered by word."""

    def __init__(self, names: set[str]):
        self.names, self.known = names, {}

    def _hash(self, word: str) -> int:
        if word.isdigit() or word[0].isdigit():
            return int(_NUMBER)
        return int(_UNIT) if word in UNITS else int(_PERSON) if word in self.names else word_hash(word)

    def hashes(self, tokens: list[str], own: frozenset | None = None) -> np.ndarray:
        """``own``: names of this text alone, which are not remembered."""
        known = self.known
        if len(known) > 2_000_000:
            known.clear()
        try:
            out = np.array([known[w] for w in tokens], np.uint64)
        except KeyError:
            for w in tokens:
                if w not in known:
                    known[w] = self._hash(w)
            out = np.array([known[w] for w in tokens], np.uint64)
        if own:
            named = np.array([w in own for w in tokens], bool)
            out[named & (out != _NUMBER) & (out != _UNIT)] = _PERSON
        return out


def window_hashes(h: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Hash of each run of ``width`` hashes of words."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = out * _BASE + h[k : k + len(out)]
    out ^= out >> np.uint64(29)
    return out.view(np.int64)


class Windows:
    """The windows of one text: ``joined`` by template or own words. Hashes of own words are made where a window needs them."""

    def __init__(self, tokens: list[str], template: np.ndarray, width: int):
        self.tokens, self.template, self.width, self._exact = tokens, template, width, None
        self.joined = window_hashes(template, width)
        if not len(self.joined):
            return
        self.slot = (template == _NUMBER) | (template == _UNIT) | (template == _PERSON)
        held = np.cumsum(self.slot)
        slots = held[width - 1 :].copy()
        slots[1:] -= held[:-width]
        few = slots > width - min(LEAST_PLAIN, width)
        if few.any():
            self.joined = np.where(few, (self.exact().view(np.uint64) ^ _OWN).view(np.int64), self.joined)

    def exact(self) -> np.ndarray:
        if self._exact is None:
            self.own = self.template.copy()
            self.own[self.slot] = [word_hash(self.tokens[i]) for i in np.flatnonzero(self.slot).tolist()]
            self._exact = window_hashes(self.own, self.width)
        return self._exact

    def slots(self, at: int) -> list[int]:
        self.exact()
        marks = self.slot[at : at + self.width]
        return self.own[at : at + self.width][marks].view(np.int64).tolist() if marks.any() else []


def _windows(df: DataFrame, names: set[str], wanted: np.ndarray | None, width: int) -> DataFrame:
    """Windows of each text (columns id, text and, where names do not travel, own); of ``wanted`` hashes only, where given."""
    spread = "own" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(names)
        if wanted is not None:  # one bit for each of 2^22 low ends: most windows stop here
            low = np.zeros(1 << 22, bool)
            low[wanted & np.int64((1 << 22) - 1)] = True
        for batch in batches:
            ids, at, joined, exact, slots = [], [], [], [], []
            owns = batch.column("own").to_pylist() if spread else [None] * batch.num_rows
            for key, text, own in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), owns):
                if not text:
                    continue
                tokens = words(text)
                w = Windows(tokens, templates.hashes(tokens, frozenset(own) if own else None), width)
                h = w.joined
                hits = np.arange(len(h))
                if wanted is not None:
                    hits = np.flatnonzero(low[h & np.int64((1 << 22) - 1)])
                    if len(hits):
                        place = np.minimum(np.searchsorted(wanted, h[hits]), len(wanted) - 1)
                        hits = hits[wanted[place] == h[hits]]
                ids += [key] * len(hits)
                at += hits.tolist()
                joined += h[hits].tolist()
                if not len(hits):
                    continue
                exact += w.exact()[hits].tolist()
                slots += [w.slots(i) for i in hits.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(joined, pa.int64()), pa.array(exact, pa.int64()), pa.array(slots, pa.list_(pa.int64()))], ["id", "pos", "window_hash", "exact_hash", "slots"])

    return df.mapInArrow(run, _ROWS)


def _names(items: DataFrame, most: int) -> set[str] | DataFrame:
    """Names of all items: a set, or above ``most`` a table (column word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(names_in([t for t in batch.column("text").to_pylist() if t])), pa.string())], ["word"])

    found = items.select("text").mapInArrow(run, "word string").distinct()
    rows = found.limit(most + 1).collect()
    return {r.word for r in rows} if len(rows) <= most else found


def leaks(docs: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", width: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_names: int = NAMES) -> DataFrame:
    """Documents that share windows with items: ``doc_id, item_id, kind, windows, first_pos``.

    kind is ``exact`` where at least one window is word for word the same, else ``reparameterised`` (only
    slots differ, one to one). Null, empty and short texts (under ``width`` words) give no rows; repeated rows
    count once, as do ties between windows. Of the items the driver reads the names, up to
    ``broadcast_names``, and the window hashes, up to ``broadcast_windows``; more are joined by a shuffle, with
    the same result.
    """
    queries = items.select(F.col(item_key).cast("long").alias("id"), F.col(text).alias("text")).distinct()
    corpus = docs.select(F.col(doc_key).cast("long").alias("id"), F.col(text).alias("text"))
    names = _names(queries, broadcast_names)
    if isinstance(names, DataFrame):
        queries, corpus, names = with_own_words(queries, "text", words, names), with_own_words(corpus, "text", words, names), set()
    item_windows = _windows(queries, names, None, width).select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "window_hash", F.col("exact_hash").alias("item_exact"), F.col("slots").alias("item_slots"))
    hashes = [r.window_hash for r in item_windows.select("window_hash").distinct().limit(broadcast_windows + 1).collect()]
    small = len(hashes) <= broadcast_windows
    if not hashes:
        wanted = np.array([0], np.int64)
    else:
        wanted = np.sort(np.array(hashes, np.int64)) if small else None
    found = _windows(corpus, names, wanted, width).withColumnRenamed("id", "doc_id")
    pairs = found.join(F.broadcast(item_windows) if small else item_windows, "window_hash")
    exact = F.col("exact_hash") == F.col("item_exact")
    kinds = [F.size(F.array_distinct(x)) for x in ("slots", "item_slots")]
    one_to_one = (F.size("slots") == F.size("item_slots")) & (kinds[0] == kinds[1]) & (F.size(F.array_distinct(F.arrays_zip("slots", "item_slots"))) == kinds[0])
    judged = pairs.withColumn("exact", exact).where(F.col("exact") | one_to_one)
    return judged.groupBy("doc_id", "item_id").agg(F.when(F.max("exact"), "exact").otherwise("reparameterised").alias("kind"), F.countDistinct("pos").cast("long").alias("windows"), F.min("pos").alias("first_pos"))
