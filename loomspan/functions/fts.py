"""Full-text search: words, English stems, query syntax and ranks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English stop words of full-text search, and word endings of the public Snowball stemmer.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
_STEP2 = [("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_AS_IS = frozenset("sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed".split())


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in "aeiouy" and w[i - 1] in "aeiouy":
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), after(0))
    return r1, after(r1)


def _short(w: str) -> bool:
    if len(w) == 2:
        return w[0] in "aeiouy" and w[1] not in "aeiouy"
    return len(w) > 2 and w[-3] not in "aeiouy" and w[-2] in "aeiouy" and w[-1] not in "aeiouywxY"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """English stem by the published Snowball rules."""
    if len(word) < 3 or not word.isascii():
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _AS_IS:
        return word
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word.lstrip("'"))
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _AS_IS:
        return w
    if w.endswith(("eedly", "eed")):
        end = 5 if w.endswith("eedly") else 3
        if len(w) - end >= r1:
            w = w[: len(w) - end] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), "")
        if end and re.search("[aeiouy]", w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                w = w[:-1]
            elif _short(w) and r1 >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in set("cdeghkmnrt"):
            w = w[:-2]
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def tokens(text: Column) -> Column:
    """Words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    stop = frozenset(STOP)
    for s in it:
        yield s.map(lambda ws: None if ws is None else [("" if w in stop else stem(w)) for w in ws])


def lexemes(text: Column) -> Column:
    """Stems at their positions; stop words leave an empty place, so positions stay."""
    return _stems(tokens(text))


def postings(df, key: str, words: Column):
    """``key, lexeme, n, first``: how often each lexeme stands in a text and where first."""
    flat = df.select(key, F.posexplode(words).alias("at", "lexeme")).where("lexeme <> ''")
    return flat.groupBy(key, "lexeme").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def build_index(df, key: str, text: str):
    """``word, key, n``: how often each word stands in each text, ordered by word, so that a stored index is read only where a query's words are."""
    counts = df.select(F.col(key).alias("key"), F.explode(tokens(F.col(text))).alias("word")).groupBy("word", "key").agg(F.count("*").alias("n"))
    return counts.repartitionByRange("word", "key").sortWithinPartitions("word", "key")


def look_up(index, wanted: list[str]):
    """``key, hits``: texts that hold a wanted word, and how many of them they hold."""
    return index.where(F.col("word").isin(*wanted)).groupBy("key").agg(F.sum("n").cast("int").alias("hits"))


def positive_words(parsed: list[list[tuple[bool, list[str]]]]) -> list[str]:
    """The words one of which every match of a parsed query holds."""
    return sorted({w for terms in parsed for negated, ws in terms if not negated for w in ws})


def stemmed_counts(df, key: str, text: str, wanted: list[str]):
    """``key, rank`` of texts that hold a word of a wanted stem: for each stem the sum of 1/i^2 over its occurrences, scaled, averaged.

    Words are counted a text; distinct words are stemmed once and those of the wanted stems, a few forms, joined back.
    """
    counts = df.select(F.col(key).alias("_key"), F.explode(tokens(F.col(text))).alias("word")).groupBy("_key", "word").agg(F.count("*").alias("n"))

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stop, asked = frozenset(STOP), frozenset(wanted)
        for b in batches:
            stem_of = [("" if w in stop else stem(w)) for w in b["word"]]
            out = pd.DataFrame({"word": b["word"], "stem": stem_of})
            yield out[out["stem"].isin(asked)]

    forms = df.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("word")).distinct().mapInPandas(stems, "word string, stem string")
    limit = 1.64493406685
    per = counts.join(forms, "word").groupBy("_key", "stem").agg(F.sum("n").alias("n"))
    part = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / (i * i).cast("double")) / limit
    return per.groupBy("_key").agg((F.sum(part) / float(len(wanted))).alias("rank")).withColumnRenamed("_key", key)


def occurrences(words: Column, wanted: list[str]) -> Column:
    """Positions that hold one of the wanted words: the rank of an OR query by covers."""
    return F.size(F.filter(words, lambda w: w.isin(*wanted)))


def rank(words: Column, wanted: list[str]) -> Column:
    """Frequency rank: for each word sum of 1/i^2 over its occurrences, scaled, averaged over the query."""
    limit = 1.64493406685
    parts = []
    for w in wanted:
        n = occurrences(words, [w])
        parts.append(F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / (i * i).cast("double")) / limit).otherwise(0.0))
    return sum(parts[1:], parts[0]) / float(len(wanted))


def parse(query: str) -> list[list[tuple[bool, list[str]]]]:
    """A web-style query: alternatives of terms, each (negated, words); quotes make phrases, - negates, or separates.

    Without such syntax all words are alternatives of each other.
    """
    plain = re.findall(r"[^\W_]+", query.lower())
    if not re.search(r'"|\s(?:or|OR)\s|(?:^|\s)-', query):
        return [[(False, [w])] for w in plain]
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for neg, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        words = re.findall(r"[^\W_]+", (phrase or word).lower())
        if not phrase and word.lower() == "or":
            out.append([])
        elif words:
            out[-1].append((neg == "-", words))
    return [x for x in out if x]


def matches(words: Column, parsed: list[list[tuple[bool, list[str]]]]) -> Column:
    """Whether a text's words satisfy a parsed query."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    out = F.lit(False)
    for terms in parsed:
        every = F.lit(True)
        for negated, ws in terms:
            hit = line.contains(" " + " ".join(ws) + " ")
            every = every & (~hit if negated else hit)
        out = out | every
    return out
