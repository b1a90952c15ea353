"""Languages of documents and of their segments, by a linear-chain conditional random field.

Words are labelled with languages. A word's features are the word itself (the lexicon learned from the
sample), its first and last letters, its letter trigrams and its script; the weights of the features and of
the transitions between neighbouring words are learned by maximum likelihood. Forward-backward gives each
word's posteriors, from which sentences, segments and documents get a language and a confidence.

The model is fitted on at most ``TRAIN_DOCUMENTS`` labelled documents. Labels may be missing or wrong: after
a first fit the sample is labelled again by the model, and the transitions are learned from that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
import xxhash
from loomspan.llm.sampling import drawn

#: Labelled documents the field is fitted on, at most (about; drawn by hash).
TRAIN_DOCUMENTS = 4_000
#: Words of a training document that are used; longer ones give their first and go on to the next document.
TRAIN_WORDS = 400
LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "ru", "ja")
BUCKETS = 1 << 18
#: Words a whole sentence has at least (characters for scripts without spaces).
LEAST_WORDS, LEAST_WIDE = 3, 5
#: Weight that a sentence's language must have among the posteriors of its words.
LEAST_SHARE = 0.6
#: Weight of a word's own feature from which it belongs to a language's lexicon; a sentence needs two such words.
LEXICON_WEIGHT, LEAST_LEXICON = 0.15, 2

# Names and codes of languages (ISO 639), and codes that name none.
NAMES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french francais français", "es": "es spa spanish espanol español castellano", "pt": "pt por portuguese portugues português",
    "nl": "nl nld dut dutch nederlands", "ru": "ru rus russian русский", "ja": "ja jpn jp japanese 日本語",
}
NO_LANGUAGE = ("", "und", "unknown", "xx", "xxx", "n/a", "na", "none", "null", "zxx", "mul", "mis", "unk", "?", "-", "other", "undefined", "undetermined")
_CODES = {w: code for code, ws in NAMES.items() for w in ws.split()}

#: Where no spaces part the words, short runs of one script stand for them.
_WORD = re.compile(r"[぀-ゟ]{1,4}|[゠-ヿー]{1,8}|[㐀-鿿々]{1,4}|[Ѐ-ӿ]+|(?:(?![぀-ヿ㐀-鿿々ーЀ-ӿ])[^\W\d_])+(?:['’](?:(?![぀-ヿ㐀-鿿Ѐ-ӿ])[^\W\d_])+)?")
#: The same for text without those scripts, which needs no look ahead at every letter.
_LATIN_WORD, _OTHER_SCRIPT = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?"), re.compile("[぀-ヿ㐀-鿿々Ѐ-ӿ]")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'»”’)\]*_]*[ \t ]+|(?<=[。！？])|\s*[\r\n]+\s*")
_WHOLE = re.compile(r"[.!?…。！？][\"'»”’)\]*_]*\s*$")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
_SPEAKER = re.compile(r"^\[[\d:T. /-]{4,25}\]\s*[^:\n]{1,40}:\s*|^\s*(?:[#>*-]+\s+|\d+[.)]\s+)+")


def label_of(tag: Column) -> Column:
    """The code a label stands for: null for none, "other" for a language not in ``LANGUAGES``."""
    plain = F.lower(F.regexp_replace(F.coalesce(tag, F.lit("")), r"(?U)^\s+|\s+$", ""))
    base = F.when(plain.isin(*_CODES), plain).otherwise(F.regexp_extract(plain, r"^([^-_@.]+)", 1))
    known = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return F.when(plain.isin(*NO_LANGUAGE), None).otherwise(F.coalesce(F.element_at(known, base), F.lit("other")))


def features(word: str) -> list[int]:
    """Feature buckets of a word."""
    if _WIDE.match(word):
        grams = {word[i : i + 2] for i in range(min(len(word), 12) - 1)} or {word}
        kinds = ["script wide", "kana" if re.search(r"[぀-ヿ]", word) else "han"] + ["w2" + g for g in grams]
    else:
        padded = f"^{word}$"
        kinds = ["word " + word] + [f"<{word[:k]}" for k in (1, 2, 3)] + [f"{word[-k:]}>" for k in (1, 2, 3)] + sorted({padded[i : i + 3] for i in range(min(len(padded), 24) - 2)})
        kinds.append("script " + ("cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "latin" if word.isascii() else "marked"))
    return [xxhash.xxh32_intdigest(k) & (BUCKETS - 1) for k in kinds]


def sentences(text: str) -> list[str]:
    return [s for s in _SPLIT.split(text) if s and not s.isspace()]


def words(sentence: str) -> list[str]:
    plain = _SPEAKER.sub("", sentence).lower()
    return (_WORD if not plain.isascii() and _OTHER_SCRIPT.search(plain) else _LATIN_WORD).findall(plain)


class Field:
    """The conditional random field: weights by feature bucket and language, and transition scores."""

    def __init__(self, languages=LANGUAGES):
        self.languages = list(languages)
        k = len(self.languages)
        self.weights = np.zeros((BUCKETS, k), np.float32)
        self.trans = np.full((k, k), -2.0) + np.eye(k) * 2.0
        self.start = np.zeros(k)

    # fitting ------------------------------------------------------------------------------------------
    def fit(self, sequences: list[list[str]], labels: list[np.ndarray], rounds: int = 15, rate: float = 0.5, chained: bool = True) -> None:
        """Maximum likelihood by Adagrad; a sequence's labels are one language a word.

        Unchained, words are taken without their neighbours, so the counts of each word's labels say all.
        """
        vocab: dict[str, int] = {}
        coded = [np.array([vocab.setdefault(w, len(vocab)) for w in s]) for s in sequences]
        lists = [features(w) for w in vocab]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        bucket, inverse = np.unique(np.concatenate([np.array(x) for x in lists]) if lists else np.zeros(0, int), return_inverse=True)
        k = len(self.languages)
        w = self.weights[bucket].astype(np.float64)
        seen_w, seen_t = np.full_like(w, 1e-2), np.full((k, k), 1e-2)
        norm = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(lists))))
        order = np.argsort([len(c) for c in coded], kind="stable")
        groups = []
        if not chained:
            told = np.bincount(np.concatenate(coded) * k + np.concatenate(labels), minlength=len(lists) * k).reshape(-1, k).astype(float)
            order = order[:0]
        for g in range(0, len(order), 256):
            part = [i for i in order[g : g + 256] if len(coded[i])]
            if part:
                groups.append(_padded([coded[i] for i in part]) + (_padded([labels[i] for i in part])[0],))
        for _ in range(rounds):
            emit = np.stack([np.bincount(owner, w[inverse, j], len(lists)) for j in range(k)], 1) * norm[:, None]
            grad, grad_t = np.zeros_like(emit), np.zeros((k, k))
            if not chained:
                p = np.exp(emit - emit.max(1, keepdims=True))
                grad = told - told.sum(1, keepdims=True) * p / p.sum(1, keepdims=True)
            for at, mask, gold in groups:
                post, pairs = self._posteriors(emit[at], mask, True)
                diff = np.eye(k)[gold] - post
                flat, keep = at[mask], diff[mask]
                for j in range(k):
                    grad[:, j] += np.bincount(flat, keep[:, j], len(emit))
                both = mask[:, 1:] & mask[:, :-1]
                grad_t += np.bincount((gold[:, :-1] * k + gold[:, 1:])[both], minlength=k * k).reshape(k, k) - pairs
            grad *= norm[:, None]
            step = np.stack([np.bincount(inverse, grad[owner, j], len(bucket)) for j in range(k)], 1) - 0.02 * w
            seen_w += step**2
            w += rate * step / np.sqrt(seen_w)
            if chained:
                grad_t -= 0.5 * self.trans
                seen_t += grad_t**2
                self.trans += rate * grad_t / np.sqrt(seen_t)
                self.trans = np.clip(self.trans, -7, 4)
        self.weights[bucket] = w

    def scores(self, vocabulary: list[str]) -> np.ndarray:
        """Emission scores of words; words never seen get what their affixes and trigrams say."""
        lists = [features(w) for w in vocabulary]
        if not lists:
            return np.zeros((0, len(self.languages)), np.float32)
        sizes = np.array([len(x) for x in lists])
        flat = self.weights[np.concatenate([np.array(x) for x in lists])]
        return np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / np.sqrt(sizes)[:, None]

    def lexicon(self, vocabulary: list[str]) -> np.ndarray:
        """Which words speak for which language by themselves: by the lexicon, or by a script of its own."""
        out = np.zeros((len(vocabulary), len(self.languages)))
        own = self.weights[[xxhash.xxh32_intdigest("word " + w) & (BUCKETS - 1) for w in vocabulary]] if vocabulary else out
        top = np.sort(own, axis=1)[:, -1:] if len(vocabulary) else own
        out[(own >= top - 0.05) & (own > LEXICON_WEIGHT)] = 1
        for code, script in (("ja", _WIDE), ("ru", re.compile("[Ѐ-ӿ]"))):
            if code in self.languages:
                out[[i for i, w in enumerate(vocabulary) if script.match(w)], self.languages.index(code)] = 2
        return out

    # inference ----------------------------------------------------------------------------------------
    def _posteriors(self, emit: np.ndarray, mask: np.ndarray, with_pairs: bool = False):
        """Forward-backward over padded sequences (n, t, languages); and the expected transitions."""
        n, t, k = emit.shape
        e = np.exp(emit - emit.max(2, keepdims=True))
        a = np.exp(self.trans)
        alpha, beta = np.empty((t, n, k), e.dtype), np.empty((t, n, k), e.dtype)
        cur = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        alpha[0] = cur
        for i in range(1, t):
            nxt = (cur @ a) * e[:, i]
            nxt /= nxt.sum(1, keepdims=True)
            cur = np.where(mask[:, i, None], nxt, cur)
            alpha[i] = cur
        cur = np.full((n, k), 1.0 / k)
        beta[t - 1] = cur
        for i in range(t - 2, -1, -1):
            nxt = (e[:, i + 1] * cur) @ a.T
            nxt /= nxt.sum(1, keepdims=True)
            cur = np.where(mask[:, i + 1, None], nxt, cur)
            beta[i] = cur
        post = (alpha * beta).transpose(1, 0, 2)
        post /= post.sum(2, keepdims=True)
        if not with_pairs:
            return post
        pairs = np.zeros((k, k))
        for i in range(t - 1):
            live = mask[:, i + 1]
            if live.any():
                x = alpha[i][live][:, :, None] * a[None] * (e[live, i + 1] * beta[i + 1][live])[:, None, :]
                pairs += (x / x.sum((1, 2), keepdims=True)).sum(0)
        return post, pairs

    def label(self, sequences: list[np.ndarray], emit: np.ndarray, most: int = 1 << 19) -> list[np.ndarray]:
        """Posteriors of each word of each sequence of word numbers."""
        out: list[np.ndarray] = [np.zeros((0, len(self.languages)))] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: len(sequences[i]))
        s = 0
        while s < len(order):
            e = s + 1
            while e < len(order) and (e - s + 1) * len(sequences[order[e]]) <= most and e - s < 512:
                e += 1
            at, mask = _padded([sequences[i] for i in order[s:e]])
            post = self._posteriors(emit[at], mask)
            for row, i in enumerate(order[s:e]):
                out[i] = post[row, : len(sequences[i])]
            s = e
        return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, rows))
    at, mask = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), bool)
    for i, r in enumerate(rows):
        at[i, : len(r)] = r
        mask[i, : len(r)] = True
    return at, mask


def fit(texts: list[str], labels: list[str], languages=LANGUAGES) -> Field | None:
    """A field from texts and their (partly wrong) labels; null where no text has words."""
    place = {c: i for i, c in enumerate(languages)}
    sequences, gold = [], []
    for text, label in zip(texts, labels):
        tokens = [w for s in sentences(text or "") for w in words(s)][:TRAIN_WORDS]
        if tokens and label in place:
            sequences.append(tokens)
            gold.append(np.full(len(tokens), place[label]))
    if not sequences:
        return None
    first = Field(languages)
    first.fit(sequences, gold, rounds=25, chained=False)
    # label the sample again: whole sentences take the language their words speak for
    vocab: dict[str, int] = {}
    coded = [np.array([vocab.setdefault(w, len(vocab)) for w in s]) for s in sequences]
    again = [p.argmax(1) for p in first.label(coded, first.scores(list(vocab)))]
    field = Field(languages)
    field.weights = first.weights
    field.fit(sequences, again)
    return field


def judge(texts: list[str], field: Field) -> list[list[tuple[int, int, int, float, bool, int]]]:
    """Per text its sentences as (start word, end word, language, confidence, whole, letters); language -1 where no word speaks."""
    vocab: dict[str, int] = {}
    sequences, cuts = [], []
    number = vocab.setdefault
    for text in texts:
        codes: list[int] = []
        marks = []
        for s in sentences(text or ""):
            tokens = words(s)
            if tokens:
                wide = not s.isascii() and _WIDE.search(s) is not None and any(_WIDE.match(w) for w in tokens)
                enough = len(tokens) >= LEAST_WORDS or (wide and sum(len(w) for w in tokens if _WIDE.match(w)) >= LEAST_WIDE)
                marks.append((len(codes), len(codes) + len(tokens), enough and _WHOLE.search(s) is not None, len(s)))
                codes += [number(w, len(vocab)) for w in tokens]
        sequences.append(np.array(codes, np.int64))
        cuts.append(marks)
    emit = field.scores(list(vocab)).astype(np.float64)
    out = []
    lexicon = field.lexicon(list(vocab))
    lengths = np.array([len(w) for w in vocab], np.float64)
    for codes, marks, post in zip(sequences, cuts, field.label(sequences, emit)):
        rows = []
        if marks:
            weight = np.where(lengths[codes] > 8, np.sqrt(lengths[codes] / 8), 1.0)[:, None]
            sums = np.add.reduceat(post * weight, [m[0] for m in marks], axis=0)
            shares = sums / sums.sum(1, keepdims=True)
            known = np.add.reduceat(lexicon[codes], [m[0] for m in marks], axis=0)
            for (a, b, whole, size), share, spoken in zip(marks, shares, known):
                best = int(share.argmax())
                sure = share[best] >= LEAST_SHARE and spoken[best] >= LEAST_LEXICON and spoken[best] == spoken.max()
                rows.append((a, b, best, float(share[best]), whole and sure, size))
        out.append(rows)
    return out


_DOC = "key long, label string, languages array<string>, main string, confidence double, segments array<struct<language:string,sentences:int,letters:int,confidence:double>>"


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tag: str = "lang", train_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """Languages of every document with text.

    Columns: key, ``label`` (what the given tag stands for, null for none), ``languages`` (those with a whole
    sentence; where no sentence is whole, the main one), ``main`` and ``confidence``, ``segments`` (runs of
    sentences in one language, in order). Blank and null texts give no rows; texts without a word get an
    empty ``languages``. A repeated row is judged again alike; other columns are ignored.
    """
    blank = F.coalesce(~F.col("text").rlike(r"(?U)[^\s]"), F.lit(True))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), label_of(F.col(tag)).alias("label")).where(~blank)
    taught = rows.where(F.col("label").isin(*LANGUAGES))
    counts = {r.label: r.n for r in taught.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a language
    all_, least = sum(counts.values()), train_documents // (2 * len(LANGUAGES))  # half in proportion, half alike
    quota = {c: max(least, train_documents // 2 * n // all_) for c, n in counts.items()}
    share = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(min(1.0, quota[c] / n)))]) if counts else None
    sample = taught.where(drawn(F.element_at(share, F.col("label")), 5, "key")).limit(2 * train_documents).select("label", F.substring("text", 1, TRAIN_WORDS * 12).alias("text")).toArrow().to_pydict() if counts else {"text": [], "label": []}
    order = np.argsort([xxhash.xxh64_intdigest(t) for t in sample["text"]], kind="stable")  # the same whatever order rows arrive in
    field = fit([sample["text"][i] for i in order], [sample["label"][i] for i in order])
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                langs, mains, sure, segments = [], [], [], []
                for rows_ in judge(part.column("text").to_pylist(), field) if field else [[]] * part.num_rows:
                    names = field.languages if field else []
                    weight: dict[int, list[float]] = {}
                    runs: list[list] = []
                    for _, _, best, share, _, size in rows_:
                        got = weight.setdefault(best, [0.0, 0])
                        got[0] += share * size
                        got[1] += size
                        if runs and runs[-1][0] == best:
                            runs[-1][1] += 1
                            runs[-1][2] += size
                            runs[-1][3] += share * size
                        else:
                            runs.append([best, 1, size, share * size])
                    main = max(weight, key=lambda b: (weight[b][1], -b), default=-1)
                    found = sorted({names[r[2]] for r in rows_ if r[4]}) or ([names[main]] if main >= 0 else [])
                    langs.append(found)
                    mains.append(names[main] if main >= 0 else None)
                    sure.append(weight[main][0] / weight[main][1] if main >= 0 else 0.0)
                    segments.append([{"language": names[b], "sentences": n, "letters": size, "confidence": s / size} for b, n, size, s in runs])
                kind = pa.list_(pa.struct([("language", pa.string()), ("sentences", pa.int32()), ("letters", pa.int32()), ("confidence", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array(langs, pa.list_(pa.string())), pa.array(mains, pa.string()), pa.array(sure, pa.float64()), pa.array(segments, kind)], ["key", "label", "languages", "main", "confidence", "segments"])

    return rows.select("key", "label", "text").mapInArrow(lambda it: run(_only(it)), _DOC).withColumnRenamed("key", key)


def _only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield batch


def wrong_labels(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """From ``identify``: ``key, lang`` for documents whose label is missing or wrong, or that mix languages."""
    off = F.col("label").isNull() | (F.size("languages") > 1) | ~F.array_contains("languages", F.coalesce("label", F.lit("")))
    return found.where(off).select(key, F.explode("languages").alias("lang"))
