"""Personal information inside free text, replaced by typed placeholders.

A chain of transducers rewrites a text into a plain form: full-width and look-alike letters, odd spaces and
dashes, invisible characters, digits spelled as words, and mail addresses written with "at" and "dot". Each
keeps the source offset of every character, so what the detectors find in the plain form is mapped back and
replaced in the text as it was written. An Aho-Corasick scan for the detectors' keywords decides which of
them look at a text at all; it covers every text to its end.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
#: Where detectors overlap, the earlier kind keeps the characters.
ORDER = ("email", "id_number", "phone", "address", "name")
#: Distinct names that may travel to every task (about 100 bytes each); of more, each text gets those whose words it holds by a join.
NAME_WORDS = 500_000

# Look-alike letters of other scripts, and digits as words.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABESIJKMHOPCTYXaesijopcyxdhgABEZHIKMNOPTYXoav"))
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
TITLES = "mr mrs ms miss dr prof herr frau mme m monsieur madame sr sra señor señora sir".split()
PARTICLES = "de von van der den del di da la le du dos ten ter zu".split()
STREETS = "street st road rd drive dr lane ln avenue ave row court ct close way place square terrace crescent gardens boulevard blvd parkway highway hill quay mews walk".split()
NUMBER_AFTER = frozenset("calle avenida rua plaza via viale".split())
STREET_ENDS = "straße strasse str. gasse allee weg platz damm ufer ring steig chaussee straat laan gracht plein kade".split()
STREET_STARTS = "rue avenue av. boulevard bd quai place chemin impasse allée route cours passage calle avenida plaza paseo carrera rua travessa praça via viale piazza".split()
BOXES = ("p.o. box", "po box", "p. o. box", "post office box", "postfach", "boîte postale", "apartado", "postbus", "casilla")
CUES = (
    "social security", "ssn", "national insurance", "ni number", "nino", "passport", "reisepass", "passeport", "pasaporte", "passaporte", "paspoort", "id card", "identity card", "identity number", "ausweis", "carte d'identité", "carte nationale",
    "driving licen", "driver's licen", "drivers licen", "driver licen", "führerschein", "permis de conduire", "rijbewijs", "carnet de conducir", "steuer", "tax number", "tax id", "tax no", "tin", "sécurité sociale", "securite sociale", "sozialversicherung", "versicherungsnummer",
    "dni", "nif", "nie", "nir", "bsn", "cpf", "itin", "utr", "identité", "seguridad social", "insurance no", "insurance number", "numéro fiscal", "паспорт", "инн", "снилс",
)
SHORT_CUES = ("dni", "nif", "nie", "nir", "bsn", "cpf", "itin", "utr", "tin", "nino")
#: Short street words count with what follows them only.
SHORT_STREETS = [w + c for w in ("st", "rd", "dr", "ln", "ave", "row", "ct", "way") for c in (".", ",", "\n", " apt", " flat")] + [" row", " way"]
TEL_WORDS = ("tel", "phone", "telefon", "téléphone", "fon", "mobil", "handy", "portable", "cell", "fax", "call me", "ruf", "joindre")
DISGUISES = ("dot", "punkt", "point", "punto", "ponto", "(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]", " @", "@ ")

_PLAIN = {}
for _c in [0xA0, 0x202F, 0x2007, 0x2009, 0x2002, 0x2003, 0x2008, 0x200A, 0x3000, 0x205F]:
    _PLAIN[_c] = " "
for _c in [0x2010, 0x2011, 0x2012, 0x2013, 0x2212, 0xFE63, 0xFF0D]:
    _PLAIN[_c] = "-"
for _c in range(0xFF01, 0xFF5F):
    _PLAIN[_c] = chr(_c - 0xFEE0)
_PLAIN |= {0x2019: "'", 0x02BC: "'"}
_INVISIBLE = {c: None for c in [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x200E, 0x200F, 0x061C]}
_ODD = re.compile("[" + "".join(map(chr, _PLAIN)) + "]")
_HIDDEN = re.compile("[" + "".join(map(chr, _INVISIBLE)) + "]")
_MIXED = re.compile("[^\\W_]*[" + "".join(LOOKALIKES) + "][^\\W_]*")
_LOOK = str.maketrans(LOOKALIKES)
_NOT_LATIN = re.compile("[Ѐ-ӿͰ-Ͽ]")
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:(?:double|triple|doppel)[ -])?(?:{_WORDS})(?:(?:[ ,.-]|, )+(?:(?:double|triple|doppel)[ -])?(?:{_WORDS}|\d+)\b){{3,}}", re.I)
_DOT = r"(?:\s*[\[({<]\s*(?:dot|punkt|point|punto|ponto)\s*[\])}>]\s*|\s+(?:dot|DOT|punkt|point|punto|ponto)\s+|\s*\.\s?)"
_DOT_PLAIN = re.compile(_DOT)
_DISGUISED = re.compile(rf"([\w+-]+(?:{_DOT}[\w+-]+)*?)(\s*[\[({{<]\s*(?:at|ät|AT|arroba|@|chez)\s*[\])}}>]\s*|\s+(?:at|AT|arroba|ät)\s+|\s+@\s*|\s*@\s+)((?:[\w-]+{_DOT}){{1,4}}[A-Za-z]{{2,}})\b")


class Text:
    """A plain form and, where they differ, the source offset of each of its characters."""

    def __init__(self, source: str):
        self.source, self.plain, self.at = source, source, None

    def rewrite(self, pattern: re.Pattern, change) -> None:
        """Replaces each match by ``change(match)`` (a string, or null to leave it); offsets follow."""
        out, at, last = [], [], 0
        for m in pattern.finditer(self.plain):
            new = change(m)
            if new is None or new == m[0]:
                continue
            a, b = m.span()
            before = range(last, a) if self.at is None else self.at[last:a]
            places = range(a, b) if self.at is None else self.at[a:b]
            out += [self.plain[last:a], new]
            n = len(new)
            at += [*before, *(places[-1] if i == n - 1 else places[min(i * len(places) // n, len(places) - 1)] for i in range(n))]
            last = b
        if out:
            out.append(self.plain[last:])
            at += range(last, len(self.plain)) if self.at is None else self.at[last:]
            self.plain, self.at = "".join(out), at

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Source offsets of a span of the plain form."""
        return (a, b) if self.at is None else (self.at[a], self.at[b - 1] + 1)


def _undo_mail(m: re.Match) -> str | None:
    if "@" in m[2] or re.search(r"[\[({<]", m[2]):
        pass
    elif not re.search(r"dot|punkt|point|punto|ponto", m[3], re.I):
        return None  # "at" as a word of the language
    plain = lambda s: re.sub(r"\s+", "", _DOT_PLAIN.sub(".", s))
    return plain(m[1]) + "@" + plain(m[3])


def _undo_digits(m: re.Match) -> str:
    def one(w: re.Match) -> str:
        times = {"double": 2, "doppel": 2, "triple": 3}.get((w[1] or "").lower().strip(" -"), 1)
        return (w[2] if w[2][0].isdigit() else str(DIGIT_WORDS[w[2].lower()])) * times

    d = re.sub(rf"(?:((?:double|triple|doppel)[ -]))?({_WORDS}|\d+)(?:[ ,.-]|, )*", one, m[0], flags=re.I)
    if not 7 <= len(d) <= 15:
        return d
    return " ".join([d[:-10], d[-10:-7], d[-7:-4], d[-4:]] if len(d) > 9 and d[0] != "0" else [d[:3], d[3:7], d[7:]]).strip()


def plain_form(source: str, spelled: bool = True, disguised: bool = True) -> Text:
    t = Text(source)
    if not source.isascii():
        if _ODD.search(source):
            t.plain = source.translate(_PLAIN)  # one to one
        if not unicodedata.is_normalized("NFC", t.plain):
            t.rewrite(re.compile(r"\w[̀-ͯ]+"), lambda m: unicodedata.normalize("NFC", m[0]))
        if _HIDDEN.search(t.plain):
            t.rewrite(_HIDDEN, lambda m: "")
        if _NOT_LATIN.search(t.plain):  # letters of another script inside Latin words only
            t.rewrite(_MIXED, lambda m: m[0].translate(_LOOK) if re.search(r"[A-Za-z0-9]", m[0]) else None)
    if spelled:
        t.rewrite(_SPELLED, _undo_digits)
    if disguised:
        t.rewrite(_DISGUISED, _undo_mail)
    return t


_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,24}\b")
_MAILBOX = frozenset(".+%'-_")

_SEP = r"[ .\-/]"
_EXT = r"(?:,?\s?(?:x|ext\.?|extension|Durchwahl|poste|-)\s?\d{1,5}\b)?"
_PHONE = re.compile(
    r"(?<![\w.,@#/-])(?:tel:)?(?:"
    rf"\+\d{{1,3}}(?:{_SEP}?\(\d{{1,4}}\)|{_SEP})?{_SEP}?\d(?:{_SEP}{{0,2}}[\d()]){{5,12}}"  # international
    rf"|00\d{{2}}(?:{_SEP}\d{{1,5}}){{2,6}}"
    rf"|\(0\){_SEP}?\d{{2,4}}(?:{_SEP}\d{{2,5}}){{1,4}}"
    rf"|(?:1{_SEP})?(?:\(\d{{3}}\){_SEP}?|\d{{3}}([ .-]))\d{{3}}[ .-]\d{{4}}"  # 3-3-4
    rf"|0\d{{2,4}}[ /-]\d{{2,5}}(?:[ -]\d{{2,5}}){{0,4}}"
    rf"|0[1-9](?:([ .-])\d\d)(?:\2\d\d){{3}}"
    rf"){_EXT}(?![\w#]|[.,:/-]\d)"
)
_TEL_CUE = re.compile(r"(?i)\b(?:tel|phone|telephone|telefon|téléphone|teléfono|fon|mobile|mobil|handy|portable|cell|fax|call me (?:on|at)|ruf(?: bitte)?(?: unter)?|joindre au)\b[^\w\n+(]{0,4}(?:no\.?|nr\.?|number|is)?[:. ]{0,3}(?<!\d)(\+?[\d(][\d ()./-]{5,18}\d)(?![\w]|[.,]\d)")
_CUE = re.compile(
    r"(?i:(?<!\w)(?:personal|reise|bundes|führer)?(?:" + "|".join(re.escape(c) + (r"\w*" if len(c) > 4 else "") for c in sorted(CUES, key=len, reverse=True)) + r")(?:[-\s_]+(?:card|licence|license|security|insurance|id|nr|nummer)\b)?"
    r"(?:[^\w\n]{0,4}\b(?:no|nr|num|number|numbers|numero|numéro|número|nummer|id|is|lautet|est|es|card|code)\b|[^\w\n]{0,3}[n№]°?\s?°?)*)"
    r"[^\w\n]{1,5}((?=[A-Z0-9 ./-]*\d[A-Z0-9 ./-]*\d)[A-Z0-9](?:[ ./-]?[A-Z0-9]){4,22})(?![a-z])"
)
#: Numbers whose shape alone tells an authority's number.
_ID_SHAPE = re.compile(r"(?<![\w.,/-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[12] \d{2} (?:\d{2}|2[AB]) \d{2} \d{3} \d{3} \d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{8}[TRWAGMYFPDXBNJZSQVHLCKE]|[XYZ]-?\d{7}-?[A-Z])(?![\w-]|[.,]\d)")
_TCAP = r"(?:[^\W\d_a-zß-öø-ÿ](?:[^\W\d_]|['’.-])*)"
_CAP = r"(?:[^\W\d_a-zß-öø-ÿ][\w'’.-]*)"
_TOWN = rf"(?:(?:\d{{4,5}}(?:-\d{{3,4}})?|[A-Z]{{1,2}}-\d{{4,5}})\s+)?{_TCAP}(?:[ -](?:{_TCAP}|(?:sur|am|an|der|de|la|les|sous|bei)\b))*(?:\s[A-Z]{{1,2}}\d[\dA-Z]?\s?\d[A-Z]{{2}}|\s\d{{5}}\b)?"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Wohnung|Appt)\.?\s?[\w-]{1,5},?\s+)?"
_TAIL = rf"(?:,?\s+(?:Apt|Flat|Unit|Suite|Wohnung|Appt)\.?\s?[\w-]{{1,5}})?(?:(?:,|,?\s+in)?\s+{_TOWN})?"
_ENDS = "|".join(re.escape(w) for w in STREET_ENDS)
_ADDRESS = re.compile(
    rf"(?<![\w.,#/:-])(?:{_UNIT}\d{{1,5}}[A-Za-z]?(?:[-/]\d{{1,4}})?,?\s+(?:{_CAP}\s+){{1,4}}?(?i:{'|'.join(STREETS)})\b\.?(?!\s+wing){_TAIL}"
    rf"|\d{{1,5}}(?:\s?(?:bis|ter|[A-Da-d]))?,?\s+(?i:{'|'.join(re.escape(w) for w in STREET_STARTS)})\s+(?:(?i:de|du|des|la|le|les|del|las|los|da|do|dos|l'|d')\s*)*{_CAP}(?:[\s-](?:(?i:de|du|des|la|le|les|del|d')\s*)*{_CAP}){{0,4}}{_TAIL}"
    rf"|(?:(?i:am|an der|im|auf dem|zum|zur|alte[rn]?|neue[rn]?|kleine|große|obere|untere)\s+|{_CAP}[\s-]){{0,3}}(?:[^\W\d_][\w-]*(?i:{_ENDS})|(?i:am|im|an der|auf der|unter den|zum|zur)\s+{_CAP})\s+\d{{1,4}}\s?[a-z]?\b(?:(?=,?\s|[.;'\"<)]|$)){_TAIL}"
    rf"|{_CAP}(?:\s{_CAP}){{0,3}}\s+\d{{1,4}}\s?[a-z]?(?:,|\s+in)\s+\d{{4,5}}\s+{_CAP}"
    rf"|(?i:calle|avenida|rua|plaza|via|viale|ул\.|улица)\s+{_CAP}(?:\s{_CAP}){{0,3}},?\s+(?:n[.º°]\s*)?\d{{1,4}}\b{_TAIL}"
    rf"|(?i:{'|'.join(re.escape(b) for b in BOXES)})\s*(?:no\.?|nr\.?)?\s*\d[\d ]{{0,6}}(?:,|\s+in|;)?\s+{_TOWN})"
)
_CEDEX = re.compile(r"\bB\.?P\.? \d{1,5},?\s+(?:\d{5}\s+)?" + _CAP)
_BETWEEN = r"(?:[ \t]+|[ \t]*\r?\n(?:[>|\s]|[A-Z]{2}>)*)"  # a line may end inside a name, also in quoted text
_TITLE = rf"(?:(?i:{'|'.join(TITLES)})\.?{_BETWEEN})?"
_AFTER = re.compile(rf"\s?,{_BETWEEN}?({_TITLE})([^\W\d_][\w'-]*)(\.?)")
_SECOND = re.compile(rf"{_BETWEEN}([^\W\d_]\.)")
_BEFORE = re.compile(rf"({_TITLE})(?<![\w.@-])([^\W\d_][\w'-]*)(\.?){_BETWEEN}((?:[^\W\d_]\.?{_BETWEEN})?)((?:(?i:{'|'.join(PARTICLES)}){_BETWEEN}){{0,2}})$")

# People who stand in no table: named after a title, before their mail address, or by themselves.
_NAME_WORD = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:['’-][A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+)*"
_FULL_NAME = rf"{_NAME_WORD}(?: [A-ZÀ-ÖØ-Þ]\.)? (?:(?:{'|'.join(PARTICLES)}) )*{_NAME_WORD}"
FORMAL = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Señor", "Señora", "Sr", "Sra")
INTRODUCED = ("my name is", "mein name ist", "ich heiße", "je m'appelle", "me llamo", "i am called", "mijn naam is", "meu nome é")
_IN_CONTEXT = re.compile(rf"(?<!\w)(?:(?:{'|'.join(FORMAL)})\.? {_FULL_NAME}|{_FULL_NAME}(?= <[^<>\s]+@)|(?i:{'|'.join(INTRODUCED)}) ({_FULL_NAME}))")


def fold_name(word: str) -> str:
    """A name word without case and marks (ø and ß too)."""
    word = word.casefold().replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("æ", "ae").replace("œ", "oe")
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


class Names:
    """Given names and surnames, folded."""

    def __init__(self, full_names):
        self.given, self.forms = set(), set()
        for full in full_names:
            parts = [w for w in re.split(r"\s+", (full or "").strip()) if w]
            turned = bool(parts) and parts[0].endswith(",")
            parts = [w.rstrip(",") for w in parts]
            if not 2 <= len(parts) <= 4 or not all(re.fullmatch(r"[^\W\d_][^\W\d_'’.-]*(?:['’.-][^\W\d_]+)*\.?", w) for w in parts):
                continue
            if turned:
                parts = [*parts[1:], parts[0]]
            self.given.add(fold_name(parts[0]))
            surname = parts[-1]
            self.forms |= {surname.lower(), fold_name(surname), surname.lower().encode("ascii", "ignore").decode()}
        self.forms = {f for f in self.forms if len(f) > 2}

    @classmethod
    def of(cls, given, forms) -> Names:
        names = cls(())
        names.given, names.forms = set(given or ()), set(forms or ())
        return names


class Detector:
    def __init__(self, names: Names):
        keys = ahocorasick.Automaton()
        for kind, words in (("box", BOXES), ("cue", [c for c in CUES if c not in SHORT_CUES]), ("street", [w for w in STREETS if len(w) > 3] + SHORT_STREETS), ("end", STREET_ENDS), ("start", STREET_STARTS), ("tel", TEL_WORDS), ("dot", DISGUISES), ("who", [*(t.lower() + end for t in FORMAL for end in (" ", ". ")), *INTRODUCED, " <"]), ("digit", [w for w in DIGIT_WORDS if len(w) > 2])):
            for w in words:
                keys.add_word(w, keys.get(w, ()) + ((kind, len(w)),))
        keys.make_automaton()
        self.keys = keys
        self.know(names)

    def know(self, names: Names) -> None:
        """Looks for these names from now on."""
        self.names = names
        self.surnames = ahocorasick.Automaton()
        for s in names.forms:
            self.surnames.add_word(s, len(s))
        if names.forms:
            self.surnames.make_automaton()

    def _seen(self, source: str, low: str) -> set[str]:
        """Kinds of keywords that stand as their patterns need them: street words by a number, digit words by each other."""
        seen, run, last = set(), 0, -99
        for end, kinds in self.keys.iter(low):
            for kind, length in kinds:
                if kind in seen:
                    continue
                at = end - length + 1
                if kind == "digit":  # three in a row, with no more between them than separators and a few figures take
                    run = run + 1 if at - last <= 40 else 1
                    last = end
                    if run < 3:
                        continue
                elif kind == "street":
                    if not (source[at : at + 1].isupper() or source[at + 1 : at + 2].isupper()) or not any(c.isdigit() for c in low[max(0, at - 48) : at]):
                        continue
                elif kind == "end":
                    if not low[end + 1 : end + 2].isspace() or not low[end + 1 : end + 5].strip()[:1].isdigit():
                        continue
                elif kind == "start" and not self._starts_street(source, low, at, end + 1):
                    continue
                elif kind == "who" and low[end] == "<" and "@" not in low[end : end + 80]:
                    continue
                seen.add(kind)
        if any(c.upper() in source for c in SHORT_CUES):
            seen.add("cue")
        return seen

    @staticmethod
    def _starts_street(source: str, low: str, at: int, end: int) -> bool:
        """Whether a street word that comes first has its number right before it, or may have it after a name."""
        if not low[end : end + 1].isspace():
            return False
        before = low[max(0, at - 24) : at]
        if before and before[-1].isspace():
            left = before.rstrip()
            if not left and at > 24 or any(c.isdigit() for c in left[-6:]):
                return True
        return low[at:end] in NUMBER_AFTER and source[end : end + 12].lstrip()[:1].isupper()

    def _names(self, text: str, mails: Spans) -> list[tuple[int, int]]:
        """Spans of surnames with a given name or an initial beside them, outside mail addresses."""
        if not self.names.forms:
            return []
        folded = text.lower()
        if len(folded) != len(text):
            folded = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out = []
        for end, length in self.surnames.iter(folded):
            a, b = end - length + 1, end + 1
            if mails.meet(a, b):
                continue
            if folded[max(0, a - 3) : a] in ("al-", "el-"):
                a -= 3
            if (a and (folded[a - 1].isalnum() or folded[a - 1] in "-@_+")) or (b < len(folded) and (folded[b].isalnum() or folded[b] in "@_" or (folded[b] == "-" and folded[b + 1 : b + 2].isalpha()))):
                continue
            left = _BEFORE.search(text, max(0, a - 48), a)
            while left and not self._given(left[2], left[3]):  # the word before an initial is no name
                left = _BEFORE.search(text, left.end(2), a)
            if left:
                out.append((left.start(), b))
            else:
                right = _AFTER.match(text, b)
                if right and self._given(right[2], right[3], text[a:a + 1]):
                    stop = right.end() - (len(right[3]) if len(right[2]) > 1 else 0)
                    more = _SECOND.match(text, stop)
                    out.append((a, more.end() if more else stop))
        return out

    def _given(self, word: str, dot: str, like: str = "") -> bool:
        if len(word) == 1:
            return dot == "." and (word.isupper() or like.islower())
        folded = fold_name(word)
        if folded in self.names.given:
            return True
        return "-" in folded and folded.split("-")[0] in self.names.given

    def find(self, source: str) -> list[tuple[int, int, str]]:
        """Spans (start, end, kind) in the source, in order, none overlapping."""
        low = source.lower()
        seen = self._seen(source, low)
        t = plain_form(source, "digit" in seen, "dot" in seen)
        text = t.plain
        if t.at is not None:
            seen |= self._seen(text, text.lower())
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        found["email"] = _mails(text)
        if "cue" in seen:
            for m in _CUE.finditer(text):
                a, b = m.span(1)
                if sum(c.isdigit() for c in text[a:b]) >= 5:
                    found["id_number"].append((a, b))
        digits_left = sum(map(text.count, "0123456789")) if text.isascii() else 99  # each pattern below needs as many digits as its test says
        if digits_left >= 6:
            found["id_number"] += [m.span() for m in _ID_SHAPE.finditer(text)]
        taken = Spans(found["id_number"])
        for m in _PHONE.finditer(text) if digits_left >= 7 else ():
            a, b = m.span()
            digits = sum(c.isdigit() for c in m[0])
            if 7 <= digits <= 20 and not taken.meet(a, b) and not _LABEL.search(text, max(0, a - 24), a):
                found["phone"].append((a, b))
        for m in _TEL_CUE.finditer(text) if "tel" in seen else ():
            if not taken.meet(*m.span(1)) and 7 <= sum(c.isdigit() for c in m[1]) <= 15:
                found["phone"].append(m.span(1))
        if digits_left and (seen & {"street", "end", "start", "box"} or digits_left >= 5 and _POSTCODE.search(text)):
            found["address"] = [m.span() for m in _ADDRESS.finditer(text)] + [m.span() for m in _CEDEX.finditer(text)]
        found["name"] = self._names(text, Spans(found["email"]))
        if "who" in seen:
            found["name"] += [m.span(1) if m[1] else m.span() for m in _IN_CONTEXT.finditer(text)]
        spans, used = [], Spans()
        for kind in ORDER:
            for a, b in sorted(found[kind]):
                while b > a and text[b - 1] in " ,;'\"\t\r\n":
                    b -= 1
                if b > a and not used.meet(a, b):
                    used.add(a, b)
                    spans.append((*t.span(a, b), kind))
        return sorted(spans)

    def redact(self, source: str) -> tuple[str, list[tuple[int, int, str]]]:
        spans = self.find(source)
        return replaced(source, spans), spans


def replaced(source: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder in place of each span."""
    out, last = [], 0
    for a, b, kind in spans:
        if a >= last:
            out += [source[last:a], f"[{kind.upper()}]"]
            last = b
    return "".join([*out, source[last:]])


_LABEL = re.compile(r"(?i)(?:\b(?:isbn|sku|order|ticket|build|version|epoch|row|id|hash|price|issn|ref|invoice)\b[\s#:.no]{0,6}|#)$")
_POSTCODE = re.compile(r"\d[a-z]?(?:,|\s+in)\s+\d{4,5}\s+[^\W\d_]")


def _mails(text: str) -> list[tuple[int, int]]:
    """Spans of mail addresses: the mailbox before each @, the domain after it."""
    out, at = [], text.find("@")
    while at >= 0:
        a = at
        while a and (text[a - 1].isalnum() or text[a - 1] in _MAILBOX):
            a -= 1
        while a < at and text[a] in ".'-%":
            a += 1
        domain = _DOMAIN.match(text, at + 1)
        if domain and a < at and (text[at - 1].isalnum() or text[at - 1] in "+_"):
            out.append((a, domain.end()))
        at = text.find("@", at + 1)
    return out


class Spans:
    """Spans by their start, so that the few one overlaps are found by bisection."""

    def __init__(self, spans=()):
        self.kept, self.longest = sorted(spans), max((b - a for a, b in spans), default=0)

    def add(self, a: int, b: int) -> None:
        insort(self.kept, (a, b))
        self.longest = max(self.longest, b - a)

    def meet(self, a: int, b: int) -> bool:
        if not self.kept:
            return False
        at = bisect_left(self.kept, (b, -1)) - 1
        while at >= 0 and self.kept[at][0] > a - self.longest:
            if self.kept[at][1] > a:
                return True
            at -= 1
        return False


def known_names(people: DataFrame, column: str, most: int = NAME_WORDS) -> list[str] | DataFrame:
    """Distinct names of a table of people, for the detectors: a list, or above ``most`` the table itself (column n)."""
    names = people.select(F.trim(column).alias("n")).where(F.col("n") != "").distinct()
    rows = names.limit(most + 1).collect()
    return [r.n for r in rows] if len(rows) <= most else names


_PIECE = re.compile(r"[^\W_]+")
_JOINED = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*\.?")


def name_words(text: str) -> set[str]:
    """Every form under which a name may be looked up in this text: words and joined words, lower-cased and folded."""
    out = set()
    for m in _JOINED.finditer(plain_form(text).plain):
        at = [p.span() for p in _PIECE.finditer(m[0])]
        for i in range(len(at)):
            for j in range(i, min(len(at), i + 4)):
                word = m[0][at[i][0] : at[j][1]]
                out |= {word.lower(), fold_name(word)}
            if m[0][-1] == ".":
                out.add(m[0][at[i][0] :].lower())
    return out


def _with_own_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``given`` and ``forms`` to rows of key and text: those of all names' words that the text holds.

    Words of distinct texts are joined with words of names, so neither names nor texts travel to every task.
    """

    def in_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(name_words(v)) for v in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["_t", "words"])

    def in_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = Names(batch.column(0).to_pylist())
            both = [*((w, True) for w in sorted(known.given)), *((w, False) for w in sorted(known.forms))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in both], pa.string()), pa.array([g for _, g in both], pa.bool_())], ["word", "is_given"])

    marked = rows.withColumn("_t", F.sha2("text", 256))
    texts = marked.where(F.col("text").isNotNull()).groupBy("_t").agg(F.first("text").alias("text"))
    asked = texts.mapInArrow(in_texts, "_t string, words array<string>").select("_t", F.explode("words").alias("word"))
    known = names.select("n").mapInArrow(in_names, "word string, is_given boolean").distinct()
    met = asked.join(known, "word").groupBy("_t").agg(F.collect_list(F.when(F.col("is_given"), F.col("word"))).alias("given"), F.collect_list(F.when(~F.col("is_given"), F.col("word"))).alias("forms"))
    return marked.join(met, "_t", "left").drop("_t")


def redact(df: DataFrame, key: str, text: str, names: list[str] | DataFrame, with_text: bool = True) -> DataFrame:
    """Each text with its mentions replaced by placeholders such as ``[EMAIL]``.

    Columns: key, ``kinds`` (sorted, distinct), ``mentions`` (how many) and, unless ``with_text`` is false,
    ``redacted`` and ``spans`` (start, end, kind; offsets of code points of the source). Null texts come out
    null, empty ones empty, both without kinds; a repeated row is treated on its own; other columns are
    ignored. Of equal texts in a batch one is read. ``names`` as ``known_names`` gives them: a list travels to
    every task, a table is joined with the words of the texts; both give the same rows.
    """
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    spread = isinstance(names, DataFrame)
    if spread:
        rows = _with_own_names(rows, names)
    lexicon = df.sparkSession.sparkContext.broadcast([] if spread else list(names))
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(Names(lexicon.value))
        for batch in batches:
            coded = batch.column("text").dictionary_encode()
            values, take = coded.dictionary.to_pylist(), coded.indices
            if spread:  # each text brings the names it may hold
                own = zip(*(batch.column(c).to_pylist() for c in ("text", "given", "forms")))
                known = {t: (g, f) for t, g, f in own if t is not None}
                spans = []
                for v in values:
                    detector.know(Names.of(*known[v]))
                    spans.append(detector.find(v))
            else:
                spans = [detector.find(v) for v in values]
            kinds = pa.array([sorted({k for *_, k in s}) for s in spans], pa.list_(pa.string())).take(take)
            counts = pa.array([len(s) for s in spans], pa.int32()).take(take)
            columns, fields = [batch.column("key"), kinds, counts], ["key", "kinds", "mentions"]
            if with_text:
                columns += [pa.array([replaced(v, s) for v, s in zip(values, spans)], pa.string()).take(take), pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans], shape).take(take)]
                fields += ["redacted", "spans"]
            yield pa.RecordBatch.from_arrays(columns, fields)

    schema = f"key {key_type}, kinds array<string>, mentions int" + ", redacted string, spans array<struct<start:int,end:int,kind:string>>" * with_text
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
