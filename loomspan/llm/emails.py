"""Quoted history, signatures and disclaimers in mails.

A mail is cut into paragraphs, at blank lines, at changes of quote depth and where a signature may open. Three
boosted-tree models tell what a paragraph is: quoted, a signature, a disclaimer or new. Quotes are told by depth,
bars, introducing lines and headers in and before the paragraph, contact density and how often the sender writes
its lines; signatures and disclaimers by contact density, quote depth around, sender frequency, ancestor overlap and
wording. The quote model learns from lines that another sender wrote earlier in the thread, which its features do
not see; where the thread tells nothing, from how the mail is marked. The other two are fitted on paragraphs that
labelling rules are sure of. All are fitted on at most ``TRAIN_MAILS`` mails; statistics of lines cover all mails.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import xxhash

from loomspan.llm.boosting import Trees
from loomspan.llm.sampling import drawn
from loomspan.session import cut, shuffle_width

#: Mails whose blocks the models are fitted on (drawn by a hash of the id).
TRAIN_MAILS = 4_000
NEW, QUOTE, SIGNATURE, DISCLAIMER = range(4)

_MARK = re.compile(r"^\s*(?:(?:[^\W\d_a-zß-öø-ÿ]{1,3})?>|\|(?=\s|$|>|\|))\s?")
_ANGLE = re.compile(r"^\s*(?:[^\W\d_a-zß-öø-ÿ]{1,3})?>")
_BAR = re.compile(r"^\s*\|(?:\s|$|>|\|)")
# Words by which mail programs introduce what they quote, in several languages.
_SAID = r"(?:wrote|writes|schrieb|schreibt|a écrit|écrivait|escribió|escribio|escreveu|ha scritto|schreef|написал\w*|пишет|skrev|さんは書きました|書きました)"
_DATE = r"(?:\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\d{1,2}:\d{2}|\d{1,2}\.? [^\W\d_]{3,10}\.? \d{4}|[^\W\d_]{3,10} \d{1,2}, \d{4}|\d{4}年)"
_INTRO = re.compile(rf"(?i)(?=.*(?:{_DATE}|@))(?:.*\b{_SAID}\b.*|.*{_SAID}):\s*$")
_INTRO_END = re.compile(rf"(?i)(?:\b{_SAID}|書きました)\s*:?\s*$")
_ENDS_SAID = re.compile(rf"(?i){_SAID}$")
_LAST = "esbtóoufvлаоитた"  # last letters of these words
_INTRO_START = re.compile(rf"(?i)^\s*(?:on|le|am|el|em|op|il|den|в|on\s\w+)\b.*{_DATE}|^\s*\d{{4}}年|^\s*\d{{1,2}} [^\W\d_]+ \d{{4}}")
_RULE = re.compile(r"^\s*(?:[-–—_=*~#]{2,}|—|–)\s*$")
_BANNER = re.compile(r"(?i)^\s*-{2,}\s*(?:original message|original-nachricht|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|message original|message transféré|mensaje original|mensaje reenviado|mensagem original|mensagem encaminhada|oorspronkelijk bericht|doorgestuurd bericht|исходное сообщение|пересылаемое сообщение)\s*-{2,}\s*$")
_FROM = re.compile(r"^\s*\**(?:From|Von|De|Da|Van|От|差出人)\s?\**:\s?\**\s*\S")
_NEXT = re.compile(r"^\s*\**(?:Sent|Date|To|Subject|Cc|Reply-To|Gesendet|Datum|An|Betreff|Envoyé|À|Objet|Enviado(?: el)?|Fecha|Para|Asunto|Data|Assunto|Verzonden|Aan|Onderwerp|Отправлено|Дата|Кому|Тема|送信日時|宛先|件名)\s?\**:")
# Formulas that close a mail, and words of disclaimers and automatic last lines.
_CLOSE = r"(?:(?:kind|best|warm|warmest|many|with kind|with best)?\s*regards|best(?: wishes)?|all the best|cheers|many thanks|thanks(?: a lot| again| so much)?|thank you|yours(?: sincerely| faithfully| truly)?|sincerely(?: yours)?|warmly|take care|see you|love|mit freundlichen grüßen|mit freundlichem gruß|mit besten grüßen|freundliche grüße|beste grüße|viele grüße|liebe grüße|herzliche grüße|schöne grüße|herzlichst|gruß|grüße|mfg|lg|vg|vielen dank|danke|bien à (?:vous|toi)|bien cordialement|cordialement|amicalement|amitiés|bonne journée|bonne soirée|salutations(?: distinguées)?|merci(?: d'avance)?|à bientôt|bises|un saludo|saludos(?: cordiales)?|un cordial saludo|atentamente|cordialmente|un abrazo|abrazos|muchas gracias|gracias|atenciosamente|com os melhores cumprimentos|cumprimentos|abraços?|obrigad[oa]|met vriendelijke groet(?:en)?|vriendelijke groet(?:en)?|groet(?:en|jes)?|mvg|alvast bedankt|bedankt|cordiali saluti|saluti|с уважением|с наилучшими пожеланиями|всего доброго|спасибо|よろしくお願いします|よろしくお願いいたします|敬具)"
_SIGN_OFF = re.compile(rf"(?i)^\s*{_CLOSE}\s*[,.!]*\s*(?:[,–—-]\s*)?(?-i:(?:[*_]*[^\W\d_a-zß-öø-ÿ][\w.'’-]*[*_]*\s*){{0,3}})$")
_AUTO = re.compile(r"(?i)^\s*(?:sent (?:from|with|via|using)\b(?!.*[?]).{3,80}|get \S+ for \S.{0,30}|von (?:meinem|unterwegs)\b.{0,40}gesendet\.?|gesendet (?:von|mit)\b.{0,50}|envoyé (?:depuis|de|à partir de)\b.{0,50}|enviado (?:desde|do|de)\b.{0,50}|verzonden (?:vanaf|met|via)\b.{0,50}|отправлено (?:с|из)\b.{0,50}|.{2,30}から送信)\s*$")
_LEGAL = [re.compile(p, re.I) for p in (
    r"confidential|vertraulich|confidentiel|confidencial|vertrouwelijk|конфиденциальн|privileged", r"intended (?:only|solely|for|recipient)|meant only|addressee|empfänger bestimmt|seule personne nommée|destinataire|destinatari|geadresseerde",
    r"(?:e-?mail|message|nachricht|courriel|mensaje|mensagem|bericht)", r"delete it|löschen sie|supprimer|elim[ií]n|verwijder|irrtümlich|in error|par erreur|por error", r"liab|haftet|haftung|responsab|aansprakelijk", r"prohibit|interdite?|verboten|untersagt|prohibid", r"contract|vertrag|contrat|virus|monitored|archived",
    r"registered in|registered (?:office|under)|sitz der|siège social|handelsregister|registro mercantil", r"consider the (?:trees|environment)|before you print|print this|umwelt|imprimer", r"views (?:here|expressed)|disclaimer|notice:",
)]
#: A text without any of these holds none of the patterns above.
_LEGAL_HINTS = ("confid", "vertraul", "vertrouwelijk", "конфиденц", "privileged", "intended", "meant only", "addressee", "empfänger", "personne nomm", "destinat", "geadresseerde", "mail", "message", "nachricht", "courriel", "mensaje", "mensagem", "bericht", "delete it", "löschen", "supprimer", "elim", "verwijder", "irrtüm", "error", "erreur", "liab", "haft", "responsab", "aansprakelijk", "prohib", "interdit", "verboten", "untersagt", "contract", "vertrag", "contrat", "virus", "monitored", "archived", "registered", "sitz der", "siège social", "handelsregister", "registro", "consider the", "print", "umwelt", "imprimer", "views ", "disclaimer", "notice:")
_HINTS = ahocorasick.Automaton()
for _hint in _LEGAL_HINTS:
    _HINTS.add_word(_hint, True)
_HINTS.make_automaton()
_GREET = re.compile(r"(?i)^\s*(?:hi|hello|hey|dear|good (?:morning|day|evening|afternoon)|hallo|liebe[rs]?|guten (?:tag|morgen|abend)|sehr geehrte[rs]?|moin|bonjour|bonsoir|salut|cher|chère|chers|hola|buenos días|buenas|estimad[oa]s?|querid[oa]s?|olá|oi|bom dia|prezad[oa]s?|beste|geachte|dag|здравствуйте|привет|уважаем\w+|добрый день|こんにちは)\b")
_POST = re.compile(r"(?i)^\s*(?:p\.?\s?s\.?|n\.?b\.?|ps|pd|p\.?d\.?)(?:\s*[-–—:.]|\s)")
_CONTACT = re.compile(r"(?i)[\w.+-]+@[\w-]+\.|https?://|www\.|(?:\+|\b(?:tel|t|fon|phone|mobil|mobile|fax|cell)\b\.?:?\s|\b0)\(?\d[\d ()./ -]{5,}|^\W*\+?\(?\d[\d ()./ -]{6,}(?:\s?(?:x|ext\.?|durchwahl)\s?\d+)?\W*$|\b\d{1,4}[a-z]?,? [A-Z][\w'’]+(?: [A-Z][\w'’]+)* (?i:street|drive|lane|avenue|row|court|road)|(?:straße|str\.|gasse|allee|weg) \d+|\b(?:rue|boulevard|impasse|quai|avenue) |p\.o\. box")
#: What every match of ``_CONTACT`` holds; cheaper than the pattern.
_CONTACT_HINT = re.compile(r"(?i)[@/\d]|www\.|rue |boulevard |impasse |quai |avenue |p\.o\. box")
_SENTENCE = re.compile(r"[.!?。…:]['\")»”]*\s*$")


def legal_words(text: str) -> int:
    """How many kinds of disclaimer wording a text holds."""
    low = text.lower()
    return sum(bool(p.search(text)) for p in _LEGAL) if next(_HINTS.iter(low), None) else 0


@lru_cache(maxsize=1 << 16)
def has_contact(line: str) -> bool:
    return bool(_CONTACT_HINT.search(line)) and bool(_CONTACT.search(line))


def bare(line: str) -> str:
    """The line without quote marks and outer white space."""
    while True:
        m = _MARK.match(line)
        if not m or not m[0].strip():
            return line.strip()
        line = line[m.end() :]


def line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def quoted(lines: list[str], old: list[bool]) -> list[bool]:
    """Which lines are quoted, introduce a quote or are its header; ``old`` tells lines that earlier mails hold."""
    n = len(lines)
    out = [bool(_ANGLE.match(x)) for x in lines]
    solid = [i for i in range(n) if lines[i].strip()]
    after = {a: b for a, b in zip(solid, solid[1:])}
    i, barred = 0, False
    while i < n:  # bars quote only under an introduction or where their text is old
        if _BAR.match(lines[i]) and not out[i]:
            j = i
            while j < n and (_BAR.match(lines[j]) or out[j]):
                j += 1
            head = next((k for k in range(i - 1, max(-1, i - 3), -1) if lines[k].strip()), None)
            own = [k for k in range(i, j) if bare(lines[k])]
            if barred or (head is not None and lines[head].rstrip().endswith(":")) or (own and sum(old[k] for k in own) * 2 >= len(own)) or (i and out[i - 1]):
                barred = True
                for k in range(i, j):
                    out[k] = True
            i = j
        else:
            i += 1
    for i in solid:
        if out[i]:
            continue
        follower = after.get(i)
        leads = follower is None or (out[follower] and follower - i <= 2)
        if _BANNER.match(lines[i]) or (_FROM.match(lines[i]) and _header(lines, i)):
            start = i
            back = next((k for k in range(i - 1, -1, -1) if lines[k].strip()), None)
            if back is not None and i - back <= 1 and _RULE.match(lines[back]):
                start = back
            for k in range(start, n):
                out[k] = True
            break
        tail = lines[i].rstrip()
        if tail[-1:] != ":" and not (tail[-1:] in _LAST and _ENDS_SAID.search(tail[-24:])):
            if follower is None and (_INTRO_START.search(lines[i]) and "," in lines[i] and not _SENTENCE.search(lines[i]) or re.match(r"^_{30,}\s*$", lines[i])):
                out[i] = True  # cut off after the beginning of an introduction
            continue
        if (_INTRO.match(lines[i]) or (_INTRO_END.search(lines[i]) and i and _INTRO_START.search(lines[i - 1]))) and len(lines[i]) < 300:
            if leads or (follower is not None and old[follower] and follower - i <= 2):
                out[i] = True
                if not re.search(_DATE, lines[i]) and i and _INTRO_START.search(lines[i - 1]):
                    out[i - 1] = True
                if not leads:  # an unmarked quote: as far as its lines are old
                    k = follower
                    while k is not None and (old[k] or out[k]):
                        out[k] = True
                        k = after.get(k)
        elif leads and follower is not None and lines[i].rstrip().endswith(":") and re.search(rf"{_DATE}|@", lines[i]) and len(lines[i]) < 300:
            out[i] = True
    return out


def _header(lines: list[str], i: int) -> bool:
    hits = sum(bool(_NEXT.match(x)) for x in lines[i + 1 : i + 5])
    return hits >= 2 or (hits == 1 and i + 2 >= len(lines))


def blocks(lines: list[str], out: list[bool]) -> list[tuple[int, int, int]]:
    """Blocks of lines that are not quoted, as (start, end, run); a run is a stretch between quotes.

    Blocks end at blank lines, and begin anew at a rule, a closing formula, an automatic last line, a
    postscript or the opening words of a disclaimer.
    """
    found, start, run, was = [], None, 0, True
    for i in range(len(lines) + 1):
        solid = i < len(lines) and not out[i] and lines[i].strip()
        if start is not None and (not solid or _opens(lines[i]) and not (_RULE.match(lines[i - 1]) and i - 1 == start)):
            found.append((start, i, run))
            start = None
        if solid and start is None:
            start = i
        if i < len(lines) and lines[i].strip():
            run += out[i] and not was
            was = out[i]
    return found


def _opens(line: str) -> bool:
    return bool(_RULE.match(line) or _SIGN_OFF.match(line) or _AUTO.match(line) or _POST.match(line) or legal_words(line) >= 2 and re.match(r"\W*(?:[A-Z]|[А-Я])", line))


FEATURES, QUOTE_FEATURES = 24, 15
#: Characters from which a line says whose it is; shorter ones stand in too many mails.
TELLING = 12
#: Rows that the quote model is fitted on at least.
LEAST_ROWS = 200


def paragraphs(lines: list[str], out: list[bool], found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """All lines as (start, end): blocks that are not marked as quoted as they are, the others cut at blank lines and changes of depth."""
    parts, start, depth = [], None, 0
    for i in range(len(lines) + 1):
        inside = i < len(lines) and out[i] and lines[i].strip()
        now = quote_depth(lines[i]) if inside else 0
        if start is not None and (not inside or now != depth):
            parts.append((start, i))
            start = None
        if inside and start is None:
            start, depth = i, now
    return sorted(parts + [(a, b) for a, b, _ in found])


def quote_depth(line: str) -> int:
    depth = 0
    while m := _ANGLE.match(line):
        depth, line = depth + 1, line[m.end() :]
    return depth


def quote_features(lines: list[str], out: list[bool], parts: list[tuple[int, int]], often: list[int], contacts: list[bool]) -> np.ndarray:
    """One row a paragraph, of what the mail itself shows."""
    rows = np.zeros((len(parts), QUOTE_FEATURES), np.float32)
    n_lines, under, lead = max(1, len(lines)), False, -9
    for k, (a, b) in enumerate(parts):
        part = [x.strip() for x in lines[a:b]]
        n = len(part)
        intro = sum(x[-1:] == ":" and len(x) < 300 and bool(_INTRO.match(x) or _INTRO_END.search(x)) for x in part)
        banner = [x[:1] == "-" and bool(_BANNER.match(x)) for x in part]
        fields = [":" in x and bool(_FROM.match(x) or _NEXT.match(x)) for x in part]
        angles = [quote_depth(x) if ">" in x else 0 for x in part]
        heads = sum(banner) + sum(fields)
        rows[k] = (
            sum(angles) / n, sum(d > 0 for d in angles) / n, sum("|" in x and bool(_BAR.match(x)) for x in part) / n, sum(out[a:b]) / n, intro, heads / n, a - lead <= 3, under, sum(contacts[a:b]) / n,
            sum(math.log1p(often[i]) for i in range(a, b)) / n, n, sum(map(len, part)) / n, a / n_lines, k > 0 and out[parts[k - 1][0]], k + 1 < len(parts) and out[parts[k + 1][0]],
        )
        if intro or heads:
            lead = b
        under = under or any(banner) or any(f and _FROM.match(lines[a + i]) and _header(lines, a + i) for i, f in enumerate(fields))
    return rows


def thread_labels(lines: list[str], out: list[bool], parts: list[tuple[int, int]], others: list[bool], old: list[bool]) -> np.ndarray:
    """1 for paragraphs that another sender wrote earlier in the thread, 0 for those nobody did, else as the mail is marked.

    Only a mail that holds some line of another sender says anything about the paragraphs without one.
    """
    knows = any(others)
    labels = np.zeros(len(parts), np.float32)
    for k, (a, b) in enumerate(parts):
        told = [i for i in range(a, b) if len(bare(lines[i])) >= TELLING]
        share = sum(others[i] for i in told) / len(told) if told else 0.0
        if share >= 0.5:
            labels[k] = 1
        elif told and knows and not any(old[i] for i in told) and not any(out[a:b]):
            labels[k] = 0
        else:
            labels[k] = sum(out[a:b]) * 2 >= b - a
    return labels


def features(lines: list[str], out: list[bool], found: list[tuple[int, int, int]], old: list[bool], often: list[int], sender: str, contacts: list[bool]) -> np.ndarray:
    """One row a block."""
    rows = np.zeros((len(found), FEATURES), np.float32)
    names = {w.lower() for w in re.findall(r"[^\W\d_]{2,}", sender or "")}
    last_solid = max((i for i, x in enumerate(lines) if x.strip()), default=0)
    chain = contact_before = 0
    for b, (start, end, run) in enumerate(found):
        part = [x.strip() for x in lines[start:end]]
        body = part[1:] if _RULE.match(part[0]) else part
        text = " ".join(body)
        n = len(part)
        mean = sum(map(len, part)) / n
        sign, rule, auto = bool(_SIGN_OFF.match(part[0])), bool(_RULE.match(part[0])), any(_AUTO.match(x) for x in part[:2])
        contact = sum(contacts[start:end]) / n
        sentences = sum(bool(_SENTENCE.search(x[-8:])) or x.count(" ") >= 7 and len(x.split()) >= 8 for x in body) / max(1, len(body))
        legal = legal_words(text)
        words = {w.lower() for w in re.findall(r"[^\W\d_]{2,}", " ".join(part[:3]))} if mean < 60 else set()
        after = next((found[k][2] == run for k in range(b + 1, len(found))), False)
        rest = sum(1 for k in range(b + 1, len(found)) if found[k][2] == run)
        seen = [math.log1p(often[i]) for i in range(start, end)]
        longest = max(map(len, part))
        short = mean < 48 and longest < 75
        rows[b] = (
            n, mean, longest, contact, sum("|" in x or "*" in x for x in part) / n, sign, rule, rule and not body, auto, legal, bool(_GREET.match(part[0])) and not sign,
            sum(old[start:end]) / n, sum(seen) / n, max(seen), rest, start / (last_solid + 1), sentences, chain, bool(names & words), bool(_POST.match(part[0])), short,
            sum(map(str.isdigit, text)) / max(1, len(text)), contact_before, out[end] if end < len(lines) else end > last_solid,
        )
        chain = 2 if (sign or rule or auto) and short else 1 if chain and short and not after else 0
        if chain == 0 and contact > 0.3 and short:
            chain = 1
        contact_before = contact
    return rows


def sure(rows: np.ndarray) -> np.ndarray:
    """Labels of blocks by rule: 0 new, 1 signature, 2 disclaimer, -1 unsure."""
    n, mean, _, contact, marks, sign, rule, only, auto, legal, greet, _, often, _, rest, place, sentence, chain, name, post, short, _, before, _ = rows.T
    label = np.where((sentence >= 0.5) & (legal < 2) & (mean > 30), 0, -1)
    label = np.where((greet > 0) | (post > 0) | ((chain == 0) & (contact == 0) & (name == 0) & (legal < 2)), 0, label)
    label = np.where((sign > 0) | (auto > 0), 1, label)
    label = np.where((rule > 0) & (legal < 2) & (short > 0) & (only == 0), 1, label)
    label = np.where((label != 1) & (post == 0) & (greet == 0) & (short > 0) & (chain > 0) & (legal < 2) & ((sentence < 0.5) | (contact > 0.3)), 1, label)
    label = np.where((label != 1) & (legal >= 3) & (post == 0), 2, label)
    label = np.where((rule > 0) & (legal >= 2), 2, label)
    return label


class Model:
    """Three models; ``quotes`` holds the features of paragraphs and, last, their labels."""

    def __init__(self, rows: np.ndarray, quotes: np.ndarray):
        if len(quotes):  # a few paragraphs count as often as it takes for a leaf to hold one of them
            quotes = np.tile(quotes, (math.ceil(LEAST_ROWS / len(quotes)), 1))
        self.quote = Trees().fit(quotes[:, :-1], quotes[:, -1].astype(float))
        label = sure(rows)
        kept = label >= 0
        self.signature = Trees(rounds=80, depth=4).fit(rows[kept], (label[kept] == 1).astype(float))
        self.disclaimer = Trees().fit(rows[kept], (label[kept] == 2).astype(float))

    def quoted(self, quotes: np.ndarray) -> np.ndarray:
        return self.quote.predict(quotes) >= 0.5 if len(quotes) else np.zeros(0, bool)

    def kinds(self, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0, int)
        s, d = self.signature.predict(rows), self.disclaimer.predict(rows)
        return np.where((d >= 0.5) & (d >= s), DISCLAIMER, np.where(s >= 0.5, SIGNATURE, NEW))


def split_lines(body: str) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in body.split("\n")]


def line_statistics(mails: DataFrame) -> DataFrame:
    """Per mail: ``old``, ``others`` and ``often`` of each of its lines, as arrays by line.

    ``old``: the text of the line (without quote marks) stands in an earlier mail of the thread; copies of the
    same mail do not count. ``others``: and another sender was the first to write it, and no other thread holds it. ``often``: how often the sender wrote it unquoted, copies of mails included. Input columns:
    ``id, thread, mail, sender, sent, body``.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, marked = [], []
            for body in batch.column("body").to_pylist():
                lines = split_lines(body or "")
                texts = [bare(x) for x in lines]
                out.append([line_hash(t) if t else None for t in texts])
                marked.append([bool(_ANGLE.match(x)) for x in lines])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "thread", "mail", "sender", "sent")), pa.array(out, pa.list_(pa.int64())), pa.array(marked, pa.list_(pa.bool_()))], ["id", "thread", "mail", "sender", "sent", "hashes", "marked"])

    flat = cut(mails.mapInArrow(hashes, "id long, thread long, mail long, sender long, sent long, hashes array<long>, marked array<boolean>"))  # as arrays, an eighth of the rows' size
    lines = flat.select("id", "thread", "mail", "sender", "sent", F.posexplode(F.arrays_zip("hashes", "marked")).alias("line", "z")).select("id", "thread", "mail", "sender", "sent", "line", F.col("z.hashes").alias("h"), F.col("z.marked").alias("marked")).where(F.col("h").isNotNull())
    first = lines.groupBy("thread", "h").agg(F.min(F.struct("sent", "mail", "sender")).alias("first"), F.max("sent").alias("last"))
    common = first.groupBy("h").agg(F.count("*").alias("threads")).where("threads > 1").select("h", F.lit(True).alias("common"))  # says nothing of who is quoted
    first = first.where("last > first.sent").drop("last").join(common, "h", "left")  # of lines that nobody wrote again, none is old
    often = lines.where(~F.col("marked")).groupBy("sender", "h").agg(F.count("*").alias("often")).where("often > 1")
    known = lines.join(first, ["thread", "h"], "left").select("id", "line", "sender", "h", F.coalesce((F.col("first.sent") < F.col("sent")) & (F.col("first.mail") != F.col("mail")), F.lit(False)).alias("old"), F.when(F.col("common").isNull(), F.col("first.sender")).alias("_by"))
    full = known.join(often, ["sender", "h"], "left").select("id", F.struct("line", "old", F.coalesce(F.col("old") & (F.col("_by") != F.col("sender")), F.lit(False)).alias("others"), F.coalesce("often", F.lit(1)).cast("int").alias("often")).alias("l"))
    part = lambda c: F.transform("stats", lambda x: x[c]).alias(c)
    return full.groupBy("id").agg(F.collect_list("l").alias("stats")).select("id", part("line"), part("old"), part("others"), part("often"))


def classify(messages: DataFrame, *, train_mails: int = TRAIN_MAILS, with_text: bool = False) -> DataFrame:
    """Every non-blank line of each mail with its kind: ``id, line_no, kind`` (new, quote, signature, disclaimer), and ``line`` itself where asked for.

    Input: ``id, thread, mail`` (any key of the mail that its copies share), ``sender, sender_name, sent,
    body``. Null and empty bodies give no rows; a repeated row gives its lines once; mails sent at the same
    time do not count as earlier than each other. Other columns are ignored.
    """
    mails = messages.select(F.col("id").cast("long").alias("id"), F.col("thread").cast("long").alias("thread"), F.xxhash64("thread", "mail").alias("mail"), F.coalesce(F.col("sender").cast("long"), -F.abs(F.xxhash64("thread")) - 1).alias("sender"), F.unix_micros(F.col("sent").cast("timestamp")).alias("sent"), F.col("sender_name").cast("string").alias("sender_name"), "body")
    mails = mails.where(F.col("id").isNotNull() & (F.length("body") > 0)).dropDuplicates(["id"])
    width = shuffle_width(messages.sparkSession)  # set, or the adaptive join would leave parsing to a few tasks
    known = cut(mails.select("id", "sender_name", "body").repartition(width, "id").join(line_statistics(mails.drop("sender_name")), "id"))

    def parse(body: str, places: list[int], olds: list[bool], by_others: list[bool], counts: list[int], name: str):
        lines = split_lines(body)
        old, others, often = [False] * len(lines), [False] * len(lines), [0] * len(lines)
        for i, o, x, n in zip(places, olds, by_others, counts):
            old[i], others[i], often[i] = bool(o), bool(x), n
        out = quoted(lines, old)
        found = blocks(lines, out)
        parts = paragraphs(lines, out, found)
        contacts = [has_contact(x.strip()) for x in lines]
        return lines, found, features(lines, out, found, old, often, name or "", contacts), parts, quote_features(lines, out, parts, often, contacts), lambda: thread_labels(lines, out, parts, others, old)

    fields = ("body", "line", "old", "others", "often", "sender_name")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in zip(*(batch.column(c).to_pylist() for c in fields)):
                _, _, blocks_, _, quotes, labels = parse(*x)
                rows += blocks_.tolist() + np.column_stack([quotes, labels()]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float32()))], ["row"])

    share = min(1.0, train_mails / max(1, known.count()))
    sample = known.where(drawn(share, 3, "id")).limit(2 * train_mails)
    taught = sample.mapInArrow(rows_of, "row array<float>").toArrow().column("row").to_pylist()
    of = lambda width: np.array([r for r in taught if len(r) == width], np.float32).reshape(-1, width)
    model = Model(of(FEATURES), of(QUOTE_FEATURES + 1))
    shared = messages.sparkSession.sparkContext.broadcast(model)
    names = ("new", "quote", "signature", "disclaimer")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(*x) for x in zip(*(batch.column(c).to_pylist() for c in fields))]
            kinds = shared.value.kinds(np.concatenate([p[2] for p in parsed])).tolist() if parsed else []
            marked = shared.value.quoted(np.concatenate([p[4] for p in parsed])).tolist() if parsed else []
            ids, at, what, texts, k, q = [], [], [], [], 0, 0
            for key, (lines, found, _, parts, *_) in zip(batch.column("id").to_pylist(), parsed):
                kind = [NEW] * len(lines)
                for start, end, _ in found:
                    kind[start:end] = [kinds[k]] * (end - start)
                    k += 1
                for start, end in parts:
                    if marked[q]:
                        kind[start:end] = [QUOTE] * (end - start)
                    q += 1
                for i, x in enumerate(lines):
                    if x.strip():
                        ids.append(key), at.append(i + 1), what.append(names[kind[i]])
                        if with_text:
                            texts.append(x)
            columns, named = [pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(what, pa.string())], ["id", "line_no", "kind"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, named + ["line"] * with_text)

    return known.mapInArrow(label, "id long, line_no int, kind string" + ", line string" * with_text)


def mails_of(messages: DataFrame, conversations: DataFrame, authors: DataFrame) -> DataFrame:
    """Messages of mail threads in the form ``classify`` reads; a thread is a chat if its key begins with a chat service."""
    chat = F.col("thread_key").rlike("^(iMessage|SMS);")
    threads = conversations.select(F.col("id").alias("thread"), F.col("external_id").alias("thread_key")).where(~F.coalesce(chat, F.lit(False))).select("thread")
    people = authors.select(F.col("id").alias("sender"), F.col("display_name").alias("sender_name"))
    rows = messages.select("id", F.col("conversation_id").alias("thread"), F.coalesce("external_id", F.concat(F.lit("row "), F.col("id"))).alias("mail"), F.col("author_id").alias("sender"), F.col("sent_at").alias("sent"), "body")
    return rows.join(threads, "thread", "left_semi").join(people.dropDuplicates(["sender"]), "sender", "left")


def new_text(messages: DataFrame, **options) -> DataFrame:
    """``id, body``: each mail reduced to the non-blank lines its sender newly wrote; empty where there are none."""
    kept = classify(messages, with_text=True, **options).where("kind = 'new'")
    text = kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return messages.select("id").distinct().join(text, "id", "left").select("id", F.coalesce("body", F.lit("")).alias("body"))
