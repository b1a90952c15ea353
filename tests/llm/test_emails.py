import datetime as dt
import random

import numpy as np

from loomspan.llm import emails
from loomspan.llm.boosting import Trees

PEOPLE = {1: "Ada Lindqvist", 2: "Bo Marrow", 3: "Cleo Fontaine"}
TEXT = [
    "The committee met in the old library and found three maps that nobody had seen before.", "Please bring the second box of slides when you come over on Thursday evening.",
    "We counted forty chairs in the hall, which is six fewer than the plan says.", "The printer refuses every sheet that is wider than the tray.", "I would rather wait for the surveyor than guess the height again.",
]
CLOSE = ["Kind regards,", "Cheers,", "Viele Grüße", "Bien à vous,", "Un saludo,"]
CARD = {1: ["Ada Lindqvist", "Surveyor | Lindqvist & Daughters", "T +44 20 7946 0312 | ada@lind.example"], 2: ["Bo"], 3: ["*Cleo Fontaine*", "Fontaine Press", "fon 030 23 125 671"]}
LEGAL = "This e-mail is confidential and meant only for the addressee. If it reached you in error, please delete it; we accept no liability."


def thread(rnd, conv, start):
    """Mails of one thread with the numbers of the lines that are not new."""
    out, quoted = [], []
    for k in range(rnd.randrange(2, 5)):
        who = rnd.choice([1, 2, 3])
        lines, bad = [], []

        def add(text, new):
            lines.append(text)
            if not new and text.strip():
                bad.append(len(lines))

        if rnd.random() < 0.5:
            add(rnd.choice(["Hi all,", "Dear Bo,", "Bonjour,"]), True)
        for _ in range(rnd.randrange(1, 3)):
            for t in rnd.sample(TEXT, 2):
                add(t, True)
            add("", True)
        if rnd.random() < 0.8:
            if who == 3:
                add("--", False)
            else:
                add(rnd.choice(CLOSE), False)
            for c in CARD[who]:
                add(c, False)
            if rnd.random() < 0.3:
                add("", True)
                add("P.S. " + TEXT[0], True)
        if rnd.random() < 0.3:
            add("", True), add("-" * 20, False), add(LEGAL, False)
        if quoted:
            add("", True)
            if rnd.random() < 0.5:
                add("On Sun, 18 Aug 2024 at 03:09, Somebody Else", False), add("<else@x.example> wrote:", False)
                for q in quoted:
                    add("> " + q, False)
            else:
                add("-----Original Message-----", False), add("From: Somebody <s@x.example>", False), add("Sent: Thu, 27 May 2021 04:42", False), add("To: All", False), add("Subject: Maps", False), add("", True)
                for q in quoted:
                    add(q, False)
        out.append((who, lines, bad))
        quoted = lines
    return [(conv, f"<m{conv}.{i}>", who, start + dt.timedelta(hours=i), (rnd.choice(["\n", "\r\n"])).join(lines), bad) for i, (who, lines, bad) in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, thread long, mail string, sender long, sender_name string, sent timestamp, body string, kind string")


def test_held_out_accuracy(spark):
    rnd, mails = random.Random(4), []
    for c in range(150):
        mails += thread(rnd, c, dt.datetime(2024, 1, 1) + dt.timedelta(days=c))
    rows = [(i, m[0], m[1], m[2], PEOPLE[m[2]], m[3], m[4], "clash") for i, m in enumerate(mails)]
    want = {(i, n) for i, m in enumerate(mails) for n in m[5]}
    labels = emails.classify(frame(spark, rows), train_mails=120)
    got = {(r.id, r.line_no) for r in labels.where("kind <> 'new'").collect()}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97
    reduced = {r.id: r.body for r in emails.new_text(frame(spark, rows), train_mails=120).collect()}
    assert len(reduced) == len(rows) and all(LEGAL not in b for b in reduced.values())


def test_contact_hint_loses_no_line():
    lines = ["www.example.com", "Avenue des Lilas", "RUE DE L'EAU", "Boulevard Sud", "impasse Verte", "Quai Nord", "P.O. Box", "a@b.example", "Tel: ٠١٢٣٤٥٦٧٨٩", "see https://x.example", "12 Mill Lane", "Hauptstr. 5"]
    assert all(map(emails._CONTACT.search, lines)) and all(map(emails.has_contact, lines))
    for line in ("avenues", "true story", "Regards, Anna", "page 3"):
        assert emails.has_contact(line) == bool(emails._CONTACT.search(line))


def test_traps_stay_new():
    lines = ["Hi,", "From the harbour side the plan still holds.", "To: the left of the door there is a switch.", "On Friday the crew wrote up the results and left.", "| a | b |", "ok -- next week then"]
    assert not any(emails.quoted(lines, [False] * len(lines)))
    lines = ["Bo Marrow wrote on 2024-01-02:", "| old text", "", "my answer", "| more old text", "MØ> from the third", ">> deep"]
    assert emails.quoted(lines, [False] * 7) == [True, True, False, False, True, True, True]


def test_edges(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, 1, "a", 1, None, day, None, ""), (2, 1, "b", 1, None, day, "", ""), (3, 1, "c", None, None, None, "Hello\n\n> x", ""), (3, 1, "c", None, None, None, "Hello\n\n> x", ""), (4, None, None, 2, "", day, "word " * 50000, "")]
    got = sorted((r.id, r.line_no, r.kind) for r in emails.classify(frame(spark, rows)).collect())
    assert got == [(3, 1, "new"), (3, 3, "quote")] or got == [(3, 1, "new"), (3, 3, "quote"), (4, 1, "new")]
    assert emails.classify(frame(spark, rows).limit(0)).count() == 0


def test_trees_learn():
    rnd = np.random.default_rng(1)
    x = rnd.random((2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((Trees().fit(x[:1500], y[:1500]).predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
