import pytest

from loomspan.llm import personal

NAMES = ["Lena Ørsk-Moor", "Tomás Wexholme", "kenji vossgard", "model-3", " René  Tarnhöfer ", "Corvane, Petra", "+1 206 555 0101"]


@pytest.fixture(scope="module")
def detector():
    return personal.Detector(personal.Names(NAMES))


CASES = [
    ("Write to a.b+c@mail.some-host.example, or A_B AT host DOT example; x [at] host [dot] co [dot] uk", "Write to [EMAIL], or [EMAIL]; [EMAIL]"),
    ("We met at host and ping @user, Update @scope/pkg@2.5.1", None),
    ("Call +44 20 7946 0312 or (206) 555-0115 x15, 0199 00 48 77, tel:+1-206-555-0147, +49(0)30 23125144", "Call [PHONE] or [PHONE], [PHONE], [PHONE], [PHONE]"),
    ("Ring two oh six, five five five, oh one double two now", "Ring [PHONE] now"),
    ("The row id is 6202962029, the limit 6.2029.000. ISBN 000-0-2318-72318-1, SKU 31726-17-26, 10.19.88.5, 2024-03-15 08:11:22", None),
    ("my passport no. L95304248, Personalausweis L51X32T63, SSN 956-15-3299, Steuer-ID 06 737 136 721", "my passport no. [ID_NUMBER], Personalausweis [ID_NUMBER], SSN [ID_NUMBER], Steuer-ID [ID_NUMBER]"),
    ("At 12 High Mill Street, Ashtown or Töpferstr. 68a in 00437 Hohenlinde, P.O. Box 12, Ashtown; 3 bis, rue de l'Eau, Vaux", "At [ADDRESS] or [ADDRESS], [ADDRESS]; [ADDRESS]"),
    ("Room 47, Main Street wing, is locked; the backup drive keeps 5 pages in a row", None),
    ("Lena Orsk-Moor, Wexholme, Tomas and R. Tarnhöfer met Mr Petra de\n> Corvane", "[NAME], [NAME] and [NAME] met [NAME]"),
    ("Lena and Mr Wexholme use the Wexholme Bridge and wexholme.kenji@x.example", "Lena and Mr Wexholme use the Wexholme Bridge and [EMAIL]"),
    ("Маil tоm​@host.еxample ２０６－５５５－０１０１", "Маil [EMAIL] [PHONE]"),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_cases(detector, text, expected):
    redacted, spans = detector.redact(text)
    assert redacted == (expected or text)
    last = 0
    for a, b, kind in spans:
        assert last <= a < b <= len(text) and kind in personal.KINDS
        last = b
    assert detector.find(text) == spans


def test_people_of_no_table(detector):
    text = "Mr. Adam Quillfeather wrote, Zora Finch <z@finch.example> answered: my name is Ole van Brunn. Dr Who met Frau Berg, Adam Quill and Mr Fox."
    redacted, _ = detector.redact(text)
    assert redacted == "[NAME] wrote, [NAME] <[EMAIL]> answered: my name is [NAME]. Dr Who met Frau Berg, Adam Quill and Mr Fox."


def test_names_behind_one_in_an_address(detector):
    """The first name of the text lies inside an address and is none; the later one counts."""
    for text in ("Parcel for 12 Mill Lane, Lena Wexholme, and by hand to Tomás Wexholme.", "We went to 12 Lena Wexholme Street. then we saw Tomás Wexholme."):
        assert {k for *_, k in detector.find(text)} == {"address", "name"}


def test_more_names_than_travel(spark):
    """Names joined by a shuffle find what names sent to every task find."""
    texts = [t for t, _ in CASES] + [None, "", "Jean-Luc O'Neill-Márquez, Petra Corvane jr. and al-Tarnhöfer, René", "R.Tarnhöfer, kenji\nvossgard"]
    people = spark.createDataFrame([(n,) for n in [*NAMES, "Jean-Luc O'Neill-Márquez", None, " "]], "n string")
    names, joined = personal.known_names(people, "n"), personal.known_names(people, "n", most=2)
    assert isinstance(names, list) and not isinstance(joined, list)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    rows = lambda n: sorted(map(str, personal.redact(df, "id", "body", n).collect()))
    assert rows(joined) == rows(names)


def test_offsets_survive_rewriting():
    t = personal.plain_form("​ab one two three four five, é [at] y [dot] example!")
    for i in range(len(t.plain)):
        a, b = t.span(i, i + 1)
        assert 0 <= a < b <= len(t.source)
    at = t.plain.index("@")
    assert t.source[t.at[at - 1]] in "é" and t.plain.endswith("example!") and t.source[t.at[-1]] == "!"


def test_operator_edges(spark):
    long = "quiet words go on " * 20000 + "and Lena Ørsk-Moor ends it"
    rows = [(1, None, "k"), (2, "", "k"), (3, long, "k"), (3, long, "k"), (4, "x@y.example", None)]
    df = spark.createDataFrame(rows, "id long, body string, kinds string")
    out = personal.redact(df, "id", "body", NAMES).collect()
    got = sorted((r.id, tuple(r.kinds or ()), r.redacted if r.id != 3 else r.redacted[-24:]) for r in out)
    assert got == [(1, (), None), (2, (), ""), (3, ("name",), "s go on and [NAME] ends it"[-24:]), (3, ("name",), "s go on and [NAME] ends it"[-24:]), (4, ("email",), "[EMAIL]")]
    assert personal.redact(df.limit(0), "id", "body", NAMES, False).count() == 0
    assert personal.redact(df, "id", "body", [], False).where("mentions > 0").count() == 1
