import random

from pyspark.sql import functions as F

from loomspan.llm import languages

# a small grammar for each language: subject, verb phrase, ending
PARTS = {
    "en": (["The baker", "My neighbour", "That old dog", "Every student"], ["wants to see the river", "has never been to the market", "will read these letters", "thinks about the weather"], ["before the summer.", "with her brother.", "because it is late.", "when the bell rings."]),
    "de": (["Der Bäcker", "Mein Nachbar", "Jener alte Hund", "Jede Schülerin"], ["will den Fluss sehen", "war noch nie auf dem Markt", "liest bald diese Briefe", "denkt über das Wetter nach"], ["vor dem Sommer.", "mit ihrem Bruder.", "weil es spät ist.", "wenn die Glocke klingt."]),
    "fr": (["Le boulanger", "Mon voisin", "Ce vieux chien", "Chaque élève"], ["veut voir la rivière", "n'est jamais allé au marché", "va lire ces lettres", "pense au temps qu'il fait"], ["avant la fin de l'été.", "avec son frère.", "parce qu'il est tard.", "quand la cloche sonne."]),
    "es": (["El panadero", "Mi vecino", "Ese perro viejo", "Cada alumna"], ["quiere ver el río", "nunca ha ido al mercado", "va a leer estas cartas", "piensa en el tiempo"], ["antes del verano.", "con su hermano.", "porque ya es tarde.", "cuando suena la campana."]),
    "ru": (["Пекарь", "Мой сосед", "Эта старая собака", "Каждая ученица"], ["хочет увидеть реку", "никогда не был на рынке", "скоро прочитает эти письма", "думает о погоде"], ["до конца лета.", "вместе с братом.", "потому что уже поздно.", "когда звонит колокол."]),
    "ja": (["パン屋は", "隣の人は", "あの古い犬は", "どの生徒も"], ["川を見たいと", "市場へ行ったことが", "この手紙をすぐに", "天気のことばかり"], ["夏の前に思った。", "兄と一緒に話した。", "遅いので帰った。", "鐘が鳴ると立った。"]),
}
SPELLING = {"en": ["en", "English", " EN", "en-GB"], "de": ["de", "ger", "de_AT"], "fr": ["fr", "fra"], "es": ["es", "Spanish"], "ru": ["ru"], "ja": ["ja", "ja_JP"]}


def sentence(rnd, code):
    return ("" if code == "ja" else " ").join(rnd.choice(p) for p in PARTS[code])


def corpus(seed, n=500):
    rnd, rows, truth = random.Random(seed), [], {}
    for i in range(n):
        main = rnd.choice(list(PARTS))
        text = [sentence(rnd, main) for _ in range(rnd.randrange(2, 7))]
        found = {main}
        if i % 6 == 0:
            other = rnd.choice([c for c in PARTS if c != main])
            text.insert(rnd.randrange(len(text)), sentence(rnd, other))
            found.add(other)
        tag = rnd.choice(SPELLING[main]) if i % 5 else rnd.choice([None, "", "und", *SPELLING[rnd.choice(list(PARTS))]])
        truth[i] = (tag, main, found)
        rows.append((i, rnd.choice([" ", "\n"]).join(text), tag, "clash"))
    return rows, truth


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, languages string")


def test_documents_and_segments(spark):
    rows, truth = corpus(3)
    found = languages.identify(frame(spark, rows), train_documents=400)
    out = {r.doc_id: r for r in found.collect()}
    assert sum(set(out[i].languages) == t[2] for i, t in truth.items()) / len(truth) > 0.95
    mixed = [i for i, t in truth.items() if len(t[2]) == 2 and set(out[i].languages) == t[2]]
    assert all({s.language for s in out[i].segments} == truth[i][2] and 0 < out[i].confidence <= 1 for i in mixed)
    wrong = {(r.doc_id, r.lang) for r in languages.wrong_labels(found).collect()}
    label = {i: frozenset(c for c, names in SPELLING.items() if t[0] in names) for i, t in truth.items()}
    want = {(i, c) for i, t in truth.items() for c in t[2] if label[i] != t[2]}
    assert len(wrong & want) / len(wrong | want) > 0.93


def test_foreign_names_make_no_language(spark):
    rows, _ = corpus(5)
    rows.append((9000, "The baker and Der Bäcker will read these letters before the summer. My neighbour thinks about the weather (le boulanger).", "en", ""))
    out = {r.doc_id: r.languages for r in languages.identify(frame(spark, rows), train_documents=400).collect()}
    assert out[9000] == ["en"]


def test_labels(spark):
    tags = [(" EN-us", "en"), ("Deutsch", "de"), ("pt_BR", "pt"), ("N/A", None), (None, None), ("it", "other"), ("日本語", "ja"), ("  ", None)]
    df = spark.createDataFrame(tags, "tag string, want string").withColumn("got", languages.label_of(F.col("tag")))
    assert all(r.got == r.want for r in df.collect())


def test_edges(spark):
    rows, _ = corpus(7, 60)
    rows += [(800, None, "en", ""), (801, "", "en", ""), (802, " \n　", None, ""), (803, "1234 5678", None, ""), (804, "The baker wants to see the river before the summer. " * 5000, "en", ""), (805, rows[0][1], "en", ""), (805, rows[0][1], "en", "")]
    out = languages.identify(frame(spark, rows)).collect()
    by = {r.doc_id: r for r in out}
    assert not {800, 801, 802} & set(by) and by[803].languages == [] and by[804].languages == ["en"] and sum(r.doc_id == 805 for r in out) == 2
    assert languages.identify(frame(spark, rows).limit(0)).count() == 0
