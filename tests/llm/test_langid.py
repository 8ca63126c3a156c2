import random

from genoloom.llm import langid

PARTS = {
    "en": (["The program", "Our team", "This list", "The second run"], ["shows a clear signal", "was compared with the others", "has changed since last year"], ["in the kidney", "after the correction", "for older donors"]),
    "de": (["Das Programm", "Unsere Gruppe", "Diese Liste", "Der zweite Lauf"], ["zeigt ein klares Signal", "wurde mit den anderen verglichen", "hat sich seit dem letzten Jahr geändert"], ["in der Niere", "nach der Korrektur", "bei älteren Spendern"]),
    "es": (["El programa", "Nuestro grupo", "Esta lista", "La segunda prueba"], ["muestra una señal clara", "fue comparada con los demás", "ha cambiado desde el año pasado"], ["en el riñón", "después de la corrección", "para los donantes mayores"]),
    "ja": (["このプログラムは", "私たちの結果は", "二番目の試行は"], ["腎臓で明らかな信号を示した", "ほかの結果と比べられた", "去年から変わっている"], ["", "と思われる", "ことがわかった"]),
}


def sentence(lang, rng):
    a, b, c = (rng.choice(x) for x in PARTS[lang])
    gene = f"KAX{rng.randint(1, 99)}"
    return f"{a}{gene}{b}{c}。" if lang == "ja" else f"{a} {gene} {b} {c}."


def corpus(n=240, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        label = lang if rng.random() < 0.85 else rng.choice(list(PARTS))
        rows.append((i, " ".join(sentence(lang, rng) for _ in range(5)), label, lang))
    return rows


TAGS = [("en", "en"), ("English", "en"), ("de", "de"), ("es", "es"), ("ja", "ja"), (None, "xx")]


def model_of(rows):
    cut = [(label, i, s[a:b].strip()) for i, s, label, _ in rows for a, b, _ in langid.sentences(s)]
    return langid.fit(sorted(cut))


def test_held_out_sentences_are_right():
    model, rng = model_of(corpus()), random.Random(9)
    words = langid.Words(model.projected)
    want = [rng.choice(list(PARTS)) for _ in range(400)]
    which, _, lang, sure = langid.judge(words, model, [sentence(x, rng) for x in want])
    got = [model.langs[x] if x >= 0 else None for x in lang]
    assert len(which) == 400 and sum(g == w for g, w in zip(got, want)) >= 396
    assert all(g in (w, None) for g, w in zip(got, want)) and ((sure > 0) & (sure <= 1)).all()


def test_sentences_leave_out_what_is_none():
    text = "# A heading without end\n\nThe first one is here. It costs 0.18 in all.\n\n| a | b |\n|---|---|\n\n* KAX1: 2.1\n\nsaid \"Das Programm zeigt\" and went on.\n```\nx = y. z\n```\nno end here"
    assert [text[a:b].strip() for a, b, _ in langid.sentences(text)] == ["The first one is here.", "It costs 0.18 in all.", 'said "Das Programm zeigt" and went on.']
    assert "Programm" not in langid.sentences(text)[2][2]
    assert langid.sentences("") == [] and langid.sentences("x" * 100_000) == []
    assert [t for _, _, t in langid.sentences("一つ目の文です。二つ目の文です。")] == ["一つ目の文です", "二つ目の文です"]


def test_cases(spark):
    rng = random.Random(3)
    two = sentence("en", rng) + " " + sentence("en", rng) + "\n\n" + sentence("de", rng)
    extra = [
        (1000, sentence("es", rng), None), (1001, sentence("es", rng), "zz"), (1002, sentence("de", rng), "en"), (1003, sentence("en", rng), "English"), (1004, two, "en"),
        (1005, None, None), (1006, "", "en"), (1007, "KAX1, KAX2, 0.5", None), (1008, "a" * 50_000, None), (1009, two, None), (1010, " \n ", "xx"), (1011, sentence("es", rng) * 3000, "es"),
    ]
    rows = [(i, t, l) for i, t, l, _ in corpus()] + extra
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'c' as segments", "'d' as label")
    tags = spark.createDataFrame(TAGS, "lang_tag string, lang string").selectExpr("*", "1 as doc_id")
    found = langid.document_languages(docs, tags)
    got = {}
    for r in langid.label_cases(found).where("doc_id >= 1000").collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert got == {1000: {"es"}, 1001: {"es"}, 1002: {"de"}, 1004: {"de", "en"}, 1009: {"de", "en"}}
    one = {r.doc_id: r for r in found.where("doc_id >= 1000").collect()}
    assert one[1005].lang is None and one[1005].confidence is None and one[1003].lang == "en"
    parts = [(s["lang"], two[s["start"] : s["end"]].strip()) for s in one[1004].segments]
    assert [p[0] for p in parts] == ["en", "de"] and parts[1][1] in two and parts[1][1].endswith(".")


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "The program shows a signal here.", None)], "doc_id long, text string, lang string")
    tags = spark.createDataFrame(TAGS, "lang_tag string, lang string")
    assert [r.lang for r in langid.document_languages(docs, tags).collect()] == [None]
    assert langid.document_languages(docs.limit(0), tags).count() == 0


def test_quotations_of_any_length_are_treated_alike():
    short = 'The group calls it "ein klares Signal in der Niere" in every report.'
    long = short.replace("ein klares", "ein " + "sehr " * 60 + "klares")
    for text in (short, long):
        (_, _, words), = langid.sentences(text)
        assert "Niere" not in words and "every report" in words
    for n in (1, 60):
        whole = 'She said "' + "Das Programm zeigt ein " + "sehr " * n + "klares Signal. Mehr" + '" and left the room.'
        assert "Programm" in " ".join(w for _, _, w in langid.sentences(whole))
    inches = 'A bar of 5" is long enough for us. Then we took the "KAX1 term" away from it.'
    assert [w.split()[0] for _, _, w in langid.sentences(inches)] == ["A", "Then"]
    assert "KAX1" not in langid.sentences(inches)[1][2]


def test_words_of_any_length_have_subwords(spark):
    assert len(langid._subwords("donau" * 30)) and langid._natural("donau" * 30)
    model, rng = model_of(corpus()), random.Random(4)
    text = sentence("de", rng).replace(".", " " + "Nierengewebe" * 8 + ".")
    which, _, lang, _ = langid.judge(langid.Words(model.projected), model, [text])
    assert [model.langs[x] for x in lang] == ["de"]


def test_a_worker_keeps_models_apart():
    one, two = model_of(corpus(seed=1)), model_of(corpus(seed=2))
    assert one.key != two.key
