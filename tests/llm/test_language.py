import pytest

from inkgrid.llm import language as L

EN = ["The operator counted the settings during the night. The parser stored all the files.", "When the broker signed the report, the queue held many entries for the office.", "It was the auditor that returned the missing page on Monday morning."]
DE = ["Die Warteschlange zählte den Bericht am Montag. Der Lieferant prüfte alle Dateien.", "Insgesamt trafen viele Seiten während der Nacht ein und wurden gespeichert.", "Die Prüfroutine löschte das Archiv nach dem Neustart ohne Vorwarnung."]
ES = ["El operador contó los ajustes durante la noche. La cola guardó todos los archivos.", "El proveedor revisó el informe porque la oficina lo rechazó por la mañana.", "La oficina publicó la página que faltaba después del reinicio."]


@pytest.fixture(scope="module")
def model():
    return L.fit_word_scores([("en", t) for t in EN] * 3 + [("de", t) for t in DE] + [("es", t) for t in ES] + [("nl", t) for t in EN] + [("ja", "これはテストです。")] * 3 + [("zh", "处理管道检查了报告。")] * 3)


@pytest.mark.parametrize("label, code", [("en-GB", "en"), ("English", "en"), ("zho", "zh"), ("de_at", "de"), ("PT", "pt"), ("und", None), ("", None), (None, None), ("xx", None), ("zh-Hant", "zh")])
def test_labels(label, code):
    assert L.iso_code(label) == code


def test_a_label_without_words_of_its_own_is_dropped(model):
    assert "nl" not in model.langs and {"en", "de", "es"} <= set(model.langs)


def test_segments(model):
    t = EN[1] + " " + DE[1] + "\n\n" + ES[1] + " 处理管道检查了报告。"
    s = L.segments(t, model)
    assert [x[2] for x in s] == ["en", "de", "es", "zh"] and [x[0] for x in s] == [0, len(EN[1]) + 1, len(EN[1] + DE[1]) + 3, len(t) - 10]
    assert all(0.5 < x[3] <= 1 for x in s)
    assert [x[2] for x in L.segments("Привет мир. สวัสดี", model)] == ["ru", "th"]
    assert L.segments("12 34.", model) == [(0, 6, "zxx", 0.0)] and L.segments(" ", model) == []
    assert len(L.segments('The stamp read "Die Warteschlange zählte" and the office stored it.', model)) == 1


def test_records(spark, model):
    d = spark.createDataFrame([("1", EN[0], "de", 0), ("1", EN[0], "de", 0), ("2", EN[0], "English", 0), ("3", None, "en", 0), ("4", "", None, 0), ("5", DE[0] + " " + EN[1], "de", 0), ("6", EN[2] * 500, None, 0), ("7", "99", "en", 0)], "id string, t string, lang string, rec_id int")
    cases = L.language_cases(L.language_segments(d, model, "id", "t", "lang")).collect()
    assert sorted((r["rec_id"], r["seg_start"], r["lang"]) for r in cases) == [("1", 0, "en"), ("5", 0, "de"), ("5", len(DE[0]) + 1, "en"), ("6", 0, "en")]
    assert L.language_segments(d.limit(0), model, "id", "t", "lang").count() == 0


def test_training_sample_is_bounded(spark):
    d = spark.range(3000).selectExpr("id doc_id", "'a b c' text", "if(id % 3 = 0, null, 'en') lang")
    assert 150 < len(L.training_sample(d, 200)) <= 250
    assert L.training_sample(d.limit(0), 10) == []
    assert L.fit_word_scores([]).langs == []


def test_a_unit_of_any_length_keeps_its_language(model):
    t = " ".join(["the operator counted all the files and stored them during the night while"] * 12_000 + ["die Warteschlange zählte den Bericht am Montag und das"]) + "."
    assert len(t.split()) > 145_899
    assert [x[2] for x in L.segments(t, model)] == ["en"]


def test_identifiers_say_nothing(model):
    t = "处理管道检查了报告。\n\nKA-1323: 0000e9811b6f6b26bfa5a4d17e1b68d9\n\n处理管道检查了报告。"
    assert [x[2] for x in L.segments(t, model)] == ["zh"]
    assert L.segments("9e1 a0b1", model)[0][2] == "zxx"


def test_scripts_without_a_trained_language(model):
    for t, x in (("இது ஒரு சோதனை.", "ta"), ("ეს არის ტესტი.", "ka"), ("זה מבחן.", "he"), ("Αυτό είναι μια δοκιμή.", "el"), ("এটি একটি পরীক্ষা।", "bn"), ("ይህ ፈተና ነው።", "am"), ("이것은 시험입니다.", "ko")):
        assert [s[2] for s in L.segments(t, model)] == [x]
    assert L.segments("এটি একটি পরীক্ষা।", model)[0][3] == 0.5  # one of two languages of its script
    assert L.segments("ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺ", model)[0][2:] == ("und", 0.0)


@pytest.fixture(scope="module")
def large_model():
    """Texts of three languages with shared and own words; each language has 400 words."""
    import numpy as np

    r = np.random.default_rng(5)
    heads = {"en": "str wh th ck ng ough", "de": "sch pf ung ß ei tz", "es": "ñ rr ción lla que ado"}
    words = {x: ["".join(r.choice(list("aeioulnrst")) for _ in range(2)) + r.choice(h.split()) + "".join(r.choice(list("aeioulnrst")) for _ in range(2)) for _ in range(400)] for x, h in heads.items()}
    common = ["".join(r.choice(list("aeioulnrst"), 3)) for _ in range(150)]

    def text(x, n):
        return " ".join(str(r.choice(common)) if r.random() < 0.5 else str(r.choice(words[x])) for _ in range(n))

    docs = [(x if r.random() > 0.1 else "en", ". ".join(text(x, 12).capitalize() for _ in range(6)) + ".") for x in heads for _ in range(60)]
    return L.fit_word_scores(docs), text, list(heads)


def test_confidence_is_no_higher_than_the_share_of_right_answers(large_model):
    model, text, langs = large_model
    got = []
    for k in range(1500):
        x = langs[k % 3]
        (*_, lang, conf), *_ = L.segments(text(x, 1 + k % 7) + ".", model)
        got.append((conf, lang == x))
    for lo, hi in ((0.3, 0.7), (0.7, 0.9), (0.9, 0.99), (0.99, 1.01)):
        part = [(c, ok) for c, ok in got if lo <= c < hi]
        if len(part) >= 30:
            assert sum(ok for _, ok in part) / len(part) >= sum(c for c, _ in part) / len(part) - 0.06, (lo, hi)
    assert sum(ok for c, ok in got if c >= 0.99) / sum(c >= 0.99 for c, _ in got) > 0.98


def test_a_language_outside_the_sample_is_unknown(large_model, spark):
    model, text, _ = large_model
    other = "Wieczorem operator przejrzał ustawienia i zapisał wszystkie pliki w archiwum. Kolejka przyjęła zgłoszenia z biura. " * 3
    assert [x[2] for x in L.segments(other, model)] == ["und"]
    assert [x[2] for x in L.segments(text("de", 40) + ".", model)] == ["de"]
    d = spark.createDataFrame([("1", other, "de"), ("2", "12 - 34", "de")], "id string, t string, lang string")
    assert [(r["rec_id"], r["lang"]) for r in L.language_cases(L.language_segments(d, model, "id", "t", "lang")).collect()] == [("1", "und")]


def test_the_model_is_a_provider_of_the_core(spark, model):
    from inkgrid.operators import providers

    L.register(model)
    d = spark.createDataFrame([(EN[0],), (DE[0],), ("",), (None,)], "t string")
    assert [r["lang"] for r in providers.apply_provider(d, "language", "t", "lang", "trained").collect()] == ["en", "de", "und", None]
