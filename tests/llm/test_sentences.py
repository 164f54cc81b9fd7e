import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkgrid.llm.sentences import sentence_spans, sentence_units


def units(t):
    return [t[a:e] for a, e in zip(*sentence_spans(t))]


@pytest.mark.parametrize(
    "text, out",
    [
        ("One two. Three four! Five?", ["One two.", "Three four!", "Five?"]),
        ("At 8 a.m. during work. It ended at 11 p.m. sharp.", ["At 8 a.m. during work.", "It ended at 11 p.m. sharp."]),
        ("He lost it, etc. The rest stayed.", ["He lost it, etc.", "The rest stayed."]),
        ("See Fig. 7 and Sec. 49.57 for details. Next.", ["See Fig. 7 and Sec. 49.57 for details.", "Next."]),
        ("“Stop. Retry later. Nothing is lost,” wrote Ann. Then it ran.", ["“Stop. Retry later. Nothing is lost,” wrote Ann.", "Then it ran."]),
        ('The log said "Queue full! Drop nothing." and it went on. "All is done." Next one.', ['The log said "Queue full! Drop nothing." and it went on.', '"All is done."', "Next one."]),
        ("Am 21. März kam er. Der 12. Lauf endete. Nr. 5 z. B. nicht.", ["Am 21. März kam er.", "Der 12. Lauf endete.", "Nr. 5 z. B. nicht."]),
        ("El Sr. Gil, p. ej. en la pág. 3, salió. ¿Quién fue?", ["El Sr. Gil, p. ej. en la pág. 3, salió.", "¿Quién fue?"]),
        ("Он ищет файл и т. д. Отдел ждёт. См. рис. 5 и стр. 7.", ["Он ищет файл и т. д.", "Отдел ждёт.", "См. рис. 5 и стр. 7."]),
        ("王说：“停！没有丢失。”然后走了。下一句！", ["王说：“停！没有丢失。”然后走了。", "下一句！"]),
        ("「準備はできたか？」と言った。次。", ["「準備はできたか？」と言った。", "次。"]),
        ("दो पृष्ठ मिले। डॉ. तोर आए।", ["दो पृष्ठ मिले।", "डॉ. तोर आए।"]),
        ("هل وصل؟ نعم وصل. قال د. تور.", ["هل وصل؟", "نعم وصل.", "قال د. تور."]),
        ("ฝ่ายตรวจสอบนับ 5 หน้า ระบบเปลี่ยน GB เมื่อสิ้น", ["ฝ่ายตรวจสอบนับ 5 หน้า", "ระบบเปลี่ยน GB เมื่อสิ้น"]),
        ("He waited ... and then left. 后来……走了。", ["He waited ... and then left.", "后来……走了。"]),
        ("Title here\n\nA line\nthat wraps. End.", ["Title here", "A line\nthat wraps.", "End."]),
        ("Items:\n- one. two\n- three\n1. four", ["Items:", "- one. two", "- three", "1. four"]),
        ("(A whole sentence.) Another one (cf. p. 3). Last", ["(A whole sentence.)", "Another one (cf. p. 3).", "Last"]),
        ("J. R. Smith came. pipectl v5.4.8 ran.", ["J. R. Smith came.", "pipectl v5.4.8 ran."]),
        ("Really?! Yes.", ["Really?!", "Yes."]),
        ("The answer is no. They left early.", ["The answer is no.", "They left early."]),
        ("She studies modern art. He paints walls.", ["She studies modern art.", "He paints walls."]),
        ("He wore a cap. It was red.", ["He wore a cap.", "It was red."]),
        ("Use the ref. It works.", ["Use the ref.", "It works."]),
        ("Plan B. Then we go.", ["Plan B.", "Then we go."]),
        ("We bought vitamin C. It helped.", ["We bought vitamin C.", "It helped."]),
        ("The medic. equipment arrived late.", ["The medic. equipment arrived late."]),
        ("The answer is in art. 5 and No. 7, see Ref. B and et al. (2020). It is known.", ["The answer is in art. 5 and No. 7, see Ref. B and et al. (2020).", "It is known."]),
        ("Das ist die Art. Er kam mit Hr. Meier, vgl. Abb. 3. Es war gut.", ["Das ist die Art.", "Er kam mit Hr. Meier, vgl. Abb. 3.", "Es war gut."]),
        ("Il est dans l'av. Foch avec M. Petit. Elle est venue.", ["Il est dans l'av. Foch avec M. Petit.", "Elle est venue."]),
        ("The av. Then it was over.", ["The av.", "Then it was over."]),
        ("It was sold by Dr. Who. iPhone users were glad.", ["It was sold by Dr. Who.", "iPhone users were glad."]),
        ("", []),
        (None, []),
        (" \n\t ", []),
    ],
)
def test_units(text, out):
    assert (units(text) if text is not None else list(sentence_spans(text)[0])) == out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB .!?\n“”\"()…。ก5-​", max_size=60))
def test_units_cover_everything_but_white_space(t):
    a, e = sentence_spans(t)
    last = 0
    for x, y in zip(a, e):
        assert last <= x < y and not t[last:x].strip() and t[x:y] == t[x:y].strip()
        last = y
    assert not t[last:].strip()


def test_long_text_in_linear_time():
    t = "This is a sentence of the text. " * 50_000
    assert len(sentence_spans(t)[0]) == 50_000
    assert len(sentence_spans("x" * 1_000_000)[0]) == 1
    assert len(sentence_spans("(" * 20_000 + "a. B")[0]) >= 1


def test_frame(spark):
    d = spark.createDataFrame([("a", "One. Two.", 1), ("a", "One. Two.", 2), ("b", None, 1), ("c", "", 1), (None, "X.", 1)], "id string, content string, starts int")
    got = {r["id"]: r["starts"] for r in sentence_units(d).collect()}
    assert got == {"a": [0, 5], "b": [], "c": [], None: [0]}
    assert sentence_units(d.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["p. ", "Sra. ", "A. ", "no. The ", "“ A b. ", "(a. ", "„«‹「x. Y” ", '" A. B'])
def test_repetitive_texts_take_time_in_proportion(piece):
    import time

    took = []
    for n in (2_000, 20_000):
        t = time.process_time()
        sentence_spans(piece * n)
        took.append(time.process_time() - t)
    assert took[1] < 40 * max(took[0], 0.01)
