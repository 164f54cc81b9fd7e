import random

import pytest

from inkgrid.llm import truncation as T

WORDS = "the operator counted settings during night parser stored files broker signed report queue held entries office auditor returned missing page morning clerk renamed archive".split()


def sentence(r):
    w = [r.choice(WORDS) for _ in range(r.randint(6, 14))]
    return w[0].capitalize() + " " + " ".join(w[1:]) + "."


def text(r, n):
    return "Annex " + str(r.randint(1, 99)) + "\n\n" + "\n\n".join(" ".join(sentence(r) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(6)
    rows, true = [], set()
    for i in range(1500):
        t = text(r, r.randint(1, 8))
        src = ["limited", "free", None][i % 3]
        if src == "limited" and len(t) > 500:
            t = t[:500].rstrip()
            if not t.endswith("."):
                true.add(i)
        elif src == "free" and i % 30 == 1:
            t = t[: len(t) // 2].rstrip()
            if len(t) > 60 and not t.endswith("."):
                true.add(i)
        elif i % 7 == 0:
            t += "\n\nAnnex " + str(i % 90)
        elif i % 11 == 0:
            t += "\n\nKind regards, Ann Berg"
        rows.append((i, t, src, 0))
    rows += [(9001, None, "free", 0), (9002, "", "free", 0), (9003, "  \n", None, 0), (9004, "字。" * 20_000, "free", 0), (9005, "Der Lauf endete am 12.", "free", 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, ending int")
    return rows, true, T.truncated(d).collect(), d


def test_found(judged):
    _rows, true, got, _d = judged
    cut = {r["doc_id"] for r in got if r["cut"]}
    assert len(cut & true) >= 0.97 * len(true) and len(cut - true) <= 0.03 * len(true)
    assert not {9001, 9002, 9003} & {r["doc_id"] for r in got} and 9004 not in cut


def test_spikes(judged, spark):
    *_x, d = judged
    s = T.length_spikes(T.scan(d)[0]).collect()
    assert {r["source"] for r in s} == {"limited"} and any(r["length"] == 500 for r in s)


def test_keys():
    assert T._keys("- 12 files") == ("L:9 files", "L:9") and T._keys("附件510编号") == ("附件9编", "附件")
    assert T._CUT_MARK.search("some text [...]") and T._CUT_MARK.search("some te…") and not T._CUT_MARK.search("a sentence.")


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert T.truncated(d).count() == 0
