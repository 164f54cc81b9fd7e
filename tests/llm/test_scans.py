import random

import numpy as np
import pytest

from inkgrid.llm import scans as S
from inkgrid.llm.boosting import Boosted

VOCAB = "report message settings operator counted archive delivery missing threshold similarity training handbook customer supplier catalogue migration quarterly insurance department warehouse inspector correction embedding translation maintenance collector regional contract signed invoice purchase stored during morning evening office paper number window".split()


def page_lines(r, doc, pages):
    out, n = [], 0

    def add(p, t):
        nonlocal n
        n += 1
        out.append((doc, n, p, t))

    for p in range(1, pages + 1):
        add(p, f"Quarterly archive of {doc}")
        add(p, "")
        for _ in range(4):
            w = [r.choice(VOCAB) for _ in range(40)]
            w[0] = w[0].capitalize()
            line = ""
            for x in w:
                if len(line) + len(x) > 52:
                    add(p, line.strip())
                    line = ""
                line += x + " "
            add(p, line.strip() + ".")
            add(p, "")
        add(p, f"- {p} -")
    return out


@pytest.fixture(scope="module")
def found(spark):
    r = random.Random(4)
    rows = [x for d in range(12) for x in page_lines(r, f"doc{d}", 3)]
    bad = [i for i, x in enumerate(rows) if x[3].split() and "message" in x[3].split()[1:-1]][:6]
    for i in bad:
        rows[i] = (*rows[i][:3], rows[i][3].replace("message", "mess@ge", 1))
    worse = [i for i, x in enumerate(rows) if "quarterly" in x[3].split()[1:-1] and i not in bad][:14]
    for i in worse:
        rows[i] = (*rows[i][:3], rows[i][3].replace("quarterly", "qu@rterly", 1))
    hyph = [i for i, x in enumerate(rows[:-1]) if x[3] and rows[i + 1][3] and not x[3].startswith(("Quart", "-")) and rows[i + 1][3].split()[0].isalpha() and len(rows[i + 1][3].split()[0]) > 7 and rows[i + 1][3][0].islower()][:10]
    for i in hyph:
        w = rows[i + 1][3].split()[0]
        rows[i] = (*rows[i][:3], rows[i][3] + " " + w[:4] + "-")
        rows[i + 1] = (*rows[i + 1][:3], rows[i + 1][3][4:])
    rows += [rows[5], ("doc0", None, 1, "x"), (None, 3, 1, "y")]
    rows[10] = (*rows[10][:2], None, rows[10][3])
    rows = [(*x[:3], x[3] or None) if k % 2 else x for k, x in enumerate(rows)]
    d = spark.createDataFrame([(*x, "extra") for x in rows], "document_id string, line_no int, page int, text string, block string")
    f = S.scan_findings(d)
    return rows, {k: {(rows[i][0], rows[i][1]) for i in v} for k, v in (("misread", bad + worse), ("hyphen", hyph))}, f, S.line_kinds(f).collect()


def test_kinds(found):
    rows, true, _f, got = found
    by = {k: {(r["document_id"], r["line_no"]) for r in got if r["kind"] == k} for k in ("furniture", "hyphen", "misread")}
    furniture = {(x[0], x[1]) for x in rows if x[0] and x[1] and x[3] and (x[3].startswith("Quarterly archive of") or x[3].startswith("- "))}
    assert by["furniture"] == furniture
    assert by["hyphen"] == true["hyphen"]
    assert len(by["misread"] & true["misread"]) >= 0.9 * len(true["misread"]) and len(by["misread"] - true["misread"]) <= 2


def test_paragraphs(found):
    _rows, _true, f, _got = found
    p = S.paragraphs(f).collect()
    assert len(p) == 12 * 3 * 4 and all(x["text"].endswith(".") and "- " not in x["text"] and "@" not in x["text"] for x in p)


def test_paragraph_over_blocks(spark):
    n = 2 * S.BLOCK + 900
    text = {i: f"w{i} goes on" for i in range(1, n + 1)}
    text[S.BLOCK - 1], text[S.BLOCK] = "the mess-", "@ge, went on"  # a misread word broken at a block's border
    text[2 * S.BLOCK - 1], text[2 * S.BLOCK] = "a well-", "known man"  # a compound there
    want = " ".join(text[i] for i in range(1, n + 1)).replace("mess- @ge", "message").replace("well- known", "well-known")
    after = 3 * S.BLOCK + 500  # ends in an empty block: the paragraph is finished, so the next line is another one
    rows = [("d", i, i // 40, x, False) for i, x in text.items()] + [("d", n + 1, n // 40, "end.", False)] + [("d", i, n // 40, "", False) for i in range(n + 2, after)] + [("d", after, n // 40 + 1, "Next", False)]
    lines = spark.createDataFrame([x[:4] for x in rows], "document_id string, line_no int, page int, text string")
    found = {
        "blocks": S.line_blocks(lines),
        "furniture": spark.createDataFrame([], "document_id string, line_no int"),
        "tokens": spark.createDataFrame([], S._TOKEN_SCHEMA),
        "broken": spark.createDataFrame([("d", S.BLOCK - 1, "mess", "@ge", S.BLOCK, "-", True), ("d", 2 * S.BLOCK - 1, "well", "known", 2 * S.BLOCK, "-", False)], "document_id string, line_no int, token string, right string, line_no2 int, hyphen string, joins boolean"),
        "corrections": spark.createDataFrame([("mess@ge", "message", [4])], "token string, correction string, places array<int>"),
    }
    got = sorted((r["first_line"], r["last_line"], r["text"]) for r in S.paragraphs(found).collect())
    assert got == [(1, n + 1, want + " end."), (after, after, "Next")]


def test_empty(spark):
    d = spark.createDataFrame([], "document_id string, line_no int, page int, text string")
    f = S.scan_findings(d)
    assert S.line_kinds(f).count() == 0 and S.paragraphs(f).count() == 0


@pytest.mark.parametrize("c, w, out", [("rejected", "rejectcd", [("e", "c", 6)]), ("modern", "modem", [("rn", "m", 4)]), ("item", "itern", [("m", "rn", 3)]), ("close", "cl0sc", [("o", "0", 2), ("e", "c", 4)]), ("abc", "abc", []), ("short", "something", None)])
def test_align(c, w, out):
    assert S.align(c, w) == out


@pytest.mark.parametrize("t, n", [("- 12 -", (12, "- 9 -")), ("iii", (3, "roman")), ("Page 2 of 9", (2, "Page 9 of 9")), ("viii", (8, "roman")), ("text", None), ("trimestral.", None), ("3/7", (3, "9/9"))])
def test_page_numbers(t, n):
    assert S.page_number(t) == n


def test_boosting_learns_and_generalises():
    r = np.random.default_rng(0)
    x = r.standard_normal((3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    m = Boosted().fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert len(Boosted().fit(np.zeros((0, 4)), np.zeros(0)).score(x[:3])) == 3


def test_hyphen_training_uses_counts_of_the_whole_corpus(spark, monkeypatch):
    seen = []

    fit = Boosted.fit
    monkeypatch.setattr(Boosted, "fit", lambda m, x, y: seen.append((x, y)) or fit(m, x, y))
    letters = "abcdefghijklmnopqrst"
    whole = [(f"{a}x{b}y", 5) for a in letters for b in letters]
    words = spark.createDataFrame(whole + [(f"{a}{c}", 900) for a in letters for c in "xy"], "word string, n long")
    compounds = spark.createDataFrame([(f"{a}x-{b}y", 7) for a in letters for b in letters], "word string, n long")
    tokens = spark.createDataFrame([("ax", "by", "-")], "token string, right string, hyphen string")
    S.judge_breaks(tokens, words, compounds, sample_rows=40)
    (x, y), = seen
    assert 20 < (y == 1).sum() < 400 and np.allclose(x[:, 2], np.log1p(900))
    # an example counts all occurrences but itself
    assert np.allclose(x[y == 1, 0], np.log1p(4)) and np.allclose(x[y == 1, 1], np.log1p(7))
    assert np.allclose(x[y == 0, 0], np.log1p(5)) and np.allclose(x[y == 0, 1], np.log1p(6))
