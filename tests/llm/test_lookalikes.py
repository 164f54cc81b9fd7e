import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkgrid.llm import lookalikes as L

TEXTS = ["Report of the café: 12 files", "Rеpоrt оf the café: 12 files", "Ｒｅｐｏｒｔ of the café: １２ files", "Report of the caf​é: 12  ﬁles", "Report of the cafe: 12 files", "report of the café: 12 files", "Report of the café: 13 files", "Report of\nthe café: 12 files", "サブ ｻﾌﾞ", "ｻﾌﾞ サブ", None, "", "​"]


@pytest.fixture(scope="module")
def rules():
    c = {}
    for t in TEXTS:
        for x in t or "":
            c[x] = c.get(x, 0) + 1
    return L.rewrite_rules(c | {x: 1000 for x in "abcdefghijklmnopqrstuvwxyzR é"})


def test_rewriting(rules):
    r = L.Rewriter(rules)
    out = [r(t) for t in TEXTS]
    assert len(set(out[:4])) == 1 and out[0] == TEXTS[0]
    assert len({out[0], *out[4:8]}) == 5 and out[8] == out[9] and out[10] is None and out[11] == out[12] == ""
    assert all(r(x) == x for x in out if x)


def test_classes_are_transitive():
    u = L.UnionFind()
    u.union("a", "b")
    u.union("b", "c")
    u.union("x", "y")
    assert sorted(sorted(c) for c in u.classes()) == [["a", "b", "c"], ["x", "y"]]


def test_the_commonest_member_represents_its_class():
    assert L.rewrite_rules({"о": 100, "o": 1})["o"] == "о" and L.rewrite_rules({"о": 1, "o": 100})["о"] == "o"
    assert "²" not in L.rewrite_rules({"²": 5, "2": 9}) and "①" not in L.rewrite_rules({"①": 5, "1": 9}) and "Σ" not in L.rewrite_rules({"Σ": 1, "C": 9})


def test_pairs(spark, rules):
    d = spark.createDataFrame([(f"i{k:02d}", t, "x") for k, t in enumerate(TEXTS)] + [("i00", TEXTS[0], "y"), ("copy", TEXTS[0], "z")], "id string, content string, look string")
    looks = L.rewrite(d, rules, hashes_only=True)
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in L.look_alike_pairs(looks).collect()}
    same = ["i00", "i01", "i02", "i03", "copy"]
    want = {tuple(sorted(p)) for p in itertools.combinations(same, 2)} - {("copy", "i00")} | {("i08", "i09"), ("i11", "i12")}
    assert got == want
    assert L.look_alike_pairs(L.rewrite(d.limit(0), rules, hashes_only=True)).count() == 0


def test_counts(spark):
    d = spark.createDataFrame([("aab",), (None,), ("",), ("é" * 1000,)], "content string")
    assert L.code_point_counts(d, "content") == {"a": 2, "b": 1, "é": 1000}
    assert L.code_point_counts(d.limit(0), "content") == {}


def test_hot_text(spark, rules):
    d = spark.range(6000).selectExpr("concat('k', id) id", "if(id % 3 = 0, 'same text', concat('t ', id)) content").unionByName(spark.createDataFrame([("odd", "samе text")], "id string, content string"))
    assert L.look_alike_pairs(L.rewrite(d, rules, hashes_only=True)).count() == 2000


def test_runs_of_spaces_of_any_length():
    r = L.Rewriter(L.rewrite_rules({x: 10 for x in "ab \n "}))
    for n in (2, 64, 65, 127, 1000, 100_001):
        assert r("a" + " " * n + "b") == "a b" and r("a" + "  " * n + "b") == "a b" and r("a" + " " * n + "\nb") == "a\nb"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aаαeе é\u0301\u0308oοօ \u00a0\u2003\u3000\t\u200b\u00ad\n\rＡAfiﬁ-‐\u0323", max_size=40))
def test_rewriting_is_idempotent(t):
    for counts in ({}, {"а": 50, "e": 9}):
        c = counts | {x: counts.get(x, 0) + 1 for x in t}
        r = L.Rewriter(L.rewrite_rules(c))
        assert r(r(t)) == r(t)


@pytest.mark.parametrize("gap", [" " * 65, " " * 200, " \u00a0\u2003" * 99, "\u3000" * 70])
def test_gaps_of_any_width(gap):
    r = L.Rewriter(L.rewrite_rules({x: 9 for x in "ab\n"} | {x: 1 for x in gap}))
    assert r(f"a{gap}b") == "a b" and r(f"a{gap}\nb") == "a\nb" and r(r(f"a{gap}b")) == "a b"


def test_letters_of_many_alphabets_look_alike():
    r = L.Rewriter(L.rewrite_rules({x: 50 for x in "CODE code"} | {x: 1 for x in "ᏟОᎠᎬꓚꓳꓓꓰⲤⲞⲥօ"}))
    assert r("ᏟОᎠᎬ") == r("ꓚꓳꓓꓰ") == "CODE" and r("ⲥօde") == "code"
