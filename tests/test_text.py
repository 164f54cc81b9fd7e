import pytest
from pyspark.sql import functions as F

from inkgrid.config import EngineConfig, load_env_file
from inkgrid.functions import text as T


def one(spark, fn, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "value, canonical",
    [("Hello  WORLD", "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"), ("ﬁle ①", "83bf7fcd913e81d35f0d0e94ed1ec0611e8e3b4909c23b00ef9f076f205e67c6"), ("  ", ""), (None, None)],
)
def test_canonical_hash(spark, value, canonical):
    assert one(spark, T.canonical_hash, value) == canonical


@pytest.mark.parametrize("value, h", [("", 14695981039346656037), ("a", 12638187200555641996), ("a b c", 7624391895601202607), ("the quick brown", 10025113595126182347)])
def test_fnv(spark, value, h):
    assert int(one(spark, T.fnv1a64, value)) == h


@pytest.mark.parametrize(
    "fn, value, out",
    [
        (T.strip_control, "a\rb\tc\n", "ab\tc\n"),
        (T.normalize_text, "infor-\nmation is\n\nok", "information is\nok"),
        (T.normalize_text, "end-\n\nnext", "end-\nnext"),
        (T.normalize_text, "a-\nb-\nc", "ab-\nc"),
        (T.clean_chunk_text, "infor-\nmation  is\n \nok", "infor-\nmation is\nok"),
        (T.collapse_ws, " a  b\n c ", "a b c"),
        (T.query_text, "Search_Query: x", "Search_Query: x"),
        (T.query_text, "x", "search_query: x"),
        (T.normalize_text, None, None),
        (T.normalize_text, "", ""),
    ],
)
def test_normalisers(spark, fn, value, out):
    assert one(spark, fn, value) == out


@pytest.mark.parametrize("value, h", [("The quick brown fox jumps over the lazy dog", 4.431965), ("aaaaaaaaaaaaaaaaaaaa bb cc dd", 1.506483), ("abab", 1.0), ("", 0.0)])
def test_entropy(spark, value, h):
    assert one(spark, T.entropy, value) == pytest.approx(h, abs=1e-6)


def test_vector_codec(spark):
    assert one(spark, lambda c: T.parse_vector(T.format_vector(c)), [1.0, -0.5, 1e-7], "array<float>") == pytest.approx([1.0, -0.5, 1e-7])


def test_stable_id_differs_by_part(spark):
    a = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("a", None)], "x string, y string").select(T.stable_id(F.col("x"), F.col("y")).alias("i")).collect()
    assert len({r["i"] for r in a}) == 3 and all(len(r["i"]) == 36 for r in a)


def test_metadata_json_leaves_out_empties(spark):
    d = spark.sql("select named_struct('tenant_id','', 'section_heading','h','entities', array('a'), 'keywords', cast(array() as array<string>), 'n', 1) m")
    assert d.select(T.metadata_json(F.col("m")).alias("j")).first()["j"] == '{"section_heading":"h","entities":["a"],"n":1}'


def test_config():
    c = EngineConfig.load({"INKGRID_CHUNK_BUDGET": "7", "INKGRID_STOP_WORDS": "a, b", "INKGRID_ENRICH_DUPLICATES": "true", "OTHER": "x"})
    assert c.chunk_budget == 7 and c.stop_words == ("a", "b") and c.enrich_duplicates and c.chunk_overlap == 80
    with pytest.raises(ValueError):
        EngineConfig.load({}, required=("chunk_budget",))
    assert load_env_file("# c\nexport A='1'\nA=2\n\nB = x") == {"A": "1", "B": "x"}
