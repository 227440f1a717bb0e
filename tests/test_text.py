import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.sources.parsers import redacted


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,want", [
    ("k = sk-ant-abcdefgh1", "k = <redacted>"), ("password: hunter22", "<redacted>"), ("api_key=<str>", "api_key=<str>"),
    ("Authorization: Bearer abcdefgh12", "Authorization: <redacted>"), ("postgres://u:p4ss@h/db", "<redacted>h/db"), ("plain words", "plain words"), (None, None),
])
def test_redact(spark, text, want):
    assert one(spark, text, T.redact) == want
    if text is not None:
        assert redacted(text) == want


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="ab .=:sk-token\xa0'\"", max_size=60), min_size=5, max_size=30))
def test_redact_is_idempotent_and_equals_python(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        pytest.skip("no session")
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for r in df.select("x", T.redact(F.col("x")).alias("y"), T.redact(T.redact(F.col("x"))).alias("z")).collect():
        assert r["y"] == redacted(r["x"]) == r["z"]


def test_lines(spark):
    for t in ("", "a", "a\n", "a\nb", "a\r\nb\rc\n", "\n\n"):
        assert one(spark, t, T.prose_lines) == len(t.splitlines())
        assert one(spark, t, T.code_lines) == t.count("\n") + 1


def test_ranges(spark):
    t = "\n".join(map(str, range(1, 1001)))
    assert one(spark, t, lambda x: T.read_range(x, F.lit(2), F.lit(3))) == "2\n3"
    assert one(spark, t, lambda x: T.read_range(x, F.lit(2000), F.lit(3000))) == "(EOF: 1000 lines)"
    assert one(spark, t, lambda x: T.read_range(x, F.lit(1), F.lit(1000))).endswith("400\n(capped at 400 lines)")
    assert one(spark, t, T.read_full).endswith("(truncated at 400 of 1000 lines)")
    assert one(spark, "a\nb", T.read_full) == "a\nb"


def test_edit(spark):
    f = lambda x: T.replace_unique(x, F.lit("b"), F.lit("Z"))
    assert one(spark, "abc", f) == "aZc" and one(spark, "abb", f) is None and one(spark, "ac", f) is None


def test_names(spark):
    assert one(spark, "a.b.c", T.leaf) == "c" and one(spark, "a.b.c", T.head) == "a"
    assert sorted(one(spark, "src/load_big-table.test.py", T.name_tokens)) == ["big", "load", "table"]
    assert one(spark, "src/core/a.py", T.folder_label) == "core" and one(spark, "a.py", T.folder_label) == "(root)"
    assert one(spark, "v1.10.2", T.version_tuple) == [1, 10, 2]
    assert one(spark, "### Title", T.heading_level) == 3 and one(spark, "### Title", T.heading_label) == "Title"
    assert one(spark, "Pärse_header ünï", T.search_tokens) == ["parse", "header", "uni"]
    assert one(spark, "x\nrefreshed: now\ny", T.strip_timestamp) == "x\ny"


def test_confined_paths_cannot_climb_out(spark):
    import os

    paths = ["/r/a", "/r", "/r/", "/r/../etc", "/r/a/../../r/b", "/rx/a", "//r//a/./b", "/..", "/r/..", "/r/a/..", "", "/"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.normal_path(F.col("p")).alias("n"), T.confined(F.col("p"), "/r").alias("c")).collect()
    for r in got:
        n = os.path.normpath("/" + r["p"].lstrip("/"))
        assert r["n"] == n and r["c"] == (n == "/r" or n.startswith("/r/"))
