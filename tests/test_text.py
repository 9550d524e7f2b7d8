import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symgrove.functions import text as T

IGNORE = [
    ("test/test_foo.cpp", "test/", True),
    ("./test/foo.cpp", "test/", True),
    ("/home/repo/test/foo.cpp", "test/", True),
    ("src/test.cpp", "test/", False),
    ("foo.test.cpp", "*.test.cpp", True),
    ("foo.cpp", "*.test.cpp", False),
    ("bar.md", "*.md", True),
    ("src/generated_foo.cpp", "generated*", True),
    ("src/normal.cpp", "generated*", False),
    ("path/to/examples/demo.cpp", "examples", True),
    ("include/third_party/foo.h", "third_party", True),
]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("path,pattern,hit", IGNORE)
def test_ignore(spark, path, pattern, hit):
    assert one(spark, T.ignored(F.lit(path), [pattern])) is hit


def test_ignore_file():
    assert T.ignore_patterns("# x\n\n  a/  \n*.b") == ["a/", "*.b"]


@pytest.mark.parametrize(
    "text,want",
    [("foo_bar", ["foo", "bar"]), ("FooBar", ["foobar"]), ("调用图 é a", ["调用图", "é"]), ("the return x1", ["x1"]), ("", []), (None, []), ("a b a", []), ("ab AB ab", ["ab"])],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("a,b,want", [([], [], 0.0), (["a"], ["a"], 1.0), (["a", "b"], ["b", "c"], 1 / 3)])
def test_jaccard(spark, a, b, want):
    arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, T.jaccard(arr(a), arr(b))) == pytest.approx(want)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abcdef"), unique=True), st.lists(st.sampled_from("abcdef"), unique=True))
def test_jaccard_properties(spark, a, b):
    arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    x, y, z = spark.range(1).select(T.jaccard(arr(a), arr(b)), T.jaccard(arr(b), arr(a)), T.jaccard(arr(a), arr(a))).first()
    assert x == y and 0 <= x <= 1 and z == (1 if a else 0)


@pytest.mark.parametrize("a,b,want", [([], [1.0], 0.0), ([0.0], [1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], 0.0), ([1.0, 9.0], [2.0], 1.0), (None, [1.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(T.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("col,part,hit", [("LoadQueue", "queue", True), ("É", "é", False), ("a\\b", "a\\b", True), ("axb", "a_b", True), ("ab", "a%b", True), ("x", "y", False)])
def test_like(spark, col, part, hit):
    assert one(spark, T.contains(F.lit(col), part)) is hit


def test_labels_and_paths(spark):
    row = spark.range(1).select(T.label_kind(F.lit("calls:std::move")), T.label_target(F.lit("calls:std::move")), T.label_target(F.lit("x")), T.stem(F.lit("a/b.c.md")), T.extension(F.lit("a/b.c.md")), T.extension(F.lit("a/.md")), T.language_of(F.lit("x.HPP")), T.language_of(F.lit("x.hpp"))).first()
    assert tuple(row) == ("calls", "std::move", "", "b.c", "md", "", None, "cpp")
