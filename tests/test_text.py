import time

import regex
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.functions.grades import relative, round_up
from quillmark.functions.vectors import cosine
from quillmark.operators.items import cast_points, cast_text, is_answered, scheme_text

PUBLISHED = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)


def apply(spark, expression, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_strip_takes_line_breaks_and_unicode_spaces(spark):
    values = ["\n\t a b \r\n", " x ", "", " \n", "\x1cy\x85", None]
    got = apply(spark, text.strip, *values)
    assert got == [v.strip() if v is not None else None for v in values]


def test_white_space_is_no_answer(spark):
    values = ["", " ", "\n　\t", None, "None", "0", " a"]
    assert apply(spark, is_answered, *values) == [False] * 4 + [True] * 3


def test_first_number(spark):
    values = [".5", "-5", "-0.5", "+2.5 of 3", "no number", "", "a 12 b 3", "1.2.3", None]
    assert apply(spark, text.first_number, *values) == [
        0.5, 5.0, -0.5, 2.5, None, None, 12.0, 1.2, None,
    ]


def test_to_last_full_stop(spark):
    values = ["Good. rest", "no stop  ", "1.5", "", "a.\nb", "..."]
    assert apply(spark, text.to_last_full_stop, *values) == ["Good.", "no stop.", "1.", ".", "a.", "..."]


def test_echo_is_kept_only_if_absent(spark):
    df = spark.createDataFrame(
        [("ask", "ask 3 points "), ("ask", " 2"), ("ask", "so: ask me"), ("", "x")], "p string, t string"
    )
    got = [r[0] for r in df.select(text.after_echo(F.col("t"), F.col("p"))).collect()]
    assert got == ["3 points", "2", "me", "x"]


def test_pre_tokens_are_the_published_ones(spark):
    values = [
        "I'll go,  it's\n\n 3 o'clock   ok!\t\tend  ", "a b", "", "   ", "Été 12½… x'tre",
        "don't  stop\n", "tab\tnewline\n x",
    ]
    for budget in (1, 2, 3, 7, 924):
        got = apply(spark, lambda v: text.truncate_tokens(v, budget), *values)
        assert got == ["".join(PUBLISHED.findall(v)[:budget]) for v in values]


def test_truncation_may_keep_the_cue(spark):
    long = "word " * 50
    got = apply(spark, lambda v: text.truncate_tokens(v, 10, "Score:"), long, "short")
    assert got[0].endswith(" Score:") and len(PUBLISHED.findall(got[0])) == 10
    assert got[1] == "short"


def test_what_follows_the_budget_is_not_looked_at(spark):
    values = [" ".join("ab"[n % 2] * (n % 7 + 1) + "!1"[n % 3 == 0] for n in range(3000)), "\n" * 3000, "x" * 9000, "  a\u00a0b" * 900, "", None]
    for budget in (1, 3, 924, 2500):
        got = apply(spark, lambda v: text.truncate_tokens(v, budget), *values)  # noqa: B023
        assert got == [v and "".join(PUBLISHED.findall(v)[:budget]) for v in values]
    long = spark.createDataFrame([("one 2, " * 2_000_000,)], "v string").select(text.truncate_tokens(F.col("v")).alias("v"))
    start = time.perf_counter()
    assert len(PUBLISHED.findall(long.first().v)) == 924
    assert time.perf_counter() - start < 5


def test_rounding_up(spark):
    df = spark.createDataFrame([(2.0000000001,), (2.01,), (0.0,), (-0.3,), (1.25,), (None,)], "v double")
    read = lambda m: [r[0] for r in df.select(round_up(F.col("v"), m)).collect()]
    assert read("Full Points") == [2.0, 3.0, 0.0, 0.0, 2.0, None]
    assert read("Half Points") == [2.0, 2.5, 0.0, 0.0, 1.5, None]
    assert read("Quarter Points") == [2.0, 2.25, 0.0, -0.25, 1.25, None]
    assert read("None of these")[1] == 2.01


def test_relative_points(spark):
    df = spark.createDataFrame([("1", 2.0), ("1", 0.0), ("", 2.0), ("x", 1.0)], "g string, p double")
    assert [r[0] for r in df.select(relative(F.col("g"), F.col("p"))).collect()] == [0.5, None, None, None]


def test_casts(spark):
    df = spark.createDataFrame([(None, "2.5"), ("None", ""), ("a", "x")], "t string, p string")
    got = [tuple(r) for r in cast_points(cast_text(df, "t"), "p").collect()]
    assert got == [("", 2.5), ("None", None), ("a", None)]


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 2.0]), ([float("nan"), 1.0], [1.0, 1.0]), (None, [1.0])],
        "a array<float>, b array<float>",
    )
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1:] == [0.0, None, None]


def test_unknown_scheme_is_quarter_points(spark):
    got = apply(spark, scheme_text, "full_points", "half_points", "other", None)
    assert [g.split(" like")[0] for g in got] == [
        "full points", "full points or half points",
        "full points or quarter points", "full points or quarter points",
    ]
