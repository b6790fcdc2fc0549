"""Functions on cases with known results, random ones included."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumspark.functions import latex, speak
from vellumspark.functions import license as L
from vellumspark.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_number_words():
    assert speak.whole(2294) == "two thousand two hundred and ninety-four"
    assert speak.whole(1_000_005) == "one million five"
    assert speak.number("1.960") == "one point nine six"
    assert speak.year(1905) == "nineteen oh five"
    assert [speak.roman(x) for x in ("I", "IV", "IX", "XXXIX", "IIII", "", "VX")] == [1, 4, 9, 39, None, None, None]


@given(st.integers(0, 10**8))
@settings(max_examples=200, deadline=None)
def test_number_words_are_words(n):
    assert speak.whole(n).replace("-", " ").replace(" ", "").isalpha()


def test_numbers(spark):
    text = F.lit("2,294 tasks, 1.960% of 438K in Table 5 and Figure 12; é12 a3 3.4.5")
    assert one(spark, T.stated_numbers(text))[:3] == ["2,294", "1.960", "438"]
    known = one(spark, T.known_numbers(text))
    assert {"2294", "1.96", "438", "438000", "5"} <= set(known)
    assert one(spark, T.norm_number(F.lit("0.00"))) == "0"
    assert one(spark, T.norm_number(F.lit("1,000"))) == "1000"


def test_nulls_stay_null(spark):
    null = F.lit(None).cast("string")
    assert one(spark, T.stated_numbers(null)) is None
    assert one(spark, L.linked_license(null)) is None
    assert one(spark, T.figure_label(null)) is None


def test_syllables(spark):
    words = ["table", "the", "rhythm", "estimate", "x1", "42", "queue"]
    assert [one(spark, T.syllables(F.lit(w))) for w in words] == [1, 1, 1, 3, 1, 0, 1]


def test_license_notice_far_down(spark):
    far = "x " * 15000
    assert one(spark, L.license_of(F.lit(far + "We used a CC BY dataset."))) == ""
    assert one(spark, L.license_of(F.lit(far + "This article is licensed under a Creative Commons Attribution License"))) == "CC BY 4.0"


def test_macros_and_braces():
    macros = latex.definitions(r"\newcommand{\p}[2]{P(#1 \mid #2)}\DeclareMathOperator{\sg}{sg}")
    assert latex.expanded(r"\p{a}{b_{c}} + \sg x", macros) == r"P(a \mid b_{c}) + \operatorname{sg} x"
    assert latex.braced("{a{b}c}d", 0) == ("a{b}c", 7)
    assert latex.braced("{a", 0) == (None, 0)
    assert latex.equations("") == []


def test_similarity():
    assert latex.similarity("θ i − β j", r"\theta_i - \beta_j") > 0.7
    assert latex.similarity("", "x") == 0.0


def test_flattened_once_and_missing():
    files = {"m.tex": "\\documentclass{a}\\begin{document}\\input{a}\\input{a}\\input{none}\\end{document}", "a.tex": "A\\input{m}"}
    assert latex.flattened(files) == "\\documentclass{a}\\begin{document}A\\end{document}"
