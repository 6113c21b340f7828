"""Micro-goldens of the text functions, one per trap that touches them."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.functions import arrays, lcs, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).collect()[0][0]


@pytest.mark.parametrize(
    ("function", "given_", "wanted"),
    [
        (text.symbols_replaced, "a_b{c}", "a bc"),
        (text.html_decoded, "&quot;x&quot; &amp; y &#39;z&#39;", "\"x\" & y 'z'"),
        (text.html_decoded, "caf&eacute; &frac12;", "caf&eacute; &frac12;"),
        (text.html_decoded, "&#8217; caf&eacute; &amp;quot;", "’ caf&eacute; &quot;"),
        (text.html_decoded, "&#38;lt; &#038;", "&lt; &"),
        (text.regex_escaped, "a.b(c)_[d]", r"a\.b\(c\)_\[d\]"),
        (text.question_finished, "Wat is P1 van Q1?", "wat is p1 van q1 ?"),
        (text.question_finished, "Q1 heeft mp3 en (P2)?", " q1 heeft m p3 en ( p2 ) ?"),
        (text.answer_finished, "SELECT ?ans ?ans_1 WHERE { wd:Q1 wdt:P1 ?ans_1 . ?ans_1 wdt:P11 ?ans }", "select var_1 var_1_1 where brack_open q1 p1 var_1_1 sep_dot var_1_1 p11 var_1 brack_close"),
        (text.answer_finished, "ASK WHERE { wd:Q1 p:P1 ?s FILTER(?s > 3.5) }", "ask where brack_open q1 p1 var_1 filter attr_open var_1 > 3 sep_dot 5 attr_close brack_close"),
        (text.answer_finished, "SELECT ?x, ?x WHERE {?x wdt:P1 wd:Q1.}", "select var_1 , var_1 where brack_open var_1 p1 q1 sep_dot brack_close"),
        (text.url_encoded, "a b~c*d", "a%20b~c%2Ad"),
        (text.ids_of, "wd:Q42 wdt:P31 wd:Q421 wdt:P31", ["P31", "Q42", "Q421"]),
        (text.masks_switched, "P1 Q22 x", "R1 S22 x"),
        (text.prediction_joined, " < a > b _attr_open , c ", "<a> b_ attr_open,c"),
        (text.words_of, "  a\t b\n", ["a", "b"]),
        (text.words_of, " ", []),
        (text.unique_code_points, "abca", ["a", "b", "c"]),
        (text.entity_kind, "&amp;", "character"),
        (text.entity_kind, "&#12;", "numeric"),
        (text.id_kind, "P31", "property"),
    ],
)
def test_function(spark, function, given_, wanted):
    assert one(spark, function(F.col("t")), t=given_) == wanted


def test_errors_and_choice(spark):
    assert one(spark, text.errors_replaced(F.col("q"), F.col("r")), q="Wie is ERROR12 ?", r="4th Knesset") == "Wie is 4th Knesset?"
    assert one(spark, text.errors_replaced(F.col("q"), F.col("r")), q="ERROR1 x", r="a$1\\b") == "a$1\\b x"
    assert one(spark, text.errors_replaced(F.col("q"), F.lit(None).cast("string")), q="Wie is ERROR12 ?") == "Wie is ERROR12 ?"
    assert one(spark, text.chosen_question(F.col("q"), F.col("p"), F.col("n")), q="short", p="x" * 21, n="t") == "x" * 21
    assert one(spark, text.chosen_question(F.col("q"), F.col("p"), F.col("n")), q="short", p="x" * 20, n="t") == "t"
    with pytest.raises(Exception, match="no question"):
        one(spark, text.chosen_question(F.col("q"), F.col("p"), F.lit(None).cast("string")), q="short", p="x")
    with pytest.raises(Exception, match="neither"):
        one(spark, text.id_kind(F.col("t")), t="X1")


@pytest.mark.parametrize(("ours", "theirs", "plain", "strict"), [("P1 Q1", "P0 Q0", True, True), ("Q1 Q2", "Q1 Q10", False, True), ("Q1 Q1", "Q1 Q2", True, False), ("Q1 x", "Q1 y", False, False), ("Q1", "Q1 Q2", False, False)])
def test_alpha_equivalence(spark, ours, theirs, plain, strict):
    assert one(spark, text.alpha_equivalent(F.col("a"), F.col("b")), a=ours, b=theirs) is plain
    assert one(spark, text.alpha_equivalent(F.col("a"), F.col("b"), strict=True), a=ours, b=theirs) is strict


def test_bounds(spark):
    assert tuple(one(spark, text.first_bounds(F.col("t"), F.col("p")), t="xabab", p="ab")) == (2, 3)
    assert one(spark, text.first_bounds(F.col("t"), F.col("p")), t="x", p="ab") is None
    assert one(spark, text.first_replaced(F.col("t"), F.col("p"), F.lit("-")), t="xabab", p="ab") == "x-ab"


@pytest.mark.parametrize(("a", "b", "wanted"), [("abcxyz", "xyzabc", "abc"), ("héllo", "yéll", "éll"), ("abc", "xyz", None), ("", "a", None)])
def test_common_substring(spark, a, b, wanted):
    assert one(spark, text.longest_common_substring(F.col("a"), F.col("b")), a=a, b=b) == wanted
    assert lcs.longest(a, b) == wanted


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=12), st.text("abé", max_size=12))
def test_common_substring_against_brute_force(a, b):
    every = {a[i:j] for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b}
    assert lcs.longest(a, b) == min(every, key=lambda x: (-len(x), x), default=None)


def test_arrays(spark):
    assert one(spark, arrays.before(F.array(F.lit(1), F.lit(2), F.lit(0), F.lit(3)), 0)) == [1, 2]
    assert one(spark, arrays.before(F.array(F.lit(1), F.lit(2)), 0)) == [1, 2]
    assert one(spark, arrays.padded(F.array(F.lit(1), F.lit(2)), 4, 9)) == [1, 2, 9, 9]
    assert one(spark, arrays.attention(F.array(F.lit(1), F.lit(2)), 4)) == [1, 1, 0, 0]
    assert arrays.summarised([3, 1, 2, 9]) == "{1, 2, ..., 9}" and arrays.summarised([2, 1]) == "{1, 2}"
    assert [one(spark, arrays.schedule(F.lit(s), 100)) for s in (0, 5, 10, 55, 100)] == [0.0, 0.5, 1.0, 0.5, 0.0]
    assert abs(one(spark, arrays.smoothed_loss(arrays.log_softmax(F.array(F.lit(1.0), F.lit(1.0))), F.lit(0), 0.2)) - 0.6931471805599453) < 1e-12
