import json
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeweave.functions import (
    combined_text,
    estimated_tokens,
    has_text,
    rebuild_abstract,
    rebuild_abstract_json,
    safe_date,
)
from citeweave.functions.text import strip, year_in_range


def apply(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("v"))).collect()]


def test_has_text_counts_tabs_but_no_spaces(spark):
    values = ["", "  ", " ", "　 ", "\t", "\n", " a ", None]
    assert apply(spark, values, has_text) == [False, False, False, False, True, True, True, None]


def test_strip_removes_all_white_space(spark):
    values = [" \t\na b\r\n ", "\x1c\x85x", "", "a\n"]
    assert apply(spark, values, strip) == ["a b", "x", "", "a"]


def test_safe_date(spark):
    values = ["2020", "2020-01", "2020-1-5", "2020/01/05", "2020-13-01", "", None,
              "2020-01-05T10:00:00", "unknown", "2020/01-05"]
    fifth = date(2020, 1, 5)
    assert apply(spark, values, safe_date) == [
        None, None, fifth, fifth, None, None, None, fifth, None, None
    ]


def test_year_range_lets_unknown_years_pass(spark):
    years = [None, 0, 1999, 2000, 2010, 2011]
    test = lambda c: year_in_range(c, 2000, 2010)
    assert apply(spark, years, test, "int") == [True, True, False, True, True, False]
    assert apply(spark, years, lambda c: year_in_range(c, 2000), "int")[-1] is True
    assert apply(spark, years, lambda c: year_in_range(c, None, 2000), "int")[2:] == [
        True, True, False, False
    ]


def test_tokens_count_code_points_and_treat_null_as_empty(spark):
    frame = spark.createDataFrame([("añ", None), (None, "12345"), ("😀", "x")], "t string, a string")
    assert [r[0] for r in frame.select(estimated_tokens("t", "a")).collect()] == [0.5, 1.25, 0.5]
    assert [r[0] for r in frame.select(combined_text("t", "a")).collect()] == [
        "añ ", " 12345", "😀 x"
    ]


@pytest.mark.parametrize(
    "raw, expected",
    [
        (None, ""),
        ("{}", ""),
        ('{"a":[0,2],"b":[1]}', "a b a"),
        ('{"b":[7],"a":[2]}', "a b"),
        ('{"a":[1,1],"b":[1]}', "a a b"),
        ('{"a":[0],"b":[2],"a":[3]}', "b a"),
        ('{"a":[2],"b":[2],"a":[2]}', "a b"),
        ('{"a":[0],"b":7,"c":[1]}', "a c"),
        ('{"a":null,"b":[1]}', "b"),
        ("[]", ""),
        ('"text"', ""),
        ("no json", ""),
    ],
)
def test_rebuild_from_json(spark, raw, expected):
    assert apply(spark, [raw], rebuild_abstract_json) == [expected]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.text("abcäß ÜZ0.", min_size=1, max_size=4), max_size=30), max_size=5))
def test_rebuild_round_trip(spark, texts):
    texts = [[w.replace(" ", "_") for w in words] for words in texts]
    indexes = []
    for words in texts:
        index = {}
        for place, word in enumerate(words):
            index.setdefault(word, []).append(place * 3)
        indexes.append(index)
    expected = [" ".join(words) for words in texts]
    assert apply(spark, [json.dumps(i) for i in indexes], rebuild_abstract_json) == expected
    assert apply(spark, indexes, rebuild_abstract, "map<string,array<int>>") == expected
