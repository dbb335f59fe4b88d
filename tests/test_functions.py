"""Single functions and predicates on literal rows."""

import json
import re
import unicodedata

import pytest
import yaml
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import spec
from corpusloom.functions import predicates as P
from corpusloom.functions import text as X


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(column(F.col("t"))).collect()]


def by_hand(t):
    t = unicodedata.normalize("NFKC", t)
    t = "".join(" " if c in "\n\t\r" else "" if unicodedata.category(c) in ("Cc", "Cf", "Co") else c for c in t)
    return " ".join(t.split())


CASES = ["", "  a\tb\n c ", "a\vb", "soft­hyphen", "zero‍width", "ﬁ ½ ①", "﻿bom", "Straße ẞ", "x　y z", "\x85a\x1cb", "é é"]


def test_clean(spark):
    assert values(spark, CASES, X.clean) == [by_hand(t) for t in CASES]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn"))), min_size=1, max_size=20))
def test_clean_and_words_of_any_text(spark, rows):
    assert values(spark, rows, lambda c: X.clean(c)) == [by_hand(t) for t in rows]
    assert values(spark, rows, lambda c: X.normalized_words(X.clean(c))) == [re.findall("[a-z0-9]+", by_hand(t).casefold()) for t in rows]


def test_shingles_need_enough_words(spark):
    assert values(spark, ["a b c d", "a b"], lambda c: X.word_shingles(X.normalized_words(c), 3)) == [["a b c", "b c d"], []]


def test_slug_and_template(spark):
    assert values(spark, ["Source A / synthetic"], X.slug) == ["source-a-synthetic"]
    with pytest.raises(Exception, match="no letters"):
        values(spark, ["///"], X.slug)
    df = spark.createDataFrame([(" why ", "so"), ("why", "  ")], "question string, response string")
    got = df.select(X.render("Question: {question}\nAnswer: {response}", {c: df[c] for c in df.columns})).collect()
    assert [r[0] for r in got] == ["Question: why\nAnswer: so", None]
    with pytest.raises(ValueError):
        X.render("{a!r}", {"a": F.lit("")})


def test_segments_and_stops(spark):
    assert values(spark, ["abcde", ""], lambda c: X.segments(c, 2)) == [["ab", "cd", "e"], [""]]
    assert values(spark, ["one. two, three"], lambda c: X.until_stops(c, [",", "."])) == ["one"]


def test_byte_level(spark):
    assert values(spark, ["Ġab", "Ċ"], X.byte_level_hex) == ["206162", "0A"]


#: A row, filters, and whether it passes: bounds hold from the least on and below the most, members and languages are spelled in several ways.
FILTER_ROWS = [
    ({"language": "ENG"}, {"language": "english"}, True),
    ({"language": " en_GB"}, {"language": "en"}, True),
    ({"language": "english"}, {"language": "EN"}, True),
    ({"language": "enx"}, {"language": "en"}, False),
    ({"language": None}, {"language": "en"}, False),
    ({"edu_int_score": 7}, {"edu_int_score_min": 7}, True),
    ({"edu_int_score": 6}, {"edu_int_score_min": 7}, False),
    ({"language_score": 0.25}, {"language_score_min": 0.25}, True),
    ({"rank": 12.5}, {"rank_min": 12.5}, True),
    ({"rank": 12.5}, {"rank_max": 12.5}, False),
    ({"rank": 12.25}, {"rank_min": 3, "rank_max": 12.5}, True),
    ({"rank": "-1e3"}, {"rank_max": 0}, True),
    ({"rank": None}, {"rank_min": -1}, False),
    ({"colour": "red"}, {"colour_in": ["blue", "red"]}, True),
    ({"colour": "Red"}, {"colour_in": ["blue", "red"]}, False),
    ({"colour": "red", "rank": 4}, {"colour_in": ["red"], "rank_min": 5}, False),
    ({"colour": "red"}, {"rank_max": 5}, False),
    ({"colour": "red"}, {"unknown": 1}, True),
    ({}, {}, True),
]


@pytest.mark.parametrize("row,filters,passes", FILTER_ROWS)
def test_filters_on_metadata(spark, row, filters, passes):
    df = spark.createDataFrame([(json.dumps(row),)], "meta string")
    assert df.where(P.conditions(df, filters)).count() == int(passes)


def test_filters_on_columns(spark):
    df = spark.createDataFrame([(float("nan"), ["fr", "en"], None), (1.0, ["fr"], "x")], "score double, language array<string>, meta string")
    assert df.where(P.conditions(df, {"score_min": 0.5})).count() == 1
    assert df.where(P.conditions(df, {"language": "english"})).count() == 1
    nan = df.withColumnRenamed("score", "language_score")
    assert nan.where(P.conditions(nan, {"language_score_min": 5})).count() == 1
    empty = spark.createDataFrame([(None, """{"score": 1}""")], "score double, metadata string")
    assert empty.where(P.conditions(empty, {"score_min": 0})).count() == 0  # a null column hides the metadata
    with pytest.raises(ValueError):
        P.conditions(df, {"language": "french"})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad = spark.createDataFrame([("abc",)], "score string")
        bad.where(P.conditions(bad, {"score_min": 0})).collect()


def test_mix_files(tmp_path):
    good = {"name": "A", "dataset": "x/y", "token_budget": 600}
    write = lambda value: (tmp_path / "c.yaml").write_text(yaml.safe_dump(value)) and tmp_path / "c.yaml"
    found = spec.load_mix(write({"sources": [good, {**good, "name": "B", "filters": {"language": "en"}, "beyond": 1}]}))
    assert [(s.name, s.token_budget, dict(s.filters)) for s in found] == [("A", 600, {}), ("B", 600, {"language": "en"})]
    for bad, words in (
        (1, "lists no sources"),
        ({"sources": 1}, "lists no sources"),
        ({"sources": ["x"]}, "written as"),
        ({"sources": [{"name": " ", "token_budget": 0, "filters": [1]}]}, "name is below.*dataset is missing; token_budget is below.*filters is a list"),
        ({"sources": [{**good, "text_template": 3, "min_text_chars": -1}]}, "min_text_chars is below|text_template is a int"),
        ({"sources": [{**good, "token_budget": True}]}, "token_budget is a bool"),
        ({"sources": [good, good]}, "occur twice: A"),
    ):
        with pytest.raises(ValueError, match=words):
            spec.load_mix(write(bad))
    assert [spec.scaled_budget(n, 0.5) for n in (1, 5, 7)] == [2, 2, 4]
    assert spec.source_seed(5, "a") != spec.source_seed(5, "b") and spec.source_seed(6, "a") == spec.source_seed(5, "a") + 1


def test_assembly_files(tmp_path):
    mixed = {"name": "A", "kind": "hf", "dataset": "x", "token_budget": 3}
    taken = {"name": "B", "kind": "existing_source", "manifest": "m.json", "source_name": "b", "token_budget": 2}
    write = lambda value: (tmp_path / "c.yaml").write_text(yaml.safe_dump(value)) and tmp_path / "c.yaml"
    found = spec.load_assembly(write({"target_train_tokens": 5, "seed": 4, "sources": [mixed, taken]}))
    assert (found.target_train_tokens, found.mixed["A"].token_budget, found.sources[1]["source_name"], found.settings["seed"]) == (5, 3, "b", 4)
    for bad, words in (
        ({"sources": [mixed]}, "target_train_tokens"),
        ({"target_train_tokens": 0, "sources": [mixed]}, "target_train_tokens"),
        ({"target_train_tokens": 5, "sources": [{**mixed, "kind": "other"}]}, "no known kind"),
        ({"target_train_tokens": 5, "sources": [{**mixed, "dataset": ""}]}, "dataset is below"),
        ({"target_train_tokens": 5, "sources": [{"name": "B", "kind": "existing_source"}]}, "manifest is missing; source_name is missing; token_budget is missing"),
        ({"target_train_tokens": 5, "sources": [mixed, {**taken, "name": "A"}]}, "occur twice"),
    ):
        with pytest.raises(ValueError, match=words):
            spec.load_assembly(write(bad))


def test_numbers_to_read(spark):
    df = spark.createDataFrame([(1234567.891,), (None,)], "x double")
    assert [r[0] for r in df.select(X.number(F.col("x"), 2)).collect()] == ["1,234,567.89", "—"]
