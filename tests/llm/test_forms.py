import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseworks.llm import forms
from clauseworks.llm.forms import consistent_form, form_words, word_offsets

SAME = [
    ("Ｐａｙｍｅｎｔ． １２", "Payment. 12"),
    ("café", "café"),
    ("a​b­c﻿", "abc"),
    ("a b　c\r\n d", "a b c d"),
    ("the сustоmer", "the customer"),
    ("а clause", "a clause"),
    ("Part Ⅸ, oﬀer", "Part IX, offer"),
    ("NOK 5", "NOK 5"),
    ("cѐde", "cède"),
    ("Set‐Off", "Set-Off"),
    ("Тһе seller", "The seller"),
    ("  x ", "x"),
]
DIFFERENT = [("May", "may"), ("depot", "dépôt"), ("4, 5", "4; 5"), ("3²", "32"), ("x₁", "x1"), ("may not", "may"), ("№ 5", "No 5")]


@pytest.mark.parametrize("a,b", SAME)
def test_read_the_same(a, b):
    assert consistent_form(a) == consistent_form(b) == b


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_visible_differences_stay(a, b):
    assert consistent_form(a) != consistent_form(b)


def test_other_scripts_stay():
    for text in ("Все стороны согласны, а договор продлевается", "Η σύμβαση", "货物 合同", "Straße groß"):
        assert consistent_form(text) == unicodedata.normalize("NFC", text)
    # English among Russian keeps its letters
    assert "as soon as" in consistent_form("Договор: as soon as possible, затем склад")


def test_null_and_blank():
    assert consistent_form(None) is None and consistent_form("") == "" and consistent_form(" ​\n") == ""
    assert form_words(None) == [] and form_words("A1, b²!") == ["a1", "b²"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeое́​ \n１Ａ.ßЖ", max_size=25))
def test_form_is_stable_and_words_have_places(text):
    form = consistent_form(text)
    assert consistent_form(form) == form
    places = word_offsets(text)
    if places is not None:
        assert len(places) == len(form_words(text))
        assert all(form_words(text[s:e]) for s, e in places)


def test_equal_forms(spark):
    left = spark.createDataFrame([(1, "a  b", 5), (1, "a  b", 5), (2, "a b", 5), (3, None, 5), (None, "a b", 5), (4, "", 5)], "passage_id bigint, text string, form_hash int")
    right = spark.createDataFrame([(10, "a b"), (10, "a b"), (11, "c"), (12, None), (13, " ")], "chunk_id bigint, text string")
    got = forms.equal_forms(left, right, "passage_id", "chunk_id").collect()
    assert sorted(map(tuple, got)) == [(1, 10), (4, 13)]
    assert forms.equal_forms(left.limit(0), right, "passage_id", "chunk_id").count() == 0


def test_very_long_text():
    assert len(consistent_form("ａ " * 300_000)) == 599_999


@pytest.mark.parametrize("pair", ["ѵv", "ᏀG", "ԌG", "гr", "Ьb", "ƒf"])
def test_rarer_look_alikes(pair):
    other, latin = pair
    assert forms.consistent_form(f"the se{other}en parties") == forms.consistent_form(f"the se{latin}en parties")


def test_look_alikes_are_of_their_scripts():
    for script, pairs in [*forms._LOOK_ALIKES.items(), *forms._ONE_WAY.items()]:
        for pair in pairs.split(" "):
            assert len(pair) == 2 and forms._script(pair[0]) == "Latin" and forms._script(pair[1]) == script


def test_digits_and_letters_stay_apart():
    assert forms.consistent_form("O1l0") == "O1l0"


def test_confusables():
    assert forms.confusables("The pаrty pаys сорe") == (3, 0, 0)
    assert forms.confusables("the соре of this") == (0, 0, 1)  # wholly in Cyrillic letters, among Latin words
    assert forms.confusables("xжz is kept") == (0, 1, 0)
    assert forms.confusables(None) == forms.confusables("plain") == forms.confusables("привет сор") == (0, 0, 0)


def test_form_classes(spark):
    a = spark.createDataFrame([(1, "a  b"), (1, "a  b"), (2, "a b"), (3, "c"), (4, None), (None, "a b"), (5, "")], "p bigint, text string")
    b = spark.createDataFrame([(7, "a b"), (8, "c"), (9, " "), (10, "d")], "c bigint, text string")
    got = sorted((r.left_rows, r.right_rows, r.spellings) for r in forms.form_classes(a, b, "p", "c").collect())
    assert got == [(1, 1, 2), (2, 1, 2)]
    assert forms.form_classes(a.limit(0), b, "p", "c").count() == 0
