import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseworks.functions import text as tx
from clauseworks.functions.stem import stem

CASES = {
    "a\u00a0b": "a b",
    "a \t\u2003 b": "a b",
    "a\r\nb": "a\nb",
    "a\rb": "a\nb",
    "a\r\n\r\n\r\nb": "a\n\nb",
    "a \n \n b": "a\n\nb",
    "a b c": "a\nb\nc",
    "  a \n": "a",
    "": "",
    " \n ": "",
    "café x": "café x",
}
CLAUSES = ["12. Term", "12.3 Term", "1.2.3. Term", "4) the", "(a) the", "(iv) the", "a. the", "iv. the", "Section 4", "SECTION 4.2: Term", "Article IV", "Article iv. Notices", "v. ACME Corp"]
PLAIN = ["", "the term", "1234. x", "2020 was", "12 months", "section 4 of this", "Article 5 applies", "(abcde) x", "v. acme", "vi.", "e.g. this", "Smith v. Jones", "(a)"]


@pytest.mark.parametrize("raw", CASES)
def test_normalize(raw):
    assert tx.normalize(raw).text == CASES[raw]


def test_normalized_column_equals_python(spark):
    rows = spark.createDataFrame([(k, raw) for k, raw in enumerate(CASES)], "k int, text string")
    got = {r.k: r.n for r in rows.select("k", tx.normalized(F.col("text")).alias("n")).collect()}
    assert got == dict(enumerate(CASES.values()))


def test_hyphens_join_in_pdf_text_only():
    assert tx.normalize("agree-\nment", True).text == "agreement"
    assert tx.normalize("agree-\n\nment", True).text == "agree-\n\nment"
    assert tx.normalize("agree-\nMent", True).text == "agree-\nMent"
    assert tx.normalize("12-\nment", True).text == "12-\nment"
    assert tx.normalize("agree-\nment").text == "agree-\nment"


def test_source_ranges():
    form = tx.normalize("café  x")
    assert form.text == "café x"
    assert form.source_range(3, 4) == (3, 5)
    assert form.source_range(5, 6) == (7, 8)
    assert form.source_range(2, 2) == (2, 2)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab́ée \n\r\t  -Zz", max_size=30))
def test_every_character_comes_from_its_source(raw):
    form = tx.normalize(raw)
    assert len(form.text) == len(form.starts) == len(form.ends)
    for c, s, e in zip(form.text, form.starts, form.ends, strict=True):
        assert c.isspace() or c in unicodedata.normalize("NFC", raw[s:e])
    assert form.starts == sorted(form.starts)


def test_clause_lines(spark):
    lines = [(x, True) for x in CLAUSES] + [(x, False) for x in PLAIN]
    rows = spark.createDataFrame(lines, "line string, want boolean")
    assert rows.where(tx.is_clause_line(F.col("line")) != F.col("want")).collect() == []


def test_snippet(spark):
    cases = {("one two three", 20): "one two three", ("one two three", 7): "one two…", ("one two three", 8): "one two…", ("onetwothree", 4): "onet…", (" a\n b ", 9): "a b"}
    for (text, n), want in cases.items():
        assert spark.createDataFrame([(text,)], "t string").select(tx.snippet(F.col("t"), n)).first()[0] == want


def test_wrap():
    assert tx.wrap("aa bb cc", 5) == ["aa bb", "cc"]
    assert tx.wrap("a verylongword b", 4) == ["a", "verylongword", "b"]


def test_pages(spark):
    pages = [(0, 1), (10, 2), (30, 5)]
    cases = {0: 1, 9: 1, 10: 2, 29: 2, 31: 5}
    for off, want in cases.items():
        assert tx.page_of(pages, off) == want
    assert tx.page_of([], 3) is None
    rows = spark.createDataFrame([([{"off": o, "page": p} for o, p in pages], 10), ([], 3)], "pages array<struct<off:int,page:int>>, off int")
    assert [r[0] for r in rows.select(tx.page_at(F.col("pages"), F.col("off"))).collect()] == [2, None]


def test_formats(spark):
    names = {"a/b.PDF": "pdf", "x.docx": "docx", "x.tar.txt": "txt", ".pdf": None, "a/noext": None, "x.doc": None}
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    assert {r.p: r.f for r in rows.select("p", tx.file_format(F.col("p")).alias("f")).collect()} == names


def test_trigrams(spark):
    rows = spark.createDataFrame([("The cat sat. The cat sat!",), ("two words",), ("",)], "t string")
    assert [set(r[0]) for r in rows.select(tx.trigrams(F.col("t"))).collect()] == [{"the cat sat", "cat sat the", "sat the cat"}, set(), set()]


def test_stems():
    pairs = {"terminated": "termin", "termination": "termin", "obligations": "oblig", "licensee": "license", "agreement": "agreement", "agreements": "agreement", "running": "run", "hoping": "hope", "cries": "cri", "ties": "tie", "skies": "sky", "generously": "generous", "national": "nation", "happiness": "happi", "by": "by", "exceeding": "exceed", "knackeries": "knackeri", "consolingly": "consol"}
    assert {w: stem(w) for w in pairs} == pairs
