import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseworks.llm import splitting
from clauseworks.llm.splitting import pieces


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb.", "\n", "\n\n", "(a)", "Section", "4", " ", " "]), max_size=60), st.integers(1, 9), st.integers(0, 8))
def test_pieces_hold_the_text(parts, limit, overlap):
    text = " ".join(parts)
    if overlap >= limit:
        with pytest.raises(ValueError):
            pieces(text, limit, overlap)
        return
    words = splitting.atoms(text)
    got = [[w for w in words if s <= w[0] and w[1] <= e] for s, e in pieces(text, limit, overlap)]
    assert all(0 < len(g) <= limit for g in got)
    joined = got[0] if got else []
    for a, b in zip(got, got[1:], strict=False):
        assert a[len(a) - overlap :] == b[:overlap] if len(a) >= overlap else True
        joined = joined + b[overlap:]
    assert joined == words


def test_cuts_at_the_strongest_boundary():
    text = "One two. Three four.\n\nFive six seven.\nSection 2 eight nine ten"
    got = [text[s:e] for s, e in pieces(text, 8, 0)]
    assert got == ["One two. Three four.\n\nFive six seven.", "Section 2 eight nine ten"]


def test_long_words_are_cut_only_when_asked():
    assert pieces("x" * 10, 2, 0) == [(0, 10)]
    assert pieces("x" * 10, 2, 0, max_chars=3) == [(0, 6), (6, 10)]


def test_spark(spark):
    chunks = spark.createDataFrame([(1, 7, "a b c d e", 10, "s"), (1, 7, "a b c d e", 10, None), (2, 7, "a b", 0, "s"), (3, 8, "a b c", None, "s"), (4, 9, "a b c", 0, None), (5, 7, None, 0, "s"), (6, 7, "", 0, "s")], "id bigint, doc_id bigint, text string, char_start int, source string")
    documents = spark.createDataFrame([(7, "t"), (8, None)], "doc_id bigint, source string")
    config = spark.createDataFrame([("s", 2, 0, 0), ("t", 4, 1, 0), ("u", None, None, 0)], "source string, max_tokens int, overlap int, capacity int")
    rows = splitting.split_oversized(chunks, documents, config).orderBy("chunk_id", "piece").collect()
    # the document's source holds, the chunk's own where the document has none; chunk 4 has neither
    want = [(1, 0, "a b c d", 10, 17), (1, 1, "d e", 16, 19), (3, 0, "a\u00a0b", None, None), (3, 1, "c", None, None)]
    assert [(r.chunk_id, r.piece, r.text, r.char_start, r.char_end) for r in rows] == want
    assert splitting.split_oversized(chunks.limit(0), documents, config).count() == 0
    assert splitting.split_oversized(chunks, documents, config.limit(0)).count() == 0


def test_very_long_text():
    text = "word, " * 100_000
    got = pieces(text, 200, 40)
    assert all(len(text[s:e].split()) <= 200 for s, e in got)
    assert got[0][0] == 0 and got[-1][1] == len(text.rstrip())


def test_spark_cuts_words_without_end(spark):
    text = "a b " + "x" * 50_000 + " c"
    chunks = spark.createDataFrame([(1, 7, text, 10, "s")], "id bigint, doc_id bigint, text string, char_start int, source string")
    documents = spark.createDataFrame([(7, "s")], "doc_id bigint, source string")
    config = spark.createDataFrame([("s", 3, 1, 0)], "source string, max_tokens int, overlap int, capacity int")
    rows = splitting.split_oversized(chunks, documents, config).orderBy("piece").collect()
    assert max(len(r.text) for r in rows) <= 6_010
    assert all(r.text == text[r.char_start - 10 : r.char_end - 10] and r.words <= 3 for r in rows)
    assert rows[0].char_start == 10 and rows[-1].char_end == 10 + len(text)
    assert all(b.char_start <= a.char_end for a, b in zip(rows, rows[1:], strict=False))
