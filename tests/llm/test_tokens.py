import os
import random

import pytest

from clauseworks.llm import packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
TEXTS = ["", None, "Hello  world", "It's \n\n 12,5 €", "日本 語　x", "a b​c", "x" * 5000, " ", "\t\n ", "don't ’s", "Ⅸ²½", "ab\x1cc", "é 😀<|endoftext|>"]


def test_ids_equal_the_whole_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    whole.encode_special_tokens = True
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode(rows).collect()}
    assert got == {k: whole.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(TEXTS)}


def test_blocks(spark):
    """Every text a block, repeated rows, words that blocks share, and texts far longer than a block."""
    long = "one two  three\n" * 3000
    rows = [*enumerate(TEXTS), *enumerate(TEXTS), (50, long), (51, "two three"), (None, "two")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = [sorted(((r.doc_id, r.ids) for r in tokens.encode(df, chars=c).collect()), key=key) for c in (0, 20, tokens.BLOCK_CHARS)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


def test_round_trip(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in tokens.decode(tokens.encode(rows)).collect()} == {k: t or "" for k, t in enumerate(TEXTS)}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokens.encode(none).count() == 0 and tokens.decode(tokens.encode(none)).count() == 0


def _best(lengths, capacity):
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


def test_each_container_is_the_fullest_possible():
    rng = random.Random(4)
    p = packing.Packer(50)
    left = [rng.randrange(1, 51) for _ in range(80)]
    for k, n in enumerate(left):
        p.add(k, n)
    seen = []
    for box in p.filled(0):
        sizes = [n for _, n in box]
        first = max(left)
        assert sizes[0] == first
        left.remove(first)
        assert sum(sizes) - first == _best(left, 50 - first)
        for n in sizes[1:]:
            left.remove(n)
        seen += [k for k, _ in box]
    assert sorted(seen) == list(range(80)) and not left


def test_fill(spark):
    rng = random.Random(1)
    texts = [(k, " ".join("word" for _ in range(rng.randrange(1, 300))), "s") for k in range(500)] + [(500, None, "s"), (501, "", None), (502, "word " * 5000, "s"), (503, "word", None), (503, "word", None)]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string, source string").repartition(2)
    config = spark.createDataFrame([("s", 1, 1, 2048), ("s", 1, 1, 2048), (None, 1, 1, 9)], "source string, max_tokens int, overlap int, capacity int")
    got = packing.fill(rows, config).collect()
    boxes, docs = {}, {}
    for r in got:
        if r.container_id is not None:
            boxes[r.container_id] = boxes.get(r.container_id, 0) + r.tokens
        docs.setdefault(r.doc_id, []).append((r.part, r.token_start, r.tokens))
    assert max(boxes.values()) <= 2048 and sum(b < 2048 for b in boxes.values()) <= 2
    assert {d for d, x in docs.items() if len(x) > 1} == {502, 503}
    parts = sorted(docs[502])
    assert [p[1] for p in parts] == list(range(0, sum(p[2] for p in parts), 2048))
    assert docs[500] == [(0, 0, 0)] and docs[501] == [(0, 0, 0)]
    assert packing.fill(rows.limit(0), config).count() == 0
