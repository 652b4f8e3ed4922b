import io
import json
import os
import zipfile

import pytest

from clauseworks.sources import files, records, sinks
from clauseworks.sources.files import Unreadable

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(*runs: str) -> str:
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def test_docx_paragraphs_tables_and_controls():
    body = p("one", " more") + p("  ") + f"<w:tbl><w:tr><w:tc>{p('cell')}<w:tbl><w:tr><w:tc>{p('inner')}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl><w:sdt><w:sdtContent>{p('held')}</w:sdtContent></w:sdt>"
    assert files.extract_docx(docx(body)).text == "one more\n\ncell\n\ninner\n\nheld"


def test_docx_runs_and_tracked_changes():
    body = "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:moveFrom><w:r><w:t>from</w:t></w:r></w:moveFrom><w:moveTo><w:r><w:t>to</w:t></w:r></w:moveTo></w:p>"
    assert files.extract_docx(docx(body)).text == "a\tb\nlinknewto"


def test_broken_docx_is_unreadable():
    with pytest.raises(Unreadable):
        files.extract_docx(b"no zip")


def test_txt_decoding():
    assert files.extract_txt(b"\xef\xbb\xbfa\xffb").text == "a�b"


def test_pages_and_text_layer():
    got = files.joined_pages(["x" * 150, "", "y" * 160])
    assert got.pages == [(0, 1), (152, 2), (154, 3)]
    with pytest.raises(Unreadable, match="no text layer"):
        files.joined_pages(["x" * 99])


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b.txt").write_text("after the folder b by name")
    (tmp_path / "b" / "z.TXT").write_text("in b")
    (tmp_path / "_a.txt").write_text("abc")
    (tmp_path / ".hidden.txt").write_text("seen")
    (tmp_path / "~$open.docx").write_text("lock")
    (tmp_path / "x.doc").write_text("no")
    (tmp_path / "bad.docx").write_bytes(b"junk")
    os.symlink(tmp_path / "b.txt", tmp_path / "link.txt")
    return tmp_path


def test_walk(folder):
    got = files.walk(folder)
    assert [os.path.relpath(f.path, folder) for f in got.found] == [".hidden.txt", "_a.txt", "b/z.TXT", "b.txt", "bad.docx"]
    assert [os.path.basename(x) for x, _ in got.skipped] == ["link.txt", "x.doc", "~$open.docx"]
    assert len(files.walk(folder, lambda d: d.name == "b").found) == 4


def test_read_files(spark, folder):
    rows = files.read_files(spark, files.walk(folder).found).orderBy("position").collect()
    assert [r.text for r in rows] == ["seen", "abc", "in b", "after the folder b by name", None]
    assert rows[1].hash.hex() == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert rows[4].error.startswith("not a DOCX file")


def test_size_limit(tmp_path):
    path = tmp_path / "big.txt"
    with open(path, "wb") as f:
        f.truncate(files.MOST_BYTES + 1)
    with pytest.raises(Unreadable, match="50 MB"):
        files.extract(str(path), "txt")


def test_queries_file(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    good = {"id": "a", "category": "c", "type": "matched", "text": "t"}
    path.write_text(json.dumps(good) + "\n\n")
    assert records.read_queries(spark, str(path)).collect()[0].kind == "matched"
    for bad in ({**good, "text": " "}, {**good, "type": "other"}, {"id": "a"}, [1]):
        path.write_text("\n" + json.dumps(bad))
        with pytest.raises(records.BadRecord, match="line 2"):
            records.read_queries(spark, str(path))


def test_spans_file(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text("c\tf.txt\t1\t5\n")
    assert tuple(records.read_spans(spark, str(path)).first()) == ("c", "f.txt", 1, 5)
    for bad in ("c\tf\t5\t5", "c\tf\t1", "c\tf\tx\t5"):
        path.write_text(bad + "\n")
        with pytest.raises(Exception, match="bad span"):
            records.read_spans(spark, str(path)).collect()


def test_contracts(spark, tmp_path):
    path = tmp_path / "c.json"
    data = {"data": [{"title": "T", "paragraphs": [{"context": "ab cd", "qas": [{"id": "T__Parties", "question": "?", "answers": [{"answer_start": 3, "text": "cd"}]}]}]}]}
    path.write_text(json.dumps(data))
    texts, spans = records.read_contracts(spark, str(path))
    assert texts.first().text == "ab cd" and tuple(spans.first()) == ("T", "Parties", 3, 5)
    data["data"][0]["paragraphs"][0]["qas"][0]["answers"][0]["answer_start"] = 0
    path.write_text(json.dumps(data))
    with pytest.raises(Exception, match="isn't in its place"):
        records.read_contracts(spark, str(path))[1].collect()


def test_runs_and_qrels_come_back(spark, tmp_path):
    run = spark.createDataFrame([("m", "q", 7, 0.5, 1), ("m", "q", 9, 0.25, 2)], "method string, query_id string, id bigint, score double, rank int")
    sinks.write_run(run, str(tmp_path / "run"))
    assert [r.value for r in spark.read.text(str(tmp_path / "run")).collect()] == ["q Q0 7 1 0.500000000 m", "q Q0 9 2 0.250000000 m"]
    assert sorted(map(tuple, records.read_run(spark, str(tmp_path / "run")).select("id", "rank", "score").collect())) == [(7, 1, 0.5), (9, 2, 0.25)]
    qrels = spark.createDataFrame([("q", 9), ("q", 10)], "query_id string, chunk_id bigint")
    sinks.write_qrels(qrels, str(tmp_path / "qrels"))
    assert [r.chunk_id for r in records.read_qrels(spark, str(tmp_path / "qrels")).collect()] == [9, 10]


def test_raw_vectors(spark, tmp_path):
    import numpy as np

    np.arange(6, dtype="<f4").tofile(tmp_path / "v")
    assert records.read_raw_vectors(spark, str(tmp_path / "v"), 3).collect()[1].vec == [3.0, 4.0, 5.0]
    with pytest.raises(records.BadRecord):
        records.read_raw_vectors(spark, str(tmp_path / "v"), 4)


def test_written_test_set_comes_back(spark, tmp_path):
    from clauseworks.sources import testset

    contracts = spark.createDataFrame([("A / B", "äb\r\ncd"), ("C", "x")], "title string, text string")
    spans = spark.createDataFrame([("Term", "A / B", 0, 2)], "category string, title string, char_start int, char_end int")
    assert testset.write_test_set(contracts, spans, tmp_path) == 2
    assert (tmp_path / "documents" / "A_B.txt").read_bytes() == "äb\r\ncd".encode()
    assert (tmp_path / "docs.txt").read_text() == "A_B.txt\nC.txt\n"
    assert tuple(records.read_spans(spark, str(tmp_path / "spans.tsv")).first()) == ("Term", "A_B.txt", 0, 2)
    assert testset.has_checksum(tmp_path / "docs.txt", __import__("hashlib").sha256(b"A_B.txt\nC.txt\n").hexdigest())
    assert testset.peak_memory_mb() > 1
    with pytest.raises(ValueError):
        testset.write_test_set(contracts.unionByName(spark.createDataFrame([("A  B", "")], "title string, text string")), spans, tmp_path)


def test_functions_in_sql(spark):
    from clauseworks.functions.register import register

    assert set(register(spark, 4)) == {"normalize_text", "is_clause_start", "snippet", "dot", "hash_embed"}
    r = spark.sql("SELECT normalize_text('a  b') AS n, is_clause_start('(a) x') AS c, is_clause_start('a x') AS d, snippet('one  two three', 8) AS s, snippet('onetwothree', 4) AS t, dot(array(1D, 2D), array(3D, 4D)) AS p, size(hash_embed('a')) AS h").first()
    assert tuple(r) == ("a b", True, False, "one two…", "onet…", 11.0, 4)
