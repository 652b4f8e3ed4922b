import json
import threading
import time
import urllib.error
import urllib.request

import numpy as np
import pytest

from clauseworks import cli
from clauseworks.functions import embedding as em
from clauseworks.operators.chunking import ChunkConfig
from clauseworks.plans import effectiveness, index
from clauseworks.plans.index import IndexFault


@pytest.fixture
def documents(tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("Governing law. This agreement is governed by the laws of Utopia.\n\n1. Term. The term is two years.")
    (folder / "b.txt").write_text("Royalties are paid  every\nquarter by the licensee.")
    (folder / "c.txt").write_text(" \n ")
    return folder


def test_build_open_and_search(spark, documents, tmp_path):
    target = tmp_path / "ix"
    stages = []
    done = index.build(spark, str(documents), str(target), progress=lambda s, n: stages.append(s))
    assert (done.documents, done.chunks) == (2, 2) and stages == ["Preparing", "Embedding"]
    assert [reason for _, reason in done.skipped] == ["no text"]
    opened = index.Index(spark, str(target))
    rows, seconds = opened.search("royalties paid quarter", 5)
    first = rows.collect()[0]
    assert first.path.endswith("b.txt") and first.text == "Royalties are paid every\nquarter by the licensee." and set(seconds) == {"encode", "scan"}
    assert opened.chunk(0).doc_id == 0 and opened.chunk(9) is None and opened.document(1).format == "txt"
    with pytest.raises(ValueError):
        opened.search(" ")
    with pytest.raises(IndexFault, match="dim"):
        index.check_settings(opened.meta, index.Settings(opened.meta["model"], opened.meta["weights"], 3, 200, 40))
    with pytest.raises(IndexFault, match="max_tokens"):
        index.Index(spark, str(target), config=ChunkConfig(100, 40))
    assert index.reusable(str(target), str(documents), index.settings_of(em.HashEmbedder(), ChunkConfig()))
    assert not index.reusable(str(target), str(tmp_path), index.settings_of(em.HashEmbedder(), ChunkConfig()))
    (documents / "d.txt").write_text("new")
    assert index.build(spark, str(documents), str(target)).documents == 3
    assert not list(tmp_path.glob("ix.*"))


def test_refusals(spark, documents, tmp_path):
    with pytest.raises(IndexFault, match="inside"):
        index.build(spark, str(documents), str(tmp_path))
    own = tmp_path / "mine"
    own.mkdir()
    (own / "letter.txt").write_text("keep")
    with pytest.raises(IndexFault, match="other files"):
        index.build(spark, str(documents), str(own))
    assert (own / "letter.txt").exists()
    with pytest.raises(IndexFault, match="no complete index"):
        index.Index(spark, str(tmp_path / "none"))


def test_an_index_inside_its_documents_is_left_out(spark, documents):
    assert index.build(spark, str(documents), str(documents / "ix")).documents == 2
    assert index.build(spark, str(documents), str(documents / "ix")).documents == 2


def test_install_brings_the_old_one_back(tmp_path):
    old = tmp_path / "ix"
    old.mkdir()
    (old / index.META).write_text("{}")
    with pytest.raises(OSError):
        index.install(tmp_path / "missing", old)
    assert (old / index.META).exists()
    for name, ours in (("ix.old", True), ("ix.old-3", True), ("ix.partial", True), ("ix", True), ("ix.older", False), ("ix.old-", False)):
        assert index.is_index_folder(tmp_path / name, old) == ours


def test_page_and_offsets_refer_to_the_source(spark):
    files = spark.createDataFrame([(0, "pdf", "a  agree-\nment\n\nnext", [(0, 1), (16, 2)])], "position bigint, format string, text string, pages array<struct<off:int,page:int>>")
    (row,) = index.passages(files, ChunkConfig()).collect()
    assert (row.text, row.char_start, row.char_end, row.page) == ("a agreement\n\nnext", 0, 20, 1)


def test_evaluation(spark, documents, tmp_path):
    index.build(spark, str(documents), str(tmp_path / "ix"))
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"id": f"Q0{k}m", "category": c, "type": "matched", "text": t}) for k, c, t in ((1, "pay", "royalties"), (2, "none", "zebra"))))
    (tmp_path / "s.tsv").write_text("pay\tb.txt\t0\t20\n")
    out = tmp_path / "out"
    out.mkdir()
    text = effectiveness.run_all(spark, index.Index(spark, str(tmp_path / "ix")), str(tmp_path / "q.jsonl"), str(tmp_path / "s.tsv"), str(out))
    assert "matched queries (2)" in text and "0.5000" in text and "n/a" in text
    assert "no relevant chunk: Q02m" in (out / "scores.txt").read_text()


def test_commands(documents, tmp_path, capsys, spark):
    assert cli.main(["--overlap", "300", "search", "x"]) == 2
    assert cli.main(["--index-dir", str(tmp_path), "index", str(documents)]) == 1
    assert cli.main(["--index-dir", str(tmp_path / "ix"), "index", str(documents)]) == 0
    assert cli.main(["--index-dir", str(tmp_path / "ix"), "search", "governing law", "-k", "1"]) == 0
    assert "1. " in capsys.readouterr().out
    assert cli.main(["index", "--dry-run", str(documents)]) == 0


def test_service(spark, documents, tmp_path):
    from clauseworks.serve import Refused, Service, serve

    service = Service(spark, str(tmp_path / "ix"), em.HashEmbedder(), ChunkConfig())
    assert not service.status()["ready"]
    with pytest.raises(Refused):
        service.search("x")
    service.start(str(documents))
    while service.job_status()["state"] == "running":
        time.sleep(0.1)
    assert service.status()["documents"] == 2
    server, token = serve(service, 0)
    port = server.server_address[1]
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None, key=token):
        data = json.dumps(body).encode() if body is not None else None
        return json.load(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", data, {"Authorization": f"Bearer {key}"})))

    assert ask("/api/search", {"query": "royalties", "k": 500})["hits"][0]["file"] == "b.txt"
    opened = []
    service.opener = opened.append
    chunk = ask("/api/search", {"query": "royalties"})["hits"][0]["chunk"]
    assert ask("/api/open", {"chunk": chunk}) == {"opened": "b.txt"} and [p.rsplit("/", 1)[-1] for p in opened] == ["b.txt"]
    for path, body, key, status in (("/api/open", {"chunk": 10**6}, token, 404), ("/api/open", {"path": "b.txt"}, token, 400), ("/api/status", None, "wrong", 403), ("/api/search", {"query": ""}, token, 400), ("/nothing", None, token, 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            ask(path, body, key)
        assert e.value.code == status
    server.shutdown()


def _encoder(kind: str) -> em.Encoder:
    rng = np.random.default_rng(0)
    d, f, v = 8, 16, 20
    w = {"embeddings.word_embeddings.weight": (v, d), "embeddings.position_embeddings.weight": (30, d), "embeddings.token_type_embeddings.weight": (2, d), "encoder.relative_attention_bias.weight": (32, 2), "embeddings.LayerNorm.weight": (d,), "embeddings.LayerNorm.bias": (d,)}
    parts = ("attention.attn.q", "attention.attn.k", "attention.attn.v", "attention.attn.o") if kind == "mpnet" else ("attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense")
    norm = "attention.LayerNorm" if kind == "mpnet" else "attention.output.LayerNorm"
    for k in range(2):
        for name, shape in [*((x, (d, d)) for x in parts), ("intermediate.dense", (f, d)), ("output.dense", (d, f))]:
            w |= {f"encoder.layer.{k}.{name}.weight": shape, f"encoder.layer.{k}.{name}.bias": shape[:1]}
        for name in (norm, "output.LayerNorm"):
            w |= {f"encoder.layer.{k}.{name}.weight": (d,), f"encoder.layer.{k}.{name}.bias": (d,)}
    return em.Encoder(em.Model("t", kind, d, 16), {k: rng.normal(size=s).astype(np.float32) for k, s in w.items()}, em.EncoderSettings(2, 2, 1e-5, 1 if kind == "mpnet" else 0))


@pytest.mark.parametrize("kind", ["bert", "mpnet"])
def test_padding_changes_no_vector(kind):
    encoder = _encoder(kind)
    lone = encoder.forward(np.array([[5, 6, 7]]), np.ones((1, 3), int))
    padded = encoder.forward(np.array([[5, 6, 7, 0, 0], [2, 3, 4, 5, 6]]), np.array([[1, 1, 1, 0, 0], [1] * 5]))
    assert np.allclose(lone[0], padded[0], atol=1e-4) and np.allclose(np.linalg.norm(padded, axis=1), 1, atol=1e-5)


def test_relative_buckets():
    b = em.relative_buckets(300)
    assert b[0, 0] == 0 and b[3, 0] == 3 and b[0, 3] == 19 and b[299, 0] == 15 and b[0, 299] == 31


def test_models():
    assert em.MODELS["intfloat/e5-base-v2"].query_prefix == "query: " and em.MODELS["BAAI/bge-base-en-v1.5"].directory == "bge-base-en-v1.5"


def test_chunks_are_measured_in_the_tokens_of_the_model(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from clauseworks.functions.embedding import HashEmbedder

    vocabulary = {c: k for k, c in enumerate(["[UNK]", *"abcdefghijklmnopqrstuvwxyz.,0123456789"])}
    tokenizer = Tokenizer(models.WordLevel(vocabulary, "[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Split("", "isolated")
    letters = tokenizer.to_str()

    class Letters(HashEmbedder):
        def tokens(self, text):
            return [(a, b) for a, b in Tokenizer.from_str(letters).encode(text, add_special_tokens=False).offsets if a < b and not text[a:b].isspace()]

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1. The buyer pays.\n2. The seller sends the goods.\n\n" + "word " * 60)
    index.build(spark, str(tmp_path / "in"), str(tmp_path / "out"), Letters(), ChunkConfig(40, 5))
    texts = [r.text for r in index.Index(spark, str(tmp_path / "out"), Letters(), ChunkConfig(40, 5)).chunks.collect()]
    assert len(texts) > 3 and all(len(Letters().tokens(t)) <= 40 for t in texts)


def test_erf_and_gelu():
    from math import erf as exact

    import numpy as np

    from clauseworks.functions.embedding import erf, gelu

    x = np.linspace(-6, 6, 2001)
    assert np.abs(erf(x) - [exact(v) for v in x]).max() < 2e-7
    assert gelu(np.zeros(3, np.float32)).dtype == np.float32


def test_causes_are_not_repeated():
    try:
        try:
            raise OSError("disk full")
        except OSError as e:
            raise IndexFault("can't write: disk full") from e
    except IndexFault as e:
        assert cli.causes(e) == "can't write: disk full"
    try:
        raise ValueError("bad") from KeyError("x")
    except ValueError as e:
        assert cli.causes(e) == "bad: 'x'"
