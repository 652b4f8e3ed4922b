"""Embedding models: a registry, a hashing stand-in, and transformer encoders in numpy for supplied weights."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, sqrt
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Model:
    """What must be known of a model to use it."""

    id: str
    architecture: str
    dim: int
    max_tokens: int
    pooling: str = "mean"
    query_prefix: str = ""
    passage_prefix: str = ""

    @property
    def directory(self) -> str:
        return self.id.rsplit("/", 1)[-1]


#: Public models and how their cards say they are used.
MODELS = {
    m.id: m
    for m in (
        Model("sentence-transformers/all-MiniLM-L6-v2", "bert", 384, 256),
        Model("sentence-transformers/all-mpnet-base-v2", "mpnet", 768, 384),
        Model("BAAI/bge-base-en-v1.5", "bert", 768, 512, "first", "Represent this sentence for searching relevant passages: "),
        Model("intfloat/e5-base-v2", "bert", 768, 512, "mean", "query: ", "passage: "),
    )
}


def register(model: Model) -> None:
    MODELS[model.id] = model


class Embedder(Protocol):
    model: Model

    def fingerprint(self) -> str: ...

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Counts of terms in hashed buckets, of unit length: a stand-in where no weights are at hand, not a semantic model."""

    def __init__(self, dim: int = 64) -> None:
        self.model = Model(f"hash-{dim}", "hash", dim, 1 << 30)

    def fingerprint(self) -> str:
        return hashlib.sha256(f"md5 6 hex digits mod {self.model.dim}".encode()).hexdigest()

    def embed(self, texts: list[str]) -> np.ndarray:
        import regex

        out = np.zeros((len(texts), self.model.dim), np.float64)
        for row, text in zip(out, texts, strict=True):
            for term in regex.findall(r"[\p{L}\p{N}]+", text.lower()):
                if len(term.encode()) <= 40:
                    row[int(hashlib.md5(term.encode()).hexdigest()[:6], 16) % self.model.dim] += 1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def embed_query(embedder: Embedder, text: str) -> np.ndarray:
    return embedder.embed([embedder.model.query_prefix + text])[0]


def embed_passages(chunks: DataFrame, embedder: Embedder, key: str = "id", batch: int = 32) -> DataFrame:
    """key, vec of every chunk; within a task, texts of like length share a batch, so little is padded."""
    prefix = embedder.model.passage_prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [prefix + t for t in b.column(1).to_pylist()]
            order = sorted(range(len(texts)), key=lambda k: len(texts[k].encode()))
            out = np.empty((len(texts), embedder.model.dim), np.float32)
            for k in range(0, len(order), batch):
                out[order[k : k + batch]] = embedder.embed([texts[i] for i in order[k : k + batch]])
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * embedder.model.dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=[key, "vec"])

    return chunks.where("text is not null").select(key, "text").mapInArrow(run, f"{key} bigint, vec array<float>")


def read_safetensors(path: str | Path) -> dict[str, np.ndarray]:
    """Tensors of a file of that format, mapped into memory."""
    with open(path, "rb") as f:
        size = struct.unpack("<Q", f.read(8))[0]
        header = json.loads(f.read(size))
    data = np.memmap(path, np.uint8, "r", 8 + size)
    kinds = {"F32": np.float32, "F16": np.float16, "I64": np.int64}
    return {name: data[slice(*t["data_offsets"])].view(kinds[t["dtype"]]).reshape(t["shape"]) for name, t in header.items() if name != "__metadata__"}


#: Coefficients of a rational approximation of the error function, off by 1.5e-7 at most (Abramowitz and Stegun, 7.1.26).
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: np.ndarray) -> np.ndarray:
    t = 1 / (1 + 0.3275911 * np.abs(x))
    y = np.zeros_like(t)
    for c in reversed(_ERF):
        y = (y + c) * t
    return np.sign(x) * (1 - y * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return (x * 0.5 * (1 + erf(x.astype(np.float64) / sqrt(2)))).astype(x.dtype)


def layer_norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, eps: float) -> np.ndarray:
    x = x - x.mean(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + eps) * weight + bias


def relative_buckets(length: int, buckets: int = 32, most: int = 128) -> np.ndarray:
    """Bucket of every distance between positions: half for either direction, exact while small, then by logarithm."""
    distance = np.arange(length)[:, None] - np.arange(length)[None, :]
    half = buckets // 2
    exact = half // 2
    out = np.where(distance < 0, half, 0)
    far = np.abs(distance)
    large = exact + (np.log(np.maximum(far, 1) / exact) / log(most / exact) * (half - exact)).astype(np.int64)
    return out + np.where(far < exact, far, np.minimum(large, half - 1))


@dataclass
class EncoderSettings:
    layers: int
    heads: int
    eps: float = 1e-12
    pad: int = 0


class Encoder:
    """A BERT or MPNet encoder over supplied weights, named as in their public checkpoints."""

    def __init__(self, model: Model, weights: dict[str, np.ndarray], settings: EncoderSettings) -> None:
        self.model, self.w, self.settings = model, {k.removeprefix(f"{model.architecture}."): np.asarray(v, np.float32) for k, v in weights.items()}, settings

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.w[f"{name}.weight"].T + self.w[f"{name}.bias"]

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        return layer_norm(x, self.w[f"{name}.weight"], self.w[f"{name}.bias"], self.settings.eps)

    def _embedded(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        x = self.w["embeddings.word_embeddings.weight"][ids]
        if self.model.architecture == "mpnet":  # positions count real tokens, from the one after the padding's
            position = np.cumsum(mask, axis=1) * mask + self.settings.pad
            x = x + self.w["embeddings.position_embeddings.weight"][position]
        else:
            x = x + self.w["embeddings.position_embeddings.weight"][: ids.shape[1]][None] + self.w["embeddings.token_type_embeddings.weight"][0]
        return self._norm(x, "embeddings.LayerNorm")

    def _attention(self, x: np.ndarray, layer: str, away: np.ndarray) -> np.ndarray:
        n, length, dim = x.shape
        heads = self.settings.heads
        names = {"q": "attention.attn.q", "k": "attention.attn.k", "v": "attention.attn.v", "o": "attention.attn.o", "norm": "attention.LayerNorm"}
        if self.model.architecture == "bert":
            names = {"q": "attention.self.query", "k": "attention.self.key", "v": "attention.self.value", "o": "attention.output.dense", "norm": "attention.output.LayerNorm"}
        q, k, v = (self._linear(x, f"{layer}.{names[c]}").reshape(n, length, heads, dim // heads).transpose(0, 2, 1, 3) for c in "qkv")
        score = q @ k.transpose(0, 1, 3, 2) / sqrt(dim // heads) + away
        score = np.exp(score - score.max(axis=-1, keepdims=True))
        held = (score / score.sum(axis=-1, keepdims=True) @ v).transpose(0, 2, 1, 3).reshape(n, length, dim)
        return self._norm(x + self._linear(held, f"{layer}.{names['o']}"), f"{layer}.{names['norm']}")

    def forward(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of token ids; mask is 1 for real tokens."""
        x = self._embedded(ids, mask)
        away = np.where(mask[:, None, None, :] == 1, 0, -1e9).astype(np.float32)
        if self.model.architecture == "mpnet":
            table = self.w["encoder.relative_attention_bias.weight"]
            away = away + table[relative_buckets(ids.shape[1], len(table))].transpose(2, 0, 1)[None]
        for k in range(self.settings.layers):
            layer = f"encoder.layer.{k}"
            x = self._attention(x, layer, away)
            x = self._norm(x + self._linear(gelu(self._linear(x, f"{layer}.intermediate.dense")), f"{layer}.output.dense"), f"{layer}.output.LayerNorm")
        real = mask[:, :, None].astype(np.float32)
        pooled = x[:, 0] if self.model.pooling == "first" else (x * real).sum(axis=1) / real.sum(axis=1)
        return pooled / np.linalg.norm(pooled, axis=1, keepdims=True)


class LoadedEmbedder:
    """A registered model with its files in a folder; loaded by each worker when first used."""

    def __init__(self, model: Model, folder: str) -> None:
        self.model, self.folder = model, folder
        self._ready: tuple | None = None

    def __getstate__(self) -> dict:
        return {"model": self.model, "folder": self.folder, "_ready": None}

    def fingerprint(self) -> str:
        with open(Path(self.folder, "model.safetensors"), "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    def _load(self) -> tuple:
        if self._ready is None:
            from tokenizers import Tokenizer

            config = json.loads(Path(self.folder, "config.json").read_text())
            if config["model_type"] != self.model.architecture or config["hidden_size"] != self.model.dim:
                raise ValueError(f"{self.folder} holds another model than {self.model.id}")
            tokenizer = Tokenizer.from_file(str(Path(self.folder, "tokenizer.json")))
            self._plain = Tokenizer.from_file(str(Path(self.folder, "tokenizer.json")))
            self._plain.no_truncation()
            self._plain.no_padding()
            tokenizer.enable_truncation(self.model.max_tokens)
            pad = config.get("pad_token_id", 0)
            tokenizer.enable_padding(pad_id=pad)
            settings = EncoderSettings(config["num_hidden_layers"], config["num_attention_heads"], config.get("layer_norm_eps", 1e-12), pad)
            self._ready = tokenizer, Encoder(self.model, read_safetensors(Path(self.folder, "model.safetensors")), settings)
        return self._ready

    def embed(self, texts: list[str]) -> np.ndarray:
        tokenizer, encoder = self._load()
        rows = tokenizer.encode_batch(texts)
        return encoder.forward(np.array([r.ids for r in rows]), np.array([r.attention_mask for r in rows]))

    def tokens(self, text: str) -> list[tuple[int, int]]:
        """Places of the model's own tokens, whole and without special ones: what chunks are measured in."""
        self._load()
        return [(a, b) for a, b in self._plain.encode(text, add_special_tokens=False).offsets if a < b]
