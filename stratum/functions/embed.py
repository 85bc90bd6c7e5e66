"""The built-in embedding: stemmed words and their 2- and 3-grams hashed into 512 places.

An ``EmbeddingProvider`` turns batches of texts into vectors. The built-in one needs nothing;
an HTTP one posts to an embeddings endpoint; a local model can be plugged in the same way."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions.stem import terms
from stratum.functions.text import strip
from stratum.schema import VECTOR_DIM

#: Texts that are embedded at a time.
SLICE = 128
# fixed values: hash constants and weights
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SECOND_START, SECOND_XOR, SECOND_MULTIPLY, SECOND_TURN = 0x9E3779B97F4A7C15, 0x9E3779B1, 0xC2B2AE35, 7
WEIGHTS = (1.0, 1.75, 2.25)


class Backend(Enum):
    REMOTE = "openai"
    ONNX = "local_onnx"
    BUILTIN = "local_builtin"
    FALLBACK = "lexical_fallback"


class Preference(Enum):
    AUTO = "auto"
    REMOTE = "openai"
    LOCAL = "local"


class LocalProvider(Enum):
    AUTO = "auto"
    ONNX = "onnx"
    BUILTIN = "builtin"


def preference(value: str) -> Preference:
    value = value.lower()
    if value == "openai":
        return Preference.REMOTE
    return Preference.LOCAL if value in ("local", "strong_local", "fallback", "onnx", "fastembed") else Preference.AUTO


def local_provider(value: str) -> LocalProvider:
    value = value.lower()
    if value in ("onnx", "fastembed"):
        return LocalProvider.ONNX
    return LocalProvider.BUILTIN if value in ("builtin", "built_in", "strong_local", "fallback") else LocalProvider.AUTO


def _extend(one: np.ndarray, two: np.ndarray, data: np.ndarray, at: np.ndarray, left: np.ndarray) -> None:
    """Take the bytes data[at], data[at + 1], ... into both states of each feature, ``left`` of them."""
    open_ = np.arange(len(one))
    while len(open_ := open_[left[open_] > 0]):
        b = data[at[open_]].astype(np.uint64)
        one[open_] = (one[open_] ^ b) * np.uint64(FNV_PRIME)
        x = two[open_] ^ b * np.uint64(SECOND_XOR)
        two[open_] = (x << np.uint64(SECOND_TURN) | x >> np.uint64(64 - SECOND_TURN)) * np.uint64(SECOND_MULTIPLY)
        at, left = at + 1, left - 1


def builtin_vectors(texts: list[str]) -> np.ndarray:
    """The vectors of many texts at once. The features of a text are its stemmed words and their runs of two and
    three, joined by ::, whose states go on from those of the runs one shorter. (Sums are of eighths, so exact in any order.)"""
    found = [[w.encode() for w in terms(t)] for t in texts]
    number: dict[bytes, int] = {b"::": 0}
    ids = np.array([number.setdefault(w, len(number)) for own in found for w in own], np.int64)
    text = np.repeat(np.arange(len(texts)), [len(own) for own in found])
    data = np.frombuffer(b"".join(number), np.uint8)
    size = np.array([len(w) for w in number])
    start = np.cumsum(size) - size
    one, two = np.full(len(ids), FNV_START, np.uint64), np.full(len(ids), SECOND_START, np.uint64)
    out = np.zeros(len(texts) * VECTOR_DIM)
    for n, weight in enumerate(WEIGHTS, 1):
        last = np.arange(n - 1, len(ids))  # the last word of each run
        last = last[text[last] == text[last - (n - 1)]] if len(last) else last
        one, two = (one[last], two[last]) if n == 1 else (one[last - first], two[last - first])
        if n > 1:
            _extend(one, two, data, np.zeros(len(last), np.int64), np.full(len(last), 2))
        _extend(one, two, data, start[ids[last]], size[ids[last]])
        dim, row = np.uint64(VECTOR_DIM), text[last] * VECTOR_DIM
        sign = np.where((one ^ two) % np.uint64(2) == 0, 1.0, -1.0)
        out += np.bincount(row + (one % dim).astype(np.int64), minlength=len(out)) * weight
        out += np.bincount(row + (two % dim).astype(np.int64), weights=sign, minlength=len(out)) * (0.5 * weight)
        # states by the place of a run's last word, for the runs that go on from it
        whole_one, whole_two = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
        whole_one[last], whole_two[last] = one, two
        one, two, first = whole_one, whole_two, 1
    vectors = out.reshape(len(texts), VECTOR_DIM).astype(np.float32)
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.where(norm > 0, vectors / np.where(norm > 0, norm, 1), vectors)


def builtin_vector(text: str) -> np.ndarray:
    return builtin_vectors([text])[0]


def encode_vector(v: np.ndarray) -> bytes:
    return np.asarray(v, "<f4").tobytes()


def decode_vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data[: len(data) // 4 * 4], "<f4")


@dataclass(frozen=True)
class EmbeddingConfig:
    """How texts are embedded. Explicit values win over the environment, and that over defaults."""

    preference: Preference = Preference.AUTO
    local: LocalProvider = LocalProvider.AUTO
    model: str = "text-embedding-3-small"
    base_url: str = "https://api.openai.com/v1"
    api_key: str | None = None
    timeout: float = 20.0

    @classmethod
    def resolve(cls, backend=None, local=None, model=None, api_key=None, base_url=None, env=os.environ) -> EmbeddingConfig:
        get = lambda x, *names: x if x is not None else next((env[n] for n in names if n in env), None)
        return cls(
            preference(get(backend, "STRATUM_EMBEDDING_BACKEND") or "auto"), local_provider(get(local, "STRATUM_LOCAL_EMBEDDING_PROVIDER") or "auto"),
            get(model, "STRATUM_EMBEDDING_MODEL") or cls.model, get(base_url, "STRATUM_EMBEDDING_URL") or cls.base_url,
            get(api_key, "OPENAI_API_KEY", "STRATUM_EMBEDDING_KEY"),
        )

    def validate(self) -> None:
        if self.preference is Preference.REMOTE:
            if not self.api_key:
                raise ValueError("the remote embedding backend needs an API key")
            if not self.model.strip() or not self.base_url.strip():
                raise ValueError("the remote embedding backend needs a model and a base URL")


class Builtin:
    label = Backend.BUILTIN

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        return [v for at in range(0, len(texts), SLICE) for v in builtin_vectors(texts[at : at + SLICE])]


class Remote:
    label = Backend.REMOTE

    def __init__(self, config: EmbeddingConfig):
        self.config = config

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        return [v for at in range(0, len(texts), SLICE) for v in self._request(texts[at : at + SLICE])]

    def _request(self, texts: list[str]) -> list[np.ndarray]:
        c = self.config
        body = json.dumps({"input": texts, "model": c.model}).encode()
        request = urllib.request.Request(c.base_url.rstrip("/") + "/embeddings", body, {"Authorization": f"Bearer {c.api_key}", "Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=c.timeout) as answer:  # noqa: S310
            return [fitted(np.array(x["embedding"], np.float32)) for x in json.load(answer)["data"]]


class Onnx:
    """A local sentence model, if a model file and tokenizer are given in the environment."""

    label = Backend.ONNX

    def __init__(self, env=os.environ):
        import onnxruntime
        from tokenizers import Tokenizer

        self.session = onnxruntime.InferenceSession(env["STRATUM_ONNX_MODEL"])
        self.tokenizer = Tokenizer.from_file(env["STRATUM_ONNX_TOKENIZER"])

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for e in self.tokenizer.encode_batch(texts):
            feed = {"input_ids": np.array([e.ids]), "attention_mask": np.array([e.attention_mask]), "token_type_ids": np.array([e.type_ids])}
            hidden = self.session.run(None, {x.name: feed[x.name] for x in self.session.get_inputs()})[0][0]
            out.append(fitted(hidden.mean(axis=0).astype(np.float32)))
        return out


def fitted(v: np.ndarray) -> np.ndarray:
    out = np.zeros(VECTOR_DIM, np.float32)
    out[: min(len(v), VECTOR_DIM)] = v[:VECTOR_DIM]
    norm = np.sqrt((out * out).sum())
    return out / norm if norm > 0 else out


def provider(config: EmbeddingConfig):
    """The first available backend in order of preference. An explicit remote one is never replaced."""
    config.validate()
    if config.preference is Preference.REMOTE or (config.preference is Preference.AUTO and config.api_key):
        return Remote(config)
    if config.local is not LocalProvider.BUILTIN:
        try:
            return Onnx()
        except (ImportError, KeyError, OSError, RuntimeError):
            pass
    return Builtin()


def embed_column(config: EmbeddingConfig | None = None):
    """A pandas UDF from texts to vectors of 512 floats; a null text has the zero vector."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = provider(config or EmbeddingConfig(local=LocalProvider.BUILTIN, preference=Preference.LOCAL))
        for batch in batches:
            yield pd.Series(own.embed([t or "" for t in batch]))

    return embed


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_terms(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: list(dict.fromkeys(terms(t or ""))))


def phrase_overlap(query: Column, query_terms: Column, text: Column, text_terms: Column) -> Column:
    """1 if the text contains the query, plus three quarters of the share of its stems that the text has."""
    low, own = F.lower(text), F.lower(strip(query))
    whole = F.when(low.contains(own), F.lit(1.0)).otherwise(F.lit(0.0))
    share = F.size(F.array_intersect(query_terms, text_terms)) / F.greatest(F.size(query_terms), F.lit(1))
    return F.when((own == "") | (strip(low) == ""), F.lit(0.0)).otherwise(whole + 0.75 * share)
