"""Embedding providers, and embedding as a vectorised function on the executors."""

from __future__ import annotations

import json
import math
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

from ..functions.text import token_list

# Service addresses, models and sizes.
VOYAGE_URL, VOYAGE_MODEL, VOYAGE_BATCH, VOYAGE_DIMENSION = "https://api.voyageai.com/v1/embeddings", "voyage-3-lite", 128, 1024
OLLAMA_URL, OLLAMA_MODEL, OLLAMA_DIMENSION = "http://localhost:11434", "bge-large", 1024
TRANSFORMERS_MODEL, TRANSFORMERS_DIMENSION, TRANSFORMERS_POOLING = "Xenova/bge-large-en-v1.5", 1024, "cls"
NAMES = ("voyage", "ollama", "transformers")

#: Sends a JSON body: (url, headers, body) to (status, text).
Transport = Callable[[str, dict, dict], tuple[int, str]]


class EmbeddingProvider(Protocol):
    dimension: int

    def embed_documents(self, texts: list[str]) -> list[np.ndarray]: ...

    def embed_query(self, text: str) -> np.ndarray: ...


def post(url: str, headers: dict, body: dict) -> tuple[int, str]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request) as r:  # noqa: S310  an address from the configuration
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def _vectors(rows, service: str) -> list[np.ndarray]:
    for i, row in enumerate(rows):
        if not isinstance(row, list) or not row:
            raise ValueError(f"{service} API returned invalid embedding at index {i}")
    return [np.array(row, np.float32) for row in rows]


class _Provider:
    def embed_query(self, text: str) -> np.ndarray:
        found = self.embed_documents([text])
        if len(found) != 1:
            raise ValueError(f"Expected 1 query embedding, got {len(found)}")
        return found[0]


class VoyageProvider(_Provider):
    dimension = VOYAGE_DIMENSION

    def __init__(self, transport: Transport = post):
        self.transport = transport

    def _call(self, texts: list[str], kind: str) -> list[np.ndarray]:
        key = os.environ.get("VOYAGE_API_KEY")
        if not key:
            raise ValueError("VOYAGE_API_KEY environment variable is not set")
        status, text = self.transport(VOYAGE_URL, {"Authorization": f"Bearer {key}"}, {"input": texts, "model": VOYAGE_MODEL, "input_type": kind})
        if not 200 <= status < 300:
            raise ValueError(f"Voyage API error ({status}): {text}")
        data = json.loads(text).get("data")
        if not isinstance(data, list) or len(data) != len(texts):
            raise ValueError(f"Voyage API returned unexpected response: expected {len(texts)} embeddings, got {len(data) if isinstance(data, list) else 'no data field'}")
        return _vectors([d.get("embedding") for d in data], "Voyage")

    def embed_documents(self, texts: list[str]) -> list[np.ndarray]:
        out, total = [], math.ceil(len(texts) / VOYAGE_BATCH)
        for i in range(0, len(texts), VOYAGE_BATCH):
            batch = texts[i : i + VOYAGE_BATCH]
            try:
                out += self._call(batch, "document")
            except Exception as e:
                raise ValueError(f"Embedding failed on batch {i // VOYAGE_BATCH + 1}/{total} (texts {i}-{i + len(batch) - 1}): {e}") from e
        return out

    def embed_query(self, text: str) -> np.ndarray:
        found = self._call([text], "query")
        if len(found) != 1:
            raise ValueError(f"Expected 1 query embedding, got {len(found)}")
        return found[0]


class OllamaProvider(_Provider):
    def __init__(self, transport: Transport = post):
        self.transport = transport
        self.dimension = int(os.environ.get("OLLAMA_DIMENSION") or OLLAMA_DIMENSION)

    def embed_documents(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        url = os.environ.get("OLLAMA_URL") or OLLAMA_URL
        try:
            status, text = self.transport(f"{url}/api/embed", {}, {"model": os.environ.get("OLLAMA_MODEL") or OLLAMA_MODEL, "input": texts})
        except Exception as e:
            raise ValueError(f"Failed to connect to Ollama at {url}: {e}") from e
        if not 200 <= status < 300:
            raise ValueError(f"Ollama API error ({status}): {text}")
        rows = json.loads(text).get("embeddings")
        if not isinstance(rows, list):
            raise ValueError("Ollama API returned unexpected response: missing embeddings array")
        if len(rows) != len(texts):
            raise ValueError(f"Ollama API returned unexpected response: expected {len(texts)} embeddings, got {len(rows)}")
        return _vectors(rows, "Ollama")


class TransformersProvider(_Provider):
    """In-process model. load(model, **options) gives a function (texts, pooling) -> vectors; the default reads an ONNX folder."""

    def __init__(self, load: Callable | None = None):
        self.load = load or _onnx
        self.dimension = int(os.environ.get("TRANSFORMERS_DIMENSION") or TRANSFORMERS_DIMENSION)
        self._run = None

    def embed_documents(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        name = os.environ.get("TRANSFORMERS_MODEL") or TRANSFORMERS_MODEL
        if self._run is None:
            local = os.environ.get("TRANSFORMERS_MODEL_PATH")
            options = {"dtype": dtype} if (dtype := os.environ.get("TRANSFORMERS_DTYPE")) else {}
            try:
                self._run = self.load(local or name, remote=not local, **options)
            except Exception as e:
                raise ValueError(f'Failed to load Transformers model "{name}": {e}') from e
        try:
            rows = self._run(texts, os.environ.get("TRANSFORMERS_POOLING") or TRANSFORMERS_POOLING)
        except Exception as e:
            raise ValueError(f"Transformers inference failed: {e}") from e
        out = []
        for row in rows:
            v = np.array(row, np.float32)
            norm = float(np.linalg.norm(v))
            out.append(v / norm if norm else v)
        return out


def _onnx(model: str, remote: bool = True, dtype: str | None = None):
    """A model folder with tokenizer.json and onnx/model.onnx (model_<dtype>.onnx)."""
    import onnxruntime
    from tokenizers import Tokenizer

    if not os.path.isdir(model):
        raise FileNotFoundError(f"{model} is no local folder" + (", and models are not downloaded" if remote else ""))
    tokenizer = Tokenizer.from_file(os.path.join(model, "tokenizer.json"))
    session = onnxruntime.InferenceSession(os.path.join(model, "onnx", f"model_{dtype}.onnx" if dtype else "model.onnx"))
    wanted = {i.name for i in session.get_inputs()}

    def run(texts: list[str], pooling: str):
        tokenizer.enable_padding()
        encoded = tokenizer.encode_batch(texts)
        feeds = {"input_ids": [e.ids for e in encoded], "attention_mask": [e.attention_mask for e in encoded], "token_type_ids": [e.type_ids for e in encoded]}
        hidden = session.run(None, {k: np.array(v, np.int64) for k, v in feeds.items() if k in wanted})[0]
        if pooling == "cls":
            return hidden[:, 0]
        mask = np.array(feeds["attention_mask"])[:, :, None]
        return (hidden * mask).sum(1) / mask.sum(1)

    return run


class HashingProvider(_Provider):
    """Offline and deterministic: signed hashing of terms, unit length."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed_documents(self, texts: list[str]) -> list[np.ndarray]:
        import zlib

        out = []
        for text in texts:
            v = np.zeros(self.dimension, np.float32)
            for term in token_list(text):
                h = zlib.crc32(term.encode())
                v[h % self.dimension] += 1 if h >> 31 else -1
            norm = float(np.linalg.norm(v))
            out.append(v / norm if norm else v)
        return out


_held: dict[str, EmbeddingProvider] = {}


def get_provider() -> EmbeddingProvider:
    """The process's provider, as EMBEDDING_PROVIDER names it."""
    if "provider" not in _held:
        name = os.environ.get("EMBEDDING_PROVIDER") or "transformers"
        if name not in NAMES:
            raise ValueError(f'Invalid EMBEDDING_PROVIDER "{name}". Valid options: {", ".join(NAMES)}')
        _held["provider"] = {"voyage": VoyageProvider, "ollama": OllamaProvider, "transformers": TransformersProvider}[name]()
    return _held["provider"]


def set_provider(provider: EmbeddingProvider) -> None:
    _held["provider"] = provider


def reset_provider() -> None:
    _held.clear()


def get_dimension() -> int:
    return get_provider().dimension


def embed_documents(texts: list[str]) -> list[np.ndarray]:
    return get_provider().embed_documents(texts)


def embed_query(text: str) -> np.ndarray:
    return get_provider().embed_query(text)


def embed_frame(rows: DataFrame, make: Callable[[], EmbeddingProvider] | None = None, text_col: str = "content", batch: int = VOYAGE_BATCH, by: str | None = None) -> DataFrame:
    """rows with a column embedding. Each worker makes one provider, or gets a copy of the process's, and sends it up to `batch` texts at a time; no row, no call.

    by: texts that differ in this column are not sent together, and what a call raises is told in columns error and trace of its rows.
    """
    from pyspark.sql import types as T

    if make is None:
        held = get_provider()
        make = lambda: held

    told = [T.StructField(c, T.StringType()) for c in ("error", "trace")] if by else []
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), *told])

    def run(frames):
        import traceback

        provider = None
        for frame in frames:
            groups = [g for _, g in frame.groupby(by, sort=False)] if by else [frame]
            for group in groups:
                for i in range(0, len(group), batch):
                    part = group.iloc[i : i + batch]
                    try:
                        provider = provider or make()
                        found, said = provider.embed_documents(part[text_col].tolist()), {}
                        if by:
                            said = {"error": None, "trace": None}
                    except Exception as e:
                        if not by:
                            raise
                        found, said = None, {"error": str(e), "trace": traceback.format_exc()}
                    vectors = [None] * len(part) if found is None else [[float(x) for x in v] for v in found]
                    yield part.assign(embedding=vectors, **said)

    return rows.mapInPandas(run, schema)
