"""Models behind a digest, as objects that a worker makes once, and offline stand-ins for them."""

from __future__ import annotations

import hashlib
import json
import logging
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
#: Sends a JSON request to an address with headers and gives the JSON answer.
Transport = Callable[[str, dict, dict], dict]


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Writer(Protocol):
    def write(self, prompt: str) -> str: ...


class HashEmbedder:
    """Word counts in hashed dimensions: the same text has the same vector everywhere."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                row[h % self.dim] += 1 if h >> 63 else -1
        return out


class FirstSentence:
    """A summary that is the first sentence of the abstract in the prompt."""

    def write(self, prompt: str) -> str:
        m = re.search(r"(?s)Abstract:\n(.*?)\n\n", prompt)
        return re.split(r"(?<=[.!?])\s", m.group(1).strip(), maxsplit=1)[0] if m else prompt[:100]


class CapitalLines:
    """Organisations that are the lines of the text that name one, as a JSON list."""

    def write(self, prompt: str) -> str:
        return json.dumps([x.strip() for x in prompt.split("\n")[1:] if re.search(r"\b(?:University|Institute|Laboratory|Hospital)\b", x)])


def http_json(url: str, body: dict, headers: dict, seconds: float = 60.0) -> dict:
    """The transport of the clients below where no other is given."""
    asked = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(asked, timeout=seconds) as answer:
        return json.load(answer)


class _Client:
    """A model behind an address that speaks the common JSON forms of embeddings and chats."""

    def __init__(self, base_url: str, key: str, model: str, transport: Transport = http_json, **settings: object):
        self.base_url, self.key, self.model, self.transport, self.settings = base_url.rstrip("/"), key, model, transport, settings

    def _ask(self, path: str, body: dict) -> dict:
        return self.transport(f"{self.base_url}/{path}", {"model": self.model, **self.settings, **body}, {"Authorization": f"Bearer {self.key}"})


class ApiEmbedder(_Client):
    """Vectors from an API, put in order by the index that the answer gives each."""

    def embed(self, texts: list[str]) -> np.ndarray:
        data = self._ask("embeddings", {"input": texts})["data"]
        return np.array([d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))], dtype=np.float64)


class ApiWriter(_Client):
    """Answers of a chat model. role: what the model is told that it is."""

    def __init__(self, *args: object, role: str | None = None, **settings: object):
        super().__init__(*args, **settings)
        self.role = role

    def write(self, prompt: str) -> str:
        told = [{"role": "system", "content": self.role}] if self.role else []
        return self._ask("chat/completions", {"messages": [*told, {"role": "user", "content": prompt}]})["choices"][0]["message"]["content"]


class LocalEmbedder:
    """A model of a sentence-embedding library that is installed on the workers; an error says so where it isn't."""

    def __init__(self, model: str, **settings: object):
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("the local embedder needs the package sentence_transformers") from e
        self.model, self.settings = SentenceTransformer(model, trust_remote_code=False), settings

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.model.encode(texts, **self.settings), dtype=np.float64)


def register_model(registry: dict[str, Callable], name: str, maker: Callable, needs: str) -> None:
    """Make a model known by a name; maker() is called once a worker. What it makes must have the method `needs`."""
    if isinstance(maker, type) and not callable(getattr(maker, needs, None)):
        raise TypeError(f"{name} has no method {needs}")
    registry[name] = maker


def checked_vectors(vectors: object, texts: int) -> np.ndarray:
    """The vectors as a matrix with a row for each text; another shape is an error of the model."""
    m = np.asarray(vectors, dtype=np.float64)
    if texts and (m.ndim != 2 or len(m) != texts):
        raise ValueError(f"{texts} texts gave vectors of the shape {m.shape}")
    return m


EMBEDDERS: dict[str, type] = {"hash": HashEmbedder}
WRITERS: dict[str, type] = {"first_sentence": FirstSentence, "capital_lines": CapitalLines}


def named(registry: dict[str, type], name: str) -> type:
    if name not in registry:
        raise ValueError(f"{name} not found; there are {', '.join(sorted(registry))}")
    return registry[name]


def embedded(text: Column, name: str = "hash", batch: int | None = 64) -> Column:
    """Vectors of texts, asked for in batches (64 for null and 0); the model is made once a worker."""
    maker, size = named(EMBEDDERS, name), batch or 64

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = maker()
        for texts in batches:
            said = ["" if t is None else t for t in texts]
            yield pd.Series([v.tolist() for at in range(0, len(said), size) for v in checked_vectors(model.embed(said[at : at + size]), len(said[at : at + size]))], dtype=object)

    return run(text)


class Tokens(Protocol):
    """What cuts a text into tokens and puts them together again, such as a public tokenizer."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


def clipped(prompt: str, most: int, tokens: Tokens | None = None) -> str:
    """At most `most` tokens of a prompt; without a tokenizer, runs of text without blanks with the blanks between them."""
    if tokens is not None:
        ids = tokens.encode(prompt)
        return prompt if len(ids) <= most else tokens.decode(ids[:most])
    ends = [m.end() for m in re.finditer(r"\S+", prompt)]
    return prompt if len(ends) <= most else prompt[: ends[most - 1]]


def written(prompt: Column, name: str, most: int, tokens: Callable[[], Tokens] | None = None) -> Column:
    """Answers of a model, null for a null prompt and, with a line in the worker's log, for a failure; the model is made once a worker.

    tokens: makes the tokenizer that prompts are clipped by, once a worker.
    """
    maker = named(WRITERS, name)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, cutter = maker(), None if tokens is None else tokens()
        for prompts in batches:
            out = []
            for p in prompts:
                try:
                    out.append(None if p is None else model.write(clipped(p, most, cutter)))
                except Exception:
                    log.warning("the model %s gave no answer", name, exc_info=True)
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return run(prompt)
