"""Embedders as plug-ins: a resource that each Python worker makes once and that turns batches of texts into vectors."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a text that an embedder is given at most; a longer one is an error, never cut.
MAX_PAYLOAD = 1 << 20


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedGrams:
    """Counts of hashed character trigrams, case folded, with signs, at unit length. A text without a trigram has the zero vector."""

    def __init__(self, dims: int = 256) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            folded = text.lower()
            hashes = np.fromiter((zlib.crc32(folded[i : i + 3].encode("utf-8", "surrogatepass")) for i in range(len(folded) - 2)), dtype=np.int64)
            np.add.at(row, (hashes >> 1) % self.dims, 1.0 - 2.0 * (hashes & 1))
            if length := np.sqrt(row @ row):
                row /= length
        return out


_made: dict[str, Embedder] = {}


def embedded(df: DataFrame, text: str, make: Callable[[], Embedder] = HashedGrams, name: str = "hashed-grams-256", most: int = MAX_PAYLOAD) -> DataFrame:
    """df with vector (array of float) and error of column text; df has no columns of these names.

    make builds the embedder, once in each Python worker for a name, which has to change with make. A null text has neither vector
    nor error. A text of over most bytes, or one that the embedder fails on, has an error and no vector; when a batch fails, its
    texts are tried one by one, so that the others stand.
    """

    def one(resource: Embedder, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [(v.tolist(), None) for v in np.asarray(resource.embed(texts), dtype=np.float32)]
        except Exception as e:
            if len(texts) == 1:
                return [(None, type(e).__name__)]
            return [one(resource, [t])[0] for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _made:
            _made[name] = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            out: list[tuple[list[float] | None, str | None]] = [(None, None) if t is None else (None, "payload too large") for t in texts]
            fits = [i for i, t in enumerate(texts) if t is not None and len(t.encode("utf-8", "surrogatepass")) <= most]
            for i, got in zip(fits, one(_made[name], [texts[i] for i in fits]) if fits else []):
                out[i] = got
            vectors, errors = pa.array([v for v, _ in out], type=pa.list_(pa.float32())), pa.array([e for _, e in out], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors, errors], names=[*batch.schema.names, "vector", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, vector array<float>, error string")
