"""Texts to vectors: prefixes, a hook for a model, and a hashed stand-in for one.

A model is anything that takes a list of texts and gives an array with a row for each,
in their order. It is loaded once by each worker process and is given texts a batch at
a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from docquery.functions.loaded import Loaded
from docquery.functions.text import counts, let
from docquery.operators.search import normalise, tokens

#: What stands before queries and passages for models of this family.
PREFIXES = {"query": "Represent this sentence for searching relevant passages: ", "passage": ""}


def with_prefix(text: Column, model: str, side: str = "query", prefixes: dict[str, str] = PREFIXES) -> Column:
    """The text as a model wants it: with its side's prefix if the model's name contains bge."""
    return F.concat(F.lit(prefixes[side]), text) if "bge" in model.lower() else text


def hashed_vector(text: Column, dimension: int = 1024) -> Column:
    """Unit vector of word counts by hashed bucket (md5): repeatable and without a model; a stand-in for one."""
    buckets = F.transform(tokens(text), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dimension)))

    # counted once; then each place of the vector is a lookup
    return normalise(let(F.map_from_entries(counts(buckets)), lambda n: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dimension - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(n, i), F.lit(0)).cast("double"))))


class HashedModel:
    """``hashed_vector`` as a model."""

    #: Words whose buckets a worker remembers at most.
    REMEMBERED = 1 << 18

    def __init__(self, dimension: int = 1024):
        self.dimension = dimension
        self.buckets: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        found = [re.findall(r"\w{2,}", t.lower()) for t in texts]
        known, at = self.buckets, []
        for w in (w for words in found for w in words):
            if (x := known.get(w)) is None:
                if len(known) >= self.REMEMBERED:
                    known.clear()
                x = known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dimension
            at.append(x)
        row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, found), np.int64, len(found)))
        out = np.bincount(row * self.dimension + np.array(at, np.int64), minlength=len(texts) * self.dimension).astype(float).reshape(-1, self.dimension)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)


def _vectors(model: Callable[[list[str]], np.ndarray], texts: list[str | None], batch: int) -> list[np.ndarray | None]:
    """A vector for each text by its place; null texts have none and aren't given to the model."""
    out: list[np.ndarray | None] = [None] * len(texts)
    some = [k for k, t in enumerate(texts) if t is not None]
    for at in range(0, len(some), batch):
        own = some[at : at + batch]
        made = np.asarray(model([texts[k] for k in own]), float)
        if made.ndim != 2 or len(made) != len(own):
            raise ValueError(f"the model gave {made.shape} for {len(own)} texts")
        for k, v in zip(own, made, strict=True):
            out[k] = v
    return out


def embedded(df: DataFrame, model: Loaded, *, text: str = "text", vector: str = "embedding", batch: int = 2000) -> DataFrame:
    """Adds the vectors of a model, ``batch`` texts at a time; a null text has a null vector. A column of that name is replaced. For one text after the other, as a service embeds them, 32 is a usual batch."""
    kept = [c for c in df.columns if c != vector]
    places = [f"c{k}" for k in range(len(kept))]
    schema = ", ".join(f"{p} {df.schema[c].dataType.simpleString()}" for p, c in zip(places, kept, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.get()
        for whole in batches:
            for b in (whole.slice(at, batch) for at in range(0, whole.num_rows, batch)):
                made = _vectors(own, b.column(b.num_columns - 1).to_pylist(), batch)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.list_(pa.float64()))], names=[*places, "v"])

    given = df.select(*[df[f"`{c}`"].alias(p) for p, c in zip(places, kept, strict=True)], df[f"`{text}`"].alias("__text"))
    return given.mapInArrow(run, f"{schema}, v array<double>").toDF(*kept, vector)


def model_vectors(model: Loaded, batch: int = 32) -> Callable[[Column], Column]:
    """The same as a column function, for where vectors are one expression among others."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def vectors(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model.get()
        for texts in parts:
            made = _vectors(own, texts.to_pylist(), batch)
            none = np.array([v is None for v in made], bool)
            ends = np.append(0, np.cumsum([0 if v is None else len(v) for v in made])).astype(np.int32)
            flat = np.concatenate([np.zeros(0), *(v for v in made if v is not None)])
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(none))

    return vectors
