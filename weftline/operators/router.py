"""Inference in numpy: the routing head, the task head, and models of any kind over batches of rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def parameter_count(model: object) -> int:
    """How many numbers a head is made of."""
    return sum(getattr(model, f.name).size for f in fields(model))


@dataclass
class Router:
    """Layer norm, a linear layer, GELU, a linear layer, softmax; dropout plays no part outside training."""

    scale: np.ndarray
    shift: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    def shares(self, tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """tokens [batch, token, number], mask [batch, token]: shares [batch, language]; an error for other shapes."""
        if tokens.ndim != 3 or mask.shape != tokens.shape[:2] or tokens.shape[2] != len(self.scale):
            raise ValueError(f"tokens {tokens.shape} and mask {mask.shape} don't fit a router of {len(self.scale)}")
        weight = mask.astype(float)[..., None]
        pooled = (tokens * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)
        centred = pooled - pooled.mean(axis=1, keepdims=True)
        normed = centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + 1e-5) * self.scale + self.shift
        hidden = normed @ self.first + self.first_bias
        hidden = hidden * 0.5 * (1 + np.vectorize(math.erf)(hidden / math.sqrt(2)))
        return _softmax(hidden @ self.second + self.second_bias)


@dataclass
class TaskHead:
    """A linear layer, tanh, a linear layer: logits of a vector, or of each of a text's."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        """[…, number] to […, class]; an error for vectors of another width."""
        if vectors.shape[-1] != self.first.shape[0]:
            raise ValueError(f"vectors of {vectors.shape[-1]} don't fit a head of {self.first.shape[0]}")
        return np.tanh(vectors @ self.first + self.first_bias) @ self.second + self.second_bias

    def classes(self, vectors: np.ndarray) -> np.ndarray:
        return self.logits(vectors).argmax(axis=-1)


def infer(rows: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], kind: str, into: str = "prediction", batch_rows: int = 256) -> DataFrame:
    """`rows` with what a model says of each: `make` is called once in a task and gives a function of a batch of rows.

    The model may be of any library that the workers have; `kind` is the type
    of what it says, as SQL writes it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for whole in batches:
            for at in range(0, len(whole), batch_rows):
                batch = whole.slice(at, batch_rows)
                said = model(batch)
                if len(said) != len(batch):
                    raise ValueError(f"{len(said)} predictions for {len(batch)} rows")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said)], [*batch.schema.names, into])

    if into in rows.columns:
        raise ValueError(f"there is a column named {into}")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{into}` {kind}")
