"""Model inference as vectorised UDFs.

A model is whatever ``runtime_factory`` returns: a callable of a list of inputs giving a list
of results. It is made once per worker process, results follow the inputs' order, and a
failure gives a row with its error instead of failing the task, unless ``enforce`` is set.
Inputs that repeat are inferred once per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUNTIMES: dict[str, Any] = {}


def model_udf(runtime_factory: Callable[[], Callable[[list], list]], result: T.DataType, identity: str, batch: int = 64, enforce: bool = False):
    """A UDF returning ``struct<status, error, value>`` for any of the model ports."""
    schema = T.StructType([T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), T.StructField("value", result)])

    @F.pandas_udf(schema)
    def infer(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if identity not in _RUNTIMES:
            _RUNTIMES[identity] = runtime_factory()
        model = _RUNTIMES[identity]
        for part in parts:
            values = part.tolist()
            known: dict[Any, tuple] = {}
            todo = [v for v in dict.fromkeys(values) if v is not None]
            for at in range(0, len(todo), batch):
                own = todo[at : at + batch]
                try:
                    known |= {v: ("ok", None, r) for v, r in zip(own, model(own), strict=True)}
                except Exception as e:
                    if enforce:
                        raise
                    known |= {v: ("fallback", f"{type(e).__name__}: {e}", None) for v in own}
            rows = [known.get(v, ("missing", None, None)) for v in values]
            yield pd.DataFrame(rows, columns=["status", "error", "value"])

    return infer


def fake_runtime(dims: int = 8) -> Callable[[], Callable[[list], list]]:
    """A deterministic stand-in: unit vectors from the digest of the input."""

    def make() -> Callable[[list], list]:
        def run(items: list) -> list:
            out = []
            for x in items:
                raw = hashlib.sha256(x if isinstance(x, bytes) else str(x).encode()).digest()
                v = np.frombuffer(raw[:dims], dtype=np.uint8).astype(float) - 127.5
                out.append((v / np.linalg.norm(v)).tolist())
            return out

        return run

    return make


def inferred_once(rows: DataFrame, content: str, udf, out: str) -> DataFrame:
    """Applies a model to each distinct content once and joins the results back by its digest."""
    keyed = rows.withColumn("__sha", F.sha2(F.col(content).cast("binary"), 256))
    distinct = keyed.groupBy("__sha").agg(F.any_value(content).alias(content))
    results = distinct.select("__sha", udf(content).alias(out))
    return keyed.join(results, "__sha", "left").drop("__sha")


def screened(rows: DataFrame, keep, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a costly model on the rows that pass a cheap test and returns the others as they are."""
    passed = model(rows.filter(F.coalesce(keep, F.lit(False))))
    return passed.unionByName(rows.filter(~F.coalesce(keep, F.lit(False))), allowMissingColumns=True)
