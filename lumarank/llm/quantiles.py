"""Percentiles of very large numeric columns from mergeable relative-rank compactors.

Stated error: the rank of a returned percentile is off by at most ``EPSILON`` times the number
of values above the wanted rank, plus one (99 % confidence). The upper tail is protected, so
the error of p99 is a hundredth of that of the median in ranks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumarank.runtime import strip_blanks

SECTION = 32
EPSILON = 0.02
#: Values a partition holds in sketches before it hands them on.
FLUSH_VALUES = 2_000_000
#: Partial sketches merged by one task before the second level of merging.
FAN_IN = 64


class _Level:
    """One compactor: items of equal weight, of which the greatest are never compacted."""

    __slots__ = ("items", "sections", "width", "turns", "coin")

    def __init__(self, items: np.ndarray, sections: int = 3, width: float = SECTION, turns: int = 0, coin: int = 0):
        self.items, self.sections, self.width, self.turns, self.coin = items, sections, width, turns, coin

    @property
    def section(self) -> int:
        return max(4, 2 * round(self.width / 2))

    @property
    def capacity(self) -> int:
        return 2 * self.sections * self.section

    def widen(self) -> None:
        """Twice the sections, each narrower by the root of two, as compactions add up."""
        while self.turns >= 1 << (self.sections - 1) and self.width / 2**0.5 >= 4:
            self.width /= 2**0.5
            self.sections *= 2

    def compact(self, salt: int) -> np.ndarray:
        """Every second one of the smallest items, which leave this level."""
        self.items.sort()
        ones = (~self.turns & (self.turns + 1)).bit_length() - 1
        free = min(ones + 1, self.sections) * self.section
        keep = 2 * self.sections * self.section - free
        out = (len(self.items) - keep) // 2 * 2
        if out <= 0:
            return self.items[:0]
        if self.turns % 2:
            self.coin ^= 1
        else:
            x = (self.turns * 0x9E3779B97F4A7C15 + salt * 0xBF58476D1CE4E5B9 + len(self.items)) & (2**64 - 1)
            self.coin = ((x ^ (x >> 31)) * 0x94D049BB133111EB >> 40) & 1
        up = self.items[:out][self.coin :: 2].copy()
        self.items = self.items[out:].copy()
        self.turns += 1
        self.widen()
        return up


class RelativeRankSketch:
    """Mergeable summary with multiplicative rank error towards the greatest values."""

    def __init__(self, levels: list[_Level] | None = None, n: int = 0):
        self.levels, self.n = levels or [_Level(np.empty(0))], n

    def update(self, values: np.ndarray) -> None:
        values = np.asarray(values, dtype=np.float64)
        low = self.levels[0]
        low.items = np.concatenate([low.items, values])
        self.n += len(values)
        self._compress()

    def merge(self, other: RelativeRankSketch) -> None:
        for h, level in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(_Level(np.empty(0)))
            mine = self.levels[h]
            mine.items = np.concatenate([mine.items, level.items])
            mine.turns |= level.turns
            if level.sections > mine.sections:
                mine.sections, mine.width = level.sections, level.width
            mine.widen()
        self.n += other.n
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            while len(level.items) >= level.capacity:
                up = level.compact(h)
                if not len(up):
                    break
                if h + 1 == len(self.levels):
                    self.levels.append(_Level(np.empty(0)))
                self.levels[h + 1].items = np.concatenate([self.levels[h + 1].items, up])
            h += 1

    def quantiles(self, qs: Sequence[float]) -> list[float | None]:
        """For each q the value of rank ceil(q n); None for an empty sketch."""
        if not self.n:
            return [None] * len(qs)
        values = np.concatenate([x.items for x in self.levels])
        weights = np.concatenate([np.full(len(x.items), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        at = [min(int(np.searchsorted(ranks, max(1, int(np.ceil(q * self.n - 1e-9))))), len(values) - 1) for q in qs]
        return [float(values[order[i]]) for i in at]

    def to_bytes(self) -> bytes:
        head = [self.n, len(self.levels)]
        for x in self.levels:
            head += [len(x.items), x.sections, x.turns, x.coin, int(np.float64(x.width).view(np.int64))]
        return np.array(head, dtype=np.int64).tobytes() + np.concatenate([x.items for x in self.levels]).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> RelativeRankSketch:
        n, count = np.frombuffer(raw, dtype=np.int64, count=2)
        head = np.frombuffer(raw, dtype=np.int64, count=5 * count, offset=16).reshape(count, 5)
        items = np.frombuffer(raw, dtype=np.float64, offset=16 + 40 * int(count))
        levels, at = [], 0
        for size, sections, turns, coin, width in head.tolist():
            levels.append(_Level(items[at : at + size].copy(), sections, float(np.int64(width).view(np.float64)), turns, coin))
            at += size
        return cls(levels, int(n))


def _build(keys: list[str], value: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() // FAN_IN
        held: dict[tuple, list[np.ndarray]] = {}
        waiting = 0

        def out() -> pd.DataFrame:
            rows = []
            for key, chunks in held.items():
                sketch = RelativeRankSketch()
                sketch.update(np.concatenate(chunks))
                rows.append((*key, part, sketch.n, sketch.to_bytes()))
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, "part", "n", "sketch"])

        for pdf in batches:
            # rows of a key are brought together once per batch, whatever the number of keys
            codes = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0]) if len(order) else []
            names = list(zip(*(pdf[k].to_numpy(dtype=object)[order[starts]] for k in keys)))
            for name, values in zip(names, np.split(pdf[value].to_numpy()[order], starts[1:])):
                key = tuple(None if k is None or k != k else k for k in name)
                held.setdefault(key, []).append(values)
            waiting += len(pdf)
            if waiting > FLUSH_VALUES:
                yield out()
                waiting = 0
        if held:
            yield out()

    return run


def _merge(keys: list[str]):
    """Merges runs of equal keys in a sorted stream, holding one sketch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        whole: RelativeRankSketch | None = None
        for pdf in batches:
            rows = []
            for *key, raw in zip(*(pdf[k].to_numpy(dtype=object) for k in keys), pdf["sketch"]):
                key = tuple(None if k is None or k != k else k for k in key)
                if whole is not None and key == now:
                    whole.merge(RelativeRankSketch.from_bytes(raw))
                    continue
                if whole is not None:
                    rows.append((*now, whole.n, whole.to_bytes()))
                now, whole = key, RelativeRankSketch.from_bytes(raw)
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "n", "sketch"])
        if whole is not None:
            yield pd.DataFrame([(*now, whole.n, whole.to_bytes())], columns=[*keys, "n", "sketch"])

    return run


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [T.StructField(k, kinds[k]) for k in keys]


_SKETCH = [T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())]


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch per ``keys`` from the sketches of partitions, days or earlier merges."""
    schema = T.StructType([*_key_fields(sketches, keys), *_SKETCH])
    return sketches.select(*keys, "sketch").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_merge(list(keys)), schema)


def build_sketches(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A sketch of ``value`` per ``keys`` as ``(keys..., n, sketch)``.

    Every partition sketches its own rows, so that only sketches are shuffled; they merge in
    two levels, at most FAN_IN partitions in a first task, so that a key which all partitions
    hold doesn't meet in one task at once. Null keys are a key of their own; null, NaN and
    infinite values take no part; an empty input gives no rows.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias(value))
    rows = rows.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    fields = _key_fields(rows, keys)
    parts = rows.mapInPandas(_build(keys, value), T.StructType([*fields, T.StructField("part", T.LongType()), *_SKETCH]))
    return merge_sketches(merge_sketches(parts, [*keys, "part"]), keys)


def sketch_quantiles(sketches: DataFrame, qs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``names`` in place of the sketch: the value of rank ceil(q n) for each q, within the stated error."""
    qs = [float(q) for q in qs]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: RelativeRankSketch.from_bytes(x).quantiles(qs))

    rest = [c for c in sketches.columns if c != "sketch"]
    got = sketches.select(*rest, read("sketch").alias("__q"))
    return got.select(*rest, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])


def attempt_latencies(attempts: DataFrame) -> DataFrame:
    """``(model, task, day, latency_ms)``, each attempt_id once, of finite latencies above 0.

    ``model`` is in lower case without outer blanks; attempts without an id take no part; a
    missing model, task or day is a key of its own.
    """
    value = F.col("latency_ms")
    rows = attempts.filter((value > 0) & (value < float("inf")) & F.col("attempt_id").isNotNull()).select(
        "attempt_id",
        F.struct(value.alias("latency_ms"), F.lower(strip_blanks(F.col("model"))).alias("model"), "task", F.to_date("recorded_at").alias("day")).alias("row"),
    )
    return rows.groupBy("attempt_id").agg(F.min("row").alias("row")).select("row.model", "row.task", "row.day", "row.latency_ms")


def daily_latency_sketches(attempts: DataFrame) -> DataFrame:
    """The table to keep: one sketch per model, task and day; tables of other days unite with it."""
    return build_sketches(attempt_latencies(attempts), ["model", "task", "day"], "latency_ms")
