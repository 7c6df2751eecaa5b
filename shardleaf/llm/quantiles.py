"""Mergeable percentiles with relative rank error, by relative-rank compactors."""

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKETCH = "n bigint, items array<double>, sizes array<int>, states array<bigint>"


class RelativeSketch:
    """A stack of compactors that keeps the highest values of each level and halves the others.

    With section size k, the estimated rank of a value differs from its true rank r (of n) by about
    (n - r) / (4 k) in one standard deviation: the error is multiplicative in the distance from the top. Up to 6 k
    values are kept as they are, so the result is then exact. Sketches merge in any order.
    """

    def __init__(self, k: int = 64):
        self.k, self.n, self.levels, self.states = k, 0, [np.empty(0)], [0]

    def _shape(self, level: int) -> tuple[int, int]:
        """Sections and their size: as compactions add up, there are more and smaller ones."""
        sections, size = 3, float(self.k)
        while self.states[level] >= 1 << (sections - 1) and size / math.sqrt(2) >= 4:
            sections, size = sections * 2, size / math.sqrt(2)
        return sections, 2 * round(size / 2)

    def _compress(self) -> None:
        level = 0
        while level < len(self.levels):
            sections, size = self._shape(level)
            if len(self.levels[level]) > 2 * sections * size:
                values, state = np.sort(self.levels[level]), self.states[level]
                due = min(sections, (~state & (state + 1)).bit_length())  # trailing ones of the state, and one
                low = len(values) - (sections * size + (sections - due) * size)
                low -= low % 2
                coin = zlib.crc32(struct.pack("<qqqdd", level, state, low, values[0], values[low // 2])) & 1  # a task run again decides alike
                if level + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.states.append(0)
                self.levels[level + 1] = np.concatenate([self.levels[level + 1], values[:low][coin::2]])
                self.levels[level], self.states[level] = values[low:], state + 1
            level += 1

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], np.asarray(values, float)])
        self._compress()

    def merge(self, other: "RelativeSketch") -> None:
        self.n += other.n
        for level, (items, state) in enumerate(zip(other.levels, other.states)):
            if level == len(self.levels):
                self.levels.append(np.empty(0))
                self.states.append(0)
            self.levels[level] = np.concatenate([self.levels[level], items])
            self.states[level] |= state
        self._compress()

    def quantiles(self, qs) -> list[float]:
        """The least kept value whose estimated rank is at least q * n (nearest rank)."""
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 1 << h) for h, x in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        return [float(values[order[min(len(order) - 1, int(np.searchsorted(ranks, q * ranks[-1] - 1e-9)))]]) for q in qs]

    def row(self) -> dict:
        return {"n": self.n, "items": np.concatenate(self.levels), "sizes": [len(x) for x in self.levels], "states": list(self.states)}

    @classmethod
    def of(cls, k: int, n, items, sizes, states) -> "RelativeSketch":
        it = cls(k)
        it.n, it.states = int(n), [int(s) for s in states]
        it.levels = np.split(np.asarray(items, float), np.cumsum(sizes)[:-1])
        return it


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def build_sketches(df: DataFrame, keys: list[str], value_col: str, k: int = 64, hold: int = 1 << 20, fan_in: int = 256) -> DataFrame:
    """One sketch (columns ``n, items, sizes, states``) of ``value_col`` per group of ``keys``.

    Null and NaN values are left out; a group without values has no sketch; null keys form a group of their own; ties
    and repeated rows count as often as they stand there; columns other than the keys and the value are ignored.
    Each task first sketches what it holds (at most ``hold`` values at a time, so many keys only make more partial
    sketches), then partial sketches merge in a tree: a hot group never meets in one task as values.
    """
    given = df.select(*keys, F.col(value_col).cast("double").alias("_value")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    schema = f"{_key_schema(given, keys)}, {SKETCH}, _part bigint"

    def partial(batches):
        held, count, part = {}, 0, 0

        def flush():
            rows = []
            for key, chunks in held.items():
                sketch = RelativeSketch(k)
                sketch.add(np.concatenate(chunks))
                rows.append(dict(zip(keys, key)) | sketch.row() | {"_part": part})
            return pd.DataFrame(rows, columns=[*keys, "n", "items", "sizes", "states", "_part"])

        for pdf in batches:
            for key, values in pdf.groupby(keys, dropna=False, sort=False)["_value"]:
                held.setdefault(tuple(None if pd.isna(x) else x for x in key), []).append(values.to_numpy())
            count += len(pdf)
            if count >= hold:
                yield flush()
                held, count, part = {}, 0, part + 1
        if held:
            yield flush()

    parts = given.mapInPandas(partial, schema).withColumn("_part", F.xxhash64(F.spark_partition_id(), "_part")).checkpoint()
    groups = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).head().n
    while groups > fan_in:  # a tree: one merge sees about fan_in sketches of a key, however many tasks there were
        groups = -(-groups // fan_in)
        parts = merge_sketches(parts.withColumn("_part", F.pmod(F.xxhash64("_part"), F.lit(groups))), [*keys, "_part"], k)
    return merge_sketches(parts, keys, k)


def merge_sketches(df: DataFrame, keys: list[str], k: int = 64) -> DataFrame:
    """The sketches of ``df`` merged per group of ``keys`` (of days into weeks, say), without the values they stand for.

    No sketch in, none out. Without keys, all merge into one.
    """
    given = df.select(*keys, "n", "items", "sizes", "states")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        total = RelativeSketch(k)
        for row in pdf[["n", "items", "sizes", "states"]].itertuples(index=False):
            total.merge(RelativeSketch.of(k, *row))
        return pd.DataFrame([{c: pdf[c].iloc[0] for c in keys} | total.row()])

    schema = ", ".join(x for x in (_key_schema(given, keys), SKETCH) if x)
    return given.groupBy(*keys).applyInPandas(merged, schema)


def read_percentiles(sketches: DataFrame, keys: list[str], percents: list[int], k: int = 64) -> DataFrame:
    """``keys``, ``pct`` (int), ``n`` and ``value`` of each sketch and percent."""
    given = sketches.select(*keys, "n", "items", "sizes", "states")

    def read(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                sketch = RelativeSketch.of(k, row["n"], row["items"], row["sizes"], row["states"])
                for pct, value in zip(percents, sketch.quantiles([p / 100 for p in percents])):
                    rows.append({c: row[c] for c in keys} | {"pct": pct, "n": row["n"], "value": value})
            yield pd.DataFrame(rows, columns=[*keys, "pct", "n", "value"])

    return given.mapInPandas(read, ", ".join(x for x in (_key_schema(given, keys), "pct int, n bigint, value double") if x))
