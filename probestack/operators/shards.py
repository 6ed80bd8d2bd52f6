"""Packing items into bounded shards. Each walk is sequential by nature and runs per group."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame


class _Totals:
    """Shards' totals under a tree of minima, so that the first one with room is found in logarithmic time."""

    def __init__(self):
        self.n, self.size, self.low = 0, 1, [math.inf, math.inf]

    def first(self, fits) -> int | None:
        """The first shard whose total fits; fits holds for any smaller total too."""
        if not fits(self.low[1]):
            return None
        at = 1
        while at < self.size:
            at = 2 * at if fits(self.low[2 * at]) else 2 * at + 1
        return at - self.size

    def put(self, shard: int | None, duration: float) -> int:
        """Add to a shard, or to a new one."""
        if shard is None:
            shard, self.n = self.n, self.n + 1
            if self.n > self.size:
                totals = self.low[self.size :] + [math.inf] * self.size
                self.size *= 2
                self.low = [math.inf] * self.size + totals
                for i in range(self.size - 1, 0, -1):
                    self.low[i] = min(self.low[2 * i], self.low[2 * i + 1])
            self.low[self.size + shard] = 0.0
        at = self.size + shard
        self.low[at] += duration
        while at > 1:
            at //= 2
            self.low[at] = min(self.low[2 * at], self.low[2 * at + 1])
        return shard


def first_fit(durations: list[float], bound: float) -> list[int]:
    """Shard of each item: an item over the bound takes the first empty shard, others the first with room (strictly below the bound)."""
    totals, out = _Totals(), []
    for d in durations:
        shard = totals.first(lambda t: t <= 0.0) if d > bound else totals.first(lambda t: t + d < bound)  # noqa: B023
        out.append(totals.put(shard, d))
    return out


def sequential(durations: list[float], bound: float) -> list[int]:
    """Shard of each item: a shard is closed after its sum exceeds the bound, so it may overshoot."""
    shard, total, out = 0, 0.0, []
    for d in durations:
        out.append(shard)
        total += d
        if total > bound:
            shard, total = shard + 1, 0.0
    return out


def pack(items: DataFrame, group: str, order: list[str], duration: str, bound: float, method: str = "first_fit") -> DataFrame:
    """items with a column shard, packed per group in the given order (with unique last key)."""
    walk = {"first_fit": first_fit, "sequential": sequential}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(shard=pd.Series(walk(pdf[duration].tolist(), bound), index=pdf.index, dtype="int32"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", shard int"
    return items.groupBy(group).applyInPandas(run, schema)
