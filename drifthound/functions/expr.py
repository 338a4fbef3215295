"""Column expressions that several operators use."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def run_order() -> WindowSpec:
    """The events of a run in their order."""
    return W.partitionBy("run_id").orderBy("pos")


def so_far() -> WindowSpec:
    """The running frame of a run."""
    return run_order().rowsBetween(W.unboundedPreceding, W.currentRow)


AGGREGATORS = ("min", "max_knn", "mean_knn", "quantile", "mean")


def sigmoid(x: Column, clamp: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clamp), F.least(F.lit(clamp), x))))


def upper_rank(values: Column, q: float) -> Column:
    """Upper nearest-rank quantile of an array; infinity where it is empty."""
    at = F.least(F.size(values) - 1, F.ceil(F.lit(q) * (F.size(values) - 1))).cast("int")
    return F.when(F.size(values) == 0, F.lit(float("inf"))).otherwise(F.try_element_at(F.array_sort(values), at + 1))


def nearest(distances: Column, how: str = "max_knn", kappa: int = 3, q: float = 0.25) -> Column:
    """One score of an array of distances; 0 for an empty one."""
    if how not in AGGREGATORS:
        raise ValueError(f"unknown aggregator {how!r}")
    s, n = F.array_sort(distances), F.size(distances)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    if how == "min":
        value = F.array_min(distances)
    elif how == "mean":
        value = total(distances) / n
    elif how == "max_knn":
        value = F.try_element_at(s, F.greatest(F.lit(1), F.least(F.lit(kappa), n)))
    elif how == "mean_knn":
        k = F.greatest(F.lit(1), F.least(F.lit(kappa), n))
        value = total(F.slice(s, F.lit(1), k)) / k
    else:
        place = F.lit(q) * (n - 1)
        low = F.floor(place).cast("int")
        a, b = F.try_element_at(s, low + 1), F.try_element_at(s, F.least(low + 2, n))
        value = a + (b - a) * (place - low)
    return F.when(n > 0, value).otherwise(F.lit(0.0))


def without_own(d: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of distances in rising order, and how many count in each: the place `own`, where that is one, does not."""
    out = own >= 0
    s = d.copy()
    s[out, own[out]] = np.inf
    return np.sort(s, axis=1), d.shape[1] - out


def nearest_sorted(s: np.ndarray, n: np.ndarray, how: str = "max_knn", kappa: int = 3, q: float = 0.25) -> np.ndarray:
    """`nearest` inside a task: a score for each row of sorted distances, of which the first n count."""
    if how not in AGGREGATORS:
        raise ValueError(f"unknown aggregator {how!r}")
    rows = np.arange(len(s))
    if not s.shape[1]:
        return np.zeros(len(s))
    first = np.maximum(1, np.minimum(kappa, n))
    total = lambda k: np.where(np.arange(s.shape[1]) < k[:, None], s, 0.0).sum(axis=1)
    if how == "min":
        value = s[:, 0]
    elif how == "mean":
        value = total(n) / np.maximum(1, n)
    elif how == "max_knn":
        value = s[rows, first - 1]
    elif how == "mean_knn":
        value = total(first) / first
    else:
        place = q * np.maximum(0, n - 1)
        low = np.floor(place).astype(np.int64)
        a, b = s[rows, low], s[rows, np.maximum(0, np.minimum(low + 1, n - 1))]
        value = a + (b - a) * (place - low)
    return np.where(n > 0, value, 0.0)


def nearest_of(d: np.ndarray, own: np.ndarray, how: str = "max_knn", kappa: int = 3, q: float = 0.25) -> np.ndarray:
    """`nearest` inside a task: a score for each row of distances, without the place `own` where that is one."""
    return nearest_sorted(*without_own(d, own), how, kappa, q)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))
