"""Exact random streams: one NumPy generator a contrast, used in a fixed order and issued once.

A contrast's intervals depend only on its own name, whatever ran before; two contrasts of one
name would share their draws, so the second is refused. Within a contrast the generator
serves the item interval first and the cluster interval then, as one record's fields are
filled. Such a stream is serial: a contrast is one task's work, and contrasts are spread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SEED = 20260805
REPS = 20_000
#: Names that one registry can hold.
MOST_NAMES = 100_000
HELD_DRAWS = 1 << 22


class Streams:
    """The names issued under a seed; a name is its contrast's key, joined by slashes."""

    def __init__(self, seed: int = SEED) -> None:
        self.seed, self.names = seed, set()

    def issue(self, contrasts: DataFrame) -> None:
        """Takes the names of (distinct) contrasts; ValueError if one of them was taken before."""
        new = ["/".join(map(str, r)) for r in contrasts.limit(MOST_NAMES + 1).collect()]
        if len(new) + len(self.names) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} streams")
        twice = self.names.intersection(new)
        if twice or len(set(new)) < len(new):
            raise ValueError(f"streams asked for a second time: {sorted(twice or {n for n in new if new.count(n) > 1})[:3]}")
        self.names.update(new)

    def intervals(self, items: DataFrame, keys: list[str], value: str, order: str, cluster: str | None = None, reps: int = REPS) -> DataFrame:
        """For each contrast an interval over items and, with cluster, one over clusters (unit says which)."""
        self.issue(items.select(*keys).distinct())
        return ordered_intervals(items, keys, value, order, cluster, reps, self.seed)


def generator(seed: int, name: str) -> np.random.Generator:
    return np.random.default_rng([seed, *map(ord, name)])


def item_means(values: np.ndarray, rng: np.random.Generator, reps: int) -> np.ndarray:
    """Means of as many drawn items as there are."""
    step = max(1, HELD_DRAWS // len(values))
    return np.concatenate([values[rng.integers(0, len(values), (min(step, reps - a), len(values)))].mean(1) for a in range(0, reps, step)])


def cluster_means(values: np.ndarray, labels: np.ndarray, rng: np.random.Generator, reps: int) -> np.ndarray:
    """Means over the items of as many drawn clusters as there are; ValueError below two."""
    _, at = np.unique(labels, return_inverse=True)
    sums, sizes = np.bincount(at, values), np.bincount(at)
    k = len(sizes)
    if k < 2:
        raise ValueError("two clusters at least")
    step, out = max(1, HELD_DRAWS // k), []
    for a in range(0, reps, step):
        draw = rng.integers(0, k, (min(step, reps - a), k))
        out.append(sums[draw].sum(1) / sizes[draw].sum(1))
    return np.concatenate(out)


def told(means: np.ndarray, effect: float) -> list[float]:
    """effect, lo, hi, p and p_centred."""
    below, floor = float((means <= 0).mean()), 1 / len(means)
    far = float((np.abs(means - effect) >= abs(effect) - 1e-12).mean())
    return [effect, *np.quantile(means, [0.025, 0.975]), max(2 * min(below, 1 - below), floor), max(far, floor)]


def ordered_intervals(items: DataFrame, keys: list[str], value: str, order: str, cluster: str | None, reps: int, seed: int) -> DataFrame:
    """The intervals alone; NaN and null values are left out before anything is drawn."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        name = [frame[k].iloc[0] for k in keys]
        rng = generator(seed, "/".join(map(str, name)))
        d = frame[value].to_numpy(dtype=float)
        rows = [[*name, "item", *told(item_means(d, rng, reps), float(d.mean())), len(d), len(d)]]
        if cluster is not None:
            labels = frame[cluster].to_numpy()
            rows.append([*name, "cluster", *told(cluster_means(d, labels, rng, reps), float(d.mean())), len(d), len(np.unique(labels))])
        return pd.DataFrame(rows, columns=columns)

    columns = [*keys, "unit", "effect", "lo", "hi", "p", "p_centred", "n", "n_clusters"]
    kinds = [*(items.schema[k].dataType.simpleString() for k in keys), "string", *["double"] * 5, "long", "long"]
    used = items.select(*keys, order, value, *([cluster] if cluster else [])).where(f"{value} is not null and not isnan({value})")
    return used.groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {k}" for c, k in zip(columns, kinds, strict=True)))
