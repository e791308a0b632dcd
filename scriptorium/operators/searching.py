"""ML6: settings searched by a tree-structured Parzen estimator.

Trials are ordered by loss; two densities are formed for each parameter, of the good trials and of the
others, and of the draws from the first the one is tried whose ratio of densities is largest. The trials
follow one another, as each learns from those before; the work of a trial is Spark's.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STARTUP, DRAWS, MOST_GOOD = 10, 24, 25  # random trials first; draws for a proposal; good trials at most


@dataclass(frozen=True)
class Real:
    """A number between two bounds, on a logarithmic scale if ``log``; whole if ``whole``."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inner(self, v: float) -> float:
        a, b, x = (math.log(t) if self.log else t for t in (self.low, self.high, v))
        return (x - a) / (b - a) if b > a else 0.0

    def outer(self, u: float):
        a, b = (math.log(t) if self.log else t for t in (self.low, self.high))
        x = a + min(max(u, 0.0), 1.0) * (b - a)
        x = math.exp(x) if self.log else x
        return round(min(max(x, self.low), self.high)) if self.whole else min(max(x, self.low), self.high)

    def random(self, rng: np.random.Generator):
        return self.outer(rng.random())

    def proposals(self, good: list, bad: list, rng: np.random.Generator) -> list[tuple[object, float]]:
        l, g = Mixture([self.inner(v) for v in good]), Mixture([self.inner(v) for v in bad])
        drawn = l.draw(rng, DRAWS)
        return [(self.outer(u), r) for u, r in zip(drawn, l.log_density(drawn) - g.log_density(drawn))]


@dataclass(frozen=True)
class Choice:
    """One of some values."""

    values: tuple

    def random(self, rng: np.random.Generator):
        return self.values[rng.integers(len(self.values))]

    def proposals(self, good: list, bad: list, rng: np.random.Generator) -> list[tuple[object, float]]:
        share = lambda seen: np.array([1 + sum(v == x for x in seen) for v in self.values], float) / (len(self.values) + len(seen))
        l, g = share(good), share(bad)
        return [(self.values[k], math.log(l[k] / g[k])) for k in rng.choice(len(self.values), DRAWS, p=l)]


class Mixture:
    """A Parzen estimator on 0..1: a normal density at each point, as wide as the larger gap to its
    neighbours, and a flat one for what hasn't been seen."""

    def __init__(self, points: list[float]):
        self.at = np.sort(np.array(points, float))
        gaps = np.diff(np.concatenate([[0.0], self.at, [1.0]]))
        self.width = np.clip(np.maximum(gaps[:-1], gaps[1:]), 1 / min(100, 1 + len(points)), 1.0)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = np.empty(n)
        for k in range(n):
            i = rng.integers(len(self.at) + 1)
            u = rng.random() if i == len(self.at) else rng.normal(self.at[i], self.width[i])
            while not 0 <= u <= 1:  # the normal density is cut off at the bounds
                u = rng.normal(self.at[i], self.width[i])
            out[k] = u
        return out

    def log_density(self, u: np.ndarray) -> np.ndarray:
        inside = np.array([0.5 * (math.erf((1 - a) / (s * math.sqrt(2))) + math.erf(a / (s * math.sqrt(2)))) for a, s in zip(self.at, self.width)])
        each = np.exp(-0.5 * ((u[:, None] - self.at) / self.width) ** 2) / (self.width * math.sqrt(2 * math.pi)) / inside
        return np.log((each.sum(axis=1) + 1.0) / (len(self.at) + 1))


@dataclass
class Study:
    """Trials so far, as ``(setting, loss)``; a loss that is no number counts as infinite."""

    space: dict[str, Real | Choice]
    seed: int = 42
    startup: int = STARTUP
    trials: list[tuple[dict, float]] = field(default_factory=list)

    def ask(self) -> dict:
        """The next setting; the same study gives the same one again."""
        rng = np.random.default_rng([self.seed, len(self.trials)])
        if len(self.trials) < self.startup:
            return {name: p.random(rng) for name, p in self.space.items()}
        ranked = sorted(range(len(self.trials)), key=lambda k: (self.trials[k][1], k))
        n = min(max(1, math.ceil(0.1 * len(ranked))), MOST_GOOD)
        out = {}
        for name, p in self.space.items():
            good, bad = ([self.trials[k][0][name] for k in part] for part in (ranked[:n], ranked[n:]))
            out[name] = max(p.proposals(good, bad, rng), key=lambda x: x[1])[0]
        return out

    def tell(self, setting: dict, loss: float) -> None:
        self.trials.append((setting, math.inf if math.isnan(loss) else loss))

    def best(self) -> tuple[dict, float]:
        return min(self.trials, key=lambda t: t[1])

    def run(self, loss: Callable[[dict], float], trials: int) -> Study:
        for _ in range(trials):
            setting = self.ask()
            self.tell(setting, loss(setting))
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        """``trial, setting, loss``."""
        return spark.createDataFrame([(k, {n: str(v) for n, v in s.items()}, x) for k, (s, x) in enumerate(self.trials)], "trial int, setting map<string,string>, loss double")


def fold_loss(df: DataFrame, make: Callable[[dict], object], folds: int) -> Callable[[dict], float]:
    """The mean over folds (``fold`` 0, 1, ...) of the squared error of ``make(setting)``, fitted to the other folds."""
    judge = RegressionEvaluator(metricName="mse")

    def loss(setting: dict) -> float:
        return float(np.mean([judge.evaluate(make(setting).fit(df.filter(F.col("fold") != k)).transform(df.filter(F.col("fold") == k))) for k in range(folds)]))

    return loss
