"""Search, early stopping, kernel regression and saved models."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from scriptorium.operators import kernels as K
from scriptorium.operators import learning as L
from scriptorium.operators import searching as H
from scriptorium.plans import learning as P

SPACE = {"a": H.Real(1e-4, 1e4, log=True), "b": H.Real(0.0, 1.0), "n": H.Real(2, 40, whole=True), "c": H.Choice(("x", "y", "z"))}


def rmse(predictions):
    return RegressionEvaluator(metricName="rmse").evaluate(predictions)


def surface(s):
    return (np.log10(s["a"]) - 1.5) ** 2 / 4 + 4 * (s["b"] - 0.3) ** 2 + ((s["n"] - 17) / 20) ** 2 + {"x": 0.5, "y": 0.0, "z": 0.8}[s["c"]]


def test_search_beats_random_draws():
    """Over 20 seeds, the best of 60 trials, on average and more often than not."""
    ours = np.array([H.Study(SPACE, seed).run(surface, 60).best()[1] for seed in range(20)])
    chance = np.array([H.Study(SPACE, 1000 + seed, startup=60).run(surface, 60).best()[1] for seed in range(20)])
    assert ours.mean() < 0.6 * chance.mean() and (ours < chance).sum() >= 14


def test_studies_repeat_and_keep_to_their_space():
    a, b = (H.Study(SPACE, 5).run(surface, 25) for _ in range(2))
    assert a.trials == b.trials and a.ask() == b.ask()
    for s, _ in a.trials:
        assert 1e-4 <= s["a"] <= 1e4 and 0 <= s["b"] <= 1 and s["c"] in "xyz" and s["n"] == int(s["n"]) and 2 <= s["n"] <= 40
    broken = H.Study(SPACE, 5).run(lambda s: float("nan") if s["c"] == "x" else surface(s), 25)
    assert broken.best()[0]["c"] != "x"
    fixed = H.Study({"k": H.Real(3.0, 3.0), "v": H.Choice((1,))}, startup=1).run(lambda s: 1.0, 5)
    assert all(s == {"k": 3.0, "v": 1} for s, _ in fixed.trials)


def test_densities_are_densities():
    m = H.Mixture([0.1, 0.1, 0.4, 0.95])
    grid = (np.arange(20_000) + 0.5) / 20_000
    assert np.exp(m.log_density(grid)).mean() == pytest.approx(1, abs=1e-3)
    drawn = m.draw(np.random.default_rng(1), 4000)
    assert ((0 <= drawn) & (drawn <= 1)).all()
    assert (drawn < 0.25).mean() == pytest.approx(np.exp(m.log_density(grid[grid < 0.25])).mean() * 0.25, abs=0.03)


@pytest.fixture(scope="module")
def curved(spark):
    d = P.curved(spark, "/root/testdata/sf0.01").persist()
    yield d
    d.unpersist()


def test_kernel_beats_ridge_on_a_curved_label(curved):
    train, test = curved.filter("fold <> 0"), curved.filter("fold = 0")
    kernel = K.fit(train, "vec_id", c=1e4, landmarks=150)
    ridge = L.ridge(1e-4).fit(train)
    assert rmse(kernel.transform(test)) < 0.6 * rmse(ridge.transform(test))


def test_kernel_fit_is_the_least_squares_solution(spark):
    """With every row as a landmark, the predictions are those of a dense solve."""
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(60, 3)), rng.integers(1, 5, 60).astype(float)
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2
    rows = [(k, x[k].tolist(), float(y[k]), float(w[k])) for k in range(60)] + [(100, None, 1.0, 1.0), (101, [0.0, 0.0, 0.0], None, 1.0)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double, weight double")
    got = {r["id"]: r["prediction"] for r in K.fit(df, "id", c=10.0, landmarks=500, gamma=0.7).transform(df).collect()}
    s = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
    kernel = np.exp(-0.7 * ((s[:, None] - s[None]) ** 2).sum(axis=2))
    values, turns = np.linalg.eigh(kernel)
    phi = np.c_[kernel @ (turns / np.sqrt(np.maximum(values, 1e-12))) @ turns.T, np.ones(60)]
    penalty = np.eye(61) / 10.0
    penalty[-1, -1] = 0
    beta = np.linalg.solve(phi.T @ (w[:, None] * phi) / w.sum() + penalty, phi.T @ (w * y) / w.sum())
    assert np.allclose([got[k] for k in range(60)], phi @ beta, atol=1e-6) and got[100] is None and got[101] is not None
    with pytest.raises(ValueError):
        K.fit(df.filter("id = 100"), "id")


def test_boosting_stops_where_the_loss_is_least(curved):
    train, check = curved.filter("fold > 1"), curved.filter("fold = 1")
    model, curve = L.stopped_early(train, check, rounds=12, depth=4, rate=1.0)
    losses = [r["loss"] for r in curve.orderBy("round").collect()]
    best = losses.index(min(losses)) + 1
    assert len(model.trees) == best < 12  # so large a step overfits soon
    assert rmse(model.transform(check)) ** 2 == pytest.approx(min(losses), rel=1e-6)


def test_the_second_stage_learns_what_the_first_leaves(curved):
    shifted = lambda df: df.withColumn("label", F.col("label") + 3)
    large, small, check = curved.filter("fold > 1"), shifted(curved.filter("fold = 0")), shifted(curved.filter("fold = 1"))
    both = L.two_stages(large, small, check, rounds=6, depth=2, rate=0.5)
    alone, _ = L.stopped_early(large, check, rounds=6, depth=2, rate=0.5)
    assert rmse(both.transform(check)) < 0.5 * rmse(alone.transform(check))


def test_saved_models_predict_the_same(curved, tmp_path):
    for k, model in enumerate((L.ridge().fit(curved), L.forest(5, 3).fit(curved), L.boosted(3, 2).fit(curved))):
        again = L.saved(model, f"file://{tmp_path}/{k}")
        a, b = ({r["vec_id"]: r["prediction"] for r in m.transform(curved).collect()} for m in (model, again))
        assert a == b
