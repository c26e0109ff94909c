"""Networks that stop and go on, starts taken from others, and starts of iterative predictions."""

from __future__ import annotations

import copy
import pickle
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import seeding
from lattica.plans import network as NW
from lattica.plans import reporting
from lattica.plans.recipe import ClassificationHead, Hidden, Input, Recipe, RegressionHead

KEYS = {"continuous": ["a", "b"], "categorical": ["c"], "row_id": "id"}


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    at = r.integers(0, 3, 240)
    made = [(i, float(k + 0.2 * u), float(k % 2 + 0.2 * v), "xyz"[(k + i % 5 // 4) % 3], int(k > 0), float(2 * k + 0.1 * u)) for i, (k, u, v) in enumerate(zip(at, r.standard_normal(240), r.standard_normal(240), strict=True))]
    return spark.createDataFrame(made, "id long, a double, b double, c string, y int, z double").repartition(3).persist()


def _quiet(f, *a, **k):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return f(*a, **k)


CHAINS = {
    "flat": (Recipe.chain(Input(K=4, epsilon=0.02), ClassificationHead(), delta=0.3), "y"),
    "hidden": (Recipe.chain(Input(K=4, epsilon=0.02), Hidden(K=3, epsilon=0.05), ClassificationHead(), delta=0.3), "y"),
    "weights": (Recipe.chain(Input(K=4, epsilon=0.02, epsilon_T=0.5), ClassificationHead(), delta=0.3), "y"),
    "values": (Recipe.chain(Input(K=4, epsilon=0.02), RegressionHead(), delta=0.5), "z"),
}


@pytest.mark.parametrize("name", sorted(CHAINS))
def test_stopping_changes_nothing(rows, name):
    recipe, target = CHAINS[name]
    whole = _quiet(NW.fit, rows, recipe, target, **KEYS, max_iter=4, tol=0.0)
    part = _quiet(NW.fit, rows, recipe, target, **KEYS, max_iter=2, tol=0.0, keep_rows=True)
    assert part.can_resume
    before = copy.deepcopy(part.params)
    on = _quiet(NW.go_on, part, max_iter=4, tol=0.0)
    assert np.allclose(on.losses, whole.losses, rtol=1e-9, atol=1e-12)
    assert np.allclose(on.params.C, whole.params.C, atol=1e-9)
    assert np.array_equal(part.params.C, before.C) and len(part.losses) == 3


def test_initialise_then_go_on_is_a_fit(rows):
    recipe, target = CHAINS["hidden"]
    start = NW.initialise(rows, recipe, target, **KEYS)
    assert start.losses == [] and not start.converged and start.can_resume
    assert "no step taken" in reporting.describe(start)
    assert np.allclose(_quiet(NW.go_on, start, max_iter=3, tol=0.0).losses, _quiet(NW.fit, rows, recipe, target, **KEYS, max_iter=3, tol=0.0).losses)


def test_hard_instance_weights_are_refused(rows):
    recipe = Recipe.chain(Input(K=2, epsilon=0.02, epsilon_T=0.0), ClassificationHead(), delta=0.3)
    with pytest.raises(ValueError, match="hard instance weights"):
        NW.fit(rows, recipe, "y", **KEYS)


def test_what_cannot_go_on(rows):
    recipe, target = CHAINS["flat"]
    made = NW.fit(rows, recipe, target, **KEYS, tol=1e-3, keep_rows=True)
    assert made.converged and not made.can_resume and NW.go_on(made) is made
    bare = _quiet(NW.fit, rows, recipe, target, **KEYS, max_iter=1, tol=0.0)
    with pytest.raises(ValueError, match="kept no rows"):
        NW.go_on(bare)
    kept = _quiet(NW.fit, rows, recipe, target, **KEYS, max_iter=1, tol=0.0, keep_rows=True)
    assert not pickle.loads(pickle.dumps(kept)).can_resume


def test_groups_that_fit_are_taken_over(rows):
    recipe, target = CHAINS["hidden"]
    old = _quiet(NW.fit, rows, recipe, target, **KEYS, max_iter=3, tol=0.0)
    state = old.initial_state
    state.C[0, 0] += 1
    assert state.C[0, 0] != old.params.C[0, 0]
    again = NW.initialise(rows, recipe, target, **KEYS, initial_state=old.initial_state)
    assert np.array_equal(again.params.C, old.params.C) and np.array_equal(again.params.thetas[0], old.params.thetas[0])
    with pytest.warns(UserWarning, match="the transitions of the initial state"):
        fewer = NW.initialise(rows, recipe.replace_block("input", K=3), target, **KEYS, initial_state=old.initial_state)
    assert np.array_equal(fewer.params.C, old.params.C[:3])


def test_a_hidden_block_needs_rows(rows):
    recipe = Recipe.chain(Input(K=2, epsilon=0.02), Hidden(K=300, epsilon=0.05), ClassificationHead(), delta=0.3)
    with pytest.raises(ValueError, match="needs 300 rows"):
        NW.initialise(rows, recipe, "y", **KEYS)


def test_starts_of_iterative_predictions(rows):
    recipe, target = CHAINS["flat"]
    made = NW.fit(rows, recipe, target, **KEYS)
    given = rows.withColumn("q", F.array(F.lit(0.25), F.lit(0.75)))
    labels = {}
    for start in (None, "arithmetic", "uniform", 7, "column:q"):
        out = made.predict(given, config=NW.PredictConfig(mode="iterative", start=start))
        labels[start] = {r["id"]: r["label"] for r in out.select("id", "label").collect()}
        assert len(labels[start]) == 240
    assert labels["arithmetic"] == labels[None] and labels[7] == {r["id"]: r["label"] for r in made.predict(given.repartition(7), config=NW.PredictConfig(mode="iterative", start=7)).collect()}
    first = made.predict(given, config=NW.PredictConfig(mode="iterative", start="column:q", max_iter=0)).first()
    assert first["prediction"] == [0.25, 0.75]
    for bad in ("mean", "column:w"):
        with pytest.raises(Exception, match="no start|cannot be resolved|UNRESOLVED"):
            made.predict(given, config=NW.PredictConfig(mode="iterative", start=bad)).count()
    with pytest.raises(Exception, match="no start of the right size"):
        made.predict(rows.withColumn("q", F.array(F.lit(0.5), F.lit(0.75))), config=NW.PredictConfig(mode="iterative", start="column:q")).count()
    with pytest.raises(ValueError, match="iterative"):
        NW.PredictConfig(start="uniform")
    values, target = CHAINS["values"]
    reg = NW.fit(rows, values, target, **KEYS)
    mean = reg.predict(rows, config=NW.PredictConfig(mode="iterative", start="mean", max_iter=0)).first()
    assert np.allclose(mean["prediction"], reg.params.out.mean(1))
    low, high = reg.params.out.min(), reg.params.out.max()
    assert all(low <= r["prediction"][0] <= high for r in reg.predict(rows, config=NW.PredictConfig(mode="iterative", start=5, max_iter=0)).collect())


def test_a_start_moves_the_clusters_before_the_prediction(rows):
    """Two steps from given shares equal the same steps by hand."""
    recipe, target = CHAINS["flat"]
    made = NW.fit(rows, recipe, target, **KEYS)
    p = made.params
    given = rows.withColumn("q", F.array(F.lit(0.9), F.lit(0.1)))
    out = made.predict(given, config=NW.PredictConfig(mode="iterative", start="column:q", max_iter=2, tol=0.0)).toPandas().set_index("id")
    x = made.affiliations(rows).select("id", "cost").toPandas().set_index("id")
    soft = lambda c, e: np.exp(-(c - c.min()) / e) / np.exp(-(c - c.min()) / e).sum()
    for i in range(0, 240, 16):
        g = soft(np.array(x.loc[i, "cost"]) - p.deltas[-1] * np.array([0.9, 0.1]) @ np.log(np.maximum(p.out, 1e-300)), p.epsilons[0])
        q = soft(-g @ np.log(np.maximum(p.out, 1e-300)).T, 1.0)
        assert np.allclose(out.loc[i, "prediction"], q, atol=1e-6)


def test_groupings():
    points = np.array([[0.0], [0.1], [5.0], [5.1]])
    labels, mass = np.array([[9.0, 1.0], [1.0, 9.0], [8.0, 2.0], [2.0, 8.0]]), np.full(4, 10.0)
    near = seeding.group_source(points, mass, 2, np.random.default_rng(0))
    assert near[0] == near[1] != near[2] == near[3]
    best = seeding.best_grouping(labels, mass, points, 2, (1e-3, 1.0), False, 0)
    assert best[0] == best[2] != best[1] == best[3]  # labels, not places
    every = [seeding.grouping_loss(np.array(g), labels, mass, False) for g in ([0, 0, 1, 1], [0, 1, 0, 1], [0, 1, 1, 0])]
    assert seeding.grouping_loss(best, labels, mass, False) == min(every)
    copies = seeding.group_source(np.zeros((3, 1)), np.ones(3), 3, np.random.default_rng(1))
    assert sorted(copies) == [0, 1, 2]
