"""Fits against a NumPy form of the objective, and what must hold of them."""

from __future__ import annotations

import math
import pickle
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import seeding, staging
from lattica.operators import statistics as T
from lattica.operators.guess import allocate_seeds, feature_weights
from lattica.plans import network as NW
from lattica.plans import reporting
from lattica.plans.estimators import Classifier, Regressor
from lattica.plans.recipe import ClassificationHead, Hidden, Input, ManifoldInput, Recipe, RegressionHead
from lattica.plans.selection import accuracy_loss, plan_seeds, select, winner
from lattica.sources import models
from lattica.streaming.scoring import score_stream

X = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(0), []
    for k, centre in enumerate(([0.2, 0.2, 0.5], [0.8, 0.3, 0.5], [0.5, 0.8, 0.5])):
        for _ in range(24):
            x = np.clip(rng.normal(centre, 0.07), 0, 1)
            out.append((len(out), *map(float, x), "ab"[k % 2], k if len(out) % 6 else None, float(x[0] ** 2), float(x[1] ** 2)))
    return out


@pytest.fixture(scope="module")
def blobs(spark, rows):
    return spark.createDataFrame(rows, "id long, f0 double, f1 double, f2 double, cat string, y int, t0 double, t1 double").repartition(3, "id").persist()


def fitted(df, recipe, target="y", cat=(), **options):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        warnings.simplefilter("error", NW.LossIncreaseWarning)
        return NW.fit(df, recipe, target, X, cat, row_id="id", **{"max_iter": 4} | options)


def test_two_steps_match_numpy(blobs, rows):
    eps, delta = 0.02, 0.4
    C0 = np.array([[0.3, 0.3, 0.5], [0.7, 0.3, 0.5], [0.5, 0.7, 0.5], [0.4, 0.6, 0.4]])
    made = fitted(blobs, Recipe.chain(Input(K=4, epsilon=eps), ClassificationHead(), delta=delta), centres=C0, max_iter=2, tol=0.0)
    x = np.array([r[1:4] for r in rows])
    low, high = x.min(0), x.max(0)
    x = (x - low) / (high - low)
    y = [r[5] for r in rows]
    T, f = len(x), sum(v is not None for v in y) / len(x)
    Q = np.zeros((T, 3))
    for t, v in enumerate(y):
        if v is not None:
            Q[t, v] = f / sum(v is not None for v in y)
    soft = lambda c: np.exp(-(c - c.min(1, keepdims=True)) / (eps / T)) / np.exp(-(c - c.min(1, keepdims=True)) / (eps / T)).sum(1, keepdims=True)
    C = C0.copy()
    dist = lambda: ((x[:, None] - C[None]) ** 2).mean(2)
    G, losses = soft(dist() / T), []
    for k in range(2):
        theta = (Q.T @ G) / (Q.T @ G).sum(0)
        value = lambda: (G * dist()).sum() / T - delta * (Q.T @ G * np.log(np.maximum(theta, 1e-300))).sum() + eps * (G * np.log(np.where(G > 0, G, 1))).sum() / T  # noqa: B023, E731
        if not k:
            losses.append(value())
        G = soft(dist() / T - delta * Q @ np.log(np.maximum(theta, 2.2250738585072014e-308)))
        C = (G.T @ x) / G.sum(0)[:, None]
        losses.append(value())
    assert np.allclose(made.params.C, C, atol=1e-9)
    assert np.allclose(made.losses, losses, atol=1e-9)


@pytest.mark.parametrize(
    ("recipe", "target", "cat"),
    [
        (Recipe.chain(Input(K=5, epsilon=0.01, epsilon_D=0.05, epsilon_T=0.5), ClassificationHead(), delta=0.3), "y", ["cat"]),
        (Recipe.chain(Input(K=6, epsilon=0.01), Hidden(K=3, epsilon=0.05), ClassificationHead(), delta=0.3), "y", ["cat"]),
        (Recipe.chain(Input(K=4, epsilon=0.01), Hidden(K=3, epsilon=0.05), ClassificationHead(coupling="S"), delta=0.3, coupling="S", theta_alpha=1.1), "y", []),
        (Recipe.chain(Input(K=6, epsilon=0.01), RegressionHead(epsilon_M=0.1), delta=2.0), ["t0", "t1"], []),
        (Recipe.chain(ManifoldInput(K=3, subspace_dimension=1, epsilon=0.01), ClassificationHead(), delta=0.3), "y", []),
        (Recipe.chain(Input(K=4), ClassificationHead(), delta=0.1), "y", []),
    ],
)
def test_losses_fall(blobs, recipe, target, cat):
    made = fitted(blobs, recipe, target, cat)
    assert all(b <= a + 1e-12 for a, b in zip(made.losses, made.losses[1:], strict=False))
    if target == "y":
        labelled = made.predict(blobs).where("y is not null")
        assert labelled.agg(F.avg((F.col("label") == F.col("y")).cast("double"))).first()[0] > 0.9
    if made.params.U is not None:
        for u in made.params.U:
            assert np.allclose(u.T @ u, np.eye(u.shape[1]))


def test_prediction_is_row_local_and_streams(spark, blobs, tmp_path):
    made = fitted(blobs, Recipe.chain(Input(K=4, epsilon=0.02, epsilon_T=0.5), ClassificationHead(), delta=0.3), max_iter=2)
    every = {r["id"]: r["label"] for r in made.predict(blobs).collect()}
    some = {r["id"]: r["label"] for r in made.predict(blobs.where("id % 7 = 0")).collect()}
    assert some == {k: every[k] for k in some}
    blobs.drop("y").write.parquet(str(tmp_path / "in"))
    stream = score_stream(spark.readStream.schema(blobs.drop("y").schema).parquet(str(tmp_path / "in")), made)
    run = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r["id"]: r["label"] for r in spark.table("scored").collect()} == every
    with pytest.raises(ValueError):
        score_stream(blobs, made)
    shares = [r["share"] for r in made.score_samples(blobs, blobs, "id").collect()]
    assert 0 < min(shares) <= max(shares) == 1.0
    again = made.predict(blobs, config=NW.PredictConfig(mode="iterative", max_iter=3))
    assert again.where("y is not null").agg(F.avg((F.col("label") == F.col("y")).cast("double"))).first()[0] > 0.9


def test_learned_instance_weights_ride_in_blocks(blobs, monkeypatch):
    """No row of such a fit is unpacked by itself, and the result is that of kept rows, past a checkpoint; scores read predictions once."""
    recipe = Recipe.chain(Input(K=4, epsilon=0.02, epsilon_T=0.5), ClassificationHead(), delta=0.3)
    kept = fitted(blobs, recipe, cat=["cat"], max_iter=9, tol=0.0, keep_rows=True)

    def never(*args):
        raise AssertionError("rows one by one")

    monkeypatch.setattr(NW, "_rows", never)
    made = fitted(blobs, recipe, cat=["cat"], max_iter=9, tol=0.0)
    assert made.losses == pytest.approx(kept.losses, rel=1e-12)
    assert made.params.C == pytest.approx(kept.params.C, rel=1e-9)
    assert made.log_partition == pytest.approx(kept.log_partition, rel=1e-9)
    weight = {r["id"]: r["instance_weight"] for r in made.predict(blobs, ["instance_weights"]).collect()}
    calls, predict = [], NW.Network.predict
    monkeypatch.setattr(NW.Network, "predict", lambda self, *a, **b: calls.append(1) or predict(self, *a, **b))
    share = {r["id"]: r["share"] for r in made.score_samples(blobs, blobs, "id").collect()}
    assert share == {i: pytest.approx(sum(x <= w for x in weight.values()) / len(weight)) for i, w in weight.items()}
    assert len(calls) == 1


def test_save_load_resume_report(spark, blobs, tmp_path):
    recipe = Recipe.chain(Input(K=4, epsilon=0.02, epsilon_D=0.05), ClassificationHead(), delta=0.3)
    made = fitted(blobs, recipe, cat=["cat"], max_iter=2, tol=0.0)
    models.save(spark, made, str(tmp_path / "net"))
    back = models.load(spark, str(tmp_path / "net"))
    same = lambda n: sorted((r["id"], r["label"]) for r in n.predict(blobs).collect())
    assert same(back) == same(made) and back.recipe == made.recipe and back.layout == made.layout
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        on = NW.resume(back, blobs, "y", row_id="id", max_iter=2, tol=0.0)
        straight = fitted(blobs, recipe, cat=["cat"], max_iter=4, tol=0.0)
    assert len(on.losses) == 5 and on.losses[-1] <= made.losses[-1]
    assert math.isclose(straight.losses[2], made.losses[2], abs_tol=1e-12)
    with pytest.raises(ValueError):
        NW.resume(back, blobs, "y", row_id="id", recipe=recipe.replace_block("input", K=5))
    assert reporting.count_parameters(made, raw=True) == 4 * 3 + 4 * 2 + 4 + 3 * 4
    assert set(reporting.effective_dimensions(made, blobs)) == {"gamma0", "features"}
    assert reporting.centroid_frame(spark, made).count() == 12
    assert reporting.decision_frame(made, blobs, "f0", "f1", 3).count() == 9
    assert made.calibrated(blobs, "y").config.epsilon_P is not None


def test_estimators_and_selection(blobs):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        clf = Classifier(Recipe.chain(Input(K=4, epsilon=0.01, balanced=True), ClassificationHead(), delta=0.3), target="y", row_id="id", continuous=X, max_iter=2)
        clf.set_params(recipe__blocks__input__K=3, max_iter=3).fit(blobs.where("y is not null"))
        assert clf.classes_ == [0, 1, 2] and clf.score(blobs.where("y is not null")) > 0.9
        assert clf.get_params()["recipe__blocks__input__K"] == 3
        half = blobs.withColumn("t0", F.when(F.col("id") > 0, F.col("t0")))
        with pytest.raises(ValueError):
            Regressor(target=["t0", "t1"], row_id="id", continuous=X).fit(half)
        folds = blobs.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("fold")).withColumn("part", F.when(F.col("id") % 2 == F.col("fold"), "validation").otherwise("train"))
        made = select(blobs, Recipe.chain(Input(K=3, epsilon=0.01), ClassificationHead(), delta=0.3), "y", row_id="id", inits=2, loss=accuracy_loss, folds=folds, continuous=X, max_iter=2)
    assert made.losses
    assert plan_seeds(5, 1) == [5] and len(set(plan_seeds(5, 4))) == 4
    assert winner([math.nan, 2.0, 1.0, 1.0]) == 2


def test_driver_decisions(blobs):
    assert allocate_seeds({0: (2, 5.0), 1: (9, 3.0), 2: (9, 4.0)}, 8) == {0: 2, 1: 3, 2: 3}
    with pytest.raises(ValueError):
        allocate_seeds({0: (2, 1.0), 1: (2, 1.0)}, 1)
    weights = feature_weights(blobs, X, ["cat"], "y", True)
    assert math.isclose(sum(weights.values()), 1) and weights["f2"] < weights["f0"]


def test_validation(spark, blobs):
    bad = blobs.withColumn("f0", F.when(F.col("id") == 3, F.lit(float("nan"))).otherwise(F.col("f0")))
    with pytest.raises(ValueError):
        fitted(bad, Recipe.chain(Input(), ClassificationHead()), layout=NW.staging.Layout(tuple((c, 0.0, 1.0) for c in X), ()))
    with pytest.raises(ValueError):
        fitted(blobs.limit(0), Recipe.chain(Input(), ClassificationHead()), layout=NW.staging.Layout(tuple((c, 0.0, 1.0) for c in X), ()))


def test_offsets_cost_no_digits(spark):
    df = spark.createDataFrame([(1e9 + k % 7, 1e9 + k % 7 + 0.05 * (k % 2), "ab"[k % 7 > 3]) for k in range(700)], "t double, g double, c string")
    near = spark.createDataFrame([(float(k % 7), k % 7 + 0.05 * (k % 2), "ab"[k % 7 > 3]) for k in range(700)], "t double, g double, c string")
    for made in (lambda d: T.r2(d, "t", "g"), lambda d: T.correlation_ratio(d, "t", "c")):
        assert made(df).first()["value"] == pytest.approx(made(near).first()["value"], abs=1e-6)


def test_a_constant_feature_and_bad_rows(spark):
    rows = [(k, float(k % 5), 3.0, "ab"[k % 2], k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c string, y int")
    told = []
    made = NW.fit(df, Recipe.chain(Input(K=2), ClassificationHead()), "y", ["a", "b"], ["c"], row_id="row_id", max_iter=3, tol=0.0, init_rows=[3, 4], logger=lambda k, loss: told.append((k, loss)))
    assert [k for k, _ in told] == list(range(len(made.losses))) and [x for _, x in told] == made.losses
    for bad in ((1, None, 3.0, "a", 0), (1, float("nan"), 3.0, "a", 0), (1, 1.0, 3.0, "z", 0)):
        with pytest.raises(Exception, match="a row has"):
            made.predict(spark.createDataFrame([bad], df.schema)).collect()
    again = pickle.loads(pickle.dumps(made))
    assert again.predict(df).orderBy("row_id").collect() == made.predict(df).orderBy("row_id").collect()
    with pytest.raises(ValueError):
        NW.fit(df, Recipe.chain(Input(K=2), ClassificationHead()), "y", ["a", "b"], row_id="row_id", init_rows=[3, 99])


def test_long_vocabularies_are_joined(spark):
    names = [f"n{k:03d}" for k in range(staging.SEARCHED + 40)]
    df = spark.createDataFrame([(k, n) for k, n in enumerate([*names, "other"])], "row_id long, c string")
    out = staging.replay_layout(df, staging.Layout((), (("c", tuple(names)),)))
    assert out.columns == ["row_id", "c", "x", "codes"]
    assert {r.row_id: r.codes[0] for r in out.collect()} == {**dict(enumerate(range(len(names)))), len(names): -1}


def test_a_scan_keeps_its_width(spark, monkeypatch):
    """Sums merge behind a shuffle: as many tasks read rows as there are partitions."""
    monkeypatch.setattr(NW, "MERGERS", 3)
    df = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 9).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    widths = []
    for n in (2, 40):
        made = NW.fit(df.repartition(n), Recipe.chain(Input(K=2, epsilon=0.05), ClassificationHead()), "y", ["a"], row_id="row_id", max_iter=2, tol=0.0, centres=[[0.1], [0.9]])
        widths.append(made.losses)
    assert widths[0] == pytest.approx(widths[1])


def test_supplied_projectors(spark):
    df = spark.createDataFrame([(k, k / 30, (k * 7 % 30) / 30, k % 2) for k in range(30)], "row_id long, a double, b double, y int")
    recipe = Recipe.chain(ManifoldInput(K=2, subspace_dimension=1), ClassificationHead())
    U = np.array([[[2.0], [0.0]], [[0.0], [3.0]]])
    made = NW.fit(df, recipe, "y", ["a", "b"], row_id="row_id", max_iter=0, centres=[[0.2, 0.5], [0.8, 0.5]], projectors=U)
    assert np.abs(made.params.U) == pytest.approx(np.abs(U) / [[[2.0]], [[3.0]]])
    with pytest.raises(ValueError):
        NW.fit(df, recipe, "y", ["a", "b"], row_id="row_id", max_iter=0, centres=[[0.2, 0.5], [0.8, 0.5]], projectors=U * 0)


def test_batches_are_read_as_matrices():
    """Columns of lists become matrices and back, in slices of batches too and without features of a kind."""
    import pyarrow as pa

    x = np.arange(24.0).reshape(8, 3)
    column = NW.lists(x)
    assert column.to_pylist() == x.tolist()
    assert (NW.matrix(column.slice(2, 4)) == x[2:6]).all()
    none = pa.array([[]] * 8, pa.list_(pa.int32()))
    assert NW.matrix(none, np.int64).shape == (8, 0) and NW.matrix(column.slice(0, 0)).size == 0
    b = pa.RecordBatch.from_pydict({"x": column, "codes": none, "q": NW.lists(x[:, :2]), "omega": [0.0] * 8, "w": [0.5] * 8, "u": [0.25] * 8, "s": NW.lists(x)})
    rows = NW._rows(b.slice(1, 5), None, True, [2, 1], [np.array([True, False]), np.array([True])])
    assert (rows.x == x[1:6]).all() and rows.codes.shape == (5, 0) and (rows.q == x[1:6, :2]).all()
    assert (rows.gammas[0] == x[1:6, :1]).all() and (rows.gammas[1] == x[1:6, 2:]).all() and (rows.u == 0.25).all() and (rows.w == 0.5).all()


def test_rows_in_blocks_are_drawn_and_summed_as_rows_are(spark, blobs):
    staged = spark.range(40).select(F.col("id").alias("row_id"), F.array(F.col("id") / 7, F.sqrt("id")).alias("x"), F.array((F.col("id") % 3).cast("int")).alias("codes"), F.array(F.col("id") / 2).alias("q"), F.lit(0.25).alias("omega"), F.lit(0.025).alias("w")).coalesce(2)
    blocks = NW.blocked(staged, 1 << 40)
    assert blocks.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and sum(r["n"] for r in blocks.collect()) == 40
    drawn = NW.measured(blocks, lambda r: list(zip(r.q[:, 0] * 2, r.x[:, 1], r.codes[:, 0], r.w, r.omega, seeding.uniforms(r.h, 5, 3), strict=True)))
    found = sorted(row for part in drawn for row in part)
    want = staged.select("row_id", F.col("x")[1], F.col("codes")[0], "w", "omega", seeding.uniform(F.col("row_id"), 1 << 40, 5, 3)).orderBy("row_id").collect()
    assert [tuple(r) for r in want] == found


def test_compiled_predictions_are_the_interpreted_ones(blobs):
    from lattica.functions import arrays as A

    made = fitted(blobs, Recipe.chain(Input(K=4, epsilon=0.02), Hidden(K=3, epsilon=0.05), ClassificationHead(), delta=0.4), cat=["cat"], max_iter=2)
    p, rows = made.params, made.affiliations(blobs)
    plain = A.plus(A.distances(F.col("x"), p.C.tolist(), p.W[:3].tolist()), A.cross_entropy(F.element_at("codes", 1), p.P[0].tolist(), p.scales[0] * float(p.W[3])))
    both = rows.select("cost", plain.alias("c"), "gamma0", A.assign(F.col("cost"), p.epsilons[0], len(p.C)).alias("g"), "gamma1", A.propagate(F.col("gamma0"), p.thetas[0].tolist(), p.deltas[0], p.epsilons[1]).alias("h")).collect()
    assert all(r["cost"] == r["c"] and r["gamma0"] == r["g"] and r["gamma1"] == r["h"] for r in both)
    assert "transform" not in made.predict(blobs)._jdf.queryExecution().optimizedPlan().toString().replace("zip_with", "transform")


@pytest.mark.parametrize("start", [None, "uniform"])
def test_iterative_predictions_keep_no_rows(spark, blobs, start):
    made = fitted(blobs, Recipe.chain(Input(K=4, epsilon=0.02), ClassificationHead(), delta=0.4), max_iter=3)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    config = NW.PredictConfig(mode="iterative", tol=0.0, max_iter=11, start=start)  # more rounds than the first pass takes
    out = made.predict(blobs, config=config)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    p = made.params
    found = out.select("id", "prediction", "f0", "f1", "f2").orderBy("id").collect()
    x = np.array([[r[f"f{i}"] for i in range(3)] for r in found])
    low, high = np.array([v[1:] for v in made.layout.continuous]).T
    d = (((x - low) / (high - low))[:, None] - p.C[None]) ** 2 @ p.W
    soft = lambda c, e: np.exp(-(c - c.min(1, keepdims=True)) / e) / np.exp(-(c - c.min(1, keepdims=True)) / e).sum(1, keepdims=True)
    logs = np.log(np.maximum(p.out, np.finfo(float).tiny))
    g = soft(d, 0.02)
    q = soft(-0.4 * g @ logs.T, 0.4) if start is None else np.full((len(x), 3), 1 / 3)
    for k in range(11):
        q = soft(-0.4 * g @ logs.T, 0.4) if k or start is None else q
        g = soft(d - 0.4 * q @ logs, 0.02)
    assert np.allclose([r["prediction"] for r in found], q, atol=1e-9)
