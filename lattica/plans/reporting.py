"""What a fitted network says about itself, as numbers and small frames (to be drawn by any tool)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import arrays as A
from lattica.plans.network import Network
from lattica.plans.recipe import Input


def active_features(network: Network, tol: float = 0.1) -> list[int]:
    """Features whose weight times their number is above tol."""
    w = network.params.W
    if np.ptp(w) == 0 or tol >= len(w):
        raise ValueError("uniform weights, or a tol that no feature can reach, single nothing out")
    return [int(i) for i in np.flatnonzero(w * len(w) > tol)]


def count_parameters(network: Network, affiliations: bool = False, raw: bool = False) -> int:
    """Entries, or degrees of freedom: a simplex of n has n - 1, a d-subspace of D has d (D - d)."""
    p, free = network.params, 0 if raw else 1
    d = p.C.shape[1]
    total = p.C.size + sum(q.shape[0] * (q.shape[1] - free) for q in p.P)
    if p.U is not None:
        k, _, r = p.U.shape
        total += p.U.size if raw else k * r * (d - r) - (k * r if p.alpha == 0 else 0)
    first, _, head, links = network.recipe.as_chain()
    if isinstance(first, Input) and math.isfinite(first.epsilon_D):
        total += len(p.W) - free
    for t, c in zip(p.thetas, links, strict=False):
        total += t.size - free * (t.shape[1] if (c.coupling or "M") == "M" else t.shape[0])
    total += p.out.size - (0 if p.regression else free * (p.out.shape[1] if head.coupling == "M" else p.out.shape[0]))
    if p.W_M is not None and math.isfinite(getattr(head, "epsilon_M", math.inf)):
        total += len(p.W_M) - free
    if affiliations:
        total += network.rows * sum(k - free for k in p.widths)
    return int(total)


def feature_importances(network: Network, df: DataFrame | None = None) -> np.ndarray:
    """Feature weights, or for a manifold input the leverage of features in the bases, by cluster mass."""
    p = network.params
    if p.U is None:
        return p.W
    mass = np.full(len(p.C), 1 / len(p.C))
    if df is not None:
        rows = network.affiliations(df)
        mass = np.array(rows.agg(*[F.avg(F.col("gamma0")[k]) for k in range(len(p.C))]).first(), float)
    leverage = mass @ (p.U**2).sum(2)
    return leverage / leverage.sum()


def target_weights(network: Network) -> np.ndarray:
    p = network.params
    return p.W_M if p.W_M is not None else np.full(len(p.out), 1 / len(p.out))


def effective_dimensions(network: Network, df: DataFrame, share: bool = False) -> dict[str, float]:
    """Mean effective dimension of each block's shares, and of the feature weights."""
    rows = network.affiliations(df)
    names = [f"gamma{n}" for n in range(len(network.params.thetas) + 1)]
    found = rows.agg(*[F.avg(A.effective_dimension(F.col(c), share)).alias(c) for c in names]).first()
    w = network.params.W[network.params.W > 0]
    size = float(np.exp(-(w * np.log(w)).sum())) if len(w) else 0.0
    return {**found.asDict(), "features": size / len(network.params.W) if share and len(w) else size}


def describe(network: Network) -> str:
    lines = [f"{type(b).__name__} {b.name}" for b in network.recipe.blocks]
    return "\n".join([*lines, f"clusters {network.params.widths}", f"loss {network.losses[-1]:.6g} after {len(network.losses) - 1} iterations, {'converged' if network.converged else 'not converged'}" if network.losses else "no step taken"])


def loss_frame(spark: SparkSession, network: Network) -> DataFrame:
    return spark.createDataFrame(list(enumerate(network.losses)), "iteration int, loss double")


def centroid_frame(spark: SparkSession, network: Network) -> DataFrame:
    """(cluster, feature, value) in the units of the columns."""
    cols = network.layout.continuous
    return spark.createDataFrame([(k, c, float(v * (b - a) + a)) for k, row in enumerate(network.params.C) for (c, a, b), v in zip(cols, row, strict=True)], "cluster int, feature string, value double")


def transition_frame(spark: SparkSession, network: Network) -> DataFrame:
    rows = [(n, t, s, float(v)) for n, m in enumerate([*network.params.thetas, network.params.out]) for t, row in enumerate(m) for s, v in enumerate(row)]
    return spark.createDataFrame(rows, "connection int, target int, source int, value double")


def affiliation_frame(network: Network, df: DataFrame, key: str) -> DataFrame:
    return network.affiliations(df).select(key, F.posexplode("gamma0").alias("cluster", "share"))


def decision_frame(network: Network, df: DataFrame, a: str, b: str, steps: int = 40) -> DataFrame:
    """Predictions on a grid of two features, the others at their median or commonest level."""
    bounds = {c: (lo, hi) for c, lo, hi in network.layout.continuous}
    middle = df.agg(*[F.percentile_approx(c, 0.5).alias(c) for c in bounds], *[F.mode(c).alias(c) for c, _ in network.layout.categorical])
    axis = lambda c: F.explode(F.array(*[F.lit(float(v)) for v in np.linspace(*bounds[c], steps)])).alias(c)
    grid = middle.drop(a, b).select("*", axis(a)).select("*", axis(b))
    return network.predict(grid)
