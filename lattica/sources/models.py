"""Saved networks: metadata as JSON text and parameters as a Parquet table, through Spark's own writers.

So a network can lie in any store that Spark reads. Kept rows are saved on request.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.operators.staging import Layout
from lattica.plans import kernel as N
from lattica.plans.network import Network, PredictConfig
from lattica.plans.recipe import Recipe

FORMAT, VERSION = "lattica-network", 1


def _arrays(p: N.Params) -> dict[str, np.ndarray]:
    out = {"C": p.C, "W": p.W, "out": p.out}
    out |= {f"P{j}": q for j, q in enumerate(p.P)} | {f"theta{n}": t for n, t in enumerate(p.thetas)}
    return out | ({"W_M": p.W_M} if p.W_M is not None else {}) | ({"U": p.U} if p.U is not None else {})


def save(spark: SparkSession, network: Network, path: str, rows: bool = False) -> None:
    p = network.params
    meta = {
        "format": FORMAT, "version": VERSION, "recipe": network.recipe.to_json(), "losses": network.losses, "converged": network.converged, "config": vars(network.config), "rows": network.rows, "classes": network.classes,
        "log_partition": network.log_partition, "least": network.least, "layout": {"continuous": network.layout.continuous, "categorical": network.layout.categorical, "dropped": network.layout.dropped},
        "scalars": {"scales": p.scales, "alpha": p.alpha, "epsilons": p.epsilons, "deltas": p.deltas, "epsilon_T": p.epsilon_T, "shift": p.shift, "mass": p.mass, "regression": p.regression}, "has_rows": rows,
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    table = [(k, list(v.shape), v.astype(float).ravel().tolist()) for k, v in _arrays(p).items()]
    spark.createDataFrame(table, "name string, shape array<int>, cells array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")
    if rows:
        if network.state is None:
            raise ValueError("the network keeps no rows")
        network.state.write.mode("overwrite").parquet(f"{path}/rows")


def load(spark: SparkSession, path: str) -> Network:
    meta = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/metadata").collect()))
    if meta.get("format") != FORMAT or meta.get("version") != VERSION:
        raise ValueError(f"{path} holds no network of version {VERSION}")
    have = {r["name"]: np.array(r["cells"], float).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/parameters").select("name", "shape", "cells").collect()}
    for k, v in have.items():
        if not np.isfinite(v).all():
            raise ValueError(f"{k} is not finite")
    s, n = meta["scalars"], len(meta["scalars"]["epsilons"]) - 1
    p = N.Params(have.pop("C"), have.pop("W"), [have.pop(f"P{j}") for j in range(len(s["scales"]))], s["scales"], [have.pop(f"theta{i}") for i in range(n)], have.pop("out"), have.pop("W_M", None), have.pop("U", None), s["alpha"], s["epsilons"], s["deltas"], s["epsilon_T"], s["shift"], s["mass"], s["regression"])
    if have:
        raise ValueError(f"unknown parameters: {', '.join(have)}")
    for q in p.P:
        if np.abs(q.sum(1) - 1).max(initial=0) > 1e-9:
            raise ValueError("categorical centres are no shares")
    if math.isnan(p.epsilon_T):
        raise ValueError("a temperature is no number")
    frozen = lambda v: tuple(frozen(x) if isinstance(x, list) else x for x in v)
    layout = Layout(frozen(meta["layout"]["continuous"]), frozen(meta["layout"]["categorical"]), tuple(meta["layout"]["dropped"]))
    out = Network(Recipe.from_json(meta["recipe"]), layout, p, meta["losses"], meta["converged"], PredictConfig(**meta["config"]), meta["rows"], meta["classes"], meta["log_partition"], meta["least"])
    if meta["has_rows"]:
        out.state = spark.read.parquet(f"{path}/rows").withColumn("u", F.col("u"))
    return out
