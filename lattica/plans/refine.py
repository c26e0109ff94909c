"""Iterative prediction: predictions and shares in turn until the batch settles."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import arrays as A
from lattica.operators import seeding, staging
from lattica.plans import kernel as N


#: Rounds of the passes that look for where predictions settle.
_PASSES = (8, 24, 56)


def _predicted(p: N.Params, gamma: np.ndarray, epsilon: float) -> np.ndarray:
    return gamma @ p.out.T if p.regression else N.assign(-p.deltas[-1] * gamma @ N.floored(p.out).T, epsilon)


def _objective(p: N.Params, rows: N.Rows, d: np.ndarray) -> np.ndarray:
    """What each row costs with its prediction as its target."""
    out = rows.u * (rows.gammas[0] * d).sum(1)
    for n, g in enumerate(rows.gammas):
        out = out - p.epsilons[n] * N.entropies(g) + (N.outgoing(p, rows, n) * g).sum(1)
    if p.regression:
        weights = p.W_M if p.W_M is not None else np.full(len(p.out), 1 / len(p.out))
        out = out + p.deltas[-1] * (rows.q**2 @ weights)
    return out



def _starts(network, given: DataFrame, config) -> Column:
    """The first predictions by config.start: given shares or random ones, else an empty array."""
    p, start = network.params, config.start
    n = len(p.out)
    none = F.array().cast("array<double>")
    if p.regression and start in ("arithmetic", "uniform") or not p.regression and start == "mean":
        raise ValueError(f"{start} is no start of this head")
    if start == "arithmetic" and network.recipe.as_chain()[2].coupling == "S":
        raise ValueError("an arithmetic start needs an M head")
    if isinstance(start, str) and start.startswith("column:"):
        value = F.col(f"`{start[7:]}`").cast("array<double>")
        fine = (F.size(value) == n) & F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        if not p.regression:
            fine = fine & staging.on_simplex(value)
        return F.when(fine, value).otherwise(F.raise_error(F.lit("a row has no start of the right size and sum")).cast("array<double>"))
    if isinstance(start, int):  # uniform on the simplex; for regression of clusters, which centroids turn into a value
        parts = len(p.out[0]) if p.regression else n
        row = F.hash("x", "codes")
        made = A.normalise(F.array(*[-F.ln(seeding.uniform(row, start, i)) for i in range(parts)]))
        return A.through(made, p.out.tolist()) if p.regression else made
    return none


def refined(network, df: DataFrame, config) -> DataFrame:
    """df with prediction (and label). Rows do not meet, but the stopping rule is on the mean of the batch, so this is for whole batches and no stream."""
    p, widths = network.params, network.params.widths
    epsilon = config.epsilon_P if config.epsilon_P is not None else p.deltas[-1]
    recover, rows_fitted, least, log_partition = np.isfinite(p.epsilon_T), network.rows, network.least, network.log_partition
    from lattica.plans.network import lists, matrix

    columns = df.columns
    given = staging.replay_layout(df, network.layout)
    given = given.withColumn("_start", _starts(network, given, config))
    how = config.start

    def started(start: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        if how in ("uniform", "mean"):
            return np.tile(p.out.mean(1) if p.regression else np.full(len(p.out), 1 / len(p.out)), (len(gamma), 1))
        if how == "arithmetic":
            return N.normalised(gamma @ p.out.T, 1)
        return start if how is not None else _predicted(p, gamma, epsilon)

    def rounds(x: pa.Array, codes: pa.Array, start: pa.Array) -> Iterator[N.Rows]:
        """The rows after the single pass, then after each round, changed in place."""
        n_rows = len(x)
        x, codes = matrix(x).reshape(n_rows, -1), matrix(codes, np.int64).reshape(n_rows, -1)
        d, ones = p.distances(x, codes), np.ones(n_rows)
        rows = N.Rows(x, codes, np.zeros((n_rows, len(p.out))), ones, ones, ones, [N.assign(d, p.epsilons[0])], d)
        for n, theta in enumerate(p.thetas):
            rows.gammas.append(N.assign(-p.deltas[n] * rows.gammas[n] @ N.floored(theta).T, p.epsilons[n + 1]))
        rows.q = started(matrix(start), rows.gammas[-1])
        yield rows
        for k in itertools.count(1):
            if k > 1 or how is None:
                rows.q = _predicted(p, rows.gammas[-1], epsilon)
            for n in range(len(p.thetas), 0, -1):
                cost = -p.deltas[n - 1] * rows.gammas[n - 1] @ N.floored(p.thetas[n - 1]).T
                rows.gammas[n] = N.assign(cost + N.outgoing(p, rows, n), p.epsilons[n])
            rows.gammas[0] = N.assign(rows.u[:, None] * d + N.outgoing(p, rows, 0), p.epsilons[0])
            if recover:
                of = (rows.gammas[0] * d).sum(1)
                rows.u = rows_fitted * np.minimum(1.0, np.exp(np.clip((least - of) / p.epsilon_T - log_partition, -700, 700)))
            yield rows

    def costs(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, and what they cost after each of most rounds."""
        count, total = 0, np.zeros(most + 1)
        for b in batches:
            if b.num_rows:
                count += b.num_rows
                total += [_objective(p, rows, rows.d).sum() for rows in itertools.islice(rounds(b["x"], b["codes"], b["_start"]), most + 1)]
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count]), lists(total[None])], ["n", "cost"])

    def settled() -> int:
        """Rounds until the mean cost settles. Rows do not meet, so no state is kept: a pass takes so many rounds, and a longer one begins again."""
        for most in sorted({min(m, config.max_iter) for m in (*_PASSES, config.max_iter)}):
            parts = given.select("x", "codes", "_start").mapInArrow(partial(costs, most), "n long, cost array<double>").collect()  # a row a task
            if not parts:
                return 0
            mean = np.sum([r["cost"] for r in parts], axis=0) / sum(r["n"] for r in parts)
            for k in range(1, most + 1):
                if abs(mean[k] - mean[k - 1]) <= config.tol * max(abs(mean[k - 1]), N.EPS):
                    return k
        return config.max_iter

    last = settled()

    def predicted(x: pa.Array, codes: pa.Array, start: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        return lists(next(itertools.islice(rounds(x, codes, start), last, None)).q)

    out = given.withColumn("prediction", F.arrow_udf(predicted, "array<double>")("x", "codes", "_start")).select(*[F.col(f"`{c}`") for c in columns if c != "prediction"], "prediction")
    if not p.regression:
        out = out.withColumn("label", F.element_at(F.array(*[F.lit(c) for c in network.classes]), F.array_position("prediction", F.array_max("prediction")).cast("int")))
    return out
