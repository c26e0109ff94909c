"""Fitting and applying a network.

Rows live in a DataFrame; parameters live on the driver. An iteration is one scan for each
clustering block: the scan refreshes that block's shares and sums what the updates need, so a
network with N hidden blocks reads its rows N + 1 times an iteration. Without hidden blocks and
learned instance weights shares follow from parameters alone, and no state is kept at all.
"""

from __future__ import annotations

import copy
import math
import pickle
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import arrays as A
from lattica.operators import seeding, staging
from lattica.operators import statistics as T
from lattica.plans import kernel as N
from lattica.plans.recipe import Input, ManifoldInput, Recipe, RegressionHead
from lattica.sources.shared import checkpointed


#: Tasks that merge the sums of a scan of many partitions.
MERGERS = 32


class ConvergenceWarning(UserWarning):
    """The iteration budget ended first."""


class LossIncreaseWarning(UserWarning):
    """A loss rose by more than rounding explains."""


@dataclass(frozen=True)
class PredictConfig:
    """single: one forward pass. iterative: predictions and shares in turn until the batch settles."""

    mode: str = "single"
    readout: str = "geometric"
    epsilon_P: float | None = None
    tol: float = 1e-4
    max_iter: int = 100
    #: Where iterative predictions start: None is the single pass; arithmetic or uniform (classes),
    #: mean (regression), a whole number as the seed of random shares, or column:<name> of given ones.
    start: str | int | None = None

    def __post_init__(self) -> None:
        if self.start is not None and self.mode != "iterative":
            raise ValueError("start needs iterative prediction")
        if isinstance(self.start, str) and self.start not in ("arithmetic", "uniform", "mean") and not self.start.startswith("column:"):
            raise ValueError("start is arithmetic, uniform, mean, column:<name> or a seed")
        if self.mode not in ("single", "iterative") or self.readout not in ("geometric", "arithmetic"):
            raise ValueError("mode is single or iterative, readout geometric or arithmetic")


@dataclass
class Network:
    recipe: Recipe
    layout: staging.Layout
    params: N.Params
    losses: list[float]
    converged: bool
    config: PredictConfig
    rows: int
    classes: list | None = None
    log_partition: float = 0.0
    least: float = 0.0
    state: DataFrame | None = None
    sums: dict[int, dict] | None = None  # of every block as its rows stand, as large as the parameters
    stored: list[int] = field(default_factory=list)  # widths of the kept rows' shares, and what is left of them
    keep: list[np.ndarray] = field(default_factory=list)
    members: list[Network] = field(default_factory=list)

    def __getstate__(self) -> dict:
        """For pickle and copy: everything but the kept rows, which live in Spark."""
        return {**self.__dict__, "state": None, "sums": None}

    @property
    def can_resume(self) -> bool:
        """Whether the rows and sums that a fit would go on from were kept (keep_rows), and it has not settled."""
        return self.state is not None and self.sums is not None and not self.converged

    @property
    def initial_state(self) -> N.Params:
        """A detached copy of the parameters, to start another fit from."""
        return copy.deepcopy(self.params)

    # --- forward pass as expressions; row-local, so a stream can be transformed too ---------
    def _distance(self) -> Column:
        p, d = self.params, self.params.C.shape[1]
        if p.U is not None:
            def cost(k: int) -> Column:
                away = F.zip_with("x", A.vector(p.C[k]), lambda a, b: a - b)
                along = A.total(F.array(*[A.dot(away, p.U[k][:, j]) * A.dot(away, p.U[k][:, j]) for j in range(p.U.shape[2])]))
                return ((1 + p.alpha) * A.sq_norm(away) - along) / d

            return F.array(*[cost(k) for k in range(len(p.C))])
        each = A.unrolled_distances(F.col("x"), p.C.tolist(), p.W[:d].tolist()) if d else [F.lit(0.0)] * len(p.C)
        for j, (q, s) in enumerate(zip(p.P, p.scales, strict=True)):
            scale = s * float(p.W[d + j])
            each = [c + F.element_at(A.vector([-scale * math.log(max(v, A.TINY)) for v in row]), F.get("codes", j) + 1) for c, row in zip(each, q.tolist(), strict=True)]
        return F.array(*each)

    def affiliations(self, df: DataFrame) -> DataFrame:
        """df with x, codes, cost and gamma0, gamma1, ... of its rows."""
        p = self.params
        out = staging.checked(staging.replay_layout(df, self.layout), self.layout)
        out = out.withColumn("cost", self._distance())
        out = _shares(out, "cost", "gamma0", p.epsilons[0], len(p.C))
        for n, theta in enumerate(p.thetas):
            out = _shares(out.withColumn(_TEMP[0], _each(A.unrolled(F.col(f"gamma{n}"), A.logs(theta.tolist())), -p.deltas[n])), _TEMP[0], f"gamma{n + 1}", p.epsilons[n + 1], len(theta)).drop(_TEMP[0])
        return out

    def _read_out(self, df: DataFrame, gamma: str, config: PredictConfig) -> DataFrame:
        """df with prediction, from the shares in the column gamma."""
        p = self.params
        if p.regression:
            return df.withColumn("prediction", F.array(*A.unrolled(F.col(gamma), p.out.tolist())))
        if config.readout == "arithmetic":
            if self.recipe.as_chain()[2].coupling == "S":
                raise ValueError("an arithmetic read-out needs an M head")
            return df.withColumn("prediction", A.arithmetic_readout(F.col(gamma), p.out.tolist()))
        e = config.epsilon_P if config.epsilon_P is not None else p.deltas[-1]
        costs = df.withColumn(_TEMP[0], _each(A.unrolled(F.col(gamma), A.logs(p.out.tolist())), -p.deltas[-1]))
        return _shares(costs, _TEMP[0], "prediction", e, len(p.out)).drop(_TEMP[0])

    def predict(self, df: DataFrame, details: Sequence[str] = (), config: PredictConfig | None = None) -> DataFrame:
        """df with prediction (and label for classes); details: affiliations, instance_weights, reconstruction."""
        config = config or self.config
        if config.mode == "iterative":
            from lattica.plans.refine import refined

            return refined(self, df, config)
        out = self.affiliations(df)
        out = self._read_out(out, f"gamma{len(self.params.thetas)}", config)
        if not self.params.regression:
            names = F.array(*[F.lit(c) for c in self.classes])
            out = out.withColumn("label", F.element_at(names, F.array_position("prediction", F.array_max("prediction")).cast("int")))
        if "instance_weights" in details:
            out = out.withColumn("instance_weight", self._recovered())
        if "reconstruction" in details:
            out = out.withColumn("reconstruction", self._reconstruction())
        drop = ["x", "codes", "cost"] + ([] if "affiliations" in details else [f"gamma{n}" for n in range(len(self.params.thetas) + 1)])
        return out.drop(*drop)

    def _recovered(self) -> Column:
        if not math.isfinite(self.params.epsilon_T):
            raise ValueError("instance weights were not learned")
        return A.recovered_weight(A.dot(F.col("gamma0"), F.col("cost")), self.least, self.params.epsilon_T, self.log_partition)

    def _reconstruction(self) -> Column:
        p = self.params
        if p.U is None:
            return A.through(F.col("gamma0"), p.C.T.tolist())
        parts = []
        for k in range(len(p.C)):
            basis = p.U[k] @ p.U[k].T
            away = F.zip_with("x", A.vector(p.C[k]), lambda a, b: a - b)
            parts.append(A.plus(A.through(away, basis.tolist()), A.vector(p.C[k])))
        out = None
        for k, part in enumerate(parts):
            term = A.times(part, F.element_at("gamma0", k + 1))
            out = term if out is None else A.plus(out, term)
        return out

    def reconstruct(self, df: DataFrame) -> DataFrame:
        """df with reconstruction (scaled features) and reconstruction_cat (shares of levels)."""
        out = self.affiliations(df).withColumn("reconstruction", self._reconstruction())
        if self.params.P:
            out = out.withColumn("reconstruction_cat", F.array(*[A.through(F.col("gamma0"), q.T.tolist()) for q in self.params.P]))
        return out.drop("x", "codes", "cost", *[f"gamma{n}" for n in range(len(self.params.thetas) + 1)])

    def predict_all(self, df: DataFrame) -> DataFrame:
        """Predictions of every kept member, by member."""
        out = None
        for k, m in enumerate(self.members or [self]):
            one = m.predict(df).withColumn("member", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return out

    def score_samples(self, df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
        """(key, share): where a row's recovered weight stands among those of the reference rows."""
        # weights are read several times, so they are written once
        weigh = lambda d: checkpointed(self.predict(d, ["instance_weights"]).select(key, "instance_weight"))
        of = weigh(df)
        return T.ecdf(of if reference is df else weigh(reference), of, key, "instance_weight")

    def calibrated(self, df: DataFrame, label: str) -> Network:
        """The network with the read-out temperature of least log loss among its strength, a fitted one and 0."""
        p = self.params
        if p.regression:
            raise ValueError("a regression has no read-out temperature")
        rows = self.affiliations(df).where(F.col(label).isNotNull())
        z = A.through(F.col(f"gamma{len(p.thetas)}"), A.logs(p.out.tolist()))
        rows = rows.select(A.let(z, lambda v: F.transform(v, lambda e: e - F.array_max(v))).alias("z"), staging.code_of(label, self.classes).alias("c")).persist(StorageLevel.MEMORY_AND_DISK)

        def loss(*betas: float) -> list[float]:
            each = [F.avg(log_loss_at(b)) for b in betas]
            return list(rows.agg(*[e.alias(f"b{i}") for i, e in enumerate(each)]).first())

        low, high = math.log(1e-6), math.log(1e6)
        for _ in range(6):  # a grid of betas each pass, around the best of the last
            grid = np.linspace(low, high, 17)
            best = int(np.argmin(loss(*np.exp(grid))))
            low, high = grid[max(best - 1, 0)], grid[min(best + 1, 16)]
        beta = math.exp((low + high) / 2)
        start, fitted = loss(1.0, beta)
        wrong = rows.where(F.element_at("z", F.col("c") + 1) < 0).limit(1).count()
        rows.unpersist()
        e = p.deltas[-1]
        if fitted < start:
            e = p.deltas[-1] / beta
        if not wrong:
            e = 0.0
        return replace(self, config=replace(self.config, epsilon_P=e))

    def inspect(self, name: str):
        p = self.params
        have: dict[str, Callable] = {
            "continuous_centroids": lambda: p.C, "categorical_centroids": lambda: p.P, "feature_weights": lambda: p.W, "manifold_projectors": lambda: p.U,
            "transition_matrices": lambda: p.thetas, "head_parameters": lambda: p.out, "training_affiliations": lambda: self._kept("s"), "training_instance_weights": lambda: self._kept("u"),
            "affiliation_regimes": lambda: ["soft" if e > 0 else "hard" for e in p.epsilons],
        }
        if name not in have:
            raise ValueError(f"{name} is none of {', '.join(have)}")
        return have[name]()

    def _kept(self, column: str) -> DataFrame:
        if self.state is None:
            raise ValueError("the network keeps no rows")
        return self.state.select("row_id", column)


def log_loss_at(beta: float) -> Column:
    return F.ln(A.total(F.transform("z", lambda v: F.exp(v * beta)))) - beta * F.element_at("z", F.col("c") + 1)


#: Columns that stand for a value that is used several times; they are dropped again.
_TEMP = ("_lattica_cost", "_lattica_low", "_lattica_each", "_lattica_mass")


def _each(values: list[Column], by: float) -> Column:
    return F.array(*[v * F.lit(float(by)) for v in values])


def _shares(df: DataFrame, cost: str, into: str, temperature: float, n: int) -> DataFrame:
    """df with A.assign of the n costs in a column, in operations that Spark compiles (functions of arrays are interpreted)."""
    if not A.is_soft(temperature):
        return df.withColumn(into, A.assign(F.col(cost), temperature, n))
    _, low, each, mass = _TEMP
    out = df.withColumn(low, F.array_min(cost))
    out = out.withColumn(each, F.array(*[F.exp(-(F.get(cost, k) - F.col(low)) / F.lit(float(temperature))) for k in range(n)]))
    out = out.withColumn(mass, A.added([F.get(each, k) for k in range(n)]))
    fine = F.col(low).isNotNull() & ~F.isnan(low) & (F.abs(low) < float("inf"))
    return out.withColumn(into, F.array(*[F.when(fine, F.get(each, k) / F.col(mass)).otherwise(F.lit(1.0) / n) for k in range(n)])).drop(low, each, mass)


# --- staging ---------------------------------------------------------------------------------
def stage(df: DataFrame, layout: staging.Layout, target: str | Sequence[str], row_id: str, classes: list | None, weight: str | None, class_weights: dict | None, task: Column | None) -> DataFrame:
    """row_id, x, codes, q (weighted classes, or outputs), omega, w."""
    out = staging.replay_layout(df, layout)
    raw = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    if classes is not None:
        target_, labelled = staging.class_target(F.when(F.col(target).isNotNull(), staging.code_of(target, classes)), len(classes))
    else:
        names = [target] if isinstance(target, str) else list(target)
        target_, labelled = staging.value_target(F.array(*[F.col(c).cast("double") for c in names]))
    out = out.select(F.col(row_id).alias("row_id"), "x", "codes", target_.alias("t"), labelled.alias("labelled"), raw.alias("raw"), (task if task is not None else F.lit(1.0)).alias("task"))
    out = staging.normalised_weights(out, F.col("raw"))
    if classes is not None:
        out = staging.class_weighted(out, "t", "w", "labelled", [float((class_weights or {}).get(c, 1.0)) for c in classes]).withColumn("omega", F.lit(0.0))
    else:
        out = staging.task_weighted(out, "w", "labelled", F.col("task")).withColumn("q", F.col("t"))
    return out.select("row_id", "x", "codes", "q", "omega", "w")


def matrix(column: pa.Array, kind: type = float) -> np.ndarray:
    """A column of lists of one length (without nulls) as a matrix, with no step for a row."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1) if len(column) else np.empty((0, 0), kind)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    rows = np.ascontiguousarray(rows, dtype=float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def values(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float, copy=False)


def _rows(b: pa.RecordBatch, p: N.Params, has_state: bool, stored: list[int], keep: list[np.ndarray]) -> N.Rows:
    w, n_rows = values(b["w"]), b.num_rows
    x, codes = matrix(b["x"]).reshape(n_rows, -1), matrix(b["codes"], np.int64).reshape(n_rows, -1)
    if has_state:
        s, at, gammas = matrix(b["s"]), 0, []
        for n, k in zip(stored, keep, strict=True):
            gammas.append(np.ascontiguousarray(s[:, at : at + n][:, k]))
            at += n
        u = values(b["u"])
    else:
        gammas, u = [np.full((n_rows, n), 1 / n) for n in p.widths], w
    return N.Rows(x, codes, matrix(b["q"]), values(b["omega"]), w, u, gammas)


def _needed(df: DataFrame) -> DataFrame:
    """What sums are made of; ids stay where they are."""
    return df.select(*[c for c in df.columns if c != "row_id"])


_PARTS = {"h": np.int64, "x": float, "codes": np.int32, "q": float, "omega": float, "w": float}


def blocked(staged: DataFrame, seed: int = 0) -> DataFrame:
    """The staged rows in blocks, a row each: n and the bytes of every column (of one value throughout, that value), so that a scan hands them to Python as they lie. h is a hash of the id and the seed, which rows are drawn by.

    Where the input gives fewer tasks than there are cores, blocks are dealt out to all of them.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = {c: matrix(b[c], kind) if pa.types.is_list(b[c].type) else b[c].to_numpy(zero_copy_only=False).astype(kind, copy=False) for c, kind in _PARTS.items()}
                yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int32()), **{c: pa.array([(v[:1] if v.ndim == 1 and (v == v[0]).all() else v).tobytes()], pa.binary()) for c, v in cells.items()}})

    rows = staged.select(F.xxhash64("row_id", F.lit(seed)).alias("h"), *[c for c in _PARTS if c != "h"])
    out = rows.mapInArrow(packed, "n int, " + ", ".join(f"{c} binary" for c in _PARTS))
    cores = staged.sparkSession.sparkContext.defaultParallelism
    return out.repartition(cores) if rows.rdd.getNumPartitions() < cores else out


def _unblocked(b: pa.RecordBatch, p: N.Params | None = None) -> Iterator[N.Rows]:
    """The rows of each block; without state, so their shares are even."""
    for i in range(b.num_rows):
        n = b["n"][i].as_py()
        c = {k: np.frombuffer(b[k][i].as_buffer(), kind) for k, kind in _PARTS.items() if k in b.schema.names}
        c = {k: np.full(n, v[0]) if k in ("h", "omega", "w") and len(v) == 1 else v for k, v in c.items()}
        x, codes, q = c["x"].reshape(n, -1), c["codes"].reshape(n, -1), c["q"].reshape(n, -1)
        u = np.frombuffer(b["u"][i].as_buffer(), float) if "u" in b.schema.names else c["w"]
        yield N.Rows(x, codes, q, c["omega"], c["w"], u, [np.full((n, k), 1 / k) for k in p.widths] if p is not None else [], h=c.get("h"))


def measured(blocks: DataFrame, of_rows: Callable[[N.Rows], object]) -> list:
    """What of_rows makes of each block of rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [pickle.dumps(of_rows(rows)) for rows in _unblocked(b)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(made, pa.binary())})

    return [pickle.loads(r["part"]) for r in blocks.mapInArrow(each, "part binary").collect()]


def _merged(parts: DataFrame) -> dict[str, np.ndarray] | None:
    """The sum of pickled sums, a row for each task of a scan."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for x in b["part"]:
                total = N.merged(total, pickle.loads(x))
        if total is not None:
            yield pd.DataFrame({"part": [pickle.dumps(total)]})

    # sums are as large as the parameters; behind a shuffle, so that the scan keeps its width, they merge in tasks first
    few = parts.repartition(MERGERS).mapInPandas(merge, "part binary") if parts.rdd.getNumPartitions() > 2 * MERGERS else parts
    total = None
    for r in few.collect():
        total = N.merged(total, pickle.loads(r["part"]))
    return total


class Fit:
    """The scans of one fit."""

    def __init__(self, staged: DataFrame, params: N.Params, blocks: DataFrame | None = None):
        self.staged, self.p = staged, params
        self.stateless = not params.thetas and not math.isfinite(params.epsilon_T)
        self.blocks = blocks  # of staged, for scans without state, or with no state but instance weights
        self.state: DataFrame | None = None
        self.stored, self.keep = [], []
        self.scans = 0
        self.borrowed: DataFrame | None = None  # rows of a network that stays as it is

    def scan(self, n: int, coupled: bool = True, through: bool = False) -> dict[str, np.ndarray]:
        """Refresh block n (through: and every block behind it) and return the merged sums of block n."""
        p, stored, keep, has = self.p, list(self.stored), [k.copy() for k in self.keep], self.state is not None
        if p.shift and not has:
            p.shift = 0.0
        if not self.stateless and self.blocks is not None:
            return self._weighed(coupled)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    r = _rows(b, p, has, stored, keep)
                    N.advance(p, r, n, coupled)
                    for m in range(1, len(p.thetas) + 1) if through else ():
                        r.gammas[m] = N.assign(-p.deltas[m - 1] * (r.gammas[m - 1] @ N.floored(p.thetas[m - 1]).T), p.epsilons[m])
                    yield pa.RecordBatch.from_arrays([*(b[c] for c in base), pa.array(r.u), lists(np.hstack(r.gammas))], [*base, "u", "s"])

        widths = p.widths

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if not b.num_rows:
                    continue
                for r in _unblocked(b, p) if self_stateless else [_rows(b, p, True, widths, [np.ones(k, bool) for k in widths])]:
                    if self_stateless:
                        N.advance(p, r, n, coupled)
                    total = N.merged(total, N.sums(p, r, n))
            if total is not None:
                yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(total)]})

        base, self_stateless = ["row_id", "x", "codes", "q", "omega", "w"], self.stateless
        if self.stateless and self.blocks is None:
            self.blocks = blocked(self.staged).persist(StorageLevel.MEMORY_AND_DISK)
        source = self.blocks
        old = self.state
        if not self.stateless:
            kind = self.staged.schema["row_id"].dataType.simpleString()
            source = (self.state if has else self.staged).mapInArrow(step, f"row_id {kind}, x array<double>, codes array<int>, q array<double>, omega double, w double, u double, s array<double>")
            self.scans += 1
            if self.scans % 8 == 0:
                source = checkpointed(source)
            source = source.persist(StorageLevel.MEMORY_AND_DISK)
            self.state, self.stored, self.keep = source, widths, [np.ones(k, bool) for k in widths]
        total = _merged((source.drop("h") if self.stateless else _needed(source)).mapInArrow(summed, "part binary"))
        if old is not None and old is not self.borrowed and not self.stateless:
            old.unpersist()
        return total

    def _weighed(self, coupled: bool) -> dict[str, np.ndarray]:
        """scan of the one block of rows whose instance weights are all their state: blocks of rows carry these, and a pass over them gives the sums as well."""
        p, base = self.p, ["n", "x", "codes", "q", "omega", "w"]

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, r in enumerate(_unblocked(b, p)):
                    N.advance(p, r, 0, coupled)
                    made = [pa.array([r.u.tobytes()], pa.binary()), pa.array([pickle.dumps(N.sums(p, r, 0))], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*(b[c].slice(i, 1) for c in base), *made], [*base, "u", "part"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for x in b["part"]:
                    total = N.merged(total, pickle.loads(x.as_py()))
            if total is not None:
                yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(total)]})

        old = self.state
        source = (self.blocks.select(*base) if old is None else old.select(*base, "u")).mapInArrow(step, ", ".join(["n int", *(f"{c} binary" for c in [*base[1:], "u", "part"])]))
        self.scans += 1
        if self.scans % 8 == 0:
            source = checkpointed(source)
        self.state = source.persist(StorageLevel.MEMORY_AND_DISK)
        total = _merged(self.state.select("part").mapInArrow(summed, "part binary"))
        (self.blocks if old is None else old).unpersist()
        return total

    def prune(self, n: int, alive: np.ndarray) -> np.ndarray:
        """Drop clusters of block n without mass from parameters and state; returns what stays."""
        keep = alive > N.TINY
        if keep.all():
            return keep
        p = self.p
        if n == 0:
            p.C, p.P = p.C[keep], [q[keep] for q in p.P]
            p.U = p.U[keep] if p.U is not None else None
        else:
            p.thetas[n - 1] = p.thetas[n - 1][keep]
            if self.axes[n - 1] == 0:
                p.thetas[n - 1] = N.normalised(p.thetas[n - 1], 0)
        if n < len(p.thetas):
            p.thetas[n] = p.thetas[n][:, keep]
            if self.axes[n] == 1:
                p.thetas[n] = N.normalised(p.thetas[n], 1)
        else:
            p.out = p.out[:, keep]
            if not p.regression and self.axes[-1] == 1:
                p.out = N.normalised(p.out, 1)
        if self.keep:
            self.keep[n] = keep
        return keep

    axes: list[int] = []


def _kept(sums: dict[str, np.ndarray], keep: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Sums of the clusters of block n that stay."""
    out = dict(sums)
    for k in ("alive", "m", "N", "SS", "A", "omega"):
        if k in out:
            out[k] = out[k][keep]
    for k in [k for k in out if k[0] == "c" and k[1:].isdigit()]:
        out[k] = out[k][keep]
    for k in ("next", "head"):
        if k in out:
            out[k] = out[k][:, keep]
    return out


def _head_update(p: N.Params, s: dict, axis: int, prior: float, epsilon_M: float) -> None:
    if not p.regression:
        p.out = N.normalised(s["head"] + prior, axis)
        return
    mean = s["y1"] / max(float(s["y0"][0]), N.TINY)
    p.out = np.where(s["omega"][None] <= N.TINY, mean[:, None], s["head"] / np.maximum(s["omega"], N.TINY)[None])
    if math.isfinite(epsilon_M):
        p.W_M = N.assign(p.deltas[-1] * _residuals(p, s)[None], epsilon_M)[0]


def _residuals(p: N.Params, s: dict) -> np.ndarray:
    return s["y2"] - 2 * (p.out * s["head"]).sum(1) + (p.out**2 * s["omega"][None]).sum(1)


def _input_update(p: N.Params, s: dict, epsilon_D: float) -> None:
    """Feature weights against the old centres, then the centres."""
    z = float(s["u"][0])
    m, mean, d = s["m"] / z, s["N"] / z, p.C.shape[1]
    if math.isfinite(epsilon_D) and p.U is None:
        cost = [s["S2"] / z - 2 * (p.C * mean).sum(0) + (m[:, None] * p.C**2).sum(0)]
        cost += [np.array([-scale * (N.floored(q) * s[f"c{j}"] / z).sum()]) for j, (q, scale) in enumerate(zip(p.P, p.scales, strict=True))]
        p.W = N.assign(np.concatenate(cost)[None], epsilon_D)[0]
    has = m > N.TINY
    p.C = np.where(has[:, None], mean / np.maximum(m, N.TINY)[:, None], 0.0)
    p.P = [N.normalised(s[f"c{j}"], 1) for j in range(len(p.P))]
    if p.U is not None:
        cov = s["SS"] / z / np.maximum(m, N.TINY)[:, None, None] - p.C[:, :, None] * p.C[:, None, :]
        p.U = np.where(has[:, None, None], N.leading(cov, p.U.shape[2]), p.U)
    p.mass = z
    del d


def _input_loss(p: N.Params, s: dict, rows: int) -> float:
    z = float(s["u"][0])
    m, mean, d = s["m"] / z, s["N"] / z, p.C.shape[1]
    if p.U is not None:
        second = s["SS"] / z - mean[:, :, None] * p.C[:, None, :] - p.C[:, :, None] * mean[:, None, :] + m[:, None, None] * p.C[:, :, None] * p.C[:, None, :]
        out = ((1 + p.alpha) * np.einsum("kdd->", second) - np.einsum("kdp,kde,kep->", p.U, second, p.U)) / d
    else:
        out = float(p.W[:d] @ (s["S2"] / z - 2 * (p.C * mean).sum(0) + (m[:, None] * p.C**2).sum(0)))
        out -= sum(p.W[d + j] * scale * (N.floored(q) * s[f"c{j}"] / z).sum() for j, (q, scale) in enumerate(zip(p.P, p.scales, strict=True)))
    if math.isfinite(p.epsilon_T):
        out -= float(s["ub"][0]) / z + p.epsilon_T * math.log(z * rows)
    return float(out)


def fit(df: DataFrame, recipe: Recipe, target: str | Sequence[str], continuous: Sequence[str] = (), categorical: Sequence[str] = (), *, row_id: str, weight: str | None = None, class_weights: dict | None = None, task_weights: Column | None = None, layout: staging.Layout | None = None, centres: np.ndarray | None = None, levels: Sequence[np.ndarray] | None = None, max_iter: int = 100, tol: float = 1e-4, seed: int = 0, config: PredictConfig | None = None, keep_rows: bool = False, start: N.Params | None = None, calibrate: bool = False, init_rows: Sequence | None = None, projectors: np.ndarray | None = None, logger: Callable[[int, float], None] | None = None, initial_state: N.Params | None = None) -> Network:
    """Fit a chain of blocks by exact block-coordinate descent. Features are scaled by the layout; row_id names each row for good.

    init_rows: ids of rows whose features are the first centres. projectors: bases (K, D, d) of a
    manifold input, made orthonormal. logger is told each iteration and its loss, from 0.
    initial_state: parameters of another network; groups that fit this one are taken over, with a
    warning for each that does not (start takes all of them as they are).
    """
    first, hidden, head, links = recipe.as_chain()
    if first.epsilon_T == 0:
        raise ValueError("hard instance weights (epsilon_T = 0) cannot be fitted")
    layout = layout or staging.fit_layout(df, continuous, categorical)
    regression = isinstance(head, RegressionHead)
    classes = None
    if not regression:
        classes = [r[0] for r in df.where(F.col(target).isNotNull()).select(target).distinct().orderBy(target).limit(10_001).collect()]
        if len(classes) > 10_000 or len(classes) < (head.n_classes or 2) and len(classes) < 2:
            raise ValueError(f"{len(classes)} classes")
    staged = stage(df, layout, target, row_id, classes, weight, class_weights, task_weights)
    in_blocks = not hidden and not (keep_rows and math.isfinite(first.epsilon_T))
    if keep_rows or not in_blocks:
        staged = staged.persist(StorageLevel.MEMORY_AND_DISK)
    rows = staging.validate(staged, layout.levels, len(layout.continuous))
    if init_rows is not None:
        centres, levels = _of_rows(staged, list(init_rows), first.K, layout)
    blocks = blocked(staged, seed).persist(StorageLevel.MEMORY_AND_DISK)
    p = start or _start(staged, first, hidden, head, links, layout, rows, centres, levels, seed, regression, classes, projectors, blocks)
    if initial_state is not None:
        p = reuse(initial_state, p)
    run = Fit(staged, p, blocks if in_blocks else None)
    if not in_blocks:
        blocks.unpersist()
    run.axes, priors = _couplings(p, head, links)
    last = len(p.thetas)

    # start: shares without couplings, exact categorical centres, then the chain
    s0 = run.scan(0, coupled=False, through=True)
    if start is None:
        p.P = [N.normalised(s0[f"c{j}"], 1) for j in range(len(p.P))]
        if hidden and not (initial_state is not None and _alike(initial_state.thetas, p.thetas)):
            _capacity(hidden, links, len(p.C), rows)
            seeding.connect(run, staged, s0, p, seed)
            s0 = run.scan(0, coupled=False, through=True)
    by = {0: _kept(s0, run.prune(0, s0["alive"]), 0)}
    for n in range(1, last + 1):
        by[n] = _sums_of(run, n)
    p.shift = float(by[0]["b"][0]) if math.isfinite(p.epsilon_T) else 0.0
    by[0]["ub"] = np.zeros(1)  # instance weights are the sample weights so far
    losses: list[float] = []
    done = _optimise(run, by, losses, first, head, priors, rows, max_iter, tol, logger)
    if not done and max_iter:
        warnings.warn("max_iter was reached before tol", ConvergenceWarning, stacklevel=2)
    out = Network(recipe, layout, p, losses, done, config or PredictConfig(), rows, classes, math.log(p.mass * rows) if math.isfinite(p.epsilon_T) else 0.0, p.shift)
    if keep_rows:
        out.state = run.state if run.state is not None else staged
        out.sums, out.stored, out.keep = by, list(run.stored), list(run.keep)
    else:
        staged.unpersist()
        if run.state is not None:
            run.state.unpersist()
    if run.blocks is not None:
        run.blocks.unpersist()
    if calibrate and not regression:
        out = out.calibrated(df, target)
    return out


def _optimise(run: Fit, by: dict[int, dict], losses: list[float], first, head, priors: list[float], rows: int, max_iter: int, tol: float, logger: Callable[[int, float], None] | None) -> bool:
    """Iterate from the sums of every block until the loss settles (True) or it holds max_iter steps; by, losses and the parameters follow in place."""
    p, last, regression = run.p, len(run.p.thetas), run.p.regression

    def loss() -> tuple[float, float]:
        out = _input_loss(p, by[0], rows) - sum(e * float(by[n]["entropy"][0]) for n, e in enumerate(p.epsilons))
        for n in range(last):
            out -= p.deltas[n] * float((N.floored(p.thetas[n]) * (by[n]["next"] + priors[n])).sum())
        if regression:
            weights = p.W_M if p.W_M is not None else np.full(len(p.out), 1 / len(p.out))
            out += p.deltas[-1] * float(weights @ _residuals(p, by[last]))
            if math.isfinite(head.epsilon_M):
                out -= head.epsilon_M * float(N.entropies(weights[None])[0])
        else:
            out -= p.deltas[-1] * float((N.floored(p.out) * (by[last]["head"] + priors[-1])).sum())
        offset = sum(e * math.log(k) for e, k in zip(p.epsilons, p.widths, strict=True) if e > 0)
        if isinstance(first, Input) and math.isfinite(first.epsilon_D):
            out -= first.epsilon_D * float(N.entropies(p.W[None])[0])
            offset += first.epsilon_D * math.log(len(p.W))
        if math.isfinite(p.epsilon_T):
            offset += p.epsilon_T * math.log(rows)
        if regression and math.isfinite(head.epsilon_M):
            offset += head.epsilon_M * math.log(len(p.out))
        return out, offset

    for k in range(len(losses) - 1 if losses else 0, max_iter):
        _head_update(p, by[last], run.axes[-1], priors[-1], head.epsilon_M if regression else math.inf)
        if not losses:
            losses.append(loss()[0])
            if logger:
                logger(0, losses[0])
        for n in range(last, 0, -1):
            s = run.scan(n)
            by[n] = _kept(s, run.prune(n, s["alive"]), n)
            p.thetas[n - 1] = N.normalised(by[n]["A"] + priors[n - 1], run.axes[n - 1])
        s = run.scan(0)
        by[0] = _kept(s, run.prune(0, s["alive"]), 0)
        _input_update(p, by[0], first.epsilon_D if isinstance(first, Input) else math.inf)
        now, offset = loss()
        if now > losses[-1] + 256 * N.EPS * max(1.0, abs(now)):
            warnings.warn(f"the loss rose from {losses[-1]:.17g} to {now:.17g}", LossIncreaseWarning, stacklevel=2)
        losses.append(now)
        if logger:
            logger(k + 1, now)
        if abs(now - losses[-2]) / max(abs(losses[-2] + offset), N.EPS) <= tol:
            return True
    return False


def _couplings(p: N.Params, head, links: list) -> tuple[list[int], list[float]]:
    """The axis that each transition is normalised over, and its pseudocount for an entry."""
    axes = [0 if (c.coupling or "M") == "M" else 1 for c in links[:-1]] + [0 if p.regression or head.coupling == "M" else 1]
    alphas = [(c.theta_alpha or 1.0) - 1 for c in links[:-1]] + [0.0 if p.regression else head.theta_alpha - 1]
    return axes, [a / n for a, n in zip(alphas, [*(t.size for t in p.thetas), p.out.size], strict=True)]


def _capacity(hidden: list, links: list, width: int, rows: int) -> None:
    """Raises if a hidden block that needs rows for its profiles (S couplings, or more clusters than before it) has too few."""
    for block, link in zip(hidden, links, strict=False):
        if (link.coupling == "S" or width < block.K) and rows < block.K:
            raise ValueError(f"{block.name} needs {block.K} rows for its profiles and there are {rows}")
        width = block.K


def _alike(a: list, b: list) -> bool:
    return [x.shape for x in a] == [x.shape for x in b]


def reuse(old: N.Params, new: N.Params) -> N.Params:
    """new with the groups of old that fit it: input (or its first clusters, if it had more), transitions and head; warns of the rest."""
    def fits(name: str, ok: bool) -> bool:
        if not ok:
            warnings.warn(f"{name} of the initial state does not fit and is made afresh", UserWarning, stacklevel=4)
        return ok

    out, K = replace(new), len(new.C)
    same_kind = (old.U is None) == (new.U is None) and (old.U is None or old.U.shape[1:] == new.U.shape[1:])
    if fits("the input", same_kind and old.C.shape[1] == new.C.shape[1] and [q.shape[1] for q in old.P] == [q.shape[1] for q in new.P] and len(old.C) >= K):
        out.C, out.P, out.W = old.C[:K].copy(), [q[:K].copy() for q in old.P], old.W.copy()
        out.U = old.U[:K].copy() if old.U is not None else None
    if new.thetas and fits("the transitions", _alike(old.thetas, new.thetas)):
        out.thetas = [t.copy() for t in old.thetas]
    if fits("the head", old.regression == new.regression and old.out.shape == new.out.shape):
        out.out = old.out.copy()
        out.W_M = old.W_M.copy() if old.W_M is not None and new.W_M is not None else new.W_M
    return out


def initialise(df: DataFrame, recipe: Recipe, target: str | Sequence[str], continuous: Sequence[str] = (), categorical: Sequence[str] = (), *, row_id: str, **options) -> Network:
    """The network that a fit would start from: staged, seeded and pruned, with no step taken; it can be resumed."""
    return fit(df, recipe, target, continuous, categorical, row_id=row_id, max_iter=0, keep_rows=True, **options)


def go_on(network: Network, *, max_iter: int = 100, tol: float = 1e-4, logger: Callable[[int, float], None] | None = None) -> Network:
    """Go on from where a fit that kept its rows stood, as if it had not stopped.

    max_iter is the ceiling of all steps, those taken before included; losses are appended. A
    network that has settled takes no step. The given network stays as it is.
    """
    if network.converged:
        return network
    if not network.can_resume:
        raise ValueError("the network kept no rows to go on from")
    first, _, head, links = network.recipe.as_chain()
    p, by, losses = copy.deepcopy(network.params), copy.deepcopy(network.sums), list(network.losses)
    run = Fit(network.state, p)
    run.axes, priors = _couplings(p, head, links)
    if not run.stateless:
        run.state, run.stored, run.keep, run.borrowed = network.state, list(network.stored), list(network.keep), network.state
    done = _optimise(run, by, losses, first, head, priors, network.rows, max_iter, tol, logger)
    if not done:
        warnings.warn("max_iter was reached before tol", ConvergenceWarning, stacklevel=2)
    if run.blocks is not None:
        run.blocks.unpersist()
    out = replace(network, params=p, losses=losses, converged=done, sums=by, least=p.shift, log_partition=math.log(p.mass * network.rows) if math.isfinite(p.epsilon_T) else 0.0)
    if not run.stateless:
        out.state, out.stored, out.keep = run.state, list(run.stored), list(run.keep)
    return out


def _sums_of(run: Fit, n: int) -> dict[str, np.ndarray]:
    """Sums of block n as its rows stand."""
    p, widths = run.p, run.p.widths
    stored, keep = list(run.stored), [k.copy() for k in run.keep]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = N.merged(total, N.sums(p, _rows(b, p, True, stored, keep), n))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(total)]})

    del widths
    total = None
    for r in _needed(run.state).mapInArrow(summed, "part binary").collect():
        total = N.merged(total, pickle.loads(r["part"]))
    return total


def _of_rows(staged: DataFrame, ids: list, K: int, layout: staging.Layout) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centres and level shares of the rows of those ids, in their order."""
    if len(set(ids)) != len(ids) or len(ids) != K:
        raise ValueError(f"init_rows needs {K} different rows")
    found = {r["row_id"]: r for r in staged.where(F.col("row_id").isin(ids)).select("row_id", "x", "codes").collect()}  # K rows
    if len(found) != K:
        raise ValueError("init_rows names rows that are not there")
    codes = np.array([found[i]["codes"] for i in ids], int).reshape(K, -1)
    return np.array([found[i]["x"] for i in ids], float).reshape(K, -1), [np.eye(n)[codes[:, j]] for j, n in enumerate(layout.levels)]


def _bases(projectors: np.ndarray, K: int, width: int, d: int) -> np.ndarray:
    """Supplied bases, checked and made orthonormal."""
    U = np.asarray(projectors, float)
    if U.shape != (K, width, d) or not np.isfinite(U).all() or (np.linalg.matrix_rank(U) < d).any():
        raise ValueError(f"projectors need shape {(K, width, d)}, finite values and full rank")
    return np.linalg.qr(U)[0]


def _start(staged, first, hidden, head, links, layout, rows, centres, levels, seed, regression, classes, projectors=None, blocks=None) -> N.Params:
    K = min(first.K, rows)
    if K < first.K:
        warnings.warn(f"K is {K}: there are no more rows", UserWarning, stacklevel=3)
    d, m = len(layout.continuous), layout.levels
    rng = np.random.default_rng(seed)
    manifold = isinstance(first, ManifoldInput)
    if manifold and (m or first.subspace_dimension > d):
        raise ValueError("a manifold input takes continuous features only, and more of them than its subspaces have")
    width = d + len(m)
    std = 0.0 if manifold else first.W_std
    z = std * rng.standard_normal(width)
    W = np.exp(z - z.max(initial=0)) / np.exp(z - z.max(initial=0)).sum() if width else np.empty(0)
    if centres is None:
        centres, seeds_codes = seeding.kmeanspp(partial(measured, blocks), K, W, d, first.candidates, first.balanced and not regression)
        levels = [np.eye(n)[seeds_codes[:, j]] for j, n in enumerate(m)]
    centres = np.asarray(centres, float).reshape(-1, d)
    guess = None if manifold else first.delta_cat
    if guess is None and m:
        from lattica.operators.guess import delta_cat_guess

        guess = delta_cat_guess(staged, d, m).first()["value"] if d else 1.0
    scales = [A.level_scale(guess or 1.0, n) for n in m]
    U = None
    if manifold:
        U = seeding.projectors(staged, centres, first.subspace_dimension) if projectors is None else _bases(projectors, len(centres), d, first.subspace_dimension)
    outputs = len(classes) if classes else len(staged.select("q").first()["q"])
    widths = [len(centres), *(h.K for h in hidden)]
    thetas = [np.full((b, a), 1 / b if (c.coupling or "M") == "M" else 1 / a) for a, b, c in zip(widths, widths[1:], links, strict=False)]
    out = np.zeros((outputs, widths[-1])) if regression else np.full((outputs, widths[-1]), 1 / outputs)
    W_M = np.array(head.W_M) / sum(head.W_M) if regression and head.W_M else np.full(outputs, 1 / outputs) if regression and math.isfinite(head.epsilon_M) else None
    return N.Params(centres, W, [np.asarray(v, float) for v in levels or []], scales, thetas, out, W_M, U, first.alpha if manifold else 0.0, [first.epsilon, *(h.epsilon for h in hidden)], [c.delta for c in links], first.epsilon_T, 0.0, 1.0, regression)


def resume(network: Network, df: DataFrame, target: str | Sequence[str], *, row_id: str, max_iter: int = 100, tol: float = 1e-4, recipe: Recipe | None = None, **options) -> Network:
    """Go on from fitted parameters: on the same rows, or fine-tuned on new ones; the recipe may change temperatures and strengths."""
    recipe = recipe or network.recipe
    _same_shape(recipe, network.recipe)
    first, hidden, head, links = recipe.as_chain()
    p = replace(network.params, epsilons=[first.epsilon, *(h.epsilon for h in hidden)], deltas=[c.delta for c in links], epsilon_T=first.epsilon_T, shift=0.0, mass=1.0)
    again = fit(df, recipe, target, row_id=row_id, layout=network.layout, start=p, max_iter=max_iter, tol=tol, config=network.config, **options)
    again.losses = [*network.losses, *again.losses[1:]]
    return again


def _same_shape(a: Recipe, b: Recipe) -> None:
    free = {"epsilon", "epsilon_D", "epsilon_T", "epsilon_M", "epsilon_ratio"}
    shape = lambda r: [(type(x).__name__, {k: v for k, v in vars(x).items() if k not in free}) for x in r.blocks]
    if shape(a) != shape(b):
        raise ValueError("only temperatures and strengths may change")
