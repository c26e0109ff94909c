"""Choosing among seeds, by loss in sample or over folds; candidates run as concurrent Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import statistics as T
from lattica.operators.seeding import sub_seed
from lattica.operators.staging import check_folds
from lattica.plans.network import Network, fit
from lattica.plans.recipe import Recipe


def plan_seeds(root: int, inits: int) -> list[int]:
    """The root itself for one start, else a seed for each."""
    return [root] if inits == 1 else [sub_seed(root, f"init{i}") for i in range(inits)]


def winner(scores: Sequence[float]) -> int:
    """The first least score; what is no number comes last."""
    return min(range(len(scores)), key=lambda i: (math.isnan(scores[i]), scores[i] if not math.isnan(scores[i]) else 0.0, i))


def accuracy_loss(predicted: DataFrame, target: str) -> float:
    return -T.accuracy(predicted, target, "label").first()["value"]


def log_loss(classes: Sequence) -> Callable[[DataFrame, str], float]:
    def loss(predicted: DataFrame, target: str) -> float:
        code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target)) - 1
        return T.log_loss(predicted.withColumn("_c", code.cast("int")), "_c", "prediction").first()["value"]

    return loss


def r2_loss(predicted: DataFrame, target: str) -> float:
    return -T.r2(predicted.withColumn("_p", F.col("prediction")[0]), target, "_p").first()["value"]


def select(df: DataFrame, recipe: Recipe, target: str | Sequence[str], *, row_id: str, inits: int = 1, seed: int = 0, loss: Callable[[DataFrame, str], float] | None = None, folds: DataFrame | None = None, parallel: int = 1, keep: str = "winner", **options) -> Network:
    """The network of the best of several starts. folds: (row_id, fold, part) with part train or validation; the winner is fitted again on all rows."""
    if folds is not None and loss is None:
        raise ValueError("folds need a loss")
    if folds is not None:
        check_folds(folds, row_id)

    def scored(s: int) -> tuple[float, Network | None]:
        if folds is None:
            made = fit(df, recipe, target, row_id=row_id, seed=s, **options)
            return (loss(made.predict(df).where(F.col(target).isNotNull()), target) if loss else made.losses[-1]), made
        total, count = 0.0, 0
        for k in sorted(r[0] for r in folds.select("fold").distinct().collect()):
            part = lambda p, k=k: df.join(folds.where((F.col("fold") == k) & (F.col("part") == p)).select(row_id).distinct(), row_id, "left_semi")
            made = fit(part("train"), recipe, target, row_id=row_id, seed=s, **options)
            total, count = total + loss(made.predict(part("validation")).where(F.col(target).isNotNull()), target), count + 1
        return total / count, None

    seeds = plan_seeds(seed, inits)
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        found = list(pool.map(scored, seeds))
    best = winner([s for s, _ in found])
    out = found[best][1] or fit(df, recipe, target, row_id=row_id, seed=seeds[best], **options)
    if keep == "members":
        out.members = [m for _, m in found if m is not None] or [out]
    return out

