"""Starting points: k-means++ by races, projectors, and transitions of hidden blocks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import arrays as A


def sub_seed(root: int, name: str) -> int:
    """A seed for a named part, from 8 bytes of BLAKE2b, within 63 bits."""
    return int.from_bytes(hashlib.blake2b(f"{root}:{name}".encode(), digest_size=8).digest(), "big") >> 1


def uniform(row: Column, *salt: int) -> Column:
    """A uniform number in (0, 1) for a row, the same wherever and whenever it is formed."""
    return (F.shiftrightunsigned(F.xxhash64(row, *[F.lit(s) for s in salt]), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def dissimilarity(width: int, W: np.ndarray, seed_x: list[float], seed_codes: list[int]) -> Column:
    """What a row is away from a seed: weighted square distance, and the price of a share of nothing for each level that differs."""
    out = A.sq_distance(F.col("x"), seed_x, W[:width].tolist()) if width else F.lit(0.0)
    miss = -math.log(A.TINY)
    for j, c in enumerate(seed_codes):
        out = out + F.when(F.element_at("codes", j + 1) == c, F.lit(0.0)).otherwise(F.lit(miss * float(W[width + j])))
    return F.greatest(out, F.lit(0.0))


def nearest(width: int, W: np.ndarray, drawn: list) -> Column:
    """The least dissimilarity to the seeds drawn so far, 1 before the first."""
    return F.least(*[dissimilarity(width, W, d["x"], d["codes"]) for d in drawn], F.lit(float("inf"))) if drawn else F.lit(1.0)


def potentials(rows: DataFrame, near: Column, options: list, width: int, W: np.ndarray) -> DataFrame:
    """(p0, p1, ...): what each option would leave of the weighted dissimilarity, in one aggregate."""
    return rows.agg(*[F.sum(F.col("w") * F.least(near, dissimilarity(width, W, o["x"], o["codes"]))).alias(f"p{i}") for i, o in enumerate(options)])


_P1, _P2, _P3, _P5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hashed(seed: np.ndarray, salt: int) -> np.ndarray:
    """Spark's xxhash64 of a whole number (32 bits) on top of hashes (uint64)."""
    h = (seed + _P5 + np.uint64(4)) ^ (np.uint64(salt) * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def uniforms(h: np.ndarray, *salt: int) -> np.ndarray:
    """uniform() of rows whose hash so far is h (int64), salted further."""
    with np.errstate(over="ignore"):
        h = h.view(np.uint64)
        for s in salt:
            h = _hashed(h, s)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _away(rows, width: int, W: np.ndarray, seed: tuple) -> np.ndarray:
    """dissimilarity() of a block of rows."""
    out = (rows.x - seed[0]) ** 2 @ W[:width]
    for j, c in enumerate(seed[1]):
        out = out + np.where(rows.codes[:, j] == c, 0.0, -math.log(A.TINY) * float(W[width + j]))
    return out


def kmeanspp(measured: Callable, K: int, W: np.ndarray, width: int, candidates: int | None, balanced: bool) -> tuple[np.ndarray, np.ndarray]:
    """(centres, codes) of K rows drawn in turn with chance w * D2 to the nearest one drawn.

    A draw is a race: the row with the least -ln(u) / chance wins, which is one minimum over all
    rows and needs no order. With several candidates the one that leaves the least D2 is kept.
    measured(of_rows) is what of_rows makes of each block of rows; h is what rows are drawn by.
    """
    tries = candidates or 2 + int(math.log(K))

    def classes(rows) -> dict[int, tuple[int, float]]:
        of, has = rows.q.argmax(1), rows.q.sum(1) > 0
        return {int(c): (int((on := has & (of == c)).sum()), float(rows.w[on].sum())) for c in np.unique(of[has])}

    pools: list[int | None] = [None] * K
    if balanced:
        from lattica.operators.guess import allocate_seeds

        groups: dict[int, tuple[int, float]] = {}
        for some in measured(classes):
            for c, (n, m) in some.items():
                groups[c] = (groups[c][0] + n, groups[c][1] + m) if c in groups else (n, m)
        pools = [c for c, n in allocate_seeds(groups, K).items() for _ in range(n)]

    drawn: list[tuple] = []  # x, codes and h of each

    def near(rows) -> np.ndarray:
        out = np.ones(len(rows.x))
        for j, d in enumerate(drawn):
            out = np.minimum(out, _away(rows, width, W, d)) if j else _away(rows, width, W, d)
        return out

    def race(pool: int | None, k: int, runs: int, anyone: bool) -> list[tuple]:
        """The winners of runs races: by chance, or (anyone) of all that were not drawn."""

        def winners(rows) -> list[tuple | None]:
            chance = np.where(np.isin(rows.h, [d[2] for d in drawn]), 0.0, 1.0) if anyone else rows.w * near(rows)
            on = chance > 0
            if pool is not None:
                on &= (rows.q.sum(1) > 0) & (rows.q.argmax(1) == pool)
            at, out = np.flatnonzero(on), []
            for i in range(runs if len(at) else 0):
                time = -np.log(uniforms(rows.h[at], k, i)) / chance[at]
                first = at[time == time.min()]
                out.append(min((float(time.min()), rows.x[t].tolist(), rows.codes[t].tolist(), int(rows.h[t])) for t in first))
            return out

        best: list[tuple] = []
        for some in measured(winners):
            best = [min(a, b) for a, b in zip(best, some, strict=True)] if best and some else best or some
        return [(np.array(x, float), codes, h) for _, x, codes, h in best]

    for k, pool in enumerate(pools):
        options = race(pool, k, tries if drawn else 1, False) or race(pool, k, 1, True)
        if not options:
            break
        if len(options) > 1:

            def left(rows, options: list = options, pool: int | None = pool) -> np.ndarray:
                """What each option would leave of the weighted dissimilarity."""
                now, w = near(rows), rows.w if pool is None else rows.w * ((rows.q.sum(1) > 0) & (rows.q.argmax(1) == pool))
                return np.array([w @ np.minimum(now, _away(rows, width, W, o)) for o in options])

            options = [options[int(np.argmin(sum(measured(left))))]]
        drawn.append(options[0])
    return np.array([d[0] for d in drawn], float).reshape(len(drawn), -1), np.array([d[1] for d in drawn], int).reshape(len(drawn), -1)


def projectors(staged: DataFrame, centres: np.ndarray, d: int) -> np.ndarray:
    """Leading directions of the rows nearest to each centre, about the centre, completed from the axes."""
    K, width = centres.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((K, width, width))
        for b in batches:
            x = np.stack(b["x"].to_numpy()).astype(float) if len(b) else np.empty((0, width))
            near = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1) if len(x) else np.empty(0, int)
            for k in np.unique(near):
                away = x[near == k] - centres[k]
                total[k] += away.T @ away
        yield pd.DataFrame({"k": range(K), "part": [t.tobytes() for t in total]})

    def merge(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            for x in b["part"]:
                total += np.frombuffer(x).reshape(width, width)
        yield pd.DataFrame({"k": [key[0]], "part": [total.tobytes()]})

    out = np.zeros((K, width, d))
    scatter = np.zeros((K, width, width))
    for r in staged.select("x").mapInPandas(partial, "k int, part binary").groupBy("k").applyInPandas(merge, "k int, part binary").collect():  # a matrix a centre
        scatter[r["k"]] = np.frombuffer(r["part"]).reshape(width, width)
    for k in range(len(centres)):
        values, vectors = np.linalg.eigh(scatter[k])
        rank = int((values > max(values.max(initial=0), 0) * 1e-12).sum()) if values.max(initial=0) > 0 else 0
        basis = [vectors[:, -1 - j] for j in range(min(rank, d))]
        for axis in np.eye(width):  # directions that the rows do not give
            for _ in range(2):
                for b in basis:
                    axis = axis - (axis @ b) * b
            if len(basis) < d and np.linalg.norm(axis) > 0.5 / width:
                basis.append(axis / np.linalg.norm(axis))
        for j, b in enumerate(basis[:d]):
            out[k, :, j] = b * np.sign(b[np.abs(b).argmax()] or 1)
    return out


#: Geometric groupings that are tried beside the merges.
GEOMETRIC_DRAWS = 8


def _label_loss(v: np.ndarray) -> float:
    s = v.sum()
    p = v / s if s > 0 else v
    return float(-s * (p[p > 0] * np.log(p[p > 0])).sum())


def grouping_loss(group: np.ndarray, labels: np.ndarray, masses: np.ndarray, regression: bool) -> float:
    """What the labels cost if clusters of one group share a prediction, from their sums alone."""
    onto = np.eye(group.max() + 1)[:, group]
    sums, mass = onto @ labels, np.maximum(onto @ masses, A.TINY)
    return -float((sums**2 / mass[:, None]).sum()) if regression else sum(_label_loss(v) for v in sums)


def group_source(points: np.ndarray, masses: np.ndarray, groups: int, rng: np.random.Generator) -> np.ndarray:
    """Group of each cluster by the nearest of several representatives, drawn in turn by mass times square distance; each represents itself."""
    chosen: list[int] = []
    for _ in range(min(groups, len(points))):
        near = np.min([((points - points[c]) ** 2).sum(1) for c in chosen], axis=0) if chosen else np.ones(len(points))
        chance = masses * near
        chance[chosen] = 0.0
        if chance.sum() <= 0:  # nothing but copies is left
            chance = np.ones(len(points))
            chance[chosen] = 0.0
        chosen.append(int(rng.choice(len(points), p=chance / chance.sum())))
    group = np.argmin([((points - points[c]) ** 2).sum(1) for c in chosen], axis=0)
    group[chosen] = np.arange(len(chosen))
    return group


def best_grouping(labels: np.ndarray, masses: np.ndarray, points: np.ndarray, groups: int, weights: tuple[float, ...], regression: bool, seed: int) -> np.ndarray:
    """Of a merge for each weight of geometry and several geometric draws, the grouping whose labels cost least; earlier ones win ties, merges first."""
    made = [merge_groups(labels, masses, points, groups, w, regression) for w in weights]
    made += [group_source(points, masses, groups, np.random.default_rng(sub_seed(seed, f"group{i}"))) for i in range(GEOMETRIC_DRAWS)]
    return min(made, key=lambda g: grouping_loss(g, labels, masses, regression))


def merge_groups(labels: np.ndarray, masses: np.ndarray, points: np.ndarray, groups: int, geometry: float, regression: bool) -> np.ndarray:
    """Group of each cluster after merging pairs of least rise in label loss plus geometry * Ward cost."""
    sums, mass, centre = labels.copy(), masses.copy(), points.copy()
    live, group = list(range(len(mass))), np.arange(len(mass))

    def rise(a: int, b: int) -> float:
        ward = mass[a] * mass[b] / max(mass[a] + mass[b], A.TINY)
        if regression:
            apart = sums[a] / max(mass[a], A.TINY) - sums[b] / max(mass[b], A.TINY)
            label = ward * float(apart @ apart)
        else:
            label = _label_loss(sums[a] + sums[b]) - _label_loss(sums[a]) - _label_loss(sums[b])
        return max(label, 0.0) + geometry * ward * float(((centre[a] - centre[b]) ** 2).sum())

    while len(live) > groups:
        a, b = min(((a, b) for i, a in enumerate(live) for b in live[i + 1 :]), key=lambda ab: rise(*ab))
        whole = max(mass[a] + mass[b], A.TINY)
        centre[a] = (mass[a] * centre[a] + mass[b] * centre[b]) / whole
        sums[a], mass[a] = sums[a] + sums[b], mass[a] + mass[b]
        live.remove(b)
        group[group == group[b]] = group[a]
    return np.searchsorted(sorted(set(group)), group)


def connect(run, staged: DataFrame, s0: dict, p, seed: int = 0) -> None:
    """Transitions into the hidden blocks: identity, the best of label-aware merges and geometric groupings, or spread profiles."""
    mass = np.maximum(s0["m"], A.TINY)
    labels = (s0["head"] if "head" in s0 else _label_sums(run, p)).T
    points = np.hstack([p.C * np.sqrt(p.W[: p.C.shape[1]] if len(p.W) else 1.0), *[q * np.sqrt(p.W[p.C.shape[1] + j]) for j, q in enumerate(p.P)]])
    for n, theta in enumerate(p.thetas):
        to, of = theta.shape
        if to == of:
            group = np.arange(of)
        elif to < of:
            weights = (1e-3, 1.0) if n == len(p.thetas) - 1 else (1.0,)
            group = best_grouping(labels, mass, points, to, weights, p.regression, sub_seed(seed, f"hidden{n}"))
        else:
            group = np.arange(of)
        made = np.full((to, of), 0.05 / to)
        made[group, np.arange(of)] += 0.95
        if to > of:  # each further target leans to one source
            for t in range(of, to):
                made[t, t % of] += 0.5
        p.thetas[n] = made / made.sum(0 if run.axes[n] == 0 else 1, keepdims=True)
        onto = np.zeros((to, of))
        onto[group, np.arange(of)] = 1
        labels, points = onto @ labels, onto @ (points * mass[:, None]) / np.maximum(onto @ mass, A.TINY)[:, None]
        mass = onto @ mass


def _label_sums(run, p) -> np.ndarray:
    """Target sums by input cluster, from one pass over the stored shares."""
    k = len(p.C)
    q = run.state.select("q", F.slice("s", 1, k).alias("g")).select(F.posexplode("q").alias("m", "v"), "g").select("m", "v", F.posexplode("g").alias("k", "h"))
    out = np.zeros((len(p.out), k))
    for r in q.groupBy("m", "k").agg(F.sum(F.col("v") * F.col("h")).alias("s")).collect():
        out[r["m"], r["k"]] = r["s"]
    return out
