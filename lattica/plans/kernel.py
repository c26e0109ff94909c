"""Block kernels in NumPy: what one batch of rows adds to the sums of a scan, and their updates.

A fit is a fixed-point iteration of scans. Each scan refreshes the shares of one block for every
row and sums what the following updates need; sums are as large as the parameters. Updates run on
the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

TINY, EPS = np.finfo(np.float64).tiny, np.finfo(np.float64).eps
#: Levels up to which counts are a product of matrices.
FEW_LEVELS = 16


def floored(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, TINY))


def normalised(p: np.ndarray, axis: int) -> np.ndarray:
    s = p.sum(axis, keepdims=True)
    return np.where(s <= TINY, 1.0 / p.shape[axis], p / np.maximum(s, TINY))


def assign(cost: np.ndarray, temperature: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Rows of shares: softmax of -cost / (temperature * weight), or one-hot at the first minimum."""
    if temperature == 0:
        out = np.zeros_like(cost)
        out[np.arange(len(cost)), cost.argmin(1)] = 1
        return out
    by = temperature if weight is None else np.maximum(temperature * weight, TINY)[:, None]
    low = cost[:, :1].copy()  # by columns, of which there are few: a reduction of short rows costs many times as much
    for k in range(1, cost.shape[1]):
        np.minimum(low, cost[:, k : k + 1], out=low)
    e = np.exp((low - cost) / by)
    e /= e.sum(1, keepdims=True)
    return e if np.isfinite(low).all() else np.where(np.isfinite(low), e, 1.0 / cost.shape[1])


def entropies(p: np.ndarray) -> np.ndarray:
    return -(p * np.log(np.where(p > 0, p, 1))).sum(1)


@dataclass
class Params:
    """Everything that a scan needs; small, and sent to every task."""

    C: np.ndarray
    W: np.ndarray  # feature weights, continuous first
    P: list[np.ndarray] = field(default_factory=list)  # (K, levels) of each categorical feature
    scales: list[float] = field(default_factory=list)
    thetas: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None  # (classes, K) or (outputs, K)
    W_M: np.ndarray | None = None
    U: np.ndarray | None = None  # (K, D, d) bases of a manifold input
    alpha: float = 0.0
    epsilons: list[float] = field(default_factory=list)  # of the input and the hidden blocks
    deltas: list[float] = field(default_factory=list)  # into the hidden blocks, then the head
    epsilon_T: float = math.inf
    shift: float = 0.0  # of the exponent of instance weights
    mass: float = 1.0  # their sum
    regression: bool = False

    @property
    def widths(self) -> list[int]:
        return [len(self.C), *(len(t) for t in self.thetas)]

    def distances(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        n, d = self.C.shape
        if self.U is not None:
            away = x[:, None, :] - self.C[None]
            along = np.einsum("tkd,kdp->tkp", away, self.U)
            return ((1 + self.alpha) * (away**2).sum(2) - (along**2).sum(2)) / d
        w = self.W[:d]
        cost = (x**2 @ w)[:, None] - 2 * (x * w) @ self.C.T + (self.C**2 @ w)[None] if d else np.zeros((len(x), n))
        for j, (p, s) in enumerate(zip(self.P, self.scales, strict=True)):
            cost = cost - self.W[d + j] * s * floored(p).T[codes[:, j]]
        return cost


@dataclass
class Rows:
    """A batch: features, target sums (q: weighted classes, or y with omega), weight and state."""

    x: np.ndarray
    codes: np.ndarray
    q: np.ndarray
    omega: np.ndarray
    w: np.ndarray
    u: np.ndarray
    gammas: list[np.ndarray]
    d: np.ndarray | None = None  # distances, once they are known
    h: np.ndarray | None = None  # a hash of each row's id, that it is drawn by


def outgoing(p: Params, rows: Rows, n: int) -> np.ndarray:
    last = len(p.thetas)
    if n < last:
        return -p.deltas[n] * rows.w[:, None] * (rows.gammas[n + 1] @ floored(p.thetas[n]))
    if not p.regression:
        return -p.deltas[-1] * rows.q @ floored(p.out)
    weight = p.W_M if p.W_M is not None else np.full(len(p.out), 1 / len(p.out))
    return p.deltas[-1] * rows.omega[:, None] * ((weight @ p.out**2)[None] - 2 * (rows.q * weight) @ p.out)


def advance(p: Params, rows: Rows, n: int, coupled: bool = True) -> None:
    """Refresh block n of the rows in place."""
    if n:
        cost = -p.deltas[n - 1] * rows.w[:, None] * (rows.gammas[n - 1] @ floored(p.thetas[n - 1]).T)
        rows.gammas[n] = assign(cost + outgoing(p, rows, n), p.epsilons[n], rows.w)
        return
    d = rows.d = p.distances(rows.x, rows.codes)
    cost = (rows.u / p.mass)[:, None] * d
    rows.gammas[0] = assign(cost + outgoing(p, rows, 0) if coupled else cost, p.epsilons[0], rows.w)
    if math.isfinite(p.epsilon_T):
        b = (rows.gammas[0] * d).sum(1)
        rows.u = rows.w * np.exp(np.clip(-(b - p.shift) / p.epsilon_T, -700, 700)) if coupled else rows.w


def sums(p: Params, rows: Rows, n: int) -> dict[str, np.ndarray]:
    """What the rows add after block n was refreshed."""
    g = rows.gammas[n]
    out = {"count": np.array([len(g)]), "alive": g.sum(0), "entropy": np.array([(rows.w * entropies(g)).sum()])}
    if n:
        out["A"] = g.T @ (rows.w[:, None] * rows.gammas[n - 1])
    if n < len(p.thetas):
        out["next"] = rows.gammas[n + 1].T @ (rows.w[:, None] * g)
    else:
        out["head"] = (rows.omega[:, None] * rows.q).T @ g if p.regression else rows.q.T @ g
        if p.regression:
            out |= {"omega": rows.omega @ g, "y2": rows.omega @ rows.q**2, "y1": rows.omega @ rows.q, "y0": np.array([rows.omega.sum()])}
    if n == 0:
        d = p.distances(rows.x, rows.codes) if rows.d is None else rows.d
        b = (g * d).sum(1)
        gu = g * rows.u[:, None]
        out |= {"m": gu.sum(0), "N": gu.T @ rows.x, "S2": rows.u @ rows.x**2, "u": np.array([rows.u.sum()]), "ub": np.array([(rows.u * (b - p.shift)).sum()]), "b": np.array([b.min(initial=np.inf)])}
        for j, q in enumerate(p.P):
            if q.shape[1] <= FEW_LEVELS:
                counts = (rows.codes[:, j, None] == np.arange(q.shape[1])).astype(float).T @ gu
            else:
                counts = np.zeros((q.shape[1], len(q)))
                np.add.at(counts, rows.codes[:, j], gu)
            out[f"c{j}"] = counts.T
        if p.U is not None:
            out["SS"] = np.einsum("tk,td,te->kde", gu, rows.x, rows.x)
    return out


def merged(a: dict[str, np.ndarray] | None, b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return b if a is None else {k: np.minimum(a[k], v) if k == "b" else a[k] + v for k, v in b.items()}


def leading(cov: np.ndarray, d: int) -> np.ndarray:
    """Orthonormal leading directions of each covariance, after scaling to a unit diagonal and a ridge."""
    top = np.maximum(np.einsum("kdd->kd", cov).max(1), TINY)[:, None, None]
    _, v = np.linalg.eigh(cov / top + EPS * np.eye(cov.shape[1]))
    return np.linalg.qr(v[:, :, ::-1][:, :, :d])[0]
