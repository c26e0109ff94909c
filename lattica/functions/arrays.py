"""Row-local mathematics as Column expressions over array<double> columns.

Everything here stays inside Spark's engine: no Python runs on rows. Small parameters
(centroids, transitions, weights) enter as literals.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Machine precision and the smallest positive normal number of a double.
EPS, TINY = 2.220446049250313e-16, 2.2250738585072014e-308

Vector = Sequence[float]
Matrix = Sequence[Sequence[float]]


def is_soft(temperature: float) -> bool:
    """A positive temperature is soft and zero is hard; nothing lies between."""
    return temperature > 0


def vector(values: Vector) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column | Vector) -> Column:
    return total(F.zip_with(a, b if isinstance(b, Column) else vector(b), lambda x, y: x * y))


def scaled_ratio(value: Column, numerator: Column, denominator: Column) -> Column:
    """value * numerator / denominator where the ratio alone would overflow or vanish: exponents are taken apart."""
    log = F.log(F.abs(value)) + F.log(F.abs(numerator)) - F.log(F.abs(denominator))
    ratio = F.abs(numerator) / F.nullif(F.abs(denominator), F.lit(0.0))
    direct = value * (numerator / F.nullif(denominator, F.lit(0.0)))
    plain = (ratio > TINY) & (ratio < 1.0 / TINY)
    return F.when((value == 0) | (numerator == 0), F.lit(0.0)).when(plain, direct).otherwise(F.signum(value) * F.signum(numerator) * F.signum(denominator) * F.exp(log))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a Column used twice in an expression is computed twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise(values: Column) -> Column:
    """Divide by the sum; without mass the result is uniform."""

    def shared(v: Column) -> Column:
        return let(total(v), lambda mass: F.transform(v, lambda x: F.when(mass <= TINY, F.lit(1.0) / F.size(v)).otherwise(x / F.greatest(mass, F.lit(TINY)))))

    return let(values, shared)


def floored_log(p: Column) -> Column:
    return F.ln(F.greatest(p, F.lit(TINY)))


def softmax(cost: Column, temperature: float, weight: Column | None = None) -> Column:
    """Shares that fall with cost; weight scales a row's temperature. A minimum that is not finite gives uniform shares."""
    by = F.lit(float(temperature)) if weight is None else F.lit(float(temperature)) * weight

    def shared(c: Column) -> Column:
        return let(F.array_min(c), lambda low: let(F.transform(c, lambda v: F.exp(-(v - low) / by)), lambda each: let(total(each), lambda mass: chosen(low, each, mass))))

    def chosen(low: Column, each: Column, mass: Column) -> Column:
        fine = low.isNotNull() & ~F.isnan(low) & (F.abs(low) < float("inf"))
        return F.transform(each, lambda e: F.when(fine, e / mass).otherwise(F.lit(1.0) / F.size(each)))

    return let(cost, shared)


def first_least(cost: Column) -> Column:
    """The place of the first minimum, from 0."""
    return let(cost, lambda c: (F.array_position(c, F.array_min(c)) - 1).cast("int"))


def one_hot(code: Column, levels: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda m: F.when(code == m, F.lit(1.0)).otherwise(F.lit(0.0)))


def hard(cost: Column, levels: int) -> Column:
    return let(first_least(cost), lambda k: one_hot(k, levels))


def assign(cost: Column, temperature: float, levels: int, weight: Column | None = None) -> Column:
    """Soft shares at a positive temperature, one-hot at the first minimum at zero."""
    return softmax(cost, temperature, weight) if is_soft(temperature) else hard(cost, levels)


def entropy(p: Column) -> Column:
    return total(F.transform(p, lambda v: F.when(v > 0, -v * F.ln(v)).otherwise(F.lit(0.0))))


def effective_dimension(p: Column, share: bool = False) -> Column:
    """exp of the entropy: how many entries carry the mass; as a share of the size on request."""
    size = F.exp(entropy(p))
    return size / F.size(p) if share else size


def added(terms: Sequence[Column]) -> Column:
    """The sum of terms in their order, as total() forms it."""
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def unrolled(values: Column, matrix: Matrix) -> list[Column]:
    """What through() forms, an expression an entry, which Spark compiles. values: a plain column, since it is named for each use."""
    return [added([F.get(values, i) * F.lit(float(v)) for i, v in enumerate(row)]) for row in matrix]


def unrolled_distances(x: Column, centres: Matrix, weights: Vector) -> list[Column]:
    """What distances() forms, an expression a centre, which Spark compiles. x: a plain column."""
    apart = lambda i, v: F.get(x, i) - F.lit(float(v))
    return [added([apart(i, v) * apart(i, v) * F.lit(float(w)) for i, (v, w) in enumerate(zip(c, weights, strict=True))]) for c in centres]


def sq_norm(x: Column, weights: Vector | None = None) -> Column:
    return total(F.transform(x, lambda v: v * v)) if weights is None else dot(F.transform(x, lambda v: v * v), weights)


def sq_distance(x: Column, centre: Vector, weights: Vector | None = None) -> Column:
    apart = F.zip_with(x, vector(centre), lambda a, b: (a - b) * (a - b))
    return total(apart) if weights is None else dot(apart, weights)


def distances(x: Column, centres: Matrix, weights: Vector | None = None) -> Column:
    """The weighted squared distance to each centre."""
    return F.array(*[sq_distance(x, c, weights) for c in centres])


def level_scale(delta: float, levels: int) -> float:
    """What a categorical feature's cross-entropy counts for: delta * (1 - 1/M) / ln M."""
    return delta * (1 - 1 / levels) / math.log(levels)


def cross_entropy(code: Column, shares: Matrix, scale: float = 1.0) -> Column:
    """scale * -log of the share that each cluster gives to a code."""
    return F.array(*[F.element_at(vector([-scale * math.log(max(p, TINY)) for p in row]), code + 1) for row in shares])


def cross_entropy_of(shares_of_row: Column, shares: Matrix, scale: float = 1.0) -> Column:
    return F.array(*[dot(shares_of_row, [-scale * math.log(max(p, TINY)) for p in row]) for row in shares])


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def times(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda v: v * by)


def through(gamma: Column, matrix: Matrix) -> Column:
    """matrix (rows = targets) applied to a row of shares."""
    return let(gamma, lambda g: F.array(*[dot(g, row) for row in matrix]))


def logs(matrix: Matrix) -> list[list[float]]:
    return [[math.log(max(v, TINY)) for v in row] for row in matrix]


def turned(matrix: Matrix) -> list[list[float]]:
    return [list(c) for c in zip(*matrix, strict=True)]


def propagate(gamma: Column, theta: Matrix, delta: float, temperature: float) -> Column:
    """Shares of the next block from those of this one."""
    return assign(times(through(gamma, logs(theta)), F.lit(-float(delta))), temperature, len(theta))


def coupling_cost(gamma: Column, theta: Matrix, delta: float, weight: Column) -> Column:
    """What a neighbour's shares make each cluster cost, read along the rows of theta."""
    return times(through(gamma, logs(theta)), -float(delta) * weight)


def arithmetic_readout(gamma: Column, theta: Matrix) -> Column:
    return normalise(through(gamma, theta))


def geometric_readout(gamma: Column, theta: Matrix, delta: float, temperature: float) -> Column:
    """softmax of delta * Gamma log Theta' / temperature; first maximum at temperature 0."""
    return assign(times(through(gamma, logs(theta)), F.lit(-float(delta))), temperature, len(theta))


def gated(target: Column, weight: Column, labelled: Column) -> Column:
    return F.transform(target, lambda q: F.when(labelled, q * weight).otherwise(F.lit(0.0)))


def recovered_weight(cost: Column, least: float, temperature: float, log_partition: float) -> Column:
    """A query row's instance weight against the training rows, at most 1."""
    return F.least(F.lit(1.0), F.exp((F.lit(float(least)) - cost) / float(temperature) - float(log_partition)))
