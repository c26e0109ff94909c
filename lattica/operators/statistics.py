"""Grouped sums that every parameter update is made of, association measures, draws and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import arrays as A


def cluster_sums(df: DataFrame, gamma: str, x: str, weight: Column) -> DataFrame:
    """(k, d, mass, first, second): sums of gamma * w, and of it times x and x squared.

    Rows are spread over k and d inside the task and summed there before anything moves, so the
    exchange carries one row for each (k, d) and task.
    """
    spread = df.select(weight.alias("_w"), x, F.posexplode(gamma).alias("k", "_g")).select("k", (F.col("_g") * F.col("_w")).alias("_m"), F.posexplode(x).alias("d", "_x"))
    return spread.groupBy("k", "d").agg(F.sum("_m").alias("mass"), F.sum(F.col("_m") * F.col("_x")).alias("first"), F.sum(F.col("_m") * F.col("_x") * F.col("_x")).alias("second"))


def masses(df: DataFrame, gamma: str, weight: Column | None = None) -> DataFrame:
    return df.select((F.lit(1.0) if weight is None else weight).alias("_w"), F.posexplode(gamma).alias("k", "_g")).groupBy("k").agg(F.sum(F.col("_g") * F.col("_w")).alias("mass"))


def survivors(df: DataFrame, gamma: str) -> DataFrame:
    """Clusters whose unweighted mass is above nothing."""
    return masses(df, gamma).select("k", "mass", (F.col("mass") > A.TINY).alias("alive"))


def centroids(sums: DataFrame) -> DataFrame:
    """first / mass; a cluster without mass lies at zero."""
    return sums.select("k", "d", F.when(F.col("mass") <= A.TINY, F.lit(0.0)).otherwise(F.col("first") / F.greatest("mass", F.lit(A.TINY))).alias("value"))


def level_shares(df: DataFrame, gamma: str, code: str, weight: Column, levels: int) -> DataFrame:
    """(k, level, share): what each cluster gives each level; uniform without mass."""
    counts = df.select(code, weight.alias("_w"), F.posexplode(gamma).alias("k", "_g")).groupBy("k", code).agg(F.sum(F.col("_g") * F.col("_w")).alias("n"))
    dense = counts.groupBy("k").agg(*[F.coalesce(F.sum(F.when(F.col(code) == m, F.col("n"))), F.lit(0.0)).alias(f"n{m}") for m in range(levels)])
    out = dense.select("k", A.normalise(F.array(*[F.col(f"n{m}") for m in range(levels)])).alias("s"))
    return out.select("k", F.posexplode("s").alias("level", "share"))


def group_means(df: DataFrame, group: str, groups: int, values: Sequence[str], weight: Column) -> DataFrame:
    """Weighted means by group for every group; an empty group has the mean of all."""
    sums = [F.sum(weight).alias("_m"), *[F.sum(weight * F.col(v)).alias(f"_{v}") for v in values]]
    every = df.agg(*sums).select(*[(F.col(f"_{v}") / F.col("_m")).alias(f"all_{v}") for v in values])
    wanted = df.sparkSession.range(groups).select(F.col("id").cast("int").alias(group)).join(F.broadcast(every))  # one row of means beside each of a few groups
    found = df.groupBy(group).agg(*sums)
    return wanted.join(found, group, "left").select(group, *[F.when(F.col("_m") > A.TINY, F.col(f"_{v}") / F.col("_m")).otherwise(F.col(f"all_{v}")).alias(v) for v in values])


def transition_counts(df: DataFrame, target: str, source: str, weight: Column) -> DataFrame:
    """(t, s, n): weighted co-occurrence of two blocks' shares."""
    spread = df.select(weight.alias("_w"), source, F.posexplode(target).alias("t", "_t")).select("t", (F.col("_t") * F.col("_w")).alias("_m"), F.posexplode(source).alias("s", "_s"))
    return spread.groupBy("t", "s").agg(F.sum(F.col("_m") * F.col("_s")).alias("n"))


def transitions(counts: DataFrame, over: str, pseudocount: float = 0.0) -> DataFrame:
    """(t, s, share): counts and a prior, normalised over targets (M) or sources (S)."""
    w = Window.partitionBy("s" if over == "M" else "t")  # as many rows as the parameters, not as the data
    n = F.col("n") + pseudocount
    mass, count = F.sum(n).over(w), F.count("*").over(w)
    return counts.select("t", "s", F.when(mass <= A.TINY, F.lit(1.0) / count).otherwise(n / F.greatest(mass, F.lit(A.TINY))).alias("share"))


def log_partition(df: DataFrame, cost: str, temperature: float) -> DataFrame:
    """(least, log_partition): min b and log of the sum of exp(-(b - min) / temperature), from two aggregates."""
    least = df.agg(F.min(cost).alias("least"))
    return df.join(F.broadcast(least)).groupBy("least").agg(F.ln(F.sum(F.exp(-(F.col(cost) - F.col("least")) / temperature))).alias("log_partition"))


def entropy_penalty(df: DataFrame, gamma: str, weight: Column, temperature: float) -> DataFrame:
    """(value): minus the temperature times the weighted mean entropy of rows of shares."""
    return df.agg((-F.lit(temperature) * F.sum(weight * A.entropy(F.col(gamma))) / F.sum(weight)).alias("value"))


def ecdf(reference: DataFrame, query: DataFrame, key: str, value: str, bins: int = 4096) -> DataFrame:
    """(key, share of reference values at or below the query's).

    Values are counted first, so equal ones are one row, and the counts are summed in two steps:
    within ranges of values that are dealt over tasks (as many as there are partitions, at most
    ``bins``), and over the ranges. No task holds all values.
    """
    bins = min(bins, max(64, int(query.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    both = reference.select(F.col(value).alias("v"), F.lit(1).alias("n"))
    if query is not reference:
        both = both.unionByName(query.select(F.col(value).alias("v"), F.lit(0).alias("n")))
    edges = reference.select(F.percentile_approx(value, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("v"))) if edges else F.lit(0)
    both = both.withColumn("bucket", bucket)
    below = both.groupBy("bucket").agg(F.sum("n").alias("m"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    below = below.select("bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    size = reference.count()
    values = both.groupBy("bucket", "v").agg(F.sum("n").alias("n")).withColumn("within", F.sum("n").over(within)).join(F.broadcast(below), "bucket")
    shares = values.select(F.col("v").alias("its_v"), ((F.col("before") + F.col("within")) / float(max(size, 1))).alias("share"))
    return query.select(key, F.col(value).alias("v")).join(shares, F.col("v").eqNullSafe(F.col("its_v"))).select(key, "share")


def weighted_draws(df: DataFrame, key: str, weight: str, uniforms: Sequence[float], buckets: int = 64) -> DataFrame:
    """(draw, key): for each u the first row in key order whose cumulative weight exceeds u * total; the last weighted row at the end.

    Weights are summed by ranges of keys first (a few rows), then inside the one range that a
    draw falls in, so no task orders all rows.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.select(F.lit(0).alias("draw"), key).limit(0)
    width = (high - low) // buckets + 1
    ranged = df.withColumn("_b", F.floor((F.col(key) - low) / width).cast("int"))
    sums = {r["_b"]: r["s"] for r in ranged.groupBy("_b").agg(F.sum(weight).alias("s")).collect()}
    whole, at, wanted = sum(sums[b] for b in sorted(sums)), 0.0, []
    last = max((b for b in sums if sums[b] > 0), default=None)
    starts = {}
    for b in sorted(sums):
        starts[b], at = at, at + sums[b]
    for i, u in enumerate(uniforms):
        hit = next((b for b in sorted(sums) if starts[b] + sums[b] > u * whole), last)
        if hit is not None:
            wanted.append((i, hit, u * whole - starts[hit]))
    wanted_df = df.sparkSession.createDataFrame(wanted, "draw int, _b int, need double")
    within = Window.partitionBy("_b").orderBy(key)
    inside = ranged.where(F.col("_b").isin(sorted({b for _, b, _ in wanted}))).withColumn("_c", F.sum(weight).over(within)).where(F.col(weight) > 0)
    joined = inside.join(F.broadcast(wanted_df), "_b")
    return joined.groupBy("draw").agg(F.coalesce(F.min(F.when(F.col("_c") > F.col("need"), F.col(key))), F.max(key)).alias(key))


def correlation_ratio(df: DataFrame, value: str, group: str) -> DataFrame:
    """sqrt of the share of variance between groups, 0 to 1; 0 where there is none. Moments are taken about means, so an offset costs no digits."""
    by = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    middle = by.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("middle"))
    away = F.col("m") - F.col("middle")
    sums = by.join(F.broadcast(middle)).agg(F.sum(F.col("n") * away * away).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))  # one row of means beside each group
    every = F.col("between") + F.col("within")
    return sums.select(F.when(every <= 1e-12, F.lit(0.0)).otherwise(F.sqrt(F.least(F.greatest(F.col("between") / F.nullif(every, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))).alias("value"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cramer's V without correction; 0 with fewer than two levels on a side."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    # chi2 / n = sum n_ab^2 / (n_a n_b) - 1, so empty cells need no rows
    sums = cells.join(rows, "a").join(cols, "b").agg((F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))) - 1).alias("phi"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    small = F.least("r", "c") - 1
    return sums.select(F.when(small < 1, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.col("phi"), F.lit(0.0)) / F.greatest(small, F.lit(1)))).alias("value"))


def absolute_pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    r = F.corr(a, b)
    return df.agg(F.coalesce(F.when(F.isnan(r), F.lit(0.0)).otherwise(F.abs(r)), F.lit(0.0)).alias("value"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two discrete columns, in nats."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    whole = cells.agg(F.sum("n").alias("t"))
    joined = cells.join(rows, "a").join(cols, "b").join(F.broadcast(whole))
    return joined.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("value"))


def accuracy(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("value"))


def log_loss(df: DataFrame, code: str, shares: str) -> DataFrame:
    p = F.element_at(shares, F.col(code) + 1)
    return df.agg(F.avg(-F.ln(F.least(F.greatest(p, F.lit(A.EPS)), F.lit(1 - A.EPS)))).alias("value"))


def r2(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """1 - SSE / SST in one pass; the variance is taken about the mean, so an offset costs no digits."""
    t, e = F.col(truth), F.col(truth) - F.col(guess)
    sums = df.agg(F.avg(F.when(e.isNotNull(), e * e)).alias("e"), F.var_pop(F.when(e.isNotNull(), t)).alias("v"))
    return sums.select(F.when(F.col("v") <= 0, F.lit(0.0)).otherwise(1 - F.col("e") / F.nullif("v", F.lit(0.0))).alias("value"))
