"""Staging: scaled features, codes, targets and normalised weights, with validation by one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import arrays as A


#: Levels up to which a code is searched for in a literal array.
SEARCHED = 64


@dataclass(frozen=True)
class Layout:
    """Continuous columns with their bounds, and categorical columns with their sorted levels."""

    continuous: tuple[tuple[str, float, float], ...]
    categorical: tuple[tuple[str, tuple], ...]
    dropped: tuple[str, ...] = ()

    @property
    def levels(self) -> list[int]:
        return [len(v) for _, v in self.categorical]


def scaled(column: str, low: float, high: float) -> Column:
    """A value between its bounds as 0 to 1; a constant column is 0 throughout (and missing values stay missing)."""
    value = F.col(column).cast("double")
    return (value - low) / (high - low) if high > low else value * 0.0


def code_of(column: str, levels: Sequence) -> Column:
    """The place of a value among its sorted levels, -1 if unseen or missing."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column)) - 1, F.lit(-1)).cast("int")


def bounds(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, float, float]]:
    row = df.agg(*[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).first()
    return [(c, row[f"min_{c}"], row[f"max_{c}"]) for c in columns]


def fit_layout(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str], most_levels: int = 100_000) -> Layout:
    """Bounds and vocabularies; a categorical column with a single level is dropped."""
    found = []
    for c in categorical:
        if df.where(F.col(c).isNull()).limit(1).count():
            raise ValueError(f"{c} has missing values")
        levels = [r[0] for r in df.select(c).distinct().orderBy(c).limit(most_levels + 1).collect()]
        if len(levels) > most_levels:
            raise ValueError(f"{c} has more than {most_levels} levels")
        found.append((c, tuple(levels)))
    return Layout(tuple(bounds(df, continuous)) if continuous else (), tuple(x for x in found if len(x[1]) > 1), tuple(c for c, v in found if len(v) < 2))


def replay_layout(df: DataFrame, layout: Layout) -> DataFrame:
    """df with x (array<double>) and codes (array<int>); a code of -1 marks what the layout has not seen.

    Few levels are found in a literal array; a longer vocabulary is joined (it is bounded by
    fit_layout, and broadcast), so that a row costs one lookup and not a search.
    """
    placed = {}
    for j, (c, v) in enumerate(layout.categorical):
        placed[c] = code_of(c, v)
        if len(v) > SEARCHED:
            known = df.sparkSession.createDataFrame(list(enumerate(v)), f"_code{j} int, _level{j} {df.schema[c].dataType.simpleString()}")
            df = df.join(F.broadcast(known), F.col(c) == F.col(f"_level{j}"), "left").drop(f"_level{j}")
            placed[c] = F.coalesce(F.col(f"_code{j}"), F.lit(-1))
    x = F.array(*[scaled(c, a, b) for c, a, b in layout.continuous]) if layout.continuous else F.array().cast("array<double>")
    codes = F.array(*[placed[c] for c, _ in layout.categorical]) if layout.categorical else F.array().cast("array<int>")
    return df.withColumns({"x": x, "codes": codes}).drop(*[f"_code{j}" for j in range(len(layout.categorical))])


def checked(staged: DataFrame, layout: Layout) -> DataFrame:
    """staged, whose rows raise an error when they are read if a feature is missing or not finite, or a level was not seen; row-local, so it holds for streams."""
    bad_x = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    unseen = F.exists("codes", lambda c: c < 0)
    fine = F.when(bad_x, F.raise_error(F.lit("a row has features that are missing or not finite")).cast("array<double>")).when(unseen, F.raise_error(F.lit("a row has a level that the layout has not seen")).cast("array<double>")).otherwise(F.col("x"))
    return staged.withColumn("x", fine)


def defects(staged: DataFrame, levels: Sequence[int], width: int) -> DataFrame:
    """(n, x, code0, ...): rows, rows whose features are missing, not finite or of another width, and rows with a level out of range by feature."""
    bad_x = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    bad_code = [F.count_if((F.element_at("codes", j + 1) < 0) | (F.element_at("codes", j + 1) >= m)).alias(f"code{j}") for j, m in enumerate(levels)]
    return staged.agg(F.count("*").alias("n"), F.count_if(bad_x | (F.size("x") != width)).alias("x"), *bad_code)


def code_ranges(df: DataFrame, codes: Sequence[str]) -> DataFrame:
    """(low_c, high_c, levels_c) of each column of codes, in one aggregate."""
    return df.agg(*[e.alias(f"{n}_{c}") for c in codes for n, e in (("low", F.min(c)), ("high", F.max(c)), ("levels", F.max(c) + 1))])


def validate_codes(df: DataFrame, codes: Sequence[str], expected: Sequence[int] | None = None) -> list[int]:
    """Levels of each column of codes, as they are or as expected; raises on missing or negative codes, codes out of range, and fewer than two levels."""
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in codes]).first()
    row = code_ranges(df, codes).first()
    out = []
    for j, c in enumerate(codes):
        n = expected[j] if expected is not None else row[f"levels_{c}"]
        if missing[c] or row[f"low_{c}"] is None or row[f"low_{c}"] < 0 or row[f"high_{c}"] >= n:
            raise ValueError(f"{c} has codes that are missing or out of range")
        if n < 2:
            raise ValueError(f"{c} has fewer than two levels")
        out.append(n)
    return out


def validate(staged: DataFrame, levels: Sequence[int], width: int) -> int:
    """Rows of the staged table; raises on an empty table, a width or value that is no feature, or an unseen level."""
    row = defects(staged, levels, width).first()
    if not row["n"]:
        raise ValueError("no rows")
    if row["x"]:
        raise ValueError(f"{row['x']} rows have features that are missing or not finite")
    for j in range(len(levels)):
        if row[f"code{j}"]:
            raise ValueError(f"{row[f'code{j}']} rows have levels that the layout has not seen (categorical feature {j})")
    return row["n"]


def on_simplex(shares: Column, allow_zero: bool = False) -> Column:
    """Whether a row of shares is finite, non-negative and sums to one (or, if allowed, to nothing)."""
    s = A.total(shares)
    fine = F.forall(shares, lambda v: ~F.isnan(v) & (v >= 0) & (v < float("inf")))
    near = F.abs(s - 1) <= 8 * F.size(shares) * A.EPS
    return fine & (near | (s == 0) if allow_zero else near)


def class_target(code: Column, classes: int) -> tuple[Column, Column]:
    """(one-hot target, labelled): a code of -1 or null is unlabelled and has a row of zeros."""
    labelled = F.coalesce(code >= 0, F.lit(False))
    return A.one_hot(F.coalesce(code, F.lit(-1)), classes), labelled


def value_target(values: Column) -> tuple[Column, Column]:
    """(target, labelled): a row with a missing or NaN value is unlabelled and zero."""
    labelled = ~F.exists(values, lambda v: v.isNull() | F.isnan(v))
    return F.when(labelled, values).otherwise(F.transform(values, lambda v: F.lit(0.0))), labelled


def normalised_weights(df: DataFrame, weight: Column, into: str = "w") -> DataFrame:
    """df with weights that sum to one; sums are formed first and enter as a literal, so no window is needed."""
    top = df.agg(F.max(weight).alias("top"), F.count_if(weight.isNull() | F.isnan(weight) | (weight <= 0)).alias("bad")).first()
    if top["bad"]:
        raise ValueError(f"{top['bad']} weights are not positive")
    if top["top"] is None:
        return df.withColumn(into, weight)
    whole = df.agg(F.sum(weight / top["top"]).alias("s")).first()["s"]  # by the largest first: sums cannot overflow
    return df.withColumn(into, weight / top["top"] / whole)


def labelled_share(df: DataFrame, weight: str, labelled: str) -> float:
    row = df.agg(F.sum(F.when(F.col(labelled), F.col(weight))).alias("some"), F.sum(weight).alias("every"), F.count_if(~F.col(labelled)).alias("none")).first()
    return 1.0 if not row["none"] else (row["some"] or 0.0) / row["every"]


def class_weighted(df: DataFrame, target: str, weight: str, labelled: str, class_weights: Sequence[float]) -> DataFrame:
    """df with q: share * w * target * c over its labelled sum, whose total is the labelled share."""
    share = labelled_share(df, weight, labelled)
    raw = F.zip_with(target, A.vector(class_weights), lambda t, c: t * c)
    mass = df.where(labelled).agg(F.sum(F.col(weight) * A.total(raw)).alias("m")).first()["m"]
    if not mass:
        raise ValueError("no labelled mass")
    return df.withColumn("q", F.transform(raw, lambda v: F.when(F.col(labelled), F.lit(share / mass) * F.col(weight) * v).otherwise(F.lit(0.0))))


def task_weighted(df: DataFrame, weight: str, labelled: str, task: Column) -> DataFrame:
    """df with omega: share * w * task over its labelled sum."""
    share = labelled_share(df, weight, labelled)
    mass = df.where(labelled).agg(F.sum(F.col(weight) * task).alias("m")).first()["m"]
    if not mass:
        raise ValueError("no labelled mass")
    return df.withColumn("omega", F.when(F.col(labelled), F.lit(share / mass) * F.col(weight) * task).otherwise(F.lit(0.0)))


def subset(staged: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    """The staged rows that rows names, each once."""
    return staged.join(rows.select(key).distinct(), key, "left_semi")


def fold_table(df: DataFrame, key: str, folds: int, by: Column | None = None) -> DataFrame:
    """(key, fold): a fold for each row by a whole number (if none is given, a hash of the key that any engine can form)."""
    by = F.crc32(F.col(key).cast("string")) if by is None else by
    return df.select(key, F.pmod(by, F.lit(folds)).cast("int").alias("fold"))


def common_train_rows(folds: DataFrame, key: str) -> DataFrame:
    """Keys that every fold trains on: those held out in none."""
    n = folds.select("fold").distinct().count()
    return folds.where("part = 'train'").groupBy(key).agg(F.count_distinct("fold").alias("n")).where(F.col("n") == n).select(key)


def check_folds(folds: DataFrame, key: str) -> None:
    """Raises if a fold trains and validates on one row or names a row twice, names another part, or lacks one."""
    if folds.groupBy("fold", key).count().where("count > 1").limit(1).count():
        raise ValueError("a fold holds a row twice")
    parts = folds.groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("t"), F.count_if(F.col("part") == "validation").alias("v"), F.count("*").alias("n"))
    if parts.where("t = 0 or v = 0 or t + v <> n").limit(1).count():
        raise ValueError("a fold needs rows of part train and of part validation, and no others")
