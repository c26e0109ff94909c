"""One query for each operator, on the test tables, and the SQL that must agree with it.

Features of ``lineitem`` are scaled by fixed bounds, and parameters are literal constants, the
same in both languages. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import arrays as A
from lattica.operators import seeding as G
from lattica.operators import staging as S
from lattica.operators import statistics as T
from lattica.plans import kernel as P
from lattica.plans import network as N
from lattica.plans import recipe as R
from lattica.plans import reporting

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Fixed parameters of the queries.
BOUNDS = (("l_quantity", 1.0, 50.0), ("l_extendedprice", 900.0, 105000.0), ("l_discount", 0.0, 0.1), ("l_tax", 0.0, 0.08))
FLAGS, STATUS = ("A", "N", "R"), ("F", "O")
C = [[0.2131, 0.1873, 0.2917, 0.3191], [0.5171, 0.4637, 0.6113, 0.4871], [0.8293, 0.7717, 0.4373, 0.7131]]
W = [0.3701, 0.2903, 0.2103, 0.1293]
P_FLAG = [[0.51, 0.28, 0.21], [0.19, 0.62, 0.19], [0.13, 0.29, 0.58]]
P_STATUS = [[0.71, 0.29], [0.43, 0.57], [0.17, 0.83]]
THETA = [[0.81, 0.38, 0.13], [0.19, 0.62, 0.87]]
THETA_S = [[0.52, 0.31, 0.17], [0.11, 0.36, 0.53]]
OUT = [[0.47, 0.21, 0.12], [0.31, 0.53, 0.29], [0.22, 0.26, 0.59]]
CY = [[0.1871, 0.4637, 0.8219], [0.2713, 0.5119, 0.7907]]  # outputs by clusters
TEMP, DELTA, DELTA_CAT = 0.0531, 0.6173, 0.4127
K, D, TINY = 3, 4, "2.2250738585072014e-308"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = ", ".join(KEYS)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, x, cf (flag code), cs (status code) and w0 (raw weight)."""
    df = read(spark, sf_dir, "lineitem")
    x = F.array(*[S.scaled(c, a, b) for c, a, b in BOUNDS])
    return df.select(*KEYS, x.alias("x"), S.code_of("l_returnflag", FLAGS).alias("cf"), S.code_of("l_linestatus", STATUS).alias("cs"), F.col("l_quantity").cast("double").alias("w0"))


def spread(df: DataFrame, array: str, value: str = "value", at: str = "k") -> DataFrame:
    return df.select(*KEYS, F.posexplode(array).alias(at, value)).select(*KEYS, at, r6(value).alias(value))


# --- SQL pieces ---------------------------------------------------------------------------
def _d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


LI = f"li AS (SELECT {KEY_SQL}, " + ", ".join(f"(CAST({c} AS DOUBLE) - {_d(a)}) / {_d(b - a)} AS x{i}" for i, (c, a, b) in enumerate(BOUNDS)) + ", CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE -1 END AS cf, CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS cs, CAST(l_quantity AS DOUBLE) AS w0 FROM lineitem)"


def _dist(k: int, weighted: bool = True) -> str:
    return "(" + " + ".join(f"{_d(W[d]) + ' * ' if weighted else ''}(x{d} - {_d(C[k][d])}) * (x{d} - {_d(C[k][d])})" for d in range(D)) + ")"


def _pick(code: str, values: list[float]) -> str:
    return "CASE " + code + " " + " ".join(f"WHEN {i} THEN {_d(v)}" for i, v in enumerate(values)) + " END"


def _xent(k: int) -> str:
    import math

    a, b = A.level_scale(DELTA_CAT, 3), A.level_scale(DELTA_CAT, 2)
    return f"({_pick('cf', [-a * math.log(p) for p in P_FLAG[k]])} + {_pick('cs', [-b * math.log(p) for p in P_STATUS[k]])})"


def _soft(cost: str, temp: str, n: int = K, name: str = "g") -> str:
    """Columns name0.. from columns cost0.."""
    low = "least(" + ", ".join(f"{cost}{k}" for k in range(n)) + ")"
    each = [f"exp(-({cost}{k} - {low}) / ({temp}))" for k in range(n)]
    return ", ".join(f"{e} / ({' + '.join(each)}) AS {name}{k}" for k, e in enumerate(each))


DI = "di AS (SELECT *, " + ", ".join(f"{_dist(k)} AS d{k}" for k in range(K)) + " FROM li)"
GA = f"ga AS (SELECT *, {_soft('d', _d(TEMP))} FROM di)"
BASE = f"WITH {LI}, {DI}, {GA}"


def _long(columns: list[str], source: str, at: str = "k", value: str = "value") -> str:
    """Long form of several columns."""
    return " UNION ALL ".join(f"SELECT {KEY_SQL}, {i} AS {at}, round({c}, 6) AS {value} FROM {source}" for i, c in enumerate(columns))


def _sum_long(columns: list[str], source: str, at: str = "k", value: str = "value") -> str:
    return " UNION ALL ".join(f"SELECT {i} AS {at}, round({c}, 6) AS {value} FROM {source}" for i, c in enumerate(columns))


def with_gamma(df: DataFrame) -> DataFrame:
    df = df.withColumn("cost", A.distances(F.col("x"), C, W))
    return df.withColumn("gamma", A.softmax(F.col("cost"), TEMP))


def long_row(df: DataFrame, *columns: Column, at: str = "k") -> DataFrame:
    """A one-row frame of sums as (at, value)."""
    return df.select(F.posexplode(F.array(*columns)).alias(at, "value")).select(at, r6("value").alias("value"))


# --- staging --------------------------------------------------------------------------------
@query("minmax_stage", "SELECT column_name, round(low, 6) AS low, round(high, 6) AS high, n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, count(*) AS n FROM lineitem" for c, _, _ in BOUNDS) + ")")
def minmax_stage(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    found = spark.createDataFrame(S.bounds(df, [c for c, _, _ in BOUNDS]), "column_name string, low double, high double")
    return found.select("column_name", r6("low").alias("low"), r6("high").alias("high"), F.lit(df.count()).cast("long").alias("n"))


@query("validate_continuous", f"WITH {LI} SELECT count(*) AS n, count(*) FILTER (WHERE NOT (" + " AND ".join(f"isfinite(x{d})" for d in range(D)) + ")) AS bad FROM li")
def validate_continuous(spark, sf_dir):
    return S.defects(lineitem(spark, sf_dir), [], D).withColumnRenamed("x", "bad")


@query("validate_categorical", f"WITH {LI} SELECT min(cf) AS low_flag, max(cf) AS high_flag, max(cf) + 1 AS levels_flag, min(cs) AS low_status, max(cs) AS high_status, max(cs) + 1 AS levels_status FROM li")
def validate_categorical(spark, sf_dir):
    return S.code_ranges(lineitem(spark, sf_dir).select(F.col("cf").alias("flag"), F.col("cs").alias("status")), ["flag", "status"])


@query("validate_distribution_rows", f"{BASE} SELECT count(*) AS n, count(*) FILTER (WHERE abs(g0 + g1 + g2 - 1) <= 8 * 3 * 2.220446049250313e-16 AND least(g0, g1, g2) >= 0) AS on_simplex FROM ga")
def validate_distribution_rows(spark, sf_dir):
    return with_gamma(lineitem(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_if(S.on_simplex(F.col("gamma"))).alias("on_simplex"))


@query("onehot_encode", f"WITH {LI} " + _long([f"CASE WHEN cf = {m} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for m in range(3)], "li", "level"))
def onehot_encode(spark, sf_dir):
    return spread(lineitem(spark, sf_dir).withColumn("h", A.one_hot(F.col("cf"), 3)), "h", at="level")


@query("label_vocab", "SELECT l_returnflag AS level, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS code, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def label_vocab(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    levels = S.fit_layout(df, [], ["l_returnflag"]).categorical[0][1]
    return df.groupBy(F.col("l_returnflag").alias("level")).agg(F.count("*").alias("n")).select("level", S.code_of("level", levels).alias("code"), "n")


@query("layout_replay", "WITH b AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem), v AS (SELECT DISTINCT l_linestatus, CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS INTEGER) AS code FROM lineitem) SELECT " + KEY_SQL + ", round((CAST(l_quantity AS DOUBLE) - b.a) / (b.b - b.a), 6) AS x0, v.code AS code FROM lineitem JOIN v USING (l_linestatus), b")
def layout_replay(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    out = S.replay_layout(df, S.fit_layout(df, ["l_quantity"], ["l_linestatus"]))
    return out.select(*KEYS, r6(F.col("x")[0]).alias("x0"), F.col("codes")[0].alias("code"))


DOC = "doc AS (SELECT d.doc_id, CAST(d.n_chars + 1 AS DOUBLE) AS w0, l.toxic, l.quality, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)), ws AS (SELECT *, w0 / (SELECT sum(w0) FROM doc) AS w FROM doc)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") + 1).cast("double").alias("w0"))
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic", "quality", F.lit(True).alias("labelled"))
    out = docs.join(labels, "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))
    return S.normalised_weights(out, F.col("w0"))


@query("weights_normalise", f"WITH {DOC} SELECT doc_id, round(w * 1000, 6) AS w FROM ws")
def weights_normalise(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", r6(F.col("w") * 1000).alias("w"))


@query("labelled_share", f"WITH {DOC} SELECT round(sum(CASE WHEN labelled THEN w END) / sum(w), 6) AS value FROM ws")
def labelled_share(spark, sf_dir):
    share = S.labelled_share(documents(spark, sf_dir), "w", "labelled")
    return spark.createDataFrame([(share,)], "value double").select(r6("value").alias("value"))


@query("stage_classification_target", f"WITH {DOC} SELECT doc_id, labelled, CASE WHEN toxic = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS q0, CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS q1 FROM ws")
def stage_classification_target(spark, sf_dir):
    target, labelled = S.class_target(F.col("toxic"), 2)
    return documents(spark, sf_dir).select("doc_id", labelled.alias("labelled"), target[0].alias("q0"), target[1].alias("q1"))


@query("stage_regression_target", "SELECT event_id, value IS NOT NULL AND NOT isnan(value) AS labelled, CASE WHEN value IS NULL OR isnan(value) THEN 0.0 ELSE round(value, 6) END AS y FROM events")
def stage_regression_target(spark, sf_dir):
    y, labelled = S.value_target(F.array(F.col("value").cast("double")))
    return read(spark, sf_dir, "events").select("event_id", labelled.alias("labelled"), r6(y[0]).alias("y"))


@query("class_weighted_target", f"WITH {DOC}, f AS (SELECT sum(CASE WHEN labelled THEN w END) / sum(w) AS f, sum(CASE WHEN labelled THEN w * CASE toxic WHEN 0 THEN 0.7::DOUBLE ELSE 2.3::DOUBLE END END) AS m FROM ws) SELECT doc_id, round(CASE WHEN labelled AND toxic = 0 THEN f / m * w * 0.7::DOUBLE ELSE 0 END * 1000, 6) AS q0, round(CASE WHEN labelled AND toxic = 1 THEN f / m * w * 2.3::DOUBLE ELSE 0 END * 1000, 6) AS q1 FROM ws, f")
def class_weighted_target(spark, sf_dir):
    df = documents(spark, sf_dir)
    target, labelled = S.class_target(F.col("toxic"), 2)
    out = S.class_weighted(df.withColumns({"target": target, "labelled": labelled}), "target", "w", "labelled", [0.7, 2.3])
    return out.select("doc_id", r6(F.col("q")[0] * 1000).alias("q0"), r6(F.col("q")[1] * 1000).alias("q1"))


@query("task_weighted_rows", f"WITH {DOC}, f AS (SELECT sum(CASE WHEN labelled THEN w END) / sum(w) AS f, sum(CASE WHEN labelled THEN w * (1.0::DOUBLE + quality) END) AS m FROM ws) SELECT doc_id, round(CASE WHEN labelled THEN f / m * w * (1.0::DOUBLE + quality) ELSE 0 END * 1000, 6) AS omega FROM ws, f")
def task_weighted_rows(spark, sf_dir):
    out = S.task_weighted(documents(spark, sf_dir), "w", "labelled", F.lit(1.0) + F.col("quality"))
    return out.select("doc_id", r6(F.col("omega") * 1000).alias("omega"))


@query("training_subset", "WITH s AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS v FROM orders WHERE o_custkey % 3 = 1) SELECT o_orderkey, round(v / (SELECT sum(v) FROM s) * 1000, 6) AS w FROM s")
def training_subset(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("v"))
    rows = orders.where("o_custkey % 3 = 1").select("o_orderkey")
    return S.normalised_weights(S.subset(orders, rows, "o_orderkey"), F.col("v")).select("o_orderkey", r6(F.col("w") * 1000).alias("w"))


# --- primitives -----------------------------------------------------------------------------
EV = "ev AS (SELECT event_id, abs(value) + 0.1 AS a, abs(value) * 0.37 + 0.2 AS b, (user_id % 7) + 0.5 AS c FROM events WHERE value IS NOT NULL AND NOT isnan(value)), pr AS (SELECT event_id, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM ev)"


def shares_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("value is not null and not isnan(value)")
    v = F.abs(F.col("value").cast("double"))
    return e.select("event_id", F.col("value").cast("double").alias("value"), A.normalise(F.array(v + F.lit(0.1), v * F.lit(0.37) + F.lit(0.2), (F.col("user_id") % 7) + F.lit(0.5))).alias("p"))


@query("normalise_rows", f"WITH {EV} SELECT event_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM pr")
def normalise_rows(spark, sf_dir):
    return shares_of_events(spark, sf_dir).select("event_id", *[r6(F.col("p")[k]).alias(f"p{k}") for k in range(3)])


@query("floored_log", f"WITH {EV} SELECT event_id, round(ln(greatest(p0, {TINY})), 6) AS value FROM pr")
def floored_log(spark, sf_dir):
    return shares_of_events(spark, sf_dir).select("event_id", r6(A.floored_log(F.col("p")[0])).alias("value"))


@query("scale_ratio", f"WITH {EV} SELECT event_id, round(p0 * p1 / p2, 6) AS value FROM pr")
def scale_ratio(spark, sf_dir):
    return shares_of_events(spark, sf_dir).select("event_id", r6(A.scaled_ratio(F.col("p")[0], F.col("p")[1], F.col("p")[2])).alias("value"))


_H = "-(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2))"


@query("entropy_rows", f"WITH {EV} SELECT event_id, round({_H}, 6) AS value FROM pr")
def entropy_rows(spark, sf_dir):
    return shares_of_events(spark, sf_dir).select("event_id", r6(A.entropy(F.col("p"))).alias("value"))


@query("effective_dimension", f"WITH {EV} SELECT event_id, round(exp({_H}), 6) AS size, round(exp({_H}) / 3, 6) AS share FROM pr")
def effective_dimension(spark, sf_dir):
    return shares_of_events(spark, sf_dir).select("event_id", r6(A.effective_dimension(F.col("p"))).alias("size"), r6(A.effective_dimension(F.col("p"), True)).alias("share"))


@query("entropy_penalty", f"{BASE} SELECT round(-{_d(TEMP)} * sum(w0 * -(g0 * ln(greatest(g0, {TINY})) + g1 * ln(greatest(g1, {TINY})) + g2 * ln(greatest(g2, {TINY})))) / sum(w0), 6) AS value FROM ga")
def entropy_penalty(spark, sf_dir):
    return T.entropy_penalty(with_gamma(lineitem(spark, sf_dir)), "gamma", F.col("w0"), TEMP).select(r6("value").alias("value"))


_B = "b AS (SELECT *, g0 * d0 + g1 * d1 + g2 * d2 AS b FROM ga)"


@query("log_partition", f"{BASE}, {_B}, m AS (SELECT min(b) AS least FROM b) SELECT round(any_value(m.least), 6) AS least, round(ln(sum(exp(-(b - m.least) / 0.21))), 6) AS log_partition FROM b, m")
def log_partition(spark, sf_dir):
    df = with_gamma(lineitem(spark, sf_dir)).withColumn("b", A.dot(F.col("gamma"), F.col("cost")))
    return T.log_partition(df, "b", 0.21).select(r6("least").alias("least"), r6("log_partition").alias("log_partition"))


@query("sq_norm", f"WITH {LI} SELECT {KEY_SQL}, round(" + " + ".join(f"{_d(W[d])} * x{d} * x{d}" for d in range(D)) + ", 6) AS value FROM li")
def sq_norm(spark, sf_dir):
    return lineitem(spark, sf_dir).select(*KEYS, r6(A.sq_norm(F.col("x"), W)).alias("value"))


#: Centres that the driver may hold.
MOST_CENTRES = 1000


# --- distances ------------------------------------------------------------------------------
@query("sqdist_matrix", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), c AS (SELECT label AS k, min_by(e, vec_id) AS c FROM v GROUP BY label) SELECT vec_id, k, round(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS value FROM v, c")
def sqdist_matrix(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    first = v.groupBy("label").agg(F.min(F.struct("vec_id", "e")).alias("m")).select("label", "m.e").limit(MOST_CENTRES + 1).collect()  # a centre for each of the ten classes
    if len(first) > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} labels: too many centres for the driver")
    centres = F.array(*[F.struct(F.lit(r["label"]).alias("k"), A.vector(r["e"]).alias("c")) for r in sorted(first)])
    long = v.select("vec_id", "e", F.explode(centres).alias("c"))
    return long.select("vec_id", F.col("c.k").alias("k"), r6(A.total(F.zip_with("e", "c.c", lambda a, b: (a - b) * (a - b)))).alias("value"))


@query("weighted_sqdist", f"WITH {LI}, {DI} " + _long([f"d{k}" for k in range(K)], "di"))
def weighted_sqdist(spark, sf_dir):
    return spread(lineitem(spark, sf_dir).withColumn("cost", A.distances(F.col("x"), C, W)), "cost")


@query("categorical_xent", f"WITH {LI} " + _long([_xent(k) for k in range(K)], "li"))
def categorical_xent(spark, sf_dir):
    return spread(lineitem(spark, sf_dir).withColumn("cost", _categorical()), "cost")


def _categorical() -> Column:
    return A.plus(A.cross_entropy(F.col("cf"), P_FLAG, A.level_scale(DELTA_CAT, 3)), A.cross_entropy(F.col("cs"), P_STATUS, A.level_scale(DELTA_CAT, 2)))


def _mixed(df: DataFrame) -> DataFrame:
    df = df.withColumn("cost", A.plus(A.distances(F.col("x"), C, W), _categorical()))
    return df.withColumn("gamma", A.softmax(F.col("cost"), TEMP))


_MIX = f"WITH {LI}, mi AS (SELECT *, " + ", ".join(f"{_dist(k)} + {_xent(k)} AS d{k}" for k in range(K)) + f" FROM li), ga AS (SELECT *, {_soft('d', _d(TEMP))} FROM mi)"


@query("mixed_discretisation", f"{_MIX} SELECT round(avg(g0 * d0 + g1 * d1 + g2 * d2), 6) AS value FROM ga")
def mixed_discretisation(spark, sf_dir):
    return _mixed(lineitem(spark, sf_dir)).agg(r6(F.avg(A.dot(F.col("gamma"), F.col("cost")))).alias("value"))


@query("seed_dissimilarity", f"WITH {LI} SELECT {KEY_SQL}, round(greatest({_dist(1)}, 0) + CASE WHEN cf = 1 THEN 0 ELSE -ln({TINY}::DOUBLE) END, 6) AS value FROM li")
def seed_dissimilarity(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("codes", F.array("cf"))
    return df.select(*KEYS, r6(G.dissimilarity(D, np.array([*W, 1.0]), C[1], [1])).alias("value"))


# --- assignment -----------------------------------------------------------------------------
@query("hard_assign", f"WITH {LI}, {DI} SELECT {KEY_SQL}, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS k FROM di")
def hard_assign(spark, sf_dir):
    return lineitem(spark, sf_dir).select(*KEYS, A.first_least(A.distances(F.col("x"), C, W)).alias("k"))


@query("soft_assign", f"{BASE} " + _long([f"g{k}" for k in range(K)], "ga"))
def soft_assign(spark, sf_dir):
    return spread(with_gamma(lineitem(spark, sf_dir)), "gamma")


@query("weighted_soft_assign", f"WITH {LI}, {DI}, we AS (SELECT *, {_soft('d', _d(TEMP) + ' * (w0 / 25.5)')} FROM di) " + _long([f"g{k}" for k in range(K)], "we"))
def weighted_soft_assign(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("cost", A.distances(F.col("x"), C, W))
    return spread(df.withColumn("gamma", A.assign(F.col("cost"), TEMP, K, F.col("w0") / 25.5)), "gamma")


# --- sufficient statistics ------------------------------------------------------------------
@query("cluster_mass", f"{BASE} SELECT k, round(sum(g) / 1000, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, g{k} AS g FROM ga" for k in range(K)) + ") GROUP BY k")
def cluster_mass(spark, sf_dir):
    return T.masses(with_gamma(lineitem(spark, sf_dir)), "gamma").select("k", r6(F.col("mass") / 1000).alias("value"))


@query("nonempty_clusters", f"WITH {LI}, {DI}, h AS (SELECT CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS k FROM di) SELECT r.k, count(h.k) > 0 AS alive FROM (VALUES (0), (1), (2)) r(k) LEFT JOIN h ON h.k = r.k GROUP BY r.k")
def nonempty_clusters(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("gamma", A.hard(A.distances(F.col("x"), C, W), K))
    return T.survivors(df, "gamma").select("k", "alive")


def _kd(expression: str, source: str, group: bool = True) -> str:
    """(k, d, value) of an aggregate over source with {g} and {x}."""
    return " UNION ALL ".join(f"SELECT {k} AS k, {d} AS d, round({expression.format(g=f'g{k}', x=f'x{d}')}, 6) AS value FROM {source}" for k in range(K) for d in range(D))


@query("centroid_update", f"{BASE} " + _kd("sum({g} * w0 * {x}) / sum({g} * w0)", "ga"))
def centroid_update(spark, sf_dir):
    sums = T.cluster_sums(with_gamma(lineitem(spark, sf_dir)), "gamma", "x", F.col("w0"))
    return T.centroids(sums).select("k", "d", r6("value").alias("value"))


@query("categorical_centroid_update", f"{BASE} " + " UNION ALL ".join(f"SELECT {k} AS k, {m} AS level, round(sum(CASE WHEN cf = {m} THEN g{k} * w0 ELSE 0 END) / sum(g{k} * w0), 6) AS share FROM ga" for k in range(K) for m in range(3)))
def categorical_centroid_update(spark, sf_dir):
    return T.level_shares(with_gamma(lineitem(spark, sf_dir)), "gamma", "cf", F.col("w0"), 3).select("k", "level", r6("share").alias("share"))


@query("grouped_means", f"WITH {LI}, a AS (SELECT sum(w0 * x0) / sum(w0) AS x0, sum(w0 * x1) / sum(w0) AS x1 FROM li), g AS (SELECT cf, sum(w0 * x0) / sum(w0) AS x0, sum(w0 * x1) / sum(w0) AS x1 FROM li GROUP BY cf) SELECT r.cf, round(coalesce(g.x0, a.x0), 6) AS x0, round(coalesce(g.x1, a.x1), 6) AS x1 FROM (VALUES (0), (1), (2), (3)) r(cf) LEFT JOIN g ON g.cf = r.cf, a")
def grouped_means(spark, sf_dir):
    df = lineitem(spark, sf_dir).select("cf", "w0", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"))
    return T.group_means(df, "cf", 4, ["x0", "x1"], F.col("w0")).select("cf", r6("x0").alias("x0"), r6("x1").alias("x1"))


def _b(d: int) -> str:
    return "(" + " + ".join(f"avg(g{k} * (x{d} - {_d(C[k][d])}) * (x{d} - {_d(C[k][d])}))" for k in range(K)) + ")"


def _feature_cost() -> list[Column]:
    return [F.avg(sum((F.col("gamma")[k] * (F.col("x")[d] - C[k][d]) * (F.col("x")[d] - C[k][d]) for k in range(1, K)), F.col("gamma")[0] * (F.col("x")[d] - C[0][d]) * (F.col("x")[d] - C[0][d]))) for d in range(D)]


@query("feature_weight_cost", f"{BASE} " + _sum_long([_b(d) for d in range(D)], "ga", "d"))
def feature_weight_cost(spark, sf_dir):
    one = with_gamma(lineitem(spark, sf_dir)).agg(*[c.alias(f"b{d}") for d, c in enumerate(_feature_cost())])
    return long_row(one, *[F.col(f"b{d}") for d in range(D)], at="d")


@query("feature_weight_update", f"{BASE}, fc AS (SELECT " + ", ".join(f"{_b(d)} AS b{d}" for d in range(D)) + f" FROM ga), fw AS (SELECT {_soft('b', '0.031', D, 'g')} FROM fc) " + _sum_long([f"g{d}" for d in range(D)], "fw", "d"))
def feature_weight_update(spark, sf_dir):
    one = with_gamma(lineitem(spark, sf_dir)).agg(*[c.alias(f"b{d}") for d, c in enumerate(_feature_cost())])
    return one.select(F.posexplode(A.softmax(F.array(*[F.col(f"b{d}") for d in range(D)]), 0.031)).alias("d", "value")).select("d", r6("value").alias("value"))


@query("instance_cost", f"{BASE} SELECT {KEY_SQL}, round(g0 * d0 + g1 * d1 + g2 * d2, 6) AS value FROM ga")
def instance_cost(spark, sf_dir):
    return with_gamma(lineitem(spark, sf_dir)).select(*KEYS, r6(A.dot(F.col("gamma"), F.col("cost"))).alias("value"))


@query("instance_weight_update", f"{BASE}, {_B}, m AS (SELECT min(b) AS least FROM b), z AS (SELECT sum(w0 * exp(-(b - m.least) / 0.21)) / 1000 AS z FROM b, m) SELECT {KEY_SQL}, round(w0 * exp(-(b - m.least) / 0.21) / z.z, 6) AS value FROM b, m, z")
def instance_weight_update(spark, sf_dir):
    df = with_gamma(lineitem(spark, sf_dir)).withColumn("b", A.dot(F.col("gamma"), F.col("cost")))
    least = df.agg(F.min("b")).first()[0]
    raw = F.col("w0") * F.exp(-(F.col("b") - F.lit(least)) / 0.21)
    z = df.agg((F.sum(raw) / 1000).alias("z")).first()["z"]
    return df.select(*KEYS, r6(raw / F.lit(z)).alias("value"))


@query("recover_instance_weights", f"{BASE}, {_B} SELECT {KEY_SQL}, round(least(1.0, exp((0.011 - b) / 0.21 + 0.017)), 6) AS value FROM b")
def recover_instance_weights(spark, sf_dir):
    df = with_gamma(lineitem(spark, sf_dir)).withColumn("b", A.dot(F.col("gamma"), F.col("cost")))
    return df.select(*KEYS, r6(A.recovered_weight(F.col("b"), 0.011, 0.21, -0.017)).alias("value"))


@query("inlier_percentile", "WITH r AS (SELECT value AS v FROM events WHERE value IS NOT NULL AND user_id % 2 = 0), c AS (SELECT v, count(*) AS n FROM r GROUP BY v) SELECT e.event_id, round((SELECT coalesce(sum(n), 0) FROM c WHERE c.v <= e.value) / (SELECT count(*) FROM r), 6) AS share FROM events e WHERE e.value IS NOT NULL")
def inlier_percentile(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("value is not null").select("event_id", "user_id", F.col("value").cast("double").alias("value"))
    return T.ecdf(e.where("user_id % 2 = 0"), e, "event_id", "value").select("event_id", r6("share").alias("share"))


# --- coupling -------------------------------------------------------------------------------
_CPL = [" + ".join(f"g{k} * {_d(v)}" for k, v in enumerate(row)) for row in A.logs(THETA)]
_HID = f"hi AS (SELECT *, " + ", ".join(f"-{_d(DELTA)} * ({c}) AS u{j}" for j, c in enumerate(_CPL)) + f" FROM ga), h AS (SELECT * EXCLUDE (u0, u1), {_soft('u', '0.31', 2, 'h')} FROM hi)"
HID = f"{BASE}, {_HID}"


def with_hidden(df: DataFrame) -> DataFrame:
    return with_gamma(df).withColumn("hidden", A.propagate(F.col("gamma"), THETA, DELTA, 0.31))


@query("coupling_cost", f"{BASE} " + _long([f"-{_d(DELTA)} * (w0 / 25.5) * ({c})" for c in _CPL], "ga"))
def coupling_cost(spark, sf_dir):
    df = with_gamma(lineitem(spark, sf_dir))
    return spread(df.withColumn("cost", A.coupling_cost(F.col("gamma"), THETA, DELTA, F.col("w0") / 25.5)), "cost")


@query("propagate_hidden", f"{HID} " + _long(["h0", "h1"], "h"))
def propagate_hidden(spark, sf_dir):
    return spread(with_hidden(lineitem(spark, sf_dir)), "hidden")


_CNT = "ct AS (" + " UNION ALL ".join(f"SELECT {t} AS t, {s} AS s, sum(h{t} * g{s} * w0) / sum(w0) AS n FROM h" for t in range(2) for s in range(K)) + ")"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_hidden(lineitem(spark, sf_dir))
    whole = df.agg(F.sum("w0")).first()[0]
    return T.transition_counts(df, "hidden", "gamma", F.col("w0") / F.lit(whole))


@query("transition_counts_m", f"{HID}, {_CNT} SELECT t, s, round(n / sum(n) OVER (PARTITION BY s), 6) AS share FROM ct")
def transition_counts_m(spark, sf_dir):
    return T.transitions(_counts(spark, sf_dir), "M").select("t", "s", r6("share").alias("share"))


@query("transition_counts_s", f"{HID}, {_CNT} SELECT t, s, round(n / sum(n) OVER (PARTITION BY t), 6) AS share FROM ct")
def transition_counts_s(spark, sf_dir):
    return T.transitions(_counts(spark, sf_dir), "S").select("t", "s", r6("share").alias("share"))


@query("transition_pseudocount", f"{HID}, {_CNT} SELECT t, s, round((n + 0.05) / sum(n + 0.05) OVER (PARTITION BY s), 6) AS share FROM ct")
def transition_pseudocount(spark, sf_dir):
    return T.transitions(_counts(spark, sf_dir), "M", 0.05).select("t", "s", r6("share").alias("share"))


@query("transition_loss", f"{HID}, {_CNT} SELECT round(-{_d(DELTA)} * sum(n * CASE " + " ".join(f"WHEN t = {t} AND s = {s} THEN {_d(v)}" for t, row in enumerate(A.logs(THETA)) for s, v in enumerate(row)) + " END), 6) AS value FROM ct")
def transition_loss(spark, sf_dir):
    logs = F.array(*[F.lit(v) for row in A.logs(THETA) for v in row])
    return _counts(spark, sf_dir).agg(r6(-F.lit(DELTA) * F.sum(F.col("n") * F.element_at(logs, F.col("t") * K + F.col("s") + 1))).alias("value"))


# --- heads ----------------------------------------------------------------------------------
_HC = "hc AS (" + " UNION ALL ".join(f"SELECT {m} AS t, {s} AS s, sum(CASE WHEN cf = {m} THEN g{s} * w0 ELSE 0 END) / sum(w0) AS n FROM ga" for m in range(3) for s in range(K)) + ")"


def _head_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_gamma(lineitem(spark, sf_dir)).withColumn("target", A.one_hot(F.col("cf"), 3))
    whole = df.agg(F.sum("w0")).first()[0]
    return T.transition_counts(df, "target", "gamma", F.col("w0") / F.lit(whole))


@query("output_gate", f"WITH {LI} SELECT {KEY_SQL}, round(CASE WHEN cs = 1 THEN x0 * w0 ELSE 0 END, 6) AS value FROM li")
def output_gate(spark, sf_dir):
    return lineitem(spark, sf_dir).select(*KEYS, r6(A.gated(F.array(F.col("x")[0]), F.col("w0"), F.col("cs") == 1)[0]).alias("value"))


@query("class_head_counts", f"{BASE}, {_HC} SELECT t, s, round((n + 0.01) / sum(n + 0.01) OVER (PARTITION BY s), 6) AS share FROM hc")
def class_head_counts(spark, sf_dir):
    return T.transitions(_head_counts(spark, sf_dir), "M", 0.01).select("t", "s", r6("share").alias("share"))


@query("class_head_cost", f"{BASE} " + _long([f"-{_d(DELTA)} * ({_pick('cf', [A.logs(OUT)[m][k] for m in range(3)])})" for k in range(K)], "ga"))
def class_head_cost(spark, sf_dir):
    target = A.one_hot(F.col("cf"), 3)
    return spread(lineitem(spark, sf_dir).withColumn("cost", A.times(A.through(target, A.turned(A.logs(OUT))), -DELTA)), "cost")


@query("class_head_loss", f"{BASE}, {_HC} SELECT round(-{_d(DELTA)} * sum((n + 0.01) * CASE " + " ".join(f"WHEN t = {t} AND s = {s} THEN {_d(v)}" for t, row in enumerate(A.logs(OUT)) for s, v in enumerate(row)) + " END), 6) AS value FROM hc")
def class_head_loss(spark, sf_dir):
    logs = F.array(*[F.lit(v) for row in A.logs(OUT) for v in row])
    return _head_counts(spark, sf_dir).agg(r6(-F.lit(DELTA) * F.sum((F.col("n") + 0.01) * F.element_at(logs, F.col("t") * K + F.col("s") + 1))).alias("value"))


_AR = [" + ".join(f"g{k} * {_d(v)}" for k, v in enumerate(row)) for row in OUT]


@query("readout_arithmetic", f"{BASE} " + _long([f"({a}) / ({' + '.join(f'({x})' for x in _AR)})" for a in _AR], "ga"))
def readout_arithmetic(spark, sf_dir):
    return spread(with_gamma(lineitem(spark, sf_dir)).withColumn("p", A.arithmetic_readout(F.col("gamma"), OUT)), "p")


_LO = [" + ".join(f"g{k} * {_d(v)}" for k, v in enumerate(row)) for row in A.logs(OUT)]
_GEO = "ge AS (SELECT *, " + ", ".join(f"-{_d(DELTA)} * ({c}) AS z{m}" for m, c in enumerate(_LO)) + " FROM ga)"


@query("readout_geometric", f"{BASE}, {_GEO}, gp AS (SELECT {KEY_SQL}, {_soft('z', '0.43', 3, 'p')} FROM ge) " + _long(["p0", "p1", "p2"], "gp"))
def readout_geometric(spark, sf_dir):
    return spread(with_gamma(lineitem(spark, sf_dir)).withColumn("p", A.geometric_readout(F.col("gamma"), OUT, DELTA, 0.43)), "p")


@query("readout_hard", f"{BASE}, {_GEO} SELECT {KEY_SQL}, CASE WHEN z0 <= z1 AND z0 <= z2 THEN 0 WHEN z1 <= z2 THEN 1 ELSE 2 END AS m FROM ge")
def readout_hard(spark, sf_dir):
    return with_gamma(lineitem(spark, sf_dir)).select(*KEYS, A.first_least(A.times(A.through(F.col("gamma"), A.logs(OUT)), -DELTA)).alias("m"))


_Y = ["x1", "x0"]


@query("reg_head_centroids", f"{BASE} " + " UNION ALL ".join(f"SELECT {m} AS m, {k} AS k, round(sum(w0 * g{k} * {y}) / sum(w0 * g{k}), 6) AS value FROM ga" for m, y in enumerate(_Y) for k in range(K)))
def reg_head_centroids(spark, sf_dir):
    df = with_gamma(lineitem(spark, sf_dir)).withColumn("y", F.array(F.col("x")[1], F.col("x")[0]))
    return T.centroids(T.cluster_sums(df, "gamma", "y", F.col("w0"))).select(F.col("d").alias("m"), "k", r6("value").alias("value"))


@query("reg_head_cost", f"{BASE} " + _long([f"{_d(DELTA)} * (w0 / 25.5) * (" + " + ".join(f"0.5 * ({_d(CY[m][k] ** 2)} - 2 * {y} * {_d(CY[m][k])})" for m, y in enumerate(_Y)) + ")" for k in range(K)], "ga"))
def reg_head_cost(spark, sf_dir):
    y = [F.col("x")[1], F.col("x")[0]]
    cost = F.array(*[F.lit(DELTA) * F.col("w0") / 25.5 * sum((0.5 * (F.lit(CY[m][k] ** 2) - 2 * y[m] * CY[m][k]) for m in range(1, 2)), 0.5 * (F.lit(CY[0][k] ** 2) - 2 * y[0] * CY[0][k])) for k in range(K)])
    return spread(lineitem(spark, sf_dir).withColumn("cost", cost), "cost")


_RES = ["(" + " + ".join(f"g{k} * ({y} - {_d(CY[m][k])}) * ({y} - {_d(CY[m][k])})" for k in range(K)) + ")" for m, y in enumerate(_Y)]


def _residuals(df: DataFrame) -> DataFrame:
    y = [F.col("x")[1], F.col("x")[0]]
    each = [sum((F.col("gamma")[k] * (y[m] - CY[m][k]) * (y[m] - CY[m][k]) for k in range(1, K)), F.col("gamma")[0] * (y[m] - CY[m][0]) * (y[m] - CY[m][0])) for m in range(2)]
    return with_gamma(df).agg(*[(F.sum(F.col("w0") * e) / F.sum("w0")).alias(f"r{m}") for m, e in enumerate(each)])


@query("reg_head_loss", f"{BASE} SELECT round({_d(DELTA)} * sum(w0 * 0.5 * ({_RES[0]} + {_RES[1]})) / sum(w0), 6) AS value FROM ga")
def reg_head_loss(spark, sf_dir):
    return _residuals(lineitem(spark, sf_dir)).select(r6(F.lit(DELTA) * 0.5 * (F.col("r0") + F.col("r1"))).alias("value"))


@query("output_weights", f"{BASE}, re AS (SELECT {_d(DELTA)} * sum(w0 * {_RES[0]}) / sum(w0) AS r0, {_d(DELTA)} * sum(w0 * {_RES[1]}) / sum(w0) AS r1 FROM ga), wm AS (SELECT {_soft('r', '0.07', 2, 'g')} FROM re) " + _sum_long(["g0", "g1"], "wm", "m"))
def output_weights(spark, sf_dir):
    one = _residuals(lineitem(spark, sf_dir))
    return one.select(F.posexplode(A.softmax(F.array(F.col("r0") * DELTA, F.col("r1") * DELTA), 0.07)).alias("m", "value")).select("m", r6("value").alias("value"))


@query("reg_predict", f"{BASE} " + _long([" + ".join(f"g{k} * {_d(v)}" for k, v in enumerate(row)) for row in CY], "ga", "m"))
def reg_predict(spark, sf_dir):
    return spread(with_gamma(lineitem(spark, sf_dir)).withColumn("y", A.through(F.col("gamma"), CY)), "y", at="m")


@query("reconstruct_cont", f"{BASE} " + _long([" + ".join(f"g{k} * {_d(C[k][d])}" for k in range(K)) for d in range(D)], "ga", "d"))
def reconstruct_cont(spark, sf_dir):
    return spread(with_gamma(lineitem(spark, sf_dir)).withColumn("r", A.through(F.col("gamma"), A.turned(C))), "r", at="d")


@query("reconstruct_cat", f"{BASE} " + _long([" + ".join(f"g{k} * {_d(P_FLAG[k][m])}" for k in range(K)) for m in range(3)], "ga", "level"))
def reconstruct_cat(spark, sf_dir):
    return spread(with_gamma(lineitem(spark, sf_dir)).withColumn("r", A.through(F.col("gamma"), A.turned(P_FLAG))), "r", at="level")


# --- association, draws, scores ---------------------------------------------------------------
@query("delta_cat_guess", f"WITH {LI}, v AS (SELECT median(s) AS v FROM (" + " UNION ALL ".join(f"SELECT var_pop(x{d}) AS s FROM li" for d in range(D)) + f") WHERE s > 0), h AS (SELECT median(e) AS h FROM (SELECT sum(-p * ln(p)) * (1 - 1 / 3.0::DOUBLE) / ln(3.0::DOUBLE) AS e FROM (SELECT count(*) / (SELECT count(*) FROM li)::DOUBLE AS p FROM li GROUP BY cf) UNION ALL SELECT sum(-p * ln(p)) * (1 - 1 / 2.0::DOUBLE) / ln(2.0::DOUBLE) AS e FROM (SELECT count(*) / (SELECT count(*) FROM li)::DOUBLE AS p FROM li GROUP BY cs)) WHERE e > 0) SELECT round(v / h, 6) AS value FROM v, h")
def delta_cat_guess(spark, sf_dir):
    from lattica.operators.guess import delta_cat_guess as guess

    return guess(lineitem(spark, sf_dir).withColumn("codes", F.array("cf", "cs")), D, [3, 2]).select(r6("value").alias("value"))


@query("corr_ratio", "WITH g AS (SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS s, sum(c_acctbal * c_acctbal) AS q FROM customer GROUP BY 1), t AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g) SELECT round(sqrt(least(greatest((b - s * s / n) / (q - s * s / n), 0), 1)), 6) AS value FROM t")
def corr_ratio(spark, sf_dir):
    return T.correlation_ratio(read(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal")), "c_acctbal", "c_mktsegment").select(r6("value").alias("value"))


@query("cramers_v", "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b) SELECT round(sqrt(greatest(sum(n * n / (na * nb)) - 1, 0) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS value FROM c JOIN ra USING (a) JOIN rb USING (b)")
def cramers_v(spark, sf_dir):
    return T.cramers_v(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select(r6("value").alias("value"))


@query("abs_pearson", "SELECT round(abs(corr(CAST(p_size AS DOUBLE), CAST(p_retailprice AS DOUBLE))), 6) AS value FROM part")
def abs_pearson(spark, sf_dir):
    return T.absolute_pearson(read(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").cast("double").alias("b")), "a", "b").select(r6("value").alias("value"))


@query("mutual_info_discrete", "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c) SELECT round(sum(n / t * ln(n * t / (na * nb))), 6) AS value FROM c JOIN ra USING (a) JOIN rb USING (b), t")
def mutual_info_discrete(spark, sf_dir):
    return T.mutual_information(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select(r6("value").alias("value"))


@query("null_threshold", "WITH s AS (SELECT c_nationkey AS feature, avg(c_acctbal) / 10000 AS score FROM customer GROUP BY 1), q AS (SELECT quantile_cont(score, 0.6) AS t FROM s), c AS (SELECT feature, greatest(score - t, 0) AS v FROM s, q) SELECT feature, round(v / (SELECT sum(v) FROM c), 6) AS value FROM c")
def null_threshold(spark, sf_dir):
    from lattica.operators.guess import subtract_threshold

    scores = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("feature")).agg((F.avg("c_acctbal") / 10000).alias("score"))
    return subtract_threshold(scores, scores, 0.6).select("feature", r6("value").alias("value"))


UNIFORMS = (0.0131, 0.2477, 0.5003, 0.7511, 0.9973)


@query("weighted_draw", "WITH c AS (SELECT o_orderkey, o_totalprice, sum(o_totalprice) OVER (ORDER BY o_orderkey) AS c, sum(o_totalprice) OVER () AS t FROM orders), u AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_d(u)})" for i, u in enumerate(UNIFORMS)) + ") v(draw, u)) SELECT draw, min(o_orderkey) AS o_orderkey FROM c, u WHERE c.c > u.u * c.t GROUP BY draw")
def weighted_draw(spark, sf_dir):
    return T.weighted_draws(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("w")), "o_orderkey", "w", UNIFORMS)


def _seed(x: list[float]) -> dict:
    return {"x": x, "codes": []}


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose weights sum to their mean."""
    df = lineitem(spark, sf_dir)
    return df.withColumn("w", F.col("w0") / F.lit(float(max(df.count(), 1))))


@query("kmeanspp_potential", f"WITH {LI}, {DI} SELECT round(avg(w0 * least(d0, d1)), 6) AS value FROM di")
def kmeanspp_potential(spark, sf_dir):
    return G.potentials(_seeded(spark, sf_dir), G.nearest(D, np.array(W), [_seed(C[0])]), [_seed(C[1])], D, np.array(W)).select(r6("p0").alias("value"))


_CAND = [[0.31, 0.27, 0.83, 0.61], [0.77, 0.71, 0.13, 0.29], [0.11, 0.91, 0.47, 0.53]]


@query("greedy_candidate", f"WITH {LI}, {DI}, p AS (" + " UNION ALL ".join(f"SELECT {i} AS candidate, avg(w0 * least(d0, " + " + ".join(f"{_d(W[d])} * (x{d} - {_d(c[d])}) * (x{d} - {_d(c[d])})" for d in range(D)) + ")) AS potential FROM di" for i, c in enumerate(_CAND)) + ") SELECT candidate, round(potential, 6) AS potential, potential = min(potential) OVER () AS chosen FROM p")
def greedy_candidate(spark, sf_dir):
    one = G.potentials(_seeded(spark, sf_dir), G.nearest(D, np.array(W), [_seed(C[0])]), [_seed(c) for c in _CAND], D, np.array(W))
    each = one.withColumn("low", F.least(*[F.col(f"p{i}") for i in range(3)])).select("low", F.posexplode(F.array(*[F.col(f"p{i}") for i in range(3)])).alias("candidate", "p"))
    return each.select("candidate", r6("p").alias("potential"), (F.col("p") == F.col("low")).alias("chosen"))


@query("balanced_allocation", "WITH c AS (SELECT quality * 2 + toxic AS class, count(*) AS n FROM labels GROUP BY 1), r AS (SELECT class, n, unnest(range(1, n + 1)) AS turn FROM c), o AS (SELECT class, turn, row_number() OVER (ORDER BY turn, n DESC, class) AS place FROM r) SELECT class, count(*) FILTER (WHERE place <= 23) AS seeds FROM o GROUP BY class")
def balanced_allocation(spark, sf_dir):
    from lattica.operators.guess import allocate_seeds

    counts = read(spark, sf_dir, "labels").groupBy((F.col("quality") * 2 + F.col("toxic")).alias("class")).agg(F.count("*").alias("n")).collect()  # a row a class
    made = allocate_seeds({r["class"]: (r["n"], float(r["n"])) for r in counts}, 23)
    return spark.createDataFrame(sorted(made.items()), "class int, seeds long")


@query("fold_assign", "SELECT o_orderkey, CAST((o_orderkey * 7919 + 13) % 104729 % 5 AS INTEGER) AS fold FROM orders")
def fold_assign(spark, sf_dir):
    return S.fold_table(read(spark, sf_dir, "orders"), "o_orderkey", 5, (F.col("o_orderkey") * 7919 + 13) % 104729)


@query("common_train_rows", "SELECT o_orderkey FROM orders WHERE (o_orderkey * 7919 + 13) % 104729 % 5 NOT IN (0, 1, 2)")
def common_train_rows(spark, sf_dir):
    at = read(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919 + 13) % 104729 % 5).cast("int").alias("held"))
    folds = at.select("o_orderkey", "held", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("fold"))
    return S.common_train_rows(folds.select("o_orderkey", "fold", F.when(F.col("held") == F.col("fold"), "validation").otherwise("train").alias("part")), "o_orderkey")


@query("accuracy", f"{BASE} SELECT round(avg(CASE WHEN cf = CASE WHEN g0 >= g1 AND g0 >= g2 THEN 0 WHEN g1 >= g2 THEN 1 ELSE 2 END THEN 1.0 ELSE 0.0 END), 6) AS value FROM ga")
def accuracy(spark, sf_dir):
    df = with_gamma(lineitem(spark, sf_dir)).withColumn("guess", (F.array_position("gamma", F.array_max("gamma")) - 1).cast("int"))
    return T.accuracy(df, "cf", "guess").select(r6("value").alias("value"))


@query("log_loss", f"{BASE} SELECT round(avg(-ln(least(greatest(CASE cf WHEN 0 THEN g0 WHEN 1 THEN g1 ELSE g2 END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))), 6) AS value FROM ga")
def log_loss(spark, sf_dir):
    return T.log_loss(with_gamma(lineitem(spark, sf_dir)), "cf", "gamma").select(r6("value").alias("value"))


@query("r2", f"{BASE}, p AS (SELECT x1 AS y, " + " + ".join(f"g{k} * {_d(v)}" for k, v in enumerate(CY[0])) + " AS p FROM ga) SELECT round(1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS value FROM p")
def r2(spark, sf_dir):
    df = with_gamma(lineitem(spark, sf_dir)).select(F.col("x")[1].alias("y"), A.dot(F.col("gamma"), CY[0]).alias("p"))
    return T.r2(df, "y", "p").select(r6("value").alias("value"))


_BETAS = (0.25, 0.5, 1.0, 2.0, 4.0)


@query("calibration_grid_loss", f"{BASE}, z AS (SELECT cf, " + ", ".join(f"{c} AS z{m}" for m, c in enumerate(_LO)) + " FROM ga) " + " UNION ALL ".join(f"SELECT {_d(b)} AS beta, round(avg(ln(exp({b} * z0) + exp({b} * z1) + exp({b} * z2)) - {b} * CASE cf WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END), 6) AS value FROM z" for b in _BETAS))
def calibration_grid_loss(spark, sf_dir):
    df = with_gamma(lineitem(spark, sf_dir)).withColumn("z", A.through(F.col("gamma"), A.logs(OUT))).withColumn("c", F.col("cf"))
    one = df.agg(*[F.avg(N.log_loss_at(b)).alias(f"l{i}") for i, b in enumerate(_BETAS)])  # one pass for the grid
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("beta"), r6(f"l{i}").alias("value")) for i, b in enumerate(_BETAS)])).alias("r")).select("r.*")


# --- whole models ---------------------------------------------------------------------------
UNIFORM = [0.25] * 4
_LAYOUT = S.Layout(BOUNDS, ())


def _rows_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    return df.withColumn("row_id", F.xxhash64(*KEYS, "l_extendedprice", "l_quantity"))


def _fit(df: DataFrame, recipe: R.Recipe, target: str | list[str], **options) -> N.Network:
    return N.fit(df, recipe, target, row_id="row_id", **options)


def _step(df: DataFrame, recipe: R.Recipe, target: str | list[str], **options) -> N.Network:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", N.ConvergenceWarning)  # one iteration is asked for
        return _fit(df, recipe, target, max_iter=1, **options)


def _centres(spark: SparkSession, network: N.Network) -> DataFrame:
    rows = [(k, d, float(v)) for k, row in enumerate(network.params.C) for d, v in enumerate(row)]
    return spark.createDataFrame(rows, "k int, d int, value double").select("k", "d", r6("value").alias("value"))


def _u(k: int) -> str:
    return "(" + " + ".join(f"0.25::DOUBLE * (x{d} - {_d(C[k][d])}) * (x{d} - {_d(C[k][d])})" for d in range(D)) + ")"


_STEP = f"WITH {LI}, di AS (SELECT *, " + ", ".join(f"{_u(k)} AS d{k}" for k in range(K)) + f" FROM li), ga AS (SELECT *, {_soft('d', _d(TEMP))} FROM di)"
_THETAS = "th AS (SELECT " + ", ".join(f"sum(CASE WHEN cf = {m} THEN g{k} ELSE 0 END) / sum(g{k}) AS t{m}_{k}" for m in range(3) for k in range(K)) + " FROM ga)"
_NEXT = "nx AS (SELECT ga.*, " + ", ".join(f"d{k} - {_d(DELTA)} * ln(greatest(CASE cf WHEN 0 THEN t0_{k} WHEN 1 THEN t1_{k} ELSE t2_{k} END, {TINY})) AS c{k}" for k in range(K)) + f" FROM ga, th), gn AS (SELECT * EXCLUDE (g0, g1, g2), {_soft('c', _d(TEMP))} FROM nx)"


@query("fit_step_classification", f"{_STEP}, {_THETAS}, {_NEXT} " + _kd("sum({g} * {x}) / sum({g})", "gn"))
def fit_step_classification(spark, sf_dir):
    recipe = R.Recipe.chain(R.Input(K=K, epsilon=TEMP), R.ClassificationHead(), delta=DELTA)
    return _centres(spark, _step(_rows_of_lineitem(spark, sf_dir), recipe, "l_returnflag", layout=_LAYOUT, centres=C))


_CYS = "cy AS (SELECT " + ", ".join(f"sum(g{k} * x1) / sum(g{k}) AS y{k}" for k in range(K)) + " FROM ga)"
_RNEXT = "nx AS (SELECT ga.*, " + ", ".join(f"d{k} + {_d(DELTA)} * (y{k} * y{k} - 2 * x1 * y{k}) AS c{k}" for k in range(K)) + f" FROM ga, cy), gn AS (SELECT * EXCLUDE (g0, g1, g2), {_soft('c', _d(TEMP))} FROM nx)"


@query("fit_step_regression", f"{_STEP}, {_CYS}, {_RNEXT} " + _kd("sum({g} * {x}) / sum({g})", "gn"))
def fit_step_regression(spark, sf_dir):
    recipe = R.Recipe.chain(R.Input(K=K, epsilon=TEMP), R.RegressionHead(), delta=DELTA)
    rows = _rows_of_lineitem(spark, sf_dir).withColumn("price", S.scaled("l_extendedprice", 900.0, 105000.0))
    return _centres(spark, _step(rows, recipe, "price", layout=_LAYOUT, centres=C))


def _fixed(rows: int = 1, **changes) -> N.Network:
    """A network of literal parameters."""
    recipe = R.Recipe.chain(R.Input(K=K, epsilon=TEMP, epsilon_D=0.5), R.ClassificationHead(), delta=DELTA)
    params = P.Params(np.array(C), np.array(W), out=np.array(OUT), epsilons=[TEMP], deltas=[DELTA])
    return N.Network(recipe, _LAYOUT, replace(params, **changes), [1.0], True, N.PredictConfig(), rows, list(FLAGS))


def _label(p: str) -> str:
    return f"CASE WHEN {p}0 >= {p}1 AND {p}0 >= {p}2 THEN 'A' WHEN {p}1 >= {p}2 THEN 'N' ELSE 'R' END"


_NEG = "zz AS (SELECT *, " + ", ".join(f"-({c}) AS z{m}" for m, c in enumerate(_LO)) + " FROM ga)"


@query("predict_single", f"{BASE}, {_NEG}, pr AS (SELECT {KEY_SQL}, {_soft('z', '1.0', 3, 'p')} FROM zz) SELECT {KEY_SQL}, {_label('p')} AS label, round(greatest(p0, p1, p2), 6) AS p FROM pr")
def predict_single(spark, sf_dir):
    out = _fixed().predict(read(spark, sf_dir, "lineitem"))
    return out.select(*KEYS, "label", r6(F.array_max("prediction")).alias("p"))


_GZ = "gz AS (SELECT di.*, " + ", ".join(f"d{k} - {_d(DELTA)} / 3 * (" + " + ".join(f"ln({_d(OUT[m][k])})" for m in range(3)) + f") AS c{k}" for k in range(K)) + " FROM di)"


@query("predict_start_uniform", f"WITH {LI}, {DI}, {_GZ}, ga AS (SELECT *, {_soft('c', _d(TEMP))} FROM gz), {_NEG}, pr AS (SELECT {KEY_SQL}, {_soft('z', '1.0', 3, 'p')} FROM zz) SELECT {KEY_SQL}, {_label('p')} AS label, round(greatest(p0, p1, p2), 6) AS p FROM pr")
def predict_start_uniform(spark, sf_dir):
    """Two steps of iterative prediction from uniform shares: the first moves the clusters, the second the prediction."""
    out = _fixed().predict(read(spark, sf_dir, "lineitem"), config=N.PredictConfig(mode="iterative", start="uniform", max_iter=2, tol=0.0))
    return out.select(*KEYS, "label", r6(F.array_max("prediction")).alias("p"))


_HG = " + ".join(f"g{k} * ln(greatest(g{k}, {TINY}))" for k in range(K))


@query("effective_dimensions", f"{BASE} SELECT 'gamma0' AS name, round(avg(exp(-({_HG}))), 6) AS value FROM ga UNION ALL SELECT 'features', round(exp(-(" + " + ".join(f"{_d(w)} * ln({_d(w)})" for w in W) + ")), 6)")
def effective_dimensions(spark, sf_dir):
    found = reporting.effective_dimensions(_fixed(), read(spark, sf_dir, "lineitem"))
    return spark.createDataFrame(list(found.items()), "name string, value double").select("name", r6("value").alias("value"))


_WEIGHTS = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({d}, {_d(w)})" for d, w in enumerate(W)) + ") v(feature, weight))"


@query("active_features", f"WITH {_WEIGHTS} SELECT feature FROM w WHERE weight * (SELECT count(*) FROM w) > 0.6")
def active_features(spark, sf_dir):
    return spark.createDataFrame([(d,) for d in reporting.active_features(_fixed(), 0.6)], "feature int")


@query("feature_importances", f"WITH {_WEIGHTS} SELECT feature, round(weight, 6) AS value FROM w")
def feature_importances(spark, sf_dir):
    return spark.createDataFrame([(d, float(v)) for d, v in enumerate(reporting.feature_importances(_fixed()))], "feature int, value double").select("feature", r6("value").alias("value"))


@query("count_parameters", f"WITH n AS (SELECT count(*) AS n FROM lineitem) SELECT 'free' AS kind, CAST({K * D} + {D} - 1 + {K} * (3 - 1) AS BIGINT) AS value UNION ALL SELECT 'raw', CAST({K * D} + {D} + {K} * 3 AS BIGINT) UNION ALL SELECT 'free with shares', CAST({K * D} + {D} - 1 + {K} * (3 - 1) + n * ({K} - 1) AS BIGINT) FROM n")
def count_parameters(spark, sf_dir):
    made = _fixed(rows=read(spark, sf_dir, "lineitem").count())
    rows = [("free", reporting.count_parameters(made)), ("raw", reporting.count_parameters(made, raw=True)), ("free with shares", reporting.count_parameters(made, affiliations=True))]
    return spark.createDataFrame(rows, "kind string, value long")


@query("target_weights", "SELECT * FROM (VALUES (0, 0.3::DOUBLE), (1, 0.7::DOUBLE)) v(output, value)")
def target_weights(spark, sf_dir):
    made = _fixed(out=np.array(CY), W_M=np.array([0.3, 0.7]), regression=True)
    return spark.createDataFrame([(m, float(v)) for m, v in enumerate(reporting.target_weights(made))], "output int, value double")


#: A direction of each cluster, and the price of the distance along it.
AXES = [[0.5, 0.5, 0.5, 0.5], [0.6, 0.8, 0.0, 0.0], [0.0, 0.0, 0.8, 0.6]]
ALPHA = 0.15


def _manifold() -> N.Network:
    recipe = R.Recipe.chain(R.ManifoldInput(K=K, subspace_dimension=1, alpha=ALPHA, epsilon=TEMP), R.ClassificationHead(), delta=DELTA)
    return replace(_fixed(U=np.array(AXES)[:, :, None], alpha=ALPHA), recipe=recipe)


def _along(k: int) -> str:
    return "(" + " + ".join(f"{_d(AXES[k][d])} * (x{d} - {_d(C[k][d])})" for d in range(D)) + ")"


_MANIFOLD = f"WITH {LI}, al AS (SELECT *, " + ", ".join(f"{_along(k)} AS a{k}" for k in range(K)) + " FROM li), di AS (SELECT *, " + ", ".join(f"({_d(1 + ALPHA)} * {_dist(k, False)} - a{k} * a{k}) / {D} AS d{k}" for k in range(K)) + f" FROM al), ga AS (SELECT *, {_soft('d', _d(TEMP))} FROM di)"


@query("manifold_cost", f"{_MANIFOLD} " + _long([f"d{k}" for k in range(K)], "ga"))
def manifold_cost(spark, sf_dir):
    return spread(_manifold().affiliations(read(spark, sf_dir, "lineitem")), "cost")


@query("manifold_project", f"{_MANIFOLD} " + _long([" + ".join(f"g{k} * ({_d(C[k][d])} + {_d(AXES[k][d])} * a{k})" for k in range(K)) for d in range(D)], "ga", "d"))
def manifold_project(spark, sf_dir):
    return spread(_manifold().reconstruct(read(spark, sf_dir, "lineitem")), "reconstruction", at="d")


@query("manifold_importances", f"{_MANIFOLD}, m AS (SELECT " + ", ".join(f"avg(g{k}) AS m{k}" for k in range(K)) + " FROM ga) " + " UNION ALL ".join(f"SELECT {d} AS feature, round(" + " + ".join(f"m{k} * {_d(AXES[k][d] ** 2)}" for k in range(K)) + ", 6) AS value FROM m" for d in range(D)))
def manifold_importances(spark, sf_dir):
    found = reporting.feature_importances(_manifold(), read(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(d, float(v)) for d, v in enumerate(found)], "feature int, value double").select("feature", r6("value").alias("value"))


_CUT = [[OUT[m][k] / sum(OUT[m][j] for j in (0, 2)) for k in (0, 2)] for m in range(3)]


@query("prune_clusters", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {m}, round({_d(v)}, 6))" for m, row in enumerate(_CUT) for i, v in enumerate(row)) + ") v(cluster, class, share)")
def prune_clusters(spark, sf_dir):
    """A head that is normalised over clusters, after the one without mass is gone."""
    run = N.Fit(read(spark, sf_dir, "region"), _fixed().params)
    run.axes = [1]
    run.prune(0, np.array([3.0, 0.0, 2.0]))
    rows = [(i, m, float(v)) for m, row in enumerate(run.p.out) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "cluster int, class int, share double").select("cluster", "class", r6("share").alias("share"))


def _classified(spark: SparkSession, sf_dir: str, recipe: R.Recipe, **options) -> tuple[DataFrame, N.Network]:
    df = _rows_of_lineitem(spark, sf_dir)
    return df, _fit(df, recipe, "l_returnflag", continuous=[c for c, _, _ in BOUNDS], categorical=["l_linestatus"], **options)


@query("fit_classification")
def fit_classification(spark, sf_dir):
    recipe = R.Recipe.chain(R.Input(K=8, epsilon=0.01, epsilon_D=0.05), R.ClassificationHead(), delta=0.3)
    df, made = _classified(spark, sf_dir, recipe)
    return made.predict(df).select(*KEYS, "label", F.array_max("prediction").alias("p"))


@query("fit_regression")
def fit_regression(spark, sf_dir):
    df = _rows_of_lineitem(spark, sf_dir).withColumn("price", S.scaled("l_extendedprice", 900.0, 105000.0))
    recipe = R.Recipe.chain(R.Input(K=8, epsilon=0.01), R.RegressionHead(), delta=2.0)
    made = _fit(df, recipe, "price", continuous=["l_quantity", "l_discount", "l_tax"])
    return made.predict(df).select(*KEYS, F.col("prediction")[0].alias("price"))


@query("fit_hidden")
def fit_hidden(spark, sf_dir):
    recipe = R.Recipe.chain(R.Input(K=8, epsilon=0.01), R.Hidden(K=4, epsilon=0.05), R.ClassificationHead(), delta=0.3)
    df, made = _classified(spark, sf_dir, recipe)
    return made.predict(df).select(*KEYS, "label")


@query("fit_manifold")
def fit_manifold(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    parts = [f"e{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0])]
    v = e.select(F.col("vec_id").alias("row_id"), "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(parts)])
    recipe = R.Recipe.chain(R.ManifoldInput(K=10, subspace_dimension=2, epsilon=0.01), R.ClassificationHead(), delta=0.3)
    made = _fit(v, recipe, "label", continuous=parts)
    return made.predict(v.drop("label")).select("row_id", "label")


@query("predict_iterative")
def predict_iterative(spark, sf_dir):
    recipe = R.Recipe.chain(R.Input(K=6, epsilon=0.02), R.ClassificationHead(), delta=0.2)
    df, made = _classified(spark, sf_dir, recipe)
    return made.predict(df, config=N.PredictConfig(mode="iterative")).select(*KEYS, "label")


@query("score_samples")
def score_samples(spark, sf_dir):
    recipe = R.Recipe.chain(R.Input(K=6, epsilon=0.02, epsilon_T=0.5), R.ClassificationHead(), delta=0.2)
    df, made = _classified(spark, sf_dir, recipe)
    return made.score_samples(df, df, "row_id")


@query("select_init")
def select_init(spark, sf_dir):
    from lattica.plans.selection import select

    df = read(spark, sf_dir, "part").withColumn("row_id", F.col("p_partkey"))
    made = select(df, R.Recipe.chain(R.Input(K=5, epsilon=0.02), R.ClassificationHead(), delta=0.2), "p_brand", row_id="row_id", inits=3, parallel=3, continuous=["p_size", "p_retailprice"])
    return made.predict(df).select("p_partkey", "label")
