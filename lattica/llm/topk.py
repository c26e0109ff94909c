"""Exact top-k search by MaxScore over quantised vectors.

Components are terms, and a vector's component is its weight in the term's postings. For each
query the terms are ordered by the most that they can add in a shard. As many of the first are
essential as are needed so that the rest together cannot reach the k-th best score; essential
postings are traversed for all vectors of a block, and the other terms are probed only for
vectors whose score so far, with all that may still come, can reach it. Scores are integers, so
bounds are exact and ties go to the smaller id.

Corpus and queries are packed in shards and blocks of bounded size; each query block meets each
shard by an equi-join on the shard, and the best of each shard are merged by query.

Defined results: vectors that are null, empty, or hold null or non-finite components, and rows
without an id, take no part; a shorter vector counts as zero where it ends; rows equal in id and
vector count once; a query does not find rows of its own id; of several query rows with one id
the smallest vector asks; components are clamped to +-2**53 and scores to a long; with fewer
candidates than k all are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, tidy

#: Vectors of a shard, queries of a block, vectors scored at a time, terms probed at a time.
SHARD, QUERIES, BLOCK, PROBE = 4096, 1024, 1024, 8


def best(ids: np.ndarray, weights: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best of a shard whose ids ascend."""
    low, high = weights.min(0), weights.max(0)
    most, fewest = np.maximum(query * low, query * high), np.minimum(query * low, query * high)
    order = np.argsort(-(most - fewest), kind="stable")
    sure = fewest[order].sum()  # what every vector of the shard scores at least
    gains = (most - fewest)[order]
    rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # the most that the terms from here on add
    after = np.append(np.cumsum(gains[::-1])[::-1], 0)  # the most that they add beyond what is sure
    best_ids, best_scores = np.empty(0, np.int64), np.empty(0, query.dtype)
    for at in range(0, len(ids), BLOCK):
        rows = np.arange(at, min(at + BLOCK, len(ids)))
        rows = rows[ids[rows] != own]
        step = len(order)
        if len(best_ids) >= k:
            # essential terms: without gains in them a vector stays below the k-th best
            step = int(np.argmax(after + sure < best_scores[-1])) if (after + sure < best_scores[-1]).any() else len(order)
        score = weights[np.ix_(rows, order[:step])] @ query[order[:step]]
        while step < len(order) and len(rows):
            alive = score + rest[step] >= best_scores[-1]
            rows, score = rows[alive], score[alive]
            terms = order[step : step + PROBE]
            score = score + weights[np.ix_(rows, terms)] @ query[terms]
            step += PROBE
        best_ids, best_scores = np.append(best_ids, ids[rows]), np.append(best_scores, score)
        keep = np.lexsort((best_ids, -best_scores))[:k]
        best_ids, best_scores = best_ids[keep], best_scores[keep]
    return list(zip(best_scores.tolist(), best_ids.tolist(), strict=True))


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component, of the vectors that take part."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & whole)
    edge = float(1 << 53)
    v = F.transform(vector_col, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-edge)), F.lit(edge))).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _packed(b: pd.DataFrame, key: str) -> pd.DataFrame:
    width = max(map(len, b["v"]))
    m = _matrix(b["v"].tolist(), width)
    rows = np.unique(np.column_stack([b["id"].to_numpy(np.int64), m]), axis=0)
    if key == "block":  # one query an id
        rows = rows[np.append(True, rows[1:, 0] != rows[:-1, 0])]
    return pd.DataFrame({key: [b[key].iloc[0]], f"{key}_width": [width], f"{key}_rows": [rows.astype("<i8").tobytes()]})


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score): for each query row its k best rows of vectors."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    corpus = quantised(vectors, id_col, vector_col, scale)
    asked = quantised(queries, id_col, vector_col, scale)
    shards, blocks = max(1, -(-corpus.count() // SHARD)), max(1, -(-asked.count() // QUERIES))
    deal = lambda df, name, n: df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    of_shard = deal(corpus, "shard", shards).groupBy("shard").applyInPandas(lambda b: _packed(b, "shard"), "shard int, shard_width int, shard_rows binary")
    of_block = deal(asked, "block", blocks).groupBy("block").applyInPandas(lambda b: _packed(b, "block"), "block int, block_width int, block_rows binary")
    of_shard, of_block = scratch.write(of_shard, "shards"), scratch.write(of_block, "blocks")
    meets = of_block.withColumn("its_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = meets.join(of_shard.hint("shuffle_merge"), F.col("its_shard") == F.col("shard"))

    @tidy
    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                out = []
                corpus = np.frombuffer(r.shard_rows, "<i8").reshape(-1, r.shard_width + 1)
                ask = np.frombuffer(r.block_rows, "<i8").reshape(-1, r.block_width + 1)
                width = max(r.shard_width, r.block_width)
                ids, weights, q = corpus[:, 0], _matrix(corpus[:, 1:], width), _matrix(ask[:, 1:], width)
                top = int(np.abs(weights).max()) * int(np.abs(q).max()) * width if len(ids) and len(ask) else 0
                if top >= 1 << 62:
                    weights, q = weights.astype(object), q.astype(object)
                elif top < 1 << 53:
                    weights, q = weights.astype(np.float64), q.astype(np.float64)  # exact, and by BLAS
                for own, query in zip(ask[:, 0].tolist(), q, strict=True):
                    out += [(own, i, max(min(int(s), 2**63 - 1), -(2**63))) for s, i in best(ids, weights, query, own, k)]
                yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    found = pairs.select("shard_width", "shard_rows", "block_width", "block_rows").mapInPandas(searched, "query_id long, id long, score long")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    merged = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", F.col("id").alias(id_col), "score")
