"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text train a linear numpy classifier. The share of toxic
text among unlabelled text is the class prior; the risk of calling text clean is estimated on
unlabelled text and corrected by what the prior says is toxic in it, and where that estimate
falls below zero the step goes back, so that the classifier does not explain the toxic part of
the unlabelled text away. Labels of clean text serve the prior alone.

Features of a text are the presence of its words and of their beginnings (3 to 6 letters),
hashed; those that confirmed examples hold more often than unlabelled text are kept. Confirmed
examples are a bounded sample (``max_toxic`` documents, those with the smallest hash of their
id). Unlabelled text is every document that is not held out, labels withheld, so that it is
spread as all text is: its features are counted, and its part of the risk, gradient and curvature
are summed at every Newton step, over all of it. Tasks sum their own first, so what comes to the
driver is as large as the features.

Defined results: null and empty texts have no features and score as the bias says; a null id is
in no fold that is held out and has no label; without a confirmed example, or a feature that
tells them, every score is 0; it makes no difference whether all documents have labels or few; a
document with several labels counts as toxic if one of them does; of rows with one id one is a confirmed example; equal rows score
alike; empty tables give no rows; other columns pass through untouched.
"""

from __future__ import annotations

import itertools
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, give_back, small_batches, tidy, whole

WORD = re.compile(r"[^\W\d_]+")
BITS, BEGINNINGS = 20, (3, 4, 5, 6)
#: Confirmed documents to fit on, features to keep, least number of confirmed examples with a feature, deviations that are no chance.
MAX_TOXIC, FEATURES, LEAST, SURE = 2000, 384, 5, 3.5
#: Sums of tasks meet in so many parts.
PARTS = 16
#: Newton steps at most, and the weight of the squares of weights.
STEPS, DECAY = 24, 1e-2
THRESHOLD = 0.7
KEPT_WORDS = 200_000


def features(word: str) -> set[int]:
    mask = (1 << BITS) - 1
    return {zlib.crc32(word.encode()) & mask, *(zlib.crc32(f"^{word[:k]}".encode()) & mask for k in BEGINNINGS if len(word) >= k)}


def _placed(texts: pd.Series, place: dict[int, int] | None, known: dict[str, tuple[int, ...]]) -> Iterator[set[int]]:
    """The features of each text, or their places where those are given; known keeps words for a while."""
    for text in texts:
        found: set[int] = set()
        for w in set(WORD.findall(text.lower())):
            if (at := known.get(w)) is None:
                at = known[w] = tuple(features(w)) if place is None else tuple(place[f] for f in features(w) if f in place)
            if at:
                found.update(at)
        if len(known) > KEPT_WORDS:
            known.clear()
        yield found


@dataclass(frozen=True)
class Model:
    """weights by hashed feature; a score is the logistic of scale * (sum of weights - cut) moved to THRESHOLD at the cut."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float
    cut: float
    scale: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        z = self.scale * (margin - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rows(found: list[np.ndarray], width: int) -> np.ndarray:
    """Presence of features, and a column of ones."""
    out = np.zeros((len(found), width + 1))
    for x, row in zip(out, found, strict=True):
        x[row] = 1
    out[:, -1] = 1
    return out


def part_of_risk(x: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of n documents for each row: their number, the loss of calling them clean, its gradient and its curvature."""
    z = x @ w
    s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return float(n.sum()), float(n @ np.logaddexp(0, z)), (n * s) @ x, (x * (n * s * (1 - s))[:, None]).T @ x


def nn_pu(positive: np.ndarray, unlabelled: Callable[[np.ndarray], tuple[float, float, np.ndarray, np.ndarray]], prior: float, steps: int = STEPS, decay: float = DECAY) -> np.ndarray:
    """Weights (the bias last) that minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the logistic loss.

    With that loss prior * (R+ - R-) of the positives is linear, so while the estimate of the clean
    risk is not negative the whole is convex and Newton steps settle it; a step that would take the
    estimate below zero is halved until it does not.
    """
    w = np.zeros(positive.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    ridge = np.full(len(w), decay)
    ridge[-1] = 0
    mean = positive.mean(0)

    def at(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        n, loss, slope, bend = unlabelled(w)
        clean = loss / n - prior * np.logaddexp(0, positive @ w).mean()
        return clean, loss / n - prior * float(mean @ w) + float(ridge @ w**2) / 2, slope / n - prior * mean + ridge * w, bend / n + np.diag(ridge + 1e-9)

    _, risk, slope, bend = at(w)
    step = np.linalg.solve(bend, slope)
    for _ in range(steps):
        clean, new_risk, slope, bend = at(w - step)
        if clean < 0 or new_risk > risk:
            step = step / 2
            if np.abs(step).max() < 1e-4:
                break
            continue
        done = risk - new_risk < 1e-6
        w, risk = w - step, new_risk
        if done:
            break
        step = np.linalg.solve(bend, slope)
    return w


def held_out(id_col: str, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def _summed(rows: DataFrame, measure: Callable[[pd.DataFrame, dict], tuple]) -> tuple | None:
    """The sums over all rows of what measure makes of a batch; a task sums its own first, and keeps a dictionary."""

    def added(total: tuple | None, x: tuple) -> tuple:
        return x if total is None else tuple(p + q for p, q in zip(total, x, strict=True))

    @tidy
    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, kept = None, {}
        for b in batches:
            total = added(total, measure(b, kept)) if len(b) else total
        if total is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId() % PARTS], "data": [zlib.compress(pickle.dumps(total), 1)]})

    def met(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for x in b["data"]:
                total = added(total, pickle.loads(zlib.decompress(x)))
        yield pd.DataFrame({"part": [key[0]], "data": [zlib.compress(pickle.dumps(total), 1)]})

    out, kind = None, "part int, data binary"
    for r in rows.mapInPandas(some, kind).groupBy("part").applyInPandas(met, kind).collect():  # PARTS sums, as large as the features
        out = added(out, pickle.loads(zlib.decompress(r["data"])))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC) -> Model | None:
    """Learn from rows that are not held out; None without a confirmed example or without features of them."""
    spark = small_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    share = known.agg(F.avg("y").alias("prior"), F.sum("y").alias("n")).first()
    if not share["n"]:
        return None
    prior = min(max(float(share["prior"]), 1e-4), 0.9)
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    toxic = known.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(max_toxic).select("id")
    toxic = rows.join(F.broadcast(toxic), "id", "left_semi").dropDuplicates(["id"])
    texts = toxic.select("text")

    def counted(places: np.ndarray | None) -> Callable[[pd.DataFrame, dict], tuple]:
        """Measures documents, and documents with each feature (of those places)."""
        size = 1 << BITS if places is None else len(places)

        def measure(b: pd.DataFrame, kept: dict) -> tuple:
            if "place" not in kept:
                kept |= {"place": None if places is None else {int(f): k for k, f in enumerate(places)}, "known": {}}
            found = itertools.chain.from_iterable(_placed(b["text"], kept["place"], kept["known"]))
            return len(b), np.bincount(np.fromiter(found, np.int64), minlength=size)

        return measure

    toxic_found = _summed(texts, counted(None))
    if toxic_found is None:
        return None
    n_toxic, toxic_with = toxic_found
    common = np.flatnonzero(toxic_with >= min(LEAST, n_toxic))
    if not len(common):
        return None
    toxic_with = toxic_with[common]
    n_free, free_with = _summed(rows.select("text"), counted(common))
    # how many deviations the confirmed share lies above the unlabelled one
    share_p, share_u = toxic_with / n_toxic, (free_with + 1) / (n_free + 2)
    worth = (share_p - share_u) / np.sqrt(share_u * (1 - share_u) * (1 / n_toxic + 1 / (n_free + 1)))
    worth = np.where((share_p > 1.5 * share_u) & (worth > SURE), worth, 0)
    chosen = common[np.sort(np.argsort(-worth, kind="stable")[: min(FEATURES, int((worth > 0).sum()))])]
    if not len(chosen):
        return None
    width = len(chosen)

    @tidy
    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, known = {int(f): k for k, f in enumerate(chosen)}, {}
        for b in batches:
            found = Counter(np.array(sorted(x), "<u2").tobytes() for x in _placed(b["text"], place, known))
            yield pd.DataFrame(found.items(), columns=["found", "n"])

    scratch = Scratch(spark, "toxicity")
    free = scratch.write(rows.select("text").mapInPandas(patterns, "found binary, n long").groupBy("found").agg(F.sum("n").alias("n")), "patterns")
    taken = lambda x: np.frombuffer(x, "<u2").astype(np.int64)
    p = _rows([taken(r["found"]) for r in texts.mapInPandas(patterns, "found binary, n long").collect() for _ in range(r["n"])], width)  # of max_toxic documents

    def over_free(measure: Callable[[np.ndarray, np.ndarray], tuple]) -> tuple:
        return _summed(free, lambda b, _: measure(_rows([taken(x) for x in b["found"]], width), b["n"].to_numpy(float)))

    w = nn_pu(p, lambda w: over_free(lambda x, n: part_of_risk(x, n, w)), prior)
    # the cut with the best estimate of F1: what is found of the toxic, against what is found in all
    at_p = np.sort(p @ w)
    cuts = np.unique(at_p)

    def spread(x: np.ndarray, n: np.ndarray) -> tuple:
        z = x @ w
        return n.sum(), n @ z, n @ z**2, np.bincount(np.searchsorted(cuts, z, "right"), n, len(cuts) + 1)

    n, sum_z, sum_zz, below = over_free(spread)
    recall = 1 - np.searchsorted(at_p, cuts) / len(at_p)
    taken_u = 1 - np.cumsum(below)[:-1] / n
    best = int(np.argmax(2 * prior * recall / (prior + taken_u)))
    # half way from the best cut to the unlabelled margins below it; margins equal to it but for rounding are at it
    bins = np.linspace(cuts[best - 1] if best else cuts[best] - 1, cuts[best], 65)

    def under(x: np.ndarray, n: np.ndarray) -> tuple:
        z = x @ w
        on = z < cuts[best] - 1e-9
        return (np.histogram(z[on], bins, weights=n[on])[0],)

    (held,) = over_free(under)
    lower = bins[np.flatnonzero(held)[-1] if held.any() else 0]
    scratch.drop("patterns")
    deviation = np.sqrt(max(sum_zz / n - (sum_z / n) ** 2, 0))
    return Model(chosen, w[:-1], float(w[-1]), float((cuts[best] + lower) / 2), float(4 / max(deviation, 1e-6)))


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> Column:
    """The score of each whole text, 0 to 1."""
    small_batches(docs.sparkSession)
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place, known = {int(f): k for k, f in enumerate(model.chosen)}, {}
        for texts in batches:
            margins = [model.bias + sum(model.weights[k] for k in sorted(found)) for found in _placed(texts, place, known)]
            yield pd.Series(model.score(np.array(margins, float)))
        give_back()

    return scored(whole(text_col))


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at or above the threshold."""
    return docs.where(score(docs, model, text_col) < threshold)
