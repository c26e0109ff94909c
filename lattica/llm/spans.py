"""Substring dedup by sliding sentence spans.

A text is split into sentences (each with the white space after it). The spans of a text are the
shortest runs of at least ``least_sentences`` sentences with words that have ``least_words``
words, one starting at every sentence and one ending at every sentence, and every single sentence
of ``long_words`` words. With no floor of words these are the pairs of neighbours, and as every
run of several sentences is covered by its pairs, a repeated run of any length goes whole. A
span's words, in lower case, are hashed. Spans are joined over the whole corpus; of spans with
equal words the first, by document and place, stays, and sentences that any other of them covers
are removed; the first place of a sentence always stays. Of a repeated passage a broken sentence
at its edges stays, and a lone whole sentence of under ``long_words`` words between two such.
First places come from a partial aggregate, are written, and only those of repeated spans are
joined back, from tables on both sides, so that Spark splits the part of a span that a third of
all rows hold.

Defined results: null and empty texts have no sentences and stay; a text shorter than a span
stays; spans that repeat within one text count too; rows equal in id and text count as one
document; a null id is a document before all others; an empty table gives no rows; other
columns pass through, whatever they are called (with ``counts``, columns named _sentences or
_removed raise an error, as the result would have two of them).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, tidy, whole

#: A run of several sentences is a span whatever its words; a single sentence is one from LONG_WORDS words.
LEAST_SENTENCES, LEAST_WORDS, LONG_WORDS = 2, 0, 50
_END = re.compile(r"[.!?]+\s+|\n\s*")


def sentences(text: str) -> list[str]:
    """Parts of a text: a sentence ends with a line, or with . ! or ? before white space; white space after it belongs to it."""
    edges = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    return [text[a:b] for a, b in itertools.pairwise(edges) if b > a]


def _runs(counts: list[int], least_sentences: int, least_words: int) -> set[tuple[int, int]]:
    """(start, end) of the shortest run from each place that has enough sentences and words."""
    out, end, held = set(), 0, 0
    for k in range(len(counts)):
        while end < len(counts) and (end - k < least_sentences or held < least_words):
            held += counts[end]
            end += 1
        if end - k < least_sentences or held < least_words:
            break
        out.add((k, end))
        held -= counts[k]
    return out


def spans(text: str, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentences, hash of the words) of each span; sentences without words count for nothing."""
    words = [(k, w) for k, s in enumerate(sentences(text)) if (w := s.lower().split())]
    counts = [len(w) for _, w in words]
    found = _runs(counts, least_sentences, least_words)
    if least_words:
        found |= {(len(counts) - b, len(counts) - a) for a, b in _runs(counts[::-1], least_sentences, least_words)}
    found |= {(k, k + 1) for k, n in enumerate(counts) if n >= long_words}
    joined = [" ".join(w) for _, w in words]
    return [(words[a][0], words[b - 1][0] - words[a][0] + 1, xxhash.xxh3_128_digest(" ".join(joined[a:b]))) for a, b in sorted(found)]


def without(text: str, covered: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without covered sentences, how many there were and how many went."""
    parts = sentences(text)
    gone = np.zeros(len(parts), bool)
    for k, n in covered:
        gone[k : k + n] = True
    return "".join(p for p, g in zip(parts, gone, strict=True) if not g), len(parts), int(gone.sum())


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS, counts: bool = True) -> DataFrame:
    """docs with repeated sentences removed from the text, and with counts columns _sentences and _removed with their numbers."""
    if counts and {"_sentences", "_removed"} & set(docs.columns):
        raise ValueError("_sentences and _removed are columns of the input; ask for no counts")
    order = docs.schema[id_col].dataType

    @tidy
    def spanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(key, h, *s) for key, h, text in zip(b["id"], b["h"], b["text"], strict=True) for s in spans(text, least_sentences, least_words, long_words)]
            yield pd.DataFrame(out, columns=["id", "h", "k", "n", "words"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(whole(text_col)).alias("h"), whole(text_col).alias("text"))
    found = rows.mapInPandas(spanned, "id string, h long, k int, n int, words binary").withColumn("id", F.col("id").cast(order))
    place = F.struct("id", "h", "k")
    first = found.groupBy("words").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select(F.col("words").alias("its_words"), "first")
    first = Scratch(docs.sparkSession, "spans").write(first, "first")
    again = found.join(first.hint("shuffle_merge"), F.col("words") == F.col("its_words")).where(~place.eqNullSafe(F.col("first")))
    covered = again.groupBy(F.col("id").alias("its_id"), F.col("h").alias("its_h")).agg(F.collect_set(F.struct("k", "n")).alias("covered"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(whole(text_col)).alias("h"))
    joined = keyed.join(covered, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("h") == F.col("its_h")), "left")

    @F.pandas_udf("text string, sentences int, removed int")
    def cleaned(text: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = [without(t, [(c["k"], c["n"]) for c in p] if p is not None else []) if t is not None else (None, 0, 0) for t, p in zip(text, places, strict=True)]
        return pd.DataFrame(rows, columns=["text", "sentences", "removed"])

    joined = joined.select("row", cleaned(F.col("row")[text_col], F.col("covered")).alias("cleaned"))
    more = [F.col("cleaned.sentences").alias("_sentences"), F.col("cleaned.removed").alias("_removed")] if counts else []
    return joined.select(*[(F.col("cleaned.text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns], *more)
