"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, runs of white space as one space, digits as 0) and hashed.
For each host the distinct documents that hold a line are counted; lines in more documents than
the host's limit are removed, and documents that lose too large a part of their words, or keep
too few, are rejected. Counting goes in two steps, documents of a line first, so a line that a
third of all rows hold is summed from partial counts and lands in no single task.

Defined results: a null text has no words and fails the base rules; a null host is a host of its
own; a null id is told from others by its text; equal rows count as one document and are judged
alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import small_batches, tidy, whole

SYMBOLS = b"#*$%&|<>"
#: Base rules: fewest words, largest share of words in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: A line is frequent in more documents of its host than LINE_DOCS and than LINE_SHARE of them, and in more than MOST_DOCS whatever the host's size.
LINE_DOCS, LINE_SHARE, MOST_DOCS = 20, 0.01, 1000
#: A document is depleted if it loses more than this share of its words, or keeps fewer than LEAST_LEFT.
MOST_LOST, LEAST_LEFT = 0.5, 25

_SPACES, _DIGITS = re.compile(r"\s+"), re.compile(r"\d")


def normalised(line: str) -> str:
    return _DIGITS.sub("0", _SPACES.sub(" ", line.lower()).strip())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); words are runs without ASCII white space."""
    data = text.encode()
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, b" \t\n\r\x0b\x0c")))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += bool(line.split())
        else:
            seen.add(line)
    repeated = 0
    if len(words) > 3:
        index: dict[bytes, int] = {}
        k = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        n = len(index)
        pairs = pd.factorize(k[:-2] * n + k[1:-1])[0]
        windows = pd.factorize(pairs * n + k[2:])[0]
        often = np.bincount(windows)[windows] >= 2
        covered = np.zeros(len(words), bool)
        for d in range(3):
            covered[d : d + len(often)] |= often
        repeated = int(covered.sum())
    return len(words), chars, symbols, dup, repeated


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_lines, n_removed_words), a row per row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(host_col).cast("string").alias("host"), whole(text_col).alias("text"))

    @tidy
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([base_counts(t) for t in b["text"]], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")
            out.insert(0, "id", b["id"].to_numpy())
            out.insert(1, "h", [xxhash.xxh3_128_digest(t) for t in b["text"]])
            yield out

    @tidy
    def lined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, host, text in zip(b["id"], b["host"], b["text"], strict=True):
                h, found = xxhash.xxh3_128_digest(text), {}
                for line in text.split("\n"):
                    if n := len(line.encode().split()):
                        x = xxhash.xxh3_128_digest(normalised(line))
                        lines, words = found.get(x, (0, 0))
                        found[x] = lines + 1, words + n
                out += [(key, h, host, x, *n) for x, n in found.items()]
            yield pd.DataFrame(out, columns=["id", "h", "host", "line", "n_lines", "n_line_words"])

    base = rows.drop("host").mapInPandas(counted, "id string, h binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    lines = rows.mapInPandas(lined, "id string, h binary, host string, line binary, n_lines int, n_line_words int")
    document = F.coalesce(F.col("id"), F.hex("h"))
    of_host = rows.select("host", F.coalesce("id", F.sha2("text", 256)).alias("d")).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    held = lines.groupBy("host", "line", document.alias("d")).agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min(line_docs, most_docs))
    limits = of_host.withColumnRenamed("host", "its_host")
    frequent = held.join(limits, F.col("host").eqNullSafe(F.col("its_host"))).where((F.col("docs") > F.col("host_docs") * line_share) & (F.col("docs") > line_docs) | (F.col("docs") > most_docs)).select(F.col("host").alias("its_host"), F.col("line").alias("its_line"))
    lost = (
        lines.join(frequent, F.col("host").eqNullSafe(F.col("its_host")) & (F.col("line") == F.col("its_line")))
        .groupBy("id", "h", "host", "line")
        .agg(F.max("n_lines").alias("n_lines"), F.max("n_line_words").alias("n_line_words"))
        .groupBy(F.col("id").alias("its_id"), F.col("h").alias("its_h"))
        .agg(F.sum("n_lines").alias("n_removed_lines"), F.sum("n_line_words").alias("n_removed_words"))
    )
    out = base.join(lost, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("h") == F.col("its_h")), "left").fillna(0, ["n_removed_lines", "n_removed_words"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))
    depleted = (F.col("n_removed_words") > MOST_LOST * F.col("n_words")) | (F.col("n_words") - F.col("n_removed_words") < LEAST_LEFT)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed_lines", "n_removed_words")
