"""Best-fit packing by length histogram.

Only the counts of piece lengths go to the driver (as many as a sequence has tokens, at most).
Best-fit decreasing runs over counts: all pieces of one length are placed in one step, so its
cost depends on the capacity and not on the corpus. The plan says, for each run of ranks within
a length, in which sequences and at which offsets they go; pieces then take their slots by rank
within their length. Ranks come from counts of (length, bucket), so that no length, however
common, is numbered in one task.

Defined results: a null text counts as empty and is one piece of the end token alone; repeated
rows are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import bpe
from lattica.llm.common import Scratch, tidy

CAPACITY, END_ID = 2048, 0
#: Rows of a bucket of one length, about, and the most buckets.
BUCKET_ROWS, BUCKETS = 512, 1 << 16


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, and before them what is left over."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, pieces a sequence, first offset)."""
    open_at: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, how many)
    rooms: list[int] = []
    out, sequences = [], 0

    def leave(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in open_at:
                bisect.insort(rooms, room)
            open_at.setdefault(room, []).append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
            else:
                room, first = capacity, sequences
                many = -(-left // (capacity // length))
                sequences += many
            each = room // length
            placed = min(left, many * each)
            out.append((length, rank, placed, first, each, capacity - room))
            filled, rest = divmod(placed, each)
            leave(room - each * length, first, filled)
            if rest:
                leave(room - rest * length, first + filled, 1)
            leave(room, first + filled + bool(rest), many - filled - bool(rest))
            left, rank = left - placed, rank + placed
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of each document, its end token added."""
    end = np.uint32(end_id).astype("<u4").tobytes()

    def cut(keys: list[str | None], ids: list[bytes]) -> pd.DataFrame:
        rows = []
        for key, data in zip(keys, ids, strict=True):
            data, start = data + end, 0
            for k, n in enumerate(cut_lengths(len(data) // 4, capacity)):
                part = data[4 * start : 4 * (start + n)]
                rows.append((key, k, start, n, zlib.crc32(part), part))
                start += n
        out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "ids"])
        return out if with_ids else out.drop(columns="ids")

    return bpe.encode(docs, tokenizer, id_col, text_col, then=cut, schema="piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset."""
    spark = docs.sparkSession
    cut = Scratch(spark, "packing").write(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = int(min(BUCKETS, max(1, -(-sum(counts.values()) // BUCKET_ROWS))))
    slots = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    starts = (slots[:, 0] << 46) + slots[:, 1]

    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "ids_crc32"))
    ranked = dealt.withColumn("within", within).join(firsts.hint("shuffle_merge"), ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("within") - 1).drop("bucket", "within", "first")

    @tidy
    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = slots[np.searchsorted(starts, (b["length"].to_numpy(np.int64) << 46) + b["rank"].to_numpy(np.int64), "right") - 1]
            nth, slot = np.divmod(b["rank"].to_numpy(np.int64) - s[:, 1], np.maximum(s[:, 4], 1))
            yield b.drop(columns="rank").assign(sequence_id=s[:, 3] + nth, offset=s[:, 5] + slot * s[:, 0])[[*names, "sequence_id", "offset"]]

    names = cut.columns
    kinds = {f.name: "string" if f.name == id_col else f.dataType.simpleString() for f in cut.schema.fields}
    out = ranked.withColumn(id_col, F.col(id_col).cast("string")).mapInPandas(take, ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", sequence_id long, offset long")
    return out.withColumn(id_col, F.col(id_col).cast(cut.schema[id_col].dataType))
