"""Exact removal of long repeated byte strings, by suffix arrays.

Every string of ``length`` bytes (a window) holds the smallest hash of its pieces of ``gram``
bytes, its anchor; equal windows have equal anchors at equal places. Documents are dealt into
shards of about ``CHUNK_BYTES``, and anchors into as many ranges as there are partitions:

1. A shard sorts its anchors, cuts the sorted list at the splitters of all ranges by binary
   search, and ships the lists. A range merges the lists of all shards and tells each which of
   its anchors stand in several documents. Others cannot be in a repeated window.
2. A shard builds the suffix array of its text around such anchors by Larsson-Sadakane refinement
   in numpy (only suffixes whose order is still open are sorted again, by the rank of what
   follows at twice the distance), then common prefixes along it: Kasai's rule gives those of a
   suffix from the one before it, so bytes are compared only where the rule does not hold. Equal
   surroundings become one, with the smallest document; of each the bytes from the anchor on and
   those before it go to the anchor's range, in the order of the suffix array.
3. A range merges the sorted suffixes of all shards by binary search, and orders what stands
   before the anchors likewise. Two windows with the anchor at the same place are equal if both
   parts have common prefixes of their lengths; all but those of the smallest document are
   marked, a bit a window, and the marks go back to the shards.
4. A shard removes what marked windows cover.

A shard is made of rows that a task reads one after the other, so dealing moves nothing; whole
texts are written once, compressed, in rows of shards, which are shuffled to meet what comes back
from ranges. Beside them anchors, texts around repeated anchors and marks move. Copies are shipped once a shard, so a passage that a
third of all rows hold comes from each shard once, and in a range its equal texts become one. A
range works through its suffixes some at a time. Texts are compared as bytes, so no hash decides
a result.

Defined results: a null text counts as empty; texts shorter than a window keep all bytes; a null
id counts as smaller than any other; rows that share an id do not mark each other; repeats
within one text are no matches; an empty table gives no rows; other columns are not read,
whatever they are called. Ids are whole numbers; windows have at least 8 bytes.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, give_back, partitions, tidy, whole

LENGTH = 50
#: Bytes of a shard, about; suffixes of a range that are compared together, about.
CHUNK_BYTES, TOGETHER = 1 << 20, 1 << 17
#: Places of an anchor in a window are told apart by the bits of a mark.
MOST_PLACES = 27
#: Bits of an anchor: two pieces of one anchor cost a comparison, no more.
ANCHOR_BITS = 48
NO_ID = -(1 << 63)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram(length: int) -> int:
    """Bytes of an anchor's piece: a multiple of 8 that leaves at most MOST_PLACES places in a window."""
    if length < 8:
        raise ValueError("windows have at least 8 bytes")
    return max(8, 8 * -(-(length - MOST_PLACES + 1) // 8))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, zeros behind the end."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data),), "<u8", padded.tobytes(), 0, (1,)).astype(np.uint64)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first depth bytes, rank of each): Larsson-Sadakane refinement from 8 bytes on."""
    n = len(data)
    key = _words(data).byteswap()
    order = np.argsort(key, kind="stable").astype(np.int32)
    fresh = np.append(True, key[order][1:] != key[order][:-1])
    del key
    first = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), np.int32(0)))
    rank = np.empty(n, np.int32)
    rank[order] = first
    del first
    h = 8
    while h < depth:
        sizes = np.diff(np.append(np.flatnonzero(fresh), n))
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in order that are not settled
        if not len(open_):
            break
        at = order[open_]
        then = at.astype(np.int64) + h
        behind = np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        both = rank[at].astype(np.int64) * (n + 1) + behind
        del then, behind
        by = np.argsort(both, kind="stable")
        order[open_] = at[by]
        both = both[by]
        fresh[open_] = np.append(True, both[1:] != both[:-1]) | fresh[open_]
        first = np.maximum.accumulate(np.where(fresh[open_], open_, 0))
        rank[order[open_]] = first
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix of the order shares with the one before it, exact up to most."""
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    # Kasai: if i-1 follows j-1 in the order and i follows j, then i shares one byte less than i-1
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (data[:-1] == data[before[:-1]])
    # what is compared is bounded, so the rule is begun anew before it runs out
    place = np.arange(n, dtype=np.int32)
    since = place - np.maximum.accumulate(np.where(follows, np.int32(0), place))
    follows &= since % (most // 2) != 0
    starts = np.flatnonzero(~follows)
    words = _words(data)
    shared = np.zeros(len(starts), np.int64)
    live = np.flatnonzero(before[starts] >= 0)
    for k in range(0, most, 8):
        a, b = starts[live] + k, before[starts[live]].astype(np.int64) + k
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        x = words[a] ^ words[b]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        same = np.minimum(same, n - np.maximum(a, b))
        shared[live] += same
        live = live[same == 8]
    del words, since
    run = np.cumsum(~follows, dtype=np.int32) - 1
    plcp = np.maximum(shared.astype(np.int32)[run] - (place - starts.astype(np.int32)[run]), 0)
    plcp[before < 0] = 0
    return plcp[order]


def _kept(*parts: object) -> bytes:
    return zstandard.compress(pickle.dumps(parts, protocol=5), 3)


def _taken(data: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(data))


class Chunk:
    """A shard of documents, and its windows by anchor."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, none: np.ndarray, length: int = LENGTH):
        self.length, self.gram, self.ids, self.none = length, gram(length), ids, none
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def windows(self) -> None:
        """Runs of windows with one anchor: first and last window, anchor's place, hash (as a number in the sorted list of anchors)."""
        n, length = len(self.data), self.length
        ends = np.cumsum(self.sizes)
        of = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.first = self.last = self.place = self.doc = np.empty(0, np.int64)
        hashes = np.empty(0, np.uint64)
        if n >= length:
            step = lambda w, k: np.append(w[k:], np.zeros(min(k, n), w.dtype))
            words = _words(self.data)
            key = _mixed(words)
            for k in range(8, self.gram, 8):
                key = _mixed(key ^ step(words, k))
            del words
            # of equal pieces of a window the first one, wherever the window stands
            least = (key & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
            span, reach = length - self.gram + 1, 1  # pieces of a window; how many the minimum covers
            while 2 * reach <= span:
                least = np.minimum(least, step(least, reach))
                reach *= 2
            least = np.minimum(least, step(least, span - reach)) if span > reach else least
            s = np.flatnonzero(np.arange(n) + length <= ends[of])
            place = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            del least
            new = np.append(True, (place[1:] != place[:-1]) | (s[1:] != s[:-1] + 1) | (of[s[1:]] != of[s[:-1]]))[: len(s)]
            runs = np.flatnonzero(new)
            if len(runs):
                self.first, self.last, self.place = s[runs], s[np.append(runs[1:], len(s)) - 1], place[runs]
                self.doc = of[self.first].astype(np.int64)
                # least hashes are small numbers; mixed again they spread evenly over ranges
                hashes = _mixed(key[self.place]) >> np.uint64(64 - ANCHOR_BITS)
        self.anchors, self.which = np.unique(hashes, return_inverse=True)

    def edges(self, ranges: int) -> np.ndarray:
        """Where the sorted anchors are cut at the splitters of the ranges."""
        cuts = (np.arange(1, ranges, dtype=np.float64) / ranges * 2.0**ANCHOR_BITS).astype(np.uint64)
        return np.concatenate([[0], np.searchsorted(self.anchors, cuts), [len(self.anchors)]])

    def lists(self, ranges: int) -> list[tuple[int, bytes]]:
        """(range, its sorted anchors, each with whether several documents of the shard hold it)."""
        low, high = np.full(len(self.anchors), 2**62), np.full(len(self.anchors), -1)
        np.minimum.at(low, self.which, self.doc)
        np.maximum.at(high, self.which, self.doc)
        values = (self.anchors << np.uint64(1)) | (low != high).astype(np.uint64)
        edges = self.edges(ranges)
        return [(int(r), _squeezed(values[edges[r] : edges[r + 1]])) for r in np.flatnonzero(np.diff(edges))]

    def shipped(self, masks: dict[int, bytes], ranges: int) -> list[tuple[int, bytes]]:
        """(range, surroundings of its repeated anchors in the order of the suffix array), and as range -1 what marked() needs."""
        alive, edges = np.zeros(len(self.anchors), bool), self.edges(ranges)
        for r, mask in masks.items():
            a, b = edges[r], edges[r + 1]
            alive[a:b] = np.unpackbits(np.frombuffer(zlib.decompress(mask), np.uint8), count=b - a).astype(bool)
        runs = np.flatnonzero(alive[self.which])
        if not len(runs):
            return []
        length = self.length
        first, last, place, doc = self.first[runs], self.last[runs], self.place[runs], self.doc[runs]
        # stretches of text that windows of these runs cover, zeros between them
        begins = np.append(True, (first[1:] > last[:-1] + length) | (doc[1:] != doc[:-1]))
        stretch = np.cumsum(begins) - 1
        at = first[begins]
        size = last[np.append(np.flatnonzero(begins)[1:], len(runs)) - 1] + length - at
        to = np.cumsum(size + length) - size - length
        text = np.zeros(int(to[-1] + size[-1] + length), np.uint8)
        spots = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(to, size) + spots] = self.data[np.repeat(at, size) + spots]
        del spots
        moved = (to - at)[stretch]
        order, rank = suffix_array(text, length)
        same = np.empty(len(text), np.int32)
        same[order] = np.cumsum(common_prefixes(text, order, -(-2 * length // 8) * 8) < length)  # equal up to a window's length
        del order
        # equal surroundings: equal from the anchor on and from the first window on, with as many windows
        before, many = place - first, last - first
        key = (same[place + moved].astype(np.int64) * (len(text) + 1) + same[first + moved]) * 32 + before
        _, one, of = np.unique(key * 32 + many, return_index=True, return_inverse=True)
        least = np.full(len(one), 2**63 - 1)
        np.minimum.at(least, of, self.ids[doc])
        spot, back = (place + moved)[one], before[one]
        where = np.searchsorted(edges, self.which[runs[one]], "right") - 1
        by = np.lexsort((rank[spot], where))  # suffixes of a range, in order
        number = np.empty(len(one), np.int32)
        number[by] = np.arange(len(one))
        spot, back, where, least_, many_ = spot[by], back[by], where[by], least[by], many[one][by]
        ahead = text[np.minimum(spot[:, None] + np.arange(length), len(text) - 1)]
        behind = text[np.maximum(spot[:, None] - 1 - np.arange(MOST_PLACES - 1), 0)]
        behind[np.arange(MOST_PLACES - 1) >= back[:, None]] = 0
        found, counts = np.unique(where, return_counts=True)
        parts = np.append(0, np.cumsum(counts))
        out = [(int(r), _kept(ahead[a:b], behind[a:b], back[a:b].astype(np.uint8), many_[a:b].astype(np.uint8), least_[a:b])) for r, a, b in zip(found, parts, parts[1:], strict=False)]
        return [*out, (-1, _kept(first.astype(np.int32), before.astype(np.uint8), many.astype(np.uint8), number[of], self.ids[doc] > least[of], found, counts))]

    def marked(self, plan: bytes | None, marks: dict[int, bytes]) -> np.ndarray:
        """Bytes that marked windows cover."""
        cover = np.zeros(len(self.data) + self.length + 1, np.int32)
        if plan is not None:
            first, before, many, number, later, found, counts = _taken(plan)
            bits = np.concatenate([np.frombuffer(zlib.decompress(marks[r]), "<u4") if r in marks else np.zeros(n, "<u4") for r, n in zip(found.tolist(), counts.tolist(), strict=True)])
            bits = bits[number]
            for k in range(MOST_PLACES):  # the k-th window of each run
                on = (k <= many) & (later | ((bits >> np.maximum(before.astype(np.int64) - k, 0).astype(np.uint32)) & 1).astype(bool))
                at = first[on].astype(np.int64) + k
                np.add.at(cover, at, 1)
                np.add.at(cover, at + self.length, -1)
        return np.cumsum(cover)[: len(self.data)] > 0


def _squeezed(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, by byte planes."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def repeated(lists: list[np.ndarray]) -> list[np.ndarray]:
    """For the sorted anchor lists of a range, which anchors stand in several documents."""
    every = np.concatenate(lists)
    anchors, in_chunk = every >> np.uint64(1), (every & np.uint64(1)).astype(bool)
    distinct, of, count = np.unique(anchors, return_inverse=True, return_counts=True)
    several = count > 1
    several[of[in_chunk]] = True
    return np.split(several[of], np.cumsum([len(x) for x in lists])[:-1])


def merged(lists: list[np.ndarray]) -> np.ndarray:
    """The order of the concatenated lists, each of which is sorted: pairs of lists are merged by binary search, level by level."""
    starts = np.cumsum([0, *map(len, lists)])
    level = [(x, np.arange(a, a + len(x))) for x, a in zip(lists, starts, strict=False)]
    while len(level) > 1:
        up = [level[-1]] if len(level) % 2 else []
        for (x, i), (y, j) in zip(level[0:-1:2], level[1::2], strict=False):
            at = np.searchsorted(x, y, "right") + np.arange(len(y))
            first = np.ones(len(x) + len(y), bool)
            first[at] = False
            z, k = np.empty(len(first), x.dtype), np.empty(len(first), np.int64)
            z[first], z[at], k[first], k[at] = x, y, i, j
            up.append((z, k))
        level = up
    return level[0][1]


def _shared(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it; none for the first."""
    out = np.zeros(len(rows), np.int32)
    differ = rows[1:] != rows[:-1]
    out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def marks_of(ahead: list[np.ndarray], behind: np.ndarray, back: np.ndarray, many: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For the surroundings of each shard, ahead sorted within a shard: a bit for each place of the anchor whose window also starts in a document with a smaller id."""
    every = np.concatenate(ahead)
    out = np.zeros(len(every), "<u4")
    order = merged([np.ascontiguousarray(x).view(f"S{length}").ravel() for x in ahead])
    every = every[order]
    share = _shared(every)
    # slices end where the pieces of anchors differ
    ends = np.append(np.flatnonzero(share < gram(length))[1:], len(every))
    begin = 0
    while begin < len(every):
        end = int(ends[min(np.searchsorted(ends, begin + TOGETHER), len(ends) - 1)])
        at, common = order[begin:end], share[begin:end].copy()
        common[0] = 0
        size = back[at].astype(np.int64)
        rows = behind[at]
        by = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
        also = _shared(rows[by])
        ids, windows = owner[at], many[at].astype(np.int64)
        for a in range(int(size.max()) + 1):
            on = np.flatnonzero((a <= size) & (a >= size - windows))
            if not len(on):
                continue
            left = np.empty(len(at), np.int64)
            left[by] = np.cumsum(also < a) if a else 0
            key = np.cumsum(common < length - a)[on] * (len(at) + 1) + left[on]
            _, of = np.unique(key, return_inverse=True)
            least = np.full(int(of.max()) + 1, 2**63 - 1)
            np.minimum.at(least, of, ids[on])
            out[at[on[least[of] < ids[on]]]] |= np.uint32(1 << a)
        begin = end
    return out


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): a row per row of docs; kept holds the remaining bytes."""
    gram(length)
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    key, ranges = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), partitions(spark)
    rows = docs.select(F.col(id_col).isNull().alias("none"), key.alias("id"), F.encode(whole(text_col), "UTF-8").alias("text"))

    def chunk_of(data: bytes) -> Chunk:
        texts, ids, none = _taken(data)
        return Chunk(texts, ids, none, length)

    def table(key: tuple, rows: list[tuple[int, bytes]]) -> pd.DataFrame:
        give_back()
        return pd.DataFrame([(int(key[0]), r, x) for r, x in rows], columns=["chunk", "range", "data"])

    @tidy
    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in itertools.chain(batches, [None]):
            for row in () if b is None else zip(b["text"], b["id"], b["none"], strict=True):
                held.append(row)
                size += len(row[0])
                if size >= CHUNK_BYTES:
                    yield shard(part << 32 | made, held)
                    made, held, size = made + 1, [], 0
        if held:
            yield shard(part << 32 | made, held)

    def shard(number: int, rows: list[tuple[bytes, int, bool]]) -> pd.DataFrame:
        data = _kept([t for t, _, _ in rows], np.array([i for _, i, _ in rows], np.int64), np.array([n for _, _, n in rows], bool))
        return pd.DataFrame({"chunk": [number], "data": [data]})

    @tidy
    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, data in zip(b["chunk"], b["data"], strict=True):
                chunk = chunk_of(data)
                chunk.windows()
                yield table((number,), chunk.lists(ranges))

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        found = repeated([_unsqueezed(x) for x in b["data"]])
        return pd.DataFrame([(c, r, zlib.compress(np.packbits(m).tobytes(), 1)) for c, r, m in zip(b["chunk"], b["range"], found, strict=True) if m.any()], columns=["chunk", "range", "data"])

    def ship(key: tuple, b: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(masks):
            return table(key, [])
        chunk = chunk_of(b["data"].iloc[0])
        chunk.windows()
        return table(key, chunk.shipped(dict(zip(masks["range"], masks["data"], strict=True)), ranges))

    def mark(b: pd.DataFrame) -> pd.DataFrame:
        parts = [_taken(x) for x in b["data"]]
        found = marks_of([p[0] for p in parts], *(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4)), length)
        found = np.split(found, np.cumsum([len(p[0]) for p in parts])[:-1])
        del parts
        give_back()
        return pd.DataFrame([(c, r, zlib.compress(m.tobytes(), 1)) for c, r, m in zip(b["chunk"], b["range"], found, strict=True) if m.any()], columns=["chunk", "range", "data"])

    def removed(key: tuple, b: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return pd.DataFrame(columns=["id", "none", "n_bytes", "n_removed", "n_spans", "kept"])
        chunk = chunk_of(b["data"].iloc[0])
        answers = dict(zip(replies["range"].tolist(), replies["data"], strict=True))
        gone = chunk.marked(answers.pop(-1, None), answers)
        out, at = [], 0
        for n in chunk.sizes.tolist():
            g = gone[at : at + n]
            out.append((n, int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), chunk.data[at : at + n][~g].tobytes()))
            at += n
        give_back()
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"]).assign(id=chunk.ids, none=chunk.none)

    row = "chunk long, range int, data binary"
    shards = scratch.write(rows.mapInPandas(dealt, "chunk long, data binary"), "shards")
    masks = scratch.write(shards.mapInPandas(lists, row).groupBy("range").applyInPandas(merge, row), "masks")
    # a row of range -1 is a shard's own plan
    shipped = scratch.write(shards.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInPandas(ship, row), "shipped")
    marks = scratch.write(shipped.where("range >= 0").groupBy("range").applyInPandas(mark, row), "marks")
    replies = marks.unionByName(shipped.where("range < 0"))
    out = shards.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(removed, "id long, none boolean, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(~F.col("none"), F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
