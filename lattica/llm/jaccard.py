"""Exact n-gram Jaccard join by a token-group matrix.

A document's set holds the hashes of its word shingles. Equal sets fall into one class, and only
classes are compared. Similar classes are grouped: of those that share a minimum under one of a
few hash functions and are of about one size, each is compared with one centre (the one whose
tokens are the most common, so the least changed of many copies), and what such links join is a
group. Then the token-group matrix holds, for each token of a class's prefix, the groups that
have it, with bounds on their members: sizes, and the largest set that a member can still link
with if that token is the first that both have. A class asks the groups of sets of its size or
more that these bounds leave; a group's members are laid out in blocks with the union of their
tokens, and a block is opened only if its union holds as many of the query's tokens as the
threshold asks of the query. Before any tokens move, marks of a few bits a token (the tokens of a
set modulo a power of two, as a bitmap) leave out blocks that cannot be similar: bits of the one
set that the other lacks are tokens that it lacks. All links are verified on whole sets.

Tokens are ordered by how often they are (as a sketch of fixed size counts them over the whole
corpus; any order that all sets share is exact), then by value. If the first common token of two
sets stands at place p of the one and q of the other, they share at most as many tokens as follow
there, so each has a reach: the largest set that it can link with from that place. A copy with many
changes has them first, and cannot reach sets of its own size through the tokens that all copies
share: a large group of copies makes no rows for its pairs, linked or not. Nothing is capped.

Defined results: null, empty and wordless texts have an empty set and link with nothing (their
component is their own id); texts of fewer words than a shingle have one token; rows with equal
sets are one class, whatever their ids; a component's id is its smallest id, null only if all
are; repeated rows give a row each; other columns are not read (one_of_each hands them on,
whatever they are called); an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, drop_shuffles, near, sieved, tidy, whole
from lattica.llm.graph import components

WORDS, PERCENT = 5, 80
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
#: Hash functions whose minima propose centres, and the ratio of sizes that one centre serves.
MINIMA, ALIKE = 2, 1.3
#: Counters of the sketch, and its blocks.
COUNTERS, BLOCKS = 1 << 22, 64
#: Members of a block of a group.
BLOCK = 8
#: Bits of a mark for each token, at least.
MARK_BITS = 2
#: Characters of the texts that are hashed together.
SOME_CHARS = 1 << 20
KEPT_WORDS = 50_000
#: Rows handed over at a time.
SLICE = 512
MASK = np.uint64((1 << 48) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


class Shingles:
    """Sets of shingle hashes; word hashes are kept for a while."""

    def __init__(self, words: int = WORDS):
        self.words, self.kept = words, _Words()

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The sorted set of each text; texts are hashed some at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < SOME_CHARS:
                size += len(texts[end])
                end += 1
            yield from self._some(texts[at:end])
            at = end

    def _some(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        split = [t.encode().translate(_LOWER).split() for t in texts]
        sizes = [len(x) for x in split]
        pad = self.words - 1
        h = np.fromiter(map(self.kept.__getitem__, itertools.chain.from_iterable(split)), np.uint64, sum(sizes))
        whole = np.append(h, np.zeros(pad, np.uint64))
        sums = np.full(len(h), self.words, np.uint64)
        for j in range(self.words):
            sums = _mixed(sums + whole[j : len(h) + j])
        at = 0
        for n in sizes:
            if n >= self.words:
                yield np.unique(sums[at : at + n - pad])
            elif n:
                few = np.full(1, n, np.uint64)
                for x in h[at : at + n]:
                    few = _mixed(few + x)
                yield few
            else:
                yield np.empty(0, np.uint64)
            at += n


def _packed(tokens: np.ndarray) -> bytes:
    """Tokens in 6 bytes each; 48 bits tell the tokens of a pair of sets apart."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def least(n: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """Tokens that a set of n must share with any set at the threshold."""
    return -(-n * percent // 100)


def ordered(tokens: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by how often they are, about, then by value; and how often, as a logarithm."""
    often = levels[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)]
    by = np.sort((often.astype(np.uint64) << np.uint64(48)) | tokens)
    return by & MASK, often


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(whole(text_col)).alias("h"), whole(text_col).alias("text"))


def _sets(rows: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(id, h, n, node, tokens, block): a row for each row, tokens once for equal sets of a task; and, with a block of counters in tokens, what the task has counted."""

    @tidy
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, counts, seen = Shingles(words), np.zeros(COUNTERS, np.int32), set()
        for b in batches:
            for at in range(0, len(b), SLICE):
                part, out = b.iloc[at : at + SLICE], []
                for key, h, t in zip(part["id"], part["h"], shingles(part["text"].tolist()), strict=True):
                    node = xxhash.xxh3_128_digest(t.tobytes()) if len(t) else None
                    fresh = len(t) and node not in seen
                    if fresh:
                        seen.add(node)
                        np.add.at(counts, (t & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                    out.append((key, h, len(t), node, _packed(np.sort(t & MASK)) if fresh else None, None))
                if len(seen) > KEPT_WORDS:
                    seen.clear()
                yield pd.DataFrame(out, columns=["id", "h", "n", "node", "tokens", "block"])
        if counts.any():
            yield pd.DataFrame([(None, None, None, None, zlib.compress(x.tobytes(), 1), k) for k, x in enumerate(np.split(counts, BLOCKS))], columns=["id", "h", "n", "node", "tokens", "block"])

    return scratch.write(rows.mapInPandas(made, "id string, h long, n int, node binary, tokens binary, block int"), "sets")


def _levels(sets: DataFrame) -> np.ndarray:
    """How often tokens are over all classes (of each task), as a whole logarithm, in a fixed number of counters."""

    def summed(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS // BLOCKS, np.int64)
        for b in batches:
            for x in b["tokens"]:
                total += np.frombuffer(zlib.decompress(x), np.int32)
        yield pd.DataFrame({"block": [key[0]], "levels": [np.log2(total + 1).astype(np.uint8).tobytes()]})

    out = np.zeros(COUNTERS, np.uint8)
    each = COUNTERS // BLOCKS
    found = sets.where("block is not null").select("block", "tokens").groupBy("block").applyInPandas(summed, "block int, levels binary")
    for r in found.collect():  # COUNTERS bytes, whatever the corpus
        out[r["block"] * each : (r["block"] + 1) * each] = np.frombuffer(r["levels"], np.uint8)
    return out


def _tokens(sets: DataFrame, wanted: DataFrame, of: Callable[[DataFrame], DataFrame] = lambda some: some) -> DataFrame:
    """(node, n, tokens) of the wanted classes, each once; or what of, row by row, makes of these."""
    some = sets.where("tokens is not null and node is not null").select("node", "n", "tokens")
    # the sieve keeps the join from shuffling the whole table; a semi-join would be moved below it
    some = of(sieved(some, "node", wanted, "node"))
    return some.join(near(wanted.select(F.col("node").alias("want"))), F.col("node") == F.col("want")).drop("want").dropDuplicates(["node"])


def mark(tokens: np.ndarray) -> bytes:
    """A bitmap of the tokens modulo its length, a power of two."""
    size = 1 << (max(MARK_BITS * len(tokens), 64) - 1).bit_length()
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(data: bytes, size: int) -> int:
    """The mark that data would be with size bytes, its own or fewer."""
    n, bits = len(data), int.from_bytes(data, "little")
    while n > size:
        n //= 2
        bits = (bits & ((1 << 8 * n) - 1)) | (bits >> 8 * n)
    return bits


def may_link(n: int, a: bytes, m: int, b: bytes, percent: int = PERCENT) -> bool:
    """Whether sets of n and m tokens may be similar, by their marks; never false if they are."""
    size = min(len(a), len(b))
    x, y = _folded(a, size), _folded(b, size)
    both = (x & y).bit_count()
    common = min(n - (x.bit_count() - both), m - (y.bit_count() - both))
    return 100 * common >= percent * (n + m - common)


def _marks(some: DataFrame) -> DataFrame:
    """(node, n, mark) for (node, n, tokens)."""

    @tidy
    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "n": b["n"], "mark": [mark(_unpacked(x)) for x in b["tokens"]]})

    return some.mapInPandas(marked, "node binary, n int, mark binary")


def _hopeful(asked: DataFrame, blocks: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The rows (a, block) of asked whose block has a member that may link with a, by the marks of both."""

    @tidy
    def hopeful(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [any(may_link(n, own, m, its, percent) for m, its in zip(sizes, marks, strict=True)) for n, own, sizes, marks in zip(b["n"], b["mark"], b["sizes"], b["marks"], strict=True)]
            yield b.loc[keep, ["a", "block"]]

    groups = marks.join(near(blocks), "node").groupBy("block").agg(F.collect_list("n").alias("sizes"), F.collect_list("mark").alias("marks"))  # about BLOCK members
    asking = marks.select(F.col("node").alias("a"), "n", "mark").join(near(asked), "a")
    return asking.join(groups.hint("shuffle_merge"), "block").mapInPandas(hopeful, "a binary, block string")


def _opened(asked: DataFrame, blocks: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b) for each query a of asked (a, block) and each member b of the block that is as similar as asked."""

    def packed(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("node")
        return pd.DataFrame({"block": [b["block"].iloc[0]], "nodes": [b["node"].tolist()], "sizes": [b["n"].tolist()], "members": [b"".join(b["tokens"])]})

    @tidy
    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for a, tokens, nodes, sizes, members in zip(b["a"], b["tokens"], b["nodes"], b["sizes"], b["members"], strict=True):
                query, all_of = _unpacked(tokens), _unpacked(members)
                at = np.searchsorted(query, all_of)
                hit = query[np.minimum(at, len(query) - 1)] == all_of
                if len(np.unique(at[hit])) < least(len(query), percent):  # the union of the block holds too few
                    continue
                ends = np.cumsum(sizes)
                shared = np.append(0, np.cumsum(hit))
                for node, n, end in zip(nodes, sizes, ends, strict=True):
                    common = int(shared[end] - shared[end - n])
                    if 100 * common >= percent * (len(query) + n - common) and node != a:
                        out.append((a, node))
            yield pd.DataFrame(out, columns=["a", "b"])

    groups = tokens.join(near(blocks), "node").groupBy("block").applyInPandas(packed, "block string, nodes array<binary>, sizes array<int>, members binary")
    asking = tokens.select(F.col("node").alias("a"), "tokens").join(near(asked), "a")
    return asking.join(groups.hint("shuffle_merge"), "block").mapInPandas(opened, "a binary, b binary").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, h, n_shingles, component_id, class_id, component): a row per row of docs; h is Spark's xxhash64 of the text, class_id the smallest id with an equal set, component a key of the component, null for empty sets."""
    scratch, kind = Scratch(docs.sparkSession, "jaccard"), docs.schema[id_col].dataType
    sets = _sets(_rows(docs, id_col, text_col), words, scratch)
    levels = _levels(sets)

    @tidy
    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for node, n, data in zip(b["node"], b["n"], b["tokens"], strict=True):
                tokens = _unpacked(data)
                minima = [int((_mixed(tokens + np.uint64(_MIX[j + 2]))).min().astype(np.int64)) for j in range(MINIMA)]
                by, often = ordered(tokens, levels)
                out.append((node, int(n), float(often.mean()), minima, int(np.log(n) / np.log(ALIKE)), _packed(by[: n - least(n, percent) + 1])))
            yield pd.DataFrame(out, columns=["node", "n", "common", "minima", "size", "prefix"])

    once = sets.where("node is not null and tokens is not null").select("node", "n", "tokens")
    once = once.mapInPandas(described, "node binary, n int, common double, minima array<long>, size int, prefix binary").dropDuplicates(["node"])
    once = scratch.write(once, "described")
    drop_shuffles(scratch.spark)
    ids = scratch.write(sets.where("block is null").select("id", "h", "n", "node"), "ids")

    # groups: what links to common centres joins
    grouped, linked = once.select("node", F.col("node").alias("group")), None
    for j in range(MINIMA):
        keyed = once.select("node", "size", "common", F.col("minima")[j].alias("m")).join(grouped, "node")
        centre = F.max_by(F.struct("node", "group"), F.struct("common", "node"))
        centres = keyed.groupBy("m", "size").agg(centre.alias("c"), F.count("*").alias("many")).where("many > 1").select(F.col("m").alias("its_m"), F.col("size").alias("its_size"), F.col("c.node").alias("centre"), F.col("c.group").alias("its_group"))
        asked = keyed.join(centres.hint("shuffle_merge"), (F.col("m") == F.col("its_m")) & (F.col("size") == F.col("its_size"))).where("group != its_group")
        asked = scratch.write(asked.select(F.col("node").alias("a"), "centre"), f"asked-{j}")
        wanted = scratch.write(asked.select(F.col("a").alias("node")).unionByName(asked.select(F.col("centre").alias("node"))).distinct(), f"wanted-{j}")
        tokens = scratch.write(_tokens(sets, wanted), f"tokens-{j}")
        drop_shuffles(scratch.spark)
        blocks = asked.select(F.col("centre").alias("node"), F.hex("centre").alias("block")).distinct()
        found = scratch.write(_opened(asked.select("a", F.hex("centre").alias("block")), blocks, tokens, percent), f"links-{j}")
        linked = found if linked is None else linked.unionByName(found)
        scratch.drop(f"tokens-{j}")
        drop_shuffles(scratch.spark)
        # each class has one key and one centre, so the links of a round are stars
        star = (found if j == 0 else components(linked, scratch, "groups").select(F.col("node").alias("a"), F.col("component").alias("b"))).withColumnRenamed("a", "its_node")
        named = once.select("node").join(star.hint("shuffle_merge"), F.col("node") == F.col("its_node"), "left")
        grouped = scratch.write(named.select("node", F.coalesce("b", "node").alias("group")), f"grouped-{j}")

    # the matrix: tokens of prefixes by groups; only tokens of several groups can link what is not yet one
    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), SLICE):
                yield b.iloc[at : at + SLICE]

    @tidy
    def tokens_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            yield pd.DataFrame({"token": _unpacked(b"".join(b["prefix"])).astype("<i8")})

    @tidy
    def places_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            sizes = np.array([len(p) // 6 for p in b["prefix"]], np.int64)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pd.DataFrame({"token": _unpacked(b"".join(b["prefix"])).astype("<i8"), "of": np.repeat(b["key"].to_numpy(np.int64), sizes), "place": place})

    # tokens of several classes first, which asks for the tokens alone; then short rows of these; what else is known of a class (or of two with one hash) joins the rest
    keyed = once.select(F.xxhash64("node").alias("key"), "prefix")
    shared = keyed.select("prefix").mapInPandas(tokens_of, "token long").groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select(F.col("token").alias("t"))
    shared = scratch.write(shared, "shared")
    drop_shuffles(scratch.spark)
    # the sieve keeps the places of all other tokens where they are
    some = sieved(keyed.mapInPandas(places_of, "token long, of long, place int"), "token", shared, "t")
    some = scratch.write(some.join(near(shared), F.col("token") == F.col("t")).drop("t"), "places")
    drop_shuffles(scratch.spark)
    known = once.select("node", "n").join(grouped.select("node", F.xxhash64("group").alias("g")), "node").withColumn("key", F.xxhash64("node"))
    far = F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent) - F.col("n")
    some = scratch.write(some.join(known.hint("shuffle_merge"), F.col("of") == F.col("key")).select("token", "node", "g", "n", far.cast("int").alias("reach")), "some")
    scratch.drop("places")
    drop_shuffles(scratch.spark)
    matrix = some.groupBy(F.col("token").alias("its_token"), F.col("g").alias("its_g")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("its_reach"))
    # the smaller set asks; of equal ones that of the group with the larger name
    fits = (F.col("g") != F.col("its_g")) & (F.col("low") <= F.col("reach")) & (F.col("high") >= F.col("n")) & (F.col("its_reach") >= F.col("n")) & ((F.col("high") > F.col("n")) | (F.col("g") > F.col("its_g")))
    asked = some.where("reach >= n").join(matrix.hint("shuffle_merge"), (F.col("token") == F.col("its_token")) & fits).select(F.col("node").alias("a"), "its_g").distinct()
    asked = scratch.write(asked, "asked")
    scratch.drop("some")
    drop_shuffles(scratch.spark)
    its = scratch.write(asked.select(F.col("its_g").alias("the_g")).distinct(), "its")
    inside = scratch.write(grouped.select("node", F.xxhash64("group").alias("g")).join(near(its), F.col("g") == F.col("the_g"), "left_semi"), "inside")
    large = scratch.write(inside.groupBy(F.col("g").alias("the_g")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"), "large")
    members = inside.join(near(large), F.col("g") == F.col("the_g"), "left")
    members = scratch.write(members.select("node", "g", F.concat_ws("-", "g", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))).alias("block")), "members")
    of_group = members.select(F.col("g").alias("the_g"), "block").distinct()
    queries = scratch.write(asked.join(of_group.hint("shuffle_merge"), F.col("its_g") == F.col("the_g")).select("a", "block"), "proposed")
    named = scratch.write(queries.select(F.col("a").alias("node")).unionByName(members.select("node")).distinct(), "named")
    marks = scratch.write(_tokens(sets, named, _marks), "marks")
    drop_shuffles(scratch.spark)
    queries = scratch.write(_hopeful(queries, members.select("node", "block"), marks, percent), "queries")
    hoped = scratch.write(queries.select(F.col("block").alias("its_block")).distinct(), "hoped")
    members = scratch.write(members.join(near(hoped), F.col("block") == F.col("its_block")).select("node", "block"), "hopeful")
    for name in ("members", "proposed", "named", "marks", "hoped"):
        scratch.drop(name)
    wanted = scratch.write(queries.select(F.col("a").alias("node")).unionByName(members.select("node")).distinct(), "wanted")
    drop_shuffles(scratch.spark)
    tokens = scratch.write(_tokens(sets, wanted), "tokens")
    for name in ("sets", "described", "asked", "shared", "inside"):
        scratch.drop(name)
    drop_shuffles(scratch.spark)
    found = scratch.write(_opened(queries, members, tokens, percent), "links")
    for name in ("tokens", "queries", "hopeful"):
        scratch.drop(name)
    drop_shuffles(scratch.spark)

    # links between groups join them
    own, its = grouped.select(F.col("node").alias("a"), F.col("group").alias("ga")), grouped.select(F.col("node").alias("b"), F.col("group").alias("gb"))
    between = found.join(own.hint("shuffle_merge"), "a").join(its.hint("shuffle_merge"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    named = components(between, scratch, "components").select(F.col("node").alias("its_group"), "component")
    first = ids.where("n > 0").groupBy("node").agg(F.min(F.col("id").cast(kind)).alias("class_id"))
    whole_of = grouped.join(named.hint("shuffle_merge"), F.col("group") == F.col("its_group"), "left").select("node", F.coalesce("component", "group").alias("component")).join(first.hint("shuffle_merge"), "node")
    whole_of = scratch.write(whole_of, "classes")
    names = whole_of.groupBy(F.col("component").alias("its_component")).agg(F.min("class_id").alias("component_id"))
    per_class = whole_of.join(names.hint("shuffle_merge"), F.col("component") == F.col("its_component")).select(F.col("node").alias("its_node"), "component_id", "class_id", "component")
    out = ids.join(per_class.hint("shuffle_merge"), F.col("node") == F.col("its_node"), "left")
    own = F.col("id").cast(kind)
    return out.select(own.alias(id_col), "h", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, own).otherwise(F.col("component_id")).alias("component_id"), F.when(F.col("n") == 0, own).otherwise(F.col("class_id")).alias("class_id"), "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, the one with the smallest id (then hash of its text); rows equal in id and text are one document."""
    scratch = Scratch(docs.sparkSession, "jaccard-kept")
    named = classes(docs, id_col, text_col, words, percent)
    known = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "h")
    kept = named.where("component is not null").groupBy("component").agg(F.min(known).alias("k")).select("k.id", "k.h")
    kept = scratch.write(kept.unionByName(named.where("component is null").select(F.col(id_col).alias("id"), "h")).distinct(), "kept")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(whole(text_col)).alias("hash"), F.col(id_col).alias("key"))
    return keyed.join(kept.hint("shuffle_merge"), F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")), "left_semi").select("row.*")
