"""Byte-level BPE encoding and decoding by tree concatenation.

A text no longer than ``leaf_chars`` is encoded where it stands. A longer text is cut into
leaves, which are dealt over all tasks and encoded in parallel. Leaves end at pre-token
boundaries where there are any. A pre-token (text without a place to split it) of more than
HALF_CHARS characters is halved anywhere, and its halves again, over tasks or, if it is no longer
than a leaf, where it stands; where two halves meet, a window of tokens around the join is
encoded again, growing until its first token agrees with the left half and its last token with
the right half. A sequence of BPE tokens is the encoding of its text if and only if each pair of
neighbours is, so agreement at both ends makes the whole sequence exact.

Pre-tokens are told apart by their characters, never by hashes alone.

Defined results: a null text counts as empty and has no tokens; a null id stays null; repeated
rows give one result each; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from lattica.llm.common import partitions, small_batches, tidy, whole

#: Fixed value: the pre-token pattern of byte-level BPE (the tokenizers library's ByteLevel).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts up to so many characters are encoded whole.
LEAF_CHARS = 1 << 15
#: Pre-tokens of more characters are encoded as a tree of halves.
HALF_CHARS = 24
#: Pre-tokens up to so many characters are kept with their ids, at most so many of them a worker.
KEPT_CHARS, KEPT_PIECES = 64, 200_000
#: Rows of a result handed over at a time.
SLICE = 512
#: Characters of the texts that are split together.
BATCH_CHARS = 1 << 20
#: Classes of characters, and the mark between texts.
LETTER, NUMBER, OTHER, SPACE, END = range(5)
MARK = "\U0010ffff"
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Tokens on each side of a join in the first window.
WINDOW = 4


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, 2 * BATCH_CHARS), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each id of a tokenizer file."""
    of_char = {c: b for b, c in enumerate(byte_alphabet())}
    vocab, added = spec["model"]["vocab"], spec["added_tokens"]
    out = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in added)]))
    for token, k in vocab.items():
        out[k] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
    for t in added:
        out[t["id"]] = t["content"].encode()
    return out


class ByteBpe:
    """One tokenizer file in one process."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        if spec["model"].get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self.leaf_chars = leaf_chars
        self.special = {t["content"]: np.uint32(t["id"]).tobytes() for t in added}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        self.pattern = regex.compile(PATTERN)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.to_chars = dict(enumerate(alphabet))
        self.bytes_of = token_bytes(spec)
        self.model: models.BPE = Tokenizer.from_file(path).model
        self.own_split = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.same: set[str] = set(map(chr, range(128)))  # characters on whose class the pattern and the library agree
        self.other: set[str] = set()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ids = [vocab[a + b] for a, b in pairs]
        self.ranked = None
        if ids == sorted(ids) and all(c in vocab for c in alphabet):  # merges in the order of ids: ids are ranks
            ranks = {b: k for k, b in enumerate(self.bytes_of) if k not in {t["id"] for t in added}}
            self.ranked = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kinds = np.full(0x110000, OTHER, np.uint8)
        for kind, of in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(of, every):
                self.kinds[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
        self.kinds[ord(MARK)] = END
        self.kept: dict[str, bytes] = {}

    def raw(self, data: bytes) -> np.ndarray:
        """Ids of bytes that belong to one pre-token."""
        return np.array([t.id for t in self.model.tokenize(data.decode("latin-1").translate(self.to_chars))], "<u4")

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two encoded halves of one pre-token, exact as of the whole."""
        k = WINDOW
        while len(left) and len(right):
            a, b = left[-k:], right[:k]
            mid = self.raw(b"".join(self.bytes_of[i] for i in (*a, *b)))
            if (k >= len(left) or mid[0] == a[0]) and (k >= len(right) or mid[-1] == b[-1]):
                return np.concatenate([left[:-k] if k < len(left) else left[:0], mid, right[k:]])
            k *= 2
        return np.concatenate([left, right])

    def long_piece(self, piece: str) -> np.ndarray:
        """A pre-token of any length, as a tree of halves."""
        if len(piece) <= HALF_CHARS:
            return np.array(self.ranked.encode_ordinary(piece), "<u4") if self.ranked else self.raw(piece.encode())
        mid = len(piece) // 2
        return self.joined(self.long_piece(piece[:mid]), self.long_piece(piece[mid:]))

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens, as the library's own version of Unicode has them."""
        chars = set(text)
        self._probe(chars)
        return self.pattern.findall(text) if self.other.isdisjoint(chars) else self._library(text)

    def _probe(self, chars: set[str]) -> None:
        for c in chars - self.same - self.other:
            probes = (f"a{c}a", f"1{c}1", f"!{c}!", f" {c} ")
            (self.same if all(self.pattern.findall(p) == self._library(p) for p in probes) else self.other).add(c)

    def _library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.own_split.pre_tokenize_str(text)]

    def _ids(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        if self.ranked and len(piece) <= HALF_CHARS:
            ids = self.ranked.encode_ordinary(piece)
            return struct.pack(f"<{len(ids)}I", *ids)
        return self.long_piece(piece).astype("<u4").tobytes()

    def _odd(self, text: str) -> bool:
        """Whether a text holds added tokens, the mark between texts, or characters whose class the library sees otherwise."""
        if self.split and any(t in text for t in self.special) or MARK in text:
            return True
        if not text.isascii() and not self.same.issuperset(chars := set(text)):
            self._probe(chars)
            return not self.other.isdisjoint(chars)
        return False

    def _slow(self, text: str) -> bytes:
        found = self.split.findall(text) if self.split else []
        parts = self.split.split(text) if found else [text]
        return b"".join(b"".join(map(self._ids, self.pretokens(p))) + (self.special[found[i]] if i < len(found) else b"") for i, p in enumerate(parts))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        batch, size = [], 0
        for k, text in enumerate(texts):
            if self._odd(text):
                out[k] = self._slow(text)
                continue
            batch.append(k)
            size += len(text)
            if size > BATCH_CHARS:
                self._many(texts, batch, out)
                batch, size = [], 0
        if batch:
            self._many(texts, batch, out)
        return out

    def _many(self, texts: list[str], batch: list[int], out: list[bytes]) -> None:
        """Pre-tokens of many texts by runs of character classes; each distinct one is encoded once."""
        joined = MARK.join([texts[k] for k in batch]) + MARK
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kinds = self.kinds[codes]
        # two marks in a row are two runs: an empty text stands between them
        first = np.append(0, np.flatnonzero((kinds[1:] != kinds[:-1]) | (kinds[1:] == END)) + 1)
        kind, last = kinds[first], np.append(first[1:], len(codes)) - 1
        starts = np.zeros(len(codes) + 1, bool)
        starts[first] = True
        space = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != END))
        starts[last[space]] = True
        before = codes[np.maximum(first - 1, 0)]
        led = (first > 0) & (before == 32)  # a space goes with what follows it
        starts[first[led & (kind != SPACE) & (kind != END)]] = False
        quote = np.flatnonzero((kind[:-1] == OTHER) & (first[:-1] == last[:-1]) & (codes[first[:-1]] == 39) & ~led[:-1] & (kind[1:] == LETTER))
        if len(quote):
            at = first[quote]
            one, two = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
            size = np.where(np.isin(one, [115, 116, 109, 100]), 1, np.where((two == 101) & ((one == 114) | (one == 118)) | (two == 108) & (one == 108), 2, 0))
            size[(size == 2) & (last[quote + 1] == at + 1)] = 0
            at, size = at[size > 0], size[size > 0]
            starts[at + 1] = False
            starts[at + 1 + size] = True
        at = np.flatnonzero(starts[:-1])
        end = np.append(at[1:], len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(len(codes), BASE), out=sums[1:])
        h = (sums[end] - sums[at]) * _powers(len(codes), BASE_INVERSE)[at]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) ^ (end - at).astype(np.uint64)
        which, distinct = pd.factorize(h)
        where = np.empty(len(distinct), np.int64)
        where[which[::-1]] = np.arange(len(which))[::-1]
        # pieces of one hash that are not the same characters stand for themselves
        first_at, sizes_at = at[where][which], (end - at)[where][which]
        apart = codes != codes[np.minimum(np.arange(len(codes)) + np.repeat(first_at - at, end - at), len(codes) - 1)]
        unlike = np.flatnonzero((sizes_at != end - at) | (np.add.reduceat(apart, at) > 0))
        which[unlike] = len(where) + np.arange(len(unlike))
        where = np.append(where, unlike)
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        kept, found = self.kept, []
        for s, e in zip(at[where].tolist(), end[where].tolist(), strict=True):
            piece = joined[s:e]
            if (ids := kept.get(piece)) is None:
                ids = b"" if piece == MARK else self._ids(piece)
                if e - s <= KEPT_CHARS:
                    kept[piece] = ids
            found.append(ids)
        size = np.array([len(x) // 4 for x in found], np.int64)
        offset = np.cumsum(size) - size
        each = size[which]
        ends = np.cumsum(each)
        pool = np.frombuffer(b"".join(found), "<u4")
        ids = pool[np.repeat(offset[which] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        edges = [0, *ends[codes[at] == ord(MARK)].tolist()]
        data = ids.tobytes()
        for k, (a, b) in zip(batch, itertools.pairwise(edges), strict=True):
            out[k] = data[4 * a : 4 * b]

    def cut(self, text: str) -> list[tuple[str, bool, bool]]:
        """Leaves of a long text: the leaf, whether it is a part of one pre-token, whether it continues the leaf before it."""
        leaves, start, at, ends = [], 0, 0, []
        found = self.split.findall(text) if self.split else []
        for i, part in enumerate(self.split.split(text) if found else [text]):
            for piece in [*self.pretokens(part), *found[i : i + 1]]:
                end = at + len(piece)
                if len(piece) > self.leaf_chars and piece not in self.special:
                    self._leaf(leaves, text, start, at, ends)
                    n = 2
                    while len(piece) / n > self.leaf_chars:
                        n *= 2
                    edges = [at + len(piece) * k // n for k in range(n + 1)]
                    leaves += [(text[a:b], True, k > 0) for k, (a, b) in enumerate(itertools.pairwise(edges))]
                    start = end
                    ends = []
                elif end - start > self.leaf_chars:
                    self._leaf(leaves, text, start, at, ends)
                    start, ends = at, []
                at = end
                ends.append(at)
        leaves.append((text[start:], False, False))
        return [x for x in leaves if x[0]]

    @staticmethod
    def _leaf(leaves: list[tuple[str, bool, bool]], text: str, start: int, end: int, ends: list[int]) -> None:
        """text[start:end] as a leaf; white space at its end would be one pre-token there, so each such pre-token stands alone."""
        alone: list[tuple[str, bool, bool]] = []
        while ends and end > start:
            at = ends[-2] if len(ends) > 1 and ends[-2] > start else start
            if not regex.fullmatch(r"\s+", text[at:end]):
                break
            alone.insert(0, (text[at:end], True, False))
            end = at
            ends.pop()
        leaves += [(text[start:end], False, False), *alone]

    def leaf(self, text: str, raw: bool) -> bytes:
        return self.long_piece(text).astype("<u4").tobytes() if raw else self.encode_batch([text])[0]

    def grown(self, leaves: list[tuple[np.ndarray, bool]]) -> np.ndarray:
        """Ids of a text from the ids of its leaves, joined pairwise level by level; the flag tells that a leaf continues the one before it."""
        while len(leaves) > 1:
            up = []
            for i in range(0, len(leaves), 2):
                a, *b = leaves[i : i + 2]
                up.append(a if not b else (self.joined(a[0], b[0][0]) if b[0][1] else np.concatenate([a[0], b[0][0]]), a[1]))
            leaves = up
        return leaves[0][0] if leaves else np.empty(0, "<u4")


def decoded(ids: bytes, table: list[bytes]) -> str:
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[tuple[str, int], ByteBpe] = {}


def loaded(path: str, leaf_chars: int = LEAF_CHARS) -> ByteBpe:
    """The tokenizer of this worker process."""
    if (path, leaf_chars) not in _LOADED:
        _LOADED[path, leaf_chars] = ByteBpe(path, leaf_chars)
    return _LOADED[path, leaf_chars]


def _as_they_are(keys: list[str | None], ids: list[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"id": keys, "ids": ids})


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, then: Callable[[list[str | None], list[bytes]], pd.DataFrame] = _as_they_are, schema: str = "ids binary") -> DataFrame:
    """(id, ids): ids binary, little-endian unsigned 32-bit. One row per row of docs.

    ``then`` goes on in the worker that encoded: from ids of documents and their tokens to the
    columns id and ``schema``, any number of rows for a document.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), whole(text_col).alias("text"))  # pandas would turn long ids into floats beside a null

    @tidy
    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(tokenizer, leaf_chars)
        for b in batches:
            for at in range(0, len(b), SLICE):
                part = b.iloc[at : at + SLICE]
                yield then(part["id"].tolist(), bpe.encode_batch(part["text"].tolist()))

    @tidy
    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(tokenizer, leaf_chars)
        for b in batches:
            for key, h, text in zip(b["id"], b["h"], b["text"], strict=True):
                for k, (leaf, raw, on) in enumerate(bpe.cut(text)):
                    yield pd.DataFrame({"id": [key], "h": [h], "part": [k], "leaf": [leaf], "raw": [raw], "continues": [on]})

    @tidy
    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(tokenizer, leaf_chars)
        for b in batches:
            yield b.assign(ids=[bpe.leaf(t, r) for t, r in zip(b["leaf"], b["raw"], strict=True)])[["id", "h", "part", "continues", "ids"]]

    def grown(b: pd.DataFrame) -> pd.DataFrame:
        copies, one = int((b["part"] == 0).sum()), b.drop_duplicates("part").sort_values("part")
        ids = loaded(tokenizer, leaf_chars).grown([(np.frombuffer(x, "<u4"), c) for x, c in zip(one["ids"], one["continues"], strict=True)])
        return then([b["id"].iloc[0]] * copies, [ids.astype("<u4").tobytes()] * copies)

    size = F.length("text")
    few = rows.where(size <= leaf_chars).mapInPandas(short, f"id string, {schema}")
    # equal rows share a key; their leaves come as often as the rows do
    cut = rows.where(size > leaf_chars).withColumn("h", F.sha2("text", 256)).mapInPandas(leaves, "id string, h string, part int, leaf string, raw boolean, continues boolean")
    many = cut.repartition(partitions(docs.sparkSession), "id", "h", "part").mapInPandas(encoded, "id string, h string, part int, continues boolean, ids binary")
    many = many.groupBy("id", "h").applyInPandas(grown, f"id string, {schema}")
    return few.unionByName(many).select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *few.columns[1:])


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(id, ids, decoded): encode() and decode() in one pass."""

    def both(keys: list[str | None], ids: list[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"id": keys, "ids": ids, "decoded": [decoded(x, loaded(tokenizer, leaf_chars).bytes_of) for x in ids]})

    return encode(docs, tokenizer, id_col, text_col, leaf_chars, both, "ids binary, decoded string")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: the text of its ids, malformed bytes replaced as UTF-8 decoders do."""

    @tidy
    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(tokenizer, encoding="utf-8") as f:
            table = token_bytes(json.load(f))
        for b in batches:
            for at in range(0, len(b), SLICE):
                part = b.iloc[at : at + SLICE]
                yield part.assign(decoded=[decoded(x, table) if x is not None else "" for x in part[ids_col]])

    kept = encoded.select(F.col(id_col).cast("string").alias(id_col), ids_col)
    out = kept.mapInPandas(texts, f"`{id_col}` string, `{ids_col}` binary, decoded string")
    return out.withColumn(id_col, F.col(id_col).cast(encoded.schema[id_col].dataType))
