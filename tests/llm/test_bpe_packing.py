from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from lattica.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    parts = ["the", "a", " ", "  ", "'s", "'ll", "ab", "12", "!", "<|endoftext|>", "\n", "ing", " t", "é", "ዓ", "一", "\x85", "​", "😀", "\U0010ffff", "࢏"]
    some = ["".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(n)]
    return [*some, "", " " * 300, "x" * 5000, "".join(r.choices("abetn", k=4000)), "\n\n" + "é" * 3000 + "\n\n 1", "don't we'll 'sab ''s 's's"]


def test_encode_equals_library(spark, library):
    rows = [(i, t, i) for i, t in enumerate(texts(1, 150))]
    rows += [(7, None, 0), (None, "no id", 0), (3, "again " * 100, 0), (3, "again " * 100, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    for leaf in (16, 1 << 15):
        out = bpe.decode(bpe.encode(df, PATH, leaf_chars=leaf), PATH).collect()
        want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows]
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        got = sorted(((r["doc_id"], list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"]))) for r in out), key=key)
        assert got == sorted(want, key=key)
        assert sorted(r["decoded"] for r in bpe.round_trip(df, PATH, leaf_chars=leaf).collect()) == sorted(r["decoded"] for r in out)
        assert sorted(r["decoded"] for r in out) == sorted(library.decode(ids, skip_special_tokens=False) for _, ids in want)


def test_join_windows_grow():
    e = bpe.ByteBpe(PATH)
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choices("abehtnrs", k=r.randint(2, 400))).encode()
        at = r.randint(1, len(text) - 1)
        assert e.joined(e.raw(text[:at]), e.raw(text[at:])).tolist() == e.raw(text).tolist()


@pytest.mark.parametrize("n", [1024, 4096])
def test_pieces_of_one_hash_keep_their_ids(library, n):
    """Thue-Morse words and their complements collide under every polynomial hash modulo 2 ** 64."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    both = [word, word.translate(str.maketrans("ab", "ba")), f"x {word} y"]
    e = bpe.ByteBpe(PATH)
    for texts in (both, both[::-1]):
        assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in e.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_unsplit_text_goes_through_joins(spark, library, monkeypatch):
    r = random.Random(6)
    text = "so " + "".join(r.choices("abehtnrs", k=100_000)) + " 1"
    ids = bpe.encode(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), PATH).collect()
    want = library.encode(text, add_special_tokens=False).ids
    assert [list(struct.unpack(f"<{len(x['ids']) // 4}I", x["ids"])) for x in ids] == [want, want]
    e, seen = bpe.ByteBpe(PATH), []
    joined = e.joined
    monkeypatch.setattr(e, "joined", lambda a, b: seen.append(1) or joined(a, b))
    e.encode_batch(["a" + "b" * bpe.HALF_CHARS])
    assert seen


def test_plan_fills_and_is_close_to_the_bound():
    r = random.Random(3)
    for capacity in (7, 64, 2048):
        counts = {r.randint(1, capacity): r.randint(1, 400) for _ in range(40)}
        slots: dict[int, list[tuple[int, int]]] = {}
        for length, rank, n, first, each, offset in packing.plan(counts, capacity):
            for k in range(n):
                slots.setdefault(first + k // each, []).append((offset + k % each * length, length))
        assert sum(len(s) for s in slots.values()) == sum(counts.values())
        for s in slots.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(k * n for k, n in counts.items())
        assert len(slots) <= 11 / 9 * max(math.ceil(total / capacity), sum(n for k, n in counts.items() if 2 * k > capacity)) + 1


def test_pack(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(4, 80))] + [(1, None), (None, None), (5, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(df, PATH, capacity=64).collect()
    want = []
    for i, t in rows:
        ids, start = [*library.encode(t or "", add_special_tokens=False).ids, 0], 0
        for k, n in enumerate(packing.cut_lengths(len(ids), 64)):
            want.append((i, k, start, n, zlib.crc32(struct.pack(f"<{n}I", *ids[start : start + n]))))
            start += n
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    rooms: dict[int, list[tuple[int, int]]] = {}
    for r in out:
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in rooms.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, PATH).count() == 0
    assert packing.pack(df, PATH).count() == 0
    clash = spark.createDataFrame([(1, "a", 1, 2, 3)], "doc_id long, text string, ids int, piece int, rank int")
    assert packing.pack(clash, PATH).count() == 1 and bpe.encode(clash, PATH).columns == ["doc_id", "ids"]


def test_digest_is_of_little_endian_ids(spark):
    df = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    ids = bpe.encode(df, PATH).first()["ids"]
    assert hashlib.sha256(ids).hexdigest() == hashlib.sha256(struct.pack("<2I", 31373, 995)).hexdigest()
