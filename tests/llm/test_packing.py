"""Packing: ids as the tokenizers library gives them, whole covers, patterns against brute force."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from folioforge.llm import packing

RANKS = P.path("byte_bpe_50k.tiktoken")
ADDED = packing.added_tokens(P.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, source string, length long, sequence_id long"


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x <|endoftext|> y\n<|endoftext|>\nz", "<|endoftext", "  <|endoftext|>  ", "a", " a", "a ", "  a  b", "it's we'll\n\nyes", "x\ny z\n", "\ttab nbsp em", "Ünïcödé 日本語 😀 12345 $$$ <|endoftext|>", "a\r\nb \n c", "don't's 's", "\x1c\x85 　x", "A" * 5000, "word " * 3000 + "end", "\n".join(["ligne une deux."] * 50)]


def test_ids_equal_the_library(reference):
    t = packing.Tokenizer(RANKS, P.PATTERN, ADDED)
    rng = random.Random(3)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", ".", "é", " ", "the", "日", "-", "<|endoftext|>", "<|", "|>"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(t.ids(text), "<u4").tolist() == reference(text), repr(text)


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    t = packing.Tokenizer(RANKS, P.PATTERN)
    for i in range(500):
        t.ids(f"w{i} v{i} u{i}")
    assert len(t.spaced) <= 50 and len(t.first) <= 50


def _check_plan(counts, plan, capacity):
    used = {}
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= capacity and times > 0
        for s, n in pattern.items():
            used[s] = used.get(s, 0) + n * times
    assert used == {s: n for s, n in counts.items() if n}
    return sum(t for _, t in plan)


def _first_fit(counts, capacity):
    rooms = []
    for s in sorted(counts, reverse=True):
        for _ in range(counts[s]):
            for i, r in enumerate(rooms):
                if r >= s:
                    rooms[i] -= s
                    break
            else:
                rooms.append(capacity - s)
    return len(rooms)


def test_patterns_beat_first_fit_and_reach_the_bound():
    rng = random.Random(1)
    for _ in range(12):
        counts = {s: rng.randrange(0, 60) for s in rng.sample(range(1, 65), 30)}
        assert _check_plan(counts, packing.patterns(counts, 64), 64) <= _first_fit(counts, 64) * 1.01 + 6
    for _ in range(8):  # with enough small pieces, nothing but the total matters
        counts = {s: rng.randrange(1000, 5000) for s in range(1, 33)}
        bins = _check_plan(counts, packing.patterns(counts, 64), 64)
        assert bins <= -(-sum(s * n for s, n in counts.items()) // 64) * 1.002 + 64
    assert packing.patterns({}) == []
    assert _check_plan({256: 7}, packing.patterns({256: 7}), 256) == 7


def test_patterns_match_brute_force_on_tiny_cases():
    def fewest(items, capacity):
        for n in range(1, len(items) + 1):
            for places in itertools.product(range(n), repeat=len(items)):
                if all(sum(s for s, p in zip(items, places) if p == b) <= capacity for b in range(n)):
                    return n

    rng = random.Random(2)
    for _ in range(15):
        items = [rng.randrange(1, 10) for _ in range(6)]
        bins = _check_plan({s: items.count(s) for s in items}, packing.patterns({s: items.count(s) for s in items}, 10), 10)
        assert fewest(items, 10) <= bins <= fewest(items, 10) + 1


def test_pieces_cover_every_id_once(spark, reference):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "cat", "Straße", "x1", "."]) for _ in range(rng.randrange(0, 900))), "s", -5, -6) for i in range(300)]
    rows += [(1000 + i, t, None, 0, 0) for i, t in enumerate(TEXTS)] + [(2000, None, "s", 0, 0), (2001, "same row", "s", 0, 0), (2001, "same row", "s", 0, 0), (None, "no id", "s", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    packed = packing.pack(docs, RANKS, P.PATTERN, keep_ids=True, added=ADDED)
    got = packed.collect()
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(reference(t or "") + [1])
    by_copy = {}
    for r in got:
        by_copy.setdefault((r.doc_id, r.part, r.copy), []).append(r)
    assert len(by_copy) == len(rows)
    for (doc, _, _), pieces in by_copy.items():
        pieces.sort(key=lambda r: r.start)
        ids = want[doc][0]
        at = 0
        for r in pieces:
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids == part and r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE
    total = sum(r.length for r in got)
    assert len(sequences) * 2048 <= total * 1.05 + 4 * 2048
    whole = packing.sequences(packed).collect()
    assert sum(r.n_tokens for r in whole) == total and all(len(r.ids) == 4 * r.n_tokens for r in whole)


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).count() == 0
