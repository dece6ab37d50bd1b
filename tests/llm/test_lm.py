"""The language model against a plain dictionary implementation, and its probabilities' sum."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import lm
from folioforge.llm.common import mix

SCHEMA = "doc_id long, text string, score string, n_tokens int"


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


class Plain:
    """Interpolated modified Kneser-Ney of order two, by the book."""

    def __init__(self, texts):
        self.c1, self.c2 = Counter(), Counter()
        for t in texts:
            w = _words(t)
            self.c1.update(w)
            self.c2.update(zip(["<s>", *w], w))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.total, self.kinds = Counter(), defaultdict(Counter)
        self.follow = Counter()
        for (h, w), c in self.c2.items():
            self.total[h] += c
            self.kinds[h][min(c, 3)] += 1
            self.follow[w] += 1
        of = lambda counts: [sum(1 for x in counts.values() if x == k) for k in (1, 2, 3, 4)]
        self.d2, self.d1 = lm.discounts(*of(self.c2)), lm.discounts(*of(self.follow))

    def q(self, w):
        even = 1 / (self.v + 1)
        if not self.c2:
            return even
        left = sum(self.d1[min(c, 3)] for c in self.follow.values())
        c = self.follow.get(w, 0)
        return (c - self.d1[min(c, 3)]) / len(self.c2) + left / len(self.c2) * even

    def p(self, h, w):
        if not self.total[h]:
            return self.q(w)
        c = self.c2.get((h, w), 0)
        left = sum(self.d2[k] * n for k, n in self.kinds[h].items())
        return (c - self.d2[min(c, 3)]) / self.total[h] + left / self.total[h] * self.q(w)

    def row(self, text):
        w = _words(text)
        base = sum(math.log10((self.c1.get(x, 0) + 1) / (self.n + self.v + 1)) for x in w)
        return len(w), sum(x in self.c1 for x in w), base, sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *w], w))


def _rows(n):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "x-y", "The", "THE", "\x1c"]
    return [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randrange(0, 60))), "s", 1) for i in range(n)] + [(n, None, "s", 1), (n + 1, "", "s", 1), (n + 2, "new words only\tHERE\n", "s", 1), (n + 2, "new words only\tHERE\n", "s", 1), (None, "w1 w2", "s", 1), (n + 3, "w0 " * 5000, "s", 1)]


@pytest.mark.parametrize(("share", "bytes_"), [(0.25, 16 << 20), (0.02, 2000)])
def test_matches_plain_counts(spark, monkeypatch, share, bytes_):
    monkeypatch.setattr(lm, "SHARD_BYTES", bytes_)
    monkeypatch.setattr(lm, "HOT_SHARE", share)
    monkeypatch.setattr("builtins.max", max)
    rows = _rows(200)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = lm.score_all(docs, lambda name: F.crc32(name) % 7 == 2).collect()
    import zlib

    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    plain = Plain([t for i, t, *_ in rows if not held(i)])
    want = sorted((str(i), held(i), *plain.row(t)) for i, t, *_ in rows)
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    assert len(want) == len(have)
    for w, h in zip(want, have):
        assert w[:4] == h[:4] and np.allclose(w[4:], h[4:], rtol=1e-9), (w, h)
    assert {r.train_tokens for r in got} == {plain.n}


def test_probabilities_sum_to_one():
    plain = Plain([t for _, t, *_ in _rows(80)])
    for h in ["<s>", "w0", "w59", "never"]:
        assert abs(sum(plain.p(h, w) for w in [*plain.c1, "<unseen>"]) - 1) < 1e-9


def test_unmix_inverts_mix():
    x = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (lm._unmix(mix(x)) == x).all()


def test_counts_over_a_byte():
    n = np.array([1, 254, 255, 256, 10**12, 3])
    assert (lm._unpack(*lm._pack(n)) == n).all()


def test_no_rows_and_no_training_rows(spark):
    assert lm.score_all(spark.createDataFrame([], SCHEMA), lambda name: F.crc32(name) % 7 == 2).count() == 0
    got = lm.score_all(spark.createDataFrame([(1, "a b", "", 0)], SCHEMA), lambda name: F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens) for r in got] == [(3, 0, 0.0, 0.0, 0)]
