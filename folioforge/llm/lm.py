"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays,
memory-mapped by the workers that score.

The model has order two. Workers turn whole texts into word hashes, count what they hold in memory
and send, for each shard, one sorted array of keys with their counts; a shard's task merges these and
writes its arrays into the shared folder. Three passes over the texts:

1. words. A word's number is its place in the vocabulary's sorted hashes;
2. pairs, sharded by their first word (words with more than HOT_SHARE of a shard's tokens are split
   over several shards by the second). A shard holds the hashes of its pairs with their counts, and
   for each first word the total and how many pairs occur once, twice and more often; of the second
   words it sends on how many first words they follow;
3. scores: every text, against the arrays, mapped read-only.

Shards grow in number with the input, never in size; the driver holds a few numbers a shard. Order
two is what the disk budget allows: pairs take twice the input, and there are half as many triples again (the
README has the figures).

p(w | h) = (c(hw) - D(c(hw))) / c(h) + (D1 n1 + D2 n2 + D3 n3+)(h) / c(h) * q(w), and q likewise over the
numbers of first words, with what it discounts spread evenly over the vocabulary and one unknown
word. D1..D3 come from the counts of counts. A text runs from a start mark to one end token.

Defined cases: null text is empty and scores its end alone; a null id is hashed as empty text; without
training rows everything is unknown and has probability 1; repeated rows train and score each; scores do
not depend on order, so ties do not matter; extra columns are not read.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _A, mix, pick, scratch, sliced, words, written

END = np.uint64(0x5EEDED0FF00D0001)
START_ID, UNKNOWN_ID = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFE)
#: Tokens that a worker counts at once; bytes of text for each shard; share of a shard's tokens that splits a word.
AT_ONCE, SHARD_BYTES, HOT_SHARE = 3_000_000, 16 << 20, 0.25
_LOW = np.uint64(0xFFFFFFFF)


# --------------------------------------------------------------------------- arrays in the shared folder


def _write(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all: a repeated task writes the same bytes under the same name."""
    system, base = pafs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    own = f"{base}/.{name}.{os.getpid()}.{np.random.default_rng().integers(1 << 62)}"
    with system.open_output_stream(own, compression=None) as out:
        out.write(np.ascontiguousarray(array).view(np.uint8).data if array.size else b"")
    system.move(own, f"{base}/{name}")


_MAPPED: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()


def _mapped(folder: str, name: str, kind: type) -> np.ndarray:
    """An array, memory-mapped where the folder is a file system's, else read."""
    key = (folder, name)
    if key in _MAPPED:
        _MAPPED.move_to_end(key)
        return _MAPPED[key]
    system, base = pafs.FileSystem.from_uri(folder)
    if isinstance(system, pafs.LocalFileSystem):
        path = f"{base}/{name}"
        found = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    else:
        with system.open_input_file(f"{base}/{name}") as f:
            found = np.frombuffer(f.read(), kind)
    _MAPPED[key] = found
    while len(_MAPPED) > 8192:
        _MAPPED.popitem(last=False)
    return found


def _find(keys: np.ndarray, array: np.ndarray) -> np.ndarray:
    """Places of sorted ``keys`` in a sorted array, -1 where absent."""
    if not len(array):
        return np.full(len(keys), -1)
    at = np.searchsorted(array, keys)
    at[at == len(array)] = 0
    return np.where(array[at] == keys, at, -1)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, those over 254 apart."""
    big = np.flatnonzero(counts > 254)
    small = counts.astype(np.uint8)
    small[big] = 255
    return small.tobytes(), np.stack([big, counts[big]]).astype("<i8").tobytes()


def _unpack(small: bytes, big: bytes) -> np.ndarray:
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    rest = np.frombuffer(big, "<i8").reshape(2, -1)
    counts[rest[0]] = rest[1]
    return counts


_BLOBS = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("small", pa.binary()), ("big", pa.binary())])
BLOBS = "shard int, kind int, keys binary, small binary, big binary"


def _blobs(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, kind: int = 0) -> Iterator[pa.RecordBatch]:
    """One row a shard."""
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
    rows = []
    for a, b in zip(starts, [*starts[1:], len(shard)]):
        small, big = _pack(counts[a:b])
        rows.append({"shard": int(shard[a]), "kind": kind, "keys": keys[a:b].astype("<u8").tobytes(), "small": small, "big": big})
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_pylist(rows[at : at + 64], _BLOBS)


def _parts(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(k, "<u8"), _unpack(s, b)) for k, s, b in zip(pdf["keys"], pdf["small"], pdf["big"])]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each text and its end, and where texts start in them (one more at the end)."""
    hashes, rows = words(column)
    n = len(rows) - 1
    out = np.empty(len(hashes) + n, np.uint64)
    starts = rows + np.arange(n + 1)
    ends = starts[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = hashes
    out[ends] = END
    return out, starts


# --------------------------------------------------------------------------- pass 1: words


def _word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            found, _ = tokens(batch.column("text"))
            held.append(found)
            n += len(found)
            if n >= AT_ONCE:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                yield from _blobs(keys, counts, _word_shard(keys, shards))
                held, n = [], 0
        if n:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield from _blobs(keys, counts, _word_shard(keys, shards))

    return run


def _keep_words(folder: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(_parts(pdf))
        shard = int(pdf["shard"].iloc[0])
        _write(folder, f"word-{shard}", keys)
        _write(folder, f"count-{shard}", counts.astype(np.int64))
        return pd.DataFrame({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())]})

    return run


class Vocabulary:
    """Word hash -> number: a shard's base and the place in its sorted hashes."""

    def __init__(self, folder: str, sizes: np.ndarray) -> None:
        self.folder, self.sizes, self.base = folder, sizes, np.concatenate([[0], np.cumsum(sizes)])

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts) of sorted distinct hashes; UNKNOWN_ID and 0 where absent."""
        ids, counts = np.full(len(hashes), UNKNOWN_ID), np.zeros(len(hashes), np.int64)
        shard = _word_shard(hashes, len(self.sizes))
        edges = np.searchsorted(shard, np.arange(len(self.sizes) + 1))
        for s in np.flatnonzero(edges[1:] > edges[:-1]):
            if not self.sizes[s]:
                continue
            a, b = edges[s], edges[s + 1]
            at = _find(hashes[a:b], _mapped(self.folder, f"word-{s}", np.uint64))
            hit = at >= 0
            ids[a:b][hit] = (at[hit] + self.base[s]).astype(np.uint64)
            counts[a:b][hit] = _mapped(self.folder, f"count-{s}", np.int64)[at[hit]]
        return ids, counts

    def shard_of(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, ids.astype(np.int64), "right").astype(np.int64) - 1


# --------------------------------------------------------------------------- pass 2: pairs


def _pair_shard(keys: np.ndarray, shards: int, hot: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """By the first word; a hot one is spread over ``salts`` shards by the second."""
    first = keys >> np.uint64(32)
    shard = mix(first + np.uint64(1))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
        split = hot[at] == first
        shard[split] += mix(keys[split] & _LOW) % salts[at[split]].astype(np.uint64)
    return (shard % np.uint64(shards)).astype(np.int32)


def _pairs(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(previous word, word) of each token; a text's first follows the start mark."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[starts[:-1]] = START_ID
    return before << np.uint64(32) | ids


def _count_pairs(vocabulary: Vocabulary, shards: int, hot: np.ndarray, salts: np.ndarray):
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        yield from _blobs(mix(keys), counts, _pair_shard(keys, shards, hot, salts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            found, starts = tokens(batch.column("text"))
            distinct, back = np.unique(found, return_inverse=True)
            held.append(_pairs(vocabulary.look(distinct)[0][back], starts))
            n += len(found)
            if n >= AT_ONCE:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = x.copy()
    x ^= (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x


_PAIR_ROWS = "kind int, shard int, keys binary, small binary, big binary, n long, total long, n1 long, n2 long, n3 long, n4 long"
#: Kinds of rows that a pair shard sends on: its own figures; hot first words; second words.
_OWN, _HOT, _FOLLOW = 0, 1, 2


def _keep_pairs(folder: str, vocabulary: Vocabulary, hot: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        hashes, counts = _merged(_parts(pdf))
        small, big = _pack(counts)
        _write(folder, f"pair-{shard}", hashes)
        _write(folder, f"pairs-{shard}", np.frombuffer(small, np.uint8))
        _write(folder, f"many-{shard}", np.frombuffer(big, "<i8"))
        keys = _unmix(hashes)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = keys >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.zeros(0, np.int64)
        context = first[starts]
        figures = np.stack([np.add.reduceat(x.astype(np.int64), starts) for x in (counts, counts == 1, counts == 2, counts > 2)], 1) if len(starts) else np.zeros((0, 4), np.int64)
        at = np.isin(context, hot)
        _write(folder, f"context-{shard}", context[~at])
        _write(folder, f"figures-{shard}", figures[~at])
        own = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        rows = [(_OWN, shard, b"", b"", b"", len(counts), int(counts.sum()), *own)]
        rows += [(_HOT, shard, int(c).to_bytes(8, "little"), b"", b"", 0, *map(int, f), 0) for c, f in zip(context[at], figures[at])]
        second, follows = np.unique(keys & _LOW, return_counts=True)
        if len(second):
            home = vocabulary.shard_of(second)
            edges = np.searchsorted(home, np.arange(len(vocabulary.sizes) + 1))
            for s in np.flatnonzero(edges[1:] > edges[:-1]):
                a, b = edges[s], edges[s + 1]
                place = (second[a:b].astype(np.int64) - vocabulary.base[s]).astype("<u4")
                rows.append((_FOLLOW, int(s), place.tobytes(), *_pack(follows[a:b]), 0, 0, 0, 0, 0, 0))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _PAIR_ROWS.split(", ")])

    return run


def _keep_follows(folder: str, sizes: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        total = np.zeros(int(sizes[shard]), np.int64)
        for k, s, b in zip(pdf["keys"], pdf["small"], pdf["big"]):
            total[np.frombuffer(k, "<u4")] += _unpack(s, b)
        _write(folder, f"follow-{shard}", total)
        return pd.DataFrame({"shard": [shard], "n": [int(total.sum())], **{f"n{k}": [int((total == k).sum())] for k in (1, 2, 3, 4)}, "more": [int((total > 2).sum())]})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D(0), D(1), D(2), D(3 and more)."""
    if not n1:
        return np.zeros(4)
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1]
    d.append(2 - 3 * y * n3 / n2 if n2 else d[1])
    d.append(3 - 4 * y * n4 / n3 if n3 else d[2])
    return np.array([0.0, *(min(max(x, 0.0), k) for k, x in zip((1, 2, 3), d[1:]))])


# --------------------------------------------------------------------------- pass 3: scores


class Model:
    """Everything but the arrays: folder, sizes, hot first words with their figures, discounts, totals."""

    def __init__(self, folder: str, vocabulary: Vocabulary, shards: int, hot: np.ndarray, salts: np.ndarray, hot_figures: np.ndarray, d2: np.ndarray, d1: np.ndarray, tokens_: int, pairs: int, left: float) -> None:
        self.folder, self.vocabulary, self.shards, self.hot, self.salts, self.hot_figures = folder, vocabulary, shards, hot, salts, hot_figures
        self.d2, self.d1, self.tokens, self.pairs, self.left = d2, d1, tokens_, pairs, left

    @property
    def words(self) -> int:
        return int(self.vocabulary.base[-1])

    def lower(self, ids: np.ndarray) -> np.ndarray:
        """q of distinct sorted word numbers."""
        even = 1.0 / (self.words + 1)
        if not self.pairs:
            return np.full(len(ids), even)
        out = np.full(len(ids), self.left / self.pairs * even)
        n_known = int(np.searchsorted(ids, np.uint64(self.words)))
        known = ids[:n_known]
        home = self.vocabulary.shard_of(known)
        edges = np.searchsorted(home, np.arange(len(self.vocabulary.sizes) + 1))
        for s in np.flatnonzero(edges[1:] > edges[:-1]):
            a, b = edges[s], edges[s + 1]
            n = _mapped(self.folder, f"follow-{s}", np.int64)[known[a:b].astype(np.int64) - self.vocabulary.base[s]]
            out[a:b] += (n - self.d1[np.minimum(n, 3)]) / self.pairs
        return out

    def pair_scores(self, keys: np.ndarray) -> np.ndarray:
        """log10 p of distinct sorted (previous, word) keys."""
        word, back = np.unique(keys & _LOW, return_inverse=True)
        q = self.lower(word)[back]
        shard = _pair_shard(keys, self.shards, self.hot, self.salts)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        count, figures = np.zeros(len(keys), np.int64), np.zeros((len(keys), 4), np.int64)
        first = keys >> np.uint64(32)
        for s in np.flatnonzero(edges[1:] > edges[:-1]):
            at = order[edges[s] : edges[s + 1]]
            hashed = mix(keys[at])
            rank = np.argsort(hashed, kind="stable")
            found = _find(hashed[rank], _mapped(self.folder, f"pair-{s}", np.uint64))
            hit = found >= 0
            n = _mapped(self.folder, f"pairs-{s}", np.uint8)[found[hit]].astype(np.int64)
            big = np.flatnonzero(n == 255)
            if len(big):
                many = _mapped(self.folder, f"many-{s}", np.int64).reshape(2, -1)
                n[big] = many[1][np.searchsorted(many[0], found[hit][big])]
            count[at[rank[hit]]] = n
            context, here = np.unique(first[at], return_inverse=True)
            place = _find(context, _mapped(self.folder, f"context-{s}", np.uint64))
            known = _mapped(self.folder, f"figures-{s}", np.int64).reshape(-1, 4)
            if len(known):
                figures[at] = np.where(place[:, None] >= 0, known[place], 0)[here]
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
            split = self.hot[at] == first
            figures[split] = self.hot_figures[at[split]]
        total = figures[:, 0]
        seen = np.maximum(total, 1)
        p = (count - self.d2[np.minimum(count, 3)]) / seen + figures[:, 1:] @ self.d2[1:] / seen * q
        return np.log10(np.where(total > 0, p, q))

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        found, starts = tokens(column)
        distinct, back = np.unique(found, return_inverse=True)
        ids, counts = self.vocabulary.look(distinct)
        count = counts[back]
        keys, again = np.unique(_pairs(ids[back], starts), return_inverse=True)
        at = starts[:-1]
        base = np.log10((count + 1) / (self.tokens + self.words + 1))
        add = lambda x: np.add.reduceat(x, at) if len(at) else x[:0]  # noqa: E731  every text has an end
        return {"n_tokens": np.diff(starts), "n_known": add((count > 0).astype(np.int64)), "base_score": add(base), "score": add(self.pair_scores(keys)[again])}


def fit(texts: DataFrame, folder: str | None = None) -> Model:
    """The model of all rows of ``texts`` (one column, text)."""
    spark = texts.sparkSession
    folder = folder or scratch(spark, "lm")
    texts = texts.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(size // SHARD_BYTES) + 8
    counted = texts.mapInArrow(sliced(_count_words(shards), 2000), BLOBS)
    kept = written(counted.groupBy("shard").applyInPandas(_keep_words(folder), "shard int, n long, total long"), "lm-words").collect()
    sizes = np.zeros(shards, np.int64)
    for r in kept:
        sizes[r["shard"]] = r["n"]
    total = sum(r["total"] for r in kept)
    vocabulary = Vocabulary(folder, sizes)
    hot, salts = _hot_words(spark, folder, [r["shard"] for r in kept], vocabulary, max(1000.0, HOT_SHARE * total / shards), texts)
    pairs = texts.mapInArrow(sliced(_count_pairs(vocabulary, shards, hot, salts), 2000), BLOBS)
    sent = written(pairs.groupBy("shard").applyInPandas(_keep_pairs(folder, vocabulary, hot), _PAIR_ROWS), "lm-pairs")
    for s in range(shards):
        if not sizes[s]:
            _write(folder, f"follow-{s}", np.zeros(0, np.int64))
    own = sent.filter(F.col("kind") == _OWN).select("shard", "n", "n1", "n2", "n3", "n4").collect()
    present = {r["shard"] for r in own}
    for s in range(shards):
        if s not in present:
            for name in ("pair", "pairs", "many", "context", "figures"):
                _write(folder, f"{name}-{s}", np.zeros(0, np.uint8))
    figures = np.zeros((len(hot), 4), np.int64)
    for r in sent.filter(F.col("kind") == _HOT).select("keys", "total", "n1", "n2", "n3").collect():  # a few a shard
        figures[np.searchsorted(hot, np.uint64(int.from_bytes(r["keys"], "little")))] += [r["total"], r["n1"], r["n2"], r["n3"]]
    follows = sent.filter(F.col("kind") == _FOLLOW).select("shard", "keys", "small", "big").groupBy("shard").applyInPandas(_keep_follows(folder, sizes), "shard int, n long, n1 long, n2 long, n3 long, n4 long, more long")
    follows = written(follows, "lm-follows").collect()
    of = lambda rows, k: sum(r[k] for r in rows)
    d2 = discounts(*(of(own, f"n{k}") for k in (1, 2, 3, 4)))
    d1 = discounts(*(of(follows, f"n{k}") for k in (1, 2, 3, 4)))
    left = d1[1] * of(follows, "n1") + d1[2] * of(follows, "n2") + d1[3] * of(follows, "more")
    return Model(folder, vocabulary, shards, hot, salts, figures, d2, d1, total, of(follows, "n"), left)


def _hot_words(spark, folder: str, shards: list[int], vocabulary: Vocabulary, most: float, texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words with more than ``most`` tokens (as many as shards at most, by a factor), and over how
    many shards each is split. The start mark precedes as many tokens as there are texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["shard"]:
                counts = _mapped(folder, f"count-{s}", np.int64)
                at = np.flatnonzero(counts > most)
                yield pd.DataFrame({"id": at + vocabulary.base[s], "n": counts[at]})

    rows = spark.createDataFrame([(s,) for s in shards], "shard int").mapInPandas(run, "id long, n long").collect()
    found = {r["id"]: r["n"] for r in rows}
    n_texts = texts.count()
    if n_texts > most:
        found[int(START_ID)] = n_texts
    hot = np.array(sorted(found), np.uint64)
    return hot, np.array([int(-(-found[int(i)] // most)) for i in hot], np.int64)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row."""
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(found[n]) for n in ("n_tokens", "n_known", "base_score", "score")]], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    if kind == "void":
        rows, kind = rows.withColumn("doc_id", F.col("doc_id").cast("long")), "bigint"
    return rows.mapInArrow(sliced(run, 2000), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def score_all(docs: DataFrame, held: Callable[[Column], Column], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows that ``held`` (of the id as text) does not hold out, and score all."""
    rows = pick(docs, doc_id=doc_id, text=text)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    model = fit(rows.filter(~held(name)).select("text"))
    return score(rows, model).withColumn("held_out", held(name)).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
