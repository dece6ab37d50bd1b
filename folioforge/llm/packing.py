"""Packing token sequences by cutting-stock column generation.

Documents become token ids and an end id, and are cut at multiples of the sequence length, so a long
document fills whole sequences and leaves one rest. Piece lengths are counted in a histogram of
CAPACITY classes (lengths rounded up to GRAIN), which is all the driver sees, whatever the input's size.
A linear program picks how often each pattern of classes is used; its columns are priced by a knapsack
dynamic programme over the duals until none improves it, or the bound leaves less than GAP to gain.
Patterns are rounded down, what that leaves is filled greedily, and the plan is a table of rank
intervals: pieces are ranked within their class by partition offsets (no sort of a class in one task),
and a rank gives the sequence. Offsets follow from the pieces that share a sequence.

Ids are those of the vocabulary's own library: its added tokens are found in the text first, and what lies
between them is encoded by the ranks.

Defined cases: null text is empty and packs its end id alone; repeated rows are packed each; texts of
any length are cut; pieces of one length class are equal to the plan, ties go by partition and place;
no rows give no pieces; extra columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import pick, sliced, written

SEQUENCE, END_ID = 2048, 1
GRAIN = 8
CAPACITY = SEQUENCE // GRAIN
GAP = 1e-3
#: Chunks that a worker remembers, and the longest chunk it does.
CACHE, CACHED_LENGTH = 300_000, 48


class _Chunks(dict):
    """Chunk of text -> its ids as little-endian unsigned 32-bit integers, filled on demand."""

    def __init__(self, encode, before: str) -> None:
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(self.before + chunk), "<u4").tobytes()
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids


class Tokenizer:
    """Byte-level BPE. A single space or line feed between two other characters always starts a new
    pre-token, so texts are cut there and chunks are remembered; texts with any other white space are
    encoded whole."""

    def __init__(self, ranks_path: str, pattern: str, added: Mapping[str, int] | None = None) -> None:
        import tiktoken

        self.added = {k: np.array([v], "<u4").tobytes() for k, v in (added or {}).items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if self.added else None

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.spaced = _Chunks(self.encode, ""), _Chunks(self.encode, " ")
        self.line = np.array(self.encode("\n"), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.split is None:
            return self._between(text)
        parts = self.split(text)
        return b"".join(self.added[x] if i % 2 else self._between(x) for i, x in enumerate(parts))

    def _between(self, text: str) -> bytes:
        if not text:
            return b""
        parts: list[bytes] = []
        spaced = self.spaced.__getitem__
        for line in text.split("\n"):
            chunks = line.split()
            if not chunks or " ".join(chunks) != line:
                return np.array(self.encode(text), "<u4").tobytes()
            parts.append(self.first[chunks[0]])
            parts.extend(map(spaced, chunks[1:]))
            parts.append(self.line)
        parts.pop()
        return b"".join(parts)


def added_tokens(vocabulary_path: str) -> dict[str, int]:
    """The added tokens of a vocabulary in the tokenizers library's JSON, and their ids."""
    with open(vocabulary_path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in found):
        raise ValueError("added tokens that take white space or whole words only are not supported")
    return {t["content"]: t["id"] for t in found}


_LOADED: dict[tuple, Tokenizer] = {}


def _tokenizer(path: str, pattern: str, added: tuple[tuple[str, int], ...]) -> Tokenizer:
    if (path, pattern, added) not in _LOADED:
        _LOADED[path, pattern, added] = Tokenizer(path, pattern, dict(added))
    return _LOADED[path, pattern, added]


_PIECES = "part int, doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, local long, ids binary"


def _cutter(path: str, pattern: str, keep_ids: bool, added: tuple[tuple[str, int], ...]):
    end = np.array([END_ID], "<u4").tobytes()
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("local", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, ranks, row = _tokenizer(path, pattern, added), TaskContext.get().partitionId(), [0] * (CAPACITY + 1), 0
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = memoryview(encoder.ids(text or "") + end)
                total, row = len(ids) // 4, row + 1
                for start in range(0, total, SEQUENCE):
                    piece = ids[4 * start : 4 * (start + SEQUENCE)]
                    length = len(piece) // 4
                    bucket = -(-length // GRAIN)
                    values = (part, doc, row, start, length, zlib.crc32(piece), total, bucket, ranks[bucket], bytes(piece) if keep_ids else None)
                    ranks[bucket] += 1
                    for column, value in zip(out, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return cut


# --------------------------------------------------------------------------- the linear program


def _price(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern of a knapsack that may hold a class any number of times."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = np.searchsorted(sizes, room, "right")
        if n:
            value = best[room - sizes[:n]] + worth[:n]
            j = int(value.argmax())
            if value[j] > best[room] + 1e-12:
                best[room], choice[room] = value[j], j
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), pattern


def _start(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: patterns filled longest first, each used until one of its classes is exhausted.
    None holds a class exhausted before, so they are independent."""
    left, basis, x = need.copy(), np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes))
    open_ = np.ones(len(sizes), bool)
    for step in range(len(sizes)):
        room = capacity
        for i in range(len(sizes) - 1, -1, -1):
            if open_[i] and sizes[i] <= room:
                basis[i, step] = room // sizes[i]
                room -= basis[i, step] * sizes[i]
        held = np.flatnonzero(basis[:, step])
        times = left[held] / basis[held, step]
        out = held[times.argmin()]
        x[step] = times.min()
        left[held] = np.maximum(0.0, left[held] - x[step] * basis[held, step])
        left[out], open_[out] = 0.0, False
    return basis, x


def _inverse(basis: np.ndarray) -> np.ndarray:
    """By elimination. The driver keeps off threaded BLAS, which may not survive beside a JVM's forks."""
    n = len(basis)
    a = np.hstack([basis, np.eye(n)])
    for i in range(n):
        pivot = i + int(np.abs(a[i:, i]).argmax())
        a[[i, pivot]] = a[[pivot, i]]
        a[i] /= a[i, i]
        rest = a[:, i].copy()
        rest[i] = 0.0
        a -= np.outer(rest, a[i])
    return a[:, n:]


def patterns(counts: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, most: int = 2000) -> list[tuple[dict[int, int], int]]:
    """(pattern, times): every piece counted is in exactly one, and none is over ``capacity``."""
    sizes = np.array(sorted(s for s, n in counts.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([counts[int(s)] for s in sizes], float)
    basis, x = _start(sizes, need, capacity)
    inverse, bound = _inverse(basis), float((sizes * need).sum()) / capacity
    for _ in range(most):
        value, column = _price(sizes, inverse.sum(0), capacity)
        used = x.sum()
        bound = max(bound, used / max(1.0, value))
        if value <= 1 + 1e-9 or used - bound < max(0.5, gap * used):
            break
        step = (inverse * column).sum(1)
        ratio = np.full(len(x), np.inf)
        np.divide(x, step, out=ratio, where=step > 1e-9)
        out = int(ratio.argmin())
        theta = max(0.0, ratio[out])
        x = np.maximum(0.0, x - theta * step)
        x[out] = theta
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    times = np.floor(x + 1e-9).astype(np.int64)
    whole = basis.astype(np.int64)
    left = need.astype(np.int64) - whole @ times
    while (left < 0).any():  # rounding noise only
        times[int((whole[int(left.argmin())] > 0).argmax() if not times[whole[int(left.argmin())] > 0].any() else np.flatnonzero((whole[int(left.argmin())] > 0) & (times > 0))[0])] -= 1
        left = need.astype(np.int64) - whole @ times
    found = [({int(s): int(a) for s, a in zip(sizes, whole[:, i]) if a}, int(times[i])) for i in range(len(x)) if times[i]]
    while left.any():
        room, pattern = capacity, {}
        for i in range(len(sizes) - 1, -1, -1):
            n = min(int(left[i]), room // int(sizes[i]))
            if n:
                pattern[int(sizes[i])] = n
                room -= n * int(sizes[i])
        again = min(int(left[i]) // pattern[int(s)] for i, s in enumerate(sizes) if int(s) in pattern)
        for i, s in enumerate(sizes):
            left[i] -= again * pattern.get(int(s), 0)
        found.append((pattern, again))
    return found


def intervals(plan: Sequence[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Class -> (first rank, first sequence, pieces a sequence) of each pattern that holds it."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used, sequence = [0] * (capacity + 1), 0
    for pattern, times in plan:
        for size, n in pattern.items():
            out.setdefault(size, []).append((used[size], sequence, n))
            used[size] += n * times
        sequence += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in out.items()}


def _assigner(plan: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, ranks = batch.column("bucket").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, slot = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for b in np.unique(buckets):
                at = np.flatnonzero(buckets == b)
                first, base, each = plan[int(b)]
                j = np.searchsorted(first, ranks[at], "right") - 1
                beyond = ranks[at] - first[j]
                sequence[at] = base[j] + beyond // each[j]
                slot[at] = (CAPACITY - int(b)) * (CAPACITY + 1) + beyond % each[j]
            yield batch.append_column("sequence_id", pa.array(sequence)).append_column("slot", pa.array(slot))

    return assign


def pack(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False, added: Mapping[str, int] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece; ids if kept.
    ``part`` and ``copy`` tell the pieces of repeated documents apart."""
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(rows.mapInArrow(sliced(_cutter(ranks_path, pattern, keep_ids, tuple(sorted((added or {}).items()))), tidy=True), _PIECES), "pack-pieces")
    per_part = pieces.groupBy("part", "bucket").agg((F.max("local") + 1).alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(per_part.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-offsets")
    counts = {r["bucket"]: r["n"] for r in offsets.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # CAPACITY rows at most
    plan = intervals(patterns(counts))
    ranked = pieces.join(offsets.select("part", "bucket", "first"), ["part", "bucket"]).withColumn("rank", F.col("local") + F.col("first")).drop("local", "first")
    schema = StructType([*ranked.schema.fields, StructField("sequence_id", LongType()), StructField("slot", LongType())])
    placed = ranked.mapInArrow(_assigner(plan), schema)
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "copy", *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian unsigned 32-bit) from pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
