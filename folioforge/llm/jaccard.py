"""Size-aware heavy-light join of word shingle sets by Jaccard similarity, and its components.

Equal sets are one class, so copies never meet pairwise. Classes up to a size boundary are light: a
pair of sizes needs a known overlap, and each light set enumerates its subsets of just that many
shingles; sets that share one link, with nothing left to verify, and every group is joined to its
smallest member. Larger classes are heavy: they scan inverted lists. A list holds the sets that have
its shingle among their rarest (so few that two linked sets must share one of them), with size and
place, which bound the overlap that is still possible. The boundary is the one of least cost, from
the histogram of sizes.

Rarity: shingles that repeat within blocks of documents are counted, and a bounded table of the most
repeated puts those last. It orders shingles and decides no pair, so any table gives the same result.

Lists need not be expanded into pairs. In each round every entry meets a few anchors of its list,
first those whose shared shingle is placed earliest (the sets nearest to a common original), then
random ones; pairs already in one component are skipped, and the first round leaves nothing over of
lists as short as its anchors. Before sets are fetched, a pair has to pass a bitmap bound: bits of one
set's bitmap that are not in the other's stand for shingles that it lacks. What is left across
components after the rounds is compared in full, behind that bound inside the join. So no link between
different components is lost, and a group of thousands of near copies costs a few comparisons a member.

A class is a set (its hash and its size) and has a number of its own; ids only name components in the
end. A row is found again by a hash of its id and its text.

Defined cases: null text, or text without words, has the empty set and links with nothing, itself
included; with fewer words than a shingle the whole sequence is one; rows of one id take part each
with its own text, whether they are equal or not; so do rows with null ids, which come last when a component
is named (a component of null ids alone has a null id); ties do not occur, components are sets; no
rows give no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import comparable, free, marked, mix, pick, place_of, runs, sliced, slim, words, written

#: Shingles that order lists as frequent, at most; repeats within a block that count; shingles a block.
FREQUENT, REPEATS, BLOCK = 1 << 18, 2, 1_000_000
#: Anchors of a list in each round. The first round's are the earliest placed.
ANCHORS = (4, 8, 16)
#: Pairs that may be looked at for each entry before rounds of random anchors pay.
PAIRS_AN_ENTRY = 64
#: What an inverted list's entry costs, an enumerated subset's being 1.
ENTRY_COST = 3.0
#: Bits of a bitmap: a power of two, twice the shingles at least, within these.
LEAST_BITS, MOST_BITS = 1024, 8192


def needed(s: int, t: int, similarity: tuple[int, int]) -> int:
    """The least overlap of sets of s and t shingles that are similar: a/b of their union."""
    a, b = similarity
    return -(-a * (s + t) // (a + b))


def linked(overlap: int, s: int, t: int, similarity: tuple[int, int]) -> bool:
    return similarity[1] * overlap >= similarity[0] * (s + t - overlap)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, rows = words(column)
    grams = runs(hashes, k)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(runs(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _code(s: np.ndarray) -> int:
    """A hash of a set and its size, as a signed 64-bit integer. With the set's size it names a class."""
    total = np.array([mix(s).sum(dtype=np.uint64) if len(s) else np.uint64(0)], np.uint64) ^ np.uint64(len(s))
    return int(mix(total)[0].view(np.int64))


def _bitmap(s: np.ndarray) -> np.ndarray:
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 2 * len(s)):
        bits *= 2
    flags = np.zeros(bits, bool)
    flags[(mix(s) >> np.uint64(40)).astype(np.int64) % bits] = True
    return np.packbits(flags, bitorder="little").view("<i8")


_SIGNATURES = "key long, doc_id long, n int, code long, bitmap array<long>, is_shingle boolean"


def _signatures(k: int):
    """Rows (key, doc_id, n, code, bitmap), and rows of repeated shingles (n of documents, value as code)."""

    def rows(key, ids, n, code, maps: list[np.ndarray], is_shingle: bool) -> pa.RecordBatch:
        offsets = np.cumsum([0, *map(len, maps)]).astype(np.int32)
        bitmap = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(maps) if maps else np.zeros(0, np.int64), pa.int64()))
        return pa.RecordBatch.from_arrays([key, ids, pa.array(n, pa.int32()), pa.array(code, pa.int64()), bitmap, pa.array(np.full(len(code), is_shingle))], names=["key", "doc_id", "n", "code", "bitmap", "is_shingle"])

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= REPEATS
        none = pa.nulls(int(often.sum()), pa.int64())
        return rows(none, none, n[often].astype(np.int32), value[often].view(np.int64), [np.zeros(0, np.int64)] * int(often.sum()), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        total = 0
        for batch in batches:
            sets = shingle_sets(batch.column("text"), k)
            codes = [_code(s) for s in sets]
            yield rows(batch.column("key"), batch.column("doc_id"), np.array([len(s) for s in sets], np.int32), np.array(codes, np.int64), [_bitmap(s) for s in sets], False)
            for s, c in zip(sets, codes):
                if len(s) and (c, len(s)) not in seen:  # copies do not make a shingle frequent
                    seen.add((c, len(s)))
                    held.append(s)
                    total += len(s)
            if total >= BLOCK:
                yield repeated(held)
                held, total = [], 0
                seen.clear()
        if held:
            yield repeated(held)

    return run


# --------------------------------------------------------------------------- light sets


def subsets_of(size: int, similarity: tuple[int, int], boundary: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, subset size) of each pair of light sizes that a set of ``size`` is in."""
    a, b = similarity
    return [(min(size, t), max(size, t), needed(size, t, similarity)) for t in range(-(-a * size // b), min(boundary, b * size // a) + 1) if t > 0]


def boundary_of(histogram: dict[int, int], similarity: tuple[int, int], most: int = 64) -> int:
    """The largest light size: least cost of subsets below and list entries above."""
    a, b = similarity

    def entries(s: int) -> int:
        return s - -(-a * s // b) + 1

    best, least = 0, None
    for boundary in range(most + 1):
        cost = ENTRY_COST * sum(n * entries(s) for s, n in histogram.items() if s > 0 and b * s > a * boundary)
        cost += sum(n * sum(comb(s, o) for _, _, o in subsets_of(s, similarity, boundary)) for s, n in histogram.items() if 0 < s <= boundary)
        if least is None or cost < least:
            best, least = boundary, cost
        if boundary and comb(boundary, needed(boundary, boundary, similarity)) > 100_000:
            break
    return best


def _subset_keys(s: np.ndarray, similarity: tuple[int, int], boundary: int) -> Iterator[tuple[int, bool]]:
    """(key, whether the set is the larger) for each subset; equal sizes count as both by being the smaller."""
    from itertools import combinations

    hashed = mix(s)
    whole = hashed.sum(dtype=np.uint64)
    for small, large, size in subsets_of(len(s), similarity, boundary):
        left_out = len(s) - size
        tag = mix(np.array([small << 32 | large], np.uint64))[0]
        for out in combinations(range(len(s)), left_out):
            rest = whole - hashed[list(out)].sum(dtype=np.uint64) if out else whole
            yield int(mix(np.array([rest ^ tag], np.uint64))[0].view(np.int64)), small != large and len(s) == large


# --------------------------------------------------------------------------- heavy sets


def _frequency(values: np.ndarray, frequent: np.ndarray, weight: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
    return np.where(frequent[at] == values, weight[at], 0)


def _entries(k: int, similarity: tuple[int, int], boundary: int, frequent: np.ndarray, weight: np.ndarray):
    """(value, code, at): list entries of sets that may meet a heavy one, ``at`` being place and size in
    one; and of light sets their subsets' keys, with place -1 for the smaller side and -2 for the larger."""
    a, b = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            value, code, size, place = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n, c = len(s), _code(s)
                if not n or (c, n) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add((c, n))
                if n <= boundary:
                    for key, larger in _subset_keys(s, similarity, boundary):
                        value.append(np.array([key], np.int64))
                        place.append(np.array([-2 if larger else -1], np.int64))
                        code.append(np.array([c], np.int64))
                        size.append(np.array([n], np.int64))
                if b * n > a * boundary:
                    few = n - -(-a * n // b) + 1
                    order = np.lexsort((mix(s), _frequency(s, frequent, weight)))[:few]
                    value.append(s[order].view(np.int64))
                    place.append(np.arange(few))
                    code.append(np.full(few, c))
                    size.append(np.full(few, n))
            if value:
                at = np.concatenate(place).astype(np.int64) << 32 | np.concatenate(size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(value).astype(np.int64)), pa.array(np.concatenate(code).astype(np.int64)), pa.array(at)], names=["value", "code", "at"])

    return run


def _full_sets(k: int, most: int = 1 << 20):
    """(cid, members) of the rows whose set is the class that was asked for, in batches of some ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, members, held = [], [], 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(members, pa.binary())], names=["cid", "members"])  # noqa: B023

            for cid, code, n, s in zip(*[batch.column(c).to_pylist() for c in ("cid", "code", "n")], shingle_sets(batch.column("text"), k)):
                if len(s) == n and _code(s) == code:
                    ids.append(cid)
                    members.append(s.astype("<u8").tobytes())
                    held += len(members[-1])
                    if held >= most:
                        yield made()
                        ids, members, held = [], [], 0
            yield made()

    return run


def _once_a_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of a task's rows with a key: repeated rows are not shuffled. More of them would do no harm."""
    seen: set[int] = set()
    for batch in batches:
        new = [k not in seen and (seen.add(k) or True) for k in batch.column("key").to_pylist()]
        yield batch.filter(pa.array(new, pa.bool_()))
        if len(seen) > 500_000:
            seen.clear()


def _sets_of(rows: DataFrame, classes: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """cid, members of the classes in ``ids``, each from the text of one of its rows: few others are shuffled."""
    wanted = written(classes.join(ids, "cid", "left_semi").select("key", "cid", "code", "n"), "jaccard-wanted")
    texts = marked(rows, wanted).filter("_maybe").select("key", "text").mapInArrow(sliced(_once_a_key, tidy=True), "key long, text string").join(slim(wanted), "key")
    out = written(texts.select("cid", "code", "n", "text").mapInArrow(sliced(_full_sets(k), tidy=True), "cid long, members binary"), "jaccard-sets", records=100)
    free(wanted)
    return out


def _folded(bitmap: Column, words: Column) -> Column:
    """The bitmap cut in parts of so many words, laid over each other."""
    last = F.size(bitmap) - 1
    laid = F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.aggregate(F.sequence(i, last, words), F.lit(0).cast("long"), lambda x, j: x.bitwiseOR(F.get(bitmap, j))))
    return F.when(F.size(bitmap) == words, bitmap).otherwise(laid)


def _lacks(x: Column, y: Column) -> Column:
    """Shingles of x that y surely lacks."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, m: n + m)


def _reaches(bound: Column, n: Column, m: Column, similarity: tuple[int, int]) -> Column:
    a, b = similarity
    return bound * F.lit(a + b) >= (n + m) * F.lit(a)


def _bitmaps(ids: DataFrame, classes: DataFrame, signatures: DataFrame) -> DataFrame:
    """cid, n, bitmap of the classes in ``ids``, each from the signature of one of its rows (several, if that row is repeated)."""
    known = written(marked(classes, ids, "cid").filter("_maybe").select("key", "cid", "n"), "jaccard-known")
    return marked(signatures.select("key", "bitmap"), known).filter("_maybe").select("key", "bitmap").join(slim(known), "key").select("cid", "n", "bitmap")


def _plausible(pairs: DataFrame, classes: DataFrame, signatures: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b) whose bitmaps leave room for enough shared shingles."""
    asked = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    known = _bitmaps(asked, classes, signatures)
    met = pairs.join(known.toDF("a", "an", "am"), "a").join(known.toDF("b", "bn", "bm"), "b")
    words = F.least(F.size("am"), F.size("bm"))
    x, y = _folded(F.col("am"), words), _folded(F.col("bm"), words)
    bound = F.least(F.col("an") - _lacks(x, y), F.col("bn") - _lacks(y, x))
    return met.filter(_reaches(bound, F.col("an"), F.col("bn"), similarity)).select("a", "b").distinct()


def _compared(similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, held, x = [], None, None
            first, second = batch.column("a_members"), batch.column("b_members")
            for i, a in enumerate(batch.column("a").to_pylist()):
                if a != held:
                    held, x = a, np.frombuffer(first[i].as_buffer(), "<u8")
                y = np.frombuffer(second[i].as_buffer(), "<u8")
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                keep.append(linked(int((large[at] == small).sum()), len(x), len(y), similarity))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def _compare(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``pairs`` (a, b) with whether their sets are similar. A set travels once, and once for each of
    its pairs as the second; the many pairs of a first are split by the adaptive join."""
    right = sets.toDF("b", "b_members").join(slim(pairs), "b")
    met = right.join(sets.toDF("a", "a_members"), "a")
    return met.select("a", "b", "a_members", "b_members").mapInArrow(sliced(_compared(similarity), tidy=True), "a long, b long, linked boolean")


# --------------------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """id, label (the smallest id it is connected with) of every id in ``edges`` (a, b); a written table.
    Every round takes the least label among neighbours, then the label's own label; tables are
    written between rounds, and nothing is collected."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.filter("a <> b").distinct(), "components-edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id").withColumn("old", F.col("label")), "components-start")
    while True:
        now = labels.select("id", "label")
        near = both.join(slim(now.withColumnRenamed("id", "b")), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = now.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = now.select(F.col("id").alias("label"), F.col("label").alias("next"))
        stepped = written(least.join(jump, "label", "left").select("id", F.least("label", F.coalesce("next", "label")).alias("label"), "old"), "components-step")
        free(labels)
        labels = stepped
        if labels.filter("label <> old").isEmpty():
            free(both)
            return labels


# --------------------------------------------------------------------------- the join


def _fits(similarity: tuple[int, int]) -> Column:
    """Whether entries x and y of one list, of different components, may be similar by sizes and places.
    Similar sets pass in the list of their first common shingle: neither's earlier places are shared."""
    a, b = similarity
    fits = (F.col("x.label") != F.col("y.label")) & (F.col("x.n") * b >= F.col("y.n") * a) & (F.col("y.n") * b >= F.col("x.n") * a)
    bound = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    return fits & _reaches(bound, F.col("x.n"), F.col("y.n"), similarity)


def _pairs(x: DataFrame, y: DataFrame, fits: Column) -> DataFrame:
    met = x.alias("x").join(y.alias("y"), (F.col("x.value") == F.col("y.value")) & fits)
    return met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of lists that hold several components, with theirs."""
    entries = lists.join(slim(labels.select(F.col("id").alias("cid"), "label")), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    several = entries.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("value")
    return entries.join(several, "value", "left_semi")


def _with_anchors(entries: DataFrame, similarity: tuple[int, int], anchors: int, order: Column) -> DataFrame:
    """(a, b) of entries of one list that can still be similar: each entry with ``anchors`` of its list."""
    chosen = entries.withColumn("r", F.row_number().over(Window.partitionBy("value").orderBy(order, "cid"))).filter(F.col("r") <= anchors).drop("r")
    return _pairs(entries, chosen, _fits(similarity))


def _pairs_left(entries: DataFrame) -> tuple[int, int]:
    """Pairs that ``_with_all`` would look at, and entries."""
    held = entries.groupBy("value", "label").count().groupBy("value").agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    r = held.agg(F.sum(F.col("n") * (F.col("n") - F.col("most"))).alias("pairs"), F.sum("n").alias("n")).first()  # one row
    return r["pairs"] or 0, r["n"] or 0


def _with_all(entries: DataFrame, classes: DataFrame, signatures: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b) of entries of one list that can still be similar: all outside its largest component
    with all. The bitmaps, folded to the least length, are part of the join's condition."""
    ids = entries.select("cid").distinct()
    maps = _bitmaps(ids, classes, signatures).select("cid", _folded(F.col("bitmap"), F.lit(LEAST_BITS // 64)).alias("m"))
    entries = entries.join(maps, "cid")
    largest = entries.groupBy("value", "label").count().groupBy("value").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    outside = entries.join(largest, "value").filter("label <> largest").drop("largest")

    x, y = F.col("x.m"), F.col("y.m")
    bound = F.least(F.col("x.n") - _lacks(x, y), F.col("y.n") - _lacks(y, x))
    return _pairs(entries, outside, _fits(similarity) & _reaches(bound, F.col("x.n"), F.col("y.n"), similarity))


def _frequent(repeated: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles counted most often, sorted, and their counts: all above the count that leaves at most
    FREQUENT of them, by a histogram, so nothing is sorted in one place."""
    counted = written(repeated.groupBy("code").agg(F.least(F.sum("n"), F.lit(1 << 14)).cast("int").alias("n")), "jaccard-frequent")
    histogram = sorted(((r["n"], r["c"]) for r in counted.groupBy("n").agg(F.count("*").alias("c")).collect()), reverse=True)  # 2**14 rows at most
    total, least = 0, 1 << 15
    for n, c in histogram:
        if total + c > FREQUENT:
            break
        total, least = total + c, n
    found = counted.filter(F.col("n") >= least).toArrow()  # FREQUENT rows at most
    free(counted)
    values, counts = found.column("code").to_numpy().view(np.uint64), found.column("n").to_numpy().astype(np.int32)
    order = np.argsort(values, kind="stable")
    return values[order], counts[order]


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def _in_components(rows: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """key, doc_id, n, and of rows with words label (of the component) and least (its smallest id)."""
    signed = written(rows.mapInArrow(sliced(_signatures(k), tidy=True), _SIGNATURES), "jaccard-signatures")
    signatures = signed.filter("not is_shingle").select("key", "doc_id", "n", "code", "bitmap")
    frequent, weight = _frequent(signed.filter("is_shingle").select("code", "n"))
    classes = signatures.filter("n > 0").groupBy("code", "n").agg(F.min("key").alias("key"), F.min("doc_id").alias("least"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    histogram = {r["n"]: r["c"] for r in classes.filter(F.col("n") <= 128).groupBy("n").agg(F.count("*").alias("c")).collect()}  # 128 rows at most
    boundary = boundary_of(histogram, similarity)

    entries = rows.select("text").mapInArrow(sliced(_entries(k, similarity, boundary, frequent, weight), tidy=True), "value long, code long, at long")
    whole = Window.partitionBy("value")  # subsets' keys are hashed apart from shingles
    shared = entries.select("*", F.min("code").over(whole).alias("lo"), F.max("code").over(whole).alias("hi")).filter("lo <> hi").select("value", "code", "at").distinct()
    shared = shared.select("value", "code", F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("n"), F.shiftright("at", 32).cast("int").alias("place"))
    shared = written(shared.join(slim(classes.select("code", "n", "cid")), ["code", "n"]).select("value", "cid", "n", "place"), "jaccard-lists")
    lists = shared.filter("place >= 0")

    by_subset = shared.filter("place < 0").groupBy("value").agg(F.min("cid").alias("first"), F.max("place").alias("hi"), F.min("place").alias("lo"), F.max("n").alias("n_hi"), F.min("n").alias("n_lo"))
    # A subset links its holders if both sides of its pair of sizes are there; of equal sizes, always.
    joined = by_subset.filter("(lo < hi) or (n_lo = n_hi and hi = -1)")
    edges = [written(shared.filter("place < 0").join(joined.select("value", "first"), "value").select(F.col("first").alias("a"), F.col("cid").alias("b")).filter("a <> b").distinct(), "jaccard-light")]

    tested: list[DataFrame] = []
    sets: list[DataFrame] = []
    labels = components(edges[0])
    long = written(lists.join(lists.groupBy("value").count().filter(F.col("count") > ANCHORS[0] + 1).select("value"), "value", "left_semi"), "jaccard-long")
    random = True  # until a round of random anchors finds no link
    for turn, anchors in enumerate([*ANCHORS, None]):
        if anchors and not random:
            continue
        entries = _labelled(long if turn else lists, labels)
        if turn and anchors:
            left, n = _pairs_left(entries)
            if left <= PAIRS_AN_ENTRY * n:
                continue
        if anchors:
            pairs = _with_anchors(entries, similarity, anchors, F.xxhash64("cid", F.lit(turn)) if turn else F.col("place"))
        else:
            pairs = _with_all(entries, classes, signatures, similarity)
        for before in tested:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = written(pairs, "jaccard-pairs")
        tested.append(pairs)
        near = written(_plausible(pairs, classes, signatures, similarity), "jaccard-plausible")
        found = links = None
        if not near.isEmpty():
            ids = near.select(F.col("a").alias("cid")).unionByName(near.select(F.col("b").alias("cid"))).distinct()
            for had in sets:
                ids = ids.join(had, "cid", "left_anti")
            sets.append(_sets_of(rows, classes, ids, k))
            found = written(_compare(near, reduce(DataFrame.unionByName, sets), similarity), "jaccard-compared", records=50)
            links = found.filter("linked").select("a", "b")
        free(near)
        if links is not None and not links.isEmpty():
            edges.append(links)
            free(labels)
            labels = components(reduce(DataFrame.unionByName, edges))
        else:
            random = not turn
    free(shared, long, *tested, *sets)

    named = classes.select("code", "n", "cid", "least").join(labels.select(F.col("id").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    named = named.join(named.groupBy("label").agg(F.min("least").alias("smallest")), "label").select("code", "n", "label", F.col("smallest").alias("least"))
    return signatures.drop("bitmap").join(slim(named), ["code", "n"], "left").select("key", "doc_id", "n", "label", "least")


def similar_documents(docs: DataFrame, k: int = 4, similarity: tuple[int, int] = (85, 100), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``; component is the component's own number,
    null where a row has no words."""
    found = _in_components(_rows(docs, text, doc_id), k, similarity)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("label").alias("component"))


def one_of_each(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (80, 100), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all their columns, that stay: of each component one, that with the smallest id,
    null being the largest, then any one text, then the smallest row; rows without words all stay."""
    found = written(_in_components(_rows(docs, text, doc_id), k, similarity).filter("n > 0").groupBy("key", "label", "doc_id").count(), "jaccard-found")
    stays = found.groupBy("label").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")).alias("x")).select("label", F.col("x.key").alias("kept"))
    odd = found.join(stays, "label").select("key", (F.col("key") == F.col("kept")).alias("stays"), "count").filter("not stays or count > 1")
    odd = written(odd.select("key", "stays"), "jaccard-odd")  # rows that go, or are there several times
    names, columns = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*columns)
    key = [F.lit(None) if at is None else F.col(f"c{at}") for at in (place_of(docs, doc_id), place_of(docs, text))]
    told = marked(flat.withColumn("key", F.xxhash64(key[0].cast("long"), key[1].cast("string"))), odd)
    # Rows that are there several times meet by their key, any other row by itself.
    rest = told.filter("_maybe").join(odd, "key", "left").filter("stays is null or stays")
    own = F.when(F.col("stays").isNull(), F.monotonically_increasing_id())
    single = rest.withColumn("own", own).groupBy(F.when(F.col("own").isNull(), F.col("key")).alias("k"), "own").agg(F.min_by(F.struct(*columns), F.struct(*comparable(flat, columns))).alias("row")).select("row.*")
    return told.filter("not _maybe").select(*columns).unionByName(single).toDF(*names)
