"""Persisted postings of two text columns, for BM25.

Texts are tokenised once, in one pass that writes rows (t, item_key, ft, fd, l): a term, how often the
title and the document hold it, and the length of both. Rows lie in folders by a hash of the term, as many
as the documents ask for, and sorted by term in each file, so a query reads its terms' folders and their row groups only.
A frequent term is dealt to several files. One row with an empty term stands for each document, and gives count and
average length. An index is named by a digest of all records, so a change of any gives another one.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import indexed_words
from ..session import remove_at_exit, shared_folder
from .manifests import Manifests

#: Documents a folder, folders at least and at most (a power of two), files of a folder, terms that are named in the filter.
PER_PART, LEAST_PARTS, MOST_PARTS, SALTS, FEW_TERMS = 4000, 4, 4096, 4, 1000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            keys, terms, rows, ft, fd, lengths = batch.column("item_key"), [], [], [], [], []
            for i, (title, document) in enumerate(zip(batch.column("title").to_pylist(), batch.column("document").to_pylist())):
                a, b = Counter(indexed_words(title)), Counter(indexed_words(document))
                length = a.total() + b.total()
                found = ["", *(a.keys() | b.keys())]
                terms += found
                rows += [i] * len(found)
                ft += [a[t] for t in found]
                fd += [b[t] for t in found]
                lengths += [length] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), keys.take(pa.array(rows, pa.int64())), pa.array(ft, pa.int32()), pa.array(fd, pa.int32()), pa.array(lengths, pa.int64())], names=["t", "item_key", "ft", "fd", "l"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, keys, ft, fd, l): of texts of some BLOCK_WORDS words together, a row a term with the texts that hold it."""
    for whole in batches:
        held, n = [], 0
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            said, counts = [], []
            for title, document in zip(batch.column("title").to_pylist(), batch.column("document").to_pylist()):
                a, b = indexed_words(title), indexed_words(document)
                said += a
                said += b
                counts.append((len(a), len(b)))
            held.append((batch.column("item_key"), pa.array(said, pa.string()).dictionary_encode(), np.array(counts, np.int64)))
            n += len(said)
            if n >= BLOCK_WORDS:
                yield _blocked(held)
                held, n = [], 0
        if held:
            yield _blocked(held)


def _blocked(held: list[tuple[pa.Array, pa.DictionaryArray, np.ndarray]]) -> pa.RecordBatch:
    keys, said = pa.concat_arrays([k for k, _, _ in held]), pa.chunked_array([w for _, w, _ in held]).unify_dictionaries()
    counts = np.concatenate([c for _, _, c in held])
    code = np.concatenate([c.indices.to_numpy().astype(np.int64) for c in said.chunks])
    # Of each word its term, text, and whether it is of the title, as one number; equal ones are counted.
    place = np.repeat(np.arange(counts.size), counts.ravel())
    found, times = np.unique(code * counts.size + place, return_counts=True)
    pair, titled = found // 2, found % 2 == 0
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
    ft, fd = (np.add.reduceat(np.where(x, times, 0), first) if len(first) else first for x in (titled, ~titled))
    term, text = pair[first] // len(counts), pair[first] % len(counts)
    # One block with an empty term stands for the texts themselves.
    starts = np.r_[0, len(counts) + np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)]), len(counts) + len(term)]
    text = np.r_[np.arange(len(counts)), text]
    names = pa.concat_arrays([pa.array([""]), (said.chunks[-1].dictionary if len(term) else pa.array([], pa.string())).take(pa.array(term[starts[1:-1] - len(counts)]))])
    none = np.zeros(len(counts), np.int64)
    columns = (keys.take(pa.array(text)), pa.array(np.r_[none, ft], pa.int32()), pa.array(np.r_[none, fd], pa.int32()), pa.array(counts.sum(1)[text]))
    return _rows(names, starts, columns)


def _rows(terms: pa.Array, starts: np.ndarray, columns: tuple) -> pa.RecordBatch:
    offsets = pa.array(starts, pa.int32())
    return pa.RecordBatch.from_arrays([terms, *[pa.ListArray.from_arrays(offsets, c) for c in columns]], names=["t", "keys", "ft", "fd", "l"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, item_key, ft, fd, l) as blocks: neighbours of one term together."""
    for batch in batches:
        if batch.num_rows:
            codes = batch.column("t").dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
            yield _rows(batch.column("t").take(pa.array(starts[:-1])), starts, tuple(batch.column(c) for c in ("item_key", "ft", "fd", "l")))


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def parts_for(documents: int) -> int:
    parts = LEAST_PARTS
    while parts < MOST_PARTS and parts * PER_PART < documents:
        parts *= 2
    return parts


class Postings:
    """An index that lies in ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.parts = spark, path, int(path.rpartition("-p")[2])
        self.rows, self.counts = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts")
        whole = self.rows.filter((F.col("part") == part_of(F.lit(""), self.parts)) & (F.col("t") == "")).agg(F.count("*").alias("n"), F.avg("l").alias("l")).first()  # one row
        self.documents, self.average = whole["n"], whole["l"] or 1.0

    @classmethod
    def of(cls, docs: DataFrame, folder: str | None = None) -> Postings:
        """The index of ``docs`` (item_key, title, document); built where ``folder`` has none of these records."""
        spark = docs.sparkSession
        records = docs.select("item_key", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("document", F.lit("")).alias("document"))
        h = F.xxhash64("item_key", "title", "document")
        d = records.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(F.xxhash64(h, F.lit(7))), F.lit(0)).alias("y")).first()  # one row
        path = f"{(folder or shared_folder(spark)).rstrip('/')}/postings-{d['n']}-{d['x'] & (1 << 64) - 1:016x}{d['y'] & (1 << 64) - 1:016x}-{int(d['s']) % (1 << 61):x}-p{parts_for(d['n'])}"
        hadoop = spark._jvm.org.apache.hadoop.fs
        where = hadoop.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop.Path(f"{path}/counts/_SUCCESS")):
            made, parts = f"{path}.{uuid.uuid4().hex[:8]}", parts_for(d["n"])
            kind = records.schema["item_key"].dataType.simpleString()
            rows = records.mapInArrow(_counted, f"t string, item_key {kind}, ft int, fd int, l long").withColumn("part", part_of(F.col("t"), parts))
            dealt = rows.repartition(parts * SALTS, "part", F.pmod(F.xxhash64("item_key"), F.lit(SALTS))).sortWithinPartitions("part", "t")
            dealt.write.partitionBy("part").parquet(f"{made}/postings")
            counts = spark.read.parquet(f"{made}/postings").groupBy("part", "t").agg(F.count("*").alias("n"))
            counts.repartition(parts, "part").sortWithinPartitions("t").write.partitionBy("part").parquet(f"{made}/counts")
            if not fs.rename(hadoop.Path(made), where):  # another writer was first
                fs.delete(hadoop.Path(made), True)
            if folder is None:
                remove_at_exit(spark, path)
        return cls(spark, path)

    def of_terms(self, terms: list[str]) -> DataFrame:
        return of_terms(self.rows, self.parts, terms)

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """How many documents hold each of ``terms``; only those that any does."""
        return {r["t"]: r["n"] for r in of_terms(self.counts, self.parts, terms).collect()}


def of_terms(rows: DataFrame, parts: int, terms: list[str]) -> DataFrame:
    """The rows of a stated query set's terms, from their folders."""
    asked = rows.sparkSession.createDataFrame([(t,) for t in terms], "t string")
    folders = [r["p"] for r in asked.select(part_of(F.col("t"), parts).alias("p")).distinct().collect()]  # MOST_PARTS rows at most
    rows = rows.filter(F.col("part").isin(folders or [-1])).drop("part")
    return rows.filter(F.col("t").isin(terms)) if len(terms) <= FEW_TERMS else rows.join(F.broadcast(asked), "t", "left_semi")


# --------------------------------------------------------------------------- segments

#: Segments of about one size that are merged into one, and removed keys that are broadcast at most.
FAN, FEW_KEYS = 4, 1_000_000
#: Words of the texts that share a block a term, and a few more.
BLOCK_WORDS = 1 << 21


class SegmentedPostings(Manifests):
    """An index that grows: each arrival of documents is a segment with postings, counts and titles of its own, each removal a
    folder of keys that older segments no longer have. Postings lie in blocks (t, keys, ft, fd, l): a row has a term and arrays of the texts of one
    batch that hold it, so what is dealt, sorted and written are blocks. A manifest lists both, with the documents and words that each
    segment still has, so a reader opens one version without looking at the documents. Segments of one size are
    merged once there are FAN of them, and removals go when no older segment is left."""

    def add(self, docs: DataFrame, merge: bool = True) -> int:
        """A segment of ``docs`` (item_key, title, document; doi if there is one), whose keys are new."""
        m = self._now()
        return self._sealed(m["segments"] + [self._segment(docs, m["version"] + 1)], m["gone"], m, merge)

    def remove(self, keys: DataFrame) -> int:
        m = self._now()
        segments, gone = self._without(m, keys)
        return self._sealed(segments, gone, m, False)

    def upsert(self, docs: DataFrame, merge: bool = True) -> int:
        """``docs`` in place of what is there under their keys, in one version."""
        m = self._now()
        segments, gone = self._without(m, docs.select("item_key"))
        return self._sealed(segments + [self._segment(docs, m["version"] + 1)], gone, m, merge)

    def _now(self) -> dict:
        return self.manifest() if self.version() else {"version": 0, "segments": [], "gone": []}

    def _sealed(self, segments: list[dict], gone: list[dict], m: dict, merge: bool) -> int:
        segments = [s for s in segments if s["n"]]
        gone = [g for g in gone if any(s["at"] < g["at"] for s in segments)]
        version = self._seal(m["version"] + 1, {"segments": segments, "gone": gone})
        tiers: dict[int, list[dict]] = {}
        for s in segments:
            tiers.setdefault(int(math.log(s["n"], FAN)), []).append(s)
        alike = next((t for _, t in sorted(tiers.items()) if len(t) >= FAN), None)
        return self.merge([s["path"] for s in alike]) if merge and alike else version

    def _segment(self, docs: DataFrame, at: int) -> dict:
        doi = F.col("doi").cast("string") if "doi" in docs.columns else F.lit(None).cast("string")
        records = docs.select("item_key", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("document", F.lit("")).alias("document"), doi.alias("doi"))
        parts, kind = parts_for(records.count()), records.schema["item_key"].dataType.simpleString()
        rows = records.select("item_key", "title", "document").mapInArrow(_blocks, _block_of(kind))
        return self._save(rows, records.select("item_key", "title", "doi"), parts, at)

    def _save(self, rows: DataFrame, titles: DataFrame, parts: int, at: int) -> dict:
        name = f"segment-{uuid.uuid4().hex[:12]}"
        rows = rows.withColumn("part", part_of(F.col("t"), parts))
        dealt = rows.repartition(parts * SALTS, "part", F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(SALTS))).sortWithinPartitions("part", "t")
        dealt.write.partitionBy("part").parquet(f"{self.folder}/{name}/postings")
        saved = self._read(f"{name}/postings")
        counts = saved.groupBy("part", "t").agg(F.sum(F.size("keys")).cast("long").alias("n"))
        counts.repartition(parts, "part").sortWithinPartitions("t").write.partitionBy("part").parquet(f"{self.folder}/{name}/counts")
        titles.write.parquet(f"{self.folder}/{name}/titles")
        whole = _documents(_each_text(saved), parts).agg(F.count("*").alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()  # one row
        return {"path": name, "at": at, "parts": parts, "n": whole["n"], "length": whole["l"]}

    def _without(self, m: dict, keys: DataFrame) -> tuple[list[dict], list[dict]]:
        """Segments with what they have left when ``keys`` are gone, and the removals with these."""
        at = m["version"] + 1
        name = self._written(keys.select("item_key").filter("item_key is not null").distinct(), "gone")
        saved = self._read(name)
        rows = saved.count()
        now = Segments(self, m)
        told = [_documents(now.live(s, now.postings(s)), s["parts"]).select("item_key", "l", F.lit(s["path"]).alias("path")) for s in m["segments"]]
        lost = {}
        if told and rows:
            every = told[0]
            for more in told[1:]:
                every = every.unionByName(more)
            hit = every.join(F.broadcast(saved) if rows <= FEW_KEYS else saved, "item_key", "left_semi")
            lost = {r["path"]: (r["n"], r["l"]) for r in hit.groupBy("path").agg(F.count("*").alias("n"), F.sum("l").alias("l")).collect()}  # a row a segment
        segments = [s | {"n": s["n"] - lost.get(s["path"], (0, 0))[0], "length": s["length"] - lost.get(s["path"], (0, 0))[1]} for s in m["segments"]]
        return segments, [*m["gone"], {"path": name, "at": at, "rows": rows}] if lost else m["gone"]

    def merge(self, paths: list[str] | None = None) -> int:
        """The segments named, or all, as one, without what was removed from them."""
        m = self._now()
        chosen = [s for s in m["segments"] if paths is None or s["path"] in paths]
        if not chosen:
            return m["version"]
        now = Segments(self, m)
        rows = [now.blocks(s).drop("part") for s in chosen]
        titles = [now.live(s, self._read(f"{s['path']}/titles")) for s in chosen]
        for more in rows[1:]:
            rows[0] = rows[0].unionByName(more)
        for more in titles[1:]:
            titles[0] = titles[0].unionByName(more)
        made = self._save(rows[0], titles[0], parts_for(sum(s["n"] for s in chosen)), m["version"] + 1)
        return self._sealed([s for s in m["segments"] if s not in chosen] + [made], m["gone"], m, False)

    def open(self, version: int | None = None) -> Segments:
        return Segments(self, self.manifest(version))


class Segments:
    """One version of a ``SegmentedPostings``, with what a search asks of postings."""

    def __init__(self, index: SegmentedPostings, manifest: dict) -> None:
        self.index, self.manifest = index, manifest
        self.documents = sum(s["n"] for s in manifest["segments"])
        self.average = sum(s["length"] for s in manifest["segments"]) / self.documents if self.documents else 1.0

    def postings(self, segment: dict) -> DataFrame:
        return _each_text(self.index._read(f"{segment['path']}/postings"))

    def blocks(self, segment: dict) -> DataFrame:
        """What is left of a segment; blocks of one that lost nothing are taken as they are."""
        whole = self.index._read(f"{segment['path']}/postings")
        if not self._gone(segment):
            return whole
        left = self.live(segment, _each_text(whole)).select("t", "item_key", "ft", "fd", "l")
        return left.mapInArrow(_gathered, _block_of(left.schema["item_key"].dataType.simpleString()))

    def _gone(self, segment: dict) -> list[dict]:
        return [g for g in self.manifest["gone"] if g["at"] > segment["at"]]

    def live(self, segment: dict, rows: DataFrame) -> DataFrame:
        """``rows`` of a segment without those whose keys were removed since."""
        gone = self._gone(segment)
        if not gone:
            return rows
        keys = self.index._read(*[g["path"] for g in gone]).distinct()
        return rows.join(F.broadcast(keys) if sum(g["rows"] for g in gone) <= FEW_KEYS else keys, "item_key", "left_anti")

    def _each(self, what) -> DataFrame:
        frames = [what(s) for s in self.manifest["segments"]]
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more)
        return out

    def of_terms(self, terms: list[str]) -> DataFrame:
        if not self.manifest["segments"]:
            return self.index.spark.createDataFrame([], "t string, item_key long, ft int, fd int, l long")
        return self._each(lambda s: self.live(s, of_terms(self.postings(s), s["parts"], terms)))

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """From the counts of segments that lost nothing, and from the postings that are left of the others."""
        if not self.manifest["segments"]:
            return {}

        def counted(s: dict) -> DataFrame:
            if not self._gone(s):
                return of_terms(self.index._read(f"{s['path']}/counts"), s["parts"], terms).select("t", "n")
            return self.live(s, of_terms(self.postings(s), s["parts"], terms)).groupBy("t").agg(F.count("*").alias("n"))

        return {r["t"]: r["n"] for r in self._each(counted).groupBy("t").agg(F.sum("n").alias("n")).collect()}  # a row a term of the queries

    def titles(self) -> DataFrame:
        """item_key, title, doi of every document that is left."""
        return self._each(lambda s: self.live(s, self.index._read(f"{s['path']}/titles")))


def _documents(rows: DataFrame, parts: int) -> DataFrame:
    """The one row of each document that has its length."""
    return rows.filter((F.col("part") == part_of(F.lit(""), parts)) & (F.col("t") == ""))


def _block_of(kind: str) -> str:
    return f"t string, keys array<{kind}>, ft array<int>, fd array<int>, l array<long>"


def _each_text(blocks: DataFrame) -> DataFrame:
    """A row a term and text."""
    zipped = F.arrays_zip(F.col("keys").alias("item_key"), "ft", "fd", "l")
    return blocks.select("part", "t", F.inline(zipped))
