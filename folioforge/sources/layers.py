"""An index that is merged as it is read: sorted ranges of keys, with puts and deletes on top, and compaction.

A change writes what changes, not the index: an upsert is a folder of its rows, a deletion one of its keys, and a
manifest lists the ranges (folder, least and greatest key, rows) and the changes on them, in order. A reader resolves one
manifest. Ranges that no change reaches by its keys are read as they are; the others leave out the keys that a change
names, by an anti join (broadcast only while the manifest says that the changes have at most FEW rows), and of the changes of one key the last counts. Compaction
writes anew only the ranges that changes reach, and starts by itself when the changes are many against the rows.

Keys are whole numbers or strings. Rows may have any columns besides item_key, but for range, _gone and _at; a change that lacks one has nulls there, and
a new one is null in older rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept
from .manifests import Manifests

#: Rows a range, ranges at most, changed rows that are broadcast at most, and when compaction starts: so many changes, or this share of the rows.
PER_RANGE, MOST_RANGES, FEW, MOST_CHANGES, SHARE = 1_000_000, 4096, 1_000_000, 16, 0.25
KEY = "item_key"


def _order(key: int | str):
    return key.encode() if isinstance(key, str) else key


def _meet(a: dict, b: dict) -> bool:
    return a["rows"] and b["rows"] and _order(a["lo"]) <= _order(b["hi"]) and _order(b["lo"]) <= _order(a["hi"])


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class LayeredIndex(Manifests):
    """The index in ``folder``. ``check`` gives, for rows, the reason why one is refused, null where it is not."""

    def __init__(self, spark: SparkSession, folder: str, per_range: int = PER_RANGE, check: Callable[[DataFrame], Column] | None = None) -> None:
        super().__init__(spark, folder)
        self.per_range, self.check = per_range, check

    # ----------------------------------------------------------------- reading

    def read(self, version: int | None = None, lo: int | str | None = None, hi: int | str | None = None) -> DataFrame:
        """The rows of a version, of keys from ``lo`` to ``hi`` if given: only ranges and changes that hold such keys are opened."""
        m = self.manifest(version)
        span = {"rows": 1, "lo": lo, "hi": hi}
        wanted = lambda part: part["rows"] and (lo is None or _order(part["hi"]) >= _order(lo)) and (hi is None or _order(part["lo"]) <= _order(hi))
        rows = self._merged([r for r in m["ranges"] if wanted(r)], [c for c in m["changes"] if wanted(c)], m["schema"])
        rows = rows.filter(F.col(KEY) >= F.lit(span["lo"])) if lo is not None else rows
        return rows.filter(F.col(KEY) <= F.lit(span["hi"])) if hi is not None else rows

    def _latest(self, changes: list[dict]) -> DataFrame:
        """One row a changed key: the last change's, with _gone."""
        told = [self._read(c["path"]).withColumns({"_gone": F.lit(c["kind"] == "gone"), "_at": F.lit(c["at"])}) for c in changes]
        every = _union(told)
        if len(changes) == 1:
            return every.drop("_at")
        values = F.struct(*[c for c in every.columns if c not in (KEY, "_at")])
        return every.groupBy(KEY).agg(F.max_by(values, "_at").alias("_r")).select(KEY, "_r.*")

    def _merged(self, ranges: list[dict], changes: list[dict], schema: str) -> DataFrame:
        none = self.spark.createDataFrame([], schema)
        if not changes:
            return _union([none, *self._ranges(ranges)])
        latest = self._latest(changes)
        keys = latest.select(KEY)
        keys = F.broadcast(keys) if sum(c["rows"] for c in changes) <= FEW else keys
        reached = [r for r in ranges if any(_meet(r, c) for c in changes)]
        still = self._ranges([r for r in ranges if r not in reached])
        under = [_union(self._ranges(reached)).join(keys, KEY, "left_anti")] if reached else []
        return _union([none, *still, *under, latest.filter(~F.col("_gone")).drop("_gone")]).select(*none.columns)

    def _ranges(self, ranges: list[dict]) -> list[DataFrame]:
        """One frame for each folder that ranges share."""
        by: dict[str, list[str]] = {}
        for r in ranges:
            by.setdefault(r["path"], []).append(f"{self.folder}/{r['path']}/range={r['range']}")
        return [self.spark.read.parquet(*paths) for paths in by.values()]

    def get(self, keys: list[int] | list[str]) -> DataFrame:
        """The rows of a few keys."""
        return self.read(lo=min(keys, key=_order), hi=max(keys, key=_order)).filter(F.col(KEY).isin(keys)) if keys else self.read().limit(0)

    def count(self) -> int:
        """From the manifest where nothing was changed, else by the keys alone."""
        m = self.manifest()
        return sum(r["rows"] for r in m["ranges"]) if not m["changes"] else self.read().select(KEY).count()

    # ----------------------------------------------------------------- changes

    def publish(self, rows: DataFrame) -> int:
        """``rows`` in place of whatever there is."""
        base = self.version()
        made = self._checked(rows, unique=True)
        n = made.count()
        parts = max(1, min(MOST_RANGES, -(-n // self.per_range)))
        dealt = made.repartitionByRange(parts, KEY).withColumn("range", F.spark_partition_id())
        return self._seal(base + 1, {"ranges": self._write_ranges(dealt), "changes": [], "schema": made.schema.simpleString()})

    def _checked(self, rows: DataFrame, unique: bool) -> DataFrame:
        """Written apart, so that what is checked is what is published."""
        saved = kept(rows, "layer")
        told = [F.count("*").alias("n"), F.count_distinct(KEY).alias("keys"), F.min(F.lit(None).cast("string") if self.check is None else self.check(saved)).alias("why")]
        found = saved.agg(*told).first()  # one row
        if unique and found["keys"] != found["n"]:
            raise ValueError(f"{found['n'] - found['keys']} keys are repeated or null")
        if found["why"] is not None:
            raise ValueError(found["why"])
        return saved

    def _write_ranges(self, dealt: DataFrame) -> list[dict]:
        """``dealt`` has range, one a partition; each is a folder that is sorted by key."""
        path = self._written(dealt.sortWithinPartitions("range", KEY), "ranges", "range")
        told = self._read(path).groupBy("range").agg(F.count("*").alias("n"), F.min(KEY).alias("lo"), F.max(KEY).alias("hi")).orderBy("range").collect()  # MOST_RANGES rows at most
        return [{"path": path, "range": r["range"], "rows": r["n"], "lo": r["lo"], "hi": r["hi"]} for r in told]

    def _change(self, kind: str, rows: DataFrame) -> int:
        m = self.manifest() if self.version() else {"version": 0, "ranges": [], "changes": [], "schema": rows.schema.simpleString()}
        saved = self._checked(rows, unique=kind == "put")
        told = saved.agg(F.count("*").alias("n"), F.min(KEY).alias("lo"), F.max(KEY).alias("hi")).first()  # one row
        schema = m["schema"]
        if kind == "put":
            schema = self.spark.createDataFrame([], schema).unionByName(saved.limit(0), allowMissingColumns=True).schema.simpleString()
        change = {"path": self._written(saved, kind), "kind": kind, "at": m["version"] + 1, "rows": told["n"], "lo": told["lo"], "hi": told["hi"]}
        body = {"ranges": m["ranges"], "changes": [*m["changes"], change], "schema": schema}
        version = self._seal(m["version"] + 1, body)
        rows_below = sum(r["rows"] for r in m["ranges"])
        if len(body["changes"]) > MOST_CHANGES or sum(c["rows"] for c in body["changes"]) > max(self.per_range, SHARE * rows_below):
            return self.compact()
        return version

    def upsert(self, rows: DataFrame) -> int:
        """``rows`` in place of those of their keys, which are unique; writes these rows and nothing else."""
        return self._change("put", rows)

    def insert(self, rows: DataFrame) -> int:
        """Those of ``rows`` whose keys are not there."""
        span = rows.agg(F.min(KEY).alias("lo"), F.max(KEY).alias("hi")).first()  # one row
        if not self.version() or span["lo"] is None:
            return self._change("put", rows)
        return self._change("put", rows.join(self.read(lo=span["lo"], hi=span["hi"]).select(KEY), KEY, "left_anti"))

    def delete(self, keys: DataFrame) -> int:
        """The rows of ``keys`` (item_key) are no longer read; writes the keys."""
        return self._change("gone", keys.select(KEY).filter(F.col(KEY).isNotNull()).distinct())

    def compact(self) -> int:
        """The same rows without changes on them: ranges that changes reach, and their neighbours' new keys, are written anew."""
        m = self.manifest()
        changes = [c for c in m["changes"] if c["rows"]]
        if not m["ranges"] or any(r["rows"] > 4 * self.per_range for r in m["ranges"]):
            return self.publish(self.read())
        bounds = [r["lo"] for r in m["ranges"][1:]]  # a key belongs to the last range that begins at it or below
        number = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(KEY))) if bounds else F.lit(0)
        touched = {r["n"] for r in self._latest(changes).select(number.alias("n")).distinct().collect()} if changes else set()  # MOST_RANGES at most
        rows = self._merged([r for i, r in enumerate(m["ranges"]) if i in touched], changes, m["schema"])
        made = self._write_ranges(rows.withColumn("range", number).repartition(max(1, len(touched)), "range")) if touched else []
        anew = {r["range"]: r for r in made}
        ranges = [anew[i] if i in anew else r for i, r in enumerate(m["ranges"]) if i in anew or i not in touched]
        return self._seal(m["version"] + 1, {"ranges": ranges, "changes": [], "schema": m["schema"]})

    def sweep(self, keep: int = 2) -> int:
        """Removes folders that the last ``keep`` versions do not name, and older manifests; how many folders went."""
        last = self.version()
        used = {part["path"] for v in range(max(1, last - keep + 1), last + 1) for part in (lambda m: m["ranges"] + m["changes"])(self.manifest(v))}
        fs, folder = self._path("")
        gone = 0
        for f in fs.listStatus(folder):
            name = f.getPath().getName()
            if name.startswith("MANIFEST-"):
                if int(name.removeprefix("MANIFEST-")) <= last - keep:
                    self._drop(name)
            elif name not in used:
                self._drop(name)
                gone += 1
        return gone
