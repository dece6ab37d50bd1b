"""A versioned index of Parquet tables: each change writes a new version, and the greatest sealed version counts.

A version is written whole to a folder of its own, checked, then sealed by a manifest (its folder, count,
dimension, content digest, model) that is renamed to MANIFEST-n without overwriting. So of two writers that
start from one version one succeeds, and readers resolve one immutable version: they never see a change half
done, nor a moment without any. Paths go through the cluster's file system.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles, is_valid
from ..operators.library import content_digest, insert_only, upsert, without
from .manifests import Conflict, Manifests

__all__ = ["Conflict", "IndexStore"]


class IndexStore(Manifests):
    """``folder`` holds versions' folders and MANIFEST-1, MANIFEST-2, ..."""

    def __init__(self, spark: SparkSession, folder: str, dimension: int, model: str) -> None:
        super().__init__(spark, folder)
        self.dimension, self.model = dimension, model

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.manifest(version)['path']}")

    def publish(self, rows: DataFrame, base: int | None = None) -> int:
        """``rows`` has item_key, document, embedding, and more if wanted. Invalid vectors and repeated keys fail
        before anything is published. ``base`` is the version that ``rows`` were made from, the greatest if not given."""
        version = (self.version() if base is None else base) + 1
        name = f"v{version}-{uuid.uuid4().hex[:8]}"
        path = f"{self.folder}/{name}"
        rows.write.parquet(path)
        try:
            saved = self.spark.read.parquet(path)
            checks = saved.agg(F.count("*").alias("n"), F.count_distinct("item_key").alias("keys"), F.count_if(~is_valid(doubles(F.col("embedding")), self.dimension)).alias("bad")).first()  # one row
            if checks["bad"] or checks["keys"] != checks["n"]:
                raise ValueError(f"{checks['bad']} invalid vectors, {checks['n'] - checks['keys']} repeated keys")
            self._seal(version, {"path": name, "rows": checks["n"], "dimension": self.dimension, "model": self.model, "digest": self._digest(saved)})
        except Exception:
            self._drop(name)
            raise
        return version

    def _digest(self, rows: DataFrame) -> str | None:
        found = content_digest(rows.withColumn("document", F.coalesce("document", F.lit(""))), "item_key", "document").first()  # one row or none
        return found["digest"] if found else None

    def _beside(self, rows: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
        """What is published, and ``rows``, with the columns of both; nulls where one has none."""
        old = self.read(base)
        both = old.limit(0).unionByName(rows.limit(0), allowMissingColumns=True)
        wide = lambda side: side.select(*[F.col(c) if c in side.columns else F.lit(None).cast(t).alias(c) for c, t in both.dtypes])
        return wide(old), wide(rows)

    def upsert(self, rows: DataFrame) -> int:
        base = self.version()
        return self.publish(upsert(*self._beside(rows, base), "item_key") if base and self.manifest(base)["model"] == self.model else rows, base)

    def insert(self, rows: DataFrame) -> int:
        base = self.version()
        return self.publish(insert_only(*self._beside(rows, base), "item_key") if base else rows, base)

    def delete(self, keys: DataFrame) -> int:
        base = self.version()
        return self.publish(without(self.read(base), keys, "item_key"), base)

    def reset(self) -> int:
        base = self.version()
        return self.publish(self.read(base).limit(0), base)

    def verify(self, version: int | None = None) -> bool:
        """Whether the rows still have the count and the digest that the manifest states."""
        m = self.manifest(version)
        rows = self.read(m["version"])
        return rows.count() == m["rows"] and self._digest(rows) == m["digest"]

    def status(self) -> dict:
        """version, rows, model, dimension, folder of what is published; version 0 if nothing is."""
        version = self.version()
        m = self.manifest(version) if version else {"rows": 0, "model": self.model, "dimension": self.dimension}
        return {"version": version, "rows": m["rows"], "model": m["model"], "dimension": m["dimension"], "folder": self.folder}
