"""Snapshots of a library with its vectors, if both agree; digests of files, vectors and records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles, is_valid
from .library import content_digest, reconcile


class Drift(RuntimeError):
    """The source or the index changed while it was read, or they do not agree."""


def _hashed(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, "<f8").tobytes()).hexdigest())


def vector_hash(embedding: Column) -> Column:
    """SHA-256 of a vector as little-endian doubles."""
    return F.pandas_udf(_hashed, "string")(doubles(embedding))


def checked(papers: DataFrame, index: DataFrame, dimension: int) -> None:
    """Fails unless ``papers`` (item_key, date_modified) and ``index`` (item_key, embedding, date_modified) hold the same
    keys once each, with the same dates, and every vector is sound. Names at most ten keys that are not."""

    def fail(rows: DataFrame, what: str) -> None:
        keys = sorted(str(r["item_key"]) for r in rows.select("item_key").limit(10).collect())
        if keys:
            raise Drift(f"{what}: {', '.join(keys)}")

    if papers.isEmpty():
        raise Drift("there are no papers")
    for table, name in ((papers, "papers"), (index, "vectors")):
        fail(table.groupBy("item_key").count().filter("count > 1"), f"repeated {name}")
    sides = reconcile(papers, index, "item_key")
    fail(sides.filter("missing_in = 'right'"), "papers without vectors")
    fail(sides.filter("missing_in = 'left'"), "vectors without papers")
    fail(index.filter(~is_valid(doubles(F.col("embedding")), dimension)), "unsound vectors")
    dates = papers.select("item_key", F.col("date_modified").alias("now")).join(index.select("item_key", F.col("date_modified").alias("then")), "item_key")
    empty = lambda c: ~F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    fail(dates.filter(empty("now") | empty("then")), "dates are missing")
    fail(dates.filter("now <> then"), "stale vectors")


def embedding_records(index: DataFrame, provenance: Mapping[str, object]) -> DataFrame:
    """paper_key, view_name, producer, model, dimension, source_hash, vector_hash of every vector; ``index`` has item_key,
    document, embedding."""
    given = [F.lit(provenance.get(n)).alias(n) for n in ("producer", "model", "dimension")]
    return index.select(F.col("item_key").alias("paper_key"), F.lit("text_retrieval").alias("view_name"), *given, F.concat(F.lit("sha256:"), F.sha2(F.coalesce("document", F.lit("")), 256)).alias("source_hash"), vector_hash(F.col("embedding")).alias("vector_hash"))


def snapshot(papers: DataFrame, index: DataFrame, provenance: Mapping[str, object], scope: Mapping[str, object]) -> dict:
    """snapshot_id, snapshot_hash and metadata of papers (item_key, date_modified, more) and vectors that agree. The
    hash covers every row and the metadata, and no time; rows may come in any order."""
    checked(papers, index, int(provenance["dimension"]))
    rows = papers.select(F.col("item_key").cast("string").alias("k"), F.to_json(F.struct(*sorted(papers.columns))).alias("t"))
    own = content_digest(rows, "k", "t").first()  # one row
    records = embedding_records(index, provenance)
    theirs = content_digest(records.select(F.col("paper_key").cast("string").alias("k"), F.to_json(F.struct(*sorted(records.columns))).alias("t")), "k", "t").first()  # one row
    metadata = {"scope": dict(scope), "embedding": dict(provenance), "counts": {"papers": own["n"], "embeddings": theirs["n"]}}
    payload = json.dumps({"metadata": metadata, "papers": own["digest"], "embeddings": theirs["digest"]}, sort_keys=True, ensure_ascii=False)
    digest = hashlib.sha256(payload.encode()).hexdigest()
    return {"snapshot_id": f"snapshot:{digest[:16]}", "snapshot_hash": f"sha256:{digest}", "metadata": metadata}


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), size, sha256 of every file below ``folder``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    below = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    return found.select(F.substring(below, len(root) + 1, 1 << 30).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def fingerprint(listed: DataFrame) -> str | None:
    """One digest of a folder's ``files``."""
    found = content_digest(listed.withColumn("_t", F.concat_ws(":", F.col("size").cast("string"), "sha256")), "path", "_t").first()  # one row or none
    return found["digest"] if found else None


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, removed, changed) between two listings."""
    a, b = before.select("path", F.col("sha256").alias("was")), after.select("path", F.col("sha256").alias("is"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")
