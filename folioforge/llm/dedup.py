"""Exact duplicates by a persistent digest index.

The index is a table that is bucketed and sorted by digest. It lies in a folder of the shared store, is opened
again by that folder's name, and only grows. An arrival of documents is cut down to slim rows (digest, id,
code points), summed up by digest before anything is shuffled, and parted by a sort-merge join whose index side needs no
exchange: an anti join gives the texts that no earlier arrival had, and those are appended; the rest are
appended as copies, so that sizes of groups and the rule of which row stays hold over all arrivals.
An arrival that is in the index already is not appended again, so a repeated job changes nothing.

Texts are equal when they agree after every character of ASCII white space is deleted; digests are SHA-256 of
what is left, in UTF-8. Of equal texts the row with the most code points in its original text stays, then the
smallest id. No Python runs on the executors.

Hot texts: a group is summed up by partial aggregation. When rows fetch what the index says of their text, texts that hold
over a thousandth of all rows, fewer than a thousand, are broadcast, and the others are joined by digest.

Defined cases: null text is empty, and all empty texts (white space only, too) are equal; a null id counts as the
largest; of rows that agree in text, code points and id exactly one stays; very long texts are digested whole, in one pass; an
empty table gives no rows and an index without entries; extra columns are not read, and columns are found by
their exact name first.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, pick, scratch, with_groups, written

SPACE = " \t\n\x0b\f\r"
#: What the index holds of each text of each arrival: the row that stays there and how many there are.
ENTRY = "digest binary, arrival string, is_new boolean, doc_id bigint, rid bigint, points bigint, n bigint"


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """rid, doc_id, digest, points of each row, written: the only pass over the texts."""
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = pick(docs, doc_id=doc_id, text=text)
    slim = rows.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.translate(whole, SPACE, "").cast("binary"), 256)).alias("digest"), F.char_length(whole).cast("long").alias("points"))
    return written(slim, "dedup-digests")


def _summed(rows: DataFrame, n) -> DataFrame:
    """One row a digest: the row that stays, and how many rows there are."""
    best = F.min(F.struct((-F.col("points")).alias("less"), F.isnull("doc_id").alias("none"), "doc_id", "arrival", "rid"))
    found = rows.groupBy("digest").agg(best.alias("b"), F.sum(n).alias("n"))
    return found.select("digest", F.col("b.arrival").alias("arrival"), F.col("b.doc_id").alias("doc_id"), F.col("b.rid").alias("rid"), (-F.col("b.less")).alias("points"), "n")


class DigestIndex:
    """The index below ``folder``; ``buckets`` counts only where it is new (as many as shuffles have partitions, if not given)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.buckets = self._found() or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{self.folder}/digests-b{self.buckets}"
        self.table = f"folioforge_digests_{hashlib.md5(path.encode()).hexdigest()}"
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"create table if not exists {self.table} ({ENTRY}) using parquet clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{place}'")

    def _found(self) -> int | None:
        """How many buckets the index has that lies there."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return next((int(m[1]) for m in (re.fullmatch(r"digests-b(\d+)", n) for n in sorted(names)) if m), None)

    def entries(self) -> DataFrame:
        return self.spark.read.table(self.table)

    def admit(self, rows: DataFrame, arrival: str) -> DataFrame:
        """Appends the texts of ``rows`` (rid, doc_id, digest, points); gives those that are new, one row a text:
        digest, arrival, is_new, doc_id, rid, points, n."""
        held = self.entries()
        if held.filter(F.col("arrival") == arrival).isEmpty():
            summed = _summed(rows.withColumn("arrival", F.lit(arrival)), F.lit(1)).repartition(self.buckets, "digest")
            earlier = held.select("digest").hint("merge")
            fresh = summed.join(earlier, "digest", "left_anti").withColumn("is_new", F.lit(True))
            known = summed.join(earlier, "digest", "left_semi").withColumn("is_new", F.lit(False))
            fresh.unionByName(known).select(*held.columns).write.insertInto(self.table)  # one job, one commit
        return self.entries().filter((F.col("arrival") == arrival) & F.col("is_new"))

    def groups(self) -> DataFrame:
        """digest, arrival, doc_id, rid, points, n of each text: the row that stays, over all arrivals. No exchange."""
        return _summed(self.entries(), F.col("n"))

    def close(self, remove: bool = False) -> None:
        """Forget the table's name; with ``remove`` the files too."""
        self.spark.sql(f"drop table if exists {self.table}")
        if remove:
            discard(self.spark, self.folder)


def _arrival(n: int):
    return F.pmod(F.xxhash64("doc_id", "digest"), F.lit(n)).cast("string")


def exact_duplicates(docs: DataFrame, folder: str | None = None, arrivals: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs``, and its rid. They come to the index
    in ``arrivals`` parts, each by one ``admit``. Without a ``folder`` the index is new, and is removed when the driver ends."""
    spark = docs.sparkSession
    slim = digests(docs, text, doc_id)
    index = DigestIndex(spark, folder or scratch(spark, "dedup-index"))
    for i in range(arrivals):
        index.admit(slim.filter(_arrival(arrivals) == str(i)), str(i))
    groups = index.groups().select("digest", F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"), F.col("n").alias("group_size"))
    told = with_groups(slim, groups, "digest", "group_size", slim.count())
    return told.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "rid")
