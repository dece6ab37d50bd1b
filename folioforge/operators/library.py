"""Relational operators over a bibliographic library: attribute pivots, hierarchies, counts, duplicates,
merges, versions and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import duplicate_title, normalized_doi, squashed
from ..session import kept

CHILD_TYPES = ("attachment", "note", "annotation")


def pivot_attributes(items: DataFrame, values: DataFrame, names: Sequence[str], key: str = "item_id") -> DataFrame:
    """Entity-attribute-value rows (key, name, value) as columns, by name, in one aggregation; items
    without an attribute have null there."""
    wide = values.filter(F.col("name").isin(list(names))).groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    return items.join(wide, key, "left")


def concat_children(parents: DataFrame, children: DataFrame, key: str, text: str, order: str, out: str, separator: str = "; ") -> DataFrame:
    """Children's texts joined in order; each side is aggregated before any join, so two kinds of
    children never multiply each other."""
    joined = children.filter(F.col(text).isNotNull()).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator).alias(out))
    return parents.join(joined, key, "left")


def with_counts(containers: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    """How many members each container has, 0 where none."""
    counted = members.groupBy(key).agg(F.count("*").alias(out))
    return containers.join(counted, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def newest(rows: DataFrame, stamp: str, key: str, limit: int) -> DataFrame:
    """The rows with the latest stamps, ties to the smaller key."""
    return rows.orderBy(F.desc(stamp), key).limit(limit)


def newest_of_each(rows: DataFrame, group: str, stamp: str, key: str, limit: int) -> DataFrame:
    """The same of every group, with rank."""
    order = Window.partitionBy(group).orderBy(F.desc(stamp), key)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def histogram(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """The most frequent values and how often, ties to the smaller."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(limit)


def coverage(items: DataFrame, texts: DataFrame, by: str, key: str) -> DataFrame:
    """Of each kind: total, with_fulltext, pdf, html; ``texts`` has a row (key, source) for each text of an item."""
    has = texts.groupBy(key).agg(F.lit(True).alias("_t"), F.bool_or(F.col("source") == "pdf").alias("_p"), F.bool_or(F.col("source") == "html").alias("_h"))
    rows = items.select(key, by).join(has, key, "left")
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if("_t").alias("with_fulltext"), F.count_if("_p").alias("pdf"), F.count_if("_h").alias("html"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which side lacks them."""
    a, b = left.select(key, F.lit(True).alias("in_left")).distinct(), right.select(key, F.lit(True).alias("in_right")).distinct()
    both = a.join(b, key, "full_outer")
    return both.filter("in_left is null or in_right is null").select(key, F.when(F.col("in_left").isNull(), "left").otherwise("right").alias("missing_in"))


def stale(current: DataFrame, indexed: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows whose stamp in the index differs from the current one."""
    return current.select(key, F.col(stamp).alias("current")).join(indexed.select(key, F.col(stamp).alias("indexed")), key).filter(~F.col("current").eqNullSafe(F.col("indexed")))


def duplicate_groups(items: DataFrame, by: str = "both") -> DataFrame:
    """group_key, item_keys (sorted), n of groups of two or more by normalised title, DOI, or both. DOI
    groups sort before title groups. No scan cap."""
    parts = []
    if by in ("doi", "both"):
        parts.append(items.select(F.concat(F.lit("doi:"), F.lower(F.trim("doi"))).alias("group_key"), "item_key").filter(F.length(F.trim("doi")) > 0))
    if by in ("title", "both"):
        parts.append(items.select(F.concat(F.lit("title:"), duplicate_title(F.col("title"))).alias("group_key"), "item_key").filter(F.length(duplicate_title(F.col("title"))) > 0))
    if not parts:
        raise ValueError(f"unknown key: {by}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("group_key").agg(F.sort_array(F.collect_list("item_key")).alias("item_keys"), F.count("*").alias("n")).filter("n >= 2")


def best_of_group(rows: DataFrame, key: str, score: Column, tie: str) -> DataFrame:
    """The row with the best score of each key, ties to the first."""
    order = Window.partitionBy(key).orderBy(F.desc("_s"), tie)
    return rows.withColumn("_s", score).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_s", "_r")


def without_preprints(items: DataFrame) -> DataFrame:
    """Drops a preprint whose DOI group or squashed-title group holds a journal article."""
    doi, title = normalized_doi(F.coalesce("doi", F.lit(""))), squashed(F.coalesce("title", F.lit("")))
    keyed = items.withColumn("_d", F.nullif(doi, F.lit(""))).withColumn("_t", F.nullif(title, F.lit("")))
    articles = keyed.filter("item_type = 'journalArticle'")
    by_doi = articles.filter("_d is not null").select("_d").distinct().withColumn("_hd", F.lit(True))
    by_title = articles.filter("_t is not null").select("_t").distinct().withColumn("_ht", F.lit(True))
    marked = keyed.join(by_doi, "_d", "left").join(by_title, "_t", "left")
    return marked.filter("item_type <> 'preprint' or (_hd is null and _ht is null)").select(*items.columns)


def chosen_attachment(attachments: DataFrame) -> DataFrame:
    """Of each parent the best attachment: PDF, then HTML, then others; those with a checksum first."""
    kind = F.when(F.col("content_type") == "application/pdf", 0).when(F.col("content_type").startswith("text/html"), 1).otherwise(2)
    order = Window.partitionBy("parent_key").orderBy(kind, F.desc(F.coalesce(F.length("md5"), F.lit(0)) > 0), "ord")
    return attachments.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def merge_plan(items: DataFrame, groups: DataFrame) -> DataFrame:
    """For each group (group_id, keeper, member): the keeper's tags after the merge, what is added, and how many go."""
    tagged = groups.join(items.select(F.col("item_key").alias("member"), "tags"), "member")
    own = F.max(F.when(F.col("member") == F.col("keeper"), F.col("tags")))
    merged = tagged.groupBy("group_id", "keeper").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), own.alias("own"), F.count_if(F.col("member") != F.col("keeper")).alias("n_trashed"))
    return merged.select("group_id", "keeper", "tags", F.array_sort(F.array_except("tags", F.coalesce("own", F.array().cast("array<string>")))).alias("added"), "n_trashed")


def update_tags(items: DataFrame, add: Sequence[str], remove: Sequence[str]) -> DataFrame:
    """New tags of each item, and what changed: removal first, then addition of what is absent; attachments are left alone."""
    gone, new = F.array(*[F.lit(t) for t in remove]).cast("array<string>"), F.array(*[F.lit(t) for t in add]).cast("array<string>")
    left = F.array_except("tags", gone)
    out = items.filter("item_type <> 'attachment'").withColumn("removed", F.array_intersect("tags", gone)).withColumn("added", F.array_except(new, left))
    return out.withColumn("tags", F.array_sort(F.array_union(left, new)))


def tag_counts(updated: DataFrame) -> DataFrame:
    """tag, n_added, n_removed over the items of ``update_tags``."""
    both = updated.select(F.explode("added").alias("tag"), F.lit(1).alias("a"), F.lit(0).alias("r")).unionByName(updated.select(F.explode("removed").alias("tag"), F.lit(0).alias("a"), F.lit(1).alias("r")))
    return both.groupBy("tag").agg(F.sum("a").alias("n_added"), F.sum("r").alias("n_removed"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return without(old, new, key).unionByName(new)


def insert_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(without(new, old, key))


def content_digest(rows: DataFrame, key: str, text: str) -> DataFrame:
    """count and SHA-256 of all rows (keys of any type). Rows are hashed where they lie, and the hashes meet in a
    tree by prefixes of the hashed keys, so no step sees more than a share of them."""
    held = rows.select(F.sha2(F.col(key).cast("string"), 256).alias("k"), F.sha2(F.col(text), 256).alias("h")).select("k", F.concat("k", "h").alias("h"), F.lit(1).cast("long").alias("n"))
    for length in (4, 2, 0):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
        held = held.groupBy(F.left("k", F.lit(length)).alias("k")).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"))
    return held.select("n", F.col("h").alias("digest"))


def tree(nodes: DataFrame) -> DataFrame:
    """key, name, parent, depth, path of every node reachable from a root (null parent), at any depth.
    Nodes with a missing parent or on a cycle are not reachable. Every level is one join, written apart."""
    last = kept(nodes.filter("parent is null").select("key", "name", "parent", F.lit(0).alias("depth"), F.col("name").alias("path"), F.array("key").alias("_above")), "tree")
    out = last
    while True:
        up = last.select(F.col("key").alias("parent"), F.col("path").alias("above"), (F.col("depth") + 1).alias("depth"), "_above")
        below = nodes.join(up, "parent").filter(~F.array_contains("_above", F.col("key")))
        last = kept(below.select("key", "name", "parent", "depth", F.concat_ws("/", "above", "name").alias("path"), F.array_append("_above", F.col("key")).alias("_above")), "tree")
        if last.isEmpty():
            return out.drop("_above")
        out = out.unionByName(last)


def span_overlaps(spans: DataFrame, ranges: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """Spans (key, start, end) with the ranges (key, range_start, range_end) of their key that they overlap, half
    open. Both are dealt to blocks of positions, so the join has equal keys; the first common block counts."""
    cut = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor(F.greatest(a, b - 1) / block)))
    x = spans.withColumn("_block", cut(F.col("start"), F.col("end")))
    y = ranges.withColumn("_block", cut(F.col("range_start"), F.col("range_end")))
    met = x.join(y, [key, "_block"]).filter((F.col("start") < F.col("range_end")) & (F.col("end") > F.col("range_start")))
    return met.filter(F.col("_block") == F.floor(F.greatest("start", "range_start") / block)).drop("_block")
