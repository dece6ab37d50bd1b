"""Changes to a library as new versions of its rows, and the evaluator's suites and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from copy import deepcopy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized_doi
from .library import without

#: Fields that an update may set on any item.
WRITABLE = ("title", "date", "abstract", "url", "extra", "publication", "volume")

# The evaluator's defaults, and its profiles over them.
DEFAULTS = {"mode": "dense", "collapse": False, "noise_policy": "keep", "k": 60, "gate": False, "gate_threshold": 0.8, "gate_min_tokens": 3, "title_weight": 3.0, "weights": {"dense": 1.0, "lex": 0.5}}
PROFILES = {
    "baseline-dense": {"mode": "dense"},
    "dense-collapse": {"mode": "dense", "collapse": True},
    "hybrid-rrf": {"mode": "hybrid", "weights": {"dense": 1.0, "lex": 1.0}},
    "hybrid-weighted": {"mode": "hybrid", "weights": {"dense": 1.0, "lex": 0.5}},
    "hybrid-gated": {"mode": "hybrid", "weights": {"dense": 1.0, "lex": 0.5}, "gate": True},
    "hybrid-weighted-collapse": {"mode": "hybrid", "weights": {"dense": 1.0, "lex": 0.5}, "collapse": True},
    "hybrid-gated-collapse": {"mode": "hybrid", "weights": {"dense": 1.0, "lex": 0.5}, "gate": True, "collapse": True},
}


def profile(name: str, overrides: Mapping[str, object] | None = None) -> dict:
    """A profile's settings; ``overrides`` name them, with dots inside (``weights.lex``)."""
    if name not in PROFILES:
        raise KeyError(name)
    settings = deepcopy(DEFAULTS | PROFILES[name])
    for key, value in (overrides or {}).items():
        *path, last = key.split(".")
        place = settings
        for step in path:
            place = place.get(step) if isinstance(place, dict) else None
        if not isinstance(place, dict) or last not in place:
            raise ValueError(f"unknown setting: {key}")
        place[last] = value
    return settings


def update_items(items: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` (item_key and some of WRITABLE): a given value replaces, null leaves; fields that the
    item's table lacks are ignored; the version of a changed row rises."""
    fields = [f for f in WRITABLE if f in updates.columns and f in items.columns]
    named = updates.select("item_key", F.lit(True).alias("_hit"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = items.join(named, "item_key", "left")
    changed = F.lit(False)
    for f in fields:
        changed = changed | (F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f)))
    joined = joined.withColumn("version", F.when(changed, F.col("version") + 1).otherwise(F.col("version")))
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(f"_{f}", f))
    return joined.select(*items.columns)


def manage_collections(items: DataFrame, targets: DataFrame, add: Sequence[str], remove: Sequence[str]) -> DataFrame:
    """Membership of the items in ``targets`` after additions and removals, sorted."""
    new, gone = (F.array(*[F.lit(x) for x in xs]).cast("array<string>") for xs in (add, remove))
    hit = targets.select("item_key").distinct().withColumn("_hit", F.lit(True))
    moved = F.array_sort(F.array_except(F.array_union(F.coalesce("collections", F.array().cast("array<string>")), new), gone))
    return items.join(hit, "item_key", "left").withColumn("collections", F.when(F.col("_hit"), moved).otherwise(F.col("collections"))).drop("_hit")


def ingest(items: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``found`` that are not in the library: by DOI, case aside, or by arXiv number in ``extra``."""
    known = items.select(normalized_doi(F.coalesce("doi", F.lit(""))).alias("_d")).filter("_d <> ''").distinct()
    numbers = items.select(F.lower(F.regexp_extract("extra", r"(?i)arxiv:\s*(\S+)", 1)).alias("_a")).filter("_a <> ''").distinct()
    keyed = found.withColumn("_d", normalized_doi(F.coalesce("doi", F.lit("")))).withColumn("_a", F.lower(F.coalesce("arxiv", F.lit(""))))
    return keyed.join(known, "_d", "left_anti").join(numbers, "_a", "left_anti").drop("_d", "_a")


def apply_merge(items: DataFrame, plan: DataFrame, groups: DataFrame) -> DataFrame:
    """The library after ``library.merge_plan``: keepers have the merged tags, the other members are gone."""
    gone = groups.filter("member <> keeper").select(F.col("member").alias("item_key"))
    merged = plan.select(F.col("keeper").alias("item_key"), F.col("tags").alias("_tags"))
    return without(items, gone, "item_key").join(merged, "item_key", "left").withColumn("tags", F.coalesce("_tags", "tags")).drop("_tags")


def checked_suite(suite: DataFrame) -> DataFrame:
    """``suite`` (query_id, text, exclude_ids, candidate_ids), after its ids were found unique and its texts not empty."""
    bad = suite.groupBy("query_id").agg(F.count("*").alias("n"), F.max((F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).cast("int")).alias("empty")).filter("n > 1 or empty = 1").limit(1).collect()
    if bad:
        raise ValueError(f"query {bad[0]['query_id']} is repeated or has no text")
    return suite


def eligible(suite: DataFrame, ids: DataFrame) -> DataFrame:
    """(query_id, item_key) that may be ranked: all ids, or the candidates where they are given (an empty list
    is none), less the excluded."""
    stated = suite.filter("candidate_ids is not null").select("query_id", "exclude_ids", F.explode("candidate_ids").alias("item_key"))
    stated = stated.join(ids.select("item_key").distinct(), "item_key", "left_semi")
    free = suite.filter("candidate_ids is null").agg(F.collect_list(F.struct("query_id", "exclude_ids")).alias("q")).first()["q"]  # a stated query set
    every = [ids.select(F.lit(r["query_id"]).alias("query_id"), F.lit(list(r["exclude_ids"] or [])).cast("array<string>").alias("exclude_ids"), F.col("item_key")) for r in free]
    for e in every:
        stated = stated.unionByName(e)
    return stated.filter(~F.coalesce(F.array_contains("exclude_ids", F.col("item_key")), F.lit(False))).select("query_id", "item_key")


def moved_children(children: DataFrame, groups: DataFrame, repeated: DataFrame) -> DataFrame:
    """``children`` (itemID, parentItem, ...) after a merge of ``groups`` (keeper, member): those of members belong to
    the keeper, but for ``repeated`` (itemID), which it has already and which stay with the member."""
    target = groups.filter("member <> keeper").select(F.col("member").alias("parentItem"), "keeper").distinct()
    kept_back = repeated.select("itemID").distinct().withColumn("_stays", F.lit(True))
    joined = children.join(target, "parentItem", "left").join(kept_back, "itemID", "left")
    parent = F.when(F.col("keeper").isNotNull() & F.col("_stays").isNull(), F.col("keeper")).otherwise(F.col("parentItem"))
    return joined.withColumn("parentItem", parent).select(*children.columns)


def merge_preview(items: DataFrame, children: DataFrame, groups: DataFrame, repeated: DataFrame) -> DataFrame:
    """Of each keeper: duplicates, tags and collections that it gets (sorted), children that move, attachments that do not."""
    none = F.array().cast("array<string>")
    held = groups.join(items.select(F.col("item_key").alias("member"), F.coalesce("tags", none).alias("tags"), F.coalesce("collections", none).alias("collections")), "member")
    own = lambda c: F.max(F.when(F.col("member") == F.col("keeper"), F.col(c)))
    gained = lambda c: F.array_sort(F.array_except(F.array_remove(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("member") != F.col("keeper"), F.col(c))))), ""), F.coalesce(own(c), none)))
    out = held.groupBy("keeper").agg(F.array_sort(F.collect_set(F.when(F.col("member") != F.col("keeper"), F.col("member")))).alias("duplicates"), gained("tags").alias("new_tags"), gained("collections").alias("new_collections"))
    theirs = groups.filter("member <> keeper").join(children.select(F.col("parentItem").alias("member"), "itemID"), "member").join(repeated.select("itemID").distinct().withColumn("_r", F.lit(True)), "itemID", "left")
    counts = theirs.groupBy("keeper").agg(F.count_if(F.col("_r").isNull()).alias("n_moved"), F.count_if(F.col("_r").isNotNull()).alias("n_skipped"))
    return out.join(counts, "keeper", "left").fillna(0, ["n_moved", "n_skipped"])


def update_labels(items: DataFrame, updates: DataFrame, column: str = "tags") -> DataFrame:
    """``updates`` (item_key, set, add, remove: arrays, each may be null): what is set replaces, then additions and removals
    apply; sorted. The version of a changed row rises."""
    none = F.array().cast("array<string>")
    given = updates.select("item_key", F.col("set").alias("_s"), F.coalesce("add", none).alias("_a"), F.coalesce("remove", none).alias("_r"), F.lit(True).alias("_hit"))
    now = F.coalesce(F.col(column), none)
    new = F.array_sort(F.array_except(F.array_union(F.coalesce("_s", now), F.col("_a")), F.col("_r")))
    joined = items.join(given, "item_key", "left").withColumn("_new", F.when(F.col("_hit"), new).otherwise(F.col(column)))
    changed = F.col("_hit").isNotNull() & (F.array_sort(now) != F.col("_new"))
    joined = joined.withColumn("version", F.when(changed, F.col("version") + 1).otherwise(F.col("version"))).withColumn(column, F.col("_new"))
    return joined.select(*items.columns)


def parent_collections(wanted: DataFrame, collections: DataFrame) -> DataFrame:
    """``wanted`` (id, parent) with parent_key: eight capitals and digits are a key, anything else a name, case aside; a name
    that several have gives the smallest key, and one that none has null."""
    named = collections.groupBy(F.lower("name").alias("_n")).agg(F.min("key").alias("_k"))
    joined = wanted.join(named, F.lower(F.col("parent")) == F.col("_n"), "left")
    return joined.select("id", "parent", F.when(F.col("parent").rlike("^[A-Z0-9]{8}$"), F.col("parent")).otherwise(F.col("_k")).alias("parent_key"))


def model_name(settings: object) -> str | None:
    """The first ``model_name`` or ``model`` anywhere in nested settings, depth first."""
    if isinstance(settings, Mapping):
        named = next((v for k in ("model_name", "model") if isinstance(v := settings.get(k), str) and v.strip()), None)
        return named or next((m for v in settings.values() if (m := model_name(v))), None)
    return next((m for v in settings if (m := model_name(v))), None) if isinstance(settings, (list, tuple)) else None
