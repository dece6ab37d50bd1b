"""Queries over annotations, attachments, merges, labels, feeds and renderings, made of the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import acquire, changes, render, search, snapshot
from ..operators import items as I
from . import library as plans
from .catalog import NUMBERS, tables
from .library import TITLE, first_line, table
from .literals import filled, sql_filled

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


# --------------------------------------------------------------------------- annotations, attachments, feeds

#: Where the numbers of parts, orders and suppliers begin as items, far enough apart for tables of any size; keys keep their own numbers.
PARTS, ORDERS, FEEDS = 2 * NUMBERS, 3 * NUMBERS, 4 * NUMBERS


def _library(spark, sf_dir) -> dict[str, DataFrame]:
    """``catalog.tables``, with parts as attachments of the customers of their numbers, orders as annotations on these, and suppliers
    as items of feeds, which nations are."""
    t = tables(spark, sf_dir)
    p, o, s, n = (table(spark, sf_dir, x) for x in ("part", "orders", "supplier", "nation"))
    more = lambda rows, number, named, letter, kind, library: rows.select(number.alias("itemID"), F.concat(F.lit(letter), named.cast("string")).alias("key"), F.lit(kind).alias("itemTypeID"), library.cast("int").alias("libraryID"), F.lit("").alias("dateAdded"), F.lit("").alias("dateModified"))
    part, order, feeds = F.col("p_partkey") + PARTS, F.col("o_orderkey") + ORDERS, F.col("s_suppkey") + FEEDS
    t["itemAttachments"] = p.select(part.alias("itemID"), F.col("p_partkey").alias("parentItemID"), F.concat(F.lit("storage:"), "p_name").alias("path"), F.when(F.col("p_size") % 2 == 0, "application/pdf").otherwise("text/html").alias("contentType"))
    t["itemAnnotations"] = o.select(order.alias("itemID"), (F.col("o_custkey") + PARTS).alias("parentItemID"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("text"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("comment"), (F.col("o_orderkey") % 7).cast("int").alias("type"), F.lit("#ffd400").alias("color"), F.lit("").alias("pageLabel"))
    feed = s.select(feeds.alias("itemID"), F.concat(F.lit("F"), "s_suppkey").alias("key"), F.lit(1).alias("itemTypeID"), (F.col("s_nationkey") + 100).cast("int").alias("libraryID"), F.format_string("2020-%04d", F.col("s_suppkey") % 50).alias("dateAdded"), F.lit("").alias("dateModified"))
    t["items"] = reduce(DataFrame.unionByName, [t["items"], more(p, part, F.col("p_partkey") + 20_000_000, "A", 2, F.lit(0)), more(o, order, F.col("o_orderkey") + 30_000_000, "T", 3, F.lit(0)), feed])
    t["feeds"] = n.select((F.col("n_nationkey") + 100).alias("libraryID"), F.col("n_name").alias("name"), F.concat(F.lit("http://"), "n_name").alias("url"))
    t["feedItems"] = s.select(feeds.alias("itemID"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("2021")).alias("readTime"))
    values = s.select(feeds.alias("itemID"), F.lit(1).alias("fieldID"), (-F.col("s_suppkey") - 1).alias("valueID"), F.col("s_name").alias("value"))
    t["itemData"] = t["itemData"].unionByName(values.select("itemID", "fieldID", "valueID"))
    t["itemDataValues"] = t["itemDataValues"].unionByName(values.select("valueID", "value"))
    t["itemCreators"] = t["itemCreators"].unionByName(s.select(feeds.alias("itemID"), F.col("s_nationkey").alias("creatorID"), F.col("s_nationkey").alias("orderIndex")))
    return t


_KIND = "case o_orderkey % 7 when 1 then 'highlight' when 2 then 'note' when 3 then 'image' when 4 then 'ink' when 5 then 'underline' else 'unknown' end"
_ANNOTATED = "from orders left join part on p_partkey = o_custkey left join customer on c_custkey = p_partkey"
_HOLDS = "(contains(lower(case when o_orderkey % 5 <> 0 then o_orderpriority end), '{0}') or contains(lower(case when o_orderkey % 3 = 0 then o_orderstatus end), '{0}'))"


@query("annotation_search", f"select 'T' || (o_orderkey + 30000000) as key, coalesce(case when o_orderkey % 5 <> 0 then o_orderpriority end, '') as text, coalesce(case when o_orderkey % 3 = 0 then o_orderstatus end, '') as comment, {_KIND} as annotation_type, case when p_partkey is not null then 'A' || (p_partkey + 20000000) end as attachment_key, 'K' || c_custkey as parent_key, c_name as parent_title {_ANNOTATED} where {_HOLDS.format('urgent')}")
def _(spark, sf_dir):
    return I.search_annotations(_library(spark, sf_dir), "URGENT", None).drop("color", "page_label")


@query("notes_and_annotations", f"select 'note' as type, 'K' || c_custkey as parent_key, c_name as parent_title, count(*) as n from orders join customer on c_custkey = o_custkey where contains(lower(o_orderpriority), 'low') group by all union all select 'annotation', 'K' || c_custkey, c_name, count(*) {_ANNOTATED} where {_HOLDS.format('low')} group by all")
def _(spark, sf_dir):
    t = _library(spark, sf_dir)
    notes = t["itemNotes"].select("itemID", F.concat(F.lit("N"), "itemID").alias("key"), F.lit(3).alias("itemTypeID"), F.lit(0).alias("libraryID"), F.lit("").alias("dateAdded"), F.lit("").alias("dateModified"))
    t["items"] = t["items"].unionByName(notes)
    return I.search_notes_and_annotations(t, "low", None).groupBy("type", "parent_key", "parent_title").agg(F.count("*").alias("n"))


@query("attachments_of_parents", "select p_partkey + 20000000 as \"itemID\", 'A' || (p_partkey + 20000000) as key, 'storage:' || p_name as path, case when p_size % 2 = 0 then 'application/pdf' else 'text/html' end as \"contentType\" from part where p_partkey = 7")
def _(spark, sf_dir):
    return I.parent_attachments(_library(spark, sf_dir), 7).withColumn("itemID", F.col("itemID") - PARTS + 20_000_000)


@query("feed_list", "select (n_nationkey + 100)::int as \"libraryID\", n_name as name, 'http://' || n_name as url, count(s_suppkey) as n_items from nation left join supplier on s_nationkey = n_nationkey group by all")
def _(spark, sf_dir):
    return I.feed_list(_library(spark, sf_dir)).withColumn("libraryID", F.col("libraryID").cast("int"))


_FEED = "select s_suppkey, 'F' || s_suppkey as key, '2020-' || lpad((s_suppkey % 50)::varchar, 4, '0') as added, s_suppkey % 2 = 0 as is_read, s_name, case when n_nationkey % 7 <> 0 then case when n_nationkey % 3 <> 0 then n_name || ', Ann' else n_name end end as creators from supplier join nation on n_nationkey = s_nationkey where s_nationkey = 4 order by added desc, s_suppkey limit 20"


@query("newest_feed_items", f"select s_suppkey + 40000000 as \"itemID\", key, 'journalArticle' as item_type, added as \"dateAdded\", is_read, s_name as title, null::varchar as abstract, null::varchar as url, creators from ({_FEED})")
def _(spark, sf_dir):
    return I.newest_feed_items(_library(spark, sf_dir), 104).withColumn("itemID", F.col("itemID") - FEEDS + 40_000_000)


@query("feed_markdown", f"select key, '### ' || s_name || chr(10) || '**Type:** journalArticle | **Status:** ' || case when is_read then 'Read' else 'Unread' end || coalesce(chr(10) || '**Authors:** ' || creators, '') || chr(10) || '**Added:** ' || added as markdown from ({_FEED})")
def _(spark, sf_dir):
    f = I.newest_feed_items(_library(spark, sf_dir), 104)
    return f.select("key", render.feed_item_markdown(F.col("title"), F.col("item_type"), F.col("is_read"), F.col("creators"), F.col("dateAdded"), F.col("url")).alias("markdown"))


@query("annotation_markdown", f"select o_orderkey, '## Annotation ' || o_orderkey || case when o_orderkey % 2 = 0 then ' (from \"' || o_clerk || '\")' else '' end || chr(10) || '**Type:** ' || {_KIND} || chr(10) || '**Key:** T' || o_orderkey || chr(10) || '**Color:** Yellow' || case when o_orderkey % 3 = 0 then chr(10) || '**Page:** ' || o_orderstatus || case when o_orderkey % 6 = 0 then ' (index: ' || o_orderkey || ')' else '' end else '' end || chr(10) || '**Text:** ' || o_orderpriority as markdown from (select *, o_orderpriority || o_orderstatus as o_clerk from orders)")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", I.annotation_markdown(k, I.kind_of((k % 7).cast("int")), F.concat(F.lit("T"), k), I.colour_name(F.lit("#FFD400")), F.when(k % 3 == 0, F.col("o_orderstatus")), F.when(k % 6 == 0, k), F.col("o_orderpriority"), F.lit(None).cast("string"), F.when(k % 2 == 0, F.concat("o_orderpriority", "o_orderstatus"))).alias("markdown"))


@query("filled_annotations", "select o_orderkey from orders where o_orderkey % 5 <> 0 or o_orderkey % 3 = 0")
def _(spark, sf_dir):
    t = _library(spark, sf_dir)["itemAnnotations"]
    return I.filled_annotations(t).select((F.col("itemID") - ORDERS).alias("o_orderkey"))


# --------------------------------------------------------------------------- merges, labels, collections


def _merge(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Four orders are one work, the first keeps; lines are their attachments."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("member"), F.floor(F.col("o_orderkey") / 4).cast("long").alias("g"))
    groups = o.join(o.groupBy("g").agg(F.min("member").alias("keeper")), "g").select("keeper", "member")
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("itemID"), F.col("l_orderkey").alias("parentItem"), F.col("l_returnflag").alias("contentType"), F.col("l_linestatus").alias("filename"), F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_quantity").cast("int") % 3).cast("string")).alias("md5"), F.lit(None).cast("string").alias("url"))
    return groups, lines


_MERGE = """
g as (select o_orderkey as member, min(o_orderkey) over (partition by o_orderkey // 4) as keeper from orders),
l as (select l_orderkey * 10 + l_linenumber as id, l_orderkey as parent, l_returnflag || '|' || l_linestatus || '|' || coalesce(case when l_linenumber % 2 = 0 then (l_quantity::int % 3)::varchar end, '') as sign from lineitem),
own as (select distinct keeper, sign from g join l on parent = keeper),
r as (select g.keeper, member, id from g join l on parent = g.member join own on own.keeper = g.keeper and own.sign = l.sign where g.member <> g.keeper)"""


@query("repeated_attachments", f"with {_MERGE} select keeper, member, id as \"itemID\" from r")
def _(spark, sf_dir):
    groups, lines = _merge(spark, sf_dir)
    return I.repeated_attachments(lines, groups)


@query("moved_children", f"with {_MERGE} select l.id as \"itemID\", case when g.keeper is not null and r.id is null then g.keeper else parent end as \"parentItem\" from l left join g on g.member = parent left join (select distinct id from r) r on r.id = l.id")
def _(spark, sf_dir):
    groups, lines = _merge(spark, sf_dir)
    return changes.moved_children(lines.select("itemID", "parentItem"), groups, I.repeated_attachments(lines, groups))


@query(
    "merge_preview",
    f"""with {_MERGE}, t as (select o_orderkey, [o_orderpriority, o_orderstatus] as tags, [o_orderstatus] as cs from orders),
m as (select keeper, list_sort(list(distinct member) filter (member <> keeper)) as duplicates, list_distinct(flatten(list(tags) filter (member <> keeper))) as theirs, any_value(tags) filter (member = keeper) as own, list_distinct(flatten(list(cs) filter (member <> keeper))) as their_cs, any_value(cs) filter (member = keeper) as own_cs from g join t on o_orderkey = member group by keeper),
c as (select g.keeper, count(*) filter (r.id is null) as moved, count(*) filter (r.id is not null) as skipped from g join l on parent = g.member left join (select distinct id from r) r on r.id = l.id where g.member <> g.keeper group by g.keeper)
select m.keeper, coalesce(duplicates, []) as duplicates, coalesce(list_sort(list_filter(theirs, lambda x: x <> '' and not list_contains(own, x))), []) as new_tags, coalesce(list_sort(list_filter(their_cs, lambda x: x <> '' and not list_contains(own_cs, x))), []) as new_collections, coalesce(moved, 0) as n_moved, coalesce(skipped, 0) as n_skipped from m left join c using (keeper)""",
)
def _(spark, sf_dir):
    groups, lines = _merge(spark, sf_dir)
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_key"), F.array("o_orderpriority", "o_orderstatus").alias("tags"), F.array("o_orderstatus").alias("collections"))
    return changes.merge_preview(items, lines, groups, I.repeated_attachments(lines, groups))


@query(
    "updated_labels",
    """with i as (select doc_id, [lang, source] as tags from documents), n as (select doc_id, tags, list_sort(list_distinct(list_filter(list_concat(case when doc_id % 6 = 0 then ['set', 'Zed'] else tags end, case when doc_id % 2 = 0 then ['added', 'en'] else [] end), lambda x: x is not null and not (doc_id % 3 = 0 and x = 'fr')))) as new from i where doc_id % 5 <> 0)
select i.doc_id as item_key, case when n.doc_id is not null and list_sort(i.tags) is distinct from new then 2 else 1 end::bigint as version, case when n.doc_id is not null then new else i.tags end as tags from i left join n using (doc_id)""",
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("lang is not null and source is not null")
    items = d.select(F.col("doc_id").alias("item_key"), F.lit(1).cast("long").alias("version"), F.array("lang", "source").alias("tags"))
    k = F.col("doc_id")
    given = d.filter(k % 5 != 0).select(k.alias("item_key"), F.when(k % 6 == 0, F.array(F.lit("set"), F.lit("Zed"))).alias("set"), F.when(k % 2 == 0, F.array(F.lit("added"), F.lit("en"))).alias("add"), F.when(k % 3 == 0, F.array(F.lit("fr"))).alias("remove"))
    return changes.update_labels(items, given)


SQL["updated_labels"] = SQL["updated_labels"].replace("from documents)", "from documents where lang is not null and source is not null)")


@query("parent_collections", "select p_partkey as id, case p_partkey % 4 when 0 then 'ABCD' || lpad((p_partkey % 10000)::varchar, 4, '0') when 1 then 'nation_' || (p_partkey % 30) when 2 then 'NATION_' || (p_partkey % 25) else 'none such' end as parent, case p_partkey % 4 when 0 then 'ABCD' || lpad((p_partkey % 10000)::varchar, 4, '0') when 3 then null else (select 'C' || min(n_nationkey) from nation where lower(n_name) = 'nation_' || case p_partkey % 4 when 1 then p_partkey % 30 else p_partkey % 25 end) end as parent_key from part")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    parent = F.element_at(F.array(F.format_string("ABCD%04d", k % 10000), F.concat(F.lit("nation_"), k % 30), F.concat(F.lit("NATION_"), k % 25), F.lit("none such")), (k % 4 + 1).cast("int"))
    wanted = table(spark, sf_dir, "part").select(k.alias("id"), parent.alias("parent"))
    return changes.parent_collections(wanted, table(spark, sf_dir, "nation").select(F.concat(F.lit("C"), "n_nationkey").alias("key"), F.col("n_name").alias("name")))


@query("collections_named", "select upper(n_name) as name, 'C' || n_nationkey as key from nation where n_nationkey % 2 = 0")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return I.collections_named(n.select(F.concat(F.lit("C"), "n_nationkey").alias("key"), F.col("n_name").alias("name")), n.filter("n_nationkey % 2 = 0").select(F.upper("n_name").alias("name")))


# --------------------------------------------------------------------------- searches


@query("enriched_results", "select o_custkey % 3 as query_id, o_orderkey as item_key, 'q' || (o_custkey % 3) as query, c_name as title, case when c_custkey is null then 'Could not fetch full item data: ' || o_orderkey end as error from orders left join customer on c_custkey = o_orderkey and c_custkey % 2 = 0")
def _(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("query_id"), F.col("o_orderkey").alias("item_key"))
    items = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("item_key"), F.col("c_name").alias("title"))
    asked = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("q"), "r_regionkey").alias("text"))
    return search.enriched(found, items, asked).select("query_id", "item_key", "query", "item.title", "error")


@query("enriched_share", "select count(c_custkey) || '/' || count(*) || ' items' as enriched from orders left join customer on c_custkey = o_orderkey and c_custkey % 2 = 0")
def _(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(F.lit(0).cast("long").alias("query_id"), F.col("o_orderkey").alias("item_key"))
    items = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("item_key"), F.col("c_name").alias("title"))
    return search.enriched_share(search.enriched(found, items, spark.range(1).select(F.col("id").alias("query_id"), F.lit("q").alias("text"))))


@query(
    "refilled_search",
    """with s as (select q.vec_id query_id, e.vec_id item_key, 1 - list_sum(list_transform(list_zip(e.embedding::double[], q.embedding::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) x from embeddings e join embeddings q on q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by x desc, item_key) as rank from s where item_key in (select doc_id from documents)),
c as (select query_id, min(rank) as f, arg_min(item_key, rank) as item_key from r group by query_id, case when item_key % 20 = 0 then 'own title ' || item_key else 'the same title' end)
select query_id, row_number() over (partition by query_id order by f)::int as rank, item_key from c qualify rank <= 10""",
)
def _(spark, sf_dir):
    """Nineteen items of twenty are one work, so that the first hundred candidates do not fill ten places."""
    e = table(spark, sf_dir, "embeddings")
    title = F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("own title "), F.col("doc_id").cast("string"))).otherwise("the same title")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_key"), title.alias("title"), F.lit(None).cast("string").alias("doi"), F.col("text").alias("document"))
    index = e.select(F.col("vec_id").alias("item_key"), "embedding").join(docs.select("item_key"), "item_key", "left_semi")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("").alias("text"), F.col("embedding").alias("qv"))
    return search.search(docs, index, asked.select("query_id", "text"), asked.select("query_id", "qv"), 10, {"collapse": True}).select("query_id", "rank", "item_key")


# --------------------------------------------------------------------------- small rules over whole tables

_FILES = ["a/{id}.pdf", "/abs/{id}.pdf", "../{id}.epub", "x/../{id}.pdf", "{id}.EPUB", "C:\\{id}.pdf", "{id}", "a..b/{id}.pdf", None]


@query("safe_paths", f"with v as (select doc_id, {sql_filled(_FILES)} as x from documents) select doc_id, coalesce(not starts_with(x, '/') and not regexp_matches(x, '(^|/)\\.\\.(/|$)') and not regexp_matches(x, '^[A-Za-z]:') and lower(regexp_extract(x, '\\.([^./]+)$', 1)) in ('pdf', 'epub'), false) as safe from v")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.safe_path(filled(_FILES), ("pdf", "epub")).alias("safe"))


@query("path_overlaps", "with v as (select doc_id, '/data/' || (doc_id % 10) || case when doc_id % 3 = 0 then '/' else '' end as a, '/data/' || (doc_id % 5) || case when doc_id % 7 = 0 then '/sub' else '' end as b from documents), w as (select doc_id, rtrim(a, '/') || '/' as a, rtrim(b, '/') || '/' as b from v) select doc_id, case when a = b then 'equal' when starts_with(a, b) then 'inside' when starts_with(b, a) then 'contains' end as overlap from w")
def _(spark, sf_dir):
    k = F.col("doc_id")
    a = F.concat(F.lit("/data/"), (k % 10).cast("string"), F.when(k % 3 == 0, "/").otherwise(""))
    b = F.concat(F.lit("/data/"), (k % 5).cast("string"), F.when(k % 7 == 0, "/sub").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", X.overlap_of_paths(a, b).alias("overlap"))


@query("split_names", rf"select doc_id, case when contains(trim({TITLE}), ' ') then trim(regexp_extract(trim({TITLE}), '^(.*)\s\S+$', 1)) else '' end as first, regexp_extract(trim({TITLE}), '(\S+)$', 1) as last from documents where text is not null")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", X.split_name(first_line()).alias("n")).select("doc_id", F.col("n.firstName").alias("first"), F.col("n.lastName").alias("last"))


@query("pdf_payloads", "select doc_id, doc_id % 2 = 0 and octet_length(encode('%PDF' || coalesce(text, ''))) >= 1000 as valid from documents")
def _(spark, sf_dir):
    payload = F.concat(F.when(F.col("doc_id") % 2 == 0, "%PDF").otherwise("<htm"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", acquire.is_pdf(F.encode(payload, "UTF-8")).alias("valid"))


@query("box_corners", "select p_partkey, least(p_size, p_size % 7 + 3)::double as x, least(p_retailprice, 950.5) as y from part")
def _(spark, sf_dir):
    box = lambda a, b: F.array(a.cast("double"), b.cast("double"), F.lit(0.0), F.lit(0.0))
    boxes = F.array(box(F.col("p_size"), F.col("p_retailprice")), box(F.col("p_size") % 7 + 3, F.lit(950.5)))
    return table(spark, sf_dir, "part").select("p_partkey", I.corner(boxes).alias("c")).select("p_partkey", "c.x", "c.y")


@query("changed_files", "select 'd/' || doc_id as path, case when doc_id % 11 = 0 then 'added' when doc_id % 7 = 0 then 'removed' else 'changed' end as change from documents where doc_id % 11 = 0 or doc_id % 7 = 0 or doc_id % 5 = 0")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("t"))
    before = d.filter("doc_id % 11 <> 0").select("path", F.sha2("t", 256).alias("sha256"))
    after = d.filter("doc_id % 7 <> 0 or doc_id % 11 = 0").select("path", F.sha2(F.concat("t", F.when(F.col("doc_id") % 5 == 0, "!").otherwise("")), 256).alias("sha256"))
    return snapshot.changed_files(before, after)


# --------------------------------------------------------------------------- renderings

_TYPE = "case doc_id % 3 when 0 then 'book' when 1 then 'journalArticle' end"
_WHO = "case when doc_id % 2 = 0 then 'van Doe, Jane' else coalesce(source, 'No authors listed') end"


def _items(spark, sf_dir) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    author = F.struct(F.when(k % 2 == 0, F.lit("Jane")).alias("firstName"), F.when(k % 2 == 0, F.lit("van Doe")).alias("lastName"), F.when(k % 2 != 0, F.col("source")).alias("name"))
    return d.select(k.alias("item_key"), F.when(k % 3 == 0, "book").when(k % 3 == 1, "journalArticle").alias("item_type"), F.when(k % 7 != 0, first_line()).alias("title"), F.when(k % 5 != 0, F.lit("2021-05")).alias("date"), F.array(author).alias("creators"), F.when(k % 4 != 0, F.col("text")).alias("abstract"), F.when(k % 6 != 0, F.array("lang", F.lit("t"))).alias("tags"), F.when(k % 8 != 0, F.col("text")).alias("fulltext"))


@query(
    "result_blocks",
    f"""select doc_id as item_key, '## ' || (doc_id + 1) || '. ' || coalesce(case when doc_id % 7 <> 0 then {TITLE} end, 'Untitled') || chr(10) || '**Type:** ' || coalesce({_TYPE}, 'unknown') || chr(10) || '**Item Key:** ' || doc_id || chr(10) || '**Date:** ' || case when doc_id % 5 <> 0 then '2021-05' else 'No date' end || chr(10) || '**Authors:** ' || {_WHO} || chr(10) || '**Similarity Score:** ' || (doc_id % 10)
  || case when doc_id % 4 <> 0 and length(text) > 0 then chr(10) || '**Abstract:** ' || case when length(text) > 200 then left(text, 200) || '...' else text end else '' end || case when doc_id % 6 <> 0 and lang is not null then chr(10) || '**Tags:** `' || lang || '` `t`' when doc_id % 6 <> 0 then chr(10) || '**Tags:** `t`' else '' end || chr(10) as markdown from documents""",
)
def _(spark, sf_dir):
    d = _items(spark, sf_dir)
    return d.select("item_key", render.result_block(d, F.col("item_key") + 1, extra={"Similarity Score": F.col("item_key") % 10}).alias("markdown"))


@query(
    "connector_fetch",
    f"""with i as (select doc_id, coalesce(case when doc_id % 7 <> 0 then {TITLE} end, 'Item ' || doc_id) as title, {_WHO} as who, case when doc_id % 8 <> 0 then text end as f, case when doc_id % 4 <> 0 then text end as a, lang, coalesce({_TYPE}, '') as kind from documents)
select doc_id::varchar as id, title, case when length(regexp_replace(coalesce(f, ''), '^\\s+|\\s+$', '', 'g')) >= 40 then f else title || chr(10) || chr(10) || 'Authors: ' || who || chr(10) || case when length(a) > 0 then 'Abstract:' || chr(10) || a else '' end end as text, 'https://library.example.org/items/' || doc_id as url, kind, case when doc_id % 5 <> 0 then '2021-05' else '' end as date, who as authors, case when doc_id % 6 <> 0 then 2 else 0 end as n_tags from i""",
)
def _(spark, sf_dir):
    d = _items(spark, sf_dir)
    told = d.select(F.from_json(render.fetched_json(d, "https://library.example.org/items/"), "id string, title string, text string, url string, metadata struct<itemType: string, date: string, key: string, doi: string, authors: string, tags: array<string>>").alias("j"))
    return told.select("j.id", "j.title", "j.text", "j.url", F.col("j.metadata.itemType").alias("kind"), "j.metadata.date", "j.metadata.authors", F.size("j.metadata.tags").alias("n_tags"))
