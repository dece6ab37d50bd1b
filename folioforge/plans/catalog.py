"""Queries over a library's own tables, made of the driver's: customers are items with nations as creators, orders their
notes, parts attachments; and over documents as items with texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import creators_text, list_values
from ..operators import items as I
from ..operators import render, search
from .library import TITLE, table
from .literals import rows, sql_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


#: Numbers that one kind of item may have: notes begin there, so no table grows into another's.
NUMBERS = 1 << 40


def tables(spark, sf_dir) -> dict:
    c, n, o = (table(spark, sf_dir, x) for x in ("customer", "nation", "orders"))
    values = c.select("c_custkey", F.explode(F.array(F.struct(F.lit(1).alias("f"), F.col("c_name").alias("v")), F.struct(F.lit(2).alias("f"), F.col("c_mktsegment").alias("v")), F.struct(F.lit(26).alias("f"), F.concat(F.lit("10.1/"), F.col("c_custkey").cast("string")).alias("v")))).alias("x"))
    data = values.select(F.col("c_custkey").alias("itemID"), F.col("x.f").alias("fieldID"), (F.col("c_custkey") * 100 + F.col("x.f")).alias("valueID"), F.col("x.v").alias("value")).filter("fieldID <> 26 or itemID % 3 = 0")
    makers = c.select(F.col("c_custkey").alias("itemID"), F.explode(F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 1) % 25)).alias("creatorID"))
    literal = lambda values, schema: spark.createDataFrame(values, schema)
    items = c.select(F.col("c_custkey").alias("itemID"), F.concat(F.lit("K"), "c_custkey").alias("key"), (F.col("c_nationkey") % 5).cast("int").alias("itemTypeID"), (F.col("c_nationkey") % 2).cast("int").alias("libraryID"), F.lit("2020").alias("dateAdded"), F.col("c_acctbal").cast("string").alias("dateModified"))
    return {
        "items": items,
        "itemTypes": literal([(0, "book"), (1, "journalArticle"), (2, "attachment"), (3, "note"), (4, "thesis")], "itemTypeID int, typeName string"),
        "fields": literal([(1, "title"), (2, "abstractNote"), (16, "extra"), (26, "DOI"), (13, "url")], "fieldID int, fieldName string"),
        "itemData": data.select("itemID", "fieldID", "valueID"),
        "itemDataValues": data.select("valueID", "value"),
        "creators": n.select(F.col("n_nationkey").alias("creatorID"), F.when(F.col("n_nationkey") % 3 != 0, F.lit("Ann")).alias("firstName"), F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")).alias("lastName")),
        "itemCreators": makers.withColumn("orderIndex", F.col("creatorID")),
        "itemNotes": o.select((F.col("o_orderkey") + NUMBERS).alias("itemID"), F.col("o_custkey").alias("parentItemID"), F.concat(F.lit("<p>"), "o_orderpriority", F.lit("</p>")).alias("note")),
        "deletedItems": c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("itemID")),
        "libraries": literal([(0, "user"), (1, "group"), (2, "feed")], "libraryID int, type string"),
    }


_LIVE = "live as (select * from customer where c_nationkey % 5 not in (2, 3) and not c_acctbal < 0)"
_SCAN = f"""
with {_LIVE},
m as (select c_custkey k, unnest([c_nationkey, (c_nationkey + 1) % 25]) n from customer),
cr as (select k, string_agg(case when n % 3 <> 0 then n_name || ', Ann' else n_name end, '; ' order by n) creators from m join nation on n = n_nationkey where n % 7 <> 0 group by k),
nt as (select o_custkey k, string_agg('<p>' || o_orderpriority || '</p>', ' ' order by o_orderkey) notes from orders group by all)
select c_custkey as "itemID", 'K' || c_custkey as key, case c_nationkey % 5 when 0 then 'book' when 1 then 'journalArticle' else 'thesis' end as item_type, c_name as title, c_mktsegment as abstract,
       null::varchar as extra, case when c_custkey % 3 = 0 then '10.1/' || c_custkey end as doi, notes, creators
from live left join cr on cr.k = c_custkey left join nt on nt.k = c_custkey"""


@query("item_scan", _SCAN)
def _(spark, sf_dir):
    return I.item_scan(tables(spark, sf_dir)).drop("dateAdded", "dateModified")


@query("item_by_key", _SCAN + " where c_custkey = 5")
def _(spark, sf_dir):
    return I.item_by_key(tables(spark, sf_dir), "K5").drop("dateAdded", "dateModified")


@query("item_count", f"with {_LIVE} select count(*) as n from live")
def _(spark, sf_dir):
    return I.item_count(tables(spark, sf_dir))


@query("library_item_counts", "with c as (select c_nationkey % 2 l, count(*) n from customer where c_nationkey % 5 not in (2, 3) group by all), l(i, t) as (values (0, 'user'), (1, 'group'), (2, 'feed')) select i::int as \"libraryID\", t as type, coalesce(n, 0)::bigint as n_items from l left join c on c.l = i")
def _(spark, sf_dir):
    return I.library_counts(tables(spark, sf_dir))


@query("search_items_plain", f"with s as ({_SCAN}) select key from s where contains(lower(concat_ws(chr(10) || chr(10), 'Title: ' || title, 'Authors: ' || creators, 'Abstract: ' || abstract, 'Notes: ' || notes)), 'nation_4, ann')")
def _(spark, sf_dir):
    return I.search_items(I.item_scan(tables(spark, sf_dir)), "Nation_4, ANN", None).select("key")


@query("search_title_creator_year", f"with s as ({_SCAN}) select key from s where contains(lower(concat_ws(' ', title, creators, '')), 'customer') and contains(lower(concat_ws(' ', title, creators, '')), 'nation_4')")
def _(spark, sf_dir):
    scan = I.item_scan(tables(spark, sf_dir)).withColumn("date", F.lit("2020-01-01"))
    return I.search_by_title_creator_year(scan, "Customer nation_4").select("key")


@query("note_search", "select 'K' || o_custkey as parent_key, c_name as parent_title, count(*) as n from orders join customer on c_custkey = o_custkey where contains(lower(o_orderpriority), 'urgent') group by all")
def _(spark, sf_dir):
    t = tables(spark, sf_dir)
    t["items"] = t["items"].unionByName(t["itemNotes"].select("itemID", F.concat(F.lit("N"), "itemID").alias("key"), F.lit(3).alias("itemTypeID"), F.lit(0).alias("libraryID"), F.lit("").alias("dateAdded"), F.lit("").alias("dateModified")))
    return I.search_notes(t, "URGENT", None).groupBy("parent_key", "parent_title").agg(F.count("*").alias("n"))


def documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    author = F.struct(F.lit("author").alias("creatorType"), F.when(F.col("doc_id") % 2 == 0, F.lit("Jane")).alias("firstName"), F.when(F.col("doc_id") % 2 == 0, F.lit("van Doe")).alias("lastName"), F.when(F.col("doc_id") % 2 != 0, F.col("source")).alias("name"))
    return d.select(F.col("doc_id").cast("string").alias("item_key"), F.when(F.col("doc_id") % 3 == 0, "book").when(F.col("doc_id") % 3 == 1, "journalArticle").otherwise("note").alias("item_type"), F.substring_index("text", "\n", 1).alias("title"), F.array(author).alias("creators"), F.lit("").alias("abstract"), F.col("source").alias("publication"), F.array("lang", F.lit("")).alias("tags"), F.concat(F.lit("<p>"), "lang", F.lit("</p>")).alias("note"), F.lit("2021-05").alias("date"), F.col("text").alias("fulltext"), F.concat(F.lit("x\nCitation Key: K"), F.col("doc_id").cast("string")).alias("extra"), (F.col("doc_id") % 4 == 0).alias("fulltext_attempted"))


_AUTHOR = "case when doc_id % 2 = 0 then 'van Doe, Jane' else source end"
_DOCUMENT = f"array_to_string(list_filter([coalesce({TITLE}, ''), {_AUTHOR}, source, lang || ' ', lang], lambda x: x <> ''), ' ')"


@query("document_text", f"select doc_id::varchar as item_key, {_DOCUMENT} || chr(10) || chr(10) || text as document from documents")
def _(spark, sf_dir):
    d = documents(spark, sf_dir)
    structured = I.document_text(F.col("title"), F.col("creators"), F.col("abstract"), F.col("publication"), F.col("tags"), F.col("note"))
    return d.select("item_key", I.with_fulltext(structured, F.col("fulltext")).alias("document"))


@query("metadata_document", f"select doc_id::varchar as item_key, {_DOCUMENT} as document from documents")
def _(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("item_key", I.document_text(*[F.col(c) for c in ("title", "creators", "abstract", "publication", "tags", "note")]).alias("document"))


@query("item_metadata", f"select doc_id::varchar as item_key, case doc_id % 3 when 0 then 'book' when 1 then 'journalArticle' else 'note' end as item_type, {TITLE} as title, '2021-05' as date, '' as date_added, '' as date_modified, {_AUTHOR} as creators, source as publication, '' as url, '' as doi, case when length(text) > 0 then 'true' when doc_id % 4 = 0 then 'failed' end as has_fulltext, null::varchar as fulltext_source, lang || ' ' as tags, 'K' || doc_id as citation_key, 'legacy' as clean_version from documents")
def _(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select(I.item_metadata(d).alias("m")).select("m.*")


@query("citation_key_exact", "select doc_id::varchar as item_key from documents where doc_id = 42")
def _(spark, sf_dir):
    return I.by_citation_key(documents(spark, sf_dir), "K42").select("item_key")


_TYPE = "case doc_id % 3 when 0 then 'book' when 1 then 'journalArticle' else 'note' end"


@query("item_markdown", f"select doc_id::varchar as item_key, concat_ws(chr(10) || chr(10), '# ' || {TITLE}, '**Type:** ' || {_TYPE}, '**Item Key:** ' || doc_id, '**Date:** 2021-05', '**Authors:** ' || {_AUTHOR}, case when doc_id % 3 = 1 then '**Journal:** ' || source end, chr(10) || chr(10) || '## Extra' || chr(10) || chr(10) || 'x' || chr(10) || 'Citation Key: K' || doc_id, '**Citation Key (from Extra):** K' || doc_id, '**Tags:** `' || lang || '`') as markdown from documents")
def _(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("tags", F.array_remove("tags", ""))
    return d.select("item_key", render.item_markdown(d).alias("markdown"))


@query("bibtex_entry", f"select doc_id::varchar as item_key, case when doc_id % 3 <> 2 then '@' || case doc_id % 3 when 0 then 'book' else 'article' end || '{{' || case when doc_id % 2 = 0 then 'vanDoe' else source end || '2021_' || doc_id || ',' || chr(10) || '  title = {{' || replace(replace({TITLE}, '{{', '\\{{'), '}}', '\\}}') || '}},' || chr(10) || '  journal = {{' || source || '}},' || chr(10) || '  author = {{' || {_AUTHOR} || '}},' || chr(10) || '  year = {{2021}}' || chr(10) || '}}' end as entry from documents")
def _(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("item_key", render.bibtex_entry(d).alias("entry"))


# --------------------------------------------------------------------------- search

_OR = {"$or": [{"label": {"$gt": 5}}, {"$and": [{"label": {"$lte": 2}}, {"even": True}]}]}


@query("dense_filter_or", "with i as (select vec_id, label, case when vec_id % 3 <> 0 then label % 2 = 0 end as even from embeddings) select vec_id from i where label > 5 or (label <= 2 and coalesce(even, false))")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") % 3 != 0, F.col("label") % 2 == 0).alias("even"))
    return e.filter(search.dense_filter(_OR, e)).select("vec_id")


@query("document_filter", "select doc_id from documents where (contains(text, 'the ') and not contains(text, 'with')) or contains(text, 'ß')")
def _(spark, sf_dir):
    where = {"$or": [{"$and": [{"$contains": "the "}, {"$not_contains": "with"}]}, {"$contains": "ß"}]}
    return table(spark, sf_dir, "documents").filter(search.document_filter(where, F.col("text"))).select("doc_id")


@query("reranked", "select o_custkey as query_id, o_orderkey as item_key, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_key"), F.col("o_orderkey").alias("rank"), F.col("o_totalprice").alias("rerank_score"))
    return search.reranked(o.drop("rerank_score"), o, 2)


@query("query_costs", "select text, (octet_length(encode(text)) + 32)::int as estimated_tokens, (octet_length(encode(text)) + 32) * 0.2 / 1e6 as cost from (select distinct text from benchmark where item_id % 4 <> 0) where text not in (select text from benchmark where item_id % 4 = 0)")
def _(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return search.query_costs(b, b.filter("item_id % 4 = 0").select(F.sha2("text", 256).alias("key")), 0.2)


# --------------------------------------------------------------------------- small rules

POSITIONS = ['{"pageIndex": {id}, "rects": [[10.5, 2{id}, 30, 40], [1, 2, 3, 4]]}', '{"pageIndex": 0, "rects": []}', "{}", "not json", None]
QUERIES["annotation_places"] = lambda spark, sf_dir: rows(spark, sf_dir, POSITIONS).select("id", I.annotation_place(F.col("x")).alias("p")).select("id", "p.page", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
SQL["annotation_places"] = f"with {sql_rows(POSITIONS)}, j as (select id, case when json_valid(x) then x end x from v) select id, (x ->> '$.pageIndex')::int + 1 as page, (x ->> '$.rects[0][0]')::double as px, (x ->> '$.rects[0][1]')::double as py from j"

COLOURS = ["{line}", "#ffd400", "#FF6666", "#123456", "", None]
QUERIES["colour_names"] = lambda spark, sf_dir: rows(spark, sf_dir, COLOURS).select("id", I.colour_name(F.col("x")).alias("name"))
SQL["colour_names"] = f"with {sql_rows(COLOURS)} select id, case lower(x) when '#ffd400' then 'Yellow' when '#ff6666' then 'Red' else '' end as name from v"

QUERIES["pages_to_try"] = lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", I.pages_to_try(F.col("p_size"), F.lit(40)).alias("pages"))
SQL["pages_to_try"] = "select p_partkey, list_filter([p_size, p_size - 1, p_size + 1, p_size - 2, p_size + 2], lambda p: p >= 1 and p <= 40) as pages from part"

QUERIES["first_seen_rows"] = lambda spark, sf_dir: I.first_seen(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")
SQL["first_seen_rows"] = "select o_custkey, o_orderkey, o_orderpriority from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1"


@query("annotations_by_first_source", "select l_orderkey, 0 as source, count(*) as n from lineitem where l_returnflag = 'R' group by all union all select l_orderkey, 1, count(*) from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') group by all")
def _(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return I.first_source([line.filter("l_returnflag = 'R'"), line], "l_orderkey").groupBy("l_orderkey", "source").agg(F.count("*").alias("n"))


@query("update_stats", "select count_if(vec_id is null and regexp_matches(text, '\\S')) as processed, count_if(vec_id is null and regexp_matches(text, '\\S')) as added, count_if(vec_id is not null or not regexp_matches(text, '\\S')) as skipped from documents left join embeddings on vec_id = doc_id")
def _(spark, sf_dir):
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return I.update_stats(known, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


LISTS = ['["a{id}", " b ", ""]', "a, b{id} ,c", "single{id}", '"quoted{id}"', "", "  ", "{line}", None]
QUERIES["list_inputs"] = lambda spark, sf_dir: rows(spark, sf_dir, LISTS).select("id", list_values(F.col("x")).alias("values"))
SQL["list_inputs"] = f"with {sql_rows(LISTS)}, t as (select id, trim(coalesce(x, '')) as t from v) select id, list_filter(list_transform(case when starts_with(t, '[') and json_valid(t) then from_json(t, '[\"VARCHAR\"]') when starts_with(t, '\"') then from_json('[' || t || ']', '[\"VARCHAR\"]') else string_split(t, ',') end, lambda x: trim(x)), lambda x: x <> '') as values from t"


QUERIES["creators_line"] = lambda spark, sf_dir: documents(spark, sf_dir).select("item_key", creators_text(F.col("creators")).alias("creators"))
SQL["creators_line"] = f"select doc_id::varchar as item_key, {_AUTHOR} as creators from documents"


@query("dense_mode_search", "with s as (select q.vec_id query_id, e.vec_id item_key, 1 - list_sum(list_transform(list_zip(e.embedding::double[], q.embedding::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) x from embeddings e join embeddings q on q.vec_id % 50 = 0) select query_id, row_number() over (partition by query_id order by x desc, item_key)::int as rank, item_key from s where item_key in (select doc_id from documents) qualify rank <= 10")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_key"), F.lit("").alias("title"), F.lit(None).cast("string").alias("doi"), F.col("text").alias("document"))
    index = e.select(F.col("vec_id").alias("item_key"), "embedding").join(docs.select("item_key"), "item_key", "left_semi")
    asked = e.filter("vec_id % 50 = 0")
    found = search.search(docs, index, asked.select(F.col("vec_id").alias("query_id"), F.lit("").alias("text")), asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), 10)
    return found.select("query_id", "rank", "item_key")
