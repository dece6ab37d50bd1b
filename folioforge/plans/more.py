"""Queries for acquisition, changes and annotations, over literal payloads and the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import books
from ..operators import acquire, changes, library
from .library import _user_tags, first_line, table
from .literals import rows, sql_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}

OPEN = [
    json.dumps({"doi": "10.1/a", "is_oa": True, "best_oa_location": {"url": "http://a", "url_for_pdf": "http://a/{id}.pdf"}, "oa_locations": []}),
    json.dumps({"doi": "10.1/b", "is_oa": True, "best_oa_location": {"url": "http://b"}, "oa_locations": [{"url": "http://b1"}, {"url": "http://b2", "url_for_pdf": "http://b2/{id}.pdf"}]}),
    json.dumps({"doi": "10.1/c", "is_oa": True, "best_oa_location": {"url": "http://c/{id}"}, "oa_locations": []}),
    json.dumps({"doi": "10.1/d", "is_oa": False, "best_oa_location": None, "oa_locations": []}),
    None,
]
QUERIES["open_access_pdf"] = lambda spark, sf_dir: rows(spark, sf_dir, OPEN).select("id", acquire.best_pdf(F.col("x")).alias("url"))
SQL["open_access_pdf"] = (
    f"with {sql_rows(OPEN)}, o as (select id, x, list_filter(json_extract_string(x, '$.oa_locations[*].url_for_pdf'), lambda u: u is not null) l from v) "
    "select id, coalesce(x ->> '$.best_oa_location.url_for_pdf', l[1], x ->> '$.best_oa_location.url') as url from o"
)

WORKS = [
    json.dumps({"type": "journal-article", "title": ["On {id} things"], "container-title": ["J. Things"], "author": [{"given": "Jane", "family": "Doe"}, {"name": "A Group"}], "published": {"date-parts": [[2020, 5, 1]]}, "abstract": "<jats:p>We show <b>it</b>.</jats:p>", "DOI": "10.1/x{id}"}),
    json.dumps({"type": "never-heard", "title": [], "published": {"date-parts": [[1999]]}}),
    json.dumps({"type": "posted-content", "title": ["Pre"], "DOI": "10.1/y"}),
    *[json.dumps({"type": t, "title": [t + " {id}"]}) for t in ("book", "book-chapter", "proceedings-article", "report", "dissertation", "monograph", "reference-entry", "dataset", "peer-review", "edited-book", "standard")],
]
QUERIES["work_items"] = lambda spark, sf_dir: rows(spark, sf_dir, WORKS).select("id", acquire.work_item(F.col("x")).alias("w")).select("id", "w.item_type", "w.title", "w.publication", F.col("w.date").alias("date"), "w.abstract", "w.doi", F.size(F.coalesce("w.creators", F.array())).cast("long").alias("n_creators"))
SQL["work_items"] = (
    f"with {sql_rows(WORKS)} select id, case x ->> '$.type' when 'journal-article' then 'journalArticle' when 'posted-content' then 'preprint' when 'book' then 'book' when 'book-chapter' then 'bookSection' when 'proceedings-article' then 'conferencePaper' when 'report' then 'report' when 'dissertation' then 'thesis' when 'monograph' then 'book' when 'reference-entry' then 'encyclopediaArticle' when 'edited-book' then 'book' else 'document' end as item_type, x ->> '$.title[0]' as title, "
    "x ->> '$.\"container-title\"[0]' as publication, array_to_string(json_extract_string(x, '$.published.\"date-parts\"[0][*]'), '-') as date, "
    "trim(regexp_replace(coalesce(x ->> '$.abstract', ''), '<[^>]+>', '', 'g')) as abstract, x ->> '$.DOI' as doi, coalesce(json_array_length(x, '$.author'), 0)::bigint as n_creators from v"
)
SQL["work_items"] = SQL["work_items"].replace("array_to_string(json_extract_string(x, '$.published.\"date-parts\"[0][*]'), '-') as date", "case when len(json_extract_string(x, '$.published.\"date-parts\"[0][*]')) > 0 then array_to_string(json_extract_string(x, '$.published.\"date-parts\"[0][*]'), '-') end as date")

ATOM = ["<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>A\n  Title {id}</title><summary> Sum  mary {id}</summary><published>2017-06-12T17:57:34Z</published><author><name>Ann One</name></author><author><name>Bob Two</name></author></entry></feed>", "<feed><entry><title>{id}</title><published>19{id}-01-01</published></entry></feed>"]
QUERIES["atom_entries"] = lambda spark, sf_dir: rows(spark, sf_dir, ATOM).select("id", acquire.atom_entry(F.col("x")).alias("a")).select("id", "a.title", "a.abstract", F.col("a.date").alias("date"), "a.authors")
SQL["atom_entries"] = "select doc_id as id, case doc_id % 2 when 0 then 'A Title ' else '' end || doc_id as title, case doc_id % 2 when 0 then 'Sum mary ' || doc_id else '' end as abstract, case doc_id % 2 when 0 then '2017-06-12' else left('19' || doc_id || '-01-01', 10) end as date, case doc_id % 2 when 0 then ['Ann One', 'Bob Two'] else []::varchar[] end as authors from documents"

QUERIES["extraction_choice"] = lambda spark, sf_dir: (
    table(spark, sf_dir, "pages")
    .select("page_id", acquire.chosen_extraction({"article": F.regexp_extract("html", "(?s)<article>(.*)</article>", 1), "plain": F.trim(F.regexp_replace("html", "<[^>]*>", " ")), "raw": F.col("html")}).alias("e"))
    .select("page_id", "e.backend", "e.quality", "e.chain", F.col("e.char_count").cast("long").alias("char_count"))
)
SQL["extraction_choice"] = """
with e as (select page_id, length(regexp_extract(html, '<article>(.*)</article>', 1, 's')) a, length(trim(regexp_replace(html, '<[^>]*>', ' ', 'g'))) b, length(html) c from pages),
f as (select *, case when a >= 500 then 'article' when b >= 500 then 'plain' when c >= 500 then 'raw' when a >= b and a >= c and a > 0 then 'article' when b >= c and b > 0 then 'plain' when c > 0 then 'raw' end backend from e),
g as (select *, case backend when 'article' then a when 'plain' then b when 'raw' then c else 0 end n from f)
select page_id, backend, case when n >= 500 then 'good' when n > 0 then 'degraded' else 'empty' end as quality,
       case when a >= 500 then ['article'] when b >= 500 then ['article', 'plain'] else ['article', 'plain', 'raw'] end as chain, n::bigint as char_count from g"""

STATUS = ["http://a/{id}|200", "https://proxy.example.org/{id}|200", "http://b/z|403", "http://c/w|503", "http://d|404"]
QUERIES["acquisition_route"] = lambda spark, sf_dir: rows(spark, sf_dir, STATUS).select("id", acquire.route(F.split_part("x", F.lit("|"), F.lit(2)).cast("int"), F.split_part("x", F.lit("|"), F.lit(1)), "proxy.example.org").alias("route"))
SQL["acquisition_route"] = f"with {sql_rows(STATUS)} select id, case when contains(x, '//proxy.example.org') then 'proxy' when split_part(x, '|', 2) in ('401', '402', '403') then 'proxy' when split_part(x, '|', 2) in ('429', '500', '502', '503', '504') then 'retry' else 'direct' end as route from v"

QUERIES["attachment_indicator"] = lambda spark, sf_dir: table(spark, sf_dir, "orders").join(
    table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_linestatus") == "O").alias("o")), "o_orderkey", "left"
).select("o_orderkey", acquire.indicator(F.coalesce("r", F.lit(False)), F.coalesce("n", F.lit(0)), F.coalesce("o", F.lit(False))).alias("indicator"))
SQL["attachment_indicator"] = """
with c as (select l_orderkey, count(*) n, bool_or(l_returnflag = 'R') r, bool_or(l_linestatus = 'O') o from lineitem group by all)
select o_orderkey, concat_ws(', ', case when r then 'PDF' end, case when n > 0 then n || ' attachments' end, case when o then 'has notes' end) as indicator
from orders left join c on l_orderkey = o_orderkey"""


def _items(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_key"), F.lit(1).cast("long").alias("version"), first_line().alias("title"), F.col("source").alias("publication"), F.array("lang").alias("collections"))


def update_result(spark, sf_dir):
    items = _items(spark, sf_dir).select("item_key", "version", "publication")
    return changes.update_items(items, items.filter("item_key % 5 = 0").select("item_key", F.when(F.col("item_key") % 2 == 0, F.lit("new name")).alias("publication"), F.lit("ignored").alias("volume")))


QUERIES["update_result"] = update_result
SQL["update_result"] = "select doc_id as item_key, case when doc_id % 10 = 0 then 2 else 1 end::bigint as version, case when doc_id % 10 = 0 then 'new name' else source end as publication from documents"

QUERIES["collection_membership"] = lambda spark, sf_dir: changes.manage_collections(_items(spark, sf_dir), _items(spark, sf_dir).filter("item_key % 3 = 0"), ["shelf"], ["en"]).select("item_key", "collections")
SQL["collection_membership"] = "select doc_id as item_key, case when doc_id % 3 = 0 then list_sort(list_filter([lang, 'shelf'], lambda c: c <> 'en')) else [lang] end as collections from documents"


def merged_library(spark, sf_dir):
    u = _user_tags(spark, sf_dir)
    group = F.floor(F.col("item_key") / 4).cast("long")
    groups = u.withColumn("group_id", group).select("group_id", F.min("item_key").over(_by("group_id")).alias("keeper"), F.col("item_key").alias("member"))
    return changes.apply_merge(u, library.merge_plan(u, groups), groups).select("item_key", "tags")


def _by(name: str):
    from pyspark.sql import Window

    return Window.partitionBy(name)


QUERIES["merge_result"] = merged_library
SQL["merge_result"] = "with u as (select user_id, list(distinct event_type) t from events group by user_id) select min(user_id) as item_key, list_sort(list_distinct(flatten(list(t)))) as tags from u group by user_id // 4"

def ingest_plan(spark, sf_dir):
    """Parts are the library: works by DOI, and some by the number in their extra lines; documents are what was found."""
    p = table(spark, sf_dir, "part")
    library_ = p.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("doi:10.1/OLD"), "p_partkey")).alias("doi"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x\narXiv: 1706."), F.format_string("%05d", "p_partkey"))).alias("extra"))
    d = table(spark, sf_dir, "documents")
    found = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("10.1/old"), "doc_id")).alias("doi"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("1706."), F.format_string("%05d", "doc_id"))).alias("arxiv"))
    return changes.ingest(library_, found).select("id", "doi")


QUERIES["ingest_plan"] = ingest_plan
SQL["ingest_plan"] = "select doc_id as id, case when doc_id % 5 <> 0 then '10.1/old' || doc_id end as doi from documents where not (doc_id % 5 <> 0 and doc_id % 2 = 0 and doc_id in (select p_partkey from part)) and not (doc_id % 7 = 0 and doc_id % 3 = 0 and doc_id in (select p_partkey from part))"

SUITE = "array<struct<query_id: string, text: string, exclude_ids: array<string>, candidate_ids: array<string>>>"
SUITE_ROWS = [{"query_id": "q1", "text": "a", "exclude_ids": ["0", "1"], "candidate_ids": None}, {"query_id": "q2", "text": "b", "exclude_ids": ["2"], "candidate_ids": ["2", "3", "never"]}, {"query_id": "q3", "text": "c", "exclude_ids": [], "candidate_ids": []}]


def suite_eligible(spark, sf_dir):
    suite = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(SUITE_ROWS)), SUITE)).alias("r")).select("r.*")
    return changes.eligible(changes.checked_suite(suite), table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("item_key")))


QUERIES["suite_eligible"] = suite_eligible
SQL["suite_eligible"] = "select 'q1' as query_id, doc_id::varchar as item_key from documents where doc_id not in (0, 1) union all select 'q2', '3' from documents where doc_id = 3"

QUERIES["note_html"] = lambda spark, sf_dir: table(spark, sf_dir, "conversations").select("conv_id", "turn", books.note_html(F.concat(F.col("role"), F.lit(" <&>")), F.col("text")).alias("html"))
SQL["note_html"] = "select conv_id, turn, '<h1>' || role || ' &lt;&amp;&gt;</h1>' || array_to_string(list_transform(string_split(text, chr(10) || chr(10)), lambda p: '<p>' || replace(p, chr(10), '<br/>') || '</p>'), '') as html from conversations"

QUERIES["annotation_kinds"] = lambda spark, sf_dir: table(spark, sf_dir, "part").groupBy(books.kind_name((F.col("p_size") % 7).cast("int")).alias("kind")).agg(F.count("*").alias("n"))
SQL["annotation_kinds"] = "select case p_size % 7 when 1 then 'highlight' when 2 then 'note' when 3 then 'image' when 4 then 'ink' when 5 then 'underline' else 'unknown' end as kind, count(*) as n from part group by 1"

QUERIES["pseudo_pages"] = lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", books.pseudo_page(F.col("n_chars"), F.lit(100)).alias("page"))
SQL["pseudo_pages"] = "select doc_id, ((n_chars + 100) // 1800 + 1)::bigint as page from documents"
