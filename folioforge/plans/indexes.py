"""Queries over kept indexes, paged sources, hash trees and lines; all are made from the driver's tables as they run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascade, lines, order, passages, retrieval, search
from ..operators.changes import PROFILES
from ..session import kept, remove_at_exit, shared_folder
from ..sources import hashtree, paged
from ..sources.layers import LayeredIndex
from ..sources.postings import SegmentedPostings
from ..sources.vectors import VectorIndex, recall
from . import library as plans
from . import literals
from .library import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def _folder(spark: SparkSession, name: str) -> str:
    """A new one, removed when the driver ends."""
    path = f"{shared_folder(spark)}/folioforge-{name}-{uuid.uuid4().hex[:12]}"
    remove_at_exit(spark, path)
    return path


# --------------------------------------------------------------------------- vectors


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_key"), "embedding", "label")


def _grown(spark, sf_dir, metric: str = "l2") -> VectorIndex:
    """Nine rows of ten are there when it is built; the others are added."""
    rows = _vectors(spark, sf_dir)
    index = VectorIndex.build(rows.filter("item_key % 10 <> 3"), _folder(spark, "vectors"), metric)
    index.add(rows.filter("item_key % 10 = 3"))
    return index


_TOP = """
with i as (select vec_id item_key, embedding::double[] v, label from embeddings),
     q as (select vec_id query_id, embedding::double[] qv from embeddings where vec_id % 50 = 0),
     s as (select query_id, item_key, {score} exact from i join q on true where {where}),
     r as (select *, row_number() over (partition by query_id order by exact desc, item_key)::int as rank from s)
select query_id, item_key, round(exact, 6) + 0.0 as score, rank from r where rank <= 10"""


@query("ivf_exact", _TOP.format(score=plans._SCORES["l2"], where="true"))
def _(spark, sf_dir):
    return _grown(spark, sf_dir).search(plans._vectors(spark, sf_dir), 10, exact=True)


@query("ivf_exact_cosine_filtered", _TOP.format(score=plans._SCORES["cosine"], where="label in (1, 2, 5)"))
def _(spark, sf_dir):
    return _grown(spark, sf_dir, "cosine").search(plans._vectors(spark, sf_dir), 10, exact=True, where=F.col("label").isin(1, 2, 5))


@query("ivf_recall", "with n as (select count(*) n from embeddings) select count(*) as queries, sum(least(10, n))::bigint as wanted, any_value(n) as indexed, true as enough from embeddings, n where vec_id % 50 = 0")
def _(spark, sf_dir):
    """Of the ten nearest by a full scan, at least 0.95 are among those of the probed lists."""
    index, asked = _grown(spark, sf_dir), plans._vectors(spark, sf_dir)
    full = retrieval.dense_topk(_vectors(spark, sf_dir), asked, 10)
    held = index.rows().count()
    return recall(index.search(asked, 10), full).select("queries", "wanted", F.lit(held).alias("indexed"), (F.col("recall") >= 0.95).alias("enough"))


# --------------------------------------------------------------------------- postings


def _replaced(d: DataFrame) -> DataFrame:
    """Every eleventh text with its words backwards and a few more."""
    return d.filter("item_key % 11 = 0").withColumn("document", F.concat(F.reverse(F.coalesce("document", F.lit(""))), F.lit(" the of and")))


_AFTER = "now as (select doc_id, case when doc_id % 11 = 0 then reverse(coalesce(text, '')) || ' the of and' else text end as text, {title} as title from documents where doc_id % 13 <> 0)"


def _bm25_after(titled: bool) -> str:
    """The SQL of BM25 over what the documents are after replacements and removals."""
    sql = plans._bm25_sql(titled).replace("from documents", "from now").replace(plans.INDEXED.format(plans.TITLE), plans.INDEXED.format("title"))
    return "with " + _AFTER.format(title=plans.TITLE) + "," + sql


@query("bm25_segments", _bm25_after(True) + " select query_id, item_key, score, rank from lr where rank <= 10")
def _(spark, sf_dir):
    """An index that three arrivals, an upsert, a removal and a merge have gone through scores as one built at once."""
    docs = plans._docs(spark, sf_dir)
    index = SegmentedPostings(spark, _folder(spark, "segments"))
    for i in range(3):
        index.add(docs.filter(f"item_key % 3 = {i}"))
    index.upsert(_replaced(docs))
    index.remove(docs.filter("item_key % 13 = 0"))
    index.merge([s["path"] for s in index.manifest()["segments"][:2]])
    return retrieval.lexical_topk(None, plans._asked(spark, sf_dir), 10, postings=index.open())


QUERIES["hybrid_kept"] = lambda spark, sf_dir: retrieval.hybrid_over(plans.lexicon(spark, sf_dir, True), VectorIndex.build(_vectors(spark, sf_dir), _folder(spark, "vectors")), plans._asked(spark, sf_dir), plans._paired(spark, sf_dir), exact=True)
SQL["hybrid_kept"] = plans.SQL["hybrid_search"]


# --------------------------------------------------------------------------- layers and trees

#: Texts a range at most, so ranges grow in number and not in what a task reads of them.
ROWS_A_RANGE = 20_000

@query(
    "index_replay",
    """with n as (select max(doc_id) m from documents),
    r as (select doc_id as item_key, sha256(coalesce(text, '') || case when doc_id % 10 = 9 then ':9' else '' end || case when doc_id % 7 = 3 then ':last' else '' end) as sha, doc_id % 10 = 9 or doc_id % 7 = 3 as replaced from documents where doc_id % 23 <> 5 or doc_id % 7 = 3),
    x as (select doc_id + m + 1 as item_key, sha256('new') as sha, true as replaced from documents, n where doc_id % 50 = 0)
    select * from r union all select * from x""",
)
def _(spark, sf_dir):
    """Ten batches over a published index: upserts of old and new keys, deletions, compactions on the way."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_key"), F.coalesce("text", F.lit("")).alias("document"), F.lit(False).alias("replaced"))
    index = LayeredIndex(spark, _folder(spark, "layers"), per_range=max(100, min(ROWS_A_RANGE, d.count() // 5)))
    index.publish(d)
    most = d.agg(F.max("item_key")).first()[0] or 0
    changed = lambda rows, mark: rows.select("item_key", F.concat("document", F.lit(mark)).alias("document"), F.lit(True).alias("replaced"))
    for batch in range(7):
        index.upsert(changed(d.filter(f"item_key % 10 = 9 and item_key % 7 = {batch}"), ":9"))
    index.delete(d.filter("item_key % 23 = 5"))
    index.insert(d.filter("item_key % 50 in (0, 1)").select(F.when(F.col("item_key") % 50 == 0, F.col("item_key") + most + 1).otherwise(F.col("item_key")).alias("item_key"), F.lit("new").alias("document"), F.lit(True).alias("replaced")).filter("item_key % 23 <> 5 or item_key > " + str(most)))
    index.upsert(d.filter("item_key % 7 = 3").select("item_key", F.concat("document", F.when(F.col("item_key") % 10 == 9, ":9").otherwise(""), F.lit(":last")).alias("document"), F.lit(True).alias("replaced")))
    return index.read().select("item_key", F.sha2("document", 256).alias("sha"), "replaced")


@query(
    "changed_keys",
    "select doc_id as key, case when doc_id % 97 = 1 then 'missing' else 'changed' end as change from documents where doc_id % 97 = 1 or (doc_id % 89 = 2) union all select doc_id + 1000000000, 'extra' from documents where doc_id % 83 = 3",
)
def _(spark, sf_dir):
    """The keys on which an index differs from its source, found from the root of two hash trees."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    other = d.filter("doc_id % 97 <> 1").withColumn("text", F.when(F.col("doc_id") % 89 == 2, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    other = other.unionByName(d.filter("doc_id % 83 = 3").withColumn("doc_id", F.col("doc_id") + 1_000_000_000))
    a = hashtree.HashTree(d, "doc_id", ["text", "source"])
    return hashtree.changed_keys(a, hashtree.HashTree(other, "doc_id", ["text", "source"], a.depth))


# --------------------------------------------------------------------------- paged sources


def _captured(spark, sf_dir) -> tuple[str, int]:
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(F.lit("book"), F.lit("attachment"), F.lit("journalArticle"), F.lit("note"), F.lit("thesis")), (F.col("doc_id") % 5 + 1).cast("int"))
    items = d.select(F.concat(F.lit("K"), F.col("doc_id").cast("string")).alias("key"), F.col("doc_id"), F.to_json(F.struct(F.concat(F.lit("K"), F.col("doc_id").cast("string")).alias("key"), kind.alias("itemType"), F.concat(F.lit("2020-"), F.col("n_chars").cast("string")).alias("dateModified"), F.col("text").alias("abstractNote"))).alias("data"))
    folder = _folder(spark, "pages")
    return folder, paged.write_pages(order.numbered(items, [F.col("doc_id")]), folder)


@query("paged_items", "select row_number() over (order by doc_id) - 1 as place, 'K' || doc_id as key, 1::bigint as version, ['book', 'attachment', 'journalArticle', 'note', 'thesis'][doc_id % 5 + 1] as item_type, '2020-' || n_chars as date_modified, sha256(coalesce(text, '')) as sha from documents qualify true")
def _(spark, sf_dir):
    folder, _ = _captured(spark, sf_dir)
    rows = paged.exact_read(spark, folder)
    return rows.select("place", "key", "version", "item_type", "date_modified", F.sha2(F.coalesce(F.get_json_object("data", "$.abstractNote"), F.lit("")), 256).alias("sha"))


@query("paged_top_level", "with r as (select doc_id, row_number() over (order by doc_id) - 1 as place from documents), t as (select *, row_number() over (order by place) n from r where doc_id % 5 not in (1, 3)) select place, 'K' || doc_id as key from t where n <= 150")
def _(spark, sf_dir):
    folder, _ = _captured(spark, sf_dir)
    rows = paged.registered(spark).read.format("paged").option("address", folder).load()
    return paged.top_level(rows, 150).select("place", "key")


# --------------------------------------------------------------------------- lines


def _words(spark, sf_dir) -> DataFrame:
    """The words of each text stand for lines here."""
    return lines.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text", " ")


_LINES = "l as (select doc_id as key, unnest(range(len(s))) as i, unnest(s) as line from (select doc_id, string_split(text, ' ') s from documents where text is not null))"


@query(
    "short_line_runs",
    rf"with {_LINES}, s as (select *, length(regexp_replace(line, '^\s+|\s+$', '', 'g')) <= 3 as f from l), r as (select *, i - row_number() over (partition by key, f order by i) as g from s) select key, min(i)::int as run, count(*) as n, coalesce(string_agg(trim(line), '' order by i) filter (trim(line) <> ''), '') as text from r where f group by key, g having count(*) >= 3",
)
def _(spark, sf_dir):
    found = lines.short_runs(_words(spark, sf_dir), longest=3, least=3)
    return found.select("key", "run", "n", F.array_join(F.transform("cells", lambda c: c["text"]), "").alias("text"))


@query("near_banners", f"with {_LINES}, b as (select *, coalesce(length(line) >= 11, false) as is_banner from l), n as (select *, max(is_banner) over (partition by key order by i rows between 5 preceding and 5 following) as near from b) select key, count(*) as n, count(*) filter (near) as near, count(*) filter (is_banner) as banners from n group by key")
def _(spark, sf_dir):
    found = lines.near(_words(spark, sf_dir), F.char_length("line") >= 11)
    return found.groupBy("key").agg(F.count("*").alias("n"), F.count_if("near").alias("near"), F.count_if("is_banner").alias("banners"))


@query(
    "running_headers",
    rf"""with {_LINES}, b as (select *, length(line) >= 10 as br, length(line) < 10 and regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' as filled from l),
p as (select *, sum(br::int) over (partition by key order by i) as page, max(br) over (partition by key) as paged from b),
e as (select *, min(i) filter (filled) over (partition by key, page) as lo, max(i) filter (filled) over (partition by key, page) as hi, max(page) over (partition by key) as lastp,
             count(*) over (partition by key, lower(line)) as times from p)
select key, i::int as "at", line, times from e where paged and filled and (i = lo or (i = hi and page < lastp)) and times >= 3 and regexp_matches(lower(line), '^[a-m]')""",
)
def _(spark, sf_dir):
    return lines.running_headers(_words(spark, sf_dir), F.char_length("line") >= 10, "^[a-m]")


# --------------------------------------------------------------------------- keyword cascade

_BRIEF = "lower(" + literals._FOLD.replace("translate(x,", "translate({},") + ")"


def _cascade_sql() -> str:
    fold = lambda c: _BRIEF.format(c)
    brief = fold(f"concat_ws(' ', {plans.TITLE}, source, 2000 + doc_id % 100)")
    said = ["text", "case when len(w) > 2 then concat_ws(' ', list_filter(w, lambda x: not regexp_full_match(x, '\\d+'))[1], list_filter(w, lambda x: regexp_full_match(x, '1[89]\\d{2}|20\\d{2}'))[1]) end", "case when len(w) >= 2 then coalesce(list_filter(w, lambda x: not regexp_full_match(x, '\\d+'))[1], w[1]) end", "text"]
    names = ["as asked", "author and year", "author only", "everything"]
    steps = " union all ".join(f"select query_id, {i} as st, '{names[i]}' as step, {said[i]} as said from w" for i in range(4))
    return f"""
with q as (select item_id as query_id, case item_id % 5 when 0 then 'src' || item_id || ' 20' || lpad((item_id % 100)::varchar, 2, '0') when 1 then 'src' || item_id || ' 20' || lpad((item_id % 100)::varchar, 2, '0') || ' nosuchword'
             when 2 then 'src' || item_id || ' nosuchword' when 3 then array_to_string(string_split(text, ' ')[1:3], ' ') else 'nosuchword neither' end as text from benchmark),
w as (select *, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') as w from q),
s as ({steps}), sp as (select *, string_split({fold("said")}, ' ') as words from s where said is not null),
d as (select doc_id, {brief} as brief, {fold("coalesce(text, '')")} as whole from documents),
m as (select query_id, st, step, said, doc_id from sp join d on len(list_filter(words, lambda x: not contains(case st when 3 then whole else brief end, x))) = 0),
b as (select * from m where st = (select min(st) from m n where n.query_id = m.query_id))
select query_id, step, said, doc_id as item_key, row_number() over (partition by query_id order by doc_id)::int as rank from b qualify rank <= 10"""


@query("keyword_cascade", _cascade_sql())
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    brief = F.concat_ws(" ", plans.first_line(), "source", (F.lit(2000) + F.col("doc_id") % 100).cast("string"))
    items = d.select(F.col("doc_id").alias("item_key"), brief.alias("brief"), F.col("text").alias("whole"))
    n, y = F.col("item_id").cast("string"), F.format_string("20%02d", F.col("item_id") % 100)
    forms = [F.concat(F.lit("src"), n, F.lit(" "), y), F.concat(F.lit("src"), n, F.lit(" "), y, F.lit(" nosuchword")), F.concat(F.lit("src"), n, F.lit(" nosuchword")), F.array_join(F.slice(F.split("text", " "), 1, 3), " "), F.lit("nosuchword neither")]
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.element_at(F.array(*forms), (F.col("item_id") % 5 + 1).cast("int")).alias("text"))
    return cascade.cascade(items, asked, 10)


# --------------------------------------------------------------------------- the evaluator


def _suite(spark, sf_dir) -> DataFrame:
    """The benchmark as a suite: every third query has candidates, every second exclusions."""
    b = table(spark, sf_dir, "benchmark")
    ids = lambda step, first: F.transform(F.sequence(F.lit(0), F.lit(120)), lambda i: (i * step + first).cast("string"))
    return b.select(F.col("item_id").cast("string").alias("query_id"), "text", F.when(F.col("item_id") % 2 == 0, ids(7, F.col("item_id"))).alias("exclude_ids"), F.when(F.col("item_id") % 3 == 0, ids(3, F.lit(1))).alias("candidate_ids"))


def evaluation(spark, sf_dir) -> DataFrame:
    """The suite under each profile: the ten best of each query, and how many of its exact ten are among them."""
    suite, index = _suite(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_key"), "embedding")
    vectors = kept(plans._paired(spark, sf_dir).withColumn("query_id", F.col("query_id").cast("string")), "asked")  # a stated query set
    docs, kept_index, shared = plans._docs(spark, sf_dir), plans.lexicon(spark, sf_dir), {}
    out = None
    for name in PROFILES:
        found, overlaps = search.evaluate(suite, docs, index, vectors, name, 10, skip_missing=True, postings=kept_index, shared=shared)
        rows = found.join(F.broadcast(overlaps), "query_id").select("query_id", "system", "rank", F.col("item_key").cast("long").alias("item_key"), F.round("overlap", 6).alias("overlap"))  # a stated query set
        out = rows if out is None else out.unionByName(rows)
    return out


def _evaluation_sql() -> str:
    may = "(query_id % 3 <> 0 or (item_key % 3 = 1 and item_key <= 361)) and not (query_id % 2 = 0 and item_key >= query_id and (item_key - query_id) % 7 = 0 and item_key <= query_id + 840)"
    # Dense rows, and lexical rows of the items that are indexed, cut by what a query may find before they are ranked.
    score = "1 - list_sum(list_transform(list_zip(embedding::double[], qv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    cosine = "list_sum(list_transform(list_zip(embedding::double[], qv), lambda p: p[1] * p[2])) / greatest(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) * sqrt(list_sum(list_transform(qv, lambda x: x * x))), 1e-30)"
    base = f"""
dq as (select vec_id query_id, embedding::double[] qv from embeddings where vec_id in (select item_id from benchmark)),
ds as (select * from (select query_id, vec_id item_key, {score} exact, {cosine} cosine from embeddings join dq on true) where {may}),
dr as (select *, row_number() over (partition by query_id order by exact desc, item_key)::int as rank from ds),
ll as (select query_id, item_key, exact, row_number() over (partition by query_id order by exact desc, item_key)::int as rank from le where query_id in (select query_id from dq) and {may}),
ex as (select query_id, list(item_key order by cosine desc, item_key)[1:10] as ten from ds group by query_id),
ti as (select doc_id item_key, array_to_string({plans.TOKENS.format(plans.TITLE)}, ' ') t, list_distinct({plans.TOKENS.format(plans.TITLE)}) own from documents),
bt as (select item_id query_id, list_distinct({plans.TOKENS.format("text")}) asked from benchmark)"""
    parts, unions = [], []
    for n, (name, settings) in enumerate(PROFILES.items()):
        if settings["mode"] == "dense":
            parts.append(f"f{n} as (select query_id, item_key, rank from dr where rank <= 100)")
        else:
            wd, wl = settings["weights"]["dense"], settings["weights"]["lex"]
            gated = "(lexical_rank = 1 and len(list_intersect(own, asked)) >= 3 and len(list_intersect(own, asked))::double / len(own) >= 0.8)" if settings.get("gate") else "false"
            parts.append(f"""
b{n} as (select query_id, item_key, 0 br, rank, {wd}::double / (60 + rank) part from dr where rank <= 100 union all select query_id, item_key, 1 br, rank, {wl}::double / (60 + rank) part from ll where rank <= 100),
s{n} as (select query_id, item_key, sum(part) exact, min((br, rank)) fst, min(case when br = 1 then rank end) lexical_rank from b{n} group by all),
r{n} as (select s{n}.*, coalesce({gated}, false) g, row_number() over (partition by query_id order by exact desc, fst, item_key) rk from s{n} join ti using (item_key) join bt using (query_id)),
f{n} as (select query_id, item_key, row_number() over (partition by query_id order by g desc, rk)::int as rank from r{n})""")
        if settings.get("collapse"):
            parts.append(f"""
c{n} as (select query_id, arg_min(item_key, rank) item_key, min(rank) fst from f{n} join ti using (item_key) group by query_id, case when t = '' then 'key:' || item_key else 'title:' || t end),
g{n} as (select query_id, item_key, row_number() over (partition by query_id order by fst)::int as rank from c{n})""")
        else:
            parts.append(f"g{n} as (select query_id, item_key, row_number() over (partition by query_id order by rank)::int as rank from f{n} where item_key in (select doc_id from documents))")
        unions.append(f"select g.query_id::varchar as query_id, '{name}' as system, rank, item_key, round(len(list_intersect(ten, o.found))::double / len(ten), 6) as overlap from g{n} g join ex using (query_id) join (select query_id, list(item_key) as found from g{n} where rank <= 10 group by query_id) o using (query_id) where rank <= 10")
    return "with " + plans._bm25_sql(True) + "," + base + "," + ",".join(parts) + " " + " union all ".join(unions)


QUERIES["evaluation"] = evaluation
SQL["evaluation"] = _evaluation_sql()


# --------------------------------------------------------------------------- passages


@query(
    "passages_placed",
    r"""with p as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from benchmark), d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') w from documents),
pw as (select item_id, len(w) n, unnest(range(len(w))) j, unnest(w) w from p), dw as (select doc_id, unnest(range(len(w))) i, unnest(w) w from d),
a as (select item_id, doc_id, i - j as start, any_value(n) n, count(*) agree from pw join dw using (w) group by all)
select item_id as passage, doc_id as text, start::int as start, n::int as n, agree::int as agree, agree / n as likeness from a
where agree >= n - floor(n * (1.0 - 0.8) + 1e-9) qualify row_number() over (partition by item_id, doc_id order by agree desc, start) = 1""",
)
def _(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage"), F.col("text").alias("words"))
    return passages.placed(asked, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text"), F.col("text").alias("words")))
