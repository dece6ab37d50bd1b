"""Queries over texts that the driver's tables do not hold as such: identifiers, creators, citation keys, attachments'
paths, payloads of registries. Each row of ``documents`` is one: a form by its id, filled with its id, its first line or its text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import acquire, items
from .library import TITLE, first_line, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def filled(forms: list) -> Column:
    """One of ``forms`` (null is one) with {id}, {line} and {text} of a document in it."""
    form = F.element_at(F.array(*[F.lit(v).cast("string") for v in forms]), (F.pmod("doc_id", F.lit(len(forms))) + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    return F.replace(F.replace(F.replace(form, F.lit("{id}"), F.col("doc_id").cast("string")), F.lit("{line}"), F.substring_index(text, "\n", 1)), F.lit("{text}"), text)


def rows(spark: SparkSession, sf_dir: str, forms: list, name: str = "x") -> DataFrame:
    """id and a text column of every document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), filled(forms).alias(name))


def sql_filled(forms: list) -> str:
    quoted = ", ".join("null::varchar" if v is None else "e'" + v.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'" for v in forms)
    return f"replace(replace(replace([{quoted}][doc_id % {len(forms)} + 1], '{{id}}', doc_id::varchar), '{{line}}', split_part(coalesce(text, ''), chr(10), 1)), '{{text}}', coalesce(text, ''))"


def sql_rows(forms: list) -> str:
    return f"v(id, x) as (select doc_id, {sql_filled(forms)} from documents)"


def add(name: str, values: list, column, out: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rows(spark, sf_dir, values).select("id", column(F.col("x")).alias(out))
    SQL[name] = f"with {sql_rows(values)} select id, {sql} as {out} from v"


DOIS = ["10.1000/xyz{id}", " https://doi.org/10.1000/XYZ.{id} ", "http://dx.doi.org/10.5555/ab(c{id})", "doi:10.1000/x{id},", "DOI: 10.1000/y{id}).", "not a doi", "", None, "https://doi.org/10.1000/q{id}?utm=1", "10.12/short{id}", "{line}"]
add("doi_normalize", DOIS, X.normalized_doi, "doi", r"trim(regexp_replace(lower(trim(x)), '^(https?://(dx\.)?doi\.org/|doi:\s*)', ''))")
_CLEAN = r"""nullif(regexp_replace(regexp_extract(regexp_replace(trim({}), '\?.*$', ''), '^(?i:https?://(?:dx\.)?doi\.org/|doi:\s*)?(10\.\d{{4,9}}/\S+)$', 1), '[.,);\]]+$', ''), '')"""
add("doi_clean", DOIS, X.clean_doi, "doi", _CLEAN.format("x"))

ARXIV = ["arXiv:2101.00001v{id}", "2101.00001", "{line}", "https://arxiv.org/abs/1706.03762", "https://arxiv.org/pdf/1706.03762v5.pdf", "hep-th/9901001", "math.GT/0309136v1", "10.1000/x", "hello", None]
_ARXIV = r"nullif(regexp_extract(trim({}), '^(?i:arxiv:\s*|https?://arxiv\.org/(?:abs|pdf)/)?(\d{{4}}\.\d{{4,5}}(?:v\d+)?|(?i:[a-z\-]+(?:\.[a-z]{{2}})?)/\d{{7}}(?:v\d+)?)(?:\.pdf)?$', 1), '')"
add("arxiv_normalize", ARXIV, X.arxiv_id, "arxiv", _ARXIV.format("x"))

IDENTIFIERS = [*DOIS, *ARXIV, "PMID: {id}", "{id}", "https://example.org/paper?id={id}", "garbage in {line}"]
QUERIES["identifier_normalize"] = lambda spark, sf_dir: rows(spark, sf_dir, IDENTIFIERS).select("id", X.identifier(F.col("x")).alias("i")).select("id", "i.type", "i.value", "i.version")
SQL["identifier_normalize"] = (
    f"with {sql_rows(IDENTIFIERS)}, k as (select id, trim(x) t, lower({_CLEAN.format('x')}) d, {_ARXIV.format('x')} a, nullif(regexp_extract(trim(x), '^(?i:pmid:\\s*)?(\\d{{1,8}})$', 1), '') p from v) "
    "select id, case when d is not null then 'doi' when a is not null then 'arxiv' when p is not null then 'pmid' when regexp_full_match(t, '(?i)https?://\\S+') then 'url' end as type, "
    "case when d is not null then d when a is not null then regexp_replace(a, 'v\\d+$', '') when p is not null then p when regexp_full_match(t, '(?i)https?://\\S+') then t end as value, "
    "case when d is null then nullif(regexp_extract(a, 'v(\\d+)$', 1), '')::int end as version from k"
)

TITLES = ["{text}", "The {line}", "An {line}", "The Quick Brown Fox", "quick brown fox", "  QUICK  BROWN  FOX!  ", "A the An apple", "An Apple", "the", "Été à Paris: l'an 2000", "", None, "a a a", "STRASSE straße", "ﬁne ½ snake_case"]


def _articles(sql: str) -> str:
    for a in ("a", "an", "the"):
        sql = f"regexp_replace({sql}, '^{a} ', '')"
    return sql


add("title_normalize", TITLES, X.duplicate_title, "title", _articles(r"trim(regexp_replace(regexp_replace(lower(trim(x)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"))
add("title_tokens", TITLES, X.normalized_title, "title", r"array_to_string(regexp_extract_all(replace(replace(replace(lower(coalesce(x, '')), 'ß', 'ss'), 'ﬁ', 'fi'), '½', '1⁄2'), '[\p{L}\p{N}]+'), ' ')")
add("title_squashed", TITLES, X.squashed, "title", r"regexp_replace(lower(x), '\s+', '', 'g')")

NAMES = ["{text}", "{line}", "Müller–Lüdenscheidt", "Cladder–Micus", "plain words here", "Straße", "naïve café", None, "", "Łódź Ærøskøbing cœur Đặng Čapek Őr"]
_FOLD = f"replace(replace(replace(replace(strip_accents(translate(translate(x, 'łŁøØđĐ', 'lLoOdD'), '{X.DASHES}', '-------')), 'ß', 'ss'), 'æ', 'ae'), 'Æ', 'AE'), 'œ', 'oe')"
add("search_folded", NAMES, X.folded, "name", _FOLD)
_VARIANTS = f"[x, {_FOLD}, replace(translate(x, '{X.DASHES}', '-------'), '-', ' '), replace({_FOLD}, '-', ' '), replace(replace(replace(replace(x, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), replace(x, ' ', '-')]"
QUERIES["query_variants"] = lambda spark, sf_dir: rows(spark, sf_dir, [n for n in NAMES if n is not None]).select("id", F.array_sort(X.search_variants(F.col("x"))).alias("variants"))
SQL["query_variants"] = f"with {sql_rows([n for n in NAMES if n is not None])} select id, list_sort(list_distinct({_VARIANTS})) as variants from v"

EXTRAS = ["{text}\nCitation Key: Key{id}\n{text}", "Citation Key: Smith{id}\nother", "note\nCitationKey:Doe99", "citation key:  low ", "no key\nCitation Keys: x", "", None, "a\ncitation key: one\nCitation Key: two"]
add("citekey_parse", EXTRAS, X.citation_key, "citekey", "trim(regexp_replace(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '(?i)^citation ?key:'))[1], '(?i)^citation ?key:', ''))")

PROVENANCE = ["[Paper Ingest Provenance]\nsource: unpaywall {id}\nhas_fulltext: true\n[Other]\nx: y", "before\n[Paper Ingest Provenance]\n a : b c \nno colon line\nurl: http://x/y", "nothing", "{line}\n[Paper Ingest Provenance]\ntitle: {line}\nid: {id}", None]
QUERIES["provenance_parse"] = lambda spark, sf_dir: rows(spark, sf_dir, PROVENANCE).select("id", F.explode(X.provenance(F.col("x"))).alias("key", "value"))
SQL["provenance_parse"] = (
    f"with {sql_rows(PROVENANCE)}, b as (select id, regexp_replace(split_part(x || chr(10), '[Paper Ingest Provenance]', 2), '(?s)\\n\\[.*$', chr(10)) b from v where contains(x, '[Paper Ingest Provenance]')), "
    "l as (select id, unnest(string_split(b, chr(10))) l from b) select id, trim(split_part(l, ':', 1)) as key, trim(regexp_replace(l, '^[^:]*:', '')) as value from l where regexp_matches(l, '^\\s*[^:\\s]+\\s*:') and regexp_matches(l, '^\\s*[^:\\s]+:')"
)

CREATORS = ["{line}; Doe{id}, Jane", "{line}, J.; {line}", "Doe, Jane; Roe{id}, Richard", "Plato", "van Gogh, Vincent; UNESCO;  ; Smith, J., Jr.", "", None]
QUERIES["creators_parse"] = lambda spark, sf_dir: rows(spark, sf_dir, CREATORS).select("id", F.posexplode(X.parsed_creators(F.col("x"))).alias("pos", "c")).select("id", F.col("pos").cast("long").alias("pos"), "c.lastName", "c.firstName", "c.name")
SQL["creators_parse"] = (
    f"with {sql_rows(CREATORS)}, p as (select id, list_filter(list_transform(string_split(x, ';'), lambda s: trim(s)), lambda s: s <> '') ps from v), "
    "u as (select id, unnest(range(len(ps)))::bigint pos, unnest(ps) c from p) select id, pos, case when contains(c, ',') then trim(split_part(c, ',', 1)) end as \"lastName\", case when contains(c, ',') then trim(regexp_replace(c, '^[^,]*,', '')) end as \"firstName\", case when not contains(c, ',') then c end as name from u"
)
QUERIES["creators_format"] = lambda spark, sf_dir: rows(spark, sf_dir, CREATORS).select("id", X.creators_text(X.parsed_creators(F.col("x"))).alias("creators"))
SQL["creators_format"] = (
    f"with {sql_rows(CREATORS)}, p as (select id, list_filter(list_transform(string_split(x, ';'), lambda s: trim(s)), lambda s: s <> '') ps from v) "
    "select id, coalesce(nullif(array_to_string(list_transform(ps, lambda c: case when contains(c, ',') then trim(split_part(c, ',', 1)) || ', ' || trim(regexp_replace(c, '^[^,]*,', '')) else c end), '; '), ''), 'No authors listed') as creators from p"
)

PDF = ["{text}", "{line}-\n{text}", "“{line}” – ﬁ", "hyphen-\nated words", "“quoted” – dash", "ﬁne ﬂow of oﬃce", " many \n\n lines\tand  tabs ", "", None]
_PDF = "translate(regexp_replace(x, '(\\p{L})-\\n(\\p{L})', '\\1\\2', 'g'), '" + X.DASHES + "', '-------')"
for _a, _b in (*X.LIGATURES, *X.QUOTES):
    _PDF = f"replace({_PDF}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
_PDF = f"trim(regexp_replace({_PDF}, '[ \\t\\r\\n]+', ' ', 'g'))"
add("pdf_text_normalize", PDF, X.pdf_text, "text", _PDF)
add("pdf_text_matching", PDF, X.matching_text, "text", f"lower(replace({_PDF}, ' ', ''))")

PATHS = ["storage:paper{id}.pdf", "file:///home/u/My%20File%20{id}.pdf", "/abs/{id}/olute.pdf", "attachments:sub/x.pdf", "ftp://x/y", "", None]
add("attachment_paths", PATHS, lambda c: X.attachment_path(c, F.lit("KEY1"), "/data/storage", "/base"), "path", "case when starts_with(x, 'storage:') then '/data/storage/KEY1/' || substr(x, 9) when starts_with(x, 'file://') then url_decode(substr(x, 8)) when starts_with(x, 'attachments:') then '/base/' || substr(x, 13) when starts_with(x, '/') then x end")

SECRETS = ["{line}", "key{id}", "abcdefgh", "abc", "", "abcd", "a longer secret key", None]
add("masked", SECRETS, X.masked, "masked", "case when length(x) <= 4 then repeat('*', length(x)) else left(x, 4) || repeat('*', length(x) - 4) end")
URLS = ["https://user:pw{id}@host.org:8000/v1?key=1#f", "http://host/path/{id}", "plain", "https://h.org?x", None]
add("endpoints", URLS, X.endpoint, "endpoint", r"regexp_replace(regexp_replace(x, '^([a-zA-Z][a-zA-Z0-9+.\-]*://)[^/?#@]*@', '\1'), '[?#].*$', '')")

ASKED = ["{text} 19{id}", "{line} 2001", "smith 2019 deep", "1799 revolution 2099 3000", "no year", "1850", ""]
QUERIES["query_years"] = lambda spark, sf_dir: rows(spark, sf_dir, ASKED).select("id", X.year_terms(F.col("x")).alias("years"))
SQL["query_years"] = f"with {sql_rows(ASKED)} select id, list_filter(string_split(x, ' '), lambda w: regexp_full_match(w, '1[89][0-9][0-9]|20[0-9][0-9]')) as years from v"

POSITIONS = ['{"pageIndex": {id}, "rects": [[10.7, 20.2, 30, 40]]}', '{"pageIndex": 0, "rects": [[1, 700.5, 2, 3], [9, 9, 9, 9]]}']
QUERIES["sort_index"] = lambda spark, sf_dir: rows(spark, sf_dir, POSITIONS).select("id", (F.get_json_object("x", "$.pageIndex").cast("long") + 1).alias("page"), items.sort_index(F.col("x"), F.lit(792)).alias("sort_index"))
SQL["sort_index"] = f"with {sql_rows(POSITIONS)}, p as (select id, (x ->> '$.pageIndex')::bigint g, (x ->> '$.rects[0][0]')::double a, (x ->> '$.rects[0][1]')::double b from v) select id, g + 1 as page, lpad(g::varchar, 5, '0') || '|' || lpad(floor(792 - b)::bigint::varchar, 6, '0') || '|' || lpad(floor(a)::bigint::varchar, 5, '0') as sort_index from p"

CITED = ["10.1/{id}", "https://doi.org/10.1/B{id}", None, "10.1/b{id}", "{line}", " DOI:10.1/{id}"]
_TALLIES = "t as (select '10.1/' || p_partkey d, p_size s, p_size % 7 c from part union all select '10.1/B' || p_partkey, p_size + 1, null from part where p_partkey % 2 = 0)"


def _works(spark, sf_dir) -> DataFrame:
    """What registries say of works: parts, some by a second DOI."""
    p = table(spark, sf_dir, "part")
    plain = p.select(F.concat(F.lit("10.1/"), "p_partkey").alias("doi"), F.col("p_size").alias("supporting"), (F.col("p_size") % 7).alias("contrasting"), F.when(F.col("p_size") % 5 == 0, F.array(F.lit("retraction"), "p_brand")).when(F.col("p_size") % 5 == 1, F.array().cast("array<string>")).alias("notices"))
    return plain.unionByName(p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("10.1/B"), "p_partkey").alias("doi"), (F.col("p_size") + 1).alias("supporting"), F.lit(None).cast("int").alias("contrasting"), F.lit(None).cast("array<string>").alias("notices")))


QUERIES["citation_enrich"] = lambda spark, sf_dir: acquire.cited(rows(spark, sf_dir, CITED, "doi"), _works(spark, sf_dir).drop("notices")).select("id", "doi", "supporting", "contrasting")
SQL["citation_enrich"] = f"with {sql_rows(CITED)}, {_TALLIES} select v.id, v.x as doi, t.s as supporting, t.c as contrasting from v left join t on trim(regexp_replace(lower(trim(x)), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '')) = lower(t.d)"
QUERIES["retraction_scan"] = lambda spark, sf_dir: acquire.retracted(rows(spark, sf_dir, CITED, "doi"), _works(spark, sf_dir)).select("id", "doi", "notices")
SQL["retraction_scan"] = f"with {sql_rows(CITED)} select id, x as doi, ['retraction', p_brand] as notices from v join part on p_size % 5 = 0 and trim(regexp_replace(lower(trim(x)), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '')) = '10.1/' || p_partkey"

IEEE = ['{line} "doi":"10.1109/5.{id}" {text}', '{text}<meta name="citation_doi" content="10.1109/X.{id}">', "nothing", "{text}", None]
add("landing_page_doi", IEEE, acquire.landing_doi, "doi", """coalesce(nullif(regexp_extract(x, '"doi"\\s*:\\s*"([^"]+)"', 1), ''), nullif(regexp_extract(x, 'citation_doi"\\s+content="([^"]+)"', 1), ''))""")

RESOLVED = ["https://doi.org/10.1000/{id}", "http://www.host.org:8000/a/b;c?q={id}#f", "https://h.org"]
QUERIES["proxy_urls"] = lambda spark, sf_dir: (
    table(spark, sf_dir, "documents")
    .select("doc_id", filled(RESOLVED).alias("u"), F.regexp_replace(first_line(), r"[^\p{L} ]", "").alias("t"), "source")
    .select("doc_id", acquire.by_host(F.col("u"), "proxy.example.org").alias("by_host"), acquire.by_query(F.col("u"), "https://p.example.org/login").alias("by_query"), acquire.open_url(F.concat(F.lit("10.1000/"), F.col("doc_id")), {"title": F.col("t"), "au": F.lit(None).cast("string"), "jtitle": F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")}).alias("open_url"))
)
SQL["proxy_urls"] = rf"""
with v as (select doc_id, {sql_filled(RESOLVED)} as u, replace(url_encode(regexp_replace({TITLE}, '[^\p{{L}} ]', '', 'g')), '%20', '+') as t, source from documents)
select doc_id, regexp_extract(u, '^([a-z]+://)', 1) || replace(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1), '.', '-') || '.proxy.example.org' || regexp_extract(u, '^[a-z]+://[^/?#]*(.*)$', 1) as by_host,
       'https://p.example.org/login?url=' || url_encode(u) as by_query,
       'rft_id=' || url_encode('doi:10.1000/' || doc_id) || '&rft.genre=article' || case when t <> '' then '&rft.title=' || t else '' end || case when doc_id % 2 = 0 and source is not null then '&rft.jtitle=' || url_encode(source) else '' end as open_url from v"""

QUERIES["provenance_text"] = lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", X.provenance_text({"source": F.col("source"), "n_chars": F.col("n_chars"), "open": F.col("doc_id") % 2 == 0, "lang": F.when(F.col("doc_id") % 3 == 0, F.col("lang"))}).alias("extra"))
SQL["provenance_text"] = "select doc_id, '[Paper Ingest Provenance]' || case when source is not null then chr(10) || 'source: ' || source else '' end || case when n_chars is not null then chr(10) || 'n_chars: ' || n_chars else '' end || chr(10) || 'open: ' || case when doc_id % 2 = 0 then 'true' else 'false' end || case when doc_id % 3 = 0 and lang is not null then chr(10) || 'lang: ' || lang else '' end as extra from documents"
