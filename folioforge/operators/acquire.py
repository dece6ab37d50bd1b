"""Acquisition: parsing of captured payloads, choice of a location, routing, extraction quality.

Requests themselves are a boundary: these operators take tables of payloads that something else fetched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized_doi

# Registry types as item types.
WORK_TYPES = {
    "journal-article": "journalArticle",
    "book": "book",
    "book-chapter": "bookSection",
    "proceedings-article": "conferencePaper",
    "report": "report",
    "dissertation": "thesis",
    "posted-content": "preprint",
    "monograph": "book",
    "reference-entry": "encyclopediaArticle",
    "dataset": "document",
    "peer-review": "document",
    "edited-book": "book",
    "standard": "document",
}
LOCATION = "struct<url: string, url_for_pdf: string, host_type: string, license: string, version: string>"
OPEN_ACCESS = f"doi string, title string, is_oa boolean, year int, publisher string, best_oa_location {LOCATION}, oa_locations array<{LOCATION}>"
WORK = "type string, title array<string>, `container-title` array<string>, author array<struct<given: string, family: string, name: string>>, published struct<`date-parts`: array<array<int>>>, ISSN array<string>, abstract string, publisher string, volume string, DOI string"
PAYWALL_CODES = (401, 402, 403)


def best_pdf(payload: Column) -> Column:
    """The URL to fetch: the best location's PDF, else the first other PDF, else the best landing page."""
    p = F.from_json(payload, OPEN_ACCESS)
    others = F.filter(p["oa_locations"], lambda x: x["url_for_pdf"].isNotNull())
    return F.coalesce(p["best_oa_location"]["url_for_pdf"], F.get(others, 0)["url_for_pdf"], p["best_oa_location"]["url"])


def work_item(payload: Column) -> Column:
    """A registry's work as an item: type, title, publication, creators, date, abstract without markup."""
    p = F.from_json(payload, WORK)
    kinds = F.create_map(*[F.lit(x) for pair in WORK_TYPES.items() for x in pair])
    creators = F.transform(p["author"], lambda a: F.struct(a["family"].alias("lastName"), F.when(a["family"].isNotNull(), F.coalesce(a["given"], F.lit(""))).alias("firstName"), F.when(a["family"].isNull(), a["name"]).alias("name")))
    return F.struct(
        F.coalesce(kinds[p["type"]], F.lit("document")).alias("item_type"),
        F.get(p["title"], 0).alias("title"),
        F.get(p["container-title"], 0).alias("publication"),
        creators.alias("creators"),
        F.array_join(F.transform(F.get(p["published"]["date-parts"], 0), lambda x: x.cast("string")), "-").alias("date"),
        F.trim(F.regexp_replace(F.coalesce(p["abstract"], F.lit("")), "<[^>]+>", "")).alias("abstract"),
        p["DOI"].alias("doi"),
    )


def atom_entry(payload: Column) -> Column:
    """An Atom feed's first entry: title, summary, published, authors, categories."""
    path = lambda x: f"/*[local-name()='feed']/*[local-name()='entry'][1]/*[local-name()='{x}']"
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.struct(
        squeezed(F.xpath_string(payload, F.lit(path("title")))).alias("title"),
        squeezed(F.xpath_string(payload, F.lit(path("summary")))).alias("abstract"),
        F.left(F.xpath_string(payload, F.lit(path("published"))), F.lit(10)).alias("date"),
        F.xpath(payload, F.lit(path("author") + "/*[local-name()='name']/text()")).alias("authors"),
    )


def route(status: Column, url: Column, proxy_host: str) -> Column:
    """direct, proxy (behind a paywall the proxy may open, or on the proxy's host already) or retry."""
    host = F.parse_url(url, F.lit("HOST"))
    return F.when(host == proxy_host, "proxy").when(status.isin(*PAYWALL_CODES), "proxy").when(status.isin(429, 500, 502, 503, 504), "retry").otherwise("direct")


def chosen_extraction(texts: dict[str, Column], least: int = 500) -> Column:
    """struct(backend, text, quality, chain) over backends in order: the first good text, else the
    longest; the chain names what was tried."""
    names = list(texts)
    lengths = {n: F.length(F.coalesce(texts[n], F.lit(""))) for n in names}
    longest = F.greatest(*lengths.values()) if len(names) > 1 else lengths[names[0]]
    backend = F.coalesce(*[F.when(lengths[n] >= least, F.lit(n)) for n in names], *[F.when((lengths[n] == longest) & (longest > 0), F.lit(n)) for n in names])
    text = F.coalesce(*[F.when(backend == n, texts[n]) for n in names], F.lit(""))
    tried, earlier = [], F.lit(True)
    for n in names:
        tried.append(F.when(earlier, F.lit(n)))
        earlier &= lengths[n] < least
    quality = F.when(F.length(text) >= least, "good").when(F.length(text) > 0, "degraded").otherwise("empty")
    return F.struct(backend.alias("backend"), quality.alias("quality"), F.array_compact(F.array(*tried)).alias("chain"), F.length(text).alias("char_count"))


def is_pdf(content: Column, least: int = 1000) -> Column:
    return (F.substring(content, 1, 4) == F.lit(b"%PDF")) & (F.octet_length(content) >= least)


def indicator(has_pdf: Column, attachments: Column, has_notes: Column) -> Column:
    """What an item has besides itself, in words."""
    return F.array_join(F.array_compact(F.array(F.when(has_pdf, F.lit("PDF")), F.when(attachments > 0, F.concat(attachments.cast("string"), F.lit(" attachments"))), F.when(has_notes, F.lit("has notes")))), ", ")


# --------------------------------------------------------------------------- citations


def _by_doi(items: DataFrame, works: DataFrame, how: str) -> DataFrame:
    """``works`` has one row a DOI; DOIs meet however they are written. Items without one stay where ``how`` keeps them, apart from
    the join, so that they are no hot key."""
    key = F.nullif(normalized_doi(F.coalesce("doi", F.lit(""))), F.lit(""))
    told = works.withColumn("_d", F.nullif(normalized_doi(F.coalesce("doi", F.lit(""))), F.lit(""))).drop("doi").filter("_d is not null")
    keyed = items.withColumn("_d", key)
    met = keyed.filter("_d is not null").join(told, "_d", how)
    if how == "inner":
        return met.drop("_d")
    none = [F.lit(None).cast(t).alias(c) for c, t in told.dtypes if c != "_d"]
    return met.unionByName(keyed.filter("_d is null").select("*", *none)).drop("_d")


def cited(items: DataFrame, *works: DataFrame) -> DataFrame:
    """``items`` (doi, ...) with what each of ``works`` (doi, tallies or titles) says of them; nulls where nothing."""
    return reduce(lambda rows, told: _by_doi(rows, told, "left"), works, items)


def retracted(items: DataFrame, works: DataFrame) -> DataFrame:
    """The items whose work has editorial notices (an array that is not empty), with these."""
    return _by_doi(items, works.filter(F.size(F.coalesce("notices", F.array().cast("array<string>"))) > 0).select("doi", "notices"), "inner")


# --------------------------------------------------------------------------- institutional addresses


def landing_doi(page: Column) -> Column:
    """The DOI that a publisher's page states, in its data or its head."""
    told = F.regexp_extract(page, r'"doi"\s*:\s*"([^"]+)"', 1)
    head = F.regexp_extract(page, r'citation_doi"\s+content="([^"]+)"', 1)
    return F.coalesce(F.nullif(told, F.lit("")), F.nullif(head, F.lit("")))


def by_host(url: Column, suffix: str) -> Column:
    """The address with its host, dots as dashes, below a proxy's."""
    scheme, rest = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://)", 1), F.regexp_extract(url, r"(?s)^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(.*)$", 1)
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    return F.concat(scheme, F.replace(host, F.lit("."), F.lit("-")), F.lit("." + suffix), rest)


def by_query(url: Column, base: str) -> Column:
    """The address as a parameter of a proxy's."""
    return F.concat(F.lit(base + "?url="), F.url_encode(url))


def open_url(doi: Column, fields: dict[str, Column]) -> Column:
    """The parameters that a link resolver takes for an article; ``fields`` that are null or empty are left out."""
    parts = [F.concat(F.lit("rft_id="), F.url_encode(F.concat(F.lit("doi:"), doi))), F.lit("rft.genre=article")]
    parts += [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"rft.{name}="), F.url_encode(c))) for name, c in fields.items()]
    return F.array_join(F.array_compact(F.array(*parts)), "&")
