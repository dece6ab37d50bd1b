"""Renderings of items: markdown, connector JSON, BibTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import creators_text, truncated

# Item types as BibTeX entry types, and annotation colours by name.
BIBTEX_TYPES = {"journalArticle": "article", "book": "book", "bookSection": "incollection", "conferencePaper": "inproceedings", "thesis": "phdthesis", "report": "techreport", "webpage": "misc", "manuscript": "unpublished"}


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key], F.lit(default))


def result_markdown(rank: Column, title: Column, key: Column, date: Column, abstract: Column, length: int = 200) -> Column:
    lines = [
        F.concat(F.lit("## "), rank.cast("string"), F.lit(". "), F.coalesce(title, F.lit("Untitled"))),
        F.concat(F.lit("**Key:** "), key.cast("string")),
        F.when(F.coalesce(F.length(date), F.lit(0)) > 0, F.concat(F.lit("**Date:** "), date)),
        F.when(F.coalesce(F.length(abstract), F.lit(0)) > 0, F.concat(F.lit("**Abstract:** "), truncated(abstract, length))),
    ]
    return F.concat_ws("\n", *lines)


def connector_json(key: Column, title: Column, url: Column) -> Column:
    return F.to_json(F.struct(key.cast("string").alias("id"), F.coalesce(title, F.lit("Untitled")).alias("title"), F.coalesce(url, F.lit("")).alias("url")))


def bibtex(key: Column, item_type: Column, title: Column, author: Column, year: Column) -> Column:
    """Null for attachments and notes, which have no entry."""
    fields = [F.concat(F.lit(f"  {n} = {{"), F.replace(F.replace(v, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}")), F.lit("}")) for n, v in (("title", title), ("author", author), ("year", year))]
    body = F.array_join(F.filter(F.array(*[F.when(F.length(v) > 0, f) for f, v in zip(fields, (title, author, year))]), lambda x: x.isNotNull()), ",\n")
    return F.when(~item_type.isin("attachment", "note"), F.concat(F.lit("@"), lookup(BIBTEX_TYPES, item_type, "misc"), F.lit("{"), key.cast("string"), F.lit(",\n"), body, F.lit("\n}")))


def _has(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit(""))) > 0


def item_markdown(item: DataFrame, include_abstract: bool = True) -> Column:
    """An item's fields (item_key, item_type, title, date, creators, publication, volume, issue, pages, publisher,
    place, doi, url, extra, tags, abstract, collections, n_children; any may be missing) as markdown paragraphs."""
    col = lambda n: F.col(n).cast("string") if n in item.columns else F.lit(None).cast("string")
    kind = F.coalesce(col("item_type"), F.lit("unknown"))
    parts = lambda head, more: F.concat(head, *[F.when(_has(col(n)), F.concat(F.lit(label), col(n))).otherwise("") for label, n in more])
    key_line = F.get(F.filter(F.split(F.coalesce(col("extra"), F.lit("")), "\r?\n"), lambda x: F.lower(x).contains("citation key")), 0)
    key = F.when(key_line.contains(":"), F.trim(F.regexp_replace(key_line, "^[^:]*:", ""))).otherwise(F.trim(key_line))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("`"), t, F.lit("`"))), " ") if "tags" in item.columns else F.lit("")
    held = F.size(F.coalesce("collections", F.array().cast("array<string>"))) if "collections" in item.columns else F.lit(0)
    children = F.coalesce(F.col("n_children"), F.lit(0)) if "n_children" in item.columns else F.lit(0)
    lines = [
        F.concat(F.lit("# "), F.coalesce(col("title"), F.lit("Untitled"))),
        F.concat(F.lit("**Type:** "), kind),
        F.concat(F.lit("**Item Key:** "), F.coalesce(col("item_key"), F.lit("None"))),
        F.when(_has(col("date")), F.concat(F.lit("**Date:** "), col("date"))),
        F.when(F.size("creators") > 0, F.concat(F.lit("**Authors:** "), creators_text(F.col("creators")))) if "creators" in item.columns else None,
        F.when((kind == "journalArticle") & _has(col("publication")), parts(F.concat(F.lit("**Journal:** "), col("publication")), ((", Volume ", "volume"), (", Issue ", "issue"), (", Pages ", "pages")))),
        F.when((kind == "book") & _has(col("publisher")), parts(F.concat(F.lit("**Publisher:** "), col("publisher")), ((", ", "place"),))),
        F.when(_has(col("doi")), F.concat(F.lit("**DOI:** "), col("doi"))),
        F.when(_has(col("url")), F.concat(F.lit("**URL:** "), col("url"))),
        F.when(_has(col("extra")), F.concat(F.lit("\n\n## Extra\n\n"), col("extra"))),
        F.when(_has(col("extra")) & key_line.isNotNull(), F.concat(F.lit("**Citation Key (from Extra):** "), key)),
        F.when(_has(tags), F.concat(F.lit("**Tags:** "), tags)),
        F.when(_has(col("abstract")), F.concat(F.lit("\n\n## Abstract\n\n"), col("abstract"))) if include_abstract else None,
        F.when(held > 0, F.concat(F.lit("**Collections:** "), held.cast("string"), F.lit(" collections"))),
        F.when(children > 0, F.concat(F.lit("**Notes/Attachments:** "), children.cast("string"))),
    ]
    text = F.concat_ws("\n\n", *[x for x in lines if x is not None])
    return text


# Item fields as BibTeX fields.
BIBTEX_FIELDS = (("title", "title"), ("publication", "journal"), ("volume", "volume"), ("issue", "number"), ("pages", "pages"), ("publisher", "publisher"), ("doi", "doi"), ("url", "url"), ("abstract", "abstract"))


def bibtex_entry(item: DataFrame) -> Column:
    """An entry with the key of first author, year and item; null for attachments and notes. ``creators`` is an
    array of structs with creatorType, firstName, lastName, name."""
    col = lambda n: F.col(n).cast("string") if n in item.columns else F.lit(None).cast("string")
    first = F.get(F.col("creators"), 0)
    surname = F.coalesce(first["lastName"], F.element_at(F.split(F.trim(first["name"]), r"\s+"), -1), F.lit(""))
    year = F.when(_has(col("date")), F.left(col("date"), F.lit(4))).otherwise("nodate")
    name = F.concat(F.replace(surname, F.lit(" "), F.lit("")), year, F.lit("_"), col("item_key"))
    escaped = lambda c: F.replace(F.replace(c, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    fields = [F.when(_has(col(ours)), F.concat(F.lit(f"  {theirs} = {{"), escaped(col(ours)), F.lit("}"))) for ours, theirs in BIBTEX_FIELDS]
    authors = F.transform(F.filter("creators", lambda c: c["creatorType"] == "author"), lambda c: F.when(c["lastName"].isNotNull() & c["firstName"].isNotNull(), F.concat(c["lastName"], F.lit(", "), c["firstName"])).otherwise(c["name"]))
    authors = F.filter(authors, lambda a: a.isNotNull())
    fields.append(F.when(F.size(authors) > 0, F.concat(F.lit("  author = {"), F.array_join(authors, " and "), F.lit("}"))))
    fields.append(F.when(year != "nodate", F.concat(F.lit("  year = {"), year, F.lit("}"))))
    body = F.concat_ws(",\n", F.concat(F.lit("@"), lookup(BIBTEX_TYPES, col("item_type"), "misc"), F.lit("{"), name), *fields)
    return F.when(~col("item_type").isin("attachment", "note"), F.concat(body, F.lit("\n}")))


def feed_item_markdown(title: Column, item_type: Column, is_read: Column, creators: Column, added: Column, url: Column) -> Column:
    """One feed item; read or unread by its read time."""
    lines = [
        F.concat(F.lit("### "), F.coalesce(title, F.lit("Untitled"))),
        F.concat(F.lit("**Type:** "), item_type, F.lit(" | **Status:** "), F.when(is_read, "Read").otherwise("Unread")),
        F.when(_has(creators), F.concat(F.lit("**Authors:** "), creators)),
        F.concat(F.lit("**Added:** "), added),
        F.when(_has(url), F.concat(F.lit("**URL:** "), url)),
    ]
    return F.concat_ws("\n", *lines)


def _part(item: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in item.columns else F.lit(None).cast("string")


def result_block(item: DataFrame, rank: Column | None = None, abstract_length: int | None = 200, with_tags: bool = True, extra: dict[str, Column] | None = None) -> Column:
    """An item (item_key, item_type, title, date, creators, abstract, tags; any may be missing) in a list of results: heading with or
    without its rank, fields, ``extra`` fields by their labels, abstract (None: whole, 0: none), tags, and a blank line."""
    title = F.coalesce(_part(item, "title"), F.lit("Untitled"))
    authors = creators_text(F.col("creators")) if "creators" in item.columns else F.lit("No authors listed")
    lines = [
        F.concat(F.lit("## "), rank.cast("string"), F.lit(". "), title) if rank is not None else F.concat(F.lit("## "), title),
        F.concat(F.lit("**Type:** "), F.coalesce(_part(item, "item_type"), F.lit("unknown"))),
        F.concat(F.lit("**Item Key:** "), F.coalesce(_part(item, "item_key"), F.lit(""))),
        F.concat(F.lit("**Date:** "), F.coalesce(_part(item, "date"), F.lit("No date"))),
        F.concat(F.lit("**Authors:** "), authors),
        *[F.concat(F.lit(f"**{label}:** "), value.cast("string")) for label, value in (extra or {}).items()],
    ]
    if abstract_length != 0:
        shown = truncated(_part(item, "abstract"), abstract_length) if abstract_length else _part(item, "abstract")
        lines.append(F.when(_has(_part(item, "abstract")), F.concat(F.lit("**Abstract:** "), shown)))
    if with_tags and "tags" in item.columns:
        tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("`"), t, F.lit("`"))), " ")
        lines.append(F.when(_has(tags), F.concat(F.lit("**Tags:** "), tags)))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


#: Characters that a full text has at least, to be given as such.
LEAST_TEXT = 40


def fetched_json(item: DataFrame, address: str) -> Column:
    """What a connector fetches of an item: id, title, text, url, metadata. A text that is missing or too short gives way to
    title, authors and abstract."""
    key, title = _part(item, "item_key"), F.coalesce(_part(item, "title"), F.concat(F.lit("Item "), _part(item, "item_key")))
    authors = creators_text(F.col("creators")) if "creators" in item.columns else F.lit("No authors listed")
    text, abstract = _part(item, "fulltext"), _part(item, "abstract")
    brief = F.concat(title, F.lit("\n\n"), F.lit("Authors: "), authors, F.lit("\n"), F.when(_has(abstract), F.concat(F.lit("Abstract:\n"), abstract)).otherwise(""))
    enough = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")) >= LEAST_TEXT
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in item.columns else F.array().cast("array<string>")
    empty = lambda n: F.coalesce(_part(item, n), F.lit(""))
    metadata = F.struct(empty("item_type").alias("itemType"), empty("date").alias("date"), key.alias("key"), empty("doi").alias("doi"), authors.alias("authors"), tags.alias("tags"))
    return F.to_json(F.struct(key.alias("id"), title.alias("title"), F.when(enough, text).otherwise(brief).alias("text"), F.concat(F.lit(address), key).alias("url"), metadata.alias("metadata")))
