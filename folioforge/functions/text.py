"""Text functions over columns. Normalisers that look alike stay apart: each has its own callers and rules."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import tokens

# Latin letters with marks and what they are without, by their decomposition; a few have none.
_BASES = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in r if unicodedata.decomposition(chr(c)) and unicodedata.normalize("NFD", chr(c))[0].isascii()}
_BASES |= dict(zip("øØłŁđĐðÐıħĦ", "oOlLdDdDihH"))
ACCENTED, PLAIN = "".join(_BASES), "".join(_BASES.values())

# Letters that fold to two, how umlauts are spelled out, ligatures and quotes written plainly.
DOUBLED = (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "Th"))
DASHES = "‐‑‒–—―−"
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
QUOTES = (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"))


def normalized_title(c: Column) -> Column:
    """Tokens joined by spaces: the key of ranking collapse."""
    return F.array_join(tokens(c), " ")


def normalized_doi(c: Column) -> Column:
    """The key of ranking collapse: lower case, without resolver or prefix."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))


def clean_doi(c: Column) -> Column:
    """A DOI as written, case kept; null if there is none. Query strings and closing punctuation go."""
    found = F.regexp_extract(F.regexp_replace(F.trim(c), r"\?.*$", ""), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?(10\.\d{4,9}/\S+)$", 1)
    return F.nullif(F.regexp_replace(found, r"[.,);\]]+$", ""), F.lit(""))


def arxiv_id(c: Column) -> Column:
    """An arXiv number, old or new, with its version; null if there is none."""
    return F.nullif(F.regexp_extract(F.trim(c), r"(?i)^(?:arxiv:\s*|https?://arxiv\.org/(?:abs|pdf)/)?(\d{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+(?:\.[a-z]{2})?/\d{7}(?:v\d+)?)(?:\.pdf)?$", 1), F.lit(""))


def identifier(c: Column) -> Column:
    """struct(type, value, version) of what an identifier is: doi, arxiv, pmid, url; nulls if none."""
    t = F.trim(c)
    doi, arxiv = F.lower(clean_doi(t)), arxiv_id(t)
    pmid = F.nullif(F.regexp_extract(t, r"(?i)^(?:pmid:\s*)?(\d{1,8})$", 1), F.lit(""))
    version = F.nullif(F.regexp_extract(arxiv, r"v(\d+)$", 1), F.lit("")).cast("int")
    is_url = t.rlike(r"(?i)^https?://\S+$")
    kind = F.when(doi.isNotNull(), "doi").when(arxiv.isNotNull(), "arxiv").when(pmid.isNotNull(), "pmid").when(is_url, "url")
    value = F.when(doi.isNotNull(), doi).when(arxiv.isNotNull(), F.regexp_replace(arxiv, r"v\d+$", "")).when(pmid.isNotNull(), pmid).when(is_url, t)
    return F.struct(kind.alias("type"), value.alias("value"), F.when(doi.isNull(), version).alias("version"))


def squashed(c: Column) -> Column:
    """The key of preprint suppression: lower case without white space."""
    return F.regexp_replace(F.lower(c), r"\s+", "")


def duplicate_title(c: Column) -> Column:
    """The key of duplicate search: punctuation goes, spaces squeeze, one article after the other goes."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))
    for article in ("a", "an", "the"):
        t = F.regexp_replace(t, f"^{article} ", "")
    return t


def folded(c: Column) -> Column:
    """For search: accents and dashes folded."""
    out = F.translate(F.translate(c, ACCENTED, PLAIN), DASHES, "-" * len(DASHES))
    for a, b in DOUBLED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def search_variants(c: Column) -> Column:
    """Distinct spellings to try, in a fixed order: as given, folded, dashes as spaces, umlauts spelled out, spaces as dashes."""
    spelled = c
    for a, b in UMLAUTS:
        spelled = F.replace(spelled, F.lit(a), F.lit(b))
    dashless = F.replace(F.translate(c, DASHES, "-" * len(DASHES)), F.lit("-"), F.lit(" "))
    return F.array_distinct(F.array(c, folded(c), dashless, F.replace(folded(c), F.lit("-"), F.lit(" ")), spelled, F.replace(c, F.lit(" "), F.lit("-"))))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<.*?>", "")


def pdf_text(c: Column) -> Column:
    """Extracted text as typed: words joined over line breaks, plain dashes, quotes and ligatures, single spaces."""
    t = F.translate(F.regexp_replace(c, r"(\p{L})-\n(\p{L})", "$1$2"), DASHES, "-" * len(DASHES))
    for a, b in (*LIGATURES, *QUOTES):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def matching_text(c: Column) -> Column:
    return F.lower(F.replace(pdf_text(c), F.lit(" "), F.lit("")))


def match_threshold(c: Column) -> Column:
    """How alike a fuzzy match must be, by the length of what is sought."""
    return F.when(F.length(c) < 50, 0.85).when(F.length(c) < 150, 0.75).otherwise(0.65)


def citation_key(extra: Column) -> Column:
    """The first line of ``extra`` that names a citation key."""
    line = F.get(F.filter(F.split(extra, "\n"), lambda x: x.rlike(r"(?i)^citation ?key:")), 0)
    return F.trim(F.regexp_replace(line, r"(?i)^citation ?key:", ""))


def truncated(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def quality(c: Column) -> Column:
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n >= 500, "good").when(n > 0, "degraded").otherwise("empty")


def size_warned(c: Column) -> Column:
    """With a note in front where the text may be 5,000 tokens or more."""
    estimate = F.floor(F.length(c) / 4)
    return F.when(estimate >= 5000, F.concat(F.lit("Large result: about "), estimate.cast("string"), F.lit(" tokens.\n\n"), c)).otherwise(c)


def creators_text(creators: Column) -> Column:
    """Last, First of each (a null part is absent, an empty one is not), else the name; joined by semicolons."""
    each = F.transform(creators, lambda x: F.when(x["lastName"].isNotNull() & x["firstName"].isNotNull(), F.concat(x["lastName"], F.lit(", "), x["firstName"])).otherwise(x["name"]))
    joined = F.array_join(F.filter(each, lambda x: x.isNotNull()), "; ")
    return F.when(F.coalesce(F.length(joined), F.lit(0)) == 0, F.lit("No authors listed")).otherwise(joined)


def parsed_creators(c: Column) -> Column:
    """The inverse: array of struct(lastName, firstName, name)."""
    parts = F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")

    def one(x: Column) -> Column:
        comma = F.locate(",", x) > 0
        return F.struct(F.when(comma, F.trim(F.substring_index(x, ",", 1))).alias("lastName"), F.when(comma, F.trim(F.regexp_replace(x, "^[^,]*,", ""))).alias("firstName"), F.when(~comma, x).alias("name"))

    return F.transform(parts, one)


def year_terms(query: Column) -> Column:
    return F.filter(F.split(query, " "), lambda w: w.rlike(r"^(1[89]\d{2}|20\d{2})$"))


def masked(c: Column, keep: int = 4) -> Column:
    return F.when(F.length(c) <= keep, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.left(c, F.lit(keep)), F.repeat(F.lit("*"), F.length(c) - keep)))


def endpoint(c: Column) -> Column:
    """Scheme, host, port and path of a URL: no credentials, query or fragment."""
    return F.regexp_replace(F.regexp_replace(c, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://)[^/?#@]*@", "$1"), r"[?#].*$", "")


def provenance(extra: Column, header: str = "[Paper Ingest Provenance]") -> Column:
    """Map of the ``key: value`` lines after the header, up to the next bracketed line."""
    after = F.substring_index(F.concat(extra, F.lit("\n")), header, -1)
    block = F.when(F.locate(header, extra) > 0, F.regexp_replace(after, r"(?s)\n\[.*$", "\n"))
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*[^:\s]+:"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", "")))))


def provenance_text(fields: dict[str, Column], header: str = "[Paper Ingest Provenance]") -> Column:
    """The inverse of ``provenance``: a line for each field that is not null."""
    told = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in fields.items()]
    return F.array_join(F.array_compact(F.array(F.lit(header), *told)), "\n")


def attachment_path(path: Column, key: Column, storage: str, base: str) -> Column:
    """Where an attachment's URI points: storage:, file://, attachments:, absolute; else null."""
    return (
        F.when(path.startswith("storage:"), F.concat_ws("/", F.lit(storage), key, F.regexp_replace(path, "^storage:", "")))
        .when(path.startswith("file://"), F.url_decode(F.replace(F.regexp_replace(path, "^file://", ""), F.lit("+"), F.lit("%2B"))))
        .when(path.startswith("attachments:"), F.concat_ws("/", F.lit(base), F.regexp_replace(path, "^attachments:", "")))
        .when(path.startswith("/"), path)
    )


def list_values(c: Column) -> Column:
    """A list given as a JSON array, a JSON string, words between commas, or one word: its parts that are not empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    parsed, quoted = F.from_json(t, "array<string>"), F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")
    parts = F.when(t.startswith("["), F.coalesce(parsed, F.array(t))).when(t.startswith('"') & (F.size(quoted) == 1), quoted).otherwise(F.split(t, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def split_name(c: Column) -> Column:
    """struct(firstName, lastName) of a name in one string, at its last space; a single word is a last name."""
    t = F.trim(c)
    return F.struct(F.trim(F.regexp_extract(t, r"^(.*)\s\S+$", 1)).alias("firstName"), F.regexp_extract(t, r"(\S+)$", 1).alias("lastName"))


def safe_path(c: Column, extensions: tuple[str, ...]) -> Column:
    """Whether a path is relative, stays below its folder, and has one of these extensions."""
    inside = ~c.startswith("/") & ~c.rlike(r"(^|/)\.\.(/|$)") & ~c.rlike(r"^[A-Za-z]:")
    return F.coalesce(inside & F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1)).isin(*extensions), F.lit(False))


def overlap_of_paths(a: Column, b: Column) -> Column:
    """equal, inside (a in b), contains (b in a) or null."""
    x, y = (F.concat(F.regexp_replace(c, "/+$", ""), F.lit("/")) for c in (a, b))
    return F.when(x == y, "equal").when(x.startswith(y), "inside").when(y.startswith(x), "contains")


def anchor(text: Column, from_start: bool, length: int = 40, more: int = 15) -> Column:
    """The first (or last) ``length`` characters, with the rest of a word that they cut if that is shorter than
    ``more``; empty where the text is shorter than two anchors."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    if from_start:
        found = F.concat(F.left(t, F.lit(length)), F.regexp_extract(F.substring(t, length + 1, more), f"^([^ ]{{0,{more - 1}}}) ", 1))
    else:
        before = F.left(t, F.greatest(F.length(t) - length, F.lit(0)))
        found = F.concat(F.regexp_extract(F.right(before, F.lit(more)), f" ([^ ]{{0,{more - 2}}})$", 1), F.right(t, F.lit(length)))
    return F.when(F.length(t) < 2 * length, "").otherwise(F.trim(found))
