"""Electronic books and annotated pages: chapters of a zip container, canonical fragment identifiers of a
passage, note HTML, annotations' positions."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F

# Annotation kinds by code, elements without text, characters of a page.
KINDS = {1: "highlight", 2: "note", 3: "image", 4: "ink", 5: "underline"}
SILENT = frozenset("script style head meta link title".split())
PAGE_CHARACTERS = 1800


def spine(container: bytes) -> list[tuple[int, str, str]]:
    """(place in the reading order, path, text of the file) of each chapter."""
    with zipfile.ZipFile(io.BytesIO(container)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile"))
        tree = ElementTree.fromstring(z.read(package))
        files = {e.get("id"): e.get("href") for e in tree.iter() if e.tag.endswith("}item")}
        order = [e.get("idref") for e in tree.iter() if e.tag.endswith("}itemref")]
        folder = posixpath.dirname(package)
        return [(i, p, z.read(p).decode("utf-8", "replace")) for i, p in ((i, posixpath.normpath(posixpath.join(folder, files[r]))) for i, r in enumerate(order) if r in files)]


class _Nodes(HTMLParser):
    """Text nodes with the steps to them: elements count 2, 4, ..., texts between them 1, 3, ..."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = [["", 0]]
        self.found: list[tuple[tuple[int, ...], str]] = []

    def handle_starttag(self, tag, attrs) -> None:
        self.stack[-1][1] += 1
        if tag not in ("br", "hr", "img", "meta", "link", "input"):
            self.stack.append([tag, 0])

    def handle_startendtag(self, tag, attrs) -> None:
        self.stack[-1][1] += 1

    def handle_endtag(self, tag) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data) -> None:
        if any(t in SILENT for t, _ in self.stack):
            return
        steps = tuple(2 * n for _, n in self.stack[:-1]) + (1 + 2 * self.stack[-1][1],)
        self.found.append((steps, data))


def text_nodes(page: str) -> list[tuple[tuple[int, ...], str]]:
    parser = _Nodes()
    parser.feed(page)
    parser.close()
    return parser.found


def _step(steps: tuple[int, ...], offset: int) -> str:
    return "".join(f"/{s}" for s in steps) + f":{offset}"


def fragment(place: int, page: str, passage: str) -> str | None:
    """The identifier of a passage's range in the chapter at ``place``: exactly, else without white space."""
    nodes = text_nodes(page)
    whole = "".join(t for _, t in nodes)
    at = whole.find(passage) if passage else -1
    end = at + len(passage)
    if at < 0:
        places = [i for i, c in enumerate(whole) if not c.isspace()]
        short = "".join(passage.split())
        hit = "".join(whole[i] for i in places).find(short) if short else -1
        if hit < 0:
            return None
        at, end = places[hit], places[hit + len(short) - 1] + 1
    marks, passed = [], 0
    for steps, text in nodes:
        if passed <= at < passed + len(text):
            marks.append((steps, at - passed))
        if passed < end <= passed + len(text):
            marks.append((steps, end - passed))
        passed += len(text)
    (a, i), (b, j) = marks[0], marks[-1]
    shared = 0
    while shared < min(len(a), len(b)) - 1 and a[shared] == b[shared]:
        shared += 1
    head = "".join(f"/{s}" for s in a[:shared])
    return f"epubcfi(/6/{2 * (place + 1)}!{head},{_step(a[shared:], i)},{_step(b[shared:], j)})"


def pseudo_page(before: Column, offset: Column) -> Column:
    """A page number for a place ``offset`` characters into a chapter with ``before`` characters ahead of it."""
    return (F.floor((before + offset) / PAGE_CHARACTERS) + 1).cast("long")


def note_html(title: Column, body: Column) -> Column:
    """A note's HTML: its title escaped, a paragraph for each blank line, a break for each line."""
    escaped = title
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    paragraphs = F.transform(F.split(body, "\n\n"), lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br/>")), F.lit("</p>")))
    heading = F.when(F.length(F.coalesce(title, F.lit(""))) > 0, F.concat(F.lit("<h1>"), escaped, F.lit("</h1>"))).otherwise(F.lit(""))
    return F.concat(heading, F.array_join(paragraphs, ""))


def kind_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(names[code], F.lit("unknown"))


def joined_hyphens(text: str) -> str:
    return re.sub(r"(\w)-\n(\w)", r"\1\2", text)
