"""Main text of web pages by minimum-cut labelling.

A page is split into text blocks; a logistic classifier over each block's text, neighbours, place and
surroundings gives the costs of calling it content or boilerplate, which become capacities to the two
terminals. The names of classes are graded hints (the share of telling words in each name of a list, of any length, those
that often mislead apart), not verdicts. Blocks that follow each other, and blocks under one parent, are tied by
smoothness edges that weaken with their distance in the tree. The minimum cut is the labelling of
least total cost; blocks whose own costs outweigh all their ties are settled first (any minimum cut
agrees with that), and the rest goes through max-flow. The classifier is trained here, on labelled
pages that ``training_page`` makes, some with misleading names, by Newton's method.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by a line feed. Scripts, styles, titles, text areas and frames are left out;
formulas are text like any other, and so are hidden parts and templates inside an article (elsewhere that they
are hidden is a hint). Nothing else is dropped or cut.

Defined cases: null html is empty; a page without markup is one block of text; unclosed, stray and
misnested tags, unclosed comments and unclosed scripts are read as browsers would, roughly; nesting
of any depth, names and texts of any length, read whole; of labellings of equal cost that with fewer content blocks is taken; repeated rows are rows
of their own; no rows give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, sliced

# Element names of HTML and words that name parts of pages.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE = frozenset("nav footer aside form button select dialog menu head".split())
INSIDE = frozenset("article main".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
INSIDE_ROLES = frozenset("main article".split())
STRONG_WORDS = frozenset("ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer login masthead menu modal nav navbar navigation newsletter outbrain pager pagination popup sidebar sidenav signup sponsor sponsored subscribe subscription taboola toolbar topbar".split())
WEAK_WORDS = frozenset("banner disclaimer foot header notice notices notification overlay promo promoted promotion recommended related replies respond share sharing skip social tags widget widgets".split())
INSIDE_WORDS = frozenset("article body content entry main post story text".split())
NEUTRAL_WORDS = frozenset("area article bar block body bottom box col column container content entry global group inner item items left list main outer page panel post reader right row section site text top unit user wrap wrapper".split())
HIDDEN = 0.5  # the share of telling words that being hidden amounts to
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

_TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|$)|"[^"]*+"|'[^']*+'""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    """node: numbers of the open elements around it, innermost first, as a linked pair (parent, number).
    outside, inside: by elements and roles. strong, weak: the largest share of such words in a name
    around it. named: whether a name around it is one of content."""

    text: str
    link: int
    node: tuple
    depth: int
    tag: str
    outside: bool
    inside: bool
    strong: float
    weak: float
    named: bool


@dataclass(slots=True)
class _Open:
    name: str
    node: tuple
    depth: int
    hints: tuple[bool, bool, float, float, bool]
    link: bool


@lru_cache(1 << 16)
def _token_hints(token: str) -> tuple[float, float, bool]:
    """Shares of strong and of weak words in one class or id, and whether it names content."""
    words = {w.lower() for w in _PART.findall(token)}
    telling = words - NEUTRAL_WORDS
    n = max(1, len(telling))
    return len(telling & STRONG_WORDS) / n, len(telling & WEAK_WORDS) / n, bool(words & INSIDE_WORDS)


def _name_hints(value: str) -> tuple[float, float, bool]:
    """Of a list of names, of any length: each is judged by itself, and the most telling counts."""
    strong, weak, content = 0.0, 0.0, False
    for token in value.split():
        s, w, c = _token_hints(token) if len(token) <= 64 else _token_hints.__wrapped__(token)  # long ones are not remembered
        strong, weak, content = max(strong, s and s + w), max(weak, w), content or c
    return (strong, 0.0, False) if strong else (0.0, weak, content and not weak)


def _attributes(name: str, raw: str, parent: _Open) -> tuple[bool, bool, float, float, bool]:
    """The hints of an element, with what it inherits."""
    outside, inside, strong, weak, named = parent.hints
    hidden = name in ("noscript", "template")
    if name in OUTSIDE or (name == "header" and not inside):
        outside = True
    elif name in INSIDE:
        inside = True
    if raw and not raw.isspace():
        for m in _ATTRIBUTE.finditer(raw):
            if not m[1]:  # the value of another attribute, which may hold markup
                continue
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                outside |= value.lower() in OUTSIDE_ROLES
                inside |= value.lower() in INSIDE_ROLES
            elif key == "style":
                flat = value.replace(" ", "").lower()
                hidden |= "display:none" in flat or "visibility:hidden" in flat
            elif key == "hidden":
                hidden = True
            elif key == "aria-hidden":
                hidden |= value.lower() == "true"
            elif name not in ("html", "body"):
                s, w, content = _name_hints(value)
                strong, weak, named = max(strong, s), max(weak, w), named or content
    if hidden and not (inside or named):  # a hint outside the article, none within
        strong = max(strong, HIDDEN)
    return outside, inside, strong, weak, named


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    root = _Open("", (None, 0), 0, (False, False, 0.0, 0.0, False), False)
    stack, found, number, paragraphs = [root], [], 0, 0
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            holder = stack[-1]
            for item in reversed(stack):
                if item.name in BLOCKS or item is root:
                    holder = item
                    break
            if text:
                found.append(Block(text, min(linked, len(text)), holder.node, holder.depth, holder.name, *holder.hints))
        linked = 0

    def leave(i: int) -> None:
        """Close the open elements from number ``i`` on."""
        nonlocal paragraphs
        paragraphs -= sum(x.name == "p" for x in stack[i:])
        del stack[i:]

    at, end = 0, len(page)
    search = _TAG.search
    while at < end:
        m = search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        top = stack[-1]
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if top.link:
                linked += len(piece.strip())
        at = m.end()
        if m[0] == "<!--":
            close = page.find("-->", at)
            at = end if close < 0 else close + 3
            continue
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:  # an end tag
            if name in BLOCKS:
                flush()
            elif name == "br":
                pieces.append(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    if name in BLOCKS or all(x.name not in BLOCKS for x in stack[i:]):
                        leave(i)
                    break
            continue
        if name in RAW:
            if name in BLOCKS and not (name == "title" and any(x.name == "svg" for x in stack)):  # a drawing's title ends no text
                flush()
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end if close is None else close.end()
            continue
        if name in BLOCKS:
            flush()
            if paragraphs and name not in ("button", "option", "summary"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == "p":
                        leave(i)
                        break
                    if stack[i].name in ("button", "td", "th", "table", "caption"):
                        break
            if name in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in CLOSES[name]:
                        leave(i)
                        if name != "tr":
                            break
                    elif stack[i].name in FENCES[name]:
                        break
        elif name in ("br", "img", "input", "wbr"):
            if name != "wbr":
                pieces.append(" ")
        if name in VOID:
            continue
        parent, number = stack[-1], number + 1
        if (given := m[3] or m[6] or "").endswith("/") and name in ("svg", "math"):
            continue  # these close themselves
        paragraphs += name == "p"
        stack.append(_Open(name, (parent.node, number), parent.depth + 1, _attributes(name, given, parent), parent.link or name == "a"))
    flush()
    return found


# --------------------------------------------------------------------------- the classifier


def features(found: list[Block]) -> list[tuple[float, ...]]:
    n = len(found)
    words = [min(1.0, math.log1p(b.text.count(" ") + 1) / 5) for b in found]
    links = [b.link / len(b.text) for b in found]
    out = []
    for i, b in enumerate(found):
        around = [j for j in (i - 1, i + 1) if 0 <= j < n] or [i]
        stop = float(b.text[-1] in ".!?…。\"'”»")
        out.append((
            1.0, float(b.outside), float(b.inside), b.strong, b.weak, float(b.named), float(b.tag in HEADINGS), float(b.tag in ("p", "blockquote", "pre")), links[i], words[i], stop,
            sum(words[j] for j in around) / len(around), sum(links[j] for j in around) / len(around), abs(2 * i / max(1, n - 1) - 1.0),
        ))
    return out


_OTHER_WORDS = "board history work prices table field result figure report data view quote detail series chapter".split()


def training_page(rng: random.Random) -> str:
    """A page whose texts start with + (content) or - (boilerplate). Some names of content mislead."""
    say = lambda n: " ".join("".join(rng.choice("aeioubdfglmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    sentence = lambda n: say(n).capitalize() + rng.choice("...!?,")
    pick_ = lambda words: rng.choice(sorted(words))
    kind = rng.choice(["elements", "names", "names", "bare"])

    def paragraph() -> str:
        r = rng.random()
        if r < 0.08:
            return f"<h2>+ {say(rng.randrange(1, 8))}</h2>"
        if r < 0.16:
            return "<ul>" + "".join(f"<li>+ {say(rng.randrange(2, 14))}</li>" for _ in range(rng.randrange(1, 5))) + "</ul>"
        text = "+ " + " ".join(sentence(rng.randrange(2, 25)) for _ in range(rng.choice([1, 1, 2, 4])))
        if rng.random() < 0.2:
            text += f" <a>{say(2)}</a> {sentence(5)}"
        part = f"<{tag}>{text}</{tag}>" if (tag := rng.choice(["p", "p", "p", "blockquote", "div"])) else ""
        if rng.random() < 0.12:  # a name that misleads
            name = pick_(WEAK_WORDS) + rng.choice(["", "-" + rng.choice(_OTHER_WORDS), "-" + pick_(NEUTRAL_WORDS)]) if rng.random() < 0.85 else pick_(STRONG_WORDS) + "-" + rng.choice(_OTHER_WORDS)
            part = f'<div class="{name}">{part}</div>'
        return part

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li><a>- {say(rng.randrange(1, 5))}</a></li>" for _ in range(n)) + "</ul>"

    def talk() -> str:
        return "".join(f"<{tag}>- {' '.join(sentence(rng.randrange(2, 16)) for _ in range(rng.choice([1, 1, 2])))}</{tag}>" for tag in [rng.choice(["p", "div"]) for _ in range(rng.choice([1, 1, 2, 4]))])

    def outside(inner: str) -> str:
        if kind == "elements" and rng.random() < 0.7:
            tag = rng.choice(["nav", "aside", "footer", "form", "header"])
            return f"<{tag}>{inner}</{tag}>"
        word = pick_(STRONG_WORDS) if rng.random() < 0.75 else pick_(WEAK_WORDS)
        name = rng.choice([word, f"{pick_(NEUTRAL_WORDS)}-{word}", f"{word}-{pick_(NEUTRAL_WORDS)}", f"{word} {pick_(STRONG_WORDS)}"])
        return f'<div {rng.choice(["class", "id"])}="{name}">{inner}</div>'

    body = [f"<h1>+ {say(rng.randrange(1, 10))}</h1>", *[paragraph() for _ in range(rng.randrange(1, 14))]]
    for _ in range(rng.choice([0, 0, 1, 2])):
        body.insert(rng.randrange(1, len(body) + 1), outside(talk()))
    main = "".join(body)
    wrap = {"elements": "<article>{}</article>", "names": rng.choice(['<div id="content">{}</div>', '<div class="post">{}</div>', "<div>{}</div>"]), "bare": "<div>{}</div>"}[kind]
    parts = [wrap.format(main)]
    for _ in range(rng.randrange(1, 4)):
        parts.insert(0, f"<div>{links(rng.randrange(2, 7))}</div>" if kind == "bare" or rng.random() < 0.2 else outside(rng.choice([links(rng.randrange(2, 7)), talk()])))
    for _ in range(rng.randrange(1, 4)):
        parts.append(f"<div>{links(rng.randrange(1, 7))}</div>" if kind == "bare" or rng.random() < 0.2 else outside(rng.choice([links(rng.randrange(2, 7)), talk()])))
    return "".join(parts)


@cache
def weights(pages: int = 400, ridge: float = 2.0) -> tuple[float, ...]:
    rng, x, y = random.Random(5), [], []
    for _ in range(pages):
        found = blocks(training_page(rng))
        y += [float(b.text.startswith("+")) for b in found]
        for b in found:
            b.text = b.text[2:] or "."
            b.link = max(0, min(b.link - 2, len(b.text)))
        x += features(found)
    a, t = np.array(x), np.array(y)
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - t) + ridge * w)
    return tuple(w.tolist())


# --------------------------------------------------------------------------- the cut

NEAR, KIN = 1.5, 0.8


def _distance(a: Block, b: Block) -> int:
    """Steps between the two elements in the tree."""
    x, y, i, j, steps = a.node, b.node, a.depth, b.depth, 0
    while i > j:
        x, i, steps = x[0], i - 1, steps + 1
    while j > i:
        y, j, steps = y[0], j - 1, steps + 1
    while x is not y and x[1] != y[1]:
        x, y, steps = x[0], y[0], steps + 2
    return steps


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: (block, later block, weight)."""
    out, last = [], {}
    for i, b in enumerate(found):
        parent = b.node[0][1] if b.node[0] else 0
        if i:
            out.append((i - 1, i, NEAR / (1 + _distance(found[i - 1], b))))
        if parent in last:
            out.append((last[parent], i, KIN / (i - last[parent])))
        last[parent] = i
    return out


def minimum_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Of the labelling of least cost, True where a block is content. ``content`` is the cost of
    calling it that; an edge costs its weight where its ends differ."""
    n = len(content)
    gain = [b - c for c, b in zip(content, boilerplate)]  # of calling it content
    tied: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            tied[i][j] = tied[i].get(j, 0.0) + w
            tied[j][i] = tied[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo, sums = deque(range(n)), [sum(t.values()) for t in tied]
    while todo:  # settle what outweighs its ties; its neighbours' costs then hold the tie
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) >= sums[i]:
            label[i] = gain[i] > 0
            for j, w in tied[i].items():
                if label[j] is None:
                    gain[j] += w if label[i] else -w
                    sums[j] -= w
                    todo.append(j)
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        for i, side in zip(open_, _max_flow(open_, gain, tied, label)):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(open_: list[int], gain: list[float], tied: list[dict[int, float]], label: list) -> list[bool]:
    """Which of the open blocks stay with the source (content) in a minimum cut, by Dinic's method."""
    place = {v: k for k, v in enumerate(open_)}
    source, sink = len(open_), len(open_) + 1
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, ab: float, ba: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(ab)
        graph[b].append(len(to))
        to.append(a)
        room.append(ba)

    for k, v in enumerate(open_):
        if gain[v] > 0:
            join(source, k, gain[v], 0.0)
        elif gain[v] < 0:
            join(k, sink, -gain[v], 0.0)
        for u, w in tied[v].items():
            if label[u] is None and place[u] > k:
                join(k, place[u], w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (sink + 1)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(open_))]
        turn = [0] * (sink + 1)
        path: list[int] = []
        a = source
        while True:  # a blocking flow, without recursion
            if a == sink:
                least = min(room[e] for e in path)
                cut = 0
                for i, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if room[e] <= tiny and not cut:
                        cut = i + 1
                a = to[path[cut - 1] ^ 1]
                del path[cut - 1 :]
                continue
            while turn[a] < len(graph[a]):
                e = graph[a][turn[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(graph[a]):
                path.append(graph[a][turn[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1


def costs(found: list[Block], w: Sequence[float]) -> tuple[list[float], list[float]]:
    """Of each block the costs of calling it content, and boilerplate."""
    content, boilerplate = [], []
    for row in features(found):
        z = sum(f * x for f, x in zip(row, w))
        # -log of the logistic function of z and of -z, without overflow
        soft = math.log1p(math.exp(-abs(z)))
        content.append(soft + max(0.0, -z))
        boilerplate.append(soft + max(0.0, z))
    return content, boilerplate


def main_text(page: str | None, w: Sequence[float] | None = None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = minimum_cut(*costs(found, w or weights()), ties(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    rows = pick(pages, page_id=page_id, url=url, html=html).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, w) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(sliced(run), "page_id long, url string, text string, n_chars long")
