"""Where a passage stands in a text: exactly, without white space, or by likeness."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Windows compared at most at full resolution; longer texts are stepped through, then refined.
FULL = 10_000


def threshold(needle: str) -> float:
    return 0.85 if len(needle) < 50 else 0.75 if len(needle) < 150 else 0.65


def _squeezed(text: str) -> tuple[str, list[int]]:
    """Lower case without white space, and each character's place in the text."""
    places = [i for i, c in enumerate(text) if not c.isspace()]
    return "".join(text[i].lower()[:1] for i in places), places


def _likeness(a: str, b: str, floor: float) -> float:
    m = SequenceMatcher(None, a, b, autojunk=False)
    if m.real_quick_ratio() < floor or m.quick_ratio() < floor:
        return 0.0
    return m.ratio()


def locate(needle: str | None, hay: str | None) -> tuple[int, int, float, str] | None:
    """(start, end, ratio, strategy), or None if nothing is alike enough."""
    if not needle or not needle.strip() or not hay:
        return None
    at = hay.find(needle)
    if at >= 0:
        return at, at + len(needle), 1.0, "exact"
    short, _ = _squeezed(needle)
    long, places = _squeezed(hay)
    at = long.find(short)
    if at >= 0:
        return places[at], places[at + len(short) - 1] + 1, 1.0, "squeezed"
    n, least = len(short), threshold(needle)
    if len(long) <= n:
        ratio = _likeness(short, long, least)
        return (places[0], places[-1] + 1, round(ratio, 6), "fuzzy") if ratio >= least else None
    step = 1 if len(long) < FULL // max(1, n // 40) else max(1, n // 8)
    best, where = 0.0, -1
    for i in range(0, len(long) - n + 1, step):
        r = _likeness(short, long[i : i + n], max(least * 0.8, best))
        if r > best:
            best, where = r, i
    if where >= 0 and step > 1:
        for i in range(max(0, where - step), min(len(long) - n, where + step) + 1):
            r = _likeness(short, long[i : i + n], best)
            if r > best:
                best, where = r, i
    return (places[where], places[where + n - 1] + 1, round(best, 6), "fuzzy") if best >= least else None


# --------------------------------------------------------------------------- pages

#: Passages longer than this are found by their ends; an end is so long, and is alike from this ratio on.
LONG, ANCHOR, MORE, ALIKE = 100, 40, 15, 0.75
REACH = 2


def ends(text: str) -> tuple[str, str] | None:
    """The first and the last words of a text, some ANCHOR characters each; None if it is too short for both."""
    text = text.strip()
    if len(text) < 2 * ANCHOR:
        return None
    right, left = text.find(" ", ANCHOR), text.rfind(" ", 0, len(text) - ANCHOR)
    first = text[:right] if 0 < right < ANCHOR + MORE else text[:ANCHOR]
    last = text[left + 1 :] if left >= 0 and len(text) - ANCHOR - left < MORE else text[-ANCHOR:]
    return first.strip(), last.strip()


def _place(short: str, long: str, begin: int) -> tuple[int, float] | None:
    """Where ``short`` stands in ``long`` from ``begin`` on, exactly or alike."""
    at = long.find(short, begin)
    if at >= 0:
        return at, 1.0
    n, best, where = len(short), ALIKE, -1
    for i in range(begin, len(long) - n + 1):
        r = _likeness(short, long[i : i + n], best)
        if r >= best and (where < 0 or r > best):
            best, where = r, i
    return (where, best) if where >= 0 else None


def by_ends(needle: str, hay: str) -> tuple[int, int, float, str] | None:
    """A long passage by its two ends; where only the first is found, the other is put by the passage's length."""
    both = ends(needle)
    if both is None or not hay:
        return None
    (first, _), (last, _), (whole, _) = _squeezed(both[0]), _squeezed(both[1]), _squeezed(needle)
    long, places = _squeezed(hay)
    start = _place(first, long, 0)
    if start is None:
        return None
    end = _place(last, long, start[0] + 1)
    stop = end[0] + len(last) if end else min(len(long), start[0] + len(whole))
    ratio = min(start[1], end[1]) if end else start[1]
    return places[start[0]], places[stop - 1] + 1, round(ratio, 6), "ends" if end else "start"


def locate_in_pages(needle: str | None, pages: list[str | None], target: int) -> tuple[int, int, int, float, str] | None:
    """(page from 1, start, end, ratio, strategy): the page looked for, then its neighbours, the nearer first; on each a
    long passage by its ends, then any exactly or by likeness."""
    if not needle or not needle.strip():
        return None
    order = [target, *[target + sign * d for d in range(1, REACH + 1) for sign in (-1, 1)]]
    for page in (p for p in order if 1 <= p <= len(pages)):
        hay = pages[page - 1]
        found = (by_ends(needle, hay) if hay and len(needle) > LONG else None) or locate(needle, hay)
        if found:
            return (page, *found)
    return None


def _in_pages(needles: pd.Series, pages: pd.Series, targets: pd.Series) -> pd.DataFrame:
    found = [locate_in_pages(n, [] if p is None else list(p), int(t)) or (None,) * 5 for n, p, t in zip(needles, pages, targets)]
    return pd.DataFrame(found, columns=["page", "start", "end", "ratio", "strategy"]).astype({"page": "Int64", "start": "Int64", "end": "Int64"})


def located_in_pages(needle: Column, pages: Column, target: Column) -> Column:
    return F.pandas_udf(_in_pages, "page long, start long, end long, ratio double, strategy string")(needle, pages, target)


def _located(needles: pd.Series, hays: pd.Series) -> pd.DataFrame:
    found = [locate(a, b) or (None, None, None, None) for a, b in zip(needles, hays)]
    return pd.DataFrame(found, columns=["start", "end", "ratio", "strategy"]).astype({"start": "Int64", "end": "Int64"})


def located(needle: Column, hay: Column) -> Column:
    return F.pandas_udf(_located, "start long, end long, ratio double, strategy string")(needle, hay)
