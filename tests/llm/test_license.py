"""Licence scan: the trained classifier, a plain scorer, and lines that look like licences."""

import math
import re
import textwrap

from folioforge.llm import license as L

SCHEMA = "doc_id long, text string, family string, paragraph int"


def _plain(text):
    """The same scoring, line by line."""
    m, out = L.model(), []
    index = {g: i for i, g in enumerate(m.features)}
    known = {}
    for f, g in L.template_bigrams():
        known.setdefault(f, set()).add(g)
    for place, line in enumerate((text or "").split("\n")):
        grams = L.grams(line)
        at = [index[g] for g in grams if g in index]
        z = m.weights[at].sum(0) + m.bias
        k = int(z.argmax())
        p = 1 / sum(math.exp((x - z[k]) / m.temperature) for x in z)
        pairs = [g for g in grams if " " in g]
        family = m.families[k]
        similar = sum(g in known.get(family, ()) for g in pairs) / max(1, len(pairs))
        if family != L.UNKNOWN and round(p, 6) >= m.least and round(similar, 6) >= L.CONFIRM:
            out.append((place, family, round(p, 6), round(similar, 6)))
    return out


def _scan(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    return sorted((str(r.doc_id), r.paragraph, r.family, r.probability, r.similarity) for r in L.scan(docs).collect())


def test_held_out_variations_are_named():
    assert L.model().accuracy >= 0.88


def test_matches_the_plain_scorer(spark):
    texts = [t for family in L.TEMPLATES.values() for t in family] + list(L.PLAIN)
    rows = [(i, f"Some line.\n{t}\nLast line.") for i, t in enumerate(texts)] + [(900, "\n".join(texts))]
    want = sorted((str(i), p, f, s, r) for i, t in rows for p, f, s, r in _plain(t))
    got = _scan(spark, rows)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 2e-6 and abs(a[4] - b[4]) < 2e-6 for a, b in zip(got, want))


def test_templates_found_and_plain_lines_left_alone(spark):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "Licensed under the Apache License, Version 2.0."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), *[(100 + i, t) for i, t in enumerate(L.PLAIN)]]
    assert [(a, b, c) for a, b, c, *_ in _scan(spark, rows)] == [("1", 1, "mit"), ("2", 0, "apache"), ("3", 0, "gpl"), ("4", 0, "cc-by-nc")]


def test_edges(spark):
    assert _scan(spark, []) == []
    line = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, line), (3, line), (None, line.upper()), (4, "word " * 50_000), (5, f"{line}\n" * 30)]
    got = _scan(spark, rows)
    assert [x[0] for x in got].count("3") == 2 and [x[0] for x in got].count("None") == 1 and [x[0] for x in got].count("5") == 30


def test_the_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = L.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_every_line_is_scored(spark):
    line = "this list of conditions and the following disclaimer in the documentation"
    texts = [t for family in L.TEMPLATES.values() for t in family]
    rows = [(i, textwrap.fill(t, width)) for width in (30, 50, 72) for i, t in enumerate(texts, 1000 * width)] + [(1, f"x\n{line}\ny")]
    want = sorted((str(i), p, f, s, r) for i, t in rows for p, f, s, r in _plain(t))
    got = _scan(spark, rows)
    assert ("1", 1, "bsd") in [x[:3] for x in got]
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 2e-6 and abs(a[4] - b[4]) < 2e-6 for a, b in zip(got, want))
