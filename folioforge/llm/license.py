"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A sparse logistic regression over word unigrams and bigrams names a licence family or ``unknown``. It
is trained here on the templates below and on variations of them (words dropped, names and years
filled in), with plain sentences as the unknown class; variations that training never sees set the
softmax's temperature and the least probability that a prediction needs. A prediction stands only if
enough of the paragraph's bigrams occur in the family's templates.

The scan is native: paragraphs (lines) are split, turned into n-grams, filtered, joined with the table
of weights and summed by DataFrame functions alone. Every paragraph's bigrams are compared with those of
all templates together; one that could not be confirmed for any family, whatever the classifier says, is
left out before the sums, so nothing is lost by it. The tables of weights and of template bigrams are
broadcast: their size is fixed by the templates.

Wordings that no template holds are seldom found: with one template left out of training and comparison,
24 of 56 are still named and 11 confirmed (the README has the figures).

Defined cases: null or empty text has no paragraphs; repeated rows report each; equal probabilities go
to the first family by name; very long lines are read whole; no rows give no
rows; extra columns are not read.
"""

from __future__ import annotations

import json
import random
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

UNKNOWN = "unknown"
#: The least share of a paragraph's bigrams that its family's templates must hold.
CONFIRM = 0.6
WORDS = r"[\p{L}\p{N}]+"

# Notices and characteristic passages of public licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Released under the GNU AGPL v3.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD License. Use of this source code is governed by a BSD-style license.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-nc-nd": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Creative Commons CC0 1.0 Universal public domain dedication.",
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL v3. GPL-2.0-only",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the GNU LGPL v3.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
}
#: Sentences of the unknown class, some of them near to licences in words.
PLAIN = (
    "He lost his driving licence after the accident and had to walk to work.",
    "The restaurant was licensed to serve alcohol until midnight.",
    "Her fishing license expired at the end of the year.",
    "The software engineer wrote a program that copies files from one disk to another.",
    "All rights reserved.",
    "The general was known to the public as a man of few words.",
    "A free lunch was offered to any person who came to the opening of the library.",
    "The first version of the report was published in 2004 and the second in 2010.",
    "Under the terms of the agreement, the work had to be finished by the summer.",
    "The institute of technology in Massachusetts was founded long ago.",
    "They use the source of the river to obtain water for the common lands.",
    "The apache helicopter landed near the creek without any warning.",
    "The commons debated the attribution of the paintings for an hour.",
    "You may not enter this room except with a ticket.",
    "The warranty on the car covers parts for three years.",
    "This is a work of fiction. Names and places are invented.",
    "Permission was granted to build a house on the hill.",
    "The conditions on the mountain were worse than expected.",
    "It is not known who holds the copyright in the song.",
    "The license fee for television is paid every year.",
    "The foundation gave its name to the new wing of the museum.",
    "See the notice on the door for the hours of opening.",
    "The merchants of the city met to modify the law.",
    "It was distributed in the hope that people would read it.",
)
_FILL = ("Copyright (c) 2019 Jane Doe.", "2021", "The project", "Note:", "Contributors", "v1.2", "Acme Inc.")


def grams(text: str) -> list[str]:
    """The distinct unigrams and bigrams of a paragraph, lower-cased."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))


def _variations(text: str, rng: random.Random, n: int, licence: bool) -> list[str]:
    out = [text]
    words = text.split()
    for _ in range(n):
        kept = [w for w in words if rng.random() > 0.12] or words
        if rng.random() < 0.4:
            kept = [rng.choice(_FILL), *kept]
        if licence and len(kept) > 24 and rng.random() < 0.5:  # part of a passage, as line breaks leave it
            at = rng.randrange(len(kept) - 14)
            kept = kept[at : at + 14]
        out.append(" ".join(kept))
    return out


class Model:
    """families (the last is unknown), features, weights (features x families), bias, temperature, least probability."""

    def __init__(self) -> None:
        rng = random.Random(5)
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        rows: list[tuple[str, int, bool]] = []
        for k, family in enumerate(self.families):
            for text in TEMPLATES.get(family, PLAIN):
                for i, v in enumerate(_variations(text, rng, 12 if family != UNKNOWN else 8, family != UNKNOWN)):
                    rows.append((v, k, i % 4 == 3))
        vocabulary = sorted({g for v, _, held in rows if not held for g in grams(v)})
        self.features = vocabulary
        index = {g: i for i, g in enumerate(vocabulary)}

        def bags(held: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Places of the features of all rows in a row, where rows start, and their classes."""
            chosen = [([index[g] for g in grams(v) if g in index], k) for v, k, h in rows if h == held]
            chosen = [(b, k) for b, k in chosen if b]
            sizes = np.array([len(b) for b, _ in chosen])
            return np.array([i for b, _ in chosen for i in b]), np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.array([k for _, k in chosen])

        flat, starts, y = bags(False)
        sizes = np.diff(np.append(starts, len(flat)))
        row_of = np.repeat(np.arange(len(y)), sizes)
        by_feature = np.argsort(flat, kind="stable")
        used, first = np.unique(flat[by_feature], return_index=True)
        w, b = np.zeros((len(vocabulary), len(self.families))), np.zeros(len(self.families))
        b[-1] = 1.0  # what matches nothing is unknown
        scale = 1.0 / np.sqrt(sizes)[:, None]
        share = len(y) / (len(self.families) * np.bincount(y, minlength=len(self.families)))
        for _ in range(400):
            z = np.add.reduceat(w[flat], starts, axis=0) + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= share[y][:, None] * scale
            w *= 1 - 8e-5
            w[used] -= 4.0 / len(y) * np.add.reduceat(p[row_of[by_feature]], first, axis=0)
            b[:-1] -= 0.2 * p[:, :-1].mean(0)
        self.weights, self.bias = np.round(w, 6), np.round(b, 6)
        flat, starts, truth = bags(True)
        z = np.add.reduceat(self.weights[flat], starts, axis=0) + self.bias

        def proba(t: float) -> np.ndarray:
            s = np.exp((z - z.max(1, keepdims=True)) / t)
            return s / s.sum(1, keepdims=True)

        self.temperature = min((2.0 ** (k / 4) for k in range(-8, 13)), key=lambda t: -np.log(np.maximum(proba(t)[np.arange(len(truth)), truth], 1e-300)).mean())
        p = proba(self.temperature)
        self.accuracy = float((p.argmax(1) == truth).mean())
        right = p[np.arange(len(truth)), truth][(p.argmax(1) == truth) & (truth < len(self.families) - 1)]
        self.least = float(round(min(0.5, np.quantile(right, 0.01) * 0.9), 6))


@cache
def model() -> Model:
    return Model()


def template_bigrams() -> list[tuple[str, str]]:
    return sorted({(family, g) for family, texts in TEMPLATES.items() for t in texts for g in grams(t) if " " in g})


def _literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from a literal, without leaving the JVM."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, paragraph (its place among the text's lines, from 0), family, probability, similarity
    of each paragraph that the classifier names and the templates confirm."""
    spark, m = docs.sparkSession, model()
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    words = F.regexp_extract_all(F.lower("line"), F.lit(WORDS), F.lit(0))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    lines = lines.withColumn("w", words).withColumn("bi", F.array_distinct(pairs))
    # A family's bigrams are among those of all, so what all hold less of than CONFIRM (less a hundredth, for rounding) is never confirmed.
    in_any, least = sorted({g for _, g in template_bigrams()}), round(100 * CONFIRM) - 1
    lines = lines.filter(F.aggregate("bi", F.lit(0), lambda s, g: s + F.when(g.isin(in_any), 100 - least).otherwise(-least)) > 0)
    lines = lines.withColumn("g", F.concat(F.array_distinct("w"), F.col("bi")))
    weights = _literal(spark, [{"g": g, "w": row} for g, row in zip(m.features, m.weights.tolist())], "g: string, w: array<double>")
    known = _literal(spark, [{"f": f, "g": g} for f, g in template_bigrams()], "f: string, g: string")
    known = known.groupBy("g").agg(F.collect_set("f").alias("held_by"))
    # One pass over the n-grams: weights and template families side by side, summed by paragraph and family.
    table = weights.join(known, "g", "full_outer")
    each = lines.select("doc_id", "row", "paragraph", F.size("bi").alias("n_bi"), F.explode("g").alias("g")).join(F.broadcast(table), "g")
    sums = [F.sum(F.get("w", k)).alias(f"z{k}") for k in range(len(m.families))]
    held = [F.sum(F.array_contains("held_by", f).cast("int")).alias(f"h{k}") for k, f in enumerate(m.families[:-1])]
    # A paragraph's n-grams lie in one task, so its sums are whole before the shuffle: one row a paragraph moves.
    summed = each.groupBy("row", "paragraph").agg(F.first("doc_id").alias("doc_id"), F.first("n_bi").alias("n_bi"), *sums, *held)
    z = F.array(*[F.coalesce(f"z{k}", F.lit(0.0)) + F.lit(b) for k, b in enumerate(m.bias.tolist())])
    h = F.array(*[F.coalesce(f"h{k}", F.lit(0)) for k in range(len(m.families) - 1)], F.lit(0))
    judged = summed.select("doc_id", "paragraph", "n_bi", z.alias("z"), h.alias("h")).withColumn("top", F.array_max("z")).withColumn("best", F.array_position("z", F.col("top")).cast("int"))
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp((x - F.col("top")) / F.lit(m.temperature)))
    out = judged.select(
        "doc_id",
        F.col("paragraph").cast("long").alias("paragraph"),
        F.element_at(F.array(*[F.lit(f) for f in m.families]), F.col("best")).alias("family"),
        F.round(1 / total, 6).alias("probability"),
        F.round(F.element_at("h", F.col("best")) / F.greatest(F.col("n_bi"), F.lit(1)), 6).alias("similarity"),
    )
    return out.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= m.least) & (F.col("similarity") >= CONFIRM))


def scan_sql(table: str = "documents") -> str:
    """The same scoring as SQL for DuckDB, with the trained weights as values."""
    m = model()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    weights = ",\n".join("(" + ",".join([q(g), *[repr(v) for v in row]]) + ")" for g, row in zip(m.features, m.weights.tolist()))
    known = ",\n".join(f"({q(f)},{q(g)})" for f, g in template_bigrams())
    names = [f"z{k}" for k in range(len(m.families))]
    sums = ", ".join(f"coalesce(sum({n}), 0) + {b!r} as {n}" for n, b in zip(names, m.bias.tolist()))
    unpivot = " union all ".join(f"select doc_id, row, paragraph, n_bi, {k} as k, {q(f)} as family, z{k} as z from s" for k, f in enumerate(m.families))
    return f"""
with weights(g, {", ".join(names)}) as (values {weights}),
known(f, g) as (values {known}),
d as (select doc_id, row_number() over () as row, string_split(text, chr(10)) as ls from {table}),
l as (select doc_id, row, unnest(range(len(ls)))::bigint as paragraph, unnest(ls) as line from d),
w as (select doc_id, row, paragraph, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+') as w from l),
b as (select *, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as bi from w),
e as (select doc_id, row, paragraph, len(bi) as n_bi, unnest(list_concat(list_distinct(w), bi)) as g from b),
s as (select doc_id, row, paragraph, n_bi, {sums} from e left join weights using (g) group by all),
u as ({unpivot}),
p as (select *, exp((z - max(z) over (partition by row, paragraph)) / {m.temperature!r}) as x from u),
r as (select *, x / sum(x) over (partition by row, paragraph) as pr, row_number() over (partition by row, paragraph order by x desc, k) as n from p),
h as (select e.row, e.paragraph, k.f, count(*) as held from e join known k on e.g = k.g group by all)
select r.doc_id, r.paragraph, r.family, round(r.pr, 6) as probability, round(coalesce(h.held, 0) / greatest(r.n_bi, 1), 6) as similarity
from r left join h on r.row = h.row and r.paragraph = h.paragraph and r.family = h.f
where r.n = 1 and r.family <> '{UNKNOWN}' and round(r.pr, 6) >= {m.least!r} and round(coalesce(h.held, 0) / greatest(r.n_bi, 1), 6) >= {CONFIRM}"""
