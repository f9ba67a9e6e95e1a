"""Licence scan: text units against licence templates by Dice over word bigrams. DataFrame functions throughout."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual short notices of public licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the 2-Clause BSD License.",
    "BSD-3-Clause": "Released under the 3-Clause BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files, to deal in the Software without restriction, including without "
                "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
                "to the following conditions: The above copyright notice and this permission notice shall be "
                "included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def normal_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def template_bigrams(text: str) -> list[str]:
    w = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def size_bounds(n: int, dice: float) -> tuple[int, int]:
    """Sizes of a bigram set that can reach ``dice`` against a set of ``n``: 2 min(n, m) >= dice (n + m)."""
    lo, hi = dice * n / (2 - dice), n * (2 - dice) / dice
    return max(1, math.ceil(lo - 1e-9)), math.floor(hi + 1e-9)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, str] = TEMPLATES, dice: float = 0.8) -> DataFrame:
    """One row per input row: id, n_lines, n_candidates, licence, dice, line_no, n_hits.

    Units are the lines of the text (split at \\n) and the whole text (line_no -1). A unit is
    lower-cased, cut into words of [a-z0-9] and turned into its set of word bigrams; its
    Dice coefficient 2 |A and B| / (|A| + |B|) is taken with each template whose size makes
    ``dice`` reachable (n_candidates counts those pairs). ``licence`` is the template of the
    highest coefficient of at least ``dice`` over all units, then the smallest line_no, then
    the template name; n_hits counts the units that reach it. Without a hit: licence, dice
    and line_no null. Null or empty text: one empty line, no hit. Repeated rows give repeated
    results. Other columns are ignored; an empty table gives an empty one.

    The templates are a parameter and stand in the plan as literals, so no join happens. The
    word count bounds the set size from above, so units that are too short never build their
    bigrams, and units too long for every template are cut by a floor on their distinct
    words. The only shuffle is one combined row per document.
    """
    grams = {k: template_bigrams(v) for k, v in sorted(templates.items())}
    bounds = {k: size_bounds(len(g), dice) for k, g in grams.items()}
    least = min((lo for lo, _ in bounds.values()), default=1)
    most = max((hi for _, hi in bounds.values()), default=0)

    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    one = F.array(F.struct(F.lit(-1).alias("no"), text.alias("unit")))
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("no"), x.alias("unit")))
    units = (docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
                         F.size(lines).alias("n_lines"), F.concat(one, numbered).alias("units"))
             .select("rid", "id", "n_lines", F.explode("units").alias("u"))
             .select("rid", "id", "n_lines", "u.no", "u.unit"))

    def words(c: Column) -> Column:
        return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")

    # only units that can hold between `least` and `most` different bigrams are cut into them:
    # w words give w - 1 bigrams, and a set of m bigrams has at most m + 1 different words
    w = F.col("w")
    units = units.withColumn("w", words(F.col("unit"))).drop("unit")
    in_reach = (F.size(w) > least) & (F.size(F.array_distinct(w)) <= most + 1)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(
        " ", F.get(w, i - 1), F.get(w, i))))
    units = units.withColumn("b", F.when(in_reach, pairs)).drop("w").withColumn("n", F.coalesce(F.size("b"), F.lit(-1)))

    best, candidates = [], F.lit(0)
    for name, g in grams.items():
        lo, hi = bounds[name]
        fits = F.col("n").between(lo, hi)
        d = 2.0 * F.size(F.array_intersect("b", F.array(*[F.lit(x) for x in g]))) / (F.col("n") + len(g))
        candidates = candidates + F.when(fits, 1).otherwise(0)
        # smallest struct = highest coefficient, then line, then name
        best.append(F.when(fits & (d >= dice), F.struct((-d).alias("d"), F.col("no"), F.lit(name).alias("name"))))
    hit = F.least(*best) if len(best) > 1 else best[0] if best else F.lit(None).cast("struct<d:double,no:int,name:string>")
    scored = units.select("rid", "id", "n_lines", candidates.cast("bigint").alias("c"), hit.alias("hit"))
    per_doc = scored.groupBy("rid").agg(F.first("id").alias("id"), F.first("n_lines").cast("bigint").alias("n_lines"),
                                        F.sum("c").alias("n_candidates"), F.min("hit").alias("hit"),
                                        F.count("hit").alias("n_hits"))
    return per_doc.select("id", "n_lines", "n_candidates", F.col("hit.name").alias("licence"),
                          (-F.col("hit.d")).alias("dice"), F.col("hit.no").alias("line_no"), "n_hits")
