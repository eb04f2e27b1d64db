"""Licence scan, in DataFrame operations only.

Lines and headers (paragraphs of several lines) that could reach the threshold are compared with the templates by sparse TF-IDF cosine; idf
comes from all documents. A file whose whole text is close to a template, or that is named like one, is its directory's licence file. Files
without a licence of their own take that of the nearest ancestor directory, by joins of paths.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, doc_id, lower_ascii, materialize, partitions

#: Notices, headers and short licence texts by which files name their licence (fixed values, the licences' own public wording).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "SPDX-License-Identifier: BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    "ISC": (
        "SPDX-License-Identifier: ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.""",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
        "SPDX-License-Identifier: MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    "Proprietary": ("All rights reserved.",),
}
TOKEN = r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(TOKEN), F.lit(0))


def idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def telling(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Terms of which a line has one at least if it reaches the threshold: the others are too light in every template."""
    found = set()
    for v in vectors:
        norm, sum_ = math.sqrt(sum(x * x for x in v.values())), 0.0
        for term, x in sorted(v.items(), key=lambda kv: (kv[1], kv[0])):
            sum_ += x * x
            if math.sqrt(sum_) >= threshold * norm:
                found.add(term)
    return sorted(found)


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])


def _dot(terms: Column, vector: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x["x"] * F.coalesce(F.try_element_at(vector, x["d"]), F.lit(0.0)))


def _best(words: Column, weights: dict[str, float], unknown: float, vectors: list[tuple[str, dict[str, float]]]) -> Column:
    """(score, license) of the closest template."""
    known = _map(weights)
    weight = lambda x: F.coalesce(F.try_element_at(known, x), F.lit(unknown))

    def scored(w: Column) -> Column:
        terms = F.transform(F.array_distinct(w), lambda d: F.struct(d.alias("d"), (F.size(F.filter(w, lambda y: y == d)) * weight(d)).alias("x")))

        def against(t: Column) -> Column:
            norm = F.sqrt(F.aggregate(t, F.lit(0.0), lambda a, x: a + x["x"] * x["x"]))
            out = []
            for name, v in vectors:
                size = math.sqrt(sum(x * x for x in v.values()))
                m = _map({k: x / size for k, x in v.items()})
                dot = _dot(t, m)
                out.append(F.struct(F.round(F.coalesce(dot / F.when(norm > 0, norm), F.lit(0.0)), 6).alias("score"), F.lit(name).alias("license")))
            return F.array_max(F.array(*out))

        return F.element_at(F.transform(F.array(terms), against), 1)

    return F.element_at(F.transform(F.array(words), scored), 1)


def _best_whole(words: Column, weights: dict[str, float], unknown: float, vectors: list[tuple[str, dict[str, float]]]) -> Column:
    """As _best(), for texts of any length: the norm is one pass over the sorted words, a product one over those that templates hold."""
    known = _map(weights)
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["word"] == x, a["run"]).otherwise(F.lit(0))
        return F.struct(x.alias("word"), (run + 1).alias("run"), (a["sum"] + (2 * run + 1) * F.pow(F.coalesce(F.try_element_at(known, x), F.lit(unknown)), F.lit(2.0))).alias("sum"))

    def parts(w: Column) -> Column:
        norm = F.sqrt(F.aggregate(F.sort_array(w), start, step, lambda a: a["sum"]))
        return F.struct(norm.alias("norm"), F.filter(w, lambda x: F.array_contains(F.array(*[F.lit(k) for k in sorted(weights)]), x)).alias("held"))

    def against(t: Column) -> Column:
        out = []
        for name, v in vectors:
            size = math.sqrt(sum(x * x for x in v.values()))
            m = _map({k: x * weights[k] / size for k, x in v.items()})
            dot = F.aggregate(t["held"], F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(m, x), F.lit(0.0)))
            out.append(F.struct(F.round(F.coalesce(dot / F.when(t["norm"] > 0, t["norm"]), F.lit(0.0)), 6).alias("score"), F.lit(name).alias("license")))
        return F.array_max(F.array(*out))

    return F.element_at(F.transform(F.transform(F.array(words), parts), against), 1)


def license_scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, path, license, score, n_lines, is_license_file, effective_license, inherited_from) per row of files.

    license: of the best line or header with a cosine of threshold or more, else null (n_lines counts the lines); effective_license: that, or the one of the nearest ancestor
    directory with a licence file (inherited_from). The first of several licence files of a directory by score, then by name, counts.
    Null texts have no lines; null paths have no directory and inherit nothing; null ids stay null; repeated rows give equal rows; other
    columns are ignored; an empty table gives no rows; texts of any length are compared whole. Of templates that tie, the licence whose name
    is last counts. What is broadcast is the templates' terms and, for directories with many rows, 2 * partitions rows at most.
    """
    templates = TEMPLATES if templates is None else templates
    rows = files.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), path.cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = [(name, tokens(t)) for name, ts in sorted(templates.items()) for t in ts]
    vocabulary = sorted({w for _, ws in split for w in ws})
    held = F.array_intersect(_tokens(F.col("text")), F.array(*[F.lit(w) for w in vocabulary]))
    counted = rows.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    df = {r["term"]: r["n"] for r in counted}
    n = df.pop("", 0)
    weights = {w: idf(n, df.get(w, 0)) for w in vocabulary}
    vectors = [(name, {w: ws.count(w) * weights[w] for w in ws}) for name, ws in split]
    sure = telling([v for _, v in vectors], threshold)
    pattern = r"(?i)(^|[^a-z0-9.\-])(" + "|".join(re.escape(w) for w in sure) + r")($|[^a-z0-9])"
    unknown = idf(n, 0)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(pattern))
    best = F.filter(F.transform(lines, lambda x: _best(_tokens(x), weights, unknown, vectors)), lambda x: x["score"] >= threshold)
    headers = F.filter(F.split("text", r"\n[\x20\x09\x0B-\x0D]*\n"), lambda x: x.contains("\n") & x.rlike(pattern))
    above = F.filter(F.transform(headers, lambda x: _best_whole(_tokens(x), weights, unknown, vectors)), lambda x: x["score"] >= threshold)
    empty = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("license"))
    none = F.array().cast("array<struct<score:double,license:string>>")
    # One test of the whole text spares the others' work where no template can match.
    held = F.when(F.col("text").rlike(pattern), F.struct(best.alias("lines"), above.alias("headers"), _best_whole(_tokens(F.col("text")), weights, unknown, vectors).alias("whole")))
    scanned = rows.select("id", "path", held.alias("held")).select("id", "path", F.coalesce("held.lines", none).alias("found"), F.coalesce("held.headers", none).alias("headers"), F.coalesce("held.whole", empty).alias("whole"))
    top = F.array_max(F.concat("found", "headers"))
    is_file = top.isNotNull() & ((F.col("whole.score") >= threshold) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)))
    scanned = scanned.select("id", "path", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))).alias("dir"), top["license"].alias("license"), top["score"].alias("score"), F.size("found").alias("n_lines"), is_file.alias("is_license_file"))
    scanned = materialize(scanned, "licences")  # without the texts
    # The first licence file of each directory, and for each directory its nearest ancestor that has one.
    owned = scanned.where("is_license_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("f")).select(F.col("dir").alias("above"), F.col("f.license").alias("inherited"))
    parts = F.split("dir", "/")
    dirs = materialize(scanned.where("dir is not null").groupBy("dir").agg(F.count("*").alias("n")), "directories")
    ancestors = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("above")).distinct()
    nearest = ancestors.join(owned, "above").groupBy("dir").agg(F.max_by(F.struct("inherited", "above"), F.length("above")).alias("up"))
    # Directories with more than a half of a partition's share of the rows, 2 * partitions at most, are joined where their rows are.
    share = 2 * partitions(files.sparkSession)
    hot = [r["dir"] for r in dirs.where(F.col("n") * share > n).select("dir").collect()] if n > 10_000 else []
    is_hot = F.coalesce(F.col("dir").isin(hot), F.lit(False)) if hot else F.lit(False)
    out = scanned.where(~is_hot).join(nearest.where(~is_hot), "dir", "left")
    if hot:
        out = out.unionByName(scanned.where(is_hot).join(F.broadcast(nearest.where(is_hot)), "dir", "left"))
    inherits = F.col("license").isNull() & F.col("up").isNotNull()
    return out.select(doc_id().alias("doc_id"), "path", "license", "score", "n_lines", "is_license_file", F.coalesce("license", F.col("up.inherited")).alias("effective_license"), F.when(inherits, F.col("up.above")).alias("inherited_from"))
