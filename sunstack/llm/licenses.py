"""License scans [native]: sparse TF-IDF cosine to licence templates, inherited by directory.

A text's lines (in markup, block tags end a line and other tags are blanks, so a wrapped
header is one line) are read in windows, each a bag of terms: runs of ASCII letters and
digits, lower-cased. A term of a template sentence weighs tf * idf, with tf its count in the
window or sentence and idf = ln((1 + N) / (1 + df)) + 1 over all texts; any other word weighs
``OTHER``, whatever N is. A line's licence is that of the sentence and window of the highest
cosine of at least ``threshold``; a text's licence is that of its best line (ties: the first name).

A window that reaches the threshold holds an anchor, one of the heaviest terms: a vector
of the others alone can't have that cosine. Windows are laid around the
anchors: of the sentence's length with the anchor where the sentence has it, and of twice
that length, so words before, between and after don't hide a sentence. A window needs
``LEAST_TERMS`` terms of the sentence and all those that another licence with a like
sentence never has (the version, the identifier).

Passes. One reads all texts and keeps the template terms in each, which gives df and an
exact bound: a text whose terms of a sentence are too light is done. Only lines of the
texts left are taken apart. Rows are numbered in the table that this pass writes, so rows
of equal id and path are judged apart.

A path declares a licence for its directory if it is a licence file (LICENSE, COPYING
...) or the directory's own page (ends in "/"). A text without a licence inherits that
of the nearest directory above it that declares one: the distinct directories, not the
texts, are expanded to their ancestors and joined, over ``SALTS`` parts of each key, as one
host may hold a third of all texts.

Cases: null text or html has no lines, a null path no directory, so nothing to inherit;
several declarations of one directory: the best score, then the first name; repeated
rows are judged alike; an empty table gives an empty result; a very long text is one row of
its own terms at most. Only id, path and text are read, so other columns never clash.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

THRESHOLD, OTHER, LEAST_TERMS, SALTS = 0.6, 2.0, 3, 8
SPLIT = "[^a-z0-9]+"
LICENCE_FILE = r"^(licen[cs]e|copying|copyright|unlicense)([.-].*)?$"

# Licence names and the sentences of their texts and headers.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Licensed under the Zero-Clause BSD License.",
             "SPDX-License-Identifier: 0BSD"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License Version 3",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
                 "Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
                   'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
                   "CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0"),
    "Artistic-2.0": ("This is free software, licensed under the Artistic License 2.0.", "The Artistic License 2.0", "SPDX-License-Identifier: Artistic-2.0"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "Licensed under the Simplified BSD License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
                     "specific prior written permission.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0", "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                     "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
                        "SPDX-License-Identifier: CC-BY-NC-ND-4.0"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
                        "SPDX-License-Identifier: CC-BY-NC-SA-4.0"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
                     "SPDX-License-Identifier: CC-BY-ND-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                     "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "CC0 1.0 Universal Public Domain Dedication",
                "SPDX-License-Identifier: CC0-1.0"),
    "CDDL-1.0": ("The contents of this file are subject to the terms of the Common Development and Distribution License.", "Common Development and Distribution License Version 1.0",
                 "SPDX-License-Identifier: CDDL-1.0"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Eclipse Public License - v 2.0",
                "SPDX-License-Identifier: EPL-2.0"),
    "EUPL-1.2": ("Licensed under the European Union Public Licence, Version 1.2.", "Licensed under the EUPL, Version 1.2 or later.", "SPDX-License-Identifier: EUPL-1.2"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU General Public License Version 2",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU General Public License Version 3",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0"),
    "ISC": ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
            "this permission notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU Lesser General Public License Version 2.1",
                 "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
                 "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-2.1"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License Version 3",
                 "SPDX-License-Identifier: LGPL-3.0"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
            "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "MS-PL": ("Licensed under the Microsoft Public License (Ms-PL).", "SPDX-License-Identifier: MS-PL"),
    "NCSA": ("Licensed under the University of Illinois/NCSA Open Source License.", "SPDX-License-Identifier: NCSA"),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"),
    "PostgreSQL": ("Released under the PostgreSQL License.", "SPDX-License-Identifier: PostgreSQL"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "WTFPL": ("Do What The Fuck You Want To Public License", "SPDX-License-Identifier: WTFPL"),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
             "software.", "Licensed under the zlib License.", "SPDX-License-Identifier: Zlib"),
}


BLOCK_TAGS = ("address|article|aside|blockquote|body|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|"
              "legend|li|main|menu|nav|ol|option|p|pre|script|section|select|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul")  # fmt: skip


def terms(line: Column) -> Column:
    """Terms of a line in order: lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(line), SPLIT), "")


def book() -> list[tuple[str, list[str]]]:
    """Licence and terms of every template sentence."""
    return [(name, re.findall("[a-z0-9]+", s.lower())) for name, all_ in TEMPLATES.items() for s in all_]


def weigh(sentences: list[tuple[str, list[str]]], idf: dict[str, float], threshold: float) -> list[dict]:
    """Norm, term weights, anchors with their places, and needed terms of every sentence."""
    bags = [Counter(own) for _, own in sentences]
    square = [{t: (n * idf[t]) ** 2 for t, n in bag.items()} for bag in bags]
    norms = [math.sqrt(sum(sorted(sq.values()))) for sq in square]
    said, out = defaultdict(set), []
    for name, own in sentences:
        said[name] |= set(own)
    for i, (name, own) in enumerate(sentences):
        anchors, light = set(), 0.0
        for t in sorted(square[i], key=lambda t: (square[i][t], t)):
            light += square[i][t]
            if math.sqrt(light) >= threshold * norms[i] * (1 - 1e-9):
                anchors.add(t)
        like = {sentences[k][0] for k in range(len(sentences)) if sum(n * bags[k][t] * idf[t] ** 2 for t, n in bags[i].items()) >= threshold * norms[i] * norms[k]} - {name}
        need = sorted({t for other in like for t in bags[i] if t not in said[other]})
        out.append({"sentence": i, "license": name, "length": len(own), "norm": norms[i], "need": need, "anchors": sorted(anchors),
                    "terms": [{"term": t, "w": idf[t], "tf": n, "at": [p for p, x in enumerate(own) if x == t] if t in anchors else []} for t, n in sorted(bags[i].items())]})
    return out


def _inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from constants, without rows made in Python."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def best_window(occurs: Column, n: Column, length: Column, norm: Column, need: Column) -> Column:
    """Best cosine of a sentence over the windows of a line of n terms; occurs: (pos, term, w, tf, at) of the sentence's terms in it, by pos."""
    anchors = F.flatten(F.transform(occurs, lambda s: F.flatten(F.transform(s["at"], lambda p: F.array(
        F.struct((s["pos"] - p).alias("start"), length.alias("width")), F.struct((s["pos"] - 2 * p).alias("start"), (2 * length).alias("width")))))))

    def cosine(window: Column) -> Column:
        end = F.least(window["start"] + window["width"], n)
        inside = F.sort_array(F.transform(F.filter(occurs, lambda x: (x["pos"] >= window["start"]) & (x["pos"] < end)), lambda x: F.struct(x["term"], x["w"], x["tf"])))
        others = end - F.greatest(window["start"], F.lit(0)) - F.size(inside)

        def step(a: Column, x: Column) -> Column:
            # In order of term: the k-th of a term adds k² - (k-1)² to the square of its count.
            k = F.when(a["term"] == x["term"], a["k"] + 1).otherwise(1)
            return F.struct(x["term"].alias("term"), k.alias("k"), (a["dot"] + x["tf"] * x["w"] * x["w"]).alias("dot"), (a["sq"] + (2 * k - 1) * x["w"] * x["w"]).alias("sq"))

        start = F.struct(F.lit("").alias("term"), F.lit(0).alias("k"), F.lit(0.0).alias("dot"), F.lit(0.0).alias("sq"))
        value = F.aggregate(inside, start, step, lambda a: a["dot"] / (norm * F.sqrt(a["sq"] + others * OTHER * OTHER)))
        kinds = F.array_distinct(F.transform(inside, lambda x: x["term"]))
        return F.when((F.size(kinds) >= LEAST_TERMS) & (F.size(F.array_intersect(kinds, need)) == F.size(need)), value)

    return F.array_max(F.transform(F.array_distinct(anchors), cosine))


def plain(html: Column) -> Column:
    """Markup to lines: block tags end a line, other tags and line ends are blanks, and the commonest entities are decoded."""
    text = F.regexp_replace(F.translate(html, "\r\n", "  "), f"(?i)</?(?:{BLOCK_TAGS})(?:[\\s/][^>]*)?>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def url_path(url: Column) -> Column:
    """host/segments of a URL, without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#].*$", "")


def scan(files: DataFrame, id_col: str, path_col: Column, text_col: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, origin (own, inherited or none), score (of the deciding line, 4 decimals), directory (that declared it)."""
    spark, sentences = files.sparkSession, book()
    vocabulary = sorted({t for _, own in sentences for t in own})
    base = files.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), path_col.alias("path"), F.coalesce(text_col, F.lit("")).alias("text"))
    base = table(base.withColumn("present", F.array_intersect(F.split(F.lower("text"), SPLIT), F.array(*map(F.lit, vocabulary)))), "texts")
    df = {r["term"]: r["df"] for r in base.select(F.explode("present").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row for each template term at most
    n = base.count()
    weighed = weigh(sentences, {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}, threshold)
    wanted = _inline(spark, weighed, "sentence: int, license: string, length: int, norm: double, need: array<string>, anchors: array<string>, terms: array<struct<term: string, w: double, tf: int, at: array<int>>>")
    anchors = F.array(*map(F.lit, sorted({t["term"] for x in weighed for t in x["terms"] if t["at"]})))
    by_term = wanted.select("sentence", "license", "length", "norm", "need", F.inline("terms"))

    def enough(seen: Column) -> Column:
        """Whether the terms seen of a sentence could reach the threshold."""
        return F.aggregate(seen, F.lit(0.0), lambda a, x: a + (x["tf"] * x["w"]) * (x["tf"] * x["w"])) >= (threshold * F.col("norm")) ** 2 * (1 - 1e-9)

    # All map-side, so texts are never shuffled: a text is carried once for each sentence that it could hold, by the first anchor that it has.
    met = base.select("row", "text", "present", F.explode(F.array_intersect("present", anchors)).alias("term"))
    met = met.join(F.broadcast(by_term.where(F.size("at") > 0).select("term", "sentence")), "term").join(F.broadcast(wanted.drop("license", "length")), "sentence")
    met = met.where((F.col("term") == F.array_min(F.array_intersect("present", "anchors"))) & (F.size(F.array_intersect("present", "need")) == F.size("need"))
                    & enough(F.filter("terms", lambda x: F.array_contains("present", x["term"]))))
    lines = met.select("row", "sentence", "anchors", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    lines = lines.select("row", "sentence", "line", terms(F.col("content")).alias("terms"), "anchors").where(F.arrays_overlap("terms", "anchors"))
    words = lines.select("row", "sentence", "line", F.size("terms").alias("n"), F.posexplode("terms").alias("pos", "term")).join(F.broadcast(by_term), ["sentence", "term"])
    found = words.groupBy("row", "line", "license", "sentence").agg(
        F.array_sort(F.collect_list(F.struct("pos", "term", "w", "tf", "at"))).alias("occurs"), *[F.first(c).alias(c) for c in ("n", "length", "norm", "need")])
    found = found.where(enough(F.array_distinct(F.transform("occurs", lambda x: F.struct(x["term"], x["tf"], x["w"])))))
    scored = found.select("row", "license", best_window(*map(F.col, ("occurs", "n", "length", "norm", "need"))).alias("score"))
    best = scored.where(F.col("score") >= threshold * (1 - 1e-9)).groupBy("row").agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), "license")).alias("license"))

    own = base.select("row", "doc_id", "path").join(best.hint("merge"), "row", "left").select("row", "doc_id", "path", "license", "score", F.regexp_replace("path", "[^/]*$", "").alias("parent"))
    declares = F.col("path").endswith("/") | F.lower(F.regexp_extract("path", "([^/]*)$", 1)).rlike(LICENCE_FILE)
    declared = own.where(declares & F.col("license").isNotNull()).groupBy("parent").agg(
        F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), "license")).alias("d"))
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    parts = F.split(F.rtrim("parent", F.lit("/")), "/")
    above = own.where(F.col("license").isNull() & F.col("parent").isNotNull()).select("parent").distinct().select(
        "parent", salt("parent"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).alias("directory"))
    declared = declared.select(F.col("parent").alias("directory"), "d", F.explode(salts).alias("salt"))
    found = above.join(declared, ["directory", "salt"]).groupBy("parent").agg(F.max_by(F.struct("directory", "d.license", "d.score"), F.length("directory")).alias("from"))
    found = found.select("parent", "from", F.explode(salts).alias("salt"))
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("from").isNotNull(), "inherited").otherwise("none")
    return own.withColumn("salt", salt("row")).join(found, ["parent", "salt"], "left").select(
        "doc_id", F.coalesce("license", "from.license").alias("license"), origin.alias("origin"), F.round(F.coalesce("score", "from.score"), 4).alias("score"),
        F.when(F.col("license").isNull(), F.col("from.directory")).alias("directory"))


def scan_pages(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Licences of web pages, by URL path and visible text."""
    return scan(pages, "page_id", url_path(F.col("url")), plain(F.col("html")), threshold)
