"""Licence scans in DataFrame functions only: TF-IDF cosine to templates, then inheritance down directories.

Units of a text are what may state a licence: its lines, two lines in a row, the sentences and the paragraphs (of up to `LONG`
words) that are left when comment marks go and lines are joined, so that wrapped notices are whole; all of them
with a header word. Longer sentences and lines give a window of words around each header word instead. A unit with an SPDX
identifier states that. Any other becomes a sparse vector of its words, weighted by term frequency times inverse document frequency
among the licences of the templates; words that no template has weigh as little as a common one. Terms are joined with the templates' terms, and
products are summed by (unit, template). The best template at `least` or more is the unit's licence. A file's own licence is that of
its best unit; a file without one inherits from the nearest ancestor directory (its own included) with a licence file, found by
joining the file's ancestor paths with the licence files' directories.

Null and empty texts have no units; null paths inherit nothing. Repeated paths give a row each and share what any of their texts states. Among matches that
agree to a tenth the template listed first wins, in a directory with several licence files the best match. An empty table gives none. Extra columns don't pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplate.llm.common import ascii_lower_col, few, looked_up, written

#: Notices by which licences are declared, and openings of their texts, under their SPDX names. Of equal matches the first listed wins.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004",
    ],
    "MIT": [
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "ISC": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-3.0-or-later": [
        "This work is licensed under the GNU General Public License, version 3 or later.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0-or-later": [
        "This work is licensed under the GNU General Public License, version 2 or later.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0-or-later": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1-or-later": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0-or-later": [
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0-only": [
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
        "GNU General Public License as published by the Free Software Foundation, version 3",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "GPL-2.0-only": [
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "GNU General Public License as published by the Free Software Foundation, version 2",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "LGPL-3.0-only": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1-only": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "AGPL-3.0-only": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License - v 2.0"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "CC-BY-NC-SA-3.0": ["Licensed under CC BY-NC-SA 3.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License."],
    "MPL-1.1": ["Licensed under the Mozilla Public License, version 1.1.", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.", "Mozilla Public License Version 1.1"],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "Eclipse Public License - v 1.0"],
    "LGPL-2.0-or-later": ["you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GFDL-1.3-or-later": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"],
    "GFDL-1.2-or-later": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation"],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Released under the zlib License."],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Licensed under the Zero-Clause BSD License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "CC0 1.0 Universal"],
}

#: Words that make a unit a header; every template has one.
HEADER_WORDS = r"(?i)licen[cs]|cc0|redistribut|permission (?:is hereby|is granted|to use)|neither the name|unencumbered|\bmpl\b"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*\(?((?-i)[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?)*)"
#: What opens and closes lines of comments.
COMMENT = r"(?mi)^[ \t]*(?:/\*+|\*+(?!/)|//+!?|#+!?|;+|--+|%+|<!--|dnl\b|rem\b|\"\"\"|''')?[ \t]*|[ \t\r]*(?:\*+/|-->)?[ \t\r]*$"

#: Words that tell licences of one wording apart. A unit and a template that it is given agree in all of them.
MODIFIERS = {
    "lesser": r"(?i)\blesser\b|\blgpl",
    "library": r"(?i)\blibrary general public",
    "affero": r"(?i)\baffero\b|\bagpl",
    "nc": r"(?i)creative commons.*non-?commercial|\bcc[ -]by[a-z -]*\bnc\b",
    "nd": r"(?i)creative commons.*no-?deriv|\bcc[ -]by[a-z -]*\bnd\b",
    "sa": r"(?i)creative commons.*share-?alike|\bcc[ -]by[a-z -]*\bsa\b",
    "provided": r"(?i)with or without fee is hereby granted, provided",
}
#: Names of licences of which a unit may state several, and what says that it states none.
NAMES = {
    "MIT": r"(?i)\bMIT licen[cs]e",
    "Apache-2.0": r"(?i)\bapache[ -]+licen[cs]e,?[ (]*(?:version|v\.?)?[ ]*2(?:\.0)?\b|\bapache[ -]2\.0\b",
    "BSD-3-Clause": r"(?i)\bBSD[ -]3[ -]clause|\b3[ -]clause BSD",
    "BSD-2-Clause": r"(?i)\bBSD[ -]2[ -]clause|\b2[ -]clause BSD",
    "MPL-2.0": r"(?i)\bmozilla public licen[cs]e,?[ ]*(?:version|v\.?)?[ ]*2\.0|\bMPL[ -]2\.0",
    "ISC": r"(?i)\bISC licen[cs]e",
    "Zlib": r"(?i)\bzlib licen[cs]e",
    "BSL-1.0": r"(?i)\bboost software licen[cs]e",
}
NEGATED = r"(?i)(?:\bnot\b|n't\b|\bnever\b|\bno longer\b)(?: \w+){0,2} (?:licen[cs]ed|released|distributed|available|covered)\b"
#: Numbers of versions: with a point anywhere, without one after a word for it. A zero after the point says nothing.
VERSION = r"(?i)(?<![\d.])(\d{1,2}\.\d)(?!\d)|\bv(?:ersion)?\.? ?(\d{1,2})(?![\d.]*\d)"

#: Words of the longest paragraphs, and sentences, that are a unit; words of windows around a header word in longer ones.
LONG, WINDOWS = 120, (14, 40)
#: Weight of a word that no template has; the idf of a word in half of the licences is about this.
UNSEEN = 0.75

_TERM = r"[^a-z0-9]+"


def terms(text: Column) -> Column:
    return F.filter(F.split(ascii_lower_col(text), _TERM), lambda w: w != "")


def _template_weights(spark, templates: dict[str, list[str]]) -> DataFrame:
    """(term, idf, template, variant, rank, weight) with unit-length weights."""
    rows = spark.createDataFrame([(name, i, t, k) for k, (name, ts) in enumerate(templates.items()) for i, t in enumerate(ts)], "template string, variant int, text string, rank int").repartition(1)
    # Versions and modifiers of one licence share its words, which are no less telling for that: words are counted by the name's first part.
    family = F.split("template", "-")[0]
    n = len({name.partition("-")[0] for name in templates})
    one = ["template", "variant", "rank"]
    counts = rows.select(*one, F.explode(terms(F.col("text"))).alias("term")).groupBy(*one, "term").agg(F.count("*").alias("tf"))
    idf = counts.groupBy("term").agg(F.log(F.lit(n + 1.0) / (F.count_distinct(family) + 0.5)).alias("idf"))
    weighted = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy(*one).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, one).select("term", "idf", *one, (F.col("w") / F.col("norm")).alias("weight"))


def versions(text: Column) -> Column:
    """The versions that a text states, without a zero after the point."""
    found = F.concat(F.regexp_extract_all(text, F.lit(VERSION), F.lit(1)), F.regexp_extract_all(text, F.lit(VERSION), F.lit(2)))
    return F.array_distinct(F.filter(F.transform(found, lambda v: F.regexp_replace(v, r"\.0$", "")), lambda v: v != ""))


def _facts(text: Column) -> Column:
    return F.struct(versions(text).alias("versions"), F.struct(*(text.rlike(r).alias(m) for m, r in MODIFIERS.items())).alias("modifiers"))


def match(units: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """(id, template, cosine, rank) of the best template of each distinct `unit` string, where it reaches `least`; id is the string's SHA-256.

    The same notice stands in very many files, so distinct strings are matched, once each. A template only counts where the unit has all
    its MODIFIERS and no other, and, if it states versions, has those of the template. A negated unit states nothing, and one with
    several NAMES joins them by OR, or by AND if it has no "or"."""
    weights = F.broadcast(written(_template_weights(units.sparkSession, templates), "templates"))  # bounded by the given templates
    # Strings are known by their hash from here on, so that a long one isn't repeated with each of its terms.
    named = written(units.select("unit").distinct().select("unit", F.sha2("unit", 256).alias("id"), F.regexp_extract("unit", SPDX, 1).alias("said")).filter((F.col("said") != "") | ~F.col("unit").rlike(NEGATED)), "units")
    counted = named.filter("said = ''").select("id", F.explode(terms(F.col("unit"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    idf = F.broadcast(weights.select("term", "idf").distinct())
    known = written(counted.join(idf, "term", "left").select("id", "term", (F.col("tf") * F.coalesce("idf", F.lit(UNSEEN))).alias("w")), "terms")
    norms = known.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    kinds = units.sparkSession.createDataFrame([(name, i, t) for name, ts in templates.items() for i, t in enumerate(ts)], "template string, variant int, text string").select("template", "variant", _facts(F.col("text")).alias("must"))
    dots = known.join(weights, "term").groupBy("id", "template", "variant", "rank").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    near = dots.join(norms, "id").select("id", "template", "variant", "rank", F.least(F.lit(1.0), F.col("dot") / F.col("norm")).alias("cosine")).filter(F.col("cosine") >= least)
    told = near.join(named.select("id", _facts(F.col("unit")).alias("has")), "id").join(F.broadcast(kinds), ["template", "variant"])
    stated_version = (F.size("has.versions") == 0) | (F.size(F.array_except("must.versions", "has.versions")) == 0)
    cosine = told.filter((F.col("has.modifiers") == F.col("must.modifiers")) & stated_version)
    best = cosine.groupBy("id").agg(F.min(F.struct((-F.round("cosine", 9)).alias("order"), "rank", "template", "cosine")).alias("b"))
    # Names that SPDX has given up stand for these.
    said = F.regexp_replace(F.regexp_replace("said", r"\b([AL]?GPL-\d\.\d)\+", "$1-or-later"), r"\b([AL]?GPL-\d\.\d)(?![\w.+-])", "$1-only")
    stated = named.filter("said <> ''").select("id", F.regexp_replace(said, r"[ \t]+", " ").alias("template"), F.lit(1.0).alias("cosine"), F.lit(-1).alias("rank"))
    single = best.select("id", F.col("b.template").alias("template"), F.col("b.cosine").alias("cosine"), F.col("b.rank").alias("rank"))
    named_here = F.array_compact(F.array(*(F.when(F.col("unit").rlike(r), F.lit(n)) for n, r in NAMES.items())))
    joint = F.when(F.col("unit").rlike(r"(?i)\bor\b|\bdual"), F.lit(" OR ")).otherwise(F.lit(" AND "))
    several = named.filter("said = ''").select("id", named_here.alias("names"), joint.alias("joint")).filter(F.size("names") > 1)
    both = several.select("id", F.when(F.col("joint") == " OR ", F.array_join("names", " OR ")).otherwise(F.array_join("names", " AND ")).alias("template"), F.lit(1.0).alias("cosine"), F.lit(-1).alias("rank"))
    return single.join(several.select("id"), "id", "left_anti").unionByName(both).unionByName(stated)


def headers(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit): the distinct units of every whole text that have a header word."""
    is_header = lambda x: x.rlike(HEADER_WORDS)
    spaced = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    n_words = lambda x: F.size(F.split(x, " "))
    bare = files.filter(is_header(F.col(text))).select(key, F.regexp_replace(text, COMMENT, "").alias("bare"))
    cut = bare.select(key, F.split("bare", "\n").alias("lines"), F.transform(F.filter(F.split("bare", r"\n\s*\n"), is_header), spaced).alias("paragraphs"))
    two = F.transform("lines", lambda x, i: F.when(is_header(x), F.concat_ws(" ", x, F.get("lines", i + 1))))
    sentences = F.flatten(F.transform("paragraphs", lambda p: F.split(p, r"(?<=[.!?])\s+(?=[\p{Lu}\"(])")))
    short = F.filter("paragraphs", lambda p: n_words(p) <= LONG)
    units = F.array_distinct(F.transform(F.filter(F.concat(F.filter("lines", is_header), F.filter(two, lambda x: x.isNotNull()), sentences, short), is_header), spaced))

    def around(x: Column) -> Column:
        words = F.split(x, " ")
        at = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(r"(?i)licen[cs]|cc0|redistribut|permission|neither|unencumbered|^mpl$"), i)), lambda i: i.isNotNull())
        return F.when(F.size(words) <= LONG, F.array(x)).otherwise(F.flatten(F.transform(at, lambda i: F.array(*(F.array_join(F.slice(words, F.greatest(i - n // 2, F.lit(0)) + 1, n), " ") for n in WINDOWS)))))

    return cut.select(key, F.explode(F.array_distinct(F.flatten(F.transform(units, around)))).alias("unit"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first, the root ("") last."""
    parts = F.split(directory(path), "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scan(files: DataFrame, key: str = "key", path: str = "path", text: str = "text", is_license: Column | None = None, templates: dict[str, list[str]] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """`key`, `path`, `license` (or null), `cosine`, `origin` ("header", "file", "inherited" or null) and `origin_dir` of every row.

    `is_license` says which rows are licence files; by default their names do."""
    named = is_license if is_license is not None else F.element_at(F.split(F.col(path), "/"), -1).rlike(LICENSE_FILE)
    files = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("text"), F.coalesce(named, F.lit(False)).alias("named"))
    units = written(headers(files.filter("path is not null"), "path", "text").withColumn("id", F.sha2("unit", 256)), "headers")
    found = units.select("path", "id").join(few(written(match(units, templates, least), "matches"), 100_000), "id")
    best = F.min(F.struct((-F.round("cosine", 1)).alias("order"), "rank", (-F.col("cosine")).alias("exact"), "template", "cosine")).alias("b")
    own = written(found.groupBy("path").agg(best).select("path", F.col("b.template").alias("template"), F.col("b.cosine").alias("cosine"), F.col("b.rank").alias("rank")), "own")
    rows = files.select("key", "path", "named")
    stated = written(rows.filter("named").join(own, "path").groupBy(directory(F.col("path")).alias("dir")).agg(best), "stated")
    # Directories are few beside files: ancestors are looked up once a directory. All have the root above them, so it is a hot key.
    dirs = rows.filter("path is not null").select(directory(F.col("path")).alias("at"), "path").groupBy("at").agg(F.min("path").alias("some"))
    above = looked_up(dirs.select("at", F.posexplode(ancestors(F.col("some"))).alias("up", "dir")), stated, ["dir"], F.col("at")).filter("b is not null")
    nearest = written(above.groupBy("at").agg(F.min(F.struct("up", "dir", "b")).alias("near")).select("at", F.col("near.dir").alias("near_dir"), F.col("near.b.template").alias("near_template"), F.col("near.b.cosine").alias("near_cosine")), "nearest")
    full = looked_up(rows.join(own.drop("rank"), "path", "left").withColumn("at", directory(F.col("path"))), nearest, ["at"], F.xxhash64("key", "path"))
    held = F.col("template").isNotNull()
    return full.select(
        F.col("key").alias(key),
        F.col("path").alias(path) if path != key else F.col("path"),
        F.coalesce("template", "near_template").alias("license"),
        F.coalesce("cosine", "near_cosine").alias("cosine"),
        F.when(held & F.col("named"), "file").when(held, "header").when(F.col("near_template").isNotNull(), "inherited").alias("origin"),
        F.when(~held, F.col("near_dir")).alias("origin_dir"),
    )
