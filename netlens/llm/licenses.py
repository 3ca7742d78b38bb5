"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Each template has an anchor, a word that few texts hold. Wherever a text has an anchor, the terms around
it make a window of the template's length, across line breaks and comment marks, which are no terms; so a
wrapped header, a sentence within a paragraph and a title within a whole licence file are all seen as
they are. Windows become sparse TF-IDF vectors, whose cosine to their template comes from a join of terms.
Template weights are a bounded table. An SPDX identifier in the text decides before any cosine. A file
with no license of its own takes that of the nearest directory above that holds a licence file:
directories, not files, are joined to their ancestors, and files to their directory.

Every text is looked at as a whole, and explode makes rows of windows, never of texts. Names are SPDX
identifiers, without what says whether later versions are allowed. Defined results: a null text or path
has none, score 0 and no source. Of several identifiers the first counts. Of equal scores the first
license by name wins; of several licence files in one directory the highest score, then the first name.
Repeated rows are numbered when written and judged each by itself. An empty table gives an empty result.
Other columns are not looked at.
"""

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm.columns import ascii_lower, documents, let
from netlens.storage import materialize

GNU = {"GPL": "General Public License", "LGPL": "Lesser General Public License", "AGPL": "Affero General Public License"}
GNU_VERSIONS = {"GPL": ("2.0", "3.0"), "LGPL": ("2.1", "3.0"), "AGPL": ("3.0",)}
CREATIVE = {
    "BY": "Attribution",
    "BY-SA": "Attribution ShareAlike",
    "BY-NC": "Attribution NonCommercial",
    "BY-ND": "Attribution NoDerivatives",
    "BY-NC-SA": "Attribution NonCommercial ShareAlike",
}

# Sentences of headers and licence files, by license; the anchor of each stands before the bar.
SENTENCES = {
    "Apache-2.0": [
        "licensed|Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "licensed|Licensed under the Apache License, Version 2.0.",
        "license|Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "BSD-2-Clause": [
        "redistribution|Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors as is and any express or implied warranties",
        "licensed|Licensed under the BSD 2-Clause License.",
    ],
    "BSD-3-Clause": [
        "redistribution|Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "licensed|Licensed under the BSD 3-Clause License.",
    ],
    "BSL-1.0": [
        "permission|Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "license|Boost Software License Version 1.0",
    ],
    "CC0-1.0": [
        "creative|Creative Commons Legal Code CC0 1.0 Universal",
        "cc0|released under CC0 1.0 Universal public domain dedication",
    ],
    "EPL-2.0": [
        "eclipse|made available under the terms of the Eclipse Public License 2.0 which is available at",
        "eclipse|Eclipse Public License v 2.0",
    ],
    "ISC": [
        "permission|Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "license|Released under the ISC License.",
    ],
    "MIT": [
        "permission|Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "license|Released under the MIT License.",
        "licensed|Licensed under the MIT license.",
        "license|The MIT License (MIT) Copyright (c)",
    ],
    "MPL-2.0": [
        "mozilla|This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
        "mozilla|subject to the terms of the Mozilla Public License, v. 2.0.",
        "mozilla|Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity",
    ],
    "Unlicense": [
        "unencumbered|This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"
    ],
    "Zlib": [
        "permission|In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"
    ],
}
#: Months and years of the titles that GNU licences carry.
GNU_DATES = {
    "GPL-2.0": "June 1991",
    "GPL-3.0": "29 June 2007",
    "LGPL-2.1": "February 1999",
    "LGPL-3.0": "29 June 2007",
    "AGPL-3.0": "19 November 2007",
}

FILE_NAMES = "^(license|licence|copying|notice)([.-].*)?$"
#: A whole license expression; its operators are upper-case, so that prose behind an identifier isn't part of it.
SPDX_ID = "[A-Za-z0-9][A-Za-z0-9.+-]*"
SPDX = (
    r"(?i)SPDX-License-Identifier:[ \t]*"
    rf"([( \t]*{SPDX_ID}(?:[) \t]*[ \t](?-i:AND|OR|WITH)[ \t][( \t]*{SPDX_ID})*(?:[ \t]*\))*)"
)
SPDX_TOKEN = f"({SPDX_ID}|[()])"
SPDX_SUFFIX = r"(-only|-or-later|\+|\.)$"
LEAST_COSINE = 0.6


def terms_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def templates() -> list[tuple[str, str, list[str]]]:
    """(license, anchor, terms) of each template."""
    texts = [(name, *x.split("|")) for name, each in SENTENCES.items() for x in each]
    for short, title in GNU.items():
        for full in GNU_VERSIONS[short]:
            name, version = f"{short}-{full}", full.removesuffix(".0")
            texts += [
                *(
                    (
                        name,
                        "gnu",
                        f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version",
                    )
                    for work in ("program", "library")
                ),
                (
                    name,
                    "gnu",
                    f"you can redistribute it and/or modify it under the terms of the GNU {title} version {version} as published by the Free Software Foundation",
                ),
                (name, "gnu", f"This work is licensed under the GNU {title}, version {version}."),
                (name, "gnu", f"GNU {title} Version {version}, {GNU_DATES[name]} Copyright (C)"),
            ]
    for short, title in CREATIVE.items():
        texts += [
            (f"CC-{short}-4.0", "creative", f"This work is licensed under a Creative Commons {title} 4.0 International License."),
            (f"CC-{short}-4.0", "cc", f"Licensed under CC {short} 4.0."),
        ]
    return [(name, anchor, terms_of(text)) for name, anchor, text in texts]


def template_tables() -> tuple[list[tuple], list[tuple], dict[str, float], float]:
    """Windows (template, license, anchor, offset, length), weights of unit length (template, term, weight), inverse document
    frequencies, and that of unknown terms."""
    every = templates()
    frequency: dict[str, int] = {}
    for _, _, terms in every:
        for term in set(terms):
            frequency[term] = frequency.get(term, 0) + 1
    idf = {t: math.log(1 + len(every) / f) for t, f in sorted(frequency.items())}
    windows, weights = [], []
    for k, (name, anchor, terms) in enumerate(every):
        windows.append((k, name, anchor, terms.index(anchor), len(terms)))
        raw = {t: terms.count(t) * idf[t] for t in sorted(set(terms))}
        size = math.sqrt(sum(w * w for w in raw.values()))
        weights += [(k, t, w / size) for t, w in raw.items()]
    return windows, weights, idf, math.log(1 + len(every))


def anchors() -> list[str]:
    return sorted({anchor for _, anchor, _ in templates()})


def cue() -> str:
    return "(^|[^a-z0-9])(" + "|".join(anchors()) + ")([^a-z0-9]|$)"


def plain(text: Column) -> Column:
    """Lower-case, with one spelling of the word license."""
    return F.replace(ascii_lower(text), F.lit("licenc"), F.lit("licens"))


def windows_of(found: DataFrame, windows: list[tuple]) -> DataFrame:
    """``row``, ``at``, ``template`` and ``terms`` of the windows around each anchor in ``plain`` texts."""
    before, after = max(w[3] for w in windows), max(w[4] - w[3] for w in windows)
    table = found.sparkSession.createDataFrame(
        windows,
        "template int, license string, anchor string, offset int, length int",
    ).drop("license")

    def contexts(terms: Column) -> Column:
        """What lies around each anchor, as far as any template reaches."""
        hits = F.array_compact(F.transform(terms, lambda t, i: F.when(t.isin(anchors()), i)))

        def context(i: Column) -> Column:
            start = F.greatest(i - before, F.lit(0))
            return F.struct(
                i.alias("at"),
                (i - start).alias("inside"),
                F.get(terms, i).alias("anchor"),
                F.slice(terms, start + 1, F.lit(before + after)).alias("terms"),
            )

        return F.transform(hits, context)

    around = found.select("row", F.explode(let(F.regexp_extract_all("plain", F.lit("[a-z0-9]+"), F.lit(0)), contexts)).alias("c"))
    joined = around.select("row", "c.at", "c.inside", "c.terms", "c.anchor").join(F.broadcast(table), "anchor")
    start = F.col("inside") - F.col("offset")
    window = F.slice("terms", F.greatest(start, F.lit(0)) + 1, F.col("length") + F.least(start, F.lit(0)))
    return joined.select("row", "at", "template", window.alias("terms"))


def best_templates(found: DataFrame) -> DataFrame:
    """``row``, ``license`` and ``cosine`` of the window and template that are most alike."""
    spark = found.sparkSession
    windows, weights, idf, unknown = template_tables()
    weighed = spark.createDataFrame(weights, "template int, term string, weight double")
    inverse = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    names = spark.createDataFrame([(w[0], w[1]) for w in windows], "template int, license string")
    counted = windows_of(found, windows).select(
        "row",
        "at",
        "template",
        F.explode("terms").alias("term"),
    ).groupBy("row", "at", "template", "term").agg(F.count("*").alias("times"))
    # The tables of the templates are bounded by the code above.
    valued = counted.join(F.broadcast(inverse), "term", "left").join(
        F.broadcast(weighed),
        ["template", "term"],
        "left",
    ).withColumn(
        "w",
        F.col("times") * F.coalesce("idf", F.lit(unknown)),
    )
    scored = valued.groupBy("row", "at", "template").agg(
        (F.sum(F.col("w") * F.coalesce("weight", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("exact")
    )
    named = scored.join(F.broadcast(names), "template").select(
        "row",
        "license",
        F.round("exact", 6).alias("cosine"),
    ).where(F.col("cosine") >= LEAST_COSINE)
    best = named.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best"))
    return best.select("row", F.col("best.license").alias("like"), (-F.col("best.minus")).alias("likeness"))


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def declared_name(text: Column) -> Column:
    """The license expression of the text's first SPDX identifier, its names spelled as the templates' are; null without one.

    One blank stands between names and operators. Parentheses that don't match in number, as where a closing one
    belongs to the text around, are left out.
    """
    known = F.create_map(*(F.lit(x) for name in sorted({name for name, _, _ in templates()}) for x in (name.lower(), name)))
    expression = F.nullif(F.regexp_extract(text, SPDX, 1), F.lit(""))

    def spelled(token: Column) -> Column:
        return let(F.regexp_replace(token, SPDX_SUFFIX, ""), lambda s: F.coalesce(F.try_element_at(known, F.lower(s)), s))

    def joined(tokens: Column) -> Column:
        opening, closing = F.filter(tokens, lambda t: t == "("), F.filter(tokens, lambda t: t == ")")
        kept = F.when(F.size(opening) == F.size(closing), tokens).otherwise(F.filter(tokens, lambda t: ~t.isin("(", ")")))
        said = F.array_join(F.transform(kept, spelled), " ")
        return F.replace(F.replace(said, F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")"))

    return let(F.regexp_extract_all(expression, F.lit(SPDX_TOKEN), 1), joined)


def scan(files: DataFrame, id_column: str, path_column: str, text_column: str) -> DataFrame:
    """``doc_id``, ``path``, ``license``, ``cosine`` (0 without, 1 of an identifier), ``found_in`` (spdx, header, file, inherited,
    none) and ``inherited_from``."""
    named = files.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("doc_id"),
        F.col(path_column).alias("path"),
        F.col(text_column).alias("text"),
    )
    # One pass over the texts: what the anchors leave is small.
    low = plain(F.col("text"))
    said = F.when(F.contains(low, F.lit("spdx-license-identifier:")), declared_name(F.col("text")))
    lines = materialize(
        named.select(
            "row",
            "doc_id",
            "path",
            said.alias("declared"),
            let(low, lambda t: F.when(t.rlike(cue()), t)).alias("plain"),
        ),
        "license-candidates",
    )
    own = best_templates(lines.where(F.col("plain").isNotNull() & F.col("declared").isNull()).select("row", "plain"))
    license, cosine = F.coalesce("declared", "like"), F.when(F.col("declared").isNotNull(), 1.0).otherwise(F.col("likeness"))
    judged = lines.drop("plain").join(own, "row", "left").select(
        "doc_id",
        "path",
        F.col("declared").isNotNull().alias("by_name"),
        license.alias("license"),
        cosine.alias("cosine"),
        directory(F.col("path")).alias("directory"),
    )
    judged = materialize(judged, "licenses")
    is_file = F.coalesce(F.lower(F.element_at(F.split("path", "/"), -1)).rlike(FILE_NAMES), F.lit(False))
    declared = judged.where(is_file & F.col("license").isNotNull()).groupBy("directory").agg(
        F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("d")
    ).select(F.col("directory").alias("above"), F.col("d.license").alias("from_license"))
    directories = judged.where(F.col("license").isNull() & F.col("directory").isNotNull()).select("directory").distinct()
    steps = F.split("directory", "/")
    above = F.concat(
        F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")),
        F.array(F.lit("")),
    )
    ancestors = directories.select("directory", F.explode(F.array_distinct(above)).alias("above"))
    nearest = ancestors.join(declared, "above").groupBy("directory").agg(
        F.max(F.struct(F.length("above").alias("depth"), "above", "from_license")).alias("n")
    )
    whole = judged.join(nearest, "directory", "left")
    own_place = F.when(is_file, "file").when(F.col("by_name"), "spdx").otherwise("header")
    found_in = F.when(F.col("license").isNotNull(), own_place).when(F.col("n").isNotNull(), "inherited").otherwise("none")
    return whole.select(
        "doc_id",
        "path",
        F.coalesce("license", "n.from_license").alias("license"),
        F.coalesce("cosine", F.lit(0.0)).alias("cosine"),
        found_in.alias("found_in"),
        F.when(F.col("license").isNull(), F.col("n.above")).alias("inherited_from"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths: its rows are files ``source/thousands/hundreds/tens/id.txt``; ids divisible by 20 are LICENSE
    files, in the source's folder or one to three folders further down in turn."""
    docs = documents(spark, sf_dir)
    folders = F.array(
        F.coalesce("source", F.lit("none")),
        *(F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 100, 10)),
    )
    licence = F.concat_ws("/", F.slice(folders, 1, (F.floor(F.col("doc_id") / 20) % 4).cast("int") + 1), F.lit("LICENSE"))
    path = F.when(F.col("doc_id") % 20 == 0, licence).otherwise(
        F.concat_ws("/", folders, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    )
    return scan(docs.withColumn("path", path), "doc_id", "path", "text")


def oracle() -> str:
    windows, weights, idf, unknown = template_tables()
    values = lambda rows: ", ".join(
        "(" + ", ".join(
            f"'{x}'"
            if isinstance(x, str) else f"{x!r}::double"
            if isinstance(x, float) else repr(x)
            for x in r
        ) + ")"
        for r in rows
    )
    known = sorted({name for name, _, _ in templates()})
    return f"""
WITH windows(template, license, anchor, off, len) AS (VALUES {values(windows)}),
weights(template, term, weight) AS (VALUES {values(weights)}),
inverse(term, idf) AS (VALUES {values(sorted(idf.items()))}),
known(name) AS (VALUES {values([(k,) for k in known])}),
placed AS (SELECT doc_id, text, replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'licenc', 'licens') AS plain,
  [coalesce(source, 'none'), CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 AS VARCHAR), CAST(doc_id // 10 AS VARCHAR)] AS folders FROM documents),
files AS (SELECT doc_id, text, plain, array_to_string(CASE WHEN doc_id % 20 = 0 THEN folders[1 : (doc_id // 20) % 4 + 1] ELSE folders END, '/') AS directory,
  CASE WHEN doc_id % 20 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS name FROM placed),
said AS (SELECT doc_id, regexp_extract_all(nullif(regexp_extract(text, '{SPDX}', 1), ''), '{SPDX_TOKEN}') AS tokens FROM files),
tokens AS (SELECT doc_id, generate_subscripts(tokens, 1) AS pos, unnest(tokens) AS token, len(list_filter(tokens, lambda t: t = '(')) = len(list_filter(tokens, lambda t: t = ')')) AS even
  FROM said WHERE tokens IS NOT NULL),
names AS (SELECT doc_id, pos, coalesce(name, regexp_replace(token, '{SPDX_SUFFIX}', '')) AS name
  FROM tokens LEFT JOIN known ON lower(regexp_replace(token, '{SPDX_SUFFIX}', '')) = lower(name) WHERE even OR token NOT IN ('(', ')')),
declared_ids AS (SELECT doc_id, replace(replace(string_agg(name, ' ' ORDER BY pos), '( ', '('), ' )', ')') AS license FROM names GROUP BY doc_id),
lists AS (SELECT doc_id, regexp_extract_all(plain, '[a-z0-9]+') AS t FROM files WHERE regexp_matches(plain, '{cue()}') AND doc_id NOT IN (SELECT doc_id FROM declared_ids)),
terms AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM lists),
hits AS (SELECT doc_id, pos AS hit, template, pos - off AS start, pos - off + len AS stop FROM terms JOIN windows ON term = anchor),
valued AS (SELECT h.doc_id, hit, template, t.term, count(*) * coalesce(max(idf), {unknown!r}::double) AS w
  FROM hits h JOIN terms t ON t.doc_id = h.doc_id AND t.pos >= h.start AND t.pos < h.stop LEFT JOIN inverse i ON i.term = t.term GROUP BY 1, 2, 3, 4),
scored AS (SELECT doc_id, hit, v.template, round(sum(w * coalesce(weight, 0.0)) / sqrt(sum(w * w)), 6) AS cosine FROM valued v LEFT JOIN weights g ON g.template = v.template AND g.term = v.term GROUP BY 1, 2, 3),
ranked AS (SELECT doc_id, license, cosine, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) AS n FROM scored JOIN windows USING (template) WHERE cosine >= {LEAST_COSINE}),
own AS (SELECT doc_id, license, cosine, false AS by_name FROM ranked WHERE n = 1 UNION ALL SELECT doc_id, license, 1.0, true FROM declared_ids),
judged AS (SELECT f.doc_id, directory, name, license, cosine, by_name FROM files f LEFT JOIN own USING (doc_id)),
declared AS (SELECT directory AS above, arg_min(license, (-cosine, license)) AS given FROM judged WHERE name = 'LICENSE' AND license IS NOT NULL GROUP BY 1),
folders AS (SELECT DISTINCT directory FROM judged),
nearest AS (SELECT directory, arg_max(above, length(above)) AS above, arg_max(given, length(above)) AS given FROM folders JOIN declared ON directory = above OR starts_with(directory, above || '/') GROUP BY 1)
SELECT j.doc_id, j.directory || '/' || j.name AS path, coalesce(j.license, n.given) AS license, coalesce(j.cosine, 0.0) AS cosine,
  CASE WHEN j.license IS NOT NULL THEN CASE WHEN j.name = 'LICENSE' THEN 'file' WHEN j.by_name THEN 'spdx' ELSE 'header' END WHEN n.above IS NOT NULL THEN 'inherited' ELSE 'none' END AS found_in,
  CASE WHEN j.license IS NULL THEN n.above END AS inherited_from
FROM judged j LEFT JOIN nearest n USING (directory)"""
