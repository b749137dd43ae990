"""License scan: sparse TF-IDF cosine of spans of words to licence templates, then inheritance along directories.

The spans run over the words of a whole file; a file that shares too little of a template's weight cannot reach
the threshold and is left out before the spans are scored (an exact bound).  The weights are those of the
files at hand, for every term, so a verdict does not depend on how many files there are.  In a
source tree a file that opens with a licence notice is a licence file and speaks for its directory; on a site,
whose pages open with a title, every page with a notice votes for its directory.  A file without a notice
of its own inherits from the nearest ancestor directory with one.  Built-in column functions only.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sightline.operators.ordering import salted_join
from sightline.session import cut_lineage

# Fixed values, as (name, text): the usual short notices, headers of source files, and passages that licence files hold.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution. "
     "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
     "this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
)
# Lines that name a licence and hold nothing else, word by word.
TITLES = (
    ("Apache-2.0", "apache license"), ("Apache-2.0", "apache license version 2 0"), ("Apache-2.0", "apache license 2 0"),
    ("CC-BY-4.0", "cc by 4 0"), ("CC-BY-NC-4.0", "cc by nc 4 0"), ("CC-BY-SA-4.0", "cc by sa 4 0"), ("CC0-1.0", "cc0 1 0"),
    ("GPL-3.0", "gnu general public license version 3"), ("ISC", "isc license"), ("LGPL-3.0", "gnu lesser general public license version 3"),
    ("MIT", "mit license"), ("MIT", "the mit license"), ("MIT", "the mit license mit"), ("MPL-2.0", "mozilla public license version 2 0"),
)
LICENSE_FILE = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying)[^/]*$"
THRESHOLD = 0.75
TERM = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), TERM, -1), "")


# Tags that end a line; all others stand within one.
BLOCKS = (
    "address|article|aside|blockquote|body|br|caption|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "frame|frameset|h[1-6]|head|header|hr|html|legend|li|main|menu|meta|nav|noscript|ol|optgroup|option|p|pre|section|select|summary|"
    "table|tbody|td|template|textarea|tfoot|th|thead|title|tr|ul")


def html_lines(html: Column) -> Column:
    """Text of a page with a line end in place of every block tag; other tags, comments, scripts and styles are left out."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1>", "")
    return F.regexp_replace(F.regexp_replace(bare, rf"(?i)</?(?:{BLOCKS})(?:[\s/][^>]*)?>", "\n"), r"<[^>]*>", "")


def _term_sets(templates: Sequence[tuple[str, str]]) -> list[set[str]]:
    return [{t for t in re.split("[^0-9a-z\x80-\U0010FFFF]+", text.lower()) if t} for _, text in templates]


def _is_title(text: Column, titles: Sequence[str]) -> Column:
    """Whether a line consists of one of the titles."""
    gap = r"[^0-9a-z\x{80}-\x{10FFFF}\n]"
    return F.lower(text).rlike(rf"(?md)^{gap}*(?:{'|'.join(t.replace(' ', gap + '+') for t in titles)}){gap}*$")


def first_line(text: Column) -> Column:
    """First line that has a term; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.split(text, "\n", -1), lambda x: F.size(terms(x)) > 0), F.lit(0)), F.lit(""))


def directory(path: Column) -> Column:
    """Path up to the last slash; empty for a file at the top, null for a null path."""
    return F.regexp_extract(path, r"^(?s)(.*)/[^/]*$", 1)


def scan_licenses(
    files: DataFrame, file_id: str, path: str, text: str, templates: Sequence[tuple[str, str]] = TEMPLATES,
    votes: bool = False, titles: Sequence[tuple[str, str]] = TITLES,
) -> DataFrame:
    """One row per row of ``files``: ``file_id``, path, ``own_license``, ``own_score``, ``license``, ``origin``.

    ``own_license`` has a template with a cosine of at least 0.75 to a span of words of the whole text; of several,
    that with the greatest product of cosine and shared weight, ties by name.  Without one, a line that is a
    title of a license (by name, with ``titles``) counts with score 1.  A span begins and ends with a term of the template, may run over line ends and has at
    most three times the template's words and ten.  ``origin`` is "own", the directory that the license is
    inherited from, or null if there is none.  A directory has the best license of its files whose best span
    begins in the first non-empty line, whose first line is a title or whose name is that of a licence file; with ``votes``, the license that most of its files have of their own,
    ties by name.  Terms count once per span and weigh log((1 + files) / (1 + files with the term)) + 1 over
    all files.  Null or empty texts have no notice, null paths inherit nothing, repeated rows come as often
    as they do, other columns are not read.

    Runs jobs: three written tables (file counts of all terms; files with the words of candidates; matched
    files) and one row per term of the templates (their number is bounded by the templates).
    """
    sets = _term_sets(templates)
    vocabulary = sorted(set().union(*sets))
    given = files.select(
        F.col(file_id).alias("file_id"), F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
        terms(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    counts = cut_lineage(
        given.select(F.explode(F.array_append(F.array_distinct("_words"), "")).alias("term"))
        .groupBy("term").agg(F.count("*").alias("n")))
    df = {r["term"]: r["n"] for r in counts.where(F.col("term").isin(["", *vocabulary])).collect()}
    total = df.pop("", 0)
    square = {t: (math.log((1 + total) / (1 + df.get(t, 0))) + 1) ** 2 for t in vocabulary}

    limit = THRESHOLD * THRESHOLD * (1 - 1e-9)

    def heavy(own: set[str]) -> list[str]:
        """Terms without which the others weigh too little: every span that matches has one of them."""
        light, order = 0.0, sorted(own, key=lambda t: (square[t], t))
        bound = limit * sum(square[t] for t in own)
        for k, t in enumerate(order):
            light += square[t]
            if light >= bound:
                return order[k:]
        return order

    ranks = {name: -i for i, name in enumerate(sorted({name for name, _ in [*templates, *titles]}))}
    known = F.from_json(F.lit(json.dumps([
        {"name": name, "rank": ranks[name], "square": sum(square[t] for t in own), "span": 3 * len(text.split()) + 10,
         "own": sorted(own), "heavy": heavy(own), "terms": [{"term": t, "square": square[t]} for t in sorted(own)]}
        for (name, text), own in zip(templates, sets)])),
        "array<struct<name string, rank int, square double, span int, own array<string>, heavy array<string>, terms array<struct<term string, square double>>>>")

    # The cosine of a span is at most the length of what it shares with the template, over the template's length.
    shared = F.array_intersect("_words", F.array(*[F.lit(t) for t in vocabulary]))
    # Within a transform of one element, so that the shared terms are made once per file.
    likely = F.get(F.transform(F.array(shared), lambda own: F.filter(known, lambda x: F.aggregate(
        x["terms"], F.lit(0.0), lambda acc, t: acc + F.when(F.array_contains(own, t["term"]), t["square"]).otherwise(0.0)
    ) >= x["square"] * limit)), F.lit(0))
    kinds = {name: [t for n, t in titles if n == name] for name in sorted({n for n, _ in titles})}
    title = F.when(_is_title(F.col("_text"), [t for _, t in titles]), F.coalesce(*[
        F.when(_is_title(F.col("_text"), own), F.lit(name)) for name, own in kinds.items()])) if titles else F.lit(None).cast("string")
    opens = _is_title(F.col("_first"), [t for _, t in titles]) if titles else F.lit(False)
    read = cut_lineage(
        given.withColumn("_likely", F.transform(likely, lambda x: x["name"])).withColumn("_title", title)
        .withColumn("_is", F.size("_likely") > 0)
        .withColumn("_first", F.when(F.col("_is") | F.col("_title").isNotNull(), first_line(F.col("_text"))))
        .select(
            F.monotonically_increasing_id().alias("_row"), "file_id", "path", directory(F.col("path")).alias("_dir"),
            F.when(F.col("_is"), F.col("_likely")).alias("_likely"), F.when(F.col("_is"), F.col("_words")).alias("_words"),
            F.size(terms(F.col("_first"))).alias("_first"), "_title", (opens | F.col("path").rlike(LICENSE_FILE)).alias("_speaks")))
    candidates = read.where("_likely IS NOT NULL")

    # Per candidate, its words in order with their weights and the place where each stood before.
    places = (
        candidates.select("_row", F.posexplode("_words").alias("pos", "term"))
        .groupBy("_row", "term").agg(F.sort_array(F.collect_list("pos")).alias("at")))
    frequent = counts.join(places.select("term").distinct(), "term", "left_semi")
    weight = F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("n"))) + 1
    texts = (
        salted_join(places, frequent, ["term"], ["_row"])
        .select("_row", "term", (weight * weight).alias("square"), F.explode(F.transform("at", lambda p, i: F.struct(
            p.alias("pos"), F.coalesce(F.get("at", i - 1), F.lit(-1)).alias("before")))).alias("at"))
        .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at.pos", "at.before", "term", "square"))).alias("_text")))

    def span_score(begin: Column, words: Column, template: Column) -> Column:
        """Best cosine of the spans that begin at one word; a word counts where it stands first."""
        def add(acc: Column, x: Column) -> Column:
            fresh = F.when(x["before"] < begin["pos"], x["square"]).otherwise(0.0)
            dot, norm = acc["dot"] + F.when(x["own"], fresh).otherwise(0.0), acc["norm"] + fresh
            here = F.struct(F.round(dot / F.sqrt(norm * template["square"]), 6).alias("score"), dot.alias("dot"))
            return F.struct(dot.alias("dot"), norm.alias("norm"), F.greatest(acc["best"], here).alias("best"))

        none = F.lit(0.0)
        zero = F.struct(none.alias("dot"), none.alias("norm"), F.struct(none.alias("score"), none.alias("dot")).alias("best"))
        return F.aggregate(F.slice(words, begin["pos"] + 1, template["span"]), zero, add, lambda acc: acc["best"])

    template = F.col("_template")
    best = (
        candidates.select("_row", F.explode(F.filter(known, lambda x: F.array_contains("_likely", x["name"]))).alias("_template"))
        .join(texts, "_row")
        .withColumn("_text", F.transform("_text", lambda x: F.struct(
            x["pos"].alias("pos"), x["before"].alias("before"), x["square"].alias("square"),
            F.array_contains(template["own"], x["term"]).alias("own"), F.array_contains(template["heavy"], x["term"]).alias("heavy"))))
        .withColumn("_spans", F.get(F.transform(F.array(F.filter("_text", lambda x: x["heavy"])), lambda needed: F.transform(
            F.filter("_text", lambda x: x["own"] & F.exists(
                needed, lambda h: (h["pos"] >= x["pos"]) & (h["pos"] < x["pos"] + template["span"]))),
            lambda x: F.struct(span_score(x, F.col("_text"), template).alias("best"), (-x["pos"]).alias("start")))), F.lit(0)))
        .withColumn("_found", F.array_max(F.transform("_spans", lambda x: F.struct(
            x["best"]["score"].alias("score"), x["start"].alias("start"), x["best"]["dot"].alias("dot")))))
        .groupBy("_row").agg(F.max(F.when(F.col("_found.score") >= THRESHOLD, F.struct(
            F.round(F.col("_found.score") * F.col("_found.dot"), 6).alias("shared"), "_template.rank", "_found.start",
            "_found.score", "_template.name"))).alias("_best")))
    rank = F.coalesce(*[F.when(F.col("_title") == name, F.lit(ranks[name])) for name in kinds], F.lit(0))
    titled = F.when(F.col("_title").isNotNull(), F.struct(
        F.lit(0.0).alias("shared"), rank.alias("rank"), F.lit(-2147483647).alias("start"), F.lit(1.0).alias("score"), F.col("_title").alias("name")))
    matched = cut_lineage(
        read.drop("_words", "_likely").join(best, "_row", "left")
        .withColumn("_best", F.coalesce("_best", titled))
        .select("file_id", "path", "_dir", "_best", (F.col("_speaks") | (-F.col("_best.start") < F.col("_first"))).alias("_opening")))

    heard = matched.where(F.col("_best").isNotNull() & F.col("_dir").isNotNull())
    if votes:
        speaking = (
            heard.groupBy("_dir", "_best.rank", "_best.name").agg(F.count("*").alias("votes"))
            .groupBy("_dir").agg(F.max(F.struct("votes", "rank", "name")).alias("_said")))
    else:
        speaking = heard.where("_opening").groupBy("_dir").agg(F.max("_best").alias("_said"))
    steps = F.split("_dir", "/", -1)
    ancestors = (
        matched.where("_best IS NULL AND _dir IS NOT NULL").select("_dir").distinct()
        .withColumn("_steps", steps)
        .select(F.col("_dir").alias("_below"), F.explode(F.sequence(F.lit(1), F.size("_steps"))).alias("_depth"), "_steps")
        .withColumn("_dir", F.array_join(F.slice("_steps", F.lit(1), F.col("_depth")), "/")))
    nearest = (
        salted_join(ancestors.drop("_steps"), speaking, ["_dir"], ["_below"])
        .groupBy("_below").agg(F.max_by(F.struct("_dir", "_said"), "_depth").alias("_near"))
        .select(F.col("_below").alias("_dir"), "_near"))
    joined = salted_join(matched, nearest, ["_dir"], ["file_id", "path"], "left")
    inherits = F.col("_best").isNull() & F.col("_near").isNotNull()
    return joined.select(
        "file_id", "path", F.col("_best.name").alias("own_license"), F.col("_best.score").alias("own_score"),
        F.when(inherits, F.col("_near._said.name")).otherwise(F.col("_best.name")).alias("license"),
        F.when(inherits, F.col("_near._dir")).when(F.col("_best").isNotNull(), F.lit("own")).alias("origin"))
