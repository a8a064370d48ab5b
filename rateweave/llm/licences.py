"""Licence notices, found by the Dice coefficient over word bigrams.

``scan`` judges lines and whole documents, ``passages`` what stands within or across them; ``notices`` is both.

Lines. Each line of a document, and the whole document if it has several lines (line -1), is compared with the
licence templates. Text is normalised first: A-Z become a-z, and everything but a-z and 0-9 divides words. With A and B the
distinct bigrams of a unit and of a template, Dice is 2 |A and B| / (|A| + |B|). A template can only reach the threshold t if
t / (2 - t) <= |A| / |B| <= (2 - t) / t: templates outside these bounds are pruned before anything is compared, and so are
units that share no bigram with any template.

Passages. Each run of as many words as a template has (or up to the document's end) that begins with a bigram of the template is
compared with it, wherever lines end; a run that reaches the threshold can be moved on to such a beginning without losing a shared
bigram. Runs are only made for a template if the document shares as many bigrams with it as the threshold takes, and only where as many
of them lie close enough. Of overlapping runs of one template the best counts, of equal ones the first. A passage is left out if ``scan``
has it already: if it is part of a line found for the same licence, or touches a line or lies in a document found for the same template.
Passages are also compared with ``FULL_TEXTS``, whole texts of the short licences and openings of the long ones, and in ``notices`` with
``SECTIONS``, all of each long text in sections, so that any part of a licence file that holds a section is found.

A unit or run that reaches the threshold shares at least t / (2 - t) of a template's bigrams, so it holds one of any choice of slightly
more than the rest of them. The choice is those of the longest words; documents without any of it are passed over.

Templates are a parameter of at most ``MAX_TEMPLATES``; their bigrams are literals of the expression. Everything is row by row, with no shuffle.
Time and memory go with the length of a text, also of one that is nothing but notices: each word is compared with its own template's
length of words, one run at a time.

Defined results: null and empty texts and units with fewer than two words match nothing. A unit that reaches the threshold with
several templates has a row for each. Repeated rows give their own rows; rows without id are kept. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from rateweave.llm.common import lower_ascii
from rateweave.llm.licence_texts import FULL_TEXTS, SECTIONS
from rateweave.session import materialize

THRESHOLD_PERCENT = 70
MAX_TEMPLATES = 200

#: Public licence notices, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def template_bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bigrams(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(lower_ascii(text), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))


def checked(templates: tuple[tuple[str, str], ...]) -> list[tuple[int, str, list[str]]]:
    """Number, licence and bigrams of the templates that have any."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    known = [(i, name, template_bigrams(body)) for i, (name, body) in enumerate(templates)]
    return [t for t in known if t[2]]


def least_shared(n: int, percent: int) -> int:
    """The fewest bigrams that a unit shares with a template of ``n`` bigrams if it reaches the threshold."""
    return -(-percent * n // (200 - percent))


def telling(known: list[tuple[int, str, list[str]]], percent: int) -> list[str]:
    """Bigrams of which every match of any template holds one."""
    return sorted({b for _, _, own in known for b in sorted(own, key=lambda b: (-len(b), b))[: len(own) - least_shared(len(own), percent) + 1]})


def one_of(pairs: list[str]) -> str:
    """SQL list of bigrams (of a-z, 0-9 and blanks alone)."""
    return ", ".join(f"'{b}'" for b in pairs)


def held_apart(df: DataFrame, kept: list[str], **columns: Column) -> DataFrame:
    """Columns ``kept`` and new ones, which later filters and expressions take as they are instead of working them out again."""
    made = df.select(*kept, F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("_made"))
    return made.select(*kept, *(F.col(f"_made.{name}").alias(name) for name in columns))


def with_pairs(docs: DataFrame, known: list[tuple[int, str, list[str]]], percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and pairs (all bigrams in order) of the documents that can match anything."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    words = F.split(F.trim(F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))), " ")
    rows = held_apart(rows, ["doc_id", "text"], words=words)
    # the pair of the last word is null
    pairs = F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = held_apart(rows, ["doc_id", "text"], pairs=pairs)
    return rows.where(F.expr(f"exists(pairs, b -> coalesce(b in ({one_of(telling(known, percent))}), false))"))


def scan(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = THRESHOLD_PERCENT,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, line_no (from 0; -1 for the whole document), licence, template (its number), shared and dice of each match."""
    known = checked(templates)
    listed = F.array(*(
        F.struct(F.lit(i).alias("no"), F.lit(name).alias("name"), F.array(*map(F.lit, own)).alias("own")) for i, name, own in known
    ))
    every = F.array(*map(F.lit, sorted({b for t in known for b in t[2]})))
    fewest = min(-(-percent * len(own) // (200 - percent)) for _, _, own in known)

    rows = with_pairs(docs, known, percent, doc_id, text)
    lines = F.split("text", "\n")
    units = F.transform(lines, lambda line, i: F.struct(i.cast("int").alias("line_no"), line.alias("unit")))
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("line_no"), F.col("text").alias("unit")))).otherwise(F.array())
    rows = rows.select("doc_id", F.explode(F.concat(units, whole)).alias("u")).select("doc_id", "u.*")
    rows = rows.withColumn("own", bigrams(F.col("unit"))).where((F.size("own") >= fewest) & F.arrays_overlap("own", every))
    n = F.size("own")
    fitting = F.filter(listed, lambda t: (percent * F.size(t["own"]) <= (200 - percent) * n) & (percent * n <= (200 - percent) * F.size(t["own"])))
    compared = F.transform(fitting, lambda t: F.struct(
        t["no"].alias("template"), t["name"].alias("licence"), F.size(F.array_intersect("own", t["own"])).alias("shared"),
        (n + F.size(t["own"])).alias("both"),
    ))
    found = rows.select("doc_id", "line_no", F.explode(F.filter(compared, lambda m: 200 * m["shared"] >= percent * m["both"])).alias("m"))
    return found.select("doc_id", "line_no", "m.licence", "m.template", "m.shared", (2 * F.col("m.shared") / F.col("m.both")).alias("dice"))


def passages(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = THRESHOLD_PERCENT,
    doc_id: str = "doc_id", text: str = "text", full: tuple[tuple[str, str], ...] = FULL_TEXTS,
) -> DataFrame:
    """The columns of ``scan`` for each passage that it doesn't find; line_no is the line the passage begins in.

    The templates of ``full`` are numbered after ``templates``.
    """
    known = checked(templates + full)
    lengths = {i: len(re.findall("[a-z0-9]+", body.lower())) for i, (_, body) in enumerate(templates + full)}
    by_line = [t for t in known if t[0] < len(templates)]

    def listing(some):
        return F.array(*(
            F.struct(F.lit(i).alias("no"), F.lit(name).alias("name"), F.split(F.lit(",".join(own)), ",").alias("own")) for i, name, own in some
        ))

    every = sorted({b for t in known for b in t[2]})
    rows = with_pairs(docs, known, percent, doc_id, text)
    hits = F.expr(f"filter(transform(pairs, (b, i) -> struct(i as at, b as pair)), h -> h.pair in ({one_of(every)}))")
    rows = held_apart(rows, ["doc_id", "text", "pairs"], hits=hits)
    # where the bigrams of a template stand, in documents with enough of them
    places = F.array(*(
        F.struct(
            F.lit(i).alias("no"), F.lit(name).alias("name"), F.lit(lengths[i]).alias("long"), F.lit(least_shared(len(own), percent)).alias("least"),
            F.split(F.lit(",".join(own)), ",").alias("own"), F.expr(f"transform(filter(hits, h -> h.pair in ({one_of(own)})), h -> h.at)").alias("held"),
        ) for i, name, own in known
    ))
    rows = rows.select("doc_id", "text", "pairs", F.explode(F.filter(places, lambda t: F.size(t["held"]) >= t["least"])).alias("t"))
    rows = rows.select("doc_id", "text", "pairs", "t.*")
    starts = F.filter("held", lambda at, i: F.coalesce(F.get("held", i + F.col("least") - 1) <= at + F.col("long") - 2, F.lit(False)))

    # one run at a time; a run that ends with the document has a null for the pair of the last word
    def run(at):
        return F.array_compact(F.slice("pairs", at + 1, F.col("long") - 1))

    sized = F.transform(starts, lambda at: F.struct(
        at.alias("at"), F.size(F.array_intersect(run(at), "own")).alias("shared"), (F.size(F.array_distinct(run(at))) + F.size("own")).alias("both")
    ))
    good = F.filter(sized, lambda r: 200 * r["shared"] >= percent * r["both"])
    ranked = F.array_sort(F.transform(good, lambda r: F.struct((-2 * r["shared"] / r["both"]).alias("lack"), r["at"].alias("at"), r["shared"].alias("shared"), r["both"].alias("both"))))
    kept = ["doc_id", "text", "pairs", "no", "name", "long", "own"]
    rows = held_apart(rows, kept, ranked=ranked).where(F.size("ranked") > 0)
    # Of runs that overlap none is taken twice, so a stretch of a run's length holds the beginning of one at most: a run meets
    # those taken in its own stretch and the next ones only.
    stretch = F.floor(F.size("pairs") / F.col("long")).cast("int") + 1
    none = F.array_repeat(F.get("ranked", F.size("ranked")), stretch)

    def taken_with(taken, r):
        k = F.floor(r["at"] / F.col("long")).cast("int")
        near = [F.get(taken, k + d) for d in (-1, 0, 1)]
        overlaps = [F.coalesce(F.abs(n["at"] - r["at"]) < F.col("long"), F.lit(False)) for n in near]
        put = F.concat(F.slice(taken, 1, k), F.array(r), F.slice(taken, k + 2, F.size(taken)))
        return F.when(overlaps[0] | overlaps[1] | overlaps[2], taken).otherwise(put)

    best = F.array_compact(F.aggregate("ranked", none, taken_with))
    lines = F.split("text", "\n")
    line_no = F.flatten(F.transform(lines, lambda line, i: F.array_repeat(i, word_count(line))))
    rows = held_apart(rows, [c for c in kept if c != "text"], best=best, lines=lines, line_no=line_no)
    found = rows.select("*", F.explode("best").alias("r"))
    last = F.least(F.col("r.at") + F.col("long"), F.size("pairs")) - 1
    found = found.withColumn("first_line", F.get("line_no", F.col("r.at"))).withColumn("last_line", F.get("line_no", last))
    found = held_apart(
        found, ["doc_id", "pairs", "no", "name", "own", "r", "first_line", "last_line"],
        units=F.transform(F.slice("lines", F.col("first_line") + 1, F.col("last_line") - F.col("first_line") + 1), bigrams),
    )

    def reaches(unit, own):
        return 200 * F.size(F.array_intersect(unit, own)) >= percent * (F.size(unit) + F.size(own))

    inside = F.col("first_line") == F.col("last_line")
    near = F.filter(listing(by_line), lambda t: (t["no"] == F.col("no")) | (inside & (t["name"] == F.col("name"))))
    by_scan = F.exists(near, lambda t: F.exists("units", lambda u: reaches(u, t["own"])))
    by_scan = by_scan | ((F.col("no") < len(templates)) & reaches(F.array_distinct(F.array_compact("pairs")), F.col("own")))
    return found.where(~by_scan).select(
        "doc_id", F.col("first_line").alias("line_no"), F.col("name").alias("licence"), F.col("no").alias("template"), "r.shared",
        (2 * F.col("r.shared") / F.col("r.both")).alias("dice"),
    )


def word_count(line: Column) -> Column:
    plain = F.trim(F.regexp_replace(lower_ascii(line), "[^a-z0-9]+", " "))
    return F.when(F.length(plain) > 0, F.size(F.split(plain, " "))).otherwise(0)


def notices(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = THRESHOLD_PERCENT,
    doc_id: str = "doc_id", text: str = "text", full: tuple[tuple[str, str], ...] = FULL_TEXTS + SECTIONS,
) -> DataFrame:
    """``scan`` and ``passages``, of the documents that can match anything; these are picked and written once."""
    rows = with_pairs(docs, checked(templates + full), percent, doc_id, text).select("doc_id", "text")
    rows = materialize(rows, "licence-suspects")
    return scan(rows, templates, percent).unionByName(passages(rows, templates, percent, full=full))
