"""Licence scans: a positional index of licence templates by their rarest words.

A template is a licence text, or a passage of one, with the key phrases that must stand
in it.  All licence words are weighed by how few documents of the corpus hold them, and
each template is filed under its rarest words with their places.  A document's filed
words propose where templates would start; starts that two of a template's words agree
on are candidates.  A candidate counts if enough of the template's words stand at their
places and all its key phrases stand within a few words of it.  So many words of a
template are filed that any place with enough words is a candidate: with ``m`` words
that may be amiss, its ``m + 2`` rarest.  Everything about a document happens in its own
row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_WORD, fresh, plain_words

#: Share of a notice's words that must stand at their places.
LEAST_SHARE = 0.8
#: How many words before and behind a notice its key phrases may begin.
SLACK = 5
#: What a licence's name alone is worth as a score, against 1 for a whole notice.
NAME_SCORE = 0.5


def words_of(text: str) -> list[str]:
    """The normalised words of a template."""
    return re.findall(PLAIN_WORD, text.lower())


@dataclass(frozen=True)
class Template:
    """A text, the label it stands for, and the key phrases that must stand in or near it.

    ``least`` is the share of its words that must stand at their places, ``worth`` the score
    of a place where all do.  ``base`` marks plain phrases whose every place is reported.
    """

    label: str
    text: str
    keys: tuple[str, ...] = ()
    least: float = LEAST_SHARE
    worth: float = 1.0
    base: bool = False

    @property
    def words(self) -> list[str]:
        return words_of(self.text)

    @property
    def need(self) -> int:
        """The least number of words at their places (1 at least)."""
        return max(1, math.ceil(self.least * len(self.words) - 1e-9))


def phrase(label: str, text: str) -> Template:
    """A phrase that must stand as it is."""
    return Template(label, text, least=1.0, base=True)


def name(label: str, text: str) -> Template:
    """A licence's name, which must stand as it is."""
    return Template(label, text, least=1.0, worth=NAME_SCORE)


BASE = [
    phrase("mit", "under the mit license"),
    phrase("apache-2", "apache license version 2"),
    phrase("cc-by-nc", "cc by nc"),
]

#: Names that stand for a licence wherever they are.
NAMES = [
    name("mit", "hereby granted free of charge"),
    name("apache-2", "apache license version 2 0"),
    name("gpl-2", "gnu general public license version 2"),
    name("gpl-3", "gnu general public license version 3"),
    name("lgpl-3", "gnu lesser general public license version 3"),
    name("agpl-3", "gnu affero general public license version 3"),
    name("mpl-2", "mozilla public license v 2 0"),
    name("bsd", "redistribution and use in source and binary forms"),
    name("cc-by-nc", "cc by nc 4 0"),
    name("cc-by-sa", "cc by sa 4 0"),
    name("cc-by", "cc by 4 0"),
    name("cc-by", "creative commons attribution 4 0 international"),
    name("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    name("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    name("cc0", "cc0 1 0 universal"),
    name("all-rights-reserved", "all rights reserved"),
]

#: Passages of public licences and of the notices they ask for, with the phrases that tell them apart.
NOTICES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("free of charge", "deal in the software without restriction")),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ("this permission notice", "substantial portions of the software")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee", "appear in all copies")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0", "in compliance with the license")),
    Template("gpl-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2")),
    Template("gpl-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3")),
    Template("lgpl-2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", ("gnu lesser general public license", "version 2 1")),
    Template("lgpl-3", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu lesser general public license", "version 3")),
    Template("agpl-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu affero general public license", "version 3")),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license", "2 0")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    Template("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ("redistributions in binary form", "this list of conditions")),
    Template("bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products", "prior written permission")),
    Template("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ("alter it and redistribute it freely",)),
    Template("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", ("source code form or as a compiled binary",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("attribution 4 0",)),
]


def word_spread(words: DataFrame, column: str, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many rows of the whole table each licence word occurs (one entry per licence word)."""
    held = words.select(F.explode(F.array_intersect(column, _strings(vocabulary))).alias("w"))
    return {r["w"]: r["count"] for r in held.groupBy("w").count().collect()}


def _strings(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def postings(templates: Sequence[Template], spread: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """The index: filed word to (template, place).

    Two filed words are at their places wherever enough words are; where a single word is
    enough, every word is filed twice.
    """
    filed: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(templates):
        rarest = sorted(range(len(t.words)), key=lambda k: (spread.get(t.words[k], 0), t.words[k], k))
        for place in rarest[: len(rarest) - t.need + 2] * (1 if t.need > 1 else 2):
            filed.setdefault(t.words[place], []).append((number, place))
    return filed


def scan(docs: DataFrame, templates: Sequence[Template] | None = None, text_col: str = "text", slack: int = SLACK) -> DataFrame:
    """``docs`` without its text, with what was found in each whole text.

    ``n_words``; ``base_starts`` (sorted first words, from 0, of all places of base
    phrases; one word may start several); ``base_labels`` and ``labels`` (sorted distinct
    arrays; the latter also has those of names and notices); ``score``, the best share of
    a found template's words at their places, times its worth (0 if nothing was found).  A
    template may also start before the text or end behind it, if enough of it is there.

    A null or empty text has no words and no finds; repeated rows are each scanned; an
    empty table gives an empty one.  Columns of ``docs`` with these names give way.
    """
    templates = [t for t in ([*BASE, *NAMES, *NOTICES] if templates is None else templates) if t.words]
    added = ["n_words", "base_starts", "base_labels", "labels", "score"]
    rest = [c for c in docs.columns if c not in (text_col, *added)]
    w, near, finds = (fresh(docs, c) for c in ("words", "near", "finds"))
    found = docs.withColumn(w, plain_words(F.col(text_col))).select(*rest, w)
    if not templates:
        none = F.array().cast("array<string>")
        return found.select(*rest, F.size(w).cast("long").alias("n_words"), F.array().cast("array<int>").alias("base_starts"), none.alias("base_labels"), none.alias("labels"), F.lit(0.0).alias("score"))
    filed = postings(templates, word_spread(found, w, sorted({x for t in templates for x in t.words})))

    # Where the filed words stand in the document; rows without any skip the rest.
    quoted = ",".join(f"'{x}'" for x in sorted(filed))
    marked = F.expr(f"filter(transform(`{w}`, (x, k) -> named_struct('w', x, 'k', k)), p -> p.w IN ({quoted}))")
    empty = F.array().cast("array<struct<w:string,k:int>>")
    found = found.withColumn(near, F.when(F.arrays_overlap(w, _strings(sorted(filed))), marked).otherwise(empty))

    # A candidate is start * (number of templates) + template, proposed by two words.
    many = len(templates)
    index = F.create_map(*(c for x, at in sorted(filed.items()) for c in (F.lit(x), F.array(*(F.struct(F.lit(n).alias("n"), F.lit(k).alias("k")) for n, k in at)))))
    proposed = F.flatten(F.transform(near, lambda p: F.transform(F.element_at(index, p["w"]), lambda q: (p["k"] - q["k"]).cast("long") * many + q["n"])))
    agreed = _let(F.array_sort(proposed), lambda a: F.array_distinct(F.filter(a, lambda x, k: x == F.get(a, k - 1))))

    known = F.array(
        *(
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(t.base).alias("base"),
                F.lit(t.need).alias("need"),
                F.lit(float(t.worth)).alias("worth"),
                _strings(t.words).alias("words"),
                (F.array(*(_strings(words_of(k)) for k in t.keys)) if t.keys else F.array().cast("array<array<string>>")).alias("keys"),
            )
            for t in templates
        )
    )

    def place(code: Column, t: Column) -> Column:
        start = F.floor((code - F.pmod(code, F.lit(many))) / many).cast("int")
        size = F.size(t["words"])
        hits = F.size(F.filter(F.sequence(F.lit(0), size - 1), lambda k: F.get(F.col(w), start + k) == F.get(t["words"], k)))
        around = F.sequence(F.greatest(start - slack, F.lit(0)), F.greatest(start + size + slack - 1, F.lit(0)))
        keys = F.forall(t["keys"], lambda key: F.exists(around, lambda k: F.slice(F.col(w), k + 1, F.size(key)) == key))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), start.alias("start"), (hits / size * t["worth"]).alias("score"), ((hits >= t["need"]) & keys).alias("ok"))

    judged = F.transform(agreed, lambda code: _let(F.get(known, F.pmod(code, F.lit(many)).cast("int")), lambda t: place(code, t)))
    none = F.array().cast("array<struct<label:string,base:boolean,start:int,score:double,ok:boolean>>")
    found = found.withColumn(finds, F.when(F.size(near) > 0, F.filter(judged, lambda x: x["ok"])).otherwise(none))

    base = F.filter(F.col(finds), lambda x: x["base"])
    labels = lambda of: F.array_sort(F.array_distinct(F.transform(of, lambda x: x["label"])))
    return found.select(
        *rest,
        F.size(w).cast("long").alias("n_words"),
        F.array_sort(F.transform(base, lambda x: x["start"])).alias("base_starts"),
        labels(base).alias("base_labels"),
        labels(F.col(finds)).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.col(finds), lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )
