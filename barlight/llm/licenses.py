"""License scans by a positional rare-token index.

The index maps the words with the highest inverse document frequency among the licence templates to their (template, position)
postings. A file's own occurrences of these words look up the postings; each gives a template and the place at which it would start.
Postings that differ and agree on about one place count with their words' IDF, each once. Where they make up enough of a template, and its mandatory
key phrases occur, the file carries that template. Plain names of licences are found by the base rule beside it.
Built from DataFrame functions alone: no Python runs on the executors.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of the base rule and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Passages of public licence notices, and phrases without which a passage doesn't count.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("free of charge", "without restriction"),
    ),
    "apache": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ("in compliance with the license", "required by applicable law"),
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license", "free software foundation"),
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ("lesser general public license",),
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice",
        ("source and binary forms", "following conditions are met"),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee", "appear in all copies"),
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("mozilla public license",),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("unencumbered software", "public domain"),
    ),
    "cc-by": (
        "this work is licensed under the creative commons attribution international license to view a copy of this license visit creativecommons org or send a letter to creative commons mountain view california",
        ("creative commons attribution",),
    ),
}

#: Words of so many templates or fewer are in the index.
MOST_TEMPLATES = 2
#: The share of the weight of a template's postings that must agree on one place.
AGREE = 0.6
#: Places agree that lie in one of the cells of SPREAD words, or in one of those half a cell further on: copies have words put in or left out,
#: and half a cell of them never parts what belongs together.
SPREAD = 24
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Added to places, as a template may be cut off before its start; whole cells, so that one begins at place 0.
ORIGIN = 10_000 * SPREAD


@dataclass
class Index:
    """posts: word -> (template, position, number) postings of the words with the highest IDF; weights: of the postings by number; totals: of the
    templates; fewest: different words without which no template's share can be met.
    """

    posts: dict[str, list[tuple[int, int, int]]]
    weights: list[float]
    totals: list[float]
    fewest: int = 1


def index(templates=None, most: int = MOST_TEMPLATES) -> Index:
    texts = [t.split() for t, _ in (templates or TEMPLATES).values()]
    df = Counter(w for t in texts for w in set(t))
    out = Index(defaultdict(list), [], [0.0] * len(texts))
    for k, t in enumerate(texts):
        for i, w in enumerate(t):
            if df[w] <= most:
                idf = log((1 + len(texts)) / df[w])
                out.posts[w].append((k, i, len(out.weights)))
                out.weights.append(idf)
                out.totals[k] += idf
    heaviest: list[float] = [1.0] * len(texts)
    for posts in out.posts.values():
        for k in {k for k, _, _ in posts}:
            heaviest[k] = max(heaviest[k], sum(out.weights[n] for t, _, n in posts if t == k))
    out.fewest = max(1, min((int(AGREE * total / most) for total, most in zip(out.totals, heaviest, strict=True)), default=1))
    return out


def _ends_here(phrase: list[str]):
    def stands(i: Column) -> Column:
        good = F.get("words", i) == phrase[-1]
        for back, w in enumerate(reversed(phrase[:-1]), 1):
            good = good & (i >= back) & F.coalesce(F.get("words", i - back) == w, F.lit(False))
        return good

    return stands


def _start_of(phrase: list[str]):
    return lambda i: i - (len(phrase) - 1)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates=None) -> DataFrame:
    """Licence phrases and templates in every whole text.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Returns doc_id, n_words, n_base (places of the base
    phrases), first_word and last_word (smallest and largest start of a place, in words from 0; null if none),
    base_labels, labels (with those of the templates; sorted and joined by commas, empty if none) and score: 1 with
    a base place, else the largest share of a verified template's weight that agrees on one place, else 0.
    A null text counts as empty. Repeated rows are scanned alike. An empty table gives no rows. Further columns are ignored.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    found = index(templates)
    names, rare = list(templates), sorted(found.posts)
    words = F.filter(F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")
    need = [AGREE * total for total in found.totals]
    rows = docs.select(F.col(key).alias("doc_id"), words.alias("words")).withColumn("n_words", F.size("words").cast("long"))

    def places(is_word) -> Column:
        """Positions of the words that the condition holds for; asked for only where there are some."""
        return F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: is_word(F.get("words", i)))

    none = F.array().cast("array<int>")
    last = {p.split()[-1] for p in phrases}
    ends = F.when(F.arrays_overlap("words", F.array(*map(F.lit, sorted(last)))), places(lambda w: w.isin(sorted(last)))).otherwise(none)
    rows = rows.withColumn("ends", ends)
    for k, phrase in enumerate(phrases):
        p = phrase.split()

        starts = F.transform(F.filter("ends", _ends_here(p)), _start_of(p))
        rows = rows.withColumn(f"p{k}", F.when(F.size("ends") > 0, starts).otherwise(none))
    # each occurrence of a rare word votes with its postings for cells of places, a posting once for a cell
    table = F.create_map(*[x for w in rare for x in (F.lit(w), F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(i).alias("i"), F.lit(n).alias("n")) for t, i, n in found.posts[w]]))])

    def cells(place: Column, post: Column) -> Column:
        cell = lambda half: F.floor((place - post["i"] + ORIGIN + half * (SPREAD // 2)) / SPREAD) * 2 + half
        return F.array(*[F.shiftleft(F.shiftleft(post["t"], 32) + cell(half), 16) + post["n"] for half in (0, 1)])

    lookup = F.flatten(F.flatten(F.transform(places(lambda w: w.isin(rare)), lambda i: F.transform(F.element_at(table, F.get("words", i)), lambda p: cells(i, p)))))
    several = F.size(F.array_intersect("words", F.array(*map(F.lit, rare)))) >= found.fewest
    rows = rows.withColumn("votes", F.when(several, F.array_sort(F.array_distinct(lookup))))
    # the votes of a cell stand side by side: add up their weights, and keep the heaviest cell of each template
    zero = F.struct(F.lit(-1).cast("long").alias("cell"), F.lit(0.0).alias("sum"), F.array(*[F.lit(0.0)] * len(names)).alias("best"))
    weights = F.array(*map(F.lit, found.weights))

    def step(a: Column, v: Column) -> Column:
        cell, weight = F.shiftright(v, 16), F.get(weights, v.bitwiseAND(F.lit(0xFFFF)).cast("int"))
        total = F.when(cell == a["cell"], a["sum"] + weight).otherwise(weight)
        t = F.shiftright(v, 48).cast("int")
        more = F.when(total > F.get(a["best"], t), F.transform(a["best"], lambda b, k: F.when(k == t, total).otherwise(b))).otherwise(a["best"])
        return F.struct(cell.alias("cell"), total.alias("sum"), more.alias("best"))

    rows = rows.withColumn("best", F.when(F.size("votes") >= found.fewest, F.aggregate("votes", zero, step, lambda a: a["best"])))
    agreed = F.coalesce(sum(((F.get("best", F.lit(k)) >= need[k]).cast("int") for k in range(len(names))), F.lit(0)), F.lit(0)) > 0
    rows = rows.withColumn("joined", F.when(agreed, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
    verified = []
    for k, name in enumerate(names):
        good = F.get("best", F.lit(k)) >= need[k]
        for phrase in templates[name][1]:
            good = good & F.contains("joined", F.lit(f" {phrase} "))
        verified.append((name, F.coalesce(good, F.lit(False)), F.least(F.lit(1.0), F.get("best", F.lit(k)) / F.lit(found.totals[k]))))
    starts = [F.col(f"p{k}") for k in range(len(phrases))]
    every = F.concat(*starts)
    base = [F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(starts, phrases.values(), strict=True)]
    more = [F.when(good, F.lit(name)) for name, good, _ in verified]
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    share = F.greatest(F.lit(0.0), *[F.when(good, s).otherwise(0.0) for _, good, s in verified])
    return rows.select("doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), join(base).alias("base_labels"), join([*base, *more]).alias("labels"), F.when(F.size(every) > 0, 1.0).otherwise(share).alias("score"))
