"""Licence scans by a positional index of rare words, with DataFrame functions only.

Document frequencies of all template words are counted over the whole table. Each template is indexed by the KEYS words
of highest IDF of its mandatory phrase, with their places. A file's words are looked up there; each posting proposes the
place where the template would start, the postings of one template are intersected by that place, and a proposal counts if
the whole mandatory phrase stands where it should and `share` of all template words do. As a mandatory phrase must stand
whole, its rarest words are in every file that has it, so the index misses nothing. The base phrases are templates that
are mandatory as a whole; their places are the verified proposals.

Edge cases: null texts are empty and have no words, labels or places, and score 0; overlapping places all count; a template
may begin before the text does if its mandatory phrase is whole; rows that repeat a doc_id and rows with a null one are
scanned each for itself; an empty table gives an empty result; extra columns are ignored; labels in a tie of score all stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import words

#: Phrases and their labels. A caller may name others as base; these then still give labels.
BASE = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, template words, mandatory phrase. The texts are the public wordings of the licences' notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "be used to endorse or promote products derived from this software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed under the license is distributed on an as is basis"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "terms of the mozilla public license"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl was not distributed with this file"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "terms of the eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("bsl-1", "boost software license version 1 0", "boost software license"),
    ("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to public license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("proprietary", "all rights reserved", "all rights reserved"),
]
KEYS = 2


def _offset(template: str, phrase: str) -> int:
    """The word of the template at which its phrase begins."""
    return f" {template} ".split(f" {phrase} ")[0].count(" ")


def _stands(listed: Column, at: Column, phrase: list[str]) -> Column:
    """How many of the phrase's words stand at their place from word `at` on; places before the text hold none."""
    same = lambda w, i: F.coalesce((at + i >= 0) & (F.get(listed, at + i) == w), F.lit(False)).cast("int")
    return F.aggregate(F.transform(F.array(*map(F.lit, phrase)), same), F.lit(0), lambda x, y: x + y)


def scan(docs: DataFrame, share: float = 0.8, base: dict[str, str] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best share of a template's words)."""
    tokens = docs.select("doc_id", words(F.col("text")).alias("words"))
    templates = TEMPLATES + [(label, phrase, phrase) for phrase, label in BASE.items() if phrase not in base]
    wanted = [(label, phrase, phrase) for phrase, label in base.items()] + templates
    vocabulary = F.array(*map(F.lit, sorted({w for _, _, must in wanted for w in must.split()})))
    known = tokens.select(F.explode(F.array_intersect(vocabulary, "words")).alias("w"))
    counts = {r["w"]: r["n"] for r in known.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a template word

    index = []  # for each template its rarest mandatory words, each with its places in the template
    for _, template, must in wanted:
        listed, begin = template.split(), _offset(template, must)
        there = listed[begin : begin + len(must.split())]
        keys = sorted(set(there), key=lambda w: (counts.get(w, 0), w))[:KEYS]
        index.append({w: [begin + i for i, x in enumerate(there) if x == w] for w in keys})

    rare = F.array(*map(F.lit, sorted({w for keys in index for w in keys})))
    at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(rare, x["w"]))
    looked = tokens.select("doc_id", "words", F.when(F.arrays_overlap("words", rare), at).alias("at"))

    def starts(keys: dict[str, list[int]]) -> Column:
        """Places at which all of a template's keys say that it starts."""
        mine = lambda word: F.transform(F.filter("at", lambda x: x["w"] == word), lambda x: x["i"])
        less = lambda places, o: F.transform(places, lambda i: i - F.lit(o))
        said = [F.flatten(F.array(*[less(mine(word), o) for o in places])) for word, places in keys.items()]
        return reduce(F.array_intersect, said)

    def verified(template: str, must: str, keys: dict[str, list[int]]) -> Column:
        """(s, share) of the proposals at which the mandatory phrase stands."""
        phrase, full, begin = must.split(), template.split(), _offset(template, must)
        whole = F.filter(starts(keys), lambda s: _stands(F.col("words"), s + begin, phrase) == len(phrase))
        return F.transform(whole, lambda s: F.struct(s.alias("s"), (F.lit(1.0) if full == phrase else _stands(F.col("words"), s, full) / F.lit(len(full))).alias("share")))

    fixed, other = index[: len(base)], index[len(base) :]
    found = looked.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.array(*[F.struct(F.lit(label).alias("label"), verified(phrase, phrase, keys)["s"].alias("at")) for (phrase, label), keys in zip(base.items(), fixed, strict=True)]).alias("base"),
        F.filter(F.array(*[F.struct(F.lit(label).alias("label"), F.array_max(verified(t, must, keys)["share"]).alias("share")) for (label, t, must), keys in zip(templates, other, strict=True)]), lambda x: x["share"] >= share).alias("more"))
    places = F.array_compact(F.flatten(F.transform("base", lambda b: F.coalesce(b["at"], F.array().cast("array<int>")))))
    held = found.select("*", places.alias("places"), F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"]).alias("b"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return held.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
        joined(F.col("b")).alias("base_labels"), joined(F.concat("b", "more.label")).alias("labels"),
        F.when(F.size("b") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("more.share"), F.lit(0.0))).alias("score"))
