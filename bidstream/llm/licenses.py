"""License scans by a positional index of rare words.

Templates are notices and whole texts of licences. Of each template the index holds the words that are rarest in the
corpus, by their document frequency, with their places: a posting is a template and a place in it. A file looks up those
of its words that are in the index, its licence words of highest IDF. Each hit names templates, and where in the file each would have
to begin; the postings of a template are intersected by that, so at least two rare words have to agree on one beginning. There all of the
template's words are compared with the file's, weighed by IDF, and the key phrase has to stand whole.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.llm.common import documents, text_of

#: Words, in any case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Fixed by the contract: phrase, label.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Template, key phrase in it, label.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gnu general public license version 2", "gpl-2.0"),
    ("under the terms of the gnu lesser general public license", "gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mozilla public license", "mpl"),
    ("under the terms of the eclipse public license", "eclipse public license", "epl"),
    ("licensed under cc by 4 0", "cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc nd 4 0", "cc by nc nd 4 0", "cc-by-nc-nd-4.0"),
    ("licensed under the creative commons attribution license", "creative commons attribution", "cc-by"),
    ("released under the mit license", "the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "released into the public domain", "unlicense"),
    ("distributed under the boost software license version 1 0", "boost software license", "bsl-1.0"),
)


#: Whole texts, from their first sentence on.
TEXTS = (
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
    "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
    distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
    following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
    Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
    CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
    OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "permission is hereby granted free of charge", "mit"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
    above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
    WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
    SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
    OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
     "for any purpose with or without fee is hereby granted", "isc"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
    met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
    Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution.""", "redistributions of source code must retain the above copyright notice", "bsd-2-clause"),
    ("""Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
    contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
     "may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
    arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
    and to alter it and redistribute it freely, subject to the following restrictions""", "to alter it and redistribute it freely", "zlib"),
    ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
    distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
     "released into the public domain", "unlicense"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
    obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
    distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
     "you may not use this file except in compliance with the license", "apache-2.0"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", "either version 3 of the license", "gpl-3.0"),
    ("""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""", "either version 2 of the license", "gpl-2.0"),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
    file, You can obtain one at""", "mozilla public license v 2 0", "mpl-2.0"),
    ("""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
    covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software""",
     "use reproduce display distribute execute and transmit the software", "bsl-1.0"),
)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _small(w: Column) -> Column:
    return F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _is_one_of(w: Column, listed: list[str]) -> Column:
    """lower() is quick but knows capitals beyond A-Z as well, so what it lets pass is looked at again."""
    return F.lower(w).isin(listed) & _small(w).isin(listed)


def _hits(listed: list[str]) -> Column:
    """(p, w): where the listed word with number w, from 1, stands in `words`."""
    numbered = F.transform("words", lambda w, i: F.when(_is_one_of(w, listed), F.struct(i.alias("p"), w.alias("w"))))
    number = F.array(*map(F.lit, listed))
    return F.transform(F.filter(numbered, lambda x: x.isNotNull()), lambda x: F.struct(x["p"].alias("p"), F.array_position(number, _small(x["w"])).alias("w")))


def word_weights(docs: DataFrame, listed: list[str]) -> dict[str, float]:
    """The IDF of each listed word, over all documents."""
    words = F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))
    present = F.array_distinct(F.transform(F.filter("words", lambda w: _is_one_of(w, listed)), _small))
    counted = docs.select(words.alias("words")).select(F.explode(F.array_append(present, "")).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in counted.collect()}  # at most one row for each word, and one for all documents
    n = df.get("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in listed}


def find_licenses(docs: DataFrame, agree: float = 0.6, templates: tuple = TEMPLATES + TEXTS, rare: int = 6) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_words, places, base_labels, method_labels, score.

    places: sorted starts, in words, of the BASE phrases; a place where two phrases start counts twice. templates: (text, key
    phrase in it, label); the index holds the places of the `rare` rarest words of each. agree: the least share of a template's IDF
    that has to agree on one beginning; score is the largest such share of any template whose key phrase stands in the file,
    or 1 where a BASE phrase stands. Null and empty texts have no words and score 0; repeated rows, null ids and other columns
    are passed over as they are; an empty table gives no rows.
    """
    texts = [words_of(t) for t, *_ in templates]
    keys = []
    for text, (_, key, _) in zip(texts, templates, strict=True):
        key = words_of(key)
        keys.append((next(i for i in range(len(text)) if text[i : i + len(key)] == key), len(key)))
    base_words = sorted({w for phrase, _ in BASE for w in phrase.split()})
    idf = word_weights(docs, sorted({w for text in texts for w in text} | set(base_words)))
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, text in enumerate(texts):
        for w in sorted(set(text), key=lambda w: (-idf[w], w))[:rare]:
            postings.setdefault(w, []).extend((t, i) for i, x in enumerate(text) if x == w)
    indexed = sorted(postings)

    longs = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    index = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("at")) for t, i in postings[w]]) for w in indexed])
    held_words = F.array(*[F.array(*map(F.lit, text)) for text in texts])
    weights = F.array(*[F.array(*[F.lit(idf[w]) for w in text]) for text in texts])
    totals = F.array(*[F.lit(sum(idf[w] for w in text)) for text in texts])
    key_at, key_n = longs(a for a, _ in keys), longs(n for _, n in keys)
    needed = longs(min(2, sum(text.count(w) for w in indexed)) for text in texts)

    def begins(word: str, place: int) -> Column:
        """Where a text must begin for `word` to stand at `place` of it."""
        number = base_words.index(word) + 1
        return F.transform(F.filter("base_hits", lambda h: h["w"] == number), lambda h: h["p"] - place)

    def phrase(text: str) -> Column:
        """Where all words of a phrase stand together, from the rarest word on."""
        order = sorted(enumerate(text.split()), key=lambda x: -idf[x[1]])
        return reduce(F.array_intersect, [begins(w, i) for i, w in order])

    def held(text: str) -> Column:
        """Whether all words of a phrase are in the file at all; rarest first, so that most files fail at once."""
        return reduce(lambda x, y: x & y, [F.array_contains("present", base_words.index(w) + 1) for w in sorted(set(text.split()), key=lambda w: -idf[w])])

    same = lambda c, i: _small(F.get("words", c["b"] + i)) == F.get(F.get(held_words, c["t"]), i)
    named = F.flatten(F.transform("rare_hits", lambda h: F.transform(F.get(index, (h["w"] - 1).cast("int")), lambda q: F.struct(q["t"].alias("t"), (h["p"] - q["at"]).alias("b")))))
    # sorted, a beginning that two postings agree on stands beside itself
    meet = F.array_distinct(F.filter("named", lambda c, i: (F.get(needed, c["t"]) < 2) | (F.get("named", i + 1) == c)))
    key_stands = lambda c: F.forall(F.sequence(F.get(key_at, c["t"]), F.get(key_at, c["t"]) + F.get(key_n, c["t"]) - 1), lambda i: F.coalesce(same(c, i), F.lit(False)))
    share = lambda c: F.aggregate(
        F.sequence(F.lit(0), F.size(F.get(held_words, c["t"])) - 1), F.lit(0.0),
        lambda s, i: s + F.when(same(c, i), F.get(F.get(weights, c["t"]), i)).otherwise(F.lit(0.0)),
    ) / F.get(totals, c["t"])
    none = F.array().cast("array<int>")
    bases = [F.when(held(p), phrase(p)).otherwise(none).alias(f"b{i}") for i, (p, _) in enumerate(BASE)]
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"b{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    label = F.array(*[F.lit(x) for *_, x in templates])
    labels = F.transform(F.filter("shares", lambda x: x["share"] >= agree), lambda x: F.get(label, x["t"]))
    best = F.coalesce(F.array_max(F.transform("shares", lambda x: x["share"])), F.lit(0.0))
    return (
        docs.select("doc_id", F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0)).alias("words"))
        .select("doc_id", "words", _hits(base_words).alias("base_hits"), _hits(indexed).alias("rare_hits"))
        .withColumn("named", F.array_sort(named)).withColumn("present", F.array_distinct("base_hits.w"))
        .withColumn("meet", F.filter(meet, key_stands))
        .select(
            "doc_id", F.size("words").cast("long").alias("n_words"), *bases,
            F.transform("meet", lambda c: F.struct(c["t"].alias("t"), share(c).alias("share"))).alias("shares"),
        )
        .select(
            "doc_id", "n_words", F.sort_array(F.concat(*[f"b{i}" for i in range(len(BASE))])).alias("places"),
            F.sort_array(F.array_distinct(base_labels)).alias("base_labels"), F.sort_array(F.array_distinct(labels)).alias("method_labels"),
            F.when(F.size(base_labels) > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), best)).alias("score"),
        )
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.sort_array(F.array_union("base_labels", "method_labels"))
    return find_licenses(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.get("places", 0).cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), "score",
    )
