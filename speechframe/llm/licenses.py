"""License scans: exact set-similarity join of text blocks with license templates.

A block is a window of the whole text, so that a statement that wraps over lines stands in one as well.
Templates are sorted into classes by their lengths, four classes an octave; the windows of a class of c words
begin at every step of c / 4 words and are so long that any c + step consecutive words stand in one. A short
statement is thus looked for in little more than its own words. Tokens are ordered by how often they occur in
the whole corpus, rarest first. A block that holds at least a share t of a template's n tokens shares
o = ceil(t * n) of them, so it holds one of the template's n - o + 1 rarest (prefix filter): only windows
around such tokens are built. It needs o tokens of its own (length filter); and the tokens that follow the
first shared one must suffice on both sides (positional filter). What is left is counted exactly.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import WORD, row_key, written
from speechframe.llm.words import words

#: Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Wordings of public licenses and the notices that they ask for, as their authors publish them.
#: Label to statement, of any length.
TEMPLATES = {
    "agpl": "under the terms of the GNU Affero General Public License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "bsd-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by": "licensed under CC BY 4.0",
    "cc-by-nc": "licensed under CC BY-NC 4.0",
    "cc-by-sa": "licensed under CC BY-SA 4.0",
    "cc-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "waived all copyright and related or neighboring rights to this work",
    "gpl": "This work is licensed under the GNU General Public License version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl": "under the terms of the GNU Lesser General Public License",
    "mit": "released under the MIT license",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    "mit-licensed": "licensed under the MIT license",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
}
#: Identifiers of the lines that name a license in source files.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()
TEMPLATES |= {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in SPDX}


def tokens_of(statement: str) -> list[str]:
    return re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in statement))


def class_of(statement: str) -> int:
    """The words of the statement's class: their number, above 8 rounded up so that an octave has four classes."""
    n = max(len(tokens_of(statement)), 1)
    unit = 1 << max(0, (n - 1).bit_length() - 3)
    return -(-n // unit) * unit


def windows_of(size: int) -> tuple[int, int]:
    """step, length of a class's windows: any size + step consecutive words stand in one."""
    step = max(1, size // 4)
    return step, size + 2 * step - 1


def _corpus_order(kept: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words, rarest in the corpus first, ties by word; kept has the documents' words as ids, places in the vocabulary from 1."""
    found = kept.select(F.explode(F.filter("ids", lambda i: i > 0)).alias("id"))
    n = {vocabulary[row["id"] - 1]: row["count"] for row in found.groupBy("id").count().collect()}  # a row for each template word at most
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _places(w: Column, phrase: str) -> Column:
    """The positions at which the phrase's words stand consecutively."""
    first, *others = phrase.split()
    last = F.size(w) - 1 - len(others)

    def here(i: Column) -> Column:
        same = F.get(w, i) == F.lit(first)
        for k, part in enumerate(others, 1):
            same = same & (F.get(w, i + k) == F.lit(part))
        return same

    could = (last >= 0) & F.array_contains(w, first)
    return F.when(could, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _windows(anchors: Column, w: Column, step: int, length: int) -> Column:
    """The words of the windows that hold one of the anchors (places in w, from 0)."""
    last = F.greatest(F.lit(0), F.ceil((F.size(w) - length) / step).cast("int"))
    first = lambda i: F.greatest(F.lit(0), F.ceil((i - length + 1) / step).cast("int"))
    starts = F.array_distinct(F.flatten(F.transform(anchors, lambda i: F.sequence(first(i), F.least(last, F.floor(i / step).cast("int"))))))
    return F.transform(starts, lambda k: F.slice(w, k * step + 1, length))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """Per document row: doc_id, n_words, places of the phrases (sorted array, words from 0), base_labels and labels
    (sorted arrays), blocks (array of template label, words of the block's template tokens shared, score) and score
    (the highest containment of a template in a block; 0 where none meets the threshold).

    The templates are a parameter of bounded size, each of any length; the text side is never collected or broadcast.
    Null and empty texts have no words, labels or places; very long texts have as many different blocks as their words ask for, in
    one row; repeated rows each get a row; an empty table stays empty; other columns are ignored.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    vocabulary = sorted({w for text in templates.values() for w in tokens_of(text)})
    split = docs.select("doc_id", row_key().alias("row"), words(F.col("text")).alias("w"))
    # words are made once: what is read again is their places in the vocabulary, 0 for others, null where no word is of it
    ids = F.transform("w", lambda x: F.when(x.isin(vocabulary), F.array_position(F.lit(vocabulary), x).cast("int")).otherwise(0))
    named = [F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]
    kept = split.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), *[_places(F.col("w"), p).alias(f"p{i}") for i, p in enumerate(phrases)], F.when(F.arrays_overlap("w", F.lit(vocabulary)), ids).alias("ids"))
    places, base_labels = F.array_sort(F.flatten(F.array(*[f"p{i}" for i in range(len(phrases))]))), F.array_sort(F.array_distinct(F.array_compact(F.array(*named))))
    kept = written(kept.select("doc_id", "row", "n_words", places.alias("places"), base_labels.alias("base_labels"), "ids"), "license-words")
    order = _corpus_order(kept, vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    spec = []
    for label, text in sorted(templates.items()):
        tokens = sorted({rank[w] for w in tokens_of(text)})
        need = math.ceil(threshold * len(tokens) - 1e-9)
        spec += [(token, class_of(text), label, at, tokens, need) for at, token in enumerate(tokens[: len(tokens) - need + 1])]
    table = docs.sparkSession.createDataFrame(spec, "token int, size int, template string, at_template int, tokens array<int>, need int")

    # a block as the ranks of its template words, rarest first; only windows that hold a prefix token of their class
    ranked = F.transform("ids", lambda i: F.when(i > 0, F.element_at(F.lit([rank[w] for w in vocabulary]), i)).otherwise(-1))
    anchored = F.filter(F.transform("w", lambda x, i: F.when(x.isin(sorted({row[0] for row in spec})), F.struct(i.alias("i"), x.alias("x")))), lambda a: a.isNotNull())

    def blocks(size: int) -> Column:
        mine = [row for row in spec if row[1] == size]
        anchors = F.transform(F.filter("found", lambda a: a["x"].isin(sorted({row[0] for row in mine}))), lambda a: a["i"])
        tokens = F.lit(sorted({r for row in mine for r in row[4]}))
        # as strings, of which equal ones are found by hash
        each = F.array_distinct(F.transform(_windows(anchors, F.col("w"), *windows_of(size)), lambda b: F.array_join(F.array_sort(F.array_intersect(b, tokens)).cast("array<string>"), ",")))
        return F.transform(each, lambda b: F.struct(F.lit(size).alias("size"), F.split(b, ",").cast("array<int>").alias("block")))

    held = F.concat(*[blocks(size) for size in sorted({row[1] for row in spec})])
    none = F.array().cast("array<struct<size:int,block:array<int>>>")
    base = kept.withColumn("w", ranked).withColumn("found", anchored).select("doc_id", "row", "n_words", "places", "base_labels", F.when(F.size("found") > 0, held).otherwise(none).alias("held"))
    # a first row for the document itself, then one for each token of each of its blocks
    itself = F.array(F.struct(F.lit(0).alias("size"), F.array().cast("array<int>").alias("block")))
    each = base.withColumn("one", F.explode(F.concat(itself, "held"))).drop("held").select("*", "one.*").drop("one")
    each = each.select("*", F.posexplode(F.when(F.size("block") > 0, F.col("block")).otherwise(F.array(F.lit(-1)))).alias("at_block", "token"))
    joined = each.join(F.broadcast(table), ["token", "size"], "left")
    follow = F.least(F.size("tokens") - F.col("at_template"), F.size("block") - F.col("at_block"))
    shared = F.when((F.size("block") >= F.col("need")) & (follow >= F.col("need")), F.size(F.array_intersect("block", "tokens")))
    hit = F.when(shared >= F.col("need"), F.struct(F.col("template"), (shared / F.size("tokens")).alias("score")))
    scored = joined.select("doc_id", "row", "n_words", "places", "base_labels", F.col("token").alias("token"), hit.alias("hit")).where((F.col("token") < 0) | F.col("hit").isNotNull())
    grouped = scored.groupBy("doc_id", "row", "n_words", "places", "base_labels").agg(F.count_if(F.col("token") < 0).cast("int").alias("copies"), F.array_sort(F.collect_set("hit")).alias("hits"))
    out = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    labels = F.array_sort(F.array_union("base_labels", F.transform("hits", lambda h: h["template"])))
    return out.select("doc_id", "row", "n_words", "places", "base_labels", labels.alias("labels"), "hits", F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("score"))


def digest(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    found = scan(docs, phrases, templates)
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
