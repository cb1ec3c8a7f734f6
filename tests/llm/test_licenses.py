import math
import random
import re

from speechframe.llm import licenses
from tests.llm.test_decontaminate import words


def brute(docs, phrases=licenses.PHRASES, templates=licenses.TEMPLATES, threshold=0.9):
    out = []
    for doc, text in docs:
        w = words(text)
        places, base = [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += here
            base |= {label} if here else set()
        labels, score = set(base), 0.0
        for label, statement in templates.items():
            t, c = set(words(statement)), len(words(statement))
            while c > 8 and c % (1 << (c - 1).bit_length() - 3):  # four classes an octave
                c += 1
            step = max(1, c // 4)
            length = c + 2 * step - 1
            starts = [0]
            while starts[-1] + length < len(w):
                starts.append(starts[-1] + step)
            for i in starts:
                shared = len(t & set(w[i : i + length]))
                if shared >= math.ceil(threshold * len(t) - 1e-9):
                    labels.add(label)
                    score = max(score, shared / len(t))
        out.append((doc, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return sorted(out, key=str)


def run(spark, docs, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS labels", "1 AS w", "2 AS token")
    return sorted((tuple(r) for r in licenses.digest(d, **kw).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    tokens = sorted({w for t in licenses.TEMPLATES.values() for w in words(t)}) + ["É", "zebra", "CC", "By"]
    docs = []
    for i in range(150):
        parts = [" ".join(rng.choice(tokens) for _ in range(rng.choice([0, 3, 8, 120])))]
        if rng.random() < 0.7:
            statement = words(rng.choice(list(licenses.TEMPLATES.values())))
            if rng.random() < 0.5:
                statement[rng.randrange(len(statement))] = "other"
            parts.insert(rng.randint(0, 1), " ".join(statement).title())
        docs.append((i, rng.choice([" ", "\n", ". "]).join(parts)))
    docs += [(3, docs[3][1]), (None, "All Rights Reserved"), (500, None), (501, ""), (502, "cc-by cc by " * 2000), (503, "General, public\nLICENSE")]
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_statement_in_a_long_line_is_found(spark):
    line = " ".join(f"w{i}" for i in range(1000))
    text = re.sub("w500", "released under the MIT license", line)
    assert run(spark, [(1, text)])[0][6:] == ("mit", 1.0)


def test_statements_that_wrap_over_lines_are_found(spark):
    docs = [
        (1, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"),
        (2, "x\nLicensed under the Apache\nLicense, Version 2.0\ny"),
        (3, "This work is licensed under the\nGNU General Public License version 3"),
    ]
    assert [r[6:] for r in run(spark, docs)] == [("bsd", 1.0), ("apache-2.0", 1.0), ("gpl", 1.0)]


def test_scattered_words_are_no_statement(spark):
    docs = [(1, "the rights of all men were reserved"), (2, "All  rights\nreserved."), (3, "the mit press has released a license book under review"), (4, "rights all reserved")]
    assert [r[6:] for r in run(spark, docs)] == [("", 0.0), ("reserved", 1.0), ("", 0.0), ("reserved", 1.0)]


def test_notices_as_they_stand_in_files(spark):
    gpl = """# Copyright (C) 2020 A. Person
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""
    isc = """Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
    filler = "fn main() { let x = 1; }\n" * 200
    docs = [(1, gpl + "\n" + filler), (2, filler + isc + filler), (3, "// SPDX-License-Identifier: MIT\n" + filler), (4, "/* SPDX-License-Identifier: GPL-3.0-or-later */")]
    assert [r[6:] for r in run(spark, docs)] == [("gpl,gpl-notice,gpl-warranty", 1.0), ("isc", 1.0), ("spdx-mit", 1.0), ("spdx-gpl-3.0-or-later", 1.0)]


def test_a_very_long_text_of_rare_words_has_few_blocks(spark):
    docs = [(1, "reserved rights " * 100_000 + "all"), (2, "x")]
    assert run(spark, docs)[0][6:] == ("reserved", 1.0)


def test_templates_of_any_length(spark):
    rng = random.Random(6)
    long = {"long": " ".join(f"t{i}" for i in range(300)), "Mixed": "Some Words, here: ÉTÉ", "short": "a b c"}
    kept = [w for i, w in enumerate(long["long"].split()) if i % 20]
    filler = lambda n: " ".join(f"f{rng.randrange(500)}" for _ in range(n))
    docs = [(1, filler(700) + "\n" + " \n".join(kept) + filler(900)), (2, " ".join(kept[:250])), (3, f"{filler(30)} some WORDS here ÉTÉ"), (4, "c b\na"), (5, filler(100_000) + " " + long["long"])]
    assert run(spark, docs, templates=long) == brute(docs, templates=long)
    assert [r[6] for r in run(spark, docs, templates=long)] == ["long", "", "Mixed", "short", "long"]
