import random
import re
import time

import pyarrow as pa
import pytest

from speechframe import schema as S
from speechframe.operators import dictionary as D
from speechframe.operators import matching as M

DICT = "section string, correct string, correct_ord int, wrong string, wrong_ord int"


def by_pattern(text, lookup, skip=S.HEADER):
    """(text, hits) by one alternation, longest form first."""
    hits = {}
    forms = "|".join(re.escape(w) for w in sorted(lookup, key=lambda w: (-len(w), w)))

    def fix(m):
        if m.group(0) in lookup and not (skip and re.compile(skip, re.ASCII).match(text, m.start())):
            hits[lookup[m.group(0)]] = hits.get(lookup[m.group(0)], 0) + 1
            return lookup[m.group(0)]
        return m.group(0)

    return re.sub(f"(?:{skip})|{forms}" if skip else forms, fix, text, flags=re.ASCII), hits


def counted(text, forms):
    return {f: text.count(f) for f in forms if f in text}


def made(rng, n, alphabet="abก้*[]: 01๐🎉"):
    forms = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(n)}
    texts = ["".join(rng.choice([*alphabet, "**ab** [00:01]:", "**", "[1:23]:", *sorted(forms)[:9]]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    return {f: f"<{i % 7}>" for i, f in enumerate(sorted(forms))}, texts


@pytest.mark.parametrize("shard_chars", [10**6, 40])
def test_equals_one_alternation(spark, monkeypatch, shard_chars):
    monkeypatch.setattr(M, "SHARD_CHARS", shard_chars)
    rng = random.Random(4)
    for n in (1, 30, 70):
        lookup, texts = made(rng, n)
        d = spark.createDataFrame([("exact", c, i, w, i) for i, (w, c) in enumerate(lookup.items())], DICT)
        docs = spark.createDataFrame([*enumerate(texts), (999, None), (5, "")], "doc_id int, text string").selectExpr("*", "'x' AS wrong", "1 AS term")
        fixed, counts = D.apply_exact(docs, d, "doc_id")
        want = {i: by_pattern(t, lookup) for i, t in enumerate(texts)}
        got = {(r.doc_id, r.text) for r in fixed.collect()}
        assert got == {(i, t) for i, (t, _) in want.items()} | {(999, None), (5, "")}
        assert {(r.doc_id, r.term): r.n for r in counts.collect()} == {(i, c): k for i, (_, hits) in want.items() for c, k in hits.items()}
        tally = {r.wrong: (r.hits, r.meetings) for r in D.count_in_transcripts(d, docs).collect()}
        each = [counted(t, lookup) for t in texts]
        assert tally == {w: (sum(e.get(w, 0) for e in each), sum(w in e for e in each)) for w in lookup}


def test_sampled_contexts(spark):
    docs = spark.createDataFrame([(1, "aa aaa\nb aa"), (2, "aa"), (3, None), (0, "x" * 40 + "b" + "y" * 40)], "doc_id int, text string")
    d = spark.createDataFrame([("exact", "A", 1, "aa", 1), ("aliases", "B", 2, "b", 1), ("fuzzy", "X", 3, "x", 1)], DICT)
    rows = {(r.wrong, r.example): (r.doc_id, r.pos, r.snippet) for r in D.sample_context(d, docs, "doc_id", 2, 3).collect()}
    assert rows == {("aa", 1): (1, 0, "aa aa"), ("aa", 2): (1, 3, "aa aaa b"), ("b", 1): (0, 40, "xxxbyyy"), ("b", 2): (1, 7, "aa b aa")}


def test_empty_and_odd_dictionaries(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id int, text string")
    none = spark.createDataFrame([], DICT)
    assert D.apply_exact(docs, none, "doc_id")[0].first().text == "abc" and D.count_in_transcripts(none, docs).count() == 0
    odd = spark.createDataFrame([("exact", None, 1, "b", 1), ("exact", "C", 1, None, 1), ("exact", "E", 1, "", 1)], DICT)
    assert D.apply_exact(docs, odd, "doc_id")[0].first().text is not None
    assert D.find_collisions(none).count() == 0 and D.apply_exact(docs.limit(0), odd, "doc_id")[0].count() == 0


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(9)
    forms = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 14))) for _ in range(210_000)})[:200_000]
    texts = [" ".join(rng.choice(forms) + rng.choice(("", "x", "ab")) for _ in range(150)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8).cache()
    docs.count()
    return forms, texts, docs


def dictionary_of(spark, forms):
    return spark.createDataFrame([("exact", w.upper(), i, w, 1) for i, w in enumerate(forms)], DICT).cache()


def test_two_hundred_thousand_forms(spark, many):
    forms, texts, docs = many
    lookup = {w: w.upper() for w in forms}

    def brute(text):
        out, at = [], 0
        while at < len(text):
            size = next((n for n in range(14, 4, -1) if text[at : at + n] in lookup and at + n <= len(text)), 0)
            out.append(lookup[text[at : at + size]] if size else text[at])
            at += size or 1
        return "".join(out)

    fixed = {r.doc_id: r.text for r in D.apply_exact(docs, dictionary_of(spark, forms), "doc_id")[0].collect()}
    assert all(fixed[i] == brute(t) for i, t in enumerate(texts))


def test_time_of_a_text_does_not_grow_with_the_forms(many):
    forms, texts, _ = many
    took = {}
    for n in (2_000, 200_000):
        shard = (f"t{n}", type("B", (), {"value": [(w, w) for w in forms[:: len(forms) // n]]})())
        M.longest_at(shard, "")
        began = time.process_time()
        for text in texts:
            M.longest_at(shard, text)
        took[n] = time.process_time() - began
    assert took[200_000] < 20 * took[2_000] + 0.5, took  # a hundred times the forms; more hits, slower memory


def test_few_rows_of_a_batch_are_python_objects_at_a_time():
    from speechframe.operators import matching

    most = []

    class Column(list):
        def slice(self, at, n):
            most.append(n)
            return pa.array(list(self)[at : at + n])

    run = matching._mapped(lambda t: [{"wrong": t, "n": 1}], matching._COUNTS).func
    got = run(Column(str(i) for i in range(1000)))
    assert [r[0]["wrong"] for r in got.to_pylist()] == [str(i) for i in range(1000)] and max(most) == matching.SLICE_ROWS and len(run(Column())) == 0
