import hashlib
import random
import re

from speechframe.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(A_Z))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for window, owners in windows.items():
            n = len(window)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    hit.update(range(i, i + n))
                    found |= owners
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS n_words", "1 AS word")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS window")
    return sorted((tuple(r) for r in decontaminate.digest(d, b).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["a", "b", "The", "É", "é", "x1", "日本", "of"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(20)] + [(3, text(14)), (None, text(12)), (77, None)]
    docs = [(i, text(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "")) for i in range(80)]
    docs += [(5, docs[5][1]), (6, "other text"), (None, docs[9][1]), (900, None), (901, ""), (902, " ".join(["The"] * 3000) + " " + items[8][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c"), (2, None)], []) == brute([(1, "a b c"), (2, None)], [])


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = [(1, "one two three four"), (2, "two three"), (3, None)]
    items = [(1, "Two three"), (2, "four")]
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert run(spark, docs, items) == brute(docs, items)


def test_clean_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "q one two three q", "s"), (1, "clean", "s"), (2, None, None), (None, "one two three", "t")], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    left = decontaminate.clean_documents(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, docs.where("text = 'clean' OR text IS NULL").collect()))
