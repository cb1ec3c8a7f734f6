import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from speechframe.llm import importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return len(words), [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent, least, buckets, longest):
    """(id, n_features, weight, score, rank) of (id, text) rows."""
    parsed = [(i, *features(t, longest)) for i, t in docs]
    s, t = (Counter(crc32(f) % buckets for fs in texts for f in fs) for texts in ([p[2] for p in parsed], [features(x, longest)[1] for x in target]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + float(buckets)) / ((s[b] + 1.0) * (all_t + float(buckets))))) for b in s}
    scored = []
    for i, n, fs in parsed:
        weight = sum(gain[crc32(f) % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = order[: len(order) * percent // 100]
    out = [(r[0], r[2], r[3], r[4], None) for r in scored]
    for rank, r in enumerate(drawn, 1):
        out[out.index((r[0], r[2], r[3], r[4], None))] = (r[0], r[2], r[3], r[4], rank)
    return sorted(out, key=str)


def run(spark, docs, target, percent=10, least=20, buckets=10_000, longest=1):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS own", "2 AS rank", "3 AS bucket", "4 AS score").repartition(3)
    aimed = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    return sorted((tuple(r) for r in importance.resample(df, aimed, percent, least, buckets, longest).collect()), key=str)


DOCS = [(i, " ".join(f"w{(i * j) % 97}" for j in range(3 + i % 40)) + (" Énd, THE the" if i % 3 else "")) for i in range(1, 120)]
DOCS += [(200, None), (201, ""), (202, " .,!"), (203, "x" * 200_000), (204, "the " * 50_000), (205, "日本 語 " * 30), (None, "a b " * 12), (None, None), (7, "w1 w2 w3 " * 9), (7, "w1 w2 w3 " * 9), (7, "w1 w2 w3 " * 9)]
TARGET = ["the w1 w2", "The w5, w5 énd", None, "", "w96 " * 400]


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (2, 50, 50), (3, 1000, 100)])
def test_equals_brute_force(spark, longest, buckets, percent):
    assert run(spark, DOCS, TARGET, percent, 20, buckets, longest) == brute(DOCS, TARGET, percent, 20, buckets, longest)


def test_small_blocks_and_split_buckets(spark, monkeypatch):
    for name, value in (("BLOCK_POSTINGS", 40), ("BLOCK_DOCS", 7), ("BLOCKS_PER_DEAL", 2), ("MAX_MEMO", 5)):
        monkeypatch.setattr(importance, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert run(spark, DOCS, TARGET, 30, 5) == brute(DOCS, TARGET, 30, 5, 10_000, 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_tables(spark):
    assert run(spark, [], TARGET) == []
    assert run(spark, DOCS[:5], []) == brute(DOCS[:5], [], 10, 20, 10_000, 1)
    assert run(spark, [(1, None)], [None]) == [(1, 0, 0, brute([(1, None)], [], 10, 20, 10_000, 1)[0][3], None)]


def test_likeness_shows_in_the_draw(spark):
    docs = [(i, "target words here again " * 6 if i % 10 == 0 else "something else all along " * 6) for i in range(1000)]
    df, aimed = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("target words here again " * 50,)], "text string")
    drawn = importance.drawn(df, aimed, percent=10)
    assert drawn.count() == 100 and drawn.where("doc_id % 10 = 0").count() > 60
