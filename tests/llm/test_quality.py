import random

import numpy as np
from pyspark.sql import functions as F

from speechframe.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=1200, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("th", "er", "on", "an", "re") for b in ("ing", "ed", "ly", "tion", "st", "and")]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        kind = rng.random()
        quality_, toxic = 1, 0
        if kind < 0.15:
            words, quality_ = [w.upper() + "!!" for w in words], 0
        elif kind < 0.3:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scum"])
            toxic = 1
        docs.append((i, " ".join(words), rng.choice(["en", "fr"]), f"s{rng.randint(0, 9)}"))
        labels.append((i, quality_, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    rows = quality.quality_scores(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels[:700], LABELS)).collect()
    want = {d: bool(q and not t) for d, q, t in labels}
    held_out = [r.keep == want[r.doc_id] for r in rows if r.doc_id >= 700]
    assert len(rows) == len(docs) and np.mean(held_out) > 0.97


def test_rates_equal_brute_force(spark):
    docs, labels = corpus(300)
    frame, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels[:200], LABELS)
    rows = {r.doc_id: r for r in quality.quality_scores(frame, known).collect()}
    label = {d: float(q and not t) for d, q, t in labels[:200]}
    y = {d: label.get(d, rows[d].evidence) for d, *_ in docs}
    groups = {}
    for d, _, lang, source in docs:
        groups.setdefault(source, {}).setdefault(lang, []).append(y[d])
    rate = np.mean(list(y.values()))
    strength = lambda sets: min(1e4, max(2.0, c / max(sum(n * (s / n - p) ** 2 for n, s, p in sets) / t - c, 1e-9))) if (t := sum(n for n, _, _ in sets)) and (c := sum(n * p * (1 - p) for n, _, p in sets) / t) else 1e4
    hosts = {h: (sum(map(len, p.values())), sum(map(sum, p.values()))) for h, p in groups.items()}
    m_host = strength([(n, s, rate) for n, s in hosts.values()])
    means = {h: (s + m_host * rate) / (n + m_host) for h, (n, s) in hosts.items()}
    m_path = strength([(len(v), sum(v), means[h]) for h, p in groups.items() for v in p.values()])
    for d, _, lang, source in docs:
        n, s = hosts[source]
        host = (s - y[d] + m_host * rate) / (n - 1 + m_host)
        v = groups[source][lang]
        path = (sum(v) - y[d] + m_path * host) / (len(v) - 1 + m_path)
        odds = np.log(rows[d].evidence / (1 - rows[d].evidence)) - np.log(rate / (1 - rate)) + np.log(path / (1 - path))
        assert np.isclose(rows[d].host_rate, host) and np.isclose(rows[d].path_rate, path) and np.isclose(rows[d].score, 1 / (1 + np.exp(-odds)))


def test_a_bad_host_lowers_its_documents_and_a_sparse_one_hardly(spark):
    docs, labels = corpus(600)
    docs = [(d, t, la, "bad" if q == 0 or x == 1 else s) for (d, t, la, s), (_, q, x) in zip(docs, labels, strict=True)]
    docs += [(5000, docs[0][1], "en", "bad"), (5001, docs[0][1], "en", "new")]
    rows = {r.doc_id: r for r in quality.quality_scores(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()}
    assert rows[5000].host_rate < 0.2 < 0.5 < rows[5001].host_rate and rows[5000].score < rows[5001].score


def test_odd_rows(spark):
    docs, labels = corpus(60)
    docs += [(1, None, None, None), (70, "", "en", "s1"), (71, "é " * 200_000, "fr", None), (None, "the", "en", "s2"), docs[5], docs[5]]
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "'x' AS host", "1 AS evidence", "2 AS label")
    known = spark.createDataFrame(labels + [(None, 1, 0), (2, None, 0), (3, 0, 1), (3, 1, 0)], LABELS)
    rows = quality.quality_scores(frame, known).collect()
    assert len(rows) == len(docs) and all(0 < r.score < 1 for r in rows)
    assert len({(round(r.score, 9), r.keep) for r in rows if r.doc_id == docs[5][0]}) == 1
    unknown = quality.quality_scores(frame, known.limit(0))
    assert unknown.where(~F.col("keep")).count() == 0 and unknown.count() == len(docs)
    assert quality.quality_scores(frame.limit(0), known).count() == 0


def test_url_parts(spark):
    row = spark.createDataFrame([("https://A.example.com/news/x?y", "mailto:x")], "a string, b string").select(quality.url_host(F.col("a")), quality.url_path(F.col("a")), quality.url_host(F.col("b"))).first()
    assert tuple(row) == ("a.example.com", "news", "")


def test_a_repeated_sampled_document_is_fitted_once(spark):
    docs, labels = corpus(400)
    known = spark.createDataFrame(labels, LABELS)
    one = quality.fit(spark.createDataFrame(docs, SCHEMA), known)
    many = quality.fit(spark.createDataFrame(docs + [docs[7]] * 500, SCHEMA), known)
    assert all(np.allclose(one.weights[t], many.weights[t]) for t in quality.TARGETS if t in one.weights) and one.weights.keys() == many.weights.keys()


def test_pages_are_scored_by_host_and_path(spark):
    docs, labels = corpus(600)
    bad = "IDIOT!! SCUM!! " * 30
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.example.com/{i % 3}/x", f"<p>{bad if i % 2 else docs[i][1]}</p><script>{bad}</script>") for i in range(0, 200)]
    pages += [(900, None, None), (901, "no url", ""), (902, "http://good.example.com/", "<p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = {r.page_id: r for r in quality.page_digest(df, spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(rows) == 203 and (rows[1].host, rows[1].path, rows[901].host) == ("bad.example.com", "1", "")
    assert np.mean([rows[i].host_rate for i in range(1, 199, 2)]) < 0.3 < 0.6 < np.mean([rows[i].host_rate for i in range(0, 200, 2)])
