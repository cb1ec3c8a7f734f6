import math
import random

import numpy as np
from pyspark.sql import functions as F

from speechframe.llm import top_k


def brute(rows, divisor, k):
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(vectors):
        if i is not None and i % divisor == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j is None, j or 0) for b, (j, w) in enumerate(vectors) if b != a)
            out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, divisor=3, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS id", "1 AS own", "2 AS score")
    return sorted((tuple(r) for r in top_k.top_k(df, lambda i: i % divisor == 0, k).collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 17)
    monkeypatch.setattr(top_k, "BLOCK_ROWS", 5)
    monkeypatch.setattr(top_k, "FIRST_DEPTH", 2)
    rng = random.Random(2)
    for dims, values in ((8, 1.0), (3, 0.03), (2, 1e7)):
        rows = [(i, [rng.uniform(-values, values) for _ in range(dims)]) for i in range(120)]
        rows += [(200 + i, [0.5] * dims) for i in range(20)]
        rows += [rows[3], rows[6], (300, None), (303, [None] * dims), (306, [float("nan")] * dims), (309, [float("inf")] * dims), (312, [0.1]), (315, []), (318, [0.0] * dims), (None, [0.9] * dims)]
        assert run(spark, rows) == brute(rows, 3, 5)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, [1.0])]) == []
    assert run(spark, [(3, [1.0]), (4, [2.0])]) == [(3, 1, 4, 64 * 128)]


def test_bound_stops_early():
    rng = np.random.default_rng(1)
    matrix = np.sort(rng.integers(0, 1000, (4096, 2)), axis=0)
    order = np.argsort(matrix, axis=0, kind="stable").astype(np.uint16)
    shard = top_k.Shard(np.arange(4096), np.arange(4096), matrix, order)
    reads = []
    shard.matrix = type("Counted", (), {"__getitem__": lambda _, at: (reads.append(len(at)), matrix[at].astype(float))[1]})()
    best = top_k.Best(1, 10)
    shard.search(np.array([[1, 2]]), np.array([-1]), best)
    assert sum(reads) < 200 and best.scores[0].tolist() == sorted((matrix @ [1, 2]).tolist(), reverse=True)[:10]


def scored_share(matrix, queries, k=20):
    """The k best of each query, walked one by one, and the share of all vectors that a query scored."""
    order = np.argsort(matrix, axis=0, kind="stable").astype(np.uint16)
    shard, found = top_k.Shard(np.arange(len(matrix)), np.arange(len(matrix)), matrix, order), []
    for q in queries:
        best = top_k.Best(1, k)
        shard.search(q[None, :], np.array([-1]), best)
        found.append(best.scores[0].tolist())
    return found, shard.scored / (len(queries) * len(matrix))


def test_scored_vectors_in_64_dimensions():
    rng = np.random.default_rng(5)
    plain = rng.integers(-64, 65, (4096, 64))
    steep = (rng.standard_normal((4096, 64)) * 400 / (1 + np.arange(64)) ** 2).astype(np.int64)  # few dimensions carry the scores
    for matrix, most in ((plain, 1.0), (steep, 0.5)):
        queries = matrix[:8]
        found, share = scored_share(matrix, queries)
        assert found == [sorted((matrix @ q).tolist(), reverse=True)[:20] for q in queries]
        assert share <= most, share
    assert scored_share(plain, plain[:8])[1] > 0.9  # stated in the README: all dimensions count alike here, and the bound prunes nothing


def test_shards_are_full_whatever_the_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = top_k.scaled_vectors(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(950)], "i long, x array<double>").coalesce(1), "i", "x").withColumn("own", F.col("id"))
        sizes = sorted(len(r.ids) // 8 for r in top_k._packed(df, 300, True).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sizes == [50, 300, 300, 300]
