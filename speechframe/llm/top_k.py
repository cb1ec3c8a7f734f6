"""Exact top-k inner-product search by Fagin's threshold algorithm.

Vectors are packed into shards of bounded size, each with its components sorted by dimension. A query
walks its shard's lists from their best end (largest values where its own component is positive,
smallest where it is negative), all to the same depth, and scores every vector it meets; a block of
queries walks together, so that what they meet is scored in one product. What a query has not met scores at most the sum over dimensions of its component times the value at that depth; once
this bound falls below the k-th best score so far, the shard has nothing more for it. The k-th best is
carried from shard to shard within a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import written

#: Vectors of a shard and queries of a block; a pair of them is the unit of work. Queries that are scored at a time.
SHARD_ROWS, BLOCK_ROWS, QUERY_ROWS = 4096, 2048, 256
#: Depth of the first step into the lists; each step doubles it.
FIRST_DEPTH = 16


def scaled_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """id, v (array<long>: floor of scale times each component as double) of the rows whose components are all finite."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.where(F.col(vector_col).isNotNull()).where(finite).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A row for each vector, shorter ones padded with zeros, in the smallest integers that hold all values."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    most = int(np.abs(flat).max(initial=0))
    kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
    out = np.zeros((len(vectors), int(sizes.max(initial=0))), dtype=kind)
    row = np.repeat(np.arange(len(vectors)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _packed(df: DataFrame, rows: int, lists: bool) -> DataFrame:
    """Blobs of at most rows vectors: number of the blob's first row, ids, rows' own numbers, matrix and its width, sorted lists."""

    def filled(batches):
        """Parts of exactly rows rows, whatever the size of Arrow's batches; the last may be smaller."""
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == rows:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def pack(batches):
        for table in filled(batches):
            for part in table.to_batches():
                matrix = _matrix(pa.concat_arrays([part.column(2)]))
                order = np.argsort(matrix, axis=0, kind="stable").astype(np.uint16) if lists else np.zeros(0, np.uint16)
                own = part.column(1).to_numpy(zero_copy_only=False)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                values = [int(own[0]), ids.tobytes(), own.tobytes(), matrix.shape[1], matrix.dtype.itemsize, matrix.tobytes(), order.tobytes()]
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["first", "ids", "own", "dims", "width", "matrix", "lists"])

    return df.select("id", "own", "v").mapInArrow(pack, "first long, ids binary, own binary, dims int, width int, matrix binary, lists binary")


def _unpacked(matrix: bytes, rows: int, dims: int, width: int) -> np.ndarray:
    return np.frombuffer(matrix, f"<i{width}").reshape(rows, dims)


class Best:
    """The k best (score, id) of each query of a block so far, in order; NONE where there are fewer."""

    NONE = -(1 << 62)

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((queries, k), self.NONE, dtype=np.int64), np.full((queries, k), (1 << 63) - 1, dtype=np.int64)

    def kth(self, rows: np.ndarray) -> np.ndarray:
        return self.scores[rows, self.k - 1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merges candidates (query row, score, id) in; ties go to the smaller id."""
        touched = np.unique(rows)
        if not len(touched):
            return
        row = np.concatenate([np.repeat(touched, self.k), rows])
        score = np.concatenate([self.scores[touched].ravel(), scores])
        id_ = np.concatenate([self.ids[touched].ravel(), ids])
        by = np.lexsort((id_, -score, row))
        row, score, id_ = row[by], score[by], id_[by]
        first = np.searchsorted(row, touched)
        take = (first[:, None] + np.arange(self.k)).ravel()
        self.scores[touched], self.ids[touched] = score[take].reshape(-1, self.k), id_[take].reshape(-1, self.k)


class Shard:
    def __init__(self, ids: np.ndarray, own: np.ndarray, matrix: np.ndarray, lists: np.ndarray):
        self.ids, self.lists = ids, lists
        self.n, self.dims = matrix.shape
        self.most = int(np.abs(matrix.astype(np.int64)).max(initial=0))
        self.exact, self.matrix = matrix, matrix.astype(np.float64)
        self.sorted = np.take_along_axis(self.matrix, lists.astype(np.int64), axis=0)
        self.scored = 0  # pairs of a query and a vector it met
        self.by_own = np.argsort(own)
        self.own = own[self.by_own]

    def search(self, queries: np.ndarray, own: np.ndarray, best: Best) -> None:
        """Merges what the shard has to add for a block of queries into best.

        The lists are read for all queries that are not done, a step at a time and from the ends that any
        of them asks for; what is met is scored for all of them at once. A query is done when its bound
        falls below its k-th best: a tie with a smaller id may still be ahead.
        """
        q = np.zeros((len(queries), self.dims), dtype=np.int64)
        dims = min(self.dims, queries.shape[1])
        q[:, :dims] = queries[:, :dims]
        # products of doubles are exact below 2^53
        exact = self.most * int(np.abs(q).max(initial=0)) * max(self.dims, 1) >= 1 << 53
        wide = q.astype(np.float64)
        place = np.minimum(np.searchsorted(self.own, own), self.n - 1)
        itself = np.where(self.own[place] == own, self.by_own[place], -1)
        seen, column = np.zeros(self.n, dtype=bool), np.full(self.n, -1)
        active, depth, step = np.arange(len(q)), 0, FIRST_DEPTH
        while depth < self.n and len(active):
            to = min(self.n, depth + step)
            up, down = (q[active] > 0).any(axis=0), (q[active] < 0).any(axis=0)
            met = np.zeros(self.n, dtype=bool)
            if up.any() or down.any():
                met[self.lists[self.n - to : self.n - depth, up].ravel()] = True
                met[self.lists[depth:to, down].ravel()] = True
            else:  # every score is 0
                met[:], to = True, self.n
            met = np.flatnonzero(met & ~seen)
            seen[met] = True
            column[:] = -1
            column[met] = np.arange(len(met))
            for a in range(0, len(active), QUERY_ROWS) if len(met) else ():
                rows = active[a : a + QUERY_ROWS]
                self.scored += len(rows) * len(met)
                scores = (q[rows] @ self.exact[met].T.astype(np.int64)) if exact else wide[rows] @ self.matrix[met].T
                mine = np.flatnonzero((itself[rows] >= 0) & (column[itself[rows]] >= 0))
                scores[mine, column[itself[rows[mine]]]] = Best.NONE
                least = np.maximum(best.kth(rows), Best.NONE + 1)
                if len(met) > best.k and (least == Best.NONE + 1).any():
                    least = np.maximum(least, np.partition(scores, len(met) - best.k, axis=1)[:, len(met) - best.k].astype(np.int64))
                i, j = np.nonzero(scores >= least[:, None])
                best.add(rows[i], scores[i, j].astype(np.int64), self.ids[met[j]])
            depth, step = to, step * 2
            if depth < self.n:
                bound = np.maximum(wide[active], 0) @ self.sorted[self.n - depth - 1] + np.minimum(wide[active], 0) @ self.sorted[depth]
                kth = best.kth(active)
                active = active[(kth == Best.NONE) | (bound + (1e-6 * np.abs(kth) if exact else 0) >= kth)]


def top_k(df: DataFrame, queries: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id satisfies queries, its k best other rows by
    integer inner product, ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part; shorter vectors count as
    padded with zeros; fewer than k other rows are all returned. Repeated rows are rows of their own,
    as queries and as candidates; a null vec_id is ranked behind ties and is no query; an empty table
    has no result; other columns are ignored. Scores must fit 64 bits. Work is queries times rows, in
    pairs of a block and a shard that are dealt over a grid; each list is read no further than its bound asks. The bound
    is a sum over dimensions: it stops early where few of them carry the scores, and late where all do (figures in README).
    """
    keyed = written(scaled_vectors(df, id_col, vector_col, scale).withColumn("own", F.monotonically_increasing_id()), "vectors")
    asked = keyed.where(F.col("id").isNotNull() & queries(F.col("id")))
    n, m = keyed.count(), asked.count()
    rows, columns = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(m / BLOCK_ROWS))
    shards = _packed(keyed.fillna({"id": (1 << 63) - 1}), SHARD_ROWS, True).withColumn("g", F.pmod(F.xxhash64("first"), F.lit(rows)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    blocks = _packed(asked.repartition(columns, "own"), BLOCK_ROWS, False).withColumn("h", F.pmod(F.xxhash64("first"), F.lit(columns)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    named = blocks.select("g", "h", *[F.col(c).alias(f"q_{c}") for c in ("ids", "own", "dims", "width", "matrix")])
    pairs = shards.select("g", "h", "ids", "own", "dims", "width", "matrix", "lists").join(named, ["g", "h"])

    def search(batches):
        best: dict[bytes, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["own"], np.int64)
                shard = Shard(ids, own, _unpacked(row["matrix"], len(ids), row["dims"], row["width"]), np.frombuffer(row["lists"], np.uint16).reshape(len(ids), row["dims"]))
                q_ids, q_own = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_own"], np.int64)
                known = best.setdefault(row["q_own"], (q_ids, q_own, Best(len(q_ids), k)))
                shard.search(_unpacked(row["q_matrix"], len(q_ids), row["q_dims"], row["q_width"]), q_own, known[2])
        for q_ids, q_own, found in best.values():
            i, j = np.nonzero(found.scores != Best.NONE)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q_ids[i], q_own[i], found.ids[i, j], found.scores[i, j])], names=["query_id", "own", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, own long, vec_id long, score long")
    ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS rank").where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit((1 << 63) - 1)).alias("vec_id"), "score")
