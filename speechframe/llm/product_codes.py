"""Product quantisation of vectors with exact integer arithmetic, trained by Elkan's form of Lloyd's rounds.

Every vector is a row of its integers and, for each part, its entry, an upper bound of its distance to that
entry and one lower bound for each entry. A round passes the rows once: bounds move by what the entries
moved, the triangle inequality rules entries out where it does so strictly, and what it leaves is decided
by exact integer distances, so ties go to the smaller index. The same pass adds up, batch by batch, what the
next entries need. The codebooks have a fixed size and are all that comes to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import BROADCAST_ROWS, drop_written, joined_on, small_batches, written

#: Components beyond this could overflow the 64 bits of a squared distance.
MOST = 1 << 28
#: Outward rounding of bounds: far more than float32 and a square root lose.
UP, DOWN = 1 + 1e-6, 1 - 1e-6


def _upward(x: np.ndarray) -> np.ndarray:
    return (x * UP).astype(np.float32)


def _downward(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * DOWN, 0).astype(np.float32)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a and rows of b, pair by pair."""
    d = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", d, d)


class Part:
    """One part's codebook in one round, with how far its entries moved since the round before."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None):
        self.entries, self.n = entries, len(entries)
        gaps = entries[:, None, :] - entries[None, :, :]
        between = np.sqrt(np.einsum("ijk,ijk->ij", gaps, gaps).astype(np.float64))
        self.half = between * (0.5 * DOWN)
        np.fill_diagonal(self.half, np.inf)
        self.nearest = self.half.min(axis=1)
        moved = entries - (entries if before is None else before)
        self.moved = np.sqrt(np.einsum("ij,ij->i", moved, moved).astype(np.float64)) * UP

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Assignments and bounds from all distances."""
        d = np.stack([_distances(x, np.broadcast_to(e, x.shape)) for e in self.entries], axis=1)
        best = d.argmin(axis=1)
        root = np.sqrt(d.astype(np.float64))
        return best.astype(np.uint8), _upward(root[np.arange(len(x)), best]), _downward(root), d.size

    def again(self, x: np.ndarray, best: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Assignments and bounds after the entries moved; the last number counts the distances worked out."""
        upper = _upward(upper.astype(np.float64) + self.moved[best])
        lower = _downward(lower.astype(np.float64) - self.moved)
        # an entry is ruled out if it is strictly farther by a bound: equal ones may win a tie
        rows = np.flatnonzero(upper >= self.nearest[best])
        rows = rows[((upper[rows, None] >= lower[rows]) & (upper[rows, None] >= self.half[best[rows]])).any(axis=1)]
        if not len(rows):
            return best, upper, lower, 0
        own = best[rows].astype(np.int64)
        mine = _distances(x[rows], self.entries[own])
        root = np.sqrt(mine.astype(np.float64))
        upper[rows], lower[rows, own] = _upward(root), _downward(root)
        left = (upper[rows, None] >= lower[rows]) & (upper[rows, None] >= self.half[own])
        left[np.arange(len(rows)), own] = False
        i, c = np.nonzero(left)
        exact = _distances(x[rows[i]], self.entries[c])
        lower[rows[i], c] = _downward(np.sqrt(exact.astype(np.float64)))
        d = np.full((len(rows), self.n), np.iinfo(np.int64).max)
        d[np.arange(len(rows)), own], d[i, c] = mine, exact
        now = d.argmin(axis=1)
        best, changed = best.copy(), now != own
        best[rows] = now
        upper[rows[changed]] = _upward(np.sqrt(d[changed, now[changed]].astype(np.float64)))
        return best, upper, lower, len(rows) + len(i)


def _matrix(cells: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of equally long binary cells as a matrix."""
    return np.frombuffer(b"".join(cells.to_pylist()), kind).reshape(len(cells), width)


def _cells(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary cells."""
    raw = np.ascontiguousarray(matrix)
    size = raw.shape[1] * raw.itemsize
    flat = raw.tobytes()
    return pa.array([flat[i : i + size] for i in range(0, len(flat), size)] if size else [b""] * len(raw), pa.binary())


class Layout:
    """How a row's cells are laid out: parts, components of a part, entries of a codebook, bytes of a component."""

    def __init__(self, parts: int, width: int, entries: int, kind: str):
        self.parts, self.width, self.entries, self.kind = parts, width, entries, kind

    def vectors(self, cells: pa.Array) -> np.ndarray:
        return _matrix(cells, self.kind, self.parts * self.width)


def _packed(kept: DataFrame, layout: Layout) -> DataFrame:
    """v, the last column, as a binary cell, shorter vectors padded with zeros; the other columns stay."""
    wide = layout.parts * layout.width

    def run(batches):
        for batch in batches:
            *others, v = batch.columns
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            out = np.zeros((len(v), wide), dtype=layout.kind)
            row = np.repeat(np.arange(len(v)), sizes)
            out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            yield pa.RecordBatch.from_arrays([*others, _cells(out)], names=batch.schema.names)

    return kept.mapInArrow(run, kept.drop("v").schema.add("v", "binary"))


def _round(rows: DataFrame, layout: Layout, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """rows with new entries and bounds (best, upper, lower), and on the first row of each batch what its parts add to the next entries."""
    p, w, k = layout.parts, layout.width, layout.entries
    names = ["id", "label", "v", "best", "upper", "lower", "sums", "worked"]

    def run(batches):
        parts = [Part(books[j], None if before is None else before[j]) for j in range(p)]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = layout.vectors(batch.column(batch.schema.names.index("v")))
            best, upper, lower = np.zeros((n, p), np.uint8), np.zeros((n, p), np.float32), np.zeros((n, p * k), np.float32)
            if before is not None:
                held = [batch.column(batch.schema.names.index(c)) for c in ("best", "upper", "lower")]
                best, upper, lower = _matrix(held[0], "<u1", p).copy(), _matrix(held[1], "<f4", p).copy(), _matrix(held[2], "<f4", p * k).copy()
            sums, worked = np.zeros((p, k, w + 1), np.int64), 0
            for j, part in enumerate(parts):
                piece, bounds = x[:, j * w : (j + 1) * w], slice(j * k, (j + 1) * k)
                best[:, j], upper[:, j], lower[:, bounds], done = part.first(piece) if before is None else part.again(piece, best[:, j], upper[:, j], lower[:, bounds])
                worked += done
                np.add.at(sums[j, :, :w], best[:, j], piece.astype(np.int64))
                sums[j, :, w] = np.bincount(best[:, j], minlength=k)
            first = [sums.tobytes()] + [None] * (n - 1)
            kept = [batch.column(batch.schema.names.index(c)) for c in ("id", "label", "v")]
            yield pa.RecordBatch.from_arrays([*kept, _cells(best), _cells(upper), _cells(lower), pa.array(first, pa.binary()), pa.array([worked] + [None] * (n - 1), pa.int64())], names=names)

    return rows.mapInArrow(run, rows.select("id", "label", "v").schema.add("best", "binary").add("upper", "binary").add("lower", "binary").add("sums", "binary").add("worked", "long"))


def _next_books(rows: DataFrame, layout: Layout, books: np.ndarray) -> np.ndarray:
    """The entries' floored means; unused entries stay. Sums of batches are added up in tasks, then over a fixed number of groups."""
    p, w, k = layout.parts, layout.width, layout.entries

    def added(batches):
        total = np.zeros(p * k * (w + 1), np.int64)
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                total += np.frombuffer(cell, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "n"])

    found = rows.where("sums IS NOT NULL").select("sums").mapInArrow(added, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(p * k * (w + 1), np.int64)
    for row in found:
        total[row.at] = row.n
    total = total.reshape(p, k, w + 1)
    counts = total[:, :, w:]
    return np.where(counts > 0, total[:, :, :w] // np.maximum(counts, 1), books)


def _coded(rows: DataFrame, layout: Layout, books: np.ndarray) -> DataFrame:
    """id, label, code, error: exact distances to the final entries."""
    p, w = layout.parts, layout.width

    def run(batches):
        for batch in batches:
            x, best = layout.vectors(batch.column(2)), _matrix(batch.column(3), "<u1", p)
            error = np.zeros(batch.num_rows, np.int64)
            for j in range(p):
                error += _distances(x[:, j * w : (j + 1) * w], books[j][best[:, j]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bytes(b).hex() for b in best]), pa.array(error)], names=["id", "label", "code", "error"])

    return rows.select("id", "label", "v", "best").mapInArrow(run, rows.select("id", "label").schema.add("code", "string").add("error", "long"))


def train(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(coded rows: id, label, code, error; codebooks: part, entry, component). See codes() for what each input gives."""
    small_batches(df.sparkSession)
    x = F.col("__x")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    picked = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("__x")).where(x.isNotNull()).where(finite)
    kept = picked.select("id", "label", F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v"))
    size, most = kept.agg(F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    if (most or 0) >= MOST:
        raise ValueError(f"components times {scale} must stay below {MOST}")
    width = max(1, -(-(size or 0) // parts))
    first = [r.v for r in kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    layout = Layout(parts, width, max(1, len(first)), "<i2" if (most or 0) < 1 << 15 else "<i4")
    books = np.zeros((layout.entries, parts * width), np.int64)
    for i, v in enumerate(first):
        books[i, : len(v)] = v
    books = np.ascontiguousarray(books.reshape(layout.entries, parts, width).transpose(1, 0, 2))
    rows, before = written(_packed(kept, layout), "vectors"), None
    for _ in range(rounds):
        moved = written(_round(rows, layout, books, before), "bounds")
        drop_written(rows)
        rows, before, books = moved, books, _next_books(moved, layout, books)
    last = written(_round(rows, layout, books, before), "bounds")
    drop_written(rows)
    coded = written(_coded(last, layout, books), "codes")
    drop_written(last)
    return coded, books if first else books[:, :0]


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code (two hex digits a part), error, label_error, codebooks_sha256 of every vector.

    Vectors that are null or hold null or non-finite components are dropped. The codebooks start with the
    smallest ids' vectors (null ids last, ties by the vector); fewer rows than entries give smaller
    codebooks. Shorter vectors count as padded with zeros to the longest, and that to a multiple of parts.
    Repeated rows are rows of their own; null ids and labels stay, and null labels count as one label;
    an empty table has no rows; other columns are ignored, whatever their names. Components times scale
    must stay below 2^28, or the call is refused. Memory of a task is a batch; the driver holds the codebooks.
    """
    coded, books = train(df, parts, entries, rounds, scale, id_col, vector_col, label_col)
    coded = coded.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = written(coded.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    labels, total = sums.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    joined = coded.join(F.broadcast(sums), "__label") if labels <= BROADCAST_ROWS else joined_on(coded, sums, "__label", total)
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
