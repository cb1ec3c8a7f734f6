"""Importance resampling towards a target corpus: inverted postings, dealt by hashed feature.

One pass turns each text into postings: for a block of documents, every bucket's documents and counts, as
one row. The postings are shuffled by bucket; there each bucket's gain, worked out from what both corpora
hold of it, is multiplied into the postings, and what documents gain is added up by document. Buckets are
dealt in a fixed number of groups, so a document has at most that many sums to add up, and a group's
postings over tasks by block: a bucket that most documents share spreads, each row of it one block's share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechframe.llm.common import drop_written, small_batches, written

#: A block ends at this many postings or documents; offsets within a block fit 16 bits.
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 20, 1 << 16
#: Groups of buckets, and blocks of one group that come together: some 16 MB of postings, whatever the corpus.
BUCKET_GROUPS, BLOCKS_PER_DEAL = 8, 16
#: Hashed features that a worker remembers, and the longest it keeps.
MAX_MEMO, MEMO_BYTES = 500_000, 48

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of UTF-8 bytes, A-Z lower-cased: runs of digits, letters and anything beyond ASCII."""
    return text.translate(_LETTERS).split() if text else []


class Buckets(dict):
    """The bucket of a feature: unsigned crc32 of its bytes modulo their number; common features are remembered."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        at = crc32(feature) % self.n
        if len(feature) <= MEMO_BYTES:
            if len(self) >= MAX_MEMO:
                self.clear()
            self[feature] = at
        return at


def _grams(words: list[bytes], longest: int) -> Iterator[bytes]:
    if longest == 1:
        return iter(words)
    return chain(words, *(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) for n in range(2, longest + 1)))


_POSTING = [("block", T.LongType()), ("bucket", T.IntegerType()), ("total", T.LongType()), ("docs", T.BinaryType()), ("counts", T.BinaryType()), ("own", T.LongType()), ("n_features", T.LongType()), ("n_words", T.LongType())]


def _postings(df: DataFrame, buckets: int, longest: int, with_docs: bool) -> DataFrame:
    """A row for each block and bucket (total, and with_docs the documents' offsets and counts), and a row for each document (own, id, sizes)."""
    schema = T.StructType([*(T.StructField(n, t, True) for n, t in _POSTING), T.StructField("id", df.schema["id"].dataType, True)])
    names = schema.names

    def run(batches):
        bucket_of, own = Buckets(buckets), TaskContext.get().partitionId() << 33
        keys, counts, block, held = [], [], own, 0

        def flush():
            key, count = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key % buckets, kind="stable")
            key, count = key[order], count[order]
            at, docs = key % buckets, (key // buckets).astype("<u2")
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            ends = np.append(starts[1:], len(at))
            total = np.add.reduceat(count, starts)
            bounds = list(zip(starts.tolist(), ends.tolist(), strict=True))
            count = count.astype("<u4")
            spans = [[pa.array([a[i:j].tobytes() for i, j in bounds], pa.binary()) for a in (docs, count)]] if with_docs else [[pa.nulls(len(starts), pa.binary())] * 2]
            cells = {"block": pa.array(np.full(len(starts), block)), "bucket": pa.array(at[starts].astype(np.int32)), "total": pa.array(total), "docs": spans[0][0], "counts": spans[0][1]}
            for i in range(0, len(starts), 2000):
                yield rows(min(2000, len(starts) - i), **{n: c.slice(i, 2000) for n, c in cells.items()})

        def rows(n, **cells):
            return pa.RecordBatch.from_arrays([cells.get(f.name, pa.nulls(n, kinds[f.name])) for f in schema], names=names)

        kinds = None
        for batch in batches:
            kinds = kinds or {"block": pa.int64(), "bucket": pa.int32(), "total": pa.int64(), "docs": pa.binary(), "counts": pa.binary(), "own": pa.int64(), "n_features": pa.int64(), "n_words": pa.int64(), "id": batch.schema.field("id").type}
            if not batch.num_rows:
                continue
            if held and (held >= BLOCK_POSTINGS or own - block + batch.num_rows > BLOCK_DOCS):
                yield from flush()
                keys, counts, held, block = [], [], 0, own
            n_words, n_features, found = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text)
                n_words.append(len(words))
                features = np.fromiter(map(bucket_of.__getitem__, _grams(words, longest)), np.int64)
                n_features.append(len(features))
                found.append(features)
            first = own - block
            doc = np.repeat(np.arange(first, first + batch.num_rows, dtype=np.int64), n_features)
            key, count = np.unique(doc * buckets + np.concatenate(found), return_counts=True)
            keys.append(key)
            counts.append(count.astype(np.int64))
            held += len(key)
            if with_docs:
                yield rows(batch.num_rows, own=pa.array(np.arange(own, own + batch.num_rows)), n_features=pa.array(n_features, pa.int64()), n_words=pa.array(n_words, pa.int64()), id=batch.column("id"))
            own += batch.num_rows
        if held:
            yield from flush()

    return df.select("id", "text").mapInArrow(run, schema)


def _gained(postings: DataFrame, gains: DataFrame) -> DataFrame:
    """own, gained: count times gain over a document's postings in one group of buckets. Both sides come by deal, the group and its share of the blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("bucket").to_numpy())
        known, gain = right.column("bucket").to_numpy()[order], right.column("gain").to_numpy()[order]
        counts = left.column("counts").to_pylist()
        sizes = [len(c) // 4 for c in counts]
        if not sizes:
            return pa.table({"own": pa.array([], pa.int64()), "gained": pa.array([], pa.int64())})
        own = np.repeat(left.column("block").to_numpy(), sizes) + np.frombuffer(b"".join(left.column("docs").to_pylist()), "<u2")
        each = np.repeat(gain[np.searchsorted(known, left.column("bucket").to_numpy())], sizes) * np.frombuffer(b"".join(counts), "<u4")
        order = np.argsort(own, kind="stable")
        own = own[order]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        return pa.table({"own": pa.array(own[starts]), "gained": pa.array(np.add.reduceat(each[order], starts))})

    left, right = postings.select("deal", "block", "bucket", "docs", "counts"), gains.select("deal", "bucket", "gain")
    return left.groupBy("deal").cogroup(right.groupBy("deal")).applyInArrow(run, "own long, gained long")


def _ranked(scored: DataFrame, eligible: int, percent: int, least_words: int) -> DataFrame:
    """Adds rank (from 1) to the drawn rows. The rows are sorted over all tasks; a row's rank is its place in its task after the sizes of the tasks before."""
    may = F.col("n_words") >= least_words
    placed = written(scored.withColumn("may", may).orderBy(F.desc("may"), F.desc("score"), F.asc_nulls_last("id"), "own").withColumn("place", F.monotonically_increasing_id()), "ranked")
    task = F.shiftright("place", 33)
    sizes = placed.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    before = sizes.selectExpr("task", "coalesce(sum(n) OVER (ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")  # a row for each task
    rank = F.col("before") + F.col("place") - F.shiftleft(F.col("task"), 33) + 1
    drawn = F.col("may") & (rank <= eligible * percent // 100)
    return placed.withColumn("task", task).join(F.broadcast(before), "task").withColumn("rank", F.when(drawn, rank))


def resample(
    df: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_features, weight, score, rank of every row: a draw of percent of the rows without replacement, weighted by likeness to target.

    Features are runs of 1 to longest words; a bucket's gain compares its share, smoothed by one, of target
    with that of df; weight is the floored mean gain. score adds Gumbel noise that the seed and the id fix,
    so the highest scores are a weighted draw without replacement; rows of fewer than least_words words
    are not drawn (rank null). Texts are taken whole, whatever their length. Null and empty texts have no
    features and weight 0; a null id scores like an empty one and is ranked behind ties; ties go to the
    smaller id, then to either row; repeated rows are each counted, scored and drawn; an empty target gives
    gains all the same; an empty df gives no rows; other columns are ignored, whatever their names. The
    gains are one row a bucket: buckets is a parameter and does not grow with the data.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = target.select(F.lit(None).cast(source.schema["id"].dataType).alias("id"), F.col(text_col).alias("text"))
    held = written(_postings(source, buckets, longest, True).withColumn("s", F.col("total")).withColumn("t", F.lit(None).cast("long")), "postings")
    aimed = _postings(wanted, buckets, longest, False).select("bucket", F.lit(0).cast("long").alias("s"), F.col("total").alias("t"))
    both = held.where("bucket IS NOT NULL").select("bucket", "s", "t").unionByName(aimed)
    sums = written(both.groupBy("bucket").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")), "buckets")
    all_s, all_t = (int(x or 0) for x in sums.agg(F.sum("s"), F.sum("t")).first())

    def smoothed(n, total):
        return (n.cast("double") + 1) * (F.lit(total).cast("double") + buckets)

    gains = sums.where("s > 0").select("bucket", F.floor(1000 * F.log(smoothed(F.col("t"), all_s) / smoothed(F.col("s"), all_t))).cast("long").alias("gain"))
    # a bucket has at most one row a block; a deal is a group of buckets in some BLOCKS_PER_DEAL blocks
    blocks = held.where("bucket IS NOT NULL").select("block").distinct().count()
    shares = max(1, math.ceil(blocks / BLOCKS_PER_DEAL))
    group = F.pmod("bucket", F.lit(BUCKET_GROUPS)).cast("long")
    dealt = held.where("bucket IS NOT NULL").withColumn("deal", group * shares + F.pmod(F.xxhash64("block"), F.lit(shares)))
    sent = gains.withColumn("deal", F.explode(F.sequence(group * shares, group * shares + (shares - 1))))
    every = _gained(dealt, sent).select("own", "gained", F.lit(None).cast(source.schema["id"].dataType).alias("id"), F.lit(None).cast("long").alias("n_features"), F.lit(None).cast("long").alias("n_words"))
    every = every.unionByName(held.where("own IS NOT NULL").select("own", F.lit(0).cast("long").alias("gained"), "id", "n_features", "n_words"))
    docs = every.groupBy("own").agg(F.max("id").alias("id"), F.max("n_features").alias("n_features"), F.max("n_words").alias("n_words"), F.sum("gained").alias("gained"))
    mean = F.when(F.col("n_features") > 0, F.expr("(gained - pmod(gained, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    draw = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")).cast("string")), 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0))).cast("long")
    scored = written(docs.withColumn("weight", mean).withColumn("score", F.col("weight") + noise).drop("gained"), "scored")
    eligible = scored.where(F.col("n_words") >= least_words).count()
    drop_written(held)
    drop_written(sums)
    ranked = _ranked(scored, eligible, percent, least_words)
    drop_written(scored)
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def drawn(df: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of resample() that are drawn, best first within its order of ranks."""
    return resample(df, target, **how).where("rank IS NOT NULL")
