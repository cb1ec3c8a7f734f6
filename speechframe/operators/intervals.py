"""Interval joins and interval algebra over (meeting, start, end) rows of any numeric type.

Everything is grouped by meeting, or is a window keyed by it: a range join is turned into groups of time
buckets, coverage is swept over its boundary points. Rows with a null bound or none of positive
length take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechframe import schema as S
from speechframe.functions.text import strip
from speechframe.sources.sinks import stored


def _bucket(x: Column, width) -> Column:
    return F.floor(x / F.lit(width)).cast("bigint")


def _bucketed(df: DataFrame, width) -> DataFrame:
    """One row for each bucket of time that an interval touches."""
    return df.where("end > start").withColumn("__b", F.explode(F.sequence(_bucket(F.col("start"), width), _bucket(F.col("end"), width))))


#: Widths of time that one group of segments and turns holds.
GROUP_WIDTHS = 16


def _greatest_within(x: np.ndarray, y: np.ndarray, worth: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each query the point of the greatest worth with x <= qx and y >= qy, else -1; worth is a permutation of the points' numbers.

    The points up to qx are a few runs of 2^k points in order of x; in each run the points from qy on are a prefix by
    falling y, whose greatest worth is kept.
    """
    n, best = len(x), np.full(len(qx), -1)
    by_x = np.argsort(x, kind="stable")
    upto = np.searchsorted(x[by_x], qx, side="right")
    falling = np.sort(-y)
    fall, wanted = np.searchsorted(falling, -y, side="left")[by_x], np.searchsorted(falling, -qy, side="right")
    gain = worth[by_x]
    for k in range(n.bit_length()):
        runs = np.arange(n) >> k
        keys = runs * (n + 1) + fall
        order = np.argsort(keys, kind="stable")
        most = np.maximum.accumulate(runs * (n + 1) + gain[order]) - runs * (n + 1)
        ask = np.flatnonzero(upto >> k & 1)
        run = (upto[ask] >> k) - 1
        to = np.searchsorted(keys[order], run * (n + 1) + wanted[ask], side="left")
        some = to > run << k
        best[ask[some]] = np.maximum(best[ask[some]], most[to[some] - 1])
    point = np.empty(n, np.int64)
    point[worth] = np.arange(n)
    return np.where(best >= 0, point[best], -1)


def _longest_overlap(s: np.ndarray, e: np.ndarray, ts: np.ndarray, te: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the turn that overlaps it most, of equal ones the first, and the overlap (none where it isn't positive).

    Four turns can be the one: the first of those that cover the segment, the longest inside it, the one that ends last of
    those that run at its start, and the one that starts first of those that run at its end. No pair beside them is looked at.
    """
    n = len(ts)

    def worth(*by) -> np.ndarray:  # places by the given values, then the first turn above the later ones
        out = np.empty(n, np.int64)
        out[np.lexsort((-np.arange(n), *by))] = np.arange(n)
        return out

    over = _greatest_within(ts, te, worth(), s, e)
    inside = _greatest_within(-ts, -te, worth(te - ts), -s, -e)

    def first_to(order: np.ndarray, value: np.ndarray, count: np.ndarray) -> np.ndarray:
        most = np.maximum.accumulate(value[order])
        point = np.empty(n, np.int64)
        point[value] = np.arange(n)
        return np.where(count > 0, point[most[count - 1]], -1)

    by_start, by_end = np.argsort(ts, kind="stable"), np.argsort(-te, kind="stable")
    at_start = first_to(by_start, worth(te), np.searchsorted(ts[by_start], s, side="right"))
    at_end = first_to(by_end, worth(-ts), np.searchsorted(-te[by_end], -e, side="right"))
    best, most = np.full(len(s), -1), np.zeros(len(s), ts.dtype)
    for t in (over, inside, at_start, at_end):
        overlap = np.where(t >= 0, np.minimum(e, te[t]) - np.maximum(s, ts[t]), 0)
        better = (overlap > most) | ((overlap == most) & (overlap > 0) & (t < best))
        best, most = np.where(better, t, best), np.where(better, overlap, most)
    return best, most


def merge_segments_turns(segments: DataFrame, turns: DataFrame, width=60.0) -> DataFrame:
    """Each segment with the speaker whose turn overlaps it most; the first turn wins ties.

    Touching intervals and those of no length don't overlap; a segment without overlap, or whose turn
    names no speaker, gets SPEAKER_UNKNOWN. Segments (meeting_id, seq, start, end, text) stay one row
    each, however many groups of GROUP_WIDTHS times `width` a pair shares; a meeting of any length spreads over groups. A
    segment leaves a group with one turn at most, and a group's work grows as its rows times their logarithm, so
    turns that all overlap cost no row a pair. Times that are neither whole nor floating numbers are compared as doubles.
    """
    whole = all(isinstance(d.schema[c].dataType, T.IntegralType) for d in (segments, turns) for c in ("start", "end"))
    kind = "bigint" if whole else "double"
    times = [F.col(c).cast(kind).alias(c) for c in ("start", "end")]
    s = _bucketed(segments.select("meeting_id", "seq", *times), width * GROUP_WIDTHS)
    t = _bucketed(turns.select("meeting_id", "turn_idx", *times, "speaker"), width * GROUP_WIDTHS)
    out = T.StructType([s.schema["meeting_id"], s.schema["seq"], t.schema["turn_idx"], t.schema["speaker"], T.StructField("overlap", s.schema["start"].dataType)])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("turn_idx")
        best, most = np.zeros(0, np.int64), np.zeros(0)
        if left.num_rows and right.num_rows:
            best, most = _longest_overlap(*(d.column(c).to_numpy() for d in (left, right) for c in ("start", "end")))
        some = np.flatnonzero(best >= 0)
        left, right = left.take(pa.array(some)), right.take(pa.array(best[some]))
        return pa.table([left.column("meeting_id"), left.column("seq"), right.column("turn_idx"), right.column("speaker"), pa.array(most[some], pa.int64() if whole else pa.float64())], names=out.names)

    near = s.groupBy("meeting_id", "__b").cogroup(t.groupBy("meeting_id", "__b")).applyInArrow(met, out)
    best = near.groupBy("meeting_id", "seq").agg(F.max_by("speaker", F.struct("overlap", -F.col("turn_idx"))).alias("speaker"))
    named = F.coalesce(F.nullif("speaker", F.lit("")), F.lit(S.UNKNOWN_SPEAKER))
    return segments.join(best, ["meeting_id", "seq"], "left").select("meeting_id", "seq", "start", "end", named.alias("speaker"), strip(F.col("text")).alias("text"))


def seconds_by_speaker(turns: DataFrame) -> DataFrame:
    """Sum of the lengths of each speaker's turns; turns that end before they start count as none."""
    return turns.groupBy("meeting_id", "speaker").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("start"))).alias("seconds"))


#: Ranges up to which their carried sums are broadcast.
BROADCAST_RANGES = 100_000


def _ranged(df: DataFrame, keys: list[str], order: list[str], ranges: int) -> DataFrame:
    """df with __range, the number of the row's range: rows sorted by keys and order are cut into about so many ranges of like size, stored."""
    return stored(df.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def _carried(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what is carried into their range: sums has a row for each key and range."""
    same = F.lit(True)
    named = sums.withColumnsRenamed({k: f"__{k}" for k in [*keys, "__range"]})
    for k in [*keys, "__range"]:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    few = sums.count() <= BROADCAST_RANGES
    return rows.join(F.broadcast(named) if few else named, same, "left").drop(*[f"__{k}" for k in [*keys, "__range"]])


def _union_by_ranges(df: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """union_intervals() with a key's intervals in many tasks.

    A range hands on its greatest end and the last start that follows no end of its own. What reaches into
    a range is the greatest end before it, and the island that is open there is the last such start that
    also follows that end.
    """
    d = _ranged(df.where("end >= start").select(*keys, "start", "end"), keys, ["start", "end"], ranges)
    w = W.partitionBy(*keys, "__range").orderBy("start", "end")
    local = d.withColumn("__b", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    alone = F.when(F.col("__b").isNull() | (F.col("start") > F.col("__b")), F.col("start"))
    sums = stored(local.groupBy(*keys, "__range").agg(F.max("end").alias("__e"), F.max(alone).alias("__l")), "sums")
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    reach = sums.withColumn("__m", F.max("__e").over(before))
    opens = F.when(F.col("__m").isNull() | (F.col("__l") > F.col("__m")), F.col("__l"))
    carried = reach.withColumn("__o", opens).withColumn("__i", F.last("__o", ignorenulls=True).over(before)).select(*keys, "__range", "__m", "__i")
    joined = _carried(local, stored(carried, "carried"), keys)
    starts = F.when(F.greatest("__m", "__b").isNull() | (F.col("start") > F.greatest("__m", "__b")), F.col("start"))
    island = F.coalesce(F.max(starts).over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("__i"))
    return joined.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__i")


def _swept_by_ranges(at: DataFrame, keys: list[str], values: list[str], ranges: int) -> DataFrame:
    """Points (keys, p, values) with q, the next point of the key, and running sums of the values, with a key's points in many tasks."""
    d = _ranged(at, keys, ["p"], ranges)
    sums = stored(d.groupBy(*keys, "__range").agg(F.min("p").alias("__first"), *[F.sum(v).alias(f"__{v}") for v in values]), "sums")
    order = W.partitionBy(*keys).orderBy("__range")  # a row a range
    carry = [F.coalesce(F.sum(f"__{v}").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"__{v}") for v in values]
    carried = stored(sums.select(*keys, "__range", F.lead("__first").over(order).alias("__next"), *carry), "carried")
    w = W.partitionBy(*keys, "__range").orderBy("p")
    joined = _carried(d, carried, keys)
    return joined.select(*keys, "p", F.coalesce(F.lead("p").over(w), "__next").alias("q"), *[(F.sum(v).over(w) + F.col(f"__{v}")).alias(v) for v in values])


def union_intervals(df: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """Overlapping or touching intervals of a key become one. With ranges, a key's intervals are dealt over about so many tasks
    by time, for keys that hold more than a task should."""
    if ranges:
        return _union_by_ranges(df, keys, ranges)
    w = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("__m"), 0).otherwise(1)).over(w)
    return df.where("end >= start").withColumn("__m", before).withColumn("__i", island).groupBy(*keys, "__i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__i")


def _swept(points: DataFrame, keys: list[str], values: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """Cells between neighbouring boundary points, with running sums of the values at their start."""
    at = points.groupBy(*keys, "p").agg(*[F.sum(c).alias(n) for n, c in values.items()])
    if ranges:
        return _swept_by_ranges(at, keys, list(values), ranges).where("q IS NOT NULL")
    w = W.partitionBy(*keys).orderBy("p")
    return at.select(*keys, "p", F.lead("p").over(w).alias("q"), *[F.sum(n).over(w).alias(n) for n in values]).where("q IS NOT NULL")


def _points(df: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    d = df.where("end > start")
    return d.select(*keys, *extra, F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d")))).alias("__x")).select(*keys, *extra, "__x.p", "__x.d")


def subtract_intervals(keep: DataFrame, remove: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """The parts of keep's intervals that no interval of remove covers; overlapping intervals of keep are united first."""
    a = _points(union_intervals(keep, keys, ranges), keys).withColumn("k", F.col("d")).withColumn("r", F.lit(0))
    b = _points(union_intervals(remove, keys, ranges), keys).withColumn("k", F.lit(0)).withColumn("r", F.col("d"))
    cells = _swept(a.unionByName(b), keys, {"k": F.col("k"), "r": F.col("r")}, ranges).where("k > 0 AND r = 0")
    return union_intervals(cells.select(*keys, F.col("p").alias("start"), F.col("q").alias("end")), keys, ranges)


def clean_intervals(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """The stretches of each speaker in which no other speaker's turn runs.

    A speaker's own overlapping turns are no overlap. Each speaker's coverage is united, the boundaries
    are swept once, and a cell belongs to a speaker where exactly one is active: the running sum of the
    active speakers' numbers is then that speaker's number. Speakers with nothing left don't appear. With
    ranges, one meeting's turns are dealt over about so many tasks by time.
    """
    keys = ["meeting_id"]
    own = union_intervals(turns.where("end > start AND speaker IS NOT NULL").select("meeting_id", "speaker", "start", "end"), ["meeting_id", "speaker"], ranges)
    if ranges:  # the numbers come from the speakers, not from a window over all of a meeting's turns
        own = stored(own, "own")
        who = own.select("meeting_id", "speaker").distinct().withColumn("__no", F.dense_rank().over(W.partitionBy("meeting_id").orderBy("speaker")).cast("bigint"))
        numbered = own.join(who, ["meeting_id", "speaker"])
    else:
        numbered = own.withColumn("__no", F.dense_rank().over(W.partitionBy("meeting_id").orderBy("speaker")).cast("bigint"))
    names = numbered.select("meeting_id", "__no", "speaker").distinct()
    cells = _swept(_points(numbered, keys, "__no"), keys, {"active": F.col("d"), "__no": F.col("d") * F.col("__no")}, ranges).where("active = 1")
    united = union_intervals(cells.select("meeting_id", "__no", F.col("p").alias("start"), F.col("q").alias("end")), ["meeting_id", "__no"], ranges)
    return united.join(names, ["meeting_id", "__no"]).select("meeting_id", "speaker", "start", "end")


def select_intervals(clean: DataFrame, min_length=S.MIN_INTERVAL_SECONDS, target=S.TARGET_SECONDS, count: int = S.MAX_INTERVALS) -> DataFrame:
    """Each speaker's longest stretches, until the total before a stretch reaches the target or count are taken."""
    w = W.partitionBy("meeting_id", "speaker").orderBy(F.desc("__len"), "start")
    taken = F.coalesce(F.sum("__len").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        clean.withColumn("__len", F.col("end") - F.col("start"))
        .where(F.col("__len") >= min_length)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= count)
        .withColumn("__before", taken)
        .where(F.col("__before") < target)
        .drop("__len", "__before")
    )


def longest_clips(clean: DataFrame, seconds=S.CLIP_SECONDS) -> DataFrame:
    """Each speaker's longest stretch, the earliest of equals, cut to so many seconds."""
    best = clean.groupBy("meeting_id", "speaker").agg(F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("b"))
    return best.select("meeting_id", "speaker", "b.start", F.least(F.col("b.end"), F.col("b.start") + seconds).alias("end"))
