"""Ordered folds over transcript blocks: parsing, run merging and chunking under a token budget.

The folds carry a few values from row to row. Rows come sorted within partitions keyed by meeting and
stream through a task batch by batch, so memory is bounded by a batch and one open chunk, whatever the
length of a meeting.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechframe import schema as S
from speechframe.functions.text import estimate_tokens, parse_timestamp, strip


def parse_segments(transcripts: DataFrame) -> DataFrame:
    """Blocks of a transcript (meeting_id, md): seg, speaker, start_seconds, body, raw.

    Blocks are divided by blank lines. One with a header opens a row, others join the open row, those
    before the first header are skipped.
    """
    block = transcripts.select("meeting_id", F.posexplode(F.split("md", "\n\n", -1)).alias("pos", "block")).withColumn("block", strip(F.col("block"))).where("block <> ''")
    head = F.regexp_extract("block", "^" + S.HEADER, 0)
    w = W.partitionBy("meeting_id").orderBy("pos")
    rows = block.withColumn("__h", head).withColumn("seg", F.sum((F.col("__h") != "").cast("int")).over(w)).where("seg > 0")
    joined = rows.groupBy("meeting_id", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("b"))
    raw = joined.select("meeting_id", "seg", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("raw"))
    return raw.select(
        "meeting_id",
        "seg",
        F.regexp_extract("raw", "^" + S.HEADER, 1).alias("speaker"),
        parse_timestamp(F.regexp_extract("raw", "^" + S.HEADER, 2)).alias("start_seconds"),
        strip(F.regexp_replace("raw", "^" + S.HEADER, "")).alias("body"),
        "raw",
    )


def fold(df: DataFrame, key: str, order: str, start: Callable, schema: str) -> DataFrame:
    """Runs start(key) -> object with push(row) and close(), each yielding rows, over each key's rows in order.

    The rows of a key meet in one task by the nature of a fold, but only one batch of them is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current = None, None
        columns = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if state is None or k != current:
                    if state is not None:
                        out.extend(state.close())
                    state, current = start(k), k
                out.extend(state.push(row))
            yield pd.DataFrame(out, columns=columns)
        if state is not None:
            yield pd.DataFrame(list(state.close()), columns=columns)

    return df.where(F.col(key).isNotNull()).withColumn(key, F.col(key).cast("string")).repartition(F.col(key)).sortWithinPartitions(key, order).mapInPandas(run, schema)


class _Runs:
    """The open block of a run: its speaker, its text so far and the rows in it."""

    def __init__(self, key, cap: int):
        self.key, self.cap, self.block, self.rows, self.text, self.speaker = key, cap, 0, 0, "", None

    def push(self, row):
        tokens = math.ceil(len(self.text) / S.CHARS_PER_TOKEN) + math.ceil(len(row.body) / S.CHARS_PER_TOKEN) + 1
        if row.speaker == self.speaker and tokens <= self.cap:
            self.text = f"{self.text} {row.body}".rstrip()
            self.rows += 1
        else:
            yield from self.close()
            self.text, self.rows = row.raw, 1
        # a continuation paragraph ends the run
        self.speaker = None if "\n\n" in row.body else row.speaker

    def close(self):
        if self.rows:
            yield (self.key, self.block, self.rows, self.text)
            self.block += 1


def merge_turns(segments: DataFrame, max_tokens: int = S.MERGE_MAX_TOKENS) -> DataFrame:
    """Runs of one speaker become one block while it stays within max_tokens; rows of parse_segments in, meeting_id, block, n_segments, raw out.

    A continuation paragraph ends a run: it stays with its own row, and the next row opens a block.
    """
    rows = segments.select("meeting_id", "seg", "speaker", "body", "raw")
    return fold(rows, "meeting_id", "seg", lambda k: _Runs(k, max_tokens), "meeting_id string, block bigint, n_segments bigint, raw string")


def merge_transcripts(transcripts: DataFrame, max_tokens: int = S.MERGE_MAX_TOKENS) -> DataFrame:
    """meeting_id, md: transcripts with their runs merged, under what stands before the first header; those in which nothing merges stay as they are."""
    blocks = merge_turns(parse_segments(transcripts), max_tokens)
    merged = blocks.groupBy("meeting_id").agg(F.max("n_segments").alias("most"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "raw"))), lambda x: x["raw"]), "\n\n").alias("__md"))
    changed = merged.where("most > 1").select(F.col("meeting_id").alias("__id"), "__md")
    parts = F.filter(F.transform(F.split("md", "\n\n", -1), strip), lambda b: b != "")
    first = F.array_position(F.transform(parts, lambda b: b.rlike("^" + S.HEADER)), True)
    head = F.slice(parts, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))
    d = transcripts.join(changed, F.col("meeting_id").cast("string") == F.col("__id"), "left")
    return d.select("meeting_id", F.when(F.col("__md").isNull(), F.col("md")).otherwise(F.array_join(F.concat(head, F.array("__md")), "\n\n")).alias("md"))


class _Chunks:
    """The open chunk's rows. A chunk that would overflow closes and leaves its tail for the next."""

    def __init__(self, key, most: int, overlap: int):
        self.key, self.most, self.overlap, self.no, self.rows, self.total = key, most, overlap, 0, [], 0

    def push(self, row):
        if self.rows and self.total + row.tokens > self.most:
            yield from self.close()
            tail, kept = 0, len(self.rows)
            while kept > 1 and tail + self.rows[kept - 1].tokens <= self.overlap:
                kept -= 1
                tail += self.rows[kept].tokens
            self.rows, self.total, self.no = self.rows[kept:], tail, self.no + 1
        self.rows.append(row)
        self.total += row.tokens

    def close(self):
        if self.rows:
            yield (self.key, self.no, [r.seg for r in self.rows], "\n\n".join(r.raw for r in self.rows), self.rows[0].start_seconds, self.rows[-1].start_seconds)


def split_into_chunks(segments: DataFrame, max_tokens: int = S.CHUNK_MAX_TOKENS, overlap_tokens: int = S.CHUNK_OVERLAP_TOKENS) -> DataFrame:
    """meeting_id, chunk, segs, text, start_seconds, end_seconds: rows packed in order under max_tokens, each chunk opening with the tail of the one before.

    No row is split: one of more than max_tokens has a chunk of its own. The tail leaves out a chunk's
    first row and ends at the first row that doesn't fit overlap_tokens. A chunk ends where its last row starts.
    """
    if overlap_tokens >= max_tokens:
        raise ValueError(f"an overlap of {overlap_tokens} tokens must be below the {max_tokens} of a chunk")
    rows = segments.select("meeting_id", F.col("seg").cast("bigint").alias("seg"), "raw", F.col("start_seconds").cast("int").alias("start_seconds"), estimate_tokens(F.col("raw")).alias("tokens"))
    return fold(rows, "meeting_id", "seg", lambda k: _Chunks(k, max_tokens, overlap_tokens), "meeting_id string, chunk bigint, segs array<bigint>, text string, start_seconds int, end_seconds int")


class _Spans:
    """Group of voiced stretches that spans at most so many seconds."""

    def __init__(self, key, span: float):
        self.key, self.span, self.no, self.n, self.start, self.end = key, span, 0, 0, None, None

    def push(self, row):
        if self.n and row.end - self.start > self.span:
            yield from self.close()
            self.no, self.n = self.no + 1, 0
        if not self.n:
            self.start = row.start
        self.n, self.end = self.n + 1, row.end

    def close(self):
        if self.n:
            yield (self.key, self.no, self.n, self.start, self.end)


def group_by_span(stretches: DataFrame, span: float = S.VAD_SPAN_SECONDS) -> DataFrame:
    """Stretches (meeting_id, seq, start, end) in order, grouped while a group's end less its start stays within span: meeting_id, grp, n, start, end."""
    kind = stretches.schema["start"].dataType.simpleString()
    rows = stretches.where("start IS NOT NULL AND end IS NOT NULL").select("meeting_id", "seq", "start", "end")
    return fold(rows, "meeting_id", "seq", lambda k: _Spans(k, span), f"meeting_id string, grp bigint, n bigint, start {kind}, end {kind}")
