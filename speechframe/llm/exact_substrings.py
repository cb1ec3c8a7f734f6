"""Exact substring dedup with suffix arrays over what can repeat.

The 50-byte windows of a text are keyed by the least hash of the 20-byte strings inside them, so equal
windows have equal keys and a run of neighbouring windows shares one. First only keys travel: a key
that one document alone has cannot repeat. Then the runs of the other keys travel, each distinct
string of a block of texts once, to the task that owns the key. It sorts their suffixes in two stages,
reads equal windows off the adjacent common prefixes, and returns the least doc_id of each window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.llm.blocks import COLUMNS, Keys, TextBlock, bucketed_blocks, found_in, record, rows_of, shared_keys, squeezed, unsqueezed
from speechframe.llm.shingles import _ranges, mixed
from speechframe.llm.suffix_array import common_prefixes, sorted_starts

#: Bytes of text that are hashed at a time.
SEGMENT_BYTES = 1 << 16
GRAM = 20


def _least_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """For each window of size bytes: the least hash of the GRAM-byte strings in it."""
    base, h, width, done = np.uint64(0x9E3779B97F4A7C15), data.astype(np.uint64) + np.uint64(1), 1, {}
    while width <= GRAM:
        done[width] = h
        h = h[:-width] + h[width:] * np.uint64(pow(int(base), width, 1 << 64)) if len(h) > width else h[:0]
        width *= 2
    out, at = None, 0
    n = len(data) - GRAM + 1
    for width in sorted(done, reverse=True):
        if GRAM - at >= width:
            part = done[width][at : at + n] * np.uint64(pow(int(base), at, 1 << 64))
            out = part if out is None else out + part
            at += width
    least, span, width = mixed(out), size - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (span - width)], least[span - width :])


class RunBlock(TextBlock):
    """The texts of a block, and the runs of windows with one key in them."""

    def __init__(self, row: dict, tasks: int, size: int):
        super().__init__(row)
        self.tasks, self.size = tasks, size
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        # texts without a doc_id neither repeat nor are repeated
        windows = np.where(self.known, np.maximum(self.sizes - size + 1, 0), 0)
        starts, keys, runs, texts = [], [], [], []
        for a in range(0, max(len(self.data) - size + 1, 0), SEGMENT_BYTES):
            key = _least_hashes(self.data[a : a + SEGMENT_BYTES + size - 1], size)
            text = np.searchsorted(self.end, np.arange(a, a + len(key)), side="right")
            valid = np.arange(a, a + len(key)) - self.begin[text] < windows[text]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
            at = np.flatnonzero(new)
            long = np.diff(np.append(at, len(key)))
            keep = valid[at]
            starts.append(at[keep] + a)
            runs.append(long[keep])
            keys.append(key[at[keep]])
            texts.append(text[at[keep]])
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.starts, self.runs, self.run_keys, self.run_texts = whole(starts, np.int64), whole(runs, np.int64), whole(keys, np.uint64), whole(texts, np.int64)
        self.keys = Keys(self.run_keys, self.ids[self.run_texts], tasks)

    def strings(self, flags: list[dict] | None) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """The runs whose keys are flagged, each one's string, the distinct strings (by task), their tasks and least ids."""
        runs, _ = found_in(self.run_keys, self.keys.flagged(flags))
        raw, number, strings, least, owner = self.raw, {}, [], [], []
        which = np.zeros(len(runs), dtype=np.int64)
        own = (self.run_keys[runs] % np.uint64(self.tasks)).tolist()
        ids = self.ids[self.run_texts[runs]].tolist()
        ends = (self.starts[runs] + self.runs[runs] + self.size - 1).tolist()
        for i, (a, b, doc, k) in enumerate(zip(self.starts[runs].tolist(), ends, ids, own, strict=True)):
            string = raw[a:b]
            n = number.get(string)
            if n is None:
                n = number[string] = len(strings)
                strings.append(string)
                least.append(doc)
                owner.append(k)
            elif doc < least[n]:
                least[n] = doc
            which[i] = n
        owner = np.array(owner, dtype=np.int64)
        by = np.argsort(owner, kind="stable")
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.arange(len(by))
        return runs, rank[which], [strings[i] for i in by], owner[by], np.array(least, dtype=np.int64)[by]


def window_least(strings: list[bytes], ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings' first bytes and lengths in their concatenation, and for each window start there the least id of all
    strings that hold its bytes.

    A string whose key no other one has holds no window of another, so its windows have its own id.
    The suffixes of the others are sorted, and windows are equal where neighbours have size bytes in common.
    """
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    length = np.array([len(s) for s in strings], dtype=np.int64)
    first = np.cumsum(length) - length
    key = np.concatenate([_least_hashes(data[a : a + SEGMENT_BYTES + size - 1], size) for a in range(0, len(data) - size + 1, SEGMENT_BYTES)])[first]
    _, number, times = np.unique(key, return_inverse=True, return_counts=True)
    several = times[number] > 1
    out = np.repeat(ids, length)
    order = sorted_starts(data, first[several], length[several], size)
    if len(order):
        equal = common_prefixes(data, order, size) >= size
        starts = np.flatnonzero(np.concatenate([[True], ~equal]))
        out[order] = np.repeat(np.minimum.reduceat(out[order], starts), np.diff(np.append(starts, len(order))))
    return first, length, out


def _least_ids(flagged: DataFrame, tasks: int, size: int) -> DataFrame:
    """block, least (array of task, ids): for each window of a block's distinct flagged strings the least doc_id that has it."""

    def send(batches):
        for row in rows_of(batches, [*COLUMNS, "flags"]):
            _, _, strings, owner, least = RunBlock(row, tasks, size).strings(row["flags"])
            edges = np.searchsorted(owner, np.arange(tasks + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = strings[edges[k] : edges[k + 1]]
                values = [k, row["block"], squeezed(b"".join(own)), np.array([len(s) for s in own], np.int32).tobytes(), least[edges[k] : edges[k + 1]].tobytes()]
                yield record(values, [pa.int64(), pa.int64(), *[pa.binary()] * 3], ["task", "block", "strings", "lengths", "least"])

    def sort(group: pa.Table) -> pa.Table:
        number, strings, least, uses = {}, [], [], []
        for packed, lengths, ids in zip(*(group.column(c).to_pylist() for c in ("strings", "lengths", "least")), strict=True):
            raw, at, use = unsqueezed(packed), 0, []
            for n, doc in zip(np.frombuffer(lengths, np.int32).tolist(), np.frombuffer(ids, np.int64).tolist(), strict=True):
                string = raw[at : at + n]
                at += n
                known = number.get(string)
                if known is None:
                    known = number[string] = len(strings)
                    strings.append(string)
                    least.append(doc)
                elif doc < least[known]:
                    least[known] = doc
                use.append(known)
            uses.append(np.array(use, dtype=np.int64))
        del number
        first, length, lowest = window_least(strings, np.array(least, dtype=np.int64), size)
        out = [squeezed(lowest[_ranges(first[u], length[u] - size + 1)].tobytes()) for u in uses]
        return pa.table({"task": group.column("task"), "block": group.column("block"), "ids": pa.array(out, pa.binary())})

    met = flagged.mapInArrow(send, "task long, block long, strings binary, lengths binary, least binary").groupBy("task").applyInArrow(sort, "task long, block long, ids binary")
    return met.groupBy("block").agg(F.collect_list(F.struct("task", "ids")).alias("least"))


def remove_repeats(docs: DataFrame, size: int = 50) -> DataFrame:
    """Per document row: doc_id, n_bytes, spans (array of start, end in bytes: what repeats an earlier document) and kept
    (binary: the other bytes).

    A byte goes if a string of size bytes that covers it also starts in a document with a smaller
    doc_id; strings are judged on the input. Null texts are empty; a null doc_id is neither smaller nor
    larger than another, so its text stays and takes nothing away; rows with one doc_id do not affect
    each other; an empty table stays empty; other columns are ignored.
    """
    blocks, tasks = bucketed_blocks(docs)
    flagged = blocks.join(shared_keys(blocks, lambda row: RunBlock(row, tasks, size).keys), "block", "left")
    least = _least_ids(flagged, tasks, size)

    def cut(batches):
        for row in rows_of(batches, [*COLUMNS, "flags", "least"]):
            block = RunBlock(row, tasks, size)
            gone = np.zeros(len(block.data) + 1, dtype=np.int32)
            if row["flags"] and row["least"]:
                runs, which, strings, _, _ = block.strings(row["flags"])
                windows = np.array([len(s) - size + 1 for s in strings], dtype=np.int64)
                lowest = np.concatenate([np.frombuffer(unsqueezed(x["ids"]), np.int64) for x in sorted(row["least"], key=lambda x: x["task"])])
                at = np.cumsum(windows) - windows
                starts = _ranges(block.starts[runs], block.runs[runs])
                ids = np.repeat(block.ids[block.run_texts[runs]], block.runs[runs])
                hit = starts[lowest[_ranges(at[which], block.runs[runs])] < ids]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + size, -1)
            gone = np.cumsum(gone)[:-1] > 0
            raw, ids, kept, spans, sizes = block.raw, [], [], [], []
            for i, (a, b) in enumerate(zip(block.begin.tolist(), block.end.tolist(), strict=True)):
                edge = np.flatnonzero(np.diff(gone[a:b], prepend=False, append=False)).tolist()
                cuts = list(zip(edge[0::2], edge[1::2], strict=True))
                ids.append(int(block.ids[i]) if block.known[i] else None)
                sizes.append(b - a)
                spans.append([{"start": s, "end": e} for s, e in cuts])
                kept.append(b"".join(raw[a + s : a + e] for s, e in zip([0, *edge[1::2]], [*edge[0::2], b - a], strict=True)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return flagged.join(least, "block", "left").mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digest(docs: DataFrame, size: int = 50) -> DataFrame:
    return remove_repeats(docs, size).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
