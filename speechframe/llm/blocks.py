"""Blocks of texts that meet by shared keys, without moving the texts again.

Texts are packed into compressed blocks in a bucketed table. What two documents may share is found in
two exchanges of short records between blocks and the tasks that own keys: first which keys more than
one document has, then, for those, one record of each block for each key. A frequent key sends one
record a block however many documents have it.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframe.llm.common import shared_dir, written

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Bytes of all texts for each task that owns keys, and for each bucket of blocks.
KEY_TASK_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
KEY_BITS = np.uint64((1 << 39) - 1)
COLUMNS = ["block", "texts", "sizes", "ids", "known"]


@functools.cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@functools.cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeezed(data: bytes, level: int = 1) -> bytes:
    return _compressor(level).compress(data)


def unsqueezed(data: bytes) -> bytes:
    return _decompressor().decompress(data) if data else b""


def record(values: list, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """A batch of one row."""
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def batch_of(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """A batch of some rows, or none."""
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def sort_order(keys: np.ndarray) -> np.ndarray:
    """The order of unsigned 64-bit keys, equal ones by their place. Numbers that end in their place are sorted, which takes numpy a third of an argsort's time."""
    bits = np.uint64(len(keys).bit_length())
    low, place = (np.uint64(1) << bits) - np.uint64(1), np.arange(len(keys), dtype=np.uint64)
    if int(keys.max(initial=0)) >> int(64 - bits) == 0:
        return (np.sort(keys << bits | place) & low).astype(np.int64)
    order = (np.sort(keys & ~low | place) & low).astype(np.int64)
    # keys that differ in those last bits alone may have come out of order
    by_key = keys[order]
    return order if (by_key[1:] >= by_key[:-1]).all() else np.argsort(keys, kind="stable")


def ordered(*columns: np.ndarray) -> np.ndarray:
    """The order of rows of integers from 0 on by the first column, then the second and so on; as one number each where they fit."""
    sizes = [int(c.max(initial=0)) + 1 for c in columns]
    if math.prod(sizes) >= 1 << 63:
        return np.lexsort(columns[::-1])
    key = columns[0].astype(np.int64)
    for c, n in zip(columns[1:], sizes[1:], strict=True):
        key = key * n + c
    return sort_order(key.astype(np.uint64))


def by_task(keys: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by the task that owns them, else as they are, and the bounds of each task's keys in it."""
    # numpy sorts short integers by radix
    task = (keys % np.uint64(tasks)).astype(np.uint16 if tasks <= 1 << 16 else np.int64)
    return np.argsort(task, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(task, minlength=tasks))])


def rows_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict]:
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() for n, c in zip(names, columns, strict=True)}


class TextBlock:
    """The texts of a block as one array of bytes; known tells which have a doc_id."""

    def __init__(self, row: dict):
        self.raw = unsqueezed(row["texts"])
        self.sizes, self.ids = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.end = np.cumsum(self.sizes)
        self.begin = self.end - self.sizes

    def texts(self) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True)]


class Keys:
    """The distinct keys of a block, ordered by the task that owns them, from the keys and doc_ids of all places."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, tasks: int):
        order = sort_order(keys)
        keys, ids = keys[order], ids[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.number = np.empty(len(keys), dtype=np.int64)  # of each place's key among the distinct ones
        self.number[order] = np.cumsum(new) - 1
        shared = np.zeros(len(first), dtype=bool)
        shared[self.number[order[1:][~new[1:] & (ids[1:] != ids[:-1])]]] = True
        self.order, self.edges = by_task(keys[first], tasks)
        self.keys, self.shared = keys[first][self.order], shared[self.order]
        self.tasks = tasks

    def codes(self) -> Iterator[tuple[int, bytes]]:
        """(task, five bytes for each key: 39 bits of it and whether texts of two ids share it)."""
        code = (self.keys // np.uint64(self.tasks) & KEY_BITS) << np.uint64(1) | self.shared.astype(np.uint64)
        short = np.ascontiguousarray(code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        for k in np.flatnonzero(np.diff(self.edges)).tolist():
            yield k, short[self.edges[k] : self.edges[k + 1]].tobytes()

    def _marked(self, flags: list[dict] | None) -> np.ndarray:
        marked = np.zeros(len(self.keys), dtype=bool)
        for f in flags or ():
            a, b = self.edges[f["task"]], self.edges[f["task"] + 1]
            marked[a:b] = np.unpackbits(np.frombuffer(f["bits"], dtype=np.uint8), count=b - a)
        return marked

    def flagged(self, flags: list[dict] | None) -> np.ndarray:
        """The keys that another document may have as well, sorted; a few more by collisions of their 39 bits."""
        return np.sort(self.keys[self._marked(flags)])

    def flagged_places(self, flags: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys as flagged() has them, the places that have one, and which one."""
        marked, keys = np.zeros(len(self.keys), dtype=bool), np.empty_like(self.keys)
        marked[self.order], keys[self.order] = self._marked(flags), self.keys
        at = np.flatnonzero(marked[self.number])
        return keys[marked], at, (np.cumsum(marked) - 1)[self.number[at]]


def found_in(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the values that the sorted array wanted has, and their places in it."""
    if not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    at = np.flatnonzero(wanted[place] == values)
    return at, place[at]


def bucketed_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """The table of blocks (columns COLUMNS), and the number of tasks that own keys. doc_id is cast to long; null texts are empty."""

    def pack(batches):
        part, count = TaskContext.get().partitionId(), 0
        held, ids, weight = [], [], 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in held], np.int64)
            values = [part << 32 | count, squeezed(b"".join(held), 3), sizes.tobytes(), np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is not None for i in ids], bool).tobytes()]
            return record(values, [pa.int64(), *[pa.binary()] * 4], COLUMNS)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                if held and weight + len(text) > BLOCK_BYTES:
                    yield block()
                    held, ids, weight, count = [], [], 0, count + 1
                held.append(text)
                ids.append(doc)
                weight += len(text)
        if held:
            yield block()

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, "block long, texts binary, sizes binary, ids binary, known binary")
    spark, name = docs.sparkSession, f"speechframe_blocks_{uuid.uuid4().hex}"
    # the files stand in the shared folder; the catalog's entry is only needed to read them as buckets
    rows.write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "uncompressed").bucketBy(max(8, math.ceil(total / BUCKET_BYTES)), "block").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return blocks, max(4, math.ceil(total / KEY_TASK_BYTES))


def shared_keys(blocks: DataFrame, keys_of: Callable[[dict], Keys]) -> DataFrame:
    """block, flags (array of task, bits): which of a block's distinct keys another document has as well."""

    def send(batches):
        for row in rows_of(batches, COLUMNS):
            sent = list(keys_of(row).codes())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sent], pa.int64()), pa.array([row["block"]] * len(sent), pa.int64()), pa.array([c for _, c in sent], pa.binary())], names=["task", "block", "keys"])

    def meet(group: pa.Table) -> pa.Table:
        blobs = group.column("keys").to_pylist()
        sizes = np.array([len(b) // 5 for b in blobs])
        code = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
        code[:, :5] = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 5)
        code = code.view("<u8").ravel()
        key, flag = code >> np.uint64(1), (code & np.uint64(1)).astype(bool)
        order = sort_order(key)
        same = key[order][1:] == key[order][:-1]
        flag[order[1:][same]] = True
        flag[order[:-1][same]] = True
        edges = np.concatenate([[0], np.cumsum(sizes)])
        bits = [np.packbits(flag[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"task": group.column("task"), "block": group.column("block"), "bits": pa.array(bits, pa.binary())})

    met = blocks.mapInArrow(send, "task long, block long, keys binary").groupBy("task").applyInArrow(meet, "task long, block long, bits binary")
    return written(met, "flags").groupBy("block").agg(F.collect_list(F.struct("task", "bits")).alias("flags"))
