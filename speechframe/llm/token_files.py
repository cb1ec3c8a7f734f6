"""Token ids as Parquet: files in the order of ids, ids as dictionary-coded lists, places as deltas, pages with indexes.

Documents are dealt over tasks by ranges of their id and sorted there; each task encodes its range and
writes one file. A row holds how many ids its file has before it, and a small table beside the files how
many all files before have, so a place in the whole stream needs no pass over the ids. Row groups and
pages are small enough for the page indexes to pick single documents or spans of the stream.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechframe.llm.common import BROADCAST_ROWS, shared_dir, small_batches, without

#: Bytes of a row group and rows of a page of the ids; the indexes skip whole pages.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 512
#: Runs and pieces in each of the two generations that a worker remembers, and the longest it keeps.
MAX_MEMO, MEMO_CHARS = 250_000, 48
#: Texts that are joined to one array of ids at a time.
SLICE_ROWS = 128


#: The normaliser and pattern whose pieces are cut here: Latin-1 letters, digits and white space, A-Z and the like lower-cased.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_L, _N, _S = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_PIECES = re.compile(PATTERN.replace(r"[\p{L}]", f"[{_L}]").replace(r"[\p{N}]", f"[{_N}]").replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]")).findall


def _simple(text: str) -> bool:
    """Whether a text is Latin-1 and holds no start of a special token."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


class PieceEncoder:
    """Packed ids (little-endian 32-bit) of texts, as the tokenizers library gives them.

    If the tokenizer normalises and splits as stated above, texts are cut at spaces and line ends, which that
    pattern never matches and which nothing composes with. Runs of Latin-1 are cut into the pattern's pieces
    and each piece is merged by the library's model; the library encodes runs that hold other characters.
    Runs are remembered. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        steps = [json.loads(part.__getstate__()) if part else {} for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        cuts = [(c["type"], c.get("pattern"), c.get("behavior"), c.get("invert")) for c in steps[1].get("pretokenizers", [])]
        plain = all(t.content.startswith("<|") and not t.normalized for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cut = plain and steps[0].get("normalizers") == NORMALIZERS and cuts == [("Split", {"Regex": PATTERN}, "Removed", True), ("ByteLevel", None, None, None)]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(256)}
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern."""
        packed = self.pieces.get(piece) or self.older_pieces.get(piece)
        if packed is None:
            ids = [t.id for t in self.model.tokenize(piece if piece.isascii() and piece.isalnum() else piece.translate(self.bytes))]
            packed = struct.pack(f"<{len(ids)}i", *ids)
        if len(piece) <= MEMO_CHARS:
            if len(self.pieces) >= MAX_MEMO:
                self.pieces, self.older_pieces = {}, self.pieces
            self.pieces[piece] = packed
        return packed

    def _run(self, run: str) -> bytes:
        ids = self.older.get(run)
        if ids is None:
            if not _simple(run):
                ids = self._library(run)
            elif run.isalpha():  # most runs are one word, or one and a sign
                ids = self._piece(run.lower())
            elif run[:-1].isalpha() and run[-1] in ".,;:!?":
                ids = self._piece(run[:-1].lower()) + self._piece(run[-1])
            else:
                ids = b"".join(map(self._piece, _PIECES(run.lower())))
        if len(run) <= MEMO_CHARS:
            self.runs[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.cut:
            return self._library(text)
        runs = (text.lower() if _simple(text) else text).replace("\n", " ").split(" ")
        parts = list(map(self.runs.get, runs))
        if None in parts:
            if len(self.runs) >= MAX_MEMO:
                self.runs, self.older = {}, self.runs
            parts = [self._run(run) if part is None else part for run, part in zip(runs, parts, strict=True)]
        return b"".join(parts)


_encoders: dict[str, PieceEncoder] = {}


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """file, at (ids before it in the file), n_tokens and ids in place of text; a task is a file."""
    others = [f for f in docs.schema if f.name != "text"]
    schema = T.StructType([*others, *(T.StructField(n, t, False) for n, t in (("file", T.IntegerType()), ("at", T.LongType()), ("n_tokens", T.LongType()))), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        if path not in _encoders:
            _encoders[path] = PieceEncoder(path)
        encode, file, before, end = _encoders[path].encode, TaskContext.get().partitionId(), 0, np.array([end_id], "<i4").tobytes()
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(a, SLICE_ROWS)
                packed = [encode(text or "") + end for text in batch.column("text").to_pylist()]
                sizes = np.array([len(b) >> 2 for b in packed], np.int64)
                at = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                kept = [batch.column(f.name) for f in others]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(sizes), file, np.int32)), pa.array(at), pa.array(sizes), ids], names=schema.names)

    return docs.mapInArrow(run, schema)


def write_tokens(
    df: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
    row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
) -> None:
    """Writes path/tokens (id, the kept columns, file, at, n_tokens, ids) and path/files (file, before, n_tokens, first, last).

    Rows stand in ascending order of id, nulls first, equal ids by a hash of the text. Every row ends with
    end_id. Null and empty texts are end_id alone; texts are taken whole, whatever their length; repeated
    rows are each written; an empty table gives files without rows; kept columns that clash with the
    format's own names are left out, other columns are ignored. Ids are dictionary-coded, numbers are
    coded as deltas. Rows of one id may be dealt over several files, as a row number breaks ties.
    """
    small_batches(df.sparkSession)
    own = without(df.select(*[c for c in keep if c in df.columns]), [id_col, "text", "file", "at", "n_tokens", "ids"]).columns
    docs = df.select(F.col(id_col), F.col(text_col).alias("text"), *own)
    tie = (F.xxhash64("text"), F.monotonically_increasing_id())
    keyed = docs.withColumn("__h", tie[0]).withColumn("__n", tie[1])
    dealt = keyed.repartitionByRange(F.asc_nulls_first(id_col), "__h", "__n").sortWithinPartitions(F.asc_nulls_first(id_col), "__h", "__n").drop("__h", "__n")
    numbers = {f"parquet.enable.dictionary#{c}": "false" for c in (id_col, "at", "n_tokens")}
    options = {"parquet.writer.version": "v2", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows), **numbers}
    _encoded(dealt, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id).write.options(**options).parquet(f"{path}/tokens")
    files = df.sparkSession.read.parquet(f"{path}/tokens").groupBy("file").agg(F.sum("n_tokens").alias("n_tokens"), F.min(id_col).alias("first"), F.max(id_col).alias("last"))
    before = "coalesce(sum(n_tokens) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"  # a row for each file
    files.selectExpr("file", f"{before} AS before", "n_tokens", "first", "last").coalesce(1).write.parquet(f"{path}/files")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with start, the number of ids of all rows before; a plan that leaves ids out reads none, and filters reach the page indexes."""
    files = spark.read.parquet(f"{path}/files").select("file", "before")
    few = files.count() <= BROADCAST_ROWS
    return spark.read.parquet(f"{path}/tokens").join(F.broadcast(files) if few else files, "file").withColumn("start", F.col("before") + F.col("at")).drop("before")


def read_span(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """start and ids of the stream's places first to last - 1: parts of the documents there. Files outside are not read, nor pages."""
    files = spark.read.parquet(f"{path}/files").where((F.col("before") < last) & (F.col("before") + F.col("n_tokens") > first)).collect()
    parts = []
    for f in files:  # the files that one span meets
        here = spark.read.parquet(f"{path}/tokens").where((F.col("file") == f.file) & (F.col("at") < last - f.before) & (F.col("at") + F.col("n_tokens") > first - f.before))
        start = F.col("at") + f.before
        skip = F.greatest(F.lit(0), F.lit(first) - start)
        size = F.least(F.col("n_tokens"), F.lit(last) - start) - skip
        parts.append(here.select((start + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), size.cast("int")).alias("ids")))
    if not parts:
        return spark.createDataFrame([], "start long, ids array<int>")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ids_crc32(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """rows with ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers, in place of ids."""
    kept = rows.drop(ids).columns
    schema = T.StructType([*rows.drop(ids).schema.fields, T.StructField("ids_crc32", T.LongType(), False)])

    def run(batches):
        for batch in batches:
            column = batch.column(ids)
            flat, ends = column.values.to_numpy().astype("<i4", copy=False), column.offsets.to_numpy().tolist()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(crc, pa.int64())], names=schema.names)

    return rows.select(*kept, ids).mapInArrow(run, schema)


def digest(df: DataFrame, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every row, from files that are written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/speechframe-tokens-{uuid.uuid4().hex}"
    write_tokens(df, path, tokenizer, end_id, id_col, text_col)
    return ids_crc32(read_documents(spark, path).select(id_col, "start", "n_tokens", "ids"))
