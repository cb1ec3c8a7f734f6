"""A batch source of WAV files: format "waveform". A long recording is many tasks.

The driver lists files and deals out ranges of bytes. Each task reads the head of its file and the frames
that start in its range, so no task reads more than its range and no frame is read twice. Samples come out
channel by channel, as fractions of full scale.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from speechframe.sources.inbox import _store

SCHEMA = "path string, sample_rate int, channels int, frame bigint, waveform array<array<float>>"
#: Bytes of a task and frames of a row.
RANGE_BYTES, BLOCK_FRAMES = 64 << 20, 65_536
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


class Head:
    """What the chunks before the samples say: rate, channels, kind and size of a sample, and where the samples are."""

    def __init__(self, stream, size: int, path: str):
        riff = stream.read_at(12, 0)
        if len(riff) < 12 or riff[:4] not in (b"RIFF", b"RF64") or riff[8:12] != b"WAVE":
            raise ValueError(f"{path} is not a WAV file")
        at, form = 12, None
        while at + 8 <= size:
            name, length = struct.unpack("<4sI", stream.read_at(8, at))
            if name == b"fmt ":
                form = stream.read_at(min(length, 40), at + 8)
            elif name == b"data":
                break
            at += 8 + length + (length & 1)
        else:
            raise ValueError(f"{path} holds no samples")
        if form is None or len(form) < 16:
            raise ValueError(f"{path} doesn't say what its samples are")
        kind, self.channels, self.rate, _, self.frame_bytes, bits = struct.unpack("<HHIIHH", form[:16])
        if kind == EXTENSIBLE and len(form) >= 26:
            kind = struct.unpack("<H", form[24:26])[0]
        self.width = bits // 8
        if kind not in (PCM, FLOAT) or not self.channels or self.width * self.channels != self.frame_bytes or self.width not in ((4, 8) if kind == FLOAT else (1, 2, 3, 4)):
            raise ValueError(f"{path}: samples of kind {kind} with {bits} bits aren't read")
        self.kind, self.start = kind, at + 8
        # a recorder that died left a length of 0 or of all ones: the rest of the file is sound
        rest = size - self.start
        self.frames = (rest if length in (0, 0xFFFFFFFF) else min(length, rest)) // self.frame_bytes

    def samples(self, raw: bytes) -> np.ndarray:
        """Frames as float32, a row a channel."""
        if self.kind == FLOAT:
            flat = np.frombuffer(raw, f"<f{self.width}").astype(np.float32)
        elif self.width == 1:
            flat = (np.frombuffer(raw, "<u1").astype(np.float32) - 128) / 128
        elif self.width == 3:
            wide = np.zeros((len(raw) // 3, 4), np.uint8)
            wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
            flat = (wide.view("<i4")[:, 0] >> 8).astype(np.float32) / (1 << 23)
        else:
            flat = (np.frombuffer(raw, f"<i{self.width}").astype(np.float64) / (1 << (8 * self.width - 1))).astype(np.float32)
        return flat.reshape(-1, self.channels).T


class Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        super().__init__(None)
        self.path, self.size, self.start, self.end = path, size, start, end


class WaveformReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.uri = options["path"], "://" in options["path"]
        self.range_bytes, self.block = int(options.get("rangeBytes", RANGE_BYTES)), int(options.get("blockFrames", BLOCK_FRAMES))

    def partitions(self) -> list[Range]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == pafs.FileType.File else [f for f in store.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File and f.extension.lower() == "wav"]
        return [Range(f.path, f.size, at, min(at + self.range_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, max(f.size, 1), self.range_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as stream:
            head = Head(stream, partition.size, partition.path)
            # the frames whose first byte lies in the range; what stands before the samples belongs to the first
            first, last = (max(0, min(head.frames, -(-(at - head.start) // head.frame_bytes))) for at in (partition.start, partition.end))
            for frame in range(first, last, self.block):
                n = min(self.block, last - frame)
                channels = head.samples(stream.read_at(n * head.frame_bytes, head.start + frame * head.frame_bytes))
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(channels) + 1) * n, n, dtype=np.int32)), pa.array(np.ascontiguousarray(channels).ravel()))
                waveform = pa.ListArray.from_arrays(pa.array([0, len(channels)], pa.int32()), inner)
                cells = [pa.array([partition.path]), pa.array([head.rate], pa.int32()), pa.array([head.channels], pa.int32()), pa.array([frame], pa.int64()), waveform]
                yield pa.RecordBatch.from_arrays(cells, names=["path", "sample_rate", "channels", "frame", "waveform"])


class Waveform(DataSource):
    @classmethod
    def name(cls) -> str:
        return "waveform"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WaveformReader:
        return WaveformReader(self.options)


def load_waveform(spark: SparkSession, path: str, block_frames: int = BLOCK_FRAMES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, sample_rate, channels, frame, waveform (channel, time) of a WAV file or of all in a folder, a row a block of frames.

    Nothing is resampled or mixed. A range's blocks start at the range, so frame tells where a block
    stands; bytes at the end that fill no frame are left out. A file that isn't WAV fails the query.
    """
    spark.dataSource.register(Waveform)
    return spark.read.format("waveform").option("blockFrames", block_frames).option("rangeBytes", range_bytes).load(path)


def as_blocks(waveform: DataFrame) -> DataFrame:
    """session, block_no, n, samples of a waveform's rows for rotate(), mix() and measure_peaks(): blocks in order, channels averaged."""
    from pyspark.sql import Window as W

    mono = F.transform(F.col("waveform")[0], lambda x, i: F.aggregate("waveform", F.lit(0.0).cast("double"), lambda a, c: a + F.get(c, i)) / F.col("channels"))
    order = W.partitionBy("path").orderBy("frame")  # a row a block, not a frame
    return waveform.select(F.col("path").alias("session"), F.row_number().over(order).alias("block_no"), F.size(F.col("waveform")[0]).alias("n"), mono.alias("samples"))
