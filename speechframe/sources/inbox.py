"""A streaming source of a folder's files that have stopped growing: format "stable_files".

Each look lists the folder. A file is admitted when two looks some seconds apart find it of the same size,
not empty; it is admitted once for as long as it stays. An admission is a numbered list in the source's
state folder, written whole before its number is told to Spark, so a restarted stream gets the same files
for a number it had begun, and none again that it had finished.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from speechframe import schema as S

SCHEMA = "path string, name string, length bigint, modified timestamp"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def look(path: str, endings: tuple[str, ...]) -> dict[str, tuple[int, float]]:
    """By path: size and time of change of a folder's files with the given endings (case-blind), hidden ones left out."""
    store, folder = _store(path)
    found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return {f.path: (f.size, f.mtime.timestamp()) for f in found if f.type == pafs.FileType.File and f.base_name.rpartition(".")[2].lower() in endings and not f.base_name.startswith((".", "_"))}


class Admitted(InputPartition):
    """Some files of one admission."""

    def __init__(self, files: list):
        super().__init__(None)
        self.files = files


class StableFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.state = options["path"], options["state"].rstrip("/")
        self.endings = tuple(e.strip().lower() for e in options.get("endings", ",".join(S.AUDIO_EXTENSIONS)).split(","))
        self.settle, self.most = float(options.get("settle", 2.0)), int(options.get("maxFiles", 1000))
        self.per_task = int(options.get("filesPerTask", 100))

    def _file(self, number: int) -> tuple[pafs.FileSystem, str]:
        store, folder = _store(self.state)
        return store, f"{folder}/{number:012d}.json"

    def _numbers(self) -> list[int]:
        store, folder = _store(self.state)
        names = [f.base_name for f in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, number: int) -> dict:
        if number == 0:
            return {"new": [], "seen": {}}
        store, file = self._file(number)
        with store.open_input_file(file) as stream:
            return json.loads(stream.read())

    def _save(self, number: int, entry: dict) -> None:
        store, file = self._file(number)
        store.create_dir(file.rpartition("/")[0])
        beside = f"{file}.{uuid.uuid4().hex}"
        with store.open_output_stream(beside) as stream:
            stream.write(json.dumps(entry).encode())
        store.move(beside, file)

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        """Two looks; what both agree on and no earlier admission holds is admitted under the next number, maxFiles at a time, oldest first."""
        n = max(self._numbers(), default=0)
        seen = self._load(n)["seen"]
        first = look(self.path, self.endings)
        fresh = [p for p, (size, _) in first.items() if size > 0 and p not in seen]
        if fresh:
            time.sleep(self.settle)
            again = look(self.path, self.endings)
            stable = sorted((p for p in fresh if again.get(p) == first[p]), key=lambda p: (first[p][1], p))[: self.most]
            if stable:
                # a file that has left the folder may come again under its name
                kept = {p: 1 for p in seen if p in again} | {p: 1 for p in stable}
                self._save(n + 1, {"new": [[p, *first[p]] for p in stable], "seen": kept})
                n += 1
        return {"n": n}

    def partitions(self, start: dict, end: dict) -> list[Admitted]:
        files = [f for n in range(start["n"] + 1, end["n"] + 1) for f in self._load(n)["new"]]
        return [Admitted(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)]

    def read(self, partition: Admitted) -> Iterator[pa.RecordBatch]:
        paths, sizes, times = zip(*partition.files, strict=True)
        names = [p.rpartition("/")[2] for p in paths]
        at = pa.array([round(t * 1e6) for t in times], pa.int64()).cast(pa.timestamp("us", "UTC"))
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(names), pa.array(sizes, pa.int64()), at], names=["path", "name", "length", "modified"])

    def commit(self, end: dict) -> None:
        """Lists before the finished one are not needed again; it holds what was seen."""
        for n in self._numbers():
            if n < end["n"]:
                store, file = self._file(n)
                store.delete_file(file)


class StableFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stable_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> StableFilesReader:
        return StableFilesReader(self.options)


def stable_files_stream(spark: SparkSession, path: str, state: str, settle: float = 2.0, max_files: int = 1000, endings: tuple[str, ...] = S.AUDIO_EXTENSIONS) -> DataFrame:
    """path, name, length, modified of a folder's files as they come to rest, each once, at most max_files a batch.

    state is a folder of the stream's own, beside its checkpoint; with no new file there is no batch.
    """
    spark.dataSource.register(StableFiles)
    options = {"state": state, "settle": str(settle), "maxFiles": str(max_files), "endings": ",".join(endings)}
    return spark.readStream.format("stable_files").options(**options).load(path)
