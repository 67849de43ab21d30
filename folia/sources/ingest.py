"""Files as a Python data source, batch and stream: kind, size and digest without a row that holds the file.

A file is read in blocks; its digest is taken on the way and its content stays where it is. One over the size cap is
refused: after its size where the file system tells it, else at the block that goes over the cap. Partitions are
ranges of the listing, balanced by bytes. Paths are local or of a file system that is mounted on all executors.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .readers import MAGIC

SCHEMA = "path string, length long, mime string, sha256 string, refused string"
BLOCK = 1 << 20


def described(path: str, cap: int | None, block: int = BLOCK) -> tuple:
    """path, length, mime, sha256, refused: a file's row; what is over the cap has no digest."""
    if cap is not None and os.path.getsize(path) > cap:
        return path, os.path.getsize(path), None, None, "too large"
    digest, length, head = hashlib.sha256(), 0, b""
    with open(path, "rb") as f:
        while part := f.read(block):
            head = head or part[:4]
            length += len(part)
            if cap is not None and length > cap:  # it has grown since
                return path, length, None, None, "too large"
            digest.update(part)
    kind = next((k for k, m in MAGIC if head.hex().upper().startswith(m)), "application/octet-stream")
    return path, length, kind, digest.hexdigest(), "empty" if not length else None


class Some(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


def listed(folder: str) -> list[tuple[str, int, float]]:
    return sorted((os.path.join(at, n), os.path.getsize(os.path.join(at, n)), os.path.getmtime(os.path.join(at, n))) for at, _, names in os.walk(folder) for n in names)


def balanced(files: list[tuple[str, int]], parts: int) -> list[Some]:
    """The files, largest first, each to the partition with the fewest bytes so far."""
    held: list[list] = [[0, k, []] for k in range(max(1, min(parts, len(files))))]
    import heapq

    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        least = heapq.heappop(held)
        least[2].append(path)
        heapq.heappush(held, [least[0] + size, least[1], least[2]])
    return [Some(h[2]) for h in sorted(held, key=lambda h: h[1]) if h[2]]


def _batches(paths: list[str], cap: int | None) -> Iterator[pa.RecordBatch]:
    for path in paths:
        row = described(path, cap)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["path", "length", "mime", "sha256", "refused"])


class FileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.parts = options["path"].removeprefix("file://"), int(options.get("parts", 8))
        self.cap = int(options["cap"]) if "cap" in options else None

    def partitions(self) -> list[InputPartition]:
        return balanced([f[:2] for f in listed(self.folder)], self.parts)

    def read(self, partition: Some) -> Iterator[pa.RecordBatch]:
        return _batches(partition.paths, self.cap)


class FileStream(SimpleDataSourceStreamReader):
    """New files since the last one seen, by time of change and path; the offset is the last pair."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"].removeprefix("file://")
        self.cap = int(options["cap"]) if "cap" in options else None

    def initialOffset(self) -> dict:
        return {"time": 0.0, "path": ""}

    def _between(self, start: dict, end: dict | None) -> list[tuple[float, str]]:
        seen = sorted((changed, path) for path, _, changed in listed(self.folder))
        return [f for f in seen if f > (start["time"], start["path"]) and (end is None or f <= (end["time"], end["path"]))]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        new = self._between(start, None)
        end = {"time": new[-1][0], "path": new[-1][1]} if new else start
        return iter([described(p, self.cap) for _, p in new]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([described(p, self.cap) for _, p in self._between(start, end)])

    def commit(self, end: dict) -> None:
        pass


class IngestedFiles(DataSource):
    """Spark.read.format("folia_files").option("cap", bytes).load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "folia_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FileReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FileStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IngestedFiles)
