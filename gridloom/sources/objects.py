"""Objects below a URI, read by byte ranges and written whole; the working folder.

Any store that pyarrow opens will do (file, s3, gs, hdfs). Tasks read and write for
themselves, so nothing passes through the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Ranges that lie closer than this are read as one.
GAP = 4096

_own_dirs: dict[str, str] = {}


def working_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; in a
    temporary one only where that setting is unset and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        named = _own_dirs.setdefault(app, _own_dirs.get(app) or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"{named}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the working folder: cuts lineage, and a lost executor costs
    a read."""
    path = working_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(ranges: list[tuple[int, int]], gap: int = GAP) -> list[tuple[int, int]]:
    """``(start, size)`` ranges in order, those nearer than ``gap`` joined."""
    out: list[tuple[int, int]] = []
    for start, size in sorted(ranges):
        if out and start <= out[-1][0] + out[-1][1] + gap:
            first, had = out[-1]
            out[-1] = (first, max(had, start + size - first))
        else:
            out.append((start, size))
    return out


class Store:
    """The objects below a URI. ``reads`` lists the ranges read: (name, start, size)."""

    def __init__(self, uri: str) -> None:
        if uri.startswith("file:/") and not uri.startswith("file:///"):
            uri = "file://" + uri[5:]
        self.system, self.root = fs.FileSystem.from_uri(uri)
        self.reads: list[tuple[str, int, int]] = []

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}" if name else self.root

    def size(self, name: str) -> int | None:
        """An object's size, or null where there is none."""
        info = self.system.get_file_info(self._path(name))
        return info.size if info.type == fs.FileType.File else None

    def read(self, name: str, start: int = 0, size: int | None = None) -> bytes:
        """Bytes ``start`` to ``start + size``; a range beyond the end is an error."""
        with self.system.open_input_file(self._path(name)) as f:
            size = f.size() - start if size is None else size
            self.reads.append((name, start, size))
            data = f.read_at(size, start)
        if len(data) != size:
            raise ValueError(f"{name}: {size} bytes at {start} were asked for, {len(data)} are there")
        return data

    def ranges(self, name: str, wanted: list[tuple[int, int]], gap: int = GAP) -> dict[tuple[int, int], bytes]:
        """Each wanted range's bytes; near ones are one read."""
        out, left = {}, sorted(set(wanted))
        for start, size in merged(left, gap):
            data = self.read(name, start, size)
            while left and left[0][0] + left[0][1] <= start + size:
                a, n = left.pop(0)
                out[a, n] = data[a - start : a - start + n]
        return out

    def write(self, name: str, data: bytes) -> None:
        """Write whole, under another name first: a task that runs twice does no harm."""
        path = self._path(name)
        self.system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with self.system.open_output_stream(part) as f:
            f.write(data)
        self.system.move(part, path)


@dataclass
class _Written(WriterCommitMessage):
    objects: int


class _ObjectWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> _Written:
        store, n = Store(self.path), 0
        for row in iterator:
            store.write(row["name"], bytes(row["content"]))
            n += 1
        return _Written(n)


class ObjectSink(DataSource):
    """``df.write.format("objects").mode("append").save(path)`` writes each row ``(name
    string, content binary)`` as an object of that name."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _ObjectWriter(self.options["path"])


def save_objects(objects: DataFrame, path: str) -> None:
    """Write ``(name, content)`` rows as objects below ``path``."""
    objects.sparkSession.dataSource.register(ObjectSink)
    objects.select("name", "content").write.format("objects").mode("append").save(path)
