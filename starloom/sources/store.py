"""Objects under one root (a folder or a bucket): read by byte ranges and written whole, from any task.

Roots are URIs of stores that Arrow's file systems reach (file, s3, gs, hdfs) or plain paths. Keys are relative, of plain parts;
one that would leave its root is refused. Reads and writes are tried again after waits that double.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import reachable

MANIFEST = "_manifest"


class BadKey(ValueError):
    """A key that is empty, absolute or leaves its root."""


def checked_key(key: str) -> str:
    if not key or "\\" in key or "\0" in key or any(p in ("", ".", "..") for p in key.split("/")):
        raise BadKey(repr(key))
    return key


def filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and its path there; Hadoop's names of schemes count as Arrow's."""
    root = re.sub(r"^s3[an]://", "s3://", root)
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))


class Store:
    """Reads and writes under ``root``. ``n_read`` counts the bytes that were asked for."""

    def __init__(self, root: str, tries: int = 3, wait: float = 0.4):
        self.fs, self.base = filesystem(root.rstrip("/"))
        self.tries, self.wait, self.n_read = tries, wait, 0

    def path(self, key: str) -> str:
        path = f"{self.base}/{checked_key(key)}"
        if isinstance(self.fs, fs.LocalFileSystem) and not os.path.realpath(path).startswith(os.path.realpath(self.base) + os.sep):
            raise BadKey(f"{key!r} leads out of its root")
        return path

    def again(self, call: Callable):
        """``call()``, tried again after an error of the store: a missing object is none."""
        for left in range(self.tries - 1, -1, -1):
            try:
                return call()
            except FileNotFoundError:
                raise
            except OSError:
                if not left:
                    raise
                time.sleep(self.wait * 2 ** (self.tries - 1 - left))

    def size(self, key: str) -> int | None:
        info = self.again(lambda: self.fs.get_file_info(self.path(key)))
        return info.size if info.type == fs.FileType.File else None

    def read(self, key: str, start: int = 0, size: int | None = None) -> bytes:
        """Bytes of an object from ``start``; fewer than ``size`` where it ends."""

        def once() -> bytes:
            with self.fs.open_input_file(self.path(key)) as f:
                f.seek(start)
                return f.read() if size is None else f.read(size)

        found = self.again(once)
        self.n_read += len(found)
        return found

    def open(self, key: str) -> io.BufferedReader:
        """A stream that reads ranges as they are needed."""
        return io.BufferedReader(_Ranges(self, key), 1 << 20)

    def put(self, key: str, content: bytes) -> None:
        """The whole object or none of it: local files are renamed into place, stores of objects do so by themselves."""
        path = self.path(key)

        def once() -> None:
            local = isinstance(self.fs, fs.LocalFileSystem | fs.HadoopFileSystem)
            if local:
                self.fs.create_dir(path.rsplit("/", 1)[0])
            at = f"{path}.{uuid.uuid4().hex}.part" if local else path
            with self.fs.open_output_stream(at) as f:
                f.write(content)
            if local:
                self.fs.move(at, path)

        self.again(once)

    def keys(self, pattern: str = "*") -> list[str]:
        """Keys that match a glob pattern, in order."""
        found = self.fs.get_file_info(fs.FileSelector(self.base, recursive=True, allow_not_found=True))
        keys = (f.path[len(self.base) + 1 :] for f in found if f.type == fs.FileType.File)
        return sorted(k for k in keys if fnmatch.fnmatchcase(k, pattern) and not k.endswith(".part"))


class _Ranges(io.RawIOBase):
    def __init__(self, store: Store, key: str):
        self.store, self.key, self.at = store, key, 0

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        found = self.store.read(self.key, self.at, len(into))
        into[: len(found)] = found
        self.at += len(found)
        return len(found)


@dataclass
class _Written(WriterCommitMessage):
    part: str | None
    objects: int
    bytes: int


class _Objects(DataSource):
    """Writes rows (key, content) as objects, and a manifest of all of them when every task has finished."""

    @classmethod
    def name(cls) -> str:
        return "starloom_objects"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ObjectWriter(dict(self.options))


class _ObjectWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.root, self.run = options["root"], options["run"]
        self.tries = int(options.get("tries", 5))

    def write(self, rows: Iterator) -> _Written:
        """Objects that are there with the same bytes are left alone, so a run after a failure sends only what is missing."""
        store = Store(self.root, self.tries)
        lines, total = [], 0
        for row in rows:
            content = bytes(row.content)
            digest = hashlib.sha256(content).hexdigest()
            if store.size(row.key) != len(content) or hashlib.sha256(store.read(row.key)).hexdigest() != digest:
                store.put(row.key, content)
            lines.append(json.dumps({"key": row.key, "bytes": len(content), "sha256": digest}))
            total += len(content)
        part = None
        if lines:
            part = f"{MANIFEST}/{self.run}/{TaskContext.get().partitionId():06d}.json"
            store.put(part, "\n".join(lines).encode())
        return _Written(part, len(lines), total)

    def commit(self, messages: list) -> None:
        """The manifest comes last: it names the parts that list this run's objects."""
        done = [m for m in messages if m is not None]
        head = {"run": self.run, "objects": sum(m.objects for m in done), "bytes": sum(m.bytes for m in done), "parts": sorted(m.part for m in done if m.part)}
        Store(self.root, self.tries).put(f"{MANIFEST}.json", json.dumps(head).encode())

    def abort(self, messages: list) -> None:
        """Objects stay for the next run; without a manifest of this one nobody takes them for a whole set."""


def write_objects(objects: DataFrame, root: str, tries: int = 5) -> None:
    """Writes ``objects`` (key, content) under ``root``; a key that comes twice is refused before anything is written."""
    spark = reachable(objects.sparkSession)
    twice = objects.groupBy("key").count().where("count > 1 or key is null").limit(1).collect()
    if twice:
        raise BadKey(f"{twice[0].key!r} comes more than once")
    spark.dataSource.register(_Objects)
    objects.select("key", "content").write.format("starloom_objects").option("root", root).option("run", uuid.uuid4().hex).option("tries", tries).mode("append").save()


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """key, bytes, sha256 of the objects of the last run that finished; without one, no rows."""
    store, schema = Store(root), "key string, bytes bigint, sha256 string"
    if store.size(f"{MANIFEST}.json") is None:
        return spark.createDataFrame([], schema)
    head = json.loads(store.read(f"{MANIFEST}.json"))
    paths = [f"{root.rstrip('/')}/{p}" for p in head["parts"]]
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)


def read_objects(objects: DataFrame, root: str, tries: int = 3) -> DataFrame:
    """Adds content and error to ``objects`` (with a column key): an object that can't be read has an error and no content."""
    schema = objects.select("key").withColumns({"content": F.lit(None).cast("binary"), "error": F.lit(None).cast("string")}).schema

    def run(frames):
        import pandas as pd

        store = Store(root, tries)
        for frame in frames:
            for key in frame.key:
                try:
                    row = (key, store.read(key), None)
                except (OSError, ValueError) as error:
                    row = (key, None, f"{type(error).__name__}: {error}")
                yield pd.DataFrame([row], columns=["key", "content", "error"])

    reachable(objects.sparkSession)
    return objects.select("key").mapInPandas(run, schema)
