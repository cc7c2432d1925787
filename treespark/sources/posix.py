"""A POSIX tree as a Spark data source: `spark.read.format("tree")` (S1) and a transactional `tree_files` sink.

Every executor has to mount the tree at the same place.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import shutil
import stat
import uuid
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schema import DIR, FILE, LINK, RESERVED, ZERO_HASH

SCANNED = "path string, kind int, size bigint, mtime_ns bigint, mode bigint, content_hash string, problem string"
WRITTEN = "path string, kind int, mtime_ns bigint, mode bigint, content_hash string, body binary"
#: Where tasks of a write put their files until it commits, below the reserved first component.
STAGE = RESERVED[1]
#: That move what a write has put aside into place.
THREADS = 16


def hash_file(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as body:
        while part := body.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


@dataclass
class Batch(InputPartition):
    """Directories whose whole subtrees a task lists, and directories of which it lists the entries only."""

    whole: list[str]
    flat: list[str]

    def __init__(self, whole: list[str], flat: list[str]):
        self.whole, self.flat = whole, flat


class TreeReader(DataSourceReader):
    """Lists with the driver only until there are enough directories to deal out; the rest, and all hashing, is done by tasks."""

    def __init__(self, root: str, tasks: int):
        self.root, self.tasks, self.prefix = root.rstrip("/"), tasks, "/"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """path = '/a/b' and path like '/a/b/%' narrow the walk; they are also applied afterwards."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",) and isinstance(f.value, str):
                self._narrow(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",) and f.value.startswith("/"):
                self._narrow(f.value.rsplit("/", 1)[0] or "/")
            yield f

    def _narrow(self, prefix: str) -> None:
        if self.prefix == "/" or prefix.startswith(self.prefix + "/"):
            self.prefix = prefix

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root + self.prefix) or os.path.islink(self.root + self.prefix):
            up = self.prefix.rsplit("/", 1)[0] or "/"
            return [Batch([], [up] if os.path.isdir(self.root + up) else [])]
        todo, flat = deque([self.prefix]), [] if self.prefix == "/" else [self.prefix.rsplit("/", 1)[0] or "/"]
        while todo and len(todo) < self.tasks and len(flat) < 4 * self.tasks:
            at = todo.popleft()
            flat.append(at)
            for entry in os.scandir(os.fsencode(self.root + at)):
                if entry.is_dir(follow_symlinks=False) and (name := _name(entry.name)) and not (at == "/" and name in RESERVED):
                    todo.append(f"{at.rstrip('/')}/{name}")
        n = max(1, min(self.tasks, len(todo)))
        return [Batch(list(todo)[i::n], flat[i::n]) for i in range(n)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for at in partition.flat:
            yield from self._entries(at)
        todo = list(partition.whole)
        while todo:
            for row in self._entries(todo.pop()):
                if row[1] == DIR:
                    todo.append(row[0])
                yield row

    def _entries(self, at: str) -> Iterator[tuple]:
        try:
            names = os.listdir(os.fsencode(self.root + at))
        except OSError:
            yield at, None, None, None, None, None, "unreadable"
            return
        for raw in sorted(names):
            name = _name(raw)
            path = f"{at.rstrip('/')}/{name or raw.decode('utf-8', 'replace')}"
            if name is None or at == "/" and name in RESERVED:
                yield path, None, None, None, None, None, "not_utf8" if name is None else "reserved"
                continue
            yield self._row(path)

    def _row(self, path: str) -> tuple:
        here = self.root + path
        try:
            s = os.lstat(here)
            if stat.S_ISDIR(s.st_mode):
                return path, DIR, 0, s.st_mtime_ns, s.st_mode, ZERO_HASH, None
            if stat.S_ISLNK(s.st_mode):
                target = os.readlink(os.fsencode(here))
                return path, LINK, len(target), s.st_mtime_ns, s.st_mode, hashlib.sha256(target).hexdigest(), None
            if stat.S_ISREG(s.st_mode):
                return path, FILE, s.st_size, s.st_mtime_ns, s.st_mode, hash_file(here), None
        except OSError:
            return path, None, None, None, None, None, "unreadable"
        return path, None, None, None, None, None, "special"


def _name(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


class TreeSource(DataSource):
    """S1. Options: path (the root), tasks (about how many tasks, 64). Links aren't followed; what can't be listed, read or named, devices and
    reserved names at the root come as rows with a problem and nulls."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCANNED

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self.options["path"], int(self.options.get("tasks", 64)))


@dataclass
class Staged(WriterCommitMessage):
    """What one finished task attempt has put aside: its folder, and of each file the place it is for."""

    folder: str
    files: list[tuple[str, str]]


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.stage = root.rstrip("/"), f"{root.rstrip('/')}/{STAGE}/stage-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        folder, files = f"{self.stage}/{uuid.uuid4().hex}", []  # an attempt has a folder of its own
        os.makedirs(folder)
        for i, row in enumerate(iterator):
            body = bytes(row["body"]) if row["body"] is not None else None
            if row["kind"] != DIR and (body is None or hashlib.sha256(body).hexdigest() != row["content_hash"]):
                raise ValueError(f"{row['path']}: the body isn't what its hash names")
            at = f"{folder}/{i}"
            if row["kind"] == DIR:
                os.mkdir(at)
            elif row["kind"] == LINK:
                os.symlink(os.fsdecode(body), at)
            else:
                with open(at, "wb") as out:
                    out.write(body)
            if row["kind"] != LINK:
                os.chmod(at, int(row["mode"]) & 0o7777)
                os.utime(at, ns=(int(row["mtime_ns"]), int(row["mtime_ns"])))
            files.append((at, row["path"]))
        return Staged(folder, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Moves what finished attempts have put aside into place: shallow entries first, so directories are there before what they hold."""
        files = sorted(((at, path) for m in messages if m for at, path in m.files), key=lambda f: f[1].count("/"))

        def put(some: list[tuple[str, str]]) -> None:
            for at, path in some:
                there = self.root + path
                if stat.S_ISDIR(mode := os.lstat(at).st_mode):
                    os.makedirs(there, exist_ok=True)
                    os.chmod(there, stat.S_IMODE(mode))
                else:
                    os.replace(at, there)

        with ThreadPoolExecutor(THREADS) as pool:
            for _, level in itertools.groupby(files, key=lambda f: f[1].count("/")):
                group = list(level)
                for parent in {path.rpartition("/")[0] for _, path in group}:
                    os.makedirs(self.root + parent, exist_ok=True)
                list(pool.map(put, [group[i::THREADS] for i in range(THREADS)]))
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class TreeFiles(DataSource):
    """S7 as a sink: rows (path, kind, mtime_ns, mode, content_hash, body) become entries below the option path. Tasks put files aside, each attempt in
    a folder of its own, with their bodies verified; only when all tasks are done are they moved into place, each by one rename. A failed or
    killed attempt, or a write that fails, leaves the tree as it was."""

    @classmethod
    def name(cls) -> str:
        return "tree_files"

    def schema(self) -> str:
        return WRITTEN

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, and lets filters on path reach the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TreeSource, TreeFiles):
        spark.dataSource.register(source)
