"""Where tables live: the layout under one root, the shared folder, and the log of commits that says what is current.

A commit names the folders of all tables under a root together, in one numbered log entry that is put only if
no other has its number. Readers take the last entry: what was written for a commit that failed or was killed is named by none.
All paths go through Hadoop's file systems, so driver and executors may share nothing but a store.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

LOG = "_log"
#: Log entries that stay; folders that only earlier ones name are deleted.
KEPT = 4


@dataclass(frozen=True)
class Layout:
    """The runtime's tables under ``root``; each is a versioned snapshot or a folder of files."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name not in ("registry", "extracted", "chunks", "index", "converted", "backups", "logs"):
            raise AttributeError(name)
        return f"{self.root.rstrip('/')}/{name}"


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.delete(p, True)


def make_dir(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.mkdirs(p)


def under(root: str, path: str) -> bool:
    """Whether ``path`` lies in ``root`` (not above, beside or through ``..``)."""
    return path.startswith(root.rstrip("/") + "/") and ".." not in path.split("/")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class CommitConflict(RuntimeError):
    """Another commit has changed a table that this one read or wrote."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file, whole or not at all; False if there is one.

    It is written beside its place and moved there without overwriting: a hard link on a local
    disk, elsewhere the store's own rename, which must refuse an existing target (HDFS does).
    """
    fs, target = file_system(spark, path)
    jvm = spark.sparkContext._jvm
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(fresh, False)
    try:
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.getUri().getScheme() == "file":
            os.link(fresh.toUri().getPath(), target.toUri().getPath())
            return True
        return _renamed(spark, fresh, target)
    except FileExistsError:
        return False
    finally:
        fs.delete(fresh, False)


def _renamed(spark: SparkSession, fresh, target) -> bool:
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, target, how)
    except Exception as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        return False
    return True


def _named(value) -> set[str]:
    """The folders that a table's place in a log entry names."""
    if isinstance(value, str):
        return {value} if re.match(r"[^/]+/v[0-9]{8}-[0-9a-f]{12}(/|$)", value) else set()
    return set().union(*map(_named, value.values() if isinstance(value, dict) else value)) if isinstance(value, (dict, list)) else set()


class Tables:
    """The tables under ``root`` as the last commit left them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def entries(self) -> list[int]:
        fs, log = file_system(self.spark, f"{self.root}/{LOG}")
        names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"[0-9]{20}\.json", n))

    def entry(self, number: int) -> dict:
        text = read_text(self.spark, self.place(number))
        if text is None:
            raise FileNotFoundError(self.place(number))
        return json.loads(text)

    def place(self, number: int) -> str:
        return f"{self.root}/{LOG}/{number:020d}.json"

    def state(self) -> tuple[int, dict]:
        """(number, what each table is) of the last commit; (-1, {}) before the first."""
        numbers = self.entries()
        return (numbers[-1], self.entry(numbers[-1])) if numbers else (-1, {})

    def read(self, name: str, schema: str | None = None, state: dict | None = None) -> DataFrame:
        """A table's rows; of a table that no commit has made an empty one of ``schema``, or an error if that isn't given."""
        from docspark import buckets

        number, now = self.state() if state is None else (0, state)
        value = now.get(name)
        if isinstance(value, str):
            return self.spark.read.parquet(f"{self.root}/{value}")
        if value is not None:
            return buckets.rows(self.spark, self.root, value)
        if number < 0 and self._has_versions(name):
            raise RuntimeError(f"{self.root}/{name} has versions but {LOG} is gone")
        if schema is None:
            raise FileNotFoundError(f"no table at {self.root}/{name}")
        return self.spark.createDataFrame([], schema)

    def _has_versions(self, name: str) -> bool:
        fs, folder = file_system(self.spark, f"{self.root}/{name}")
        return fs.exists(folder) and any(re.match(r"v[0-9]+-", f.getPath().getName()) for f in fs.listStatus(folder))


class Commit:
    """New versions of any tables under a root, which become current together by ``publish``.

    Tables are read as they were when the commit began. Commits of others meanwhile are no harm where they
    changed other tables than those read and written here; else ``publish`` raises CommitConflict and nothing has changed.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = KEPT):
        self.tables, self.keep = Tables(spark, root), keep
        self.number, self.before = self.tables.state()
        self.seen, self.changed = set(), {}

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        self.seen.add(name)
        return self.tables.read(name, schema, self.before if self.number >= 0 else None)

    def folder(self, name: str) -> str:
        """A fresh folder of a table, under the root. The log has a first entry before any: a root with folders and no log has lost it."""
        if self.number < 0:
            put_if_absent(self.tables.spark, self.tables.place(0), "{}")
            self.number = 0
        return f"{name}/v{self.number + 1:08d}-{uuid.uuid4().hex[:12]}"

    def write(self, name: str, rows: DataFrame) -> str:
        folder = self.folder(name)
        rows.write.parquet(f"{self.tables.root}/{folder}")
        self.changed[name] = folder
        return f"{self.tables.root}/{folder}"

    def drop(self, name: str) -> None:
        self.changed[name] = None

    def publish(self) -> int:
        """Puts the log entry and gives its number."""
        while True:
            number, now = self.tables.state()
            others = {t for t in {*now, *self.before} if now.get(t) != self.before.get(t)}
            if others & {*self.seen, *self.changed}:
                raise CommitConflict(f"changed by another commit: {sorted(others & {*self.seen, *self.changed})}")
            state = {t: v for t, v in (now | self.changed).items() if v is not None}
            if put_if_absent(self.tables.spark, self.tables.place(number + 1), json.dumps(state, sort_keys=True)):
                self._tidy()
                return number + 1

    def _tidy(self) -> None:
        """Entries before the last ``keep`` go, after the folders that only they name."""
        numbers = self.tables.entries()
        needed = set().union(*(_named(self.tables.entry(n)) for n in numbers[-self.keep :]))
        for n in numbers[: -self.keep]:
            for folder in _named(self.tables.entry(n)) - needed:
                delete(self.tables.spark, f"{self.tables.root}/{folder}")
            delete(self.tables.spark, self.tables.place(n))


def write_version(df: DataFrame, path: str, keep: int = KEPT) -> str:
    """One table's new version in a commit of its own; ``df`` may come from the version before. Gives the version's folder."""
    root, name = path.rstrip("/").rsplit("/", 1)
    commit = Commit(df.sparkSession, root, keep)
    commit.seen.add(name)
    folder = commit.write(name, df)
    commit.publish()
    return folder


def read_version(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The current rows of the table at ``path``, see ``Tables.read``."""
    root, name = path.rstrip("/").rsplit("/", 1)
    return Tables(spark, root).read(name, schema)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names; on a single machine, where that is unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/docspark-shared"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what is read more than once is computed once, and lineage ends here."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
