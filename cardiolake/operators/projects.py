"""Projects: named tables of recordings, replaced as a whole when they change."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .provenance import PROJECT_SCHEMA, upsert
from .validation import check_project_name


class ProjectStore:
    """Versions of a project: ``root/<name>/data/<id>`` holds a table, ``root/<name>/log/<n>`` names
    the table of version n.

    A version is there when its log entry is, and an entry is made by a rename that fails if
    another writer made it first; the loser reads the new version and applies its change to
    that.  So readers need no lock, never see a half-written table, and no change is lost.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        log, fs = self._path(check_project_name(name), "log"), self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _table(self, name: str, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], PROJECT_SCHEMA)
        stream = self._fs().open(self._path(name, "log", str(version)))
        try:
            folder = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.read.schema(PROJECT_SCHEMA).parquet(f"{self.root}/{name}/data/{folder}")

    def load(self, name: str, version: int | None = None) -> DataFrame:
        """The newest version, or the named one."""
        return self._table(name, (self.versions(name) or [0])[-1] if version is None else version)

    def _commit(self, name: str, version: int, folder: str) -> bool:
        """Make log entry ``version``; false if it is there already."""
        jvm, fs = self.spark._jvm, self._fs()
        draft, entry = self._path(name, "log", f".{folder}"), self._path(name, "log", str(version))
        out = fs.create(draft)
        out.write(bytearray(folder.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, entry, never_over)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.toString():
                raise
            fs.delete(draft, False)
            return False

    def change(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> int:
        """Commit ``fn`` of the newest version, again and again until no other writer came between; gives the version."""
        check_project_name(name)
        while True:
            base, folder = (self.versions(name) or [0])[-1], uuid.uuid4().hex
            fn(self._table(name, base)).select(*self.load(name, 0).columns).write.parquet(f"{self.root}/{name}/data/{folder}")
            if self._commit(name, base + 1, folder):
                return base + 1
            self._fs().delete(self._path(name, "data", folder), True)

    def save(self, name: str, recordings: DataFrame) -> int:
        """Replace the table, whatever it was."""
        return self.change(name, lambda _: recordings)

    def add(self, name: str, recordings: DataFrame) -> DataFrame:
        """Insert or replace recordings; returns the new state."""
        named = recordings.withColumn("project_id", F.lit(name))
        return self.load(name, self.change(name, lambda now: upsert(now, named.select(*now.columns))))


def new_recording_token() -> str:
    return uuid.uuid4().hex
