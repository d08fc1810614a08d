"""``spark.read.format("ephys")``: native recordings as a Spark data source.

The long layout (recording_id, channel, channel_index, sample_index, time_s, value) of
.edf, .hea, .zip, .wfdb, .npy and .npz files.  A large file is one partition for each
``samplesPerPartition`` samples, small ones share partitions of that many bytes; only the
headers of large files are read while planning.  Options bound what is read: ``start`` and
``stop`` (samples), ``channels`` and ``recordings`` (names, comma-separated).  Ranges
outside are no partitions, and of the rest only its byte ranges are read (``seek``).

    ephys.register(spark)
    spark.read.format("ephys").options(stop=5000, channels="II").load("/recordings")

With the option ``pushFilters`` comparisons of ``sample_index`` with numbers and equality
of ``recording_id`` and ``channel`` bound it likewise.  Spark 4.1 keeps what was pushed
with the loaded table, so such a ``load`` must serve one scan: a second query of the same
DataFrame would find the first one's filters.  It is off by default.

A damaged file raises, as it does with Spark's own sources.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from . import seek

SCHEMA = "recording_id string, channel string, channel_index int, sample_index long, time_s double, value double"
_ARROW = pa.schema([("recording_id", pa.string()), ("channel", pa.string()), ("channel_index", pa.int32()), ("sample_index", pa.int64()), ("time_s", pa.float64()), ("value", pa.float64())])
_END = 1 << 62


@dataclass
class Part(InputPartition):
    """Files with the sample range to read of each."""

    files: list[tuple[str, int, int]] = field(default_factory=list)


class EphysReader(DataSourceReader):
    def __init__(self, path: str, samples: int, start: int = 0, stop: int = _END, only: dict[str, set] | None = None):
        if samples < 1 or not 0 <= start < stop:
            raise ValueError("samplesPerPartition must be positive and the window not empty")
        self.path, self.samples = path, samples
        self.start, self.stop = start, stop
        self.only = dict(only or {})

    def _files(self) -> list[tuple[str, int]]:
        system, own = seek.located(self.path)
        prefix = self.path.split(":", 1)[0] + "://" if ":" in self.path.split("/", 1)[0] and not self.path.startswith("file:") else ""
        info = system.get_file_info(own)
        infos = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(own, recursive=True))
        names = self.only.get("recording_id")
        stem = lambda p: os.path.splitext(os.path.basename(p))[0]
        return sorted((prefix + i.path, i.size) for i in infos if i.type == pafs.FileType.File and i.path.lower().endswith(seek.SUFFIXES) and (names is None or stem(i.path) in names))

    def partitions(self) -> list[InputPartition]:
        out, small, held = [], Part(), 0
        for path, size in self._files() if self.start < self.stop else []:
            large = size > self.samples or path.lower().endswith(".hea")
            total = seek.facts(path)["n_samples"] if large and path.lower().endswith((".edf", ".hea", ".zip", ".wfdb")) else None
            if total is not None and total > self.samples:
                ends = range(self.start, min(self.stop, total), self.samples)
                out += [Part([(path, a, min(a + self.samples, self.stop, total))]) for a in ends]
                continue
            small.files.append((path, self.start, self.stop))
            held += size
            if held > 2 * self.samples:
                out, small, held = [*out, small], Part(), 0
        return [*out, small] if small.files else out or [Part()]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for path, start, stop in partition.files:
            for r in seek.window_rows(path, start, stop):
                if "channel" in self.only and r["channel"] not in self.only["channel"]:
                    continue
                for at in range(0, len(r["values"]), 65_536):
                    v = r["values"][at : at + 65_536]
                    index = np.arange(start + at, start + at + len(v))
                    time = pa.array(index / r["fs_hz"]) if r["fs_hz"] else pa.nulls(len(v), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array([r["recording_id"]] * len(v)), pa.array([r["channel"]] * len(v)), pa.array(np.full(len(v), r["channel_index"], np.int32)), pa.array(index, pa.int64()), time, pa.array(v)], schema=_ARROW)


class PushingReader(EphysReader):
    """The reader with filters pushed to it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if isinstance(f, IsNotNull):
            return name not in ("time_s", None)  # all other columns always have values
        if name == "sample_index" and isinstance(getattr(f, "value", None), int):
            low = {GreaterThan: f.value + 1, GreaterThanOrEqual: f.value, EqualTo: f.value}.get(type(f))
            high = {LessThan: f.value, LessThanOrEqual: f.value + 1, EqualTo: f.value + 1}.get(type(f))
            if low is None and high is None:
                return False
            self.start, self.stop = max(self.start, low or 0), min(self.stop, _END if high is None else high)
            return True
        if name in ("recording_id", "channel") and isinstance(f, (EqualTo, In)):
            given = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.only[name] = self.only.get(name, given) & given
            return True
        return False


class EphysDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ephys"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> EphysReader:
        number = lambda name, default: int(self.options.get(name, default))
        named = {"channel": self.options.get("channels"), "recording_id": self.options.get("recordings")}
        only = {k: {x.strip() for x in v.split(",")} for k, v in named.items() if v is not None}
        kind = PushingReader if str(self.options.get("pushFilters", "false")).lower() == "true" else EphysReader
        return kind(self.options["path"], number("samplesPerPartition", 1 << 18), number("start", 0), number("stop", _END), only)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let Spark push filters to readers that take them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EphysDataSource)
