"""Parts of native files: windows and headers by byte ranges, in the tasks.

``binaryFile`` lists files without opening them as long as ``content`` is not asked for;
each task opens its own files through Arrow's file systems (local and mounted folders,
HDFS, S3, GCS, Azure) and reads the ranges that the header says.  The bytes read grow with
the window or the header, never with the file:

* EDF: 256 bytes, 256 a signal, and the data records that hold the window;
* WFDB: the header file and the units of each signal file that hold the window (format 8
  stores differences and is read from its beginning); segments outside the window are not
  opened;
* archives: the directory at the end, the header member, and of each signal member what
  lies before the end of the window (a compressed member cannot be entered in its middle);
* NumPy: the array's header and the window; arrays in stored members likewise.

A file system that Arrow does not know (``viewfs`` for one) is read whole through Spark
(``readers.decoded_signals`` and ``decoded_metadata``), with the same results.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validation import check_window, unique_labels
from . import edf, readers, wfdb

WINDOWS = readers.SIGNALS + ", total_samples long, bytes_read long"
HEADERS = readers.META + ", bytes_read long"
SUFFIXES = (".edf", ".hea", ".zip", ".wfdb", ".npy", ".npz")
#: Schemes that Arrow opens, and what it calls them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


class Ranged(io.RawIOBase):
    """A file that is read by ranges and counts the bytes it was asked for."""

    def __init__(self, handle, size: int, count: list[int]):
        self.handle, self.size, self.count, self.place = handle, size, count, 0

    def at(self, offset: int, n: int) -> bytes:
        self.handle.seek(offset)
        data = self.handle.read(max(0, min(n, self.size - offset)))
        self.count[0] += len(data)
        return data

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, offset: int, whence: int = 0) -> int:
        self.place = offset + (0, self.place, self.size)[whence]
        return self.place

    def read(self, n: int = -1) -> bytes:
        data = self.at(self.place, self.size - self.place if n is None or n < 0 else n)
        self.place += len(data)
        return data


def located(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, _, rest = path.partition(":") if ":" in path.split("/", 1)[0] else ("file", "", path)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/") if rest.startswith("/") else os.path.abspath(rest)
    return pafs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


def opened(path: str, count: list[int]) -> Ranged:
    system, own = located(path)
    handle = system.open_input_file(own)
    return Ranged(handle, handle.size(), count)


def can_seek(spark: SparkSession, path: str) -> bool:
    """Whether Arrow has the file system that Spark finds under ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() in SCHEMES


# --- windows ------------------------------------------------------------------------------------------


def _row(name: str, k: int, channel: str, fs: float | None, start: int, values: np.ndarray, total: int, form: str, units: str | None = None) -> dict:
    t0 = None if fs is None else start / fs
    return {"recording_id": name, "channel": channel, "channel_index": k, "fs_hz": fs, "t0_s": t0, "units": units, "source_format": form, "values": np.ascontiguousarray(values, dtype=float), "total_samples": total}


def edf_header(f: Ranged) -> edf.EdfHeader:
    front = f.at(0, 256)
    signals = front[252:256].decode("latin-1").strip()
    if not signals.isdigit():
        raise ValueError("not an EDF file")
    return edf.header(front + f.at(256, 256 * int(signals)), f.size)


def _edf_window(name: str, f: Ranged, start: int, stop: int) -> list[dict]:
    h = edf_header(f)
    stop = min(stop, h.n_samples)
    records = f.at(*edf.span(h, start, stop)) if start < stop else b""
    values = edf.values(h, records, start, max(start, stop))
    return [_row(name, k, c, h.fs_hz, start, v, h.n_samples, "edf", h.units[i]) for k, (c, i, v) in enumerate(zip(unique_labels([h.labels[i] for i in h.signals]), h.signals, values))]


def _wfdb_window(name: str, text: str, open_: Callable[[str], Ranged], start: int, stop: int, physical: bool = True) -> list[dict]:
    parts = wfdb.segments(text)
    if parts:
        ends = np.cumsum([0, *(n for _, n in parts)])
        found = []
        for (part, n), a in zip(parts, ends):
            if a < stop and a + n > start:
                if part == "~":
                    raise ValueError("the window reaches into a gap between segments")
                found.append(_wfdb_window(name, open_(f"{part}.hea").read().decode("latin-1"), open_, max(start - a, 0), min(stop - a, n), physical))
        if len({tuple(r["channel"] for r in rows) for rows in found}) > 1:
            raise ValueError("segments have different channels")
        return [{**own[0], "t0_s": start / own[0]["fs_hz"], "values": np.concatenate([r["values"] for r in own]), "total_samples": int(ends[-1])} for own in zip(*found)]
    h = wfdb.header(text)
    columns, total = [], h.n_samples or None
    for file in dict.fromkeys(h.files):
        own = [i for i, x in enumerate(h.files) if x == file]
        fmt = h.formats[own[0]]
        if any(h.formats[i] != fmt for i in own):
            raise ValueError("signals of one file must share a format")
        f = open_(file)
        n = wfdb.length(fmt, len(own), f.size)
        total = n if total is None else min(n, total)
        end = max(start, min(stop, total))
        offset, size, skip = wfdb.span(fmt, len(own), start, end)
        f.seek(offset)
        d = wfdb.digital(f.read(size), fmt, len(own), [h.initial[i] for i in own] if h.initial else (), skip)
        columns += [(i, d[: end - start, k].astype(float)) for k, i in enumerate(own)]
    width = min(len(v) for _, v in columns)
    scaled = [(v[:width] - h.baselines[i]) / h.gains[i] if physical else v[:width] for i, v in columns]
    return [_row(name, k, c, h.fs_hz, start, v, total, "wfdb") for k, (c, v) in enumerate(zip(unique_labels([h.labels[i] for i, _ in columns]), scaled))]


class _Member(io.RawIOBase):
    """A member of an archive with its size; read forward."""

    def __init__(self, archive: zipfile.ZipFile, info: zipfile.ZipInfo):
        self.file, self.size = archive.open(info), info.file_size

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.file.seek(offset, whence)

    def read(self, n: int = -1) -> bytes:
        return self.file.read(n)


def _zip_window(name: str, f: Ranged, start: int, stop: int) -> list[dict]:
    with zipfile.ZipFile(f) as z:
        infos = readers.checked_infos(z)
        head = readers.record_head(infos)
        folder = head.rsplit("/", 1)[0] + "/" if "/" in head else ""
        return _wfdb_window(name, z.read(infos[head]).decode("latin-1"), lambda n: _Member(z, infos[folder + n]), start, stop)


def _array_window(f, start: int, stop: int) -> tuple[np.ndarray, int]:
    """Window of the array that begins where ``f`` stands."""
    version = np.lib.format.read_magic(f)
    shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if len(shape) != 1 or dtype.hasobject:
        raise ValueError("only arrays of one dimension and plain numbers are recordings")
    stop = max(start, min(stop, shape[0]))
    f.seek(start * dtype.itemsize, 1)
    return np.frombuffer(f.read((stop - start) * dtype.itemsize), dtype=dtype), shape[0]


def _numpy_window(name: str, f: Ranged, start: int, stop: int, zipped: bool) -> list[dict]:
    if not zipped:
        values, total = _array_window(f, start, stop)
        return [_row(name, 0, "value", None, start, values, total, "npy")]
    rows = []
    with zipfile.ZipFile(f) as z:
        for k, (path, info) in enumerate(readers.checked_infos(z).items()):
            with z.open(info) as member:
                values, total = _array_window(member, start, stop)
            rows.append(_row(name, k, path.removesuffix(".npy"), None, start, values, total, "npz"))
    return rows


def window_rows(path: str, start: int, stop: int, physical: bool = True) -> list[dict]:
    """Rows of one file's window by its suffix, each with the bytes that were read for the file."""
    count = [0]
    stem, suffix = os.path.splitext(os.path.basename(path))
    suffix, folder = suffix.lower(), path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    f = opened(path, count)
    if suffix == ".edf":
        rows = _edf_window(stem, f, start, stop)
    elif suffix == ".hea":
        rows = _wfdb_window(stem, f.at(0, f.size).decode("latin-1"), lambda n: opened(folder + n, count), start, stop, physical)
    elif suffix in (".zip", ".wfdb"):
        rows = _zip_window(stem, f, start, stop)
    elif suffix in (".npy", ".npz"):
        rows = _numpy_window(stem, f, start, stop, suffix == ".npz")
    else:
        raise ValueError(f"unsupported format {suffix!r}")
    if any(not np.isfinite(r["values"]).all() for r in rows):
        raise ValueError("recording contains NaN or infinite values")
    return [{**r, "bytes_read": count[0]} for r in rows]


# --- headers ----------------------------------------------------------------------------------------------


def facts(path: str) -> dict:
    """Header-level facts of one .edf, .hea, .zip or .wfdb file, with the bytes read."""
    count = [0]
    stem, suffix = os.path.splitext(os.path.basename(path))
    f = opened(path, count)
    if suffix.lower() == ".edf":
        h = edf_header(f)
        n, fs, labels = h.n_samples, h.fs_hz, [h.labels[i] for i in h.signals]
    else:
        if suffix.lower() == ".hea":
            text = f.at(0, f.size).decode("latin-1")
            folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
            size_of = lambda name: opened(folder + name, count).size
        else:
            with zipfile.ZipFile(f) as z:
                infos = readers.checked_infos(z)
                head = readers.record_head(infos)
                text, folder = z.read(infos[head]).decode("latin-1"), head.rsplit("/", 1)[0] + "/" if "/" in head else ""
            size_of = lambda name: infos[folder + name].file_size
        parts = wfdb.segments(text)
        if parts:
            named = next(p for p, _ in parts if p != "~")
            h, n = wfdb.header(opened(folder + f"{named}.hea", count).read().decode("latin-1")), sum(n for _, n in parts)
        else:
            h = wfdb.header(text)
            n = h.n_samples or min(wfdb.length(h.formats[h.files.index(x)], h.files.count(x), size_of(x)) for x in set(h.files))
        fs, labels = h.fs_hz, h.labels
    if n < 1:
        raise ValueError("recording has no samples")
    return {"recording_id": stem, "source_format": "edf" if suffix.lower() == ".edf" else "wfdb", "fs_hz": fs, "n_samples": n, "duration_s": (n - 1) / fs, "channels": unique_labels(labels), "bytes_read": count[0]}


# --- over folders -------------------------------------------------------------------------------------------


def _listed(spark: SparkSession, path: str, suffixes: str) -> DataFrame:
    """Paths of the files; nothing is opened, as ``content`` is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").where(F.lower("path").rlike(rf"\.({suffixes})$"))


def _each(paths: DataFrame, fn: Callable[[str], list[dict]], schema: str) -> DataFrame:
    target = readers._arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    rows = fn(path)
                except (ValueError, KeyError, IndexError, OSError, zipfile.BadZipFile) as e:
                    rows = [{"recording_id": os.path.splitext(os.path.basename(path))[0], "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    return paths.mapInArrow(run, schema)


def read_window(spark: SparkSession, path: str, start: int, stop: int, physical: bool = True) -> DataFrame:
    """Samples [start, stop), clipped to the recording, of every .edf, .hea, .zip, .wfdb, .npy
    and .npz file under ``path``: packed signals with ``total_samples`` and ``bytes_read``.

    A window behind the end is empty; a file that cannot be read gives a row with ``error``.
    """
    check_window(start, stop)
    if can_seek(spark, path):
        return _each(_listed(spark, path, "edf|hea|zip|wfdb|npy|npz"), lambda p: window_rows(p, start, stop, physical), WINDOWS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    whole = readers.decoded_signals(files).unionByName(readers.wfdb_records(files, physical))
    part = F.slice("values", start + 1, stop - start)
    return whole.withColumns({"total_samples": F.size("values").cast("long"), "values": part, "t0_s": F.lit(float(start)) / F.col("fs_hz"), "bytes_read": F.lit(None).cast("long")})


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Rate, length, duration and channels of every .edf, .hea, .zip and .wfdb file under ``path``, from headers alone."""
    if can_seek(spark, path):
        return _each(_listed(spark, path, "edf|hea|zip|wfdb"), lambda p: [facts(p)], HEADERS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return readers.decoded_metadata(files).withColumn("bytes_read", F.lit(None).cast("long"))


def write_files(files: DataFrame, folder: str) -> str:
    """Write rows (path, content) as files of ``folder``, by their base names, in the tasks; gives the folder.

    A file appears under its name when it is whole, so a task that runs twice does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                system, own = located(f"{folder}/{os.path.basename(path)}")
                system.create_dir(own.rsplit("/", 1)[0], recursive=True)
                part = f"{own}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                system.move(part, own)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder
