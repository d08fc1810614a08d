"""Recordings as DataFrames: CSV, EDF, WFDB, NumPy; metadata and bounded windows.

Binary formats are read with ``binaryFile`` and decoded a file a row in Arrow
batches; a file never leaves its executor.  ``signals`` is the packed layout
(recording_id, channel, channel_index, fs_hz, t0_s, units, source_format, values),
``samples`` the long one.
"""

from __future__ import annotations

import csv
import io
import os
import stat
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.validation import check_window, guess_time_column, require_valid, unique_labels, validate_series
from . import edf, wfdb

SIGNALS = "recording_id string, channel string, channel_index int, fs_hz double, t0_s double, units string, source_format string, values array<double>, error string"
META = "recording_id string, source_format string, fs_hz double, n_samples long, duration_s double, channels array<string>, error string"
#: Fixed limits.
MAX_MEMBERS, MAX_BYTES, MAX_OWNERS = 256, 512 * 1024 * 1024, 100_000


# --- CSV --------------------------------------------------------------------------------------


def _csv_table(data: bytes) -> tuple[list[str], list[list[str]]]:
    """(column names, rows of cells) of one file: quoted cells may hold commas, quotes and line ends."""
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline=""), skipinitialspace=True) if any(c.strip() for c in r)]
    return (unique_labels(rows[0]), rows[1:]) if rows else ([], [])


def _csv_names(data: bytes) -> list[str]:
    """Column names of one file; parsing ends with its first record that has a cell."""
    records = csv.reader(io.TextIOWrapper(io.BytesIO(data), "utf-8-sig", "replace", newline=""), skipinitialspace=True)
    return unique_labels(next((r for r in records if any(c.strip() for c in r)), []))


def _file_stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def csv_rows(files: DataFrame, recording: str | None = None) -> DataFrame:
    """recording_id, sample_index (physical order), and the columns as strings, of CSV files
    (path, content).

    Every file is parsed with its own header, so the order of its columns may differ; a
    column that a file lacks is null there.  A first pass reads the first record of each
    file; Spark unites the names, ordered by their first place in any file, then by name.
    Only the names reach the driver: they are the schema.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[str, int] = {}
            for d in batch.column(0):
                for i, c in enumerate(_csv_names(d.as_py())):
                    first[c] = min(i, first.get(c, i))
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), pa.array(list(first.values()), pa.int32())], names=["name", "place"])

    found = files.select("content").mapInArrow(heads, "name string, place int").groupBy("name").agg(F.min("place").alias("place"))
    names = [r["name"] for r in found.orderBy("place", "name").collect()]
    if not names:
        raise ValueError("CSV is empty")
    schema = pa.schema([("recording_id", pa.string()), ("sample_index", pa.int64()), *((c, pa.string()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                own, rows = _csv_table(content.as_py())
                for start in range(0, len(rows), 50_000):
                    part = rows[start : start + 50_000]
                    cells = {c: [r[i].strip() if i < len(r) else None for r in part] for i, c in enumerate(own)}
                    columns = [[recording or _file_stem(path)] * len(part), list(range(start, start + len(part)))] + [cells.get(c, [None] * len(part)) for c in names]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "recording_id string, sample_index long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in names))


def read_csv(spark: SparkSession, path: str, recording: str | None = None) -> DataFrame:
    """``csv_rows`` of a file, a folder or a pattern; a file is read by one task, so its
    physical order is known and disorder in time stays visible to the validation."""
    return csv_rows(spark.read.format("binaryFile").load(path), recording)


def load_and_validate(spark: SparkSession, path: str, time_col: str | None = None, recording: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, report) of CSV recordings; raises if one is not valid."""
    rows = read_csv(spark, path, recording)
    report = validate_series(rows, time_col)
    require_valid(report)
    return csv_signals(rows, time_col), report


def csv_signals(rows: DataFrame, time_col: str | None = None) -> DataFrame:
    """Packed signals of validated CSV rows."""
    time_col = time_col or guess_time_column([c for c in rows.columns if c not in ("recording_id", "sample_index")])
    channels = [c for c in rows.columns if c not in ("recording_id", "sample_index", time_col)]
    t = F.col(time_col).cast("double")
    long = rows.select(
        "recording_id", "sample_index", t.alias("t"), F.posexplode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in channels])).alias("channel_index", "x")
    ).select("recording_id", "sample_index", "t", "channel_index", F.col("x.c").alias("channel"), F.col("x.v").alias("value"))
    packed = long.groupBy("recording_id", "channel", "channel_index").agg(F.sort_array(F.collect_list(F.struct("sample_index", "t", "value"))).alias("s"))
    steps = F.transform(F.slice("s", 2, F.size("s") - 1), lambda x, i: x["t"] - F.get("s", i)["t"])
    ordered = F.array_sort(steps)
    n = F.size(ordered)
    half = (n / 2).cast("int")
    median = F.when(n % 2 == 1, F.get(ordered, half)).otherwise((F.get(ordered, half - 1) + F.get(ordered, half)) / 2)
    return packed.select(
        "recording_id", "channel", "channel_index", F.round(F.try_divide(F.lit(1.0), median), 6).alias("fs_hz"), F.get("s", F.lit(0))["t"].alias("t0_s"), F.lit(None).cast("string").alias("units"), F.lit("csv").alias("source_format"),
        F.transform("s", lambda x: x["value"]).alias("values"), F.lit(None).cast("string").alias("error"),
    )


def csv_metadata(rows: DataFrame, time_col: str | None = None) -> DataFrame:
    """Rate, length and duration from the time column alone (other columns are pruned)."""
    time_col = time_col or guess_time_column([c for c in rows.columns if c not in ("recording_id", "sample_index")])
    channels = [c for c in rows.columns if c not in ("recording_id", "sample_index", time_col)]
    timed = rows.select("recording_id", "sample_index", F.expr(f"try_cast(`{time_col}` AS double)").alias("t"))
    dt = F.col("t") - F.lag("t").over(Window.partitionBy("recording_id").orderBy("sample_index"))
    agg = timed.withColumn("dt", dt).groupBy("recording_id").agg(F.count("*").alias("n_samples"), F.percentile("dt", F.lit(0.5)).alias("m"), (F.max("t") - F.min("t")).alias("duration_s"), F.count_if(F.col("dt") <= 0).alias("bad"))
    wrong = F.when(F.col("bad") > 0, "time must be strictly increasing")
    return agg.select("recording_id", F.lit("csv").alias("source_format"), F.round(F.try_divide(F.lit(1.0), "m"), 6).alias("fs_hz"), "n_samples", "duration_s", F.lit(channels).alias("channels"), wrong.alias("error"))


# --- EDF, WFDB, NumPy ---------------------------------------------------------------------------


def _checked(values: np.ndarray) -> np.ndarray:
    if len(values) < 2:
        raise ValueError("recording has fewer than two samples")
    if not np.isfinite(values).all():
        raise ValueError("recording contains NaN or infinite values")
    return np.ascontiguousarray(values, dtype=float)


def _edf_rows(name: str, data: bytes, start: int = 0, stop: int | None = None) -> list[dict]:
    h, values = edf.samples(data, start, stop)
    labels = unique_labels([h.labels[i] for i in h.signals])
    return [{"recording_id": name, "channel": c, "channel_index": k, "fs_hz": h.fs_hz, "t0_s": start / h.fs_hz, "units": h.units[i], "source_format": "edf", "values": _checked(v)} for k, (c, i, v) in enumerate(zip(labels, h.signals, values))]


def _wfdb_rows(name: str, files: dict[str, bytes], head: str, start: int = 0, stop: int | None = None, physical: bool = True) -> list[dict]:
    h = wfdb.header(files[head].decode("latin-1"))
    folder = head.rsplit("/", 1)[0] + "/" if "/" in head else ""
    values = wfdb.samples(h, {f.removeprefix(folder): d for f, d in files.items()}, physical)[start:stop]
    return [{"recording_id": name, "channel": c, "channel_index": k, "fs_hz": h.fs_hz, "t0_s": start / h.fs_hz, "units": None, "source_format": "wfdb", "values": _checked(values[:, k])} for k, c in enumerate(unique_labels(h.labels))]


def checked_infos(archive: zipfile.ZipFile) -> dict[str, zipfile.ZipInfo]:
    """Members by normal path, from the directory alone; refuses traversal, links and floods."""
    total, out = 0, {}
    infos = archive.infolist()
    if len(infos) > MAX_MEMBERS:
        raise ValueError(f"archive contains too many files (max {MAX_MEMBERS})")
    for m in infos:
        if not m.filename or m.filename.endswith("/"):
            continue
        total += m.file_size
        if m.file_size > MAX_BYTES or total > MAX_BYTES:
            raise ValueError("archive exceeds the 512 MB limit")
        path = os.path.normpath(m.filename.replace("\\", "/"))
        if path.startswith(("/", "..")) or os.path.isabs(path):
            raise ValueError("unsafe archive path")
        if stat.S_ISLNK(m.external_attr >> 16):
            raise ValueError("archive links are not supported")
        out[path] = m
    return out


def record_head(names) -> str:
    """The one record header among the members of an archive."""
    heads = [f for f in names if f.lower().endswith(".hea")]
    if len(heads) != 1:
        raise ValueError("archive must contain exactly one record header (.hea)")
    return heads[0]


def safe_members(archive: zipfile.ZipFile) -> dict[str, bytes]:
    """Files of an archive in memory; refuses what ``checked_infos`` does, and damage."""
    infos = checked_infos(archive)
    if archive.testzip() is not None:
        raise ValueError("archive is corrupted")
    return {path: archive.read(m) for path, m in infos.items()}


def _zip_rows(name: str, data: bytes, **window) -> list[dict]:
    if len(data) > MAX_BYTES:
        raise ValueError("archive exceeds the 512 MB limit")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        files = safe_members(z)
    return _wfdb_rows(name, files, record_head(files), **window)


def decode(name: str, data: bytes, start: int = 0, stop: int | None = None) -> list[dict]:
    """Signals of one file by its suffix: .edf, .zip/.wfdb, .npy, .npz."""
    stem, suffix = os.path.splitext(os.path.basename(name))
    suffix = suffix.lower()
    if len(data) > MAX_BYTES:
        raise ValueError("file exceeds the 512 MB limit")
    if suffix == ".edf":
        return _edf_rows(stem, data, start, stop)
    if suffix in (".zip", ".wfdb"):
        return _zip_rows(stem, data, start=start, stop=stop)
    if suffix in (".npy", ".npz"):
        loaded = np.load(io.BytesIO(data), allow_pickle=False)
        arrays = {"value": loaded} if suffix == ".npy" else {k: loaded[k] for k in loaded.files}
        return [{"recording_id": stem, "channel": c, "channel_index": k, "fs_hz": None, "t0_s": None, "units": None, "source_format": suffix[1:], "values": np.asarray(v, dtype=float)[start:stop]} for k, (c, v) in enumerate(arrays.items())]
    raise ValueError(f"unsupported format {suffix!r}")


def _arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _decoded(files: DataFrame, fn, schema: str) -> DataFrame:
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = fn(path, content.as_py())
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile) as e:
                    rows = [{"recording_id": os.path.splitext(os.path.basename(path))[0], "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    return files.select("path", "content").mapInArrow(run, schema)


def read_signals(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Packed signals of .edf, .zip, .wfdb, .npy and .npz files (or a folder of them).

    A file that cannot be read gives one row with ``error``.
    """
    return decoded_signals(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), start, stop)


def decoded_signals(files: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """``read_signals`` of files given as rows (path, content); others are passed over."""
    own = files.where(F.lower("path").rlike(r"\.(edf|zip|wfdb|npy|npz)$"))
    return _decoded(own, lambda p, d: decode(p, d, start, stop), SIGNALS)


def _segment_owners(files: DataFrame) -> DataFrame:
    """(stem, owner): records that are segments of another one, from the headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    names = [n for n, _ in wfdb.segments(content.as_py().decode("latin-1"))]
                except (ValueError, IndexError):
                    names = []  # reported where the record is decoded
                rows += [(f"{path.rsplit('/', 1)[0]}/{n}", os.path.splitext(path)[0]) for n in names if n != "~"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["stem", "owner"])

    return files.where(F.lower("path").endswith(".hea")).select("path", "content").mapInArrow(run, "stem string, owner string").dropDuplicates(["stem"])


def _joined_segments(stem: str, files: dict[str, bytes], head: str, physical: bool) -> list[dict]:
    """Signals of a record of several segments, one after another."""
    parts = []
    for name, n in wfdb.segments(files[head].decode("latin-1")):
        if name == "~":
            raise ValueError("record has a segment without samples")
        rows = _wfdb_rows(stem, files, f"{name}.hea", physical=physical)
        if any(len(r["values"]) != n for r in rows):
            raise ValueError(f"segment {name} does not have {n} samples")
        parts.append(rows)
    if len({tuple(r["channel"] for r in rows) for rows in parts}) != 1:
        raise ValueError("segments have different channels")
    return [{**own[0], "values": np.concatenate([r["values"] for r in own])} for own in zip(*parts)]


def wfdb_records(files: DataFrame, physical: bool = True) -> DataFrame:
    """Packed signals of WFDB records given as files (path, content): a header and the
    signal files of the same folder and stem are one group; segments go with the record
    whose header lists them."""
    files = files.where(F.lower("path").rlike(r"\.(hea|dat)$")).select("path", "content")
    owners = _segment_owners(files)
    owners = F.broadcast(owners) if owners.limit(MAX_OWNERS + 1).count() <= MAX_OWNERS else owners
    stem = F.regexp_extract("path", r"^(.*?)\.[^./]+$", 1)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    owned = files.withColumn("stem", stem).join(owners, "stem", "left")
    groups = owned.groupBy(F.coalesce("owner", "stem").alias("path")).agg(F.collect_list(F.struct(name.alias("n"), F.col("content").alias("c"))).alias("members"))
    target = _arrow_schema(SIGNALS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                stem = os.path.basename(path)
                try:
                    own = {m["n"]: m["c"] for m in members.as_py()}
                    head = next((n for n in own if n.lower() == f"{stem}.hea".lower()), None)
                    if head is None:
                        raise ValueError("record has no header")
                    several = wfdb.segments(own[head].decode("latin-1"))
                    rows = _joined_segments(stem, own, head, physical) if several else _wfdb_rows(stem, own, head, physical=physical)
                except (ValueError, KeyError, IndexError) as e:
                    rows = [{"recording_id": stem, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    return groups.mapInArrow(run, SIGNALS)


def read_wfdb(spark: SparkSession, folder: str, physical: bool = True) -> DataFrame:
    """Packed signals of loose WFDB records (.hea with its files, one group a record)."""
    return wfdb_records(spark.read.format("binaryFile").load(folder), physical)


def read_annotations(spark: SparkSession, path: str, symbols: Sequence[str] | None = wfdb.BEAT_SYMBOLS) -> DataFrame:
    """(recording_id, sample_index, symbol, num, error) of annotation files, beat symbols only by default."""
    return decoded_annotations(spark.read.format("binaryFile").load(path), symbols)


def decoded_annotations(files: DataFrame, symbols: Sequence[str] | None = wfdb.BEAT_SYMBOLS) -> DataFrame:
    """``read_annotations`` of files given as rows (path, content)."""
    rows = _decoded(files, lambda p, d: [{"recording_id": _file_stem(p), "sample_index": s, "symbol": y, "num": n} for s, y, n in wfdb.annotations(d)], "recording_id string, sample_index long, symbol string, num int, error string")
    return rows if symbols is None else rows.where(F.col("symbol").isin(*symbols) | F.col("error").isNotNull())


def qrs_boundaries(annotations: DataFrame) -> DataFrame:
    """(recording_id, onset, offset) of the pairs of '(' and ')' with num 1; fails on broken pairs."""
    part = lambda s, name: annotations.where((F.col("num") == 1) & (F.col("symbol") == s)).select("recording_id", F.col("sample_index").alias(name), F.row_number().over(Window.partitionBy("recording_id").orderBy("sample_index")).alias("k"))
    both = part("(", "onset").join(part(")", "offset"), ["recording_id", "k"], "full")
    good = F.col("onset").isNotNull() & F.col("offset").isNotNull() & (F.col("onset") < F.col("offset"))
    checked = both.withColumn("__bad", F.assert_true(F.coalesce(good, F.lit(False)), F.lit("unmatched QRS boundary annotations")))
    return checked.where("__bad IS NULL").select("recording_id", "onset", "offset")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Header-level facts of .edf and .zip/.wfdb files."""
    return decoded_metadata(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def decoded_metadata(files: DataFrame) -> DataFrame:
    """``read_metadata`` of files given as rows (path, content)."""
    files = files.where(F.lower("path").rlike(r"\.(edf|zip|wfdb)$"))

    def one(p: str, d: bytes) -> list[dict]:
        stem, suffix = os.path.splitext(os.path.basename(p))
        if suffix.lower() == ".edf":
            h = edf.header(d)
            n, fs, labels = h.n_samples, h.fs_hz, [h.labels[i] for i in h.signals]
        else:
            with zipfile.ZipFile(io.BytesIO(d)) as z:
                h = wfdb.header(z.read(record_head(z.namelist())).decode("latin-1"))
            n, fs, labels = h.n_samples, h.fs_hz, h.labels
        return [{"recording_id": stem, "source_format": "edf" if suffix.lower() == ".edf" else "wfdb", "fs_hz": fs, "n_samples": n, "duration_s": (n - 1) / fs, "channels": unique_labels(labels)}]

    return _decoded(files, one, META)


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    """Packed signals of one file or record by its suffix (CSV, WFDB header, EDF, archives, NumPy)."""
    low = path.lower()
    if low.endswith(".csv"):
        return load_and_validate(spark, path)[0]
    if low.endswith((".hea", ".dat", ".atr")):
        stem = path.rsplit(".", 1)[0]
        folder, name = stem.rsplit("/", 1) if "/" in stem else (".", stem)
        return read_wfdb(spark, folder).where(F.col("recording_id") == name)
    return read_signals(spark, path)


# --- layouts and windows ----------------------------------------------------------------------------


def to_samples(signals: DataFrame) -> DataFrame:
    """Long layout."""
    return signals.where("error IS NULL").select("recording_id", "channel", "fs_hz", "t0_s", F.posexplode("values").alias("i", "value")).select("recording_id", "channel", F.col("i").cast("long").alias("sample_index"), (F.coalesce("t0_s", F.lit(0.0)) + F.col("i") / F.col("fs_hz")).alias("time_s"), "value")


def write_samples(samples: DataFrame, path: str) -> None:
    """Parquet by recording, rows in sample order, so that windows prune files and row groups."""
    samples.repartition("recording_id").sortWithinPartitions("recording_id", "channel", "sample_index").write.mode("overwrite").partitionBy("recording_id").parquet(path)


def window_scan(samples: DataFrame, start: int, stop: int, recording: str | None = None, on_short: str = "clip", total: int | None = None) -> DataFrame:
    """Samples [start, stop) of a recording; the range reaches the Parquet scan."""
    check_window(start, stop)
    if on_short == "error" and total is not None and stop > total:
        raise ValueError("window reaches past the end of the recording")
    rows = samples if recording is None else samples.where(F.col("recording_id") == recording)
    return rows.where((F.col("sample_index") >= start) & (F.col("sample_index") < stop))


def summary(report: DataFrame) -> DataFrame:
    """The facts of a validation report that describe the data set."""
    return report.select("recording_id", "n_samples", F.size("signal_cols").alias("n_channels"), "fs_hz", "duration_s", "valid")
