"""Queries of sources, validation, annotations, agreement, learning tables and provenance, with SQL forms.

Files are made from the driver tables as rows (path, content), which is what Spark's
``binaryFile`` source gives, and read back by the engine.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nonblank, safe_ratio, softmax, to_samples
from ..operators import annotations, learning, matching, projects, provenance, stats, validation
from ..sources import edf, ephys, readers, seek, wfdb
from .base import query, r6, scratch_path, series, table

# --- files made from tables -------------------------------------------------------------------------


def _files(rows: DataFrame, encode: Callable[[dict], tuple[str, bytes]]) -> DataFrame:
    """(path, content) of ``encode`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([c for _, c in made], pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def _vectors(spark, sf_dir) -> DataFrame:
    """Embeddings in whole thousandths."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda v: F.round(v * 1000).cast("int")).alias("v"))


def _as_edf(r: dict) -> tuple[str, bytes]:
    x = np.array(r["v"], dtype=float)
    return f"/in/s{r['vec_id']}.edf", edf.write(["a", "a"], [x, -x], 8, limits=(-32768, 32767))


def _record(r: dict, name: str) -> dict[str, bytes]:
    d = np.clip(np.stack([r["v"], [-x for x in r["v"]]], axis=1), -2000, 2000)
    head = f"{name} 2 16 {len(d)}\n{name}.dat 212 200(10)/mV 12 10 0 0 0 I\n{name}.dat 212 100 12 0 0 0 0 \n"
    return {f"{name}.hea": head.encode(), f"{name}.dat": wfdb.pack_212(d)}


def _as_archive(r: dict) -> tuple[str, bytes]:
    """A zipped record; every seventh has a member outside its folder, every eleventh two headers."""
    members = _record(r, "r")
    if r["vec_id"] % 7 == 0:
        members["../out.txt"] = b"x"
    elif r["vec_id"] % 11 == 0:
        members["q.hea"] = members["r.hea"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return f"/in/w{r['vec_id']}.zip", out.getvalue()


def _as_npy(r: dict) -> tuple[str, bytes]:
    out = io.BytesIO()
    np.save(out, np.array(r["v"], dtype=float))
    return f"/in/n{r['vec_id']}.npy", out.getvalue()


def _values(signals: DataFrame) -> DataFrame:
    return signals.where("error IS NULL").select("recording_id", "channel", F.posexplode("values").alias("i", "value"))


_INT = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS INTEGER)) AS v FROM embeddings)"


@query(f"WITH {_INT}, c AS (SELECT vec_id, 'a' AS channel, v FROM v UNION ALL SELECT vec_id, 'a_2', list_transform(v, lambda x: -x) FROM v) SELECT 's' || vec_id AS recording_id, channel, CAST(unnest(range(0, 64)) AS INTEGER) AS i, CAST(unnest(v) AS DOUBLE) AS value FROM c")
def edf_signals(spark, sf_dir):
    return _values(readers.decoded_signals(_files(_vectors(spark, sf_dir), _as_edf)))


@query(f"WITH {_INT}, c AS (SELECT vec_id, 'a' AS channel, v FROM v UNION ALL SELECT vec_id, 'a_2', list_transform(v, lambda x: -x) FROM v) SELECT 's' || vec_id AS recording_id, channel, CAST(unnest(range(0, 44)) AS INTEGER) AS i, CAST(unnest(v[21:64]) AS DOUBLE) AS value FROM c")
def edf_window(spark, sf_dir):
    """Samples [20, 70) of every file, clipped to its length."""
    return _values(readers.decoded_signals(_files(_vectors(spark, sf_dir), _as_edf), 20, 70))


@query("SELECT 's' || vec_id AS recording_id, 'edf' AS source_format, 8.0 AS fs_hz, CAST(64 AS BIGINT) AS n_samples, 7.875 AS duration_s, 'a,a_2' AS channels FROM embeddings UNION ALL SELECT 'w' || vec_id, 'wfdb', 16.0, CAST(64 AS BIGINT), 3.9375, 'I,channel_2' FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 <> 0")
def native_metadata(spark, sf_dir):
    """Facts from the headers of EDF files and archives."""
    v = _vectors(spark, sf_dir)
    m = readers.decoded_metadata(_files(v, _as_edf).unionByName(_files(v, _as_archive))).where("error IS NULL")
    return m.select("recording_id", "source_format", "fs_hz", "n_samples", "duration_s", F.array_join("channels", ",").alias("channels"))


_WFDB_SQL = _INT + """, k AS (SELECT vec_id, list_transform(v, lambda x: least(2000, greatest(-2000, x))) AS a, list_transform(v, lambda x: least(2000, greatest(-2000, -x))) AS b FROM v),
c AS (SELECT vec_id, 'I' AS channel, list_transform(a, lambda x: (x - 10) / 200.0) AS p, a AS d FROM k UNION ALL SELECT vec_id, 'channel_2', list_transform(b, lambda x: x / 100.0), b FROM k)"""


@query(f"WITH {_WFDB_SQL} SELECT 'w' || vec_id AS recording_id, channel, CAST(unnest(range(0, 64)) AS INTEGER) AS i, round(unnest(p), 6) AS value FROM c WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0")
def wfdb_archives(spark, sf_dir):
    s = readers.decoded_signals(_files(_vectors(spark, sf_dir), _as_archive))
    return _values(s).withColumn("value", r6("value"))


@query("SELECT 'w' || vec_id AS recording_id, CASE WHEN vec_id % 7 = 0 THEN 'unsafe' ELSE 'headers' END AS fault FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0")
def refused_archives(spark, sf_dir):
    s = readers.decoded_signals(_files(_vectors(spark, sf_dir), _as_archive)).where("error IS NOT NULL")
    return s.select("recording_id", F.when(F.col("error").contains("unsafe"), "unsafe").otherwise("headers").alias("fault"))


@query(f"WITH {_WFDB_SQL} SELECT 'r' || vec_id AS recording_id, channel, CAST(unnest(range(0, 64)) AS INTEGER) AS i, CAST(unnest(d) AS DOUBLE) AS value FROM c")
def wfdb_digital(spark, sf_dir):
    """Loose records (header and signal file), digital values."""
    v = _vectors(spark, sf_dir)
    member = lambda kind: _files(v, lambda r: (f"/in/r{r['vec_id']}.{kind}", _record(r, f"r{r['vec_id']}")[f"r{r['vec_id']}.{kind}"]))
    return _values(readers.wfdb_records(member("hea").unionByName(member("dat")), physical=False))


@query(f"WITH {_INT} SELECT 'n' || vec_id AS recording_id, CAST(unnest(range(0, 14)) AS INTEGER) AS i, CAST(unnest(v[51:64]) AS DOUBLE) AS value FROM v")
def npy_window(spark, sf_dir):
    return _values(readers.decoded_signals(_files(_vectors(spark, sf_dir), _as_npy), 50, 500)).drop("channel")


_MARKS = "marks AS (SELECT DISTINCT ON (user_id, s) user_id, s, event_type FROM (SELECT user_id, CAST(floor(epoch_us(ts) / 1e6 - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS s, event_type FROM events) ORDER BY user_id, s, event_type)"


def _marks(spark, sf_dir) -> DataFrame:
    at = F.floor(F.col("time_s") - 1704067200).cast("long")
    return series(spark, sf_dir).groupBy("user_id", at.alias("s")).agg(F.min("event_type").alias("event_type"))


@query(f"WITH {_MARKS} SELECT 'u' || user_id AS recording_id, s AS sample_index, CASE event_type WHEN 'click' THEN 'N' ELSE 'V' END AS symbol FROM marks WHERE event_type IN ('click', 'view')")
def annotation_files(spark, sf_dir):
    """Beats of annotation files; other symbols are left out."""
    lists = _marks(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("s", "event_type"))).alias("l"))
    symbol = {"click": "N", "view": "V", "purchase": "+", "error": "~"}
    files = _files(lists, lambda r: (f"/in/u{r['user_id']}.atr", wfdb.pack_annotations([(x["s"], symbol.get(x["event_type"], "|"), 0) for x in r["l"]])))
    return readers.decoded_annotations(files).where("error IS NULL").select("recording_id", "sample_index", "symbol")


@query(f"WITH {_MARKS}, d AS (SELECT DISTINCT user_id, s // 100 AS h FROM marks) SELECT 'u' || user_id AS recording_id, h * 100 AS onset, h * 100 + 30 AS \"offset\" FROM d")
def qrs_boundary_files(spark, sf_dir):
    lists = _marks(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_set(F.expr("s div 100"))).alias("l"))
    files = _files(lists, lambda r: (f"/in/u{r['user_id']}.q1c", wfdb.pack_annotations([x for h in r["l"] for x in ((h * 100, "(", 1), (h * 100 + 10, "N", 1), (h * 100 + 30, ")", 1))])))
    return readers.qrs_boundaries(readers.decoded_annotations(files, None))


def _csv_files(spark, sf_dir) -> DataFrame:
    """A CSV file per user: quoted names, another order of columns for odd users, a blank name."""
    s = series(spark, sf_dir)
    t, v, note = F.col("time_s").cast("string"), F.col("value").cast("string"), F.lit('"a, ""b"""')
    odd = F.col("user_id") % 2 == 1
    line = F.when(odd, F.concat_ws(",", v, t, note, F.col("sample_index"))).otherwise(F.concat_ws(",", t, v, note, F.col("sample_index")))
    head = F.when(odd, F.lit('"v, mV",Time,note,')).otherwise(F.lit('Time,"v, mV",note,'))
    lines = s.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("sample_index", line.alias("l")))).alias("l"))
    text = F.concat(head, F.lit("\r\n"), F.array_join(F.transform("l", lambda x: x["l"]), "\r\n"))
    return lines.select(F.concat(F.lit("/in/u"), "user_id", F.lit(".csv")).alias("path"), text.cast("binary").alias("content"))


@query("WITH {SERIES} SELECT 'u' || user_id AS recording_id, i AS sample_index, round(t, 6) AS time_s, round(value, 6) AS value, 'a, \"b\"' AS note, CAST(i AS VARCHAR) AS channel_4 FROM series")
def csv_rows(spark, sf_dir):
    rows = readers.csv_rows(_csv_files(spark, sf_dir))
    return rows.select("recording_id", "sample_index", r6(F.col("Time").cast("double")).alias("time_s"), r6(F.col("`v, mV`").cast("double")).alias("value"), "note", "channel_4")


@query("WITH {SERIES}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS dt FROM series) SELECT 'u' || user_id AS recording_id, 'v, mV' AS channel, round(1 / median(dt), 6) AS fs_hz, round(min(t), 6) AS t0_s, count(*) AS n, round(sum(value), 4) AS total FROM d GROUP BY user_id")
def csv_signals(spark, sf_dir):
    """Packed signals of validated CSV rows."""
    rows = readers.csv_rows(_csv_files(spark, sf_dir)).select("recording_id", "sample_index", "Time", "`v, mV`")
    validation.require_valid(validation.validate_series(rows, "Time"))
    s = readers.csv_signals(rows)
    return s.select("recording_id", "channel", "fs_hz", r6("t0_s").alias("t0_s"), F.size("values").cast("long").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("WITH {SERIES}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS dt FROM series) SELECT 'u' || user_id AS recording_id, round(1 / median(dt), 6) AS fs_hz, count(*) AS n_samples, round(max(t) - min(t), 6) AS duration_s, count(*) FILTER (dt <= 0) > 0 AS disordered FROM d GROUP BY user_id")
def csv_metadata(spark, sf_dir):
    m = readers.csv_metadata(readers.csv_rows(_csv_files(spark, sf_dir)))
    return m.select("recording_id", "fs_hz", "n_samples", r6("duration_s").alias("duration_s"), F.col("error").isNotNull().alias("disordered"))


@query("WITH {SERIES} SELECT 'u' || user_id AS recording_id, i AS sample_index, round(t, 6) AS time_s, round(value, 6) AS value FROM series WHERE i >= 5 AND i < 25")
def csv_window(spark, sf_dir):
    rows = readers.csv_rows(_csv_files(spark, sf_dir)).select("recording_id", "sample_index", r6(F.col("Time").cast("double")).alias("time_s"), r6(F.col("`v, mV`").cast("double")).alias("value"))
    return readers.window_scan(rows, 5, 25)


@query("SELECT 'd' || doc_id AS name, octet_length(encode(text)) AS length, sha256(text) AS sha256, substr(sha256(text), 1, 16) AS file_id FROM documents WHERE text IS NOT NULL")
def file_fingerprints(spark, sf_dir):
    files = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return provenance.fingerprints_of(files).withColumnRenamed("path", "name")


# --- parts of files, by byte ranges -------------------------------------------------------------------


def _long_vectors(spark, sf_dir) -> DataFrame:
    """A hundred embeddings in a row as one recording (vec_id, v)."""
    own = _vectors(spark, sf_dir).groupBy(F.expr("vec_id div 100").alias("r")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("l"))
    return own.select(F.col("r").alias("vec_id"), F.flatten(F.transform("l", lambda x: x["v"])).alias("v"))


def _native_files(spark, sf_dir, kinds: str) -> str:
    """Folder of the long recordings as EDF files, loose records, archives and arrays, as ``kinds`` asks."""
    v, folder = _long_vectors(spark, sf_dir), scratch_path(spark)
    member = lambda kind: lambda r: (f"r{r['vec_id']}.{kind}", _record(r, f"r{r['vec_id']}")[f"r{r['vec_id']}.{kind}"])
    makers = {"edf": [_as_edf], "wfdb": [member("hea"), member("dat")], "zip": [_as_archive], "npy": [_as_npy]}
    for make in (m for kind in kinds.split() for m in makers[kind]):
        seek.write_files(_files(v, make), folder)
    return folder


_LONG = _INT + """, o AS (SELECT vec_id // 100 AS r, (row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1) * 64 AS o, v FROM v),
x AS (SELECT r, CAST(o + unnest(range(0, 64)) AS BIGINT) AS i, unnest(v) AS v FROM o), k AS (SELECT r, i, least(2000, greatest(-2000, v)) AS a, least(2000, greatest(-2000, -v)) AS b FROM x)"""
_AS_EDF = "SELECT 's' || r AS recording_id, 'a' AS channel, i AS sample_index, CAST(v AS DOUBLE) AS value FROM x UNION ALL SELECT 's' || r, 'a_2', i, CAST(-v AS DOUBLE) FROM x"
_AS_WFDB = "SELECT 'r' || r AS recording_id, 'I' AS channel, i AS sample_index, round((a - 10) / 200.0, 6) AS value FROM k UNION ALL SELECT 'r' || r, 'channel_2', i, round(b / 100.0, 6) FROM k"


def _placed(windows: DataFrame, start: int) -> DataFrame:
    rows = windows.where("error IS NULL").select("recording_id", "channel", F.posexplode("values").alias("i", "value"))
    return rows.select("recording_id", "channel", (F.col("i").cast("long") + start).alias("sample_index"), r6("value").alias("value"))


@query(f"WITH {_LONG} SELECT * FROM ({_AS_EDF}) WHERE sample_index >= 3001 AND sample_index < 3500")
def edf_seek_window(spark, sf_dir):
    """A window of EDF files through the byte ranges of its data records."""
    return _placed(seek.read_window(spark, _native_files(spark, sf_dir, "edf"), 3001, 3500), 3001)


@query(f"WITH {_LONG} SELECT * FROM ({_AS_WFDB}) WHERE sample_index >= 3001 AND sample_index < 3500")
def wfdb_seek_window(spark, sf_dir):
    """A window of records of format 212, begun inside a unit of two numbers."""
    return _placed(seek.read_window(spark, _native_files(spark, sf_dir, "wfdb"), 3001, 3500), 3001)


@query(f"WITH {_LONG} SELECT 'n' || r AS recording_id, 'value' AS channel, i AS sample_index, CAST(v AS DOUBLE) AS value FROM x WHERE i >= 6000 UNION ALL SELECT replace(recording_id, 'r', 'w'), channel, sample_index, value FROM ({_AS_WFDB}) WHERE sample_index >= 6000 AND CAST(substr(recording_id, 2) AS INT) % 7 <> 0 AND CAST(substr(recording_id, 2) AS INT) % 11 <> 0")
def member_seek_window(spark, sf_dir):
    """The last samples of arrays and archives, clipped to their lengths; unsafe archives are refused."""
    return _placed(seek.read_window(spark, _native_files(spark, sf_dir, "npy zip"), 6000, 100_000), 6000)


@query(f"WITH {_LONG}, n AS (SELECT r, count(*) AS n, 8 * ((count(*) + 7) // 8) AS m FROM x GROUP BY r) SELECT 's' || r AS recording_id, 8.0 AS fs_hz, m AS n_samples, (m - 1) / 8.0 AS duration_s, 'a,a_2' AS channels, 768 AS bytes_read FROM n UNION ALL SELECT 'r' || r, 16.0, n, (n - 1) / 16.0, 'I,channel_2', 69 + 3 * length(CAST(r AS VARCHAR)) + length(CAST(n AS VARCHAR)) FROM n")
def header_facts(spark, sf_dir):
    """Facts of EDF files and loose records, with the bytes read for each."""
    m = seek.read_headers(spark, _native_files(spark, sf_dir, "edf wfdb")).where("error IS NULL")
    return m.select("recording_id", "fs_hz", "n_samples", "duration_s", F.array_join("channels", ",").alias("channels"), F.col("bytes_read").cast("int").alias("bytes_read"))


@query(f"WITH {_LONG} SELECT * FROM ({_AS_EDF} UNION ALL {_AS_WFDB}) WHERE sample_index >= 100")
def ephys_batch(spark, sf_dir):
    """All samples but the first hundred through the data source, in partitions of 2,000 samples."""
    ephys.register(spark)
    rows = spark.read.format("ephys").options(samplesPerPartition=2000, start=100).load(_native_files(spark, sf_dir, "edf wfdb"))
    return rows.select("recording_id", "channel", "sample_index", r6("value").alias("value"))


@query(f"WITH {_LONG} SELECT recording_id, channel, sample_index, value, round(sample_index / CASE WHEN recording_id LIKE 's%' THEN 8.0 ELSE 16.0 END, 6) AS time_s FROM ({_AS_EDF} UNION ALL {_AS_WFDB}) WHERE sample_index BETWEEN 1900 AND 2100 AND channel IN ('a_2', 'I')")
def ephys_window(spark, sf_dir):
    """A window of two channels through the data source; the range and the names reach its reader."""
    ephys.register(spark)
    rows = spark.read.format("ephys").options(samplesPerPartition=2000, pushFilters=True).load(_native_files(spark, sf_dir, "edf wfdb"))
    rows = rows.where("sample_index >= 1900 AND sample_index <= 2100 AND channel IN ('a_2', 'I')")
    return rows.select("recording_id", "channel", "sample_index", r6("value").alias("value"), r6("time_s").alias("time_s"))


# --- validation ---------------------------------------------------------------------------------------

_BROKEN = """{SERIES}, b AS (SELECT user_id, user_id % 6 AS k, i, CASE WHEN user_id % 6 = 3 THEN -t WHEN user_id % 6 = 5 AND i = 0 THEN NULL ELSE t END AS t,
CASE WHEN user_id % 6 = 1 OR (user_id % 6 = 2 AND i % 3 = 0) THEN NULL WHEN user_id % 6 = 4 AND i = 1 THEN CAST('inf' AS DOUBLE) ELSE value END AS v FROM series)"""


@query("WITH " + _BROKEN + """ SELECT CAST(user_id AS VARCHAR) AS recording_id, CASE k WHEN 1 THEN 'channel v is entirely missing' WHEN 2 THEN 'channel v has missing/non-numeric values' WHEN 3 THEN 'time must be strictly increasing'
WHEN 4 THEN 'channel v has infinite values' WHEN 5 THEN 'time has missing or non-numeric values' ELSE '' END AS errors, k = 0 AS valid, count(*) AS n_samples, CAST(1 AS INTEGER) AS n_channels FROM b GROUP BY user_id, k""")
def series_faults(spark, sf_dir):
    """Each kind of fault of a series, with the summary of its report."""
    k, i, t = F.col("user_id") % 6, F.col("sample_index"), F.col("time_s")
    time = F.when(k == 3, -t).when((k == 5) & (i == 0), F.lit(None)).otherwise(t)
    value = F.when((k == 1) | ((k == 2) & (i % 3 == 0)), F.lit(None)).when((k == 4) & (i == 1), F.lit(float("inf"))).otherwise(F.col("value"))
    rows = series(spark, sf_dir).select(F.col("user_id").cast("string").alias("recording_id"), "sample_index", time.alias("Time"), value.alias("v"))
    report = validation.validate_series(rows, validation.guess_time_column(rows.columns))
    about = readers.summary(report).select("recording_id", "n_channels", "n_samples", "valid")
    return report.select("recording_id", F.array_join("errors", "; ").alias("errors")).join(about, "recording_id")


_FAULTS = {
    1: "label is blank", 2: "channel is blank", 3: "confidence lies outside [0, 1]", 4: "status is not one of unreviewed, accepted, flagged", 5: "type is neither interval nor point", 6: "interval has an open side",
    7: "interval does not last", 8: "interval carries the time of a point", 9: "interval leaves the recording", 10: "point has no time", 11: "point carries sides of an interval", 12: "point leaves the recording",
}


@query("SELECT event_id AS id, CASE event_id % 14 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _FAULTS.items()) + " ELSE '' END AS faults, CASE WHEN event_id % 14 IN (6, 7, 8, 9) THEN CASE WHEN event_id % 14 = 9 THEN 90.0 ELSE 1.0 END WHEN event_id % 14 IN (5, 10) THEN NULL WHEN event_id % 14 = 12 THEN 101.0 ELSE 5.0 END AS position FROM events")
def annotation_faults(spark, sf_dir):
    """Every rule of an annotation broken in turn, and where each annotation stands."""
    k = F.col("event_id") % 14
    interval = k.isin(6, 7, 8, 9)
    null = F.lit(None).cast("double")
    a = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(k == 1, "  ").otherwise("beat").alias("label"), F.when(k == 2, "").otherwise("I").alias("channel"), F.when(k == 3, 1.5).otherwise(0.5).alias("confidence"),
        F.when(k == 4, "done").otherwise("accepted").alias("status"), F.when(interval, "interval").when(k == 5, "span").otherwise("point").alias("type"),
        F.when(k == 9, 90.0).when(interval, 1.0).when(k == 11, 1.0).otherwise(null).alias("start"), F.when(k == 6, null).when(k == 7, 1.0).when(k == 9, 110.0).when(interval, 2.0).otherwise(null).alias("end"),
        F.when(k == 8, 1.5).when(interval | k.isin(5, 10), null).when(k == 12, 101.0).otherwise(5.0).alias("time"),
    )
    return a.select("id", F.array_join(validation.annotation_errors(0.0, 100.0), "; ").alias("faults"), annotations.position().alias("position"))


@query("""WITH {BEATS}, q AS (SELECT user_id, i, t, rr_prev, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN hr + 1 ELSE hr END AS hr, CASE WHEN event_id % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS a,
CASE WHEN event_id % 13 = 0 THEN -1.0 WHEN event_id % 17 = 0 THEN 0.5 WHEN event_id % 3 = 0 THEN 3.0 ELSE i + 10.0 END AS r FROM beats),
c AS (SELECT *, CASE WHEN r >= 0 AND r = floor(r) THEN r END AS g FROM q)
SELECT user_id, count(*) AS n_rows, count(*) FILTER (hr IS NULL) + 0 AS missing_total, count(*) FILTER (isinf(a)) AS nonfinite_total, count(*) FILTER (g IS NULL) AS invalid_r_indices, count(g) - count(DISTINCT g) AS duplicate_r_indices,
CAST(max(CASE WHEN rr_prev <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS time_nonmonotonic, count(*) FILTER (rr_prev <= 0) AS invalid_rr, count(*) FILTER (rr_prev > 0 AND hr IS NOT NULL AND abs(60.0 / rr_prev - hr) > greatest(1e-6, abs(60.0 / rr_prev) * 1e-6)) AS inconsistent_heart_rate FROM c GROUP BY user_id""")
def quality_faults(spark, sf_dir):
    """The report over phenotypes in which every kind of fault occurs."""
    from .base import phenotypes

    k = lambda m: F.col("event_id") % m == 0
    p = phenotypes(spark, sf_dir).withColumn("row", F.col("r_index"))
    p = p.withColumn("heart_rate_bpm", F.when(k(5), F.lit(None)).when(k(7), F.col("heart_rate_bpm") + 1).otherwise(F.col("heart_rate_bpm"))).withColumn("r_amplitude", F.when(k(11), F.lit(float("inf"))).otherwise(F.col("r_amplitude")))
    p = p.withColumn("r_index", F.when(k(13), -1.0).when(k(17), 0.5).when(k(3), 3.0).otherwise(F.col("r_index") + 10.0))
    return validation.quality_report(p, ["user_id"], "row").drop("valid")


@query("SELECT c_custkey, regexp_full_match(n, '[A-Za-z0-9][A-Za-z0-9._-]{0,63}') AS fine FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '.' || c_name WHEN 2 THEN c_mktsegment || ' x' ELSE repeat('a', CAST(50 + c_custkey % 30 AS INTEGER)) END AS n FROM customer)")
def project_names(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    name = F.when(k == 0, F.col("c_name")).when(k == 1, F.concat(F.lit("."), "c_name")).when(k == 2, F.concat("c_mktsegment", F.lit(" x"))).otherwise(F.expr("repeat('a', int(50 + c_custkey % 30))"))
    return c.select("c_custkey", validation.is_project_name(name).alias("fine"))


@query("SELECT event_id, CAST(round_even(value * 2.5, 0) AS BIGINT) AS samples, length(trim(CASE WHEN event_id % 3 = 0 THEN '  ' ELSE event_type END)) > 0 AS named, round(value / greatest(value - 5, 1e-6), 4) AS ratio FROM events WHERE value IS NOT NULL")
def scalar_functions(spark, sf_dir):
    """Seconds to samples (halves to even), blank names, guarded ratios."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").withColumn("name", F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.col("event_type")))
    return e.select("event_id", to_samples(F.col("value"), 2.5).alias("samples"), nonblank("name").alias("named"), F.round(safe_ratio(F.col("value"), F.col("value") - 5), 4).alias("ratio"))


# --- agreement and annotations ----------------------------------------------------------------------


@query("""WITH {SERIES}, l AS (SELECT user_id, list([t] ORDER BY i) AS l FROM series WHERE event_type = 'click' GROUP BY user_id), r AS (SELECT user_id, list([t, i] ORDER BY i) AS r FROM series WHERE event_type = 'view' GROUP BY user_id),
b AS (SELECT user_id, coalesce(l, []) AS l, coalesce(r, []) AS r FROM l FULL JOIN r USING (user_id)),
f AS (SELECT user_id, len(l) AS nl, len(r) AS nr, list_reduce(list_concat([[-1.0, -1.0]], l)[2:], lambda a, x: CASE WHEN len(list_filter(r, lambda y: abs(y[1] - x[1]) <= 14400 AND NOT list_contains(a[1:-:2], y[2]))) = 0 THEN a
  ELSE list_concat(a, [list_sort(list_transform(list_filter(r, lambda y: abs(y[1] - x[1]) <= 14400 AND NOT list_contains(a[1:-:2], y[2])), lambda y: [abs(y[1] - x[1]), y[2]]))[1][2], list_min(list_transform(list_filter(r, lambda y: abs(y[1] - x[1]) <= 14400 AND NOT list_contains(a[1:-:2], y[2])), lambda y: abs(y[1] - x[1])))]) END, CAST([] AS DOUBLE[])) AS e FROM b)
SELECT user_id, CAST(len(e) // 2 AS BIGINT) AS matches, round((len(e) // 2) / greatest(nl, nr, 1), 6) AS agreement_rate, round(list_avg(e[2:-:2]), 4) AS mean_absolute_error_s FROM f""")
def point_agreement(spark, sf_dir):
    s = series(spark, sf_dir)
    points = s.select("user_id", F.lit("x").alias("label"), F.lit("c").alias("channel"), F.lit("point").alias("type"), F.col("time_s").alias("time"), F.col("sample_index").alias("seq"), "event_type")
    a = matching.point_agreement(points.where("event_type = 'click'"), points.where("event_type = 'view'"), 14400.0, ["user_id"])
    return a.select("user_id", "matches", r6("agreement_rate").alias("agreement_rate"), F.round("mean_absolute_error_s", 4).alias("mean_absolute_error_s"))


@query("""WITH {SERIES}, e AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS label, value FROM events), kept AS (SELECT * FROM e WHERE id <> '3')
SELECT id, label, CASE WHEN id = '5' THEN 'flagged' ELSE 'unreviewed' END AS status FROM kept UNION ALL SELECT 'copy', label, 'unreviewed' FROM kept WHERE id = '5'""")
def annotation_edits(spark, sf_dir):
    """Add, update, duplicate, delete; written as JSON and read again."""
    e = table(spark, sf_dir, "events")
    null = F.lit(None).cast("double")
    new = e.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("label"), F.lit("point").alias("type"), F.lit("I").alias("channel"), null.alias("start"), null.alias("end"), F.col("value").alias("time"), F.lit(1.0).alias("confidence"), *[F.lit("").alias(c) for c in ("notes", "annotator")], F.lit("unreviewed").alias("status"), *[F.lit("").alias(c) for c in ("reviewer", "review_notes")], F.col("event_id").alias("seq"))
    store = annotations.add(annotations.empty(spark), new.withColumn("time", F.abs("time")))
    store = annotations.delete(annotations.duplicate(annotations.update(store, "5", {"status": "flagged"}), "5", "copy"), "3")
    path = f"{scratch_path(spark)}/annotations"
    annotations.write_json(store, path)
    return annotations.read_json(spark, path).select("id", "label", "status")


# --- learning tables -----------------------------------------------------------------------------------


@query("""WITH {SERIES}, l AS (SELECT user_id, i, t AS tm FROM series WHERE event_type = 'click'), r AS (SELECT user_id, t AS tm, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS label FROM series WHERE event_type = 'view' AND value > 5),
near AS (SELECT *, (SELECT min(r.tm) FROM r WHERE r.user_id = l.user_id AND r.tm >= l.tm) AS nx, (SELECT max(r.tm) FROM r WHERE r.user_id = l.user_id AND r.tm < l.tm) AS pv FROM l),
pick AS (SELECT *, CASE WHEN nx IS NULL THEN pv WHEN pv IS NULL THEN nx WHEN nx - tm <= tm - pv THEN nx ELSE pv END AS ref FROM near),
won AS (SELECT *, row_number() OVER (PARTITION BY user_id, ref ORDER BY tm) AS k FROM pick WHERE abs(ref - tm) <= 14400)
SELECT w.user_id, w.i AS r_index, r.label, round(w.tm, 6) AS feature FROM won w JOIN r ON r.user_id = w.user_id AND r.tm = w.ref WHERE k = 1""")
def training_set(spark, sf_dir):
    """Features of beats next to accepted points, with their labels."""
    s = series(spark, sf_dir)
    b = s.where("event_type = 'click'").select("user_id", F.col("sample_index").alias("r_index"), "time_s")
    notes = s.select("user_id", F.lit("point").alias("type"), F.when(F.col("value") > 5, "accepted").otherwise("flagged").alias("status"), F.col("time_s").alias("time"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("label"), "event_type").where("event_type = 'view'")
    f = b.select("user_id", "r_index", F.array("time_s").alias("features"), F.lit(None).cast("string").alias("error"))
    t = learning.training_set(f, b, notes, 14400.0, ["user_id"])
    return t.select("user_id", "r_index", "label", r6(F.get("features", F.lit(0))).alias("feature"))


_FOLD = "list_reduce(list_transform({l}, lambda q: [q]), lambda a, q: CASE WHEN len(a) >= {n} OR len(list_filter(a, lambda y: abs(y[{t}] - q[1][{t}]) < {gap})) > 0 THEN a ELSE list_concat(a, q) END, CAST([] AS DOUBLE[][]))"


@query("WITH {SERIES}, s AS (SELECT user_id, list_sort(list([-value, t])) AS l FROM series GROUP BY user_id), f AS (SELECT user_id, " + _FOLD.format(l="l", n=5, t=2, gap=7200) + " AS f FROM s), u AS (SELECT user_id, unnest(f) AS x FROM f) SELECT user_id, round(x[2], 6) AS time_s, round(-x[1], 6) AS value FROM u")
def spaced_top(spark, sf_dir):
    """Highest values of every series, two hours apart."""
    t = learning.spaced(series(spark, sf_dir).select("user_id", "time_s", "value"), 7200.0, 5, ["user_id"], "value")
    return t.select("user_id", r6("time_s").alias("time_s"), r6("value").alias("value"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id % 7 <> 0), x AS (SELECT vec_id, label, list_transform(e, lambda y: exp(y - list_max(e))) AS x FROM v), p AS (SELECT vec_id, label, list_transform(x, lambda y: y / list_sum(x)) AS p FROM x),
u AS (SELECT vec_id, label, vec_id * 0.1 AS t, list_sum(list_transform(p, lambda y: y * ln(least(greatest(y, 1e-9), 1.0)))) AS m FROM p), s AS (SELECT label, list_sort(list([m, t, vec_id])) AS l FROM u GROUP BY label),
f AS (SELECT label, """ + _FOLD.format(l="l", n=25, t=2, gap=0.95) + """ AS f FROM s), o AS (SELECT label, unnest(f) AS x FROM f) SELECT label, CAST(x[3] AS BIGINT) AS r_index, round(-x[1], 6) AS uncertainty FROM o""")
def rank_uncertain(spark, sf_dir):
    """Most uncertain vectors of each label, away from annotated ones and from each other."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("r_index"), (F.col("vec_id") * 0.1).alias("time_s"), softmax("embedding").alias("probabilities"), F.lit("x").alias("predicted_label"))
    notes = e.where("r_index % 7 = 0").select("label", F.lit("point").alias("type"), F.col("time_s").alias("time"))
    r = learning.rank_uncertain(e, 25, notes, None, 0.05, 0.95, ["label"])
    return r.select("label", "r_index", r6("uncertainty").alias("uncertainty"))


_HASH = "CAST('0x' || substr(md5('42|' || CAST({c} AS VARCHAR)), 1, 15) AS BIGINT)"


@query("WITH h AS (SELECT c_custkey, " + _HASH.format(c="c_custkey") + " AS h FROM customer), k AS (SELECT *, row_number() OVER (ORDER BY h) AS k, count(*) OVER () AS n FROM h) SELECT c_custkey AS recording_id, CASE WHEN k <= greatest(1, round_even(n * 0.25, 0)) THEN 'test' ELSE 'train' END AS part FROM k")
def record_split(spark, sf_dir):
    return learning.record_split(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recording_id")))


_STRATA = "r AS (SELECT o_custkey AS id, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS rate FROM orders GROUP BY 1), st AS (SELECT id, rate, CAST(least(2, floor((row_number() OVER (ORDER BY rate, id) - 1) * 3.0 / count(*) OVER ())) AS INTEGER) AS stratum FROM r)"


@query("WITH " + _STRATA + ", h AS (SELECT id, stratum, " + _HASH.format(c="id") + " AS h FROM st), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM h) SELECT id AS recording_id, stratum, CASE WHEN k <= greatest(1, round_even(n * 0.2, 0)) THEN 'calibration' ELSE 'fit' END AS part FROM k")
def calibration_split(spark, sf_dir):
    """A fifth of the customers of each stratum of rising share of finished orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recording_id"), (F.col("o_orderstatus") == "F").cast("double").alias("label"))
    return learning.calibration_split(o)


@query("SELECT CAST(quality AS VARCHAR) AS label, count(DISTINCT source) AS n_groups FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def groups_per_class(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("source").alias("group_id"), F.col("quality").cast("string").alias("label"))
    return learning.groups_per_class(rows)


# --- statistics --------------------------------------------------------------------------------------

_CDF = """(0.5 + {x} / {steps} / 3 * list_sum(list_transform(range(0, {steps} + 1), lambda s: CASE WHEN s = 0 OR s = {steps} THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END
 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2) - 0.5 * ln({v} * pi()) - ({v} + 1) / 2 * ln(1 + ({x} * s / {steps}) ** 2 / {v})))))"""  # Simpson's rule over [0, x]
_UNITS = "u AS (SELECT c_mktsegment AS grp, o_custkey AS unit, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def _measurements(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("grp"), F.col("o_custkey").alias("unit_id"), F.col("o_totalprice").alias("value"))


@query("WITH " + _UNITS + f""", s AS (SELECT * FROM u WHERE grp IN ('BUILDING', 'MACHINERY')), m AS (SELECT grp, count(*) AS n, avg(value) AS m, median(value) AS md, var_samp(value) AS v FROM s GROUP BY grp), a AS (SELECT * FROM m WHERE grp = 'BUILDING'), b AS (SELECT * FROM m WHERE grp = 'MACHINERY'),
o AS (SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS oa, count(*) FILTER (c_mktsegment = 'MACHINERY') AS ob FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT grp, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM s), w AS (SELECT sum(r) FILTER (grp = 'BUILDING') AS ra FROM k),
tie AS (SELECT coalesce(sum(t ** 3 - t), 0) AS t FROM (SELECT count(*) AS t FROM s GROUP BY value)),
x AS (SELECT a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.md AS da, b.md AS db, oa, ob, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, (a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)) AS df, ra - a.n * (a.n + 1) / 2.0 AS u, tie.t AS tt FROM a, b, o, w, tie),
z AS (SELECT *, greatest(0, greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * (na + nb + 1 - tt / ((na + nb) * (na + nb - 1)))) AS z FROM x)
SELECT na AS n_a, nb AS n_b, oa AS n_observations_a, ob AS n_observations_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(da, 6) AS median_a, round(db, 6) AS median_b, round(u, 6) AS mann_whitney_u, round(2 * (1 - {_CDF.format(x="abs(t)", v="df", steps=2000)}), 6) AS welch_p,
round(2 * (0.5 - z / 2000 / 3 * list_sum(list_transform(range(0, 2001), lambda s: CASE WHEN s = 0 OR s = 2000 THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (z * s / 2000) ** 2) / sqrt(2 * pi())))), 6) AS mann_whitney_p FROM z""")
def compare_groups(spark, sf_dir):
    """Both tests with their p-values."""
    c = stats.compare_groups(_measurements(spark, sf_dir), "BUILDING", "MACHINERY")
    return c.select("n_a", "n_b", "n_observations_a", "n_observations_b", *[r6(k).alias(k) for k in ("mean_a", "mean_b", "median_a", "median_b", "mann_whitney_u", "welch_p", "mann_whitney_p")])


@query("WITH RECURSIVE " + _UNITS + f""", m AS (SELECT grp, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM u GROUP BY grp),
half(grp, n, m, s, lo, hi, k) AS (SELECT grp, n, m, s, CAST(0 AS DOUBLE), CAST(20 AS DOUBLE), 0 FROM m WHERE n > 1 UNION ALL
SELECT grp, n, m, s, CASE WHEN {_CDF.format(x="((lo + hi) / 2)", v="(n - 1.0)", steps=400)} < 0.975 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_CDF.format(x="((lo + hi) / 2)", v="(n - 1.0)", steps=400)} < 0.975 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM half WHERE k < 45)
SELECT grp, n, round(m, 4) AS mean, round(s, 4) AS sd, round(m - lo * s / sqrt(n), 2) AS ci_low, round(m + lo * s / sqrt(n), 2) AS ci_high FROM half WHERE k = 45""")
def mean_interval(spark, sf_dir):
    """Means of units with their t intervals."""
    m = stats.mean_interval(stats.unit_means(_measurements(spark, sf_dir)), "value", ["grp"]).where("n > 1")
    return m.select("grp", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("ci_low", 2).alias("ci_low"), F.round("ci_high", 2).alias("ci_high"))


@query("""WITH p AS (SELECT o_orderkey AS center, CAST(o_custkey AS BIGINT) AS a, CAST(o_custkey AS BIGINT) + 5 AS b FROM orders)
SELECT center, a AS onset, b AS "offset", a + center % 3 AS reference_onset, b - center % 2 AS reference_offset FROM p WHERE center % 5 <> 0""")
def match_boundaries(spark, sf_dir):
    """Found and reference boundaries of each centre; a fifth has no reference."""
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("center"), F.col("o_custkey").cast("long").alias("onset"), (F.col("o_custkey").cast("long") + 5).alias("offset"))
    ref = found.where("center % 5 <> 0").select("center", (F.col("onset") + F.col("center") % 3).alias("onset"), (F.col("offset") - F.col("center") % 2).alias("offset"))
    return matching.match_boundaries(found, ref, [])


# --- provenance --------------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def missing_records(spark, sf_dir):
    """Manifest less results: customers without a pending order."""
    results = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return provenance.missing_results(table(spark, sf_dir, "customer"), results, "c_custkey")


@query("SELECT DISTINCT ON (user_id, s) user_id, s, v AS value FROM (SELECT user_id, floor(value) AS s, max(value) AS v, 0 AS k FROM events WHERE event_type = 'view' AND value IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT user_id, floor(value), max(value), 1 FROM events WHERE event_type = 'click' AND value IS NOT NULL GROUP BY 1, 2) ORDER BY user_id, s, k DESC")
def union_by_priority(spark, sf_dir):
    """Union of two lists of peaks in which the later list wins on equal keys."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    part = lambda k: e.where(F.col("event_type") == k).groupBy("user_id", F.floor("value").cast("double").alias("s")).agg(F.max("value").alias("value"))
    return provenance.union_by_priority(part("view"), part("click"), ["user_id", "s"])


@query("""WITH n AS (SELECT string_agg('"' || n_name || '"', ',' ORDER BY n_nationkey) AS r FROM nation)
SELECT sha256('{"annotation_policy":"beats","calibration_records":[],"dataset_id":"nations","dataset_version":"1","detector_config":{"a":1,"b":[1,2]},"input_files":{},"preprocessing":{},"record_subject_map":{},"records":[' || r || '],"schema_version":"study-manifest-v2","software_commit":"c","software_version":"v","source":"tables","split_manifest":{},"subject_ids":[]}') AS manifest_sha256 FROM n""")
def manifest_hash(spark, sf_dir):
    """Canonical hash of a manifest; the moment it was made and the order of keys do not count."""
    names = [r[0] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    made = [provenance.Manifest("nations", "1", "tables", names, annotation_policy="beats", detector_config={"b": [1, 2], "a": 1}, software_version="v", software_commit="c", generated_at_utc=at) for at in ("2020-01-01T00:00:00+00:00", "2021-01-01T00:00:00Z")]
    return spark.createDataFrame([(x,) for x in sorted({m.sha256() for m in made})], "manifest_sha256 string")


@query("SELECT CAST(c_custkey AS VARCHAR) AS recording_id, CASE WHEN c_custkey % 3 = 0 THEN 'again' ELSE c_mktsegment END AS grp FROM customer")
def project_store(spark, sf_dir):
    """Recordings added to a project, a third of them a second time with another group."""
    store = projects.ProjectStore(spark, f"{scratch_path(spark)}/projects")
    null = lambda t: F.lit(None).cast(t)
    c = table(spark, sf_dir, "customer")
    full = c.select(F.col("c_custkey").cast("string").alias("recording_id"), null("string").alias("subject_id"), F.col("c_mktsegment").alias("grp"), *[null("string").alias(k) for k in ("visit", "path", "source_format")], null("double").alias("fs_hz"), null("double").alias("duration_s"), null("array<string>").alias("channels"), null("map<string,string>").alias("metadata"))
    store.add("study", full)
    return store.add("study", full.where("int(recording_id) % 3 = 0").withColumn("grp", F.lit("again"))).select("recording_id", "grp")
