import io
import zipfile

import numpy as np
import pytest

from cardiolake.operators.validation import validate_series
from cardiolake.sources import edf, readers, wfdb


def test_csv_reader_keeps_physical_order(spark, tmp_path):
    (tmp_path / "x.csv").write_text("time,Lead_II\n0,.1\n0.002,.2\n0.004,.3\n")
    s, report = readers.load_and_validate(spark, str(tmp_path / "x.csv"))
    row = s.first()
    assert row["fs_hz"] == 500 and list(row["values"]) == [0.1, 0.2, 0.3] and row["recording_id"] == "x"
    assert readers.summary(report).first()["n_channels"] == 1
    (tmp_path / "y.csv").write_text("time,v\n0,1\n2,1\n1,1\n")
    assert not validate_series(readers.read_csv(spark, str(tmp_path / "y.csv"))).first()["valid"]
    with pytest.raises(ValueError):
        readers.load_and_validate(spark, str(tmp_path / "y.csv"))
    meta = readers.csv_metadata(readers.read_csv(spark, str(tmp_path / "x.csv"))).first()
    assert meta["n_samples"] == 3 and meta["channels"] == ["Lead_II"] and meta["error"] is None


def test_csv_files_keep_their_own_headers(spark, tmp_path):
    """Other column order, quoted commas, quotes and line ends, blank and missing cells."""
    (tmp_path / "a.csv").write_text('time,I,II\n0,1,10\n1,2,20\n')
    (tmp_path / "b.csv").write_text('time,II,I,"note, long"\n\n0,30,3,"x, ""y""\nz"\n1,40,4\n')
    rows = readers.read_csv(spark, str(tmp_path / "*.csv")).orderBy("recording_id", "sample_index").collect()
    assert [(r["recording_id"], r["I"], r["II"]) for r in rows] == [("a", "1", "10"), ("a", "2", "20"), ("b", "3", "30"), ("b", "4", "40")]
    assert [r["note, long"] for r in rows] == [None, None, 'x, "y"\nz', None]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "empty"))


@pytest.mark.parametrize("fmt,bits", [(16, 16), (24, 24), (32, 31), (61, 16), (160, 16), (310, 10), (311, 10)])
def test_wfdb_formats(fmt, bits):
    d = np.random.default_rng(fmt).integers(-(1 << bits - 1), 1 << bits - 1, size=(300, 3))
    assert (wfdb.digital(wfdb.pack(d, fmt), fmt, 3) == d).all()


def test_wfdb_differences_and_equal_stems(spark, tmp_path):
    d = np.cumsum(np.random.default_rng(1).integers(-100, 100, size=(200, 2)), axis=0) + [5, -7]
    steps = np.diff(np.vstack([[5, -7], d]), axis=0).astype(np.int8).tobytes()
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "r.hea").write_text("r 2 100 200\nr.dat 8 1 8 0 5 0 0 A\nr.dat 8 1 8 0 -7 0 0 B\n")
        (tmp_path / folder / "r.dat").write_bytes(steps)
    rows = readers.read_wfdb(spark, str(tmp_path / "*")).collect()
    assert len(rows) == 4 and all((np.array(r["values"]) == d[:, r["channel_index"]]).all() for r in rows)


def test_wfdb_segments(spark, tmp_path):
    """A record of two segments, a plain one beside it, one with a gap and one that lacks a segment."""
    d = np.random.default_rng(2).integers(-2000, 2000, size=(300, 2))
    for name, part in (("m_1", d[:100]), ("m_2", d[100:]), ("g_1", d[:100]), ("p", d)):
        (tmp_path / f"{name}.hea").write_text(f"{name} 2 100 {len(part)}\n{name}.dat 16 1 16 0 0 0 0 A\n{name}.dat 16 1 16 0 0 0 0 B\n")
        (tmp_path / f"{name}.dat").write_bytes(wfdb.pack(part, 16))
    (tmp_path / "m.hea").write_text("m/2 2 100 300\nm_1 100\nm_2 200\n")
    (tmp_path / "g.hea").write_text("g/2 2 100 200\ng_1 100\n~ 100\n")
    (tmp_path / "x.hea").write_text("x/1 2 100 100\nx_1 100\n")
    rows = {}
    for r in readers.read_wfdb(spark, str(tmp_path)).collect():
        rows.setdefault(r["recording_id"], []).append(r)
    assert sorted(rows) == ["g", "m", "p", "x"] and all(rows[k][0]["error"] for k in "gx")
    for k in "mp":
        assert all((np.array(r["values"]) == d[:, r["channel_index"]]).all() for r in rows[k]) and len(rows[k]) == 2


def test_edf_round_trip_and_window(spark, tmp_path):
    x = np.sin(np.arange(1000) / 20)
    (tmp_path / "r.edf").write_bytes(edf.write(["I", "I"], [x, 2 * x], 100))
    rows = readers.read_signals(spark, str(tmp_path)).orderBy("channel_index").collect()
    assert [r["channel"] for r in rows] == ["I", "I_2"] and np.abs(np.array(rows[1]["values"]) - 2 * x).max() < 1e-3
    part = readers.read_signals(spark, str(tmp_path), 150, 2000).orderBy("channel_index").first()
    assert len(part["values"]) == 850 and abs(part["values"][0] - x[150]) < 1e-3 and part["t0_s"] == 1.5
    meta = readers.read_metadata(spark, str(tmp_path)).first()
    assert meta["n_samples"] == 1000 and meta["fs_hz"] == 100 and meta["duration_s"] == pytest.approx(9.99)


def record(name="100", n=500):
    d = np.random.default_rng(0).integers(-2048, 2048, size=(n, 2))
    head = f"{name} 2 360 {n}\n{name}.dat 212 200(1024)/mV 11 1024 0 0 0 MLII\n{name}.dat 212 200 11 0 0 0 0 V5\n"
    return d, head.encode(), wfdb.pack_212(d)


def test_wfdb_record_and_annotations(spark, tmp_path):
    d, head, data = record()
    (tmp_path / "100.hea").write_bytes(head)
    (tmp_path / "100.dat").write_bytes(data)
    rows = readers.read_wfdb(spark, str(tmp_path)).orderBy("channel_index").collect()
    assert np.allclose(rows[0]["values"], (d[:, 0] - 1024) / 200) and np.allclose(rows[1]["values"], d[:, 1] / 200)
    raw = readers.read_recording(spark, str(tmp_path / "100.hea")).count()
    assert raw == 2
    notes = [(10, "(", 1), (20, "N", 1), (30, ")", 1), (5000, "+", 0), (5100, "V", 0)]
    assert wfdb.annotations(wfdb.pack_annotations(notes)) == notes
    (tmp_path / "100.atr").write_bytes(wfdb.pack_annotations(notes))
    assert [r["sample_index"] for r in readers.read_annotations(spark, str(tmp_path / "100.atr")).orderBy("sample_index").collect()] == [20, 5100]
    b = readers.qrs_boundaries(readers.read_annotations(spark, str(tmp_path / "100.atr"), None)).first()
    assert (b["onset"], b["offset"]) == (10, 30)


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    _, head, data = record()
    (tmp_path / "ok.zip").write_bytes(packed({"a/100.hea": head, "a/100.dat": data}))
    assert readers.read_signals(spark, str(tmp_path)).where("error IS NULL").count() == 2
    for members in ({"../../escape.txt": b"x"}, {"a.hea": head, "b.hea": head}, {"x.txt": b""}):
        with pytest.raises(ValueError):
            readers.decode("x.zip", packed(members))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    assert readers.read_signals(spark, str(tmp_path)).where("error IS NOT NULL").count() == 1


def test_numpy_and_windows(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(1000.0))
    assert readers.read_signals(spark, str(tmp_path), 990, 2000).first()["values"][0] == 990
    rows = spark.createDataFrame([("r", "c", i, i / 10, float(i)) for i in range(1000)], "recording_id string, channel string, sample_index long, time_s double, value double")
    readers.write_samples(rows, str(tmp_path / "samples"))
    w = readers.window_scan(spark.read.parquet(str(tmp_path / "samples")), 100, 125, "r")
    assert sorted(r["value"] for r in w.collect()) == list(range(100, 125))
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(sample_index,100)" in plan
    with pytest.raises(ValueError):
        readers.window_scan(rows, 0, 200, on_short="error", total=100)
