"""Parts of files: results equal those of whole reads, and bytes read follow the window."""

import io
import os
import zipfile

import numpy as np
import pytest

from cardiolake.sources import edf, ephys, readers, seek, wfdb

RNG = np.random.default_rng(8)


def values(rows):
    return {(r["recording_id"], r["channel"]): list(r["values"]) for r in rows}


def write_record(folder, name, d, fmt, n=None, files=None):
    files = files or [f"{name}.dat"] * d.shape[1]
    lines = [f"{f} {fmt} 100({k})/mV 16 {k} 0 0 0 c{k}" for k, f in enumerate(files)]
    (folder / f"{name}.hea").write_text(f"{name} {d.shape[1]} 100 {'' if n is None else n}\n" + "\n".join(lines) + "\n")
    for f in set(files):
        own = d[:, [k for k, x in enumerate(files) if x == f]]
        (folder / f).write_bytes(wfdb.pack_212(own) if fmt == 212 else np.diff(own, axis=0, prepend=0).astype(np.int8).tobytes() if fmt == 8 else wfdb.pack(own, fmt))


@pytest.mark.parametrize("start,stop", [(0, 1), (0, 400), (7, 90), (123, 124), (398, 900), (400, 401), (900, 901)])
def test_windows_of_every_format_equal_slices(tmp_path, start, stop):
    for channels in (1, 2, 3):
        for fmt in (8, 16, 24, 32, 61, 160, 212, 310, 311):
            d = RNG.integers(-40, 40, size=(400, channels))
            write_record(tmp_path, f"f{fmt}", d, fmt, n=400)
            rows = seek.window_rows(str(tmp_path / f"f{fmt}.hea"), start, stop, physical=False)
            assert [list(r["values"]) for r in rows] == [list(map(float, d[start:stop, k])) for k in range(channels)], fmt
            assert all(r["total_samples"] == 400 for r in rows)
    d = RNG.integers(-40, 40, size=(400, 3))
    write_record(tmp_path, "split", d, 212, n=400, files=["a.dat", "b.dat", "a.dat"])
    rows = seek.window_rows(str(tmp_path / "split.hea"), start, stop, physical=False)
    whole = wfdb.samples(wfdb.header((tmp_path / "split.hea").read_text()), {x: (tmp_path / x).read_bytes() for x in ("a.dat", "b.dat")}, False)
    assert sorted(tuple(r["values"]) for r in rows) == sorted(tuple(whole[start:stop, k]) for k in range(3))
    x = np.sin(np.arange(400) / 9)
    (tmp_path / "r.edf").write_bytes(edf.write(["I", "II"], [x, 2 * x], 25))
    rows = seek.window_rows(str(tmp_path / "r.edf"), start, stop)
    assert [list(r["values"]) for r in rows] == [list(v) for v in edf.samples((tmp_path / "r.edf").read_bytes(), start, stop)[1]]


def test_windows_over_segments(tmp_path):
    d = RNG.integers(-2000, 2000, size=(300, 2))
    write_record(tmp_path, "m_1", d[:101], 212, n=101)
    write_record(tmp_path, "m_2", d[101:], 16, n=199)
    (tmp_path / "m.hea").write_text("m/3 2 100 350\nm_1 101\nm_2 199\n~ 50\n")
    for start, stop in ((0, 50), (90, 130), (101, 300), (250, 300)):
        rows = seek.window_rows(str(tmp_path / "m.hea"), start, stop, physical=False)
        assert all((r["values"] == d[start:stop, r["channel_index"]]).all() and r["t0_s"] == start / 100 for r in rows) and len(rows) == 2
    with pytest.raises(ValueError):
        seek.window_rows(str(tmp_path / "m.hea"), 290, 310)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Recordings of 500,000 samples: an EDF file, a record, stored and deflated archives, arrays."""
    at, n = tmp_path_factory.mktemp("long"), 500_000
    x = np.cumsum(RNG.normal(size=n))
    x = 100 * x / np.abs(x).max()
    (at / "e.edf").write_bytes(edf.write(["I", "II"], [x, -x], 250))
    d = np.stack([x * 15, x * -9], axis=1).astype(int)
    write_record(at, "w", d, 212, n=n)
    write_record(at, "u", d, 16)  # a header without a length
    for name, how in (("stored", zipfile.ZIP_STORED), ("deflated", zipfile.ZIP_DEFLATED)):
        with zipfile.ZipFile(at / f"{name}.zip", "w", how) as z:
            z.write(at / "w.hea", "x/w.hea")
            z.write(at / "w.dat", "x/w.dat")
            z.writestr("x/other.bin", bytes(2_000_000))
    np.save(at / "a.npy", x)
    np.savez(at / "b.npz", p=x, q=-x)
    (at / "bad.edf").write_bytes(b"no recording")
    (at / "notes.txt").write_text("passed over")
    return at


def test_bytes_follow_the_window_not_the_file(spark, folder):
    rows = seek.read_window(spark, str(folder), 250_100, 250_600).collect()
    whole = values(readers.read_signals(spark, str(folder), 250_100, 250_600).where("error IS NULL").collect())
    whole |= {k: v[250_100:250_600] for k, v in values(readers.read_wfdb(spark, str(folder)).where("error IS NULL").collect()).items()}
    good = [r for r in rows if r["error"] is None]
    assert values(good) == whole and len(good) == 13
    assert [r["recording_id"] for r in rows if r["error"]] == ["bad"]
    read = {r["recording_id"]: r["bytes_read"] for r in good}
    assert read["e"] <= 256 * 3 + 4 * 250 * 4 and read["w"] <= 500 * 3 + 200 and read["u"] <= 500 * 4 + 200 and read["a"] <= 500 * 8 + 200
    assert read["deflated"] < os.path.getsize(folder / "w.dat") * 0.75 and all(r["total_samples"] == 500_000 for r in good)
    tail = {r["recording_id"]: r for r in seek.read_window(spark, str(folder), 499_990, 500_090).where("channel_index = 0 AND error IS NULL").collect()}
    assert all(len(r["values"]) == 10 for r in tail.values()) and tail["e"]["t0_s"] == 499_990 / 250
    with pytest.raises(ValueError):
        seek.read_window(spark, str(folder), 0, 1_000_000)


def test_headers_cost_kilobytes(spark, folder):
    rows = {r["recording_id"]: r for r in seek.read_headers(spark, str(folder)).collect()}
    assert {k for k, r in rows.items() if r["error"]} == {"bad"}
    assert {k: r["n_samples"] for k, r in rows.items() if not r["error"]} == dict.fromkeys(["e", "w", "u", "stored", "deflated"], 500_000)
    assert all(r["bytes_read"] < 8_000 for r in rows.values() if not r["error"]) and rows["e"]["bytes_read"] == 768
    old = {r["recording_id"]: r for r in readers.read_metadata(spark, str(folder)).where("error IS NULL").collect()}
    assert all(rows[k][c] == r[c] for k, r in old.items() for c in ("fs_hz", "n_samples", "duration_s", "channels"))


def test_sparse_file_of_two_gigabytes(spark, tmp_path):
    """A header that announces 2 GB, and a file of that length of which little is read."""
    head = bytearray(edf.write(["I"], [np.zeros(1000)], 1000)[:512])
    head[236:244] = b"1000000 "
    with open(tmp_path / "big.edf", "wb") as f:
        f.write(head)
        f.truncate(512 + 2_000 * 1_000_000)
    r = seek.read_headers(spark, str(tmp_path)).first()
    assert r["n_samples"] == 10**9 and r["bytes_read"] == 512
    w = seek.read_window(spark, str(tmp_path), 700_000_500, 700_000_600).first()
    assert len(w["values"]) == 100 and w["bytes_read"] == 512 + 2_000


def test_unknown_file_systems_are_read_whole(spark, folder, monkeypatch):
    rows = values(seek.read_window(spark, str(folder), 100, 300).where("error IS NULL").collect())
    facts = {(r["recording_id"], r["n_samples"]) for r in seek.read_headers(spark, str(folder)).where("error IS NULL AND recording_id IN ('e', 'stored', 'deflated')").collect()}
    monkeypatch.setattr(seek, "SCHEMES", {})
    plain = seek.read_window(spark, str(folder), 100, 300).where("error IS NULL").collect()
    assert values(plain) == rows and all(r["bytes_read"] is None for r in plain)
    assert {(r["recording_id"], r["n_samples"]) for r in seek.read_headers(spark, str(folder)).where("error IS NULL").collect()} == facts


def test_listing_opens_nothing(spark, folder):
    plan = seek._listed(spark, str(folder), "edf")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


# --- the data source --------------------------------------------------------------------------------


def test_source_pushes_filters(spark, folder, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    for name in ("e.edf", "w.hea", "w.dat", "a.npy", "stored.zip"):
        os.link(folder / name, good / name)
    load = lambda **o: spark.read.format("ephys").options(samplesPerPartition=100_000, **o).load(str(good))
    cells = lambda df: sorted((r["recording_id"], r["channel"], r["sample_index"], r["value"], r["time_s"]) for r in df.collect())
    want = sorted((r["recording_id"], r["channel"], 199_990 + i, v, (199_990 + i) / r["fs_hz"]) for r in seek.read_window(spark, str(good), 199_990, 200_010).collect() for i, v in enumerate(r["values"]) if r["channel"] in ("I", "c1"))
    ephys.register(spark)
    rows = load()
    part = rows.where("sample_index >= 199990 AND sample_index < 200010 AND channel IN ('I', 'c1') AND value < 1e9")
    assert cells(part) == want and len(want) == 60 and rows.count() == 7 * 500_000
    assert cells(load(start=199_990, stop=200_010, channels="I, c1")) == want and load(recordings="a,none", stop=7).count() == 7
    part = load(pushFilters=True).where("sample_index >= 199990 AND sample_index < 200010 AND channel IN ('I', 'c1') AND value < 1e9")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "199990" not in plan and "IN (" not in plan and "< 1.0E9" in plan  # what is pushed is no filter of the plan any more
    assert cells(part) == want
    assert load(pushFilters=True).where("recording_id = 'a' AND sample_index = 5").collect()[0]["time_s"] is None
    assert load(pushFilters=True).where("sample_index < 0").count() == 0 and load(pushFilters=True).where("recording_id = 'none'").count() == 0


def test_source_partitions(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringContains

    r = ephys.PushingReader(str(folder / "e.edf"), 100_000)
    assert len(r.partitions()) == 5
    odd = StringContains(("channel",), "I")
    left = list(r.pushFilters([GreaterThanOrEqual(("sample_index",), 150_000), LessThan(("sample_index",), 260_000), EqualTo(("channel",), "II"), odd]))
    assert left == [odd] and [p.files[0][1:] for p in r.partitions()] == [(150_000, 250_000), (250_000, 260_000)]
    batches = list(r.read(r.partitions()[1]))
    assert sum(b.num_rows for b in batches) == 10_000 and batches[0].column(1)[0].as_py() == "II"


def test_written_files_are_read_back(spark, tmp_path):
    files = spark.createDataFrame([(f"/x/f{i}.bin", bytes([i]) * i) for i in range(9)], "path string, content binary")
    seek.write_files(files, f"file://{tmp_path}/out")
    assert {p.name: len(p.read_bytes()) for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {f"f{i}.bin": i for i in range(9)}
