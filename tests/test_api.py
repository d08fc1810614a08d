import numpy as np
import pytest

from cardiolake import api
from cardiolake.operators import projects, provenance
from cardiolake.operators.provenance import PROJECT_SCHEMA


@pytest.fixture(scope="module")
def signals(spark):
    x = np.zeros(2000)
    x[[250, 750, 1250, 1750]] = 5
    return spark.createDataFrame([("r", "c", 500.0, 0.0, x.tolist())], "recording_id string, channel string, fs_hz double, t0_s double, values array<double>")


def test_csv_calls(spark, tmp_path):
    (tmp_path / "x.csv").write_text("time,Lead_II\n" + "\n".join(f"{i / 500},{i}" for i in range(200)))
    path = str(tmp_path / "x.csv")
    assert api.analyze(spark, path)["valid"] and api.recording(spark, path).first()["fs_hz"] == 500
    assert sorted(r["value"] for r in api.window(spark, path, 20, 25).collect()) == [20, 21, 22, 23, 24]
    with pytest.raises(ValueError):
        api.window(spark, path, 5, 5)


def test_from_peaks_to_report(spark, signals):
    peaks = api.r_peaks(signals)
    rows, summary = api.phenotype(signals, peaks)
    assert rows.count() == 4 and summary.first()["heart_rate_bpm_median"] == 60
    ref = spark.createDataFrame([("r", 250), ("r", 760), ("r", 1250)], "recording_id string, sample_index long")
    m = provenance.Manifest("d", "1", "s", ["r"], software_version="1", software_commit="c")
    report = api.validate_detector(signals, ref, m, n_bootstrap=100)
    assert report["summary"]["pooled"]["true_positive"] == 3 and report["summary"]["pooled"]["false_positive"] == 1


def test_two_stage_benchmark(spark):
    """Records of two sampling rates with steep beats and broad bumps: the second stage drops the bumps."""
    rng, rows, refs = np.random.default_rng(4), [], []
    for k in range(12):
        fs = (200, 250)[k % 2]
        x = 0.02 * rng.normal(size=30 * fs)
        for j in range(1, 29):
            at = j * fs
            x[at - 2 : at + 3] += np.array([0.5, 1.0, 1.5, 1.0, 0.5])
            refs.append((f"r{k}", at))
            if (j + k) % 3 == 0:
                mid = at + fs // 2
                x[mid - 25 : mid + 26] += 1.2 * np.hanning(51)
        rows.append((f"r{k}", "c", float(fs), 0.0, x.tolist()))
    s = spark.createDataFrame(rows, "recording_id string, channel string, fs_hz double, t0_s double, values array<double>")
    out = api.benchmark_two_stage(s, spark.createDataFrame(refs, "recording_id string, sample_index long"), trees=15)
    parts = {r["recording_id"]: r["part"] for r in out["split"].collect()}
    assert sorted(parts.values()).count("test") == 3 and len(parts) == 12
    assert {r["recording_id"] for r in out["metrics"].collect()} == {k for k, v in parts.items() if v == "test"}
    p = {r["stage"]: r for r in out["pooled"].collect()}
    assert p["stage_1"]["sensitivity"] > 0.95 and p["stage_1"]["false_positive"] > 10
    assert p["two_stage"]["false_positive"] < p["stage_1"]["false_positive"] / 4 and p["two_stage"]["sensitivity"] > 0.95
    assert out["metadata"]["calibration_method"] == "held_out_records"


def test_small_calls(spark):
    assert api.false_discovery(spark, [0.01, 0.04, 0.2]) == pytest.approx([0.03, 0.06, 0.2]) and api.false_discovery(spark, []) == []
    v = spark.createDataFrame([("a", "u", 1.0), ("a", "v", 2.0), ("b", "w", 3.0), ("b", "x", 4.0)], "grp string, unit_id string, value double")
    assert api.compare(v, "a", "b")["mann_whitney_u"] == 0


def test_project_store(spark, tmp_path):
    store = projects.ProjectStore(spark, f"file://{tmp_path}")
    row = lambda k, fs: spark.createDataFrame([(None, k, "s", "g", "v", "p", "csv", fs, 1.0, ["c"], {"a": "b"})], PROJECT_SCHEMA)
    assert store.load("p1").count() == 0
    store.add("p1", row("r", 1.0))
    store.add("p1", row("q", 1.0))
    assert sorted((r["recording_id"], r["fs_hz"]) for r in store.add("p1", row("r", 2.0)).collect()) == [("q", 1.0), ("r", 2.0)]
    with pytest.raises(ValueError):
        store.load("../x")


def test_windows_and_metadata_of_native_files(spark, tmp_path):
    import numpy as np

    from cardiolake import api
    from cardiolake.sources import edf

    x = np.sin(np.arange(1000) / 20)
    (tmp_path / "r.edf").write_bytes(edf.write(["I"], [x], 100))
    rows = api.window(spark, str(tmp_path / "r.edf"), 150, 160).orderBy("sample_index").collect()
    assert [r["sample_index"] for r in rows] == list(range(150, 160)) and rows[0]["time_s"] == 1.5 and abs(rows[3]["value"] - x[153]) < 1e-3
    m = api.metadata(spark, str(tmp_path / "r.edf")).first()
    assert (m["n_samples"], m["bytes_read"]) == (1000, 512)
    (tmp_path / "r.csv").write_text("time,I\n0,1\n0.5,2\n1.0,3\n")
    assert api.metadata(spark, str(tmp_path / "r.csv")).first()["fs_hz"] == 2.0
