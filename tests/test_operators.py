import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardiolake.operators import annotations as ann
from cardiolake.operators import beats, candidates, detection, learning, matching, provenance, stats, validation


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, values, schema="recording_id string, sample_index long"):
    return df(spark, [("r", int(v)) for v in values], schema)


# --- validation


def series(spark, times, values=None):
    values = values if values is not None else [0.1 * i for i in range(len(times))]
    return df(spark, [("r", i, t, v) for i, (t, v) in enumerate(zip(times, values))], "recording_id string, sample_index long, time double, lead double")


def test_valid_csv_series(spark):
    r = validation.validate_series(series(spark, [0.0, 0.002, 0.004])).first()
    assert r["valid"] and r["fs_hz"] == 500 and r["signal_cols"] == ["lead"] and r["time_col"] == "time"


def test_disorder_and_gaps_in_time(spark):
    assert any("strictly increasing" in e for e in validation.validate_series(series(spark, [0.0, 0.01, 0.005])).first()["errors"])
    r = validation.validate_series(series(spark, [0.0, 0.01, 0.02, 0.035, 0.045])).first()
    assert r["valid"] and any("irregular" in w for w in r["warnings"])


def test_missing_and_infinite_values(spark):
    r = validation.validate_series(series(spark, [0.0, 0.1, 0.2], [1.0, float("nan"), 2.0])).first()
    assert not r["valid"] and any("missing/non-numeric" in e for e in r["errors"])
    with pytest.raises(ValueError):
        validation.require_valid(validation.validate_series(series(spark, [0.0, 0.1], [1.0, float("inf")])))


def test_labels_are_unique_even_if_taken():
    assert validation.unique_labels(["a", "a", "a_2", " "]) == ["a", "a_2", "a_2_2", "channel_4"]
    assert validation.guess_time_column(["Lead", " Time_S "]) == " Time_S "


def test_window_bounds():
    validation.check_window(0, 100_000)
    for bad in ((-1, 5), (5, 5), (0, 100_001)):
        with pytest.raises(ValueError):
            validation.check_window(*bad)


def test_phenotype_quality(spark):
    rows = [("r", 0, 10.0, 1.0, 80.0, 1.0, 1.0), ("r", 1, 10.0, 0.5, 60.0, 1.0, 1.0), ("r", 2, 1.5, 2.0, None, 1.0, None), ("r", 3, -1.0, 3.0, 60.0, 1.0, -1.0)]
    q = validation.quality_report(df(spark, rows, "recording_id string, row long, r_index double, r_time_s double, heart_rate_bpm double, r_amplitude double, rr_prev_s double")).first()
    assert (q["duplicate_r_indices"], q["time_nonmonotonic"], q["inconsistent_heart_rate"], q["invalid_r_indices"], q["missing_total"], q["invalid_rr"], q["valid"]) == (1, 1, 1, 2, 1, 1, False)


@pytest.mark.parametrize("values,ok", [([0, 5, 9], True), ([1.5], False), ([-1], False), ([1, 1], False), ([2, 1], False)])
def test_strict_indices(spark, values, ok):
    rows = df(spark, [("r", i, float(v)) for i, v in enumerate(values)], "recording_id string, row long, v double")
    assert validation.strict_indices(rows, "v").first()["valid"] is ok


# --- beats


def test_beats_of_a_regular_rhythm(spark):
    peaks = df(spark, [("r", 250), ("r", 750), ("r", 1250), ("r", 1250), ("r", 9999)], "recording_id string, r_index long")
    rec = df(spark, [("r", 1500, 0.0, 2.998, 500.0)], "recording_id string, n_samples long, time_start_s double, time_end_s double, fs_hz double")
    b = beats.segment_beats(peaks, rec, 0.2, 0.3).orderBy("index").collect()
    assert len(b) == 3 and b[1]["rr_prev_s"] == 1.0 and b[1]["heart_rate_bpm"] == 60 and abs(b[0]["start"] - 0.3) < 1e-12


def test_phenotypes_from_packed_signals(spark):
    t = np.arange(2500) / 500
    sig = df(spark, [("r", "c", 500.0, 0.0, np.sin(2 * np.pi * t).tolist())], "recording_id string, channel string, fs_hz double, t0_s double, values array<double>")
    peaks = df(spark, [("r", "c", i) for i in range(250, 2500, 500)], "recording_id string, channel string, r_index int")
    p = beats.beat_phenotypes(sig, peaks)
    s = beats.summary(p).first()
    assert p.count() == 5 and s["heart_rate_bpm_median"] == 60 and s["share_fast"] == 0
    x = np.sin(2 * np.pi * t)
    lo, hi = 650, 850
    d = np.abs(x[lo:hi] - np.median(x[lo:hi]))
    at = np.flatnonzero(d >= 0.5 * d.max())
    got = p.where("r_index = 750").first()
    assert abs(got["qrs_width_proxy_s"] - (at[-1] - at[0]) / 500) < 1e-12 and abs(got["r_amplitude"] - x[748:753].mean()) < 1e-12


def test_units_are_sorted_and_counted(spark):
    rows = df(spark, [("subject-b", 1.0), ("subject-a", 2.0), ("subject-a", float("nan"))], "unit_id string, heart_rate_bpm double")
    a = {r["unit_id"]: r for r in beats.aggregate_by_unit(rows, fields=["heart_rate_bpm"]).collect()}
    assert a["subject-a"]["n_beats"] == 2 and a["subject-a"]["heart_rate_bpm_n"] == 1 and a["subject-a"]["heart_rate_bpm_sd"] is None


# --- matching


def greedy(det, ref, tol):
    i = j = 0
    out = []
    while i < len(det) and j < len(ref):
        if abs(det[i] - ref[j]) <= tol:
            out.append((det[i], ref[j]))
            i, j = i + 1, j + 1
        elif det[i] < ref[j]:
            i += 1
        else:
            j += 1
    return out


def test_match_peaks_fixture(spark):
    m = matching.match_peaks(one(spark, [99, 201, 500]), one(spark, [100, 200, 400]), 1000.0, 5.0).first()
    assert (m["true_positive"], m["false_positive"], m["false_negative"]) == (2, 1, 1)
    assert m["sensitivity"] == m["positive_predictive_value"] == pytest.approx(2 / 3) and m["mean_timing_error_ms"] == 0


def test_match_peaks_random_against_two_pointers(spark):
    rng = np.random.default_rng(1)
    d, r = (np.unique(rng.integers(0, 3000, 200)).tolist() for _ in range(2))
    got = matching.pair_matches(one(spark, d), one(spark, r), 1000.0, 7.0).first()["pairs"]
    assert [(p["d"], p["r"]) for p in got] == greedy(d, r, 7)


def test_match_peaks_one_side_empty(spark):
    m = matching.match_peaks(one(spark, []), one(spark, [5]), 1000.0).first()
    assert m["false_negative"] == 1 and m["f1"] == 0 and m["mean_timing_error_ms"] is None


def test_labels_have_no_second_choice(spark):
    c, r = one(spark, [100, 200, 300]), one(spark, [102, 300])
    rows = candidates.label_candidates(c, r, 1000.0, 0.005, at="sample_index").orderBy("sample_index").collect()
    assert [x["label"] for x in rows] == [1, 0, 1]


def test_labels_random_against_loop(spark):
    rng = np.random.default_rng(3)
    c, r = (np.unique(rng.integers(0, 2000, 150)).tolist() for _ in range(2))
    used, want = set(), []
    for x in c:
        pos = int(np.searchsorted(r, x))
        near = [p for p in (pos, pos - 1) if 0 <= p < len(r)]
        best = min(near, key=lambda p: abs(r[p] - x))
        hit = best not in used and abs(r[best] - x) <= 6
        want.append(int(hit))
        if hit:
            used.add(best)
    got = matching.nearest_labels(one(spark, c), one(spark, r), 6.0, at="sample_index", ref_at="sample_index").orderBy("at").collect()
    assert [x["label"] for x in got] == want


def points(spark, rows):
    return df(spark, [("r", i, t, label, ch, "point") for i, (t, label, ch) in enumerate(rows)], "recording_id string, seq long, time double, label string, channel string, type string")


def test_point_agreement(spark):
    a = points(spark, [(1.0, "R", "I")])
    same = matching.point_agreement(a, points(spark, [(1.02, "R", "I")])).first()
    assert same["matches"] == 1 and same["mean_absolute_error_s"] == pytest.approx(0.02)
    assert matching.point_agreement(a, points(spark, [(1.02, "R", "II")])).first()["matches"] == 0


def test_point_agreement_random_against_loop(spark):
    rng = np.random.default_rng(5)
    left, right = ([(float(t), "R", "I") for t in np.round(rng.uniform(0, 3, 40), 3)] for _ in range(2))
    free, errors = dict(enumerate(right)), []
    for t, *_ in left:
        near = [(abs(x[0] - t), i) for i, x in free.items() if abs(x[0] - t) <= 0.04]
        if near:
            e, i = min(near)
            errors.append(e)
            del free[i]
    got = matching.point_agreement(points(spark, left), points(spark, right)).first()
    assert got["matches"] == len(errors) and got["mean_absolute_error_s"] == pytest.approx(np.mean(errors))


def test_exclusion_and_iou(spark):
    rows = df(spark, [("r", 0.0), ("r", 1.0), ("r", 1.085), ("r", -1.0)], "recording_id string, time_s double")
    kept = matching.exclude_near(rows, df(spark, [("r", 1.01)], "recording_id string, time_s double"), 0.08)
    assert sorted(r["time_s"] for r in kept.collect()) == [-1.0, 0.0]
    spans = lambda rs: df(spark, [("r", i, float(a), float(b)) for i, (a, b) in enumerate(rs)], "recording_id string, id int, start double, end double")
    out = matching.overlapping(spans([(1, 2), (0, 30)]), spans([(1.5, 2.5), (40, 50)]), 4.0).collect()
    assert {(r["a_id"], r["b_id"]): round(r["iou"], 6) for r in out} == {(0, 0): round(1 / 3, 6), (1, 0): round(1 / 30, 6)}


# --- statistics


def test_compare_groups_values(spark):
    rows = [("a", None, v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", None, v) for v in (5.0, 6.0, 7.0, 8.0)]
    r = stats.compare_groups(df(spark, rows, "grp string, unit_id string, value double"), "a", "b", unit=None).first()
    assert r["pseudoreplication_warning"] and r["mann_whitney_u"] == 0 and r["mann_whitney_p"] == pytest.approx(2 / 70)
    assert r["welch_t"] == pytest.approx(-4.381780460041329) and r["welch_df"] == pytest.approx(6) and r["welch_p"] == pytest.approx(0.00465, abs=2e-5)


def test_compare_groups_by_unit(spark):
    rows = [("a", "u", 1.0), ("a", "u", 2.0), ("a", "v", 10.0), ("a", "v", 11.0), ("b", "w", 5.0), ("b", "w", 6.0), ("b", "x", 14.0), ("b", "x", 15.0)]
    r = stats.compare_groups(df(spark, rows, "grp string, unit_id string, value double"), "a", "b").first()
    assert r["n_a"] == 2 and r["mean_a"] == 6 and not r["pseudoreplication_warning"] and r["n_observations_a"] == 4
    flat = df(spark, [("a", "u", 1.0), ("a", "v", 1.0), ("b", "w", 1.0), ("b", "x", 1.0)], "grp string, unit_id string, value double")
    assert stats.compare_groups(flat, "a", "b").first()["cohens_d"] is None
    with pytest.raises(ValueError):
        stats.compare_groups(flat.where("unit_id <> 'x'"), "a", "b")


def test_false_discovery(spark):
    p = lambda ps: df(spark, list(enumerate(ps)), "test_id long, p_value double")
    got = [r["p_adjusted"] for r in stats.benjamini_hochberg(p([0.01, 0.04, 0.2])).orderBy("test_id").collect()]
    assert got == pytest.approx([0.03, 0.06, 0.2])
    with pytest.raises(ValueError):
        stats.benjamini_hochberg(p([1.5]))


def test_mean_interval_and_bootstrap(spark):
    v = df(spark, [("a", 0.9), ("b", 0.8), ("c", 0.85)], "recording_id string, value double")
    r = stats.mean_interval(v).first()
    assert r["ci_low"] == pytest.approx(0.85 - 4.302652729911275 * 0.05 / math.sqrt(3))
    b = stats.record_bootstrap(v, "value", n_bootstrap=500, method="matrix").first()
    x = np.array([0.9, 0.8, 0.85])
    boot = x[np.random.default_rng(42).integers(0, 3, size=(500, 3))].mean(axis=1)
    assert (b["ci95_low"], b["ci95_high"]) == pytest.approx(tuple(np.percentile(boot, [2.5, 97.5])))
    assert stats.mean_interval(v.limit(1)).first()["sd"] is None


def test_scores(spark):
    p = df(spark, [(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 0, 0.1)], "label int, prediction int, score double")
    s = stats.classification_scores(p).first()
    assert s["accuracy"] == 0.75 and s["balanced_accuracy"] == 0.75 and s["macro_f1"] == pytest.approx((2 / 3 + 0.8) / 2)
    assert stats.roc_auc(p).first()[0] == pytest.approx(0.875) and stats.roc_auc(p.where("label = 1")).first()[0] is None


def test_threshold(spark):
    y, p = [1, 1, 1, 1, 0, 0, 0, 0], [0.99, 0.8, 0.7, 0.6, 0.95, 0.3, 0.2, 0.1]
    rows = df(spark, list(zip(y, p)), "label int, probability double")
    assert candidates.threshold_for_recall(rows, 0.75).first()["threshold"] == 0.7


# --- detection and learning


def packed(spark, x, fs=360.0):
    return df(spark, [("r", "c", float(fs), 0.0, list(map(float, x)))], "recording_id string, channel string, fs_hz double, t0_s double, values array<double>")


def test_detection_reports_bad_signals(spark):
    x = np.zeros(2000)
    x[[250, 750, 1250, 1750]] = 5
    assert [r["r_index"] for r in detection.detect_peaks(packed(spark, x, 500)).orderBy("r_index").collect()] == [250, 750, 1250, 1750]
    bad = detection.detect_peaks(packed(spark, [1.0, float("nan")] * 10)).first()
    assert "finite" in bad["error"] and bad["r_index"] is None


def test_filter_operator_leaves_input(spark):
    t = np.arange(1000) / 500
    x = np.sin(2 * np.pi * t) + 0.1 * np.sin(2 * np.pi * 80 * t)
    s = packed(spark, x, 500)
    out = detection.filter_signals(s, lowpass_hz=40.0).first()["filtered"]
    assert not np.allclose(out, x) and np.allclose(s.first()["values"], x)
    assert "outside" in detection.filter_signals(s, lowpass_hz=300.0).first()["error"]
    with pytest.raises(ValueError):
        detection.filter_signals(s, highpass_hz=40.0, lowpass_hz=10.0)


def test_hybrid_keeps_confident_polarity(spark):
    s = packed(spark, np.sin(2 * np.pi * np.arange(3600) / 360))
    assert detection.hybrid_polarity(s, 0.0).first()["fallback_used"] is True
    assert detection.hybrid_polarity(s, 1.0).first()["fallback_used"] is False


def test_user_detector_is_checked(spark):
    detection.register_detector("good", lambda x, fs: [1, 5])
    detection.register_detector("bad", lambda x, fs: [5, 5])
    s = packed(spark, np.zeros(20))
    assert detection.run_detector(s, "good").count() == 2
    assert detection.run_detector(s, "bad").first()["error"]


def test_suppressor_and_folds(spark):
    rng = np.random.default_rng(0)
    rows = [("r%d" % (i % 4), i % 2, (rng.normal(2 if i % 2 else -2, 0.2, 8)).tolist()) for i in range(80)]
    data = df(spark, rows, "recording_id string, label int, features array<double>")
    model, meta = learning.fit_suppressor(data, trees=5)
    out = learning.filter_candidates(model, data, 0.5)
    assert out.count() == 80 and out.where("retained").count() == 40 and meta["calibration_candidates"] > 0
    with pytest.raises(ValueError):
        learning.fit_suppressor(data.where("label = 1"))
    split = learning.calibration_split(data)
    fit, cal = (set(r[0] for r in split.where(F.col("part") == p).collect()) for p in ("fit", "calibration"))
    assert fit and cal and not fit & cal
    with pytest.raises(ValueError):
        learning.calibration_split(data.where("recording_id IN ('r0', 'r1')"))


def test_group_folds_never_split_a_group(spark):
    rows = [(f"g{g}", str(i % 2)) for g in range(6) for i in range(4)]
    folds = learning.group_folds(df(spark, rows, "group_id string, label string"), 3)
    assert folds.count() == 6 and folds.select("fold").distinct().count() == 3
    with pytest.raises(ValueError):
        learning.group_folds(df(spark, rows[:4], "group_id string, label string"), 3)


def test_active_learning(spark):
    x = np.sin(2 * np.pi * 2 * np.arange(2600) / 500)
    s = packed(spark, x, 500)
    at = list(range(250, 2500, 250))
    b = df(spark, [("r", "c", i, i / 500) for i in at], "recording_id string, channel string, r_index long, time_s double")
    notes = df(spark, [("r", "point", "accepted", i / 500, label) for i, label in zip(at[:4], "NVNV")], "recording_id string, type string, status string, time double, label string")
    f = learning.beat_features(s, b)
    train = learning.training_set(f, b, notes)
    assert train.count() == 4
    model = learning.train(train, learning.forest(5, 3))
    said = learning.predict(model, f.drop("error").join(b.select("recording_id", "r_index", "time_s"), ["recording_id", "r_index"]))
    top = [r["time_s"] for r in learning.rank_uncertain(said, 3, notes, train).collect()]
    assert 0 < len(top) <= 3 and all(abs(a - i / 500) > 0.08 for a in top for i in at[:4]) and all(abs(a - c) >= 0.25 for a in top for c in top if a != c)


# --- annotations and provenance


def test_annotation_life_cycle(spark):
    store = ann.add(ann.empty(spark), ann.rows(spark, [{"label": "QRS", "type": "interval", "channel": "I", "start": 0.5, "end": 0.6, "id": "a"}, {"label": "R", "type": "point", "channel": "I", "time": 1.0, "id": "b", "status": "accepted"}]))
    store = ann.duplicate(ann.update(store, "a", {"notes": "x"}), "b", "c")
    assert store.where("id = 'c'").first()["status"] == "unreviewed" and ann.delete(store, "a").count() == 2
    assert {r["status"]: r["n"] for r in ann.status_counts(store).collect()} == {"unreviewed": 2, "accepted": 1}
    again = ann.from_document(spark, ann.to_document(store, "f.csv"))
    assert sorted(r["id"] for r in again.collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        ann.add(store, store.where("id = 'a'"))
    with pytest.raises(ValueError):
        ann.update(store, "a", {"end": 0.5})
    with pytest.raises(KeyError):
        ann.update(store, "zz", {})
    with pytest.raises(ValueError):
        ann.from_document(spark, "{")
    assert len(ann.rows(spark, [{"label": "R", "type": "point", "channel": "I", "time": 1.0}]).first()["id"]) == 10


def manifest(**more):
    base = {"dataset_id": "d", "dataset_version": "1", "source": "s", "records": ["a", "b", "c"], "software_version": "1", "software_commit": "x", "record_subject_map": {"a": "s1", "b": "s1", "c": "s2"}, "input_files": {"a.dat": "0" * 64}, "split_manifest": {"train": ["a", "b"], "test": ["c"]}}
    return provenance.Manifest(**(base | more))


def test_manifest_hash_and_faults():
    m = manifest()
    assert provenance.Manifest.from_dict(m.to_dict()).sha256() == m.sha256() == manifest(generated_at_utc="2020-01-01T00:00:00Z").sha256()
    for bad in ({"records": ["a", "a"]}, {"input_files": {"a": "0" * 63}}, {"split_manifest": {"x": ["a", "b", "c"], "y": ["c"]}}, {"calibration_records": ["z"]}, {"record_subject_map": {"a": "s"}}, {"generated_at_utc": "now"}):
        with pytest.raises(ValueError):
            manifest(**bad).validate()


def test_report(spark, tmp_path):
    m = matching.match_peaks(df(spark, [("a", 1), ("b", 2)], "recording_id string, sample_index long"), df(spark, [("a", 1), ("b", 2)], "recording_id string, sample_index long"), 100.0)
    r = provenance.validation_report(manifest(), m, "adaptive", {"p": 1}, 75.0, n_bootstrap=100)
    assert r["failures"] == ["c"] and r["summary"]["pooled"]["f1"] == 1.0 and r["summary"]["macro_record"]["f1"]["n"] == 2
    path = provenance.write_report(r, str(tmp_path / "x" / "r.json"))
    assert open(path).read() == open(provenance.write_report(r, path)).read()
    with pytest.raises(ValueError):
        provenance.validation_report(manifest(records=["a"], record_subject_map={}, split_manifest={}), m, "d", {}, 75.0)


def test_upsert_replaces(spark):
    t = df(spark, [("p", "r", 1), ("p", "s", 2)], "project_id string, recording_id string, v int")
    out = provenance.upsert(t, df(spark, [("p", "r", 9)], "project_id string, recording_id string, v int"))
    assert sorted(r["v"] for r in out.collect()) == [2, 9]


def test_bootstrap_replays_its_tree(spark):
    """The interval is that of all blocks replayed in one process; every replicate has all its draws."""
    v = np.random.default_rng(2).normal(10, 3, size=700)
    rows = df(spark, [(f"r{i}", float(x)) for i, x in enumerate(v)], "recording_id string, value double")
    b = stats.record_bootstrap(rows, "value", n_bootstrap=300, block_records=100).first()
    dealt = {}
    for r in rows.select("recording_id", "value", F.pmod(F.xxhash64("recording_id"), F.lit(7)).alias("b")).collect():
        dealt.setdefault(r["b"], []).append((r["recording_id"], r["value"]))
    sizes = [len(dealt.get(k, [])) for k in range(7)]
    draws = [stats.block_draws(sizes, k, 300, 42) for k in range(7)]
    assert (np.sum(draws, axis=0) == 700).all() and all((d >= 0).all() for d in draws)
    means = np.sum([stats.block_sums(np.array([x for _, x in sorted(dealt[k])]), k, draws[k], 42) for k in range(7)], axis=0) / 700
    assert (b["ci95_low"], b["ci95_high"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5]))) and b["mean"] == pytest.approx(v.mean())
    again = stats.record_bootstrap(rows.repartition(5), "value", n_bootstrap=300, block_records=100).first()
    assert (again["ci95_low"], again["ci95_high"]) == (b["ci95_low"], b["ci95_high"])


def test_bootstraps_agree(spark):
    """Tree and index matrix give the same interval but for chance, whatever the blocks are."""
    v = np.random.default_rng(2).normal(10, 3, size=3000)
    rows = df(spark, [(f"r{i}", float(x)) for i, x in enumerate(v)], "recording_id string, value double")
    a, b, c = (stats.record_bootstrap(rows, "value", **k).first() for k in ({"method": "matrix"}, {}, {"block_records": 10_000}))
    width = a["ci95_high"] - a["ci95_low"]
    for x in (b, c):
        assert x["n_records"] == 3000 and abs(a["ci95_low"] - x["ci95_low"]) < 0.15 * width and abs(a["ci95_high"] - x["ci95_high"]) < 0.15 * width
    with pytest.raises(ValueError):
        stats.record_bootstrap(rows.withColumn("value", F.when(F.col("recording_id") == "r1", None).otherwise(F.col("value"))), "value")
    with pytest.raises(ValueError):
        stats.record_bootstrap(rows, "value", method="jackknife")


def test_block_numbers_are_multinomial():
    """Means, variances and the covariance of the blocks' draws are those of one multinomial."""
    sizes = [5, 0, 20, 75]
    d = np.array([stats.block_draws(sizes, k, 40_000, 7) for k in range(4)], dtype=float)
    p = np.array(sizes) / 100
    assert np.allclose(d.mean(axis=1), 100 * p, atol=0.15) and np.allclose(np.cov(d), 100 * (np.diag(p) - np.outer(p, p)), atol=0.6)


def test_spaced_selection_equals_taking_the_best_first(spark):
    """Ties of score and time, null keys, any stretch of the line, with and without a spacing."""
    rng = np.random.default_rng(15)
    rows = [(str(rng.choice(["a", "b"])) if rng.random() < 0.9 else None, float(np.round(rng.uniform(0, 40), 1)), float(rng.integers(0, 5)), i) for i in range(300)]
    table = df(spark, rows, "recording_id string, time_s double, uncertainty double, r_index long")
    for spacing, limit in ((0.5, 1000), (2.0, 6), (0.0, 7), (50.0, 3), (1.0, 0)):
        want = set()
        for key in ("a", "b", None):
            taken = []
            for r in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1], r[3])):
                if len(taken) < limit and not (spacing and any(abs(r[1] - t[1]) < spacing for t in taken)):
                    taken.append(r)
            want |= set(taken)
        got = {tuple(r) for r in learning.spaced(table, spacing, limit, ["recording_id"]).collect()}
        assert got == want
    best = sorted(rows, key=lambda r: (-r[2], r[1]))[0]
    assert learning.spaced(table, 1000.0, 5).first()["time_s"] == best[1]


def test_auc_of_several_classes(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, size=200)
    p = rng.random((200, 3)) + np.eye(3)[y] * 0.4
    p = np.round(p / p.sum(axis=1, keepdims=True), 2)
    pairs = lambda c: np.mean([(a > b) + 0.5 * (a == b) for a in p[y == c, c] for b in p[y != c, c]])
    scored = df(spark, [("abc"[k], q.tolist()) for k, q in zip(y, p)], "label string, probabilities array<double>")
    assert stats.one_vs_rest_auc(scored, ["a", "b", "c"]).first()[0] == pytest.approx(np.mean([pairs(c) for c in range(3)]))
    assert stats.one_vs_rest_auc(scored.where("label <> 'b'"), ["a", "b", "c"]).first()[0] is None


def test_running_sums_over_several_ranges(spark):
    from cardiolake.functions.prefix import running

    v = np.random.default_rng(5).permutation(500)
    rows = df(spark, [(float(x), int(x) % 7 - 3) for x in v], "k double, v long")
    for ranges in (1, 9):
        for down in (False, True):
            got = {r["k"]: (r["s"], r["m"]) for r in running(running(rows, "k", "v", "s", descending=down, ranges=ranges), "k", "v", "m", "min", down, ranges).collect()}
            at, s, m = sorted(range(500), reverse=down), 0, 99
            for k in at:
                s, m = s + k % 7 - 3, min(m, k % 7 - 3)
                assert got[float(k)] == (s, m)


def test_running_counts_of_any_key(spark, monkeypatch):
    """Ranges follow the keys, which may be strings or structs, and have nulls; splits do not hang on the ranges."""
    from cardiolake.functions import prefix

    names = [None] + [f"{i * 7919 % 1000:03d}" for i in range(300)]
    rows = df(spark, [(k, 1) for k in names], "k string, v long")
    records = df(spark, [(f"r{i % 90}", float(i % 90 % 7 == 0 or i % 5 == 0)) for i in range(900)], "recording_id string, label double")
    whole = sorted(map(tuple, learning.calibration_split(records).collect()))
    monkeypatch.setattr(prefix, "RANGE_ROWS", 20)
    assert sorted(map(tuple, learning.calibration_split(records).collect())) == whole
    assert {r[2] for r in whole} == {"calibration", "fit"} and len(whole) == 90
    for down in (False, True):
        got = {r["k"]: r["s"] for r in prefix.running(rows, "k", "v", "s", descending=down).collect()}
        order = sorted((k for k in names if k is not None), reverse=down)
        order = [*order, None] if down else [None, *order]
        assert got == {k: i + 1 for i, k in enumerate(order)}
    pair = rows.where("k IS NOT NULL").select(F.struct(F.substring("k", 3, 1).alias("a"), "k").alias("p"), "v")
    got = [r["s"] for r in prefix.running(pair, "p", "v", "s").orderBy("p").collect()]
    assert got == list(range(1, 301))


def test_point_agreement_equals_brute_force(spark):
    """Ties, equal times and used points: each left point takes the nearest unused one, the earlier listed of equals."""
    rng = np.random.default_rng(6)
    for tol in (1.0, 5.0):
        left, right = rng.integers(0, 30, size=25).astype(float), rng.integers(0, 30, size=20).astype(float)
        row = lambda side: df(spark, [("r", "x", "c", "point", float(t), i) for i, t in enumerate(side)], "recording_id string, label string, channel string, type string, time double, seq long")
        used, errors = set(), []
        for t in left:
            free = [(abs(u - t), i) for i, u in enumerate(right) if i not in used and abs(u - t) <= tol]
            if free:
                used.add(min(free)[1])
                errors.append(min(free)[0])
        got = matching.point_agreement(row(left), row(right), tol).first()
        assert got["matches"] == len(errors) and got["mean_absolute_error_s"] == pytest.approx(np.mean(errors))


def test_parts_of_one_recording_match_apart(spark, monkeypatch):
    """Parts over buckets of any width give the pairs of the two pointers over the whole list."""
    rng = np.random.default_rng(12)
    for width, n, span in ((1, 300, 3000), (3, 300, 9000), (65_536, 300, 3000), (2, 400, 1500)):
        monkeypatch.setattr(matching, "_BUCKET", width)
        d, r = (np.unique(rng.integers(0, span, n)).tolist() for _ in range(2))
        parts = matching.matched_parts(one(spark, d), one(spark, r), 1000.0, 7.0)
        rows = parts.orderBy("part").collect()
        assert [(p["d"], p["r"]) for x in rows for p in x["pairs"]] == greedy(d, r, 7)
        merged = sorted([*d, *r])
        assert len(rows) == 1 + sum(b - a > 7 for a, b in zip(merged, merged[1:]))
        whole = matching.pair_matches(one(spark, d), one(spark, r), 1000.0, 7.0).first()
        assert (whole["detected"], whole["reference"], [(p["d"], p["r"]) for p in whole["pairs"]]) == (d, r, greedy(d, r, 7))


def test_no_task_sorts_a_whole_recording(spark):
    """Windows over events are partitioned by recording and bucket; those over whole recordings see buckets."""
    parts = matching.time_parts(one(spark, [1, 2, 900]), ["recording_id"], "sample_index", F.lit(3.0), 10.0)
    assert [(r["sample_index"], r["part"]) for r in parts.orderBy("sample_index").collect()] == [(1, 1), (2, 1), (900, 900)]
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*\], \[([^\]]*)\], \[([^\]]*)\]", plan)  # what they are partitioned and ordered by
    assert len(windows) >= 3 and all("__b" in part or order.startswith("__b") for part, order in windows)


def test_point_agreement_over_parts(spark, monkeypatch):
    """Equal to the rule over the whole list, for several labels and any bucket width; points without a time only count."""
    rng = np.random.default_rng(13)
    monkeypatch.setattr(matching, "_BUCKET", 3)
    left, right = ([(float(t), str(rng.choice(["R", "T"])), "I") for t in np.round(rng.uniform(0, 20, 200), 3)] for _ in range(2))
    free, errors = dict(enumerate(right)), []
    for t, label, _ in left:
        near = [(abs(x[0] - t), i) for i, x in free.items() if x[1] == label and abs(x[0] - t) <= 0.04]
        if near:
            errors.append(min(near)[0])
            del free[min(near)[1]]
    got = matching.point_agreement(points(spark, [*left, (None, "R", "I")]), points(spark, right)).first()
    assert got["matches"] == len(errors) and got["mean_absolute_error_s"] == pytest.approx(np.mean(errors)) and got["agreement_rate"] == len(errors) / 201
    none = matching.point_agreement(points(spark, [(1.0, "R", "I")]), points(spark, [(1.0, "T", "I")])).first()
    assert (none["matches"], none["agreement_rate"], none["mean_absolute_error_s"]) == (0, 0.0, None)


def test_stratified_holdout_takes_a_share_of_each_class(spark):
    """By the smallest hashes of each class: what a rank over the whole class would take."""
    rng = np.random.default_rng(3)
    rows = [(int(i % 5 == 0), [float(v) for v in rng.normal(size=2)]) for i in range(400)]
    data = df(spark, rows, "label int, features array<double>")
    held = learning.stratified_holdout(data, 0.2, 7)
    number = F.shiftrightunsigned(F.xxhash64(F.to_json(F.struct("features")), F.lit(7)), 11)
    for label, n in ((0, 320), (1, 80)):
        own = sorted((r["h"], r["__held"]) for r in held.where(F.col("label") == label).select(number.alias("h"), "__held").collect())
        take = math.ceil(0.2 * (n - 1))
        assert [x for _, x in own] == [True] * take + [False] * (n - take)
    assert "Window" not in held._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_folds_deal_profiles(spark):
    """Groups of equal counts are one profile; folds stay even, whole, and the same in any plan."""
    rows = [(f"g{i}", str(k)) for i in range(90) for k in [i % 3] * (1 + i % 2) + ["x"]] + [("big", "x")] * 50
    data = df(spark, rows, "group_id string, label string")
    folds = learning.group_folds(data, 4)
    got = {r["group_id"]: r["fold"] for r in folds.collect()}
    assert len(got) == 91 and set(got.values()) == {0, 1, 2, 3}
    assert got == {r["group_id"]: r["fold"] for r in learning.group_folds(data.repartition(7), 4).collect()}
    for c in "012":
        per = [sum(1 for g, label in rows if label == c and got[g] == f) for f in range(4)]
        assert max(per) - min(per) <= 3
    others = learning.group_folds(data, 4, seed=1).collect()
    assert {r["group_id"]: r["fold"] for r in others} != got


def test_two_writers_lose_nothing(spark, tmp_path):
    """A change that was prepared on an old version is applied again to the one that came between."""
    from cardiolake.operators.projects import ProjectStore

    store = ProjectStore(spark, f"file://{tmp_path}")
    row = lambda i, g: spark.range(1).select(F.lit(i).alias("recording_id"), F.lit(g).alias("group"))
    empty = store.load("p", 0)
    full = lambda i, g: empty.join(row(i, g), "recording_id", "right").select(*[F.lit("p").alias(c) if c == "project_id" else F.lit(g).alias(c) if c == "group" else empty[c] if c != "recording_id" else F.col("recording_id") for c in empty.columns])
    store.add("p", full("a", "one"))
    seen = []

    def slow(now):
        if not seen:  # another writer commits while this one prepares
            ProjectStore(spark, f"file://{tmp_path}").add("p", full("b", "two"))
        seen.append(now.count())
        return provenance.upsert(now, full("c", "three").select(*now.columns))

    assert store.change("p", slow) == 3 and seen == [1, 2]
    assert sorted(r["recording_id"] for r in store.load("p").collect()) == ["a", "b", "c"] and store.versions("p") == [1, 2, 3]
    assert store.load("p", 1).count() == 1 and len(list((tmp_path / "p" / "data").iterdir())) == 3
    assert not store._commit("p", 2, "late") and store.load("p", 2).count() == 2


def test_plain_values_and_documents(spark):
    from types import MappingProxyType

    assert provenance.plain({"b": {3, 1, 2}, 1: (1, None), "a": MappingProxyType({"z": 1.5, "y": True})}) == {"1": [1, None], "a": {"y": True, "z": 1.5}, "b": [1, 2, 3]}
    assert list(provenance.plain({"b": 1, "a": 2})) == ["a", "b"]
    import json

    told = json.loads(ann.to_document(ann.empty(spark), "f", {"who": "x"}, (1.0, 2.0)))
    assert told["annotations"] == [] and told["metadata"] == {"time_start_s": 1.0, "time_end_s": 2.0, "who": "x"} and told["file"] == "f"
