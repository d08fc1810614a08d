import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardiolake.functions import distributions as d
from cardiolake.functions import kernels as k
from cardiolake.operators import detection as det
from cardiolake.operators.candidates import FEATURE_NAMES, features_of


def response(sections, fs, freqs):
    z = np.exp(-2j * np.pi * np.asarray(freqs) / fs)
    h = 1
    for r in sections:
        h = h * (r[0] + r[1] * z + r[2] * z * z) / (r[3] + r[4] * z + r[5] * z * z)
    return np.abs(h)


def test_butterworth_cutoffs_are_half_power():
    assert np.allclose(response(k.butterworth(4, "lowpass", 500, 40), 500, [0, 40, 250]), [1, 2**-0.5, 0], atol=1e-9)
    assert np.allclose(response(k.butterworth(4, "highpass", 500, 0.5), 500, [0, 0.5, 250]), [0, 2**-0.5, 1], atol=1e-6)
    assert np.allclose(response(k.butterworth(3, "bandpass", 360, 5, 20), 360, [0, 5, 20, 180]), [0, 2**-0.5, 2**-0.5, 0], atol=1e-6)
    assert np.allclose(response(k.notch(50, 30, 500), 500, [0, 50, 250]), [1, 0, 1], atol=1e-6)


def test_zero_phase_keeps_time_and_reverses_alike():
    t = np.arange(1000) / 500
    x = np.sin(2 * np.pi * t) + 0.1 * np.sin(2 * np.pi * 80 * t)
    s = k.butterworth(4, "lowpass", 500, 40)
    y = k.zero_phase(s, x, 15)
    assert np.abs(y - np.sin(2 * np.pi * t))[100:-100].max() < 0.01
    assert np.allclose(k.zero_phase(s, np.full(50, 3.0), 15), 3.0)
    with pytest.raises(ValueError):
        k.zero_phase(s, x[:15], 15)


def test_peaks_of_the_spike_train():
    x = np.zeros(2000)
    x[[250, 750, 1250, 1750]] = 5
    assert det.peaks_of(x, 500)[0].tolist() == [250, 750, 1250, 1750]
    assert len(det.peaks_of(np.zeros(100), 500)[0]) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=3, max_size=60))
def test_prominence_by_definition(values):
    x = np.asarray(values, dtype=float)
    peaks = k.local_maxima(x)
    for i, got in zip(peaks, k.prominences(x, peaks)):
        left = right = i
        while left > 0 and x[left - 1] <= x[i]:
            left -= 1
        while right < len(x) - 1 and x[right + 1] <= x[i]:
            right += 1
        assert got == x[i] - max(x[left : i + 1].min(), x[i : right + 1].min())


def pulses(sign=1, fs=360, n=7200):
    t = np.arange(n) / fs
    x = 0.02 * np.sin(2 * np.pi * t)
    for p in range(900, 6301, 900):
        x[p - 4 : p + 5] += sign * 2 * np.hanning(9)
    return x


@pytest.mark.parametrize("polarity,sign", [("positive", 1), ("negative", -1), ("adaptive", 1), ("adaptive", -1)])
def test_pulse_trains_are_found(polarity, sign):
    assert len(det.peaks_of(pulses(sign), 360, polarity)[0]) >= 7


def test_recovery_fills_one_long_gap():
    primary = [p for p in range(900, 6301, 900) if p != 2700]
    found, _ = det.recovered_of(pulses(), 360, primary, gap_ratio=1.5)
    assert len(found) <= 1 and all(1800 < f < 3600 for f in found)
    with pytest.raises(ValueError):
        det.recovered_of(pulses(), 360, [5, 3])


def test_vote_is_deterministic_and_sees_events():
    fs, t = 360, np.arange(3600) / 360
    x = 0.02 * np.sin(2 * np.pi * 1.1 * t)
    for s in np.arange(0.5, 9.6, 0.9):
        i = int(s * fs)
        x[i : i + 5] += [0.8, 1.5, 2.2, 1.4, 0.7]
    a = det.vote_of(x, fs)
    assert a == det.vote_of(x, fs) and a["qrs_events"] > 0
    assert det.vote_of(-x, fs)["polarity"] == "negative"


def test_boundaries_enclose_the_centre():
    t = np.arange(500) / 250
    x = 0.02 * np.sin(2 * np.pi * t)
    x[246:255] += np.array([0, -0.1, 0.2, 0.9, 1.5, 0.8, -0.3, -0.1, 0])
    (b,) = det.boundaries_of(x, 250, [250])
    assert b["onset"] <= 250 <= b["offset"] and b["onset"] < b["offset"]
    with pytest.raises(ValueError):
        det.boundaries_of(x, 250, [500])


def test_candidate_features_are_finite():
    t = np.arange(4000) / 360
    x = np.sin(2 * np.pi * 1.2 * t) + 0.15 * np.sin(2 * np.pi * 12 * t)
    f = features_of(x, 360, [500, 1000, 1500])
    assert f.shape == (3, len(FEATURE_NAMES)) == (3, 81) and np.isfinite(f).all()
    with pytest.raises(ValueError):
        features_of(x, 360, [4000])


def test_distributions_in_closed_form():
    for t in (0.3, 1.0, 4.2):
        assert abs(d.t_two_sided(t, 1) - (1 - 2 / np.pi * np.arctan(t))) < 1e-12
        assert abs(d.t_two_sided(t, 2) - (1 - t / np.sqrt(2 + t * t))) < 1e-12
    assert abs(d.t_quantile(0.975, 10) - 2.2281388519649) < 1e-9
    from itertools import combinations

    n, m = 4, 5
    us = [sum(r) - n * (n + 1) / 2 for r in combinations(range(1, n + m + 1), n)]
    for u in (0.0, 3.0, 8.0, 10.0):
        high = max(u, n * m - u)
        assert abs(d.mann_whitney_p(u, n, m) - min(1, 2 * np.mean([x >= high for x in us]))) < 1e-12


def test_periodogram_power_is_the_variance():
    x = np.random.default_rng(0).normal(size=256)
    f, p = k.periodogram(x, 100.0)
    assert abs(p.sum() * (f[1] - f[0]) - x.var()) < 1e-9


def by_samples(sections, x, steady):
    """A cascade sample by sample, from the state a constant past leaves."""
    level = x[0] if steady else 0.0
    for b0, b1, b2, _, a1, a2 in np.asarray(sections).tolist():
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        s1, s2 = (gain - b0) * level, (b2 - a2 * gain) * level
        level, out = level * gain, []
        for v in x.tolist():
            y = b0 * v + s1
            s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
            out.append(y)
        x = np.array(out)
    return x


def test_convolution_equals_recursion():
    rng = np.random.default_rng(3)
    designs = [k.butterworth(4, "highpass", 360, 0.5), k.butterworth(4, "lowpass", 360, 40.0), k.butterworth(3, "bandpass", 360, 5.0, 20.0), k.notch(50.0, 30.0, 360), k.butterworth(3, "bandpass", 64, 0.5, 5.0)]
    for n in (1, 2, 64, 1000, 20_000):
        x = rng.normal(size=n).cumsum() + 5
        for d in designs:
            for steady in (False, True):
                assert np.abs(k.cascade(d, x, steady) - by_samples(d, x, steady)).max() <= 1e-10 * max(1.0, np.abs(x).max())
