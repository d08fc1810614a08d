"""Queries of the signal kernels and their SQL forms.

The SQL works on lists with folds, from the public definitions and not from the
kernels: peaks by greedy thinning and prominence, filters as sample-by-sample
recursions forward and backward over the oddly extended signal, spectra as plain sums.
Only the coefficients of the band-pass designs are taken from the engine (fixed values;
the tests hold them against their frequency response); those of the other filters are
computed here from the textbook formulas of second-order sections.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .. import api
from ..functions import kernels as K
from ..functions import quantiles
from ..functions.columns import robust_scale_of, z_scores
from ..operators import beats, candidates, chunked, detection, learning
from .base import _SQL, long_signals, query, r6, signals, table

# --- parts of the SQL forms ---------------------------------------------------------------------


def _n(v: float) -> str:
    """A number as a DOUBLE literal."""
    return f"({float(v):.17e})"


SHORT = "src AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"
LONG = "src AS (SELECT vec_id // 10 AS id, flatten(list(list_transform(embedding, lambda v: CAST(v AS DOUBLE)) ORDER BY vec_id)) AS x FROM embeddings GROUP BY 1)"
CENTRED = """med AS (SELECT id, x, list_aggregate(x, 'median') AS m, list_aggregate(x, 'stddev_pop') AS sd FROM src),
zs AS (SELECT id, x, sd, list_transform(x, lambda v: v - m) AS z, list_transform(x, lambda v: m - v) AS nz FROM med)"""


def _peaks(name: str, source: str, y: str, least: str, distance: int) -> str:
    """CTEs up to ``name`` (id, i, prom): strict maxima of list ``y`` of ``source`` (id, y, sd),
    the higher ones first with none closer than ``distance``, of prominence ``least`` or more."""
    return f"""{name}_m AS (SELECT id, sd, {y} AS y, list_filter(range(1, len({y}) - 1), lambda i: {y}[i + 1] > {y}[i] AND {y}[i + 1] > {y}[i + 2]) AS m FROM {source}),
{name}_k AS (SELECT id, sd, y, list_reduce(list_transform(list_reverse_sort(list_transform(m, lambda i: {{'h': y[i + 1], 'i': i}})), lambda s: [s.i]),
  lambda acc, s: CASE WHEN len(list_filter(acc, lambda q: abs(q - s[1]) < {distance})) > 0 THEN acc ELSE list_concat(acc, s) END, CAST([] AS BIGINT[])) AS k FROM {name}_m),
{name}_u AS (SELECT id, sd, y, unnest(k) AS i FROM {name}_k),
{name}_p AS (SELECT id, sd, i, y[i + 1] - greatest(list_min(y[(coalesce(list_max(list_filter(range(0, i), lambda j: y[j + 1] > y[i + 1])), -1) + 2):(i + 1)]),
  list_min(y[(i + 1):coalesce(list_min(list_filter(range(i + 1, len(y)), lambda j: y[j + 1] > y[i + 1])), len(y))])) AS prom FROM {name}_u),
{name} AS (SELECT id, i, prom FROM {name}_p WHERE prom >= {least})"""


def _zero_phase(name: str, source: str, col: str, sections, pad: int) -> str:
    """CTEs up to ``name`` (id, y): list ``col`` filtered forward and backward, each section
    starting from the state that a constant past leaves."""
    parts = [f"""{name}_e AS (SELECT id, list_concat(list_concat(list_transform(range({pad}, 0, -1), lambda k: 2 * {col}[1] - {col}[k + 1]), {col}),
  list_transform(range(1, {pad + 1}), lambda k: 2 * {col}[len({col})] - {col}[len({col}) - k])) AS y FROM {source})"""]
    last = f"{name}_e"
    for way in "fb":
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
            g = (b0 + b1 + b2) / (1 + a1 + a2)
            y = f"({_n(b0)} * v[1] + a[1])"
            parts.append(f"""{name}_{way}{k} AS (SELECT id, list_reduce(list_transform(y, lambda v: [v]), lambda a, v: list_concat([{_n(b1)} * v[1] - {_n(a1)} * {y} + a[2], {_n(b2)} * v[1] - {_n(a2)} * {y}], list_concat(a[3:], [{y}])),
  [{_n(g - b0)} * y[1], {_n(b2 - a2 * g)} * y[1]])[3:] AS y FROM {last})""")
            last = f"{name}_{way}{k}"
        parts.append(f"{name}_{way} AS (SELECT id, list_reverse(y) AS y FROM {last})")
        last = f"{name}_{way}"
    parts.append(f"{name} AS (SELECT id, y[{pad + 1}:(len(y) - {pad})] AS y FROM {last})")
    return ",\n".join(parts)


def _biquad(kind: str, f: float, fs: float, q: float) -> tuple[float, ...]:
    """Textbook second-order section."""
    if kind == "notch":
        w, alpha = 2 * math.pi * f / fs, math.tan(math.pi * f / fs / q)
        return tuple(v / (1 + alpha) for v in (1, -2 * math.cos(w), 1)) + (1.0, -2 * math.cos(w) / (1 + alpha), (1 - alpha) / (1 + alpha))
    k = math.tan(math.pi * f / fs)
    d = 1 + k / q + k * k
    b = (k * k, 2 * k * k, k * k) if kind == "lowpass" else (1, -2, 1)
    return tuple(v / d for v in b) + (1.0, 2 * (k * k - 1) / d, (1 - k / q + k * k) / d)


def _fourth_order(kind: str, f: float, fs: float) -> list[tuple[float, ...]]:
    return [_biquad(kind, f, fs, 1 / (2 * math.cos(a * math.pi / 8))) for a in (1, 3)]


def _band(name: str, source: str, col: str, low: float, high: float, fs: float = 64.0) -> str:
    sections = K.butterworth(3, "bandpass", fs, low, high)
    return _zero_phase(name, source, col, sections.tolist(), K.smooth_pad(sections))


def _envelope(name: str, source: str, n: int) -> str:
    """CTEs up to ``name`` (id, e): zero-padded moving mean of ``n`` (odd) absolute slopes, 64 Hz."""
    half = n // 2
    return f"""{name}_g AS (SELECT id, list_transform(range(1, len(y) + 1), lambda k: 64 * abs(CASE WHEN k = 1 THEN y[2] - y[1] WHEN k = len(y) THEN y[k] - y[k - 1] ELSE (y[k + 1] - y[k - 1]) / 2 END)) AS g FROM {source}),
{name} AS (SELECT id, list_transform(range(1, len(g) + 1), lambda k: list_sum(g[greatest(1, k - {half}):least(len(g), k + {half})]) / {n}) AS e FROM {name}_g)"""


def _scale(x: str) -> str:
    """SQL of 1.4826 MAD of a list, else its standard deviation, at least 1e-8."""
    mad = f"1.4826 * list_aggregate(list_transform({x}, lambda mv: abs(mv - list_aggregate({x}, 'median'))), 'median')"
    return f"greatest(CASE WHEN {mad} > 1e-8 THEN {mad} ELSE list_aggregate({x}, 'stddev_pop') END, 1e-8)"


COUNTED = f"""{CENTRED}, {_peaks("up", "zs", "z", "0.5 * sd", 16)}, {_peaks("dn", "zs", "nz", "0.5 * sd", 16)},
cu AS (SELECT id, count(*) AS n, median(prom) AS p FROM up GROUP BY id), cd AS (SELECT id, count(*) AS n, median(prom) AS p FROM dn GROUP BY id),
pol AS (SELECT zs.id, coalesce(cu.n, 0) AS n_up, coalesce(cd.n, 0) AS n_dn, coalesce(cu.p / greatest(sd, 1e-8), 0) AS s_up, coalesce(cd.p / greatest(sd, 1e-8), 0) AS s_dn,
  abs(coalesce(cu.n, 0) - coalesce(cd.n, 0)) / greatest(coalesce(cu.n, 0), coalesce(cd.n, 0), 1) AS conf, CASE WHEN cu.n > 0 AND cd.n > 0 AND cd.n / cu.n < 0.7 THEN 'negative' ELSE 'positive' END AS p
  FROM zs LEFT JOIN cu USING (id) LEFT JOIN cd USING (id))"""
POSITIVE = f"{SHORT}, {CENTRED}, {_peaks('up', 'zs', 'z', '0.5 * sd', 16)}"

# --- peaks and polarity ---------------------------------------------------------------------------


@query(f"WITH {POSITIVE} SELECT id AS recording_id, i AS r_index, round(prom, 6) AS prominence FROM up")
def stage1_positive(spark, sf_dir):
    p = detection.detect_peaks(signals(spark, sf_dir), "positive").where("r_index IS NOT NULL")
    return p.select("recording_id", "r_index", r6("prominence").alias("prominence"))


@query(f"WITH {SHORT}, {CENTRED}, {_peaks('dn', 'zs', 'nz', '0.5 * sd', 16)} SELECT id AS recording_id, i AS r_index, round(prom, 6) AS prominence FROM dn")
def stage1_negative(spark, sf_dir):
    p = detection.detect_peaks(signals(spark, sf_dir), "negative").where("r_index IS NOT NULL")
    return p.select("recording_id", "r_index", r6("prominence").alias("prominence"))


@query(f"WITH {SHORT}, {CENTRED}, {_peaks('up', 'zs', 'z', '0.3 * sd', 6)} SELECT id AS recording_id, i AS r_index, round(prom, 6) AS prominence FROM up")
def api_peaks(spark, sf_dir):
    """The service's detector: positive only, distance in ms (100), its own prominence factor."""
    p = api.r_peaks(signals(spark, sf_dir), 100.0, 0.3).where("r_index IS NOT NULL")
    return p.select("recording_id", "r_index", r6("prominence").alias("prominence"))


@query(f"WITH {SHORT}, {COUNTED} SELECT id AS recording_id, p AS polarity, round(conf, 6) AS confidence, round(s_up, 6) AS positive_score, round(s_dn, 6) AS negative_score, CAST(n_up AS INTEGER) AS positive_candidates, CAST(n_dn AS INTEGER) AS negative_candidates FROM pol")
def counted_polarity(spark, sf_dir):
    p = detection.select_polarity(signals(spark, sf_dir))
    return p.select("recording_id", "polarity", *[r6(c).alias(c) for c in ("confidence", "positive_score", "negative_score")], "positive_candidates", "negative_candidates")


_RECOVERED = f"""{SHORT}, {COUNTED}, used AS (SELECT id, sd, CASE WHEN p = 'negative' THEN nz ELSE z END AS y, p FROM zs JOIN pol USING (id)),
{_peaks("first", "used", "y", "0.5 * sd", 16)}, {_peaks("loose", "used", "y", "0.25 * sd", 16)},
gap AS (SELECT id, i AS l, lead(i) OVER (PARTITION BY id ORDER BY i) AS r FROM first), typ AS (SELECT id, median(r - l) AS t FROM gap WHERE r IS NOT NULL GROUP BY id),
wide AS (SELECT id, l, r FROM gap JOIN typ USING (id) WHERE r - l > 1.65 * t),
inside AS (SELECT w.id, loose.i, loose.prom, row_number() OVER (PARTITION BY w.id, w.l ORDER BY loose.prom DESC, loose.i) AS k FROM wide w JOIN loose ON loose.id = w.id AND loose.i > w.l AND loose.i < w.r),
found AS (SELECT id, i, prom, 0 AS kind FROM first UNION ALL SELECT id, i, prom, 1 FROM inside WHERE k = 1)"""


@query(f"WITH {_RECOVERED} SELECT f.id AS recording_id, i AS r_index, round(arg_max(prom, kind), 6) AS prominence, any_value(p) AS polarity FROM found f JOIN pol USING (id) GROUP BY f.id, i")
def detect_peaks(spark, sf_dir):
    """Adaptive polarity with one recovered peak at most in each long gap."""
    p = detection.detect_peaks(signals(spark, sf_dir), "adaptive", recovery=True).where("r_index IS NOT NULL")
    return p.select("recording_id", "r_index", r6("prominence").alias("prominence"), "polarity")


_VOTED = f"""{{COUNTED}}, cen AS (SELECT id, z AS y FROM zs), {_band("band", "cen", "y", 5.0, 20.0)}, {_envelope("env", "band", 3)},
es AS (SELECT id, e, {_scale("e")} AS sd FROM env), {_peaks("ev", "es", "e", "0.25 * sd", 16)},
loc AS (SELECT ev.id, i, x[greatest(1, i - 7):least(len(x), i + 9)] AS w, y[greatest(1, i - 7):least(len(y), i + 9)] AS b FROM ev JOIN src USING (id) JOIN band USING (id)),
amp AS (SELECT id, i, greatest(list_max(w) - list_aggregate(w, 'median'), 0) / {_scale("w")} AS u, greatest(list_aggregate(w, 'median') - list_min(w), 0) / {_scale("w")} AS d, list_avg(list_transform(b, lambda v: v * v)) AS en FROM loc),
lean AS (SELECT id, i, en, (u - d) / greatest(u + d, 1e-8) AS l FROM amp), st AS (SELECT id, i, (i - lag(i) OVER (PARTITION BY id ORDER BY i)) / 64 AS rr FROM ev),
reg AS (SELECT id, CASE WHEN count(rr) > 0 THEN 1 / (1 + stddev_pop(rr) / greatest(avg(rr), 1e-8)) ELSE 0 END AS reg FROM st GROUP BY id),
agg AS (SELECT id, count(*) AS n, count(*) FILTER (l > 0.12) AS np, count(*) FILTER (l < -0.12) AS nm, avg(greatest(l, 0)) AS wp, avg(greatest(-l, 0)) AS wm, coalesce(avg(en) FILTER (l > 0.12), 0) AS ep, coalesce(avg(en) FILTER (l < -0.12), 0) AS em FROM lean GROUP BY id),
sc AS (SELECT *, CASE WHEN np + nm >= 8 THEN np / (np + nm) * (0.5 + 0.5 * reg) + 0.5 * wp ELSE wp END AS sp, CASE WHEN np + nm >= 8 THEN nm / (np + nm) * (0.5 + 0.5 * reg) + 0.5 * wm ELSE wm END AS sm FROM agg JOIN reg USING (id)),
vote AS (SELECT *, abs(sp - sm) / greatest(sp + sm, 1e-8) AS margin, CASE WHEN np + nm >= 8 AND sp < sm THEN 'negative' ELSE 'positive' END AS vp FROM sc),
voted AS (SELECT *, CASE WHEN np + nm < 8 THEN 0 WHEN margin >= 0.08 AND np <> nm THEN margin ELSE margin / 2 END AS vc FROM vote)"""
_VOTED_LONG = f"{LONG}, {_VOTED.replace('{COUNTED}', COUNTED)}"


@query(f"""WITH {_VOTED_LONG} SELECT id AS recording_id, vp AS polarity, round(vc, 6) AS confidence, round(sp, 6) AS positive_score, round(sm, 6) AS negative_score, CAST(n AS INTEGER) AS qrs_events, CAST(np AS INTEGER) AS positive_events,
CAST(nm AS INTEGER) AS negative_events, CAST(n - np - nm AS INTEGER) AS ambiguous_events, round(reg, 6) AS rr_regularity, round(CASE WHEN np + nm >= 8 AND ep > 0 AND em > 0 THEN ep / greatest(em, 1e-8) ELSE 0 END, 6) AS qrs_band_energy_ratio FROM voted""")
def qrs_vote(spark, sf_dir):
    v = detection.vote_polarity(long_signals(spark, sf_dir)).drop("channel", "error")
    return v.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in v.dtypes])


@query(f"""WITH {_VOTED_LONG} SELECT pol.id AS recording_id, CASE WHEN conf >= 0.1 THEN p ELSE vp END AS polarity, round(CASE WHEN conf >= 0.1 THEN conf ELSE vc END, 6) AS confidence, conf >= 0.1 AS fallback_used FROM pol LEFT JOIN voted USING (id)""")
def signal_polarity(spark, sf_dir):
    """Guarded hybrid: the count-based polarity where it is confident, the vote elsewhere."""
    p = detection.hybrid_polarity(long_signals(spark, sf_dir))
    return p.select("recording_id", "polarity", r6("confidence").alias("confidence"), "fallback_used")


@query(f"""WITH {_VOTED_LONG} SELECT pol.id AS recording_id, p AS counted, vp AS voted, p = vp AS agree, CASE WHEN conf >= 0.1 THEN p ELSE vp END AS chosen, CAST(n AS INTEGER) AS qrs_events FROM pol LEFT JOIN voted USING (id)""")
def polarity_audit(spark, sf_dir):
    return detection.polarity_audit(long_signals(spark, sf_dir)).select("recording_id", "counted", "voted", "agree", "chosen", "qrs_events")


# --- filters and boundaries ----------------------------------------------------------------------

_FILTERED = ",\n".join((
    SHORT,
    _zero_phase("base", "src", "x", _fourth_order("highpass", 0.5, 64), 15),
    _zero_phase("hp", "base", "y", _fourth_order("highpass", 0.7, 64), 15),
    _zero_phase("lp", "hp", "y", _fourth_order("lowpass", 25.0, 64), 15),
    _zero_phase("nt", "lp", "y", [_biquad("notch", 20.0, 64, 30.0)], 9),
))


@query(f"WITH {_FILTERED}, u AS (SELECT id, unnest(range(0, len(y))) AS i, unnest(y) AS v FROM nt) SELECT id AS recording_id, CAST(i AS INTEGER) AS i, round(v, 6) + 0.0 AS value FROM u")
def filtered_signals(spark, sf_dir):
    """Baseline, high-pass, low-pass and notch, zero phase, in this order."""
    f = detection.filter_signals(signals(spark, sf_dir), baseline=True, highpass_hz=0.7, lowpass_hz=25.0, notch_hz=20.0)
    return f.select("recording_id", F.posexplode("filtered").alias("i", "v")).select("recording_id", "i", (r6("v") + 0.0).alias("value"))


@query(f"""WITH {POSITIVE}, cen AS (SELECT id, z AS y FROM zs), {_band("band", "cen", "y", 5.0, 25.0)}, {_envelope("env", "band", 3)},
win AS (SELECT up.id, i AS c, greatest(0, i - 10) AS a, least(len(y), i + 11) AS b, e, list_transform(y, lambda v: abs(v)) AS s FROM up JOIN band USING (id) JOIN env USING (id)),
lim AS (SELECT *, 0.15 * list_max(e[(a + 1):b]) AS le, 0.1 * list_max(s[(a + 1):b]) AS ls FROM win),
quiet AS (SELECT *, list_transform(range(a, b), lambda k: e[k + 1] < le OR s[k + 1] < ls) AS q FROM lim),
calm AS (SELECT *, list_filter(range(a, b - 2), lambda k: q[k - a + 1] AND q[k - a + 2] AND q[k - a + 3]) AS k FROM quiet),
edge AS (SELECT id, c, a, b, list_max(list_filter(k, lambda v: v < c - 1)) AS f, list_min(list_filter(k, lambda v: v >= c)) AS t FROM calm)
SELECT id AS recording_id, c AS center, least(coalesce(f + 2, a), c) AS onset, greatest(coalesce(t, b - 1), c) AS "offset", f IS NOT NULL AS onset_found, t IS NOT NULL AS offset_found FROM edge""")
def qrs_delineation(spark, sf_dir):
    s = signals(spark, sf_dir)
    d = detection.delineate(s, detection.detect_peaks(s).where("r_index IS NOT NULL"))
    return d.select("recording_id", "center", "onset", "offset", "onset_found", "offset_found")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), m AS (SELECT *, vec_id % 20 AS k FROM v)
SELECT vec_id AS recording_id, CASE WHEN least(k * 2, 64) < 8 THEN 'short' WHEN k = 5 THEN 'not finite' WHEN k = 6 THEN 'rate' ELSE 'fine' END AS fault FROM m""")
def signal_guards(spark, sf_dir):
    """Too short signals, values that are not finite and unusable rates are told apart."""
    s = signals(spark, sf_dir).withColumn("k", (F.col("recording_id") % 20).cast("int"))
    broken = s.withColumn("values", F.slice("values", F.lit(1), F.greatest(F.lit(0), F.col("k") * 2))).withColumn("values", F.when(F.col("k") == 5, F.concat("values", F.array(F.lit(float("nan"))))).otherwise(F.col("values"))).withColumn("fs_hz", F.when(F.col("k") == 6, F.lit(-1.0)).otherwise(F.col("fs_hz")))
    p = detection.select_polarity(broken)
    fault = F.when(F.col("error").isNull(), "fine").when(F.col("error").contains("samples"), "short").when(F.col("error").contains("finite"), "not finite").otherwise("rate")
    return p.select("recording_id", fault.alias("fault"))


@query("SELECT vec_id AS recording_id, vec_id % 3 = 0 AS refused FROM embeddings")
def filter_guards(spark, sf_dir):
    """A cutoff beyond half the sampling rate is refused signal by signal."""
    s = signals(spark, sf_dir).withColumn("fs_hz", F.when(F.col("recording_id") % 3 == 0, 40.0).otherwise(F.col("fs_hz")))
    return detection.filter_signals(s, lowpass_hz=20.0).select("recording_id", F.col("error").isNotNull().alias("refused"))


@query(f"WITH {SHORT}, k AS (SELECT id, unnest(list_filter(range(0, 64), lambda i: x[i + 1] = list_max(x[(i // 16 * 16 + 1):(i // 16 * 16 + 16)]))) AS r_index FROM src WHERE id % 10 <> 0) SELECT id AS recording_id, r_index, false AS refused FROM k UNION ALL SELECT id, -1, true FROM src WHERE id % 10 = 0")
def plugin_detector(spark, sf_dir):
    """A registered detector (largest sample of every 16); a tenth of the signals makes it return indices that fall."""

    def blocks(x, fs):
        found = [i + int(np.argmax(x[i : i + 16])) for i in range(0, len(x), 16)]
        return found[::-1] if fs == 32.0 else found

    detection.register_detector("largest of blocks", blocks)
    s = signals(spark, sf_dir).withColumn("fs_hz", F.when(F.col("recording_id") % 10 == 0, 32.0).otherwise(F.col("fs_hz")))
    return detection.run_detector(s, "largest of blocks").select("recording_id", F.coalesce("r_index", F.lit(-1)).cast("long").alias("r_index"), F.col("error").isNotNull().alias("refused"))


@query(f"""WITH {POSITIVE}, {_peaks("strict", "zs", "z", "2.0 * sd", 16)}, near AS (SELECT id, i, (SELECT min(s.i) FROM strict s WHERE s.id = up.id AND s.i >= up.i) AS nx, (SELECT max(s.i) FROM strict s WHERE s.id = up.id AND s.i < up.i) AS pv FROM up),
pick AS (SELECT *, CASE WHEN nx IS NULL THEN pv WHEN pv IS NULL THEN nx WHEN nx - i <= i - pv THEN nx ELSE pv END AS ref FROM near), ok AS (SELECT *, coalesce(abs(ref - i) <= 20 * 64 / 1000.0, false) AS inside FROM pick)
SELECT id AS recording_id, i AS r_index, CAST(inside AND row_number() OVER (PARTITION BY id, inside, ref ORDER BY i) = 1 AS INTEGER) AS label FROM ok""")
def candidate_labels(spark, sf_dir):
    """Stage-1 candidates next to stricter peaks of the same signals."""
    s = signals(spark, sf_dir)
    loose, strict = detection.detect_peaks(s).where("r_index IS NOT NULL"), detection.detect_peaks(s, prominence_factor=2.0).where("r_index IS NOT NULL")
    return candidates.label_candidates(loose, strict, 64.0, 0.02, ["recording_id"])


# --- beats -----------------------------------------------------------------------------------------

_BEAT = f"{POSITIVE}, bt AS (SELECT up.id, i, x, i / 64 AS t FROM up JOIN src USING (id)), rr AS (SELECT *, t - lag(t) OVER w AS pv, lead(t) OVER w - t AS nx FROM bt WINDOW w AS (PARTITION BY id ORDER BY i))"


@query(f"""WITH {_BEAT}, w AS (SELECT *, x[greatest(1, i - 12):least(64, i + 13)] AS w, list_avg(x[greatest(1, i - 1):least(64, i + 3)]) AS amp FROM rr), d AS (SELECT *, list_transform(w, lambda v: abs(v - list_aggregate(w, 'median'))) AS d FROM w),
k AS (SELECT *, list_filter(range(1, len(d) + 1), lambda j: d[j] >= 0.5 * list_max(d)) AS k FROM d)
SELECT id AS recording_id, i AS r_index, round(t, 6) AS r_time_s, round(pv, 6) AS rr_prev_s, round(nx, 6) AS rr_next_s, round(60 / CASE WHEN pv > 0 THEN pv WHEN nx > 0 THEN nx END, 6) AS heart_rate_bpm, round(amp, 6) AS r_amplitude,
round(CASE WHEN len(d) > 5 AND list_max(d) > 0 AND len(k) >= 2 THEN (list_max(k) - list_min(k)) / 64 END, 6) AS qrs_width_proxy_s FROM k""")
def beat_phenotypes(spark, sf_dir):
    s = signals(spark, sf_dir)
    b = beats.beat_phenotypes(s, detection.detect_peaks(s).where("r_index IS NOT NULL")).drop("channel")
    return b.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in b.dtypes])


@query(f"""WITH {_BEAT} SELECT id AS recording_id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS "index", i AS r_index, round(t, 6) AS r_time_s, round(greatest(0, t - 0.1), 6) AS start, round(least(63 / 64, t + 0.2), 6) AS "end", round(pv, 6) AS rr_prev_s, round(nx, 6) AS rr_next_s FROM rr""")
def beat_windows(spark, sf_dir):
    """Windows of distinct peaks, clipped to the recording; peaks are given twice and out of range as well."""
    s = signals(spark, sf_dir)
    p = detection.detect_peaks(s).where("r_index IS NOT NULL").select("recording_id", "r_index")
    p = p.unionByName(p).unionByName(p.withColumn("r_index", F.col("r_index") + 64)).unionByName(p.withColumn("r_index", F.col("r_index") - 64))
    about = s.select("recording_id", F.lit(64).alias("n_samples"), F.lit(0.0).alias("time_start_s"), F.lit(63 / 64).alias("time_end_s"), "fs_hz")
    b = beats.segment_beats(p, about, 0.1, 0.2).drop("heart_rate_bpm")
    return b.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in b.dtypes])


_BANDS = " , ".join(f"coalesce(list_sum(list_filter(list_transform(range(0, n // 2 + 1), lambda k: CASE WHEN k * 64 / n >= {a} AND k * 64 / n < {min(b, 32.0)} THEN pw[k + 1] END), lambda v: v IS NOT NULL)), 0)" for a, b in learning.BEAT_BANDS)


@query(f"""WITH {POSITIVE}, part AS (SELECT up.id, i, x[greatest(1, i - 25):least(64, i + 27)] AS p FROM up JOIN src USING (id)),
sz AS (SELECT id, i, p, len(p) AS n, list_aggregate(p, 'median') AS m, CASE WHEN list_aggregate(p, 'stddev_pop') = 0 THEN 1 ELSE list_aggregate(p, 'stddev_pop') END AS s FROM part),
zz AS (SELECT id, i, n, list_transform(p, lambda v: (v - m) / s) AS z FROM sz), cc AS (SELECT *, list_transform(z, lambda v: v - list_avg(z)) AS c FROM zz),
sp AS (SELECT *, list_transform(range(0, n // 2 + 1), lambda k: (list_sum(list_transform(range(0, n), lambda t: c[t + 1] * cos(2 * pi() * k * t / n))) ** 2 + list_sum(list_transform(range(0, n), lambda t: c[t + 1] * sin(2 * pi() * k * t / n))) ** 2) / (64 * n) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END) AS pw FROM cc),
ft AS (SELECT id, i, [list_avg(z), list_aggregate(z, 'stddev_pop'), list_max(z), list_min(z), list_max(list_transform(z, lambda v: abs(v))), list_avg(list_transform(range(1, n), lambda k: abs(z[k + 1] - z[k]))), {_BANDS}] AS f FROM sp)
SELECT recording_id, r_index, k, round(v, 6) + 0.0 AS value FROM (SELECT id AS recording_id, i AS r_index, CAST(unnest(range(0, 10)) AS INTEGER) AS k, unnest(f) AS v FROM ft)""")
def beat_features(spark, sf_dir):
    s = signals(spark, sf_dir)
    f = learning.beat_features(s, detection.detect_peaks(s).where("r_index IS NOT NULL"))
    return f.select("recording_id", "r_index", F.posexplode("features").alias("k", "v")).select("recording_id", "r_index", "k", (r6("v") + 0.0).alias("value"))


_AT = lambda y, k: f"{y}[least(64, greatest(1, i + 1 + ({k})))]"  # noqa: E731  value k places from the candidate, edges repeated
_ENERGY = lambda y: f"list_avg(list_transform(range(-5, 6), lambda k: {_AT(y, 'k')} ** 2))"
_WIDE = f"list_transform(range(-16, 17), lambda k: {_AT('z', 'k')})"


@query(f"""WITH {POSITIVE}, nrm AS (SELECT id, CASE WHEN sd = 0 THEN 1 ELSE sd END AS sc, list_transform(z, lambda v: v / CASE WHEN sd = 0 THEN 1 ELSE sd END) AS z FROM zs),
{_band("b0", "nrm", "z", 0.5, 5.0)}, {_band("b1", "nrm", "z", 5.0, 15.0)}, {_band("b2", "nrm", "z", 15.0, 28.8)},
nb AS (SELECT id, i, prom, (i - lag(i) OVER w) / 64 AS pv, (lead(i) OVER w - i) / 64 AS nx FROM up WINDOW w AS (PARTITION BY id ORDER BY i)), ty AS (SELECT id, coalesce(median(pv), 1.0) AS t FROM nb GROUP BY id),
al AS (SELECT nb.id, i, prom, sc, z, coalesce(pv, t) AS pv, coalesce(nx, t) AS nx, t, {_ENERGY("b0.y")} AS e0, {_ENERGY("b1.y")} AS e1, {_ENERGY("b2.y")} AS e2 FROM nb JOIN ty USING (id) JOIN nrm USING (id) JOIN b0 USING (id) JOIN b1 USING (id) JOIN b2 USING (id)),
wd AS (SELECT *, {_WIDE} AS w, greatest(e0 + e1 + e2, 1e-8) AS es FROM al), co AS (SELECT *, list_transform(w[12:22], lambda v: abs(v)) AS a, list_transform(range(1, 33), lambda k: abs(w[k + 1] - w[k]) * 64) AS sl, w[12:16] AS lf, w[18:22] AS rt FROM wd),
ft AS (SELECT id, i, list_concat([z[i + 1], prom / sc, len(list_filter(a, lambda v: v >= 0.5 * list_max(a))) / 64, list_max(sl), list_avg(sl), sqrt(list_avg(list_transform(a, lambda v: v * v))), list_max(a) / greatest(list_avg(a), 1e-6), e0 / es, e1 / es, e2 / es, 0,
  list_avg(list_transform(lf, lambda v: v * v)) / greatest(list_avg(list_transform(rt, lambda v: v * v)), 1e-6), list_max(list_transform(lf, lambda v: abs(v))) / greatest(list_max(list_transform(rt, lambda v: abs(v))), 1e-6), pv, nx, pv / greatest(t, 1e-6), nx / greatest(t, 1e-6)],
  list_transform(range(0, 64), lambda k: w[least(32, CAST(floor(k * 32 / 63) AS INTEGER)) + 1] * (1 - (k * 32 / 63 - floor(k * 32 / 63))) + w[least(32, CAST(floor(k * 32 / 63) AS INTEGER) + 1) + 1] * (k * 32 / 63 - floor(k * 32 / 63)))) AS f FROM co)
SELECT recording_id, r_index, k, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) + 0.0 AS value FROM (SELECT id AS recording_id, i AS r_index, CAST(unnest(range(0, 81)) AS INTEGER) AS k, unnest(f) AS v FROM ft)""")
def candidate_features(spark, sf_dir):
    s = signals(spark, sf_dir)
    f = candidates.candidate_features(s, detection.detect_peaks(s))
    return f.select("recording_id", "r_index", F.posexplode("features").alias("k", "v")).select("recording_id", "r_index", "k", (F.round(F.col("v").cast("double"), 4) + 0.0).alias("value"))


@query(f"WITH v AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events WHERE value IS NOT NULL GROUP BY user_id) SELECT user_id, round({_scale('x')}, 6) AS scale FROM v")
def robust_scale(spark, sf_dir):
    packed = table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.collect_list("value").alias("x"))
    return packed.select("user_id", r6(robust_scale_of("x")).alias("scale"))


@query("""WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT vec_id, median(x) AS c, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM e GROUP BY vec_id)
SELECT vec_id, round(avg((x - c) / s), 6) AS mean_z, round(max((x - c) / s), 6) AS max_z, round(min((x - c) / s), 6) AS min_z, round(max(abs((x - c) / s)), 6) AS max_abs_z FROM e JOIN m USING (vec_id) GROUP BY vec_id""")
def zscore_features(spark, sf_dir):
    z = table(spark, sf_dir, "embeddings").select("vec_id", z_scores(F.col("embedding").cast("array<double>")).alias("z"))
    mean = F.aggregate("z", F.lit(0.0), lambda a, x: a + x) / F.size("z")
    return z.select("vec_id", r6(mean).alias("mean_z"), r6(F.array_max("z")).alias("max_z"), r6(F.array_min("z")).alias("min_z"), r6(F.array_max(F.transform("z", F.abs))).alias("max_abs_z"))


# --- recordings in chunks: the SQL is that of the whole signals ---------------------------------------------


@query(_SQL["detect_peaks"])
def chunked_peaks(spark, sf_dir):
    """Adaptive polarity and recovery over chunks of 20 samples."""
    p = chunked.detect_chunks(chunked.to_chunks(signals(spark, sf_dir), 20), 20, "adaptive", recovery=True).where("r_index IS NOT NULL")
    return p.select("recording_id", "r_index", r6("prominence").alias("prominence"), "polarity")


@query(_SQL["counted_polarity"])
def chunked_polarity(spark, sf_dir):
    p = chunked.select_polarity(chunked.to_chunks(signals(spark, sf_dir), 20), 20)
    return p.select("recording_id", "polarity", *[r6(c).alias(c) for c in ("confidence", "positive_score", "negative_score")], "positive_candidates", "negative_candidates")


@query(_SQL["filtered_signals"])
def chunked_filters(spark, sf_dir):
    """The four filters over chunks of 30 samples and their halos."""
    f = chunked.filter_chunks(chunked.to_chunks(signals(spark, sf_dir), 30), 30, baseline=True, highpass_hz=0.7, lowpass_hz=25.0, notch_hz=20.0)
    return f.select("recording_id", "start", F.posexplode("values").alias("i", "v")).select("recording_id", (F.col("start") + F.col("i")).cast("int").alias("i"), (r6("v") + 0.0).alias("value"))


@query("WITH s AS (SELECT vec_id // 10 AS id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT id AS recording_id, count(*) AS n, round(quantile_cont(x, 0.25), 9) AS p25, round(median(x), 9) AS p50, round(quantile_cont(x, 0.95), 9) AS p95, round(min(x), 9) AS low, round(max(x), 9) AS high FROM s GROUP BY id")
def exact_quantiles(spark, sf_dir):
    """Quantiles by refined histograms, over chunks."""
    q = quantiles.exact_quantiles(chunked.to_chunks(long_signals(spark, sf_dir), 100), ["recording_id"], "values", [0.25, 0.5, 0.95, 0.0, 1.0])
    return q.select("recording_id", "n", *[F.round(F.get("quantiles", F.lit(i)), 9).alias(c) for i, c in enumerate(("p25", "p50", "p95", "low", "high"))])
