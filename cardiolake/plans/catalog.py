"""All named queries of the engine and their SQL equivalents.

The driver tables stand in for recordings: an event series per user is a
recording with irregular samples, an embedding is a short uniform signal,
customers and orders are units and measurements.  Every query reads its whole
tables.  Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import argmax, entropy, file_id, is_finite, softmax
from ..operators import annotations, beats, candidates, detection, learning, matching, provenance, stats, validation
from ..sources import readers
from .base import _QUERIES, _SQL, Query, phenotypes, query, r6, series, signals, table

def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- windows over beats --------------------------------------------------------------------------


@query("WITH {BEATS} SELECT user_id, i AS r_index, round(rr_prev, 6) AS rr_prev_s, round(rr_next, 6) AS rr_next_s, round(hr, 6) AS heart_rate_bpm FROM beats")
def rr_intervals(spark, sf_dir):
    p = phenotypes(spark, sf_dir)
    return p.select("user_id", "r_index", r6("rr_prev_s").alias("rr_prev_s"), r6("rr_next_s").alias("rr_next_s"), r6("heart_rate_bpm").alias("heart_rate_bpm"))


@query("""WITH {BEATS} SELECT event_type, count(*) AS n_beats, round(avg(hr), 6) AS heart_rate_bpm_mean, round(stddev_samp(hr), 6) AS heart_rate_bpm_sd, round(quantile_cont(hr, 0.25), 6) AS heart_rate_bpm_p25,
round(quantile_cont(hr, 0.5), 6) AS heart_rate_bpm_median, round(quantile_cont(hr, 0.75), 6) AS heart_rate_bpm_p75, round(avg(value), 6) AS r_amplitude_mean, round(stddev_samp(value), 6) AS r_amplitude_sd,
round(quantile_cont(value, 0.25), 6) AS r_amplitude_p25, round(quantile_cont(value, 0.5), 6) AS r_amplitude_median, round(quantile_cont(value, 0.75), 6) AS r_amplitude_p75,
round(avg(CASE WHEN hr > 100 THEN 1.0 WHEN hr IS NOT NULL THEN 0.0 END), 6) AS share_fast, round(avg(CASE WHEN hr < 60 THEN 1.0 WHEN hr IS NOT NULL THEN 0.0 END), 6) AS share_slow FROM beats GROUP BY event_type""")
def phenotype_summary(spark, sf_dir):
    s = beats.summary(phenotypes(spark, sf_dir), ["event_type"], ["heart_rate_bpm", "r_amplitude"])
    return s.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query("""WITH {BEATS} SELECT user_id, count(*) AS n_beats, count(hr) AS heart_rate_bpm_n, round(avg(hr), 6) AS heart_rate_bpm_mean, round(median(hr), 6) AS heart_rate_bpm_median, round(stddev_samp(hr), 6) AS heart_rate_bpm_sd,
count(rr_prev) AS rr_prev_s_n, round(avg(rr_prev), 6) AS rr_prev_s_mean, round(median(rr_prev), 6) AS rr_prev_s_median, round(stddev_samp(rr_prev), 6) AS rr_prev_s_sd,
count(value) AS r_amplitude_n, round(avg(value), 6) AS r_amplitude_mean, round(median(value), 6) AS r_amplitude_median, round(stddev_samp(value), 6) AS r_amplitude_sd FROM beats GROUP BY user_id""")
def aggregate_by_unit(spark, sf_dir):
    a = beats.aggregate_by_unit(phenotypes(spark, sf_dir), "user_id", ["heart_rate_bpm", "rr_prev_s", "r_amplitude"])
    return a.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes])


@query("WITH {SERIES}, d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS dt FROM series) SELECT user_id, round(1 / median(dt) FILTER (dt > 0), 6) AS fs_hz FROM d GROUP BY user_id")
def sampling_rate(spark, sf_dir):
    return validation.sampling_rate(series(spark, sf_dir), ["user_id"])


@query("""WITH {BEATS} SELECT user_id, count(*) AS n_rows, CAST(count(*) FILTER (hr IS NULL) AS BIGINT) AS missing_total, CAST(0 AS BIGINT) AS nonfinite_total, CAST(0 AS BIGINT) AS invalid_r_indices, CAST(0 AS BIGINT) AS duplicate_r_indices,
CAST(max(CASE WHEN rr_prev <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS time_nonmonotonic, count(*) FILTER (rr_prev <= 0) AS invalid_rr,
count(*) FILTER (rr_prev > 0 AND abs(60.0 / rr_prev - hr) > greatest(1e-6, abs(60.0 / rr_prev) * 1e-6)) AS inconsistent_heart_rate,
count(*) FILTER (hr IS NULL) + max(CASE WHEN rr_prev <= 0 THEN 1 ELSE 0 END) + count(*) FILTER (rr_prev <= 0) + count(*) FILTER (rr_prev > 0 AND abs(60.0 / rr_prev - hr) > greatest(1e-6, abs(60.0 / rr_prev) * 1e-6)) = 0 AS valid FROM beats GROUP BY user_id""")
def quality_report(spark, sf_dir):
    return validation.quality_report(phenotypes(spark, sf_dir), ["user_id"], "r_index")


@query("WITH {SERIES} SELECT user_id, i AS sample_index, round(t, 6) AS time_s, round(value, 6) AS value FROM series WHERE i >= 10 AND i < 40")
def window_scan(spark, sf_dir):
    w = readers.window_scan(series(spark, sf_dir), 10, 40)
    return w.select("user_id", "sample_index", r6("time_s").alias("time_s"), r6("value").alias("value"))


@query("WITH {SERIES} SELECT user_id, i AS sample_index, round(avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS r_amplitude FROM series")
def smoothed_amplitude(spark, sf_dir):
    return beats.smoothed_amplitude(series(spark, sf_dir), ["user_id"]).select("user_id", "sample_index", r6("r_amplitude").alias("r_amplitude"))


@query("WITH {SERIES} SELECT user_id, i AS sample_index, round(median(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING), 6) AS baseline FROM series")
def local_baseline(spark, sf_dir):
    return beats.local_baseline(series(spark, sf_dir), 8, ["user_id"]).select("user_id", "sample_index", r6("baseline").alias("baseline"))


@query("WITH {SERIES}, n AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM series WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, i AS sample_index, round(value, 6) AS value FROM n WHERE value > a AND value > b")
def local_maxima(spark, sf_dir):
    return detection.local_maxima_rows(series(spark, sf_dir), ["user_id"]).select("user_id", "sample_index", r6("value").alias("value"))


@query("""WITH {SERIES}, g AS (SELECT user_id, t AS l, lead(t) OVER (PARTITION BY user_id ORDER BY i) AS r FROM series), d AS (SELECT *, r - l AS gap FROM g WHERE r IS NOT NULL),
m AS (SELECT user_id, median(gap) AS typical FROM d GROUP BY user_id) SELECT user_id, round(l, 6) AS "left", round(r, 6) AS "right", round(gap, 6) AS gap FROM d JOIN m USING (user_id) WHERE typical > 0 AND gap > 1.65 * typical""")
def long_gaps(spark, sf_dir):
    g = beats.long_gaps(series(spark, sf_dir), 1.65, ["user_id"], "time_s")
    return g.select("user_id", r6("left").alias("left"), r6("right").alias("right"), r6("gap").alias("gap"))


@query("WITH {SERIES}, d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS rr FROM series) SELECT user_id, round(coalesce(1 / (1 + stddev_pop(rr) / greatest(avg(rr), 1e-8)), 0), 6) AS rr_regularity FROM d GROUP BY user_id")
def rr_regularity(spark, sf_dir):
    s = series(spark, sf_dir)
    return beats.rr_regularity(s, ["user_id"], "time_s", "sample_index").select("user_id", r6("rr_regularity").alias("rr_regularity"))


# --- matching ---------------------------------------------------------------------------------------

_SIDES = "left_side AS (SELECT user_id, t AS tm FROM series WHERE event_type = 'click'), right_side AS (SELECT user_id, t AS tm FROM series WHERE event_type = 'view')"


def _sides(spark, sf_dir, name="at"):
    s = series(spark, sf_dir)
    side = lambda k: s.where(F.col("event_type") == k).select("user_id", F.col("time_s").alias(name), "event_id")
    return side("click"), side("view")


@query("WITH {SERIES}, " + _SIDES + " SELECT user_id, round(tm, 6) AS time_s FROM left_side l WHERE NOT EXISTS (SELECT 1 FROM right_side r WHERE r.user_id = l.user_id AND abs(r.tm - l.tm) <= 7200)")
def tolerance_exclusion(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return matching.exclude_near(a, b, 7200.0, ["user_id"], "at", "at").select("user_id", r6("at").alias("time_s"))


@query("WITH {SERIES}, " + _SIDES + """, near AS (SELECT user_id, tm, (SELECT min(r.tm) FROM right_side r WHERE r.user_id = l.user_id AND r.tm >= l.tm) AS nx, (SELECT max(r.tm) FROM right_side r WHERE r.user_id = l.user_id AND r.tm < l.tm) AS pv FROM left_side l),
pick AS (SELECT *, CASE WHEN nx IS NULL THEN pv WHEN pv IS NULL THEN nx WHEN nx - tm <= tm - pv THEN nx ELSE pv END AS ref FROM near),
ok AS (SELECT *, coalesce(abs(ref - tm) <= 14400, false) AS inside FROM pick), won AS (SELECT *, inside AND row_number() OVER (PARTITION BY user_id, inside, ref ORDER BY tm) = 1 AS w FROM ok)
SELECT user_id, round(tm, 6) AS time_s, CAST(w AS INTEGER) AS label, round(CASE WHEN w THEN ref END, 6) AS reference_at FROM won""")
def nearest_label(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    n = matching.nearest_labels(a, b, 14400.0, ["user_id"])
    return n.select("user_id", r6("at").alias("time_s"), "label", r6("reference_at").alias("reference_at"))


def _metrics(spark, sf_dir, tolerance_ms=14_400_000.0):
    a, b = _sides(spark, sf_dir, "sample_index")
    whole = lambda df: df.select("user_id", F.floor("sample_index").cast("long").alias("sample_index")).distinct()
    return matching.match_peaks(whole(a), whole(b), 1.0, tolerance_ms, ["user_id"])


_MATCH_SQL = "{SERIES}, " + """l AS (SELECT user_id, list(DISTINCT CAST(floor(t) AS BIGINT) ORDER BY CAST(floor(t) AS BIGINT)) AS d FROM series WHERE event_type = 'click' GROUP BY user_id),
r AS (SELECT user_id, list(DISTINCT CAST(floor(t) AS BIGINT) ORDER BY CAST(floor(t) AS BIGINT)) AS f FROM series WHERE event_type = 'view' GROUP BY user_id),
p AS (SELECT user_id, coalesce(d, []) AS d, coalesce(f, []) AS f, tol FROM l FULL JOIN r USING (user_id), (SELECT unnest([{TOLERANCES}]) AS tol)),
walk(user_id, tol, d, f, i, j, e) AS (SELECT user_id, tol, d, f, 1, 1, CAST([] AS BIGINT[]) FROM p UNION ALL
SELECT user_id, tol, d, f, i + CASE WHEN abs(d[i] - f[j]) <= tol OR d[i] < f[j] THEN 1 ELSE 0 END, j + CASE WHEN abs(d[i] - f[j]) <= tol OR d[i] >= f[j] THEN 1 ELSE 0 END,
CASE WHEN abs(d[i] - f[j]) <= tol THEN list_append(e, d[i] - f[j]) ELSE e END FROM walk WHERE i <= len(d) AND j <= len(f)),
w AS (SELECT user_id, tol, len(any_value(f)) AS nf, len(any_value(d)) AS nd, list_transform(arg_max(e, len(e)), lambda x: 1000e0 * x) AS e FROM walk GROUP BY user_id, tol),
m AS (SELECT user_id, tol, nf AS reference_count, nd AS detected_count, len(e) AS true_positive, nd - len(e) AS false_positive, nf - len(e) AS false_negative, CASE WHEN nf > 0 THEN len(e) / nf ELSE 0 END AS sensitivity, CASE WHEN nd > 0 THEN len(e) / nd ELSE 0 END AS positive_predictive_value,
CASE WHEN len(e) > 0 THEN 2 * len(e) / (nf + nd) ELSE 0 END AS f1, list_avg(e) AS mean_timing_error_ms, list_aggregate(e, 'median') AS median_timing_error_ms, list_aggregate(e, 'stddev_samp') AS sd_timing_error_ms, list_avg(list_transform(e, lambda x: abs(x))) AS mean_absolute_timing_error_ms,
list_aggregate(list_transform(e, lambda x: abs(x)), 'median') AS median_absolute_timing_error_ms, list_aggregate(list_transform(e, lambda x: abs(x)), 'quantile_cont', 0.95) AS p95_absolute_timing_error_ms, list_max(list_transform(e, lambda x: abs(x))) AS max_absolute_timing_error_ms FROM w)"""
_COUNTS = ("reference_count", "detected_count", "true_positive", "false_positive", "false_negative")
_RATES = ("sensitivity", "positive_predictive_value", "f1")
_TIMES = ("mean_timing_error_ms", "median_timing_error_ms", "sd_timing_error_ms", "mean_absolute_timing_error_ms", "median_absolute_timing_error_ms", "p95_absolute_timing_error_ms", "max_absolute_timing_error_ms")
_METRICS_SQL = ", ".join([f"CAST({c} AS BIGINT) AS {c}" for c in _COUNTS] + [f"round({c}, 6) AS {c}" for c in _RATES] + [f"round({c}, 3) AS {c}" for c in _TIMES])


def _metric_columns():
    return [*_COUNTS, *[r6(c).alias(c) for c in _RATES], *[F.round(c, 3).alias(c) for c in _TIMES]]


@query("WITH RECURSIVE " + _MATCH_SQL.replace("{TOLERANCES}", "14400") + f" SELECT user_id, {_METRICS_SQL} FROM m")
def match_peaks(spark, sf_dir):
    return _metrics(spark, sf_dir).select("user_id", *_metric_columns())


@query("WITH RECURSIVE " + _MATCH_SQL.replace("{TOLERANCES}", "14400") + """ SELECT count(*) AS records, CAST(sum(reference_count) AS BIGINT) AS reference_count, CAST(sum(detected_count) AS BIGINT) AS detected_count, CAST(sum(true_positive) AS BIGINT) AS true_positive, CAST(sum(false_positive) AS BIGINT) AS false_positive, CAST(sum(false_negative) AS BIGINT) AS false_negative,
round(sum(true_positive) / sum(reference_count), 6) AS sensitivity, round(sum(true_positive) / sum(detected_count), 6) AS positive_predictive_value, round(2 * sum(true_positive) / (sum(reference_count) + sum(detected_count)), 6) AS f1, round(avg(mean_timing_error_ms), 3) AS mean_timing_error_ms, round(median(median_absolute_timing_error_ms), 3) AS median_absolute_timing_error_ms FROM m""")
def pooled_detection(spark, sf_dir):
    p = stats.pooled_detection(_metrics(spark, sf_dir))
    return p.select("records", *_COUNTS, *[r6(c).alias(c) for c in _RATES], *[F.round(c, 3).alias(c) for c in ("mean_timing_error_ms", "median_absolute_timing_error_ms")])


@query("WITH RECURSIVE " + _MATCH_SQL.replace("{TOLERANCES}", "3600, 7200, 10800, 14400") + f" SELECT user_id, tol * 1000.0 AS tolerance_ms, {_METRICS_SQL} FROM m")
def tolerance_sweep(spark, sf_dir):
    a, b = _sides(spark, sf_dir, "sample_index")
    whole = lambda df: df.select("user_id", F.floor("sample_index").cast("long").alias("sample_index")).distinct()
    return matching.tolerance_sweep(whole(a), whole(b), 1.0, [3.6e6, 7.2e6, 10.8e6, 14.4e6], ["user_id"]).select("user_id", "tolerance_ms", *_metric_columns())


@query("WITH RECURSIVE " + _MATCH_SQL.replace("{TOLERANCES}", "14400") + ", v AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM m" for m in provenance.MACRO) + ") SELECT metric, count(value) AS n, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS sd FROM v GROUP BY metric")
def macro_summary(spark, sf_dir):
    """Means over records of the rates and timing errors, as a report has them."""
    s = provenance.rigorous_summary(_metrics(spark, sf_dir).withColumnRenamed("user_id", "recording_id"))
    rows = [(m, v["n"], round(v["mean"], 3), round(v["sd"], 3)) for m, v in s["macro_record"].items()]
    return spark.createDataFrame(rows, "metric string, n long, mean double, sd double")


@query("""WITH a AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, epoch(l_shipdate) / 86400.0 AS s, epoch(l_shipdate) / 86400.0 + l_quantity / 10 AS e FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, epoch(l_shipdate) / 86400.0 AS s, epoch(l_shipdate) / 86400.0 + l_quantity / 10 AS e FROM lineitem WHERE l_returnflag = 'R')
SELECT a.l_suppkey AS supp, a.id AS a_id, b.id AS b_id, round((least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)), 6) AS iou FROM a JOIN b ON a.l_suppkey = b.l_suppkey AND a.s < b.e AND b.s < a.e""")
def interval_iou(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    day = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(l_shipdate AS TIMESTAMP_NTZ))") / 86400.0
    spans = li.select(F.col("l_suppkey").alias("supp"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), day.alias("start"), (day + F.col("l_quantity") / 10).alias("end"), "l_returnflag")
    out = matching.overlapping(spans.where("l_returnflag = 'A'"), spans.where("l_returnflag = 'R'"), 5.0, ["supp"])
    return out.select("supp", "a_id", "b_id", r6("iou").alias("iou"))


@query("WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') SELECT o_custkey FROM a SEMI JOIN b USING (o_custkey)")
def split_leakage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return matching.split_leakage(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE round(c_acctbal, 6) END AS balance FROM customer")
def upsert_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", r6("c_acctbal").alias("balance"))
    return provenance.upsert(c, c.where("balance < 0").withColumn("balance", F.lit(0.0)), ["c_custkey"])


# --- statistics ---------------------------------------------------------------------------------------

_UNITS = "u AS (SELECT c_mktsegment AS grp, o_custkey AS unit, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def _measurements(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("grp"), F.col("o_custkey").alias("unit_id"), F.col("o_totalprice").alias("value"))


@query("WITH " + _UNITS + " SELECT grp, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd FROM u GROUP BY grp")
def unit_means_compare(spark, sf_dir):
    m = stats.group_moments(stats.unit_means(_measurements(spark, sf_dir)))
    return m.select("grp", "n", r6("mean").alias("mean"), r6("median").alias("median"), r6(F.sqrt("variance")).alias("sd"))


@query("WITH " + _UNITS + """, m AS (SELECT grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM u WHERE grp IN ('BUILDING', 'MACHINERY') GROUP BY grp), a AS (SELECT * FROM m WHERE grp = 'BUILDING'), b AS (SELECT * FROM m WHERE grp = 'MACHINERY')
SELECT a.n AS n_a, b.n AS n_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS welch_t, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 6) AS welch_df,
round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS cohens_d FROM a, b""")
def welch_t(spark, sf_dir):
    c = stats.compare_groups(_measurements(spark, sf_dir), "BUILDING", "MACHINERY")
    return c.select("n_a", "n_b", r6("welch_t").alias("welch_t"), r6("welch_df").alias("welch_df"), r6("cohens_d").alias("cohens_d"))


@query("""WITH v AS (SELECT event_type AS grp, value FROM events WHERE event_type IN ('click', 'view')), k AS (SELECT grp, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM v)
SELECT round(sum(r) FILTER (grp = 'click') - count(*) FILTER (grp = 'click') * (count(*) FILTER (grp = 'click') + 1) / 2.0, 6) AS mann_whitney_u, count(*) FILTER (grp = 'click') AS n_a, count(*) FILTER (grp = 'view') AS n_b FROM k""")
def mann_whitney_u(spark, sf_dir):
    v = table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), "value")
    return stats.rank_sums(v, "click", "view").select(r6("mann_whitney_u").alias("mann_whitney_u"), "n_a", "n_b")


@query("""WITH p AS (SELECT event_id AS test_id, value / (SELECT max(value) + 1 FROM events) AS p FROM events), k AS (SELECT *, row_number() OVER (ORDER BY p, test_id) AS r, count(*) OVER () AS n FROM p)
SELECT test_id, round(least(min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_adjusted FROM k""")
def benjamini_hochberg(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = e.agg((F.max("value") + 1).alias("m"))
    tests = e.join(F.broadcast(top)).select(F.col("event_id").alias("test_id"), (F.col("value") / F.col("m")).alias("p_value"))
    return stats.benjamini_hochberg(tests).select("test_id", r6("p_adjusted").alias("p_adjusted"))


@query()
def record_bootstrap(spark, sf_dir):
    m = stats.unit_means(_measurements(spark, sf_dir)).groupBy("unit_id").agg(F.avg("value").alias("value"))
    return stats.record_bootstrap(m, "value", "unit_id")


@query("""WITH e AS (SELECT l_returnflag, (epoch(l_shipdate) / 86400.0 - epoch(o_orderdate) / 86400.0) * 1000.0 AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_returnflag, count(e) AS n, round(avg(e), 4) AS signed_mean_ms, round(median(e), 4) AS signed_median_ms, round(stddev_samp(e), 4) AS signed_sd_ms, round(avg(abs(e)), 4) AS absolute_mean_ms, round(median(abs(e)), 4) AS absolute_median_ms, round(quantile_cont(abs(e), 0.95), 4) AS absolute_p95_ms, round(max(abs(e)), 4) AS absolute_max_ms FROM e GROUP BY 1""")
def boundary_errors(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    day = lambda c: F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))") / 86400.0
    pairs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_returnflag", day("l_shipdate").alias("found"), day("o_orderdate").alias("ref"), F.lit(1.0).alias("fs_hz"))
    b = stats.boundary_errors(pairs, "found", "ref", keys=["l_returnflag"])
    return b.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("signed_mean_ms", "signed_median_ms", "signed_sd_ms", "absolute_mean_ms", "absolute_median_ms", "absolute_p95_ms", "absolute_max_ms")])


# --- labels and scores ------------------------------------------------------------------------------------

_SCORED = "s AS (SELECT l.doc_id, source, quality AS label, n_chars / (SELECT max(n_chars) + 1.0 FROM documents) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _scored(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    top = d.agg((F.max("n_chars") + 1.0).alias("m"))
    joined = labels.join(d.select("doc_id", "source", "n_chars"), "doc_id").join(F.broadcast(top))
    return joined.select("doc_id", "source", F.col("quality").alias("label"), (F.col("n_chars") / F.col("m")).alias("score"))


@query("WITH " + _SCORED + ", k AS (SELECT score, sum(label) AS n FROM s GROUP BY score), c AS (SELECT score, sum(n) OVER (ORDER BY score DESC) / (SELECT sum(label) FROM s) AS recall FROM k) SELECT round(max(score), 9) AS threshold FROM c WHERE recall >= 0.9")
def threshold_for_recall(spark, sf_dir):
    t = candidates.threshold_for_recall(_scored(spark, sf_dir).withColumnRenamed("score", "probability"), 0.9)
    return t.select(F.round("threshold", 9).alias("threshold"))


@query("WITH " + _SCORED + " SELECT label, CAST(score < 0.5 AS INTEGER) AS prediction, count(*) AS n FROM s GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return stats.confusion(_scored(spark, sf_dir).withColumn("prediction", (F.col("score") < 0.5).cast("int")))


@query("WITH " + _SCORED + """, p AS (SELECT label, CAST(score < 0.5 AS INTEGER) AS said FROM s), c AS (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT said FROM p),
k AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS sup, (SELECT count(*) FROM p WHERE said = c) AS said, (SELECT count(*) FROM p WHERE said = c AND label = c) AS hit FROM c)
SELECT round(sum(hit) / sum(sup), 6) AS accuracy, round(avg(hit / nullif(sup, 0)), 6) AS balanced_accuracy, round(avg(2 * hit / (sup + said)), 6) AS macro_f1, round(sum(2 * hit / (sup + said) * sup) / sum(sup), 6) AS weighted_f1 FROM k""")
def classification_scores(spark, sf_dir):
    s = stats.classification_scores(_scored(spark, sf_dir).withColumn("prediction", (F.col("score") < 0.5).cast("int")))
    return s.select(*[r6(c).alias(c) for c in s.columns])


@query("WITH " + _SCORED + ", k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS roc_auc FROM k")
def roc_auc(spark, sf_dir):
    return stats.roc_auc(_scored(spark, sf_dir)).select(r6("roc_auc").alias("roc_auc"))


@query("WITH " + _SCORED + ", r AS (SELECT source AS recording_id, avg(label) AS rate FROM s GROUP BY source) SELECT recording_id, round(rate, 6) AS rate, CAST(least(2, floor((row_number() OVER (ORDER BY rate, recording_id) - 1) * 3.0 / count(*) OVER ())) AS INTEGER) AS stratum FROM r")
def record_strata(spark, sf_dir):
    s = learning.record_strata(_scored(spark, sf_dir).withColumnRenamed("source", "recording_id"))
    return s.select("recording_id", r6("rate").alias("rate"), "stratum")


# --- vectors as signals -----------------------------------------------------------------------------------

_SOFT = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), x AS (SELECT vec_id, list_transform(e, lambda y: exp(y - list_max(e))) AS x FROM v), p AS (SELECT vec_id, list_transform(x, lambda y: y / list_sum(x)) AS p FROM x)"


@query("WITH " + _SOFT + " SELECT vec_id, round(-list_sum(list_transform(p, lambda y: y * ln(least(greatest(y, 1e-9), 1.0)))), 6) AS uncertainty, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS predicted, round(list_max(p), 6) AS confidence FROM p")
def entropy_rank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", softmax("embedding").alias("p"))
    return e.select("vec_id", r6(entropy("p")).alias("uncertainty"), argmax("p").alias("predicted"), r6(F.array_max("p")).alias("confidence"))


@query()
def two_stage_detection(spark, sf_dir):
    """Second stage trained against stricter peaks of the same signals, then applied to all."""
    s = signals(spark, sf_dir)
    strict = detection.detect_peaks(s, prominence_factor=2.0).where("r_index IS NOT NULL")
    rows = learning.candidate_training_rows(s, strict, 64.0, 0.02)
    model, meta = learning.fit_suppressor(rows, 0.95)
    return learning.detect_two_stage(s, model, meta["threshold"], recovery=True)


@query()
def group_benchmark(spark, sf_dir):
    """Group-safe cross-validation of document features by source."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    feats = F.array(F.log1p(n), (F.length(F.regexp_replace(text, "[^#*$%&]", "")) / n), (F.length(F.regexp_replace(text, "[^A-Z]", "")) / n), F.size(F.split(text, "\n")) / n)
    rows = labels.join(d, "doc_id").select(F.col("source").alias("group_id"), F.col("quality").cast("string").alias("label"), feats.alias("features"))
    return learning.benchmark(rows)[1]


# --- validation, annotations, provenance --------------------------------------------------------------------


@query("""WITH {SERIES}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS dt FROM series), a AS (SELECT user_id, count(*) AS n, count(*) FILTER (dt <= 0) AS bad, max(t) - min(t) AS dur, stddev_pop(dt) AS sd, median(dt) AS m, median(dt) FILTER (dt > 0) AS mp FROM d GROUP BY user_id)
SELECT user_id, n AS n_samples, round(dur, 6) AS duration_s, round(1 / mp, 6) AS fs_hz, n >= 2 AND bad = 0 AND dur > 0 AS valid, CAST(CASE WHEN round(1 / mp, 6) < 10 THEN 1 ELSE 0 END + CASE WHEN sd > greatest(0.01 * m, 1e-12) THEN 1 ELSE 0 END AS INTEGER) AS n_warnings FROM a""")
def validate_series(spark, sf_dir):
    s = series(spark, sf_dir).select("user_id", "sample_index", "time_s", "value")
    v = validation.validate_series(s, "time_s", ["user_id"])
    return v.select("user_id", "n_samples", r6("duration_s").alias("duration_s"), "fs_hz", "valid", F.size("warnings").alias("n_warnings"))


@query("""WITH {SERIES}, n AS (SELECT *, floor(value) AS v FROM series), k AS (SELECT user_id, v >= 0 AND coalesce(v > lag(v) OVER (PARTITION BY user_id ORDER BY i), true) AS ok FROM n)
SELECT user_id, count(*) FILTER (NOT ok) AS n_bad, count(*) FILTER (NOT ok) = 0 AS valid FROM k GROUP BY user_id""")
def strict_indices(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("v", F.floor("value"))
    return validation.strict_indices(s, "v", ["user_id"], "sample_index")


@query("""WITH {SERIES}, a AS (SELECT user_id, event_id, event_type, t, value / 100 AS confidence FROM series)
SELECT event_id AS id, CAST(CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 1 ELSE 0 END + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS n_errors FROM a""")
def annotation_validate(spark, sf_dir):
    s = series(spark, sf_dir)
    null = F.lit(None).cast("double")
    a = s.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("label"), F.lit("ecg").alias("channel"), F.lit("point").alias("type"), null.alias("start"), null.alias("end"), F.col("time_s").alias("time"),
        (F.col("value") / 100).alias("confidence"), F.when(F.col("event_type") == "error", "broken").otherwise("accepted").alias("status"),
    )
    return a.select("id", F.size(validation.annotation_errors()).alias("n_errors"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    return annotations.status_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("status")))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS file_id FROM documents")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", file_id("text").alias("file_id"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)) AS n_finite FROM events GROUP BY 1")
def finite_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(is_finite("value")).alias("n_finite"))


@query("SELECT c_custkey, CASE WHEN substr(md5(CAST(c_nationkey AS VARCHAR)), 1, 1) < '4' THEN 'test' ELSE 'train' END AS part FROM customer")
def group_split(spark, sf_dir):
    """Whole groups (nations) to train or test by a hash of the group."""
    return table(spark, sf_dir, "customer").select("c_custkey", learning.hash_part("c_nationkey").alias("part"))


from . import kernel_queries, recording_queries  # noqa: E402, F401  (register their queries)
