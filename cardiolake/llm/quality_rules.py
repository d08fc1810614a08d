"""Operator 10 - quality rules with risk-controlled thresholds.

Every document gets fixed base measures and, from them, rule scores in steps of
1/``GRID`` (the higher, the worse).  Labelled rows that pass the base rule choose
the cutoffs, stratum by stratum, by a proposal and an exact test (learn, then test):

* proposal: on all bad rows and on the good ones of a quarter of the ids (by hash)
  every rule gets the cutoff that rejects most bad rows, less ``cost`` times the
  good ones (counted fourfold); on ties the most lenient, and none if the gain is
  below 1 % of the bad rows (2 at least).  The rules then stand in a *path*, largest
  gain first, each coming down to its cutoff in four steps; every step rejects
  what the step before rejects and more.
* test: on the other good rows, the holdout, the steps are tested in that order.
  A step passes if the exact binomial (Clopper-Pearson) upper bound of the share of
  good documents that its rules *together* reject is at most ``risk``.  Testing
  stops at the first failure (a fixed sequence, so a stratum needs no correction of
  its own) and the last step passed is the verdict.  The level ``delta`` is divided
  by the number of tested strata (Bonferroni).

So with probability 1 - ``delta`` no stratum loses more than ``risk`` of its good
documents to the rules.  A stratum whose holdout is too small to certify anything
(``testable``; this looks at the numbers of good rows alone) has no rules and does
not count as a test: with the defaults 149 holdout rows are enough for one stratum,
217 each for four.  Every row carries its stratum's holdout size, bound and the
number of rules in force, so that "nothing certified" is stated, not silent.

Scale: one scan in Arrow batches; the labelled rows become a histogram of at
most strata x rules x (GRID + 1) x 3 counts and then one count a stratum and step.
All labelled rows count.  The chosen cutoffs, a row a certified stratum, are joined
with the documents (broadcast up to ``PLAN_ROWS`` strata).

Defined results: null and empty texts have measures 0 and fail the base rule; very
long texts are measured whole; repeated rows are judged alike; a document labelled
both good and bad is not used; null doc_ids are allowed and have no label; a null
stratum is one of its own; empty tables give empty results; columns of other names
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, window_hashes, word_hashes

GRID = 200
STEPS = 4  # of a rule on its way from "never" to its proposed cutoff
PROPOSAL = 4  # one id in so many (by hash) proposes, the others test
PLAN_ROWS = 10_000
RULES = ("symbols", "repeats", "dup_lines", "upper", "marks")
_WORDS = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-Z]")
_MARKS = re.compile(r"[!?]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def repeat_words(h: np.ndarray, n: int = 8) -> int:
    """Words inside ``n``-word windows found twice or more, first included."""
    w = window_hashes(h, n)
    if len(w) < 2:
        return 0
    _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[: len(h)] > 0).sum())


def measure(text: str | None, cache: dict) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one whole text."""
    if not text:
        return (0,) * len(MEASURES)
    words = _WORDS.findall(text)
    lines = Counter(line for line in text.split("\n") if _WORDS.search(line))
    n_lines = sum(lines.values())
    return (
        len(words),
        sum(map(len, words)),
        len(_SYMBOLS.findall(text)),
        n_lines - len(lines),
        repeat_words(word_hashes(words, cache)),
        n_lines,
        len(_UPPER.findall(text)),
        len(_MARKS.findall(text)),
    )


def measure_documents(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep`` columns and the measures of every row."""
    schema = f"{docs.select('doc_id', *keep).schema.simpleString()[7:-1]},{','.join(f'{m}:bigint' for m in MEASURES)}".replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, max(1, batch.num_rows), 1000)):
                got = np.asarray([measure(t, cache) for t in part.column(0).to_pylist()], dtype=np.int64).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays(part.columns[1:] + [pa.array(got[:, i]) for i in range(len(MEASURES))], names=part.schema.names[1:] + list(MEASURES))

    return docs.select("text", "doc_id", *keep).mapInArrow(run, schema)


def scores() -> dict[str, Column]:
    """Rule name -> integer score 0..GRID."""
    def share(a: Column, b: Column) -> Column:
        return F.least(F.lit(GRID), F.coalesce(F.floor(GRID * F.try_divide(a, b)), F.lit(0))).cast("int")

    chars = F.col("word_chars")
    return {
        "symbols": share(F.col("n_symbols"), chars),
        "repeats": share(F.col("n_repeat_words"), F.col("n_words")),
        "dup_lines": share(F.col("n_dup_lines"), F.col("n_lines")),
        "upper": share(F.col("n_upper"), chars),
        "marks": share(F.col("n_marks"), chars),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + t * d or tiny)
        c = 1 + t / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def upper_bound(rejected: int, n: int, level: float) -> float:
    """Clopper-Pearson upper limit of a rate at confidence 1 - ``level``."""
    if n == 0 or rejected >= n:
        return 1.0
    low, high = 0.0, 1.0  # P(X <= k | p) = 1 - I_p(k + 1, n - k) falls in p
    for _ in range(60):
        mid = (low + high) / 2
        if 1 - _beta_cdf(mid, rejected + 1, n - rejected) > level:
            low = mid
        else:
            high = mid
    return high


def labels_needed(n_strata: int, risk: float = 0.02, delta: float = 0.05) -> int:
    """Holdout rows with which a step that rejects none of them is certified."""
    return math.ceil(math.log(delta / n_strata) / math.log1p(-risk))


def testable(good: dict, risk: float, delta: float) -> set:
    """The most strata (those with most holdout rows) whose rules can be certified together."""
    by_size = sorted(good, key=good.get, reverse=True)
    return set(by_size[: max((m for m, s in enumerate(by_size, 1) if good[s] >= labels_needed(m, risk, delta)), default=0)])


def propose(histogram: dict, cost: float) -> list[dict]:
    """The path of one stratum: cutoffs {rule: cutoff} of every step, each stricter than the last.

    ``histogram``: rule -> array [GRID + 1, 2] of bad rows and of good rows that propose.
    """
    wanted = []
    for k, rule in enumerate(RULES):
        if rule not in histogram:
            continue
        above = np.cumsum(histogram[rule][::-1], axis=0)[::-1]  # score >= i
        best, cutoff = max(2.0, 0.01 * int(above[0, 0])), GRID
        for c in range(GRID - 1, -1, -1):
            gain = int(above[c + 1, 0]) - cost * PROPOSAL * int(above[c + 1, 1])
            if gain > best:
                best, cutoff = gain, c
        if cutoff < GRID:
            wanted.append((-best, k, rule, cutoff))
    path, now = [], dict.fromkeys(RULES, GRID)
    for _, _, rule, cutoff in sorted(wanted):
        for i in range(1, STEPS + 1):
            now = now | {rule: GRID - (GRID - cutoff) * i // STEPS}
            if not path or now != path[-1]:
                path.append(now)
    return path


def first_steps(path: list[dict]) -> list[list]:
    """For each rule, by score: the first step of the path that rejects it, None if none does."""
    return [[next((i for i, cutoffs in enumerate(path) if v > cutoffs[r]), None) for v in range(GRID + 1)] for r in RULES]


def certify(path: list[dict], first_rejected: np.ndarray, n: int, level: float, risk: float) -> tuple[dict | None, float | None]:
    """(cutoffs, bound) of the last step passed; ``first_rejected[i]``: holdout rows that step i is the first to reject."""
    passed, bound = None, None
    for cutoffs, lost in zip(path, np.cumsum(first_rejected)):
        upper = upper_bound(int(lost), n, level)
        if upper > risk:
            break
        passed, bound = cutoffs, upper
    return passed, bound


PLAN_SCHEMA = "__stratum string, __holdout long, __level double, __bound double, __active int, " + ", ".join(f"__cut_{r} int" for r in RULES)


def fit_rules(measured: DataFrame, labels: DataFrame, stratum: str, risk: float, delta: float, cost: float) -> list[tuple]:
    """Rows of ``PLAN_SCHEMA``, one a stratum with labelled good rows."""
    truth = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__q"), F.max("quality").alias("__q2")).where("__q = __q2")
    role = F.when(F.col("__q") <= 0, "bad").when(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(PROPOSAL)) == 0, "propose").otherwise("holdout")
    judged = (
        measured.where(~base_failed())
        .select(F.col("doc_id").alias("__id"), F.col(stratum).cast("string").alias("__s"), *[c.alias(f"__{k}") for k, c in scores().items()])
        .join(truth.select("doc_id", "__q"), F.col("__id") == F.col("doc_id"))
        .select("__s", role.alias("role"), *[f"__{k}" for k in RULES])
    )
    spark = measured.sparkSession
    judged = Scratch(spark, "quality-rules").save(judged, "judged")
    histogram: dict = {}
    melted = judged.where("role <> 'holdout'").select("__s", "role", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"__{k}").alias("v")) for k in RULES])).alias("r"))
    for r in melted.groupBy("__s", "r.rule", "r.v", "role").count().toLocalIterator():
        histogram.setdefault(r["__s"], {}).setdefault(r["rule"], np.zeros((GRID + 1, 2), dtype=np.int64))[r["v"], int(r["role"] == "propose")] += r["count"]
    paths = {s: propose(h, cost) for s, h in histogram.items()}
    table = spark.createDataFrame([(s, *first_steps(path)) for s, path in paths.items()], "__t string, " + ", ".join(f"__at_{r} array<int>" for r in RULES))
    held = judged.where("role = 'holdout'").join(F.broadcast(table) if len(paths) <= PLAN_ROWS else table, F.col("__s").eqNullSafe(F.col("__t")), "left")
    step = F.least(*[F.element_at(f"__at_{r}", F.col(f"__{r}") + 1) for r in RULES])
    counts: dict = {}
    for r in held.groupBy("__s", step.alias("step")).count().toLocalIterator():
        counts.setdefault(r["__s"], {})[r["step"]] = r["count"]
    holdout = {s: sum(c.values()) for s, c in counts.items()}
    able = testable(holdout, risk, delta)
    rows = []
    for s, n in holdout.items():
        path, cutoffs, bound, level = paths.get(s, []), None, None, None
        if s in able:
            level = delta / len(able)
            cutoffs, bound = certify(path, np.array([counts[s].get(i, 0) for i in range(len(path))], dtype=np.int64), n, level, risk)
        cutoffs = cutoffs or dict.fromkeys(RULES, GRID)
        rows.append((s, n, level, bound, sum(c < GRID for c in cutoffs.values()), *[cutoffs[r] for r in RULES]))
    return rows


def judge_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05, cost: float = 5.0) -> DataFrame:
    """doc_id, the stratum, all measures, base_failed, kept, and of the stratum: holdout
    rows (n_holdout), the certified upper bound of its false rejections by the rules
    (null where nothing is certified) and the number of rules in force (rules_active)."""
    spark = docs.sparkSession
    measured = Scratch(spark, "quality-rules").save(measure_documents(docs, stratum), "measures", wide=True)
    rows = fit_rules(measured, labels, stratum, risk, delta, cost)
    plan = spark.createDataFrame(rows, PLAN_SCHEMA)
    plan = F.broadcast(plan) if len(rows) <= PLAN_ROWS else plan
    joined = measured.join(plan, F.col(stratum).cast("string").eqNullSafe(F.col("__stratum")), "left")
    ok = F.lit(True)
    for rule, score in scores().items():
        ok = ok & (score <= F.coalesce(F.col(f"__cut_{rule}"), F.lit(GRID)))
    return joined.select(
        *measured.columns,
        base_failed().alias("base_failed"),
        (~base_failed() & ok).alias("kept"),
        F.coalesce("__holdout", F.lit(0)).cast("long").alias("n_holdout"),
        F.col("__bound").alias("risk_bound"),
        F.coalesce("__active", F.lit(0)).alias("rules_active"),
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query: measures, base rule and risk-controlled verdict of every document."""
    judged = judge_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_holdout", "risk_bound", "rules_active")
