r"""Operator 13 - source divergence audit: inclusion-exclusion over supports.

For every source of a language the distance of its term distribution from that of every
other source of the language, summed over all kept terms, and the terms it uses more than
its language.  Smoothing gives every kept term a share in every source, so a plain sum
needs sources x sources x terms.  Here the sum is split by where a term occurs:

* only in one of the two: its part depends on its count alone, so a histogram of counts
  per source prices all such terms of a source against the other's constant;
* in both: postings of the same term are joined and the histogram's two one-sided parts
  are corrected by the two-sided one;
* in neither: the number of such terms times the difference of the two constants.

With z the share of a count of 0, S the support of a source and V the kept terms:
sum = A(g, h) + A(h, g) + (V - |Sg| - |Sh|) * |zg - zh| + sum over Sg and Sh of C, where
A(g, h) = sum over counts c of (terms of g with count c) * |p_g(c) - zh| and
C = |p_g - p_h| - |p_g - zh| - |zg - p_h| + |zg - zh|.  All of it is whole numbers.

Scale: one scan of the texts, in which each task counts terms per (lang, source) in a
dictionary of bounded size and sends sums; postings are partitioned by (lang, term) and
hold one row a source, so a hot term or source has no more rows than there are sources or
terms.  The posting join is for pairs a < b and is summed by pair before its shuffle.
Histograms meet the other sources of a language under a salt, so that a language with
very many sources is no single task.  The sharpest terms are ranked by a window whose
limit of 50 Spark applies before the shuffle.  Nothing reaches the driver.

Defined results: null text, lang and source count as ''; a group without terms is listed,
with shares of constants; V = 0 gives pairs of value 0 and no terms; a language of one
source gives no pairs; ties of value rank by item in UTF-8 order; repeated rows count
again; a very long text is counted whole; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches

#: Bytes of a term: letters and all bytes above ASCII, A-Z lowered; all else divides.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Entries of a task's dictionary before it is sent on.
HELD = 200_000
LEAST_DOCS, SMOOTH, SCALE, TOP, SALTS = 30, 5, 1_000_000_000, 50, 16
COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counts and documents per (lang, source, term); a row of term '' marks a group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(terms) + 1)),
                    pa.array([source] * (len(terms) + 1)),
                    pa.array([b"", *terms], pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *map(docs.__getitem__, terms)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(langs, sources, texts):
            n, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
            before = len(n)
            found = Counter((text.as_py() or b"").translate(_TERM_BYTES).split())
            n.update(found)
            docs.update(found.keys())
            size += len(n) - before
            if size > HELD:
                yield from sent()
                size = 0
    yield from sent()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)) in whole numbers."""
    wide = lambda c: c.cast("decimal(27,0)")
    below = F.greatest(total + SMOOTH * terms, F.lit(1))
    return F.call_function("div", (n + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), wide(below)) + 1


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n) of every group's kept terms, and a row of term '' a group."""
    rows = docs.select("lang", "source", "text").mapInArrow(_counted, COUNTS)
    rows = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    everywhere = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return rows.withColumn("everywhere", everywhere).where((F.col("everywhere") >= least) | (F.col("term") == "")).select("lang", "source", "term", "n")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for each other source of the
    language, part ``term`` for the ``top`` terms whose share is above the language's."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence", docs)
    with arrow_batches(spark, 256):
        counts = scratch.save(term_counts(docs, least), "counts", wide=True)
    terms = counts.where("term <> ''")
    lang_terms = terms.groupBy("lang", "term").agg(F.sum("n").alias("n_all"))
    langs = lang_terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_all").alias("total_all"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.when(F.col("term") != "", 1)).alias("support"))
    groups = groups.join(langs, "lang", "left").withColumns({"v": F.coalesce("v", F.lit(0)), "total_all": F.coalesce("total_all", F.lit(0))})
    groups = scratch.save(groups.withColumn("z", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(0)), "groups", wide=True)
    per_group = groups.select("lang", "source", "total", "v", "total_all", "z")
    postings = scratch.save(terms.join(per_group, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v"))), "postings", wide=True)

    # One-sided terms: histograms of shares against the constants of the other sources.
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    histogram = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("other_z"), salts)
    sided = histogram.join(others, ["lang", "salt"]).where("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.col("terms") * F.abs(F.col("p") - F.col("other_z"))).alias("value"))
    low, high = F.least("source", "other"), F.greatest("source", "other")
    sided = sided.select("lang", low.alias("a"), high.alias("b"), "value")

    # Terms of both: correction of the two one-sided parts.
    a = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    b = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(gap("pa", "pb") - gap("pa", "zb") - gap("za", "pb") + gap("za", "zb")).alias("value"))

    # Constants: every pair, whatever its supports are.
    left = groups.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), F.col("support").alias("na"), "v", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int").alias("salt"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"), F.col("support").alias("nb"), salts)
    neither = left.join(right, ["lang", "salt"]).where("a < b").select("lang", "a", "b", ((F.col("v") - F.col("na") - F.col("nb")) * gap("za", "zb")).alias("value"))

    sums = sided.unionByName(both).unionByName(neither).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pair = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")

    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    shares = lang_terms.join(langs, "lang").select("lang", "term", _share(F.col("n_all"), F.col("total_all"), F.col("v")).alias("q"))
    term = postings.where("n > 0").join(shares, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(ordered)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pair, "pair").unionByName(ranked(term, "term").where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts for every (lang, source) of the documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
filled AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY lang, source) + {SMOOTH} * v) AS p FROM filled JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY lang) + {SMOOTH} * v) AS q FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM counts GROUP BY lang, term) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
listed AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed) WHERE part = 'pair' OR rank <= {TOP}
"""
