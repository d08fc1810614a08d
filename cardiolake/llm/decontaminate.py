"""Operator 6 - benchmark decontamination, DataFrame functions only.

A window is ``n`` consecutive words of a benchmark item (the whole item if it
is shorter).  Any run of k words in a document covers a whole block of
b = (k + 1) // 2 words that starts at a multiple of b, so documents are scanned
block by block: the hash of each aligned block is looked up in the hash set of
the benchmark's b-grams, which travels with the scan.  Windows of each length have
their own b and set, so a short item adds one pass over the words and does not make
the blocks of the others shorter.  Documents with a hit keep their words; every
window start that a hit block allows is compared, word by word, with the windows of
the benchmark.  The result is exact.

Scale: one scan, no shuffle of texts.  The gram sets are sent with the tasks only
if they were counted to be at most ``SET_ROWS``; larger ones are hash-partitioned
and joined with the blocks.  Windows are broadcast only up to ``SET_ROWS`` rows,
otherwise joined by shuffle.  Hits are combined per document; the keys of
contaminated documents are broadcast up to ``SET_ROWS``, otherwise joined.

Defined results: rows are told apart by a row number, so repeated rows each get
the same result and a null doc_id is allowed; a null or empty text has no words;
very long texts are scanned whole;
an empty benchmark or table gives no hits or no rows; columns of any other name
are ignored (``decontaminate`` passes them through).  Benchmark rows without
words are ignored; a null item_id marks words as hit but is not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed pattern: what a word is, once A-Z are lower-case.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: A word and what follows it, in a text of either case.
PIECES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
SET_ROWS = 200_000


def _words(text: Column) -> Column:
    """The words; A-Z to lower case and separators to spaces in one pass, then split."""
    return F.array_remove(F.split(F.translate(text, UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS)), " "), "")


def _counted(df: DataFrame) -> int:
    return df.limit(SET_ROWS + 1).count()


def _gram(words: str, at: str, b: int) -> str:
    """SQL of the hash of ``b`` words from position ``at`` on."""
    return f"xxhash64({words}[int({at})])" if b == 1 else f"xxhash64(slice({words}, int({at}) + 1, {b}))"


def _known_blocks(hashes: Column, b: int, known: list[int]) -> Column:
    """(b, number) of the blocks of ``b`` words whose hash is known."""
    return F.filter(F.transform(hashes, lambda x, i: F.when(x.isin(known), F.struct(F.lit(b).alias("b"), i.alias("p")))), lambda c: c.isNotNull())


def _all_blocks(hashes: Column, b: int) -> Column:
    return F.transform(hashes, lambda x, i: F.struct(F.lit(b).alias("b"), i.alias("p"), x.alias("gram")))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): rows has row, doc_id, text_hash, n_words for every row of
    ``docs``; hits has row, positions (hit words) and items of those with a hit."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate", docs)
    items = (
        benchmark.select("item_id", _words(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .withColumn("k", F.least(F.size("words"), F.lit(n)))
        .select("item_id", "k", F.explode(F.expr("transform(sequence(0, size(words) - k), at -> slice(words, at + 1, k))")).alias("window"))
    )
    windows = scratch.save(items.distinct(), "windows")
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most n
    blocks_of: dict[int, list[int]] = {}
    for k in lengths:
        blocks_of.setdefault((k + 1) // 2, []).append(k)
    shifted = lambda b: f"CASE WHEN (k + 1) div 2 = {b} THEN transform(sequence(0, k - {b}), o -> named_struct('b', {b}, 'gram', {_gram('window', 'o', b)})) ELSE array() END"
    parts = ", ".join(map(shifted, blocks_of)) or "cast(array() AS array<struct<b: int, gram: bigint>>)"
    grams = scratch.save(windows.select(F.explode(F.expr(f"concat({parts})")).alias("g")).select("g.b", "g.gram").distinct(), "grams")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(_words(F.col("text")), F.array().cast("array<string>")).alias("words")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "words"
    )
    hashes = {b: F.expr(f"CASE WHEN size(words) >= {b} THEN transform(sequence(0, size(words) div {b} - 1), i -> {_gram('words', f'i * {b}', b)}) ELSE array() END") for b in blocks_of}
    none = F.array().cast("array<struct<b: int, p: int>>")
    if _counted(grams) <= SET_ROWS:
        known: dict[int, list[int]] = {b: [] for b in blocks_of}
        for r in grams.collect():
            known[r["b"]].append(r["gram"])
        found_at = [_known_blocks(h, b, known[b]) for b, h in hashes.items()]
        marked = base.select("row", "doc_id", "text_hash", "n_words", F.concat(none, *found_at).alias("blocks"), "words").withColumn("words", F.when(F.size("blocks") > 0, F.col("words")))
        marked = scratch.save(marked, "marked", wide=True)
        found = marked.where("size(blocks) > 0")
    else:
        marked = scratch.save(base, "marked", wide=True)
        every = F.concat(*[_all_blocks(h, b) for b, h in hashes.items()]) if hashes else F.array().cast("array<struct<b: int, p: int, gram: bigint>>")
        hit = marked.select("row", F.explode(every).alias("x")).select("row", "x.*").join(grams, ["b", "gram"], "left_semi")
        found = marked.join(hit.groupBy("row").agg(F.collect_set(F.struct("b", "p")).alias("blocks")), "row")
    sizes = " ".join(f"WHEN {b} THEN array({', '.join(map(str, ks))})" for b, ks in blocks_of.items())
    sizes = f"CASE x.b {sizes} END" if sizes else "cast(array() AS array<int>)"
    starts = f"array_distinct(flatten(flatten(transform(blocks, x -> transform({sizes}, k -> transform(sequence(x.p * x.b - k + x.b, x.p * x.b), s -> struct(s AS s, k AS k)))))))"
    again = found.select("row", "words", F.expr(f"filter({starts}, c -> c.s >= 0 AND c.s + c.k <= size(words))").alias("c")).select(
        "row", F.explode(F.expr("transform(c, c -> struct(c.s AS s, c.k AS k, slice(words, c.s + 1, c.k) AS window))")).alias("c")
    )
    known_windows = windows.groupBy("window").agg(F.collect_set("item_id").alias("ids"))
    if _counted(known_windows) <= SET_ROWS:
        known_windows = F.broadcast(known_windows)
    hits = scratch.save(
        again.select("row", "c.*")
        .join(known_windows, "window")
        .groupBy("row")
        .agg(
            F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(s, s + k - 1)")))).alias("positions"),
            F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items"),
        ),
        "hits",
    )
    return marked.select("row", "doc_id", "text_hash", "n_words"), hits


def _keyed(rows: DataFrame, hits: DataFrame, *values) -> DataFrame:
    """(__id, __hash, values) of contaminated rows; equal texts have equal hits."""
    return rows.join(hits, "row").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.lit(1).alias("__one"), *values).drop("__one")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (mode ``spans``) without the hit words."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode must be documents or spans, not {mode!r}")
    rows, hits = find_hits(docs, benchmark, n)
    same = lambda found: docs["doc_id"].eqNullSafe(found["__id"]) & (F.xxhash64(docs["text"]) == found["__hash"])
    if mode == "documents":
        found = Scratch(docs.sparkSession, "contaminated", docs).save(_keyed(rows, hits), "keys")
        found = F.broadcast(found) if _counted(found) <= SET_ROWS else found
        return docs.join(found, same(found), "left_anti")
    found = _keyed(rows, hits, F.first("positions").alias("__positions"))
    marked = docs.join(found, same(found), "left")
    lead = F.regexp_extract(docs["text"], r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    pieces = F.regexp_extract_all(docs["text"], F.lit(PIECES), F.lit(0))
    left = F.concat(lead, F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains(F.col("__positions"), i)), ""))
    return marked.select(*[F.when(F.col("__positions").isNull(), docs[c]).otherwise(left).alias(c) if c == "text" else docs[c] for c in docs.columns])


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract query: hits of 10-word benchmark windows in every document."""
    rows, hits = find_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.coalesce(F.col("items"), F.array().cast("array<long>"))
    return rows.join(hits, "row", "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("positions").isNull(), F.lit(0)).otherwise(F.size("positions")).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"),
        F.col("positions").isNotNull().alias("contaminated"),
    )


OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORDS}'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, w[s : s + least(len(w), 10) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, s, w[s : s + k - 1] AS win
  FROM (SELECT r, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS s FROM d, lens WHERE len(w) >= k)
), hit AS (SELECT dw.r, dw.k, dw.s, bw.item_id FROM dw JOIN bw ON dw.win = bw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
