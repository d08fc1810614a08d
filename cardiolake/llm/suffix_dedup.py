"""Operator 1 - repeated passages by a sparse suffix array.

A passage is a run of at least ``LEAST`` words (runs without white space, A-Z
lower-cased) that occurs in another document too.  Of all suffixes only those at
minimisers are retained: positions whose ``GRAM``-word hash is the least among
``LEAST - GRAM + 1`` neighbours, so every passage holds at least one, chosen by
its own content.  Retained suffixes carry
``REACH`` word codes to either side and are sorted by their words from the gram to
the right, then to the left.  Each is compared with its neighbours, the nearest suffix
of another document before and after it: their common words to the right are extended
by those to the left, and ``LEAST`` words or more are a repeated run.  The same is done
in the order of the words to the left.  Neighbours in one order share the most words on
that side, so they also bound what any other document can share; only where that bound
leaves runs open (the best partner on one side need not be the best on the other)
are these runs of ``LEAST`` words compared by their hashes.  A match longer than the
codes has further minimisers; spans of one document that overlap are joined, so
passages of any length come out whole.  ``match_counts`` tells what each part finds.

Scale: one hash per minimiser is counted first (partial aggregation), and only
suffixes whose hash occurs twice are made.  While the repeated hashes fit a bit table
of ``TABLE_BITS`` bits at eight bits each, the table goes with the scan (a false yes
costs a row, never a result); more of them are joined with the hashes of all
minimisers, and the places found with the texts.  Suffixes are
range-partitioned by the sort key with the document as the last column, so a
passage in a third of all documents spreads over many tasks, and are streamed
in order.  All suffixes of one hash are compared at once in memory; those of a
hash that goes over a partition's edge or fills more than ``CHUNK`` rows are
compared in pieces: neighbours inside a piece as ever, and the different runs that
sorted neighbours allow are counted over all pieces by a second aggregation.  Word codes have 32 bits, hashes of runs 64 beside those of the gram.

Defined results: null, empty and shorter texts have no spans; very long texts count
whole; rows with one
doc_id are one document and do not repeat each other; rows without doc_id are
ignored; equal hashes of neighbouring grams (ties) are all minimisers; empty tables give empty results; other columns are ignored
(``cut_repeats`` passes them through).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, arrow_batches, ascii_lower, width, window_hashes, word_hashes

LEAST, GRAM = 50, 20
SPAN = LEAST - GRAM + 1  # grams per minimiser window
REACH = LEAST - GRAM
TABLE_BITS = 1 << 26
TEXTS = 500  # texts of an Arrow batch
CHUNK = 10_000  # suffixes of one hash that are compared at once
_WORDS = re.compile(WORD)


def _hashes(text: str | None, cache: dict) -> np.ndarray:
    words = _WORDS.findall(ascii_lower(text)) if text else []
    return word_hashes(words, cache) if len(words) >= LEAST else np.empty(0, dtype=np.uint64)


def _sliding(x: np.ndarray, w: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """Least (or largest) of every ``w`` neighbours, from running values inside blocks of ``w``."""
    blocks = np.append(x, np.full(-len(x) % w, fill, dtype=x.dtype)).reshape(-1, w)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - w + 1
    return pick(behind[:m], ahead[w - 1 : w - 1 + m])


def minimisers(grams: np.ndarray) -> np.ndarray:
    """Positions whose hash is the least of some ``SPAN`` neighbours (all of equal ones)."""
    if len(grams) < SPAN:
        return np.empty(0, dtype=np.int64)
    least = _sliding(grams, SPAN, np.minimum, 2**64 - 1)
    edge = np.zeros(SPAN - 1, dtype=np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), SPAN, np.maximum, 0) == grams)


def _keys(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            got = []
            for text in batch.column(0).to_pylist():
                grams = window_hashes(_hashes(text, cache), GRAM)
                got.append(grams[minimisers(grams)])
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], names=["key"])

    return docs.select("text").mapInArrow(run, "key long")


def _bit_table(twice: DataFrame, n: int) -> np.ndarray:
    """Bits of the ``n`` keys of ``twice``, at most ``TABLE_BITS``."""
    bits = 1 << 16
    while bits < 8 * n:
        bits *= 2
    bit = F.shiftrightunsigned("key", 20).bitwiseAND(bits - 1)
    words = twice.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, int(shiftrightunsigned(key, 20) & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(bits // 64, dtype=np.int64)
    got = words.toArrow()  # at most TABLE_BITS / 64 rows
    table[got["w"].to_numpy()] = got["b"].to_numpy()
    return table.view(np.uint64)


SUFFIX_SCHEMA = "key long, right binary, left binary, doc_id long, at int"


class _SuffixRows:
    """Collects the suffixes of documents into one Arrow batch."""

    def __init__(self):
        self.keys, self.right, self.left, self.ids, self.ats = [], [], [], [], []

    def add(self, doc_id: int, h: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
        # 32-bit codes (0 is "no word"), big-endian so that bytes sort like codes.
        none = np.zeros(REACH, np.uint32)
        code = np.concatenate([none, np.maximum((h >> np.uint64(24)).astype(np.uint32), np.uint32(1)), none]).astype(">u4")
        r = np.lib.stride_tricks.sliding_window_view(code, REACH)
        self.keys.append(key.view(np.int64))
        self.right += [x.tobytes() for x in r[at + REACH + GRAM]]
        self.left += [x[::-1].tobytes() for x in r[at]]
        self.ids += [doc_id] * len(at)
        self.ats.append(at)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(self.keys)), pa.array(self.right, pa.binary()), pa.array(self.left, pa.binary()), pa.array(self.ids, pa.int64()), pa.array(np.concatenate(self.ats).astype(np.int32))],
            names=[c.split()[0] for c in SUFFIX_SCHEMA.split(", ")],
        )


def _suffixes(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """Suffixes at the minimisers whose hash the bit table has."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        bits = shared.value
        mask = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            rows = _SuffixRows()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = _hashes(text, cache)
                grams = window_hashes(h, GRAM)
                at = minimisers(grams)
                key = grams[at]
                slot = (key >> np.uint64(20)) & mask
                keep = (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                if keep.any():
                    rows.add(doc_id, h, at[keep], key[keep])
            if rows.ids:
                yield rows.batch()

    return _identified(docs).mapInArrow(run, SUFFIX_SCHEMA)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")


def _suffixes_joined(docs: DataFrame, twice: DataFrame) -> DataFrame:
    """Suffixes at the minimisers whose hash is in ``twice``, however many those are."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            ids, keys, ats = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = window_hashes(_hashes(text, cache), GRAM)
                at = minimisers(grams)
                ids += [doc_id] * len(at)
                ats.append(at)
                keys.append(grams[at])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ats).astype(np.int32))], names=["doc_id", "key", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            rows = _SuffixRows()
            for doc_id, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                h = _hashes(text, cache)
                grams = window_hashes(h, GRAM)
                at = np.intersect1d(np.asarray(at, dtype=np.int64), minimisers(grams))
                if len(at):
                    rows.add(doc_id, h, at, grams[at])
            if rows.ids:
                yield rows.batch()

    own = _identified(docs)
    hit = own.mapInArrow(places, "doc_id long, key long, at int").join(twice, "key", "left_semi")
    return own.join(hit.groupBy("doc_id").agg(F.collect_list("at").alias("ats")), "doc_id").select("doc_id", "text", "ats").mapInArrow(run, SUFFIX_SCHEMA)


class _Block:
    """Consecutive suffixes in sorted order, as arrays."""

    def __init__(self, key, right, left, doc, at):
        self.key, self.right, self.left, self.doc, self.at = key, right, left, doc, at

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Block:
        codes = lambda i: np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=">u4").reshape(-1, REACH)
        plain = lambda i: batch.column(i).to_numpy(zero_copy_only=False)
        return cls(plain(0), codes(1), codes(2), plain(3), plain(4))

    def __len__(self):
        return len(self.key)

    def pick(self, which) -> _Block:
        return _Block(self.key[which], self.right[which], self.left[which], self.doc[which], self.at[which])

    def then(self, other: _Block) -> _Block:
        return _Block(*(np.concatenate([a, b]) for a, b in zip(vars(self).values(), vars(other).values())))


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Hashes of the first 0..``REACH`` codes of every row, one row a length."""
    out = np.zeros((REACH + 1, len(codes)), dtype=np.uint64)
    for i in range(REACH):
        out[i + 1] = out[i] * np.uint64(0xD1342543DE82EF93) + codes[:, i]
    return out


def _beside(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest row of another document and the same key before and after every row, -1 for none."""
    ends = np.append(np.flatnonzero((key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) + 1, len(key))
    sizes = np.diff(ends, prepend=0)
    before, after = np.repeat(ends - sizes - 1, sizes), np.repeat(ends, sizes)
    after[after == len(key)] = -1
    for x in (before, after):
        x[key[x] != key] = -1
    return before, after


def _common(codes: np.ndarray, n_words: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Leading words that every row shares with row ``other``, 0 where that is -1."""
    rows = np.flatnonzero(other >= 0)
    same = codes[rows] == codes[other[rows]]
    out = np.zeros(len(codes), dtype=np.int64)
    out[rows] = np.minimum(np.where(same.all(axis=1), REACH, same.argmin(axis=1)), n_words[rows])
    return out


class _Found:
    """What is known of the suffixes of a block.

    ``back`` and ``on``: words before and after the gram of the span found, -1 for none.
    A run is named by its words before the gram; only ``low`` to ``high`` can be repeated.
    """

    def __init__(self, block: _Block):
        self.block = block
        self.n_left, self.n_right = (block.left != 0).sum(axis=1), (block.right != 0).sum(axis=1)
        self.back, self.on = (np.full(len(block), -1, dtype=np.int64) for _ in range(2))
        self.low, self.high = REACH - self.n_right, self.n_left.copy()

    def compare(self, order: np.ndarray, leftwards: bool, split: np.ndarray) -> None:
        """Compare the rows ``order``, sorted in one direction, with their neighbours."""
        b = self.block.pick(order)
        n_left, n_right = self.n_left[order], self.n_right[order]
        before, after = _beside(b.key, b.doc)
        most = np.zeros(len(order), dtype=np.int64)
        for other in (before, after):
            back, on = _common(b.left, n_left, other), _common(b.right, n_right, other)
            hit = back + on >= REACH
            rows = order[hit]
            self.back[rows], self.on[rows] = np.maximum(self.back[rows], back[hit]), np.maximum(self.on[rows], on[hit])
            most = np.maximum(most, back if leftwards else on)
        # The neighbours of a piece's outer rows may stand in another piece.
        bound = ~(split[order] & ((before < 0) | (after < 0)))
        rows = order[bound]
        if leftwards:
            self.high[rows] = np.minimum(self.high[rows], most[bound])
        else:
            self.low[rows] = np.maximum(self.low[rows], REACH - most[bound])

    def possible(self) -> np.ndarray:
        return self.low <= self.high

    def open(self) -> np.ndarray:
        """Rows with runs that may be repeated and hold words outside the span found."""
        return self.possible() & ((self.low < REACH - self.on) | (self.high > self.back))

    def runs(self, rows: np.ndarray):
        """(row, words before the gram, hash) of the possible runs of ``rows``."""
        b = self.block.pick(rows)
        with np.errstate(over="ignore"):
            h = _prefixes(b.left) * np.uint64(0x9E3779B97F4A7C15) + _prefixes(b.right)[::-1] * np.uint64(0xBF58476D1CE4E5B9)
            h += b.key.view(np.uint64)
        back = np.arange(REACH + 1)[:, None]
        back, at = np.nonzero((back >= self.low[rows]) & (back <= self.high[rows]))
        return rows[at], back, h[back, at]


MATCH_SCHEMA = "doc_id long, start long, end long, key long, run long, low long, high long, part int"
NEIGHBOURS, REMAINDER, PIECES = 0, 1, 2  # what found a match


def _as_rows(part: int, *columns) -> pa.RecordBatch:
    """``MATCH_SCHEMA`` from its columns, None for nulls."""
    n = next(len(c) for c in columns if c is not None)
    arrays = [pa.nulls(n, pa.int64()) if c is None else pa.array(np.ascontiguousarray(c).astype(np.int64, copy=False)) for c in columns]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(n, part, dtype=np.int32))], names=[c.split()[0] for c in MATCH_SCHEMA.split(", ")])


def _leftwards(block: _Block, rows: np.ndarray) -> np.ndarray:
    """``rows`` by key, words to the left, words to the right and document."""
    part = block.pick(rows)
    name = np.ascontiguousarray(np.concatenate([part.left, part.right], axis=1), dtype=">u4")
    return rows[np.lexsort((part.doc, name.view(f"S{4 * name.shape[1]}").ravel(), part.key))]


def _compared(block: _Block, split: bool) -> Iterator[pa.RecordBatch]:
    """Matches with two documents or more in ``block``, which is sorted.

    ``split``: the first key has suffixes elsewhere too, so its different runs come
    with their least and largest document, and with their place if that is one document.
    """
    if not len(block):
        return
    starts = np.concatenate([[0], np.flatnonzero(block.key[1:] != block.key[:-1]) + 1])
    several = np.minimum.reduceat(block.doc, starts) < np.maximum.reduceat(block.doc, starts)
    several[0] |= split
    sizes = np.diff(np.append(starts, len(block)))
    n_split = int(sizes[0]) if split else 0
    block = block.pick(np.repeat(several, sizes))
    if not len(block):
        return
    rows = np.arange(len(block))
    in_pieces = rows < n_split
    group = np.cumsum(np.append(0, block.key[1:] != block.key[:-1]))
    left_open = lambda: rows[found.possible() & (in_pieces | np.isin(group, group[found.open()]))]
    found = _Found(block)
    found.compare(rows, False, in_pieces)
    rest = left_open()
    if len(rest):
        found.compare(_leftwards(block, rest[~in_pieces[rest]]), True, in_pieces)
        rest = left_open()
    x = np.flatnonzero(found.back >= 0)
    if len(x):
        yield _as_rows(NEIGHBOURS, block.doc[x], block.at[x] - found.back[x], block.at[x] + GRAM + found.on[x], None, None, None, None)
    if not len(rest):
        return
    row, back, h = found.runs(rest)
    order = np.argsort(h)
    row, back, h = row[order], back[order], h[order]
    starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
    doc = block.doc[row]
    low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
    hit = np.repeat(low < high, np.diff(np.append(starts, len(h))))
    new = hit & ((back > found.back[row]) | (REACH - back > found.on[row]))
    if new.any():
        least, most = np.full(len(block), REACH + 1), np.full(len(block), -1)
        np.minimum.at(least, row[new], back[new])
        np.maximum.at(most, row[new], back[new])
        x = np.flatnonzero(most >= 0)
        yield _as_rows(REMAINDER, block.doc[x], block.at[x] - most[x], block.at[x] - least[x] + LEAST, None, None, None, None)
    if not n_split:
        return
    once = starts[(low < high) & (row[starts] < n_split)]
    if len(once):
        k = np.searchsorted(starts, once)
        yield _as_rows(PIECES, None, None, None, block.key[row[once]], h[once].view(np.int64), low[k], high[k])
    alone = np.flatnonzero(~hit & (row < n_split))
    if len(alone):
        start = block.at[row[alone]] - back[alone]
        yield _as_rows(PIECES, doc[alone], start, start + LEAST, block.key[row[alone]], h[alone].view(np.int64), doc[alone], doc[alone])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream sorted suffixes: spans, and the runs of keys that are not seen whole."""
    held, split = None, True  # the partition's first and last key may go on in its neighbours
    for batch in batches:
        if not batch.num_rows:
            continue
        block = _Block.of(batch)
        if held is not None:
            block = held.then(block)
        new = np.flatnonzero(block.key[1:] != block.key[:-1]) + 1
        if len(new):
            yield from _compared(block.pick(slice(0, int(new[-1]))), split)
            split = False
        held = block.pick(slice(int(new[-1]) if len(new) else 0, None))
        if len(held) >= CHUNK:
            yield from _compared(held, True)
            held, split = None, True
    if held is not None:
        yield from _compared(held, True)


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, part): words around each suffix that another document has, and what found them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix", docs)
    with arrow_batches(spark, TEXTS):
        twice = scratch.save(_keys(docs).groupBy("key").count().where("count > 1").select("key"), "twice")
        n = twice.count()
        suffixes = scratch.save(_suffixes(docs, _bit_table(twice, n)) if 8 * n <= TABLE_BITS else _suffixes_joined(docs, twice), "suffixes", wide=True)
    scratch.drop(twice)
    parts, order = max(int(spark.conf.get("spark.sql.shuffle.partitions")), width(spark, suffixes)), ["key", "right", "left", "doc_id", "at"]
    found = scratch.save(suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_scan, MATCH_SCHEMA), "matches", wide=True)
    scratch.drop(suffixes)
    runs = found.where("run IS NOT NULL")
    again = runs.groupBy("key", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("key", "run")
    apart = runs.where("doc_id IS NOT NULL").join(again, ["key", "run"]).select("doc_id", "start", "end", "part")
    return found.where("run IS NULL").select("doc_id", "start", "end", "part").unionByName(apart)


def match_counts(docs: DataFrame) -> DataFrame:
    """(part, n_matches): suffixes matched by sorted neighbours, by hashes of the runs these leave open, and runs matched over pieces."""
    name = F.element_at(F.array(*(F.lit(x) for x in ("neighbours", "remainder", "pieces"))), F.col("part") + 1)
    return matches(docs).groupBy(name.alias("part")).agg(F.count("*").alias("n_matches"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): passages that occur in another document, end exclusive."""
    every = matches(docs).select("doc_id", "start", "end")
    # Overlapping matches of a document become one span.
    by_start = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new = every.distinct().withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    numbered = new.withColumn("span", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("doc_id", "span").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    return joined.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def cut_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of ``spans`` (and the white space after each)."""
    per_doc = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("__cut")).withColumnRenamed("doc_id", "__id")
    pieces = F.regexp_extract_all(docs["text"], F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    lead = F.regexp_extract(docs["text"], r"^[\x20\x09-\x0D]*", 0)
    left = F.concat(lead, F.array_join(F.filter(pieces, lambda _, i: ~F.exists("__cut", lambda c: (i >= c["start_word"]) & (i < c["end_word"]))), ""))
    marked = docs.join(per_doc, docs["doc_id"] == per_doc["__id"], "left")
    return marked.select(*[F.when(F.col("__cut").isNull(), docs[c]).otherwise(left).alias(c) if c == "text" else docs[c] for c in docs.columns])


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or more in every document."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
