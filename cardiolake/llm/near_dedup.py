"""Operator 3 - MinHash near-dedup by a signature-coordinate inverted join.

1. Every document's set of word shingles becomes a 128-bit digest and a
   signature of ``K`` minima.  Documents of equal digest and size are one *class* at
   once, numbered by its first row.
2. Every (coordinate, value) pair is an *element*; classes are posted under
   their elements.  Two classes link only if they agree in at least ``m``
   coordinates, m being the largest count that a pair at the wanted similarity
   misses with probability below ``MISS``.  Prefix rule: with the elements of
   each class in a common order, rarest first, such pairs share one of the first
   K - m + 1, so only those are posted; elements of one class fill the prefix
   without a posting, and a class with fewer than m shared elements has none.
3. Skip rule: in a list of at most ``SMALL`` classes all are compared; in a longer
   one all are compared with its smallest member.  Agreeing coordinates are
   counted on the two signatures, pairs with m or more are confirmed on the full
   shingle sets, and components of the confirmed links are formed.  Pairs inside
   one component need no comparison.
4. Long lists with pivots of one component form a *family*.  Where a family is in several
   components, every member becomes its difference from the family's consensus
   c (shingles of more than half its members): L lost, A added.  A pair has
   |x & y| = |c| - |Lx + Ly| + |Ax & Ay|, so it links exactly if the differences
   share T = (1-t)(|Lx|+|Ly|) + t(|Ax|+|Ay|) - (1-2t)|c| shingles, t = p/(100+p).
   All are compared with the member of least difference; pairs with T <= 0 are
   then in its component.  Any other link must share a = T - min(|Lx|,|Ly|) added
   shingles, so one of any |Ax| - a + 1 of them; the rarest of the family are
   posted.  Only where a <= 0 lost shingles are posted too.
5. A list of a difference whose members are all in one component is done; one in which
   at most ``DIRECT`` members ask is compared with these.  The members of one with more
   are a family of their own, centred on their own consensus and searched like the first.
   A difference is one that at most half of its family has, so families halve at each
   step and end; lists of equal members are searched once.  No list is joined with
   itself, a family costs rows in proportion to its members' differences, and no link
   is lost.

Scale: digests, element counts and pivots are partial aggregations; hot lists are
joined on their element with tables AQE can split; families of more than ``BLOCK``
members are dealt over blocks wherever members meet their family's row; the driver
sees counts only.  A text is read a second time only if its class has a candidate
partner.

Defined results: null, empty and blank texts have no shingles, are linked with
nothing and are their own component; texts shorter than a shingle have one; very
long texts count whole (one set is held in memory); a
repeated row joins its own class; a row without doc_id gets the component of its
class, but is never the smallest; empty tables give empty results; other columns
are ignored (``near_dedup`` passes them through).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, arrow_batches, ascii_lower, window_hashes, word_hashes
from .components import connected_components

K, MISS, SMALL, DIRECT = 48, 1e-6, 8, 32
BLOCK, HOT_ROWS, TABLE_ROWS = 500, 200_000, 200_000
_WORDS = re.compile(WORD)
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**64, size=(K, 1), dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, size=(K, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def match_threshold(similarity: float, k: int = K, miss: float = MISS) -> int:
    """Largest m with P(Binomial(k, similarity) < m) <= miss."""
    total = 0.0
    for m in range(k + 1):
        total += math.comb(k, m) * similarity**m * (1 - similarity) ** (k - m)
        if total > miss:
            return m
    return k


def shingle_set(text: str | None, n: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of a whole text."""
    words = _WORDS.findall(ascii_lower(text)) if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words, cache)
    return np.unique(window_hashes(h, min(n, len(words))))


def signature(s: np.ndarray) -> np.ndarray:
    """``K`` minima of the set under as many hash functions."""
    out = np.full(K, 2**64 - 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 2000):
            np.minimum(out, ((s[None, i : i + 2000] ^ _XOR) * _ODD).min(axis=1), out=out)
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    both = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype="<i8")
    return int(both[0]), int(both[1])


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig); digest and signature are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            ids, sizes, digests, sigs = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, n, cache)
                sizes.append(len(s))
                digests.append(digest(s) if len(s) else (None, None))
                sigs.append(signature(s).tobytes() if len(s) else None)
            h1, h2 = (pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), h1, h2, pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _elements(classes: DataFrame) -> DataFrame:
    """(cid, es): the coordinate-value pairs of each class as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = (np.arange(K, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        for batch in batches:
            if batch.num_rows:
                sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u8").reshape(-1, K)
                with np.errstate(over="ignore"):
                    e = ((sigs ^ salt) * np.uint64(0xD6E8FEB86659FD93)).ravel()
                e ^= e >> np.uint64(32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(e) + 1, K, dtype=np.int32)), pa.array(e.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["cid", "es"])

    return classes.select("cid", "sig").mapInArrow(run, "cid long, es array<long>")


def _agreeing(pairs: DataFrame, m: int) -> DataFrame:
    """Pairs whose signatures agree in at least ``m`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u8").reshape(-1, K) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= m))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, set) of the wanted classes, from the texts of their smallest documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            got = [shingle_set(t, n, cache) for t in batch.column(1).to_pylist()]
            same = [len(s) > 0 and digest(s) == h for s, h in zip(got, zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in got], pa.binary())], names=["cid", "set"]).filter(pa.array(same, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), "text").join(wanted, "first_id").select("cid", "text", "h1", "h2")
    return texts.mapInArrow(run, "cid long, set binary").dropDuplicates(["cid"])


def _with(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Pairs with the ``value`` of both their classes (the pivot, ``b``, last)."""
    for side in "ab":
        pairs = pairs.join(table.select(F.col("cid").alias(side), F.col(value).alias(f"{value}_{side}")), side)
    return pairs


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, m: int, percent: int, scratch: Scratch) -> DataFrame:
    close = scratch.save(_agreeing(_with(pairs, classes, "sig"), m), "close")
    nodes = close.select(F.col("a").alias("cid")).union(close.select(F.col("b"))).distinct()
    sets = scratch.save(_sets(docs, classes.select("cid", "first_id", "h1", "h2").join(nodes, "cid", "left_semi"), n), "sets")
    links = scratch.save(_confirmed(_with(close, sets, "set"), percent), "links")
    scratch.drop(sets)
    return links


def _hot_families(families: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, blocks) of families with more than ``BLOCK`` members: how many blocks they are
    dealt in.  The larger the table, the larger a block, so at most ``HOT_ROWS`` rows."""
    sizes = scratch.save(families.groupBy("g").agg(F.count("*").alias("k")), "family-sizes")
    block = max(BLOCK, -(-(sizes.agg(F.sum("k")).first()[0] or 0) // HOT_ROWS))
    return scratch.save(sizes.where(F.col("k") > block).select("g", F.ceil(F.col("k") / block).cast("int").alias("blocks")), "hot-families")


def _beside(members: DataFrame, family: DataFrame, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Members with the one row of their family.  A hot family's row stands in each of its
    blocks and its members are dealt over them by their number, so no task has them all."""
    hot = F.broadcast(hot)
    dealt = members.join(hot, "g", "left").withColumn("block", F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    spread = family.join(hot, "g", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return dealt.join(spread, ["g", "block"], how).drop("block")


def _against_pivots(families: DataFrame, classes: DataFrame, docs: DataFrame, hot: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(g, cid, lost, added, nc) of every member against the set of its family's pivot, of size nc."""
    nodes = families.select("cid").union(families.select("g")).distinct()
    sets = scratch.save(_sets(docs, classes.select("cid", "first_id", "h1", "h2").join(nodes, "cid", "left_semi"), n), "family-sets")

    def against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost, added, size = [], [], []
            for x, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, p = np.frombuffer(x, dtype="<u8"), np.frombuffer(p, dtype="<u8")
                lost.append(np.setdiff1d(p, x, assume_unique=True).view(np.int64))
                added.append(np.setdiff1d(x, p, assume_unique=True).view(np.int64))
                size.append(len(p))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lost, longs), pa.array(added, longs), pa.array(size, pa.int64())], names=["g", "cid", "lost", "added", "nc"])

    pivots = sets.join(families.select(F.col("g").alias("cid")).distinct(), "cid").select(F.col("cid").alias("g"), F.col("set").alias("pivot_set"))
    paired = _beside(families.join(sets, "cid"), pivots, hot).select("g", "cid", "set", "pivot_set")
    raw = scratch.save(paired.mapInArrow(against_pivot, "g long, cid long, lost array<long>, added array<long>, nc long"), "raw-diffs")
    scratch.drop(sets)
    return raw


def _centred(raw: DataFrame, hot: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(g, cid, lost, added, nc, nl, na, w, kappa) of every member against its family's consensus.

    What more than half of the members lack or add corrects the set they were compared
    with to the consensus.  w and kappa are the terms of (100 + percent) T = w_x + w_y - kappa.
    """
    sizes = scratch.save(raw.groupBy("g").agg(F.count("*").alias("k")), "sizes")
    few = sizes.limit(TABLE_ROWS + 1).count() <= TABLE_ROWS
    common = {}
    for kind in ("lost", "added"):
        # Differences meet their family's size where they are counted, so that a family's many do not come together.
        counted = raw.select("g", F.explode(kind).alias("i")).groupBy("g", "i").count()
        sized = counted.join(F.broadcast(sizes), "g") if few else _beside(counted.withColumnRenamed("i", "cid"), sizes, hot).withColumnRenamed("cid", "i")
        counted = sized.where("2 * count > k")
        common[kind] = counted.groupBy("g").agg(F.collect_list("i").alias(f"all_{kind}"))
    none = F.array().cast("array<long>")
    both = _beside(raw, sizes.join(common["lost"], "g", "left").join(common["added"], "g", "left"), hot)
    lost, added, all_lost, all_added = F.col("lost"), F.col("added"), F.coalesce("all_lost", none), F.coalesce("all_added", none)
    # Against the consensus: what the majority lacks is no loss, what the majority adds and x lacks is one.
    new_lost = F.concat(F.array_except(lost, all_lost), F.array_except(all_added, added))
    new_added = F.concat(F.array_except(added, all_added), F.array_except(all_lost, lost))
    out = both.select("g", "cid", F.sort_array(new_lost).alias("lost"), F.sort_array(new_added).alias("added"), (F.col("nc") - F.size(all_lost) + F.size(all_added)).alias("nc"))
    out = out.withColumns({"nl": F.size("lost").cast("long"), "na": F.size("added").cast("long")})
    out = out.withColumns({"w": 100 * F.col("nl") + percent * F.col("na"), "kappa": (100 - percent) * F.col("nc")})
    return scratch.save(out, "diffs")


def _named(members: DataFrame, middle: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """Members with their component, that of their family's middle, and whether these differ."""
    named = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    at_mid = middle.join(labels.withColumnRenamed("node", "mid"), "mid", "left").select("g", "mid", F.coalesce("label", "mid").alias("mid_label"))
    return _beside(named, at_mid, hot).withColumn("stray", F.col("label") != F.col("mid_label"))


def _posted(named: DataFrame, hot: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(g, cid, label, nl, w, kappa, i, plus, asks): strays ask at differences that a link
    needs (``asks``), all members of families with strays answer there.

    With S = 100 + percent a link needs S * a >= w_x + w_y - kappa - S * min(nl)
    shared added shingles, which is at least w_x - kappa + percent * d for the
    least d = na - nl of the family.  Strays for which that is not positive
    (``slight``) post all their differences, lost ones included.
    """
    scale = 100 + percent
    family = named.groupBy("g").agg(F.min(F.when(F.col("stray"), F.col("w"))).alias("least_w"), F.min(F.col("na") - F.col("nl")).alias("d"))
    base = _beside(named, family.where("least_w IS NOT NULL"), hot)
    cols = ["g", "cid", "label", "nl", "w", "kappa"]
    flat = lambda df, kind, plus, asks: df.select(*cols, F.explode(kind).alias("i"), F.lit(plus).alias("plus"), F.lit(asks).alias("asks"))
    added = flat(base, "added", True, False)
    often = added.groupBy("g", "i").agg(F.count("*").alias("n"))
    strays = base.where("stray").withColumn("a", F.ceil((F.col("w") - F.col("kappa") + percent * F.col("d")) / scale))
    rare = (
        strays.where("a > 0 AND a <= na")
        .select(*cols, "na", "a", F.explode("added").alias("i"))
        .join(often, ["g", "i"])
        .groupBy(*cols, "na", "a")
        .agg(F.sort_array(F.collect_list(F.struct("n", "i"))).alias("x"))
        .select(*cols, F.explode(F.expr("slice(x, 1, int(na - a + 1))")).alias("x"))
        .where("x.n > 1")
        .select(*cols, F.col("x.i").alias("i"), F.lit(True).alias("plus"), F.lit(True).alias("asks"))
    )
    slight = strays.where("a <= 0")
    need = F.greatest(F.lit(1), F.ceil((F.col("w") + F.col("least_w") - F.col("kappa")) / scale))  # shared differences of any link with a stray
    prefix = F.greatest(F.lit(0), F.col("nl") - need + 1).cast("int")
    lost = flat(base.withColumn("lost", F.slice("lost", F.lit(1), prefix)), "lost", False, False)
    asks = scratch.save(rare.unionByName(flat(slight, "added", True, True)).unionByName(flat(slight, "lost", False, True)), "asks")
    return asks.unionByName(added).unionByName(lost)


def _lists(posted: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, i, plus, few, sub): the lists of differences that somebody asks at and several
    components are in, numbered; of lists with equal members (by 128 bits) one.  ``few``
    asks at most ``DIRECT`` members make, so their pairs are at most ``DIRECT`` a member."""
    marks = {"f1": F.bit_xor(F.xxhash64("cid", "asks")), "f2": F.bit_xor(F.xxhash64("asks", F.lit(1), "cid"))}
    facts = [F.count("*").alias("n"), F.count_if("asks").alias("asked"), F.min("label").alias("low"), F.max("label").alias("high")]
    lists = posted.groupBy("g", "i", "plus").agg(*facts, *[m.alias(k) for k, m in marks.items()]).where("asked > 0 AND low < high")
    one = lists.groupBy("g", "plus", "n", "asked", *marks).agg(F.min("i").alias("i"))
    return scratch.save(one.select("g", "i", "plus", (F.col("asked") <= DIRECT).alias("few"), F.monotonically_increasing_id().alias("sub")), "lists")


def _sharing(listed: DataFrame, percent: int) -> DataFrame:
    """Pairs of lists with few askers that may link, of different components."""
    x, y = listed.where("asks").alias("x"), listed.where("NOT asks").alias("y")
    rule = f"x.sub = y.sub AND x.label <> y.label AND (x.plus OR x.w + y.w - x.kappa <= {100 + percent} * least(x.nl, y.nl))"
    return x.join(y, F.expr(rule)).select(F.greatest("x.cid", "y.cid").alias("a"), F.least("x.cid", "y.cid").alias("b"))


def _split(members: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` whose members are in several components."""
    label = F.coalesce("label", "cid")
    seen = members.select(key, "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left").groupBy(key)
    return seen.agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low < high").select(key)


def near_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    with arrow_batches(docs.sparkSession, 500):
        return _near_components(docs, n, percent)


def _near_components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "near-dedup", docs)
    m = match_threshold(percent / 100)
    rows = scratch.save(_signed(docs, n).withColumn("row", F.monotonically_increasing_id()), "signed", wide=True)
    same_set = ["h1", "h2", "n_shingles"]
    classes = rows.where("h1 IS NOT NULL AND doc_id IS NOT NULL").groupBy(*same_set).agg(F.min("row").alias("cid"), F.min("doc_id").alias("first_id"), F.first("sig").alias("sig"))
    classes = scratch.save(classes, "classes")
    elements = scratch.save(_elements(classes).select("cid", F.explode("es").alias("e")), "elements")
    shared = scratch.save(elements.groupBy("e").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    posted = (
        elements.join(shared, "e")
        .groupBy("cid")
        .agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("es"))
        .where(F.size("es") >= m)
        .select("cid", F.explode(F.expr(f"slice(es, 1, size(es) - {m - 1})")).alias("x"))
        .select("cid", F.col("x.e").alias("e"))
    )
    posted = scratch.save(posted, "posted")
    scratch.drop(elements)
    lists = posted.groupBy("e").agg(F.count("*").alias("n"), F.min("cid").alias("pivot")).where("n > 1")
    listed = scratch.save(posted.join(scratch.save(lists, "lists"), "e"), "listed")  # no more than a join, so a hot element can be split
    scratch.drop(posted)
    # Round 1: short lists in full (at most SMALL members), long ones against their smallest member.
    long = listed.where(F.col("n") > SMALL)
    stars = long.where("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b"))
    short = listed.where(F.col("n") <= SMALL).groupBy("e").agg(F.sort_array(F.collect_list("cid")).alias("c"))
    small = short.select(F.explode(F.expr("flatten(transform(c, (x, i) -> transform(slice(c, 1, i), y -> struct(x AS a, y AS b))))")).alias("p")).select("p.a", "p.b")
    pairs = scratch.save(stars.union(small).distinct(), "pairs")
    links = _confirm(pairs, classes, docs, n, m, percent, scratch)
    labels = connected_components(links, scratch)
    # Families: long lists whose pivots are in one component, named by its smallest class.
    pivots = labels.withColumnRenamed("node", "pivot")
    families = scratch.save(long.select("pivot", "cid").distinct().join(pivots, "pivot", "left").select(F.coalesce("label", "pivot").alias("g"), "cid").distinct(), "families")
    families = scratch.save(families.join(_split(families, labels, "g"), "g"), "split-families")
    state = {"tested": pairs, "links": links, "labels": labels}

    def search(candidates: DataFrame) -> None:
        """Confirm the candidates not tested yet; their links join components."""
        known = state["tested"].select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        rest = candidates.distinct().join(known, (F.greatest("a", "b") == F.col("hi")) & (F.least("a", "b") == F.col("lo")), "left_anti")
        rest = scratch.save(rest, "rest")
        if rest.limit(1).count():
            state["tested"] = state["tested"].union(rest)
            more = _confirm(rest, classes, docs, n, m, percent, scratch)
            if more.limit(1).count():
                state["links"] = state["links"].union(more)
                state["labels"] = connected_components(state["links"], scratch)

    raw = None
    if families.limit(1).count():
        hot = _hot_families(families, scratch)
        raw = _against_pivots(families, classes, docs, hot, n, scratch)
    while raw is not None:
        diffs = _centred(raw, hot, percent, scratch)
        scratch.drop(raw)
        raw = None
        middle = scratch.save(diffs.groupBy("g").agg(F.min_by("cid", F.struct("w", "cid")).alias("mid")), "middle")
        search(_named(diffs.select("g", "cid"), middle, state["labels"], hot).where("stray").select(F.col("cid").alias("a"), F.col("mid").alias("b")))
        named = scratch.save(_named(diffs, middle, state["labels"], hot), "named")
        posted = _posted(named, hot, percent, scratch)
        lists = _lists(posted, scratch)
        listed = scratch.save(posted.join(lists, ["g", "i", "plus"]), "in-lists")
        scratch.drop(named)
        search(_sharing(listed.where("few"), percent))
        longer = listed.where("NOT few").select("g", "cid", "sub").distinct()
        longer = scratch.save(longer.join(_split(longer, state["labels"], "sub"), "sub"), "longer")
        if longer.limit(1).count():
            raw = scratch.save(diffs.join(longer, ["g", "cid"]).select(F.col("sub").alias("g"), "cid", "lost", "added", "nc"), "raw-diffs")
            hot = _hot_families(raw.select("g", "cid"), scratch)
        for done in (diffs, listed, longer):
            scratch.drop(done)
    labels = state["labels"]
    labelled = classes.select("cid", "first_id", *same_set).join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("first_id", *same_set, F.coalesce("label", "cid").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    grouped = labelled.join(smallest, "label").select(*same_set, "component_id")
    out = rows.select("doc_id", *same_set).join(grouped, same_set, "left")
    component = F.coalesce(F.col("component_id"), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies (the smallest doc_id)."""
    kept = near_components(docs, n, percent).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: components of 3-word shingle similarity 0.85 over all documents."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)
