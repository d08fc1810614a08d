import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardiolake.llm import packing as pk
from cardiolake.llm import sharding as sh
from cardiolake.llm import warc as wa

from .helpers import docs

# --- sharding


def brute_capacity(sizes, n):
    """Smallest largest part of a contiguous partition into at most n parts (dynamic programme)."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(n):
        best = [min([best[i]] + [max(best[j], sum(sizes[j:i])) for j in range(i)]) for i in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_minimax(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, size=int(rng.integers(1, 25))).tolist()
    if seed == 5:
        sizes[0] = 500
    keys, per = [f"{i:04d}" for i in range(len(sizes))], 3
    buckets = [(keys[i : i + per], sizes[i : i + per]) for i in range(0, len(sizes), per)]
    prefix = sh._Prefix(np.array([sum(s) for _, s in buckets]), np.array([max(s) for _, s in buckets]), lambda b: buckets[b], keep=2)
    capacity, cuts = sh.minimax_cuts(prefix, 4)
    assert capacity == brute_capacity(sizes, 4) and len(cuts) <= 3
    parts = np.searchsorted([keys.index(c) for c in cuts], np.arange(len(sizes)), side="right")
    assert max(np.bincount(parts, sizes)) <= capacity


def test_shards_of_documents(spark):
    rng = np.random.default_rng(1)
    texts = ["x" * int(n) for n in rng.integers(0, 400, 300)] + ["copy é"] * 50 + [None, None, "", (None, "n"), (7, "again")]
    for bucket in (10, 20_000):
        rows = sh.shard_documents(docs(spark, texts, shard=F.lit(9), key=F.lit("k"), size=F.lit(1)).repartition(5), 8, bucket).collect()
        assert len(rows) == len(texts)
        for s in range(8):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
        by = {}
        for r, t in ((r, t) for r in rows for t in [r["text_crc32"]]):
            by.setdefault((t, r["size"]), set()).add(r["shard"])
        assert all(len(v) == 1 for (_, size), v in by.items() if size > 1)  # null and empty texts are two groups of size 1
        copy = "copy é".encode()
        assert sum(r["size"] == len(copy) + 1 and r["text_crc32"] == zlib.crc32(copy) for r in rows) == 50
        sums = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
        assert max(sums) - min(sums) <= 2 * 401 + 50 * (len(copy) + 1)
    assert sh.shard_documents(docs(spark, [])).count() == 0


# --- archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    big = "<p>" + "é" * 60 + "</p>"
    rows = [(5, "http://a/é?x", big), (2, None, big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, 'q"\r\nX: y', "<b>\r\n\r\n</b>" * 30), (2, "u2", big), (None, "u", big)]
    bundles = wa.write_bundles(pages(spark, rows).withColumn("digest", F.lit("d")), frame_bytes=300, bundle_bytes=1500)
    got = wa.read_bundles(bundles).collect()
    want = [(str(i), u, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == big and i != 2 else "response", 2 if h == big and i != 2 else None) for i, u, h in rows]
    assert sorted(((str(r["page_id"]), r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted(want, key=repr)


def test_revisits_name_their_response(spark):
    big = "<p>" + "x" * 200 + "</p>"
    bundles = wa.write_bundles(pages(spark, [(4, "http://a/4", big), (2, "http://a/2 b", big), (9, None, big)]))
    records = {}
    for row in bundles.collect():
        for _, _, head, _, _ in wa.BundleReader(row["content"]).records():
            records[head["X-Page-Id"]] = head
    assert records["2"]["WARC-Type"] == "response"
    for i in ("4", "9"):
        assert records[i]["WARC-Refers-To"] == records["2"]["WARC-Record-ID"] and records[i]["WARC-Refers-To-Target-URI"] == "http://a/2%20b" == records["2"]["WARC-Target-URI"]


def test_random_access_and_plain_tools(spark, tmp_path):
    import zstandard

    bundles = wa.write_bundles(pages(spark, [(i, f"u{i}", f"<p>{i}</p>" * 40) for i in range(50)]).coalesce(1), frame_bytes=2000)
    (path,) = wa.export_bundles(bundles, str(tmp_path))
    raw = open(path, "rb").read()
    reader = wa.BundleReader(raw)
    assert len(reader.frames) > 5
    for row in wa.read_bundles(bundles).collect()[::7]:
        record = reader.record(row["record_id"])
        assert record.startswith(b"WARC/1.1\r\n") and f"X-Page-Id: {row['page_id']}".encode() in record
        assert reader.frame(row["frame"])[row["offset"] :].startswith(record)
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 50  # skippable frames are skipped by any reader
    assert wa.write_bundles(pages(spark, [])).count() == 0


# --- packing


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    own, plain = pk.Tokens(pk.default_tokenizer(), limit=3), Tokenizer.from_file(pk.default_tokenizer())
    for t in ["", " ", "It's 12'Ll x_y a½ Ñandú's don't", "ÀÉ İ×÷ <|endoftext|> Σ ΑΣ", "aİb", "x" * 50 + "'d", "é né   \x1c z", "A,b##c  d\n\te日本"]:
        assert np.frombuffer(own(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_tokens_of_letters_that_grow_and_of_all_symbols():
    """Lower case of U+023A lies outside Latin: such a text ended the job.  Every character the cache takes is tried."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(pk.default_tokenizer())
    taken = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0x130), *range(0x131, 0x250))]
    texts = ["a\u023ab c", "\u023e\u023a, dog\u023e's", *(f"{c} a{c} {c}b A{c}'S {c}{c} 1{c}2 a{c}.{c}" for c in taken), None, "", " \n"]
    for limit in (3, 800_000):
        own = pk.Tokens(pk.default_tokenizer(), limit=limit)
        for got in ([own(t) for t in texts], own.many(pa.array(["x", *texts], pa.string()).slice(1))):
            for t, raw in zip(texts, got):
                assert np.frombuffer(raw, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_frequent_words_are_encoded_once():
    """A full cache gives up what was met least, so common words do not go to the tokenizer again."""

    class Counting:
        def __init__(self, inner):
            self.inner, self.seen = inner, Counter()

        def encode(self, text, **options):
            self.seen.update(text.split())
            return self.inner.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            self.seen.update(w for t in texts for w in t.split())
            return self.inner.encode_batch_fast(texts, **options)

    own = pk.Tokens(pk.default_tokenizer(), limit=60)
    own.plain = Counting(own.plain)
    common, letters = ["river", "stone", "light", "house"], "abcdefghij"
    for i in range(300):
        rare = "".join(letters[int(d)] for d in f"{i:03d}")
        own(" ".join([*common * 3, "q" + rare, "w" + rare]))
    assert {own.plain.seen[w] for w in common} == {1} and len(own.plain.seen) == 604
    assert len(own.chunks.keys) <= 64 and len(own.words.keys) <= 64


def best_sum(counts, capacity):
    sums = {0}
    for n, k in counts:
        sums = {s + n * j for s in sums for j in range(k + 1) if s + n * j <= capacity}
    return max(sums)


@pytest.mark.parametrize("seed", range(20))
def test_fill_is_closest(seed):
    rng = np.random.default_rng(seed)
    counts = [(int(n), int(rng.integers(1, 4))) for n in sorted(set(rng.integers(3, 60, 6).tolist()), reverse=True)]
    used = pk.closest_fill(counts, 64)
    assert sum(n * k for n, k in used.items()) == best_sum(counts, 64) and all(k <= dict(counts)[n] for n, k in used.items())


def check_pieces(rows, texts, window=4096):
    own = pk.Tokens(pk.default_tokenizer())
    ids = {i: np.frombuffer(own(t), "<u4").tolist() + [2] for i, t in enumerate(texts)}
    for i, want in ids.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.asarray(want[r["start"] : at], "<u4").tobytes())
        assert at == len(want)
    total = pad = 0
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        total += at
        pad += 0 if at & (at - 1) == 0 else window - at
    assert pad <= 0.01 * total


def test_packing_covers_every_token(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["river", "stone,", "light", "Häuser!", "x9"], size=int(n))) for n in rng.integers(0, 1500, 120)] + [None, "", "word " * 20_000]
    for buffer in (4_000_000, 9000):
        rows = pk.pack_documents(docs(spark, texts, offset=F.lit(1)).repartition(3), buffer_tokens=buffer).collect()
        check_pieces(rows, texts)
    assert pk.pack_documents(docs(spark, [])).count() == 0


def test_pipeline_end_to_end(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(500)]
    clean = [" ".join(rng.choice(vocab, size=80)) for _ in range(60)]
    texts = [*clean, clean[0], clean[1] + " tail", "bench " + " ".join(vocab[:12]), "with secret = abcdef123 " + " ".join(rng.choice(vocab, size=40)), *[" ".join(w + "###" for w in rng.choice(vocab, size=60)) for _ in range(12)]]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int("###" not in t), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(vocab[:12]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(str(tmp_path / "out" / name))
        d = spark.read.parquet(str(tmp_path / "out" / name))
        assert d.columns == columns
        seen.append({r["doc_id"]: r["text"] for r in d.collect()})
    quality, near, dec, sec = seen
    assert not any("###" in t for t in quality.values()) and len(set(range(60)) - set(quality)) <= 1
    assert 60 not in near and 61 not in near and 62 in near and 62 not in dec
    assert "[SECRET]" in sec[63] and "abcdef123" not in sec[63] and len(set(range(60)) - set(sec)) <= 1
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(sec)


def test_pipeline_edges(spark, tmp_path):
    """Null and empty texts, null ids, repeated rows, clashing columns, a very long text, and no rows at all."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(400)]
    clean = [" ".join(rng.choice(vocab, size=60)) for _ in range(30)]
    long = " ".join(rng.choice(vocab, size=60_000))
    rows = [*enumerate(clean), (5, clean[5]), (None, "only here " + " ".join(rng.choice(vocab, size=50))), (40, None), (41, ""), (None, None), (42, long)]
    d = docs(spark, rows).withColumns({c: F.lit("mine") for c in ("kept", "row", "g", "cid", "h1", "key", "words", "blocks", "positions", "spans", "__kept", "__id")})
    for name, data in (("full", d), ("none", d.limit(0))):
        sf = str(tmp_path / name)
        data.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, " ".join(["unseen"] * 12))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    sf, now = str(tmp_path / "full"), spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        now.write.parquet(f"{sf}/out/{name}")
        now = spark.read.parquet(f"{sf}/out/{name}")
        assert now.columns == d.columns and {r["kept"] for r in now.select("kept").distinct().collect()} == {"mine"}
    left = [(r["doc_id"], r["text"]) for r in now.collect()]
    assert sorted(i for i, _ in left if i is not None) == sorted([*range(30), 5, 42]) and sum(i is None for i, _ in left) == 1
    assert dict(left)[42] == long
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in left}
    # Stages called alone keep documents without text, but for the first.
    bare = docs(spark, [(1, None), (2, ""), (2, "")])
    assert corpus_pipeline.quality(spark, bare, sf).count() == 0
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.secrets):
        assert stage(spark, bare, sf).count() == 3
    assert sum(r["length"] for r in corpus_pipeline.packing(spark, bare, sf).collect()) == 3
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_registry_names():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
