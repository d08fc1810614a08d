import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardiolake.llm import near_dedup as nd
from cardiolake.llm import suffix_dedup as sd

from .helpers import components, docs, words

VOCAB = [f"w{i}" for i in range(4000)]


def family(rng, base, n, edits):
    """Copies of ``base`` with up to ``edits`` words replaced."""
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, len(w), size=int(rng.integers(0, edits + 1))):
            w[at] = f"x{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


def check(spark, texts, n, percent):
    got = {r["doc_id"]: r for r in nd.near_components(docs(spark, texts), n, percent).collect()}
    want = components(list(enumerate(texts)), n, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(12):
        base = rng.choice(VOCAB, size=int(rng.integers(3, 120))).tolist()
        texts += family(rng, base, int(rng.integers(1, 6)), 4)
    texts += texts[:5] + [None, "", " \t", "One", "one", "two words", "Two  words"]
    check(spark, texts, 3, 85)


@pytest.mark.parametrize("seed,size,edits,n,percent", [(1, 60, 7, 3, 85), (2, 120, 9, 5, 80), (3, 200, 14, 3, 85)])
def test_large_families_keep_every_link(spark, seed, size, edits, n, percent):
    """Families of near copies around the threshold: all rounds of the search take part."""
    rng = np.random.default_rng(seed)
    a, b = (rng.choice(VOCAB, size=size).tolist() for _ in range(2))
    half = a[: size // 2] + b[: size - size // 2]
    texts = family(rng, a, 60, edits) + family(rng, half, 25, edits) + family(rng, b, 25, edits // 2)
    rng.shuffle(texts)
    check(spark, texts, n, percent)


@pytest.mark.parametrize("rows", [200_000, 0])
def test_families_dealt_over_blocks(spark, monkeypatch, rows):
    """Families of more than five members in blocks; sizes broadcast or (rows 0) joined in blocks."""
    monkeypatch.setattr(nd, "BLOCK", 5)
    monkeypatch.setattr(nd, "TABLE_ROWS", rows)
    rng = np.random.default_rng(4)
    a, b = (rng.choice(VOCAB, size=90).tolist() for _ in range(2))
    texts = family(rng, a, 50, 8) + family(rng, a[:45] + b[:45], 25, 8) + family(rng, b, 25, 4)
    check(spark, texts, 3, 85)


def nested(rng, sizes=(70, 60, 50)):
    """One text many times; a third of it exchanged alike in two groups, a further part in the last."""
    a = rng.choice(VOCAB, size=150).tolist()
    b = a[:120] + [f"b{k}" for k in range(30)]
    c = [f"c{k}" for k in range(20)] + b[20:]
    return [t for base, n in zip((a, b, c), sizes) for t in family(rng, base, n, 6)]


@pytest.mark.parametrize("direct,seed", [(32, 5), (2, 6)])
def test_one_difference_of_very_many_members(spark, monkeypatch, direct, seed):
    """Two groups that do not link share a difference from their family: its list becomes a
    family of its own, and the pairs compared grow with the members, not with their square."""
    monkeypatch.setattr(nd, "DIRECT", direct)
    monkeypatch.setattr(nd, "BLOCK", 20)
    tables, save = {}, nd.Scratch.save

    def counted(self, df, name, wide=False):
        out = save(self, df, name, wide)
        tables.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(nd.Scratch, "save", counted)
    texts = nested(np.random.default_rng(seed))
    check(spark, texts, 3, 85)
    assert len(tables["diffs"]) > 1, "no list became a family"
    assert sum(tables["rest"]) < 10 * len(texts)


def test_near_dedup_keeps_columns_and_one_of_each_group(spark):
    text = " ".join(VOCAB[:100])
    d = docs(spark, [text, text, text + " more", "another text altogether", None], kept=F.lit("mine"), cid=F.lit(7), component_id=F.lit("x"))
    out = nd.near_dedup(d)
    assert out.columns == d.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 3, 4]


def test_near_dedup_of_nothing_and_of_null_ids(spark):
    assert nd.near_components(docs(spark, [])).count() == 0
    rows = nd.near_components(docs(spark, [(None, "a b c"), (3, "a b c"), (3, "a b c")])).collect()
    assert [r["component_id"] for r in rows] == [3, 3, 3]


def test_threshold_of_matches():
    from math import comb

    m = nd.match_threshold(0.85)
    tail = lambda k: sum(comb(nd.K, i) * 0.85**i * 0.15 ** (nd.K - i) for i in range(k))
    assert tail(m) <= nd.MISS < tail(m + 1)


# --- repeated passages


def repeated(texts, least=50):
    """{id: word positions inside a run of ``least`` words found in another text}."""
    seen = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - least + 1):
            seen.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = {}
    for i, t in enumerate(texts):
        w = words(t)
        hit = {p for k in range(len(w) - least + 1) if len(seen[tuple(w[k : k + least])]) > 1 for p in range(k, k + least)}
        if hit:
            out[i] = hit
    return out


def covered(rows):
    out = {}
    for r in rows:
        assert r["n_words"] == r["end_word"] - r["start_word"] >= 50
        out.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return out


def test_passages_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    passages = [" ".join(rng.choice(VOCAB, size=n)) for n in (49, 50, 51, 75, 180)]
    texts = []
    for k in range(40):
        parts = [" ".join(rng.choice(VOCAB, size=int(rng.integers(0, 90)))) for _ in range(3)]
        texts.append(parts[0] + " " + passages[k % 5].upper() + "\n" + parts[1] + " " + (passages[(k * 7) % 5] if k % 3 else "") + " " + parts[2])
    texts += [None, "", "short", " ".join(["same"] * 300), " ".join(["same"] * 70), texts[0]]
    assert covered(sd.repeated_spans(docs(spark, texts)).collect()) == repeated(texts)


def lost_passage(rng):
    """Two texts share 50 words around a 20-word gram; others share more with them, but on one side only."""
    gram, left, right = (rng.choice(VOCAB, size=n).tolist() for n in (20, 15, 15))
    fresh = lambda n: [f"f{rng.integers(10**9)}" for _ in range(n)]
    x_left, x_right = fresh(40), fresh(40)
    x = x_left + left + gram + right + x_right
    c = fresh(45) + left + gram + right + fresh(45)
    near_right = [fresh(30) + gram + right + x_right[:14] + fresh(20) for _ in range(8)]
    near_left = [fresh(20) + x_left[-14:] + left + gram + fresh(30) for _ in range(8)]
    return [" ".join(w) for w in (x, c, *near_right, *near_left)]


def test_passage_between_closer_neighbours(spark):
    """The only partner of a passage is no neighbour in either sort order."""
    rng = np.random.default_rng(13)
    texts = [t for _ in range(25) for t in lost_passage(rng)]
    want = repeated(texts)
    assert len(want) == 50 and covered(sd.repeated_spans(docs(spark, texts)).collect()) == want


def test_what_neighbours_find_and_what_they_leave(spark):
    """Plain passages need neighbours only; runs of hashes are compared where the best partners differ by side."""
    rng = np.random.default_rng(3)
    passages = [" ".join(rng.choice(VOCAB, size=n)) for n in (50, 90, 300)]
    plain = [" ".join(rng.choice(VOCAB, size=40)) + " " + passages[k % 3] + " " + " ".join(rng.choice(VOCAB, size=40)) for k in range(30)]
    one = lambda texts: {r["part"]: r["n_matches"] for r in sd.match_counts(docs(spark, texts).coalesce(1)).collect()}
    got = one(plain)
    assert got["neighbours"] > 60 and "remainder" not in got
    assert one([t for _ in range(25) for t in lost_passage(rng)])["remainder"] > 0


def test_each_sorted_block_equals_comparing_all_pairs():
    """Neighbours, bounds and the remainder against all pairs of suffixes of one key, ties and text edges included."""
    rng = np.random.default_rng(17)
    for _ in range(60):
        n = int(rng.integers(2, 40))
        codes = lambda: np.where(np.arange(sd.REACH) < rng.integers(0, 31, size=(n, 1)) + 12 * rng.integers(0, 2), rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 1, 2], size=(n, sd.REACH)), 0).astype(">u4")
        right, left = codes(), codes()
        doc, at = rng.integers(0, 6, size=n), np.arange(n) * 1000 + 500
        order = sorted(range(n), key=lambda i: (right[i].tolist(), left[i].tolist(), doc[i], at[i]))
        block = sd._Block(np.full(n, 5), right[order], left[order], doc[order], at[order])
        want: dict = {}
        for i in range(n):
            for j in range(n):
                for back in range(sd.REACH + 1) if block.doc[i] != block.doc[j] else ():
                    a, b = block.left[i][:back], block.right[i][: sd.REACH - back]
                    if a.all() and b.all() and (a == block.left[j][:back]).all() and (b == block.right[j][: sd.REACH - back]).all():
                        start = int(block.at[i]) - back
                        want.setdefault(int(block.doc[i]), set()).update(range(start, start + sd.LEAST))
        got: dict = {}
        for batch in sd._compared(block, False):
            for d, a, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
                got.setdefault(d, set()).update(range(a, b))
        assert got == want


def test_repeated_hashes_beyond_the_table_are_joined(spark, monkeypatch):
    texts = edited_family(200, size=150) + [None, "short"]
    monkeypatch.setattr(sd, "TABLE_BITS", 0)
    d = docs(spark, [*texts, (0, texts[0]), (None, texts[0])], key=F.lit("k"), at=F.lit(1))
    assert covered(sd.repeated_spans(d).collect()) == repeated(texts)


def test_one_passage_everywhere(spark):
    rng = np.random.default_rng(6)
    p = " ".join(rng.choice(VOCAB, size=64))
    texts = [" ".join(rng.choice(VOCAB, size=30)) + " " + p + " " + " ".join(rng.choice(VOCAB, size=30)) for _ in range(150)]
    assert covered(sd.repeated_spans(docs(spark, texts).repartition(7)).collect()) == repeated(texts)


def edited_family(n, size=400, every=45):
    """Copies of one text with a word changed every ``every`` words or so."""
    rng = np.random.default_rng(11)
    base = rng.choice(VOCAB, size=size)
    texts = []
    for k in range(n):
        w = list(base)
        for at in np.flatnonzero(rng.random(size) < 1 / every):
            w[at] = f"x{rng.integers(60)}"
        texts.append(" ".join(w))
    return texts


def test_large_family_of_edited_copies(spark):
    """The best partner to the left and to the right are different documents for most suffixes."""
    texts = edited_family(3000)
    assert covered(sd.repeated_spans(docs(spark, texts)).collect()) == repeated(texts)


def test_keys_compared_in_pieces(spark, monkeypatch):
    """One key over many partitions and chunks: the pieces are counted together."""
    texts = edited_family(300, size=120)
    d = docs(spark, texts)
    twice = sd._keys(d).groupBy("key").count().where("count > 1").select("key").cache()
    table = sd._bit_table(twice, twice.count())
    rows = sd._suffixes(d, table).toPandas().sort_values(["key", "right", "left", "doc_id", "at"])
    monkeypatch.setattr(sd, "CHUNK", 7)
    batches = [pa.RecordBatch.from_pandas(rows.iloc[i : i + 5], preserve_index=False) for i in range(0, len(rows), 5)]
    got = pa.Table.from_batches(list(sd._scan(iter(batches)))).to_pandas()
    runs = got[got["run"].notna()]
    span = runs.groupby(["key", "run"]).agg(low=("low", "min"), high=("high", "max"))
    both = runs[runs["doc_id"].notna()].merge(span[span["low"] < span["high"]].reset_index()[["key", "run"]], on=["key", "run"])
    found = {}
    for part in (got[got["run"].isna()], both):
        for i, a, b in zip(part["doc_id"].astype(int), part["start"].astype(int), part["end"].astype(int)):
            found.setdefault(i, set()).update(range(a, b))
    assert found == repeated(texts) and len(both)


def test_cut_repeats(spark):
    rng = np.random.default_rng(8)
    p = " ".join(rng.choice(VOCAB, size=60))
    d = docs(spark, ["before " + p + " after", p, "clean text"], start_word=F.lit("s"), end_word=F.lit(1), span=F.lit(2))
    assert sd.cut_repeats(d, sd.repeated_spans(d)).columns == d.columns
    out = {r["doc_id"]: r["text"] for r in sd.cut_repeats(d, sd.repeated_spans(d)).collect()}
    assert out == {0: "before after", 1: "", 2: "clean text"}
    assert sd.repeated_spans(docs(spark, [])).count() == 0
    assert sd.repeated_spans(docs(spark, [(5, p), (5, p), (None, p)])).count() == 0


def test_very_long_texts(spark):
    """Whole texts count: the one changed word and the shared passage stand at the end of 60,000 words."""
    rng = np.random.default_rng(21)
    w = [f"u{i}" for i in rng.integers(0, 10**6, size=60_000)]
    texts = [" ".join(w), " ".join(w[:-1] + ["other"]), " ".join(w[-55:]), " ".join(f"v{i}" for i in range(60_000))]
    d = docs(spark, texts, row=F.lit("mine"), h1=F.lit(1), n_shingles=F.lit("x"))
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in nd.near_components(d, 3, 85).collect()}
    assert {i: c for i, (c, _) in got.items()} == {0: 0, 1: 0, 2: 2, 3: 3} and got[3][1] == 59_998
    spans = covered(sd.repeated_spans(d).collect())
    assert spans[0] == set(range(60_000)) and spans[2] == set(range(55)) and 3 not in spans
