"""Operators 11 to 13: centroid clustering, personal data, source divergence."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardiolake.llm import clustering, divergence, personal_data

from .helpers import docs

VECTORS = "vec_id long, embedding array<float>, label int"


# ---------------------------------------------------------------- clustering


def brute_clusters(rows, k, rounds, seed=2):
    """Plain rounds over (id, whole vector) rows."""
    named = sorted(rows, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(q) for _, q in named[:k]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    nearest = lambda q: min(range(len(centroids)), key=lambda i: (far(q, centroids[i]), i))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, q in rows:
            own[nearest(q)].append(q)
        centroids = [[sum(x) // len(own[i]) for x in zip(*own[i])] if i in own else c for i, c in enumerate(centroids)]
    return sorted(((str(i), nearest(q), far(q, centroids[nearest(q)])) for i, q in rows)), centroids


def assigned(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in df.collect())


@pytest.mark.parametrize("spread", [0.02, 1.0, 3000.0, 60_000.0])
def test_clusters_equal_plain_rounds(spark, spread):
    """Tight groups (whole balls), even clouds (leaves), large components (beyond float64) and repeats."""
    rng = random.Random(int(spread * 100))
    middles = [[rng.uniform(-1, 1) * max(1, spread) for _ in range(64)] for _ in range(6)]
    rows = [(i, [float(np.float32(m + rng.gauss(0, spread))) for m in middles[i % 6]], 0) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(200)] + [(None, rows[3][1], 0), (5, rows[5][1], 0)]
    got, centroids = clustering.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), k=8, rounds=3)
    want, middle = brute_clusters([(i, [int(np.floor(x * 256)) for x in v]) for i, v, _ in rows], 8, 3)
    assert assigned(got) == want and centroids == middle
    r = got.collect()
    by = Counter()
    for x in r:
        by[x["cluster"]] += x["distance"]
    assert all(x["cluster_inertia"] == by[x["cluster"]] and x["inertia"] == sum(by.values()) for x in r)
    assert all(x["centroid_sha256"] == hashlib.sha256(",".join(map(str, middle[x["cluster"]])).encode()).hexdigest() for x in r)


def test_balls_are_assigned_whole():
    """Tight far groups need no vector compared; equal vectors make one ball."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 9, (200, 64)), 5000 + rng.integers(0, 9, (200, 64)), np.full((300, 64), 900)]).astype(np.int32)
    order, nodes = clustering.tree(points)
    points = points[order]
    walk = clustering.Walk([[4] * 64, [5004] * 64, [901] * 64])
    balls, at, _, _ = walk.nearest(points, nodes)
    assert len(at) <= 2 * clustering.LEAF and sum(int(nodes["end"][n] - nodes["start"][n]) for n, _ in balls) == 700 - len(at)  # median cuts leave two mixed leaves
    c, d = walk.rows(points, nodes)
    exact = ((points[:, None, :].astype(np.int64) - walk.centroids[None]) ** 2).sum(axis=2)
    assert (c == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()


def test_cluster_edges(spark):
    bad = [(0, None, 1), (1, [1.0] * 63, 1), (2, [1.0] * 63 + [None], 1), (3, [1.0] * 63 + [float("nan")], 1), (4, [float("inf")] * 64, 1), (5, [], None)]
    good = [(6, [0.5] * 64, 1), (7, [0.5] * 64, 1), (7, [0.5] * 64, 1)]
    df = spark.createDataFrame(bad + good, VECTORS).withColumns({"cluster": F.lit("x"), "q": F.lit(1), "distance": F.lit(2)})
    out, centroids = clustering.cluster(df, k=40)
    # three equal centroids: the first takes all, the others stay where they are
    assert assigned(out) == [("6", 0, 0), ("7", 0, 0), ("7", 0, 0)] and centroids == [[128] * 64] * 3
    none, centroids = clustering.cluster(spark.createDataFrame(bad, VECTORS))
    assert none.count() == 0 and centroids == [] and none.columns == out.columns
    assert clustering.cluster(spark.createDataFrame([], VECTORS))[0].count() == 0
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(spark.createDataFrame([(1, [1e30] * 64, 0)], VECTORS))


# ---------------------------------------------------------------- personal data

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def passes_luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def base_spans(text):
    digits = lambda s: sum(c.isdigit() for c in s)
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text or "")]
    out += [("ip", *m.span()) for m in re.finditer(IP, text or "") if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, text or "") if 16 <= digits(m[0]) <= 19 and passes_luhn(m[0]) % 10 == 0]
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, text or "") if 8 <= digits(m[0]) <= 15]


def found(spark, texts):
    rows = personal_data.find_pii(docs(spark, texts)).select("doc_id", "findings").orderBy("doc_id").collect()
    return [[(f["kind"], f["start"], f["end"], f["base"]) for f in r["findings"]] for r in rows]


def test_base_spans_equal_plain_patterns(spark):
    """Random strings of the characters that the patterns are made of."""
    rng = random.Random(4)
    pieces = ["a@b.c", "x", "@", ".", "-", " ", "+1", "9", "12", "255.1.2.3", "4111111111111111", "4111 1111-1111 1111", "(555)", "+44 20", "\n", "ä", "😀", "%f@g.h", "..", "  ", "4222222222222"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(400)]
    for text, spans in zip(texts, found(spark, texts)):
        assert [s[:3] for s in spans if s[3]] == base_spans(text), text


ADDED = [
    ("IBAN DE89 3704 0044 0532 0130 00 BIC", ["iban:DE89 3704 0044 0532 0130 00"]),
    ("konto GB82WEST12345698765432.", ["iban:GB82WEST12345698765432"]),
    ("konto GB82WEST12345698765433.", []),
    ("XGB82WEST12345698765432", []),
    ("visa 378282246310005 thanks", ["card:378282246310005"]),
    ("visa 378282246310006 thanks", []),
    ("number 378282246310005 thanks", []),
    ("pay 4111111111111111 5500005555555559 123 now", ["card:4111111111111111", "card:5500005555555559"]),
    ("invoice 4111111111111111 5500005555555559 123", []),
    ("Des +1 (826) 555-4081 190.137.223.204 du", ["phone:+1 (826) 555-4081"]),
    ("tel. (212) 555-0123", ["phone:(212) 555-0123"]),
    ("lot (212) 555-0123", []),
    ("my SSN is 123-45-6789", ["ssn:123-45-6789"]),
    ("my SSN is 666-45-6789", []),
    ("rows 123-45-6789", []),
    ("the report of 2024-05-06 counts 1234567890123456 rows, version 10.2.300.4, page 12-13", []),
]


def test_added_spans(spark):
    texts = [t for t, _ in ADDED]
    for (text, want), spans in zip(ADDED, found(spark, texts)):
        assert [f"{k}:{text[a:b]}" for k, a, b, base in spans if not base] == want, text


def test_account_numbers_of_all_countries(spark):
    """Numbers with check digits computed here are confirmed; with one digit changed they are not."""
    rng, good = random.Random(9), []
    for n, codes in personal_data.IBAN_LENGTHS.items():
        for c in codes.split():
            body = "".join(rng.choices("0123456789", k=n - 4))
            check = 98 - int("".join(str(int(x, 36)) for x in body + c + "00")) % 97
            good.append(f"{c}{check:02d}{body}")
    bad = [x[:-1] + str((int(x[-1]) + 1) % 10) for x in good]
    kinds = lambda texts: [[s[0] for s in x if s[0] == "iban"] for x in found(spark, texts)]
    assert kinds(good) == [["iban"]] * len(good) and kinds(bad) == [[]] * len(bad)


def test_pii_edges(spark):
    texts = [None, "", "a" * 300_000, "1" * 300_000, "1 2 " * 50_000, "bob@x.com 4111111111111111 x " * 3_000, "4111111111111111 " * 3_000, "mail bob@x.com", "mail bob@x.com"]
    got = found(spark, texts)
    assert got[:5] == [[], [], [], [], []] and got[7] == got[8] == [("email", 5, 14, True)]
    assert [len(got[5]), len(got[6])] == [6_000, 3_000] and not any(s[3] for s in got[6])
    assert [s[:3] for s in got[5]] == base_spans(texts[5])
    odd = docs(spark, ["call bob@x.com"]).withColumns({"kind": F.lit(1), "pii_text": F.lit("z@z.com"), "base": F.lit(2), "a.b": F.lit(3)})
    out = personal_data.find_pii(odd)
    assert out.columns == [*odd.columns, "findings"] and [f["match"] for f in out.first()["findings"]] == ["bob@x.com"]
    assert out.first()["pii_text"] == "z@z.com" and personal_data.find_pii(docs(spark, [])).count() == 0


def test_pii_is_native(spark, sf_dir):
    plan = personal_data.op12_personal_data(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# ---------------------------------------------------------------- divergence

UPPER = {c: c + 32 for c in range(65, 91)}


def brute_divergence(rows, least, top):
    """Rows of (lang, source, text), every pair over every kept term."""
    count, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        t = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        count[lang or "", source or ""].update(t)
        seen[lang or ""].update(set(t))
    out = []
    for lang in {g[0] for g in count}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        groups = {s: c for (la, s), c in count.items() if la == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            terms = sorted((-(p[s][t] - q[t]), t.encode(), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, part, x[2], -x[0], r) for part, xs in (("pair", pairs), ("term", terms)) for r, x in enumerate(xs, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")


def test_divergence_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SALTS", 3)
    rng = random.Random(11)
    words = ["the", "The", "été", "naïve", "x", "yy", "rare", "word", "Ünder", "日本"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "é", None]), " ".join(rng.choices(words[: rng.randint(1, len(words))], k=rng.randint(0, 30)))) for _ in range(240)]
    rows += [("en", "hot", "the the rare2rare x\x00y")] * 100 + [("en", "none", None), ("en", "none2", "12 !!"), ("solo", "only", "the"), ("", "", "the word")]
    got = sorted(map(tuple, divergence.divergence(table(spark, rows).repartition(5), least=12, top=7).collect()))
    want = brute_divergence(rows, 12, 7)
    assert got == want and {r[2] for r in got} == {"pair", "term"} and len(got) > 100


def test_divergence_without_kept_terms_and_empty(spark):
    few = table(spark, [("en", "a", "x"), ("en", "b", "y"), ("en", "c", None)]).withColumns({"n": F.lit("q"), "term": F.lit(1), "salt": F.lit(2)})
    got = sorted(map(tuple, divergence.divergence(few).collect()))
    assert got == brute_divergence([("en", "a", "x"), ("en", "b", "y"), ("en", "c", None)], 30, 50)
    assert [r[4] for r in got] == [0] * 6
    assert divergence.divergence(table(spark, [])).count() == 0
    long = [("en", s, "Word " * 200_000 + s) for s in "ab"]
    assert sorted(map(tuple, divergence.divergence(table(spark, long), least=2).collect())) == brute_divergence(long, 2, 50)


def test_dictionaries_are_sent_when_full(spark, monkeypatch):
    """Sums do not depend on how often a task sends its dictionary."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["a", "a", "b", None], "text": ["x y z", "x y", "x", None]})

    def totals():
        out = Counter()
        for b in divergence._counted(iter([batch, batch])):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"]] += 1000 * r["n"] + r["docs"]
        return out

    want = totals()
    monkeypatch.setattr(divergence, "HELD", 1)
    assert totals() == want and want["en", "a", "x"] == 4004 and want["en", "", ""] == 0


def test_terms_are_cut_on_bytes():
    """Terms are cut on bytes: letters and every byte above ASCII, as the pattern has it on code points."""
    text = "".join(map(chr, range(0x300))) + "日本 ZebrA_é"
    assert [t.decode() for t in text.encode().translate(divergence._TERM_BYTES).split()] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(UPPER))
