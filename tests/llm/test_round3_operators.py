"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from revlens.llm import graph, simhash, spelling, whitening

DOCS = "doc_id long, text string"
CLASHES = ("key", "fp", "near", "word", "n", "side", "level", "node", "x", "component", "rep", "top", "count")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


def union_by(n, linked):
    """Smallest member of each row's component, by all pairs."""
    top = list(range(n))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# ---------------------------------------------------------------- operator 11

def corpus():
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(30, 200))) for _ in range(25)]
    texts = base + base[:5] + [b + " tail" for b in base[:12]] + [b.upper() for b in base[5:8]]
    texts += [None, "", " \n\t ", "one", "one two", "ONE\x0btwo", "É é x", " ".join(f"v{i % 977}" for i in range(120_000))]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, base[1]), (None, None), (3, base[9])]


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash_equals_brute_force(spark):
    rows = corpus()
    prints = [brute_print(t) for _, t in rows]
    have = [i for i, (doc, _) in enumerate(rows) if doc is not None]
    tops = union_by(len(have), lambda a, b: (prints[have[a]] ^ prints[have[b]]).bit_count() <= 3)
    least = {}
    for k, i in zip(tops, have, strict=True):
        least[k] = min(least.get(k, rows[i][0]), rows[i][0])
    component = {i: least[k] for k, i in zip(tops, have, strict=True)}
    want = [(doc, prints[i] - (1 << 64) if prints[i] >> 63 else prints[i], component.get(i)) for i, (doc, _) in enumerate(rows)]
    got = [tuple(r) for r in simhash.near_duplicates(clashing(spark.createDataFrame(rows, DOCS).repartition(3))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want}), "the corpus has links between different fingerprints"
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_spark_hash_is_the_named_one(spark):
    got = spark.sql("SELECT xxhash64('one two')").head()[0]
    assert got % (1 << 64) == xxhash.xxh64("one two".encode(), seed=42).intdigest()


def test_codewords_of_neighbours_meet():
    table = simhash.codeword_table()
    rng = np.random.default_rng(1)
    for x in rng.integers(0, 1 << 16, 3000).tolist():
        for bit in range(16):
            assert table[x, 0] in table[x ^ (1 << bit)]


def cloud(rng, size):
    """Distinct fingerprints around one centre, by chains of flips, with strangers."""
    centre, found = rng.getrandbits(64), set()
    while len(found) < size:
        x = rng.choice(sorted(found)) if found and rng.random() < 0.5 else centre
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        found.add(x)
    return sorted(found | {rng.getrandbits(64) for _ in range(50)})


@pytest.mark.parametrize("bucket, block", [(10**6, 10**6), (5, 10**6), (5, 7)])
def test_simhash_crowded_keys(spark, bucket, block):
    prints = cloud(random.Random(7), 250)
    tops = union_by(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 3, bucket, block)
    star = {r["u"]: r["v"] for r in graph.components(edges).collect()}
    groups = {}
    for s, t in zip(signed, tops, strict=True):
        groups.setdefault(t, set()).add(s)
    got = {}
    for s in signed:
        got.setdefault(star.get(s, s), set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    assert 1 < max(map(len, groups.values())) and len(groups) > 50


def test_simhash_sends_no_pairs_of_a_group(spark):
    """Among 400 fingerprints that all link, a task sends a tree and not the 79,800 pairs."""
    rng = random.Random(3)
    prints = {1 << rng.randrange(16, 64) | 1 << rng.randrange(16, 64) for _ in range(400)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").coalesce(1)
    assert simhash.links(df).count() < 30 * len(prints)


# ---------------------------------------------------------------- operator 12

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * [1, 2, 3, 1, 1, 0.5] + rng.normal()).astype(np.float32).tolist(), i % 3) for i in range(80)]
    rows += [rows[0], rows[0], (500, rows[1][1], 0), (None, rows[2][1], 1)]
    bad = [(600, None, 0), (601, [0.0] * 5 + [None], 0), (602, [0.0] * 5 + [math.nan], 0), (603, [math.inf] + [0.0] * 5, 0), (604, [], 0)]
    return rows, bad


def test_whitening_equals_brute_force(spark):
    rows, bad = vectors()
    df = spark.createDataFrame(rows + bad, VECTORS).repartition(3).withColumns({c: F.lit(1) for c in ("x", "n", "component", "deviation", "white", "c")})
    got = whitening.whiten(df, components=4).collect()
    x = {r[0:1] + (tuple(r[1]),): [math.floor(64 * float(c)) + 1_000_000 for c in r[1]] for r in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = [[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(6)] for i in range(6)]
    exact = whitening.covariance(spark.createDataFrame([(list(v),) for v in fit], "x array<long>").repartition(3), 6, n, sums, wide=False)
    assert exact == cov
    assert whitening.covariance(spark.createDataFrame([(list(v),) for v in fit], "x array<long>"), 6, n, sums, wide=True) == cov
    value, axis = np.linalg.eigh(np.array(cov, float))
    value, axis = value[::-1], axis[:, ::-1]
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    by_id = {}
    for doc, vec, _ in rows:
        v = [math.floor(64 * float(c)) + 1_000_000 for c in vec]
        by_id[doc] = ([n * a - s for a, s in zip(v, sums, strict=True)], v)
    sign = {}
    for r in sorted(got, key=lambda r: abs(r["whitened"]), reverse=True):
        c = r["component"] - 1
        dev, v = by_id[r["vec_id"]]
        assert int(r["deviation"]) == sum(d * d for d in dev)
        want = float(np.array([d / n for d in dev]) @ axis[:, c] / np.sqrt(value[c]))
        s = sign.setdefault(c, 1 if want * r["whitened"] > 0 else -1)
        assert r["whitened"] == pytest.approx(s * want, abs=1e-9)
        assert r["explained"] == pytest.approx(value[c] / value.sum(), rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9


def test_whitening_edges(spark):
    rows, bad = vectors()
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame(bad, VECTORS)).count() == 0
    one = whitening.whiten(spark.createDataFrame([rows[0], rows[0]], VECTORS)).collect()
    assert len(one) == 12 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in one)
    flat = [(i, [float(i), 1.0, 2.0 * i], 0) for i in range(9)]  # rank 1
    got = whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-9 for r in got)
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([*rows, (9, [1.0], 0)], VECTORS))
    with pytest.raises(OverflowError):
        whitening.whiten(spark.createDataFrame([*rows, (9, [1e13] * 6, 0)], VECTORS))


# ---------------------------------------------------------------- operator 13

def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words, factor=10):
    out = {}
    for w, n in words.items():
        close = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(close, default=None)
        form = best if best and -best[0] >= factor * n else None
        out[w] = (form and form[1], n, len(close), form and -form[0])
    rows = []
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, m))
    return sorted(rows)


def lexicon(long):
    rng = random.Random(13)
    words = {}
    for _ in range(60):
        w = "".join(rng.choice("aabcdé÷") for _ in range(rng.randrange(1, 12)))
        words[w] = rng.randrange(100, 5000)
        for _ in range(6):
            k = rng.randrange(len(w) + 1)
            v = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abÿ") + w[k:], w[:k] + rng.choice("abcÀ") + w[k + 1:]])
            if v:
                words.setdefault(v, rng.randrange(2, 40))
    for m in (63, 64, 65, 66, 67, 3000) if long else ():  # around the longest words of the tries, and far beyond
        w = "".join(rng.choice("abc") for _ in range(m))
        words |= {w: 900, w[:30] + "z" + w[30:]: 5, w[:-1]: 7, "y" + w[1:]: 8, w[:40] + "q" + w[41:]: 90}
    return words | {"aaaaaaa": 50, "aaaaaaaa": 500, "aaaaaaaaa": 5, "baaaaaaa": 500, "aaaaaaab": 500,
                    "chainedword": 1000, "chainedwor": 50, "chainedwo": 3}


@pytest.mark.parametrize("hot, long", [(spelling.HOT, False), (3, True)])
def test_spelling_equals_brute_force(spark, hot, long):
    words = lexicon(long)
    df = spark.createDataFrame([*words.items(), (None, 3), ("", 9), ("zzz", None)], "word string, n long").repartition(3)
    got = [tuple(r) for r in spelling.variants(clashing(df), hot=hot).collect()]
    assert sorted(got) == brute_variants(words)
    assert any(r[1] and r[2] != r[1] for r in got), "some forms are followed further"


def test_spelling_edges(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty).count() == 0
    alone = spark.createDataFrame([("lonelyword", 4), ("otherwords", 40)], "word string, n long")
    assert sorted(map(tuple, spelling.variants(alone).collect())) == [("lonelyword", None, "lonelyword", 4, 0, None), ("otherwords", None, "otherwords", 40, 0, None)]
    with pytest.raises(ValueError):
        spelling.variants(alone, factor=1)


def test_vocabulary_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Éclaires", "éclaires", "ABCDEFG", "abcdefgh", "x1wordsword", "sixsix", "naïvement"]) for _ in range(40)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "planted words"), (7, None), (8, ""), (9, "1 2 3"), (0, texts[0]), (70, "q" * 50_000 + " " + "q" * 50_000)]
    want = Counter()
    for doc, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % 5 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            want[w] += 1
    got = dict(map(tuple, spelling.vocabulary(clashing(spark.createDataFrame(rows, DOCS)), min_len=7, min_count=2, drop_every=5).collect()))
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert spelling.vocabulary(spark.createDataFrame([], DOCS)).count() == 0
