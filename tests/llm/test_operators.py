"""Each numbered operator against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

import base64
import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revlens.llm import decontaminate, html, jaccard, langid, mixing, quality, sharding, substring, tokens, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """(doc_id, text, lang, source): copies, near copies, a shared passage, nulls, blanks, short and long texts, repeated rows."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(20, 120)) for _ in range(30)]
    shared = words(rng, 40)
    texts = base + base[:4] + [t.replace(" w1", " X1", 1) for t in base[4:12]] + [words(rng, 30) + " " + shared + "\n" + words(rng, 10) for _ in range(6)]
    texts += [None, "", " \n\t ", "one", "one two", "ONE two", words(rng, 30_000), "a\x0bb\x0cc é É", "x " * 60]
    rows = [(i + 1, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, base[1], "en", "a"), (3, words(rng, 40), "en", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, src, 0) for i, t, lang, src in corpus()]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    # columns whose names clash with those that the operators use inside
    return df.withColumns({c: F.lit("clash") for c in ("key", "token", "seed", "pos", "spans", "stratum", "bucket", "hash", "rank", "sketch")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def split(text):
    return (text or "").encode().split()


def test_substring_equals_brute_force(docs, none):
    rows = corpus()
    first = {}
    for i, t, *_ in rows:
        w = split(t)
        for j in range(len(w) - 12):
            if i is not None:
                k = tuple(w[j:j + 13])
                first[k] = min(first.get(k, i), i)
    want = []
    for i, t, *_ in rows:
        w = split(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j:j + 13])] < i:
                gone[j:j + 13] = [True] * 13
        want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    got = [tuple(r) for r in substring.drop_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substring.drop_repeats(none).count() == 0


def test_substring_tells_windows_of_one_seed_apart(spark):
    """The hashes of these two windows agree in their first 40 bits, and in the seed."""
    lead = "w9527 w5437 w2692 w4199 w382 w9799 w5763 a b c d e "
    rows = [(1, lead + "x3503751"), (2, lead + "x4238871"), (3, lead + "x3503751")]
    got = substring.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (2, 0), (3, 13)]


def test_substring_seed_is_no_group(spark, capsys):
    """A phrase with many continuations is spread over tasks by its windows; windows of seeds that don't repeat aren't sent."""
    lead = "w9527 w5437 w2692 w4199 w382 w9799 w5763 "  # a seed smaller than nearly all others
    rng = random.Random(3)
    rows = [(i, lead + words(rng, 6, 10**6)) for i in range(300)] + [(1000 + i, words(rng, 40, 10**6)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sent = df.mapInArrow(substring._windows(13, spark.sparkContext.broadcast(substring.repeated_seeds(df, 13))), substring.WINDOW_SCHEMA)
    assert {r["doc_id"] for r in sent.collect()} == set(range(300))
    per = sent.repartition(8, "seed", "window").groupBy("seed", F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per) == 300 and max(r["count"] for r in per) < 100
    substring.repeated_windows(df).explain()
    assert re.search(r"hashpartitioning\(seed#\d+L, window#\d+L", capsys.readouterr().out)


def test_substring_seeds_are_counted_across_blocks():
    block = [b" ".join(b"u%d" % i for i in range(20)), b" ".join(b"v%d" % i for i in range(20))]
    one = substring._count_rows([1, 2], block, 13).to_pydict()
    two = substring._count_rows([1, 2], [block[0], block[0]], 13).to_pydict()
    same = substring._count_rows([1, 1], [block[0], block[0]], 13).to_pydict()
    assert set(one["n"]) == {1} and set(two["n"]) == {2} and set(same["n"]) == {1} and set(two["seed"]) < set(one["seed"])


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(docs, none, k, num):
    rows = corpus()
    sets = []
    for _, t, *_ in rows:
        w = [x.lower() if x.isascii() else x.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in split(t)]
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and rows[a][0] is not None and rows[b][0] is not None and 100 * len(x & y) >= num * len(x | y):
                parent[top(a)] = top(b)
    low = defaultdict(list)
    for a, r in enumerate(rows):
        if r[0] is not None:
            low[top(a)].append(r[0])
    want = [(r[0], len(sets[a]), None if r[0] is None else min(low[top(a)])) for a, r in enumerate(rows)]
    got = [tuple(r) for r in jaccard.similar_sets(docs, k, num, 100).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert jaccard.similar_sets(none, k, num, 100).count() == 0


def test_jaccard_large_groups_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 5)
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 400)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + [f"own{i}"] + base[i:])) for i in range(1, 50)]  # each links with its neighbours at least
    got = jaccard.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect()
    assert {r["component_id"] for r in got} == {1}


@pytest.mark.parametrize("heads", [1, 6])
def test_jaccard_large_groups_equal_brute_force(spark, monkeypatch, heads):
    """Clouds of near copies of several centres, a common passage and strangers, with blocks of a few rows."""
    for name, value in (("BUCKET_ROWS", 4), ("GROUP_SHINGLES", 300), ("HEADS", heads)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(8)
    rows = []
    for c in range(3):
        base = [f"c{c}w{i}" for i in range(60)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(60)] = f"own{rng.randrange(10**6)}"
            rows.append(w)
    rows += [[f"s{rng.randrange(10**6)}" for _ in range(30)] + [f"c0w{i}" for i in range(30)] for _ in range(20)]
    rng.shuffle(rows)
    sets = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} for w in rows]
    top = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and top[a] != top[b]:
                low, high = sorted((top[a], top[b]))
                top = [low if t == high else t for t in top]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_sets(df, 3, 80, 100).collect()}
    assert [got[i] for i in range(len(rows))] == top


def test_jaccard_near_copies_travel_once(spark, monkeypatch):
    """Rows sent for a group of near copies grow with the group, not with its square."""
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 500)
    sent = []
    plain = jaccard._compared
    monkeypatch.setattr(jaccard, "_compared", lambda rows, group, *a: sent.append(rows.count()) or plain(rows, group, *a) if group == "root" else plain(rows, group, *a))
    for size in (40, 160):
        rows = [(i, " ".join([f"w{j}" for j in range(100)] + [f"own{i}"])) for i in range(size)]
        got = jaccard.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect()
        assert {r["component_id"] for r in got} == {0}
    assert sent[1] <= 5 * max(sent[0], 10)


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 70, 500, 3000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n - n // 10], rng.integers(0, 2**63, n // 3 + 1).astype(np.uint64)]))
        real = len(np.setxor1d(x, y))
        assert jaccard.differ(jaccard.sketch(x), jaccard.sketch(y)) <= real
        assert jaccard.differ(jaccard.sketch(x), jaccard.sketch(x)) == 0


def test_decontaminate_finds_reworded_items(spark, none):
    item = "Alice has 12 red apples and gives 5 of them to Bob today"
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, item), (4, "six words make one short item")], "item_id long, text string")
    rows = [(1, "intro words here " + item + " and more"), (2, "Well, " + item.replace("Alice", "Tom").replace("Bob", "Jane").replace("12", "9").replace("5", "4")),
            (3, item.replace("Alice", "Tom").replace("Bob", "Tom")),  # one name for two: inconsistent
            (4, item.upper()), (5, None), (6, ""), (7, "nothing in common with the others at all, really nothing " * 30), (None, item), (8, "Now: six words make one short item!"), (1, "intro words here " + item + " and more")]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 1), (4, 1), (8, 4)}
    assert {r["doc_id"] for r in found if r["n_reworded"] == r["n_windows"]} == {2}
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items.limit(0)).count() == 0
    left = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(map(str, (r["doc_id"] for r in left.collect()))) == ["3", "5", "6", "7", "None"]


NAMES = ["Tom", "Mary Jane", "Ana Lucia Cruz", "Ivo"]
PLACES = ["New York", "Oslo", "Rio de Janeiro", "Bath"]
NUMBERS = ["two hundred", "7", "twenty-five", "5 million"]
PRICES = ["$5", "90 cents", "€7", "three dollars"]


def test_decontaminate_finds_slots_of_several_words(spark):
    item = "Janet sells 16 eggs every morning at the market in Boston for 2 dollars each, and Bob buys 3 of them on a Friday"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    ask = "{} sells {} eggs every morning at the market in {} for {} each, and {} buys {} of them on a {}"
    rows, found = [], set()
    for n, (who, where, many, price) in enumerate((a, b, c, d) for a in NAMES for b in PLACES for c in NUMBERS for d in PRICES):
        rows.append((n, "Q. " + ask.format(who, many, where, price, "Zoe", "11", "Sunday")))
        if where != "Rio de Janeiro":  # "de" stands in lower case: two names and a word
            found.add(n)
    rows.append((1000, ask.format("Mary Jane", "two hundred", "New York", "$5", "Mary Jane", "4", "Sunday")))  # one name for two, windows apart
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    ids = {r["doc_id"] for r in got}
    assert found <= ids and 1000 not in ids
    assert all(r["n_reworded"] > 0 for r in got)


def _canonical(text, lower):
    """Tokens as (type or word, value), word by word."""
    import re
    out, gap = [], True
    fresh = True
    for word in text.split():
        body = word.strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))
        if not body:
            gap, fresh = True, fresh or any(c in ".!?:;" for c in word)
            continue
        at = word.index(body)
        head, tail, low = word[:at], word[at + len(body):], body.lower()
        fresh = fresh or any(c in ".!?:;" for c in head)
        clean = not gap and not head
        kind = None
        spelt = low in decontaminate.NUMBER_WORDS
        if spelt or re.fullmatch(r"[0-9]+([.,:/][0-9]+)*(st|nd|rd|th)?", low):
            kind = "amount" if head.endswith("$") or tail.startswith("%") else "number"
        elif low in decontaminate.UNITS:
            kind = "unit"
        elif low in decontaminate.PLAIN or fresh and low in lower:
            pass
        elif body[0].isupper() and body[1:] == low[1:]:
            kind = "name"
        before = out[-1] if out else None
        if clean and before and (kind == "name" == before[0] or before[0] in ("number", "amount") and not before[2] and (spelt or kind == "unit")):
            out[-1] = ("amount" if kind == "unit" else before[0], before[1] + " " + low, kind == "unit")
        else:
            out.append((kind, low, False))
        gap, fresh = bool(tail), any(c in ".!?:;" for c in tail)
    return [(k, v) for k, v, _ in out]


def test_tokens_equal_brute_force():
    rng = np.random.default_rng(4)
    words = ["Mary", "Jane", "two", "hundred", "5", "$5", "5%", "dollars", "km", "eggs,", "Eggs", "the", "The", "sells.", "(New", "York)", "twelve,", "3.5", "--", "Boston", "million"]
    lower = {"eggs", "sells"}
    cells = np.zeros(1 << decontaminate.LOWER_BITS, bool)
    cells[decontaminate._lower_cells(decontaminate.W.Block([b"eggs sells"]).codes)] = True
    names = {1: "number", 2: "unit", 3: "name", 4: "amount", 0: None}
    for _ in range(400):
        texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(3)]
        t = decontaminate.Tokens([x.encode() for x in texts], cells)
        of = t.of[t.first]
        for i, text in enumerate(texts):
            want = _canonical(text, lower)
            assert [names[k] for k in t.kind[of == i].tolist()] == [k for k, _ in want], text
            values = t.value[of == i].tolist()
            assert len(set(zip(values, (v for _, v in want), strict=True))) == len({v for _, v in want}) == len(set(values))


def test_decontaminate_recall_on_reparameterised_items(spark):
    """Every benchmark item with three slots put in, asked again with other values."""
    texts = [(r["item_id"], r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").filter("text is not null").collect()]
    rng = np.random.default_rng(5)
    items, docs = [], []
    for i, words in texts:
        at = sorted(rng.choice(len(words), 3, replace=False).tolist(), reverse=True)
        for rows, values in ((items, ("Janet", "16", "2 dollars")), (docs, (NAMES[i % 4], NUMBERS[i // 4 % 4], PRICES[i // 16 % 4]))):
            out = list(words)
            for a, v in zip(at, values, strict=True):
                out.insert(a, v)
            rows.append((i, ("" if rows is items else "Before it comes this. ") + " ".join(out)))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    right = {r["doc_id"] for r in found if r["doc_id"] == r["item_id"]}
    assert len(right) >= 0.9 * len(texts)
    assert all(r["doc_id"] == r["item_id"] for r in found)


def test_decontaminate_finds_items_of_mostly_slots(spark):
    texts = {1: "What is 12 percent of 450 dollars plus 30 dollars?", 2: "Convert 12 km to miles", 3: "Tom paid Ann 5 dollars",
             4: "Pay 5 kg 6 kg 7 kg or 8 kg 9 kg and 10 kg 11 kg by 12 kg now", 5: "12 13 14 15 16 17", 6: "Is 5 of 6 in 7 at 8"}
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    rows = [(1, "So: what is 15 percent of 820 dollars plus 44 dollars? Tell me."), (2, "convert it. Convert 30 km to miles"), (3, "Bob paid Sue 7 euros"),
            (4, "Pay 1 kg 2 kg 3 kg or 4 kg 5 kg and 60 kg 70 kg by 80 kg now"), (5, "22 23 24 25 26 27"), (50, "see 12 13 14 15 16 17"), (6, "was 15 percent or 820 dollars less 44 dollars"),
            (7, "1 kg 2 kg 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg"), (8, "Walk 30 minutes to work"), (9, "Is 15 of 15 in 17 at 18")]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 2), (3, 3), (4, 4), (50, 5)}


def test_decontaminate_finds_short_items_as_whole_lines(spark):
    items = spark.createDataFrame([(1, "Too short"), (2, "Define entropy."), (3, "...")], "item_id long, text string")
    rows = [(1, "too short!"), (2, "it is too short to tell"), (3, "Question\n  define entropy\nAnswer"), (4, "..."), (5, "entropy")]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (3, 2)}


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "line\nbreak", "x" * 3_000_000), (6, "http://c/", "\r\n\r\nWARC/1.1"), (None, "n", "<p>é</p>"), (2, "http://b/", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    index = warc.write_bundles(pages)
    got = warc.read_bundles(index)
    best = {"<p>é</p>": 2, "": 4, "x" * 3_000_000: 5, "\r\n\r\nWARC/1.1": 6}
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = i is not None and i != best[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", best[h or ""] if revisit else None))
    assert sorted([tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str) == sorted(want, key=str)
    one = warc.read_records(index, spark.createDataFrame([(6,), (5,)], "i long")).orderBy("page_id").collect()
    assert [r["payload"].decode() for r in one] == ["x" * 3_000_000, "\r\n\r\nWARC/1.1"]
    assert warc.read_bundles(warc.write_bundles(pages.limit(0))).count() == 0
    small = warc.read_bundles(warc.write_bundles(pages, min_bytes=9)).filter("page_id = 3").first()
    assert small["record_type"] == "response"


def test_quality_counts_equal_brute_force(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    want = []
    for i, t, *_ in corpus():
        w = [x.decode() for x in split(t)]
        at = defaultdict(list)
        for j in range(len(w) - 2):
            at[tuple(w[j:j + 3])].append(j)
        repeat = len({p for v in at.values() if len(v) > 1 for j in v for p in (j, j + 1, j + 2)})
        lines = [x for x in (t or "").split("\n") if split(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w)))
    got = quality.judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    assert quality.judge(none, labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).filter("kept = base_failed").count() == 0
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not x[-1] for x in want)


def test_binomial_tail_is_exact(spark):
    for n, k, p in ((50, 0, 0.02), (1000, 20, 0.02), (7, 7, 0.5), (3000, 41, 0.02)):
        got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        assert math.exp(got) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_certified_cutoffs_keep_clean_rows(spark):
    rows = [(i, "en", 100, 500, 0, 0, 0, 0, False, i % 5 > 0, i % 5 == 0) for i in range(3000)]
    rows = [(*r[:4], 90 if r[-1] else r[4], *r[5:]) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, base_failed boolean, clean boolean, bad boolean")
    got = {r["rule"]: r["cutoff"] for r in quality.thresholds(df).collect()}
    assert got == {"symbols": 160}  # the laxest of the cutoffs that catch all bad rows
    assert quality.thresholds(df.limit(60)).count() == 0  # too few rows to be sure


def test_sharding(docs, none, spark):
    table = sharding.lookup_table({"a": 1, "b": 1, "c": 2, "off": 0}, 1009)
    counts = {x: table.count(x) for x in set(table)}
    assert set(counts) == {"a", "b", "c"} and abs(counts["c"] - 2 * counts["a"]) <= 2
    more = sharding.lookup_table({"a": 1, "b": 1, "c": 2, "d": 1}, 1009)
    assert sum(x != y for x, y in zip(table, more, strict=True)) < 0.35 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table({"a": 1}, 1000)
    placed = sharding.place(docs, {"a": 1, "b": 1}, 1009)
    assert placed.columns == [*docs.columns, "slot", "shard"] and placed.count() == docs.count()
    two = sharding.lookup_table({"a": 1, "b": 1}, 1009)
    for r in placed.collect():
        key = str(r["doc_id"]) if r["doc_id"] is not None else r["text"] or ""
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 1009
        assert (r["slot"], r["shard"]) == (slot, two[slot])
    assert sharding.place(none, {"a": 1}).count() == 0


def test_token_counts_equal_the_library(docs, none, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = ["a<|endoftext|>b", "  x   y\n\n  z ", "  ", "don't I'LL 12345½", "é    x", "日本語 🙂🙂", "<|endoftext|>", " " * 999 + "x"]
    texts = [t for _, t, *_ in corpus()] + odd
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = sorted((r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(df, path).collect())
    assert got == sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    assert tokens.count_tokens(none, path).count() == 0


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html><head><title>t</title></head></html>", ""), ("a &lt; b &amp;amp; c", "a < b &amp; c"),
    ("<nav><a href=x>menu</a></nav><article><h1>T</h1><p>One <a href=y>link</a>\n two<script>'</p>'</script><p>x&nbsp;<b>y</b></article><footer>f</footer>", "T\nOne link two\nx y"),
    ("<body><header>top</header><p>" + "word " * 40 + "</p><p>short</p><aside>" + "side " * 90 + "</aside></body>", "word " * 39 + "word\nshort"),
    ("<div class='comments'><article><p>" + "reader " * 50 + "</p></article></div><main><p>body</p></main>", "body"),
    ("<article><p>a<!-- <p>no --></p><div class=\"ad\">buy</div><form>mail</form><p>b</p></article", "a\nb"),
    ("<p>" + "long " * 50_000, "long " * 49_999 + "long")])
def test_html(page, text, spark):
    assert html.main_text(page or "") == text


BODY = [f"Paragraph {i} of the body " + "tells more of it " * 12 for i in range(4)]


def test_html_distribution_decides_over_tags():
    body = "".join(f"<div>{x}</div>" for x in BODY)
    want = "\n".join(x.strip() for x in BODY)
    cards = "".join(f"<article><h3>Teaser {i}</h3><p>{'more to read ' * 9}</p></article>" for i in range(3))
    assert html.main_text(f"<body>{body}</body>") == want
    assert html.main_text(f"<body><div>{body}</div><section>{cards}</section></body>") == want  # only teasers are marked
    assert html.main_text(f"<body>{cards}<div>{body}</div></body>") == want
    assert html.main_text(f"<main>{body}{cards}</main>") == want
    assert html.main_text(f"<body><div>{'unmarked noise ' * 20}</div><article>{body}</article></body>") == want
    noise = "<hr><div><a href=a>Share</a></div><div><a href=b>Mail</a></div><div><a href=c>Print</a></div><div>12 views</div>"
    assert html.main_text(f"<main>{body}{noise}</main>") == want  # no listed class, in a marked element


@pytest.mark.parametrize("tag", ["article", "main"])
def test_html_marked_body_keeps_light_stretches(tag):
    body = "".join(f"<p>{x}</p>" for x in BODY)
    closing = "In the end the last paragraph weighs little, but it still belongs to the text and it has to be kept whole."
    advert = "<div class='ad'>Buy</div><div class='newsletter'>Join</div><ul class='related'><li>One</li><li>Two</li></ul>"
    assert html.main_text(f"<{tag}>{body}{advert}<p>{closing}</p></{tag}>").split("\n")[-1] == closing


def test_html_article_keeps_short_and_linked_lines():
    body = "".join(f"<p>{x}</p>" for x in BODY)
    advert = "<div class='ad'>Buy</div><div class='ad'>Buy</div><div class='ad'>Buy</div><div class='ad'>Buy</div>"
    got = html.main_text(f"<article>{body}<p>See <a href=x>the whole report of the year</a></p>{advert}<p>The end.</p></article>").split("\n")
    assert got[-2:] == ["See the whole report of the year", "The end."] and len(got) == len(BODY) + 2


@pytest.mark.parametrize("head", ["<h1>Short headline</h1><div>By A. Writer</div><div>1 May</div>", "<h1>Short</h1><h2>Sub</h2><div>By A. Writer</div><div>1 May</div>", "<h1><a href=x>Short headline</a></h1><p>By A. Writer</p><p>1 May</p>"])
def test_html_unmarked_headline(head):
    page = f"<body><div class='menu'><a href=a>Home</a></div><div>{head}" + "".join(f"<p>{x}</p>" for x in BODY) + "</div></body>"
    got = html.main_text(page)
    assert got.startswith("Short") and "By A. Writer\n1 May\n" + BODY[0].strip() in got


def test_html_unmarked_closing_paragraph_after_links():
    long = "A long paragraph of the text, with many words that say what the page is about. " * 12
    last = "And here is a closing paragraph that is short beside the first one but belongs to the text all the same."
    links = "".join(f"<li><a href=x>Source number {i}</a></li>" for i in range(3))
    got = html.main_text(f"<div id=top><a href=a>Home</a> <a href=b>About</a></div><div><p>{long}</p><ul>{links}</ul><p>{last}</p></div><footer>Copyright notice of the owner, all rights reserved, and more of it than one would like to read here.</footer>")
    assert got.split("\n") == [long.strip(), "Source number 0", "Source number 1", "Source number 2", last]
    far = "".join(f"<p><a href=x>Another link {i}</a></p>" for i in range(20))
    assert last not in html.main_text(f"<div><p>{long}</p>{far}<p>{last}</p></div>"), "far below, behind a long list of links, it is another text"


def _comment(who, when, text, tag="div", more=""):
    return f"<{tag}><b>{who}</b> <span>{when}</span><p>{text}</p>{more}</{tag}>"


LONG = "A long paragraph of the article tells what happened in the town that day, and goes on for more than enough. " * 2
TWO = _comment("Anna", "3 May 2020", "I liked this text very much, thanks for the long work.") + _comment("Bob Hill", "2 hours ago", "I did not like it. " * 12)


@pytest.mark.parametrize("page", [
    f"<div><h1>Title of it</h1><p>By Eve, 1 May 2020</p><p>{LONG}</p><div id=discussion>{TWO}</div><p>{LONG}</p></div>",  # named
    f"<article><h1>Title of it</h1><p>By Eve, 1 May 2020</p><p>{LONG}</p><h2>2 Comments</h2>{TWO}<p>{LONG}</p></article>",  # titled
    f"<article><h1>Title of it</h1><p>By Eve, 1 May 2020</p><p>{LONG}</p><p>Comments</p><p>Anna, 3.5.2020</p><p>Nice.</p><h6>x</h6><p>{LONG}</p></article>",  # no blocks
    f"<main><h1>Title of it</h1><p>By Eve, 1 May 2020</p><p>{LONG}</p><ul>"  # answers
    + "".join(_comment(x, "il y a 2 heures", LONG, "li", "<p>Reply</p>") for x in ("Al", "Al")) + f"</ul><p>{LONG}</p></main>",
    f"<div><h1>Title of it</h1><p>By Eve, 1 May 2020</p><p>{LONG}</p></div><ul>"  # names and times alone, outside an article
    + "".join(_comment(x, "2020-05-03", LONG, "li") for x in ("Al", "Bo", "Cy")) + f"</ul><p>{LONG}</p>",
])
def test_html_reader_comments_by_structure(page):
    long = LONG.strip()
    assert [x for x in html.main_text(page).split("\n") if x != "x"] == ["Title of it", "By Eve, 1 May 2020", long, long]


@pytest.mark.parametrize("body", [
    f"<h2>Discussion</h2><p>Updated 3 May 2020</p><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>{LONG}</p></section>",
    "<ul>" + "".join(f"<li><b>{t}</b><p>{LONG}</p></li>" for t in ("10:45", "11:45", "12:45")) + "</ul>",  # a live report
    "".join(_comment(x, "3 May 2020", LONG) for x in ("Berlin", "Rome", "Oslo")),  # a diary, in an article
    f"<p>Comments are welcome.</p><p>{LONG}</p><p>Report of 3 May 2020</p><p>{LONG}</p>",
])
def test_html_dated_parts_of_an_article_stay(body):
    page = f"<article><p>{LONG}</p>{body}<p>The end.</p></article>"
    assert html.main_text(page) == "\n".join(x[0] for x in html.Lines(page).lines)
    assert all(x[2] for x in html.Lines(page).lines)


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", None), (None, None, "<p>x</p>")], "page_id long, url string, html string")
    assert sorted([tuple(r) for r in html.extract_text(pages).collect()], key=str) == [(1, "u", ""), (None, None, "x")]
    assert html.extract_text(pages.limit(0)).count() == 0


def test_language_gradients():
    def wide(x):
        return [wide(y) for y in x] if isinstance(x, list) else x.astype(np.float64)

    m = langid.new_model(["a", "b", "c"], 4)
    m = langid.Model(m.labels, wide(m.embed), wide(m.state), wide(m.out), wide(m.bias))
    seg, keep = langid.pack([b"hello world", b"foo" * 10, b"xyz"])
    y, rng = np.array([0, 1, 2]), np.random.default_rng(2)
    _, grads = langid.gradients(m, seg, keep.astype(np.float64), y)
    for p, g in zip(m.params(), grads, strict=True):
        i = tuple(int(rng.integers(n)) for n in p.shape)
        old, e = p[i], 1e-6
        p[i] = old + e
        up = langid.gradients(m, seg, keep, y)[0]
        p[i] = old - e
        down = langid.gradients(m, seg, keep, y)[0]
        p[i] = old
        assert (up - down) / (2 * e) == pytest.approx(g[i], abs=1e-7)


def test_language_held_out(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 -- 34", "en", "s", 0), (None, "the end of it", None, "s", 0)], DOCS)
    learn = F.col("doc_id") % 4 != 0
    got = langid.identify(docs.unionByName(odd), learn).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(got) == docs.count() + 3
    held = [r for r in got if r["doc_id"] is not None and not r["learned"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (10**6, 10**6 + 1)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(none).count() == 0


def test_every_language_is_learned(spark):
    rows = [(100 * k + i, f"text {k} {i} of a language", f"l{k:02d}") for k in range(70) for i in range(3 if k < 69 else 1)]
    sample = langid.training_segments(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang for lang, _ in sample} == {f"l{k:02d}" for k in range(70)}
    assert len(sample) == len(rows) * langid.SAMPLE_SEGMENTS


def test_sample_is_shared_among_languages():
    assert langid.shared([10**9] * 4, 200) == 200
    assert langid.shared([10**9] * 100, 200) == 128
    assert langid.shared([10**9] * 64 + [1] * 64, 200) == 199
    assert langid.shared([5] * 20_000, 200) == 1


def test_mixing_fills_quotas(docs, none, spark):
    target = mixing.Target(max_repeat=1.2, budget=1.5)
    got = mixing.mix(docs, target)
    assert got.columns == [*docs.columns, "block", "position_key"]
    size = {id_: len(split(t)) for id_, t, *_ in corpus()}
    by = defaultdict(list)
    for r in got.collect():
        by[r["source"]].append(r)
    total = defaultdict(int)
    for _, t, _, s in corpus():
        total[s] += len(split(t))
    whole = sum(total.values())
    share = {s: n / whole for s, n in total.items()}

    def weights(t):
        z = sum(p**t for p in share.values())
        return {s: p**t / z for s, p in share.items()}

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        fits = max(w / share[s] * 1.5 for s, w in weights(mid).items()) <= 1.2
        low, high = (low, mid) if fits else (mid, high)
    for s, w in weights(high).items():
        taken = sum(len(split(r["text"])) for r in by[s])
        assert w * whole * 1.5 - 1 <= taken <= w * whole * 1.5 + max(size.values()) * 3
        for block in {r["block"] for r in by[s]} - {max(r["block"] for r in by[s])}:
            assert sum(r["block"] == block for r in by[s]) == sum(x[3] == s for x in corpus())
    assert mixing.mix(none, target).count() == 0


def test_exponent_meets_an_entropy(spark):
    sources = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "source_key string, share double")
    t = mixing.exponent(sources, mixing.Target(entropy=1.0))
    p = np.array([0.7, 0.2, 0.1]) ** t
    p /= p.sum()
    assert -(p * np.log(p)).sum() == pytest.approx(1.0, abs=1e-6)
    assert mixing.exponent(sources, mixing.Target(entropy=2.0)) == 0.0


def test_quality_rejects_alpha_of_a_stratum_at_most(spark):
    """Rules that each hit other clean rows: what is chosen rejects no more than alpha of them together."""
    rows = []
    for i in range(12_000):
        part = i % 1000
        hit = part // 14 if part < 56 else -1  # four sets of 1.4 percent each
        bad = i >= 10_000
        n = 100
        rows.append((i, "en", n, 2000 if hit == 0 or bad else 500, 90 if hit == 1 or bad else 0, 9 if hit == 2 or bad else 0, 10, 45 if hit == 3 or bad else 0, not bad, bad))
    df = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, clean boolean, bad boolean")
    df = df.withColumn("base_failed", F.lit(False))
    cut = quality.thresholds(df).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in quality.RULES])
    judged = df.join(cut, "stratum", "left").withColumn("gone", quality.verdict())
    clean = judged.filter("clean")
    assert clean.filter("gone").count() <= quality.ALPHA * clean.count()
    # with few hits on clean rows the same rules are certified and catch the bad ones
    calm = df.withColumns({c: F.when(F.col("clean"), F.lit(0 if c != "word_chars" else 500)).otherwise(F.col(c)) for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")})
    cut = quality.thresholds(calm).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in quality.RULES])
    judged = calm.join(cut, "stratum", "left").withColumn("gone", quality.verdict())
    assert judged.filter("gone AND bad").count() == 2000 and judged.filter("gone AND clean").count() == 0


def test_langid_numbers_are_no_letters():
    from revlens.llm.langid import _LETTER
    assert not any(_LETTER.search(t) for t in ("\u00bd", "\u00b2", "\u2167", "12 3", "_", "")) and all(_LETTER.search(t) for t in ("a", "\u00e9", "\u6f22", "\u02b0"))


def test_columns_of_any_name_are_kept(spark):
    names = ("full", "last_key", "source_key", "mix_id", "tokens", "row", "key", "bucket", "block", "_id_", "_text_", "fail_id", "stratum", "mark", "document", "hit")
    docs = spark.createDataFrame([(i, "some words here " * 30, "en", "s", 0) for i in range(6)], DOCS)
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "not in any of these documents at all, nor anywhere else in fact")], "item_id long, text string")
    mixed = mixing.mix(wide, mixing.Target(max_repeat=1.25))
    for got in (mixed.drop("block", "position_key"), quality.keep(wide, labels), decontaminate.decontaminate(wide, items)):
        for r in got.collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names if n in got.columns)
    assert {"full", "mix_id", "position_key"} <= set(mixed.columns) and quality.keep(wide, labels).columns == wide.columns
