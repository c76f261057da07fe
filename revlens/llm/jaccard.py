"""Operator 3: n-gram Jaccard join with prefix, length, positional and suffix filters.

1. Document frequencies of shingles go into a table of 2^21 counters, summed
   over all texts. Its size is fixed, so it may be broadcast. It only sets the
   rare-first order (counter, then hash); any total order gives the same links.
2. Each set sends its prefix: for a similarity t and n shingles the n -
   ceil(t n) + 1 rarest, with n and the position. Sets that are equal share a
   key, and a key is sent once per block, so copies don't multiply.
3. Prefix rows meet at their shingle, sorted by n. A row without a partner of
   fitting length beside it is dropped while the rows stream by.
4. The remaining rows meet once more with parity sketches of their sets;
   length, positional and suffix (sketch) filters decide which sets may link.
   A pair that can't be excluded joins two candidate groups; the output is a
   spanning forest, never all pairs.
5. The sets of each candidate group are compared exactly, once per pair, and a
   pair whose ends are already connected is skipped.

Groups in 4 and 5 that are larger than a block are compared with a few of their
own rows first; rows that this connects need no comparison with each other, and
the rest is split into pairs of blocks that go to different tasks. So no group
is gathered in one place, and near copies aren't sent once for every block.

A set's key is a 64-bit hash of its shingles: among N different sets, the
chance that two share a key is about N^2 / 2^65.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm import words as W
from revlens.llm.graph import components
from revlens.llm.store import stored

CELL_BITS = 21
CELLS = 1 << CELL_BITS
PARTS = 64
BUCKET_ROWS = 4000      # prefix rows of one shingle compared in one task
GROUP_SHINGLES = 100_000  # shingles of one block of a candidate group
HEADS = 6               # rows of a larger group that all its rows are compared with first
SETS = 4000             # sets, about, that a task compares at the least

ROW_SCHEMA = "token long, key long, n int, pos int, doc_id long, sketch binary"
ROW = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()),
                 ("doc_id", pa.int64()), ("sketch", pa.binary())])
EDGE_SCHEMA = "a long, b long"
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text, its sorted distinct hashes of k-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = W.Block([t.translate(W.ASCII_LOWER) for t in texts])
    n = len(words.codes) - k + 1
    every = W.window_hashes(words.codes, k)
    out = []
    for i, (a, m) in enumerate(zip(words.first.tolist(), words.count.tolist(), strict=True)):
        if not m:
            out.append(np.empty(0, np.uint64))
        elif m < k:
            out.append(W.window_hashes(words.of(i), m))
        else:
            out.append(np.unique(every[a:min(a + m - k + 1, n)]))
    return out


def set_key(s: np.ndarray) -> int:
    """64-bit key of a set, as a signed integer; 0 for the empty set."""
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def sketch(s: np.ndarray, per_bit: int = 2) -> int:
    """Parity of the shingles that fall on each of m bits; m is a power of two near n / per_bit, 64 at least.

    For two sets, the bits that differ are at most the shingles that differ.
    """
    m = 64
    while m * per_bit < len(s):
        m *= 2
    bits = (np.bincount((s >> np.uint64(11)).astype(np.int64) & (m - 1), minlength=m) & 1).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes() + b"\1", "little")  # the last byte marks m


def differ(x: int, y: int) -> int:
    """Bits in which two sketches differ, the longer one folded to the shorter one's length."""
    while x.bit_length() > y.bit_length():
        x = _fold(x)
    while y.bit_length() > x.bit_length():
        y = _fold(y)
    return (x ^ y).bit_count()


def _fold(x: int) -> int:
    m = x.bit_length() - 1
    half = m // 2
    body = x ^ (1 << m)
    return (body >> half) ^ (body & ((1 << half) - 1)) | (1 << half)


class Rule:
    """Two sets link when den * |intersection| >= num * |union|."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def lengths(self, small, large):
        return self.den * small >= self.num * large

    def overlap(self, total):
        """Least intersection for two sets with so many shingles together."""
        return -(-self.num * total // (self.num + self.den))


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for _, texts in W.blocks(batch, need_id=False):
                _tally(table, shingle_sets(texts, k))
        for p, part in enumerate(table.reshape(PARTS, -1)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": [p], "counts": [zlib.compress(part.tobytes(), 1)]})
    return run


def _tally(table: np.ndarray, sets: list[np.ndarray]) -> None:
    if sets:
        cells = (np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        table += np.bincount(cells, minlength=CELLS).astype(np.uint32)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, c in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(c), np.uint32)
            sums[p] = sums[p] + part if p in sums else part
    for p, part in sums.items():
        yield pa.RecordBatch.from_pydict({"part": [p], "counts": [zlib.compress(part.tobytes(), 1)]})


def frequency_table(src: DataFrame, k: int) -> np.ndarray:
    """Counters of the shingles of all texts: CELLS entries, whatever the input."""
    rows = (src.mapInArrow(_count(k), "part long, counts binary")
            .repartition(PARTS, "part").mapInArrow(_add, "part long, counts binary").collect())
    table = np.zeros((PARTS, CELLS // PARTS), np.uint32)
    for r in rows:
        table[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return table.reshape(-1)


def _prefixes(k: int, rule: Rule, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = table.value
        for batch in batches:
            sent: set[int] = set()
            for ids, texts in W.blocks(batch, need_id=False):
                out = []
                for doc, s in zip(ids, shingle_sets(texts, k), strict=True):
                    n, key = len(s), set_key(s)
                    out.append((np.array([xxhash.xxh64_intdigest(str(doc).encode()) - (1 << 63)]), key, n, np.array([-1], np.int32), doc,
                                None if not n else (x := sketch(s)).to_bytes(-(-x.bit_length() // 8), "little")))
                    if n and doc is not None and key not in sent:
                        sent.add(key)
                        rare = np.lexsort((s, df[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))[:rule.prefix(n)]
                        out.append((W.signed(s[rare]), key, n, np.arange(len(rare), dtype=np.int32), None, None))
                yield _rows(out)
    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    token, key, n, pos, doc, sk = zip(*out, strict=True)
    m = np.array([len(x) for x in token])
    spread = np.repeat(np.arange(len(m)), m)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate(token)), pa.array(np.array(key, np.int64)[spread]), pa.array(np.array(n, np.int32)[spread]),
        pa.array(np.concatenate(pos)), pa.array(doc, pa.int64()).take(pa.array(spread)), pa.array(sk, pa.binary()).take(pa.array(spread))], schema=ROW)


def _with_partner(rule: Rule):
    """Of rows sorted by (token, n, key): document rows, and prefix rows with a partner of fitting length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, active = None, False  # the last prefix row, and whether the row before it fits
        for batch in batches:
            is_doc = batch.column("pos").to_numpy() < 0
            if is_doc.any():
                yield batch.filter(pa.array(is_doc))
            part = pa.Table.from_batches([batch.filter(pa.array(~is_doc))])
            part = pa.concat_tables([held, part]).combine_chunks() if held is not None else part.combine_chunks()
            if not part.num_rows:
                continue
            token, key = part["token"].to_numpy(), part["key"].to_numpy()
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            part = part.filter(pa.array(new))
            token, n = token[new], part["n"].to_numpy().astype(np.int64)
            fits = (token[1:] == token[:-1]) & rule.lengths(n[:-1], n[1:])
            keep = np.zeros(len(token), bool)
            keep[1:] |= fits
            keep[:-1] |= fits
            keep[0] |= active
            held, active = part.slice(len(token) - 1), bool(keep[-1])
            keep[-1] = False
            yield from part.filter(pa.array(keep)).to_batches()
        if active:
            yield from held.to_batches()
    return run


class _Groups:
    """Union-find over the members of one block pair, by labels."""

    def __init__(self, keys: list[int]):
        self.keys, self.label = keys, np.arange(len(keys))

    def join(self, i: int, others: np.ndarray) -> None:
        self.label[np.isin(self.label, self.label[others])] = self.label[i]

    def edges(self) -> list[tuple[int, int]]:
        root: dict[int, int] = {}
        for x, k in zip(self.label.tolist(), self.keys, strict=True):
            root[x] = min(root.get(x, k), k)
        return [(k, root[x]) for x, k in zip(self.label.tolist(), self.keys, strict=True) if root[x] != k]


def _link(g: dict[str, list], rule: Rule, sketches: list[int], fits) -> list[tuple[int, int]]:
    """Edges among the rows of a block pair. fits(i, j): whether the filters or the exact comparison let i and j link."""
    n = np.array(g["n"], np.int64)
    order = np.argsort(n, kind="stable")
    pos = np.array(g["pos"], np.int64) if "pos" in g else None
    block = np.array(g["block"])
    cross = g["bi"][0] != g["bj"][0]
    found = _Groups([g["key"][i] for i in order])
    n, block = n[order], block[order]
    if pos is not None:
        pos = pos[order]
    for i in range(len(order) - 1):
        rest = slice(i + 1, i + 1 + int(np.searchsorted(n[i + 1:] * rule.num, n[i] * rule.den, "right")))
        ok = found.label[rest] != found.label[i]
        if cross:
            ok &= block[rest] != block[i]
        if pos is not None:
            most = np.minimum(pos[i], pos[rest]) + 1 + np.minimum(n[i] - pos[i], n[rest] - pos[rest]) - 1
            ok &= most >= rule.overlap(n[i] + n[rest])
        for j in (np.flatnonzero(ok) + i + 1).tolist():
            if found.label[j] == found.label[i]:
                continue
            total = int(n[i] + n[j])
            if differ(sketches[order[i]], sketches[order[j]]) <= total - 2 * rule.overlap(total) and fits(order[i], order[j]):
                found.join(i, np.array([j]))
    return found.edges()


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGE)


def _sketch_test(rule: Rule):
    """Whether the filters let two prefix rows of one shingle link."""
    def fits(x: dict, y: dict) -> bool:
        small, large, total = min(x["n"], y["n"]), max(x["n"], y["n"]), x["n"] + y["n"]
        least = rule.overlap(total)
        most = min(x["pos"], y["pos"]) + min(x["n"] - x["pos"], y["n"] - y["pos"])
        return (rule.lengths(small, large) and most >= least
                and differ(int.from_bytes(x["sketch"], "little"), int.from_bytes(y["sketch"], "little")) <= total - 2 * least)
    return fits


def _common(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _exact_test(rule: Rule):
    """Whether two sets link."""
    def fits(x: dict, y: dict) -> bool:
        total = x["n"] + y["n"]
        return (rule.lengths(min(x["n"], y["n"]), max(x["n"], y["n"]))
                and _common(np.frombuffer(x["items"], np.uint64), np.frombuffer(y["items"], np.uint64)) >= rule.overlap(total))
    return fits


def _to_heads(group: str, test):
    """For each row of a block, which of its group's heads it links with: a bit for each, and their keys."""
    schema = pa.schema([(group, pa.int64()), ("key", pa.int64()), ("blocks", pa.int32()), ("mask", pa.int32()), ("linked", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in W.grouped(batches, [group, "salt"]):
            rows = [dict(zip(g, r, strict=True)) for r in zip(*g.values(), strict=True)]
            heads = sorted((r for r in rows if r["head"]), key=lambda r: r["key"])
            out = []
            for r in rows:
                if not r["head"]:
                    hit = [i for i, h in enumerate(heads) if h["key"] == r["key"] or test(h, r)]
                    out.append((r[group], r["key"], r["blocks"], sum(1 << i for i in hit), [heads[i]["key"] for i in hit]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    return run


def _cores(group: str):
    """For each group, the heads of its largest connected part, as bits, and the share of rows outside it."""
    schema = pa.schema([(group, pa.int64()), ("blocks", pa.int32()), ("core", pa.int32()), ("outside", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts: list[int] = []
                for m in r["masks"]:
                    joined = m["mask"]
                    for p in [p for p in parts if p & joined]:
                        parts.remove(p)
                        joined |= p
                    if joined:
                        parts.append(joined)
                total = sum(m["rows"] for m in r["masks"])
                size = {p: sum(m["rows"] for m in r["masks"] if m["mask"] & p) for p in parts}
                core = max(parts, key=lambda p: (size[p], p), default=0)  # noqa: B023
                out.append((r[group], r["blocks"], core, 1 - size.get(core, 0) / total))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    return run


def _pairs(df: DataFrame, group: str, test, stage, parts: int) -> DataFrame:
    """Edges among the rows of each group, found by ``stage`` in blocks (``blocks``: how many the group's rows fill).

    A group of one block is compared there. In a larger one, every row is
    first compared with HEADS of its rows, which travel to all blocks. Rows
    that link with heads which are linked among themselves form the core; no
    pair inside it can connect anything new. Only pairs of blocks with a row
    outside the core are left, so a group of near copies costs what it holds.
    """
    small = df.filter("blocks = 1").drop("blocks").withColumns({c: F.lit(0) for c in ("block", "bi", "bj")})
    big = stored(df.filter("blocks > 1"), "big-groups")
    if big.isEmpty():
        return _compared(small, group, stage, parts)
    salt = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    order = Window.partitionBy(group).orderBy(F.xxhash64("key", group), "key")
    heads = big.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= HEADS).drop("at")
    met = heads.withColumn("salt", every).withColumn("head", F.lit(True)).unionByName(big.withColumn("salt", salt).withColumn("head", F.lit(False)))
    marked = stored(met.repartition(parts, group, "salt").sortWithinPartitions(group, "salt")
                    .mapInArrow(_to_heads(group, test), f"{group} long, key long, blocks int, mask int, linked array<long>"), "heads")
    masks = marked.groupBy(group, "blocks", "mask").agg(F.count(F.lit(1)).alias("rows"))
    cores = (masks.groupBy(group, "blocks").agg(F.collect_list(F.struct("mask", "rows")).alias("masks"))  # at most 2^HEADS
             .mapInArrow(_cores(group), f"{group} long, blocks int, core int, outside double")
             .withColumn("salt", every).drop("blocks"))
    rows = (big.join(marked.select(group, "key", "mask"), [group, "key"]).withColumn("salt", salt).join(cores, [group, "salt"])
            .withColumn("out", F.ceil(F.col("blocks") * F.col("outside")).cast("int")))
    inside = F.col("mask").bitwiseAND(F.col("core")) != 0
    rows = rows.withColumn("block", F.when(inside, F.col("out") + F.col("salt")).otherwise(F.pmod(F.xxhash64("key"), F.col("out")).cast("int")))
    last = F.when(inside, F.col("out")).otherwise(F.col("out") + F.col("blocks")) - 1
    rows = rows.filter("out > 0").withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).select(*small.columns)
    direct = marked.select(F.col("key").alias("a"), F.explode("linked").alias("b"))
    return _compared(small.unionByName(rows), group, stage, parts).unionByName(direct)


def _compared(rows: DataFrame, group: str, stage, parts: int) -> DataFrame:
    return rows.repartition(parts, group, "bi", "bj").sortWithinPartitions(group, "bi", "bj").mapInArrow(stage, EDGE_SCHEMA)


def _candidates(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in W.grouped(batches, ["token", "bi", "bj"]):
            if len(g["key"]) > 1 and (edges := _link(g, rule, [int.from_bytes(x, "little") for x in g["sketch"]], lambda i, j: True)):
                yield _edge_batch(edges)
    return run


def _verified(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in W.grouped(batches, ["root", "bi", "bj"]):
            if len(g["key"]) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in g["items"]]

            def fits(i, j, sets=sets):
                return _common(sets[i], sets[j]) >= rule.overlap(len(sets[i]) + len(sets[j]))

            if edges := _link(g, rule, [sketch(s, 1) for s in sets], fits):
                yield _edge_batch(edges)
    return run


def _sets(k: int):
    schema = pa.schema([("root", pa.int64()), ("blocks", pa.int32()), ("key", pa.int64()), ("n", pa.int32()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, texts in W.blocks(batch, need_id=False):
                part = batch.slice(at, len(texts))
                at += len(texts)
                sets = shingle_sets(texts, k)
                rows = [(root, blocks, key, len(s), s.tobytes()) for s, root, blocks, key in
                        zip(sets, *(part.column(c).to_pylist() for c in ("root", "blocks", "key")), strict=True)
                        if set_key(s) == key]  # not another text under a repeated id
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    return run


def similar_sets(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents grouped by chains of links between their shingle sets.

    Returns one row per input row: doc_id, n_shingles and component_id, the
    smallest doc_id that links lead to (its own if there are none).

    Nulls and edges: a null, empty or blank text has an empty set and links
    with nothing; a text of fewer than k words is one shingle; a row without
    an id links with nothing and has a null component; repeated rows give
    repeated results, and different texts under one id are separate sets; an
    empty table gives an empty result; other columns are ignored.
    """
    spark, rule = docs.sparkSession, Rule(num, den)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = spark.sparkContext.broadcast(frequency_table(src, k))
    rows = stored(src.mapInArrow(_prefixes(k, rule, table), ROW_SCHEMA).repartition("token")
                  .sortWithinPartitions("token", "n", "key").mapInArrow(_with_partner(rule), ROW_SCHEMA), "prefix")
    all_docs = rows.filter("pos < 0").select("doc_id", "key", "n", "sketch")
    with_set = all_docs.filter("n > 0 AND doc_id IS NOT NULL")
    classes = with_set.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))

    active = rows.filter("pos >= 0").select("token", "key", "n", "pos")
    sketches = (with_set.join(active.select("key").distinct(), "key", "left_semi")
                .groupBy("key").agg(F.first("sketch").alias("sketch")))
    hot = active.groupBy("token").count().filter(F.col("count") > BUCKET_ROWS).select(
        "token", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("blocks"))
    bucket = active.join(hot, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).join(sketches, "key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # numbered: rows of few bytes may cost much
    star = components(_pairs(bucket, "token", _sketch_test(rule), _candidates(rule), parts))

    member = star.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(
        star.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()).join(classes, "key")
    size = member.groupBy("root").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).cast("int").alias("blocks"))
    member = member.join(size, "root").select(F.col("rep").alias("doc_id"), "root", "blocks", "key")
    sets = src.join(member, "doc_id").select("doc_id", "text", "root", "blocks", "key").mapInArrow(
        _sets(k), "root long, blocks int, key long, n int, items binary").dropDuplicates(["root", "key"])
    parts = max(parts, star.count() // SETS)
    linked = components(_pairs(stored(sets, "sets"), "root", _exact_test(rule), _verified(rule), parts)).select(F.col("u").alias("key"), F.col("v").alias("top"))

    top = classes.join(linked, "key", "left").withColumn("top", F.coalesce("top", "key"))
    first = top.groupBy("top").agg(F.min("rep").alias("component_id"))
    by_key = top.join(first, "top").select("key", "component_id", F.lit(True).alias("has"))
    return (all_docs.withColumn("key", F.when(F.expr("n > 0 AND doc_id IS NOT NULL"), F.col("key")))
            .join(by_key, "key", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
