"""Operator 11: SimHash near-duplicates through keys of the binary Golay code.

1. A text's fingerprint has 64 bits: bit b is 1 if more than half of the XXH64
   hashes of its word shingles (repeats included) have bit b.
2. Equal fingerprints are one class, represented once from here on, so copies
   are reduced by a partial aggregate and never compared.
3. A fingerprint is cut into four segments of 16 bits. Two fingerprints that
   differ in 3 bits or fewer have a segment without errors whose next segment
   has one error at most: with two or more faultless segments, at most one of
   their successors holds two or more errors; with one, the other three hold
   one each.
4. A segment, read as a word of the perfect (23, 12) Golay code, is decoded to
   all codewords at distance 4 or less: the nearest alone if that is 2 or
   less away, else six. Words at distance 1 share one: the nearest codeword of
   the one is among the other's. A key is (segment number, its 16 bits, index
   of a codeword of the next segment), 28 bits besides the number; each
   fingerprint has 4 to 24 of them.
5. Fingerprints meet at their keys; a pair is looked at if the key stems from
   the nearest codeword of one of the two, and verified by counting bits.
6. A key with more than ``BUCKET`` fingerprints is refined: the other two
   segments hold 3 errors at most, so one of them has 1 or fewer, and its
   codeword joins the key (40 bits). What is still larger than ``BLOCK`` is
   dealt out as pairs of blocks, so no group is gathered in one task.

Only the links that connect something new leave a task, never all pairs.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import words as W
from revlens.llm.graph import components
from revlens.llm.store import stored

SEED = 42
MAX_BITS = 3          # what the keys guarantee
CHUNK = 1 << 16       # shingles whose bits are counted at once
BUCKET = 4096         # fingerprints of one key compared in one task; beyond it the key is refined
BLOCK = 1 << 15       # fingerprints of one block of a refined key
ROWS = 1 << 16        # key rows worked on at once

# Fixed values of the binary Golay code: length, check bits, generator x^11+x^10+x^6+x^5+x^4+x^2+1
LENGTH, CHECKS, GENERATOR = 23, 11, 0b110001110101

PRINT_SCHEMA = "doc_id long, fp long"
KEY_SCHEMA = "key long, fp long, near boolean"
KEY = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("near", pa.bool_())])
EDGE_SCHEMA = "a long, b long"
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, k: int = 3) -> int:
    """64-bit SimHash of a text's k-word shingles, A-Z lower-cased; a shorter text is one shingle, no words give 0."""
    words = text.translate(W.ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = max(len(words) - k + 1, 1)
    pieces = zip(starts[:m].tolist(), ends[min(k, len(words)) - 1:].tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pieces), "<u8", m)
    ones = np.zeros(64, np.int64)
    for at in range(0, m, CHUNK):
        bits = np.unpackbits(hashes[at:at + CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > m, bitorder="little").view("<u8")[0])


def _prints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, k) for t in W.texts(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(W.signed(fps))], names=["doc_id", "fp"])
    return run


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator; 0 for codewords."""
    x = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - CHECKS)), x)
    return x


@functools.cache
def codeword_table() -> np.ndarray:
    """For each 16-bit segment, the indices of the codewords at distance 4 or less: the nearest first, -1 for none."""
    patterns = np.array([sum(1 << b for b in c) for e in range(5) for c in itertools.combinations(range(LENGTH), e)], np.int64)
    errors = np.full((1 << CHECKS, 6), -1, np.int64)  # by syndrome: the patterns that lead to a codeword, lightest first
    found = np.zeros(1 << CHECKS, np.int64)
    for p, s in zip(patterns.tolist(), _syndromes(patterns).tolist(), strict=True):
        errors[s, found[s]] = p
        found[s] += 1
    segments = np.arange(1 << 16, dtype=np.int64)
    to = errors[_syndromes(segments)]
    return np.where(to >= 0, (segments[:, None] ^ to) >> CHECKS, -1)


def _expand(fp: np.ndarray, prefix: np.ndarray, segment: np.ndarray, near: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(key, fp, near) for each codeword of the segments, below the given prefixes."""
    to = codeword_table()[segment]
    row, col = np.nonzero(to >= 0)
    first = col == 0
    return prefix[row] << 12 | to[row, col], fp[row], first if near is None else first & near[row]


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    x = fp.view(np.uint64)
    return [(x >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]


def _key_batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=KEY)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        seg = _segments(fp)
        yield _key_batch([_expand(fp, i << 16 | seg[i], seg[(i + 1) % 4]) for i in range(4)])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of rows whose key is crowded, with a codeword of one of the two segments that it doesn't hold."""
    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        near = batch.column("near").to_numpy(zero_copy_only=False)
        seg = np.stack(_segments(fp))
        number, row = key >> 28, np.arange(len(key))
        yield _key_batch([_expand(fp, (1 << 31 | key) << 1 | i, seg[(number + 2 + i) % 4, row], near) for i in (0, 1)])


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i[n] and j[n]; parent holds the smallest member of each row's set."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _linked(fp: np.ndarray, near: np.ndarray, end: np.ndarray, block: np.ndarray | None, bits: int) -> np.ndarray:
    """For rows in runs (end: where a row's run ends), the first row that links lead to within its run."""
    x = fp.view(np.uint64)
    parent = np.arange(len(x))
    step, at = 1, np.flatnonzero(end > np.arange(len(x)) + 1)
    while len(at):
        to = at + step
        ok = (near[at] | near[to]) & (np.bitwise_count(x[at] ^ x[to]) <= bits)
        if block is not None:
            ok &= block[at] != block[to]
        if ok.any():
            _union(parent, at[ok], to[ok])
        step += 1
        at = at[end[at] > at + step]
    return parent


def _verified(bits: int, names: tuple[str, ...]):
    """Links among the rows of each run of equal ``names``; rows come sorted by them."""
    def edges(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        cols = [rows[n].to_numpy() for n in names]
        new = np.ones(rows.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, rows.num_rows))
        keep = np.repeat(size > 1, size)
        fp, near = rows["fp"].to_numpy()[keep], rows["near"].to_numpy()[keep]
        end = np.repeat(np.cumsum(size[size > 1]), size[size > 1])
        block = None
        if "bi" in names:
            block = np.where((rows["bi"].to_numpy() != rows["bj"].to_numpy())[keep], rows["block"].to_numpy()[keep], -1 - np.arange(len(fp)))
        to = _linked(fp, near, end, block, bits)
        moved = np.flatnonzero(to != np.arange(len(to)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[to[moved]])], schema=EDGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS:
                continue
            table = pa.Table.from_batches(held)
            differs = np.any([table[n].to_numpy() != table[n][-1].as_py() for n in names], axis=0)
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0  # the last run may go on
            if cut:
                yield edges(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
        if rows:
            yield edges(pa.Table.from_batches(held))
    return run


def links(prints: DataFrame, bits: int = MAX_BITS, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(a, b) edges that connect distinct fingerprints (column fp) wherever chains of links at ``bits`` or fewer do."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the keys find differences of at most {MAX_BITS} bits")
    keys = stored(prints.mapInArrow(_keys, KEY_SCHEMA), "simhash-keys")
    crowded = keys.groupBy("key").count().filter(F.col("count") > bucket).select("key")
    found = (keys.join(crowded, "key", "left_anti").repartition("key").sortWithinPartitions("key")
             .mapInArrow(_verified(bits, ("key",)), EDGE_SCHEMA))
    if crowded.isEmpty():
        return found
    fine = stored(keys.join(crowded, "key", "left_semi").mapInArrow(_refined, KEY_SCHEMA), "simhash-fine")
    size = fine.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).filter("blocks > 1")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = (fine.join(size, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other", "blocks"))
    return found.unionByName(rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
                             .mapInArrow(_verified(bits, ("key", "bi", "bj")), EDGE_SCHEMA))


def near_duplicates(docs: DataFrame, k: int = 3, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents grouped by chains of fingerprints that differ in ``bits`` bits or fewer (at most 3).

    Returns one row per input row: doc_id, fp (the fingerprint as a signed
    bigint) and component_id, the smallest doc_id that links lead to (its own
    if there are none).

    Nulls and edges: null, empty and blank texts have the fingerprint 0 and
    link like any other; a text of fewer than k words is one shingle; a row
    without an id has a fingerprint, links with nothing and has a null
    component; repeated rows give repeated results, and different texts under
    one id are linked each by its own fingerprint; an empty table gives an
    empty result; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = stored(src.mapInArrow(_prints(k), PRINT_SCHEMA), "simhash")
    classes = stored(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-class")
    star = components(links(classes.select("fp"), bits)).select(F.col("u").alias("fp"), F.col("v").alias("top"))
    top = classes.join(star, "fp", "left").withColumn("top", F.coalesce("top", "fp"))
    by_class = top.join(top.groupBy("top").agg(F.min("rep").alias("component_id")), "top").select("fp", "component_id")
    return (prints.join(by_class, "fp", "left")
            .select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))
