"""Operator 10: substring dedup by level-wise doubling.

Level 1 looks for repeated windows of half the target length (7 words for a
target of 13). Only windows that repeat at that length are extended to the
target (twice the half, less one word if it is odd); a window whose half is
unique dies there. With the target fixed, the second level is the last.

Of the half windows only *seeds* travel: each target window names the smallest
hash among the half windows inside it. Equal target windows name equal seeds,
so no repeat is lost. A first pass counts seeds and marks those that two
documents name in a bitmap of fixed size, which every task gets; a target
window whose seed isn't marked is neither sent nor looked at again. If a corpus
fills the bitmap, more windows are sent and the second pass, which doesn't need
it, decides as before. Windows meet by seed and their own whole hash, 64 bits
each, so windows that share a seed are as many groups as they differ in words.
A group is read in the order of doc_id and only its first id is held. Texts
travel compressed to the spans that were found in them.

Repeats inside one block of a task are decided there and not sent, so a
passage held by a third of all documents meets once per block, not once per
document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import words as W

LOCAL = 0xFFFFFFFF  # position of a row that holds spans decided inside one block

BITMAP_BITS = 29    # 2^29 bits: 64 MB, whatever the corpus
PARTS = 64          # the bitmap is put together in so many parts

COUNT_SCHEMA = "seed long, n int"
CELL_SCHEMA = "part int, cells binary"
WINDOW_SCHEMA = "seed long, window long, doc_id long, pos long, local binary"
SPAN_SCHEMA = "doc_id long, text_key int, spans binary"
OUT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>"


def _text_key(text: bytes) -> int:
    return zlib.crc32(text) & 0xFFFFFF


class _Named:
    """The target windows of a block of texts, texts in the order of their ids: place, whole hash and seed of each."""

    def __init__(self, ids: list[int], block: list[bytes], target: int):
        order = sorted(range(len(ids)), key=ids.__getitem__)
        words = W.Block([block[i] for i in order])
        codes, self.first, self.count = words.codes, words.first, words.count
        self.ident = np.array([ids[i] for i in order], np.int64)
        self.keys = np.array([_text_key(block[i]) for i in order], np.int64)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        half = (target + 1) // 2
        seeds, self.full = W.window_hashes(codes, half), W.window_hashes(codes, target, 1)
        self.n = len(self.full)
        self.low = seeds[:self.n].copy()  # the smallest seed inside each window
        for j in range(1, target - half + 1 if self.n else 1):
            np.minimum(self.low, seeds[j:j + self.n], out=self.low)
        self.ok = np.flatnonzero(self.doc[:self.n] == self.doc[target - 1:]) if self.n else np.empty(0, np.int64)


def _count_rows(ids: list[int], block: list[bytes], target: int) -> pa.RecordBatch:
    """Each seed of a block, with 2 if documents of different ids name it, else 1."""
    x = _Named(ids, block, target)
    low, doc = x.low[x.ok], x.ident[x.doc[x.ok]]
    by = np.argsort(low, kind="stable")  # stable: a seed's ids rise
    low, doc = low[by], doc[by]
    new = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.empty(0, np.int64)
    end = np.append(new[1:], len(low)) - 1 if len(low) else new
    return pa.RecordBatch.from_arrays([pa.array(W.signed(low[new])), pa.array((1 + (doc[new] != doc[end])).astype(np.int32))], names=["seed", "n"])


def _counts(target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in W.blocks(batch):
                yield _count_rows(ids, block, target)
    return run


def _cells(seeds: np.ndarray) -> np.ndarray:
    """A seed's place in the bitmap. Seeds are the smallest of several hashes, so their high bits are mixed again."""
    return (W.mix(seeds) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of each batch's seeds by part of the bitmap, as packed differences."""
    width = (1 << BITMAP_BITS) // PARTS
    for batch in batches:
        cells = np.unique(_cells(batch.column("seed").to_numpy().view(np.uint64)))
        cut = np.searchsorted(cells, np.arange(PARTS + 1) * width)
        rows = [(p, zlib.compress(np.diff(cells[a:b] - p * width, prepend=0).astype("<u4").tobytes(), 1)) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        if rows:
            parts, packed = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], names=["part", "cells"])


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part: the bits of each, compressed."""
    bits, last = None, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["part", "cells"])

    for batch in batches:
        for p, packed in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            if p != last:
                if last is not None:
                    yield made()
                bits, last = np.zeros((1 << BITMAP_BITS) // PARTS, bool), p
            bits[np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4"), dtype=np.int64)] = True
    if last is not None:
        yield made()


def repeated_seeds(src: DataFrame, target: int) -> np.ndarray:
    """The bitmap of seeds that documents of different ids name, eight cells a byte.

    A seed is counted by Spark with partial sums, so a hot one is no group.
    """
    seeds = src.mapInArrow(_counts(target), COUNT_SCHEMA).groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1").select("seed")
    parts = seeds.mapInArrow(_cells_of, CELL_SCHEMA).repartition(PARTS, "part").sortWithinPartitions("part").mapInArrow(_unite, CELL_SCHEMA)
    bits = np.zeros((PARTS, (1 << BITMAP_BITS) // PARTS // 8), np.uint8)
    for r in parts.toLocalIterator():
        bits[r["part"]] = np.frombuffer(zlib.decompress(r["cells"]), np.uint8)
    return bits.reshape(-1)


def _marked(bits: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    cells = _cells(seeds)
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 > 0


def _window_rows(ids: list[int], block: list[bytes], target: int, bits: np.ndarray) -> pa.RecordBatch:
    """The windows of a block whose seeds are marked, but those that an earlier document of the block has too: these as spans."""
    x = _Named(ids, block, target)
    n, full, low, doc, ident, keys, first, lens = x.n, x.full, x.low, x.doc, x.ident, x.keys, x.first, x.count
    ok = x.ok[_marked(bits, low[x.ok])]
    if not len(ok):
        return pa.RecordBatch.from_pylist([], schema=_arrow_window())

    # windows that an earlier document of this block has too
    by = ok[np.argsort(full[ok], kind="stable")]  # stable: a window's occurrences by doc_id
    new = np.ones(len(by), bool)
    new[1:] = (full[by[1:]] != full[by[:-1]]) | (low[by[1:]] != low[by[:-1]])
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    here = np.zeros(n, bool)
    here[by[ident[doc[by]] > ident[doc[head]]]] = True

    rest = ok[~here[ok]]
    d = doc[rest]
    pos = (keys[d] << 32) | (rest - first[d])
    out = pa.RecordBatch.from_arrays([pa.array(W.signed(low[rest])), pa.array(W.signed(full[rest])), pa.array(ident[d]), pa.array(pos), pa.nulls(len(rest), pa.binary())],
                                     schema=_arrow_window())
    if not here.any():
        return out
    local = []
    for k in np.unique(doc[:n][here]).tolist():
        a, b = first[k], min(first[k] + lens[k], n)
        spans = [x for run in W.runs(here[a:b]) for x in run]
        local.append((int(W.signed(W.mix(np.array([ident[k]]).view(np.uint64)))[0]), 0, int(ident[k]),
                      (int(keys[k]) << 32) | LOCAL, struct.pack(f"<{len(spans)}i", *spans)))
    more = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*local, strict=True), _arrow_window(), strict=True)],
                                      schema=_arrow_window())
    return pa.Table.from_batches([out, more]).combine_chunks().to_batches()[0]


def _arrow_window() -> pa.Schema:
    return pa.schema([("seed", pa.int64()), ("window", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("local", pa.binary())])


def _windows(target: int, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in W.blocks(batch):
                yield _window_rows(ids, block, target, bitmap.value)
    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (seed, window, doc_id): the first of a window has the smallest id, later ones of other ids repeat it."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int32()), ("spans", pa.binary())])
    last: tuple[int, int, int] | None = None  # seed, window and its smallest id
    for batch in batches:
        pos = batch.column("pos").to_numpy()
        local = (pos & LOCAL) == LOCAL
        if local.any():
            part = batch.filter(pa.array(local))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array((pos[local] >> 32).astype(np.int32)), part.column("local")], schema=schema)
        pos = pos[~local]
        if not len(pos):
            continue
        seed, window, doc = (batch.column(c).to_numpy()[~local] for c in ("seed", "window", "doc_id"))
        new = np.ones(len(pos), bool)
        new[1:] = (seed[1:] != seed[:-1]) | (window[1:] != window[:-1])
        least = doc[np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))]
        if last is not None and (seed[0], window[0]) == last[:2]:
            least[:np.flatnonzero(np.append(new[1:], True))[0] + 1] = last[2]  # the group goes on from the batch before
        last = int(seed[-1]), int(window[-1]), int(least[-1])
        hit = np.flatnonzero(doc > least)
        if len(hit):
            at = (pos[hit] & LOCAL).astype("<i4")
            spans = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer(np.arange(0, 8 * len(hit) + 1, 8, dtype=np.int32)), pa.py_buffer(np.stack((at, at + 1), 1).tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array((pos[hit] >> 32).astype(np.int32)), spans], schema=schema)


def repeated_windows(docs: DataFrame, target: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of window starts whose words also start a window in a document with a smaller id.

    Returns (doc_id, text_key, spans): ``spans`` packs (start, end) pairs of
    window starts as little-endian int32, and a document may have many rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_seeds(src, target))
    windows = src.mapInArrow(_windows(target, bitmap), WINDOW_SCHEMA)
    return windows.repartition("seed", "window").sortWithinPartitions("seed", "window", "doc_id").mapInArrow(_resolve, SPAN_SCHEMA)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for ids, texts in W.blocks(batch, need_id=False):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_text_key(t) for t in texts], pa.int32()),
                                              pa.array([packer.compress(t) for t in texts], pa.binary())], names=["doc_id", "text_key", "text"])


def _apply(target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
                            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, size = [], 0
            for doc, text, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "packed")), strict=True):
                text = unpack(text)
                words = text.split()
                gone: list[tuple[int, int]] = []
                if packed:
                    drop = np.zeros(len(words) + 1, np.int32)
                    ends = np.frombuffer(b"".join(packed), "<i4").reshape(-1, 2)
                    np.add.at(drop, ends[:, 0], 1)
                    np.add.at(drop, ends[:, 1] + target - 1, -1)
                    mask = np.cumsum(drop)[:-1] > 0
                    gone = W.runs(mask)
                    words = [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
                cut = sum(b - a for a, b in gone)
                rows.append((doc, len(words) + cut, cut, b" ".join(words), [{"start": a, "end": b} for a, b in gone]))
                size += len(text)
                if size >= W.BLOCK_BYTES:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, schema)
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    doc, n, cut, kept, spans = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(cut, pa.int64()),
         pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, schema.field("spans").type)], schema=schema)


def drop_repeats(docs: DataFrame, target: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document without the words that an earlier document's windows cover.

    A window is ``target`` consecutive words. A word goes if some window over
    it has the same words as a window that starts in a document with a smaller
    id; windows are judged on the input. Returns doc_id, n_words, n_removed,
    kept_text (kept words joined by one space) and spans (word ranges removed).

    Nulls and edges: a null or empty text has no words; a text with fewer than
    ``target`` words has no window; a row without an id is returned whole and
    neither gives nor loses words; rows that repeat an id don't count as
    smaller than each other; an empty table gives an empty result; columns
    other than the two named are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = repeated_windows(src, target).groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("packed"))
    both = src.mapInArrow(_pack, "doc_id long, text_key int, text binary").join(found, ["doc_id", "text_key"], "left").select("doc_id", "text", "packed")
    return both.mapInArrow(_apply(target), OUT_SCHEMA)
