"""Word and window hashing shared by the operators that run numpy inside Spark tasks.

A word is a run of bytes other than space and 0x09-0x0D, which is what
``bytes.split()`` returns. The words of a block of texts become 64-bit codes
at once, eight bytes a step, and windows of k words become 64-bit hashes of
their codes. Memory is bounded by one Arrow batch plus one block, which is a
few MB or one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLOCK_BYTES = 2 << 20
LONG_WORD = 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)

_MULT = 0x9E3779B97F4A7C15
_U64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the words."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def codes(data: bytes, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit codes of byte ranges; equal bytes have equal codes anywhere."""
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(16), strides=(1,))
    h = lens.astype(np.uint64) * np.uint64(_MULT)
    at, left, who = starts, lens, None
    long = np.flatnonzero(lens > LONG_WORD)
    if len(long):
        who = np.flatnonzero(lens <= LONG_WORD)
        at, left = starts[who], lens[who]
    while len(at):
        x = eight[at] & _MASK[np.minimum(left, 8)]
        if who is None:
            h = mix(h ^ x)
        else:
            h[who] = mix(h[who] ^ x)
        more = np.flatnonzero(left > 8)
        at, left = at[more] + 8, left[more] - 8
        who = more if who is None else who[more]
    for i in long.tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i]:starts[i] + lens[i]])
    return h


class Block:
    """The words of some texts, one after another: codes, and for each text its first word and number of words."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        self.starts, self.lens = spans(self.data)
        self.codes = codes(self.data, self.starts, self.lens)
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        after = np.searchsorted(self.starts, ends)
        self.first = np.concatenate(([0], after[:-1]))
        self.count = after - self.first

    def of(self, i: int) -> np.ndarray:
        """The codes of text i."""
        return self.codes[self.first[i]:self.first[i] + self.count[i]]


def blocks(batch: pa.RecordBatch, need_id: bool = True, size: int = BLOCK_BYTES) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """(doc_ids, texts) of at most ``size`` bytes (or one text) each; with ``need_id``, rows without an id or text are left out."""
    ids: list[int | None] = []
    block: list[bytes] = []
    held = 0
    for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
        if need_id and (i is None or not t):
            continue
        if block and held + len(t) > size:
            yield ids, block
            ids, block, held = [], [], 0
        ids.append(i)
        block.append(t)
        held += len(t)
    if ids:
        yield ids, block


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each window of k codes (empty if there are fewer than k)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mult = np.uint64((_MULT + 2 * seed * 0x632BE59BD9B4E019) & _U64 | 1)
    h = np.full(n, seed + k, np.uint64)
    for j in range(k):
        h = h * mult + words[j:j + n]
    return mix(h)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 with the same bits, for a Spark bigint column."""
    return x.view(np.int64)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Groups of consecutive rows with equal keys, as column lists.

    The rows come sorted by the keys. One group is held at a time; callers
    make sure that a group is bounded.
    """
    held: dict[str, list] | None = None
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = batch.to_pydict()
        ks = list(zip(*(cols[k] for k in keys), strict=True))
        start = 0
        for i in range(len(ks) + 1):
            if i < len(ks) and ks[i] == last:
                continue
            if i > start:
                if held is None:
                    held = {c: v[start:i] for c, v in cols.items()}
                else:
                    for c, v in cols.items():
                        held[c].extend(v[start:i])
            if i < len(ks):
                if held is not None:
                    yield held
                held, last, start = None, ks[i], i
    if held is not None:
        yield held
