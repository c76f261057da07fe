"""Operator 8: language identification with a bidirectional gated recurrent network over bytes.

A gated recurrent unit reads the bytes of a segment forwards, another one
backwards; a linear layer labels every position, and a document's
probabilities are the mean of its positions' log-probabilities, normalised.
The network is trained in numpy by backpropagation through time on the
driver, on a bounded sample of labelled segments, and its weights (some
fifteen thousand numbers) are sent to the tasks, which run it over every byte.

Texts are cut into segments of SEGMENT bytes at which the state starts anew,
so that thousands of segments advance together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 64
HIDDEN = 8
SAMPLE_DOCS = 200       # labelled documents per language, at most
SAMPLE_SEGMENTS = 6     # segments of each of them
SAMPLE_TOTAL = 12_800   # documents of all languages together, shared among them; each language has one at least
BLOCK = 2048            # segments that advance together
EPOCHS = 8

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """Weights of the two directions and of the output layer; labels in the order of the output.

    Gates are 0 update, 1 reset, 2 candidate. Activations are x / (1 + |x|),
    scaled to (0, 1) for the first two: a few cheap operations a byte.
    """

    labels: list[str]
    embed: list[list[np.ndarray]]  # [direction][gate]: 256 x H, the input's part with the bias
    state: list[list[np.ndarray]]  # [direction][gate]: H x H
    out: np.ndarray                # 2H x classes
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [p for side in (0, 1) for p in (*self.embed[side], *self.state[side])] + [self.out, self.bias]


def new_model(labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)

    def draw(a, b, scale):
        return (rng.standard_normal((a, b)) * scale).astype(np.float32)

    return Model(labels, [[draw(256, hidden, 0.5) for _ in range(3)] for _ in range(2)],
                 [[draw(hidden, hidden, hidden ** -0.5) for _ in range(3)] for _ in range(2)],
                 draw(2 * hidden, len(labels), hidden ** -0.5), np.zeros(len(labels), np.float32))


def _softsign(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    np.abs(x, out=spare)
    spare += 1
    x /= spare
    return x


def _forward(m: Model, side: int, seg: np.ndarray, keep: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States of one direction: (steps, segments, H). seg: (steps, segments) bytes, keep: 1 where a byte is."""
    steps, rows = seg.shape
    (ez, er, ec), (uz, ur, uc) = m.embed[side], m.state[side]
    h = np.zeros((rows, uz.shape[0]), m.out.dtype)
    spare = np.empty_like(h)
    states = np.empty((steps, *h.shape), h.dtype)
    whole = keep.all(axis=1)
    for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
        x = seg[t]
        z, r, c = (np.take(e, x, axis=0, mode="clip") for e in (ez, er, ec))
        z += np.matmul(h, uz, out=spare)
        r += np.matmul(h, ur, out=spare)
        for gate in (z, r):
            _softsign(gate, spare)
            gate *= 0.5
            gate += 0.5
        c += (r * h) @ uc
        _softsign(c, spare)
        if trace is not None:
            trace.append((t, h, z, r, c))
        new = np.subtract(c, h, out=states[t])
        new *= z
        if not whole[t]:
            new *= keep[t][:, None]
        new += h
        h = new
    return states


def position_logits(m: Model, seg: np.ndarray, keep: np.ndarray, traces: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(steps, segments, classes) logits and the (steps, segments, 2H) states they come from."""
    both = np.concatenate([_forward(m, side, seg, keep, None if traces is None else traces[side]) for side in (0, 1)], axis=2)
    return both @ m.out + m.bias, both


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def gradients(m: Model, seg: np.ndarray, keep: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over positions and its gradient, by backpropagation through time."""
    traces: list[list] = [[], []]
    logits, both = position_logits(m, seg, keep, traces)
    logp = log_softmax(logits)
    w = keep / max(float(keep.sum()), 1.0)
    rows = np.arange(len(label))
    loss = -float((logp[:, rows, label] * w).sum())
    d = np.exp(logp)
    d[:, rows, label] -= 1
    d *= w[:, :, None]
    width, classes = m.out.shape
    H = width // 2
    g_out, g_bias = both.reshape(-1, width).T @ d.reshape(-1, classes), d.sum(axis=(0, 1))
    d_state = d @ m.out.T
    grads: list[np.ndarray] = []
    for side in (0, 1):
        ge = [np.zeros_like(e) for e in m.embed[side]]
        gs = [np.zeros_like(u) for u in m.state[side]]
        uz, ur, uc = m.state[side]
        dh = np.zeros((seg.shape[1], H), m.out.dtype)
        for t, h, z, r, c in reversed(traces[side]):
            dh = dh + d_state[t][:, side * H:(side + 1) * H]
            k = keep[t][:, None]
            dz, dc = dh * (c - h) * k, dh * z * k
            ac = dc * (1 - np.abs(c)) ** 2
            drh = ac @ uc.T
            az = dz * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            ar = drh * h * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            for g, a, x in zip(gs, (az, ar, ac), (h, h, r * h), strict=True):
                g += x.T @ a
            for g, a in zip(ge, (az, ar, ac), strict=True):
                np.add.at(g, seg[t], a)
            dh = dh * (1 - z * k) + drh * r + az @ uz.T + ar @ ur.T
        grads += [*ge, *gs]
    return loss, [*grads, g_out, g_bias]


def train(segments: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Model:
    """Fit by Adam on labelled segments, each language weighing the same; the result depends on the arguments alone."""
    names = sorted(set(labels))
    m = new_model(names, hidden, seed)
    seg, keep = pack(segments)
    y = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    by = [np.flatnonzero(y == k) for k in range(len(names))]
    share = max(map(len, by))
    params = m.params()
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(np.concatenate([rng.choice(b, share) for b in by]))
        for a in range(0, len(order), batch):
            pick = order[a:a + batch]
            _, grads = gradients(m, seg[:, pick], keep[:, pick], y[pick])
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            step += 1
            now = rate * 0.5 ** (4 * epoch / epochs)
            for p, g, f, s in zip(params, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                f += 0.1 * (g - f)
                s += 0.01 * (g * g - s)
                p -= (now * (f / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return m


def pack(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments as a (SEGMENT, segments) byte matrix, zero-padded, and a mask of the bytes that are there."""
    lens = np.array([len(s) for s in segments])
    seg = np.frombuffer(b"".join(s.ljust(SEGMENT, b"\0") for s in segments), np.uint8).reshape(-1, SEGMENT)
    return np.ascontiguousarray(seg.T, dtype=np.intp), (np.arange(SEGMENT)[:, None] < lens[None, :]).astype(np.float32)


def cut(text: bytes) -> list[bytes]:
    return [text[i:i + SEGMENT] for i in range(0, len(text), SEGMENT)]


def _pool(m: Model, segments: list[bytes]) -> np.ndarray:
    """Per segment: the sum of its positions' log-probabilities.

    Every logit is at most the column's sum of weights, so exp() is safe as it is.
    """
    sums = np.empty((len(segments), len(m.labels)))
    ones = np.ones((len(m.labels), 1), m.out.dtype)
    for a in range(0, len(segments), BLOCK):
        seg, keep = pack(segments[a:a + BLOCK])
        left, right = (_forward(m, side, seg, keep) for side in (0, 1))
        H = left.shape[2]
        total = np.zeros((seg.shape[1], len(m.labels)))
        for t in range(SEGMENT):
            logits = left[t] @ m.out[:H]
            logits += right[t] @ m.out[H:]
            logits += m.bias
            logits -= np.log(np.exp(logits) @ ones)
            total += logits if keep[t].all() else logits * keep[t][:, None]
        sums[a:a + BLOCK] = total
    return sums


def predict(m: Model, documents: list[bytes]) -> list[tuple[str, float]]:
    """(label, probability) of each text; the mean over all its positions."""
    pieces = [cut(t) for t in documents]
    owner = np.repeat(np.arange(len(documents)), [len(p) for p in pieces])
    total = np.zeros((len(documents), len(m.labels)))
    np.add.at(total, owner, _pool(m, [s for p in pieces for s in p]))
    mean = total / np.maximum([[len(t)] for t in documents], 1)
    prob = np.exp(log_softmax(mean))
    best = prob.argmax(axis=1)
    return [(m.labels[b], float(p[b])) for b, p in zip(best, prob, strict=True)]


def _label(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            found: list[tuple[str, float]] = []
            held: list[bytes] = []
            size = 0

            def flush():
                if held:
                    got = iter(predict(m, [t for t in held if t]) if any(held) else [])
                    found.extend(next(got) if t else ("und", 0.0) for t in held)
                    held.clear()

            for x in batch.column("text"):
                t = x.as_py()
                t = t.encode() if t and m.labels and _LETTER.search(t) else b""
                if size + len(t) > BLOCK * SEGMENT:
                    flush()
                    size = 0
                held.append(t)
                size += len(t)
            flush()
            lang, score = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("learned"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "learned", "lang_pred", "score"])
    return run


def shared(counts: list[int], most: int, total: int = SAMPLE_TOTAL) -> int:
    """Documents per language, at most ``most``, so that all together are ``total``; what a small language leaves goes to the others."""
    return next((q for q in range(most, 1, -1) if sum(min(c, q) for c in counts) <= total), 1)


def training_segments(docs: DataFrame, per_language: int = SAMPLE_DOCS, segments: int = SAMPLE_SEGMENTS) -> list[tuple[str, str]]:
    """(lang, segment) of a bounded sample: documents by hash order in each language, segments by hashed offsets.

    Every language with labelled rows is learned. At most SAMPLE_TOTAL x
    segments rows of SEGMENT characters reach the driver (or ``segments`` a
    language, if there are more than SAMPLE_TOTAL), whatever the input.
    """
    rank = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.crc32(F.col("text").cast("binary")))
    src = docs.filter("lang IS NOT NULL AND text RLIKE '[A-Za-z\\\\x{80}-\\\\x{10FFFF}]'").withColumn("rank", rank)
    counts = src.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return []
    per_language = shared([r["count"] for r in counts], per_language)
    # a hash bound a little above per_language / count, so that the ranking below sees few rows of a large language
    bound = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(2**63 - 1, -2**63 + 2**64 * (4.0 * per_language + 100) / r["count"]))))])
    few = src.filter(F.col("rank") <= bound[F.col("lang")])
    picked = (few.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id", "text")))
              .filter(F.col("at") <= per_language).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))))
    start = F.pmod(F.xxhash64("rank", "part"), F.greatest(F.length("text") - SEGMENT, F.lit(1))).cast("int") + 1
    rows = picked.select("lang", F.col("text").substr(start, F.lit(SEGMENT)).alias("piece"), "rank", "part").orderBy("lang", "rank", "part").collect()
    return [(r["lang"], r["piece"]) for r in rows]


def identify(docs: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, learned, lang_pred and score of each whole text.

    ``learn`` is a condition on ``doc_id`` that says which rows may be learned
    from (default: all with a language).

    Nulls and edges: a null text, or one without a letter, is ``und`` with
    score 0, as is every text if nothing could be learned; a row without a
    language isn't learned from; a null id stays null; repeated rows give
    repeated results; an empty table gives an empty result; other columns are
    ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    src = src.withColumn("learned", F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)))
    sample = [(lang, p.encode()[:SEGMENT]) for lang, p in training_segments(src.filter("learned"))]
    model = train([p for _, p in sample], [x for x, _ in sample]) if sample else new_model([])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return src.select("doc_id", "text", "learned").mapInArrow(_label(sent), "doc_id long, learned boolean, lang_pred string, score double")
