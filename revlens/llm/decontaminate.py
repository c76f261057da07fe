"""Operator 1: benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens in which numbers, units and names are
typed placeholders and all other words are lower-cased literals. A slot may
span several words: a number in words ("two hundred"), a number with its unit
("5 dollars", as "$5" and "5km" in one word) and a name ("Mary Jane") are one
token each, whose value is that of all its words. Windows of WINDOW tokens (for
a shorter benchmark item: one window of its length) are hashed over
placeholders and literals and hash-joined with the benchmark's windows. Windows
of as many words are hashed beside them, which finds verbatim copies in
any case.

A template that is mostly placeholders proves little alone. Such windows need
PROOF different words that item and document have in the same places (literals,
and names and units that were kept), in all such windows of the item together;
for an item of one window a literal that isn't a plain word is enough. Items of
fewer than LEAST words are found as whole lines, by their literals.

Two windows with one template may still be unrelated, so the slot values must
be consistent: equal values in the item are equal in the document and
different ones differ, as when a question is asked anew with other numbers
and names. Inside a window that holds for all slots. Names and units are held
to it over all windows of an item that lie at the same distance in a document,
so that a name keeps its substitute from the first window to the last; two
numbers far apart may become equal by chance.

Documents send only windows that a bitmap of the benchmark's window hashes
lets through. The bitmap has a fixed size; if a benchmark fills it, more
windows are sent and the join, which is exact, decides as before.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm import words as W
from revlens.llm.store import stored

WINDOW = 13
LEAST = 5            # items with fewer words are found as whole lines only
LEAST_TOKENS = 4     # items with fewer tokens are found by their words only
PROOF = 3            # words in common that windows of mostly placeholders need
BITMAP_BITS = 24     # 2^24 bits: 2 MB, whatever the benchmark
LOWER_BITS = 20      # 2^20 bits for the words that the benchmark has in lower case
PARTS = 16

# Word lists of the placeholders.
NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion
half third quarter dozen first second fourth fifth""".split())
UNITS = frozenset("""mm cm km kilometer kilometers kilometre kilometres meter meters metre metres centimeter centimeters mile miles
inch inches foot feet yard yards mg kg gram grams kilogram kilograms ton tons tonne tonnes pound pounds lb lbs ounce ounces oz
ml liter liters litre litres gallon gallons pint pints cup cups second seconds minute minutes hour hours day days week weeks
month months year years mph kph degree degrees celsius fahrenheit kelvin dollar dollars cent cents euro euros usd eur gbp rupee
rupees percent joule joules watt watts volt volts newton newtons pascal pascals hz khz mhz ghz kb mb gb tb""".split())
PLAIN = frozenset("""a an the this that these those and or but if then so when where while what which who whom whose why how is are
was were be been do does did has have had can could will would shall should may might must not no yes in on at by for from of to
with as it its he she they we you i his her their our your my there here each every all some any find calculate suppose given let
after before during into over under than""".split())

_NUMBER = re.compile(rb"[0-9]+(?:[.,:/][0-9]+)*(?:st|nd|rd|th)?")
_AMOUNT = re.compile(rb"[0-9]+(?:[.,][0-9]+)*([a-z]+)")
_CURRENCY = tuple(x.encode() for x in "€£¥₹")
NUMBER, UNIT, NAME, AMOUNT = 1, 2, 3, 4

_PLACEHOLDER = np.array([0, *(xxhash.xxh64_intdigest(f"<{kind}>") for kind in (NUMBER, UNIT, NAME, AMOUNT))], np.uint64)
_SCALED = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.array([b in b" \t\n\v\f\r" for b in range(256)])
_STOP = np.array([b in b".!?:;\n" for b in range(256)])
_INNER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_CHAR = np.array([1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)])


class _Listed:
    """Whether codes belong to a list of words."""

    def __init__(self, words: frozenset[str]):
        self.codes = np.sort(W.Block([" ".join(words).encode()]).codes)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.codes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        found = np.flatnonzero(self.maybe[(codes & np.uint64(0xFFFF)).astype(np.int64)])
        return found[np.isin(codes[found], self.codes)]


_IS_NUMBER, _IS_UNIT, _IS_PLAIN = _Listed(NUMBER_WORDS), _Listed(UNITS), _Listed(PLAIN)


def _lower(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def _strip(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges without punctuation at either end; length 0 if nothing else is there."""
    starts, lens = starts.copy(), lens.copy()
    for side in (0, 1):
        at = np.arange(len(starts))
        while len(at):
            at = at[lens[at] > 0]
            at = at[~_INNER[data[starts[at] + (lens[at] - 1 if side else 0)]]]
            lens[at] -= 1
            if not side:
                starts[at] += 1
    return starts, lens


class Tokens:
    """The tokens of some texts, one after another.

    A word is what lies between white space, without the punctuation at its
    ends, in lower case. It is a number if it is written in digits, listed, or
    joined by hyphens from such parts, a unit if listed, an amount if it is a
    number with a unit or a sign of a currency or per cent, and a name if its
    first letter alone is a capital and it isn't a plain word. The first word of
    a sentence is no name if ``lower`` has it (the words that the benchmark
    writes in lower case). Words with nothing but white space between them form
    one token if they are names, or a number followed by number words or by a
    unit, which makes it an amount.

    ``literal`` and ``of`` describe words (code, text), ``first``, ``kind``,
    ``value`` and ``template`` tokens (first word, slot type, code of all words,
    code in a template).
    """

    def __init__(self, texts: list[bytes], lower: np.ndarray | None = None):
        raw, low = b"\n".join(texts), b"\n".join(map(_lower, texts))
        (rs, rl), (ls, ll) = (_strip(np.frombuffer(d, np.uint8), *W.spans(d)) for d in (raw, low))
        if len(rs) != len(ls):
            raise ValueError("lower case changed the number of words")
        of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), rs, "right")
        keep = np.flatnonzero(ll > 0)
        rs, rl, ls, ll, self.of = rs[keep], rl[keep], ls[keep], ll[keep], of[keep]
        literal = W.codes(low, ls, ll)
        kind = np.zeros(len(ls), np.int8)
        bytes_low, bytes_raw = np.frombuffer(low, np.uint8), np.frombuffer(raw, np.uint8)
        upper = np.flatnonzero(W.codes(raw, rs, rl) != literal)
        a, b = _CHAR[bytes_raw[rs[upper]]], _CHAR[bytes_low[ls[upper]]]
        rest = [W.codes(d, s[upper] + c, np.maximum(n[upper] - c, 0)) for d, s, n, c in ((raw, rs, rl, a), (low, ls, ll, b))]
        kind[upper[rest[0] == rest[1]]] = NAME
        self.in_lower = np.setdiff1d(np.arange(len(ls)), upper)
        if lower is not None:
            opens = self._between(_STOP[bytes_low], ls, ll) > 0
            kind[opens & lower[_lower_cells(literal)]] = 0
        kind[_IS_PLAIN(literal)] = 0
        kind[_IS_UNIT(literal)] = UNIT
        kind[_IS_NUMBER(literal)] = NUMBER
        spelt = kind == NUMBER
        for i in np.flatnonzero(_DIGIT[bytes_low[ls]]).tolist():
            kind[i] = _amount(low[ls[i]:ls[i] + ll[i]])
        for i in np.flatnonzero(bytes_low[ls] >= 0xC2).tolist():
            word = low[ls[i]:ls[i] + ll[i]]
            if any(word.startswith(x) and _amount(word[len(x):]) == NUMBER for x in _CURRENCY):
                kind[i] = AMOUNT
        hyphen = np.concatenate(([0], np.cumsum(bytes_low == 45)))
        for i in np.flatnonzero(hyphen[ls + ll] > hyphen[ls]).tolist():
            parts = low[ls[i]:ls[i] + ll[i]].split(b"-")
            if all(map(_is_number, parts[:-1])) and parts[-1]:
                kind[i] = NUMBER if _is_number(parts[-1]) else AMOUNT if parts[-1].decode("utf-8", "replace") in UNITS else kind[i]
        edge = np.frombuffer(b" " + low + b" ", np.uint8)
        kind[(kind == NUMBER) & ((edge[ls] == 36) | (edge[ls + ll + 1] == 37))] = AMOUNT
        self.literal = literal
        self.line = np.searchsorted(np.flatnonzero(bytes_low == 10), ls)
        near = self._between(~_BLANK[bytes_low], ls, ll) == 0
        before = np.concatenate(([0], kind[:-1])) if len(kind) else kind
        counted = (before == NUMBER) | (before == AMOUNT)
        joined = near & ((kind == NAME) & (before == NAME) | counted & (spelt | (kind == UNIT)))
        self.first = np.flatnonzero(~joined)
        size = np.diff(np.append(self.first, len(kind)))
        amount = np.concatenate(([0], np.cumsum((kind == AMOUNT) | joined & (kind == UNIT))))
        self.kind, self.value = kind[self.first], literal[self.first].copy()
        self.kind[amount[self.first + size] > amount[self.first]] = AMOUNT
        at, step = np.flatnonzero(size > 1), 1
        while len(at):
            self.value[at] = W.mix(self.value[at] * _SCALED + literal[self.first[at] + step])
            step += 1
            at = at[size[at] > step]
        self.template = np.where(self.kind > 0, _PLACEHOLDER[self.kind], self.value)

    def _between(self, marks: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """How many marked bytes lie between each word and the one before; 1 for the first word of a text."""
        total = np.concatenate(([0], np.cumsum(marks)))
        ends = np.concatenate(([0], (starts + lens)[:-1])) if len(starts) else starts
        count = total[starts] - total[ends]
        count[np.flatnonzero(np.diff(self.of, prepend=-1))] = 1
        return count

    def lengths(self) -> tuple[int, int]:
        """Window lengths for a text of these tokens: (in tokens, in words), 0 where it has no window of that kind."""
        tokens, words = min(WINDOW, len(self.first)), min(WINDOW, len(self.literal))
        return (tokens if words >= LEAST and tokens >= LEAST_TOKENS else 0), words

    def windows(self, k: int, slotted: bool) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, starts) of the windows of k tokens (or k words) that lie in one text.

        There is no template of numbers alone, and one without a slot is left to the words.
        """
        codes, of = (self.template, self.of[self.first]) if slotted else (self.literal, self.of)
        n = len(codes) - k + 1
        if n <= 0 or not k:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        hashes = W.window_hashes(codes, k, 4 if slotted else 5)
        starts = np.flatnonzero(of[:n] == of[k - 1:])
        if slotted:
            numbers, slots = (np.concatenate(([0], np.cumsum(x))) for x in ((self.kind == NUMBER) | (self.kind == AMOUNT), self.kind > 0))
            starts = starts[(numbers[starts + k] - numbers[starts] < k) & (slots[starts + k] > slots[starts])]
        elif k < LEAST:
            edge = np.concatenate(([True], self.line[1:] != self.line[:-1], [True]))
            starts = starts[edge[starts] & edge[starts + k]]
        return hashes[starts], starts

    def values(self, start: int, k: int) -> list[int]:
        """Codes of the values of a window's slots, in order."""
        part = slice(start, start + k)
        return W.signed(self.value[part][self.kind[part] > 0]).tolist()

    def proof(self, start: int, k: int, whole: bool) -> tuple[bool, list[int], list[int | None]]:
        """Whether a window's template proves a copy alone, and if not, its literals and the values of its slots, null for numbers and amounts."""
        part = slice(start, start + k)
        kind, value = self.kind[part], W.signed(self.value[part])
        words = value[kind == 0]
        plain = len(_IS_PLAIN(self.value[part][kind == 0]))
        sure = 2 * len(words) >= k or whole and len(words) > plain
        return bool(sure), sorted(set(words.tolist())), [None if x in (NUMBER, AMOUNT) else v for x, v in zip(kind[kind > 0].tolist(), value[kind > 0].tolist(), strict=True)]

    def rows(self, k: int, slotted: bool, through=None) -> list[tuple[int, int, bool, int, int, list[int]]]:
        """(hash, k, by template, text, place in the text, slot values) of the windows of k; words fill no slot and have no place."""
        hashes, starts = self.windows(k, slotted)
        if through:
            let = through(hashes)
            hashes, starts = hashes[let], starts[let]
        units = self.first if slotted else np.arange(len(self.literal))
        text = self.of[units[starts]]
        base = np.searchsorted(self.of[units], text) if len(starts) else starts
        return [(h, k, slotted, t, s - b if slotted else 0, self.values(s, k) if slotted else [])
                for h, t, s, b in zip(W.signed(hashes).tolist(), text.tolist(), starts.tolist(), base.tolist(), strict=True)]


def _amount(word: bytes) -> int:
    """NUMBER for digits, AMOUNT for digits with a unit, else 0."""
    if _NUMBER.fullmatch(word):
        return NUMBER
    unit = _AMOUNT.fullmatch(word)
    return AMOUNT if unit and unit[1].decode() in UNITS else 0


def _is_number(word: bytes) -> bool:
    return bool(_NUMBER.fullmatch(word)) or word.decode("utf-8", "replace") in NUMBER_WORDS


def _lower_cells(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(64 - LOWER_BITS)).astype(np.int64)


def _lower_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of the words that a task's items write in lower case."""
    seen = np.zeros(1 << LOWER_BITS, bool)
    for batch in batches:
        for text in W.texts(batch):
            t = Tokens([text])
            seen[_lower_cells(t.literal[t.in_lower])] = True
    yield pa.RecordBatch.from_pydict({"part": [0], "bits": [zlib.compress(np.packbits(seen).tobytes(), 1)]})


_ITEM_SCHEMA = "hash long, k int, slotted boolean, item_id long, n_windows int, place int, item_values array<long>, sure boolean, words array<long>, named array<long>"


def _item_windows(lower):
    longs = pa.list_(pa.int64())
    schema = pa.schema([("hash", pa.int64()), ("k", pa.int32()), ("slotted", pa.bool_()), ("item_id", pa.int64()), ("n_windows", pa.int32()), ("place", pa.int32()),
                        ("item_values", longs), ("sure", pa.bool_()), ("words", longs), ("named", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), W.texts(batch), strict=True):
                t = Tokens([text], lower.value)
                if item is None or not len(t.of):
                    continue
                n_tokens, n_words = len(t.first), len(t.literal)
                k, k_words = t.lengths()
                n = n_words - k_words + 1
                rows += [(h, k, True, item, n, place, values, *t.proof(place, k, n_tokens == k)) for h, k, _, _, place, values in t.rows(k, True)]
                rows += [(h, k_words, False, item, n, i, [], True, [], []) for i, (h, *_) in enumerate(t.rows(k_words, False))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    return run


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmap of a task's window hashes, in parts."""
    seen = np.zeros(1 << BITMAP_BITS, bool)
    for batch in batches:
        seen[_cells(batch.column("hash").to_numpy().view(np.uint64))] = True
    for p, part in enumerate(seen.reshape(PARTS, -1)):
        if part.any():
            yield pa.RecordBatch.from_pydict({"part": [p], "bits": [zlib.compress(np.packbits(part).tobytes(), 1)]})


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    union: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, bits in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            new = np.frombuffer(zlib.decompress(bits), np.uint8)
            union[p] = union[p] | new if p in union else new
    for p, bits in union.items():
        yield pa.RecordBatch.from_pydict({"part": [p], "bits": [zlib.compress(bits.tobytes(), 1)]})


def _doc_windows(lengths: list[tuple[int, bool]], bitmap, lower):
    schema = pa.schema([("hash", pa.int64()), ("k", pa.int32()), ("slotted", pa.bool_()), ("doc_id", pa.int64()), ("doc_place", pa.int32()), ("doc_values", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let = bitmap.value
        for batch in batches:
            for ids, block in W.blocks(batch):
                t, rows = Tokens(block, lower.value), []
                for k, slotted in lengths:
                    rows += [(h, k, slotted, ids[text], place, values) for h, _, _, text, place, values in t.rows(k, slotted, lambda x: let[_cells(x)])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    return run


def _one_to_one(pairs: str) -> Column:
    """Whether an array of (item, doc) structs maps each value to one value, both ways."""
    n = F.size(F.array_distinct(pairs))
    return (n == F.size(F.array_distinct(f"{pairs}.item"))) & (n == F.size(F.array_distinct(f"{pairs}.doc")))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that share a window with consistent slots.

    Columns: doc_id, item_id, n_windows (item windows found: those by their
    words, or those by their template where these are more), n_item_windows
    (its windows by words), n_reworded (of those found, windows that only a
    template with changed values finds).

    Nulls and edges: null and empty texts have no windows; rows without an id
    (documents or items) are left out; an item with fewer than LEAST words
    is one window that must fill whole lines of a document, an item without
    words has none; repeated rows count once; either table may be empty; other
    columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    seen = np.zeros((1 << LOWER_BITS) // 8, np.uint8)
    for r in texts.mapInArrow(_lower_words, "part long, bits binary").repartition(1, "part").mapInArrow(_unite, "part long, bits binary").collect():
        seen |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    lower = spark.sparkContext.broadcast(np.unpackbits(seen).astype(bool))
    items = stored(texts.mapInArrow(_item_windows(lower), _ITEM_SCHEMA).distinct(), "items")
    lengths = sorted((r["k"], r["slotted"]) for r in items.select("k", "slotted").distinct().collect())  # at most twice WINDOW of them
    bits = np.zeros((PARTS, (1 << BITMAP_BITS) // PARTS // 8), np.uint8)
    for r in items.select("hash").mapInArrow(_bitmap, "part long, bits binary").repartition(PARTS, "part").mapInArrow(_unite, "part long, bits binary").collect():
        bits[r["part"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    bitmap = spark.sparkContext.broadcast(np.unpackbits(bits.reshape(-1)).astype(bool))
    found = src.mapInArrow(_doc_windows(lengths, bitmap, lower), "hash long, k int, slotted boolean, doc_id long, doc_place int, doc_values array<long>").dropDuplicates()
    met = found.join(items, ["hash", "k", "slotted"])
    met = met.withColumn("pairs", F.zip_with("item_values", "doc_values", lambda i, d: F.struct(i.alias("item"), d.alias("doc"))))
    met = met.filter(_one_to_one("pairs"))
    kept = F.filter(F.zip_with("named", "doc_values", lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    met = met.withColumns({
        "proof": F.when(~F.col("sure"), F.array_union("words", kept)),
        "held": F.filter(F.zip_with("named", "doc_values", lambda a, b: F.when(a.isNotNull(), F.struct(a.alias("item"), b.alias("doc")))), lambda x: x.isNotNull()),
        "shift": F.when(F.col("slotted"), F.col("doc_place") - F.col("place"))})
    # one row for each window of an item at one distance: all windows of one copy meet, and only those
    copies = met.groupBy("doc_id", "item_id", "slotted", "shift").agg(
        F.max("n_windows").alias("n_windows"), F.max("sure").alias("sure"), F.array_distinct(F.flatten(F.collect_set("held"))).alias("held"),
        F.array_distinct(F.flatten(F.collect_set("proof"))).alias("proof"),
        F.collect_set(F.struct("place", (F.col("item_values") != F.col("doc_values")).alias("changed"))).alias("places")).filter(_one_to_one("held"))
    whole = copies.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").cast("long").alias("n_item_windows"), F.max("sure").alias("sure"), F.array_distinct(F.flatten(F.collect_list("proof"))).alias("proof"),
        F.flatten(F.collect_list(F.when(~F.col("slotted"), F.col("places.place")))).alias("words"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("slotted"), F.col("places"))))).alias("slots"))
    same = F.array_distinct(F.filter("slots", lambda x: ~x["changed"])["place"])
    every = F.array_distinct(F.col("slots.place"))
    by_words, by_slots = F.size(F.array_distinct("words")), F.size(every)
    return (whole.filter(F.col("sure") | (F.size("proof") >= PROOF))
            .select("doc_id", "item_id", F.greatest(by_words, by_slots).cast("long").alias("n_windows"), "n_item_windows",
                    F.size(F.array_except(every, same)).cast("long").alias("n_reworded")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose own text holds an item.

    Other texts under the same id stay, and so do rows without an id; columns
    of any name are kept. Rows are known by a 64-bit hash of id and text.
    """
    mark = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col), F.col(text_col).cast("string")))
    marked = docs.select(F.struct(*docs.columns).alias("row"), mark.alias("mark"))
    hit = contaminated(docs.select(mark.alias("doc_id"), F.col(text_col).alias("text")), benchmark).select(F.col("doc_id").alias("mark")).distinct()
    return marked.join(hit, "mark", "left_anti").select("row.*")
