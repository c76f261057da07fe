"""Operator 13: spelling variants, found by a relational trie frontier.

1. Runs of letters are counted over all texts; frequent enough words of some
   length are the vocabulary.
2. Words that differ by one code point agree before their first difference and
   after it, so they share the first half of the word or its last. The words
   go into two tries, spelled forwards and backwards, that hold no node above
   a word's half. A node is known by a hash of what leads to it; the table of
   nodes has one row per node that at least two words pass, with its edges (at
   most one per letter). An edge that one word alone passes is a leaf and
   names that word.
3. The frontier holds states (word, position, node, edits). All words start at
   their half without an edit. Level by level it is joined with that level's
   nodes: without an edit, a state follows its own letter, or takes another
   edge as its one edit (replaced, inserted or deleted letter), always at the
   first difference, so a neighbour is reached by one path; with an edit, it
   must follow its own letters. A state that comes to the end of both words,
   or to a leaf with the same rest, is a pair of neighbours. Edges know the
   lengths of their words and the letters behind them, so moves that lead
   nowhere are left out at once.
4. Pairs are verified by their edit distance, so two nodes or rests under one
   hash cost time and never a result. Words of more than ``LONG`` letters would make as
   many levels; they meet by hashes of themselves less one letter instead, and
   are verified the same.

A node that very many words pass is a hot key of the join: its row is copied
once per ``HOT`` words, and states are dealt over the copies.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm import words as W
from revlens.llm.store import stored

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LONG = 64          # letters of the longest words in the tries
HOT = 20_000       # words of one copy of a node
HELD = 200_000     # different words counted in a task before they are sent
BROADCAST = 50_000  # hot nodes, at most, that are sent to all tasks
END = ""           # the letter of the edge that a word ends with


def _count(drop_every: int, min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), W.texts(batch), strict=True):
                for word, n in Counter(LETTERS.findall(text.translate(W.ASCII_LOWER).decode())).items():
                    if len(word) < min_len:
                        continue
                    if drop_every and doc is not None and not (h := zlib.crc32(f"{doc}:{word}".encode())) % drop_every:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_len:
                            continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield _counted(counts)
                    counts.clear()
        if counts:
            yield _counted(counts)
    return run


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, min_len: int = 7, min_count: int = 2, drop_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters, A-Z lower-cased, of at least ``min_len`` letters that occur ``min_count`` times or more.

    With ``drop_every``, a run whose CRC-32 of ``<doc_id>:<run>`` it divides
    loses the letter at that number modulo its length: planted misspellings,
    to measure how many are found. Null texts and texts without letters have
    no words; a row without an id loses no letters; repeated rows count as
    often as they are there.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return (src.mapInArrow(_count(drop_every, min_len), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


def _from(word: Column, at: Column) -> Column:
    """The rest of a word from a position (0: all of it)."""
    return F.substr(word, at + 1)


def _letter(word: Column, at: Column) -> Column:
    return F.substr(word, at + 1, F.lit(1))


def _half(length: Column, side: Column) -> Column:
    """Letters that a neighbour shares at least on one of the two sides: floor and ceiling of a half."""
    return F.floor((length + side) / 2).cast("int")


def _spelled(words: DataFrame) -> DataFrame:
    """(side, word, id): each word forwards (0) and backwards (1), with the hash of the word itself."""
    return words.select(F.posexplode(F.array("word", F.reverse("word"))).alias("side", "word"), F.xxhash64("word").alias("id"))


def _bit(value: Column) -> Column:
    """One of 64 bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), value.bitwiseAND(63))


def _next_bits(word: Column, at: Column) -> tuple[Column, Column]:
    """A bit for the letter at a position, and one for it and the letter behind it."""
    one, two = F.ascii(_letter(word, at)), F.ascii(_letter(word, at + 1))
    return _bit(one), _bit(one * 37 + two)


def nodes(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(side, level, node, copies, edges) of the nodes that two words or more pass; edges: letter, child, copies, id, rest, sizes, one, two.

    ``id`` and ``rest`` are set at leaves and ends: hashes of the word and of
    what it has behind the edge. ``copies`` says over how many rows the node
    (or child) is dealt. ``sizes``, ``one`` and ``two`` have bits for the
    lengths of the words that pass the edge, for their next letter behind it
    and for their next two.
    """
    size, word, level = F.length("word"), F.col("word"), F.col("level")
    steps = _spelled(words).select("side", "word", "id", F.explode(F.sequence(_half(size - 1, F.col("side")), size)).alias("level"))
    one, two = _next_bits(word, level + 1)
    steps = steps.select("side", "level", F.xxhash64(F.left("word", level)).alias("node"), _letter(word, level).alias("letter"),
                         F.xxhash64(F.left("word", level + 1)).alias("child"), "id", F.xxhash64(_from(word, level + 1)).alias("rest"),
                         _bit(size).alias("size"), one.alias("one"), two.alias("two"))
    last = F.when(F.col("letter") == END, F.col("id"))  # words that end at one node are told apart
    edges = (steps.groupBy("side", "level", "node", "letter", last.alias("end"))
             .agg(F.min("child").alias("child"), F.count(F.lit(1)).alias("passes"), F.min("id").alias("id"), F.min("rest").alias("rest"),
                  F.bit_or("size").alias("sizes"), F.bit_or("one").alias("one"), F.bit_or("two").alias("two")))
    copies = F.ceil(F.col("passes") / hot).cast("int")
    alone = (F.col("passes") == 1) | (F.col("letter") == END)
    edge = F.struct("letter", "child", copies.alias("copies"), F.when(alone, F.col("id")).alias("id"), "rest", "sizes", "one", "two")
    return (edges.groupBy("side", "level", "node").agg(F.sum("passes").alias("passes"), F.collect_list(edge).alias("edges"))
            .filter("passes > 1").select("side", "level", "node", copies.alias("copies"), "edges"))


def _step(met: DataFrame) -> DataFrame:
    """All moves of the states joined with their nodes: pairs have to_id, states don't.

    A move is kept only if words of the length that it leads to pass the edge
    and have the letters that must come next behind it.
    """
    word, p, size, level = F.col("word"), F.col("position"), F.col("size"), F.col("level")
    cols = {"size": F.length("word"), "l0": _letter(word, p), "l1": _letter(word, p + 1)}
    for i in range(3):
        cols[f"one{i}"], cols[f"two{i}"] = _next_bits(word, p + i)
    met = met.select("side", "level", "word", "position", "edits", "edges", *[c.alias(n) for n, c in cols.items()])
    rows = met.select("*", F.explode("edges").alias("edge")).drop("edges")
    edge, letter = F.col("edge"), F.col("edge.letter")
    same, fresh, ends = letter == F.col("l0"), F.col("edits") == 0, letter == END
    more = F.col("l0") != END

    def fits(to_size: Column, i: int) -> Column:
        return ((edge["one"].bitwiseAND(F.col(f"one{i}")) != 0) & (edge["two"].bitwiseAND(F.col(f"two{i}")) != 0)
                & (edge["sizes"].bitwiseAND(_bit(to_size)) != 0))

    other = fresh & ~same
    keep = [(same & (fresh | fits(size + level - p, 1)), p + 1, F.when(fresh, 0).otherwise(1)),
            (other & more & ~ends & fits(size, 1), p + 1, F.lit(1)),
            (other & ~ends & fits(size + 1, 0), p, F.lit(1)),
            (other & more & F.when(ends, size == p + 1).otherwise((F.col("l1") == letter) & fits(size - 1, 2)),
             p + F.when(ends, 1).otherwise(2), F.lit(1))]
    rows = rows.withColumns({f"k{i}": k for i, (k, _, _) in enumerate(keep)}).filter(" OR ".join(f"k{i}" for i in range(4)))
    moves = F.array(*[F.when(F.col(f"k{i}"), F.struct(to.cast("int").alias("position"), edits.cast("int").alias("edits"))) for i, (_, to, edits) in enumerate(keep)])
    rows = rows.select("side", "word", "size", "edge", F.explode(moves).alias("move")).filter("move IS NOT NULL")
    to, found = F.col("move.position"), edge["id"].isNotNull()
    pair = (F.col("move.edits") == 1) & (edge["rest"] == F.xxhash64(_from(word, to)))
    return rows.filter((found & pair) | (~found & (to <= size))).select(
        "side", "word", to.alias("position"), edge["child"].alias("node"), F.col("move.edits").alias("edits"),
        edge["copies"].alias("copies"), edge["id"].alias("to_id"))


def _dealt(states: DataFrame) -> DataFrame:
    return states.withColumn("copy", F.pmod(F.xxhash64("word"), F.col("copies")).cast("int"))


def _frontier_pairs(words: DataFrame, hot: int) -> DataFrame | None:
    """(word, to_id) for neighbours among the words of at most LONG + 1 letters; some twice."""
    trie = stored(nodes(words, hot).sortWithinPartitions("level"), "trie")
    size = F.length("word")
    start = _spelled(words).select("side", "word", _half(size, F.col("side")).alias("position"))
    start = start.select("side", F.col("position").alias("level"), "word", "position",
                         F.xxhash64(F.left("word", F.col("position"))).alias("node"), F.lit(0).alias("edits"))
    crowded = trie.filter("copies > 1").select("side", "level", "node", "copies")
    if crowded.limit(BROADCAST + 1).count() <= BROADCAST:
        crowded = F.broadcast(crowded)
    start = stored(start.join(crowded, ["side", "level", "node"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
                   .sortWithinPartitions("level"), "frontier")
    levels = [r[0] for r in trie.select("level").distinct().orderBy("level").collect()]  # at most LONG + 2
    found, carried = None, None
    for level in levels:
        states = start.filter(F.col("level") == level).select("side", "word", "position", "node", "edits", "copies")
        if carried is not None:
            states = states.unionByName(carried)
        here = trie.filter(F.col("level") == level).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        met = _dealt(states).drop("copies").join(here.select("side", "level", "node", "copy", "edges").hint("shuffle_hash"), ["side", "node", "copy"])
        moved = stored(_step(met), "frontier")
        pairs = moved.filter("to_id IS NOT NULL").select("side", "word", "to_id")
        found = pairs if found is None else found.unionByName(pairs)
        carried = moved.filter("to_id IS NULL").drop("to_id")
    if found is None:
        return None
    return found.select(F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word")).alias("word"), "to_id")


def _less_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a word and of the word less each letter: sums over powers, so a word of m letters costs m steps."""
    base = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        for word, which in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist(), strict=True):
            codes = W.mix(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(codes), base))), dtype=np.uint64)
            ahead = np.concatenate(([np.uint64(0)], np.cumsum(codes * power[:-1], dtype=np.uint64)))
            behind = np.concatenate(([np.uint64(0)], np.cumsum(codes[1:] * power[:-2], dtype=np.uint64)))
            # letters before the missing one keep their power, those after it move one down
            keys = np.unique(np.append(ahead[:-1] + (behind[-1] - behind), ahead[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(keys)), pa.array(np.full(len(keys), which, np.int64))], names=["key", "id"])


def _long_pairs(words: DataFrame) -> DataFrame:
    named = words.select("word", F.xxhash64("word").alias("id"))
    keys = stored(named.mapInArrow(_less_one, "key long, id long"), "long-words")
    met = keys.join(keys.withColumnRenamed("id", "to_id"), "key").filter("id <> to_id").select("id", "to_id").distinct()
    return met.join(named, "id").select("word", "to_id")


def neighbours(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, near, near_n) for all words (distinct, columns word and n) that differ by exactly one inserted, deleted or replaced code point, both ways."""
    pairs = _frontier_pairs(words.filter(F.length("word") <= LONG + 1), hot)
    long = words.filter(F.length("word") > LONG)
    if not long.isEmpty():
        pairs = _long_pairs(long) if pairs is None else pairs.unionByName(_long_pairs(long))
    named = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.xxhash64("word").alias("to_id"))
    if pairs is None:
        return named.select(F.col("near").alias("word"), "near", "near_n").limit(0)
    return (pairs.distinct().join(named, "to_id").select("word", "near", "near_n")
            .filter(F.levenshtein("word", "near", 1) == 1))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last; each round doubles the steps, and counts grow by a factor at every step."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if at.join(nxt, "root", "left_semi").isEmpty():
            return at
        at = stored(at.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def variants(words: DataFrame, factor: int = 10, hot: int = HOT) -> DataFrame:
    """Each word (columns word, n; words distinct) with its form and root: word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one code point that is
    inserted, deleted or replaced. A word's form is the near word of largest n
    (of several, the smallest in code-point order) if that n is at least
    ``factor`` times its own (2 or more), else null; root is where forms lead
    to in the end, the word itself if it has none; n_near counts near words.

    Nulls and edges: rows with a null or empty word or a null n are left out;
    an empty table gives an empty result; words of any length are compared
    whole; other columns are ignored.
    """
    if factor < 2:
        raise ValueError("forms need a factor of 2 or more, or they could run in circles")
    words = words.filter("word <> '' AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    best = neighbours(words, hot).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    top = -F.col("best.less")
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(top >= factor * F.col("n"), F.struct(F.col("best.near").alias("form"), top.alias("form_n"))).alias("to"))
    rows = stored(rows.select("word", "to.form", "n", "n_near", "to.form_n"), "variants")
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
