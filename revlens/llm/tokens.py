"""Operator 6: token counts with a whole-token shortcut.

Offline, once on the driver: every vocabulary string is encoded alone; those
that give exactly one token are proven, and a pre-token equal to one of them
counts 1 without merging. In the tasks, texts are split into pre-tokens by the
vocabulary's pattern, proven ones are counted directly, and only the rest is
merged by the library, once per distinct pre-token and process.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHE = 300_000
OUT_SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_names() -> dict[str, int]:
    """The characters that stand for the 256 bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def proven_tokens(path: str) -> list[str]:
    """Vocabulary strings that are one pre-token and that the library encodes alone as one token.

    At most as many as the vocabulary has entries, so they may be sent to every task.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = spec["pre_tokenizer"]
    if kind["type"] != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("only byte-level vocabularies without normalisation or prefix space are supported")
    names, special = byte_names(), {x["content"] for x in spec["added_tokens"]}
    strings = []
    for token in spec["model"]["vocab"]:
        try:
            strings.append(bytes(names[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # an added token, or a part of a character
    whole = regex.compile(PATTERN)
    strings = [s for s in strings if s not in special and whole.fullmatch(s)]
    found = Tokenizer.from_file(path).encode_batch(strings, add_special_tokens=False)
    return [s for s, e in zip(strings, found, strict=True) if len(e.ids) == 1]


class _Counts(dict):
    """Pre-token -> tokens: proven ones stay, merged ones are a bounded cache."""

    def __init__(self, proven: list[str], tokenizer: Tokenizer):
        super().__init__(dict.fromkeys(proven, 1))
        self._proven, self._model, self._names, self._room = proven, tokenizer.model, {b: c for c, b in byte_names().items()}, CACHE

    def __missing__(self, piece: str) -> int:
        if not self._room:
            self.clear()
            self.update(dict.fromkeys(self._proven, 1))
            self._room = CACHE
        self._room -= 1
        n = self[piece] = len(self._model.tokenize("".join(map(self._names.__getitem__, piece.encode()))))
        return n


def _count(path: str, proven, special: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pieces = _Counts(proven.value, Tokenizer.from_file(path)), regex.compile(PATTERN).findall
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        for batch in batches:
            ids, sizes, tokens = batch.column("doc_id"), [], []
            for text in batch.column("text"):
                t = text.as_py() or ""
                parts = cut.split(t) if cut else [t]
                n = len(parts) - 1  # a special string is one token
                for part in parts:
                    n += sum(map(counts.__getitem__, pieces(part)))
                tokens.append(n)
                sizes.append(len(t.encode()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of each whole text, as the library counts without added tokens.

    ``path`` names the vocabulary file, at the same place on every node. A
    special string inside a text is one token, which is the library's default.

    Nulls and edges: a null or empty text has no bytes and no tokens; a null
    id stays null; repeated rows give repeated results; an empty table gives
    an empty result; other columns are ignored. A text is held whole, one at a
    time beyond its Arrow batch.
    """
    with open(path, encoding="utf-8") as f:
        special = [x["content"] for x in json.load(f)["added_tokens"]]
    proven = docs.sparkSession.sparkContext.broadcast(proven_tokens(path))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_count(path, proven, special), OUT_SCHEMA)
