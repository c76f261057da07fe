"""Operator 5 [native]: shard placement by a permutation-filled lookup table.

Each shard orders the slots of a table of prime size by its own permutation
(offset + j * skip). The shards take turns, each claiming its first free slot,
until the table is full; weights give a shard several turns in a round. A
document's key hashes to a slot, and the slot names the shard. Shares differ
by one slot at most, and few slots change hands when a shard comes or goes.

The table depends on the shards alone and has a fixed size, so it is built
once on the driver and broadcast. Placement is a hash and a look-up.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537  # prime; the table's size, and so the bound of what is broadcast


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n ** 0.5) + 1))


def _draw(name: str, salt: str, below: int) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big") % below


def lookup_table(shards: dict[str, int], slots: int = SLOTS) -> list[str]:
    """The shard of each slot. ``shards``: name -> turns in a round (0 or less: takes none)."""
    if not _is_prime(slots):
        raise ValueError("the number of slots must be prime, so that every skip visits every slot")
    names = sorted(n for n, turns in shards.items() if turns > 0)
    if not names or sum(shards[n] for n in names) > slots:
        raise ValueError("there must be a shard, and a slot for each turn")
    at = {n: _draw(n, "offset", slots) for n in names}
    skip = {n: _draw(n, "skip", slots - 1) + 1 for n in names}
    table: list[str | None] = [None] * slots
    free = slots
    while free:
        for n in names:
            for _ in range(min(shards[n], free)):
                while table[at[n]] is not None:
                    at[n] = (at[n] + skip[n]) % slots
                table[at[n]] = n
                free -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a string key: the first 60 bits of its MD5, modulo the table size."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def table_rows(spark: SparkSession, table: list[str]) -> DataFrame:
    """(slot, shard) as a DataFrame."""
    text = F.from_json(F.lit(json.dumps(table)), "array<string>")
    return spark.range(1).select(F.posexplode(text).alias("slot", "shard"))


def place(docs: DataFrame, shards: dict[str, int], slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (replaced if they are there already).

    Nulls and edges: a row without an id is placed by its text, and one
    without either by the empty string; repeated ids go to one shard; an empty
    table stays empty.
    """
    table = lookup_table(shards, slots)
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(""))
    kept = docs.drop("slot", "shard").withColumn("slot", slot_of(key, slots))
    return kept.join(F.broadcast(table_rows(docs.sparkSession, table)), "slot").select(*kept.columns, "shard")
