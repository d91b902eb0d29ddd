"""Consistent sharding by a permutation-filled lookup table; native expressions only.

Every shard has its own preference order over the slots of a prime-sized table: it starts at
one hash of its name and steps by another, which visits all slots once since the size is
prime.  Shards take turns; each claims its first free preference, until the table is full.
A row's slot is its key's hash modulo the table size; placement is one lookup in a broadcast
table of ``table_size`` rows, a fixed size that doesn't depend on the data.

Losing or adding a shard moves about one share of the keys and few others.  Defined cases: a
null key hashes like the empty string; equal keys always land together; repeated rows are
placed alike; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65537
#: Broadcast bound: a table of 2**22 rows of two integers.
MAX_TABLE = 1 << 22


def _hash(name: str, what: str) -> int:
    return int.from_bytes(hashlib.md5(f"{what}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], table_size: int = TABLE_SIZE) -> list[int]:
    """The owner (index into ``shards``) of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if table_size > MAX_TABLE or table_size < max(2, len(shards)) or any(table_size % d == 0 for d in range(2, int(table_size**0.5) + 1)):
        raise ValueError(f"table_size must be a prime from the number of shards to {MAX_TABLE}")
    at = [_hash(s, "offset") % table_size for s in shards]
    step = [_hash(s, "skip") % (table_size - 1) + 1 for s in shards]
    owner, free = [-1] * table_size, table_size
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % table_size
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: str, table_size: int):
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % F.lit(table_size)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], table_size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Add ``slot_col`` and ``shard_col`` (the shard's name); columns of those names are replaced."""
    rows = [(i, shards[o]) for i, o in enumerate(lookup_table(shards, table_size))]
    table = df.sparkSession.createDataFrame(rows, "__kl_slot int, __kl_shard string")
    base = df.drop(*[c for c in (slot_col, shard_col) if c in df.columns and c != key])
    placed = base.withColumn("__kl_at", slot_of(key, table_size))
    placed = placed.join(F.broadcast(table), placed["__kl_at"] == table["__kl_slot"], "left")
    return placed.withColumn(slot_col, F.col("__kl_slot")).withColumn(shard_col, F.col("__kl_shard")).drop("__kl_at", "__kl_slot", "__kl_shard")
