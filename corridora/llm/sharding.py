"""Sharding with a permutation-filled lookup table.

Each shard has a preference order over a prime number of slots, (offset + k * skip) mod m from its name's digest. The
shards take turns claiming their next free slot until the table is full, so each holds m / n slots, one more or less,
and adding or taking a shard moves few slots. A row's key digest picks a slot; the table (m rows, a parameter, so of a
fixed size) is broadcast, and placement is one hash lookup. No shuffle, no state.

Nulls and edge cases: a null key is placed like the empty string; equal keys share a shard; an empty table gives no
rows; columns of the input other than the key are not touched.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
SLOTS = 16381  # a prime, over 200 slots a shard: loads differ by less than a hundredth


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot."""
    if not _is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("a prime number of slots, and as many distinct shards at most, are needed")
    order = []
    for name in shards:
        h = hashlib.md5(name.encode()).hexdigest()
        order.append((int(h[:15], 16) % slots, int(h[15:30], 16) % (slots - 1) + 1 if slots > 2 else 1))
    owner, turn, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for i, (offset, skip) in enumerate(order):
            while owner[slot := (offset + turn[i] * skip) % slots] >= 0:
                turn[i] += 1
            owner[slot] = i
            left -= 1
            if not left:
                break
    return owner


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def assign_shards(spark: SparkSession, df: DataFrame, key: str, shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard) for each row: shard is the index into `shards`."""
    owner = lookup_table(shards or shard_names(SHARDS), slots)
    text = F.lit(",".join(map(str, owner)))
    lookup = spark.range(1).select(F.posexplode(F.split(text, ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    slot = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")
    return df.select(F.col(key), slot.alias("slot")).join(F.broadcast(lookup), "slot").select(key, "slot", "shard")
