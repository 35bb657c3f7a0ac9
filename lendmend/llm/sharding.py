"""Shard placement by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size. The shards take
turns, each claiming the next slot of its order that is still free, until the table is full. A key
belongs to the shard that holds slot ``hash(key) mod size``. All shards hold about the same number
of slots, and when one joins or leaves, few other keys move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537


def lookup(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """Index of the shard that owns each slot. A shard of weight w claims w slots a turn."""
    weights = list(weights or [1] * len(shards))
    if not shards or len(set(shards)) != len(shards) or len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("shards must be distinct names, at least one, with weights of 1 or more")
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)) or slots < len(shards):
        raise ValueError("slots must be a prime number, not below the number of shards")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    owner, free = [-1] * slots, slots
    while True:
        for i, turns in enumerate(weights):
            for _ in range(turns):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                owner[at[i]] = i
                free -= 1
                if not free:
                    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 48 bits of its MD5. A null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % slots).cast("int")


def place(
    rows: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None
) -> DataFrame:
    """``rows`` with ``slot`` and ``shard`` (the shard's name); no shuffle, nothing dropped.

    The table has ``slots`` rows whatever the input, so it is broadcast. Columns of ``rows`` named
    ``slot`` or ``shard`` are replaced. Repeated rows stay, an empty table stays empty.
    """
    owners = lookup(shards, slots, weights)
    names = F.array(*[F.lit(s) for s in shards])
    owned = rows.sparkSession.range(1).select(
        F.posexplode(F.split(F.lit(",".join(map(str, owners))), ",")).alias("slot", "owner")
    )
    owned = owned.select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))
    kept = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return kept.join(F.broadcast(owned), "slot").select(*[c for c in rows.columns if c not in ("slot", "shard")], "slot", "shard")
