"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table: start + k * step modulo the size,
start and step from a digest of its name. Shards take turns; at its turn a shard claims its first free slot. A shard of
less weight passes some of its turns. The table has a fixed number of rows, so it is broadcast, and placing a key is
one hash and one lookup. Adding or removing a shard moves few keys besides those it must.

Cases. A null key has a fixed slot. Equal keys share a shard. Any key type that Spark hashes will do. Columns named slot or shard
pass by with `_in` after their names, other columns as they are; an empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import aside

#: Slots (a prime), and the shards of the registered query with their weights.
SLOTS = 65_537
SHARDS = tuple((f"shard-{i:02d}", 2.0 if i % 4 == 0 else 1.0) for i in range(24))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[tuple[str, float]], slots: int = SLOTS) -> list[int]:
    """The table: for each slot the index of its shard. shards: names and weights above 0, in any order."""
    if not is_prime(slots) or not shards or len({s for s, _ in shards}) != len(shards) or len(shards) > slots or min(w for _, w in shards) <= 0:
        raise ValueError("a prime number of slots, and distinct shards with weights above 0, no more than slots")
    turns = sorted(range(len(shards)), key=lambda i: shards[i][0])
    digests = [hashlib.sha256(name.encode()).digest() for name, _ in shards]
    start = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    most = max(w for _, w in shards)
    credit, at, table, free = [0.0] * len(shards), list(start), [-1] * slots, slots
    while free:
        for i in turns:
            credit[i] += shards[i][1] / most
            if credit[i] < 1 - 1e-9 or not free:
                continue
            credit[i] -= 1
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
    return table


def place(df: DataFrame, key_col: str, shards: Sequence[tuple[str, float]] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with the columns slot and shard. The table broadcast has exactly `slots` rows."""
    df, key_col = aside(df, ["slot", "shard"], key_col)
    table = [(i, shards[x][0]) for i, x in enumerate(fill(shards, slots))]
    lookup = F.broadcast(df.sparkSession.createDataFrame(table, "__slot int, shard string"))
    slot = F.pmod(F.xxhash64(F.col(f"`{key_col}`")), F.lit(slots)).cast("int")
    return df.withColumn("slot", slot).join(lookup, F.col("slot") == F.col("__slot")).drop("__slot")
