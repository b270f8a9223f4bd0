"""Placement of documents on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 6553  # a prime, about a hundred times the number of shards
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str, low: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[low : low + 8], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard.

    Every shard has a preference order, a permutation of the slots from an offset
    and a step drawn from its name; shards take turns, and each claims the first
    slot of its order that is still free. A shard's share differs from another's
    by one slot at most, and losing a shard moves few slots of the others.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and at most one per slot")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    place = [_number(name, 0) % slots for name in shards]
    step = [_number(name, 8) % (slots - 1) + 1 for name in shards]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            table[place[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 32 bits of the MD5 of the key as text, modulo the slots; a missing key counts as the text ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % slots


def place(
    docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, name: str = "shard"
) -> DataFrame:
    """``docs`` with the shard of each row; a column of that name is replaced.

    One broadcast of ``slots`` rows (a parameter, so its size is known) and no
    shuffle: a key with any share of the rows costs nothing extra. Equal keys share a
    shard, a missing key has one too, an empty table stays empty.
    """
    spark = docs.sparkSession
    table = lookup_table(shards, slots)
    rows = [(slot, shards[i]) for slot, i in enumerate(table)]
    lookup = spark.createDataFrame(rows, "slot bigint, shard string")
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != name)).alias("row")
    placed = docs.select(own, slot_of(F.col(key), slots).alias("slot")).join(F.broadcast(lookup), "slot")
    return placed.select("row.*", F.col("shard").alias(name))


def write_shards(docs: DataFrame, path: str, shards: Sequence[str] = SHARDS, salt: int = 8) -> None:
    """One folder per shard; a shard's rows come from up to ``salt`` tasks, so a hot key is not one task's work.

    The task follows from the row and its partition, so a stage that is run again after a lost executor deals rows
    as before, and repeated rows are spread as well. Columns that hold maps are left out of the hash.
    """
    placed = place(docs, shards=shards)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    part = F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), F.lit(salt))
    placed.repartition("shard", part).write.partitionBy("shard").parquet(path)
