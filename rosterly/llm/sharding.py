"""Shard placement by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table whose size is prime (offset and step from a hash
of its name). The shards take turns, each claiming its first free slot, until the table is full. A document's slot is
its key's hash modulo the size; the table, whose size is a parameter, is broadcast, so placement costs one lookup and
no shuffle. When a shard is added or removed, few keys move.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: A prime well over a hundred times the number of shards keeps the shares of shards within about one per cent.
SLOTS, SHARDS = 65_537, 64


def _hash(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot."""
    if not _is_prime(slots) or not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("slots must be prime; shard names distinct, at least one, at most as many as slots")
    offset = [_hash(f"offset:{s}") % slots for s in shards]
    step = [_hash(f"step:{s}") % (slots - 1) + 1 for s in shards]
    tried, owner, free = [0] * len(shards), [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owner[slot := (offset[i] + tried[i] * step[i]) % slots] >= 0:
                tried[i] += 1
            owner[slot], free = i, free - 1
            if not free:
                break
    return owner


def key_slot(key, slots: int):
    """The slot of a key column: sixty bits of its text's SHA-256, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, 15), 16, 10).cast("bigint"), F.lit(slots))


def place(docs: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS, out_slot: str = "slot", out_shard: str = "shard") -> DataFrame:
    """docs with its slot and shard; columns of those names are replaced.

    Equal keys go to one shard; a null key goes where the empty text goes. Choose a key as fine as a document, so that
    no source makes a shard hot. The broadcast table has exactly `slots` rows of two integers.
    """
    names = docs.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], "`_slot` bigint, `_shard` string")
    placed = docs.drop(out_slot, out_shard) if key_col not in (out_slot, out_shard) else docs
    return placed.withColumn("_slot", key_slot(F.col(key_col), slots)).join(F.broadcast(names), "_slot", "left").withColumnsRenamed({"_slot": out_slot, "_shard": out_shard})


def write_shards(docs: DataFrame, key_col: str, shards: list[str], path: str, slots: int = SLOTS, files_per_shard: int = 4) -> None:
    """Write docs as Parquet in one folder per shard; each shard's rows are dealt over files_per_shard tasks."""
    spread = F.pmod(F.xxhash64(key_col), F.lit(files_per_shard))
    place(docs, key_col, shards, slots).withColumn("_part", spread).repartition("shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)


NAMES = [f"shard-{i:03d}" for i in range(SHARDS)]


def op6_sharding(spark, sf_dir):
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", NAMES).select("doc_id", F.col("slot").cast("bigint").alias("slot"), "shard")


#: The table is given to SQL as a list; the place of a key in it is worked out there.
SQL = f"""
WITH k AS (SELECT doc_id, CAST('0x' || left(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 15) AS BIGINT) % {SLOTS} AS slot FROM documents),
t AS (SELECT {lookup_table(NAMES)} AS owner)
SELECT doc_id, slot, format('shard-{{:03d}}', owner[slot + 1]) AS shard FROM k, t
"""
