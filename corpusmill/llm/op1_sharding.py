"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table: a permutation
given by an offset and a stride.  Shards take turns, each claiming the next slot of its order that
is still free, until the table is full; so each shard owns almost the same number of slots, and
when a shard is added or removed, few slots change hands.  A document's key hash names a slot, the
slot its shard.

The table has a fixed, documented size (`slots`, a prime), whatever the number of documents: it is
built once on the driver and broadcast, and a document is placed by one hash and one hash-join
look-up without any shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SLOTS = 65537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and stride of a shard's permutation of the slots."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:12], 16) % slots, int(digest[12:24], 16) % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Owner (index into `shards`) of each slot."""
    if not _is_prime(slots):
        raise ValueError(f"the table size must be a prime, not {slots}")
    if not shards or len(shards) > slots or len(set(shards)) < len(shards):
        raise ValueError("shard names must be distinct, at least one and at most one per slot")
    state = [preference(s, slots) for s in shards]
    at = [offset for offset, _ in state]
    owner = [-1] * slots
    filled = 0
    while True:
        for i, (_, stride) in enumerate(state):
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + stride) % slots
            owner[slot] = i
            at[i] = (slot + stride) % slots
            filled += 1
            if filled == slots:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 48 bits of its MD5, modulo the table size.  A null key has the slot of ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % slots).cast("int")


def assign_shards(docs: DataFrame, shards: list[str], slots: int = SLOTS, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """`docs` with a column `out`: the index of the shard that each row belongs to.

    Rows with equal keys share a shard; null keys are placed together, by the empty string's hash.
    Texts are never looked at, so empty and very long ones behave alike.  An empty table gives an
    empty result.  Other columns pass through, whatever their names; a column named `out` that is
    already there is replaced.
    """
    spark = docs.sparkSession
    owners = " ".join(map(str, lookup_table(shards, slots)))
    owner_of = spark.range(1).select(F.posexplode(F.split(F.lit(owners), " ")).alias("slot", "owner"))
    # rows as one struct, which no column here can clash with
    rest = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != out])
    rows = docs.select(rest.alias("row"), slot_of(docs[key], slots).alias("slot"))
    # proven bound: the table has `slots` rows, a parameter, however many documents there are
    return rows.join(F.broadcast(owner_of), "slot").select("row.*", F.col("owner").cast("int").alias(out))


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), shard_names())


def _sql() -> str:
    owners = " ".join(map(str, lookup_table(shard_names())))
    return f"""
    WITH owner_of AS (SELECT string_split('{owners}', ' ') AS owners)
    SELECT doc_id,
           CAST(owners[1 + CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) % {SLOTS}] AS INTEGER) AS shard
    FROM documents, owner_of"""


QUERIES = {"op1_sharding": query}
ORACLES = {"op1_sharding": _sql()}
