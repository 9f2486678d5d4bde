"""Sharding by a permutation-filled lookup table, with DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime of about 128 slots a shard keeps the shards' shares within one percent of each other.
SLOTS = 16381
SHARDS = 128


def _draw(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.md5(f"{purpose}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot.

    Each shard prefers the slots in the order offset, offset + skip, offset + 2 skip, ... modulo the prime; in turns, each
    shard claims the first slot of its order that is still free. The table depends on the parameters alone.
    """
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime no smaller than the number of shards, not {slots}")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, one at least")
    owner = [-1] * slots
    at = [_draw(s, "offset") % slots for s in shards]
    skip = [_draw(s, "skip") % (slots - 1) + 1 for s in shards]
    left = slots
    while left:
        for i in range(min(len(shards), left)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            left -= 1
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 32 bits of its MD5 modulo the table's size. A null key counts as the empty one."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(slots).cast("long"))


def assign_shards(df: DataFrame, key: str, shards: list[str] | int = SHARDS, slots: int = SLOTS, spread: Column | None = None) -> DataFrame:
    """df with ``slot`` (long) and ``shard`` (int).

    One narrow pass: the table has ``slots`` rows whatever the data, so it's broadcast, and no row is shuffled. Equal keys
    meet in one shard. Where one key may be hot, ``spread`` is a column (say another id) that is appended to the key:
    the key's rows then go over as many shards as that column has values. Nulls in either count as empty. Columns of df
    named slot or shard are replaced; an empty df gives an empty result.
    """
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    table = df.sparkSession.createDataFrame(list(enumerate(lookup_table(names, slots))), "slot long, shard int")
    k = F.coalesce(df[key].cast("string"), F.lit(""))
    if spread is not None:
        k = F.concat(k, F.lit("\x00"), F.coalesce(spread.cast("string"), F.lit("")))
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    return df.select(*(df[c] for c in kept), slot_of(k, slots).alias("slot")).join(F.broadcast(table), "slot").select(*kept, "slot", "shard")


def write_shards(df: DataFrame, key: str, path: str, shards: list[str] | int = SHARDS, slots: int = SLOTS, files_per_shard: int = 8) -> None:
    """Writes df as Parquet, a folder for each shard; a shard's rows go over several tasks by what their columns hold, so a large shard isn't one task.

    Columns that Spark can't hash, maps and variants, don't count for that.
    """
    out = assign_shards(df, key, shards, slots)
    n = shards if isinstance(shards, int) else len(shards)
    hashed = [out[f.name] for f in out.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    out.repartition(n * files_per_shard, "shard", F.pmod(F.xxhash64(*hashed), F.lit(files_per_shard))).write.partitionBy("shard").parquet(path)
