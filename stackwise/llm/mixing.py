"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source's documents, in hashed order, form blocks of ``block`` documents; a slot holds one block. The target is a fluid mix:
at each instant the sources that still have blocks are served in proportion to their exact weights, at one block a slot in
all. After T(v) = sum over sources of min(w v, blocks) slots, the fluid has served v of each unit of weight, so block number
i of a source is served from T(i / w) to T((i + 1) / w). The block may not begin before the whole slot in which its service
begins and must end with that in which it ends. Each slot takes the released block with the earliest deadline; as the fluid
itself keeps all these windows, that meets every deadline, so at any time each source is less than one block away from its
share, exhausted sources included. All this is in whole numbers of any size: weights are not rounded. Nothing is dropped or
repeated.
"""

from __future__ import annotations

import heapq
import uuid
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import cmp_to_key
from itertools import accumulate, chain, islice
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch_dir

BLOCK = 32
#: Documents in a group that is ranked by one sort, and groups whose sizes are summed up together.
GROUP_ROWS, GROUPS = 512, 4096
#: Blocks of a source in a row of the schedule, and the blocks up to which the schedule is broadcast; larger ones are joined by shuffling.
CHUNK, BROADCAST_BLOCKS = 1024, 4_000_000
#: Blocks at most where no size of blocks is given, so that scheduling takes a second or two.
BLOCKS = 1 << 19
#: Slots of the schedule that the driver holds at once, some 10 MB.
HELD_SLOTS = 1 << 19


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> dict[str, array]:
    """The slots of each source's blocks, in their order: earliest deadline first in the windows of the fluid mix.

    Ties in deadlines go to the larger weight, then to the smaller name. Takes a logarithm of the number of sources a block.
    """
    out = {s: array("q") for s, n in blocks.items() if n}
    for slot, s in enumerate(_order(blocks, weights)):
        out[s].append(slot)
    return out


def _order(blocks: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[str]:
    """The source of each slot; nothing is held but the sources' next blocks."""
    names = sorted((s for s, n in blocks.items() if n), key=lambda s: (-weights[s], s))
    exact = [Fraction(weights[s]) for s in names]
    scale = lcm(*(w.denominator for w in exact))
    w, n = [int(x * scale) for x in exact], [blocks[s] for s in names]
    # the fluid exhausts sources in the order of blocks / weight; between two such times, slots grow linearly
    gone = sorted(range(len(names)), key=cmp_to_key(lambda a, b: n[a] * w[b] - n[b] * w[a]))
    base, total = list(accumulate((n[s] for s in gone), initial=0)), sum(w)
    active = [total - x for x in accumulate((w[s] for s in gone), initial=0)]

    def served(s: int, i: int) -> tuple[int, int]:
        """Whole part and remainder of w[s] T(i / w[s]), by w[s]."""
        k = bisect_right(gone, 0, key=lambda g: n[g] * w[s] - i * w[g]) if i else 0
        return divmod(base[k] * w[s] + i * active[k], w[s])

    done = [0] * len(names)
    ready: list[tuple[int, int]] = []  # deadline, source

    def window(s: int, release: int) -> tuple[int, int, int]:
        """The next block's release, deadline and the source; a source's next block waits for its last one."""
        end, rest = served(s, done[s] + 1)
        ends[s] = end
        return release, end + (rest > 0), s

    ends = [0] * len(names)
    waiting = [window(s, 0) for s in range(len(names))]  # release, deadline, source
    heapq.heapify(waiting)
    for slot in range(sum(n)):
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        deadline, s = heapq.heappop(ready)
        assert slot < deadline, "a block would miss its deadline"
        done[s] += 1
        if done[s] < n[s]:
            heapq.heappush(waiting, window(s, max(ends[s], slot + 1)))
        yield names[s]


def period(parts: Mapping[str, int]) -> list[str]:
    """The schedule of as many slots as the parts' sum, each part's source in so many, as a list of sources."""
    return [s for _, s in sorted((slot, s) for s, slots in schedule(parts, parts).items() for slot in slots)]


def schedule_tables(docs: Mapping[str, int], weights: Mapping[str, float], block: int) -> Iterator[pa.Table]:
    """Rows (source, chunk, first, slots, starts) of up to CHUNK blocks each: a block's slot and the position of its first document.

    Every slot is full but for the last block of a source. Each table has the rows of HELD_SLOTS slots; a chunk that they
    part has rows in several tables.
    """
    longs, left = pa.list_(pa.int64()), {s: -(-n // block) for s, n in docs.items()}
    order, slot, position, done = _order(left, weights), 0, 0, dict.fromkeys(docs, 0)
    while part := list(islice(order, HELD_SLOTS)):
        found: dict[tuple[str, int], tuple[int, array, array]] = {}
        for s in part:
            i = done[s]
            slots, starts = found.setdefault((s, i // CHUNK), (i, array("q"), array("q")))[1:]
            slots.append(slot)
            starts.append(position)
            done[s] = i + 1
            slot += 1
            position += block if i + 1 < left[s] else docs[s] - i * block
        columns = [[s for s, _ in found], [c for _, c in found], *([np.frombuffer(x[k], dtype=np.int64) if k else x[k] for x in found.values()] for k in range(3))]
        kinds = [pa.string(), pa.int64(), pa.int64(), longs, longs]
        yield pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["_source", "_chunk", "_first", "_slots", "_starts"])


SLOTS = "_source string, _chunk long, _first long, _slots array<long>, _starts array<long>"


def _slots(spark: SparkSession, docs: Mapping[str, int], weights: Mapping[str, float], block: int) -> DataFrame:
    """One row per source and chunk. A schedule of several tables is written to the shared folder, table by table."""
    tables = schedule_tables(docs, weights, block)
    first, second = next(tables, None), next(tables, None)
    if second is None:
        return spark.createDataFrame(first if first is not None else [], SLOTS)
    path = f"{scratch_dir(spark)}/stackwise/slots-{uuid.uuid4().hex}"
    for table in chain([first, second], tables):
        spark.createDataFrame(table, SLOTS).coalesce(1).write.mode("append").parquet(path)
    parts = spark.read.schema(SLOTS).parquet(path).groupBy("_source", "_chunk").agg(F.sort_array(F.collect_list(F.struct("_first", "_slots", "_starts"))).alias("x"))
    return parts.select("_source", "_chunk", F.col("x._first")[0].alias("_first"), F.flatten("x._slots").alias("_slots"), F.flatten("x._starts").alias("_starts"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", key: str = "doc_id", block: int | None = None, exponent: float = 0.5) -> DataFrame:
    """One row per document: key, source, ``block`` (of its source), ``slot``, ``position`` (of all documents, gapless from 0).

    ``weights`` gives each source's target weight; a source without one gets the least of them. Without weights (none or empty), a source
    weighs its number of documents to the power ``exponent``. A null source is the source ''. Documents of a source
    follow the hash of their key (ties: the key), repeated rows in any order; the last block of a source may be short. An
    empty table gives an empty result. Only key and source are shuffled: documents are ranked inside groups of about
    GROUP_ROWS by hash, so a source with a third of all rows is many groups; what reaches the driver is one row per source, and what leaves it is
    two numbers a block, HELD_SLOTS blocks at a time. A given ``block`` holds at any size; without one, blocks have BLOCK documents,
    or more in tables of over BLOCKS such blocks, and so depend on the table's size.
    """
    placed = _placed(docs, weights, source, key, block, exponent, carry=False)
    return placed.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("_block").alias("block"), "slot", "position")


def _placed(docs: DataFrame, weights: Mapping[str, float] | None, source: str, key: str, block: int | None, exponent: float, carry: bool) -> DataFrame:
    """_key, _source, _block, slot, position and, if it is to be carried, the whole row as _row."""
    spark = docs.sparkSession
    whole = [F.struct(*(docs[c] for c in docs.columns)).alias("_row")] if carry else []
    rows = docs.select(docs[key].alias("_key"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("_source"), F.xxhash64(docs[key].cast("string")).alias("_hash"), *whole)
    counts = rows.groupBy("_source").agg(F.count("*").alias("n")).collect()
    n_docs = {r["_source"]: r["n"] for r in counts}
    if not weights:
        target = {s: n**exponent for s, n in n_docs.items()}
    else:
        least = min(weights.values())
        target = {s: weights.get(s, least) for s in n_docs}
    if any(w <= 0 for w in target.values()):
        raise ValueError("weights must be positive")
    block = block or max(BLOCK, -(-sum(n_docs.values()) // BLOCKS))
    groups = max(1, -(-max(n_docs.values(), default=1) // GROUP_ROWS))
    rows = rows.withColumn("_group", F.pmod(F.shiftright("_hash", 20), F.lit(groups)).cast("int"))
    sizes = rows.groupBy("_source", "_group").agg(F.count("*").alias("_n")).withColumn("_span", F.expr(f"_group div {GROUPS}"))
    spans = sizes.groupBy("_source", "_span").agg(F.sum("_n").alias("_m")).select("_source", "_span", (F.sum("_m").over(Window.partitionBy("_source").orderBy("_span")) - F.col("_m")).alias("_base"))
    inside = F.sum("_n").over(Window.partitionBy("_source", "_span").orderBy("_group")) - F.col("_n")
    before = sizes.withColumn("_inside", inside).join(spans, ["_source", "_span"]).select("_source", "_group", (F.col("_base") + F.col("_inside")).alias("_before"))
    # a row per source and group of ranks: few, so Spark may broadcast it; else both sides are dealt by the same key
    ranked = rows.join(before, ["_source", "_group"]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_source", "_group").orderBy("_hash", "_key")) - 1)
    ranked = ranked.withColumn("_block", F.expr(f"_rank div {block}"))
    # two numbers a block, in rows of up to CHUNK blocks
    slots = _slots(spark, n_docs, target, block).drop("_first")
    few = sum(-(-n // block) for n in n_docs.values()) <= BROADCAST_BLOCKS
    placed = ranked.withColumn("_chunk", F.expr(f"_block div {CHUNK}")).join(F.broadcast(slots) if few else slots, ["_source", "_chunk"])
    inside = F.expr(f"cast(_block % {CHUNK} as int)")
    placed = placed.withColumns({"slot": F.get("_slots", inside), "position": F.get("_starts", inside) + F.col("_rank") % block})
    return placed.select("_key", "_source", "_block", "slot", F.col("position").cast("long").alias("position"), *(["_row"] if carry else []))


def in_mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", key: str = "doc_id", block: int | None = None, exponent: float = 0.5) -> DataFrame:
    """docs, unchanged, in the order of mix_sources: a global sort by position, so files and their rows follow the mix."""
    return _placed(docs, weights, source, key, block, exponent, carry=True).orderBy("position").select("_row.*")
