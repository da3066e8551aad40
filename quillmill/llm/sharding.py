"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A ring of ``2**ring_bits`` cells holds ``virtual_nodes`` points per shard. A
row falls into a cell by the hash of its key (and ties, so that rows that repeat
a key, or have none, are spread) and belongs to the next point clockwise. No
shard takes more than its capacity: keys that reach a full shard go on
clockwise to the next point of a shard with room. With ``epsilon`` 0 the
capacities add up to the number of rows, so counts differ by one at most.

Only the number of rows per cell reaches the driver (at most ``2**ring_bits``
numbers, whatever the data's size). There the overflow is played through on
counts; the outcome is a list of (cell, range of ranks, shard, first slot).
Rows are ranked within their cell by a window and joined with that list, which
is broadcast: it has at most ``2**ring_bits`` + shards * virtual_nodes entries.
`shard_documents` shuffles id, size and checksum, no text; `assign` moves each
row of its table once, as it stands.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import local_rows

RING_BITS = 14
VIRTUAL_NODES = 256
#: Names of working columns; data columns of any other name are left alone.
CELL, RANK = "__qm_cell", "__qm_rank"


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, ring_bits: int = RING_BITS) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of the points; of points in one cell the smallest hash stays."""
    best: dict[int, tuple[int, int]] = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            h = int.from_bytes(hashlib.blake2b(f"{shard}#{v}".encode(), digest_size=8).digest(), "big")
            cell = h >> (64 - ring_bits)
            best[cell] = min(best.get(cell, (h, shard)), (h, shard))
    return [(cell, best[cell][1]) for cell in sorted(best)]


def capacities(rows: int, shards: int, epsilon: float = 0.0) -> list[int]:
    """Rows that each shard may hold: (1 + epsilon) times the mean, rounded so that they suffice."""
    if epsilon <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [int(-(-rows * (1 + epsilon) // shards))] * shards


def place(counts: dict[int, int], points: list[tuple[int, int]], capacity: list[int]) -> list[dict]:
    """Play the overflow through on the number of keys per cell.

    In each round every point takes what waits there, as far as its shard has
    room, and sends the rest to the next point whose shard has room. A round
    that leaves keys over has filled a shard, so there are as many rounds as
    shards at most.
    """
    cells = [c for c, _ in points]
    owner = [s for _, s in points]
    room, used = list(capacity), [0] * len(capacity)
    waiting: dict[int, list[tuple[int, int, int]]] = {}
    for cell in sorted(counts):
        waiting.setdefault(bisect_left(cells, cell) % len(cells), []).append((cell, 0, counts[cell]))
    out = []
    while waiting:
        spilled: list[tuple[int, list[tuple[int, int, int]]]] = []
        for at in sorted(waiting):
            shard, left = owner[at], []
            for cell, lo, hi in waiting[at]:
                take = min(room[shard], hi - lo)
                if take:
                    out.append({"cell": cell, "lo": lo, "hi": lo + take, "shard": shard, "base": used[shard] - lo})
                    room[shard] -= take
                    used[shard] += take
                if lo + take < hi:
                    left.append((cell, lo + take, hi))
            if left:
                spilled.append((at, left))
        open_points = [i for i, s in enumerate(owner) if room[s]]
        waiting = {}
        for at, left in spilled:
            waiting.setdefault(open_points[bisect_left(open_points, at + 1) % len(open_points)], []).extend(left)
    return out


def cell_of(key: Column, ring_bits: int = RING_BITS, tie: list[Column] | None = None) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, *(tie or [])), 64 - ring_bits).cast("int")


def assign(df: DataFrame, key: str, shards: int, tie: list[Column] | None = None, epsilon: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, ring_bits: int = RING_BITS) -> DataFrame:
    """``df`` with ``shard`` int and ``slot`` long (0, 1, ... within the shard).

    Rows of one key, or of none, are spread by ``tie`` and may be in several
    shards, as capacities ask for anyway. Rows that are equal in key and ``tie``
    share a cell, are interchangeable, and are divided where a capacity ends.
    An empty table gives an empty result.
    Columns of ``df`` named shard or slot are replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    counts = {r[0]: r[1] for r in df.select(cell_of(df[key], ring_bits, tie).alias(CELL)).groupBy(CELL).count().collect()}
    plan = place(counts, ring(shards, virtual_nodes, ring_bits), capacities(sum(counts.values()), shards, epsilon))
    ranges = F.broadcast(local_rows(spark, plan, "cell int, lo long, hi long, shard int, base long").select(*(F.col(c).alias(f"__qm_{c}_") for c in ("cell", "lo", "hi", "shard", "base"))))
    w = Window.partitionBy(CELL).orderBy(F.xxhash64(df[key]), df[key], *(tie or []))
    ranked = df.withColumn(CELL, cell_of(df[key], ring_bits, tie)).withColumn(RANK, F.row_number().over(w).cast("long") - 1)
    hit = (F.col(CELL) == F.col("__qm_cell_")) & (F.col(RANK) >= F.col("__qm_lo_")) & (F.col(RANK) < F.col("__qm_hi_"))
    return (
        ranked.join(ranges, hit)
        .withColumn("shard", F.col("__qm_shard_"))
        .withColumn("slot", F.col("__qm_base_") + F.col(RANK))
        .drop(CELL, RANK, "__qm_cell_", "__qm_lo_", "__qm_hi_", "__qm_shard_", "__qm_base_")
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: id, size in bytes plus 8, checksum, shard and slot.

    A null text has no bytes (size 8, checksum 0). The law is ``rows``.
    """
    text = F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8")
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(F.coalesce(docs["text"], F.lit(""))).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    return assign(slim, "doc_id", shards, [F.col("size"), F.col("text_crc32")]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
