"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into ``CELLS`` equal cells. Each shard has ``VIRTUAL`` nodes on it, and the keys of a cell belong to the
next node clockwise. Every shard has a bound, and the bounds add up to the number of keys with none more than one apart;
keys that find their shard full continue clockwise to the next shard with room. So counts are balanced exactly, and a
key moves only if its own arc changes or the bound pushes it on.

Only the count of each cell, a fixed number of rows, is planned on the driver; keys are ranked within their cell by
Spark and joined to the plan.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, VIRTUAL, CELL_BITS = 24, 64, 15
CELLS = 1 << CELL_BITS


def ring(shards: int = SHARDS, virtual: int = VIRTUAL) -> list[int]:
    """The shard of each cell: that of the first node at or after it. A node that hits a taken cell takes the next
    free one."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual):
            at = xxhash.xxh3_64_intdigest(f"shard {shard} node {v}") % CELLS
            while at in nodes:
                at = (at + 1) % CELLS
            nodes[at] = shard
    owner, owners = nodes[min(nodes)], [0] * CELLS
    for cell in range(CELLS - 1, -1, -1):
        owner = nodes.get(cell, owner)
        owners[cell] = owner
    return owners


def plan(counts: dict[int, int], shards: int = SHARDS, virtual: int = VIRTUAL) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, first rank, end rank, shard, first slot): where the keys of each cell go.

    First every shard takes keys of its own arcs up to its bound, in ring order; then what is over goes on clockwise
    from its cell."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, owners = [0] * shards, ring(shards, virtual)
    segments, over = [], []

    def place(cell: int, start: int, size: int, shard: int) -> None:
        segments.append((cell, start, start + size, shard, filled[shard]))
        filled[shard] += size
        room[shard] -= size

    for cell in sorted(counts):
        n, shard = counts[cell], owners[cell]
        if size := min(n, room[shard]):
            place(cell, 0, size, shard)
        if size < n:
            over.append((cell, size, n))
    for cell, start, end in over:
        at = cell
        while start < end:
            at = (at + 1) % CELLS
            if size := min(end - start, room[owners[at]]):
                place(cell, start, size, owners[at])
                start += size
    return segments


#: Equal rows that one task deals out at once.
RUN = 1_000_000


def shard(documents: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """One row per row of ``documents`` with its ``shard`` and its ``slot``, which counts a shard's rows from 0.

    ``size`` is the bytes of the text (none for null) and 8; ``text_crc32`` is that of the text, or of no bytes. The
    law is ``rows``: counts are at most one apart. The key on the ring is the id with size and checksum of the text, so a
    hot text or source weighs on no shard, and rows without an id, or with one that repeats, spread like others. Rows
    equal in all three are dealt as runs: they are counted before the shuffle and told apart behind it. Other columns
    aren't read. An empty table gives an empty result."""
    spark = documents.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    row = ["doc_id", "size", "text_crc32"]
    rows = documents.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    cell = F.shiftrightunsigned(F.xxhash64(*row), 64 - CELL_BITS).cast("int").alias("cell")
    counts = {r["cell"]: r["n"] for r in rows.groupBy(cell).agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
    # at most CELLS + CELLS * shards segments, and in fact little over CELLS: small whatever the input
    segments = spark.createDataFrame(plan(counts, shards, virtual), "cell int, first long, end long, shard int, base long")
    in_cell = Window.partitionBy("cell").orderBy(F.xxhash64(*row), *row)
    ranked = rows.groupBy(*row).agg(F.count("*").alias("n")).withColumn("cell", cell).withColumn("from", F.sum("n").over(in_cell) - F.col("n"))
    runs = ranked.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))))
    last = F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1
    each = runs.withColumn("rank", F.explode(F.sequence(F.col("from") + F.col("run") * RUN, F.col("from") + last)))
    placed = each.join(F.broadcast(segments.withColumnRenamed("cell", "of")), (F.col("cell") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select(*row, F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
