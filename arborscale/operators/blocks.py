"""Spatial blocks for publishing: keys, ordered files, manifests and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborscale.operators import cells


def with_block(df: DataFrame, zoom: int = 20, shift: int = 8) -> DataFrame:
    """The block of a row (its tile, some bits coarser, packed) and its Morton place inside the block."""
    x, y = cells.mercator_tile(F.col("latitude"), F.col("longitude"), zoom)
    tiled = df.withColumn("tx_", x).withColumn("ty_", y)
    block = F.shiftleft(F.shiftright("tx_", shift), 24).bitwiseOR(F.shiftright("ty_", shift))
    return tiled.withColumn("block", block).withColumn("morton", cells.morton(F.col("tx_"), F.col("ty_"), shift)).drop("tx_", "ty_")


def write_blocks(df: DataFrame, path: str) -> None:
    """A folder for each block, rows by Morton place and id; a block that is too large for a task still gets only as
    many files as ranges of its places. The number of ranges is the session's number of shuffle partitions."""
    df.repartitionByRange("block", "morton").sortWithinPartitions("block", "morton", "tree_id").write.mode("overwrite").partitionBy("block").parquet(path)


def vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """The different values (``kind``, ``value``) of some string columns, named by ``kind``; nulls are no values."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in columns])).alias("v"))
    return each.select("v.*").where("value is not null").distinct()


def write_vocabulary(df: DataFrame, columns: list[str], path: str) -> None:
    """The vocabulary as a file, or files of ascending ranges, in order of kind and value."""
    vocabulary(df, columns).repartitionByRange("kind", "value").sortWithinPartitions("kind", "value").write.mode("overwrite").parquet(path)


def manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and content hash of each block and city. The hash is a sum of row hashes of 48 bits, so it needs no order and
    combines map-side; it is the sum modulo 2^64, so it fits a long for any number of rows. Each value stands behind its length, so no two rows read alike, whatever signs they hold; a null
    is told from any text."""
    marked = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns]
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *marked)), 1, 12), 16, 10).cast("long")
    low = F.lit((1 << 24) - 1).cast("long")
    n = df.groupBy("block", "city").agg(F.count("*").alias("rows"), F.sum(row.bitwiseAND(low)).alias("low_"), F.sum(F.shiftright(row, 24)).alias("high_"))
    content = F.shiftleft(F.col("high_") + F.shiftright("low_", 24), 24).bitwiseOR(F.col("low_").bitwiseAND(low))
    return n.select("block", "city", "rows", content.alias("content"))


def compare_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks that are added, removed or changed."""
    o = old.select(F.col("block").alias("ob"), F.col("city").alias("oc"), F.struct("rows", "content").alias("ov"))
    both = o.join(new.select("block", "city", F.struct("rows", "content").alias("nv")), (F.col("ob") == F.col("block")) & F.col("oc").eqNullSafe(F.col("city")), "full")
    change = F.when(F.col("ov").isNull(), "added").when(F.col("nv").isNull(), "removed").when(F.col("ov") != F.col("nv"), "changed")
    return both.select(F.coalesce("block", "ob").alias("block"), F.coalesce("city", "oc").alias("city"), change.alias("change")).where("change is not null")


def stale_objects(objects: DataFrame, named: DataFrame, oldest_kept: Column) -> DataFrame:
    """Objects (``name``, ``stamp``) that no kept manifest names and that are older than the retention."""
    return objects.join(named, "name", "left_anti").where(F.col("stamp") < oldest_kept)
