"""Publishing of blocks by generations: only what changed is written, and readers see one generation.

Rows of changed blocks go to a folder of the new generation; the manifest names the generation that holds each block and is
written last. Until then, and after a run that was lost, readers have the generation before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborscale.functions import folders
from arborscale.functions.lineage import checkpointed
from arborscale.operators import blocks


class Refused(ValueError):
    """The new rows may not replace those that are published."""


class Publication:
    """Blocks of rows (``block``, ``morton``, ``tree_id``, ``city`` and columns) under a path."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str]):
        self.spark, self.path, self.columns = spark, path, list(columns)

    def generations(self) -> list[int]:
        """Those whose manifest is complete, oldest first."""
        found = [int(n.removeprefix("manifest-")) for n in folders.names(self.spark, self.path) if n.startswith("manifest-") and folders.exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        return sorted(found)

    def manifest(self, generation: int | None = None) -> DataFrame:
        """``block``, ``city``, ``rows``, ``content`` and ``generation`` of the rows, for the last or another generation; empty before
        the first."""
        known = self.generations()
        if generation is None and not known:
            return self.spark.createDataFrame([], "block long, city string, rows long, content long, generation long")
        return self.spark.read.parquet(f"{self.path}/manifest-{generation or known[-1]}")

    def changes(self, rows: DataFrame) -> DataFrame:
        """Blocks and cities that publishing these rows would add, change or remove."""
        return blocks.compare_manifests(self.manifest(), blocks.manifest(rows, self.columns))

    def publish(self, rows: DataFrame, least_kept: float = 0.75) -> dict[str, int]:
        """Publish the rows in place of what is there, and say how many blocks were written, kept and removed.

        It is refused if fewer than a share of the published rows would be left, or a city would be gone. Nothing is written where
        nothing changed. A block is rewritten whole if the rows of any of its cities changed."""
        before, new = self.manifest(), checkpointed(blocks.manifest(rows, self.columns))
        counts = before.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).head()["n"], new.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).head()["n"]
        if counts[1] < least_kept * counts[0]:
            raise Refused(f"{counts[1]} rows in place of {counts[0]}")
        lost = before.select("city").distinct().join(new.select(F.col("city").alias("there")).distinct(), F.col("city").eqNullSafe(F.col("there")), "left_anti")
        if not lost.isEmpty():
            raise Refused(f"a city would be gone: {lost.head()['city']}")
        changed = checkpointed(blocks.compare_manifests(before, new).select("block").distinct())
        touched = changed.join(new.select("block").distinct(), "block", "left_semi")
        told = {"written": touched.count(), "removed": changed.join(new, "block", "left_anti").count(), "kept": new.select("block").distinct().join(changed, "block", "left_anti").count()}
        if not told["written"] and not told["removed"] and self.generations():
            return told
        generation = max(self.generations(), default=0) + 1
        place = f"{self.path}/rows/generation={generation}"
        folders.delete(self.spark, place)  # of a run that was lost
        folders.delete(self.spark, f"{self.path}/manifest-{generation}")
        if told["written"]:
            blocks.write_blocks(rows.select("block", "morton", "tree_id", "city", *[c for c in self.columns if c not in ("tree_id", "city")]).join(touched, "block", "left_semi"), place)
        old = before.select("block", "generation").distinct()
        named = new.join(changed.withColumn("fresh", F.lit(True)), "block", "left").join(old, "block", "left")
        held = F.when(F.col("fresh"), F.lit(generation).cast("long")).otherwise(F.col("generation"))
        named.select("block", "city", "rows", "content", held.alias("generation")).write.parquet(f"{self.path}/manifest-{generation}")
        return told

    def read(self, generation: int | None = None) -> DataFrame:
        """The rows of a generation, the last one if none is named. Folders of blocks that it doesn't name are pruned."""
        named = self.manifest(generation).select("block", "generation").distinct()
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        typed = rows.withColumn("block", F.col("block").cast("long")).withColumn("generation", F.col("generation").cast("long"))
        return typed.join(named, ["block", "generation"], "left_semi").drop("generation")

    def stale(self, keep: int = 2) -> DataFrame:
        """``generation`` and ``block`` of rows that none of the last ``keep`` manifests names."""
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        there = rows.select(F.col("generation").cast("long").alias("generation"), F.col("block").cast("long").alias("block")).distinct()
        for g in self.generations()[-keep:]:
            there = there.join(self.manifest(g).select("generation", "block"), ["generation", "block"], "left_anti")
        return there

    def prune(self, keep: int = 2) -> int:
        """Delete stale rows and older manifests; whole generations as one folder each. Says how many folders of rows went."""
        known = self.generations()
        named = {r["generation"] for g in known[-keep:] for r in self.manifest(g).select("generation").distinct().collect()}
        gone = [n for n in folders.names(self.spark, f"{self.path}/rows") if n.startswith("generation=") and int(n.removeprefix("generation=")) not in named]
        for name in gone:
            folders.delete(self.spark, f"{self.path}/rows/{name}")
        for g in known[:-keep]:
            folders.delete(self.spark, f"{self.path}/manifest-{g}")
        return len(gone)
