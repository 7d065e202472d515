"""Scans: several files as one relation, optional columns, records in text, boxes, geometry text, sorted sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborscale.functions import geometry


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet files of differing columns as one relation, by name, with the file of each row."""
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p).withColumn("file_name", F.input_file_name()) for p in paths])
    return one


def with_columns(df: DataFrame, required: Sequence[str], optional: Mapping[str, str]) -> DataFrame:
    """The required columns, and the optional ones with typed nulls where they are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    return df.select(*required, *[F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()])


def read_csv(spark: SparkSession, path: str, schema: str, null: str = "NA") -> DataFrame:
    """A file with a header whose null is a token."""
    return spark.read.csv(path, schema=schema, header=True, nullValue=null)


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line, by an explicit schema."""
    return spark.read.schema(schema).json(path)


def json_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Records in a text column as columns; fields that a record lacks are null."""
    return df.withColumn("record_", F.from_json(column, schema)).select(*df.columns, "record_.*")


def tag_records(df: DataFrame, prefix: str) -> DataFrame:
    """Portal records (``id``, ``tags`` as JSON) as tree columns: the species, else the genus; a cultivar in either of
    its tags; the reference."""
    tags = F.from_json("tags", "map<string,string>")
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col("t")[n]), F.lit("")) for n in names])
    return df.withColumn("t", tags).select(F.concat(F.lit(prefix), F.col("id")).alias("tree_id"), first("species", "genus").alias("species"), first("taxon:cultivar", "cultivar").alias("cultivar"), first("ref").alias("ref"))


def write_by_city(df: DataFrame, path: str) -> None:
    """One folder for each city, so that a reader of one city lists and reads only that."""
    df.write.mode("overwrite").partitionBy("city").parquet(path)


def read_city(spark: SparkSession, path: str, city: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("city") == city)


def in_boxes(lat: Column, lon: Column, boxes: Sequence[tuple[float, float, float, float]]) -> Column:
    """Whether a point lies in any of the half-open boxes (south, north, west, east)."""
    return reduce(lambda a, b: a | b, [(lat >= s) & (lat < n) & (lon >= w) & (lon < e) for s, n, w, e in boxes], F.lit(False))


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], partitions: int, row_group_bytes: int = 1 << 20) -> None:
    """Range-partitioned and sorted by the keys, with small row groups for readers that skip by statistics."""
    df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def wkt_centroid(wkt: Column) -> Column:
    """The centroid ``x``, ``y`` of POLYGON and MULTIPOLYGON text, all parts without their holes; null for other text."""
    return geometry.centroid(geometry.rings_of_wkt(wkt))
