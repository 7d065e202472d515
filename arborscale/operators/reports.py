"""Approved reports about trees, folded to one correction a tree.

A report sets a field, clears it, or leaves it alone, so what counts is the last report that did either. That is the greatest of
(order, value or cleared) for each field: an aggregate that combines map-side, merges with what was folded before, and runs as
a stream that takes late reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborscale.operators import clean

#: Columns of an export; ``place`` (the line) parts reports of equal stamps.
EXPORT = "treeId string, kind string, publishedAt string, species string, dbhInches string, latitude string, longitude string, clearFields array<string>, treeName string, significance string, significanceSource string"
#: The widest trunk that a report can mean, in inches, and the longest texts.
MOST_DBH = 200.0
TEXTS = {"tree_name": ("treeName", 60), "significance": ("significance", 500), "significance_source": ("significanceSource", 300)}


def field(at: Column, value: Column, cleared: Column | None = None) -> Column:
    """What a report says of a field: a struct that starts with its order, or null if it leaves the field alone. Clearing wins over
    a value of the same report and holds none."""
    cleared = F.lit(False) if cleared is None else F.coalesce(cleared, F.lit(False))
    return F.when(cleared | value.isNotNull(), F.struct(at.alias("at"), cleared.alias("cleared"), F.when(~cleared, value).alias("value")))


def partials(events: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """The last struct of each field by key. Batches and streams give the same."""
    return events.groupBy(key).agg(*[F.max(c).alias(name) for name, c in fields.items()])


def merged(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Partials of two sets of reports as those of both, whichever of them is older."""
    fields = [c for c in one.columns if c != key]
    return partials(one.unionByName(other), key, {c: F.col(c) for c in fields})


def finite(text: Column) -> Column:
    """Text as a finite number, or null."""
    number = text.cast("string").try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def accepted_species(text: Column, folds: Mapping[str, str], forms: Mapping[str, str]) -> Column:
    """The accepted name that a report proposes, folded by synonyms, else a growth form, else null: a common name is no taxon."""
    lookup = lambda pairs, c: F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), c) if pairs else F.lit(None).cast("string")
    shape = clean.accepted_shape(clean.species_text(text))
    return F.coalesce(lookup(folds, shape), shape, lookup({k.lower(): v for k, v in forms.items()}, F.lower(F.trim(text))))


def report_fields(species: Column) -> dict[str, Column]:
    """The fields of an export's reports (``EXPORT`` with ``place``). A report that the tree is missing says nothing else; any other
    says that it is there. A trunk must be wider than 0 and up to ``MOST_DBH``; a position needs both halves in bounds."""
    at = F.struct(F.coalesce("publishedAt", F.lit("")).alias("stamp"), F.col("place"))
    missing = F.coalesce(F.col("kind") == "missing", F.lit(False))
    clears = lambda name: F.coalesce(F.array_contains("clearFields", name), F.lit(False)) & ~missing
    says = lambda value: F.when(~missing, value)
    dbh, lat, lon = finite(F.col("dbhInches")), finite(F.col("latitude")), finite(F.col("longitude"))
    place = F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lat.alias("latitude"), lon.alias("longitude")))
    out = {"missing": field(at, missing), "species": field(at, says(species)), "dbh": field(at, says(F.when((dbh > 0) & (dbh <= MOST_DBH), dbh)), clears("dbhInches")), "position": field(at, says(place))}
    return out | {name: field(at, says(clean.free_text(F.col(source), most)), clears(source)) for name, (source, most) in TEXTS.items()}


def corrections(folded: DataFrame, key: str = "tree_id") -> DataFrame:
    """Partials of ``report_fields`` as corrections: a cleared trunk is null and ``dbh_unknown``, a cleared text empty."""
    text = lambda c: F.when(F.col(f"{c}.cleared"), "").otherwise(F.col(f"{c}.value")).alias(c)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return folded.select(
        key, F.col("species.value").alias("species"), F.col("dbh.value").alias("diameter_at_breast_height"), flag(F.col("dbh.cleared")).alias("dbh_unknown"),
        F.col("position.value.latitude").alias("latitude"), F.col("position.value.longitude").alias("longitude"), flag(F.col("missing.value")).alias("missing"), *map(text, TEXTS),
    )


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An export of one record a line, with each line's ``place``: files in the order of their names, lines as they stand. A stream
    must bring places of its own."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.schema(EXPORT).json(path).withColumn("place", place)


def folded(reports: DataFrame, folds: Mapping[str, str] | None = None, forms: Mapping[str, str] | None = None) -> DataFrame:
    """Partials of an export's reports by ``tree_id``; reports that name no tree are passed over. For batches and streams."""
    species = accepted_species(F.col("species"), folds or {}, forms or {})
    named = reports.withColumn("tree_id", F.trim("treeId")).where("tree_id <> ''")
    return partials(named, "tree_id", report_fields(species))
