"""Every registered query of the tree-inventory operators, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborscale.functions import folders
from arborscale.functions.lineage import shared_dir
from arborscale.operators import clean, rollups, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The tree observations as SQL, for the twins.
OBS = """obs AS (
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS tree_id, concat('c', s_nationkey) AS city,
  CASE l_linenumber WHEN 1 THEN 'COMMUNITY_MAP' WHEN 2 THEN 'OSM_IMPORT' WHEN 3 THEN 'SATELLITE_V1' WHEN 4 THEN 'PREDICTED_V1' WHEN 5 THEN 'NOTABLE_LIST'
    ELSE concat('MUNI_', s_nationkey % 3) END AS data_source,
  concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) AS species, split_part(concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)), ' ', 1) AS genus,
  p_brand AS cultivar, CAST(l_shipdate AS DATE) AS plant_date,
  40 + ((l_orderkey * 7919 + l_partkey * 31 + l_suppkey * 104729 + l_linenumber * 611) % 20000) / 1e6 AS latitude,
  -71 - ((l_orderkey * 15485863 + l_partkey * 97 + l_suppkey * 13 + l_linenumber * 4391) % 20000) / 1e6 AS longitude,
  CASE WHEN l_quantity > 2 THEN l_quantity END AS dbh, nullif(round(l_discount * 100), 0) AS crown_width_m,
  l_orderkey AS order_key, l_partkey AS part_key, l_suppkey AS supp_key, l_linenumber AS line, p_size AS size_class
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


class Views:
    """The driver's tables under one folder, and tree-inventory tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def rollups(self) -> stored.Store:
        """The stored rollups of ``obs``, built where the shared folder has none for these very files."""
        files = folders.fingerprint(self.spark, *[f"{self.sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "part")])
        path = f"{shared_dir(self.spark)}/arborscale-rollups-{files[:32]}"
        store = stored.Store(self.spark, path)
        if not store.generation():
            store.build(self.obs, tree_rollups())
        return store

    @cached_property
    def obs(self) -> DataFrame:
        """Tree observations: one row per source record."""
        rows = self.table("lineitem").join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        species = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)"))
        line = F.col("l_linenumber")
        label = F.when(line == 1, "COMMUNITY_MAP").when(line == 2, "OSM_IMPORT").when(line == 3, "SATELLITE_V1").when(line == 4, "PREDICTED_V1").when(line == 5, "NOTABLE_LIST")
        return rows.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("tree_id"),
            F.concat(F.lit("c"), F.col("s_nationkey")).alias("city"),
            label.otherwise(F.concat(F.lit("MUNI_"), F.col("s_nationkey") % 3)).alias("data_source"),
            species.alias("species"), F.split_part(species, F.lit(" "), F.lit(1)).alias("genus"), F.col("p_brand").alias("cultivar"), F.to_date("l_shipdate").alias("plant_date"),
            F.expr("40 + ((l_orderkey * 7919 + l_partkey * 31 + l_suppkey * 104729 + l_linenumber * 611) % 20000) / 1e6D").alias("latitude"),
            F.expr("-71 - ((l_orderkey * 15485863 + l_partkey * 97 + l_suppkey * 13 + l_linenumber * 4391) % 20000) / 1e6D").alias("longitude"),
            F.when(F.col("l_quantity") > 2, F.col("l_quantity")).alias("dbh"), F.nullif(F.round(F.col("l_discount") * 100), F.lit(0.0)).alias("crown_width_m"),
            F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"), line.alias("line"), F.col("p_size").alias("size_class"),
        )



def tree_rollups() -> list[stored.Rollup]:
    """The rollups that dashboards read: trees by city and species alone, and with one more column each."""
    by_species = {"city": F.col("city"), "species": F.col("species")}
    trees, size, part = {"trees": stored.Measure("count")}, F.col("size_class"), F.col("part_key")
    width = F.col("crown_width_m")
    more = {"fit": stored.Measure("count", part % 7 == 1), "canopy": stored.Measure("sum", F.pi() * (width / 2) ** 2), "largest": stored.Measure("greatest", F.col("dbh")), "log_crown": stored.Measure("moments", F.when((F.col("dbh") > 0) & (width > 0), F.log("dbh")), F.when((F.col("dbh") > 0) & (width > 0), F.log(width)))}
    traits = {
        "form": F.when(size % 3 == 0, "palm").when(size % 3 == 1, "conifer").otherwise("broad"), "growth": F.when(part % 3 == 0, "slow").when(part % 3 == 1, "medium"),
        "wildlife": F.when(part % 5 == 0, "high").otherwise("low"), "fire": F.when(part % 11 < 4, "resistant").otherwise("flammable"),
    }
    cell = lambda k: {"cell_y": F.floor(F.col("latitude") * k), "cell_x": F.floor(F.col("longitude") * k)}
    extra = {"year": {"plant_year": F.year("plant_date")}, "dbh": {"dbh_class": rollups.dbh_class(F.col("dbh"))}, "crown": {"crown_class": rollups.crown_class(width)}, "origin": {"kind": clean.source_kind(F.col("data_source"), notable=False)}, "traits": traits, "cell": cell(1000)}
    gaps = {"origin": {"no_dbh": stored.Measure("count", F.col("dbh").isNull())}}
    return [stored.Rollup("species", by_species, trees | more), *[stored.Rollup(name, by_species | c, trees | gaps.get(name, {})) for name, c in extra.items()]]


def counted(sql: str) -> str:
    """``count_if(x)`` as a filtered count, whose type is the same in both engines."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if(') : end - 1]}){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None):
    """Register a function of ``Views`` under ``name``, with the SQL that gives the same rows."""

    def register(f: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = counted(sql.replace("{OBS}", OBS))
        return f

    return register
