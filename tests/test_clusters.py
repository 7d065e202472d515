"""Clusters of odd rows: no position, no city, no size, links, and every order of tiers."""

from arborscale.operators import dedup
from pyspark.sql import functions as F

SCHEMA = "tree_id string, city string, latitude double, longitude double, data_source string, to string"


def found(spark, rows, size=(1e-4, 1e-4), link=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.tree_id: r.cluster_id for r in dedup.assign_clusters(df, size, F.col("to") if link else None).collect()}


def test_each_tier_in_its_order(spark):
    at = lambda i, source, place=0.0, to=None, city="x": (i, city, 40 + place, 5.0, source, to)
    assert found(spark, [at("z", "MUNI"), at("a", "COMMUNITY_1"), at("b", "OSM_1"), at("c", "PREDICTED_1"), at("d", "NOTABLE_1"), at("e", "MUNI")]) == {"z": "z", "e": "e", "a": "e", "b": "e", "c": "e", "d": "e"}
    assert found(spark, [at("k", "COMMUNITY_1"), at("a", "COMMUNITY_2"), at("b", "SATELLITE_1"), at("c", "OSM_1")]) == {"k": "k", "a": "a", "b": "b", "c": "a"} | {"b": "a"}
    assert found(spark, [at("s", "SATELLITE_1"), at("t", "SATELLITE_2"), at("b", "OSM_1"), at("c", "PREDICTED_1")]) == {"s": "s", "t": "t", "b": "s", "c": "s"}
    assert found(spark, [at("o", "OSM_1"), at("p", "OSM_2"), at("c", "PREDICTED_1"), at("d", "NOTABLE_1")]) == {"o": "o", "p": "p", "c": "o", "d": "d"}
    assert found(spark, [at("m", "MUNI"), at("n", "NOTABLE_1", to="q"), at("l", "NOTABLE_2"), at("o", "OSM_1", to="q")], link=True) == {"m": "m", "n": "q", "l": "m", "o": "m"}
    # near enough for one grid only, and the first grid before the next
    assert found(spark, [at("m", "MUNI", 0.00006), at("a", "MUNI", 0.00018), at("o", "OSM_1", 0.00012)])["o"] in ("m", "a")


def test_rows_without_position_city_or_size_stay_themselves(spark):
    rows = [("m", "x", 40.0, 5.0, "MUNI", None), ("a", "x", None, 5.0, "OSM_1", None), ("b", None, 40.0, 5.0, "OSM_1", None), ("c", "y", 40.0, 5.0, "OSM_1", None), ("d", "w", 40.0, 5.0, "OSM_1", None), ("e", "x", 40.0, 5.0, "OSM_1", None), ("f", "y", 40.0, 5.0, None, None)]
    sizes = spark.createDataFrame([("x", 1e-4, 1e-4), ("y", 1e-3, 1e-3)], "city string, lat_deg double, lon_deg double")
    assert found(spark, rows, sizes) == {"m": "m", "a": "a", "b": "b", "c": "f", "d": "d", "e": "m", "f": "f"}
    assert found(spark, [], sizes) == {}


def test_a_larger_cell_reaches_further(spark):
    rows = [("m", c, 40.00001, 5.00001, "MUNI", None) for c in ("x",)] + [("n", "y", 40.00001, 5.00001, "MUNI", None), ("o", "x", 40.0004, 5.00001, "OSM_1", None), ("p", "y", 40.0004, 5.00001, "OSM_1", None)]
    sizes = spark.createDataFrame([("x", 1e-4, 1e-4), ("y", 1e-3, 1e-3)], "city string, lat_deg double, lon_deg double")
    assert found(spark, rows, sizes) == {"m": "m", "n": "n", "o": "o", "p": "n"}
