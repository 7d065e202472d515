"""Generations of blocks: what is rewritten, what readers see, lost runs, refusals; hashes that no other value gives; visible trees."""

import hashlib

import pytest
from arborscale.functions import folders
from arborscale.operators import blocks, dedup, publish, quality, rank
from pyspark.sql import functions as F

SCHEMA = "tree_id string, city string, species string, block long, morton long"


def rows(spark, changed=(), gone=(), cities=("a", "b", None)):
    made = [(f"t{b}-{i}", cities[(b + i) % len(cities)], f"s{i}{'!' if b in changed and i == 3 else ''}", b, i * 7 % 5) for b in range(6) for i in range(9) if b not in gone]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture
def out(spark, tmp_path):
    return publish.Publication(spark, str(tmp_path / "world"), ["tree_id", "species"])


def seen(df):
    return sorted(map(tuple, df.select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()), key=str)


def test_only_changed_blocks_are_written_and_readers_see_one_generation(spark, out):
    assert out.publish(rows(spark)) == {"written": 6, "removed": 0, "kept": 0}
    assert out.publish(rows(spark)) == {"written": 0, "removed": 0, "kept": 6} and out.generations() == [1]
    assert out.publish(rows(spark, changed=[4])) == {"written": 1, "removed": 0, "kept": 5}
    assert folders.names(spark, f"{out.path}/rows/generation=2") == ["_SUCCESS", "block=4"]
    assert seen(out.read()) == seen(rows(spark, changed=[4])) and seen(out.read(1)) == seen(rows(spark))
    assert out.publish(rows(spark, changed=[4], gone=[2])) == {"written": 0, "removed": 1, "kept": 5}
    assert seen(out.read()) == seen(rows(spark, changed=[4], gone=[2]))
    assert {tuple(r) for r in out.stale(1).collect()} == {(1, 2), (1, 4)}
    assert {r.change for r in out.changes(rows(spark, changed=[4, 5])).collect()} == {"added", "changed"}


def test_a_lost_run_leaves_the_old_generation_and_the_next_one_cleans_up(spark, out):
    out.publish(rows(spark))
    broken = rows(spark, changed=[1]).withColumn("morton", F.when(F.col("block") == 1, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("morton")))
    with pytest.raises(Exception, match="lost"):
        out.publish(broken)
    spark.range(3).write.parquet(f"{out.path}/rows/generation=2/block=1")
    assert out.generations() == [1] and seen(out.read()) == seen(rows(spark))
    out.publish(rows(spark, changed=[1]))
    assert seen(out.read()) == seen(rows(spark, changed=[1])) and out.generations() == [1, 2]


def test_fewer_rows_or_a_lost_city_are_refused(spark, out):
    out.publish(rows(spark))
    for bad in (rows(spark, gone=[1, 2, 3]), rows(spark, cities=("a", "b", "b")), rows(spark).limit(0)):
        with pytest.raises(publish.Refused):
            out.publish(bad)
    assert out.generations() == [1] and seen(out.read()) == seen(rows(spark))


def test_pruning_deletes_what_no_manifest_names(spark, out):
    for k in range(4):
        out.publish(rows(spark, changed=range(k)).withColumn("species", F.concat("species", F.lit(str(k)))))
    assert out.prune(keep=1) == 3 and out.generations() == [4] and folders.names(spark, f"{out.path}/rows") == ["generation=4"]
    assert out.read().count() == 54


def test_hashes_tell_values_with_signs_apart(spark):
    tricky = [("a|=b", "c"), ("a", "b|=c"), ("a|1=b", "c"), (None, "c"), ("null", "c"), ("", "c"), ("a|b", None)]
    got = [blocks.manifest(spark.createDataFrame([(1, "x", *t)], "block long, city string, one string, two string"), ["one", "two"]).head().content for t in tricky]
    ids = [r[0] for r in spark.createDataFrame(tricky, "one string, two string").select(dedup.content_id("one", "two")).collect()]
    assert len(set(got)) == len(set(ids)) == len(tricky)
    null = blocks.manifest(spark.createDataFrame([(1, None, "a")], "block long, city string, one string"), ["one"])
    assert blocks.compare_manifests(null, null).count() == 0


def test_visible_trees_and_foliage_shares_of_odd_rows(spark):
    trees = [("a", "a", 1.0, 2.0, None, None, "M"), ("b", "a", 1.0, 2.0, None, None, "M"), ("c", None, 1.0, 2.0, False, False, "OSM_X"), ("d", "d", float("nan"), 2.0, None, None, "M"), ("e", "e", float("inf"), 2.0, None, None, "M"), ("f", "f", None, 2.0, None, None, "M"), ("g", "g", 91.0, 2.0, None, None, "M"), ("h", "h", 1.0, 2.0, True, None, "M"), ("i", "i", 1.0, 2.0, None, True, "M")]
    df = spark.createDataFrame(trees, "tree_id string, cluster_id string, latitude double, longitude double, missing boolean, duplicate boolean, data_source string")
    assert {r.tree_id for r in quality.visible(df).collect()} == {"a", "c"} and {r.tree_id for r in quality.visible(df, ["osm"]).collect()} == {"c"}
    rows_ = [("Acer", 1.5, 1.5, True, i % 2 == 0) for i in range(20)] + [("Acer", 3.5, 1.5, True, True)] * 3 + [("Acer", 50.0, 1.0, None, None), ("Ulmus", 1.5, 1.5, True, True), (None, 1.0, 1.0, True, True), ("Acer", None, 1.0, True, True)]
    got = {(r.genus, r.cell): (r.deciduous_share, r.level, r.open_trees) for r in rank.foliage_shares(spark.createDataFrame(rows_, "genus string, latitude double, longitude double, identified boolean, deciduous boolean")).collect()}
    assert sorted(got.values(), key=str) == sorted([(0.5, "cell", 0), (13 / 23, "region", 0), (13 / 23, "genus", 1), (None, None, 0)], key=str)


def test_content_of_many_rows_in_a_block(spark):
    """The hashes of some 65,536 rows of a block and city sum up to more than a long holds."""
    rows = spark.range(150_000).select(F.lit(1).cast("long").alias("block"), F.lit("c").alias("city"), F.col("id").cast("string").alias("tree_id"))
    want = sum(int(hashlib.md5(f"{len(str(i))}={i}".encode()).hexdigest()[:12], 16) for i in range(150_000))
    assert want > 1 << 63
    got = blocks.manifest(rows, ["tree_id"]).collect()
    assert [(r.rows, r.content % (1 << 64)) for r in got] == [(150_000, want % (1 << 64))]
