"""Stored rollups: which one answers, merging, generations, and rows that no rollup covers."""

import pytest
from arborscale.functions import folders
from arborscale.operators import rollups, stored
from arborscale.operators.stored import Measure, Rollup
from pyspark.sql import functions as F

ROWS = [("x", "Acer rubrum", 1990, 5.0, 2.0), ("x", "Acer rubrum", 1991, 7.0, 2.5), ("x", "Acer saccharum", None, None, None), ("y", "Quercus alba", 1990, 20.0, 6.0), (None, "Quercus alba", 1992, 11.0, 3.0), ("y", None, 1990, 3.0, 1.0), ("y", "Quercus rubra", 1995, 9.0, 4.0)]


@pytest.fixture
def both(spark):
    city = {"city": F.col("city"), "species": F.col("species")}
    return [
        Rollup("species", city, {"trees": Measure("count"), "wide": Measure("sum", F.col("dbh")), "line": Measure("moments", F.col("dbh"), F.col("crown"))}),
        Rollup("year", city | {"year": F.col("year")}, {"trees": Measure("count"), "measured": Measure("count", F.col("dbh").isNotNull()), "least": Measure("least", F.col("dbh")), "most": Measure("greatest", F.col("dbh"))}),
    ]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "city string, species string, year int, dbh double, crown double")


@pytest.fixture
def store(spark, tmp_path, rows, both):
    made = stored.Store(spark, str(tmp_path / "store"))
    made.build(rows, both)
    return made


def taken(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_the_smallest_covering_rollup_answers(store):
    assert store.covering(["species"], ["trees"])["name"] == "species"
    assert store.covering(["city", "year"], ["trees"])["name"] == "year"
    assert store.covering(["city"], ["trees", "most"])["name"] == "year"
    assert store.covering(["city"], ["wide", "most"]) is None and store.covering(["genus"], ["trees"]) is None
    assert store.covering([], ["line"])["name"] == "species"


def test_answers_are_those_of_the_rows(store, rows):
    genus = F.split_part("species", F.lit(" "), F.lit(1))
    assert taken(store.answer({"genus": genus}, ["species"], ["trees", "wide"])) == taken(rows.groupBy(genus.alias("genus")).agg(F.count("*"), F.sum("dbh")))
    old = F.col("year") < 1992
    assert taken(store.answer({"city": F.col("city")}, ["city", "year"], ["trees", "measured", "least", "most"], old)) == taken(rows.where(old).groupBy("city").agg(F.count("*"), F.count("dbh"), F.min("dbh"), F.max("dbh")))
    assert taken(store.answer({}, [], ["trees"])) == [(7,)] and taken(store.answer({}, ["year"], ["trees"], F.col("year") > 2000)) == [(0,)]


def test_a_line_from_moments_is_that_of_the_rows(store, rows):
    got = {r.city: r for r in stored.line(store.answer({"city": F.col("city")}, ["city"], ["line"]), ["city"], "line").collect()}
    want = {r.city: r for r in rollups.ols(rows, ["city"], F.col("dbh"), F.col("crown")).collect()}
    assert set(got) == set(want)
    for city, r in want.items():
        for c in ("n", "b", "a", "sigma", "r2", "x_max"):
            assert got[city][c] == (pytest.approx(r[c], abs=1e-9) if r[c] is not None else None)


def test_what_no_rollup_covers_is_scanned_or_refused(store, rows):
    with pytest.raises(LookupError):
        store.answer({"crown": F.col("crown")}, ["crown"], ["trees"])
    scan = Rollup("scan", {"crown": F.col("crown")}, {"trees": Measure("count")})
    assert len(taken(store.answer({"crown": F.col("crown")}, ["crown"], ["trees"], scan=(rows, scan)))) == 7


def test_merged_rows_give_the_rollups_of_all(spark, tmp_path, rows, both):
    store = stored.Store(spark, str(tmp_path / "merged"))
    store.build(rows.where("year = 1990"), both)
    store.add(rows.where("year <> 1990"), both)
    store.add(rows.where("year is null"), both)
    store.add(rows.where("false"), both)
    for r in both:
        found = next(x for x in store.catalogue().collect() if x["name"] == r.name)
        assert taken(spark.read.parquet(found["path"])) == taken(stored.partial(rows, r)) and found["rows"] == stored.partial(rows, r).count()
    assert store.generation() == 4
    store.prune(keep=1)
    assert len(folders.names(spark, store.path)) == 3 and taken(store.answer({}, [], ["trees"])) == [(7,)]


def test_other_grains_or_part_of_the_rollups_are_refused(store, rows, both):
    with pytest.raises(ValueError):
        store.add(rows, both[:1])
    with pytest.raises(ValueError):
        store.add(rows, [Rollup("species", {"city": F.col("city")}, both[0].measures), both[1]])
    assert store.generation() == 1


def test_a_run_that_ends_early_leaves_the_last_generation(spark, store, rows, both):
    broken = rows.withColumn("dbh", F.when(F.col("city") == "y", F.raise_error(F.lit("lost"))).otherwise(F.col("dbh")))
    with pytest.raises(Exception, match="lost"):
        store.add(broken, both)
    spark.range(1).write.parquet(f"{store.path}/catalogue-2")
    folders.delete(spark, f"{store.path}/catalogue-2/_SUCCESS")  # a catalogue that was not finished
    assert store.generation() == 1 and taken(store.answer({}, [], ["trees"])) == [(7,)]
    store.add(rows.where("city = 'x'"), both)
    assert store.generation() == 2 and taken(store.answer({}, [], ["trees"])) == [(10,)]


def test_a_table_without_rows_has_empty_rollups(spark, tmp_path, rows, both):
    store = stored.Store(spark, str(tmp_path / "none"))
    store.build(rows.where("false"), both)
    assert taken(store.answer({"city": F.col("city")}, ["city"], ["trees"])) == [] and taken(store.answer({}, [], ["trees"])) == [(0,)]
    with pytest.raises(FileNotFoundError):
        stored.Store(spark, str(tmp_path / "nowhere")).catalogue()


def test_trimmed_fits_checkpoint_fits_only(spark):
    """Points were written to a checkpoint in each round, all their columns included."""
    from arborscale.functions.lineage import checkpointed
    from arborscale.operators import fits

    rows = spark.range(1, 400).select((F.col("id") % 40 + 1).cast("double").alias("x"), F.when(F.col("id") % 50 == 0, 900.0).otherwise((F.col("id") % 40 + 1) * 2.0 + F.col("id") % 3).alias("y"), F.lit("g").alias("genus"))
    sizes = []
    stop = lambda df: sizes.append(df.count()) or checkpointed(df)
    out = fits.trimmed_fits(rows, [("genus", "genus")], F.col("x"), F.col("y"), F.col("n") > 10, stop, sigmas=2.0).head()
    assert sizes == [1, 1, 1]
    assert out["n"] < 399 - 7
