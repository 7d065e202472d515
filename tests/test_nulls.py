"""Null keys, NaN and infinity keep their rows and get defined results."""

import pytest
from pyspark.sql import functions as F

from arborscale.operators import blocks, clean, dedup, evalmatch, fits, grids, lookups, quality, rank


def test_rows_with_null_keys_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 4.0), (None, None)], "k string, v double")
    assert sorted(map(tuple, rank.with_group_counts(df, ["k"], {"n": F.lit(True)}).select("k", "n").collect()), key=repr) == sorted([("a", 2), ("a", 2), (None, 2), (None, 2)], key=repr)
    assert rank.outliers(df, "k", "v", 3, 2, 1, F.lit(False)).count() == 4
    assert sorted(r["v"] for r in dedup.impute_mean(df, "v", ["k"]).collect()) == [1.0, 1.0, 4.0, 4.0]
    assert fits.average_ranks(df, "v", "r", ["k"]).count() == 4
    ids = spark.createDataFrame([("x", 1), ("x", 2), (None, 3), (None, 4)], "id string, line int")
    assert sorted(map(str, (r["id"] for r in dedup.disambiguated(ids, "id", "line").collect()))) == ["None", "None", "x-1", "x-2"]


def test_shares_are_of_identified_trees(spark):
    counts = spark.createDataFrame([("c", None, 99), ("c", "oak", 1)], "city string, species string, trees long")
    got = {r["species"]: (r["share"], r["tier"]) for r in rank.rarity(counts).collect()}
    assert got == {None: (None, None), "oak": (1.0, "common")}


def test_only_finite_sizes_are_ranked(spark):
    df = spark.createDataFrame([("c", float("nan")), ("c", float("inf")), ("c", 2.0), ("c", 3.0), ("c", None), ("c", -1.0)], "city string, dbh double")
    got = {str(r["dbh"]): r["size_rank"] for r in rank.size_rank(df, "city", "dbh").collect()}
    assert got == {"nan": None, "inf": None, "2.0": 2, "3.0": 1, "None": None, "-1.0": None}


def test_manifest_tells_where_nulls_stand(spark):
    rows = [(1, "x", "a", None, "b"), (2, "x", "a", "b", None), (3, "x", "a", "", "b")]
    got = blocks.manifest(spark.createDataFrame(rows, "block long, city string, p string, q string, r string"), ["p", "q", "r"])
    assert len({r["content"] for r in got.collect()}) == 3


def test_strict_schema_fails_at_lossy_values(spark):
    rows = spark.createDataFrame([("1", "a"), (None, "b")], "n string, t string")
    assert clean.enforce_schema(rows, {"n": "int", "t": "string", "x": "date"}, ["n"], strict=True)[0].collect() == [(1, "a", None), (None, "b", None)]
    with pytest.raises(Exception, match="n can't be int: 1x"):
        clean.enforce_schema(rows.union(rows.selectExpr("'1x'", "t")), {"n": "int"}, ["n"], strict=True)[0].collect()


def test_common_names_keep_quotes_and_proper_words(spark):
    names = ["  APPLE  'James GRIEVE' ", "'ohi'a lehua", None, "", "apple 'james grieve'", "dodge's oak"]
    got = spark.createDataFrame([(names,)], "n array<string>").select(clean.common_names(F.col("n"), ["Dodge"])).first()[0]
    assert got == ["Apple 'James GRIEVE'", "'Ohi'a lehua", "Dodge's oak"]


def test_slugs_never_repeat(spark):
    names = ["elm", "elm", "elm 2", "elm", "elm 4", "elm 2", None]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = [r["slug"] for r in clean.slugs(rows, "name", ["i"]).orderBy("i").collect()]
    assert got[:6] == ["elm", "elm-3", "elm-2", "elm-5", "elm-4", "elm-2-2"]


def test_mixed_chips_are_refused(spark):
    t = spark.createDataFrame([("a", 1.0, 1.0, "train", 5.0, True), ("b", 3.0, 3.0, "val", 6.0, False), ("c", 15.0, 1.0, "val", 7.0, False)], "id string, x double, y double, split string, dbh double, ok boolean")
    none = t.where("false").select("id", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    with pytest.raises(Exception, match="several splits in chip 0_0"):
        evalmatch.rebuild_labels(t, none, none, (0.0, 0.0), 10.0).collect()
    got = evalmatch.rebuild_labels(t, none, none, (0.0, 0.0), 10.0, {"dbh": "ok"}, "drop").select("id", "dbh").collect()
    assert got == [("c", None)]


def test_distance_bands_without_a_second(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0), (3, 100.0, 0.0), (4, 100.0, 4.0), (5, 100.0, 6.0), (6, 500.0, 0.0)], "id int, x double, y double")
    found = {(r["low"], r["high"]): (r["rows"], r["mutual"], r["median_ratio"]) for r in lookups.distance_bands(lookups.two_nearest(df, 10.0), (0, 2, 5)).collect()}
    # 1 and 2 have no second neighbour, 6 has none at all
    assert found == {(0.0, 2.0): (2, 2, (2 / 4 + 2 / 6) / 2), (2.0, 5.0): (3, 2, 4 / 6)}
    assert lookups.distance_bands(lookups.two_nearest(df.limit(0), 10.0), (0, 2, 5)).count() == 0


def test_seasonal_report_counts_missing_values(spark):
    rows = [(1, 5.0, "1995-06-01"), (2, None, "1995-07-01"), (2, float("nan"), "1995-09-01"), (None, 5.0, None)]
    df = spark.createDataFrame(rows, "k int, v double, d string").withColumn("d", F.to_date("d"))
    report = lambda t: quality.seasonal_report(t, "k", {"v": (0, 10)}, "d", 1995, (6, 8)).first()
    assert tuple(report(df)) == (4, 2, 2, 2, False)
    assert tuple(report(df.where("k = 1"))) == (1, 1, 0, 0, True)
    assert not report(df.limit(0))["valid"]


def test_review_rank_of_chips_with_one_side(spark):
    p = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 2, None, 0.0), ("b", 3, "x", None)], "chip string, id int, genus string, mask double")
    t = spark.createDataFrame([("a", 10, "y"), ("c", 11, None)], "chip string, id int, genus string")
    m = spark.createDataFrame([(1, 10)], "p_id int, t_id int")
    found = {r["chip"]: (r["missed"], r["false_positive"], r["ignored"], r["label_errors"], r["error_score"], r["f1"], r["place"]) for r in evalmatch.review_rank(p, t, m, "genus", "mask").collect()}
    assert found == {"a": (0, 0, 1, 1, 1, 1.0, 1), "b": (0, 1, 0, 0, 1, 0.0, 2), "c": (1, 0, 0, 0, 1, 0.0, 3)}


def test_edge_neighbours_leave_out_test_guarded_and_later(spark):
    records = [(1, 105.0, 50.0, "train", False, None), (2, 105.0, 50.0, "test", False, None), (3, 105.0, 50.0, "train", True, None), (4, 105.0, 50.0, "train", False, "2001-01-01"), (5, 95.0, 50.0, "train", False, None), (6, 105.0, 60.0, "train", False, "1999-01-01")]
    df = spark.createDataFrame(records, "id int, x double, y double, split string, guarded boolean, d string").withColumn("plant_date", F.to_date("d"))
    tiles = spark.createDataFrame([(0, 0)], "tx int, ty int")
    found = evalmatch.edge_neighbours(tiles, df, 100.0, 60.0, F.lit("2000-01-01").cast("date"))
    assert sorted(r["id"] for r in found.collect()) == [1, 6]


def test_consolidated_names(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), (None, 5)], "name string, v int")
    folds = spark.createDataFrame([("b", "a", 0), ("d", "z", 2), ("c", "z", 1), ("q", "r", 3)], "synonym string, accepted string, place int")
    # b has its accepted row, c comes before d, q has no row
    assert sorted(map(tuple, lookups.consolidated(rows, "name", folds).collect()), key=str) == sorted([("a", 1), ("z", 3), (None, 5)], key=str)
    assert lookups.consolidated(rows, "name", folds.limit(0)).count() == 5


def test_raster_cells_of_missing_values(spark):
    rows = [(0, 0, 1, 2.0, True, False), (0, 0, 2, 4.0, True, None), (0, 0, 2, None, False, True), (1, 0, 1, None, None, True), (None, 0, 1, 1.0, True, False)]
    found = {r["cx"]: r for r in grids.raster_cells(spark.createDataFrame(rows, "cx int, cy int, day int, value double, valid boolean, wet boolean"), 0.5, 1.0, 2).collect()}
    assert (found[0]["pixels"], found[0]["land"], found[0]["valid"], found[0]["mean"], found[0]["eligible"]) == (3, 2, 2, 3.0, True)
    assert [tuple(d) for d in found[0]["days"]] == [(1, 2.0), (2, 4.0)]
    assert (found[1]["mean"], found[1]["days"], found[1]["eligible"]) == (None, [], False)
    assert not found[None]["eligible"]


def test_vocabulary_leaves_out_nulls(spark):
    df = spark.createDataFrame([("x", None), ("x", ""), (None, "x")], "a string, b string")
    assert sorted(map(tuple, blocks.vocabulary(df, ["a", "b"]).collect())) == [("a", "x"), ("b", ""), ("b", "x")]
    assert blocks.vocabulary(df.limit(0), ["a", "b"]).count() == 0
