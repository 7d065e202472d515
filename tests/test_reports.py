"""Reports folded to corrections: what a report sets, clears or leaves alone, in any order, merged, and as a stream."""

import json
import random

import pytest
from arborscale.operators import reports
from arborscale.plans import q_publish
from arborscale.plans.registry import Views
from arborscale.streaming import incremental
from pyspark.sql import functions as F

FORMS = {"palm tree": "Palm"}


def report(tree, at, **fields):
    return {"treeId": tree, "kind": "update", "publishedAt": at, **fields}


@pytest.fixture
def fold(spark, tmp_path):
    def run(*records):
        path = tmp_path / f"export-{random.random()}.ndjson"
        path.write_text("\n".join(json.dumps(r) for r in records))
        found = reports.corrections(reports.folded(reports.read_export(spark, str(path)), {"Platanus x acerifolia": "Platanus x hispanica"}, FORMS))
        return {r.tree_id: r for r in found.collect()}

    return run


def test_each_field_keeps_its_last_value_by_stamp(fold):
    r = fold(report("a", "2026-03-01", species="Quercus palustris", dbhInches=10), report("a", "2026-03-03", dbhInches="12.5"), report("a", "2026-03-02", species="quercus RUBRA", latitude=42.3, longitude=-71.1), report("a", "2026-03-03", treeName=" The   Senator "))["a"]
    assert (r.species, r.diameter_at_breast_height, r.dbh_unknown, r.latitude, r.longitude, r.missing, r.tree_name, r.significance) == ("Quercus rubra", 12.5, False, 42.3, -71.1, False, "The Senator", None)


def test_equal_stamps_go_by_lines(fold):
    assert fold(report("a", "1", dbhInches=1), report("a", "1", dbhInches=2), report("a", None, dbhInches=3))["a"].diameter_at_breast_height == 2


def test_cleared_fields_stay_cleared_until_a_later_value(fold):
    r = fold(
        report("a", "1", dbhInches=50, treeName="Old", significance="why"), report("a", "2", clearFields=["dbhInches", "treeName"], dbhInches=7, treeName="no"), report("a", "3", species="Ficus microcarpa"),
        report("b", "1", clearFields=["dbhInches", "significance"]), report("b", "2", dbhInches=14, significance="new"), report("c", "1", clearFields=["species"], species="Acer rubrum"),
    )
    assert (r["a"].diameter_at_breast_height, r["a"].dbh_unknown, r["a"].tree_name, r["a"].significance) == (None, True, "", "why")
    assert (r["b"].diameter_at_breast_height, r["b"].dbh_unknown, r["b"].significance) == (14, False, "new")
    assert r["c"].species == "Acer rubrum"


def test_missing_is_what_the_last_report_says_and_says_nothing_else(fold):
    gone = lambda tree, at, **more: {"treeId": tree, "kind": "missing", "publishedAt": at, **more}
    r = fold(report("a", "1", species="Acer rubrum"), gone("a", "2", dbhInches=9, clearFields=["treeName"]), gone("b", "1"), report("b", "2"))
    assert (r["a"].missing, r["a"].species, r["a"].diameter_at_breast_height, r["a"].tree_name) == (True, "Acer rubrum", None, None)
    assert r["b"].missing is False


def test_bad_values_leave_fields_alone(fold):
    r = fold(
        report("a", "1", dbhInches=5, latitude=1, longitude=2, species="Acer rubrum"), report("a", "2", dbhInches=-3, latitude=42, longitude=None), report("a", "3", dbhInches="NaN", latitude=91, longitude=0, species="  "),
        report("a", "4", dbhInches="inf", latitude="x", longitude="-inf", species="42"), report("a", "5", dbhInches=200.5), report("", "1", dbhInches=1), report("  ", "1", dbhInches=1), report(None, "1", dbhInches=1),
        report("b", "1", species="platanus x acerifolia 'Bloodgood'", dbhInches=200), report("c", "1", species="PALM tree", significanceSource="y" * 400),
    )
    assert set(r) == {"a", "b", "c"}
    assert (r["a"].diameter_at_breast_height, r["a"].latitude, r["a"].longitude, r["a"].species) == (5, 1, 2, "Acer rubrum")
    assert (r["b"].species, r["b"].diameter_at_breast_height, len(r["c"].significance_source)) == ("Platanus x hispanica", 200, 300)


def test_partials_merge_in_any_order_and_number_of_parts(spark):
    every = q_publish.tree_reports(Views(spark, "/root/testdata/sf0.001"))
    whole = {tuple(r) for r in reports.corrections(reports.folded(every)).collect()}
    parts = [reports.folded(every.where(F.col("place") % 3 == k)) for k in (2, 0, 1)]
    both = reports.merged(reports.merged(parts[0], parts[1], "tree_id"), parts[2], "tree_id")
    assert {tuple(r) for r in reports.corrections(both).collect()} == whole and len(whole) > 10


def test_stream_with_late_reports_ends_as_the_batch(spark, tmp_path):
    every = q_publish.tree_reports(Views(spark, "/root/testdata/sf0.001"))
    every.repartition(4, "place").write.json(str(tmp_path / "in"))  # each file holds reports of all times
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = incremental.corrections(stream).writeStream.outputMode("complete").format("memory").queryName("corrections").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("corrections").collect()} == {tuple(r) for r in incremental.corrections(every).collect()}
