"""Streams end with the rows of the batch query."""

from arborscale.operators import quality
from arborscale.streaming import incremental
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def drained(spark, df, name):
    q = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return {tuple(r) for r in spark.table(name).collect()}


def test_streams_match_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    renamed = lambda df: df.select(F.col("event_type").alias("city"), F.col("user_id").alias("species"))
    want = {tuple(r) for r in incremental.city_species_counts(renamed(events)).collect()}
    assert drained(spark, incremental.city_species_counts(renamed(stream())), "counts") == want
    got = drained(spark, incremental.latest_reports(stream(), "user_id", "event_id", "value"), "latest")
    fold = quality.latest_values(events, "user_id", ["event_id"], ["value"], F.lit(None).cast("boolean"))
    assert got == {(r["user_id"], r["value"]) for r in fold.collect()}
    assert drained(spark, incremental.windowed_counts(stream(), "ts", "1 day", "1 day", "event_type"), "windows")


def test_keys_are_checked_across_pages(spark, tmp_path):
    pages = [[(1, "a"), (2, "a")], [(3, "a"), (2, "b")], [(2, "a"), (None, "c"), (4, "d")], [(4, "d")]]
    for i, page in enumerate(pages):
        spark.createDataFrame([(*r, i) for r in page], "k int, s string, page int").coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    stream = spark.readStream.schema("k int, s string, page int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
    found = {(2, "a", 2, 0, 2), (None, "c", 1, 2, 2), (4, "d", 2, 2, 3)}
    assert drained(spark, incremental.repeated_keys(stream, ["k", "s"], "page"), "repeated") == found
    told = []
    q = incremental.repeated_keys(stream, ["k", "s"], "page").writeStream.outputMode("update").foreachBatch(lambda df, i: told.extend(map(tuple, df.collect()))).start()
    q.processAllAvailable()
    q.stop()
    assert set(told) == found  # each repeat is told when its page comes
