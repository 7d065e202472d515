"""Every operator and pipeline stage on awkward tables: nulls in every column, empty and very long texts, ties, repeated
rows, columns with names that the operators use themselves, and no rows at all."""

import corpus_pipeline
import pytest

from arborscale.llm import chunkstore, decontaminate, hmm, langid, linkgraph, neardup, order, pack, shard, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, text_key string, language_found string, toxicity_score double, benchmark_hits int, kept_id long, shard int, place long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", "   \t\n", "!!! ???", "one", "one two three four five six seven eight", "one two three four five six seven eight", "Éàü ß 漢字 😀 mixed", LONG, LONG + " more", "\x00\x1c odd"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], None if i % 2 else "s", None, 1.0, 1, "k", "l", 0.5, 3, 4, 5, 6) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "a text without an id", None, None, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (5, 1, 1), (6, 1, 0), (6, 1, 1), (None, 1, 1), (8, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (2, None), (3, ""), (None, "one"), (4, "nothing like it")], "item_id long, text string")


def applied(labels, benchmark):
    return {
        "neardup": neardup.classes, "hmm": lambda d: hmm.score(d, states=2, rounds=1), "langid": langid.predict, "shard": shard.shard, "pack": pack.pack, "order": order.training_order,
        "toxicity": lambda d: toxicity.score(d, labels), "decontaminate": lambda d: decontaminate.scan(d, benchmark), "media": chunkstore.media,
    }


@pytest.mark.parametrize("name", ["neardup", "hmm", "langid", "shard", "pack", "order", "toxicity", "decontaminate", "media"])
def test_odd_rows_and_no_rows(spark, odd, none, labels, benchmark, name):
    f = applied(labels, benchmark)[name]
    got = f(odd).collect()
    if name in ("pack", "order"):
        assert sum(r["start"] == 0 for r in got) == odd.count()
    else:
        assert len(got) == odd.count()
    assert f(none).collect() == []


def test_empty_sides(odd, labels, benchmark):
    assert {r["score"] for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.5}
    assert decontaminate.scan(odd, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "HTTP://Org/x", "<a href='http://b.com/'>"), (4, "http://b.com/de/1?q#f", None), (4, "http://b.com/de/1?q#f", None), (None, "http://", "x"), (5, "http://example.org/en/12", "")]
    pages = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "page_id long, url string, html string, host string, rank double")
    got = {r["page_id"]: r for r in linkgraph.judge(pages).collect()}
    assert linkgraph.judge(pages).count() == len(rows) and linkgraph.judge(pages.limit(0)).count() == 0
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("", "", None, "allow")
    assert (got[3]["host"], got[3]["rule"], got[3]["verdict"]) == ("org", "org/", "allow")
    assert (got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("/de/1", "com/de/", "block")
    assert got[5]["rule"] == "example.org/en/1"


def test_stages_keep_columns_and_defined_rows(spark, odd, none, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, str(tmp_path))
        assert kept.columns == odd.columns, name
        assert kept.count() <= odd.count()
        assert stage(spark, none, str(tmp_path)).count() == 0
    # copies fall to one row; null texts stay apart
    deduped = neardup.keep_one(odd)
    texts = [r["text"] for r in deduped.collect()]
    assert texts.count(None) == 2 and texts.count("one two three four five six seven eight") == 1 and sum(t is not None and len(t) > 1000 for t in texts) == 1
