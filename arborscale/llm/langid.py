"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from training texts. A text is encoded in blocks with each
dictionary; the language whose dictionary gives the fewest bytes wins. A narrow margin between the two smallest sizes
means that the text resembles two languages equally, and the prediction is then not accepted.

The classifier is fitted on a bounded sample: for each language the ``DOCS`` different texts with the smallest hashes, and
a piece of ``PIECE`` characters from a hashed place of each whole text, so copies and openings don't fill a dictionary.
Prediction encodes every block of every whole text.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborscale.llm._shared import fold, remember_only, ship, unused

#: The language of a text that is null or has no letters.
UNKNOWN = "und"
#: Bounds of the training sample: different texts of a language, characters of each, and languages with a dictionary (those
#: with most documents).
DOCS, PIECE, LANGUAGES = 400, 160, 400
#: Blocks are encoded alone, so that the dictionary and not the text's own past decides, however long the text is.
BLOCK = 8192
#: Least margin, as a share of the second smallest size, for a prediction to be accepted.
MARGIN = 0.005
LETTER = re.compile(r"[^\W\d_]")


class CompressionModel:
    """Dictionaries by language. It travels as plain bytes; each worker builds its compressors once."""

    def __init__(self, samples: dict[str, bytes]):
        self.samples = samples  # the most frequent language first
        self._encoders: list | None = None

    def __getstate__(self) -> dict:
        return {"samples": self.samples, "_encoders": None}

    def sizes(self, text: str) -> np.ndarray:
        """Bytes that the whole text takes with each language's dictionary."""
        if self._encoders is None:
            how = zstandard.ZstdCompressionParameters.from_level(6, window_log=18, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._encoders = []
            for sample in self.samples.values():
                dictionary = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(compression_params=how)
                self._encoders.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how).compress)
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return np.array([sum(len(encode(b)) for b in blocks) for encode in self._encoders], float)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score in 0 to 1 and margin. Equal sizes go to the language with more training
        documents."""
        if not text or not self.samples or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        # a byte saved counts as evidence of half a bit
        score = 1 / np.exp(-math.log(2) / 2 * (sizes - sizes[best])).sum()
        rest = np.delete(sizes, best)
        margin = 1.0 if len(rest) == 0 else float((rest.min() - sizes[best]) / rest.min())
        return list(self.samples)[best], float(score), margin


def fit(documents: DataFrame) -> CompressionModel:
    """Learn from the rows whose fold is not 0 with a text and a language; no such rows give a model that says
    ``und``. Only the ``LANGUAGES`` most frequent values of ``lang`` get a dictionary."""
    ship(documents.sparkSession)
    rows = documents.select("doc_id", "text", "lang").where("text is not null and lang is not null and length(text) > 0").where(fold() != 0)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return CompressionModel({})
    # a piece of every text that is likely to be taken: a threshold that leaves a few times as many texts, then a rank
    of_text = F.xxhash64("lang", "text")
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 4 * DOCS / n)))])
    some = rows.withColumn("at", of_text / 2.0**64 + 0.5).where(F.col("at") <= share[F.col("lang")])
    start = F.pmod(F.xxhash64("text", F.lit("place")), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1).cast("int") + 1
    pieces = some.select("lang", "at", F.lower(F.substring("text", start, F.lit(PIECE))).alias("piece")).dropDuplicates(["lang", "at"])
    by_hash = Window.partitionBy("lang").orderBy("at")
    sample = pieces.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= DOCS).select("lang", "rank", "piece").collect()  # LANGUAGES times DOCS rows
    samples: dict[str, bytes] = {}
    for r in sorted(sample):
        samples[r["lang"]] = samples.get(r["lang"], b"") + b"\n" + r["piece"].encode()
    return CompressionModel({k: samples[k] for k in sorted(samples, key=lambda k: (-counts[k], k)) if len(samples[k]) >= 8})


def predict_column(model: CompressionModel, documents: DataFrame, text: str = "text") -> Column:
    """A struct of ``lang_pred``, ``score`` and ``margin`` for each whole text."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, margin double")
    def predicted(texts: pa.Array) -> pa.Array:
        remember_only("languages")
        lang, score, margin = zip(*map(shipped.value.predict, texts.to_pylist()), strict=True) if len(texts) else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], ["lang_pred", "score", "margin"])

    return predicted(text)


def predict(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: ``lang_pred``, ``score``, ``margin`` and ``accepted``.

    A null text, an empty one and one without letters are ``und`` with score 0 and not accepted. Texts of any length are
    encoded whole; repeated rows give repeated results; other columns aren't read; no rows give none."""
    found = documents.select("doc_id", (fold() == 0).alias("held_out"), predict_column(fit(documents), documents).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.margin", ((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.margin") >= MARGIN)).alias("accepted"))


def keep_identified(documents: DataFrame) -> DataFrame:
    """``documents``, all columns, without the rows whose language is unknown or not accepted.

    Null and empty texts go, repeated rows stay or go together, no rows give none."""
    name = unused(documents, "language_found")
    found = documents.withColumn(name, predict_column(fit(documents), documents))
    return found.where((F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["margin"] >= MARGIN)).drop(name)
