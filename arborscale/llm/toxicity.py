"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary text, give every word of a text a probability; the difference of
their length-normalised log-likelihoods decides. Counts are continuation counts at both levels (in how many different
contexts an n-gram stands), so a passage that many copies repeat counts once, and discounts are estimated from the counts
of counts. The levels, each of which sums to 1:

* unigrams of the counts that both classes share, backing off to equal shares;
* unigrams of a class, backing off to the shared ones;
* bigrams of the shared counts, backing off to shared unigrams, and scaled for each class by what its unigrams say of the
  word (the marginal adaptation of Kneser, Peters and Klakow, 1997);
* bigrams of a class, backing off to those.

A rare expression says little about its class, and thousands of such differences would drown the few that matter. So an
expression keeps its class counts as far as they are likely to differ: ``differing`` gives the posterior probability that
its share of toxic contexts is its own and not that of the whole corpus, with the prior and the ordinary variation of
shares estimated from all expressions. The rest of its counts goes to the shared backoff. No expression is left out:
every n-gram of the sample is in the model.

A logistic curve, fitted on rows that the counts did not use, turns the difference per word into a probability. The
classifier is fitted on a sample of labelled rows, chosen by a hash of the id: up to about ``max_docs`` of each class for
the counts, and as many for the curve, where each row weighs as many labelled rows as it stands for, so that the prior is
that of all labelled rows. Scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.llm._shared import discard, fold, remember_only, ship, unused, written

WORD = re.compile(r"\w+")
#: Words that a worker remembers before it starts anew, and words of text that it works on at once.
MEMO_WORDS, BUFFER = 60_000, 150_000
#: Parts in which the driver fetches the n-grams of the sample, and n-grams that it works on at once.
PARTS, AT_ONCE = 16, 100_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def hashes_of(words: list[str]) -> np.ndarray:
    """A 64-bit number for each word, never 0, which stands for what is before the first word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 for w in words), np.uint64, len(words))


def _first_of(x: np.ndarray) -> np.ndarray:
    """1 where a value stands for the first time, else 0."""
    out = np.zeros(len(x), np.int32)
    out[np.unique(x, return_index=True)[1]] = 1
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, the two words before as one number, the word before, word) for every word, and whether its text has the
    bigram, and the word, for the first time there."""
    remember_only("toxicity")
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
            word = hashes_of(words_of(text))
            before = np.concatenate([[np.uint64(0)], word[:-1]])[: len(word)]
            with np.errstate(over="ignore"):
                first = np.concatenate([[np.uint64(0)], before[:-1]])[: len(word)] * GOLDEN + before
                new = _first_of(before * GOLDEN + word), _first_of(word)
            columns = [pa.array(np.full(len(word), label, np.int32)), *(pa.array(c.view(np.int64)) for c in (first, before, word)), *map(pa.array, new)]
            yield pa.RecordBatch.from_arrays(columns, ["label", "first", "before", "word", "new_pair", "new_word"])


def discount(n: np.ndarray) -> float:
    """Of Kneser and Ney: from how many n-grams have a count of one and how many of two."""
    one, two = (n == 1).sum(), (n == 2).sum()
    return float(one / (one + 2 * two)) if one else 0.5


def _log_beta_binomial(k: np.ndarray, n: np.ndarray, a: float, b: float) -> np.ndarray:
    """Log probability of a sequence of ``k`` toxic and ``n - k`` ordinary contexts when the share has a beta prior."""
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    return log_gamma(k + a) + log_gamma(n - k + b) - log_gamma(n + a + b) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)


def differing(n: np.ndarray) -> np.ndarray:
    """The posterior probability, for each column of counts by class, that its share of toxic contexts is its own.

    An expression that doesn't differ has a share that varies about the common one like a beta variable of some
    strength; one that differs has any share. The strength and the part of expressions that differ are those of the
    greatest likelihood."""
    share = n[1].sum() / max(n.sum(), 1)
    if not 0 < share < 1:
        return np.zeros(n.shape[1])
    base = int(n.max()) + 1
    code = n[1].astype(np.int64)
    code *= base
    code += n[0].astype(np.int64)
    kinds, times = np.unique(code, return_counts=True)
    toxic = (kinds // base).astype(float)
    total = toxic + kinds % base
    own = _log_beta_binomial(toxic, total, share, 1 - share)
    best = (-np.inf, np.zeros(len(total)))
    for strength in (30, 100, 300, 1000, 3000, 10_000, 1_000_000):
        common = _log_beta_binomial(toxic, total, share * strength, (1 - share) * strength)
        part = 0.01
        for _ in range(60):
            odds = np.exp(np.clip(own - common + math.log(part / (1 - part)), -500, 500))
            posterior = odds / (1 + odds)
            part = float(np.clip((posterior * times).sum() / times.sum(), 1e-9, 0.5))
        likelihood = (times * np.logaddexp(math.log(part) + own, math.log1p(-part) + common)).sum()
        best = max(best, (likelihood, posterior), key=lambda x: x[0])
    return best[1][np.searchsorted(kinds, code)]


class KneserNeyPair:
    """Both models over the same n-grams: ``log_p`` of a known word, of an unknown one, and of a known bigram, by class."""

    def __init__(self, words: dict[str, np.ndarray], parts: Iterable[dict[str, np.ndarray]]):
        """``words`` has ``word`` (a hash) and by class the different words before it (``m0``, ``m1``) and the texts that hold
        it (``t0``, ``t1``); ``parts``, which are taken one at a time, have ``before`` (0 is the start of a text), ``word``, by class
        the different words before both (``n0``, ``n1``) and the texts that hold it (``t0``, ``t1``). What an expression says of its
        class counts no text and no context twice."""
        self.words = np.unique(np.append(words["word"].view(np.uint64), np.uint64(0)))
        size, at = len(self.words), np.searchsorted(self.words, words["word"].view(np.uint64))
        # bigrams by the places of their words, in that order: a half or less of what their hashes take
        kept: dict[str, list[np.ndarray]] = {c: [] for c in ("key", "n0", "n1", "least0", "least1")}
        for part in parts:
            b, w = (np.searchsorted(self.words, part[c].view(np.uint64)) for c in ("before", "word"))
            kept["key"].append(b * (size + 1) + w)
            for c in (0, 1):
                kept[f"n{c}"].append(part[f"n{c}"].astype(np.int32))
                kept[f"least{c}"].append(np.minimum(part[f"n{c}"], part[f"t{c}"]).astype(np.int32))
        pairs = {c: np.concatenate([*kept.pop(c), np.zeros(0, np.int64 if c == "key" else np.int32)]) for c in list(kept)}
        order = np.argsort(pairs["key"])
        pairs = {c: pairs.pop(c)[order] for c in list(pairs)}
        del order
        self.pairs, count = pairs["key"], len(pairs["key"])
        runs = [slice(i, i + AT_ONCE) for i in range(0, count, AT_ONCE)]
        ends, of_texts = np.zeros((2, size)), np.zeros((2, size))
        for c in (0, 1):
            ends[c][at], of_texts[c][at] = words[f"m{c}"], words[f"t{c}"]
        both = ends.sum(0)
        seen, less = max(both.sum(), 1), discount(both)
        # an unknown word and the start have what equal shares of the discounts give
        shared = np.append(np.maximum(both - less, 0), 0) / seen + (less * (both > 0).sum() / seen if both.any() else 1) / (size + 1)
        keep, keep_pair = np.zeros(size + 1), differing(np.stack([pairs.pop(f"least{c}") for c in (0, 1)]))
        keep[:-1][both > 0] = differing(np.minimum(ends, of_texts)[:, both > 0])

        def summed(values: Callable[[slice], np.ndarray]) -> np.ndarray:
            """Sums over the bigrams of each word before."""
            out = np.zeros(size + 1)
            for r in runs:
                first, last = self.pairs[r][[0, -1]] // (size + 1)
                out[first : last + 1] += np.bincount(self.pairs[r] // (size + 1) - first, weights=values(r))
            return out

        together = pairs["n0"] + pairs["n1"]
        less, after = discount(together), summed(lambda r: together[r])

        def common(r: slice) -> np.ndarray:
            return np.maximum(together[r] - less, 0) / after[self.pairs[r] // (size + 1)]

        rest = 1 - summed(common)
        unigram, self.back, self.pair_log_p = np.zeros((2, size + 1)), np.zeros((2, size + 1)), np.zeros((2, count), np.float32)
        for c in (0, 1):
            own = np.append(keep[:-1] * np.maximum(ends[c] - discount(ends[c]), 0) / max(ends[c].sum(), 1), 0)
            unigram[c] = own + (1 - own.sum()) * shared
            scale, n = unigram[c] / shared, pairs[f"n{c}"]
            of_class, after_class = discount(n), np.maximum(summed(lambda r, n=n: n[r]), 1)

            def high(r: slice, n=n, of_class=of_class, after_class=after_class) -> np.ndarray:
                return keep_pair[r] * np.maximum(n[r] - of_class, 0) / after_class[self.pairs[r] // (size + 1)]

            norm = summed(lambda r, scale=scale: common(r) * scale[self.pairs[r] % (size + 1)]) + rest
            left = (1 - summed(high)) / norm
            for r in runs:
                b, w = np.divmod(self.pairs[r], size + 1)
                self.pair_log_p[c, r] = np.log(high(r) + left[b] * (common(r) + rest[b] * shared[w]) * scale[w])
            self.back[c] = np.log(left * rest)
        self.word_log_p = np.log(unigram)
        self._memo: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memo": {}}

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The place of each word among the known ones, or the number of these."""
        if len(self._memo) > MEMO_WORDS:
            self._memo = {}
        if new := list(set(words).difference(self._memo)):
            h = hashes_of(new)
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            self._memo.update(zip(new, np.where(self.words[at] == h, at, len(self.words)).tolist(), strict=True))
        return np.fromiter(map(self._memo.__getitem__, words), np.int64, len(words))

    def log_likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The natural log-likelihood of each whole text by class, and its number of words."""
        split = [words_of(t) for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        w = self._numbers([x for words in split for x in words])
        start = (np.cumsum(lengths) - lengths)[lengths > 0]
        b = np.concatenate([w[:1], w[:-1]])
        b[start] = 0
        key = b * (len(self.words) + 1) + w
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        out = np.zeros((2, len(texts)))
        for c in (0, 1):
            each = self.back[c][b] + self.word_log_p[c][w]
            each[known] = self.pair_log_p[c][at[known]]
            out[c][lengths > 0] = np.add.reduceat(each, start) if len(start) else 0
        return out, lengths

    def ratios(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Toxic minus ordinary log-likelihood per word of each whole text (0 where it has none), and its words."""
        means, lengths, at = np.zeros(len(texts)), np.zeros(len(texts), np.int64), 0
        sizes = np.cumsum([len(t or "") for t in texts])
        while at < len(texts):  # a bounded amount of text at once, or one text
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 6 * BUFFER, side="right")))
            found, lengths[at:upto] = self.log_likelihoods(texts[at:upto])
            means[at:upto] = (found[1] - found[0]) / np.maximum(lengths[at:upto], 1)
            at = upto
        return means, lengths


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge; the slope never turns negative."""
    if len(x) == 0 or y.min() == y.max():
        toxic = (weight * y).sum()
        return 1.0, 0.0 if len(x) == 0 else float(np.log((toxic + 0.5) / (weight.sum() - toxic + 0.5)))
    scale = max(float(x.std()), 1e-9)
    design, theta = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-3 * theta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        theta = np.clip(theta + np.clip(np.linalg.solve(hessian, gradient), -2, 2), -40, 40)
    return max(float(theta[0]) / scale, 1e-6), float(theta[1])


class ToxicityModel:
    """A fitted pair of models with its calibration; small enough to travel with the tasks, once for both uses of the pair."""

    def __init__(self, pair: KneserNeyPair, shipped: Broadcast, slope: float, intercept: float):
        self.pair, self.shipped, self.slope, self.intercept = pair, shipped, slope, intercept

    def __getstate__(self) -> dict:
        return self.__dict__ | {"shipped": None}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return scores(self.pair, self.slope, self.intercept, texts)


def scores(pair: KneserNeyPair, slope: float, intercept: float, texts: list[str | None]) -> np.ndarray:
    means, _ = pair.ratios(texts)
    return 1 / (1 + np.exp(-np.clip(slope * means + intercept, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, max_docs: int = 3000) -> ToxicityModel:
    """Fit on labelled rows whose fold is not 0: counts on folds 2 to 4, the curve on fold 1.

    ``labels`` has ``doc_id`` and ``toxic``; rows with a null in either are passed over and a repeated id is toxic if
    any of its rows is. With no labelled rows at all every text gets the score 0.5."""
    spark = ship(documents.sparkSession)
    labelled = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .where(fold() != 0)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("fitting", fold() != 1)
    )
    # four rows
    size = {(r["fitting"], r["label"]): r["n"] for r in labelled.groupBy("fitting", "label").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for (fitting, label), n in size.items():
        rate = F.when((F.col("fitting") == fitting) & (F.col("label") == label), min(1.0, max_docs / n)).otherwise(rate)
    # some four times max_docs rows at most, whatever the input
    sample = F.broadcast(labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < rate * float(1 << 40)))
    texts = written(documents.select("doc_id", "text").join(sample, "doc_id"), "toxic-sample")
    # equal texts of a class count once
    different = texts.where("fitting").select("label", "text").dropDuplicates()
    contexts = different.mapInArrow(_contexts, "label int, first long, before long, word long, new_pair int, new_word int")
    once = contexts.groupBy("label", "first", "before", "word").agg(F.sum("new_pair").alias("t"), F.sum("new_word").alias("u"))
    def by_class(name: str, column: str | None = None) -> list:
        """Rows of each class, or the sum of a column over them."""
        return [F.sum(F.when(F.col("label") == c, F.col(column) if column else 1).otherwise(0)).cast("int").alias(f"{name}{c}") for c in (0, 1)]

    bigrams = once.groupBy("before", "word").agg(*by_class("n"), *by_class("t", "t"), *by_class("u", "u"))
    counts = written(bigrams.withColumn("part", F.pmod(F.xxhash64("before", "word"), F.lit(PARTS)).cast("int")).sortWithinPartitions("part"), "toxic-bigrams")
    words = counts.groupBy("word").agg(*(F.count_if(F.col(f"n{c}") > 0).cast("int").alias(f"m{c}") for c in (0, 1)), *(F.sum(f"u{c}").cast("int").alias(f"t{c}") for c in (0, 1)))

    def columns(df: DataFrame) -> dict[str, np.ndarray]:
        return {c: x.to_numpy() for c, x in zip(df.columns, df.toArrow().columns, strict=True)}

    # as many rows as the sample has n-grams, a part at a time
    pair = KneserNeyPair(columns(words), (columns(counts.where(F.col("part") == i).drop("u0", "u1", "part")) for i in range(PARTS)))
    discard(counts)
    shipped = spark.sparkContext.broadcast(pair)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, lengths = shipped.value.ratios(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(means), pa.array(lengths)], ["label", "mean", "words"])

    held = texts.where("not fitting").select("label", "text").mapInArrow(compared, "label int, mean double, words long").where("words > 0").toPandas().sort_values(["mean", "label"])
    discard(texts)
    taken = held["label"].value_counts().to_dict()
    weight = held["label"].map({label: size[False, label] / n for label, n in taken.items()})
    return ToxicityModel(pair, shipped, *_logistic(held["mean"].to_numpy(float), held["label"].to_numpy(float), weight.to_numpy(float)))


def score_column(model: ToxicityModel):
    """A UDF of the text column that gives the score of each whole text."""
    shipped, slope, intercept = model.shipped, model.slope, model.intercept

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        remember_only("toxicity")
        return pa.array(scores(shipped.value, slope, intercept, text.to_pylist()))

    return scored


def score(documents: DataFrame, labels: DataFrame, max_docs: int = 3000) -> DataFrame:
    """One row per row of ``documents`` with ``score`` in 0 to 1 and ``predicted`` (1 from 0.5 up).

    Null and empty texts, and texts without words, get the score of a difference of 0. A repeated row gives a repeated
    result; texts of any length count whole; other columns of ``documents`` are not read; no rows give none."""
    model = fit(documents, labels, max_docs)
    return documents.select("doc_id", (fold() == 0).alias("held_out"), score_column(model)("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, max_docs: int = 3000) -> DataFrame:
    """``documents``, all columns, without the rows that score ``threshold`` or more.

    Null, empty and repeated texts score as in ``score`` and go or stay accordingly; no rows give none."""
    name = unused(documents, "toxicity_score")
    model = fit(documents, labels, max_docs)
    return documents.withColumn(name, score_column(model)("text")).where(F.col(name) < threshold).drop(name)
