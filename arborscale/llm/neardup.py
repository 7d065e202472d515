"""Near-duplicate documents by BagMinHash.

A document is the bag of its five-word shingles. For every shingle, Poisson processes over its discretised weight give
points in time, each for one component of the signature; a component keeps the earliest. Weights are covered by
intervals [0, 1), [1, 2), [2, 4), ... with a process each, whose points carry a position, and points beyond the weight
don't count: so two bags share a component's earliest point with a probability equal to their weighted Jaccard
similarity. A process stops as soon as it passes the latest component, which makes a signature cost about as much as
reading the bag.

Signatures are banded, and classes grow in three steps. In each, what verification (the exact overlap of the bags)
confirms is joined, and only pairs of different classes go on.

1. Every text of a bucket is paired with the bucket's least text, so a bucket of copies costs a line, not a square.
2. In buckets that still hold several classes, each text is paired with the text of another class that agrees with it
   most.
3. What two bags can have in common is at most what one of them has in common with all texts of other classes together.
   Spark counts that for each text that has a resembling text of another class, and only pairs for which it allows a
   similarity of 0.8 are verified: first, for each text, the likeliest one, then all that are left. Near copies that each differ on their own from a common original, or texts around a
   common passage, drop out here without a pair.

Comparing happens inside tasks, a block of a bucket against a block, and gives out no pair that steps 2 and 3 exclude. A
bucket has no cap. A candidate is verified unless its signatures agree in fewer components than ``least_agreeing`` says;
the last step compares signatures of ``FINE`` components.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from arborscale.llm._shared import discard, remember_only, ship, unused, written
from arborscale.llm.graph import components

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold agrees in no band with a probability of (1 - 0.8 ** ROWS) ** BANDS, or 0.00007.
BANDS, ROWS = 24, 5
COMPONENTS = BANDS * ROWS
#: Members of a bucket that are compared at once; a larger bucket is compared block against block.
BLOCK = 2048
#: Components of the finer signature of texts that are compared with all that is left.
FINE = 480


def least_agreeing(components: int) -> int:
    """Agreeing components below which a pair isn't verified: 4.5 standard errors under the threshold, which a pair at
    the threshold misses with a probability of 0.000003."""
    return int(components * (THRESHOLD - 4.5 * (THRESHOLD * (1 - THRESHOLD) / components) ** 0.5))


WORD = re.compile(r"\w+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> Counter:
    """The bag of runs of five words; a text of fewer words is one shingle, one without words has none."""
    words = WORD.findall((text or "").lower())
    if not words:
        return Counter()
    return Counter(map(" ".join, zip(*(words[i:] for i in range(min(SHINGLE, len(words)))), strict=False)))


def similarity(one: Counter, other: Counter) -> float:
    """Weighted Jaccard of two bags; 1 for two empty ones."""
    both = sum((one & other).values())
    total = one.total() + other.total() - both
    return both / total if total else 1.0


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit number for each (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _Hashes()


def hashed_bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bags of ``shingles`` of texts with each shingle as a 64-bit hash: text number, hash and count."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    length = np.fromiter(map(len, words), np.int64, len(words))
    each = np.fromiter((_HASHES[w] for ws in words for w in ws), np.uint64, int(length.sum()))
    doc = np.repeat(np.arange(len(texts)), length)
    start = np.concatenate([[0], np.cumsum(length)])
    left = start[doc + 1] - np.arange(len(doc))  # words from here to the end of the text
    run = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(SHINGLE, len(doc))):
            inside = left[: len(doc) - i] > i  # false only where a short text ends
            run[: len(doc) - i] += np.where(inside, each[i:] * (GOLDEN ** np.uint64(i)), np.uint64(0))
        run = _mixed(run)
    whole = (left >= SHINGLE) | (np.arange(len(doc)) == start[doc])
    doc, run = doc[whole], run[whole]
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        run[edges[i] : edges[i + 1]].sort()
    new = np.ones(len(doc), bool)
    new[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], run[first], np.diff(np.append(first, len(doc)))


def bag_minhash(n: int, doc: np.ndarray, seed: np.ndarray, weight: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """One row of ``m`` 32-bit components for each of ``n`` bags, given as bag number, hash and count; empty bags get
    zeros."""
    low = np.zeros(len(doc), np.int64)
    parts = [(doc, seed, weight, low, np.ones(len(doc), np.int64))]
    level = 1
    best = np.full(n * m, np.inf)
    point = np.zeros(n * m, np.uint64)
    latest = np.full(n, np.inf)
    with np.errstate(over="ignore"):
        while (over := weight > level).any():
            far = np.full(over.sum(), level)
            parts.append((doc[over], _mixed(seed[over] + np.uint64(level) * GOLDEN), weight[over], far, far))
            level *= 2
        doc, seed, weight, low, span = (np.concatenate(c) for c in zip(*parts, strict=True))
        time, draws = np.zeros(len(doc)), seed
        plain = level == 1  # all weights are 1, so every point counts
        while len(doc):
            draws = draws + GOLDEN
            draw = _mixed(draws)
            gap = -np.log(((draw >> np.uint64(24)) + np.uint64(1)) * 2.0**-40)
            time = time + (gap / m if plain else gap / (m * span))
            place = doc * m + ((draw & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
            if plain:
                at, when, what = place, time, draw
            else:
                valid = low + ((_mixed(draw) >> np.uint64(11)) * 2.0**-53 * span).astype(np.int64) < weight
                at, when, what = place[valid], time[valid], draw[valid]
            np.minimum.at(best, at, when)
            first = np.flatnonzero(best[at] == when)
            point[at[first]] = _mixed(what[first] ^ GOLDEN)
            open_ = np.flatnonzero(np.bincount(doc, minlength=n))
            latest[open_] = best.reshape(-1, m)[open_].max(axis=1)
            alive = np.flatnonzero(time < latest[doc])
            doc, draws, time = doc[alive], draws[alive], time[alive]
            if not plain:
                weight, low, span = weight[alive], low[alive], span[alive]
    return (point >> np.uint64(32)).astype(np.uint32).reshape(-1, m)


def _runs(batch: pa.RecordBatch, columns: Sequence[str] = ("text",), limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices with a bounded number of bytes of text together (or one row); no text is read to find them."""
    sizes = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sketch`` (the low byte of each component) and ``bands`` of each row's text; no bands without words."""
    remember_only("shingles", _HASHES.clear)
    for batch in batches:
        for part in _runs(batch):
            doc, seed, weight = hashed_bags(part.column("text").to_pylist())
            signed = bag_minhash(part.num_rows, doc, seed, weight)
            some = np.bincount(doc, minlength=part.num_rows) > 0
            key = np.zeros((part.num_rows, BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(ROWS):
                    key = _mixed(key + GOLDEN + signed.reshape(-1, BANDS, ROWS)[:, :, i])
            bands = [k if has else None for k, has in zip(key.view(np.int64).tolist(), some, strict=True)]
            sketch = pa.array([r.tobytes() for r in signed.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), sketch, pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_key", "sketch", "bands"])


def _unit_pairs(rows: list[dict], how: str) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of different classes that agree enough, of a block or between two blocks of a bucket: for each text the
    one that agrees most (``nearest``); or of those whose common shingles allow the threshold, the one that agrees most
    and has the least of its own (``likely``), or all that no star had (``all``)."""
    keys, sketch = [r["text_key"] for r in rows], np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1)
    components_, least = sketch.shape[1], least_agreeing(sketch.shape[1])
    numbers = {v: i for i, v in enumerate(dict.fromkeys(r["label"] for r in rows))}
    of = np.array([numbers[r["label"]] for r in rows])
    if len(numbers) == 1:
        return
    side = np.array([r["block"] != r["u"] for r in rows])
    left, right = np.flatnonzero(~side), np.flatnonzero(side) if side.any() else np.arange(len(rows))
    n, common = (np.array([r[c] for r in rows], float) for c in ("n", "common")) if how != "nearest" else (None, None)

    def partners(i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        others = others[of[others] != of[i]]
        if how != "nearest":
            others = others[(1 + THRESHOLD) * np.minimum(common[others], common[i]) >= THRESHOLD * (n[others] + n[i]) - 1e-6]
        agreeing = (sketch[others] == sketch[i]).sum(axis=1)
        near = agreeing >= least
        return others[near], agreeing[near]

    if how == "all":
        for i in left:
            for j in partners(i, right if side.any() else right[right > i])[0]:
                if rows[0]["head"] not in (keys[i], keys[j]):
                    yield keys[i], keys[j]
        return
    for one, other in ((left, right), (right, left)) if side.any() else ((left, left),):
        for i in one:
            others, agreeing = partners(i, other)
            if len(others):
                yield keys[i], keys[others[(agreeing / components_ + (common[others] / n[others] if how == "likely" else 0)).argmax()]]


def _across(batches: Iterator[pa.RecordBatch], how: str) -> Iterator[pa.RecordBatch]:
    """Pairs of the units of comparison, which come one after the other."""
    remember_only("shingles", _HASHES.clear)
    unit: list[dict] = []

    def pairs() -> Iterator[tuple[bytes, bytes]]:
        nonlocal unit
        for row in (row for batch in batches for i in range(0, batch.num_rows, 1000) for row in batch.slice(i, 1000).to_pylist()):
            if unit and any(row[c] != unit[0][c] for c in UNIT):
                yield from _unit_pairs(unit, how)
                unit = []
            unit.append(row)
        if unit:
            yield from _unit_pairs(unit, how)

    found = pairs()
    while some := list(islice(found, PAIRS)):  # a unit may have millions
        yield _pair_batch(some)


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remember_only("shingles", _HASHES.clear)
    for batch in batches:
        for part in _runs(batch, limit=500_000):
            signed = bag_minhash(part.num_rows, *hashed_bags(part.column("text").to_pylist()), FINE).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column("text_key"), pa.array([r.tobytes() for r in signed], pa.binary())], ["text_key", "sketch"])


def _pair_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])


#: Pairs that leave a task together.
PAIRS = 20_000


@F.arrow_udf(BooleanType())
def _resemble(one: pa.Array, other: pa.Array) -> pa.Array:
    """Whether two sketches agree in enough components to be worth verifying."""
    if not len(one):
        return pa.array([], pa.bool_())
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, COMPONENTS) for x in (one, other))
    return pa.array((a == b).sum(axis=1) >= least_agreeing(COMPONENTS))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, text of a, text of b) whose bags overlap enough. Pairs of one text come together, so its bag is
    kept while they last."""
    remember_only("shingles", _HASHES.clear)
    last, bag = None, Counter()
    for batch in (part for whole in batches for part in _runs(whole, ("ta", "tb"))):
        a, b = [], []
        for one, other, text, text_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if one != last:
                last, bag = one, shingles(text)
            if similarity(bag, shingles(text_)) >= THRESHOLD:
                a.append(one)
                b.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _links(pairs: DataFrame, signed: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The verified ones of the candidate pairs."""
    one = signed.select(F.col("text_key").alias("a"), F.col("sketch").alias("sa"))
    other = signed.select(F.col("text_key").alias("b"), F.col("sketch").alias("sb"))
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    likely = written(ordered.join(one, "a").join(other, "b").where(_resemble("sa", "sb")).select("a", "b"), f"{name}-candidates")
    left = texts.select(F.col("text_key").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("text_key").alias("b"), F.col("text").alias("tb"))
    both = likely.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    links = written(both.mapInArrow(_verify, "a binary, b binary"), f"{name}-links")
    discard(likely)
    return links


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes, with their ``label``."""
    named = members.join(components(links).withColumnRenamed("node", "text_key"), "text_key", "left").withColumn("label", F.coalesce("label", "text_key"))
    mixed = named.groupBy("band", "bucket").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("band", "bucket")
    return named.join(mixed, ["band", "bucket"], "left_semi")


UNIT = ("band", "bucket", "u", "v")


def _compared(members: DataFrame, signed: DataFrame, how: str) -> DataFrame:
    """Pairs across the classes of each bucket, found in tasks that hold two blocks of it at most."""
    key = ["band", "bucket"]
    blocks = members.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = members.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("text_key"), F.col("blocks")))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = other.withColumns({"u": F.least("block", "other"), "v": F.greatest("block", "other")}).join(signed.select("text_key", "sketch"), "text_key")
    of_text = ["text_key", "head", "label", "block", "sketch", *(["n", "common"] if how != "nearest" else [])]
    dealt = units.select(*UNIT, *of_text).repartition(*UNIT).sortWithinPartitions(*UNIT, "text_key")
    return dealt.mapInArrow(lambda batches: _across(batches, how), "a binary, b binary")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remember_only("shingles", _HASHES.clear)
    for batch in batches:
        for part in _runs(batch):
            doc, run, weight = hashed_bags(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("who").take(pa.array(doc)), part.column("label").take(pa.array(doc)), pa.array(run.view(np.int64)), pa.array(weight.astype(np.int32))], ["who", "label", "shingle", "weight"])


def _bounds(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``text_key``, its shingles ``n`` and those in ``common`` with texts of other classes, for the texts that can
    reach the threshold with one of these at all."""
    who = members.select("text_key", F.xxhash64("label").alias("label")).distinct()
    bags = written(texts.join(who, "text_key").select(F.xxhash64("text_key").alias("who"), "label", "text").mapInArrow(_bags, "who long, label long, shingle long, weight int"), "bags")
    shared = bags.groupBy("shingle").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("shingle", F.lit(True).alias("shared"))
    sums = bags.join(shared, "shingle", "left").groupBy("who").agg(F.sum("weight").alias("n"), F.sum(F.when(F.col("shared"), F.col("weight")).otherwise(0)).alias("common"))
    found = written(sums.where(F.col("common") >= THRESHOLD * F.col("n") - 1e-6), "bounds")
    discard(bags)
    return who.select("text_key", F.xxhash64("text_key").alias("who")).join(found, "who").drop("who")


def _key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _classed(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a text as ``doc_id``, ``text_key`` and ``label`` of the class; and for each label the least ``head``
    (``doc_id``, ``text_key``) and the ``class_size``."""
    ship(documents.sparkSession)
    texts = documents.select("doc_id", _key().alias("text_key"), "text").where("text is not null")
    # wide rows are signed where they lie; only keys, sketches and bands go on
    rows = written(texts.mapInArrow(_sign, "doc_id long, text_key binary, sketch binary, bands array<long>"), "sketches")
    signed = written(rows.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "signed-texts")
    key = ["band", "bucket"]
    buckets = signed.where("bands is not null").select("text_key", F.posexplode("bands").alias(*key))
    heads = buckets.groupBy(*key).agg(F.min("text_key").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(buckets.join(heads, key), "buckets")
    in_bucket = signed.select("doc_id", "text_key").join(members.select("text_key").distinct(), "text_key", "left_semi")
    one_row = in_bucket.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
    some = written(texts.join(one_row, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left_semi").select("text_key", "text").dropDuplicates(["text_key"]), "bucket-texts")
    stars = _links(members.where("text_key <> head").select(F.col("head").alias("a"), F.col("text_key").alias("b")), signed, some, "stars")
    mixed = written(_labelled(members, stars), "mixed")
    nearest = written(_compared(mixed, signed, "nearest").distinct(), "nearest")
    links = stars.union(_links(nearest, signed, some, "nearest"))
    # only texts with a resembling text of another class can have links that are still missing
    left = mixed.drop("label").join(nearest.select(F.col("a").alias("text_key")).distinct(), "text_key", "left_semi")
    rest = written(_labelled(left, links), "rest")
    bounds = _bounds(rest, some)
    bounded = written(rest.join(bounds, "text_key"), "bounded")
    likely = _links(_compared(bounded, signed, "likely"), signed, some, "likely")
    last = written(_labelled(bounded.drop("label"), links := links.union(likely)), "last")
    fine = written(some.join(last.select("text_key").distinct(), "text_key", "left_semi").mapInArrow(_finer, "text_key binary, sketch binary"), "fine")
    links = written(links.union(_links(_compared(last, fine, "all"), signed, some, "last")), "links")
    label = components(links).withColumnRenamed("node", "text_key")
    classed = written(rows.select("doc_id", "text_key").join(label, "text_key", "left").select("doc_id", "text_key", F.coalesce("label", "text_key").alias("label")), "classed")
    discard(rows, signed, members, some, mixed, nearest, rest, bounded, last, fine, links)
    heads = classed.groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("head"), F.count("*").alias("class_size"))
    return classed, heads


def classes(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, ``class_id`` (the least id of its class) and ``class_size`` in
    rows. The links behind the classes join each text to one that stands for its class; copies aren't expanded.

    Equal texts are one class. Texts are linked from a weighted Jaccard similarity of 0.8 of their five-word shingles
    up, and classes are the connected components of the links. A null text is a class of its own; empty texts are
    equal texts, and texts without words are in one class only when they are equal. Rows with a null id take part; a
    class that holds one has a null ``class_id``. Repeated rows are members of one class each; no rows give none. Texts
    of any length count whole, and other columns aren't read."""
    classed, heads = _classed(documents)
    alone = documents.where("text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return classed.join(heads, "label").select("doc_id", F.col("head.doc_id").alias("class_id"), "class_size").union(alone)


def keep_one(documents: DataFrame) -> DataFrame:
    """``documents``, all columns, with one row of each class: the one with the least id, and of repeated rows one.

    Rows with a null text are kept; of empty texts one is; no rows give none."""
    id_, key, text_key = unused(documents, "kept_id"), unused(documents, "kept_key"), unused(documents, "row_key")
    heads = _classed(documents)[1].select(F.col("head.doc_id").alias(id_), F.col("head.text_key").alias(key))
    keyed = documents.where("text is not null").withColumn(text_key, _key())
    kept = keyed.join(heads, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(text_key) == F.col(key)), "left_semi").dropDuplicates(["doc_id", text_key]).drop(text_key)
    return kept.union(documents.where("text is null"))
