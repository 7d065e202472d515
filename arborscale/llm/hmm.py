"""A hidden Markov language model.

States emit classes of words, and a class says which of its words it is: p(word | state) = p(class | state) p(word | class).
Every word of the language has a class, a hash of it, so the emissions of ``CLASSES`` classes are all that the states hold,
whatever the corpus; the words within a class follow the counts of the whole training corpus, which grow with it. No word
is cut off or pooled by rank.

Baum-Welch expectations are computed in the tasks and summed by Spark. Training takes every token of the training texts in
windows of ``WINDOW`` tokens that overlap: a window is read from ``OVERLAP`` tokens before to ``OVERLAP`` tokens behind it,
and what counts are the expectations inside, by when the chain has forgotten where reading began. The likelihood of a
text is exact: the scaled forward recursion runs over its whole token sequence.

Counts of the ``TOP`` most frequent words travel to the tasks; those of all others are looked up by a join with the whole
table of counts. That decides only where a count is read, not what a score is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.llm._shared import discard, fold, ship, written

STATES, ROUNDS = 8, 6
#: Classes of words; the id after the last one is the end of a text, so that an id takes two bytes.
CLASSES = 65_535
END = CLASSES
WINDOW, OVERLAP = 1024, 64
#: Words whose counts travel to the tasks.
TOP = 250_000
#: Occurrences of a class that are dealt to the states as all tokens are, so that a rare class isn't learned by heart, and
#: occurrences that every class has besides its own.
PRIOR, UNSEEN = 4.0, 0.5
#: Tokens that a task trains on at once, and that it scores at once (scoring keeps no token's state).
BUFFER, SCORE_BUFFER = 1_000_000, 4_000_000
#: Ids in a row of summed emissions.
BLOCK = 1024
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8: A-Z turn small, space and the characters 9 to 13 part words."""
    return (text or "").encode().translate(LOWER).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words_of(text))
            if len(counts) > 400_000:
                yield out()
                counts = Counter()
    yield out()


def class_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) % CLASSES


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        classes = pa.array([class_of(w) for w in batch.column("word").to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), classes], ["word", "n", "class"])


class Corpus:
    """What the training counts come to: totals, and by class its tokens and its different words."""

    def __init__(self, counts: DataFrame, texts: int):
        by_class = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()  # CLASSES rows at most
        at = by_class["class"].to_numpy(int)
        self.tokens, self.words = np.zeros(CLASSES), np.zeros(CLASSES)
        self.tokens[at], self.words[at] = by_class["n"], by_class["kinds"]
        self.texts = texts
        self.total, self.kinds = int(self.tokens.sum()) + texts, int(self.words.sum()) + (texts > 0)

    def base(self, n: np.ndarray) -> np.ndarray:
        """Base log10 probability of words by their count."""
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.kinds + 1)))

    def within(self, classes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probability of words within their class by their count."""
        return np.log10((n + 0.5) / (self.tokens[classes] + 0.5 * (self.words[classes] + 1)))

    @property
    def unigram(self) -> np.ndarray:
        c = np.append(self.tokens, self.texts) + 0.5
        return c / c.sum()


def most_frequent(counts: DataFrame, top: int = TOP) -> tuple[list[bytes], np.ndarray]:
    """At most ``top`` words with their counts, all words above some count; found from a histogram of counts."""
    bin_ = F.floor(F.log2("n") * 64)
    kept, cut = 0, None
    for r in counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("words")).orderBy(F.desc("bin")).collect():
        if (kept := kept + r["words"]) > top:
            break
        cut = r["bin"]
    most = counts.where(bin_ >= cut if cut is not None else F.lit(False)).select("word", "n").toPandas()
    return [bytes(w) for w in most["word"]], most["n"].to_numpy(np.int64)


ENCODED = "row_key long, doc_id long, held_out boolean, ids binary, base double, within double, known long, other array<binary>, other_n array<int>, other_class array<int>"


def encoded(documents: DataFrame, corpus: Corpus, words: list[bytes], n: np.ndarray) -> DataFrame:
    """Every text as ids of classes (with its end), the sums over words with known counts, and its other words."""
    shipped = documents.sparkSession.sparkContext.broadcast((words, n, corpus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, corpus = shipped.value
        number = TaskContext.get().partitionId() << 40
        classes = np.fromiter(map(class_of, words), np.int64, len(words))
        base, within = np.append(corpus.base(n), 0.0), np.append(corpus.within(classes, n), 0.0)
        place, classes = dict(zip(words, range(len(words)), strict=True)), classes.astype(np.uint16)
        missing = len(words)
        end = float(corpus.base(np.array([corpus.texts]))[0])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text in part.column("text").to_pylist():
                    split = words_of(text)
                    places = np.fromiter((place.get(w, missing) for w in split), np.int64, len(split))
                    ids = np.full(len(split) + 1, END, np.uint16)
                    here = places < missing
                    ids[:-1][here] = classes[places[here]]
                    others = np.flatnonzero(~here)
                    rare = Counter([split[i] for i in others])
                    of = {w: class_of(w) for w in rare}
                    ids[others] = [of[split[i]] for i in others]
                    known = int(here.sum()) + (corpus.texts > 0)
                    rows.append((ids.tobytes(), base[places].sum() + end, within[places].sum(), known, list(rare), list(rare.values()), list(of.values())))
                keys = pa.array(np.arange(number, number + len(rows)))
                number += len(rows)
                kinds = (pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([keys, part.column("doc_id"), part.column("held_out"), *columns], ["row_key", "doc_id", "held_out", "ids", "base", "within", "known", "other", "other_n", "other_class"])

    return documents.select("doc_id", (fold() == 1).alias("held_out"), "text").mapInArrow(run, ENCODED)


def windows(ids: np.ndarray, lengths: np.ndarray, window: int = WINDOW, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences cut into overlapping windows that lie one after the other: their ids and lengths, which tokens count, and
    which windows start a sequence. A sequence of up to ``window`` and ``overlap`` tokens stays whole."""
    if not len(lengths) or lengths.max() <= window + overlap:
        return ids, lengths, np.ones(len(ids), bool), np.ones(len(lengths), bool)
    cuts = np.maximum(1, -(-(lengths - overlap) // window))
    owner = np.repeat(np.arange(len(lengths)), cuts)
    which = np.arange(len(owner)) - (np.cumsum(cuts) - cuts)[owner]
    core, upto = which * window, np.where(which == cuts[owner] - 1, lengths[owner], (which + 1) * window)
    start, stop = np.maximum(core - overlap, 0), np.minimum(upto + overlap, lengths[owner])
    size = stop - start
    of = np.repeat(np.arange(len(owner)), size)
    at = start[of] + np.arange(size.sum()) - (np.cumsum(size) - size)[of]
    return ids[(np.cumsum(lengths) - lengths)[owner[of]] + at], size, (at >= core[of]) & (at < upto[of]), which == 0


class Model:
    """Start, transition and emission probabilities; a row of ``emit`` for each id."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def initial(unigram: np.ndarray, states: int = STATES) -> Model:
        noise = np.random.Generator(np.random.PCG64(7)).uniform(0.2, 1.8, (len(unigram), states))
        emit = unigram[:, None] * noise
        move = np.full((states, states), 0.05 / max(states - 1, 1)) + np.eye(states) * (0.95 - 0.05 / max(states - 1, 1))
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def by_time(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How sequences that lie one after the other are read step by step, the longest first: their order, how many
        still run at each step, and the place of each token, step after step."""
        order = np.argsort(-lengths, kind="stable")
        start = (np.cumsum(lengths) - lengths)[order]
        running = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        step = np.repeat(np.arange(len(running)), running)
        first = np.cumsum(running) - running
        return order, running, start[np.arange(len(step)) - first[step]] + step

    def log10_likelihood(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each of the sequences that lie one after the other in ``ids``, by the scaled forward recursion."""
        order, running, place = self.by_time(lengths)
        ids, ones = ids[place], np.ones(len(self.start))
        out = np.zeros(len(lengths))
        alpha, at = None, 0
        for n in running:
            now = self.emit[ids[at : at + n]]
            alpha = now * self.start if alpha is None else (alpha[:n] @ self.move) * now
            scale = alpha @ ones
            alpha /= scale[:, None]
            out[:n] += np.log10(scale)
            at += n
        found = np.empty(len(lengths))
        found[order] = out
        return found

    def expectations(self, ids: np.ndarray, lengths: np.ndarray, counted: np.ndarray | None = None, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions of sequences of bounded length, in single precision; only of the tokens
        that are ``counted``, and starts of the sequences that are ``first``."""
        order, running, place = self.by_time(lengths)
        ids = ids[place]
        emitted, move = self.emit.astype(np.float32)[ids], self.move.astype(np.float32)
        k = len(self.start)
        ones = np.ones(k, np.float32)
        forward, scales = np.empty_like(emitted), np.empty(len(place), np.float32)
        ends = np.cumsum(running)
        for t, (n, end) in enumerate(zip(running, ends, strict=True)):
            now = slice(end - n, end)
            if t == 0:
                alpha = emitted[now] * self.start.astype(np.float32)
            else:
                before = ends[t - 1] - running[t - 1]
                alpha = (forward[before : before + n] @ move) * emitted[now]
            scale = alpha @ ones
            alpha /= scale[:, None]
            forward[now], scales[now] = alpha, scale
        emitted /= scales[:, None]
        inside = None if counted is None or counted.all() else counted[place].astype(np.float32)
        moves = np.zeros((k, k))
        beta = np.ones((len(lengths), k), np.float32)
        for t in range(len(running) - 1, 0, -1):
            n, now = running[t], slice(ends[t] - running[t], ends[t])
            before = ends[t - 1] - running[t - 1]
            ahead = emitted[now] * beta[:n]
            moves += forward[before : before + n].T @ (ahead if inside is None else ahead * inside[now, None])
            forward[now] *= beta[:n]
            beta[:n] = ahead @ move.T
        if len(running):
            forward[: running[0]] *= beta
        forward /= (forward @ ones)[:, None]
        if inside is not None:
            forward *= inside[:, None]
        of_word = np.stack([np.bincount(ids, weights=forward[:, s], minlength=len(self.emit)) for s in range(k)], 1)
        begins = forward[: running[0]] if len(running) else np.zeros((0, k))
        starts = (begins if first is None else begins[first[order]]).sum(0, dtype=float)
        return starts, moves * self.move, of_word


def _buffers(batches: Iterator[pa.RecordBatch], column: str, limit: int = BUFFER) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches with a bounded number of tokens together, their ids one after the other, and the lengths."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]:
        raw = [r for b in held for r in b.column(column).to_pylist()]
        return held, np.frombuffer(b"".join(raw), np.uint16), np.array([len(r) // 2 for r in raw], np.int64)

    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            held.append(part)
            size += part.column(column).nbytes // 2
            if size > limit:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _summed(sums: pa.Array) -> bytes:
    """The sum of rows of single-precision numbers."""
    total = None
    for row in sums:
        x = np.frombuffer(row.as_buffer(), np.float32)
        total = x.astype(float) if total is None else total + x
    return total.astype(np.float32).tobytes()


def fit(sequences: DataFrame, corpus: Corpus, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the ids of all training texts: each round sums the expectations of all tasks, blocks of ids by
    blocks, a fixed number of rows, and re-estimates on the driver."""
    context = sequences.sparkSession.sparkContext
    size = CLASSES + 1
    unigram = corpus.unigram
    model = Model.initial(unigram, states)
    for _ in range(rounds):
        shipped = context.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size + BLOCK, states))  # the last block has moves and starts
            for _, ids, lengths in _buffers(batches, "ids"):
                cut, sizes, counted, first = windows(ids, lengths)
                start, moves, emitted = shipped.value.expectations(cut, sizes, counted, first)
                total[:size] += emitted
                total[size : size + states] += moves
                total[size + states] += start
            blocks = total.astype(np.float32).reshape(-1, BLOCK * states)
            some = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[i].tobytes() for i in some], pa.binary())], ["block", "sums"])

        summed = F.arrow_udf(_summed, "binary")
        rows = sequences.select("ids").mapInArrow(expect, "block int, sums binary").groupBy("block").agg(summed("sums").alias("sums")).collect()  # CLASSES / BLOCK rows
        total = np.zeros(((size + BLOCK) // BLOCK, BLOCK * states))
        for r in rows:
            total[r["block"]] = np.frombuffer(r["sums"], np.float32)
        total = total.reshape(-1, states)
        emit, move, start = total[:size], total[size : size + states] + 1e-3, total[size + states] + 1e-3
        share, times = emit.sum(0) / max(emit.sum(), 1e-9) + 1e-9, emit.sum(1, keepdims=True)
        emit = times * (emit + PRIOR * share) / (times + PRIOR) + UNSEEN * share
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        shipped.unpersist()
    return model


def score(documents: DataFrame, states: int = STATES, rounds: int = ROUNDS, top: int = TOP) -> DataFrame:
    """One row per row of ``documents``: ``score``, the model's log10 probability of the whole text, and ``base_score``,
    that of smoothed unigram counts.

    Learned from the rows whose fold is not 1. A null text is an empty one, which has its end token only. With no
    training rows everything is unknown and all states emit alike. Repeated rows give repeated results; texts of any
    length count whole; other columns aren't read; no rows give none."""
    ship(documents.sparkSession)
    training = documents.where(fold() != 1)
    counts = written(training.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(_classes, "word binary, n long, class int"), "word-counts")
    corpus = Corpus(counts, training.count())
    sequences = written(encoded(documents, corpus, *most_frequent(counts, top)), "encoded")
    model = fit(sequences.where("not held_out"), corpus, states, rounds)
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, ids, lengths in _buffers(batches, "ids", SCORE_BUFFER):
            table = pa.Table.from_batches(held).drop_columns(["ids"])
            for name, column in (("forward", shipped.value.log10_likelihood(ids, lengths)), ("n_tokens", lengths)):
                table = table.append_column(name, pa.array(column))
            yield from table.to_batches()

    scored = sequences.select("row_key", "doc_id", "held_out", "base", "within", "known", "ids").mapInArrow(forward, "row_key long, doc_id long, held_out boolean, base double, within double, known long, forward double, n_tokens long")
    rare = sequences.select("row_key", F.explode(F.arrays_zip("other", "other_n", "other_class")).alias("w")).select("row_key", F.col("w.other").alias("word"), F.col("w.other_n").alias("times"), F.col("w.other_class").alias("class"))
    of_class = documents.sparkSession.createDataFrame(list(zip(range(CLASSES), corpus.tokens.tolist(), corpus.words.tolist(), strict=True)), "class int, tokens double, words double")  # CLASSES rows
    c = F.coalesce("n", F.lit(0))
    looked_up = rare.join(counts.drop("class"), "word", "left").join(F.broadcast(of_class), "class").groupBy("row_key").agg(
        F.sum(F.col("times") * F.log10((c + 0.5) / (corpus.total + 0.5 * (corpus.kinds + 1)))).alias("rare_base"),
        F.sum(F.col("times") * F.log10((c + 0.5) / (F.col("tokens") + 0.5 * (F.col("words") + 1)))).alias("rare_within"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    zero = F.lit(0)
    return scored.join(looked_up, "row_key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"), F.lit(corpus.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("forward") + F.col("within") + F.coalesce("rare_within", zero)).alias("score"),
    )
