"""Best-fit packing after Martello and Toth's dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is a histogram with a row a length, whatever the number of
documents. A set of pieces holding the longest piece ``j`` is fixed as a sequence of its own when it dominates all others that
hold ``j``: whatever else could stand beside ``j`` could change places with it without any other sequence growing. What no
such set holds is packed best-fit, longest first. Both give runs of equal sequences; a piece finds its run by its length and
its rank among the pieces of that length, which Spark counts over ranges.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.llm._shared import discard, ship, written
from arborscale.llm.pack import text_runs, tokenizer_path, word_tokenizer

#: Tokens that a sequence holds at most, and the id that ends a document.
CAPACITY, END = 2048, 0
#: Pieces that a range has on average, and bytes of text that are tokenised together.
RANGE_PIECES, RUN_BYTES = 2_000_000, 4_000_000


class Run(NamedTuple):
    """``n`` pieces of a length, from a rank on: so many to each of consecutive sequences, from an offset on."""

    length: int
    rank: int
    n: int
    sequence: int
    each: int
    offset: int


class Instance:
    """Pieces left of each length."""

    def __init__(self, counts: dict[int, int]):
        self.left = {w: n for w, n in counts.items() if n}
        self.weights = sorted(self.left)

    def take(self, weight: int, n: int) -> None:
        self.left[weight] -= n
        if not self.left[weight]:
            del self.left[weight]
            self.weights.remove(weight)

    def without(self, weight: int) -> list[int]:
        """The lengths that remain beside one piece of ``weight``."""
        return self.weights if self.left[weight] > 1 else [w for w in self.weights if w != weight]


def dominating(instance: Instance, longest: int, capacity: int) -> tuple[int, ...] | None:
    """The set with one piece of length ``longest`` that dominates all such sets, if one of at most three pieces does.

    With ``room`` beside it: no piece fits - it stands alone. Only one fits at a time, or one fills the room - the longest that
    fits. Two fit but never three - the longest one if it is no shorter than any pair; else the fullest pair, if its longer piece
    is the longest that fits at all and no two pieces between its own lengths fit (those alone could not be exchanged for it)."""
    room = capacity - longest
    others, left = instance.without(longest), instance.left

    def n(w: int) -> int:
        return left[w] - (w == longest)

    fits = bisect_right(others, room)
    if not fits:
        return (longest,)
    best = others[fits - 1]
    smallest: list[int] = []
    for w in others[:3]:
        smallest += [w] * min(3, n(w))
    smallest = smallest[:3]
    if best == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return longest, best
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    pair = (0, 0)
    for a in reversed(others[:fits]):  # the fullest pair; of equal ones that with the longest piece
        at = bisect_right(others, min(a, room - a)) - 1
        if at >= 0 and others[at] == a and n(a) == 1:
            at -= 1
        if at >= 0 and a + others[at] > sum(pair):
            pair = a, others[at]
    a, b = pair
    if best >= a + b:
        return longest, best
    between = others[bisect_right(others, b) : others.index(a)]
    two: list[int] = []
    for w in between[:2]:
        two += [w] * min(2, n(w))
    if best == a and (len(two) < 2 or two[0] + two[1] > room):
        return longest, a, b
    return None


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed sets with how often each is taken, and the pieces that no set holds.

    A set stays dominating while pieces of its lengths last, since taking pieces away only takes other sets away. Passes
    over the lengths end when one fixes nothing."""
    instance, fixed = Instance(counts), []
    while True:
        before = len(fixed)
        for longest in sorted(instance.left, reverse=True):
            while longest in instance.left:
                found = dominating(instance, longest, capacity)
                if found is None:
                    break
                times = min(instance.left[w] // found.count(w) for w in found)
                for w in found:
                    instance.take(w, times)
                fixed.append((found, times))
        if len(fixed) == before:
            return fixed, instance.left


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Where the pieces of each length go, and the number of sequences. Every step uses up a length or a group of equal
    sequences, so the plan is bounded by the capacity and not by the number of pieces."""
    fixed, rest = reduced(counts, capacity)
    runs, rank, sequences = [], dict.fromkeys(counts, 0), 0

    def put(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        runs.append(Run(length, rank[length], n, sequence, each, offset))
        rank[length] += n

    for found, times in fixed:
        offset = 0
        for w in found:
            put(w, times, sequences, 1, offset)
            offset += w
        sequences += times
    # groups of equally filled sequences: by free room, runs of sequence numbers
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def leave(room: int, start: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((start, n))

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect_right(rooms, length - 1)
            if at < len(rooms):
                room = rooms[at]
                start, many = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, start = capacity, sequences
                many = -(-n // (capacity // length))
                sequences += many
            each, offset = room // length, capacity - room
            full = min(many, n // each)
            if full:
                put(length, full * each, start, each, offset)
                leave(room - each * length, start, full)
                n -= full * each
            if full < many:
                if n and n < each:
                    put(length, n, start + full, n, offset)
                    leave(room - n * length, start + full, 1)
                    full, n = full + 1, 0
                leave(room, start + full, many - full)
    return runs, sequences


def _pieces(documents: DataFrame, path: str, capacity: int, digests_only: bool) -> DataFrame:
    """Pieces of all documents, numbered in each partition in a scattered order, so that equal lengths spread over ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, done = word_tokenizer(path), TaskContext.get().partitionId() << 32
        for part in (p for batch in batches for p in text_runs(batch, limit=RUN_BYTES)):
            ids, lengths = encoder.encode(part.column("text"))
            ids[np.cumsum(lengths) - 1] = END
            flat, many = ids.astype("<u4"), -(-lengths // capacity)
            doc = np.repeat(np.arange(len(lengths)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            size = np.minimum(lengths[doc] - piece * capacity, capacity)
            ends = np.cumsum(size)
            bodies = [flat[s:e].tobytes() for s, e in zip((ends - size).tolist(), ends.tolist(), strict=True)]
            spread = (done + np.arange(len(doc))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)
            done += len(doc)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), pa.array(piece), pa.array(piece * capacity), pa.array(size), pa.array([zlib.crc32(b) for b in bodies], pa.int64()), pa.array(spread.astype(np.int64)), pa.array([None] * len(doc) if digests_only else bodies, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "spread", "ids"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long, spread long, ids binary")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range and each piece's number among those of its length in it; pieces come sorted by length."""
    part, last, seen = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        length = batch.column("length").to_numpy()
        if not len(length):
            continue
        heads = np.flatnonzero(np.concatenate([[True], length[1:] != length[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(length)]]))
        nth = np.arange(len(length)) - np.repeat(heads, sizes)
        if length[0] == last:
            nth[: sizes[0]] += seen
        last, seen = int(length[-1]), int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int64)), pa.array(nth)], [*batch.schema.names, "range", "nth"])


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, digests_only: bool = False) -> DataFrame:
    """Pieces of documents with their sequence and offset in it, in as few sequences as reduction and best fit find.

    A null text is an empty one, which has its end token only. Documents longer than ``capacity`` are cut into full pieces and
    a last one; all others stay whole. A repeated row is packed again; ids may be null. Other columns of ``documents`` aren't
    read; no rows give no pieces. Sequence numbers and offsets have no gaps. ``ids`` holds a piece's tokens as little-endian
    32-bit numbers, or is left out with ``digests_only``.

    The driver sees how many pieces each length has (a row a length) and how many each range of the sorted pieces (a row a range
    and length in it); a length that many pieces share lies in many ranges."""
    spark = ship(documents.sparkSession)
    pieces = written(_pieces(documents, path or tokenizer_path(), capacity, digests_only), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(counts.values()) // RANGE_PIECES))
    along = pieces.repartitionByRange(ranges, "length", "spread").sortWithinPartitions("length", "spread").drop("spread")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ordered = written(along.mapInArrow(_numbered, ", ".join(f"{c} long" for c in kept) + ", ids binary, range long, nth long"), "by-length")
    discard(pieces)
    before: dict[int, int] = {}
    bases = {}
    for r in ordered.groupBy("length", "range").agg(F.count("*").alias("n")).orderBy("length", "range").collect():
        bases[r["range"], r["length"]] = before.get(r["length"], 0)
        before[r["length"]] = before.get(r["length"], 0) + r["n"]
    runs = sorted(plan(counts, capacity)[0])
    told = spark.sparkContext.broadcast((bases, np.array(runs, np.int64).reshape(-1, 6)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, table = told.value
        key = (table[:, 0] << 48) | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            places, back = np.unique(np.stack([batch.column("range").to_numpy(), length]), axis=1, return_inverse=True)
            rank = np.array([bases[p] for p in map(tuple, places.T.tolist())], np.int64)[back] + batch.column("nth").to_numpy()
            run = table[np.searchsorted(key, (length << 48) | rank, side="right") - 1]
            nth, turn = np.divmod(rank - run[:, 1], run[:, 4])
            out = [*(batch.column(c) for c in kept), pa.array(run[:, 3] + nth), pa.array(run[:, 5] + turn * length), batch.column("ids")]
            yield pa.RecordBatch.from_arrays(out, [*kept, "sequence_id", "offset", "ids"])

    found = ordered.mapInArrow(place, ", ".join(f"{c} long" for c in [*kept, "sequence_id", "offset"]) + ", ids binary")
    return found.drop("ids") if digests_only else found
