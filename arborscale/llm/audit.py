"""Audit of how filters interact, with exact duplicates found by radix tries.

Each stretch of documents is put into a compressed trie over the bytes of its whole texts, which holds the least id at each
terminal; so a text that many documents share leaves a stretch once. The branches of these tries also give the bounds of the
ranges: after each so many bytes of text, the shortest prefix that parts a text from the one before it, so prefixes are as long
as the texts there ask for. Ranges then put their texts into tries of their own, and only what these say otherwise than the
stretch goes back to it. Filters become a mask of bits for each document, masks a histogram, and all orders of the
filters are read from that.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.llm._shared import ship, written
from arborscale.llm.pack import text_runs

#: Bit of each filter in a mask.
BITS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
#: Bytes of text in a stretch; bytes between two bounds at least, and how many bounds there are at most, whatever the input.
STRETCH_BYTES, RANGE_BYTES, MAX_RANGES = 8_000_000, 1 << 18, 400_000
_UPPER, _SIGNS, _INNER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """The mask of filters A to D that a text fails: A: under 200 words; B: under half of its words distinct; C: over three
    capitals in a hundred characters; D: holds one of the signs. Words are parted by white space of ASCII."""
    words = text.split()
    n, bare = len(words), text.translate(None, _SIGNS)
    capitals, characters = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _INNER))
    return (n < 200) * BITS["A"] + (100 * len(set(words)) < 50 * n) * BITS["B"] + (100 * capitals > 3 * characters) * BITS["C"] + (len(bare) < len(text)) * BITS["D"]


class Node:
    """A node below an edge with ``label``. ``ids``: texts that end here, of which ``least`` is the least id, if any has one."""

    __slots__ = ("children", "label", "least", "number")

    def __init__(self, label: bytes):
        self.label, self.children, self.least, self.number = label, {}, None, -1


def shared_length(a: bytes, b: bytes, start: int) -> int:
    """How many bytes ``a`` has in common with ``b`` from ``start`` on, by halving."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        middle = (low + high + 1) // 2
        if b.startswith(a[low:middle], start + low):
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """A compressed trie over whole texts."""

    def __init__(self):
        self.root = Node(b"")

    def terminal(self, text: bytes) -> Node:
        """The node where ``text`` ends, made if there is none."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                return child
            if not text.startswith(child.label, at):
                n = shared_length(child.label, text, at)
                middle = node.children[text[at]] = Node(child.label[:n])
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                child = middle
            node, at = child, at + len(child.label)
        return node

    def insert(self, text: bytes, number: int | None) -> Node:
        node = self.terminal(text)
        if number is not None and (node.least is None or number < node.least):
            node.least = number
        return node

    def walk(self) -> Iterator[tuple[Node, bytes]]:
        """All nodes in the order of their texts, each with the shortest prefix of its text that no node before it has."""
        stack = [(self.root, b"", b"")]
        while stack:
            node, path, apart = stack.pop()
            yield node, apart
            for byte in sorted(node.children, reverse=True):
                child = node.children[byte]
                stack.append((child, path + child.label if child.children else b"", path + child.label[:1]))
            if node.children and node.number < 0:  # no text ends here, so its first child is parted where it is itself
                child, below, split = stack.pop()
                stack.append((child, below, apart or split))


_ENTRY = "stretch long, entry int, text binary, mask int, least long, docs array<struct<doc_id:long,part:string>>, bound binary"


def _stretches(documents: DataFrame, step: int) -> DataFrame:
    """A row for each different text of a stretch: its failures of A to D, its least id there, its documents, and a prefix where
    ``step`` bytes have passed since the last one."""

    def flush(trie: RadixTrie, texts: list[bytes], docs: list[list[dict]], nodes: list[Node], number: int) -> pa.RecordBatch:
        bounds: list[bytes | None] = [None] * len(texts)
        gone = zlib.crc32(texts[0]) % step  # stretches shorter than a step have a bound as often as they should
        for node, apart in trie.walk():
            if node.number >= 0:
                gone += len(texts[node.number]) + 1
                if gone >= step:
                    gone %= step
                    bounds[node.number] = apart
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.string())])), pa.binary()]
        columns = [[number] * len(texts), list(range(len(texts))), texts, list(map(failures, texts)), [n.least for n in nodes], docs, bounds]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = [c.split()[0] for c in _ENTRY.split(", ")[:5]] + ["docs", "bound"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        trie, texts, docs, nodes = RadixTrie(), [], [], []
        for part in (p for batch in batches for p in text_runs(batch, limit=STRETCH_BYTES // 4)):
            for text, doc_id, lang in zip(part.column("text").fill_null("").cast(pa.binary()).to_pylist(), part.column("doc_id").to_pylist(), part.column("part").to_pylist(), strict=True):
                node = trie.insert(text, doc_id)
                if node.number < 0:
                    node.number = len(texts)
                    texts.append(text)
                    docs.append([])
                    nodes.append(node)
                    size += len(text)
                docs[node.number].append({"doc_id": doc_id, "part": lang})
                size += 16
            if size > STRETCH_BYTES:
                yield flush(trie, texts, docs, nodes, number)
                number, size, trie, texts, docs, nodes = number + 1, 0, RadixTrie(), [], [], []
        if texts:
            yield flush(trie, texts, docs, nodes, number)

    return documents.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part")).mapInArrow(run, _ENTRY)


def flags(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``part`` (the language), ``mask`` (the bits of the filters that the document fails) and ``first_id``, the least id
    with the same text.

    A null text is the empty one and a null language the empty string. E fails where a smaller id has the same whole text; so
    a repeated row doesn't fail, nor does a row without an id, and such a row fails nobody. Empty and very long texts are texts
    like others; other columns aren't read; no rows give no rows."""
    spark = ship(documents.sparkSession)
    total = documents.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).head()[0]
    entries = written(_stretches(documents, max(RANGE_BYTES, total // MAX_RANGES)), "stretches")
    # one short prefix for each range
    found = sorted({bytes(r["bound"]) for r in entries.where("bound IS NOT NULL").select("bound").collect()})
    bounds = spark.sparkContext.broadcast(found)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [bisect_right(bounds.value, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int32())], [*batch.schema.names, "range"])

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, RadixTrie] = {}
        rows: list[tuple[int, int, int | None, Node]] = []
        for batch in batches:
            for stretch, entry, text, least, where in zip(*(batch.column(c).to_pylist() for c in ("stretch", "entry", "text", "least", "range")), strict=True):
                if where not in ranges:
                    ranges[where] = RadixTrie()
                rows.append((stretch, entry, least, ranges[where].insert(text, least)))
        other = [(s, e, node.least) for s, e, least, node in rows if node.least != least]
        columns = list(zip(*other, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["of_stretch", "of_entry", "first"])

    texts = entries.select("stretch", "entry", "text", "least")
    dealt = texts.mapInArrow(ranged, "stretch long, entry int, text binary, least long, range int")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (256 * RANGE_BYTES) + 1)
    changed = dealt.repartition(parts, "range").mapInArrow(tries, "of_stretch long, of_entry int, first long")
    told = entries.select("stretch", "entry", "mask", "least", "docs").join(changed, (F.col("stretch") == F.col("of_stretch")) & (F.col("entry") == F.col("of_entry")), "left")
    rows = told.select("mask", F.coalesce("first", "least").alias("first_id"), F.explode("docs").alias("d"))
    repeated = F.when(F.col("d.doc_id") > F.col("first_id"), BITS["E"]).otherwise(0)
    return rows.select("d.doc_id", "d.part", (F.col("mask") + repeated).alias("mask"), "first_id")


def audit(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, each order of the filters and each step: the documents kept after it, removed by it, those that fail its filter
    but went before, those that fail no other filter, good (quality 1) and toxic ones removed, and all removals by the filter over all
    orders.

    Labels are looked up by id; a document is good or toxic if any of its labels says so. Rows without an id have none.
    An empty table has no parts, so no rows. The orders are read from how many documents have each mask: 32 rows a part at
    most, whatever the number of documents."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of_doc")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = flagged.select("doc_id", "part", "mask").join(known, F.col("doc_id") == F.col("of_doc"), "left")
    masks = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    steps = [(o, k + 1, BITS[f], sum(BITS[g] for g in o[:k])) for o in map("".join, permutations(BITS)) for k, f in enumerate(o)]
    every = F.from_json(F.lit(str([{"filter_order": o, "step": k, "bit": b, "before": p} for o, k, b, p in steps]).replace("'", '"')), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    each = masks.select("*", F.inline(every))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    # of the filters that a document fails, each comes first in as many orders as any other
    share = F.lit(len(steps) // 5) / F.bit_count("mask")

    def total(condition, of="n"):
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")

    return each.groupBy("part", "filter_order", "step").agg(
        total((F.col("mask").bitwiseAND(F.col("before").bitwiseOR(F.col("bit")))) == 0).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share).otherwise(0)).cast("long").alias("shapley"),
    )
