"""Training-order materialisation.

The token stream of each task's documents is cut into sequences of ``LENGTH`` tokens, so only a task's last one can be
short. A keyed Feistel permutation with cycle-walking gives every sequence a global slot: a bijection of 0 to n - 1 that
needs no sort and no state, and that the key alone repeats. Every shard is one uncompressed file of ``SHARD_RECORDS``
records of one size, written in order by one task, so the place of a slot is a product and a reader can open a shard at
any of them. A table beside the shards says what each record holds.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.llm._shared import discard, shared_dir, ship, written
from arborscale.llm.pack import binary_rows, text_runs, tokenizer_path, word_tokenizer

#: Tokens of a record, records of a shard, and the id that fills a short record.
LENGTH, SHARD_RECORDS, PAD = 2048, 4096, 0
ROUNDS = 6


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each number in 0 to ``n - 1``.

    The Feistel rounds permute the power of four at or above ``n``; a value outside is permuted again until it lies
    inside, fewer than four times on average."""
    bits = max(1, math.ceil(max(n - 1, 1).bit_length() / 2))
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits)
    keys = [np.uint64(zlib.crc32(f"{key}/{r}".encode()) << 32 | zlib.crc32(f"{r}/{key}".encode())) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            z = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & mask)
        return left << half | right

    with np.errstate(over="ignore"):
        out = once(i.astype(np.uint64))
        while (outside := out >= np.uint64(n)).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


SEQUENCE = "task int, number long, pieces array<struct<doc_id:long,start:long,length:long>>, ids binary"


def sequences(documents: DataFrame, path: str, length: int) -> DataFrame:
    """All tokens of all documents (each with its end) in sequences, numbered within their task, and the ``pieces`` of
    documents in each."""
    kinds = pa.schema([("task", pa.int32()), ("number", pa.int64()), ("pieces", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, number = word_tokenizer(path), TaskContext.get().partitionId(), 0
        rest, open_ = np.zeros(0, encoder.type), []  # of the sequence that isn't full yet

        def out(whole: list[list[tuple]], ids: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
            pieces = pa.array([[{"doc_id": d, "start": s, "length": n} for d, s, n in p] for p in whole], kinds.field("pieces").type)
            return pa.RecordBatch.from_arrays([pa.array([task] * len(whole), pa.int32()), pa.array(np.arange(number, number + len(whole))), pieces, binary_rows(ids, lengths)], schema=kinds)

        for batch in batches:
            for part in text_runs(batch):
                ids, lengths = encoder.encode(part.column("text"))
                ids, whole, at = np.concatenate([rest, ids]), [], len(rest)
                for doc_id, n in zip(part.column("doc_id").to_pylist(), lengths.tolist(), strict=True):
                    start = 0
                    while start < n:
                        size = min(n - start, length - at)
                        open_.append((doc_id, start, size))
                        start, at = start + size, at + size
                        if at == length:
                            whole.append(open_)
                            open_, at = [], 0
                cut = len(whole) * length
                yield out(whole, ids[:cut], np.full(len(whole), length))
                rest, number = ids[cut:], number + len(whole)
        if open_:
            yield out([open_], rest, np.array([len(rest)]))

    return documents.select("doc_id", "text").mapInArrow(run, SEQUENCE)


def shard_file(folder: str, shard: int) -> str:
    return f"{folder}/shards/{shard:010d}.bin"


class _Shards:
    """Writes records, in the order of their slots, to the shards of one task. A shard gets its name when it is whole, so
    a retry or a second attempt does no harm."""

    def __init__(self, folder: str):
        self.fs, self.root = FileSystem.from_uri(folder)
        self.shard, self.out = -1, None

    def write(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.temporary = shard, f"{shard_file(self.root, shard)}.{uuid.uuid4().hex}.tmp"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.out.write(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        place = shard_file(self.root, self.shard)
        try:
            self.fs.move(self.temporary, place)
        except OSError:  # some stores don't replace; another attempt has written the same bytes
            if self.fs.get_file_info(place).type != FileType.File:
                raise
            self.fs.delete_file(self.temporary)


def _stored(path: pa.Array, offset: pa.Array, stride: pa.Array) -> Iterator[bytes]:
    """The bytes at a place of a shard; a file stays open as long as the rows stay in it."""
    name, file = None, None
    for p, at, n in zip(path.to_pylist(), offset.to_pylist(), stride.to_pylist(), strict=True):
        if p != name:
            if file is not None:
                file.close()
            fs, local = FileSystem.from_uri(p)
            name, file = p, fs.open_input_file(local)
        file.seek(at)
        yield file.read(n)
    if file is not None:
        file.close()


def _data(path: pa.Array, offset: pa.Array, stride: pa.Array) -> pa.Array:
    return pa.array(list(_stored(path, offset, stride)), pa.binary())


def _digest(path: pa.Array, offset: pa.Array, stride: pa.Array) -> pa.Array:
    found = [(zlib.crc32(data), len(data)) for data in _stored(path, offset, stride)]
    return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["data_crc32", "data_bytes"])


PLACE = ("path", "byte_offset", "stride")


def with_data(index: DataFrame) -> DataFrame:
    """The records that the index names, with the bytes read from their shards as ``data``."""
    return index.withColumn("data", F.arrow_udf(_data, "binary")(*PLACE))


def materialise(documents: DataFrame, folder: str, key: int = 17, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """Write every sequence as a record at its slot, and return their index: ``slot``, ``shard``, ``record``
    (the place in the shard), ``path`` of the shard, ``byte_offset`` in it, ``stride``, ``tokens``, ``pieces`` (``doc_id``,
    ``start`` in the document, ``length``) in their order. A record holds ``length`` little-endian ids of 16 bits (32 where
    the vocabulary asks for them); ``with_data`` reads them.

    ``folder`` is one that all tasks reach. A null text is an empty one, which has its end token only; a repeated row has
    tokens of its own; very long texts run over as many records as they need; an empty table has no records. Other
    columns of ``documents`` aren't read."""
    spark = ship(documents.sparkSession)
    path = path or tokenizer_path()
    kind = word_tokenizer(path).type.newbyteorder("<")
    numbered = written(sequences(documents, path, length), "sequences")
    counts = {r["task"]: r["n"] for r in numbered.groupBy("task").agg(F.count("*").alias("n")).collect()}  # one row a task
    each = np.zeros(max(counts, default=0) + 1, np.int64)
    each[list(counts)] = list(counts.values())
    base, n = np.cumsum(each) - each, int(each.sum())

    @F.arrow_udf("long")
    def slot(task: pa.Array, number: pa.Array) -> pa.Array:
        return pa.array(permute(base[task.to_numpy()] + number.to_numpy(), n, key))

    stride = kind.itemsize * length
    fs, root = FileSystem.from_uri(folder)
    if fs.get_file_info(f"{root}/shards").type == FileType.Directory:
        fs.delete_dir(f"{root}/shards")
    fs.create_dir(f"{root}/shards", recursive=True)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, fill = _Shards(folder), np.full(length, PAD, kind).tobytes()
        for batch in batches:
            slots, ids = batch.column("slot").to_numpy(), batch.column("ids").to_pylist()
            for s, i in zip(slots.tolist(), ids, strict=True):
                shards.write(s // SHARD_RECORDS, i + fill[len(i) :])
            record = slots % SHARD_RECORDS
            yield pa.RecordBatch.from_arrays(
                [batch.column("slot"), batch.column("shard"), pa.array(record), pa.array([shard_file(folder, s // SHARD_RECORDS) for s in slots.tolist()]), pa.array(record * stride), pa.array(np.full(len(slots), stride)), pa.array([len(i) // kind.itemsize for i in ids], pa.int64()), batch.column("pieces")],
                ["slot", "shard", "record", "path", "byte_offset", "stride", "tokens", "pieces"],
            )
        shards.close()

    placed = numbered.select(slot("task", "number").alias("slot"), "pieces", "ids").withColumn("shard", F.expr(f"slot div {SHARD_RECORDS}"))
    # by shard, so that no shard is parted between tasks
    ordered = placed.repartitionByRange("shard").sortWithinPartitions("slot")
    schema = "slot long, shard long, record long, path string, byte_offset long, stride long, tokens long, pieces array<struct<doc_id:long,start:long,length:long>>"
    ordered.mapInArrow(dealt, schema).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/index")
    discard(numbered)
    return spark.read.schema(schema).parquet(f"{folder}/index")


def resume(index: DataFrame, slot: int) -> DataFrame:
    """The records from a slot on, in order. Only what the index says of them is sorted; their bytes are read in place."""
    return with_data(index.where(F.col("slot") >= slot).orderBy("slot"))


def read_from(folder: str, slot: int, length: int = LENGTH) -> Iterator[bytes]:
    """The bytes of the records from a slot on, without Spark: the shard is opened at the place of the slot."""
    fs, root = FileSystem.from_uri(folder)
    shard, at, stride = slot // SHARD_RECORDS, slot % SHARD_RECORDS * 2 * length, 2 * length
    while fs.get_file_info(place := shard_file(root, shard)).type == FileType.File:
        with fs.open_input_file(place) as file:
            file.seek(min(at, file.size()))
            while data := file.read(stride):
                yield data
        shard, at = shard + 1, 0


def training_order(documents: DataFrame, key: int = 17, length: int = LENGTH) -> DataFrame:
    """The index of the materialised order as read back from the stored records: a row for each piece of a document with
    its ``slot``, ``shard``, ``byte_offset`` of the record in the shard, ``offset`` in the record, ``start`` in the document
    and ``length`` in tokens, and the checksum and size of the record's stored bytes."""
    index = materialise(documents, f"{shared_dir(documents.sparkSession)}/arborscale-order-{uuid.uuid4().hex}", key, length)
    read = index.withColumn("stored", F.arrow_udf(_digest, "data_crc32 long, data_bytes long")(*PLACE)).select("slot", "shard", "byte_offset", "stored.*", F.posexplode("pieces").alias("at", "piece"), "pieces")
    before = F.aggregate(F.slice("pieces", 1, F.col("at")), F.lit(0).cast("long"), lambda so_far, p: so_far + p["length"])
    return read.select("slot", "shard", "byte_offset", before.alias("offset"), "piece.*", "data_crc32", "data_bytes")
