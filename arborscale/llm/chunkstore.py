"""Content-defined chunking of media payloads with a deduplicated chunk store.

A payload is cut where a rolling gear hash of the last 32 bytes has its top bits zero, so an insertion moves only the
cuts next to it. Chunks go by their SHA-256. Chunks that occur once lie in the pack of their own payload; those that
occur more often are brought together by digest in Spark and stored once in a table of shared chunks, and the ordered
chunk list of each payload refers to both. Reading joins the lists with the shared chunks, puts payloads together in
order and verifies every digest.

Which chunks may be shared is told to the tasks by a Bloom filter of ``FILTER_BITS`` bits, a fixed size whatever the
input. A false positive only sends a lone chunk to the shared table; nothing is lost.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.llm._shared import written

#: Bytes of a chunk at least and at most, and the zero bits at a cut (an average of 2,048 bytes beyond the least).
LEAST, MOST, CUT_BITS = 512, 16_384, 11
#: A payload's length is a multiple of this.
UNIT = 64
FILTER_BITS, FILTER_HASHES = 1 << 26, 4
MAGIC = b"CDC1"


def _gear() -> np.ndarray:
    """A mixed 32-bit number for each byte value."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(27))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text (null: empty) and zeros up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def cut_places(data: bytes) -> np.ndarray:
    """Ends of windows whose gear hash has zero top bits. The hash of 32 bytes is built by doubling: of one, two, four
    and so on."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunks_of(payloads: list[bytes]) -> list[list[bytes]]:
    """The chunks of each payload. They are hashed together: the least length keeps windows inside their payload."""
    places = cut_places(b"".join(payloads)) if payloads else np.zeros(0, int)
    out, base = [], 0
    for data in payloads:
        own = places[np.searchsorted(places, base + 1) : np.searchsorted(places, base + len(data), "right")] - base
        start, chunks, i = 0, [], 0
        while start < len(data):
            i = int(np.searchsorted(own, start + LEAST))
            end = int(own[i]) if i < len(own) else len(data)
            end = min(end, start + MOST, len(data))
            chunks.append(data[start:end])
            start = end
        out.append(chunks)
        base += len(data)
    return out


def _parts(batch: pa.RecordBatch, column: int, limit: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts with a bounded number of characters (or one text), and where each starts."""
    texts = batch.column(column).to_pylist()
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, texts[start:]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in _parts(batch, 0):
            found = [hashlib.sha256(c).digest() for cs in chunks_of([payload_of(t) for t in texts]) for c in cs]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["digest"])


class MaybeShared:
    """The filter: whether a chunk may occur more than once."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(digest: bytes) -> tuple[int, ...]:
        return tuple(x % FILTER_BITS for x in struct.unpack_from(f">{FILTER_HASHES}I", digest))

    def __contains__(self, digest: bytes) -> bool:
        return all(int(self.words[p >> 5]) >> (p & 31) & 1 for p in self.places(digest))


def maybe_shared(shared: DataFrame) -> MaybeShared:
    """Build the filter from a table of digests; its words are put together by Spark, at most two million of them."""
    bits = F.array(*[F.pmod(F.conv(F.hex(F.substring("digest", 4 * i + 1, 4)), 16, 10).cast("long"), F.lit(FILTER_BITS)) for i in range(FILTER_HASHES)])
    words = shared.select(F.explode(bits).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 AS int)))").alias("mask")).toPandas()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).astype(np.uint32)
    return MaybeShared(out)


def manifest_of(chunks: list[bytes], digests: list[bytes]) -> bytes:
    """The stored form of a payload: its ordered list of digests and lengths."""
    return MAGIC + struct.pack("<I", len(chunks)) + b"".join(d + struct.pack("<I", len(c)) for d, c in zip(digests, chunks, strict=True))


def listed(manifest: bytes) -> list[tuple[bytes, int]]:
    """Digests and lengths of a stored list."""
    if manifest[:4] != MAGIC:
        raise ValueError("this isn't a chunk list")
    return [(d, n) for d, n in struct.iter_unpack("<32sI", manifest[8:])]


PACK = "row_key long, doc_id long, n_bytes long, manifest binary, digests array<binary>, bodies array<binary>, alone boolean"


def store(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write the chunks of all payloads: ``packs``, a row for each row of ``documents`` with its ordered digests and
    the compressed bodies of its own chunks (null where shared), and ``shared``, a row for each shared chunk."""
    spark = documents.sparkSession
    texts = documents.select("text")
    repeated = texts.mapInArrow(_digests, "digest binary").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    filter_ = spark.sparkContext.broadcast(maybe_shared(repeated))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, number = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, part in _parts(batch, 1):
                rows = []
                for i, (text, chunks) in enumerate(zip(part, chunks_of([payload_of(t) for t in part]), strict=True)):
                    digests = [hashlib.sha256(c).digest() for c in chunks]
                    bodies = [None if d in filter_.value else compress(c) for d, c in zip(digests, chunks, strict=True)]
                    rows.append((number, ids[start + i], len((text or "").encode()), manifest_of(chunks, digests), digests, bodies, None not in bodies))
                    number += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["row_key", "doc_id", "n_bytes", "manifest", "digests", "bodies", "alone"])

    def shared_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, told = zstandard.ZstdCompressor(level=3).compress, set()
        for batch in batches:
            for _, part in _parts(batch, 0):
                found = {}
                for chunks in chunks_of([payload_of(t) for t in part]):
                    for c in chunks:
                        d = hashlib.sha256(c).digest()
                        if d in filter_.value and d not in told and d not in found:
                            found[d] = compress(c)
                told = {*told, *found} if len(told) < 100_000 else set(found)
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary())], ["digest", "body"])

    packs = written(documents.select("doc_id", "text").mapInArrow(pack, PACK), "packs")
    shared = written(texts.mapInArrow(shared_bodies, "digest binary, body binary").groupBy("digest").agg(F.first("body").alias("body")), "shared-chunks")
    return packs, shared


def rebuilt(packs: DataFrame, shared: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, the stored ``manifest`` and the ordered ``bodies`` of every payload. Only payloads with
    shared chunks are shuffled."""
    whole = packs.where("alone").select("doc_id", "n_bytes", "manifest", "bodies")
    parts = packs.where("not alone").select("row_key", F.posexplode(F.arrays_zip("digests", "bodies")).alias("at", "part"))
    named = parts.select("row_key", "at", F.col("part.digests").alias("digest"), F.col("part.bodies").alias("own"))
    joined = named.join(shared, "digest", "left").select("row_key", "at", F.coalesce("own", "body").alias("body"))
    lists = joined.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("parts"))
    heads = packs.where("not alone").select("row_key", "doc_id", "n_bytes", "manifest")
    return whole.union(heads.join(lists, "row_key").select("doc_id", "n_bytes", "manifest", "parts.body"))


def _features(payload: bytes) -> str:
    """Level, spread and entropy of the 8-bit samples, and how often neighbours cross the middle level."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={abs(entropy):.4f};crossings={crossings}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decompress = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for doc_id, n_bytes, manifest, bodies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            chunks = [decompress(b) for b in bodies]
            if listed(manifest) != [(hashlib.sha256(c).digest(), len(c)) for c in chunks]:
                raise ValueError(f"the chunks of document {doc_id} aren't those of its list")
            payload = b"".join(chunks)
            rows.append({
                "doc_id": doc_id, "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
                "media_bytes": len(manifest), "media_sha256": hashlib.sha256(manifest).hexdigest(), "feature": _features(payload), "n_chunks": len(chunks),
            })
        kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string()}
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, kinds.get(c, pa.int64())) for c in names]))


def media(documents: DataFrame) -> DataFrame:
    """Store the payload of every row, read it back from the stored chunks and describe it.

    The stored form of a payload is its ordered chunk list (digests and lengths), which lies in the packs and refers to the
    chunk store; ``media_bytes`` and ``media_sha256`` are of its bytes as read back. A null text is an empty one, whose
    payload is 64 zeros; equal texts give equal values; repeated rows give repeated rows; very long texts have as many
    chunks as they need; other columns aren't read; no rows give none."""
    result = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
    return rebuilt(*store(documents)).mapInArrow(_read, result)
