"""Sequence packing along a space-filling curve.

Each document's token vector is hashed and projected to three dimensions; the cell of the projection gets its place on a
Hilbert curve. Documents are sorted by that key over ranges, so neighbours on the curve are alike, and the token stream
along the curve is cut every ``length`` tokens. Only the very last sequence can be short, so padding doesn't grow.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.llm._shared import TOKENIZER_FILE, discard, remember_only, ship, written

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END = 4096, 2
#: Dimensions of the projection and bits of each on the curve; the rest of the key spreads equal vectors.
DIMS, BITS, SPREAD_BITS = 3, 10, 30
#: Words that a worker remembers with their ids before it starts anew.
MEMO_WORDS = 600_000
#: Tokens that a range of the curve has on average.
RANGE_TOKENS = 16_000_000
#: The white space that the tokenizer drops; Python's own split also takes the four separators below it.
CHUNK = re.compile("[^\t-\r \x85\xa0  -     　]+")
ODD_SPACE = "[\x1c-\x1f]"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others
    for the letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordTokenizer:
    """Ids of whole texts, as the tokenizer gives them, each text with ``END`` after it.

    Where white space parts words for the tokenizer, Arrow splits texts and finds the distinct words, and each of these is
    put together from its pieces (runs of letters, single digits, runs of signs), which are remembered; only a new piece
    goes through the merges. Words with the text of a special token go through the tokenizer whole. A file with another
    normaliser or splitter than the known ones is used as it is, text by text."""

    CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
    PIECE = regex.compile(CONTRACTIONS + r"|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    NORMALISERS = ["NFC", "Replace", "Lowercase"]
    SPLIT = CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.type = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.code = self.type.char
        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        steps = (how.get("normalizer") or {}).get("normalizers", [])
        first = ((how.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_words = [n["type"] for n in steps] == self.NORMALISERS and first.get("pattern") == {"Regex": self.SPLIT}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            plain = piece.isascii() and piece.isprintable()
            tokens = self.model.tokenize(piece if plain else piece.encode().decode("latin-1").translate(self.letters))
            found = self.pieces[piece] = array(self.code, [t.id for t in tokens]).tobytes()
        return found

    def _word(self, word: str) -> bytes:
        if "<" in word and any(s in word for s in self.special):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.type).tobytes()
        if word.isascii():
            small = word.lower()
            if small.isalpha():
                return self._piece(small)
            if small[:-1].isalpha() and not small[-1].isalnum():  # letters and one sign
                return self._piece(small[:-1]) + self._piece(small[-1])
        else:
            small = unicodedata.normalize("NFC", word)
            small = small.lower() if "Σ" not in small else "".join(map(str.lower, small))  # no final form of the sigma
        return b"".join(map(self._piece, self.PIECE.findall(small)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has; a null text has ``END`` only."""
        texts = texts.fill_null("")
        if not len(texts):
            return np.zeros(0, self.type), np.zeros(0, np.int64)
        if not self.by_words:
            every = [np.array([*e.ids, END], self.type) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(every), np.array([len(e) for e in every], np.int64)
        if pc.any(pc.match_substring_regex(texts, ODD_SPACE)).as_py():  # white space that the tokenizer doesn't know
            split = pa.array([CHUNK.findall(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            split = pc.utf8_split_whitespace(texts)
        known = split.flatten().dictionary_encode()
        if len(self.words) > MEMO_WORDS:
            self.words = {}
        if len(self.pieces) > MEMO_WORDS:
            self.pieces = {}
        words, distinct = self.words, known.dictionary.to_numpy(zero_copy_only=False).tolist()
        for word in set(distinct).difference(words):
            words[word] = self._word(word)
        coded = [words[w] for w in distinct]
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // self.type.itemsize
        flat = np.frombuffer(b"".join(coded), self.type)
        code = known.indices.to_numpy()
        count = size[code]
        upto = np.concatenate([[0], np.cumsum(count)])
        # a token stands as far behind its word's first as in the word's own ids
        shift = np.repeat((np.cumsum(size) - size)[code] - upto[:-1], count)
        ids = flat[shift + np.arange(upto[-1])]
        edges = upto[split.offsets.to_numpy() - split.offsets[0].as_py()]
        lengths = np.diff(edges) + 1
        out = np.full(len(ids) + len(texts), END, self.type)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), lengths - 1)] = ids
        return out, lengths


def text_runs(batch: pa.RecordBatch, column: str = "text", limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices with a bounded number of bytes of text together (or one row)."""
    sizes, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _forget_words() -> None:
    for t in _TOKENIZERS.values():
        t.words, t.pieces = {}, {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process; its words are forgotten when another operator begins there."""
    remember_only("words", _forget_words)
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _projection(size: int = 1 << 16) -> np.ndarray:
    """A fixed direction for each hashed token id."""
    return np.random.Generator(np.random.PCG64(20240229)).standard_normal((size, DIMS)).astype(np.float32)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer cells, one row each (Skilling's transform, on whole columns)."""
    x = [cells[:, d].astype(np.int64).copy() for d in range(cells.shape[1])]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for d in range(n):
            on = (x[d] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, n):
        x[d] ^= x[d - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | (((x[d] ^ t) >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert places of documents by the mean direction of their tokens."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    slots = ids & (len(table) - 1)
    sums = np.stack([np.add.reduceat(table[slots, d], starts, dtype=np.float64) for d in range(DIMS)], axis=1)
    means = sums / lengths[:, None]
    cells = ((np.tanh(3 * means) + 1) / 2 * (1 << BITS)).clip(0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells)


def binary_rows(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary value for each run of ``lengths`` numbers of ``data``."""
    edges = np.concatenate([[0], np.cumsum(lengths)]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def tokenized(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``place`` (place on the curve, then a hash of the row), ``n`` tokens and ``ids`` as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = word_tokenizer(path), _projection()
        for batch in batches:
            for part in text_runs(batch):
                ids, lengths = encoder.encode(part.column("text"))
                place = (curve_keys(ids, lengths, table) << SPREAD_BITS) | part.column("spread").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(place), pa.array(lengths), binary_rows(ids, lengths)], ["doc_id", "place", "n", "ids"])

    spread = F.xxhash64("doc_id", "text").bitwiseAND((1 << SPREAD_BITS) - 1)
    return documents.select("doc_id", "text", spread.alias("spread")).mapInArrow(run, "doc_id long, place long, n long, ids binary")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range and each document's first token in it; documents come in their order on the curve."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        first = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("ids"), pa.array(np.full(len(n), part, np.int64)), pa.array(first)], ["doc_id", "n", "ids", "range", "first"])


def pack(documents: DataFrame, path: str | None = None, length: int = LENGTH, digests_only: bool = False) -> DataFrame:
    """Pieces of documents with their sequence and offset in it.

    Documents are sorted along the curve in as many ranges as their tokens ask for. Each knows its first token within its
    range, and where a range starts follows from the tokens of those before it, a row a range; so documents are cut
    where they lie, each by itself.

    A null text is an empty one, and an empty document still has its end token. A repeated row is packed again, next to
    its twin. Very long texts are cut into as many pieces as they need. A document is cut only where a sequence ends.
    Sequence numbers and offsets have no gaps; every sequence but the last holds exactly ``length`` tokens. ``ids`` holds
    a piece's tokens as little-endian 32-bit numbers, or is left out with ``digests_only``. Other columns of ``documents``
    aren't read; no rows give no pieces."""
    spark = ship(documents.sparkSession)
    path = path or tokenizer_path()
    kind = word_tokenizer(path).type
    docs = written(tokenized(documents, path), "tokens")
    total = docs.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_TOKENS))
    along = docs.repartitionByRange(ranges, "place").sortWithinPartitions("place", "doc_id", "ids")
    ordered = written(along.mapInArrow(_numbered, "doc_id long, n long, ids binary, range long, first long"), "curve")
    discard(docs)
    # a row for each range
    sums = {r["range"]: r["n"] for r in ordered.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    tokens = np.zeros(max(sums, default=0) + 1, np.int64)
    tokens[list(sums)] = list(sums.values())
    before = spark.sparkContext.broadcast(np.cumsum(tokens) - tokens)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(i, 250) for batch in batches for i in range(0, batch.num_rows, 250))  # bounds what is held
        for batch in parts:
            out: list[tuple] = []
            first = (before.value[batch.column("range").to_numpy()] + batch.column("first").to_numpy()).tolist()
            for doc_id, n, ids, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")), first, strict=True):
                tokens, start = np.frombuffer(ids, kind).astype("<u4"), 0
                while start < n:
                    size = min(n - start, length - at % length)
                    piece = tokens[start : start + size].tobytes()
                    out.append((doc_id, start, size, zlib.crc32(piece), n, at // length, at % length, None if digests_only else piece))
                    start, at = start + size, at + size
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), arrow.types, strict=True)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    arrow = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in names])
    found = ordered.mapInArrow(cut, ", ".join(f"`{c}` {'binary' if c == 'ids' else 'long'}" for c in names))
    return found.drop("ids") if digests_only else found
