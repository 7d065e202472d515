"""Alignment of two tokenizers over the same bytes, by pointer jumping.

Tokens of both sides are intervals of bytes. Every token points to its farthest-right overlapping token of the other side,
and a token whose end both sides share points to itself. Replacing each pointer by its pointer's pointer, on whole arrays,
doubles the stretch that it spans, so after a logarithmic number of steps each token points to the last token of its
connected component, which labels the group. An id pair is linked in a document when a token of each lies in one group.

Both tokenizers always cut before a space between two characters that aren't white space, so texts are aligned a unit (a
stretch between such spaces) at a time, and a worker remembers units that it has met. Tokenizers for which this can't be shown
from their files get whole texts as units.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborscale.llm._shared import discard, remember_only, ship, written
from arborscale.llm.pack import byte_letters, text_runs, tokenizer_path

#: Files of side A (a ``tokenizers`` file with byte-level letters) and side B (a ``sentencepiece`` model).
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block, and units that a worker remembers before it starts anew.
BLOCK_BYTES, MEMO_UNITS = 4_000_000, 250_000
#: Bytes of new units that are encoded together.
ENCODE_BYTES = 300_000
#: Pairs of documents that are put in order together.
RUN_PAIRS = 250_000
#: Groups with more links than this are first reduced to their distinct ids.
PLAIN_LINKS = 64
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The splitter of byte-level tokenizer files (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE_CUT = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")
ODD_SPACE = f"^[{_WS}]|[{_WS}][{_WS}]|[{_WS}]$"


def group_labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group number of each token of both sides, whose ends in bytes are given, ascending, with the same last end."""
    n = len(ends_a)
    over_a = n + np.searchsorted(ends_b, ends_a)  # the token of B that holds the last byte of this one
    over_b = np.searchsorted(ends_a, ends_b)
    last = ends_a[over_b] == ends_b
    successor = np.concatenate([over_a, np.where(last, n + np.arange(len(ends_b)), over_b)])
    while True:
        far = successor[successor]
        if np.array_equal(far, successor):
            break
        successor = far
    number = np.cumsum(last) - 1
    return number[successor[:n] - n], number[successor[n:] - n]


def expand(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.size = np.empty(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        upto = self.size + len(values)
        if upto > len(self.data):
            grown = np.empty(upto + upto // 4, self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : upto] = values
        self.size = upto


#: Of a unit: tokens of both sides, groups, links.
FIGURES = ("n_a", "n_b", "n_groups", "n_links")


class Units:
    """What is remembered of units: their numbers, and by number on shared arrays the figures, the groups as text, and the
    distinct linked pairs with how often each occurs. A short unit takes some 280 bytes. Number 0 stands where a text has no tokens."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.figures = {c: Growing(np.int64) for c in FIGURES}
        self.text, self.pairs, self.times = bytearray(), Growing(np.int64), Growing(np.uint32)
        self.text_ends, self.pair_ends = Growing(np.int64), Growing(np.int64)
        self.add([], {c: np.zeros(1, np.int64) for c in FIGURES}, b"", np.zeros(1, np.int64), self.pairs.data[:0], self.times.data[:0], np.zeros(1, np.int64))

    def add(self, units: list[str], figures: dict[str, np.ndarray], text: bytes, text_sizes: np.ndarray, pairs: np.ndarray, times: np.ndarray, pair_sizes: np.ndarray) -> None:
        self.numbers.update(zip(units, range(self.text_ends.size, self.text_ends.size + len(units)), strict=True))
        self.text_ends.add(len(self.text) + np.cumsum(text_sizes))
        self.pair_ends.add(self.pairs.size + np.cumsum(pair_sizes))
        self.text += text
        self.pairs.add(pairs)
        self.times.add(times)
        for c in FIGURES:
            self.figures[c].add(figures[c])

    def texts_of(self, numbers: np.ndarray) -> list[bytes]:
        """The groups of each unit as text."""
        ends = self.text_ends.data
        with memoryview(self.text) as text:
            return [bytes(text[lo:hi]) for lo, hi in zip(ends[np.maximum(numbers - 1, 0)].tolist(), ends[numbers].tolist(), strict=True)]

    def pairs_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of all these units one after the other, their occurrences, and how many each unit has."""
        starts = self.pair_ends.data[np.maximum(numbers - 1, 0)]
        many = self.pair_ends.data[numbers] - starts
        at = np.repeat(starts, many) + expand(many)
        return self.pairs.data[at], self.times.data[at].astype(np.int64), many


class Aligner:
    """Both tokenizers, and the units that this worker has met."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        size_a, size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = [bytes(letters.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(size_a)]
        pieces = [self.b.id_to_piece(i) for i in range(size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.size_b = size_b
        self.signs = [b"%d%c" % (i, sign) for i in range(max(size_a, size_b)) for sign in b",|;"]
        with open(a_path, encoding="utf-8") as f:
            how = json.load(f)
        first = how.get("pre_tokenizer") or {}
        plain = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True) and not how.get("normalizer")
        self.by_units = plain and all("▁" not in p[1:] or set(p) == {"▁"} for p in pieces)
        self.units = Units()
        self.fast = self._ranked(how) if plain else None

    def _ranked(self, how: dict) -> tiktoken.Encoding | None:
        """The same vocabulary by ranks, five times as fast on short units, if its merges stand in the order of their ids."""
        model = how["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        made = [model["vocab"].get("".join(p), -1) for p in pairs]
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {self.bytes_a[i]: i for token, i in model["vocab"].items() if token not in added}
        whole = len(ranks) == 256 + len(pairs) and all(bytes([b]) in ranks for b in range(256)) and made == sorted(set(made))
        if not whole or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return None
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.fast:
            return [self.fast.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of all texts one after the other, and how many each has."""
        if not self.by_units:
            return texts, np.ones(len(texts), np.int64)
        if pc.any(pc.match_substring_regex(texts, ODD_SPACE)).as_py():
            parts = pa.array([SAFE_CUT.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            parts = pc.split_pattern(texts, " ")
        return parts.flatten(), pc.list_value_length(parts).to_numpy()

    def learn(self, new: list[str]) -> None:
        """Encode and align units not met before; those whose bytes a side doesn't give back get number 0."""
        run, size = [], 0
        for unit in new:
            run.append(unit)
            size += len(unit)
            if size > ENCODE_BYTES:
                self._learn(run)
                run, size = [], 0
        if run:
            self._learn(run)

    def _learn(self, units: list[str]) -> None:
        found_a = self.encode_a([" " + u for u in units])
        found_b = self.b.encode(units, num_threads=1)
        good = []
        for unit, a, b in zip(units, found_a, found_b, strict=True):
            whole = b" " + unit.encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b)):
                good.append((unit, a, b))
            else:
                self.units.numbers[unit] = 0
        if not good:
            return
        n_a, n_b = (np.array([len(g[k]) for g in good], np.int64) for k in (1, 2))
        a, b = (np.fromiter(chain.from_iterable(g[k] for g in good), np.int64) for k in (1, 2))
        group_a, group_b = group_labels(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        count_a, count_b = np.bincount(group_a), np.bincount(group_b)
        edges = np.concatenate([[0], group_b[np.cumsum(n_b) - 1] + 1])  # of the groups of each unit
        pairs, times, links, of_unit = self.links(a, b, group_a, group_b, edges)
        # tokens in the order of the text form, each with the sign that follows it
        upto_a, upto_b = np.cumsum(count_a), np.cumsum(count_b)
        code = np.empty(len(a) + len(b), np.int64)
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[upto_a - 1], end_b[upto_b - 1] = 1, 2
        code[np.arange(len(a)) + (upto_b - count_b)[group_a]] = a * 3 + end_a
        code[np.arange(len(b)) + upto_a[group_b]] = b * 3 + end_b
        signs = list(map(self.signs.__getitem__, code.tolist()))
        # the sign that ends a unit is left out
        cuts = np.cumsum(n_a + n_b)
        for last in (cuts - 1).tolist():
            signs[last] = signs[last][:-1]
        sizes = np.add.reduceat(np.fromiter(map(len, signs), np.int64, len(signs)), np.concatenate([[0], cuts[:-1]]))
        figures = dict(zip(FIGURES, (n_a, n_b, np.diff(edges), links), strict=True))
        self.units.add([g[0] for g in good], figures, b"".join(signs), sizes, pairs, times, np.diff(of_unit))

    def links(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct linked id pairs of each unit, as ``a * size_b + b``, how many occurrences each has, all links of each unit, and
        where each unit's pairs begin. ``edges`` bound the groups of a unit."""
        weight_a, weight_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
        if (np.bincount(of_a) * np.bincount(of_b)).max() > PLAIN_LINKS:
            (of_a, a), weight_a = np.unique(np.stack([of_a, a]), axis=1, return_counts=True)
            (of_b, b), weight_b = np.unique(np.stack([of_b, b]), axis=1, return_counts=True)
        n_b = np.bincount(of_b)
        reps = n_b[of_a]
        with_b = np.repeat((np.cumsum(n_b) - n_b)[of_a], reps) + expand(reps)
        pair, weight = np.repeat(a, reps) * self.size_b + b[with_b], np.repeat(weight_a, reps) * weight_b[with_b]
        unit = np.searchsorted(edges, np.repeat(of_a, reps), side="right") - 1
        order = np.lexsort((pair, unit))
        pair, unit, weight = pair[order], unit[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (unit[1:] != unit[:-1])]))
        times = np.add.reduceat(weight, first)
        return pair[first], times, np.bincount(unit, weights=weight).astype(np.int64), np.searchsorted(unit[first], np.arange(len(edges)))

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of the distinct units of the texts, the places among these of all texts' units one after the other, and how
        many each text has; a text with no tokens has none. Numbers hold until the next call."""
        texts = texts.fill_null("")
        flat, sizes = self.split(texts)
        known = flat.dictionary_encode()
        distinct = known.dictionary.to_pylist()
        if len(self.units.numbers) > MEMO_UNITS:
            self.units = Units()
        numbers = self.units.numbers
        self.learn([u for u in distinct if u not in numbers])
        units = np.fromiter(map(numbers.__getitem__, distinct), np.int64, len(distinct))
        codes = known.indices.to_numpy().astype(np.int64)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        bad = (units == 0)[codes]
        starts = np.cumsum(sizes) - sizes
        odd = np.add.reduceat(bad, starts) > 0 if len(sizes) else np.zeros(0, bool)
        if (odd | empty).any():
            pieces, more = [], []
            for i, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
                piece = codes[start : start + size]
                if empty[i]:
                    piece = piece[:0]
                elif odd[i]:  # the whole text as it is decides
                    whole = texts[i].as_py()
                    if whole not in numbers:
                        self.learn([whole])
                    piece = np.full(int(numbers[whole] > 0), len(units) + len(more), np.int64)
                    more += [numbers[whole]] * len(piece)
                pieces.append(piece)
            units = np.append(units, np.array(more, np.int64))
            sizes = np.array(list(map(len, pieces)), np.int64)
            codes = np.concatenate(pieces) if pieces else codes
        return units, codes, sizes


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One a worker process, until another operator begins there."""
    remember_only("units", _ALIGNERS.clear)
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def groups(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``doc_id`` and ``groups``: for each group its ``start`` and ``end`` in bytes of a space and the text, and the ids of both
    tokenizers.

    A null or empty text, and one that a tokenizer doesn't give back byte for byte, has an empty list. Rows stand for
    themselves: repeated ones are aligned again, ids may be null. Very long texts are aligned whole. Other columns aren't read;
    no rows give no rows."""
    ship(documents.sparkSession)
    paths = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = aligner(*paths)
        for batch in batches:
            for part in text_runs(batch, limit=BLOCK_BYTES // 8):
                units, codes, sizes = side.coded(part.column("text"))
                texts, out, at = side.units.texts_of(units), [], 0
                for size in sizes.tolist():
                    rows, end = [], 0
                    for group in (g for c in codes[at : at + size].tolist() for g in texts[c].split(b";")):
                        a, b = (list(map(int, ids.split(b","))) for ids in group.split(b"|"))
                        start, end = end, end + int(side.length_a[a].sum())
                        rows.append({"start": start, "end": end, "a": a, "b": b})
                    at += size
                    out.append(rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], ["doc_id", "groups"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>")


_BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, pairs array<long>, held array<long>, sizes array<long>, entry binary, times binary"


def _runs_of(doc: np.ndarray, weights: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Slices of entries, in the order of their ``n`` documents, that hold whole documents and ``RUN_PAIRS`` of weight at most, or
    one document."""
    first = np.searchsorted(doc, np.arange(n + 1))
    upto, at = np.concatenate([[0], np.cumsum(weights)])[first], 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + RUN_PAIRS, side="right")) - 1)
        yield int(first[at]), int(first[end])
        at = end


def _block(side: Aligner, part: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """The row of a block."""

    def summed(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values[codes])])
        return upto[starts + sizes] - upto[starts]

    units, codes, sizes = side.coded(part.column("text"))
    starts, n = np.cumsum(sizes) - sizes, len(sizes)
    figures, texts = [summed(side.units.figures[c].data[units]) for c in FIGURES], side.units.texts_of(units)
    sha = [hashlib.sha256(b";".join(map(texts.__getitem__, codes[s : s + k].tolist()))).hexdigest() if k else "" for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)]
    del texts
    # distinct units of a document, then its distinct pairs
    used, times = np.unique(np.repeat(np.arange(n), sizes) * max(1, len(units)) + codes, return_counts=True)
    doc, unit = np.divmod(used, max(1, len(units)))
    all_pairs, all_times, many = side.units.pairs_of(units)
    pairs, place = np.unique(all_pairs, return_inverse=True)
    begin, found = np.cumsum(many) - many, []
    for lo, hi in _runs_of(doc, many[unit], n):
        reps = many[unit[lo:hi]]
        at = np.repeat(begin[unit[lo:hi]], reps) + expand(reps)
        key, back = np.unique(np.repeat(doc[lo:hi], reps) * max(1, len(pairs)) + place[at], return_inverse=True)
        total = np.bincount(back, weights=np.repeat(times[lo:hi], reps) * all_times[at], minlength=len(key))
        of, entry = np.divmod(key, max(1, len(pairs)))
        found.append((of.astype(np.int32), entry.astype(np.uint32), total.astype(np.uint32)))
    of, entry, total = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint32) for k in range(3))
    row = [number, part.column("doc_id"), *figures, sha, pairs, np.bincount(entry, minlength=len(pairs)), np.bincount(of, minlength=n), entry.tobytes(), total.tobytes()]
    arrays = [pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) if isinstance(v, (int, bytes)) else _listed(v) for v in row]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _BLOCK.split(", ")])


def _blocks(documents: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """A row for each few megabytes of text: what its documents have by themselves, its distinct pairs with the number of its
    documents that hold them, and for each document the places of its pairs in that list with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, side = TaskContext.get().partitionId() << 32, aligner(*paths)
        for part in (p for batch in batches for p in text_runs(batch, limit=BLOCK_BYTES)):
            yield _block(side, part, number)
            number += 1

    return documents.select("doc_id", "text").mapInArrow(run, _BLOCK)


def _listed(values) -> pa.Array:
    """One row with all ``values`` as its list."""
    flat = values if isinstance(values, pa.Array) else pa.array(values, pa.string() if isinstance(values, list) else pa.int64())
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _counted(blocks: DataFrame, size_b: int) -> DataFrame:
    """``pair``, ``n`` documents that hold it, and whether no pair of its A id has more. Blocks have summed their documents."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("p.pairs", "p.held")
    counts = written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n")).withColumn("a", F.expr(f"pair div {size_b}")), "pair-counts")
    most = counts.groupBy(F.col("a").alias("of_a")).agg(F.max("n").alias("most"))
    return counts.join(most, F.col("a") == F.col("of_a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def pair_counts(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``a_id``, ``b_id``, the number of ``documents`` in which they are linked, and ``best``: no other id of B is linked to the A id
    in more. A map between the vocabularies. Texts are taken as in ``groups``."""
    ship(documents.sparkSession)
    paths = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)
    size_b = aligner(*paths).size_b
    found = _counted(_blocks(documents, paths), size_b)
    return found.select(F.expr(f"pair div {size_b}").alias("a_id"), (F.col("pair") % size_b).alias("b_id"), F.col("n").alias("documents"), "best")


def links(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """For each row its tokens of both sides, groups and links, how many links are of a pair that holds most documents of its A id
    (ties included), the sum of its links' document counts, and a digest of its groups.

    Texts are taken as in ``groups``: those without tokens have zeros and an empty digest. Each row counts as a document of
    its own. Counts cover all rows: blocks sum their own documents first, pairs are summed by Spark, and each block gets
    the counts of its own pairs back, so no row of a document and pair is ever shuffled."""
    ship(documents.sparkSession)
    paths = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)
    blocks = written(_blocks(documents, paths), "aligned")
    counted = _counted(blocks, aligner(*paths).size_b)
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair")).join(counted, "pair")
    answers = asked.select(F.col("block").alias("of_block"), "place", (F.col("n") * 2 + F.col("best").cast("long")).alias("told"))
    result = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def joined(rows: pa.Table, told: pa.Table) -> pa.Table:
        out = [pa.table({c: pa.array([], pa.string() if c == "groups_sha256" else pa.int64()) for c in result})]
        value = np.zeros(told.num_rows, np.int64)
        value[told.column("place").to_numpy()] = told.column("told").to_numpy()
        for r in rows.select(["sizes", "entry", "times"]).to_pylist():
            entry, times = (np.frombuffer(r[c], np.uint32).astype(np.int64) for c in ("entry", "times"))
            upto = np.concatenate([[0], np.cumsum(r["sizes"])])
            sums = [np.concatenate([[0], np.cumsum(times * x[entry])]) for x in (value & 1, value >> 1)]
            best, total = (s[upto[1:]] - s[upto[:-1]] for s in sums)
            lists = [rows.column(c).combine_chunks().flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha")]
            out.append(pa.Table.from_arrays([*lists[:5], pa.array(best), pa.array(total), lists[5]], result))
        return pa.concat_tables(out)

    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in result)
    return blocks.drop("pairs", "held").groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(joined, schema)
