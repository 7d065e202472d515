"""Benchmark decontamination with one Aho-Corasick automaton.

Text is normalised to lower-case words with single spaces between. The windows of the benchmark items (ten consecutive
words, or a shorter item whole) are the patterns of one automaton; a document is scanned once, each match gives the
words that it covers, and the words are mapped back to their places in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborscale.llm._shared import remember_only, ship, unused

WINDOW = 10
#: Bytes that separate words: all of ASCII but digits and letters. Capital letters turn small.
SEPARATORS = [b for b in range(128) if not chr(b).isalnum()]
TABLE = bytes(32 if b in set(SEPARATORS) else b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of benchmark text that the automaton is built for at most. The benchmark is the stated query set and small beside
#: the corpus; a larger one is refused with an error before anything is read to the driver.
MOST_BYTES = 64 << 20


def normalised(text: str | None) -> str:
    """Words with one space between and around, a character a byte; empty without words."""
    words = (text or "").encode().translate(TABLE).split()
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def windows_of(text: str | None, window: int = WINDOW) -> set[str]:
    """The windows of an item, as patterns with a space before and after."""
    words = normalised(text).split(" ")[1:-1]
    return {f" {' '.join(words[i : i + window])} " for i in range(max(1, len(words) - window + 1))} if words else set()


class Scanner:
    """The automaton of all windows of a benchmark, built in each worker from the items that travel, and what it finds."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.items, self.window, self._automaton = items, window, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            patterns: dict[str, set] = {}
            for item, text in self.items:
                for pattern in windows_of(text, self.window):
                    patterns.setdefault(pattern, set()).add(item)
            self._automaton = ahocorasick.Automaton()
            for pattern, items in patterns.items():
                self._automaton.add_word(pattern, (len(pattern), tuple(i for i in items if i is not None)))
            self._automaton.make_automaton()
        return self._automaton

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """The number of words, the hit words as merged runs [from, to) of word numbers, and the items found."""
        clean = normalised(text)
        if not clean:
            return 0, [], set()
        spans, items = [], set()
        if len(self.automaton):
            for last, (length, found) in self.automaton.iter(clean):
                spans.append((last + 1 - length, last + 1))
                items.update(found)
        n_words = clean.count(" ") - 1
        runs: list[list[int]] = []
        at = word = 0
        for start, end in sorted(set(spans)):
            word, at = word + clean.count(" ", at, start), start
            stop = word + clean.count(" ", start, end) - 1
            if runs and word <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], stop)
            else:
                runs.append([word, stop])
        return n_words, [(a, b) for a, b in runs], items

    @staticmethod
    def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Runs of words as character offsets [from, to) in the original text."""
        data = text.encode()
        ends = [m.span() for m in WORD.finditer(data)]
        return [(len(data[: ends[a][0]].decode()), len(data[: ends[b - 1][1]].decode())) for a, b in runs]


def build(benchmark: DataFrame, window: int = WINDOW, limit: int = MOST_BYTES) -> Scanner:
    """The scanner for the items of ``benchmark`` (``item_id``, ``text``), whose size Spark measures first."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    if size > limit:
        raise ValueError(f"the benchmark has {size} bytes of text; {limit} are the most for one automaton")
    ship(benchmark.sparkSession)
    return Scanner([(r["item_id"], r["text"]) for r in items.toLocalIterator()], window)


def scan_column(scanner: Scanner, documents: DataFrame, text: str = "text") -> Column:
    """A struct of counts, item ids and the hit spans in characters of the original text."""
    shipped = documents.sparkSession.sparkContext.broadcast(scanner)
    kind = "n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<start:long,end:long>>"

    @F.arrow_udf(kind)
    def scanned(texts: pa.Array) -> pa.Array:
        remember_only("benchmark")
        out = []
        for text in texts.to_pylist():
            n, runs, items = shipped.value.scan(text)
            ids = ",".join(sorted(map(str, items)))
            spans = [{"start": a, "end": b} for a, b in Scanner.offsets(text, runs)] if runs else []
            out.append({"n_words": n, "n_hit": sum(b - a for a, b in runs), "n_items": len(items), "items_sha256": hashlib.sha256(ids.encode()).hexdigest(), "spans": spans})
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("spans", span)]))

    return scanned(text)


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``documents``: words, hit words, items whose windows occur, and the hit spans.

    A null or empty text has no words; an empty benchmark hits nothing; equal items count each under its own id. An item
    without an id hits words like any other, but isn't counted or listed. Repeated rows give repeated results; texts of
    any length are read whole; other columns aren't read; no rows give none."""
    found = documents.select("doc_id", scan_column(build(benchmark, window), documents).alias("s"))
    return found.select("doc_id", "s.*", (F.col("s.n_hit") > 0).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents``, all columns, without the rows in which a window of the benchmark occurs.

    Null and empty texts stay; repeated rows stay or go together; no rows give none."""
    name = unused(documents, "benchmark_hits")
    found = documents.withColumn(name, scan_column(build(benchmark, window), documents))
    return found.where(F.col(name)["n_hit"] == 0).drop(name)
