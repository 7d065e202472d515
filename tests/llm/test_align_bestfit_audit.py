"""Alignment, dominance-reduced packing and the filter audit against brute force, and their odd rows."""

import bisect
import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from arborscale.llm import align, audit, bestfit
from arborscale.llm.pack import byte_letters

DATA = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "foo\n\n  bar\n", "tab\there  x", "x▁y z", "<|endoftext|> <s> </s>", "日本語 テキスト です。", "emoji 🤦🏼‍♂️ ok",
    "é café", "it's  we'll\xa0nbsp  em", "1234567 89", "a" * 3000, "\x00nul \x1c sep", "ab " * 500, "\x85 next", "line\r\nline2 \r\n x", "a 　 b",
]


def documents(spark, rows, parts=3):
    """Documents with columns whose names clash with those that the operators make."""
    frame = spark.createDataFrame([(*r, 7, b"x", "y") for r in rows], "doc_id long, text string, lang string, length long, ids binary, part string")
    return frame.repartition(parts)


def sample(spark):
    return [(r[0] + 10_000, *r[1:]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]


def aligned(rows):
    """Groups from cuts that both sides share, links as all pairs of a group, counts over all rows."""
    a_side, b_side = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(byte_letters())}
    per, count, most = [], Counter(), defaultdict(int)
    for doc_id, text, *_ in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_side.id_to_piece(i)) for i in b)]
        whole, groups = f" {text}".encode(), []
        if text and b"".join(bytes_a) == whole == b"".join(bytes_b):
            ends_a, ends_b = (np.cumsum(list(map(len, x))).tolist() for x in (bytes_a, bytes_b))
            cuts = sorted(set(ends_a) & set(ends_b))
            groups = [([], []) for _ in cuts]
            for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
                for i, e in zip(ids, ends, strict=True):
                    groups[bisect.bisect_left(cuts, e)][side].append(i)
        else:
            a = b = []
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        count.update(set(links))
        per.append((doc_id, a, b, groups, links))
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    for doc_id, a, b, groups, links in per:
        form = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        yield doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(form.encode()).hexdigest() if a else ""


def test_links_are_those_of_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "a", None), (None, "a", None), (3, "a", None)] + sample(spark)
    got = sorted((tuple(r) for r in align.links(documents(spark, rows)).collect()), key=str)
    assert got == sorted(aligned(rows), key=str)


def test_groups_cover_the_bytes_and_counts_the_vocabularies(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)]
    for r in align.groups(documents(spark, rows)).collect():
        text = ODD[r.doc_id]
        if r.groups:
            assert [g.start for g in r.groups] == [0, *(g.end for g in r.groups[:-1])] and r.groups[-1].end == len(f" {text}".encode())
            assert Tokenizer.from_file(P.path("byte_bpe_50k.json")).decode([i for g in r.groups for i in g.a]) == " " + text or "<" in text
    pairs = align.pair_counts(documents(spark, [(1, "a", ""), (2, "a b", ""), (3, None, "")])).collect()
    assert sorted((p.documents, p.best) for p in pairs) == [(1, True), (2, True)]


def test_units_are_remembered_in_few_bytes():
    side = align.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    units = [f"{chr(97 + i % 26)}nit{i * 7919 % 100_003}" for i in range(20_000)]
    tracemalloc.start()
    side.learn(units)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 400 * len(units)


@pytest.mark.parametrize("few", [1, 40])
def test_blocks_dont_depend_on_the_runs_of_pairs(monkeypatch, few):
    texts = [*ODD, "a b a b it's", "\x85", None]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    rows = []
    for size in (align.RUN_PAIRS, few):
        monkeypatch.setattr(align, "RUN_PAIRS", size)
        rows.append(align._block(align.aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")), part, 3).to_pydict())
    assert rows[0] == rows[1] and len(rows[0]["sizes"][0]) == len(texts)


@pytest.mark.parametrize("seed", range(5))
def test_pointer_jumping_labels_components(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 300)
    ends_a, ends_b = (np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n})) for _ in range(2))
    cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    for ends, labels in zip((ends_a, ends_b), align.group_labels(ends_a, ends_b), strict=True):
        assert labels.tolist() == [bisect.bisect_left(cuts, e) for e in ends.tolist()]


def fewest(items, capacity):
    """The least number of sequences, by trying all packings."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            go(i + 1, rooms)
            rooms[k] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng, fixed_any = random.Random(5), 0
    for t in range(800):
        capacity = rng.randint(8, 40)
        items = [rng.randint(1 if t % 2 else capacity // 4 or 1, capacity) for _ in range(rng.randint(1, 9))]
        counts = dict(Counter(items))
        fixed, rest = bestfit.reduced(counts, capacity)
        left = [w for w, n in rest.items() for _ in range(n)]
        used = Counter(left) + Counter(w for found, n in fixed for w in found * n)
        assert dict(used) == counts and all(sum(found) <= capacity for found, _ in fixed)
        assert fewest(items, capacity) == sum(n for _, n in fixed) + fewest(left, capacity)
        fixed_any += bool(fixed)
    assert fixed_any > 400


def test_plan_fills_sequences_without_gaps_or_overlap():
    rng = np.random.default_rng(3)
    for high in (60, 400, 2048):
        lengths, n = np.unique(rng.integers(1, high + 1, 3000), return_counts=True)
        counts = dict(zip(lengths.tolist(), n.tolist(), strict=True))
        runs, sequences = bestfit.plan(counts)
        spans, ranks = defaultdict(list), Counter()
        for r in sorted(runs):
            assert r.rank == ranks[r.length]
            ranks[r.length] += r.n
            for k in range(r.n):
                at = r.offset + k % r.each * r.length
                spans[r.sequence + k // r.each].append((at, at + r.length))
        assert dict(ranks) == counts and sorted(spans) == list(range(sequences))
        for s in spans.values():
            s.sort()
            assert s[0][0] == 0 and all(x[1] == y[0] for x, y in zip(s, s[1:], strict=False)) and s[-1][1] <= bestfit.CAPACITY
        tokens = sum(k * v for k, v in counts.items())
        assert sequences <= (-(-tokens // bestfit.CAPACITY) + 1 if high <= 400 else 1.03 * tokens / bestfit.CAPACITY)


def test_packed_pieces_hold_every_id_once(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "a", None), (None, "a", None), (3, "a", None), (900, "word " * 9000, "x")] + sample(spark)
    encoder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter((d, tuple(encoder.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t, _ in rows)
    pieces = bestfit.pack(documents(spark, rows)).collect()
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32 and p.start == p.piece * bestfit.CAPACITY
        by_sequence[p.sequence_id].append((p.offset, p.offset + p.length))
        by_document[p.doc_id].append((p.piece, ids))
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= bestfit.CAPACITY
    total = sum(p.length for p in pieces)
    assert len(by_sequence) <= 1.02 * total / bestfit.CAPACITY + 1
    got = Counter()
    for d, found in by_document.items():
        if len({k for k, _ in found}) == len(found):
            got[d, tuple(i for _, ids in sorted(found) for i in ids)] += 1
        else:  # rows that share an id here are short
            got.update((d, tuple(ids)) for _, ids in found)
    assert got == want
    plain = bestfit.pack(documents(spark, rows), digests_only=True)
    assert "ids" not in plain.columns and plain.count() == len(pieces)


def masks(rows):
    """The failures of each row, word by word and text by text."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, lang in rows:
        text, words = t or "", (t or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")
        words = [w for w in words if w]
        yield d, lang or "", (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + 8 * any(c in "#$%&*|" for c in text) + 16 * (d is not None and d > least.get(text, d))


AUDITED = [(i, t, "x") for i, t in enumerate(ODD)] + [(50, "", None), (51, "ab " * 500, "x"), (40, "ab " * 500, "y"), (40, "ab " * 500, "y"), (None, "a", "x"), (60, "W " * 300, "x"), (61, "W " * 300 + "$", "x"), (2, "W " * 300, "z"), (3, "a\x1cb " * 250, "z")]


def test_flags_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE_BYTES", 40)  # many bounds, so that ranges part deep in texts
    rows = AUDITED + [(100 + i, "same header of a page " * 20 + str(i % 7), "h") for i in range(60)] + sample(spark)
    got = Counter((r.doc_id, r.part, r["mask"]) for r in audit.flags(documents(spark, rows, 5)).collect())
    assert got == Counter(masks(rows))


def test_audit_counts_orders_one_by_one(spark):
    labels = spark.createDataFrame([(1, 1, 0), (40, 1, 1), (40, 0, 0), (60, 1, None), (61, None, 1), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(audit.flags(documents(spark, AUDITED)), labels).collect()}
    good, toxic, found = {1, 40, 60}, {40, 61}, list(masks(AUDITED))
    for part in {p for _, p, _ in found}:
        mine, shapley = [(d, m) for d, p, m in found if p == part], Counter()
        expected = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                bit = audit.BITS[f]
                out, kept = [x for x in left if x[1] & bit], [x for x in left if not x[1] & bit]
                failing = [x for x in mine if x[1] & bit]
                shapley[f] += len(out)
                expected[order, k + 1, f] = len(kept), len(out), len(failing) - len(out), sum(x[1] == bit for x in mine), sum(x[0] in good for x in out), sum(x[0] in toxic for x in out)
                left = kept
        for (order, k, f), row in expected.items():
            assert got.pop((part, order, k)) == (*row, shapley[f])
    assert not got


def test_tries_hold_least_ids_and_part_neighbours():
    rng = random.Random(1)
    for _ in range(50):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(1, 60))]
        trie, least = audit.RadixTrie(), {}
        for i, t in enumerate(rng.sample(range(1000), len(texts))):
            t, i = texts[i], t
            node = trie.insert(t, i)
            node.number = 0
            least[t] = min(i, least.get(t, i))
        met = [(n, apart) for n, apart in trie.walk() if n.number >= 0]
        assert [n.least for n, _ in met] == [least[t] for t in sorted(least)]
        for (before, text), (_, apart) in zip(zip(["", *sorted(least)], sorted(least), strict=False), met, strict=True):
            assert text.startswith(apart) and (not before or before < apart)


@pytest.mark.parametrize("make", [align.links, align.groups, align.pair_counts, bestfit.pack, audit.flags])
def test_no_rows_give_no_rows(spark, make):
    assert make(documents(spark, [])).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.flags(documents(spark, [])), labels).count() == 0 if make is audit.flags else True
