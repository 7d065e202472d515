"""The registered queries of the training-data operators, and their SQL where SQL can express them.

Each reads its whole table, applies its operator with production parameters and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession

from arborscale.llm import align, audit, bestfit, chunkstore, decontaminate, hmm, langid, linkgraph, neardup, order, pack, shard, toxicity
from arborscale.llm._shared import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op7_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_bag_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.classes(table(spark, sf_dir, "documents"))


def op2_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document."""
    return hmm.score(table(spark, sf_dir, "documents"))


def op3_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.predict(table(spark, sf_dir, "documents"))


def op8_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_feistel_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The materialised training order of all documents."""
    return order.training_order(table(spark, sf_dir, "documents"))


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens along the curve."""
    return pack.pack(table(spark, sf_dir, "documents"), digests_only=True)


def op4_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    return shard.shard(table(spark, sf_dir, "documents"))


def op9_link_graph_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return linkgraph.judge(table(spark, sf_dir, "pages"))


def op10_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload, stored in chunks and read back."""
    return chunkstore.media(table(spark, sf_dir, "documents"))


def op11_pointer_jumping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every document."""
    return align.links(table(spark, sf_dir, "documents"))


def op12_dominance_reduced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return bestfit.pack(table(spark, sf_dir, "documents"), digests_only=True)


def op13_trie_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders over all documents."""
    return audit.audit(audit.flags(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bag_minhash_near_duplicates": op1_bag_minhash_near_duplicates,
    "op2_hidden_markov_scores": op2_hidden_markov_scores,
    "op3_compression_language": op3_compression_language,
    "op4_bounded_ring_shards": op4_bounded_ring_shards,
    "op5_feistel_training_order": op5_feistel_training_order,
    "op9_link_graph_verdicts": op9_link_graph_verdicts,
    "op10_chunked_media": op10_chunked_media,
    "op6_hilbert_packing": op6_hilbert_packing,
    "op8_aho_corasick_decontamination": op8_aho_corasick_decontamination,
    "op7_kneser_ney_toxicity": op7_kneser_ney_toxicity,
    "op11_pointer_jumping_alignment": op11_pointer_jumping_alignment,
    "op12_dominance_reduced_packing": op12_dominance_reduced_packing,
    "op13_trie_filter_audit": op13_trie_filter_audit,
}

#: Words of both tables in order; each position is looked up among the item windows of the same text.
OP8_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM item, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT k FROM win),
hit AS (SELECT doc_id, p, win.k, item_id FROM (SELECT doc_id, i AS p, k, array_to_string(w[i : i + k - 1], ' ') AS win
    FROM doc, size, unnest(range(1, greatest(len(w) - k, -1) + 2)) AS t(i)) JOIN win USING (k, win)),
word AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM hit, unnest(range(0, k)) AS t(o) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""

def _propagated(name: str, edges: str, seeds: str) -> str:
    """The rounds of propagation as chained common table expressions."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT host, {seeds} * 0.15::DOUBLE AS r FROM h WHERE {seeds} > 0)", f"{name}s AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM {edges})"]
    for i in range(1, linkgraph.ROUNDS + 1):
        moved = f"SELECT dst AS host, 0.85::DOUBLE * sum(r * share) AS r FROM {name}{i - 1} JOIN {name}s ON host = src GROUP BY dst"
        steps.append(f"{name}{i} AS MATERIALIZED (SELECT host, sum(r) AS r FROM (FROM {name}0 UNION ALL {moved}) GROUP BY host)")
    return ", ".join(steps)


#: The rules as one CASE each, the longest first.
_BEST = sorted(linkgraph.RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
_FITS = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, _ in _BEST]
OP9_SQL = rf"""
WITH u AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
j AS (SELECT *, CASE {' '.join(f"WHEN {f} THEN '{r[0] + r[1]}'" for f, r in zip(_FITS, _BEST))} END AS rule, CASE {' '.join(f"WHEN {f} THEN '{r[2]}'" for f, r in zip(_FITS, _BEST))} END AS v FROM u),
h AS MATERIALIZED (SELECT host, count(*) FILTER (WHERE v = 'allow') / count(*) AS good, count(*) FILTER (WHERE v = 'block') / count(*) AS bad FROM j WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, translate(regexp_extract(unnest(regexp_extract_all(coalesce(html, ''), '(?i)(?:href|src)\s*=\s*["'']?([a-z][a-z0-9+.-]*://[^\s"''<>]+)', 1)), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM u),
p AS (SELECT host AS child, regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) AS up FROM h), k AS (SELECT child, up FROM p WHERE up IN (SELECT host FROM h)),
e AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM (FROM l UNION ALL SELECT child, up FROM k UNION ALL SELECT up, child FROM k) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL), back AS (SELECT dst AS src, src AS dst, w FROM e),
{_propagated('t', 'e', 'good')}, {_propagated('d', 'back', 'bad')},
b AS (SELECT d.host FROM d{linkgraph.ROUNDS} d LEFT JOIN t{linkgraph.ROUNDS} t USING (host) WHERE d.r > coalesce(t.r, 0) + 1e-9)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM b) THEN 'block' END, 'allow') AS verdict FROM j
"""

_STEPS = ", ".join(f"('{o}', {k + 1}, {audit.BITS[f]}, {sum(audit.BITS[g] for g in o[:k])})" for o in map("".join, permutations(audit.BITS)) for k, f in enumerate(o))
OP13_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
m AS (SELECT doc_id, part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > first_id THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
o(filter_order, step, bit, before) AS (VALUES {_STEPS}),
a AS (SELECT part, filter_order, step, bit,
    CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM h, o GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM a
"""

ORACLES: dict[str, str] = {"op9_link_graph_verdicts": OP9_SQL, "op8_aho_corasick_decontamination": OP8_SQL, "op13_trie_filter_audit": OP13_SQL}
