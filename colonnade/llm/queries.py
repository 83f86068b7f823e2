"""Registered queries of this subpackage: name -> function(spark, sf_dir)."""

from __future__ import annotations

from importlib import import_module

from colonnade.runtime import ship_package


def _query(name: str):
    """A query whose module is imported when it runs: workers load only what they use."""

    def run(spark, sf_dir):
        ship_package(spark)
        return getattr(import_module("colonnade.llm.contracts"), name)(spark, sf_dir)

    run.__name__ = name
    return run


NAMES = [
    "op1_document_fingerprints",
    "op2_quality_bradley_terry",
    "op3_content_addressed_tokens",
    "op4_pii_bilstm_crf",
    "op5_weighted_minhash",
    "op6_spaced_seed_decontamination",
    "op7_license_set_join",
    "op8_hilbert_shards",
    "op9_markov_secrets",
    "op10_golden_ratio_mix",
]


def queries() -> dict:
    return {name: _query(name) for name in NAMES}


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Brute force over all pairs that share a shingle; components by reachability.
_OP5 = rf"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
  runs AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM docs),
  tf AS (SELECT doc_id, g, count(*) AS n FROM runs GROUP BY doc_id, g),
  df AS (SELECT g, count(*) AS d FROM tf GROUP BY g),
  weights AS (SELECT doc_id, g, (1 + ln(n)) * least(1, ln(1 + (SELECT count(*) FROM documents) / d) / ln(5)) AS x FROM tf JOIN df USING (g)),
  total AS (SELECT doc_id, sum(x) AS t FROM weights GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS p, b.doc_id AS q, sum(least(a.x, b.x)) AS o FROM weights a JOIN weights b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT p, q FROM pairs JOIN total x ON x.doc_id = p JOIN total y ON y.doc_id = q WHERE o >= 0.8 * (x.t + y.t - o)
    UNION SELECT a.doc_id, b.doc_id FROM docs a JOIN docs b ON a.text = b.text AND a.doc_id < b.doc_id),
  both_ways AS (SELECT p AS a, q AS b FROM links UNION SELECT q, p FROM links),
  reach(id, c) AS (SELECT doc_id, doc_id FROM docs UNION SELECT e.b, r.c FROM reach r JOIN both_ways e ON e.a = r.id),
  classes AS (SELECT id, min(c) AS class_id FROM reach GROUP BY id),
  copies AS (SELECT text, min(doc_id) AS copy_of FROM docs GROUP BY text)
  SELECT doc_id, class_id, copy_of, doc_id = class_id AS keep FROM docs JOIN classes ON id = doc_id JOIN copies USING (text)"""


def _op7() -> str:
    """Every line against every notice, as word lists."""
    import re

    from colonnade.llm.licenses import NOTICES, PHRASES, THRESHOLD

    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    notices = ", ".join(f"('{k}', {listed(sorted(set(re.findall(_WORD, v.lower()))))})" for k, v in NOTICES.items())
    phrases = ", ".join(f"('{v}', {listed(k.split())})" for k, v in PHRASES.items())
    return rf"""WITH docs AS (SELECT doc_id, {_LOW} AS t, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
  places AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) AS spot
    FROM docs, (VALUES {phrases}) AS p(label, phrase)),
  base AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
  lines AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{_WORD}')) AS held FROM
    (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs)),
  found AS (SELECT doc_id, label, max(len(list_intersect(held, words)) / len(words)) AS share
    FROM lines, (VALUES {notices}) AS n(label, words)
    WHERE len(list_intersect(held, words)) >= {THRESHOLD} * len(words) - 1e-9 GROUP BY doc_id, label),
  every_label AS (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM found),
  labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every_label GROUP BY doc_id),
  best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
  FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are tested against brute force."""
    return {"op5_weighted_minhash": _OP5, "op7_license_set_join": _op7()}


__all__ = ["NAMES", "oracle_sql", "queries"]
