"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from .quality_rules import CLASS_LIMIT, CLASS_SHARES, CLASSES, COMMON_WORDS, LEAST_CHARS, LEAST_WORDS, RANKS, WORD_LIMIT

SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _distance(shares: list[str], reference: tuple[float, ...]) -> str:
    """The Jensen-Shannon distance of shares to a reference; the last share is the rest."""
    terms = [f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + {q} * log2(2 * {q} / ({p} + {q}))" for p, q in zip(shares, [*reference, round(1 - sum(reference), 6)])]
    return f"sqrt(greatest(0, ({' + '.join(terms)}) / 2))"


def quality_rules() -> str:
    counts = ", ".join(f"CAST(length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')) AS DOUBLE) / length(t) AS c_{name}" for name, p in CLASSES.items())
    bins = ", ".join(f"len(list_filter(words, lambda x: x IN ({', '.join(repr(w) for w in words.split()[a:b])}))) / CAST(len(words) AS DOUBLE) AS {lang}_{k}" for lang, words in COMMON_WORDS.items() for k, (a, b, _) in enumerate(RANKS))
    classes = [f"c_{c}" for c in CLASSES]
    classes.append(f"(1 - {' - '.join(classes)})")
    both = []
    for lang, shares in CLASS_SHARES.items():
        own = [f"{lang}_{k}" for k in range(len(RANKS))]
        words = _distance([*own, f"(1 - {' - '.join(own)})"], tuple(s for *_, s in RANKS))
        both.append(f"SELECT doc_id, {len(both)} AS lang, {_distance(classes, shares)} AS class_distance, {words} AS word_distance FROM long")
    nearest = f"greatest(class_distance / {CLASS_LIMIT}, word_distance / {WORD_LIMIT}), lang"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {SPLIT} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
base AS (SELECT d.doc_id, t, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
long AS (SELECT doc_id, {counts}, {bins} FROM base WHERE n_words >= {LEAST_WORDS} AND length(t) >= {LEAST_CHARS}),
every AS ({' UNION ALL '.join(both)}),
dist AS (SELECT doc_id, class_distance, word_distance FROM every QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {nearest}) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND coalesce(class_distance <= {CLASS_LIMIT} AND word_distance <= {WORD_LIMIT}, false) AS kept
FROM base LEFT JOIN dist USING (doc_id)"""


SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS w FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) / 2 AS BIGINT) - 99)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM rep)),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 100 AS b FROM run GROUP BY doc_id, r),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS aa, list(b ORDER BY a) AS bb FROM span GROUP BY doc_id),
kept AS (SELECT d.doc_id, x, n_spans, n_removed, CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(aa) + 1), lambda k: substr(x, 2 * CASE WHEN k = 0 THEN 0 ELSE bb[k] END + 1, 2 * (CASE WHEN k = len(aa) THEN CAST(length(x) / 2 AS BIGINT) ELSE aa[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE bb[k] END))), '') END AS y FROM d LEFT JOIN cut USING (doc_id))
SELECT doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(y)) AS kept_sha256 FROM kept"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM comp"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {SPLIT} AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM rep)),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM d),
left_over AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)"""

ORACLES = {"op1_quality_rules": quality_rules(), "op3_suffix_dedup": SUFFIX_DEDUP, "op5_embedding_dedup": EMBEDDING_DEDUP, "op10_substring_dedup": SUBSTRING_DEDUP}
