"""Quality rules by distribution divergence, in built-in expressions only.

A document's histogram of character classes and its histogram of common words
(three ranks of a language's most frequent words, and all others) are held
against references of each language by Jensen-Shannon distance (base 2, so
from 0 to 1). The nearest language is the one whose larger distance, as a share
of its limit, is least (the first, if equal); the document is kept if that one
language is within both limits. Below
the least lengths there is no verdict to give, and the document is not kept.

Everything is computed in the row: no shuffle, no Python. Three-word windows
are compared by a 64-bit hash of their words within one document.

Defined cases: a null text has no words, an empty one neither; both fail the
base rules. Equal rows give equal results; other columns aren't read; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most frequent words of each language, in order of frequency.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be this by are at from",
    "fr": "de la le et les des en un du une que est pour qui dans au sur par pas avec",
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als",
    "es": "de la que el en y los se del las un por con una no para es su al lo",
}
#: Ranks of the common words from and to, and their share of running text; the rest is all other words.
RANKS = ((0, 1, 0.050), (1, 4, 0.068), (4, 20, 0.096))
#: Shares of running text by character class, in the order of CLASSES; the rest is small letters and digits.
CLASS_SHARES = {
    "en": (0.014, 0.167, 0.0235, 0.0005, 0.001),
    "fr": (0.014, 0.167, 0.0240, 0.0005, 0.085),
    "de": (0.014, 0.156, 0.0215, 0.0005, 0.038),
    "es": (0.014, 0.161, 0.0225, 0.0005, 0.076),
}
#: Characters that are not of the class (regular expressions that both Java and RE2 read).
CLASSES = {
    "upper": r"[^\p{Lu}]+",
    "space": r"[^\x20\x09-\x0D]+",
    "stop": r"[^.,;:!?'\x22()\-]+",
    "symbol": r"[^#$%&*+/<=>@\[\]\\^_`{|}~]+",
    "wide": r"[\x00-\x7F\p{Lu}]+",
}
SYMBOLS = r"[^#*$%&|<>]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \\u0009\\u000A\\u000B\\u000C\\u000D"
#: Limits of the distances, least words (also the base rule's) and characters.
CLASS_LIMIT, WORD_LIMIT, LEAST_WORDS, LEAST_CHARS = 0.16, 0.30, 50, 200
#: Repeated windows of a document up to which they are looked up one after the other.
FEW = 64


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def distance(shares: list[str], reference: tuple[float, ...]) -> str:
    """SQL of the Jensen-Shannon distance between shares and a reference without zeros."""
    terms = []
    for p, q in zip(shares, reference):
        terms.append(f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q}D)) ELSE 0D END + {q}D * log2(2 * {q}D / ({p} + {q}D))")
    return f"sqrt(greatest(0D, ({' + '.join(terms)}) / 2))"


def with_rest(shares: tuple[float, ...]) -> tuple[float, ...]:
    return (*shares, round(1 - sum(shares), 6))


#: Windows of `words` that occur twice or more, as ascending starts. `let` binds an array once: a lambda's free expressions run for each element.
def let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


STARTS_FEW = "filter(sequence(0, size(h) - 1), i -> array_contains(r, h[i]))"
PAIRS = "sort_array(transform(h, (x, i) -> struct(x as h, i as i)))"
STARTS_MANY = let("s", PAIRS, "sort_array(transform(filter(s, (x, i) -> (i > 0 AND s[i - 1].h = x.h) OR (i < size(s) - 1 AND s[i + 1].h = x.h)), x -> x.i))")
REPEATS = let("s", "sort_array(h)", "array_distinct(filter(s, (x, i) -> i > 0 AND s[i - 1] = x))")
STARTS = let("r", REPEATS, f"CASE WHEN size(r) <= {FEW} THEN {STARTS_FEW} ELSE {STARTS_MANY} END")
COVERED = "aggregate(p, named_struct('last', -3, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)), a -> a.n)"
N_REPEAT = f"CASE WHEN size(h) = 0 OR size(array_distinct(h)) = size(h) THEN 0L ELSE {let('p', STARTS, COVERED)} END"


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept, and the columns of keep."""
    own = [f"keep_{k}" for k in range(len(keep))]
    count = lambda pattern: f"CAST(char_length(regexp_replace(text, {quoted(pattern)}, '')) AS BIGINT)"
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(k) for k, c in zip(own, keep)))
    rows = rows.selectExpr("doc_id", *own, "text", f"btrim(text, '{SPACES}') AS body", "CAST(char_length(text) AS BIGINT) AS n_chars", *(f"{count(p)} AS n_{c}" for c, p in CLASSES.items()), f"{count(SYMBOLS)} AS n_symbols")
    rows = rows.selectExpr("*", f"CASE WHEN body = '' THEN array() ELSE split(body, {quoted(SPACE)}) END AS words", f"filter(split(text, '\\n'), x -> btrim(x, '{SPACES}') <> '') AS lines")
    every = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
    listed = lambda words: ", ".join(map(quoted, words))
    rows = rows.selectExpr("doc_id", *own, "n_chars", *(f"n_{c}" for c in CLASSES), "n_symbols", "CAST(size(words) AS BIGINT) AS n_words", "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines", "CASE WHEN size(words) < 3 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END AS h", f"filter(words, w -> w IN ({listed(every)})) AS common")
    bins = [f"CAST(size(filter(common, w -> w IN ({listed(words.split()[a:b])}))) AS DOUBLE) AS {lang}_{k}" for lang, words in COMMON_WORDS.items() for k, (a, b, _) in enumerate(RANKS)]
    rows = rows.selectExpr("doc_id", *own, "n_chars", *(f"n_{c}" for c in CLASSES), "n_symbols", "n_words", "n_chars - n_space AS word_chars", "n_dup_lines", f"{N_REPEAT} AS n_repeat_words", *bins)
    rows = rows.selectExpr("*", f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed", f"n_words < {LEAST_WORDS} OR n_chars < {LEAST_CHARS} AS too_short")
    # An empty text has no shares: null, rather than a division by zero.
    classes = [f"(n_{c} / nullif(n_chars, 0))" for c in CLASSES]
    classes.append(f"((n_chars - {' - '.join(f'n_{c}' for c in CLASSES)}) / nullif(n_chars, 0))")
    by_class = [f"{distance(classes, with_rest(shares))} AS class_{lang}" for lang, shares in CLASS_SHARES.items()]
    by_word = []
    for lang in COMMON_WORDS:
        ranks = [f"{lang}_{k}" for k in range(len(RANKS))]
        by_word.append(f"""{distance([f"({c} / nullif(n_words, 0))" for c in (*ranks, f"(n_words - {' - '.join(ranks)})")], with_rest(tuple(share for *_, share in RANKS)))} AS word_{lang}""")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = rows.selectExpr("doc_id", *own, *counts, "too_short", *by_class, *by_word)
    of = {lang: f"greatest(class_{lang} / {CLASS_LIMIT}D, word_{lang} / {WORD_LIMIT}D)" for lang in COMMON_WORDS}
    rows = rows.selectExpr("*", f"least({', '.join(of.values())}) AS nearest")
    pick = lambda kind: "CASE WHEN too_short THEN NULL " + " ".join(f"WHEN {x} <= nearest THEN {kind}_{lang}" for lang, x in of.items()) + " END"
    rows = rows.selectExpr("doc_id", *own, *counts, f"{pick('class')} AS class_distance", f"{pick('word')} AS word_distance")
    # The partition's number (always 0 or more) keeps a filter on the verdict above this projection: pushed below
    # it, the filter would hold every expression written out, and lambdas would run their arrays anew for each element.
    rows = rows.selectExpr("*", f"NOT base_failed AND coalesce(class_distance <= {CLASS_LIMIT} AND word_distance <= {WORD_LIMIT}, false) AND spark_partition_id() >= 0 AS kept")
    return rows.select(*(c for c in rows.columns if c not in own), *(F.col(k).alias(c) for k, c in zip(own, keep)))
