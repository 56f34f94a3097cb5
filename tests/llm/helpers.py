from __future__ import annotations

import random

#: Names that operators use inside, as extra columns of the input.
CLASHES = ("bucket", "kind", "data", "doc", "words", "h", "fingerprint", "n_tokens", "keep_0", "score", "held_out", "node", "spans", "kept")
EDGES = [None, "", " ", "\n\n", "a", "one two three", "x" * 20_000, "word " * 3_000, "Straße ñandú 日本語 😀", "tab\tand\r\nline", "  double  spaces ", "<|endoftext|> and <|startoftext|>", "a\x00b\x01c", "same text here", "same text here"]
WORDS = "the of and to river stone light walks under old trees when evening comes slowly down from hills where nobody lives any more than three days".split()


def passage(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) + str(rng.randint(0, 9) if rng.random() < 0.2 else "") for _ in range(n))


def frame(spark, texts, clash: bool = True, first: int = 0):
    """doc_id, text, and columns whose names clash with those that operators use."""
    extra = "".join(f", {c} string" for c in CLASHES) if clash else ""
    rows = [(first + k, t, *(["x"] * len(CLASHES) if clash else [])) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, bucket int")


def with_null_id(spark):
    return spark.createDataFrame([(None, "no id " * 30), (1, None), (1, "no id " * 30), (1, "no id " * 30)], "doc_id long, text string")


def corpus(seed: int, n: int = 60) -> list[str]:
    """Random texts with copies, near copies, shared passages and repeats inside one text."""
    rng = random.Random(seed)
    shared = [passage(rng, 40) for _ in range(3)]
    out = [passage(rng, rng.randint(1, 90)) for _ in range(n)]
    for k in range(0, n, 7):
        out.append(out[k])
    for k in range(3, n, 9):
        words = out[k].split()
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    for k in range(1, n, 6):
        out[k] = out[k] + "\n" + shared[k % 3] + " " + passage(rng, 5)
    out += ["ab" * 400, "loop " * 120, shared[0][:99], shared[0][:100], shared[1] + shared[1]]
    rng.shuffle(out)
    return out
