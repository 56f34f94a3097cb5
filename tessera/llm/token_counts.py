"""Token counts by a compiled finite-state machine.

The tokenizer's cut into pieces and its merges are one deterministic machine
over the characters of the normalised text, made lazily: a state is where a
piece stands (inside letters, inside marks, after an apostrophe), the state of
the merges' transducer (transducer.py) before the piece's last symbol, and
that symbol, which may still become the piece's final one. Each transition is
annotated with the number of tokens that it emits; ids are never made.

A text is cut into chunks. Each chunk has a state map: from the state at its
left edge to the state at its right edge and the tokens emitted between. White
space leads from every state to the start, so a map is the characters up to
the chunk's first white space, which the left state has to walk, and a count
and a right state that don't depend on it. Maps compose associatively, and a
text's count is their prefix scan, taken pair by pair; texts of any length go
this way.

Defined cases: a null or empty text has no tokens; equal rows have equal
counts, each its own row; texts may be of any length (a chunk's map is as
small for a long text as for a short one); other columns aren't read; an empty
table gives an empty one.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches, texts_of
from .transducer import MergeTransducer
from .units import Generations

#: Characters of a chunk, and states that are kept (past this only the last two live on).
CHUNK, MAX_STATES = 1 << 16, 100_000
#: Where a piece stands: none is open, in letters, in marks, after an apostrophe that may begin a contraction (and its next letter).
NONE, LETTERS, MARKS, APOSTROPHE = range(4)
#: The contractions of the pattern, and the pattern.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
PATTERN = CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT, LONG = frozenset(x[1] for x in CONTRACTIONS.split("|") if len(x) == 2), {x[1]: x[2] for x in CONTRACTIONS.split("|") if len(x) == 3}
#: Controls that str.split() takes as white space but the pattern's \\s doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
SPACE, SPACES = regex.compile(r"\s").search, regex.compile(r"\s").split
#: A state: where the piece stands, the letter after an apostrophe, the transducer's state, the symbol that waits.
State = tuple[int, str, tuple, str]


class StateMap(NamedTuple):
    """head: what the left state walks; then, if the chunk has white space (cut), count more tokens and the state at the right edge."""

    head: str
    cut: bool
    count: int
    right: State


class WordBPE:
    """Counts of one tokenizer file with word ends, read from its JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split")
        if pattern != PATTERN:
            raise ValueError(f"the machine is made for another pattern than {pattern}")
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.special_cut = regex.compile("|".join(map(regex.escape, self.special)))
        to_byte = self.byte_letters()
        symbols = lambda s: "".join(chr(to_byte[c]) for c in s)
        final = lambda s: (x := symbols(s.removesuffix(self.end)))[:-1] + chr(256 + ord(x[-1])) if s.endswith(self.end) else symbols(s)
        tokens = {final(s): i for s, i in model["vocab"].items() if s not in self.special}
        pairs = [tuple(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        ranks = {(final(a), final(b)): k for k, (a, b) in enumerate(pairs)}
        self.transducer = MergeTransducer(tokens, lambda a, b: ranks.get((a, b)))
        self.first = self.transducer.states[0]
        self.start: State = (NONE, "", self.first, "")
        self.kinds: dict[str, int] = {}
        self.values: list[State] = []
        self.numbers: dict[State, int] = {}
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.number(self.start)
        # A word between white space leads from the start back to it: its transitions as one, with their count.
        self.words = Generations(self.word)

    @staticmethod
    def byte_letters() -> dict[str, int]:
        """The letters that stand for bytes: printable ones for themselves, others from code point 256 on."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}

    def number(self, state: State, after: int = -1) -> int:
        """The state's number; one past the bound takes a spare number that isn't the one before it."""
        n = self.numbers.get(state)
        if n is None:
            n = len(self.numbers)
            if n >= MAX_STATES:
                n += after == n
            else:
                self.numbers[state] = n
            while len(self.values) <= n:
                self.values.append(state)
                self.steps.append({})
            self.values[n], self.steps[n] = state, {}
        return n

    def kind(self, c: str) -> int:
        """LETTERS, MARKS, NONE for white space, or APOSTROPHE for a number, which is a piece by itself."""
        found = self.kinds.get(c)
        if found is None:
            found = self.kinds[c] = NONE if regex.match(r"\s", c) else LETTERS if regex.match(r"\p{L}", c) else APOSTROPHE if regex.match(r"\p{N}", c) else MARKS
        return found

    def closing(self, state: State) -> int:
        """Tokens that a state's open piece still emits if it ends here."""
        where, letter, members, waits = state
        if where == NONE:
            return 0
        n = len(self.transducer.ends(members, chr(256 + ord(waits)))[1])
        return n + (self.closing((LETTERS, "", self.first, letter)) if letter else 0)

    def longer(self, members: tuple, waits: str, c: str) -> tuple[tuple, str, int]:
        """The piece with one more character: transducer's state, waiting symbol, tokens emitted."""
        n = 0
        for symbol in c.encode().decode("latin-1"):
            if waits:
                members, emitted = self.transducer.follow(members, waits)
                n += len(emitted)
            waits = symbol
        return members, waits, n

    def follow(self, state: State, c: str) -> tuple[State, int]:
        """The state after a character, and the tokens emitted."""
        where, letter, members, waits = state
        kind = self.kind(c)
        if letter:
            if kind == LETTERS and c == LONG[letter]:
                members, waits, n = self.longer(members, waits, letter)
                members, waits, more = self.longer(members, waits, c)
                return self.start, n + more + self.closing((LETTERS, "", members, waits))
            # No contraction: the apostrophe was a piece, and the letter begins another.
            after, n = self.follow((LETTERS, "", self.first, letter), c)
            return after, n + self.closing((MARKS, "", members, waits))
        if where == APOSTROPHE and kind == LETTERS:
            if c in SHORT:
                members, waits, n = self.longer(members, waits, c)
                return self.start, n + self.closing((LETTERS, "", members, waits))
            if c in LONG:
                return (APOSTROPHE, c, members, waits), 0
        if kind == MARKS and where in (MARKS, APOSTROPHE) or kind == where == LETTERS:
            members, waits, n = self.longer(members, waits, c)
            return (kind, "", members, waits), n
        n = self.closing(state)
        if kind == NONE:
            return self.start, n
        members, waits, more = self.longer(self.first, "", c)
        if kind == APOSTROPHE:
            return self.start, n + more + self.closing((LETTERS, "", members, waits))
        return (APOSTROPHE if c == "'" else kind, "", members, waits), n + more

    def step(self, at: int, c: str) -> tuple[int, int]:
        after, n = self.follow(self.values[at], c)
        out = self.number(after, at), n
        if max(at, out[0]) < MAX_STATES:
            self.steps[at][c] = out
        return out

    def word(self, word: str) -> int:
        state, n = self.walk(self.start, word)
        return n + self.closing(state)

    def walk(self, state: State, text: str) -> tuple[State, int]:
        """The state after the text, and the tokens emitted on the way."""
        at, total = self.number(state), 0
        for c in text:
            found = self.steps[at].get(c)
            at, n = found if found is not None else self.step(at, c)
            total += n
        return self.values[at], total

    def chunk(self, text: str) -> StateMap:
        first = SPACE(text)
        if not first:
            return StateMap(text, False, 0, self.start)
        text, head = text[first.end() :], text[: first.end()]
        if any(c in text for c in SEPARATORS):
            *words, rest = SPACES(text)
        else:
            words = text.split()
            rest = words.pop() if words and not text[-1].isspace() else ""
        right, count = self.walk(self.start, rest)
        return StateMap(head, True, sum(map(self.words.__getitem__, words)) + count, right)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if not a.cut:
            return StateMap(a.head + b.head, b.cut, b.count, b.right)
        right, n = self.walk(a.right, b.head)
        return StateMap(a.head, True, a.count + n + b.count, b.right if b.cut else right)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """Composes neighbours pair by pair, level by level, as a parallel scan would."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings, after the file's normalisation."""
        # Lower-casing goes letter by letter, so a final sigma is like any other.
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        whole = self.scan([self.chunk(low[k : k + CHUNK]) for k in range(0, len(low), CHUNK)] or [self.chunk("")])
        state, n = self.walk(self.start, whole.head)
        return n + (whole.count + self.closing(whole.right) if whole.cut else self.closing(state))

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token."""
        if any(s in text for s in self.special):
            return len(self.special_cut.findall(text)) + sum(map(self.plain, self.special_cut.split(text)))
        return self.plain(text)


@functools.lru_cache(2)
def counter(path: str) -> WordBPE:
    return WordBPE(path)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), for each row."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            n = [own.count(t) for t in batch.column(1).to_pylist()]
            size = pa.compute.cast(pa.compute.binary_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
