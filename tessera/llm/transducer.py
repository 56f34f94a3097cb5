"""Byte-pair merges as a lazily determinised finite-state transducer.

Two adjacent tokens can stand next to each other exactly if merging their
joined symbols gives back those two tokens, and a sequence whose neighbours
all agree in this way is the one that the merges give. So every prefix has
one tokenization, and the tokenization of a longer prefix extends the one of
some shorter prefix by one token. A state is the set of prefixes that a later
token may still extend (as a node of the vocabulary's trie, the token before
it, and the tokens not yet agreed on); what all members agree on is emitted.
States and transitions are made when first met.
"""

from __future__ import annotations

from collections.abc import Callable

#: States that are kept (past this only the last two live on), and neighbour checks (past this they are made anew).
MAX_STATES, MAX_PAIRS = 100_000, 500_000


class MergeTransducer:
    """tokens: symbols to id. rank: of the pair (left, right) or None if the pair doesn't merge."""

    def __init__(self, tokens: dict[str, int], rank: Callable[[str, str], int | None]):
        self.tokens, self.rank = tokens, rank
        self.names = {i: s for s, i in tokens.items()}
        self.children: list[dict[str, int]] = [{}]
        self.ids: list[int] = [-1]
        for symbols, i in tokens.items():
            node = 0
            for c in symbols:
                below = self.children[node]
                if c not in below:
                    below[c] = len(self.children)
                    self.children.append({})
                    self.ids.append(-1)
                node = below[c]
            self.ids[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: list[dict[str, tuple[int, tuple[int, ...]]]] = []
        self.number(((0, -1, ()),))

    def number(self, state: tuple) -> int:
        n = self.numbers.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
            self.steps.append({})
        return n

    def merged(self, symbols: str) -> list[str]:
        """Merges the pair of lowest rank, the leftmost first, until none is left."""
        parts = list(symbols)
        while len(parts) > 1:
            ranks = [(r, k) for k in range(len(parts) - 1) if (r := self.rank(parts[k], parts[k + 1])) is not None]
            if not ranks:
                break
            _, k = min(ranks)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def adjacent(self, left: int, right: int) -> bool:
        """Whether two tokens can be neighbours; with -1 for the left one, whether merging gives the right one at all."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            own = [self.names[i] for i in (left, right) if i >= 0]
            found = self.pairs[left, right] = self.merged("".join(own)) == own
        return found

    def ends(self, members: tuple, symbol: str) -> tuple[list[tuple], tuple]:
        """Members that go on inside a token after the symbol, and the tokens of the prefix that it ends."""
        going, whole, children, pairs = [], None, self.children, self.pairs
        for node, last, pending in members:
            child = children[node].get(symbol)
            if child is None:
                continue
            token = self.ids[child]
            if token >= 0 and whole is None:
                fits = pairs.get((last, token))
                if fits or fits is None and self.adjacent(last, token):
                    whole = (*pending, token)
            if children[child]:
                going.append((child, last, pending))
        if whole is None:
            raise ValueError(f"no token covers the symbol {symbol!r}")
        return going, whole

    def follow(self, members: tuple, symbol: str) -> tuple[tuple, tuple[int, ...]]:
        """The state after the symbol, and the tokens emitted."""
        going, whole = self.ends(members, symbol)
        if not going:
            return ((0, whole[-1], ()),), whole
        agreed = 0
        for x in whole:
            if any(len(p) <= agreed or p[agreed] != x for _, _, p in going):
                break
            agreed += 1
        if agreed:
            going = [(node, last, p[agreed:]) for node, last, p in going]
        return (*going, (0, whole[-1], whole[agreed:])), whole[:agreed]

    def step(self, number: int, symbol: str) -> tuple[int, tuple[int, ...]]:
        return self.kept(number, symbol, *self.follow(self.states[number], symbol))

    def kept(self, number: int, symbol: str, state: tuple, emitted: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
        if len(self.numbers) >= MAX_STATES and state not in self.numbers:
            if len(self.states) == len(self.numbers):
                self.states += [(), ()]
                self.steps += [{}, {}]
            slot = len(self.numbers) + (number == len(self.numbers))
            self.states[slot], self.steps[slot] = state, {}
            return slot, emitted
        out = self.steps[number][symbol] = self.number(state), emitted
        return out

    def encode(self, symbols: str, final: str = "") -> list[int]:
        """Ids of the symbols; final stands in for the last symbol (a word's end), if given."""
        if not symbols:
            return []
        out: list[int] = []
        at, steps = 0, self.steps
        for c in symbols[:-1]:
            found = steps[at].get(c)
            at, emitted = found if found is not None else self.step(at, c)
            if emitted:
                out += emitted
        out += self.ends(self.states[at], final or symbols[-1])[1]
        return out
