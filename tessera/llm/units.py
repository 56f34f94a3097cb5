"""Texts as units whose byte-level tokens don't depend on what stands around them.

The public pattern joins one space to what follows it and treats runs of white
space by their length. Where white space is single (a space between words, a
line feed between lines), a word with the space before it can be encoded by
itself; the text is then a sequence of such units, most of them seen before.
"""

from __future__ import annotations

#: Entries of a cache's generation; two generations are held, and what is asked for stays.
MAX_ENTRIES = 400_000
#: Characters of an entry that is kept, and of a generation's entries for each that it may have.
LONGEST, EACH = 64, 16


class Irregular(Exception):
    """White space that isn't single: the text has to be taken as a whole."""


def regular(word: str) -> bool:
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


class Generations(dict):
    """A bounded cache. When it is full it becomes the older generation, from which entries asked for come back."""

    def __init__(self, make, size: int | None = None):
        super().__init__()
        self.make, self.older, self.size, self.held = make, {}, size or MAX_ENTRIES, 0

    def __missing__(self, key: str):
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(key) > LONGEST:
            return out
        if len(self) >= self.size or self.held > EACH * self.size:
            self.older, self.held = dict(self), 0
            self.clear()
        self.held += len(key)
        self[key] = out
        return out


class UnitCache:
    """Values of a text's units, each made once: a line's first word, a word with the space before it, a line feed."""

    def __init__(self, make, size: int | None = None):
        self.first = Generations(lambda word: make(word) if regular(word) else self.refuse(), size)
        self.spaced = Generations(lambda word: make(" " + word) if regular(word) else self.refuse(), size)
        self.feed = make("\n")

    @staticmethod
    def refuse():
        raise Irregular

    def of(self, text: str) -> list | None:
        """The units' values in order; None if the text isn't regular."""
        out, first, spaced = [], self.first, self.spaced.__getitem__
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                out.append(self.feed)
                out.append(first[words[0]])
                del words[0]
                out.extend(map(spaced, words))
        except Irregular:
            return None
        del out[0]
        return out
