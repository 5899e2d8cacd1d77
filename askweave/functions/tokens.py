"""A question as a sequence of tokens that knows its texts, base forms, stems and tags; every operation gives a new sequence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

from askweave.functions import question as q
from askweave.functions.words import degree, lemma, stem

#: What two tokens are compared by.
TEXT, LEMMA, TAG, STEM = range(4)


class Token(NamedTuple):
    text: str
    lemma: str
    tag: str = ""

    @staticmethod
    def of(text: str, tag: str = "") -> Token:
        return Token(text, text.lower() if tag in ("DB", "NUM", "DATE", "YEAR") else lemma(text), tag)

    def key(self, by: int) -> str:
        return self.lemma if by == LEMMA else self.text.lower() if by == TEXT else self.tag if by == TAG else stem(self.text)


@lru_cache(50_000)
def _read(text: str, before: str) -> Token:
    return Token.of(text, q.tagged(text, before.lower()).tag or ("JJR" if (d := degree(text)) and d[0] == "JJR" else "JJS" if d else ""))


class Tokens(tuple):
    @staticmethod
    def read(text: str) -> Tokens:
        """Tokens of a text, with the tags of :func:`askweave.functions.question.tag_tokens` and JJR for other comparatives."""
        said = q.text_tokens(text)
        return Tokens(map(_read, said, ["", *said]))

    @staticmethod
    def words(text: str) -> Tokens:
        """A plain sequence of the words of a name."""
        return Tokens(Token.of(w) for w in text.split())

    def __getitem__(self, at):
        out = super().__getitem__(at)
        return Tokens(out) if isinstance(at, slice) else out

    def text(self) -> str:
        return " ".join(t.text for t in self)

    def lemmas(self, keep_degrees: bool = False) -> str:
        """Base forms; comparatives and superlatives as they stand, if wished."""
        return " ".join(t.text.lower() if keep_degrees and degree(t.text) else t.lemma for t in self)

    def match_at(self, at: int, other: Tokens, by: int = TEXT) -> bool:
        """Whether another sequence stands at a place."""
        return self.keys(by)[at : at + len(other)] == other.keys(by)

    def keys(self, by: int) -> tuple[str, ...]:
        """What the tokens are compared by, made once."""
        held = self.__dict__.get("_keys")
        if held is None:
            held = self._keys = {}
        if by not in held:
            held[by] = tuple([t.text.lower() for t in self] if by == TEXT else [t.lemma for t in self] if by == LEMMA else [t.key(by) for t in self])
        return held[by]

    @cached_property
    def forms(self) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
        """Texts, base forms and stems."""
        return self.keys(TEXT), self.keys(LEMMA), self.keys(STEM)

    @cached_property
    def places(self) -> tuple[dict[str, list[int]], ...]:
        """Where each text, base form and stem stands."""
        out = []
        for keys in self.forms:
            at: dict[str, list[int]] = {}
            for i, x in enumerate(keys):
                at.setdefault(x, []).append(i)
            out.append(at)
        return tuple(out)

    @cached_property
    def untagged(self) -> list[tuple[int, str]]:
        """Places and base forms of the tokens without a tag."""
        return [(i, t.lemma) for i, t in enumerate(self) if not t.tag]

    def find(self, other: Tokens, start: int = 0, by: int = TEXT) -> int:
        """The first place of another sequence; -1 where it is not in this one."""
        if not other or not set(other.keys(by)) <= set(self.keys(by)):
            return -1
        return next((i for i in range(start, len(self) - len(other) + 1) if self.match_at(i, other, by)), -1)

    def part(self, text: str, by: int = TEXT) -> Tokens:
        """The part of this sequence that reads as the text; empty where none does."""
        own = Tokens.words(text)
        at = self.find(own, by=by)
        return self[at : at + len(own)] if at >= 0 else Tokens()

    def joined(self, other: Tokens) -> Tokens:
        return Tokens((*self, *other))

    def updated(self, at: int, token: Token) -> Tokens:
        return Tokens((*self[:at], token, *self[at + 1 :]))

    def split(self, word: str, once: bool = True) -> list[Tokens]:
        """The parts before and after a word (or all parts between its places)."""
        parts, rest = [], self
        while (at := rest.find(Tokens.words(word))) >= 0:
            parts.append(rest[:at])
            rest = rest[at + 1 :]
            if once:
                break
        return [*parts, rest]

    def without_stop_words(self) -> Tokens:
        return Tokens(t for t in self if t.text.lower() not in q.STOP_WORDS)

    def without_punctuation(self) -> Tokens:
        return Tokens(t for t in self if any(c.isalpha() for c in t.text))

    def without(self, word: str) -> Tokens:
        return Tokens(t for t in self if word.lower() not in (t.text.lower(), t.lemma))

    def count(self, word: str) -> int:
        return sum(t.text.lower() == word.lower() for t in self)

    def replaced(self, word: str, new: str) -> Tokens:
        return Tokens(Token.of(new, t.tag) if t.text.lower() == word.lower() else t for t in self)

    def without_suffixes(self) -> Tokens:
        """Base forms without ``ing`` and ``es`` where the base form is the text itself."""

        def cut(t: Token) -> Token:
            for suffix in ("ing", "es"):
                if t.lemma == t.text.lower() and t.lemma.endswith(suffix) and len(t.lemma) > len(suffix) + 2:
                    return t._replace(lemma=t.lemma.removesuffix(suffix))
            return t

        return Tokens(map(cut, self))

    def in_quotes(self, at: int, signs: str = "'\"") -> bool:
        """Whether a place lies between quote marks: an odd number of them stands before it."""
        if not any(s in self.keys(TEXT) for s in signs):
            return False
        before, after = [t.text for t in self[:at]], [t.text for t in self[at + 1 :]]
        return any(before.count(s) % 2 == 1 and s in after for s in signs)

    def runs(self, longest: int) -> Iterator[tuple[int, int]]:
        """Start and end of every run of tokens, longer ones first."""
        for n in range(min(longest, len(self)), 0, -1):
            for i in range(len(self) - n + 1):
                yield i, i + n
