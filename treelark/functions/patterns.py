"""What a text must hold to match a pattern: literal pieces of regular expressions and LIKE patterns, as a choice of sets of pieces."""

from __future__ import annotations

from itertools import product

#: Most alternatives that a formula keeps; a part with more of them asks for nothing.
ALTERNATIVES = 32
GRAM = 3

#: Any one of the sets suffices for a match to be possible; all pieces of the set must be there.
Needs = frozenset[frozenset[str]]
ANYTHING: Needs = frozenset([frozenset()])


def both(a: Needs, b: Needs) -> Needs:
    """What two parts ask for together; of two that make too many alternatives, the one that asks for more stays."""
    if len(a) * len(b) > ALTERNATIVES:
        return max(a, b, key=lambda n: (min(map(len, n)) > 0, -len(n)))
    return frozenset(x | y for x, y in product(a, b))


def either(parts: list[Needs]) -> Needs:
    found = frozenset().union(*parts)
    return ANYTHING if frozenset() in found or len(found) > ALTERNATIVES else found


class _Reader:
    """Reads a regular expression part by part; whatever it doesn't know asks for nothing."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self) -> str:
        c = self.text[self.at]
        self.at += 1
        return c

    def choice(self) -> Needs:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return either(parts)

    def sequence(self) -> Needs:
        needs, run = ANYTHING, ""

        def ended() -> None:
            nonlocal needs, run
            if len(run) >= GRAM:
                needs = both(needs, frozenset([frozenset([run])]))
            run = ""

        while self.at < len(self.text) and self.peek() not in ("|", ")"):
            piece, inner = self.atom()
            least, exactly_once = self.times()
            if piece is not None and exactly_once:
                run += piece
                continue
            if piece is not None and least:  # a character that is repeated ends the run that it belongs to
                run += piece
            ended()
            if inner is not None and least:
                needs = both(needs, inner)
            if piece is not None and least:
                run = piece
        ended()
        return needs

    def times(self) -> tuple[int, bool]:
        """Whether the part before must be there, and whether it is there just once."""
        c, least = self.peek(), 1
        if c in ("*", "?", "+"):
            self.at += 1
            least = int(c == "+")
        elif c == "{" and (end := self.text.find("}", self.at)) > 0:
            low = self.text[self.at + 1 : end].split(",")[0].strip()
            self.at = end + 1
            least = int(low) if low.isdigit() else 0
        else:
            return 1, True
        if self.peek() in ("?", "+"):
            self.at += 1
        return least, False

    def atom(self) -> tuple[str | None, Needs | None]:
        """The next part: a literal character, or what it asks for."""
        c = self.take()
        if c == "(":
            return None, self.group()
        if c == "[":
            self.skip_class()
            return None, None
        if c == "\\":
            return self.escape(), None
        if c in ".^$":
            return None, None
        return (c.lower(), None) if c.isascii() else (None, None)

    def group(self) -> Needs:
        ahead = False
        if self.peek() == "?":
            self.at += 1
            if self.peek() in ("=", "!") or self.peek(2) in ("<=", "<!"):
                ahead = True
                self.at += 1 + (self.peek() == "<")
            elif self.peek() == "<":
                self.at = self.text.find(">", self.at) + 1 or len(self.text)
            else:
                while self.peek() and self.peek() not in (":", ")", ">"):
                    self.at += 1
                if self.peek() != ")":
                    self.at += 1
        needs = self.choice()
        if self.peek() == ")":
            self.at += 1
        return ANYTHING if ahead else needs

    def skip_class(self) -> None:
        depth, first = 1, True
        while self.at < len(self.text) and depth:
            c = self.take()
            if c == "\\":
                self.at += 1
            elif c == "[":
                depth += 1
            elif c == "]" and not first:
                depth -= 1
            first = first and c == "^"

    def escape(self) -> str | None:
        c = self.take() if self.at < len(self.text) else ""
        if c == "Q":
            end = self.text.find("\\E", self.at)
            self.at = len(self.text) if end < 0 else end + 2
            return None
        if c in ("p", "P", "k", "x", "N") and self.peek() in ("{", "<"):
            self.at = max(self.text.find("}", self.at), self.text.find(">", self.at)) + 1 or len(self.text)
            return None
        if c and (c.isalnum() or not c.isascii()):
            if c in ("x", "u", "0"):  # a code point: its digits are no literals
                while self.peek() and self.peek() in "0123456789abcdefABCDEF":
                    self.at += 1
            return None
        return c or None


def needs_of_regex(pattern: str) -> Needs:
    if "(?x" in pattern or "\\E" in pattern or "&&" in pattern:
        return ANYTHING
    reader = _Reader(pattern)
    needs = reader.choice()
    return needs if reader.at >= len(pattern) else ANYTHING


def needs_of_like(pattern: str) -> Needs:
    """% and _ part pieces; there is no escape."""
    pieces, run = [], ""
    for c in pattern.lower() + "%":
        if c in "%_" or not c.isascii():
            pieces.append(run)
            run = ""
        else:
            run += c
    return frozenset([frozenset(p for p in pieces if len(p) >= GRAM)])


def grams_of(needs: Needs) -> list[list[str]]:
    """The grams of each alternative; empty if some alternative has none, so that nothing can be looked up."""
    found = [sorted({p[k : k + GRAM] for p in pieces for k in range(len(p) - GRAM + 1)}) for pieces in needs]
    return sorted(found) if all(found) else []
