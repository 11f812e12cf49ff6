"""Lexing of brace languages without a grammar: masking of comments and strings, matching of brackets.

Masks keep length and line breaks, so offsets in a mask are offsets in the text.
"""

from __future__ import annotations

import bisect
import re

_TOKEN = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?")
PAIRS = {"(": ")", "{": "}", "[": "]"}


def mask(text: str, keep_strings: bool = False) -> str:
    """The text with comments, and strings unless kept, as blanks; quotes of strings stay."""
    def blank(m):
        s = m[0]
        if s.startswith(("//", "/*")):
            return re.sub(r"[^\n]", " ", s)
        return s if keep_strings else s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if len(s) > 1 else s
    return _TOKEN.sub(blank, text)


class Source:
    """A masked text with line numbers and bracket matches."""

    def __init__(self, text: str):
        self.text, self.mask, self.code = text, mask(text), mask(text, True)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.match: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in re.finditer(r"[(){}\[\]]", self.mask):
            c = m[0]
            if c in PAIRS:
                stack.append((PAIRS[c], m.start()))
            elif stack and stack[-1][0] == c:
                self.match[stack.pop()[1]] = m.start()

    def line(self, offset: int) -> int:
        return bisect.bisect_right(self.lines, offset)

    def close(self, at: int) -> int:
        """Where the bracket at an offset closes; the text's end if it doesn't."""
        return self.match.get(at, len(self.text) - 1)

    def statement_end(self, at: int) -> int:
        """End of a statement from an offset: a semicolon, or a line break outside brackets that no operator
        leaves open."""
        n = len(self.mask)
        while at < n:
            c = self.mask[at]
            if c in PAIRS:
                at = self.close(at) + 1
                continue
            if c in ";})]" or c == "\n" and not re.search(r"[=,.+\-*/|&?:(<]\s*$", self.mask[max(0, at - 200):at]) and not re.match(r"\s*[.?:|&+=]", self.mask[at:at + 200]):
                return at
            at += 1
        return n
