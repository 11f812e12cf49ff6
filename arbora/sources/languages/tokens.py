"""Tokens of TypeScript, JavaScript and Kotlin, with strings that hold code, regular expressions and comments.

Code inside a string's template comes out as tokens of its own, between the string's pieces. Brackets know their
partners; one that is never closed ends with its surroundings, so broken files still give what stands around.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  #: name, number, string, regex or sign
    text: str
    start: int
    end: int
    fresh: bool  #: first on its line


_NAME = re.compile(r"(?:[^\W\d]|\$)[\w$]*")
_NUMBER = re.compile(r"\d\w*(?:\.\d\w*)?")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_SIGN = {
    "typescript": re.compile(r"\.\.\.|=>|\?\?=|&&=|\|\|=|\*\*=|>>>=|<<=|>>=|===|!==|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|[-+*/%&|^]=|<<|\S"),
    "kotlin": re.compile(r"===|!==|==|!=|<=|\+\+|--|&&|\|\||\?:|\?\.|::|->|\.\.<|\.\.|!!|[-+*/%]=|\S"),
}
_OPEN = {"(": ")", "[": "]", "{": "}", "${": "}"}
#: After these words a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of do else void delete throw new instanceof yield await default".split())
_STRING_END = {'"': re.compile(r'\\.|"|\$\{|\$(?=[^\W\d])|\n', re.S), '"""': re.compile(r'"""+|\$\{|\$(?=[^\W\d])'), "`": re.compile(r"\\.|`|\$\{", re.S), "'": re.compile(r"\\.|'|\n", re.S), 'plain"': re.compile(r'\\.|"|\n', re.S)}


class Tokens:
    """The tokens of a text; ``close`` maps an opening bracket to its partner, ``inside`` a token to the bracket around it."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.list = text, language, []
        self._scan()
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close: dict[int, int] = {}
        self.inside: list[int] = []
        stack: list[int] = []
        for i, t in enumerate(self.list):
            if t.kind == "sign" and t.text in (")", "]", "}"):
                at = next((k for k in range(len(stack) - 1, -1, -1) if _OPEN[self.list[stack[k]].text] == t.text), None)
                if at is not None:
                    for k in stack[at + 1:]:
                        self.close[k] = i
                    self.close[stack[at]] = i
                    del stack[at:]
            self.inside.append(stack[-1] if stack else -1)
            if t.kind == "sign" and t.text in _OPEN:
                stack.append(i)
        for k in stack:
            self.close[k] = len(self.list)

    def line(self, offset: int) -> int:
        return bisect.bisect_right(self.lines, offset)

    def _scan(self) -> None:
        text, n, kotlin, signs = self.text, len(self.text), self.language == "kotlin", _SIGN[self.language]
        at, fresh, holders = 0, True, []  # holders: of each open brace, the string that goes on after it

        def put(kind: str, start: int, end: int) -> None:
            nonlocal fresh
            self.list.append(Token(kind, text[start:end], start, end, fresh))
            fresh = False

        def string(start: int, at: int, quote: str) -> int:
            """The rest of a string from ``at``: up to its end, or to the code of a template."""
            found = _STRING_END[quote if kotlin or quote in "`'" else 'plain"']
            while m := found.search(text, at):
                if m[0] == "${":
                    put("string", start, m.start())
                    put("sign", m.start(), m.end())
                    holders.append(quote)
                    return m.end()
                if m[0] == "$":
                    put("string", start, m.start())
                    name = _NAME.match(text, m.end())
                    put("name", m.end(), name.end())
                    start = at = name.end()
                    continue
                at = m.end()
                if m[0][0] != "\\":
                    put("string", start, m.start() if m[0] == "\n" else at)
                    return m.start() if m[0] == "\n" else at
            put("string", start, n)
            return n

        while at < n:
            c = text[at]
            if c.isspace():
                fresh |= c == "\n"
                at += 1
            elif text.startswith("//", at) or (at == 0 and text.startswith("#!")):
                at = text.find("\n", at) if "\n" in text[at:] else n
            elif text.startswith("/*", at):
                depth, end = 1, at + 2
                while depth and (m := re.compile(r"/\*|\*/").search(text, end)):
                    depth += 1 if kotlin and m[0] == "/*" else -1 if m[0] == "*/" else 0
                    end = m.end()
                end = n if depth else end
                fresh |= "\n" in text[at:end]
                at = end
            elif m := _NAME.match(text, at):
                put("name", at, at := m.end())
            elif m := _NUMBER.match(text, at):
                put("number", at, at := m.end())
            elif kotlin and c == "`" and (end := text.find("`", at + 1)) > 0:
                self.list.append(Token("name", text[at + 1:end], at, end + 1, fresh))
                fresh, at = False, end + 1
            elif kotlin and text.startswith('"""', at):
                at = string(at, at + 3, '"""')
            elif c in "\"'" or c == "`":
                at = string(at, at + 1, c)
            elif c == "/" and not kotlin and self._regex_may_start() and (m := _REGEX.match(text, at)):
                put("regex", at, at := m.end())
            else:
                m = signs.match(text, at)
                put("sign", at, at := m.end())
                if m[0] == "{":
                    holders.append(None)
                elif m[0] == "}" and holders and (quote := holders.pop()):
                    at = string(at, at, quote)

    def _regex_may_start(self) -> bool:
        if not self.list:
            return True
        last = self.list[-1]
        return last.text in _BEFORE_REGEX if last.kind == "name" else last.kind == "sign" and last.text not in (")", "]", "}", "++", "--")


class Facts:
    """A parser's cursor over tokens, and the facts that it finds; ids are prefix:path#qualified.name."""

    language = prefix = ""
    words: frozenset[str] = frozenset()

    def __init__(self, path: str, text: str):
        self.path, self.text, self.rows, self.seen, self.starts = path, text, [], set(), {}
        self.tokens = Tokens(text, self.language)
        self.t, self.close, self.n = self.tokens.list, self.tokens.close, len(self.tokens.list)
        self.id = f"{self.prefix}{path}"
        self.add("file", None, self.id, path, 0, len(text))
        self.file()

    # Facts.
    def add(self, kind, owner, ident, name, start, end=None, detail=None, source=None, exported=None, signature=None):
        line = self.tokens.line
        self.rows.append((self.path, self.language, kind, owner, ident, name, detail, source, line(start), line(start if end is None else max(start, end)), exported, signature, len(self.rows)))

    def declare(self, owner, scope, name, kind, first, last, exported, signature) -> str:
        """A symbol from token ``first`` to token ``last``."""
        ident = f"{self.id}#{'.'.join([*scope, name])}"
        self.starts[ident] = self.t[first].start
        self.add("symbol", owner, ident, name, self.t[first].start, self.t[min(last, self.n - 1)].end - 1, kind, None, exported, signature)
        return ident

    def uses_type(self, owner: str, at: int) -> None:
        """A type named in a declaration, once an owner and name."""
        name = self.t[at].text
        if owner != self.id and name not in self.words and ("type", owner, name) not in self.seen:
            self.seen.add(("type", owner, name))
            self.add("annotation", owner, None, name, self.type_place(owner, at))

    def type_place(self, owner: str, at: int) -> int:
        return self.t[at].start

    def refers(self, owner: str, at: int, detail: str) -> None:
        """A call, creation or write of a symbol, each time; a read once, if it isn't written before. What a file does
        outside its symbols has no owner, so it doesn't count."""
        name = self.t[at].text
        if owner == self.id or detail == "read" and ("read", owner, name) in self.seen:
            return
        if detail in ("read", "write"):
            self.seen.add(("read", owner, name))
        self.add("reference", owner, None, name, self.t[at].start, detail=detail, source=self.receiver(at))

    # The cursor.
    def at(self, i: int) -> str:
        """The text of a name or sign; nothing for other tokens."""
        return self.t[i].text if 0 <= i < self.n and self.t[i].kind in ("name", "sign") else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < self.n and self.t[i].kind == "name"

    def after(self, i: int) -> int:
        """The token behind a bracket's partner."""
        return min(self.close.get(i, i) + 1, self.n)

    def same_line(self, i: int) -> bool:
        return i < self.n and not self.t[i].fresh

    def receiver(self, at: int) -> str | None:
        return self.t[at - 2].text if self.at(at - 1) in (".", "?.") and self.is_name(at - 2) else None

    def source(self, first: int, last: int) -> str:
        """The text from token ``first`` up to token ``last``, without the latter."""
        last = min(last, self.n)
        return self.text[self.t[first].start:self.t[last - 1].end] if first < last else ""

    def file(self) -> None:
        raise NotImplementedError
