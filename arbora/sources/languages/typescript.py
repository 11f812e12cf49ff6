"""A parser of TypeScript and JavaScript files: imports, exports, declarations, heritage, types, calls, reads, writes.

Types are read by precedence (conditional, union and intersection, unary words, array and index suffixes, then
functions, objects, tuples and named types with arguments); expressions are walked for what they refer to.
"""

from __future__ import annotations

from .tokens import Facts

#: Words that are no names in expressions, modifiers of declarations and members, and words before types.
WORDS = frozenset("if for while switch catch return new typeof await function class import export const let var super throw delete void in of instanceof yield async do else try finally case break continue default extends implements interface enum type this true false null undefined as satisfies from".split())
MODIFIERS = frozenset("public private protected static readonly abstract override async declare accessor get set".split())
BASIC = frozenset("any unknown never void string number boolean object symbol bigint null undefined this true false const keyof typeof readonly infer unique asserts is extends new in as".split())
ASSIGNS = frozenset("= += -= *= /= %= &= |= ^= **= <<= >>= >>>= ??= &&= ||=".split())


class TypeScript(Facts):
    language, prefix, words = "typescript", "ts:", WORDS | BASIC

    def file(self) -> None:
        self.listed: set[str] = set()
        self.locals: dict[str, set[str]] = {}  # names that a symbol's body has of its own
        self.passed_on = self.own_work = False  # re-exports from other files, and other statements than these and imports
        self.statements(0, self.n, [], self.id)
        if self.passed_on and not self.own_work:
            self.add("barrel", self.id, None, self.path, 0)
        mine = self.id
        own = [r for r in self.rows if not (r[2] == "reference" and r[5] in self.locals.get(r[3], ()) and (r[7] is None or r[6] in ("read", "write")))]
        self.rows = [(*r[:10], True, *r[11:]) if r[2] == "symbol" and r[3] == mine and r[5] in self.listed else r for r in own]

    def statements(self, i: int, end: int, scope: list[str], owner: str) -> None:
        while i < end:
            i = max(self.statement(i, end, scope, owner), i + 1)

    def statement(self, start: int, end: int, scope: list[str], owner: str) -> int:
        i, exported, default = start, False, False
        while True:
            x = self.at(i)
            if x == "@" and i + 1 < end:
                i = self.decorator(i, owner)
            elif x == "import" and self.at(i + 1) not in ("(", "."):
                return self.imported(i, end)
            elif x == "export":
                exported, i = True, i + 1
                start = i
                if self.at(i) in ("*", "{") or self.at(i) == "type" and self.at(i + 1) in ("*", "{"):
                    return self.exported(i, end)
            elif x == "default" and exported:
                default, i = True, i + 1
                start = i
            elif x in ("declare", "abstract", "async") and self.is_name(i + 1) and self.same_line(i + 1):
                i += 1
            else:
                break
        self.own_work |= x != ";"
        if x in ("namespace", "module") and (self.is_name(i + 1) or self.string(i + 1)):
            while i < end and self.at(i) not in ("{", ";"):
                i += 1
            return self.after(i)
        if x == "class" or x in ("interface", "enum") and self.is_name(i + 1):
            return self.block(start, i, end, scope, owner, x, exported, default)
        if x == "const" and self.at(i + 1) == "enum":
            return self.block(start, i + 1, end, scope, owner, "enum", exported, default)
        if x == "function":
            return self.function(start, i, end, scope, owner, exported, default)
        if x == "type" and self.is_name(i + 1) and self.at(i + 2) in ("=", "<"):
            return self.alias(start, i, end, scope, owner, exported)
        if x in ("const", "let", "var"):
            return self.variables(start, i, end, scope, owner, exported)
        stop = self.expression_end(i, end)
        self.scan(i, stop, owner)
        return stop + (self.at(stop) == ";")

    # Imports and exports.
    def string(self, i: int) -> str | None:
        return self.t[i].text[1:-1] if i < self.n and self.t[i].kind == "string" and len(self.t[i].text) > 1 else None

    def clause(self, i: int) -> list[tuple[str, str]]:
        """(name there, name here) of each entry of a list in braces."""
        out, k, end = [], i + 1, self.close.get(i, self.n)
        while k < end:
            if self.at(k) == "type" and self.is_name(k + 1) and self.at(k + 1) != "as":
                k += 1
            there = here = self.t[k].text
            if self.at(k + 1) == "as":
                here, k = self.t[min(k + 2, self.n - 1)].text, k + 2
            out.append((there, here))
            while k < end and self.at(k) != ",":
                k += 1
            k += 1
        return out

    def imported(self, i: int, end: int) -> int:
        at, k = self.t[i].start, i + 1
        if self.at(k) == "type" and (self.is_name(k + 1) and self.at(k + 1) != "from" or self.at(k + 1) in ("{", "*")):
            k += 1
        bound: list[tuple[str, str]] = []
        while k < end and self.string(k) is None and self.at(k) != ";":
            if self.at(k) == "{":
                bound += [(there, here) for there, here in self.clause(k)]
                k = self.after(k)
            elif self.at(k) == "*" and self.at(k + 1) == "as":
                bound.append(("*", self.t[min(k + 2, self.n - 1)].text))
                k += 3
            elif self.at(k) == "=":  # an older form of import
                stop = self.expression_end(k + 1, end)
                self.scan(k + 1, stop, self.id)
                return stop
            else:
                if self.is_name(k) and self.at(k) != "from" or self.at(k) == "from" and self.at(k + 1) in ("from", ","):
                    bound.append(("default", self.t[k].text))
                k += 1
        if source := self.string(k):
            self.add("import", self.id, None, source, at)
            for there, here in bound:
                self.add("binding", self.id, None, here, at, detail=there, source=source)
        while self.at(k + 1) in ("with", "assert") and self.at(k + 2) == "{":
            k = self.after(k + 2) - 1
        return k + 1

    def exported(self, i: int, end: int) -> int:
        at = self.t[i - 1].start
        i += self.at(i) == "type"
        names = self.clause(i) if self.at(i) == "{" else [("*", "*")]
        k = self.after(i) if self.at(i) == "{" else i + 1
        if self.at(k) == "as":
            names, k = [("namespace", self.t[min(k + 1, self.n - 1)].text)], k + 2
        if self.at(k) != "from":
            self.own_work = True
            self.listed |= {there for there, _ in names}
            return k
        source = self.string(k + 1)
        if source:
            self.passed_on = True
            self.add("import", self.id, None, source, at)
            for there, here in names:
                self.add("reexport", self.id, None, here, at, detail=None if there == "*" else there, source=source)
        return k + 2

    # Types.
    def type_(self, i: int, owner: str) -> int:
        """The place behind a type; the names in it are told."""
        i = self.union(i, owner)
        if self.at(i) == "extends" and self.same_line(i) or self.at(i) == "extends" and self.at(i - 1) not in ("{", "}", ";"):
            k = self.union(i + 1, owner)
            if self.at(k) == "?":
                k = self.type_(k + 1, owner)
                return self.type_(k + 1, owner) if self.at(k) == ":" else k
        return i

    def union(self, i: int, owner: str) -> int:
        while True:
            while self.at(i) in ("|", "&"):
                i += 1
            k = self.suffixed(i, owner)
            if k == i or self.at(k) not in ("|", "&"):
                return k
            i = k

    def suffixed(self, i: int, owner: str) -> int:
        while self.at(i) in ("keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "abstract") and (self.is_name(i + 1) or self.at(i + 1) in ("(", "[", "{", "<")) and self.at(i + 1) not in ("is", "extends"):
            i += 1
        k = self.primary(i, owner)
        while k > i:
            if self.at(k) == "[" and self.same_line(k):
                self.type_(k + 1, owner)
                k = self.after(k)
            elif self.at(k) == "is" and self.same_line(k):
                return self.type_(k + 1, owner)
            else:
                break
        return k

    def primary(self, i: int, owner: str) -> int:
        x = self.at(i)
        if x == "<":  # a function's type parameters
            i = self.arguments(i, owner)
            x = self.at(i)
        if x == "(":
            k = self.after(i)
            if self.at(k) == "=>":
                self.parameters(i, owner)
                return self.type_(k + 1, owner)
            self.type_(i + 1, owner)
            return k
        if x == "{":
            self.members(i + 1, self.close.get(i, self.n), None, owner)
            return self.after(i)
        if x == "[":
            k, end = i + 1, self.close.get(i, self.n)
            while k < end:
                k += self.at(k) in ("...", "?", ",", ":")
                k = max(self.type_(k, owner), k + 1)
            return self.after(i)
        if self.is_name(i):
            if x == "import" and self.at(i + 1) == "(":
                i = self.after(i + 1) - 1
            first = i
            while self.at(i + 1) == "." and self.is_name(i + 2):
                i += 2
            if i == first or self.at(first) not in ("import",):
                self.uses_type(owner, i)
            return self.arguments(i + 1, owner) if self.at(i + 1) == "<" else i + 1
        if i < self.n and self.t[i].kind in ("string", "number"):
            i += 1
            while i < self.n and self.at(i) == "${":  # a template of types
                self.type_(i + 1, owner)
                i = self.after(i)
                i += i < self.n and self.t[i].kind == "string"
            return i
        return i + 2 if x == "-" else i

    def angle(self, i: int) -> int | None:
        """The place behind type arguments that open at ``i``; none if it is a comparison."""
        depth, k = 0, i
        while k < self.n:
            x, kind = self.at(k), self.t[k].kind
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif x in ("(", "{", "[", "${"):
                k = self.close.get(k, self.n)
            elif not (kind in ("string", "number") or kind == "name" and x not in WORDS - BASIC or x in (",", ".", "?", "|", "&", "=>", "=", ":", "-", "...")):
                return None
            k += 1
        return None

    def arguments(self, i: int, owner: str) -> int:
        end = self.angle(i)
        if not end:
            return i + 1
        k = i + 1
        while k < end - 1:
            k += self.at(k) in (",", "=", "extends", "?", ":", "...")
            k = max(self.type_(k, owner), k + 1) if self.at(k) not in (",", "=") else k + 1
        return end

    def parameters(self, opening: int, owner: str) -> None:
        i, end = opening + 1, self.close.get(opening, self.n)
        while i < end:
            while self.at(i) == "@" or self.at(i) in MODIFIERS and (self.is_name(i + 1) or self.at(i + 1) in ("{", "[")) or self.at(i) == "...":
                i = self.decorator(i, owner) if self.at(i) == "@" else i + 1
            i = self.local(i, owner)
            i += self.at(i) == "?"
            if self.at(i) == ":":
                i = self.type_(i + 1, owner)
            stop = i
            while stop < end and self.at(stop) != ",":
                stop = self.after(stop) if self.at(stop) in ("(", "[", "{", "${") else self.angle(stop) or stop + 1 if self.at(stop) == "<" else stop + 1
            self.scan(i, stop, owner)
            i = stop + 1

    def local(self, i: int, owner: str) -> int:
        """A parameter or variable, or a pattern of them; returns the place behind."""
        if self.at(i) in ("{", "["):
            return self.after(i)
        if self.is_name(i):
            self.locals.setdefault(owner, set()).add(self.t[i].text)
        return i + 1

    def decorator(self, i: int, owner: str) -> int:
        k = i + 1
        while self.is_name(k) and self.at(k + 1) == ".":
            k += 2
        stop = self.after(k + 1) if self.at(k + 1) == "(" else k + 1
        self.scan(i + 1, stop, owner)
        return stop

    # Declarations.
    def block(self, start, i, end, scope, owner, what, exported, default) -> int:
        named = self.is_name(i + 1) and self.at(i + 1) not in ("extends", "implements")
        name, k = (self.t[i + 1].text, i + 2) if named else ("default", i + 1)
        head, brace = k, k
        while brace < end and self.at(brace) not in ("{", ";"):
            brace = self.after(brace) if self.at(brace) in ("(", "[") else self.angle(brace) or brace + 1 if self.at(brace) == "<" else brace + 1
        stop = self.after(brace) if self.at(brace) == "{" else min(brace, end)
        inner = [*scope, name]
        ident = self.declare(owner, scope, name, what, start, stop - 1, exported, self.first_line(start, stop)) if named else owner
        if default and named:
            self.add("default", self.id, ident, name, self.t[i].start)
        k = self.arguments(head, ident) if self.at(head) == "<" else head
        relation = "INHERITS"
        while k < brace:
            if self.at(k) in ("extends", "implements"):
                relation, k = "IMPLEMENTS" if self.at(k) == "implements" else "INHERITS", k + 1
                continue
            if self.is_name(k):
                while self.at(k + 1) == "." and self.is_name(k + 2):
                    k += 2
                if self.at(k + 1) == "(":  # a base that is made by a call
                    self.scan(k, self.after(k + 1), ident)
                    k = self.after(k + 1) - 1
                elif named:
                    self.add("base", ident, None, self.t[k].text, self.t[k].start, detail=relation)
                k = self.arguments(k + 1, ident) if self.at(k + 1) == "<" else k + 1
            else:
                k = self.after(k) if self.at(k) in ("(", "[", "{") else k + 1
        if self.at(brace) == "{":
            if what == "enum":
                self.values(brace + 1, stop - 1, ident)
            elif what == "class":
                self.members(brace + 1, stop - 1, inner if named else None, ident)
        return stop

    def values(self, i: int, end: int, owner: str) -> None:
        """What the values of an enumeration refer to."""
        while i < end:
            stop = self.expression_end(i, end, True)
            if self.at(i + 1) == "=":
                self.scan(i + 2, stop, owner)
            i = stop + 1

    def first_line(self, start: int, stop: int) -> str:
        return self.source(start, stop).split("\n", 1)[0].split("{")[0].strip()

    def parameter_texts(self, opening: int) -> str:
        """The parameters as they stand, comma-separated."""
        out, i, end = [], opening + 1, self.close.get(opening, self.n)
        while i < end:
            k = i
            while k < end and self.at(k) != ",":
                k = self.after(k) if self.at(k) in ("(", "[", "{", "${") else self.angle(k) or k + 1 if self.at(k) == "<" else k + 1
            out.append(self.source(i, k))
            i = k + 1
        return f"({', '.join(x for x in out if x)})"

    def members(self, i: int, end: int, scope: list[str] | None, owner: str) -> None:
        """Members of a class or interface, symbols where ``scope`` is given; of a type in braces, its types only."""
        while i < end:
            start = i
            while self.at(i) == "@":
                i = self.decorator(i, owner)
            while self.at(i) in MODIFIERS and (self.is_name(i + 1) or self.at(i + 1) in ("[", "#", "*", "{") or i + 1 < end and self.t[i + 1].kind in ("string", "number")) and not (self.at(i + 1) == "{" and self.at(i) != "static"):
                i += 1
            i += self.at(i) == "*"
            private = self.at(i) == "#"
            i += private
            name = None
            if self.at(i) == "{":  # a static block
                self.scan(i + 1, self.close.get(i, self.n), owner)
                i = self.after(i)
                continue
            if self.is_name(i):
                name, i = ("#" if private else "") + self.t[i].text, i + 1
            elif i < end and self.t[i].kind in ("string", "number"):
                name, i = self.t[i].text.strip("'\""), i + 1
            elif self.at(i) == "[":  # a computed name, or an index signature
                if self.is_name(i + 1) and self.at(i + 2) in (":", "in"):
                    self.type_(i + 3, owner)
                else:
                    self.scan(i + 1, self.close.get(i, self.n), owner)
                    name = self.source(i, self.after(i))
                i = self.after(i)
            elif self.at(i) not in ("(", "<"):
                i = max(i, start) + 1
                continue
            i += self.at(i) in ("?", "!")
            made = scope is not None and name is not None
            if self.at(i) in ("(", "<"):
                p = self.angle(i) or i + 1 if self.at(i) == "<" else i
                k = self.after(p) if self.at(p) == "(" else p
                if self.at(k) == ":":
                    k = self.type_(k + 1, self.id)
                body = k if self.at(k) == "{" else None
                stop = self.after(k) if body else k
                ident = self.declare(owner, scope, name, "method", start, stop - 1, False, name + self.parameter_texts(p)) if made and body else owner
                if made and not body:  # an overload, or abstract: the one with a body stands for it
                    i = stop + (self.at(stop) in (";", ","))
                    continue
                if self.at(i) == "<":
                    self.arguments(i, ident)
                if self.at(p) == "(":
                    self.parameters(p, ident)
                    if self.at(self.after(p)) == ":":
                        self.type_(self.after(p) + 1, ident)
                if body:
                    self.scan(body + 1, stop - 1, ident)
                i = stop
            else:
                typed = i + 1 if self.at(i) == ":" else None
                k = self.type_(typed, self.id) if typed else i
                stop = self.expression_end(k + 1, end, True) if self.at(k) == "=" else k
                ident = self.declare(owner, scope, name, "field", start, stop - 1, False, None) if made else owner
                if typed:
                    self.type_(typed, ident)
                self.scan(k + 1, stop, ident)
                i = max(stop, start + 1)
            i += self.at(i) in (";", ",")

    def function(self, start, i, end, scope, owner, exported, default) -> int:
        k = i + 1 + (self.at(i + 1) == "*")
        name = self.t[k].text if self.is_name(k) else None
        k += name is not None
        p = self.angle(k) or k + 1 if self.at(k) == "<" else k
        body = self.after(p) if self.at(p) == "(" else p
        if self.at(body) == ":":
            body = self.type_(body + 1, self.id)
        stop = self.after(body) if self.at(body) == "{" else body
        if self.at(body) != "{":  # an overload: the one with a body stands for it
            return max(stop, i + 1) + (self.at(stop) == ";")
        text = f"function {name}{self.source(p, self.after(p))}"
        ident = self.declare(owner, scope, name, "function", start, stop - 1, exported, text) if name else owner
        if default and name:
            self.add("default", self.id, ident, name, self.t[i].start)
        if self.at(k) == "<":
            self.arguments(k, ident)
        if self.at(p) == "(":
            self.parameters(p, ident)
            if self.at(self.after(p)) == ":":
                self.type_(self.after(p) + 1, ident)
        if self.at(body) == "{":
            self.scan(body + 1, stop - 1, ident)
        return max(stop, i + 1)

    def alias(self, start, i, end, scope, owner, exported) -> int:
        k = i + 2
        equal = self.angle(k) or k + 1 if self.at(k) == "<" else k
        stop = self.type_(equal + 1, self.id)
        self.declare(owner, scope, self.t[i + 1].text, "type_alias", start, stop - 1, exported, self.first_line(start, stop))
        return stop

    def variables(self, start, i, end, scope, owner, exported) -> int:
        stop = self.expression_end(i, end, False, True)
        k = i + 1
        while k < stop:
            pattern = self.at(k) in ("{", "[")
            name, k = self.t[k].text, self.after(k) if pattern else k + 1
            k += self.at(k) == "!"
            typed = k + 1 if self.at(k) == ":" else None
            value = self.type_(typed, self.id) if typed else k
            last = self.expression_end(value, stop, True)
            arrow = self.at(value) == "=" and self.makes_function(value + 1)
            signature = name + self.parameter_texts(arrow) if arrow else None
            ident = owner if pattern else self.declare(owner, scope, name, "function" if arrow is not None else "constant", start, stop - 1, exported, signature)
            if typed:
                self.type_(typed, ident)
            self.scan(value + 1, last, ident)
            if self.at(last) != ",":
                break
            k = last + 1
        return stop + (self.at(stop) == ";")

    def makes_function(self, i: int) -> int | None:
        """The place of the parameters if a function stands at ``i``."""
        i += self.at(i) == "async" and self.same_line(i + 1)
        if self.at(i) == "function":
            i += 1 + (self.at(i + 1) == "*")
            i += self.is_name(i)
            return self.angle(i) or i if self.at(i) == "<" else i
        if self.is_name(i) and self.at(i + 1) == "=>":
            return i
        p = self.angle(i) or i if self.at(i) == "<" else i
        return p if self.at(p) == "(" and self.is_arrow(p) else None

    def is_arrow(self, p: int) -> bool:
        k = self.after(p)
        if self.at(k) == ":":
            k = self.type_(k + 1, self.id)
        return self.at(k) == "=>"

    # Expressions.
    def expression_end(self, i: int, end: int, comma: bool = False, commas: bool = False) -> int:
        """The place behind an expression; ``comma`` ends it too, ``commas`` carries on over line breaks after one."""
        first = i
        while i < end:
            x = self.at(i)
            if x in (")", "]", "}", ";") or x == "," and comma:
                return i
            if i > first and self.t[i].fresh:
                before = self.at(i - 1)
                goes_on = x in (".", "?.", "?", ":", "&&", "||", "??", "+", "-", "*", "/", "%", "==", "===", "!=", "!==", "=>", "=", "|", "&", ",", ">", "<", "<=", "instanceof", "in", "as", "satisfies") or x == "{" and before in (")", "else", "try", "do", "finally", "=>") \
                    or before in ASSIGNS or before in ("=>", "(", "[", ",", "+", "-", "*", "/", "%", "&&", "||", "??", "?", ":", ".", "?.", "==", "===", "!=", "!==", "<", ">", "<=", "|", "&", "!", "in", "of", "new", "typeof", "instanceof", "await", "as", "const", "let", "var", "extends") \
                    or x in ("else", "catch", "finally") or (self.t[i - 1].kind == "string" and self.t[i].kind == "sign" and x == "${")
                if not goes_on:
                    return i
            generic = self.angle(i) if x == "<" else None
            i = self.after(i) if x in ("(", "[", "{", "${") else generic if generic and self.at(generic) in ("(", "=>") else i + 1
        return i

    def scan(self, i: int, end: int, owner: str) -> None:
        while i < end:
            t, x = self.t[i], self.at(i)
            if t.kind != "name":
                if x == "(" and self.is_arrow(i):
                    self.parameters(i, owner)
                    i = self.after(i)
                    i = self.type_(i + 1, owner) if self.at(i) == ":" else i
                else:
                    i += 1
            elif self.at(i - 1) in (".", "?."):
                i = self.reference(i, owner)
            elif x in ("import", "require") and self.at(i + 1) == "(":
                if source := self.string(i + 2):
                    self.add("dynamic_import", self.id, None, source, t.start)
                i = self.after(i + 1) if self.string(i + 2) else i + 2
            elif x in ("const", "let", "var"):
                i += 1
                if self.is_name(i) or self.at(i) in ("{", "["):
                    i = self.local(i, owner)
                    i = self.type_(i + 1, owner) if self.at(i) == ":" else i
            elif x == "function":
                i += 1 + (self.at(i + 1) == "*")
                i += self.is_name(i)
                i = self.arguments(i, owner) if self.at(i) == "<" else i
                if self.at(i) == "(":
                    self.parameters(i, owner)
                    i = self.after(i)
                    i = self.type_(i + 1, owner) if self.at(i) == ":" else i
            elif x == "class" and (self.is_name(i + 1) or self.at(i + 1) == "{"):
                brace = i + 1
                while brace < end and self.at(brace) != "{":
                    brace = self.after(brace) if self.at(brace) in ("(", "[") else self.angle(brace) or brace + 1 if self.at(brace) == "<" else brace + 1
                self.members(brace + 1, self.close.get(brace, self.n), None, owner)
                i = self.after(brace)
            elif x in ("as", "satisfies") and (self.is_name(i - 1) or self.at(i - 1) in (")", "]", "}") or self.t[i - 1].kind in ("string", "number")) and self.same_line(i):
                i = self.type_(i + 1, owner)
            elif x == "catch" and self.at(i + 1) == "(":
                self.parameters(i + 1, owner)
                i = self.after(i + 1)
            elif x == "type" and self.is_name(i + 1) and self.at(i + 2) in ("=", "<") and t.fresh:
                k = self.angle(i + 2) or i + 3 if self.at(i + 2) == "<" else i + 2
                i = self.type_(k + 1, owner)
            elif x in WORDS:
                i += 1
            else:
                i = self.reference(i, owner)

    def reference(self, i: int, owner: str) -> int:
        member, creates = self.at(i - 1) in (".", "?."), self.created(i)
        behind = (self.angle(i + 1) if self.at(i + 1) == "<" else None) or i + 1
        opens = self.at(behind)
        if opens == "?." and self.at(behind + 1) == "(":
            behind, opens = behind + 1, "("
        if opens == "(" or creates and self.at(i + 1) != ".":
            method = not creates and opens == "(" and self.at(self.after(behind)) == "{" and self.at(i - 1) in ("{", ",", "async", "get", "set", "*")
            if method:  # of an object in braces
                self.parameters(behind, owner)
                return self.after(behind)
            if behind > i + 1 and opens == "(":
                self.arguments(i + 1, owner)
            self.refers(owner, i, "new" if creates else "call")
            return behind if opens == "(" else i + 1
        key = self.at(i + 1) == ":" and self.at(i - 1) in ("{", ",") or self.at(i + 1) == ":" and self.t[i].fresh
        parameter = self.at(i + 1) == "=>"
        if parameter:
            self.local(i, owner)
        if self.at(i + 1) in ASSIGNS or self.at(i + 1) in ("++", "--") and self.same_line(i + 1) or self.at(i - 1) in ("++", "--"):
            self.refers(owner, i, "write")
        elif not (member or key or parameter):
            self.refers(owner, i, "read")
        return i + 1

    def created(self, i: int) -> bool:
        """Whether ``new`` stands before the path that ends at ``i``."""
        while self.at(i - 1) == "." and self.is_name(i - 2):
            i -= 2
        return self.at(i - 1) == "new"
