"""A parser of Kotlin files: declarations, supertypes, types, calls, reads and writes.

Symbols are the functions, classes, interfaces and objects of a file and, inside these, functions, nested classes,
properties and the constructor's properties. What stands in enumerations' bodies and companions refers to things for
the class around it, without symbols of its own.
"""

from __future__ import annotations

from .tokens import Facts

#: Words that are no names in expressions, and those that stand before a declaration.
WORDS = frozenset("if for while when catch return throw fun class object interface val var super this try finally else do is as in import package constructor init true false null typealias by where break continue".split())
MODIFIERS = frozenset("public private internal protected open abstract sealed data inner enum annotation value override suspend inline noinline crossinline operator infix tailrec const lateinit companion external final expect actual vararg reified out in".split())
ASSIGNS = frozenset("= += -= *= /= %=".split())


class Kotlin(Facts):
    language, prefix, words = "kotlin", "kotlin:", WORDS

    def file(self) -> None:
        i, package = 0, None
        while i < self.n:
            if self.at(i) == "package" and self.is_name(i + 1):
                package, i = self.dotted(i + 1)
            elif self.at(i) == "import" and self.is_name(i + 1):
                i = self.imported(i)
            elif self.at(i) == "@" and self.at(i + 1) == "file":
                i = self.annotation(i, self.id)
            else:
                break
        name = package or "<default>"
        self.add("package", self.id, f"kotlin-package:{name}", name, 0)
        while i < self.n:
            i = self.imported(i) if self.at(i) == "import" and self.is_name(i + 1) else self.declaration(i, self.n, [], self.id)

    def type_place(self, owner: str, at: int) -> int:
        """Types count at their declaration's first line."""
        return self.starts[owner]

    def dotted(self, i: int) -> tuple[str, int]:
        parts = [self.t[i].text]
        while self.at(i + 1) == "." and self.is_name(i + 2) and self.same_line(i + 1):
            i += 2
            parts.append(self.t[i].text)
        return ".".join(parts), i + 1

    def imported(self, i: int) -> int:
        full, k = self.dotted(i + 1)
        if self.at(k) == "." and self.at(k + 1) == "*":
            return k + 2
        last = local = full.rpartition(".")[2]
        if self.at(k) == "as" and self.is_name(k + 1):
            local, k = self.t[k + 1].text, k + 2
        self.add("binding", self.id, None, local, self.t[i].start, detail=last, source=full)
        return k

    # Types: each returns the place behind; the last names of paths are told.
    def type_(self, i: int, owner: str) -> int:
        while True:
            while self.at(i) == "@" or self.at(i) in ("suspend", "in", "out") and (self.is_name(i + 1) or self.at(i + 1) in ("(", "*")):
                i = self.annotation(i, owner) if self.at(i) == "@" else i + 1
            brackets = self.at(i) == "("  # parameters of a function type, or a type in brackets
            if brackets:
                self.types_between(i + 1, self.close.get(i, self.n), owner)
                i = self.after(i)
            elif self.is_name(i):
                while self.at(i + 1) == "." and self.is_name(i + 2):
                    i = self.arguments(i + 1, owner) if self.at(i + 1) == "<" else i + 2
                self.uses_type(owner, i)
                i = self.arguments(i + 1, owner)
            elif self.at(i) == "*":
                return i + 1
            else:
                return i
            while self.at(i) in ("?", "!!"):
                i += 1
            if self.at(i) == "->" and brackets or self.at(i) == "&" or self.at(i) == "." and (self.is_name(i + 1) or self.at(i + 1) == "("):
                i += 1
                continue
            return i

    def types_between(self, i: int, end: int, owner: str) -> None:
        while i < end:
            if self.is_name(i) and self.at(i + 1) == ":":
                i += 2
            k = self.type_(i, owner)
            i = k + 1 if k == i or self.at(k) == "," else k

    def angle(self, i: int) -> int | None:
        """The place behind the type arguments that open at ``i``; none if it is a comparison."""
        depth, k = 0, i
        while k < self.n:
            x = self.at(k)
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif x == "(":
                k = self.close.get(k, self.n)
            elif not (self.is_name(k) and x not in WORDS - {"in"} or x in (",", ".", "?", "*", ":", "->", "&", "@")):
                return None
            k += 1
        return None

    def arguments(self, i: int, owner: str) -> int:
        """Type arguments or parameters, if there are any at ``i``."""
        end = self.angle(i) if self.at(i) == "<" else None
        if end:
            self.types_between(i + 1, end - 1, owner)
        return end or i

    def annotation(self, i: int, owner: str) -> int:
        i += 1
        if self.is_name(i) and self.at(i + 1) == ":":
            i += 2
        if self.at(i) == "[":
            return self.after(i)
        if self.is_name(i):
            _, i = self.dotted(i)
            i = self.angle(i) or i if self.at(i) == "<" else i
            if self.at(i) == "(" and self.same_line(i):
                i = self.after(i)
        return i

    def modifiers(self, i: int, owner: str) -> tuple[int, set[str]]:
        words: set[str] = set()
        while True:
            if self.at(i) == "@" and i + 1 < self.n:
                i = self.annotation(i, owner)
            elif self.at(i) in MODIFIERS and (self.is_name(i + 1) or self.at(i + 1) == "@"):
                words.add(self.at(i))
                i += 1
            else:
                return i, words

    # Declarations.
    def declaration(self, start: int, end: int, scope: list[str], owner: str) -> int:
        """One declaration, or the token that begins none; returns the place behind."""
        i, words = self.modifiers(start, owner)
        what, exported = self.at(i), "private" not in words
        if what == "fun" and self.at(i + 1) == "interface":
            what, i = "interface", i + 1
        if what in ("class", "interface", "object") and self.is_name(i + 1) and "companion" not in words:
            return self.class_(start, i, end, scope, owner, what, "enum" in words, exported)
        if what == "fun":
            return self.function(start, i, end, scope, owner, exported)
        if what in ("val", "var"):
            return self.property_(start, i, end, scope, owner, exported)
        if what == "typealias":
            return self.expression_end(i + 1, end)
        if what == "object" or what in ("init", "get", "set", "constructor"):
            while i < end and self.at(i) not in ("{", "=") and (i == start or not self.t[i].fresh or self.at(i) == ":"):
                i = self.after(i) if self.at(i) == "(" else i + 1
            stop = self.after(i) if self.at(i) == "{" else self.expression_end(i, end)
            self.scan(start, stop, owner)
            return max(stop, start + 1)
        if self.at(i) in ("{", "(", "["):
            self.scan(i, self.after(i), owner)
            return self.after(i)
        return max(i, start) + 1

    def class_(self, start, i, end, scope, owner, what, enum, exported) -> int:
        name, k = self.t[i + 1].text, i + 2
        head = k
        k = self.angle(k) or k if self.at(k) == "<" else k
        ahead, _ = self.modifiers(k, owner)
        constructor = None
        if self.at(ahead) == "constructor" and self.at(ahead + 1) == "(":
            constructor, k = (k, ahead + 1), self.after(ahead + 1)
        elif self.at(k) == "(":
            constructor, k = (k, k), self.after(k)
        supers = k + 1 if self.at(k) == ":" else None
        while k < end and self.at(k) != "{" and (not self.t[k].fresh or self.at(k) in (":", ",", "where", "by") or self.at(k - 1) in (":", ",", "where", "by")):
            k = self.after(k) if self.at(k) in ("(", "[") else self.angle(k) or k + 1 if self.at(k) == "<" else k + 1
        body = k if self.at(k) == "{" else None
        stop = self.after(k) if body else k
        ident = self.declare(owner, scope, name, "interface" if what == "interface" else "class", start, stop - 1, exported, self.signature(start, stop))
        inner = [*scope, name]
        if self.at(head) == "<":
            self.arguments(head, ident)
        if constructor:
            first, opening = constructor
            for prop, at in self.parameters(opening, ident):
                if prop:
                    last = self.close.get(opening, self.n)
                    field = self.declare(ident, inner, self.t[at].text, "field", first, last, True, self.signature(first, last + 1))
                    self.type_(at + 2, field)
        if supers:
            self.supertypes(supers, body or stop, ident)
        if body and enum:
            self.scan(body + 1, stop - 1, ident)
        elif body:
            at = body + 1
            while at < stop - 1:
                at = self.declaration(at, stop - 1, inner, ident)
        return max(stop, i + 2)

    def signature(self, first: int, stop: int) -> str:
        return self.source(first, stop).split("{")[0].split("=")[0].strip()

    def supertypes(self, i: int, end: int, owner: str) -> None:
        while i < end and self.at(i) != "where":
            while self.at(i) == "@":
                i = self.annotation(i, owner)
            if not self.is_name(i):
                i = self.after(i) if self.at(i) in ("(", "[") else i + 1
                continue
            path, k = self.dotted(i)
            while self.at(k) == "." and self.is_name(k + 1):  # a path over lines
                path, k = path + "." + self.t[k + 1].text, k + 2
            self.add("base", owner, None, path.rpartition(".")[2], self.t[i].start, detail="SUPER")
            k = self.arguments(k, owner) if self.at(k) == "<" else k
            if self.at(k) == "(":
                self.scan(k + 1, self.close.get(k, self.n), owner)
                k = self.after(k)
            if self.at(k) == "by":
                stop = k + 1
                while stop < end and self.at(stop) != ",":
                    stop = self.after(stop) if self.at(stop) in ("(", "[", "{") else stop + 1
                self.scan(k + 1, stop, owner)
                k = stop
            i = k + 1 if self.at(k) == "," else max(k, i + 1)

    def parameters(self, opening: int, owner: str) -> list[tuple[bool, int]]:
        """(whether it is a property, its name's place) of each parameter; types and defaults are told."""
        out, i, end = [], opening + 1, self.close.get(opening, self.n)
        while i < end:
            i, _ = self.modifiers(i, owner)
            prop = self.at(i) in ("val", "var")
            i += prop
            if self.is_name(i) and self.at(i + 1) == ":":
                out.append((prop, i))
                i = self.type_(i + 2, owner)
            stop = i
            while stop < end and self.at(stop) != ",":
                stop = self.after(stop) if self.at(stop) in ("(", "[", "{") else self.angle(stop) or stop + 1 if self.at(stop) == "<" else stop + 1
            self.scan(i, stop, owner)
            i = stop + 1
        return out

    def named(self, i: int, owner: str | None) -> tuple[int, int]:
        """(start of a receiver, place of the name) behind fun, val or var and their type parameters."""
        if self.at(i) == "<":
            i = self.angle(i) or i + 1
        while self.at(i) == "@":
            i = self.annotation(i, self.id)
        start, k = i, i
        if self.at(k) == "(":  # a receiver of a function type or in brackets
            k = self.after(k)
        while k < self.n:
            if self.is_name(k):
                k += 1
            elif self.at(k) == "<" and (behind := self.angle(k)):
                k = behind
            while self.at(k) == "?":
                k += 1
            if self.at(k) in (".", "?.") and self.is_name(k + 1):
                k += 1
            elif not (self.at(k) == "<" and self.angle(k)):
                break
        return start, max(k - 1, i)

    def function(self, start, i, end, scope, owner, exported) -> int:
        head, name = self.named(i + 1, owner)
        if not self.is_name(name) or self.at(name + 1) != "(":
            return self.expression_end(i + 1, end)
        k = self.after(name + 1)
        result = k + 1 if self.at(k) == ":" else None
        if result:
            k = self.type_(result, self.id)
        while self.at(k) == "where" or k > name + 2 and self.at(k - 1) == "where" or self.at(k) == "," or self.is_name(k) and self.at(k + 1) == ":" and self.at(k - 1) in ("where", ","):
            k = self.type_(k + 2, self.id) if self.is_name(k) and self.at(k + 1) == ":" else k + 1
        body = self.at(k)
        stop = self.after(k) if body == "{" else self.expression_end(k + 1, end) if body == "=" else k
        ident = self.declare(owner, scope, self.t[name].text, "method" if scope else "function", start, stop - 1, exported, self.signature(start, stop))
        if self.at(i + 1) == "<":
            self.arguments(i + 1, ident)
        if head < name:
            self.receiver_type(head, name - 1, ident)
        self.parameters(name + 1, ident)
        if result:
            self.type_(result, ident)
        if body in ("{", "="):
            self.scan(k + 1, stop, ident)
        return max(stop, i + 1)

    def receiver_type(self, i: int, end: int, owner: str) -> None:
        """The type before an extension's last dot."""
        last = None
        while i < end:
            if self.at(i) == "<":
                i = self.arguments(i, owner)
            elif self.at(i) == "(":
                self.types_between(i + 1, self.close.get(i, self.n), owner)
                i = self.after(i)
            else:
                last = i if self.is_name(i) else last
                i += 1
        if last is not None:
            self.uses_type(owner, last)

    def property_(self, start, i, end, scope, owner, exported) -> int:
        head, name = self.named(i + 1, owner)
        k = name + 1
        if self.at(i + 1) == "(":  # several at a time
            name, k = -1, self.after(i + 1)
        typed = k + 1 if self.at(k) == ":" else None
        if typed:
            k = self.type_(typed, self.id)
        value = k + 1 if self.at(k) in ("=", "by") else None
        stop = self.expression_end(value, end) if value else k
        while self.at(stop) in ("get", "set") or self.at(stop) in MODIFIERS and self.at(stop + 1) in ("get", "set"):  # accessors
            at = stop + (self.at(stop) in MODIFIERS) + 1
            at = self.after(at) if self.at(at) == "(" else at
            if self.at(at) == ":":
                at = self.type_(at + 1, self.id)
            stop = self.after(at) if self.at(at) == "{" else self.expression_end(at + 1, end) if self.at(at) == "=" else at
        if scope and self.is_name(name):  # a file's own properties are no symbols
            ident = self.declare(owner, scope, self.t[name].text, "field", start, stop - 1, exported, self.signature(start, stop))
            if head < name:
                self.receiver_type(head, name - 1, ident)
            if typed:
                self.type_(typed, ident)
            self.scan(k + 1, stop, ident)
        elif scope:
            self.scan(k, stop, owner)
        return max(stop, i + 1)

    # Expressions.
    def expression_end(self, i: int, end: int) -> int:
        """The place behind an expression that may go on over lines."""
        first = i
        while i < end:
            x = self.at(i)
            if x in (")", "]", "}", ";", ","):
                return i
            if i > first and self.t[i].fresh and x not in (".", "?.", "?:", "&&", "||", "::", "->", "else", "as") and self.at(i - 1) not in ("=", "+", "-", "*", "/", "%", "&&", "||", "?:", ".", "?.", "(", "->", "else", "in", "is", "as", "return", "by", "to", ">", "<") \
                    and not (x == "{" and self.at(i - 1) == ")"):
                return i
            i = self.after(i) if x in ("(", "[", "{", "${") else i + 1
        return i

    def scan(self, i: int, end: int, owner: str) -> None:
        """Calls, reads, writes and types between two places; declarations there are local, so no symbols."""
        while i < end:
            t, x = self.t[i], self.at(i)
            if t.kind != "name":
                i = self.annotation(i, owner) if x == "@" and self.is_name(i + 1) and self.at(i - 1) != "return" and (t.fresh or not self.is_name(i - 1)) else i + 1
            elif x in ("val", "var"):
                i = self.after(i + 1) if self.at(i + 1) == "(" else self.named(i + 1, owner)[1] + 1
                i = self.type_(i + 1, owner) if self.at(i) == ":" else i
            elif x == "fun":
                _, name = self.named(i + 1, owner)
                i = name + 1 if self.is_name(name) and self.at(i + 1) != "(" else i + 1
                if self.at(i) == "(":
                    self.parameters(i, owner)
                    i = self.after(i)
                    i = self.type_(i + 1, owner) if self.at(i) == ":" else i
            elif x in ("class", "interface") and self.is_name(i + 1) and self.at(i - 1) != "::":
                i += 2
                i = self.angle(i) or i if self.at(i) == "<" else i
                if self.at(i) == "(":
                    self.parameters(i, owner)
                    i = self.after(i)
                i = self.type_(i + 1, owner) if self.at(i) == ":" else i
            elif x == "object" and self.at(i + 1) == ":":
                i = self.type_(i + 2, owner)
            elif x in ("is", "as") and self.at(i - 1) not in (".", "::"):
                i = self.type_(i + 2 if self.at(i + 1) == "?" else i + 1, owner)
            elif x in WORDS or x in MODIFIERS and self.is_name(i + 1) and self.same_line(i + 1):
                i += 1
            elif self.at(i + 1) == "@" and self.same_line(i + 1) and self.t[i + 1].start == t.end:  # a label
                i += 2
            elif self.at(i + 1) == ":" and self.at(i + 2) != ":" and self.at(i - 1) not in (".", "?."):  # a parameter of a lambda or loop
                i = self.type_(i + 2, owner)
            else:
                i = self.reference(i, owner)

    def reference(self, i: int, owner: str) -> int:
        member = self.at(i - 1) in (".", "?.", "::") or self.at(i - 1) == "!!" and self.at(i) == "."
        behind = (self.angle(i + 1) if self.at(i + 1) == "<" and self.same_line(i + 1) else None) or i + 1
        opens = self.at(behind) if self.same_line(behind) else ""
        generic = behind > i + 1
        if opens == "(" or opens == "{" and (generic or not self.heads_block(i)):
            self.refers(owner, i, "call")
            if generic:
                self.types_between(i + 2, behind - 1, owner)
            return behind
        bracket = self.tokens.inside[i]
        in_call = bracket >= 0 and self.at(bracket) == "("
        if opens in ASSIGNS and not generic:
            if not in_call:  # there it names an argument
                self.refers(owner, i, "write")
        elif opens in ("++", "--") or self.at(i - 1) in ("++", "--"):
            self.refers(owner, i, "write")
        elif not member or self.at(i - 1) == "::":
            self.refers(owner, i, "read")
        return i + 1

    def heads_block(self, i: int) -> bool:
        """Whether a brace behind the name belongs to a statement: ``else -> x {`` does not, ``: Type {`` does."""
        return self.at(i - 1) in (":", "class", "interface", "object", "try", "do", "else", "finally")
