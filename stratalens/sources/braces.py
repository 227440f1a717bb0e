"""Definitions, calls and imports of the brace languages: a tokenizer, bracket pairs, and one pass over the tokens.

Two readers share them: Script for JavaScript and TypeScript, Typed for Java, C and C++. Each goes over its tokens once
and calls itself for the bodies that open a scope. String contents never enter a signature.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>R"(?P<tag>[^\s()\\]{0,16})\(.*?\)(?P=tag)"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<word>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|->|::|\?\.|\.\.\.|&&|\|\||[=!<>]=+|.)""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_DIRECTIVE = re.compile(r"[ \t]*#(?:\\\r?\n|[^\n])*")
_INCLUDE = re.compile(r"\s*#\s*include\s*(?:<([^>\n]*)>|\"([^\"\n]*)\")")
_PAIRS = {")": "(", "]": "[", "}": "{"}
#: Before these a slash begins a regular expression.
_OPERATORS = set("(,=:[!&|?{};+-*%<>~^") | {"=>", "&&", "||", "==", "===", "!=", "!==", "return", "typeof", "case", "in", "of"}


class Reader:
    """The tokens of a text; symbols (name, kind, line, signature, end line) and edges (from, to, kind, line) found so far."""

    regexes = directives = False
    no_call: frozenset = frozenset()

    def __init__(self, text: str):
        self.text, self.kind, self.tok, self.at, self.end, self.pair = text, [], [], [], [], {}
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.symbols, self.edges, self.deepest = [], [], 0
        self._tokenize()

    def _tokenize(self) -> None:
        pos, open_, text, new_line = 0, [], self.text, True
        while pos < len(text):
            if self.directives and new_line and (m := _DIRECTIVE.match(text, pos)):
                if inc := _INCLUDE.match(m[0]):
                    self.edges.append(("<module>", inc[1] or inc[2] or "", "import", self.line_at(pos + len(m[0]) - len(m[0].lstrip()))))
                pos = m.end()
                continue
            m = self.regexes and text[pos] == "/" and (not self.tok or self.tok[-1] in _OPERATORS) and _REGEX.match(text, pos)
            kind = "number" if m else None
            m = m or _TOKEN.match(text, pos)
            kind = kind or m.lastgroup if m.lastgroup != "tag" else "string"
            new_line = kind == "skip" and "\n" in m[0] or new_line and kind == "skip"
            pos = m.end()
            if kind == "skip":
                continue
            i, t = len(self.tok), m[0]
            self.kind.append(kind)
            self.tok.append(t)
            self.at.append(m.start())
            self.end.append(m.end())
            if kind == "sign" and t in "([{":
                open_.append(i)
                self.deepest = max(self.deepest, len(open_))
            elif kind == "sign" and t in _PAIRS:
                while open_ and self.tok[open_[-1]] != _PAIRS[t]:  # a bracket that nothing closes
                    open_.pop()
                if open_:
                    j = open_.pop()
                    self.pair[i], self.pair[j] = j, i

    def line_at(self, pos: int) -> int:
        return bisect_right(self.breaks, pos - 1) + 1

    def line(self, i: int) -> int:
        return self.line_at(self.at[i])

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tok) and self.tok[i] in texts and self.kind[i] != "string"

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tok) and self.kind[i] == "word"

    def after(self, i: int) -> int:
        """The place behind the bracket pair that opens at i; behind i where it is none."""
        return max(self.pair.get(i, i), i) + 1

    def shown(self, lo: int, hi: int) -> str:
        """The text of the tokens lo..hi - 1, strings as <str>."""
        hi = min(hi, len(self.tok))
        out, pos = [], self.at[lo] if lo < hi else 0
        for i in range(lo, hi):
            if self.kind[i] == "string":
                out += [self.text[pos : self.at[i]], "<str>"]
                pos = self.end[i]
        return "".join([*out, self.text[pos : self.end[hi - 1]]]) if lo < hi else ""

    def chain(self, i: int) -> int:
        """The first token of the member chain that ends with the name at i."""
        while self.is_(i - 1, ".", "?.", "->", "::"):
            j = i - 2
            while self.is_(j, ")", "]") and j in self.pair and (self.word(self.pair[j] - 1) or self.is_(self.pair[j] - 1, ")", "]")) and self.tok[self.pair[j] - 1] not in self.no_call:
                j = self.pair[j] - 1
            if self.is_(j, ")", "]") and j in self.pair:
                return self.pair[j]
            if j < 0 or self.kind[j] == "sign" and not self.is_(j, "]"):
                return i if self.is_(i - 1, "::") else i - 1
            i = j
        return i

    def angles(self, i: int) -> int:
        """Behind the type arguments <...> that open at i; i where there are none."""
        if not self.is_(i, "<"):
            return i
        depth, j = 0, i
        while j < len(self.tok) and (self.kind[j] == "word" or self.tok[j] in "<>,.?&[]*|:" or self.is_(j, "::", "...")):
            depth += (self.tok[j] == "<") - (self.tok[j] == ">")
            j += 1
            if depth == 0:
                return j
        return i


class Script(Reader):
    """JavaScript and TypeScript."""

    regexes = True
    no_call = frozenset("if for while switch catch with return typeof await function super import new do else in of case throw delete void yield instanceof".split())
    begins = frozenset("; { } export default async declare abstract".split())

    def read(self):
        self.walk(0, len(self.tok), (), None)
        return self.symbols, self.edges

    def named(self, name: str, classes: tuple) -> tuple[str, str]:
        return ".".join((*classes, name)), "method" if classes else "function"

    def statement(self, i: int) -> bool:
        """Whether a statement can begin at i."""
        return i == 0 or self.is_(i - 1, *self.begins) or self.is_(i - 1, ")") or self.line(i - 1) < self.line(i) and not (self.kind[i - 1] == "sign" and self.tok[i - 1] not in ")]}") and not self.is_(i - 1, "return", "new")

    def body(self, i: int) -> int | None:
        """The brace that opens the body behind the parameters that end before i, type annotations aside."""
        if self.is_(i, ":"):
            i += 1
            while i < len(self.tok) and not self.is_(i, ";", "=", "=>", ",", ")", "]", "}"):
                if self.is_(i, "{") and not self.is_(i - 1, ":", "|", "&", "<", ",", "=>", "is"):
                    return i
                i = self.after(i)
            return None
        return i if self.is_(i, "{") else None

    def arrow(self, i: int) -> tuple[int, int, int] | None:
        """(first, last of the parameters, place behind the arrow) of an arrow function at i."""
        if self.is_(i, "async") and not self.is_(i + 1, "=>"):
            i += 1
        i = self.angles(i)
        if self.word(i) and self.is_(i + 1, "=>"):
            return i, i, i + 2
        if not self.is_(i, "(") or i not in self.pair:
            return None
        j = self.pair[i] + 1
        if self.is_(j, ":"):
            while j < len(self.tok) and not self.is_(j, "=>", ";", "{", "="):
                j = self.after(j)
        return (i, self.pair[i], j + 1) if self.is_(j, "=>") else None

    def value_end(self, i: int, hi: int) -> int:
        """Behind the expression at i: before a comma, a semicolon, or a line that cannot go on with it."""
        first = i
        while i < hi and not self.is_(i, ",", ";", ")", "]", "}"):
            if i > first and self.line(i - 1) < self.line(i) and not (self.kind[i - 1] == "sign" and self.tok[i - 1] not in ")]}") and not (self.kind[i] == "sign" and self.tok[i] not in "{([!~"):
                break
            i = self.after(i)
        return min(i, hi)

    def walk(self, lo: int, hi: int, classes: tuple, owner: str | None) -> None:
        i, hi = lo, min(hi, len(self.tok))
        while i < hi:
            t = self.tok[i] if self.kind[i] == "word" else ""
            member = self.is_(i - 1, ".", "?.")
            if member or not t:
                i = self.call(i, owner) if t else i + 1
            elif t == "import" and not self.is_(i + 1, "(", "."):
                j = i + 1
                while j < hi and self.kind[j] != "string" and not self.is_(j, ";", "="):
                    j += 1
                if j < hi and self.kind[j] == "string":
                    self.edges.append(("<module>", self.tok[j].strip("'\"`"), "import", self.line(i)))
                i = j + 1
            elif t == "function":
                i = self.function(i, classes, owner)
            elif t == "class":
                i = self.class_(i, hi, classes, owner)
            elif t in ("const", "let", "var") and (self.word(i + 1) or self.is_(i + 1, "{", "[")):
                i = self.variables(i + 1, hi, classes, owner)
            elif (j := self.angles(i + 1)) and self.is_(j, "(") and j in self.pair and t not in self.no_call and (b := self.body(self.pair[j] + 1)) and b in self.pair:
                first = i
                while self.is_(first - 1, "async", "get", "set", "static", "public", "private", "protected", "override", "*"):
                    first -= 1
                name = ".".join((*classes, t))
                self.symbols.append((name, "method", self.line(first), f"{t}{self.shown(j, self.pair[j] + 1)}", self.line(self.pair[b])))
                self.walk(j + 1, self.pair[j], classes, name)
                self.walk(b + 1, self.pair[b], classes, name)
                i = self.pair[b] + 1
            else:
                i = self.call(i, owner)

    def function(self, i: int, classes: tuple, owner: str | None) -> int:
        first = i - 1 if self.is_(i - 1, "async") else i
        j = i + 1 + self.is_(i + 1, "*")
        name, j = (self.tok[j], j + 1) if self.word(j) else (None, j)
        j = self.angles(j)
        if not self.is_(j, "(") or j not in self.pair or (b := self.body(self.pair[j] + 1)) not in self.pair:
            return i + 1
        if name and self.statement(first):
            full, kind = self.named(name, classes)
            self.symbols.append((full, kind, self.line(first), f"function {name}{self.shown(j, self.pair[j] + 1)}", self.line(self.pair[b])))
            owner = full
        self.walk(j + 1, self.pair[j], classes, owner)
        self.walk(b + 1, self.pair[b], classes, owner)
        return self.pair[b] + 1

    def class_(self, i: int, hi: int, classes: tuple, owner: str | None) -> int:
        name = self.tok[i + 1] if self.word(i + 1) and self.tok[i + 1] not in ("extends", "implements") else None
        b = i + 1
        while b < hi and not self.is_(b, "{", ";") and not (b > i + 1 and self.is_(b, "class") and not self.is_(b - 1, "extends")):
            b = self.after(b)
        if b >= hi or not self.is_(b, "{") or b not in self.pair:
            return i + 1
        self.walk(i + 2 if name else i + 1, b, classes, owner)
        if name and self.statement(i):
            self.symbols.append((".".join((*classes, name)), "class", self.line(i - 1 if self.is_(i - 1, "abstract") else i), f"class {name}", self.line(self.pair[b])))
            classes = (*classes, name)
        self.walk(b + 1, self.pair[b], classes, owner)
        return self.pair[b] + 1

    def variables(self, i: int, hi: int, classes: tuple, owner: str | None) -> int:
        """The declarators from i on; functions among their values are definitions."""
        while i < hi:
            start, j = i, self.after(i) if self.is_(i, "{", "[") else i + 1
            while j < hi and not self.is_(j, "=", ",", ";", "of", "in", ")") and (j == i + 1 or self.line(j - 1) == self.line(j)):
                j = self.after(j)  # a type annotation
            if not self.is_(j, "="):
                if self.is_(j, ","):
                    i = j + 1
                    continue
                return j + 1 if self.is_(j, "of", "in") else max(j, i + 1)
            v, end = j + 1, self.value_end(j + 1, hi)
            a = self.arrow(v)
            f = v + 1 if self.is_(v, "async") else v
            if self.word(start) and (a or self.is_(f, "function")):
                full, kind = self.named(self.tok[start], classes)
                if a:
                    lo, last, b = a
                    shown = self.shown(lo, last + 1) if self.is_(lo, "(") else "()"
                else:
                    lo = f + 1
                    while lo < end and not self.is_(lo, "("):
                        lo += 1
                    last = max(self.pair.get(lo, lo), lo)
                    b, shown = last + 1, self.shown(lo, last + 1)
                self.symbols.append((full, kind, self.line(start), f"{self.tok[start]}{shown}", self.line(max(end - 1, start))))
                self.walk(lo, last + 1, classes, full)
                self.walk(b, end, classes, full)
            else:
                self.walk(v, end, classes, owner)
            if not self.is_(end, ","):
                return end
            i = end + 1
        return hi

    def call(self, i: int, owner: str | None) -> int:
        """The edges of a call of the name at i, if it is one; the arguments come next."""
        j = self.angles(i + 1)
        if self.is_(j, "("):
            first = self.chain(i)
            member = first != i
            if not self.is_(first - 1, "new") and (member or self.tok[i] not in self.no_call and self.tok[i] != "this"):
                if member:
                    self.edges.append((owner or "<module>", self.shown(first, i + 1), "call", self.line(first)))
                self.edges.append((owner or "<module>", self.tok[i], "call", self.line(first)))
        return i + 1


class Typed(Reader):
    """Java, C and C++."""

    no_call = frozenset("if for while switch catch return sizeof alignof decltype throw new delete else do case synchronized assert try super this static_assert operator co_return co_await typeof".split())
    before_call = frozenset("return else throw case do new in goto co_return co_await co_yield delete and or not".split())

    def __init__(self, text: str, lang: str):
        self.lang, self.directives = lang, lang != "java"
        self.opens = {"java": ("class", "interface", "enum", "record"), "c": (), "cpp": ("class", "struct")}[lang]
        super().__init__(text)

    def read(self):
        self.scope(0, len(self.tok), (), None)
        return self.symbols, self.edges

    def signature(self, lo: int, hi: int) -> str:
        return re.sub(r"\s+", " ", self.shown(lo, hi)).strip().rstrip("{").rstrip().rstrip(";").strip()

    def scope(self, lo: int, hi: int, classes: tuple, owner: str | None) -> None:
        """Declarations, one after the other."""
        i = lo
        while i < hi:
            if self.is_(i, ";", "}") or self.is_(i, "public", "private", "protected") and self.is_(i + 1, ":"):
                i += 1 + self.is_(i + 1, ":")
            elif self.is_(i, "template") and self.is_(i + 1, "<"):
                depth, i = 0, i + 1
                while i < hi:
                    depth += (self.tok[i] == "<") - (self.tok[i] == ">")
                    i += 1
                    if not depth:
                        break
            elif self.lang == "java" and self.is_(i, "import"):
                j = i + 1
                while j < hi and not self.is_(j, ";"):
                    j += 1
                name = "".join(self.tok[i + 1 : j]).removeprefix("static") if self.is_(i + 1, "static") else "".join(self.tok[i + 1 : j])
                self.edges.append(("<module>", name, "import", self.line(i)))
                i = j + 1
            else:
                i = self.declaration(i, hi, classes, owner)

    def declaration(self, lo: int, hi: int, classes: tuple, owner: str | None) -> int:
        """One declaration from lo on; returns the place behind it."""
        i, open_, assigned = lo, None, False
        while i < hi and not self.is_(i, ";"):
            if self.word(i) and self.tok[i] in self.opens and self.word(i + 1) and not self.is_(i - 1, "enum", ".", "::") and open_ is None and not assigned:
                if (end := self.type_(lo, i, hi, classes, owner)) is not None:
                    return end
            if self.is_(i, "namespace", "extern") and self.is_(self.braced(i, hi), "{"):
                b = self.braced(i, hi)
                if b in self.pair and all(self.kind[k] in ("word", "string") or self.is_(k, "::") for k in range(i + 1, b)):
                    self.scope(b + 1, self.pair[b], classes, owner)
                    return self.pair[b] + 1
            if self.is_(i, "@") or self.kind[i] == "word" and self.tok[i].startswith("@"):
                i = self.after(i + 1) if self.is_(i + 1, "(") else i + 1
                continue
            if self.is_(i, "=") and not self.is_(i - 1, "operator"):
                assigned = True
            if self.is_(i, "(") and open_ is None and not assigned:
                if self.is_(i - 1, "operator") and self.is_(i + 1, ")"):  # operator()
                    i += 2
                    continue
                open_ = i
            if self.is_(i, "{"):
                break
            i = self.after(i)
        name = self.name(lo, open_) if open_ in self.pair else None
        if name and not self.is_(open_ + 1, "*", "&") and not self.is_(lo, "typedef", "using", "return"):
            return self.callable_(lo, hi, open_, *name, classes, owner)
        end = self.after(i) if self.is_(i, "{") else i
        while end < hi and self.is_(i, "{") and (assigned or self.is_(end, ",", "=")) and not self.is_(end, ";"):
            end = self.after(end)
        self.calls(lo, min(end, hi), classes, owner)
        return max(end, lo + 1)

    def braced(self, i: int, hi: int) -> int:
        while i < hi and not self.is_(i, "{", ";", "(", "="):
            i += 1
        return i

    def type_(self, lo: int, i: int, hi: int, classes: tuple, owner: str | None) -> int | None:
        """A class from its keyword at i on; None where this is no definition of one."""
        b = i + 1
        while b < hi and not self.is_(b, "{", ";", "=") and (not self.is_(b, "(") or self.is_(i, "record")):
            if b > i + 1 and self.tok[b] in self.opens and self.word(b) and self.word(b - 1):
                return None  # another begins before this one's body
            b = self.after(b)
        name = self.tok[i + 1]
        k = i + 2
        while self.lang == "cpp" and self.is_(k, "::") and self.word(k + 1):
            name, k = f"{name}::{self.tok[k + 1]}", k + 2
        first = lo if self.lang == "java" else i
        if b >= hi or not self.is_(b, "{") or b not in self.pair:
            if self.lang == "cpp" and self.is_(b, ";") and b == k:
                self.symbols.append((".".join((*classes, name)), "class", self.line(first), self.signature(first, b), self.line(b - 1)))
                return b + 1
            return None
        self.symbols.append((".".join((*classes, name)), "class", self.line(first), self.signature(first, b), self.line(self.pair[b])))
        self.calls(lo, i, classes, owner)
        self.calls(k, b, classes, owner)  # behind the keyword, which would lead here again
        self.scope(b + 1, self.pair[b], (*classes, name), owner)
        return self.pair[b] + 1

    def name(self, lo: int, open_: int) -> tuple[str, int] | None:
        """(name, its first token) before the parameters at open_."""
        i = open_ - 1
        for k in range(i, max(lo - 1, i - 4), -1):
            if self.is_(k, "operator"):
                first, name = k, "operator" + "".join(self.tok[k + 1 : open_])
                break
        else:
            if not self.word(i) or self.tok[i] in self.no_call or self.tok[i].startswith("@"):
                return None
            first, name = i, self.tok[i]
            if self.is_(i - 1, "~"):
                first, name = i - 1, f"~{name}"
        while self.lang == "cpp" and first - 2 >= lo and self.is_(first - 1, "::") and self.word(first - 2):
            first, name = first - 2, f"{self.tok[first - 2]}::{name}"
        return name, first

    def callable_(self, lo: int, hi: int, open_: int, name: str, first: int, classes: tuple, owner: str | None) -> int:
        """A function whose parameters open at open_: a definition with a body, or a declaration without."""
        i, close = self.pair[open_] + 1, self.pair[open_]
        own = name.split("::")[-1].lstrip("~") in (classes[-1:] or (name.split("::")[0],)) or "operator" in name
        typed = first > lo or own
        if self.is_(i, ":") and self.lang == "cpp":  # what a constructor initialises
            i += 1
            while i < hi and not (self.is_(i, "{") and not self.word(i - 1) and not self.is_(i - 1, ">")) and not self.is_(i, ";"):
                i = self.after(i)
        while i < hi and not self.is_(i, "{", ";"):
            i = self.after(i)
        defined = self.is_(i, "{") and i in self.pair
        clause = not defined and self.is_(i - 2, "=") and self.is_(i - 1, "default", "delete")
        literal = any(self.kind[k] in ("number", "string") and self.is_(k - 1, "(", ",") for k in range(open_ + 1, close))
        declared = not defined and not literal and (self.lang == "cpp" and typed or self.lang == "java" and first > lo and bool(classes))
        if not typed or not (defined or declared or clause and self.lang == "cpp"):
            self.calls(lo, min(self.after(i) if defined else i, hi), classes, owner)
            return max(self.after(i) if defined else i, lo + 1)
        full = ".".join((*classes, name))
        kind = "method" if classes or "::" in name else "function"
        self.symbols.append((full, kind, self.line(lo), self.signature(lo, i), self.line(self.pair[i]) if defined else self.line(min(i, len(self.tok) - 1))))
        if defined:
            self.calls(open_ + 1, self.pair[i], classes, full)
        return (self.pair[i] if defined else i) + 1

    def calls(self, lo: int, hi: int, classes: tuple, owner: str | None) -> None:
        """Calls and creations among the tokens; classes within open scopes of their own."""
        i = lo
        while i < hi:
            if not self.word(i):
                i += 1
                continue
            if self.tok[i] in self.opens and self.word(i + 1) and not self.is_(i - 1, ".", "::", "enum"):
                if (end := self.type_(i, i, hi, classes, owner)) is not None:
                    i = end
                    continue
            if self.is_(i, "new") and self.lang == "java":
                i = self.created(i, hi, classes, owner)
                continue
            j = self.angles(i + 1)
            if self.is_(j, "(") and self.tok[i] not in self.no_call:
                first = self.chain(i)
                before = first - 1
                declares = self.word(before) and self.tok[before] not in self.before_call and self.line(before) == self.line(first) and before >= lo
                if not declares and not self.is_(before, "new") and not self.tok[i].startswith("@"):
                    self.edges.append((owner or "<module>", self.tok[i], "call", self.line(first)))
            i += 1

    def created(self, i: int, hi: int, classes: tuple, owner: str | None) -> int:
        """new T(...): a call of T; a body that follows is a class without a name."""
        j = i + 1
        while self.word(j) and self.is_(j + 1, "."):
            j += 2
        open_ = self.angles(j + 1)
        if open_ == j + 1 and self.is_(open_, "<") and self.is_(open_ + 1, ">"):
            open_ += 2
        if not self.word(j) or not self.is_(open_, "(") or open_ not in self.pair:
            return i + 1
        self.edges.append((owner or "<module>", self.shown(j, open_), "call", self.line(i)))
        self.calls(open_ + 1, self.pair[open_], classes, owner)
        b = self.pair[open_] + 1
        if self.is_(b, "{") and b in self.pair:
            self.scope(b + 1, self.pair[b], classes, owner)
            return self.pair[b] + 1
        return b


def _read(reader: Reader):
    """What the reader finds; it calls itself a few times for each open bracket, so deep nesting gets its frames."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 1000 + 10 * reader.deepest))
    try:
        return reader.text.count("\n") + 1, *reader.read()
    finally:
        sys.setrecursionlimit(limit)


def script(text: str):
    """(lines, symbols, edges) of JavaScript or TypeScript."""
    return _read(Script(text))


def typed(lang: str):
    """The same for java, c or cpp."""
    return lambda text: _read(Typed(text, lang))
