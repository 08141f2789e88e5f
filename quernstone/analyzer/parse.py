"""Facts of a JavaScript or TypeScript file: its imports, functions, classes, types and calls.

Brackets are matched over the tokens once; declarations are then found by a walk
over statements, so text that isn't understood is passed over and reported, not fatal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|\#![^\n]*)
  |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
  |(?P<number>\d[\w.]*)
  |(?P<name>[A-Za-z_$\u0080-￿#][\w$\u0080-￿]*)
  |(?P<punct>=>|\.\.\.|\?\.(?!\d)|&&=?|\|\|=?|\?\?=?|[{}()\[\];,<>=!+\-*%&|^~?:.@/])""",
    re.X | re.S,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
PAIRS = {"(": ")", "[": "]", "{": "}"}
MODIFIERS = {"public", "private", "protected", "static", "async", "readonly", "get", "set", "abstract", "override", "declare", "accessor"}
BRANCHES = {"if", "for", "while", "do", "case", "&&", "||", "??"}
LOOPS = {"for", "while", "do"}
NOT_CALLED = {"if", "for", "while", "switch", "catch", "return", "typeof", "function", "await", "new", "super", "import", "in", "of", "do", "else", "case", "throw", "void", "delete", "yield", "async", "constructor"}


@dataclass
class Token:
    kind: str
    text: str
    line: int


@dataclass
class Function:
    name: str
    line: int
    params: list[str]
    owner: str | None = None
    exported: bool = False
    is_async: bool = False
    generator: bool = False
    arrow: bool = False
    static: bool = False
    returns: str | None = None
    decorators: list[str] = field(default_factory=list)
    complexity: int = 1
    cognitive: int = 0
    nesting: int = 1
    loops: int = 0
    lines: int = 0


@dataclass
class Class:
    name: str
    line: int
    exported: bool = False
    extends: str | None = None
    implements: list[str] = field(default_factory=list)
    methods: list[Function] = field(default_factory=list)
    decorators: list[str] = field(default_factory=list)


@dataclass
class Call:
    name: str
    chain: str
    function: Function | None
    is_new: bool
    is_await: bool


@dataclass
class Module:
    imports: list[tuple[str, list[str], bool]] = field(default_factory=list)
    dynamic: list[str] = field(default_factory=list)
    exports: int = 0
    functions: list[Function] = field(default_factory=list)
    classes: list[Class] = field(default_factory=list)
    variables: list[tuple[str, int, bool, str | None]] = field(default_factory=list)
    interfaces: list[tuple[str, int, list[str]]] = field(default_factory=list)
    types: list[tuple[str, int, str]] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def tokenize(text: str) -> tuple[list[Token], list[str]]:
    out: list[Token] = []
    errors: list[str] = []
    at, line = 0, 1
    while at < len(text):
        c = text[at]
        if c == "`":
            end = _template(text, at)
            out.append(Token("string", text[at:end], line))
            line, at = line + text.count("\n", at, end), end
            continue
        if c == "/" and text[at + 1 : at + 2] not in ("/", "*"):
            before = out[-1] if out else None
            value = before and (before.kind in ("number", "string") or before.text in (")", "]", "}") or (before.kind == "name" and before.text not in ("return", "typeof", "case", "in", "of")))
            found = None if value or (before and before.text in "<>") else REGEX.match(text, at)
            if found:
                out.append(Token("string", found[0], line))
                at = found.end()
                continue
        found = TOKEN.match(text, at)
        if not found:
            errors.append(f"Line {line}: unexpected character {c!r}")
            at += 1
            continue
        if found.lastgroup != "skip":
            out.append(Token(found.lastgroup, found[0], line))
        line, at = line + found[0].count("\n"), found.end()
    return out, errors


def _template(text: str, at: int) -> int:
    """The end of a template literal, with the expressions inside of it."""
    at += 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                if text[at] == "`":
                    at = _template(text, at) - 1
                depth += {"{": 1, "}": -1}.get(text[at], 0)
                at += 1
        else:
            at += 1
    return len(text)


class _Parser:
    def __init__(self, text: str):
        self.module = Module()
        self.t, self.module.errors = tokenize(text)
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i, token in enumerate(self.t):
            if token.kind != "punct":
                continue
            if token.text in PAIRS:
                stack.append(i)
            elif token.text in PAIRS.values():
                while stack and PAIRS[self.t[stack[-1]].text] != token.text:
                    self.module.errors.append(f"Line {self.t[stack[-1]].line}: {self.t[stack[-1]].text} isn't closed")
                    self.close[stack.pop()] = i
                if stack:
                    self.close[stack.pop()] = i
                else:
                    self.module.errors.append(f"Line {token.line}: {token.text} closes nothing")
        for i in stack:
            self.module.errors.append(f"Line {self.t[i].line}: {self.t[i].text} isn't closed")
            self.close[i] = len(self.t)
        self.exported_names: set[str] = set()

    def text(self, i: int) -> str:
        return self.t[i].text if i < len(self.t) else ""

    def named(self, i: int) -> bool:
        return i < len(self.t) and self.t[i].kind == "name"

    def after(self, i: int) -> int:
        """Past the bracket that opens at i."""
        return self.close.get(i, i) + 1

    def angle(self, i: int) -> int:
        """Past type parameters at i, if there are any."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            depth += {"<": 1, ">": -1}.get(self.text(i), 0)
            i = self.after(i) if self.text(i) in PAIRS else i + 1
            if depth == 0:
                return i
        return i

    def type_end(self, i: int, *stops: str) -> int:
        """The end of a type annotation at i: one of stops, or a line end after which no type goes on."""
        start, depth = i, 0
        while i < len(self.t):
            x = self.text(i)
            if depth == 0 and x in stops and not (x == "{" and (i == start or self.text(i - 1) in ("|", "&", ":", "=>"))):
                return i
            if x in ")]}" and x:
                return i
            if depth == 0 and i > start and self.t[i].line > self.t[i - 1].line and x not in ("|", "&", "?", ":", "=>", ".") and self.text(i - 1) not in ("|", "&", "?", ":", "=>", "=", ",", "<"):
                return i
            depth += {"<": 1, ">": -1}.get(x, 0)
            i = self.after(i) if x in PAIRS else i + 1
        return i

    def joined(self, a: int, b: int) -> str:
        return " ".join(x.text for x in self.t[a:b])

    def params(self, i: int) -> list[str]:
        """The names of the parameters in the parentheses at i; of those that destructure, the text."""
        out, at, end = [], i + 1, self.close.get(i, i)
        while at < end:
            while self.text(at) in MODIFIERS | {"...", "@"} and not (self.text(at) in MODIFIERS and self.text(at + 1) in (",", ":", ")", "=", "?")):
                at += 2 if self.text(at) == "@" else 1
            if self.text(at) in PAIRS:
                out.append("".join(x.text for x in self.t[at : self.after(at)]))
            elif self.named(at):
                out.append(self.text(at))
            depth = 0
            while at < end and not (depth == 0 and self.text(at) == ","):
                depth += {"<": 1, ">": -1}.get(self.text(at), 0) if self.text(at - 1) != "=" else 0
                at = self.after(at) if self.text(at) in PAIRS else at + 1
            at += 1
        return out

    # -- declarations

    def signature(self, i: int, f: Function) -> int:
        """Past type parameters, parameters and return type at i; the body or arrow follows."""
        i = self.angle(i)
        if self.text(i) != "(":
            self.module.errors.append(f"Line {self.t[min(i, len(self.t) - 1)].line}: expected (")
            return i
        f.params = self.params(i)
        i = self.after(i)
        if self.text(i) == ":":
            end = self.type_end(i + 1, "{", ";", "=>" if f.arrow else "{")
            f.returns = self.joined(i + 1, end)
            i = end
        return i

    def body(self, i: int, f: Function) -> int:
        """The block at i, or nothing."""
        if self.text(i) != "{":
            return i
        end = self.close[i]
        first = self.t[i + 1].line if i + 1 < len(self.t) else self.t[i].line
        f.lines = (self.t[end].line if end < len(self.t) else self.t[-1].line) - (first if i + 1 < end else self.t[i].line)
        self.statements(i + 1, end, f, 1)
        return end + 1

    def function(self, i: int, exported: bool, is_async: bool, decorators: list[str], fallback: str = "") -> int:
        """At the word function."""
        f = Function("", self.t[i].line, [], exported=exported, is_async=is_async, decorators=decorators)
        i += 1
        if self.text(i) == "*":
            f.generator, i = True, i + 1
        if self.named(i):
            f.name, i = self.text(i), i + 1
        f.name = f.name or fallback
        self.module.functions.append(f)
        return self.body(self.signature(i, f), f)

    def arrow_at(self, i: int) -> bool:
        """Whether an arrow function begins at i."""
        i += self.text(i) == "async" and self.text(i + 1) != "=>"
        if self.named(i) and self.text(i + 1) == "=>":
            return True
        i = self.angle(i)
        if self.text(i) != "(":
            return False
        i = self.after(i)
        if self.text(i) == ":":
            i = self.type_end(i + 1, "=>", ";", ",")
        return self.text(i) == "=>"

    def arrow(self, i: int, name: str, line: int, exported: bool, outer: Function | None, depth: int) -> int:
        f = Function(name, line, [], exported=exported, arrow=True)
        if self.text(i) == "async" and self.text(i + 1) != "=>":
            f.is_async, i = True, i + 1
        if self.named(i):
            f.params, i = [self.text(i)], i + 1
        else:
            i = self.signature(i, f)
        i += self.text(i) == "=>"
        if name:
            self.module.functions.append(f)
        target = f if name else outer
        if self.text(i) == "{":
            if name:
                return self.body(i, f)
            self.statements(i + 1, self.close[i], target, depth + 1, counted=False)
            return self.after(i)
        end = self.expression_end(i)
        self.statements(i, end, target, 1, counted=bool(name), nested=True)
        if name and i < end:
            f.lines = self.t[end - 1].line - self.t[i].line
        return end

    def expression_end(self, i: int) -> int:
        """The end of an expression at i: a comma, semicolon or closing bracket, or a line that begins anew."""
        start = i
        while i < len(self.t):
            x = self.text(i)
            if x in (",", ";") or (x in (")", "]", "}")):
                return i
            if i > start and self.t[i].line > self.t[i - 1].line and self.t[i].kind in ("name", "string", "number") and self.t[i - 1].text not in ("=", "=>", "+", "-", "*", "/", "&&", "||", "??", "?", ":", "await", "new", "typeof", "return") and self.text(i) not in ("instanceof", "in", "as", "of"):
                return i
            if x == "@" or (x in ("function", "class") and i > start and self.t[i].line > self.t[i - 1].line):
                return i
            i = self.after(i) if x in PAIRS else i + 1
        return i

    def clause(self, i: int) -> tuple[list[str], int]:
        """The names of a comma-separated list of types at i."""
        out = []
        while self.named(i):
            name, i = self.text(i), i + 1
            while self.text(i) == "." and self.named(i + 1):
                name, i = f"{name}.{self.text(i + 1)}", i + 2
            out.append(name)
            i = self.angle(i)
            if self.text(i) != ",":
                break
            i += 1
        return out, i

    def class_(self, i: int, exported: bool, decorators: list[str]) -> int:
        c = Class("", self.t[i].line, exported, decorators=decorators)
        i += 1
        if self.named(i) and self.text(i) not in ("extends", "implements"):
            c.name, i = self.text(i), i + 1
        i = self.angle(i)
        if self.text(i) == "extends":
            if self.named(i + 1):
                c.extends = self.text(i + 1)
            i += 1
            while i < len(self.t) and self.text(i) not in ("{", "implements"):
                i = self.angle(i) if self.text(i) == "<" else self.after(i) if self.text(i) in "([" else i + 1
        if self.text(i) == "implements":
            c.implements, i = self.clause(i + 1)
        while i < len(self.t) and self.text(i) != "{":
            i += 1
        self.module.classes.append(c)
        if i >= len(self.t):
            return i
        end, i = self.close[i], i + 1
        while i < end:
            i = self.member(i, end, c)
        return end + 1

    def decorators(self, i: int) -> tuple[list[str], int]:
        out = []
        while self.text(i) == "@":
            names, i = self.clause(i + 1)
            out += names[:1]
            if self.text(i) == "(":
                i = self.after(i)
        return out, i

    def member(self, i: int, end: int, c: Class) -> int:
        decorators, i = self.decorators(i)
        f = Function("", self.t[min(i, len(self.t) - 1)].line, [], owner=c.name, decorators=decorators)
        while i < end and (self.text(i) == "*" or (self.text(i) in MODIFIERS and self.text(i + 1) not in ("(", "=", ":", ";", "?", "!"))):
            f.is_async |= self.text(i) == "async"
            f.static |= self.text(i) == "static"
            f.generator |= self.text(i) == "*"
            i += 1
        if self.text(i) == "{":
            return self.after(i)
        start = i
        i = self.after(i) if self.text(i) == "[" else i + 1
        if self.text(i) in ("?", "!"):
            i += 1
        if self.text(i) in ("(", "<") and self.t[start].kind in ("name", "string"):
            f.name = self.text(start).strip("\"'")
            i = self.signature(i, f)
            if self.text(i) == "{":
                self.module.functions.append(f)
                if f.name != "constructor":
                    c.methods.append(f)
                return self.body(i, f)
            return i + (self.text(i) == ";")
        if self.text(i) == ":":
            i = self.type_end(i + 1, "=", ";")
        if self.text(i) == "=":
            if self.arrow_at(i + 1) and self.t[start].kind == "name":
                i = self.arrow(i + 1, self.text(start), f.line, False, None, 1)
                self.module.functions[-1].owner = c.name
                c.methods.append(self.module.functions[-1])
            else:
                stop = self.expression_end(i + 1)
                self.statements(i + 1, stop, None, 1, counted=False)
                i = stop
        return i + (self.text(i) in (";", ",")) if i > start else start + 1

    def import_(self, i: int) -> int:
        at, names, type_only = i + 1, [], False
        if self.text(at) == "type" and self.text(at + 1) not in ("from", ","):
            type_only, at = True, at + 1
        if at < len(self.t) and self.t[at].kind == "string":
            self.module.imports.append((self.t[at].text[1:-1], [], False))
            return at + 1
        while at < len(self.t) and self.text(at) not in ("from", ";"):
            x = self.text(at)
            if x == "{":
                inner = at + 1
                while inner < self.close[at]:
                    inner += self.text(inner) == "type" and self.named(inner + 1) and self.text(inner + 1) != "as"
                    local = inner + 2 if self.text(inner + 1) == "as" else inner
                    names.append(self.text(local))
                    inner = local + 2
                at = self.after(at)
            else:
                if x == "as" or (self.named(at) and self.text(at - 1) != "as"):
                    if x != "as":
                        names.append(x)
                    else:
                        names.append(self.text(at + 1))
                        at += 1
                at += 1
        if self.text(at) == "from" and at + 1 < len(self.t) and self.t[at + 1].kind == "string":
            self.module.imports.append((self.t[at + 1].text[1:-1], names, type_only))
            return at + 2
        return at + 1

    def variable(self, i: int, exported: bool, f: Function | None, depth: int) -> int:
        """At const, let or var."""
        top = f is None
        i += 1
        while i < len(self.t):
            line, name, annotation = self.t[i].line, None, None
            if self.named(i):
                name, i = self.text(i), i + 1
                i += self.text(i) == "!"
            elif self.text(i) in PAIRS:
                i = self.after(i)
            if self.text(i) == ":":
                end = self.type_end(i + 1, "=", ";", ",")
                annotation, i = self.joined(i + 1, end), end
            if self.text(i) in ("of", "in"):
                return i
            if self.text(i) == "=":
                i += 1
                if name and self.arrow_at(i):
                    i = self.arrow(i, name, line, exported, f, depth)
                    name = None
                elif name and self.text(i + (self.text(i) == "async")) == "function":
                    is_async = self.text(i) == "async"
                    i = self.function(i + is_async, exported, is_async, [], name)
                    name = None
                elif name and self.text(i) == "require" and self.text(i + 1) == "(" and i + 2 < len(self.t) and self.t[i + 2].kind == "string":
                    self.module.imports.append((self.t[i + 2].text[1:-1], [name], False))
                    i = self.after(i + 1)
                else:
                    end = self.expression_end(i)
                    self.statements(i, end, f, depth, counted=False, nested=True)
                    i = end
            if name and top and depth == 0:
                self.module.variables.append((name, line, exported, annotation))
            if self.text(i) != ",":
                return i
            i += 1
        return i

    def declaration(self, i: int, exported: bool, f: Function | None, depth: int) -> int | None:
        """Past a declaration at i, or None if there is none."""
        decorators, i = self.decorators(i)
        x = self.text(i)
        if x == "abstract" and self.text(i + 1) == "class":
            x, i = "class", i + 1
        if x == "async" and self.text(i + 1) == "function":
            return self.function(i + 1, exported, True, decorators)
        if x == "function":
            return self.function(i, exported, False, decorators)
        if x == "class":
            return self.class_(i, exported, decorators)
        if x in ("const", "let", "var"):
            if self.text(i + 1) == "enum":
                return self.after(i + 3)
            return self.variable(i, exported, f, depth)
        if x == "interface" and self.named(i + 1):
            name, line, extends = self.text(i + 1), self.t[i].line, []
            i = self.angle(i + 2)
            if self.text(i) == "extends":
                extends, i = self.clause(i + 1)
            self.module.interfaces.append((name, line, extends))
            return self.after(i)
        if x == "type" and self.named(i + 1) and self.text(self.angle(i + 2)) == "=":
            begin = self.angle(i + 2) + 1
            end = self.type_end(begin, ";")
            self.module.types.append((self.text(i + 1), self.t[i].line, self.joined(begin, end)))
            return end
        if x == "enum" and self.named(i + 1):
            return self.after(i + 2)
        if x in ("declare", "namespace") and self.named(i + 1):
            while i < len(self.t) and self.text(i) not in ("{", ";"):
                i += 1
            return self.after(i)
        return None

    def export(self, i: int, f: Function | None) -> int:
        self.module.exports += 1
        i += 1
        if self.text(i) == "default":
            i += 1
            done = self.declaration(i, True, f, 0)
            return i if done is None else done
        if self.text(i) == "type" and self.text(i + 1) == "{":
            i += 1
        if self.text(i) in ("{", "*"):
            i = self.after(i) if self.text(i) == "{" else i + 1
            while self.text(i) in ("as", "from") or (i < len(self.t) and self.t[i].kind in ("name", "string") and self.text(i - 1) in ("as", "from")):
                i += 1
            return i
        done = self.declaration(i, True, f, 0)
        return i if done is None else done

    # -- statements and calls

    def statements(self, i: int, end: int, f: Function | None, depth: int, counted: bool = True, nested: bool = False) -> None:
        """Walk the tokens from i to end within f; depth is that of braces within it."""
        if f is None and depth == 0:
            counted = False
        count = f if counted else None
        if count:
            count.nesting = max(count.nesting, depth)
        while i < end:
            token, x = self.t[i], self.text(i)
            fresh = i == 0 or self.text(i - 1) in (";", "{", "}", ")") or token.line > self.t[i - 1].line or self.text(i - 1) in ("else", "do")
            if f is None and depth == 0 and x == "import" and self.text(i + 1) not in ("(", "."):
                i = max(self.import_(i), i + 1)
                continue
            if f is None and depth == 0 and x == "export":
                i = max(self.export(i, f), i + 1)
                continue
            if (fresh or x in ("function", "class")) and token.kind in ("name", "punct") and self.text(i - 1) != "." and not nested:
                done = self.declaration(i, False, f, depth) if x in ("async", "function", "class", "abstract", "const", "let", "var", "interface", "type", "enum", "declare", "namespace", "@") else None
                if done is not None and done > i:
                    i = done
                    continue
            if nested and x == "function" and self.text(i + 1) in ("(", "*", "<") or nested and x == "function" and self.named(i + 1):
                f2 = Function("", token.line, [])
                at = self.signature(i + 1 + self.named(i + 1) + (self.text(i + 1) == "*"), f2)
                if self.text(at) == "{":
                    self.statements(at + 1, self.close[at], f, depth + 1, counted=False)
                    at = self.after(at)
                i = max(at, i + 1)
                continue
            if x in ("(", "async") or token.kind == "name":
                if self.text(i - 1) != "." and self.arrow_at(i):
                    i = max(self.arrow(i, "", token.line, False, f, depth), i + 1)
                    continue
            if count and token.kind in ("name", "punct") and self.text(i - 1) not in (".", "?."):
                if x in BRANCHES:
                    count.complexity += 1
                if x in LOOPS:
                    count.loops += 1
                if x in LOOPS or x == "if":
                    count.cognitive += depth
                elif x in ("else", "case", "break", "continue"):
                    count.cognitive += 1
            if token.kind == "name" and self.text(i - 1) not in (".", "?."):
                i = self.chain(i, f, depth, counted, nested)
                continue
            if x == "{":
                stop = min(self.close[i], end)
                self.statements(i + 1, stop, f, depth + 1, counted, nested)
                i = stop + 1
                continue
            i += 1

    def chain(self, i: int, f: Function | None, depth: int, counted: bool, nested: bool) -> int:
        """A chain of names at i, with the calls in it; past its last name or call."""
        first, text = i, self.text(i)
        is_new, is_await = self.text(i - 1) == "new", self.text(i - 1) == "await" or (self.text(i - 1) == "new" and self.text(i - 2) == "await")
        i += 1
        if text in ("exports", "module") and f is None and depth == 0 and self.text(i) == ".":
            self.module.exports += 1
            named = i + 1 if text == "exports" else (i + 3 if self.text(i + 2) == "." else None)
            if named and self.named(named):
                self.exported_names.add(self.text(named))
            elif self.text(i + 1) == "exports" and self.text(i + 2) == "=":
                inner = i + 3
                if self.named(inner):
                    self.exported_names.add(self.text(inner))
                elif self.text(inner) == "{":
                    self.exported_names |= {self.text(k) for k in range(inner + 1, self.close[inner]) if self.named(k) and self.text(k - 1) in ("{", ",")}
        while True:
            while self.text(i) in (".", "?.") and self.named(i + 1):
                text, i = text + self.text(i) + self.text(i + 1), i + 2
            at = self.angle(i) if self.text(i) == "<" and self.text(self.angle(i)) == "(" and self.t[first].text not in NOT_CALLED else i
            if self.text(at) != "(":
                return i
            name = self.text(first)
            if name == "import":
                if at + 1 < len(self.t) and self.t[at + 1].kind == "string":
                    self.module.dynamic.append(self.t[at + 1].text[1:-1])
            elif name in NOT_CALLED or (name == "this" and text == "this"):
                return i
            else:
                self.module.calls.append(Call(name, text, f, is_new, is_await))
            self.statements(at + 1, min(self.close[at], len(self.t)), f, depth, False, True)
            i = self.after(at)
            if self.text(i) not in (".", "?."):
                return i

    def run(self) -> Module:
        self.statements(0, len(self.t), None, 0)
        m = self.module
        for f in m.functions:
            f.exported |= f.name in self.exported_names and not f.owner
        for c in m.classes:
            c.exported |= c.name in self.exported_names
        m.variables = [(n, line, e or n in self.exported_names, a) for n, line, e, a in m.variables]
        return m


def parse(text: str) -> Module:
    return _Parser(text).run()
