"""Facts of TypeScript, JavaScript (with JSX) and Java files, from tokens and matching brackets.

A small reader, not a full grammar: it knows declarations, class bodies, calls, constructions, annotations, imports
and tags, and steps over all else. What it can't match is a diagnostic, never an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .facts import Facts, Range

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)
    |(?P<name>[#@]?[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|\?\.|\.\.\.|[{}()\[\];,.:<>=?!|&]|.)""",
    re.S | re.X,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
CLOSE = {"{": "}", "(": ")", "[": "]"}
# Words that are never the start of a call or a name.
WORDS = set("if for while switch catch return typeof instanceof in of do else try finally throw case default break continue function class interface new delete void yield await async import export from extends implements super this const let var static public private protected readonly abstract get set package enum assert synchronized".split())
MODIFIERS = set("public private protected static readonly abstract async get set declare override final synchronized native default transient volatile".split())
PRIMITIVE = set("string number boolean void any unknown never null undefined object symbol bigint int long double float char byte short true false".split())


@dataclass
class Token:
    kind: str
    text: str
    line: int
    col: int

    @property
    def end(self) -> tuple[int, int]:
        n = self.text.count("\n")
        return (self.line + n, len(self.text) - self.text.rfind("\n") - 1) if n else (self.line, self.col + len(self.text))


def tokens(text: str) -> list[Token]:
    out, at, line, start = [], 0, 0, 0
    while at < len(text):
        last = out[-1] if out else None
        m = None
        if text[at] == "/" and (last is None or (last.kind == "sign" and last.text not in (")", "]", "}")) or last.text in ("return", "typeof", "case")):
            m = REGEX.match(text, at)
        kind = "string" if m else ""
        if not m:
            m = TOKEN.match(text, at)
            kind = m.lastgroup
        if kind not in ("space", "comment"):
            out.append(Token(kind, m[0], line, at - start))
        if n := m[0].count("\n"):
            line, start = line + n, at + m[0].rfind("\n") + 1
        at = m.end()
    return out


class Reader:
    def __init__(self, facts: Facts, text: str, lang: str) -> None:
        self.f, self.t, self.java, self.jsx = facts, tokens(text), lang == "java", lang in ("tsx", "jsx", "javascript")
        self.typed = lang in ("typescript", "tsx")
        self.match = self.brackets()
        self.functions = 0  # bodies of functions that we are in

    def brackets(self) -> dict[int, int]:
        out, stack = {}, []
        for i, t in enumerate(self.t):
            if t.kind == "sign" and t.text in CLOSE:
                stack.append(i)
            elif t.kind == "sign" and t.text in CLOSE.values():
                if stack and CLOSE[self.t[stack[-1]].text] == t.text:
                    out[stack.pop()] = i
                else:
                    self.f.problem(t.line)
        for i in stack:
            self.f.problem(self.t[i].line)
            out[i] = len(self.t) - 1
        return out

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def span(self, a: int, b: int) -> Range:
        a, b = min(a, len(self.t) - 1), max(0, min(b, len(self.t) - 1))
        return self.t[a].line, self.t[a].col, *self.t[b].end

    def chain(self, i: int) -> tuple[list[str], int]:
        """A dotted chain of names from `i`, and what follows it."""
        names = [self.text(i)]
        i += 1
        while self.text(i) in (".", "?.") and self.kind(i + 1) == "name":
            names.append(self.text(i + 1))
            i += 2
        return names, i

    def past_generics(self, i: int) -> int:
        """Past `<...>` from `i`, if that closes before a statement does."""
        if self.text(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.t) and self.text(j) not in (";", "{", "}"):
            depth += {"<": 1, ">": -1}.get(self.text(j), 0)
            j += 1
            if not depth:
                return j
        return i

    def type_at(self, i: int, stop: int) -> tuple[list[str] | None, int]:
        """The first named type from `i` to the end of the annotation, which is also where reading goes on."""
        found, j, depth = None, i, 0
        while j < stop:
            s = self.text(j)
            depth += {"<": 1, ">": -1}.get(s, 0)
            if s in (";", ")", "}") or (not depth and (s in ("=", ",", "=>") or (s == "{" and j > i))):
                break
            if not depth and self.kind(j) == "name" and s not in PRIMITIVE and s not in WORDS:
                names, after = self.chain(j)
                if found is None:
                    found = names
                    self.f.refer("type_use", names, self.span(j, after - 1), "type_annotation")
                j = after
                continue
            if s in CLOSE:
                j = self.match.get(j, j)
            j += 1
        return found, j

    def block(self, a: int, b: int) -> None:
        """Statements and expressions in tokens a to b - 1."""
        i = a
        while i < b:
            i = max(i + 1, self.step(i, b))

    def step(self, i: int, b: int) -> int:
        s, k = self.text(i), self.kind(i)
        if k == "sign":
            if s == "<" and self.jsx and self.kind(i + 1) == "name" and self.kind(i - 1) != "name" and self.text(i - 1) not in (")", "]"):
                names, after = self.chain(i + 1)
                if len(names) > 1 or names[0][:1].isupper():
                    self.f.refer("renders", names, self.span(i + 1, after - 1), "jsx_element")
                return after
            if s == "=>" and self.text(i + 1) == "{":
                return self.body(i + 1)
            return i + 1
        if k == "string":
            if s[0] == "`":
                self.template(i)
            return i + 1
        if k != "name":
            return i + 1
        if s == "import" and not self.f.stack:
            return self.imports(i, b)
        if s in ("class", "interface") and self.kind(i + 1) == "name" and self.text(i - 1) != ".":
            return self.type_declaration(i, b)
        if not self.java:
            if s == "function":
                return self.function(i, b)
            if s in ("const", "let", "var"):
                return self.variables(i + 1, b)
            if s == "type" and self.typed and self.kind(i + 1) == "name" and self.text(self.past_generics(i + 2)) == "=":
                j = i
                while j < b and self.text(j) != ";" and not (j > i + 3 and self.t[j].line > self.t[j - 1].end[0] and self.text(j) not in ("|", "&")):
                    j = self.match.get(j, j) + 1
                self.f.define("type_alias", self.text(i + 1), self.span(i, j - 1), self.exported(i))
                return j
        if s == "new" and self.kind(i + 1) == "name":
            names, after = self.chain(i + 1)
            self.f.refer("instantiate", names, self.span(i + 1, after - 1), "new_expression")
            return self.past_generics(after)
        if self.text(i - 1) in (".", "?."):
            names, after = self.chain(i)
            return after
        if s.startswith("@"):
            names, after = self.chain(i)
            return after
        if s not in WORDS or s in ("this", "super"):
            names, after = self.chain(i)
            if self.java and (local := self.java_local(i, after, b)):
                return local
            call = self.past_generics(after)
            if self.text(call) == "(":
                if s not in ("super",) or len(names) > 1:
                    self.f.refer("call", names, self.span(i, after - 1), "call_expression")
                    self.express(names, i, call)
                return call
            return after
        return i + 1

    def template(self, i: int) -> None:
        """Calls in the places of a template string."""
        for m in re.finditer(r"\$\{([^{}]*)\}", self.t[i].text):
            for c in re.finditer(r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\(", m[1]):
                self.f.refer("call", c[1].split("."), self.span(i, i), "call_expression")

    def body(self, i: int) -> int:
        """A function's body whose brace is at `i`."""
        end = self.match.get(i, i)
        self.functions += 1
        self.block(i + 1, end)
        self.functions -= 1
        return end + 1

    def exported(self, i: int) -> bool:
        while i > 0 and (self.text(i - 1) in MODIFIERS or self.text(i - 1) == "export" or self.text(i - 1) in ("function", "class", "interface", "const", "let", "var")):
            i -= 1
            if self.text(i) == "export":
                return True
        return self._exporting

    _exporting = False

    def imports(self, i: int, b: int) -> int:
        j = i
        while j < b and self.text(j) != ";" and not (j > i and self.t[j].line > self.t[j - 1].line and self.kind(j - 1) == "string"):
            j += 1
        part = range(i + 1, j)
        if self.java:
            names = [self.text(x) for x in part if self.kind(x) == "name" and self.text(x) != "static" or self.text(x) == "*"]
            if names:
                dotted = ".".join(names)
                self.f.refer("import", names, self.span(i + 1, j - 1), "import_declaration", "/".join(names), dotted, dotted)
            return j
        path = next((self.text(x)[1:-1] for x in reversed(part) if self.kind(x) == "string"), None)
        x = i + 1
        while path is not None and x < j and self.text(x) != "from":
            if self.kind(x) == "name" and self.text(x) not in ("type", "as"):
                if self.text(x + 1) == "as":
                    self.f.refer("import", [self.text(x + 2)], self.span(x + 2, x + 2), "import_specifier", path, self.text(x))
                    x += 2
                else:
                    self.f.refer("import", [self.text(x)], self.span(x, x), "import_specifier", path)
            elif self.text(x) == "*" and self.text(x + 1) == "as":
                self.f.refer("import", [self.text(x + 2)], self.span(x + 2, x + 2), "namespace_import", path)
                x += 2
            x += 1
        return j

    def modifiers(self, i: int) -> tuple[str, list[str]]:
        """Visibility words and decorators before `i`."""
        words, decorators = [], []
        j = i - 1
        while j >= 0:
            s = self.text(j)
            if s in MODIFIERS or s in ("export", "abstract"):
                words.append(s)
                j -= 1
                continue
            start = j
            if s == ")":
                start = next((a for a, z in self.match.items() if z == j), j) - 1
            while start > 1 and self.text(start - 1) == ".":
                start -= 2
            if self.text(start).startswith("@"):
                decorators.append("".join(t.text for t in self.t[start : j + 1]))
                j = start - 1
                continue
            break
        return " ".join(words), decorators

    def visibility(self, words: str, name: str, i: int) -> tuple[bool, str]:
        if self.java:
            kind = "private" if "private" in words else "protected" if "protected" in words else "public"
            return kind == "public", kind
        return self.exported(i), "private" if name.startswith("#") else "public"

    def type_declaration(self, i: int, b: int) -> int:
        kind, name = self.text(i), self.text(i + 1)
        j, mode, seen = self.past_generics(i + 2), None, []
        while j < b and self.text(j) != "{":
            s = self.text(j)
            if s in ("extends", "implements"):
                mode = s
            elif self.kind(j) == "name" and mode:
                names, after = self.chain(j)
                seen.append((("implement" if mode == "implements" else "inherit"), names, self.span(j, after - 1)))
                j = self.past_generics(after)
                continue
            j += 1
        end = self.match.get(j, j)
        words, decorators = self.modifiers(i)
        exported, visibility = self.visibility(words, name, i)
        told = " ".join(decorators)
        path = self.f.path.lower()
        service = kind == "class" and (name.endswith("Service") or "service" in path or "@Injectable" in told)
        table = None
        if m := re.search(r"@(?:Entity|Table)\(?(?:['\"]([^'\"]*)['\"])?", told):
            table = m[1] or name.lower()
        elif kind == "class" and "model" in path:
            table = name.lower()
        prefix = re.search(r"@Controller\(\s*['\"]([^'\"]*)['\"]", told)
        self.f.open(kind, name, self.span(i, end), exported, visibility, table_name=table, is_service=service or None)
        for r, names, at in seen:
            self.f.refer(r, names, at, kind)
        depth, self.functions, outer = self.functions, 0, self._exporting
        self._exporting = exported and not self.java
        self.members(j + 1, end, kind == "interface", prefix[1] if prefix else None)
        self.functions, self._exporting = depth, outer
        self.f.close()
        return end + 1

    def members(self, i: int, end: int, interface: bool, prefix: str | None) -> None:
        while i < end:
            if self.kind(i) == "name" and self.text(i) in ("class", "interface") and self.kind(i + 1) == "name":
                i = self.type_declaration(i, end)
                continue
            if self.kind(i) == "name" and self.text(i) not in MODIFIERS and not self.text(i).startswith("@"):
                if (after := self.member(i, end, prefix)) > i:
                    i = after
                    continue
            if self.text(i).startswith("@"):
                _, j = self.chain(i)
                if self.text(j) == "(":
                    self.block(j + 1, self.match.get(j, j))
                    j = self.match.get(j, j) + 1
                i = max(i + 1, j)
                continue
            if self.text(i) == "{":
                i = self.body(i)
                continue
            i += 1

    def member(self, i: int, end: int, prefix: str | None) -> int:
        """A method or field whose name (or type, in Java) is at `i`; `i` if it is neither."""
        start = i
        if self.java:
            names, j = self.chain(i)
            j = self.past_generics(j)
            while self.text(j) == "[":
                j = self.match.get(j, j) + 1
            if self.kind(j) == "name":
                declared, i = names, j
            elif self.text(j) != "(":
                return start
            else:
                declared = None
        name, j = self.text(i), i + 1
        j += self.text(j) in ("?", "!")
        call = self.past_generics(j)
        words, decorators = self.modifiers(start)
        exported, visibility = self.visibility(words, name, start)
        if self.text(call) == "(":
            close = self.match.get(call, call)
            stop = close + 1
            while stop < end and self.text(stop) not in ("{", ";") and not (self.typed and self.t[stop].line > self.t[stop - 1].end[0] and self.text(stop) not in ("|", "&", ":")):
                stop += 1
            last = self.match.get(stop, stop) if self.text(stop) == "{" else min(stop, end - 1)
            method, path = self.nest_route(decorators, prefix)
            self.f.open("method", name, self.span(start, last), exported, visibility, api_method=method, api_path=path)
            self.parameters(call, close)
            if self.typed and self.text(close + 1) == ":":
                self.type_at(close + 2, stop)
            if self.text(stop) == "{":
                self.body(stop)
            self.f.close()
            return last + 1
        if self.java:
            stop = j
            while stop < end and self.text(stop) != ";":
                stop = self.match.get(stop, stop) + 1
            primitive = declared and declared[-1] in PRIMITIVE
            self.f.variable(name, self.span(i, stop - 1), None if primitive else declared, False, exported, visibility)
            self.block(j, stop)
            return stop + 1
        declared = None
        if self.text(j) == ":":
            declared, j = self.type_at(j + 1, end)
        elif self.text(j) not in ("=", ";", ",") and self.t[j].line == self.t[i].line:
            return start
        stop = j
        if self.text(j) == "=":
            if declared is None and self.text(j + 1) == "new":
                declared = self.chain(j + 2)[0]
            stop = j + 1
            while stop < end and self.text(stop) not in (";",) and not (self.t[stop].line > self.t[stop - 1].end[0] and self.text(stop - 1) not in ("=", "=>", ",", "(", ".") and self.text(stop) not in (".", "?.", ")", ",")):
                stop = self.match.get(stop, stop) + 1
        self.f.variable(name, self.span(start, max(start, stop - 1)), declared, False, exported, visibility)
        if self.text(j) == "=":
            self.block(j + 1, stop)
        return max(stop, i + 1)

    def parameters(self, a: int, b: int) -> None:
        """Annotations and default values between the brackets of a function."""
        i = a + 1
        while i < b:
            if self.text(i) == ":" and self.typed:
                _, i = self.type_at(i + 1, b)
                continue
            if self.text(i) == "=":
                i = max(i + 1, self.step(i + 1, b))
                continue
            i += 1

    def function(self, i: int, b: int) -> int:
        named = self.kind(i + 1) == "name"
        j = i + 1 + (self.text(i + 1) == "*")
        named = self.kind(j) == "name"
        call = self.past_generics(j + 1 if named else j)
        close = self.match.get(call, call)
        stop = close + 1
        while stop < b and self.text(stop) not in ("{", ";"):
            stop += 1
        end = self.match.get(stop, stop)
        if named:
            self.f.open("function", self.text(j), self.span(i, end), self.exported(i))
        self.parameters(call, close)
        if self.typed and self.text(close + 1) == ":":
            self.type_at(close + 2, stop)
        if self.text(stop) == "{":
            self.body(stop)
        if named:
            self.f.close()
        return end + 1

    def variables(self, i: int, b: int) -> int:
        if self.kind(i) != "name":
            return i + 1
        name, j, declared = self.text(i), i + 1, None
        if self.text(j) == ":":
            declared, j = self.type_at(j + 1, b)
        if self.text(j) == "=" and declared is None and self.text(j + 1) == "new":
            declared = self.chain(j + 2)[0]
        stop = j
        while stop < b and self.text(stop) not in (";", ",") and not (self.t[stop].line > self.t[stop - 1].end[0] and self.text(stop - 1) not in ("=", "=>", "(", ".", "&", "|", "?", ":") and self.text(stop) not in (".", "?.", "=", "=>", ")", "?", ":", "&", "|")):
            stop = self.match.get(stop, stop) + 1
        self.f.variable(name, self.span(i, max(i, stop - 1)), declared, self.functions > 0 or self.f.kind_here not in ("file", "class", "interface"), self.exported(i))
        return j + 1 if self.text(j) == "=" else max(j, i + 1)

    def java_local(self, i: int, after: int, b: int) -> int:
        """`Type name = ...;` in a Java body: a binding; where reading goes on, or 0."""
        j = self.past_generics(after)
        while self.text(j) == "[" and self.text(j + 1) == "]":
            j += 2
        if self.kind(j) == "name" and self.text(j) not in WORDS and self.text(j + 1) in ("=", ";", ":", ",") and self.f.stack:
            names, _ = self.chain(i)
            if names[-1] not in PRIMITIVE:
                self.f.variable(self.text(j), self.span(i, j), names, True)
            return j + 1
        return 0

    def nest_route(self, decorators: list[str], prefix: str | None) -> tuple[str | None, str | None]:
        for d in decorators:
            if m := re.match(r"@(Get|Post|Put|Delete|Patch|Options|Head|All)\((?:['\"]([^'\"]*)['\"])?", d):
                return m[1].upper(), "/" + "/".join(p for p in [*(prefix or "").split("/"), *(m[2] or "").split("/")] if p)
        return None, None

    def express(self, names: list[str], i: int, call: int) -> None:
        """`app.verb("path", handler)`: remembered, and given to the handler once the file is read."""
        if self.java or len(names) != 2 or not re.fullmatch(r"app|router|\w*[rR]oute\w*", names[0]) or names[1] not in ("get", "post", "put", "delete", "patch"):
            return
        if self.kind(call + 1) == "string" and self.text(call + 2) == ",":
            end, last = self.match.get(call, call), None
            for x in range(call + 3, end):
                if self.kind(x) == "name" and self.text(x + 1) in (")", ","):
                    last = self.text(x)
            if last:
                self.routes[last] = (names[1].upper(), self.text(call + 1)[1:-1])

    def read(self) -> None:
        self.routes: dict[str, tuple[str, str]] = {}
        self.block(0, len(self.t))
        for s in self.f.rows["symbols"]:
            if s["name"] in self.routes and s["kind"] in ("function", "variable", "method") and not s["api_method"]:
                s["api_method"], s["api_path"] = self.routes[s["name"]]


def read(facts: Facts, text: str, lang: str) -> None:
    Reader(facts, text, lang).read()
