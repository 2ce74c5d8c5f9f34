"""Facts of Python files, from the standard library's syntax tree."""

from __future__ import annotations

import ast
import re

from .facts import Facts, Range

VERBS = {"get", "post", "put", "delete", "patch", "options", "head", "api_route"}


class Reader(ast.NodeVisitor):
    def __init__(self, facts: Facts, lines: list[str]) -> None:
        self.f, self.lines = facts, lines

    def at(self, node: ast.AST) -> Range:
        a = len(self.lines[node.lineno - 1].encode()[: node.col_offset].decode(errors="ignore"))
        b = len(self.lines[node.end_lineno - 1].encode()[: node.end_col_offset].decode(errors="ignore"))
        return node.lineno - 1, a, node.end_lineno - 1, b

    def chain(self, node: ast.expr) -> list[str] | None:
        if isinstance(node, ast.Name):
            return [node.id]
        if isinstance(node, ast.Attribute):
            inner = self.chain(node.value)
            return [*inner, node.attr] if inner else [ast.unparse(node)]
        return None

    def private(self, name: str) -> tuple[bool, str]:
        hidden = name.startswith("_") and not name.startswith("__")
        return not hidden, "private" if hidden else "public"

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        exported, visibility = self.private(node.name)
        bases = [ast.unparse(b) for b in node.bases]
        table = next((s.value.value for s in node.body if isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__tablename__" for t in s.targets) and isinstance(s.value, ast.Constant)), None)
        if table is None and any("Base" in b or "Model" in b for b in bases):
            table = node.name.lower()
        service = node.name.endswith("Service") or "service" in self.f.path.lower()
        for d in node.decorator_list:
            self.visit(d)
        self.f.open("class", node.name, self.at(node), exported, visibility, table_name=table, is_service=service or None)
        for b in node.bases:
            if chain := self.chain(b):
                self.f.refer("inherit", chain, self.at(b), type(b).__name__)
        for s in [*node.keywords, *node.body]:
            self.visit(s)
        self.f.close()

    def route(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> tuple[str | None, str | None]:
        """The last decorator that names a route: `x.verb("path")`, or `x.route("path", methods=[...])`."""
        found: tuple[str | None, str | None] = (None, None)
        for d in node.decorator_list:
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str)):
                continue
            verb, path = d.func.attr, d.args[0].value
            if verb in VERBS:
                found = (verb.upper(), path)
            elif verb == "route":
                methods = next((k.value for k in d.keywords if k.arg == "methods"), None)
                first = methods.elts[0].value if isinstance(methods, ast.List | ast.Tuple) and methods.elts and isinstance(methods.elts[0], ast.Constant) else "GET"
                found = (str(first).upper(), path)
        return found

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        exported, visibility = self.private(node.name)
        method, path = self.route(node)
        for d in [*node.decorator_list, node.args]:
            self.visit(d)
        self.f.open("function", node.name, self.at(node), exported, visibility, api_method=method, api_path=path)
        for s in node.body:
            self.visit(s)
        self.f.close()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node: ast.Assign) -> None:
        chain = self.chain(node.value.func) if isinstance(node.value, ast.Call) else None
        declared = chain if chain and chain[-1][:1].isupper() else None
        for t in node.targets:
            if isinstance(t, ast.Name):
                exported, visibility = self.private(t.id)
                self.f.variable(t.id, self.at(node), declared, self.f.kind_here == "function", exported, visibility)
        self.visit(node.value)

    def visit_Call(self, node: ast.Call) -> None:
        if chain := self.chain(node.func):
            self.f.refer("call", chain, self.at(node.func), "call")
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            name = a.asname or a.name
            self.f.refer("import", name.split("."), self.at(a), "import_statement", a.name.replace(".", "/"), a.name if a.asname else None, name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        path = "/" * node.level + (node.module or "").replace(".", "/")
        for a in node.names:
            name = a.asname or a.name
            self.f.refer("import", [name], self.at(a), "import_from_statement", path, a.name if a.asname else None)


def parsed(text: str) -> tuple[ast.Module | None, int | None]:
    """(tree, line of the first error): what can be read around lines that are in error.

    Such a line becomes an empty statement, and if that won't do an empty line, as do the lines of a block that has lost its head. The
    number of lines stays, and each step changes one at least, so this ends.
    """
    lines, first = re.split("\r\n|\r|\n", text), None
    changed: dict[int, int] = {}
    while True:
        try:
            return ast.parse("\n".join(lines)), first
        except SyntaxError as e:
            at = min(max(0, (e.lineno or 1) - 1), len(lines) - 1)
            orphan = isinstance(e, IndentationError) and "unexpected indent" in (e.msg or "") and lines[at].strip() != ""
        except ValueError:
            return None, 0
        first = at if first is None else first
        deep = lambda s: len(s) - len(s.lstrip())
        if orphan:
            depth, end = deep(lines[at]), at
            while end < len(lines) and (not lines[end].strip() or deep(lines[end]) >= depth):
                end += 1
            lines[at:end] = [""] * (end - at)
        elif changed.get(at, 0) < 2 and lines[at].strip():
            lines[at] = lines[at][: deep(lines[at])] + "pass" if at not in changed else ""
            changed[at] = changed.get(at, 0) + 1
        else:
            above = next((i for i in range(at - 1, -1, -1) if lines[i].strip()), None)
            if above is None:
                return None, first
            lines[above] = ""


def read(facts: Facts, text: str) -> None:
    """Symbols and references of all that can be read; an error elsewhere in the file is a diagnostic."""
    tree, wrong = parsed(text)
    if wrong is not None:
        facts.problem(wrong)
    if tree is not None:
        Reader(facts, re.split("\r\n|\r|\n", text)).visit(tree)
