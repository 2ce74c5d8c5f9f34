"""What one file contributes to a model: symbols, scopes, containments, references, bindings and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from symgraph.operators.model import reference_id, scope_id, symbol_id

Range = tuple[int, int, int, int]
TABLES = ("symbols", "scopes", "containments", "references", "bindings", "diagnostics")


def _at(r: Range) -> dict[str, int]:
    return dict(zip(("start_line", "start_col", "end_line", "end_col"), r, strict=True))


@dataclass
class Open:
    id: str
    kind: str
    name: str


@dataclass
class Facts:
    """Collects facts in the order they are found; `open` and `close` keep the stack of enclosing symbols.

    The file's own symbol is not on the stack, so symbols at the top level are held by no one
    unless `link_file_members` is set.
    """

    path: str
    end: tuple[int, int]
    link_file_members: bool = False
    rows: dict[str, list[dict[str, Any]]] = field(default_factory=lambda: {t: [] for t in TABLES})
    stack: list[Open] = field(default_factory=list)
    scopes: list[str] = field(default_factory=list)
    count: int = 0

    def __post_init__(self) -> None:
        self.file_id = symbol_id(self.path, [self.path])
        whole = (0, 0, *self.end)
        self._symbol(self.file_id, "file", self.path.rsplit("/", 1)[-1], self.path, whole, True, "public", {})
        self._scope("global", whole, self.file_id)

    def _next(self) -> int:
        self.count += 1
        return self.count

    def _symbol(self, id: str, kind: str, name: str, qualified: str, at: Range, exported: bool, visibility: str, more: dict[str, Any]) -> None:
        row = {"id": id, "kind": kind, "name": name, "qualified_name": qualified, "file_path": self.path, **_at(at), "exported": exported, "visibility": visibility}
        row |= {"api_method": None, "api_path": None, "table_name": None, "is_service": False, "is_external": False, "declared_type": None}
        self.rows["symbols"].append(row | more | {"seq": self._next()})

    def _scope(self, kind: str, at: Range, owner: str | None) -> None:
        id = scope_id(self.path, kind, at)
        self.rows["scopes"].append({"id": id, "kind": kind, "parent_scope_id": self.scopes[-1] if self.scopes else None, "owner_symbol_id": owner, "file_path": self.path, **_at(at), "seq": self._next()})
        self.scopes.append(id)

    @property
    def here(self) -> str:
        return self.stack[-1].id if self.stack else self.file_id

    @property
    def kind_here(self) -> str:
        return self.stack[-1].kind if self.stack else "file"

    def define(self, kind: str, name: str, at: Range, exported: bool = True, visibility: str = "public", **more: Any) -> str:
        chain = [o.name for o in self.stack] + [name]
        id = symbol_id(self.path, chain)
        self._symbol(id, kind, name, ".".join(chain), at, exported, visibility, {k: v for k, v in more.items() if v is not None})
        if self.stack or self.link_file_members:
            self.rows["containments"].append({"parent_id": self.here, "child_id": id, "kind": "has_member" if kind == "method" else "owns", "seq": self._next()})
        return id

    def open(self, kind: str, name: str, at: Range, exported: bool = True, visibility: str = "public", **more: Any) -> str:
        id = self.define(kind, name, at, exported, visibility, **more)
        self._scope("class" if kind in ("class", "interface") else "function", at, id)
        self.stack.append(Open(id, kind, name))
        return id

    def close(self) -> None:
        self.stack.pop()
        self.scopes.pop()

    def variable(self, name: str, at: Range, declared: list[str] | None, local: bool, exported: bool = True, visibility: str = "public", **more: Any) -> None:
        """A symbol at the top level or in a class; elsewhere a binding, if its type is known."""
        if not local and self.kind_here in ("file", "class", "interface"):
            self.define("variable", name, at, exported, visibility, declared_type=declared or None, **more)
        elif declared and self.stack:
            self.rows["bindings"].append({"owner_symbol_id": self.here, "name": name, "file_path": self.path, **_at(at), "type_chain": declared, "seq": self._next()})

    def refer(self, kind: str, chain: list[str], at: Range, node: str, import_path: str | None = None, imported: str | None = None, raw: str | None = None) -> None:
        name = raw if raw is not None else ".".join(chain)
        self.rows["references"].append({
            "id": reference_id(self.here, name, at), "from_symbol_id": self.here, "kind": kind, "raw_name": name, "qualifier_chain": chain, "import_path": import_path, "imported_name": imported,
            "ast_node_type": node, "file_path": self.path, **_at(at), "seq": self._next(),
        })

    def problem(self, line: int) -> None:
        at = (line, 0, line, 0)
        self.rows["diagnostics"].append({"kind": "parse_error", "severity": "error", "message": f"syntax error at line {line + 1}", "file_path": self.path, **_at(at), "related_candidate_id": None})
