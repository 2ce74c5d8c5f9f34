from symgraph.sources.extract import facts_of
from symgraph.sources.walk import ignore_rules, ignored, language, walk


def got(path, lang, text):
    r = facts_of(path, lang, text)
    return r, {(s["kind"], s["name"]) for s in r["symbols"]}, {(x["kind"], x["raw_name"]) for x in r["references"]}


def test_python():
    text = (
        "from services.user import UserService as US\nimport os.path as p\nfrom .local import config\n\n"
        "class Repo(base.Model):\n    __tablename__ = 'repos'\n    def save(self):\n        x = US()\n        x.save()\n        return _hidden(1)\n\n"
        "def _hidden(n):\n    return n\n\nlimit = Counter()\n"
    )
    r, symbols, refs = got("main.py", "python", text)
    assert {("class", "Repo"), ("function", "save"), ("function", "_hidden"), ("variable", "limit"), ("file", "main.py")} <= symbols
    assert {("import", "US"), ("import", "p"), ("import", "config"), ("inherit", "base.Model"), ("call", "US"), ("call", "x.save"), ("call", "_hidden")} <= refs
    by = {s["name"]: s for s in r["symbols"]}
    assert by["_hidden"]["visibility"] == "private" and not by["_hidden"]["exported"]
    assert by["Repo"]["table_name"] == "repos" and by["save"]["id"] == "main.py::Repo::save"
    imports = {x["raw_name"]: x for x in r["references"] if x["kind"] == "import"}
    assert imports["US"]["imported_name"] == "UserService" and imports["US"]["import_path"] == "services/user" and imports["config"]["import_path"] == "/local"
    assert [(b["name"], b["type_chain"]) for b in r["bindings"]] == [("x", ["US"])]
    # top-level symbols are held by no one; methods of Python classes are functions that the class owns
    assert [(c["child_id"], c["kind"]) for c in r["containments"]] == [("main.py::Repo::__tablename__", "owns"), ("main.py::Repo::save", "owns")]
    assert len(facts_of("main.py", "python", text, link_file_members=True)["containments"]) == 5


def test_python_frameworks_and_errors():
    text = "@app.post('/users')\ndef create():\n    pass\n\n@bp.route('/items', methods=['PUT'])\ndef put():\n    pass\n\n@bp.route('/all')\ndef every():\n    pass\n\nclass MailService:\n    pass\n"
    by = {s["name"]: s for s in facts_of("api.py", "python", text)["symbols"]}
    assert [(by[n]["api_method"], by[n]["api_path"]) for n in ("create", "put", "every")] == [("POST", "/users"), ("PUT", "/items"), ("GET", "/all")]
    assert by["MailService"]["is_service"]
    assert [d["kind"] for d in facts_of("bad.py", "python", "def f(:\n")["diagnostics"]] == ["parse_error"]


def test_java_has_exactly_four_symbols_and_references():
    text = "package a.b;\nimport java.util.List;\npublic class Foo extends Bar implements Baz {\n  private Repo repo;\n  public void run(int x) { repo.save(x); }\n}\n"
    r, symbols, refs = got("a/Foo.java", "java", text)
    assert symbols - {("file", "Foo.java")} == {("class", "Foo"), ("variable", "repo"), ("method", "run")} and len(r["symbols"]) == 4
    assert refs == {("import", "java.util.List"), ("inherit", "Bar"), ("implement", "Baz"), ("call", "repo.save")} and len(r["references"]) == 4
    assert {(c["child_id"], c["kind"]) for c in r["containments"]} == {("a/Foo.java::Foo::repo", "owns"), ("a/Foo.java::Foo::run", "has_member")}


def test_typescript():
    text = """import { User as U, Other } from '../models/user.js';
import type Def from "./d";
export class UserService extends ns.Base implements Api<User>, Other {
  private users: readonly U[] = [];
  #secret = new Map<string, number>();
  constructor(private readonly repo: Repo) { super(); }
  async save(u: U): Promise<void> { const r = new Repo(); r.add(u); this.users.push(u); if (u) { helper(u); } }
}
interface Thing { id: string; run(x: U): void; }
type Pair = [string, U];
export const make = (a: number) => { const inner = new Map(); return build(a, `${name(a)}`); };
function helper(n: U) { return /[{]/.test(n) }
"""
    r, symbols, refs = got("src/s/user.ts", "typescript", text)
    assert {("class", "UserService"), ("variable", "users"), ("variable", "#secret"), ("method", "save"), ("method", "constructor"), ("interface", "Thing"), ("variable", "id"), ("method", "run"), ("type_alias", "Pair"), ("variable", "make"), ("function", "helper")} <= symbols
    assert ("variable", "inner") not in symbols and ("variable", "r") not in symbols
    assert {("import", "U"), ("import", "Other"), ("import", "Def"), ("inherit", "ns.Base"), ("implement", "Api"), ("implement", "Other"), ("instantiate", "Repo"), ("call", "r.add"), ("call", "this.users.push"), ("call", "helper"), ("call", "build"), ("call", "name"), ("type_use", "U"), ("type_use", "Repo")} <= refs
    by = {s["name"]: s for s in r["symbols"]}
    assert by["users"]["declared_type"] == ["U"] and by["UserService"]["exported"] and not by["helper"]["exported"] and by["#secret"]["visibility"] == "private"
    assert not r["diagnostics"]
    assert [x["import_path"] for x in r["references"] if x["raw_name"] == "U" and x["kind"] == "import"] == ["../models/user.js"]


def test_jsx_nest_and_express():
    text = "export function App() { return <div><Card title={name()}><Panel.Header/></Card><span/></div>; }\n"
    _, _, refs = got("app.tsx", "tsx", text)
    assert {r for r in refs if r[0] == "renders"} == {("renders", "Card"), ("renders", "Panel.Header")} and ("call", "name") in refs
    nest = "@Controller('users')\nexport class UsersController {\n  @Get(':id')\n  find(id: string) { return 1; }\n}\n@Injectable()\nclass Mailer {}\n@Entity('people')\nclass Person {}\n"
    by = {s["name"]: s for s in facts_of("u.ts", "typescript", nest)["symbols"]}
    assert (by["find"]["api_method"], by["find"]["api_path"]) == ("GET", "/users/:id") and by["Mailer"]["is_service"] and by["Person"]["table_name"] == "people"
    express = "function list(req, res) {}\nrouter.get('/users', auth, list);\n"
    by = {s["name"]: s for s in facts_of("r.js", "javascript", express)["symbols"]}
    assert (by["list"]["api_method"], by["list"]["api_path"]) == ("GET", "/users")


def test_html_and_unbalanced():
    r, symbols, refs = got("index.html", "html", '<html><head><link rel="stylesheet" href="a.css"><script src="app.js"></script></head><body><p id="x">\n<b id="y"></b></body></html>')
    assert symbols == {("file", "index.html"), ("variable", "x"), ("variable", "y")} and refs == {("import", "a.css"), ("import", "app.js")}
    assert facts_of("x.ts", "typescript", "class A { f( { }")["diagnostics"]
    assert facts_of("x.ts", "typescript", "")["symbols"]


def test_walk_and_ignore(tmp_path):
    for p in ("a.py", "pkg/__init__.py", "node_modules/x.js", "b.txt", ".hidden/c.py", "gen/d.ts", "keep.gen.ts", "x.gen.ts"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# c\ngen/\n*.gen.ts\n!keep.gen.ts\n")
    assert [p for p, *_ in walk(str(tmp_path))] == ["a.py", "keep.gen.ts", "pkg/__init__.py"]
    rules = ignore_rules("/top\n**/deep/*.js\n")
    assert ignored("top", False, rules) and not ignored("a/top", False, rules) and ignored("x/deep/y.js", False, rules)
    assert language("A.TSX") == "tsx" and language("Makefile") is None


def test_a_python_file_in_error_keeps_what_can_be_read():
    cases = [
        ("def a(:\n  x\n  y\n\ndef b():\n  return 1\n", 0, {"b"}),
        ("class A:\n  def m(self):\n    q = = 1\n    return 2\n  def n(self): pass\n", 2, {"A", "m", "n"}),
        ("x = (\n  1\ndef f():\n  pass\n", 0, {"f"}),
        ("'''abc\ndef f(): pass", 0, {"f"}),
        ("\t\n if", 1, set()),
        ("def ok(): pass\n", None, {"ok"}),
        ("", None, set()),
    ]
    for text, line, names in cases:
        rows = facts_of("m.py", "python", text)
        assert {s["name"] for s in rows["symbols"] if s["kind"] in ("class", "function", "method")} == names
        assert [d["start_line"] for d in rows["diagnostics"]] == ([] if line is None else [line])


def test_broken_python_of_any_kind_is_read_to_its_end():
    """Each cut and each doubled line of a file ends in facts, with the file's own symbol."""
    text = "class A(B):\n    x = (1,\n         2)\n    def m(self):\n        return '''a\nb'''\n\n@app.get('/x')\ndef f():\n    if 1:\n        g([1, 2])\n"
    lines = text.split("\n")
    made = [text[:i] for i in range(len(text))] + ["\n".join(lines[:i] + lines[i : i + 1] * 2 + lines[i + 2 :]) for i in range(len(lines))] + [text[i:] for i in range(0, len(text), 3)]
    for t in made:
        assert sum(s["kind"] == "file" for s in facts_of("m.py", "python", t)["symbols"]) == 1
