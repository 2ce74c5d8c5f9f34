import pytest
from pyspark.sql import functions as F

from symgraph.operators import graph as G
from symgraph.operators import search as S
from symgraph.operators.resolve import import_keys
from symgraph.plans import plan as P
from symgraph.plans.answer import Project, answer, retrieve_context
from symgraph.sources.extract import build
from symgraph.sources.store import MissingIndex, Store, from_json, model_json, to_json
from symgraph.sources.walk import from_texts

FILES = {
    "main.py": "from services.user import UserService as US\nfrom admin.user import UserService\nimport json\n\n\ndef run():\n    service = US()\n    user = get_current_user()\n    service.save(user)\n    admin = UserService()\n    admin.delete_user(user)\n    print(json.dumps(user))\n\n\ndef get_current_user():\n    return None\n",
    "services/user.py": "class UserService:\n    # Keeps a user.\n    def save(self, user):\n        return self.check(user)\n\n    def check(self, user):\n        return user\n",
    "admin/user.py": "class UserService:\n    def delete_user(self, user):\n        return missing_thing.go(user)\n",
    "tests/test_user.py": "from services.user import UserService\n\n\ndef test_save():\n    UserService().save(1)\n",
    "web/store.ts": "import { Item } from './item';\nexport class Store {\n  private cache: Map<string, Item> = new Map();\n  private item: Item;\n  load(): void { this.cache.get('x'); this.item.show(); }\n}\n",
    "web/item.ts": "export class Item { show(): void { console.log('x'); } }\n",
    "web/index.html": '<div id="root"></div><script src="./app.js"></script>',
    "web/app.js": "import { Store } from './store';\nconst store = new Store();\nstore.load();\n",
}


@pytest.fixture(scope="module")
def built(spark):
    sources = from_texts(spark, FILES)
    model, facts, counts = build(sources, "::demo")
    return model, facts, counts, sources


def links(model):
    rows = model.references.join(model.resolved.withColumnRenamed("kind", "k"), F.col("id") == F.col("candidate_id")).collect()
    return {(r.file_path, r.kind, r.raw_name): (r.to_symbol_id, r.resolution_method) for r in rows}


def test_references_bind(built):
    model, _, counts, _ = built
    assert counts == {"parsed": 8, "reused": 0}
    got = links(model)
    assert got["main.py", "import", "US"] == ("services/user.py::UserService", "import")
    assert got["main.py", "import", "UserService"] == ("admin/user.py::UserService", "import")
    assert got["main.py", "import", "json"] == ("external::json::json", "import")
    assert got["main.py", "call", "US"][0] == "services/user.py::UserService" and got["main.py", "call", "US"][1] == "import"
    assert got["main.py", "call", "service.save"] == ("services/user.py::UserService::save", "scope")
    assert got["main.py", "call", "admin.delete_user"] == ("admin/user.py::UserService::delete_user", "scope")
    assert got["main.py", "call", "get_current_user"] == ("main.py::get_current_user", "scope")
    assert got["main.py", "call", "print"] == ("external::builtin::print", "global_fallback")
    assert got["main.py", "call", "json.dumps"][0] == "external::json::json::dumps"
    assert got["services/user.py", "call", "self.check"] == ("services/user.py::UserService::check", "scope")
    assert got["web/store.ts", "call", "this.cache.get"][0] == "external::type::Map::get"
    assert got["web/store.ts", "call", "this.item.show"] == ("web/item.ts::Item::show", "scope")
    assert got["web/item.ts", "call", "console.log"][0] == "external::builtin::console::log"
    assert got["web/index.html", "import", "./app.js"] == ("web/app.js::web/app.js", "import")
    assert got["web/app.js", "import", "Store"] == ("web/store.ts::Store", "import")
    assert got["web/app.js", "call", "store.load"] == ("web/store.ts::Store::load", "scope")
    assert [r.raw_name for r in model.unresolved.collect()] == ["missing_thing.go", "UserService().save"]
    assert [(d.kind, d.severity) for d in model.diagnostics.collect()] == [("unresolved_reference", "info")] * 2
    assert {"external::type::Map", "external::type::Map::get", "external::json::json::dumps"} <= {r.id for r in model.symbols.select("id").collect()}


def test_import_keys():
    assert import_keys("pkg/a/m.py", "//b/c", "python") == (["pkg/b/c", "pkg/b/c.py", "pkg/b/c/__init__.py", "pkg.b.c"], "pkg/b/c")
    assert import_keys("src/s/u.ts", "../models/user.js", "typescript")[0][0] == "src/models/user.js"
    assert import_keys("A.java", "a/b/*", "java") == ([], None)


def test_graph_reads(built):
    model, *_ = built
    nodes, edges = G.build(model.symbols, model.containments, model.resolved)
    assert [r.id for r in G.callers_of(nodes, edges, "main.py::get_current_user").collect()] == ["main.py::run"]
    assert {r.id for r in G.members_of(nodes, edges, "web/store.ts::Store").collect()} == {"web/store.ts::Store::load"}
    assert "services/user.py::UserService" in {r.id for r in G.test_covered(nodes, edges, F.col("file_path").startswith("tests/")).collect()}
    told = {r.what: r.n for r in G.stats(nodes, edges).collect()}
    assert told["edges"] == sum(v for k, v in told.items() if k.startswith("edges:")) and told["edges:import"] == 7
    # none dangles
    ids = {r.id for r in nodes.select("id").collect()}
    assert all(e.src in ids and e.dst in ids for e in edges.collect())


def test_update_and_incremental(built, spark):
    model, facts, _, _ = built
    changed = FILES | {"admin/user.py": "class UserService:\n    def remove(self):\n        return 1\n"}
    del changed["web/app.js"]
    again, _, counts = build(from_texts(spark, changed), "::demo", facts)
    assert counts == {"parsed": 1, "reused": 6}
    ids = {r.id for r in again.symbols.select("id").collect()}
    assert "admin/user.py::UserService::remove" in ids and not any(i.startswith("web/app.js") for i in ids)
    assert ("main.py", "call", "admin.delete_user") not in links(again) or links(again)["main.py", "call", "admin.delete_user"][1] != "scope"
    gone = model.with_files("admin/user.py", None)
    assert not any(r.file_path == "admin/user.py" for r in gone.symbols.collect())
    assert gone.containments.where(F.col("child_id").startswith("admin/user.py")).isEmpty()


def test_answers(built):
    model, _, _, sources = built
    project = Project.of(model, sources)
    a = answer(project, P.analyze_impact("save"))
    assert a.status == "ok" and "main.py" in a.text and "Affected at depth 1" in a.text
    p = answer(project, P.trace_path("run", "check"))
    assert p.status == "ok" and "`run`" in p.text and "`check`" in p.text and "### Paths" in p.text
    r = answer(project, P.explore_region("main.py::run", depth=1))
    assert r.status == "ok" and "at line 9: `service.save(user)`" in r.text and "6\tdef run():" in r.text
    assert "Keeps a user." in answer(project, P.explore_region("save")).text
    assert "unbound references: missing_thing.go" in answer(project, P.explore_region("delete_user")).text
    assert answer(project, P.explore_region("UserService", auto_pick=False)).status == "ambiguous"
    assert answer(project, P.explore_region("zzzqqq")).status == "not_found"
    assert answer(project, P.QueryPlan("path", ("a",), direction="up", depth=0)).errors == ["a path needs two anchors", "direction is one of incoming, outgoing, both, not 'up'", "depth is a number from 1, not 0"]
    found = answer(project, P.search_symbols("store"))
    assert found.status == "candidates" and found.candidates[0]["name"] in ("Store", "store")
    assert answer(project, P.explore_flow("how does run get_current_user work")).status == "ok"
    assert len(answer(project, P.explore_region("main.py::run", budget=60)).text) < len(r.text)


def test_retrieval(built):
    model, _, _, sources = built
    got = retrieve_context(Project.of(model, sources), "how does delete_user work")
    assert got["strategy"] == "flow" and "admin/user.py::UserService::delete_user" in got["symbols"]
    assert retrieve_context(Project.of(model, sources), "qqqq zzzz")["symbols"] == []


def test_anchor_stages(built):
    nodes = G.build(built[0].symbols, built[0].containments, built[0].resolved)[0]
    assert S.resolve_anchor(nodes, "main.py::run") == ("resolved", ["main.py::run"])
    assert S.resolve_anchor(nodes, "userservice.SAVE") == ("resolved", ["services/user.py::UserService::save"])
    assert S.resolve_anchor(nodes, "UserService")[0] == "ambiguous"
    assert S.resolve_anchor(nodes, "deleteuser_x")[0] in ("not_found", "ambiguous", "resolved")
    ids, missing = S.free_form(nodes, "where is delete_user and xyzzy")
    assert ids[0] == "admin/user.py::UserService::delete_user" and missing == ["xyzzy"]


def test_store(built, spark, tmp_path):
    model, *_ = built
    store = Store(spark, f"{tmp_path}/s")
    with pytest.raises(MissingIndex):
        store.load()
    tables = {"symbols": model.symbols, "resolved": model.resolved}
    assert [store.save(tables), store.save(tables), store.save(tables)] == [1, 2, 3] and store.versions() == [2, 3]
    assert store.built_at() and store.changed(2) and not store.changed(3)
    back = store.load()["symbols"]
    assert sorted(map(str, back.collect())) == sorted(map(str, model.symbols.collect()))
    assert Store(spark, f"{tmp_path}/s", schema_version=5).load() == {}
    to_json(tables, f"{tmp_path}/j")
    got = from_json(spark, f"{tmp_path}/j", {"symbols": model.symbols.schema})["symbols"]
    assert sorted(map(str, got.collect())) == sorted(map(str, model.symbols.collect()))
    assert '"symbols"' in model_json(tables)
