"""Reference resolution as prioritised joins: every way to bind a reference gives candidate rows, and the first wins.

Imports are bound first. Then the bases of all other references are gathered with their priority (receiver,
lexical scopes from the inside out, imports by longest prefix, qualified name, global name, builtins), the rest of each
dotted chain is followed for all of them at once, one join a hop, and the best that reached its end stays.
Symbols outside the project are minted with identifiers that depend on nothing but their names.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from symgraph.functions.shared import materialized
from symgraph.functions.text import module_paths

from .graph import STRUCTURE_KINDS
from .model import Model, contains, range_size, scope_members

# Names that are builtin, and names whose failure is not worth a diagnostic.
BUILTINS = """print len str int float dict list set tuple range enumerate zip getattr setattr hasattr any all min max sum open type id map filter next iter repr
Exception ValueError TypeError KeyError bool abs round pow divmod sorted reversed slice ord chr isinstance issubclass callable locals globals hash classmethod staticmethod property super object
console log error warn info dir Math Date JSON Map Set Promise Object Array String Number Boolean RegExp Error setTimeout setInterval clearTimeout clearInterval parseInt parseFloat isNaN isFinite
encodeURIComponent decodeURIComponent""".split()
NATIVE = "console print len range str int dict list set true false".split()
TYPES = ["class", "interface"]


def category(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext == ".py", "python").when(ext == ".java", "java").when(ext == ".html", "html").when(ext.isin(".ts", ".tsx", ".js", ".jsx"), "typescript").otherwise("unknown")


def first_match_wins(candidates: list[DataFrame], key: str, target: str) -> DataFrame:
    """Of rows (key, target, method, priority) the one of least (priority, target) for each key."""
    rows = reduce(lambda a, b: a.unionByName(b), candidates)
    best = rows.groupBy(key).agg(F.min(F.struct("priority", F.col(target), "method")).alias("m"))
    return best.select(key, F.col(f"m.{target}").alias(target), F.col("m.method").alias("method"))


def import_keys(path: str, target: str | None, lang: str) -> tuple[list[str], str | None]:
    """Module names that an import may mean, in order, and the path that a file's path may end with."""
    target = (target or "").replace("\\", "/")
    here = posixpath.dirname(path)
    if lang == "python":
        dots = len(target) - len(target.lstrip("/"))
        at = target
        if dots:
            for _ in range(dots - 1):
                here = posixpath.dirname(here)
            at = posixpath.normpath(posixpath.join(here, target[dots:])).removeprefix("./")
        return [at, f"{at}.py", f"{at}/__init__.py", at.replace("/", ".")], at
    clean = re.sub(r"^[./]+", "", target)
    if lang == "java":
        return [], None if clean.endswith("*") else clean
    at = posixpath.normpath(posixpath.join(here, target))
    more = [f"{at}{e}" for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")]
    return ([at, at.rsplit(".", 1)[0], *more] if lang == "html" else [at, *more]), clean


@F.pandas_udf(ArrayType(StringType()))
def _import_keys(path: pd.Series, target: pd.Series, lang: pd.Series) -> pd.Series:
    """The module names, and last the suffix."""
    out = []
    for p, t, g in zip(path, target, lang, strict=True):
        keys, end = import_keys(p, t, g)
        out.append([*keys, end])
    return pd.Series(out)


@F.pandas_udf(ArrayType(StringType()))
def _module_paths(path: pd.Series) -> pd.Series:
    return path.map(module_paths)


def capitalised(name: Column) -> Column:
    return (F.upper(F.substring(name, 1, 1)) == F.substring(name, 1, 1)) & (F.lower(F.substring(name, 1, 1)) != F.substring(name, 1, 1))


def resolve_imports(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref, target, method) for import references: by module, by suffix of a file's path, by global name, or external.

    A file that is the suffix of another's name is found by an equi-join on the endings of last segments.
    """
    refs = imports.withColumn("lang", category(F.col("file_path"))).withColumn("keys", _import_keys("file_path", "import_path", "lang"))
    refs = refs.select(F.col("id").alias("ref"), "file_path", "lang", "raw_name", "import_path", "ast_node_type", F.coalesce("imported_name", "raw_name").alias("lookup"), "keys")
    refs = materialized(refs, "imports")
    files = symbols.where("kind = 'file'").select(F.col("id").alias("file_id"), F.col("file_path").alias("target_path"), F.col("name").alias("file_name"), F.col("seq").alias("file_seq"))
    # of files with one module name the last one has it
    modules = files.select("file_id", "target_path", "file_name", "file_seq", F.explode(_module_paths("target_path")).alias("key")).groupBy("key").agg(F.max_by(F.struct("file_id", "target_path", "file_name"), "file_seq").alias("f"))
    tries = refs.select("ref", F.posexplode(F.slice("keys", F.lit(1), F.size("keys") - 1)).alias("nth", "key"))
    by_module = tries.join(modules, "key").select("ref", F.col("nth").cast("long").alias("nth"), "f")
    bare = F.regexp_replace("target_path", F.lit(r"\.[A-Za-z0-9]+$"), F.lit(""))
    last = F.element_at(F.split(bare, "/"), -1)
    ends = files.select("file_id", "target_path", "file_name", "file_seq", bare.alias("bare"), F.explode(F.transform(F.sequence(F.lit(1), F.length(last)), lambda i: F.substring(last, i, F.length(last)))).alias("end"))
    wanted = refs.select("ref", F.element_at("keys", -1).alias("suffix")).where("suffix is not null and suffix <> ''").withColumn("end", F.element_at(F.split("suffix", "/"), -1))
    by_suffix = wanted.join(ends, "end").where(F.col("bare").endswith(F.col("suffix"))).select("ref", (F.lit(1000) + F.col("file_seq")).alias("nth"), F.struct("file_id", "target_path", "file_name").alias("f"))
    target = by_module.unionByName(by_suffix).groupBy("ref").agg(F.min_by("f", "nth").alias("f")).select("ref", "f.*")
    at = refs.join(target, "ref")
    whole = at.where((F.col("lang") == "html") | ((F.col("lang") == "python") & (F.col("ast_node_type") == "import_statement")))
    found = [whole.select("ref", F.col("file_id").alias("target"), F.lit("import").alias("method"), F.lit(0).cast("long").alias("priority"))]
    named = symbols.where("kind not in ('file', 'project') and exported").select(F.col("id").alias("target"), "name", "qualified_name", F.col("file_path").alias("target_path"), "seq")
    inside = at.where("lang <> 'html'").join(named, "target_path").where((F.col("name") == F.col("lookup")) | (F.col("qualified_name") == F.col("lookup")))
    found.append(inside.groupBy("ref").agg(F.min_by("target", "seq").alias("target")).select("ref", "target", F.lit("import").alias("method"), F.lit(1).cast("long").alias("priority")))
    itself = at.where((F.col("lang") == "python") & ((F.col("file_name") == F.col("lookup")) | F.col("target_path").endswith(F.concat("lookup", F.lit(".py")))))
    found.append(itself.select("ref", F.col("file_id").alias("target"), F.lit("import").alias("method"), F.lit(2).cast("long").alias("priority")))
    everywhere = named.groupBy("name", category(F.col("target_path")).alias("lang")).agg(F.min_by("target", "seq").alias("target"))
    glob = refs.where("lang <> 'html'").join(everywhere, (refs.lookup == everywhere.name) & (refs.lang == everywhere.lang)).select("ref", "target", F.lit("import").alias("method"), F.lit(3).cast("long").alias("priority"))
    found.append(glob)
    tops = files.select(F.get(F.split("target_path", "/"), 0).alias("top")).distinct()
    outside = refs.where("import_path is not null and import_path <> ''").withColumn("top", F.get(F.split("import_path", "/"), 0)).where("top <> ''").join(tops, "top", "left_anti")
    ext = F.concat_ws("::", F.lit("external"), F.replace("import_path", F.lit("\\"), F.lit("/")), "lookup")
    found.append(outside.select("ref", ext.alias("target"), F.lit("import").alias("method"), F.lit(4).cast("long").alias("priority")))
    return first_match_wins(found, "ref", "target")


def resolve_types(symbols: DataFrame, wanted: DataFrame, bindings: DataFrame) -> DataFrame:
    """(file_path, type, target): the class or interface that a type name (a joined chain) means in a file.

    What the file imported under the name, a qualified name, a type of the file, or the only one of the name.
    """
    w = wanted.select("file_path", "type").distinct().withColumn("last", F.element_at(F.split("type", r"\."), -1)).withColumn("lang", category(F.col("file_path")))
    types = symbols.where(F.col("kind").isin(TYPES)).select(F.col("id").alias("target"), "name", "qualified_name", F.col("file_path").alias("at"), "seq").withColumn("lang", category(F.col("at")))
    bound = bindings.join(types.select("target"), "target", "left_semi").select("file_path", F.col("raw_name").alias("bound"), "target")
    row = lambda df, p: df.select("file_path", "type", "target", F.lit(p).alias("priority"))
    parts = [
        row(w.join(bound, "file_path").where("bound = type"), 0),
        row(w.join(bound, "file_path").where("bound = last"), 1),
        row(w.where("type <> last").join(types.select(F.col("qualified_name").alias("type"), "lang", "target", "seq"), ["type", "lang"]).groupBy("file_path", "type").agg(F.min_by("target", "seq").alias("target")), 2),
        row(w.join(types.select("target", F.col("name").alias("last"), F.col("at").alias("file_path"), "seq"), ["last", "file_path"]).groupBy("file_path", "type").agg(F.min_by("target", "seq").alias("target")), 3),
        row(w.join(types.groupBy(F.col("name").alias("last"), "lang").agg(F.min("target").alias("target"), F.count("*").alias("n")).where("n = 1"), ["last", "lang"]), 4),
    ]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("file_path", "type").agg(F.min_by("target", F.struct("priority", "target")).alias("target"))


def enclosing_class(symbols: DataFrame, containments: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, class_id): the nearest class, interface or struct that contains each of `ids` (id), at any height."""
    parent = containments.where(F.col("kind").isin("owns", "has_member")).groupBy(F.col("child_id").alias("cur")).agg(F.min_by("parent_id", "seq").alias("up"))
    kinds = symbols.select(F.col("id").alias("up"), (F.col("kind").isin("class", "interface", "struct")).alias("is_class"))
    parent = materialized(parent.join(kinds, "up", "left"), "parents")
    at, out = ids.select("id", F.col("id").alias("cur")), None
    seen = at
    while True:
        step = materialized(at.join(parent, "cur"), "up")
        hit = step.where("is_class").select("id", F.col("up").alias("class_id"))
        out = hit if out is None else out.unionByName(hit)
        # what contains itself is come to once
        at = materialized(step.where("not coalesce(is_class, false)").select("id", F.col("up").alias("cur")).join(seen, ["id", "cur"], "left_anti"), "above")
        seen = seen.unionByName(at)
        if at.isEmpty():
            break
    return out


def follow(bases: DataFrame, symbols: DataFrame, containments: DataFrame, types: DataFrame) -> DataFrame:
    """Rows of `bases` (ref, chain, hop, cur, ...) whose chain could be followed to its end, with `cur` at that end.

    A hop goes to a contained symbol of the name; from a variable to a member of its type; from a symbol outside the
    project, or a type that is, to a member minted there.
    """
    known = symbols.select(F.col("id").alias("child_id"), F.col("name").alias("member"))
    child = containments.join(known, "child_id").groupBy(F.col("parent_id").alias("cur"), "member").agg(F.min_by("child_id", "seq").alias("next"))
    child = materialized(child, "children")
    variables = symbols.where("kind = 'variable' and declared_type is not null").select(F.col("id").alias("cur"), "file_path", F.array_join("declared_type", ".").alias("type"), F.element_at("declared_type", -1).alias("last"))
    variables = variables.join(types.withColumnRenamed("target", "type_id"), ["file_path", "type"], "left").select("cur", "last", "type_id")
    variables = materialized(variables.where("type_id is null or type_id <> cur"), "variables")
    done = bases.where(F.col("hop") >= F.size("chain"))
    live, rest = materialized(bases.where(F.col("hop") < F.size("chain")), "chains"), bases.columns
    while not live.isEmpty():  # a hop a level, up to the longest chain
        at = live.withColumn("member", F.get("chain", F.col("hop")))
        at = at.join(child, ["cur", "member"], "left").join(variables, "cur", "left")
        typed = child.select(F.col("cur").alias("type_id"), "member", F.col("next").alias("typed"))
        at = at.join(typed, ["type_id", "member"], "left")
        minted = F.when(F.col("cur").startswith("external::"), F.concat_ws("::", "cur", "member"))
        outside = F.when(F.col("type_id").isNull() & capitalised(F.col("last")), F.concat_ws("::", F.lit("external::type"), "last", "member"))
        to = F.coalesce("next", "typed", outside, minted)
        step = at.withColumn("to", to).where("to is not null").withColumn("cur", F.col("to")).withColumn("hop", F.col("hop") + 1)
        step = materialized(step.select(*rest), "hop")
        done = done.unionByName(step.where(F.col("hop") >= F.size("chain")))
        live = step.where(F.col("hop") < F.size("chain"))
    return done


def resolved(model: Model) -> Model:
    """The model with `resolved` (candidate_id, from_symbol_id, to_symbol_id, kind, resolution_method, seq), `unresolved`, its
    diagnostics, and symbols and containments for what lies outside the project."""
    symbols, refs = materialized(model.symbols, "symbols"), materialized(model.references, "references")
    scopes, containments = model.scopes, model.containments
    imports, others = refs.where("kind = 'import'"), refs.where("kind <> 'import'")
    bound = materialized(resolve_imports(symbols, imports), "bound")
    names = bound.join(imports.select(F.col("id").alias("ref"), "file_path", "raw_name", "seq"), "ref").groupBy("file_path", "raw_name").agg(F.max_by("target", "seq").alias("target"))
    names = materialized(names, "names")
    wanted = symbols.where("declared_type is not null").select("file_path", F.array_join("declared_type", ".").alias("type")).unionByName(model.bindings.select("file_path", F.array_join("type_chain", ".").alias("type")))
    types = materialized(resolve_types(symbols, wanted, names), "types")
    r = others.select(F.col("id").alias("ref"), "from_symbol_id", "file_path", F.when(F.size("qualifier_chain") > 0, F.col("qualifier_chain")).otherwise(F.array("raw_name")).alias("chain"), *[F.col(c).alias(f"r_{c}") for c in ("start_line", "start_col", "end_line", "end_col")])
    r = materialized(r.withColumn("head", F.get("chain", 0)).withColumn("lang", category(F.col("file_path"))), "refs")
    own = r.where(F.col("head").isin("this", "self") & (F.size("chain") > 1))
    free = r.join(own.select("ref"), "ref", "left_anti")

    def base(df: DataFrame, cur: str, hop: Column, priority: Column, method: str, chain: Column | None = None) -> DataFrame:
        return df.select("ref", (F.col("chain") if chain is None else chain).alias("chain"), hop.cast("int").alias("hop"), F.col(cur).alias("cur"), priority.cast("long").alias("priority"), F.lit(method).alias("method"))

    one, size = F.lit(1), F.size("chain")
    owner = enclosing_class(symbols, containments, own.select(F.col("from_symbol_id").alias("id")).distinct())
    bases = [base(own.join(owner.withColumnRenamed("id", "from_symbol_id"), "from_symbol_id"), "class_id", one, F.lit(0), "scope")]
    sc = scopes.select(F.col("id").alias("scope_id"), "owner_symbol_id", "file_path", "start_line", "start_col", "end_line", "end_col")
    walk = free.join(sc, "file_path").where(contains("", "r_")).withColumn("prio", F.lit(1_000_000) + range_size())
    walk = materialized(walk.select("ref", "chain", "head", "file_path", "scope_id", "owner_symbol_id", "prio"), "walk")
    inner = scope_members(symbols, scopes).groupBy("scope_id", F.col("name").alias("head")).agg(F.min_by("id", "seq").alias("cur"))
    here = materialized(walk.join(inner, ["scope_id", "head"]), "here")
    bases.append(base(here, "cur", one, F.col("prio") * 2, "scope"))
    local = model.bindings.groupBy("owner_symbol_id", F.col("name").alias("head")).agg(F.max_by(F.array_join("type_chain", "."), "seq").alias("type"))
    through = walk.where(size > 1).join(here.select("ref", "scope_id"), ["ref", "scope_id"], "left_anti").join(local, ["owner_symbol_id", "head"]).join(types, ["file_path", "type"])
    bases.append(base(through, "target", one, F.col("prio") * 2 + 1, "scope"))
    prefixes = free.select("*", F.explode(F.sequence(F.lit(1), size)).alias("n")).withColumn("raw_name", F.array_join(F.slice("chain", F.lit(1), F.col("n")), "."))
    far = 1 << 50
    bases.append(base(prefixes.join(names, ["file_path", "raw_name"]), "target", F.col("n"), F.lit(far) - F.col("n"), "scope"))
    plain = symbols.select("id", "name", "qualified_name", "kind", "seq", category(F.col("file_path")).alias("lang"))
    by_qname = plain.groupBy("lang", F.col("qualified_name").alias("q")).agg(F.min_by("id", "seq").alias("cur"))
    bases.append(base(free.where(size > 1).withColumn("q", F.array_join("chain", ".")).join(by_qname, ["lang", "q"]), "cur", size, F.lit(far + 1), "qualified_name"))
    by_name = plain.groupBy("lang", F.col("name").alias("head")).agg(F.min_by("id", F.struct(F.col("kind").isin("file", "project"), "seq")).alias("cur"))
    anywhere = free.join(by_name, ["lang", "head"])
    bases += [base(anywhere, "cur", one, F.lit(far + 2), "global_fallback"), base(anywhere, "cur", size, F.lit(far + 3), "global_fallback")]
    builtin = free.where(F.col("head").isin(BUILTINS)).withColumn("cur", F.concat(F.lit("external::builtin::"), "head"))
    bases.append(base(builtin, "cur", one, F.lit(far + 4), "global_fallback"))
    rows = materialized(reduce(lambda a, b: a.unionByName(b), bases), "bases")
    ends = follow(rows, symbols, containments, types)
    best = ends.groupBy("ref").agg(F.min_by(F.struct("cur", "method"), F.struct("priority", "cur")).alias("m")).select("ref", F.col("m.cur").alias("target"), F.col("m.method").alias("method"))
    imported = free.unionByName(own).join(names.select("file_path", F.col("raw_name").alias("head")), ["file_path", "head"], "left_semi").select("ref", F.lit(True).alias("imported"))
    best = best.join(imported, "ref", "left").select("ref", "target", F.when((F.col("method") == "scope") & F.col("imported"), "import").otherwise(F.col("method")).alias("method"))
    every = materialized(bound.unionByName(best).withColumnRenamed("ref", "id"), "every")
    out = refs.join(every, "id").select(F.col("id").alias("candidate_id"), "from_symbol_id", F.col("target").alias("to_symbol_id"), "kind", F.col("method").alias("resolution_method"), "seq")
    left = refs.join(every.select("id"), "id", "left_anti")
    is_import = F.col("kind") == "import"
    told = left.where(is_import | ~F.lower("raw_name").isin(NATIVE)).select(
        F.when(is_import, "unresolved_import").otherwise("unresolved_reference").alias("kind"), F.when(is_import, "warning").otherwise("info").alias("severity"),
        F.when(is_import, F.concat(F.lit("cannot find "), "raw_name", F.lit(" in "), F.coalesce("import_path", F.lit("an unknown path")))).otherwise(F.concat(F.lit("cannot resolve "), "raw_name")).alias("message"),
        "file_path", "start_line", "start_col", "end_line", "end_col", F.col("id").alias("related_candidate_id"),
    )
    new, held = externals(out, symbols)
    return replace(model, symbols=symbols.unionByName(new), containments=containments.unionByName(held), resolved=out, unresolved=left, diagnostics=model.diagnostics.unionByName(told))


def externals(out: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols for targets outside the project, with those that hold them, and the containments between."""
    ids = out.where(F.col("to_symbol_id").startswith("external::")).select(F.split("to_symbol_id", "::").alias("p"), "to_symbol_id").distinct()
    up = ids.select(F.explode(F.sequence(F.lit(3), F.greatest(F.size("p"), F.lit(3)))).alias("n"), "p").select(F.array_join(F.slice("p", F.lit(1), F.col("n")), "::").alias("id"), "n", "p").distinct()
    up = up.join(symbols.select("id"), "id", "left_anti").withColumn("name", F.element_at(F.split("id", "::"), -1)).select("id", "n", "name").distinct()
    kind = F.when(F.col("id").startswith("external::builtin::") & (F.col("n") == 3), "function").when(capitalised(F.col("name")), "class").when(F.col("n") > 3, "method").otherwise("variable")
    place = F.when(F.col("id").startswith("external::builtin::"), "builtin").otherwise("external")
    made = {
        "id": F.col("id"), "kind": kind, "name": F.col("name"), "qualified_name": F.array_join(F.slice(F.split("id", "::"), 3, 99), "."), "file_path": place, "exported": F.lit(True), "visibility": F.lit("public"),
        "is_service": F.lit(False), "is_external": F.lit(True), "seq": F.lit(1 << 60),
    }
    new = up.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in symbols.schema])
    held = up.where("n > 3").select(F.array_join(F.slice(F.split("id", "::"), F.lit(1), F.size(F.split("id", "::")) - 1), "::").alias("parent_id"), F.col("id").alias("child_id"), F.lit(STRUCTURE_KINDS[2]).alias("kind"), F.lit(1 << 60).alias("seq"))
    return new, held
