"""Symbol search: exact, prefix, substring and trigram matching, scored discovery with fallbacks, and anchor binding.

`nodes` has id, name, file_path, kind, and optionally qualified_name, seq, api_method, api_path, is_service. One query is a few
literals, so each channel is a filter over one scan; discovery adds the channels' points per node and re-ranks.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.shared import materialized
from symgraph.functions.text import WEAK_TERMS, endpoint_key, is_peripheral, is_peripheral_anchor, prefix_ladder, stem, terms, words

# Kinds that count as definitions; points of each channel; limits of the typo fallback.
DEFINITION_KINDS = ["class", "interface", "struct", "function", "method", "type_alias", "enum"]
POINTS = {"service": 10, "name_exact": 8, "name_prefix": 6, "name_substring": 4, "qname_exact": 6, "qname_substring": 3, "path_definition": 5, "path_other": 2, "route": 15}
FUZZY_POOL, FUZZY_BEST = 600, 12


def prepared(nodes: DataFrame) -> DataFrame:
    """Adds what search needs and is not there: lowered columns, qualified_name, seq-like order."""
    out = nodes
    if "qualified_name" not in out.columns:
        out = out.withColumn("qualified_name", F.col("name"))
    if "exported" not in out.columns:
        out = out.withColumn("exported", F.lit(True))
    if "is_service" not in out.columns:
        out = out.withColumn("is_service", F.lit(False))
    for c in ("name", "qualified_name", "file_path"):
        out = out.withColumn(f"{c}_lower", F.lower(c))
    return out


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.lower("name") == name.lower())


def by_qualified_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.lower("qualified_name") == name.lower())


def match(nodes: DataFrame, column: str, token: str) -> DataFrame:
    """Nodes whose column contains the token, without regard to case, and whether it is the whole of it."""
    low = F.lower(column)
    return nodes.where(low.contains(token.lower())).withColumn("exact", low == token.lower())


def starting_with(nodes: DataFrame, prefix: str, most: int | None = None) -> DataFrame:
    found = nodes.where(F.lower("name").startswith(prefix.lower()))
    return found if most is None else found.orderBy("name", "id").limit(most)


def trigrams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def trigram_index(nodes: DataFrame, column: str = "name") -> DataFrame:
    """(trigram, id): to be stored once, clustered by trigram, for selective lookups in very large tables."""
    low = F.lower(column)
    return nodes.where(F.length(column) >= 3).select(F.explode(trigrams(low)).alias("trigram"), "id")


def trigram_match(nodes: DataFrame, index: DataFrame, token: str, column: str = "name") -> DataFrame:
    """Substring matches by the index: nodes with all trigrams of the token, rechecked; short tokens scan."""
    token = token.lower()
    if len(token) < 3:
        return match(nodes, column, token)
    grams = sorted({token[i : i + 3] for i in range(len(token) - 2)})
    ids = index.where(F.col("trigram").isin(grams)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")
    return match(nodes.join(ids, "id", "left_semi"), column, token)


def endpoints(nodes: DataFrame, order: Column) -> DataFrame:
    """(endpoint, id): for each method and path the handler registered last."""
    rows = nodes.where(F.col("api_method").isNotNull())
    return rows.groupBy(endpoint_key(F.col("api_method"), F.col("api_path")).alias("endpoint")).agg(F.max_by("id", order).alias("id"))


def endpoint(nodes: DataFrame, method: str, path: str, order: Column) -> DataFrame:
    """The handler registered last for a method and path."""
    return endpoints(nodes, order).where(F.col("endpoint") == f"{method.upper()} {path}")


def services(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("kind") == "class") & (F.col("is_service") | F.col("name").endswith("Service")))


def channels(term: str, weight: float = 1.0, paths: bool = True, service_term: str | None = None) -> list[tuple[str, Column, Column]]:
    """(name, condition, points) of each way a term can match; all that hold add up."""
    name, qname, path, p = F.col("name_lower"), F.col("qualified_name_lower"), F.col("file_path_lower"), POINTS
    out = [
        ("service", (F.col("kind") == "class") & (F.col("is_service") | F.col("name").endswith("Service")) & (F.col("name") == (service_term or term)), F.lit(p["service"])),
        ("name", name.contains(term), F.when(name == term, p["name_exact"]).when(name.startswith(term), p["name_prefix"]).otherwise(p["name_substring"])),
        ("qualified name", qname.contains(term), F.when(qname == term, p["qname_exact"]).otherwise(p["qname_substring"])),
    ]
    if paths:
        out.append(("path", path.contains(term), F.when(F.col("kind").isin("class", "function"), p["path_definition"]).otherwise(p["path_other"])))
    return [(n, c, (v * F.lit(float(weight))).cast("double")) for n, c, v in out]


def scored_term(nodes: DataFrame, term: str, origin: str, stage: int, weight: float = 1.0, paths: bool = True, service_term: str | None = None) -> DataFrame:
    """(id, token, stage, points, reasons) of the nodes that a term matches, in one scan."""
    made = channels(term, weight, paths, service_term)
    points = reduce(lambda a, b: a + b, [F.when(c, v).otherwise(0.0) for _, c, v in made])
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(f"{n} match: {term}")) for n, c, _ in made]))
    hit = reduce(lambda a, b: a | b, [c for _, c, _ in made])
    return nodes.where(hit).select("id", F.lit(origin).alias("token"), F.lit(stage).alias("stage"), points.alias("points"), reasons.alias("reasons"))


def fuzzy(nodes: DataFrame, token: str, stage: int = 9) -> DataFrame:
    """Typo fallback: names that share the first two letters, within one edit (two for tokens over five letters) of
    the token, by their head of its length or whole; the best twelve."""
    most = 1 if len(token) <= 5 else 2
    pool = starting_with(nodes, token[:2], FUZZY_POOL)
    name = F.lower("name")
    head = F.levenshtein(F.lit(token), F.substring(name, 1, len(token)), most)
    whole = F.levenshtein(F.lit(token), name, most)
    d = F.when(head >= 0, head).when(whole >= 0, whole)
    near = pool.withColumn("d", d).where("d is not null").orderBy("d", "name", "id").limit(FUZZY_BEST)
    return near.select("id", F.lit(token).alias("token"), F.lit(stage).alias("stage"), F.when(F.col("d") == 0, 6.0).otherwise(4.0 - F.col("d")).alias("points"), F.array(F.lit(f"near match: {token}")).alias("reasons"))


def cascade(nodes: DataFrame, token: str) -> DataFrame:
    """Matches of the first stage that has any: the token, its stem, shorter prefixes, a typo."""
    low = token.lower()
    tries = [(low, 1.0, token)]
    if (root := stem(low)) and root != low:
        tries.append((root, 1.0, root))
    tries += [(p, 0.5, p) for p in prefix_ladder(low)]
    hits = reduce(lambda a, b: a.unionByName(b), [scored_term(nodes, t, low, i, w, service_term=s) for i, (t, w, s) in enumerate(tries)])
    if len(low) >= 4:
        hits = hits.unionByName(fuzzy(nodes, low))
    hits = materialized(hits, "cascade")
    first = hits.agg(F.min("stage")).first()[0]
    return hits.where(F.col("stage") == first) if first is not None else hits


def discover(nodes: DataFrame, query: str, limit: int | None = 10, endpoints: DataFrame | None = None) -> DataFrame:
    """(id, kind, name, file_path, score, tokens, reasons): candidates for a question, best first."""
    nodes = prepared(nodes)
    strong, weak = terms(query)
    parts = [cascade(nodes, t) for t in strong] + [scored_term(nodes, t, t, 0, 0.35, paths=False) for t in weak]
    route = re.search(r"(GET|POST|PUT|DELETE|PATCH)\s+(\S+)", query, re.I)
    if route and "api_method" in nodes.columns:
        at = endpoint(nodes, route[1], route[2], F.col("seq") if "seq" in nodes.columns else F.col("id"))
        parts.append(at.select("id", F.lit(None).cast("string").alias("token"), F.lit(0).alias("stage"), F.lit(float(POINTS["route"])).alias("points"), F.array(F.concat(F.lit("endpoint: "), "endpoint")).alias("reasons")))
    if not parts:
        return nodes.limit(0).select("id", "kind", "name", "file_path", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("tokens"), F.array().cast("array<string>").alias("reasons"))
    hits = reduce(lambda a, b: a.unionByName(b), parts)
    return ranked(nodes, hits, query, bool(weak), limit)


def ranked(nodes: DataFrame, hits: DataFrame, query: str, has_weak: bool, limit: int | None) -> DataFrame:
    """Re-rank by how many terms a node and its file match, by kind, brevity and place, in that order."""
    per = hits.groupBy("id").agg(F.sum("points").alias("points"), F.array_sort(F.collect_set("token")).alias("tokens"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    found = materialized(per.join(nodes.select("id", "kind", "name", "file_path"), "id"), "scored")
    in_file = found.select("file_path", F.explode("tokens").alias("t")).groupBy("file_path").agg(F.countDistinct("t").alias("file_terms"))
    n, f = F.size("tokens"), F.coalesce("file_terms", F.lit(0))
    s = F.col("points") * F.when(n >= 2, 1 + (n - 1) * 0.5).otherwise(1.0)
    all_weak = (n > 0) & F.forall("tokens", lambda t: t.isin(sorted(WEAK_TERMS)))
    s = s * F.when(all_weak & F.lit(has_weak), 0.4).otherwise(1.0)
    s = s + F.when(f >= 2, (f - 1) * 8).otherwise(0)
    s = s * F.when(F.col("kind").isin(DEFINITION_KINDS), 1.4).when(F.col("kind") == "variable", 0.5).otherwise(1.0)
    s = s + F.when((F.col("kind") != "file") & (F.length("name") <= 12), 2).otherwise(0)
    if not re.search(r"\b(tests?|specs?|fixtures?|mocks?)\b", query, re.I):
        s = s * F.when(is_peripheral(F.col("file_path")), 0.3).otherwise(1.0)
    out = found.join(in_file, "file_path", "left").select("id", "kind", "name", "file_path", s.alias("score"), "tokens", "reasons")
    return out if limit is None else out.orderBy(F.desc(F.round("score", 6)), "id").limit(limit)


def resolve_anchor(nodes: DataFrame, spec: str) -> tuple[str, list[str]]:
    """('resolved' | 'ambiguous' | 'not_found', ids): by id, qualified name, name among definitions, then discovery.

    A discovery is resolved if one exact name is found or the best score is twice the next; at most ten ids.
    """
    nodes = prepared(nodes)
    low = spec.lower()
    stage = F.when(F.col("id") == spec, 0).when(F.col("qualified_name_lower") == low, 1).when((F.col("name_lower") == low) & F.col("kind").isin(DEFINITION_KINDS), 2)
    hits = nodes.select("id", "name", "qualified_name", "file_path", "exported", stage.alias("stage")).where("stage is not null")
    rows = hits.orderBy("stage", is_peripheral_anchor(F.col("file_path")), F.coalesce("exported", F.lit(False)).desc(), F.length("qualified_name"), "id").limit(50).collect()
    if rows:
        best = [r.id for r in rows if r.stage == rows[0].stage]
        return ("resolved", best) if len(best) == 1 else ("ambiguous", best[:10])
    found = discover(nodes, spec, 20).select("id", "name", "score").collect()
    if not found:
        return "not_found", []
    exact = [r.id for r in found if r.name.lower() == low]
    if len(exact) == 1:
        return "resolved", exact
    if len(found) == 1 or found[0].score >= 2 * found[1].score:
        return "resolved", [found[0].id]
    return "ambiguous", [r.id for r in found[:10]]


def resolve_all(nodes: DataFrame, specs: list[str], tolerate_missing: bool = True) -> tuple[list[str], list[str]]:
    """(ids, dropped): anchors of all specs; ambiguous ones take their best if missing ones are tolerated."""
    got, dropped, reserve = [], [], []
    for spec in specs:
        kind, ids = resolve_anchor(nodes, spec)
        if kind == "resolved":
            got += [i for i in ids[:1] if i not in got]
        elif kind == "ambiguous":
            found = discover(nodes, spec, 2).select("id", "score").collect() if tolerate_missing else []
            if len(found) == 1 or (len(found) == 2 and found[0].score >= 1.25 * found[1].score):
                got += [found[0].id] if found[0].id not in got else []
            else:
                dropped.append(spec)
                reserve += ids[:1]
        else:
            dropped.append(spec)
    return (got or reserve[:1]), dropped


def free_form(nodes: DataFrame, query: str, most: int = 8) -> tuple[list[str], list[str]]:
    """(ids, unmatched terms): anchors for a whole question: what its words that look like identifiers name exactly, which always
    stay, then candidates near the best, at most three a file, two files, eight in all."""
    chosen, per_file, files, exact = [], {}, 0, set()
    for spec in (w for w in words(query) if re.search(r"[A-Z_/]", w)):
        kind, ids = resolve_anchor(nodes, spec)
        for i in ids if kind == "resolved" else []:
            exact.add(spec.lower())
            if i not in chosen and len(chosen) < most:
                chosen.append(i)
    if chosen:
        for r in nodes.where(F.col("id").isin(chosen)).select("file_path", "kind").collect():
            per_file[r.file_path] = per_file.get(r.file_path, 0) + 1
            files += r.kind == "file"
    rows = discover(nodes, query, 40).collect()
    floor = max(0.4 * rows[0].score, 5) if rows else 0
    for r in [r for r in rows if r.score >= floor] or rows[:1]:
        if r.id in chosen:
            continue
        if per_file.get(r.file_path, 0) >= 3 or (r.kind == "file" and files >= 2) or len(chosen) >= most:
            continue
        per_file[r.file_path] = per_file.get(r.file_path, 0) + 1
        files += r.kind == "file"
        chosen.append(r.id)
    matched = {t for r in rows for t in r.tokens} | exact
    return chosen, [t for t in terms(query)[0] if t.lower() not in matched]


def incoming_index(edges: DataFrame) -> DataFrame:
    """(id, kind, sources): reverse map of all edges."""
    return edges.groupBy(F.col("dst").alias("id"), "kind").agg(F.array_sort(F.collect_set("src")).alias("sources"))


def first_of_each(df: DataFrame, parts: list[str], order: list[Column], most: int = 1) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    return df.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
