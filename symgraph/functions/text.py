"""Scalar functions over names, paths and queries: plain Python for one query string, columns for tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never search terms.
HARD_STOPWORDS = set(
    """a an the is are was were be been being am to of in on at by for with from into onto via and or but if then else so than as not
    how what when where why which who does do did this that these those it its we you they them i can could should would will shall may might must
    work works working way ways thing things about over under up down off all any each some other same before after during instead also still just only more most
    happens happen break breaks breaking broke broken change changes changed modify modifies edit edits affect affects affected impact impacts refactor rename
    show tell explain describe find look see know need want called calling goes go come comes give gives""".split()
)
# Generic terms, searched at a lower weight.
WEAK_TERMS = set(
    """add delete update fix remove get set support use make flow data layer handle request response return value result config options params args item file files code
    class method function type object name id key list map""".split()
)
# Suffixes that a stem loses, the longest that fits first.
STEM_SUFFIXES = sorted(
    """ational ization isation ations ation ition ings ing ment ness ities ity ance ence able ible ives ive ers er ors or ies es ed ly al ism ist ize ise ful less ion s""".split(),
    key=lambda s: -len(s),
)
# Words that tell what a question asks for.
PLAN_WORDS = {
    "locate": ["where", "find", "locate", "exist", "implement", "defined", "declare", "file", "symbol"],
    "flow": ["how", "flow", "run", "execution", "path", "work", "trace", "call graph", "process", "step"],
    "impact": ["break", "impact", "modify", "change", "depend", "caller", "affect", "refactor", "use"],
}
# Source languages by file extension.
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "java": "java", "html": "html"}

# Words that are no anchors in a flow request.
FLOW_STOPWORDS = set(
    """the a an and or of to in on for with how does do did is are was were be been being flow data across through from into onto between via
    work works working file files use uses used using get gets set sets make makes made why what when where which who this that these those it its we you they them i
    can could should would will shall may might must way ways thing things code about over under out up down off then else so than as at by but if not all any each""".split()
)
# Patterns of test files (coverage), of files that rank low in discovery, and of those that rank low among anchors.
TEST_FILE = r"/tests?/|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.py$"
PERIPHERAL_FILE = r"(^|/)(tests?|__tests__|specs?|fixtures?|mocks?|examples?)/|scratch|[.\-_](test|spec)[.\-_][^/]*$|(^|/)(test|spec)[.\-_][^/]*$"
ANCHOR_PERIPHERAL = r"(^|/)(tests?|scratch)(/|$)|\.(test|spec)\.[a-z]+$|^scratch"


def words(query: str) -> list[str]:
    return [t for t in re.sub(r"[^a-zA-Z0-9_/]", " ", query).split() if len(t) > 1]


def terms(query: str) -> tuple[list[str], list[str]]:
    """(strong, weak) search terms; if nothing specific is left the weak become strong, and failing that all words do."""
    found = words(query)
    kept = [t for t in found if t.lower() not in HARD_STOPWORDS]
    strong = [t for t in kept if t.lower() not in WEAK_TERMS]
    weak = [t.lower() for t in kept if t.lower() in WEAK_TERMS]
    if strong:
        return strong, weak
    return (weak, []) if weak else (found, [])


def stem(token: str) -> str | None:
    """The token without its longest known suffix, if four letters or more are left."""
    return next((token[: -len(s)] for s in STEM_SUFFIXES if token.endswith(s) and len(token) - len(s) >= 4), None)


def prefix_ladder(token: str) -> list[str]:
    """Shorter and shorter prefixes, of five letters at least, of tokens of six or more."""
    n = len(token)
    return [token[:k] for k in dict.fromkeys((n - 2, n - 3, 5)) if 5 <= k < n] if n >= 6 else []


def strategy(query: str) -> str:
    """impact if its words strictly lead, else flow if it leads locate, else locate."""
    low = query.lower()
    n = {k: sum(w in low for w in ws) for k, ws in PLAN_WORDS.items()}
    if n["impact"] > n["flow"] and n["impact"] > n["locate"]:
        return "impact"
    return "flow" if n["flow"] > n["locate"] else "locate"


def strategy_column(text: Column) -> Column:
    """`strategy` over a column of questions."""
    low = F.lower(text)
    n = {k: sum((low.contains(w).cast("int") for w in ws), F.lit(0)) for k, ws in PLAN_WORDS.items()}
    return F.when((n["impact"] > n["flow"]) & (n["impact"] > n["locate"]), "impact").when(n["flow"] > n["locate"], "flow").otherwise("locate")


def token_column(text: Column) -> Column:
    """Words of a column of questions, without the hard stopwords, lowered."""
    parts = F.split(F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9_/]", " ")), " +")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(sorted(HARD_STOPWORDS)))


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike(TEST_FILE)


def is_peripheral(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(PERIPHERAL_FILE)


def is_peripheral_anchor(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(ANCHOR_PERIPHERAL)


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in LANGUAGES.items():
        out = out.when(ext == k, v)
    return out


def kind_key(kind: Column) -> Column:
    """Edge kinds compare without case or plural."""
    return F.regexp_replace(F.lower(kind), "s$", "")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def endpoint_key(method: Column, path: Column) -> Column:
    return F.concat_ws(" ", F.upper(method), path)


def confidence_tag(method: Column) -> Column:
    return F.when(method == "global_fallback", "low").when(method.isNull(), "structural").otherwise("high")


def module_paths(path: str) -> list[str]:
    """Names under which a file can be imported: without extension, dotted, and as a package."""
    base = re.sub(r"\.[^./]+$", "", path)
    out = [base, base.replace("/", ".")]
    if base.endswith(("/__init__", "/index")):
        package = base.rsplit("/", 1)[0]
        out += [package, package.replace("/", ".")]
    return list(dict.fromkeys(out))
