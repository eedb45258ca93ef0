"""Scalar text functions as Columns: tokens, classifiers, heuristics, path and url rules."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def has_any(s: Column, words) -> Column:
    """Whether ``s`` holds one of the words; a null holds none."""
    return F.coalesce(reduce(or_, [s.contains(w) for w in words]), F.lit(False))


def first_match(s: Column, rules, default: str | None) -> Column:
    """The label of the first (label, words) rule of which ``s`` holds a word."""
    out = F.lit(default)
    for label, words in reversed(rules):
        out = F.when(has_any(s, words), F.lit(label)).otherwise(out)
    return out


def first_like(s: Column, rules, default: str | None) -> Column:
    """The label of the first (label, pattern) rule that matches within ``s``."""
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(s.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def tokens(s: Column) -> Column:
    """Identifier tokens: a letter and what follows in lower case or digits, or a number; lower-cased, over one character."""
    found = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit("[A-Za-z][a-z0-9]*|[0-9]+"), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda x: F.length(x) > 1)


def normalized(s: Column) -> Column:
    """Lower case, punctuation to spaces (letters of any script stay), spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def terms(s: Column) -> Column:
    """Terms of a query: over two characters, no stop words, in order."""
    return F.filter(F.split(normalized(s), " "), lambda x: (F.length(x) > 2) & ~x.isin(*V.STOP))


def language_by_suffix(path: Column, also: dict[str, str] | None = None) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    out = F.lit("unknown")
    for key, name in (V.SUFFIXES | (also or {})).items():
        out = F.when(suffix == key, F.lit(name)).otherwise(out)
    return out


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_test_path(path: Column) -> Column:
    """Entry logic: such files are never entries."""
    name = file_name(path)
    return name.startswith("test_") | name.endswith("_test.py") | path.rlike(r"(^|/)(tests|test|spec|__tests__)/")


def is_test_flow(path: Column) -> Column:
    """Flow logic: modules whose files are mostly such stay out of the flow."""
    return path.rlike(r"(^|/)(tests?|__tests__|spec)(/|$)|(^|/)test_|_test\.")


def top_directory(path: Column) -> Column:
    """The first two parts of a path, or the first where there are at most two."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.element_at(parts, 1))


def directory(path: Column) -> Column:
    """The folder of a file; a file at the root stands for itself."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(path)


def entry_to_path(entry: Column) -> Column:
    """The file of a declared entry point: a path, a path without suffix, or a dotted module."""
    e = F.replace(F.trim(entry), F.lit("\\"), F.lit("/"))
    last = file_name(e)
    dotted = F.concat(F.replace(e, F.lit("."), F.lit("/")), F.lit(".py"))
    return F.when((e == "") | e.endswith(".py"), e).when(e.contains("/"), F.when(last.contains("."), e).otherwise(F.concat(e, F.lit(".py")))).otherwise(dotted)


def path_to_module(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))


def doc_type(path: Column) -> Column:
    """By name, then by path; ``doc`` otherwise."""
    low = F.lower(path)
    out = first_like(low, V.DOC_PATHS, "doc")
    name = file_name(low)
    for begin, label in reversed(V.DOC_NAMES):
        out = F.when(name.startswith(begin), label).otherwise(out)
    return out


def url_error(url: Column, hosts: tuple[str, ...] = ("example.com", "example.net", "example.org")) -> Column:
    """null for a url that may be fetched, else why not: scheme, credentials, host (or no subdomain of one), traversal, path."""
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)
    bare = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return F.when(~url.startswith("https://"), "scheme").when(host.contains("@"), "credentials").when(~bare.isin(*hosts), "host").when(path.contains(".."), "traversal").when(path.isin("", "/"), "path")


def risk(reach: Column, criticality: Column | None = None, kind: Column | None = None) -> Column:
    """By how much is downstream, how critical the node is, and whether it is an API or uses a database."""
    level, kind = criticality if criticality is not None else F.lit("medium"), kind if kind is not None else F.lit("CALLS")
    is_ = lambda x: F.coalesce(level == x, F.lit(False))
    worst = (reach > 30) | is_("critical") | F.coalesce(kind.isin("EXPOSES_API", "USES_DB"), F.lit(False))
    return F.when(worst, "critical").when((reach > 10) | is_("high"), "high").when((reach > 3) | is_("medium"), "medium").otherwise("low")


def complexity(lines: Column) -> Column:
    return F.when(lines < 20, "low").when(lines < 50, "medium").when(lines < 100, "high").otherwise("very_high")


def intent(name: Column) -> Column:
    """The first keyword group that a name matches."""
    return first_match(F.lower(name), V.INTENTS, "unknown")


def criticality(name: Column) -> Column:
    return first_match(F.lower(name), [("high", V.CRITICAL_WORDS), ("low", V.MINOR_WORDS)], "medium")


def side_effects(code: Column) -> Column:
    low = F.lower(code)
    found = F.array_compact(F.array(*[F.when(has_any(low, words), F.lit(label)) for label, words in V.SIDE_EFFECTS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))


def code_patterns(code: Column) -> Column:
    rules = (("generator", code.contains("yield ")), ("async", code.contains("async ") | code.contains("await ")), ("decorator", code.contains("@") & code.contains("def ")))
    return F.array_compact(F.array(*[F.when(rule, F.lit(label)) for label, rule in rules]))


def semantic_kind(name: Column, code: Column, decorators: Column) -> Column:
    """API by decorators (a string, joined by spaces), then database and events by code, then consumers by name."""
    low, body, dec = F.lower(name), F.lower(code), F.lower(F.coalesce(decorators, F.lit("")))
    api = has_any(dec, V.API_DECORATORS) | has_any(F.concat(F.lit(" "), dec), [" " + p for p in V.API_PREFIXES])
    begins = reduce(or_, [low.startswith(p) for p in V.CONSUMER_STARTS])
    ends = reduce(or_, [low.endswith(p) for p in V.CONSUMER_ENDS])
    consumer = has_any(dec, V.CONSUMER_DECORATORS) | F.coalesce(begins | ends, F.lit(False))
    return F.when(api, "EXPOSES_API").when(has_any(body, V.DB_CODE), "USES_DB").when(has_any(body, V.EMIT_CODE), "EMITS_EVENT").when(consumer, "CONSUMES_EVENT").otherwise("CALLS")


def one_liner(name: Column, kind: Column) -> Column:
    """A sentence from a name: its parts, the first as a verb; at most 120 characters."""
    clean = F.regexp_replace(name, "^(test_|_)", "")
    parts = F.filter(F.split(F.regexp_replace(clean, "([a-z])([A-Z])", "$1 $2"), r"[_.\s]"), lambda p: p != "")
    first = F.concat(F.upper(F.substring(parts[0], 1, 1)), F.lower(F.substring(parts[0], 2, 1 << 20)))
    table = F.create_map(*[F.lit(x) for pair in V.VERBS.items() for x in pair])
    verb = F.coalesce(F.try_element_at(table, first), F.when(first.endswith("s"), first).otherwise(F.concat(first, F.lit("s"))))
    rest = F.lower(F.array_join(F.slice(parts, 2, 1 << 20), " "))
    text = F.concat(verb, F.lit(" "), F.when(rest != "", rest).otherwise(kind), F.lit("."))
    bare = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 1 << 20)), F.lit(" "), name, F.lit("."))
    return F.when(F.size(parts) > 0, F.substring(text, 1, 120)).otherwise(bare)


def is_code_symbol(kind: Column, type_: Column) -> Column:
    return F.coalesce(kind.isin("function", "callable", "type"), F.lit(False)) | F.coalesce(type_.isin("function", "method", "class"), F.lit(False))


def is_callable(kind: Column, type_: Column) -> Column:
    return F.coalesce(kind.isin("function", "callable"), F.lit(False)) | F.coalesce(type_.isin("function", "method"), F.lit(False))


def is_invocation(relationship: Column, type_: Column) -> Column:
    return F.coalesce(relationship == "INVOKES", F.lit(False)) | F.coalesce(type_ == "CALLS", F.lit(False))


def is_import(relationship: Column, type_: Column) -> Column:
    return F.coalesce(relationship == "DEPENDS_ON", F.lit(False)) | F.coalesce(type_ == "IMPORTS", F.lit(False))


def is_stub(summary: Column, source: Column) -> Column:
    """Whether a summary is absent, a stub, or a heuristic one."""
    return (F.coalesce(summary, F.lit("")) == "") | F.coalesce(summary.startswith("(stub)"), F.lit(False)) | F.coalesce(source == "heuristic", F.lit(False))


def is_trivial(name: Column, code: Column) -> Column:
    """Dunders but __init__, at most six lines that aren't blank, or under 160 characters."""
    n, c = F.coalesce(name, F.lit("")), F.coalesce(code, F.lit(""))
    dunder = n.startswith("__") & n.endswith("__") & (n != "__init__")
    return dunder | (F.size(F.filter(F.split(c, r"\r?\n"), lambda x: F.trim(x) != "")) <= 6) | (F.length(c) < 160)


def provenance(adapter: Column, confidence: Column, callee: Column) -> tuple[Column, Column]:
    """Source and confidence of an edge: its adapter's, but a resolved call has its own and any other call site 0.9."""
    table = F.create_map(*[F.lit(x) for k, (s, _) in V.PROVENANCE.items() for x in (k, s)])
    level = F.create_map(*[F.lit(x) for k, (_, c) in V.PROVENANCE.items() for x in (k, c)])
    source = F.coalesce(F.try_element_at(table, F.coalesce(adapter, F.lit(""))), F.lit("regex"))
    base = F.coalesce(F.try_element_at(level, F.coalesce(adapter, F.lit(""))), F.lit(0.7))
    return source, F.coalesce(confidence, F.when((adapter == "python_ast") & (F.coalesce(callee, F.lit("")) != ""), F.lit(0.9)), base)


def semantic_provenance(inferred_by: Column) -> Column:
    return F.when(inferred_by == "bob", "llm").when(inferred_by == "heuristic", "heuristic").otherwise("ast")


def raised(level: Column, accesses: Column, relevance: Column) -> Column:
    """A criticality one level up after over ten accesses at a relevance over 0.7."""
    up = F.create_map(*[F.lit(x) for pair in zip(V.CRITICALITY, V.CRITICALITY[1:]) for x in pair])
    return F.when((accesses > 10) & (relevance > 0.7), F.coalesce(F.try_element_at(up, level), level)).otherwise(level)


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%.0f%%", (100.0 * part / total).cast("double"))).otherwise("0%")


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def rating(value: Column) -> Column:
    return F.when(value >= 4, "helpful").when(value <= 2, "unhelpful").otherwise("neutral")


def role(path: Column) -> Column:
    return first_like(F.lower(path), V.ROLES, None)


def domain(words: Column) -> Column:
    """The domain of which most keywords are in a text, the first of equals; ``general`` without any."""
    scored = [F.struct(sum((F.when(words.contains(k), 1).otherwise(0) for k in keys), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("d")) for i, (name, keys) in enumerate(V.DOMAINS)]
    best = F.greatest(*scored)
    return F.when(best["n"] > 0, best["d"]).otherwise("general")


def step_kind(intent: Column, kind: Column) -> Column:
    """What an execution step is: stored or fetched data count as database use, whatever its kind says."""
    return F.when(intent.isin("persistence", "retrieval"), "USES_DB").otherwise(kind)


def border(complexity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in V.BORDERS.items() for x in pair]), complexity), F.lit(1.0))


def glow(ratio: Column) -> tuple[Column, Column]:
    """Blur and opacity of a central node's glow; null under 0.18."""
    seen = ratio >= 0.18
    return F.when(seen, F.round(5 + ratio * 16, 0)), F.when(seen, F.round(0.2 + ratio * 0.4, 2))


def mermaid_id(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9_]", "_")
