"""Summaries and semantics of functions: rules for most, batches to a provider for the rest, its answers cached.

Only the deterministic provider runs without a network; others send one request through ``send``.
"""

from __future__ import annotations

import ast
import hashlib
import json
import os
import re
import textwrap
import urllib.request
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..functions import vocabulary as V
from ..session import ship
from ..sources.repo import salvage_json

BATCH, STUB = 10, "(stub)"
ERRORS = ("[llm error:", "[ollama error:", "[bob error:", "[openai error:", "[claude error:", "[llm unavailable")
# Calls that say nothing about what a function does.
COMMON_CALLS = (
    "print", "len", "str", "int", "float", "bool", "list", "dict", "set", "isinstance", "hasattr", "getattr", "setattr",
    "range", "enumerate", "zip", "map", "filter", "sorted", "reversed", "super", "type", "append", "extend", "update",
    "get", "items", "values", "keys", "lower", "upper", "strip", "split", "join", "format", "encode", "decode", "open",
    "close", "read", "write", "logger", "log",
)


def one_liner(name: str, kind: str = "function") -> str:
    """As ``text.one_liner``, for code that runs in Python anyway."""
    parts = [p for p in re.split(r"[_.\s]", re.sub(r"([a-z])([A-Z])", r"\1 \2", re.sub(r"^(test_|_)", "", name))) if p]
    if not parts:
        return f"{kind.capitalize()} {name}."
    first = parts[0].capitalize()
    verb = V.VERBS.get(first, first if first.endswith("s") else first + "s")
    return f"{verb} {' '.join(parts[1:]).lower() or kind}."[:120]


def describe(name: str, code: str | None, kind: str = "function") -> str:
    """The docstring's first sentence; else the name's sentence with what the code shows; else that sentence alone."""
    base = one_liner(name, kind)
    try:
        tree = ast.parse(textwrap.dedent(code or ""))
    except (SyntaxError, ValueError):
        return base
    if not (code or "").strip():
        return base
    first = next((n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))), None)
    doc = ast.get_docstring(first) if first is not None else None
    if doc:
        sentence = re.split(r"(?<=[.!?])\s+|\n", doc.strip())[0].strip()
        if len(sentence) > 10:
            return (sentence if sentence[-1] in ".!?" else sentence + ".")[:200]
    function = next((n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), None)
    returns = ast.unparse(function.returns) if function is not None and function.returns else ""
    names = dict.fromkeys(ast.unparse(c.func).split(".")[-1] for c in ast.walk(tree) if isinstance(c, ast.Call))
    used = [n for n in names if n not in COMMON_CALLS and not n.startswith("_")][:3]
    has = lambda *kinds: any(isinstance(n, kinds) for n in ast.walk(tree))
    more = ["async"] * isinstance(function, ast.AsyncFunctionDef)
    more += ["yields results lazily"] if has(ast.Yield, ast.YieldFrom) else [f"returns {returns}"] if returns not in ("", "None", "bool", "Any") else []
    more += ["using " + ", ".join(used)] * bool(used) + ["raises on invalid input"] * has(ast.Raise)
    return f"{base.rstrip('.')} ({'; '.join(more)})."[:200] if more else base.rstrip(".") + "."


@dataclass
class Provider:
    """What answers prompts. ``call`` may fail; its answer is then a stub and is not cached."""

    name: str = "heuristic"
    model: str = ""

    def call(self, prompt: str) -> str:
        return f"{STUB} {(prompt.strip().splitlines() or [''])[0][:120]}"

    @property
    def real(self) -> bool:
        return self.name != "heuristic"

    @property
    def namespace(self) -> str:
        return f"{self.name}:{self.model}"

    def ask(self, prompt: str) -> str:
        try:
            return self.call(prompt)
        except Exception as e:  # noqa: BLE001  any failure of a backend is an unavailable answer
            return f"[llm error: {e}]"

    def analyze_batch(self, items: list[dict]) -> list[dict]:
        """Summary and semantics of each item (id, name, code, kind): answers by id, else by place, else the rules' own."""
        own = [{"id": i["id"], "summary": describe(i["name"], i["code"], i["kind"]), "source": "heuristic"} for i in items]
        if not self.real:
            return own
        got = salvage_json(self.ask(batch_prompt(items)), {}).get("functions", [])
        by_id = {str(g.get("id")): g for g in got if isinstance(g, dict)}
        out = []
        for k, (item, mine) in enumerate(zip(items, own)):
            g = by_id.get(item["id"]) or (got[k] if k < len(got) and isinstance(got[k], dict) and "id" not in got[k] else {})
            out.append({"id": item["id"], "summary": g["summary"], "source": "llm"} if g.get("summary") else mine)
        return out


def batch_prompt(items: list[dict]) -> str:
    return "Summarize each function in one sentence. Answer with JSON {\"functions\": [{\"id\", \"summary\"}]}.\n" + json.dumps([{k: i[k] for k in ("id", "name", "code")} for i in items])


#: Requests of each kind of backend: path, headers, body, where the answer is, tokens, seconds.
_KINDS: dict[str, tuple] = {
    "local": ("/api/generate", lambda k: {}, lambda m, p, n: {"model": m, "prompt": p, "stream": False, "options": {"temperature": 0.2, "num_predict": n}}, ("response",), 2048, 300),
    "watsonx": ("", lambda k: {"Authorization": f"Bearer {k}"}, lambda m, p, n: {"model_id": m, "input": p, "parameters": {"max_new_tokens": n}}, ("results", 0, "generated_text"), 400, 30),
    "anthropic": ("/v1/messages", lambda k: {"x-api-key": k, "anthropic-version": "2023-06-01"}, lambda m, p, n: {"model": m, "max_tokens": n, "messages": [{"role": "user", "content": p}]}, ("content", 0, "text"), 512, 30),
    "openai": ("/chat/completions", lambda k: {"Authorization": f"Bearer {k}"}, lambda m, p, n: {"model": m, "max_tokens": n, "messages": [{"role": "user", "content": p}]}, ("choices", 0, "message", "content"), 512, 30),
}


def _post(url: str, headers: dict, body: dict, seconds: int) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=seconds) as answer:  # noqa: S310  the address is the operator's own setting
        return json.load(answer)


@dataclass
class HttpProvider(Provider):
    """A backend reached by one JSON request; ``kind`` is a key of the table above."""

    kind: str = "openai"
    url: str = ""
    key: str = ""
    send: Callable = field(default=_post, repr=False)

    def call(self, prompt: str) -> str:
        path, headers, body, where, tokens, seconds = _KINDS[self.kind]
        out = self.send(self.url.rstrip("/") + path, headers(self.key), body(self.model, prompt, tokens), seconds)
        for step in where:
            out = out[step]
        return out


_OVERRIDE: list[Provider] = []


@contextmanager
def override(provider: Provider):
    _OVERRIDE.append(provider)
    try:
        yield provider
    finally:
        _OVERRIDE.pop()


def choose(spec: dict | None = None, env: dict | None = None) -> Provider:
    """An override, else a request's own spec (provider, url, key, model), else the environment's, else the rules."""
    env = os.environ if env is None else env
    if _OVERRIDE:
        return _OVERRIDE[-1]
    spec = spec or {"provider": env.get("LOOMGRAPH_PROVIDER", ""), "url": env.get("LOOMGRAPH_PROVIDER_URL", ""), "key": env.get("LOOMGRAPH_PROVIDER_KEY", ""), "model": env.get("LOOMGRAPH_PROVIDER_MODEL", "")}
    kind = spec.get("provider") or ""
    if kind in _KINDS and spec.get("url"):
        return HttpProvider(kind, spec.get("model", ""), kind, spec["url"], spec.get("key", ""))
    return Provider()


def is_stub(answer: str | None) -> bool:
    return not answer or answer.startswith(STUB) or any(e in answer for e in ERRORS)


def cache_key(namespace: str, prompt: str) -> str:
    return hashlib.sha256(f"{namespace}\n{prompt}".encode()).hexdigest()[:32]


def answered(prompts: DataFrame, cache: DataFrame | None, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """(prompt, answer) of prompts, and the rows (key, answer) that the cache lacked; stubs and errors are never cached.

    A cached stub counts as a miss. Each partition asks for its own distinct misses.
    """
    key = F.substring(F.sha2(F.concat(F.lit(provider.namespace + "\n"), "prompt"), 256), 1, 32)
    asked = prompts.select("prompt").distinct().withColumn("key", key)
    good = lambda c: ~(c.startswith(STUB) | T.has_any(c, ERRORS) | (c == ""))
    known = None if cache is None else cache.where(good(F.col("answer"))).groupBy("key").agg(F.min("answer").alias("answer"))
    missing = asked if known is None else asked.join(known.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=[provider.ask(p) for p in batch["prompt"]])[["prompt", "key", "answer"]]

    ship(prompts.sparkSession)
    new = missing.select("prompt", "key").mapInPandas(run, "prompt string, key string, answer string")
    old = asked.limit(0).select("prompt", F.lit("").alias("answer")) if known is None else asked.join(known, "key").select("prompt", "answer")
    return old.union(new.select("prompt", "answer")), new.where(good(F.col("answer"))).select("key", "answer")


def semantics(nodes: DataFrame) -> DataFrame:
    """``nodes`` (name, code) with intent, complexity, criticality, patterns, side_effects and confidence by rules."""
    name, code = F.coalesce("name", F.lit("")), F.coalesce("code", F.lit(""))
    return nodes.withColumns({
        "intent": T.intent(name), "complexity": T.complexity(F.size(F.split(code, "\n"))), "criticality": T.criticality(name), "patterns": T.code_patterns(code), "side_effects": T.side_effects(code), "confidence": F.lit(0.4),
    })


def enrich(nodes: DataFrame, provider: Provider | None = None) -> DataFrame:
    """(id, name, summary, summary_source, intent, ... confidence) of callables with code; a real summary is never overwritten.

    ``nodes``: id, name, kind, type, code, summary, summary_source. Trivial functions, and all without a real provider, are
    described by rules; the rest go in batches of ten.
    """
    provider = provider or Provider()
    ship(nodes.sparkSession)
    rows = nodes.where(T.is_callable(F.col("kind"), F.col("type")) & (F.coalesce("code", F.lit("")) != ""))
    rows = rows.withColumns({"_kind": F.coalesce("kind", "type", F.lit("function")), "_ask": F.lit(provider.real) & ~T.is_trivial(F.col("name"), F.col("code"))})
    rules = Provider()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ask = batch["_ask"].to_pylist()
            items = [dict(zip(("id", "name", "code", "kind"), x)) for x in zip(*[batch[c].to_pylist() for c in ("id", "name", "code", "_kind")])]
            said: list[dict] = [{}] * len(items)
            for who, mine in ((provider, [k for k, a in enumerate(ask) if a]), (rules, [k for k, a in enumerate(ask) if not a])):
                for k in range(0, len(mine), BATCH):
                    part = mine[k : k + BATCH]
                    for at, answer in zip(part, who.analyze_batch([items[i] for i in part])):
                        said[at] = answer
            for name, key in (("_said", "summary"), ("_by", "source")):
                batch = batch.append_column(name, pa.array([a[key] for a in said], pa.string()))
            yield batch

    out = semantics(rows)
    told = StructType([*out.schema.fields, StructField("_said", StringType()), StructField("_by", StringType())])  # answers stay in their rows: no join by id
    out = out.mapInArrow(run, told)
    stub = T.is_stub(F.col("summary"), F.col("summary_source"))
    out = out.withColumn("summary_source", F.when(stub, F.col("_by")).otherwise(F.col("summary_source"))).withColumn("summary", F.when(stub, F.col("_said")).otherwise(F.col("summary")))
    return out.drop("_said", "_by", "_ask", "_kind")


def valid_semantics(rows: DataFrame) -> DataFrame:
    """Rows whose enumerated values are unknown get the defaults, and confidence 0."""
    bad = ~F.coalesce(F.col("complexity").isin(*V.COMPLEXITY) & F.col("criticality").isin(*V.CRITICALITY) & F.col("intent").isin("unknown", *[i for i, _ in V.INTENTS]) & F.col("confidence").between(0, 1), F.lit(False))
    keep = lambda c, default: F.when(bad, default).otherwise(F.col(c)).alias(c)
    rest = [c for c in rows.columns if c not in ("intent", "complexity", "criticality", "confidence")]
    return rows.select(*rest, keep("intent", "unknown"), keep("complexity", "medium"), keep("criticality", "medium"), keep("confidence", 0.0))


def ingestion_rows(nodes: DataFrame, members: DataFrame, modules: DataFrame, edges: DataFrame, near: int = 10, chars: int = 600) -> DataFrame:
    """One row per node for a model's ingestion: module, ``near`` callees and callers, the first ``chars`` of its code, and the
    fallback role, responsibilities and confidence."""
    from . import graph as G

    def side(mine: str, other: str, name: str) -> DataFrame:
        top = G.top_per(edges.select(mine, other).distinct(), near, [mine], other)
        return top.groupBy(F.col(mine).alias("id")).agg(F.array_sort(F.collect_list(other)).alias(name))

    own = members.select("id", "module").join(modules.select("module", F.col("name").alias("module_name")), "module")
    out = nodes.join(own, "id", "left").join(side("src", "dst", "outgoing_calls"), "id", "left").join(side("dst", "src", "incoming_calls"), "id", "left")
    none = F.array().cast("array<string>")
    summary = F.coalesce("summary", F.lit(""))
    return out.select(
        F.col("id").alias("node_id"), "name", F.col("file").alias("file_path"), F.col("type").alias("node_type"), F.col("module").alias("module_id"), "module_name", summary.alias("summary"),
        F.coalesce("outgoing_calls", none).alias("outgoing_calls"), F.coalesce("incoming_calls", none).alias("incoming_calls"), F.substring(F.coalesce("code", F.lit("")), 1, chars).alias("code_snippet"),
        F.coalesce("intent", F.lit("")).alias("role"), F.when(summary != "", F.array(summary)).otherwise(none).alias("responsibilities"), F.when(F.coalesce("intent", F.lit("")) != "", F.lit(0.4)).otherwise(F.lit(0.2)).alias("confidence"),
    )


def ground_truth(nodes: DataFrame, members: DataFrame, modules: DataFrame, most: int = 30) -> DataFrame:
    """(module, name, members as JSON): the first ``most`` members of each module."""
    from . import graph as G

    top = G.top_per(members.select("module", "id"), most, ["module"], "id").join(nodes.select("id", "name", "type", "file"), "id")
    rows = top.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("id", "name", "type", "file"))).alias("m"))
    return rows.join(modules.select("module", "name"), "module").select("module", "name", F.to_json("m").alias("members"))
