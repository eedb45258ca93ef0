"""Repositories: addresses that may be cloned, changed files, and a profile from file names and contents."""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
import tempfile
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V

# Hosts that may be cloned from.
HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org")
MOST_MB = 100


def checked_url(url: str, hosts: tuple[str, ...] = HOSTS) -> str:
    """A plain https address of an allowed host, without .git and closing slash; ValueError says why another is none."""
    url = (url or "").strip()
    parts = urlparse(url)
    if not url.lower().startswith("https://"):
        raise ValueError("scheme: only https is accepted")
    if "@" in parts.netloc:
        raise ValueError("credentials: none may be in the address")
    if parts.hostname not in hosts:
        raise ValueError(f"host: {parts.hostname} is not allowed")
    if ".." in parts.path:
        raise ValueError("traversal: the path goes up")
    if parts.path in ("", "/"):
        raise ValueError("path: owner and repository are missing")
    return f"https://{parts.hostname}{parts.path}".removesuffix(".git").rstrip("/")


@contextmanager
def cloned(url: str, most_mb: int = MOST_MB):
    """A shallow clone in a temporary folder of the driver, which is always removed; over ``most_mb`` it is an error."""
    url, folder = checked_url(url), tempfile.mkdtemp(prefix="loomgraph-clone-")
    env = os.environ | {"GIT_TERMINAL_PROMPT": "0", "GIT_ASKPASS": "echo", "GIT_CONFIG_NOSYSTEM": "1", "GIT_SSH_COMMAND": "false"}
    try:
        subprocess.run(["git", "clone", "--depth", "1", "--", url, folder], check=True, capture_output=True, env=env, timeout=600)
        size = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if not os.path.islink(os.path.join(at, f)))
        if size > most_mb << 20:
            raise ValueError(f"size: over {most_mb} MB")
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def changed_since(folder: str, last: str | None) -> tuple[list[str], str | None]:
    """Supported files that changed between a commit and the head (both names of a rename), and the head.

    Without a last commit there are none; any failure is no change.
    """
    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", folder, *args], check=True, capture_output=True, text=True, timeout=60).stdout

    try:
        head = git("rev-parse", "HEAD").strip()
        if last is None:
            return [], head
        names = [p for line in git("diff", "--name-status", "-M", last, head).splitlines() for p in line.split("\t")[1:]]
        return sorted({p for p in names if os.path.splitext(p)[1].lower() in V.SUFFIXES}), head
    except (subprocess.SubprocessError, OSError):
        return [], None


def manifest(files: DataFrame) -> DataFrame:
    """(path, digest) of files (path, text)."""
    return files.select("path", F.sha2("text", 256).alias("digest"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): supported files that differ between two manifests."""
    both = old.toDF("path", "a").join(new.toDF("path", "b"), "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.where(T.language_by_suffix(F.col("path")) != "unknown").select("path", change.alias("change"))


def invocations(files: DataFrame) -> DataFrame:
    """(module): modules that READMEs and scripts at the root run by ``python -m``."""
    low = F.lower("path")
    told = ~F.col("path").contains("/") & (low.isin("readme.md", "readme.txt", "readme.rst", "readme") | low.endswith(".sh") | low.endswith(".bat") | low.endswith(".ps1"))
    found = F.regexp_extract_all("text", F.lit(r"\bpython(?:\d+(?:\.\d+)?)?\s+-m\s+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))
    return files.where(told).select(F.explode(found).alias("m")).select(F.regexp_replace("m", r"\.+$", "").alias("module")).where("module <> ''").distinct()


def entry_points(files: DataFrame, most: int = 10) -> DataFrame:
    """(module, path, score): run modules that exist, at 200; where there are none, Python files of 40 points and more."""
    run = invocations(files)
    there = files.select("path").where(F.col("path").endswith(".py"))
    path = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    plain = run.select("module", F.concat(path, F.lit(".py")).alias("path"), F.lit(0).alias("k")).union(run.select("module", F.concat(path, F.lit("/__main__.py")), F.lit(1)))
    known = plain.join(there, "path", "left_semi").groupBy("module").agg(F.min_by("path", "k").alias("path"))
    if not known.isEmpty():
        return known.orderBy("path").limit(most).select("module", "path", F.lit(200).alias("score"))
    py = files.where(F.col("path").endswith(".py") & ~F.col("path").rlike(r"(^|/)(\.[^/]*|venv|__pycache__|node_modules)/"))
    name, stem = T.file_name(F.col("path")), F.lower(F.regexp_extract("path", r"([^/]*)\.py$", 1))
    points = lambda ok, n: F.when(F.coalesce(ok, F.lit(False)), n).otherwise(0)
    text = F.col("text")
    guarded = text.contains("__main__")
    score = (
        points(name.isin("main.py", "__main__.py"), 35) + points(stem.isin("main", "ml_main", "train", "run", "start", "cli"), 25)
        + points(F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(*map(F.lit, ("training", "train", "pipeline")))), 10) - points(stem.isin(*V.NO_ENTRY_STEMS), 80)
        + points(text.contains("if __name__") & guarded, 35) + points(text.contains("argparse.ArgumentParser") & text.contains("parse_args"), 25)
        + points(text.rlike(r"\bdef\s+main\s*\("), 20) + points(guarded & text.rlike(r"\bmain\s*\(\s*\)"), 20)
    )
    return py.select(T.path_to_module(F.col("path")).alias("module"), "path", score.alias("score")).where("score >= 40").orderBy(F.desc("score"), "path").limit(most)


def domain(words: str) -> str:
    """The domain of which most keywords occur; the first of equals, ``general`` without any."""
    best = max(V.DOMAINS, key=lambda d: sum(k in words for k in d[1]))
    return best[0] if any(k in words for k in best[1]) else "general"


def profile(files: DataFrame) -> dict:
    """A repository's profile from its files (path, text): type, domain, architecture, stack, purpose, entries."""
    root = {r["path"]: r["text"] or "" for r in files.where(F.col("path").isin("requirements.txt", "package.json", "README.md", "README.txt", "README.rst", "README")).collect()}  # six names
    folders = [r[0] for r in files.where(F.col("path").contains("/")).select(F.split("path", "/")[0].alias("d")).where(~F.col("d").startswith(".")).distinct().orderBy("d").limit(1000).collect()]
    kind, field, stack = "unknown", "general", []
    if "requirements.txt" in root:
        low = root["requirements.txt"].lower()
        stack.append("Python")
        web = next((n for n in ("FastAPI", "Flask", "Django") if n.lower() in low), None)
        if web:
            kind, stack = "web_api", [*stack, web]
        elif "click" in low or "argparse" in low:
            kind = "cli_tool"
        elif any(n in low for n in ("scikit-learn", "tensorflow", "pytorch")):
            kind, field = "ml_model", "machine_learning"
        stack += [n for n in ("NetworkX", "Pydantic") if n.lower() in low]
    if "package.json" in root:
        stack.append("JavaScript/Node.js")
        try:
            package = json.loads(root["package.json"])
            deps = {**package.get("dependencies", {}), **package.get("devDependencies", {})}
        except (ValueError, AttributeError, TypeError):
            deps = {}
        stack += [n for n in ("React", "Vue", "Express") if n.lower() in deps]
        kind = "web_api" if "express" in deps else kind
    style = "unknown"
    for needed, name in ((("app",), "modular_pipeline"), (("src",), "modular_pipeline"), (("api", "services"), "microservices"), (("models", "views", "controllers"), "mvc"), (("backend", "frontend"), "layered")):
        style = name if all(n in folders for n in needed) else style
    readme = next((root[n] for n in ("README.md", "README.txt", "README.rst", "README") if n in root), "")
    purpose = next((line.strip()[:200] for line in readme.split("\n") if line.strip() and not line.startswith("#")), "")
    words = " ".join(folders).lower() + " " + purpose.lower()
    found = domain(words)
    return {
        "project_type": kind, "domain": found if found != "general" else field, "architecture": style, "tech_stack": stack, "purpose": purpose or f"A {kind} project",
        "key_entry_points": [r["module"] for r in entry_points(files).collect()], "critical_modules": folders[:5], "confidence": 0.5, "fallback_used": True,
    }


def repo_id(path: str, custom: str | None = None) -> str:
    import hashlib

    return custom or hashlib.sha256(path.encode()).hexdigest()[:12]


def salvage_json(text: str, fallback: dict) -> dict:
    """The JSON object from a text's first brace to its last, else ``fallback``."""
    m = re.search(r"\{.*\}", text or "", re.S)
    try:
        return json.loads(m[0]) if m else fallback
    except ValueError:
        return fallback
