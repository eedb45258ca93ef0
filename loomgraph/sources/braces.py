"""Symbols of brace languages from tokens: strings and comments are taken out before anything is looked for.

A text becomes tokens (names, punctuation, strings, preprocessor lines) with their lines, and each opening bracket its closing
one. One walk over the tokens then names imports, classes and functions by what stands before and after a bracket; what a
body calls are its names before a parenthesis.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.vocabulary import KEYWORDS

_TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<line>^[ \t]*\#[^\n]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<arrow>=>)|(?P<scope>::)|(?P<mark>[^\s\w])""",
    re.S | re.M,
)
_PAIRS = {"(": ")", "{": "}", "[": "]"}
#: Words that open a class, and those that may stand before a function's name without being its type, by language.
CLASS_WORDS = {"javascript": {"class"}, "typescript": {"class"}, "java": {"class", "interface", "enum", "record"}, "c": set(), "cpp": {"class", "struct"}}
SCRIPTS = ("javascript", "typescript")
BEFORE_TYPES = {"new", "return", "else", "throw", "case", "goto"}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    close: int = -1  # the token that closes this bracket


def tokens(text: str) -> list[Token]:
    """What a text is made of; the bracket of a missing closing one stays without it."""
    out: list[Token] = []
    line, at = 1, 0
    open_: list[int] = []
    for m in _TOKEN.finditer(text):
        line, at = line + text.count("\n", at, m.start()), m.start()
        if m.lastgroup == "skip":
            continue
        token = Token(m.lastgroup, m[0], line)
        if token.text in _PAIRS and token.kind == "mark":
            open_.append(len(out))
        elif token.kind == "mark" and token.text in _PAIRS.values():
            while open_ and _PAIRS[out[open_[-1]].text] != token.text:  # what was never closed
                open_.pop()
            if open_:
                out[open_.pop()].close = len(out)
        out.append(token)
    return out


def calls(body: list[Token], own: str) -> list[str]:
    """Names before a parenthesis in order, each once, but for keywords and the function's own."""
    named = (a.text for a, b in zip(body, body[1:]) if a.kind == "name" and b.text == "(")
    return [n for n in dict.fromkeys(named) if n not in KEYWORDS and n != own]


class Reader:
    """The rows of one file; ``at`` walks over its tokens."""

    def __init__(self, path: str, text: str, language: str) -> None:
        self.path, self.language, self.script = path, language, language in SCRIPTS
        self.lines, self.tokens = text.splitlines(), tokens(text)
        self.rows: list[dict] = [{"row": "node", "id": f"{path}::<file>", "name": path.rsplit("/", 1)[-1], "kind": "file", "type": "file", "line": 1}]

    def text(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def is_name(self, k: int) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].kind == "name"

    def dotted(self, k: int, marks: tuple[str, ...] = (".",)) -> tuple[str, int]:
        """The name at ``k`` with what is joined to it, and the token after it."""
        out = ""
        while self.is_name(k) or out and self.text(k) == "*":
            out, k = out + self.text(k), k + 1
            if self.text(k) not in marks:
                break
            out, k = out + self.text(k), k + 1
        return out, k

    def body(self, k: int, header: int) -> int:
        """The brace that opens a body at ``k`` or after, before a semicolon; -1 if there is none within ``header`` tokens."""
        for j in range(k, min(k + header, len(self.tokens))):
            if self.text(j) in ("{", ";"):
                return j if self.text(j) == "{" else -1
        return -1

    def last_line(self, brace: int, line: int) -> int:
        close = self.tokens[brace].close if brace >= 0 else -1
        return self.tokens[close].line if close >= 0 else min(line + 1, max(len(self.lines), line))

    def imported(self, target: str, line: int, how: str = "static_import") -> None:
        self.rows.append({"row": "import", "id": f"{self.path}::<file>", "name": target, "target": target, "relation": "DEPENDS_ON", "receiver": how, "line": line})

    def imports(self, k: int) -> bool:
        token = self.tokens[k]
        if token.kind == "line" and self.language in ("c", "cpp"):
            if m := re.match(r"\s*#\s*include\s*[<\"]([^>\"]+)", token.text):
                self.imported(m[1], token.line, "include")
            return True
        if token.kind != "name":
            return False
        if self.script and token.text == "require" and self.text(k + 1) == "(" and k + 2 < len(self.tokens) and self.tokens[k + 2].kind == "string":
            self.imported(self.text(k + 2).strip("'\"`"), token.line)
        elif self.script and token.text == "import":
            for j in range(k + 1, len(self.tokens)):
                if self.tokens[j].kind == "string":
                    self.imported(self.text(j).strip("'\"`"), token.line)
                if self.tokens[j].kind == "string" or self.text(j) in (";", "("):
                    break
        elif self.language == "java" and token.text == "import":
            target, _ = self.dotted(k + 1 + (self.text(k + 1) == "static"))
            self.imported(target, token.line)
        return False

    def a_class(self, k: int) -> tuple[str, int] | None:
        """The class that begins at ``k``: its name and the brace of its body (-1 without one), or None."""
        if self.text(k) not in CLASS_WORDS[self.language] or not self.is_name(k) or not self.is_name(k + 1) or self.text(k - 1) in (".", "<", ",", "enum"):
            return None
        name, line, base = self.text(k + 1), self.tokens[k].line, ""
        brace = self.body(k + 2, 200)
        angles = 0  # a bound of a type parameter is no base
        for j in range(k + 2, brace if brace >= 0 else k + 2):
            angles += (self.text(j) == "<") - (self.text(j) == ">")
            if angles:
                continue
            if self.language != "cpp" and self.text(j) == "extends":
                base, _ = self.dotted(j + 1)
                break
            if self.language == "cpp" and self.text(j) in ("public", "private", "protected"):
                base, _ = self.dotted(j + 1, ("::",))
                break
        me, end = f"{self.path}::{name}", self.last_line(brace, line)
        self.rows.append({"row": "node", "id": me, "name": name, "kind": "type", "type": "class", "line": line, "end_line": end, "bases": base, "code": "\n".join(self.lines[line - 1 : end])})
        self.rows.append({"row": "edge", "id": f"{self.path}::<file>", "target": me, "relation": "CONTAINS", "line": line})
        if base:
            self.rows.append({"row": "edge", "id": me, "target": base, "relation": "EXTENDS", "line": line})
        return name, brace

    def a_function(self, k: int, owner: str) -> tuple[str, int] | None:
        """The function whose name is at ``k``: its name (with ``Owner::``) and the brace of its body, or None."""
        if not self.is_name(k) or self.text(k) in KEYWORDS:
            return None
        if self.script:
            return self._script_function(k, owner)
        before = self.text(k - 1)
        if self.text(k + 1) != "(" or self.tokens[k + 1].close < 0:
            return None
        name = self.text(k)
        if before == "::" and self.language == "cpp" and self.is_name(k - 2):
            name, before = f"{self.text(k - 2)}::{name}", self.text(k - 3)
        if not (re.match(r"[A-Za-z_$]", before) or before in ("*", "&", ">", "]")) or before in BEFORE_TYPES or self.language == "java" and not owner:
            return None
        j = self.tokens[k + 1].close + 1
        while self.is_name(j) or self.text(j) in (",", ".") and self.language == "java":  # throws, const
            j += 1
        return (name, j) if self.text(j) == "{" else None

    def _script_function(self, k: int, owner: str) -> tuple[str, int] | None:
        before, j = self.text(k - 1), k + 1
        if before == "function" or before == "*" and self.text(k - 2) == "function" or owner and self.text(j) == "(" and before not in (".", "new", "=", "(", ",", "return"):
            if self.text(j) != "(" or self.tokens[j].close < 0:
                return None
            brace = self.body(self.tokens[j].close + 1, 60)
            near = brace >= 0 and (brace == self.tokens[j].close + 1 or self.text(self.tokens[j].close + 1) == ":")
            return (self.text(k), brace) if near or before == "function" else None
        if before not in ("const", "let", "var"):
            return None
        while self.text(j) not in ("=", ";", "") and self.tokens[j].line == self.tokens[k].line:  # its type
            j += 1
        j += 1 + (self.text(j + 1) == "async")
        if self.text(j) == "(" and self.tokens[j].close >= 0:
            j = self.tokens[j].close
        elif not self.is_name(j):
            return None
        while j + 1 < len(self.tokens) and self.tokens[j + 1].kind != "arrow" and self.text(j + 1) not in (";", "{", "=", "("):
            j += 1
        if j + 1 >= len(self.tokens) or self.tokens[j + 1].kind != "arrow":
            return None
        return self.text(k), j + 2 if self.text(j + 2) == "{" else -1

    def read(self) -> list[dict]:
        classes: list[tuple[str, int, int]] = []  # name, first and last token of the body
        k = 0
        while k < len(self.tokens):
            while classes and k > classes[-1][2]:
                classes.pop()
            if self.imports(k):
                k += 1
                continue
            if found := self.a_class(k):
                name, brace = found
                if brace >= 0 and self.tokens[brace].close >= 0:
                    classes.append((name, brace, self.tokens[brace].close))
                    k = brace + 1
                else:
                    k += 2
                continue
            owner = classes[-1][0] if classes else ""
            if found := self.a_function(k, owner):
                self.function(k, *found, owner)
            k += 1
        return self.rows

    def function(self, k: int, full: str, brace: int, owner: str) -> None:
        scope, _, name = full.rpartition("::")
        arrow_or_plain = self.script and self.text(k - 1) in ("function", "*", "const", "let", "var")
        owner = scope or ("" if arrow_or_plain else owner)
        line = self.tokens[k].line
        end = self.last_line(brace, line) if brace >= 0 else line
        me = f"{self.path}::{full if scope else f'{owner}.{name}' if owner else name}"
        marks = [x.strip()[1:] for x in self.lines[max(0, line - 4) : line - 1] if x.strip().startswith("@")] if self.script else []
        inside = self.tokens[brace : self.tokens[brace].close] if brace >= 0 and self.tokens[brace].close >= 0 else self.tokens[k + 1 : next((j for j in range(k, len(self.tokens)) if self.tokens[j].line > line), len(self.tokens))]
        self.rows.append({"row": "node", "id": me, "name": name, "kind": "function", "type": "method" if owner else "function", "line": line, "end_line": end, "code": "\n".join(self.lines[line - 1 : end]), "decorators": " ".join(marks), "type_system": "dynamic" if self.language == "javascript" else "explicit"})
        self.rows.append({"row": "edge", "id": f"{self.path}::{owner or '<file>'}", "target": me, "relation": "CONTAINS", "line": line})
        self.rows.extend({"row": "edge", "id": me, "target": n, "relation": "INVOKES", "line": line} for n in calls(inside, name))


def brace_symbols(path: str, text: str, language: str) -> list[dict]:
    """Rows of a file of a brace language; a symbol ends where its braces close."""
    return Reader(path, text, language).read()
