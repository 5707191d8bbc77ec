"""Macros, conditionals and includes, as an ordered pass over files in compile order.

A macro table flows through the files of one build, so a build is one ordered pass: ``preprocess_builds`` runs
builds side by side, each in a task of its own; parsing the expanded texts afterwards is parallel by file.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from .rows import closing, split_top

DIRECTIVE = re.compile(r"^\s*`(define|undef|ifdef|ifndef|elsif|else|endif|include|undefineall|timescale|default_nettype|celldefine|endcelldefine|resetall|line|pragma)\b[ \t]*(.*)$")
USE = re.compile(r"`([A-Za-z_]\w*)")
#: How deep includes and macro uses may nest.
DEPTH = 64


class Macro:
    __slots__ = ("name", "params", "body", "path", "line")

    def __init__(self, name, params, body, path, line):
        self.name, self.params, self.body, self.path, self.line = name, params, body, path, line


class Preprocessor:
    """State of one build. ``read(path)`` gives a text or None."""

    def __init__(self, read: Callable[[str], str | None], include_dirs: tuple[str, ...] = (), defines: dict[str, str] | None = None, both_branches: bool = False):
        self.read, self.dirs, self.both = read, include_dirs, both_branches
        self.macros = {k: Macro(k, None, v, None, 0) for k, v in (defines or {}).items()}
        self.events: list[dict] = []

    def event(self, op, name, path, line, **more) -> None:
        self.events.append({"seq": len(self.events), "op": op, "name": name, "file": path, "line": line, **more})

    def run(self, path: str, text: str | None = None, depth: int = 0) -> tuple[str, list[tuple[str, int]]]:
        """Expanded text, and for each of its lines the file and line it comes from."""
        text = self.read(path) if text is None else text
        if text is None:
            return "", []
        out: list[str] = []
        origin: list[tuple[str, int]] = []
        # A branch is (taken now, taken before, conditional at all).
        branches: list[list[bool]] = []
        lines = text.split("\n")
        i = 0
        while i < len(lines):
            line, number = lines[i], i + 1
            while line.rstrip().endswith("\\") and DIRECTIVE.match(line) and i + 1 < len(lines):
                i += 1
                line = line.rstrip()[:-1] + "\n" + lines[i]
            i += 1
            active = all(b[0] for b in branches)
            if m := DIRECTIVE.match(line.replace("\n", " ")):
                self.directive(m[1], m[2].strip(), path, number, active, branches, out, origin, depth)
            elif active:
                full = line
                while i < len(lines) and self.open_use(full):
                    full += " " + lines[i]
                    i += 1
                out.append(self.expand(full, path, number, 0, bool(branches)))
                origin.append((path, number))
        if branches:
            self.event("error", "unterminated conditional", path, len(lines))
        return "\n".join(out), origin

    def directive(self, word, rest, path, line, active, branches, out, origin, depth) -> None:
        rest_code = re.sub(r"\s*//.*$", "", rest)
        name = (re.match(r"[A-Za-z_]\w*", rest_code) or [""])[0]
        if word in ("ifdef", "ifndef"):
            self.event("test", name, path, line)
            hit = (name in self.macros) == (word == "ifdef") or self.both
            branches.append([hit, hit, True])
        elif word == "elsif" and branches:
            hit = (not branches[-1][1] and name in self.macros) or self.both
            branches[-1] = [hit, branches[-1][1] or hit, True]
        elif word == "else" and branches:
            branches[-1] = [not branches[-1][1] or self.both, True, True]
        elif word == "endif":
            if branches:
                branches.pop()
            else:
                self.event("error", "endif without ifdef", path, line)
        elif not active:
            return
        elif word == "define" and name:
            after = rest[len(name) :]
            params = None
            if after.startswith("("):
                q = closing(after, 0)
                params = [(p.partition("=")[0].strip(), p.partition("=")[2].strip() if "=" in p else None) for _, p in split_top(after[1:q])]
                after = after[q + 1 :]
            self.macros[name] = Macro(name, params, re.sub(r"\s*//.*$", "", after).strip(), path, line)
            self.event("define", name, path, line, conditional=bool(branches))
        elif word == "undef":
            self.macros.pop(name, None)
            self.event("undef", name, path, line)
        elif word == "undefineall":
            self.macros.clear()
            self.event("undef", "*", path, line)
        elif word == "include":
            self.include(self.expand(rest_code, path, line, 0, False), path, line, out, origin, depth)

    def include(self, text, path, line, out, origin, depth) -> None:
        m = re.match(r'\s*(?:"([^"]+)"|<([^>]+)>)', text)
        if not m:
            self.event("error", f"unreadable include {text.strip()}", path, line)
            return
        wanted = m[1] or m[2]
        for base in (posixpath.dirname(path), *self.dirs):
            full = posixpath.normpath(posixpath.join(base, wanted))
            found = self.read(full)
            if found is not None:
                self.event("include", wanted, path, line, target=full)
                if depth >= DEPTH:
                    self.event("error", f"includes nest too deep at {wanted}", path, line)
                    return
                inner, places = self.run(full, found, depth + 1)
                out.extend(inner.split("\n") if places else [])
                origin.extend(places)
                return
        self.event("include", wanted, path, line, target=None)

    def open_use(self, line: str) -> bool:
        """Whether a macro use's arguments go on in the next line."""
        for m in USE.finditer(line):
            macro = self.macros.get(m[1])
            if macro is not None and macro.params is not None:
                at = m.end()
                while at < len(line) and line[at].isspace():
                    at += 1
                if at < len(line) and line[at] == "(" and closing(line, at) < 0:
                    return True
        return False

    def expand(self, text: str, path: str, line: int, depth: int, conditional: bool) -> str:
        out, at = [], 0
        for_comment = text.find("//")
        while m := USE.search(text, at):
            if 0 <= for_comment < m.start():
                break
            out.append(text[at : m.start()])
            at = m.end()
            macro = self.macros.get(m[1])
            if macro is None or depth > DEPTH:
                self.event("use", m[1], path, line, defined=None)
                out.append(m[0])
                continue
            self.event("use", m[1], path, line, defined=macro.path, defined_line=macro.line)
            body = macro.body
            if macro.params is not None:
                p = at
                while p < len(text) and text[p].isspace():
                    p += 1
                q = closing(text, p) if p < len(text) and text[p] == "(" else -1
                if q < 0:
                    self.event("error", f"{m[1]} needs arguments", path, line)
                    continue
                given = [a.strip() for _, a in split_top(text[p + 1 : q])]
                at = q + 1
                for k, (name, default) in enumerate(macro.params):
                    value = given[k] if k < len(given) and given[k] else default or ""
                    body = re.sub(rf"(?<![\w`]){re.escape(name)}\b", lambda _, v=value: v, body)
                body = body.replace("``", "").replace('`"', '"')
            out.append(self.expand(body, path, line, depth + 1, conditional))
        out.append(text[at:])
        return "".join(out)


def preprocess_builds(files: DataFrame, include_dirs: tuple[str, ...] = (), defines: dict[str, str] | None = None, both_branches: bool = False) -> DataFrame:
    """Expanded texts of (build, ordinal, path, text, is_source): build, ordinal, path, text; one ordered pass for each build."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal")
        texts = dict(zip(rows["path"], rows["text"]))
        p = Preprocessor(texts.get, include_dirs, defines, both_branches)
        own = rows[rows["is_source"]]
        return pd.DataFrame({"build": own["build"], "ordinal": own["ordinal"], "path": own["path"], "text": [p.run(x)[0] for x in own["path"]]})

    return files.groupBy("build").applyInPandas(run, "build string, ordinal int, path string, text string")


def macro_events(files: DataFrame, include_dirs: tuple[str, ...] = (), defines: dict[str, str] | None = None) -> DataFrame:
    """The define, undef, use, test and include events of each build, in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal")
        p = Preprocessor(dict(zip(rows["path"], rows["text"])).get, include_dirs, defines)
        for x in rows.loc[rows["is_source"], "path"]:
            p.run(x)
        build = rows["build"].iloc[0]
        cols = ("seq", "op", "name", "file", "line", "target", "defined")
        return pd.DataFrame([[build, *(e.get(c) for c in cols)] for e in p.events], columns=["build", *cols])

    return files.groupBy("build").applyInPandas(run, "build string, seq int, op string, name string, file string, line int, target string, defined string")
