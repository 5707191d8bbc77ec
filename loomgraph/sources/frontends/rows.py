"""What a front-end emits."""

from __future__ import annotations

import json
import re

SCHEMA = "row string, file string, ordinal int, id string, kind string, name string, qualified_name string, target string, line int, language string, confidence double, attrs string"


class Rows:
    """Collects the rows of one file; ids are ``{path}::{kind}:{scope}``, repeated names get the line appended."""

    def __init__(self, path: str, language: str):
        self.path, self.language = path, language
        self.rows: list[tuple] = []
        self.ids: set[str] = set()
        self.file_id = f"file:{path}"
        self._add("node", self.file_id, "file", path.rsplit("/", 1)[-1], path, None, 1, 1.0, {})
        self.ids.add(self.file_id)

    def _add(self, row, id_, kind, name, qualified, target, line, confidence, attrs) -> None:
        self.rows.append((row, self.path, len(self.rows), id_, kind, name, qualified, target, line, self.language, confidence, json.dumps(attrs, sort_keys=True)))

    def node(self, kind: str, scope: tuple[str, ...], line: int, parent: str | None, **attrs) -> str:
        qualified = ".".join(scope)
        id_ = f"{self.path}::{kind}:{qualified}"
        if id_ in self.ids:
            id_ = f"{id_}@{line}"
            k = 1
            while id_ in self.ids:
                id_, k = f"{id_.rsplit('#', 1)[0]}#{k}", k + 1
        self.ids.add(id_)
        self._add("node", id_, kind, scope[-1], qualified, None, line, 1.0, {k: v for k, v in attrs.items() if v is not None})
        self.edge(parent or self.file_id, id_, "declares", line)
        return id_

    def edge(self, src: str, dst: str, kind: str, line: int, confidence: float = 1.0, **attrs) -> None:
        self._add("edge", src, kind, None, None, dst, line, confidence, attrs)

    def ref(self, src: str, kind: str, target: str, line: int, confidence: float = 1.0, **attrs) -> None:
        self._add("ref", src, kind, None, None, target, line, confidence, {k: v for k, v in attrs.items() if v is not None})

    def error(self, line: int, message: str) -> None:
        self._add("error", None, None, message, None, None, line, None, {})

    def out(self) -> list[tuple]:
        return self.rows


def blanked(text: str, pattern: re.Pattern) -> str:
    """Matches overwritten with blanks; line breaks stay, so places keep their line numbers."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def line_at(text: str, place: int) -> int:
    return text.count("\n", 0, place) + 1


def split_top(text: str, mark: str = ",") -> list[tuple[int, str]]:
    """(offset, part) between marks outside brackets and strings."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == mark and depth == 0:
            out.append((start, text[start:i]))
            start = i + 1
    out.append((start, text[start:]))
    return [(o, p) for o, p in out if p.strip()]


def closing(text: str, at: int) -> int:
    """Place of the bracket that closes the one at ``at``; -1 if none."""
    depth, quoted = 0, False
    for i in range(at, len(text)):
        c = text[i]
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += c in "([{"
            depth -= c in ")]}"
            if depth == 0:
                return i
    return -1
