"""VHDL: entities, architectures, packages, configurations, instances, processes. Names are lower case."""

from __future__ import annotations

import re

from . import register
from ...functions.exprs import RESET_NAME
from .rows import Rows, blanked, closing, line_at, split_top

COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)
NAME = r"[A-Za-z]\w*"
CLOCK = re.compile(r"(?:^|_)(?:clk|clock|ck)(?:_|\d|$)|clk$|^clk", re.I)
RESET = re.compile(RESET_NAME, re.I)
#: Reserved words and common functions that are no signals (fixed values).
WORDS = frozenset(
    "if then else elsif end case when is others for loop while begin process wait until and or not xor nand nor xnor mod rem abs sll srl sla sra rol ror downto to rising_edge falling_edge event null report severity assert variable signal constant type subtype range array record of in out inout buffer std_logic std_logic_vector unsigned signed integer natural positive boolean bit bit_vector true false to_integer to_unsigned to_signed resize return generate port map generic open all next exit after transport".split()
)


def idents(text: str) -> list[str]:
    bare = re.sub(r'"[^"]*"|\'.\'|[xXbBoO]"[^"]*"|\b\d[\w.#]*', " ", text)
    return list(dict.fromkeys(n.lower() for n in re.findall(rf"(?<![\w.'])({NAME})(?!\s*=>)", bare) if n.lower() not in WORDS))


class Parser:
    def __init__(self, path: str, text: str):
        self.rows = Rows(path, "vhdl")
        self.text = blanked(text, COMMENT)

    def line(self, at: int) -> int:
        return line_at(self.text, at)

    def run(self) -> Rows:
        t = self.text
        libraries: list[tuple[str, str, int]] = []
        starts = re.compile(rf"\b(use|entity|architecture|package\s+body|package|configuration|context)\s+({NAME}(?:\.\w+)*)(?:\s+of\s+({NAME}(?:\.\w+)?))?\s*(is|;)?", re.I)
        at = 0
        while m := starts.search(t, at):
            kind, name, of = re.sub(r"\s+", " ", m[1].lower()), m[2].lower(), (m[3] or "").lower()
            at = m.end()
            if kind == "use":
                parts = name.split(".")
                if len(parts) >= 2:
                    libraries.append((parts[0], parts[1], self.line(m.start())))
                continue
            if (m[4] or "").lower() != "is":
                continue
            stop = self.end_of(kind, name, m.end())
            body = t[m.end() : stop]
            node = {"package": "vhdl_package", "package body": "package_body"}.get(kind, kind)
            scope = (of, name) if kind == "architecture" else (name,)
            id_ = self.rows.node(node, scope, self.line(m.start()), None, original_name=m[2] if m[2] != name else None, of_entity=of or None)
            for library, package, line in libraries:
                self.rows.ref(id_, "uses_package", package, line, library=library)
            if kind != "package":
                libraries = []
            getattr(self, node, self.plain)(id_, scope, m.end(), body, of)
            at = max(at, stop)
        return self.rows

    def end_of(self, kind: str, name: str, at: int) -> int:
        last = kind.split()[0]
        own = re.compile(rf"\bend\s+(?:{re.sub(' ', r'\\s+', kind)}\s*)?{re.escape(name)}\s*;|\bend\s+{last}\s*;", re.I)
        if m := own.search(self.text, at):
            return m.start()
        nxt = re.compile(r"^\s*(?:library|use|entity|architecture|package|configuration)\b", re.I | re.M).search(self.text, at)
        plain = list(re.compile(r"\bend\s*;", re.I).finditer(self.text, at, nxt.start() if nxt else len(self.text)))
        if plain:
            return plain[-1].start()
        self.rows.error(self.line(at), f"{kind} {name} has no end")
        return len(self.text)

    def plain(self, id_, scope, offset, body, of) -> None:
        for m in re.finditer(rf"\b(function|procedure|component)\s+({NAME})", body, re.I):
            if not re.search(r"\bend\s*$", body[: m.start()], re.I):
                self.rows.node("function" if m[1].lower() != "component" else "entity", (*scope, m[2].lower()), self.line(offset + m.start()), id_, component=m[1].lower() == "component" or None)

    vhdl_package = package_body = context = plain

    def entity(self, id_, scope, offset, body, of) -> None:
        index = 0
        for m in re.finditer(r"\b(generic|port)\s*\(", body, re.I):
            q = closing(body, m.end() - 1)
            for o, part in split_top(body[m.end() : q if q > 0 else len(body)], ";"):
                line = self.line(offset + m.end() + o + len(part) - len(part.lstrip()))
                d = re.match(rf"\s*(?:signal\s+|constant\s+)?({NAME}(?:\s*,\s*{NAME})*)\s*:\s*(in|out|inout|buffer)?\b\s*([^:]*)(?::=\s*(.*))?", part, re.I | re.S)
                if not d:
                    self.rows.error(line, "unreadable declaration")
                    continue
                for n in re.split(r"\s*,\s*", d[1]):
                    if m[1].lower() == "port":
                        self.rows.node("port", (*scope, n.lower()), line, id_, direction=(d[2] or "in").lower(), index=index)
                        index += 1
                    else:
                        self.rows.node("parameter", (*scope, n.lower()), line, id_, default=(d[4] or "").strip() or None)

    def configuration(self, id_, scope, offset, body, of) -> None:
        self.rows.ref(id_, "binds", of, self.line(offset))
        arch = re.search(rf"\bfor\s+({NAME})", body, re.I)
        for m in re.finditer(rf"\bfor\s+({NAME}(?:\s*,\s*{NAME})*)\s*:\s*({NAME})\s+use\s+entity\s+(?:({NAME})\.)?({NAME})(?:\s*\(\s*({NAME})\s*\))?", body, re.I):
            self.rows.ref(id_, "binds", m[4].lower(), self.line(offset + m.start()), labels=re.split(r"\s*,\s*", m[1].lower().strip()), component=m[2].lower(), library=(m[3] or "").lower() or None, architecture=(m[5] or "").lower() or None, block=arch[1].lower() if arch else None)

    def architecture(self, id_, scope, offset, body, of) -> None:
        line = lambda at: self.line(offset + at)
        self.rows.ref(id_, "implements", of, line(0))
        begin = re.search(r"\bbegin\b", body, re.I)
        # Functions have a begin of their own; the first outside of them opens the statements.
        head = blanked(body, re.compile(r"\b(?:function|procedure)\b(?:(?!\bend\b).)*?\bis\b.*?\bend\b[^;]*;", re.I | re.S))
        begin = re.search(r"\bbegin\b", head, re.I)
        cut = begin.end() if begin else len(head)
        for m in re.finditer(rf"\b(?:signal)\s+({NAME}(?:\s*,\s*{NAME})*)\s*:", head[:cut], re.I):
            for n in re.split(r"\s*,\s*", m[1]):
                self.rows.node("signal", (*scope, n.lower()), line(m.start()), id_)
        work = re.sub(r"[^\n]", " ", head[:cut]) + head[cut:]
        n = 0
        pattern = re.compile(rf"(?:({NAME})\s*:\s*)?(?:postponed\s+)?\bprocess\b\s*(?:\(([^)]*)\))?\s*(?:is\b)?(.*?)\bend\s+process\b[^;]*;", re.I | re.S)
        for m in pattern.finditer(work):
            self.process(id_, scope, (m[1] or f"process_{n}").lower(), line(m.start()), m[2] or "", m[3])
            n += 1
        work = blanked(work, pattern)
        inst = re.compile(rf"({NAME})\s*:\s*(?:(entity|component|configuration)\s+)?((?:{NAME}\.)?{NAME})(?:\s*\(\s*({NAME})\s*\))?\s*(?=(?:generic|port)\s+map)", re.I)
        for m in inst.finditer(work):
            stop = work.find(";", m.end())
            text = work[m.end() : stop if stop > 0 else len(work)]
            library, _, target = m[3].lower().rpartition(".")
            i = self.rows.node("instance", (*scope, m[1].lower()), line(m.start()), id_)
            self.rows.ref(i, "instantiates", target, line(m.start()), library=library or None, architecture=(m[4] or "").lower() or None, style=(m[2] or "component").lower())
            for g in re.finditer(r"\b(generic|port)\s+map\s*\(", text, re.I):
                q = closing(text, g.end() - 1)
                for k, (o, part) in enumerate(split_top(text[g.end() : q if q > 0 else len(text)])):
                    formal, _, actual = part.partition("=>")
                    named = "=>" in part
                    key = "expr_text" if g[1].lower() == "port" else "value_text"
                    self.rows.ref(i, "connects" if g[1].lower() == "port" else "parameterizes", target, line(m.end() + g.end() + o), port_name=formal.strip().lower() if named else None, position=None if named else k, **{key: (actual if named else part).strip()})
        work = blanked(work, re.compile(inst.pattern + r"[^;]*;", re.I))
        for k, m in enumerate(re.finditer(rf"(?:({NAME})\s*:\s*)?(?:with\s+[^;]*?select\s+)?({NAME})(?:\s*\([^)]*\))?(?:\.\w+)*\s*<=\s*([^;]*);", work, re.I)):
            p = self.rows.node("process", (*scope, (m[1] or f"assign_{k}").lower()), line(m.start()), id_, style="concurrent", combinational=True)
            self.rows.ref(p, "drives", m[2].lower(), line(m.start()))
            for x in idents(m[3]):
                self.rows.ref(p, "reads", x, line(m.start()))

    def process(self, id_, scope, name, line, sensitivity, body) -> None:
        listed = [x.strip().lower() for x in sensitivity.split(",") if x.strip()]
        edges = [x.lower() for x in re.findall(rf"\b(?:rising_edge|falling_edge)\s*\(\s*({NAME})", body, re.I)] + [x.lower() for x in re.findall(rf"({NAME})\s*'\s*event\b", body, re.I)]
        p = self.rows.node("process", (*scope, name), line, id_, combinational=None if edges else True, sensitivity=listed or None)
        local = {x.lower() for d in re.findall(rf"\bvariable\s+({NAME}(?:\s*,\s*{NAME})*)", body, re.I) for x in re.split(r"\s*,\s*", d)}
        start = re.search(r"\bbegin\b", body, re.I)
        code = body[start.end() :] if start else body
        reads: list[str] = []
        for m in re.finditer(rf"({NAME})(?:\s*\([^;<=]*\))?(?:\.\w+)*\s*(<=|:=)\s*([^;]*);", code):
            if m[2] == "<=" and m[1].lower() not in local and not re.search(r"\b(?:if|elsif|while|until|when)\b[^;]*$", code[: m.start()].rsplit(";", 1)[-1].rsplit("then", 1)[-1], re.I):
                self.rows.ref(p, "drives", m[1].lower(), line)
            reads += idents(m[3])
        for m in re.finditer(r"\b(?:if|elsif|case|while)\b(.*?)\b(?:then|is|loop)\b", code, re.I | re.S):
            reads += idents(m[1])
        for x in dict.fromkeys(r for r in reads if r not in local):
            self.rows.ref(p, "reads", x, line)
        if edges:
            for x in dict.fromkeys(edges):
                self.rows.ref(p, "clocked_by", x, line)
        elif 0 < len(listed) <= 2 and len(clocks := [x for x in listed if CLOCK.search(x)]) == 1:
            self.rows.ref(p, "clocked_by", clocks[0], line, 0.4)
        if edges:
            for x in dict.fromkeys([*listed, *reads]):
                if RESET.search(x):
                    self.rows.ref(p, "resets", x, line, 0.4, is_async=x in listed)


@register("vhdl")
def parse_vhdl(path: str, text: str) -> Rows:
    return Parser(path, text).run()
