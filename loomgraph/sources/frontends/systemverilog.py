"""SystemVerilog and Verilog: units, ports, parameters, instances, dataflow, clocks and verification constructs."""

from __future__ import annotations

import re

from . import register
from ...functions.exprs import RESET_NAME
from .rows import Rows, blanked, closing, line_at, split_top

COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"')
ATTRIBUTE = re.compile(r"\(\*(?!\)).*?\*\)", re.S)
NAME = r"[A-Za-z_][\w$]*"
UNIT = re.compile(rf"\b(module|macromodule|interface|program|package|class)\b(?:\s+(?:automatic|static))?\s+({NAME})")
VIRTUAL = re.compile(r"\bvirtual\s*$")
END = {"module": "endmodule", "macromodule": "endmodule", "interface": "endinterface", "program": "endprogram", "package": "endpackage", "class": "endclass"}
DIRECTION = re.compile(r"^\s*(input|output|inout|ref)\b")
RESERVED = frozenset(
    "module macromodule interface program package class endmodule begin end if else for foreach while do case casex casez endcase always always_comb always_ff always_latch initial final assign deassign force release function endfunction task endtask generate endgenerate genvar localparam parameter input output inout ref wire logic reg bit byte int integer longint shortint real time var tri supply0 supply1 typedef enum struct union packed signed unsigned import export extends implements virtual static automatic const return posedge negedge or and not nand nor xor xnor buf assert assume cover property sequence endproperty endsequence covergroup endgroup coverpoint cross constraint clocking endclocking modport default wait fork join join_any join_none new this super null void string event rand randc unique priority iff inside with break continue repeat forever disable bind pure extern protected local forkjoin".split()
)
RESET = re.compile(RESET_NAME, re.I)
LITERAL = re.compile(r"\d*'[sS]?[bBoOdDhH][0-9a-fA-FxXzZ_?]+|\b\d[\w.]*")


def idents(text: str) -> list[str]:
    """Root identifiers in order: no members, no calls, no literals."""
    bare = STRING.sub(" ", LITERAL.sub(" ", text))
    found = re.findall(rf"(?<![\w.$`]){NAME}(?!\s*(?:\(|::))", bare)
    return list(dict.fromkeys(n for n in found if n not in RESERVED))


class Parser:
    def __init__(self, path: str, text: str, language: str):
        self.rows = Rows(path, language)
        self.text = blanked(blanked(text, COMMENT), ATTRIBUTE)
        self.text = blanked(self.text, re.compile(r"^[ \t]*`\w+[^\n]*", re.M))

    def run(self) -> Rows:
        self.units(0, len(self.text), None, ())
        return self.rows

    def line(self, at: int) -> int:
        return line_at(self.text, at)

    def units(self, start: int, end: int, parent: str | None, scope: tuple[str, ...]) -> str:
        """Declares the units of a range; returns the range's text without them."""
        rest, at = list(self.text[start:end]), start
        while m := UNIT.search(self.text, at, end):
            kind, name = m[1].replace("macromodule", "module"), m[2]
            before = self.text[max(start, m.start() - 12) : m.start()]
            if name in RESERVED or kind == "interface" and VIRTUAL.search(before) or re.search(r"\btypedef\s*$", before):
                at = m.end()
                continue
            stop = self.matching(m.end(), end, kind)
            if stop < 0:
                self.rows.error(self.line(m.start()), f"{kind} {name} has no {END[kind]}")
                stop = end
            self.unit(kind, name, m.start(), m.end(), stop, parent, scope, bool(VIRTUAL.search(before)))
            after = self.text.find("\n", stop) if stop < end else end
            after = end if after < 0 else after
            for i in range(m.start() - start, min(after, end) - start):
                if rest[i] != "\n":
                    rest[i] = " "
            at = max(after, m.end())
        return "".join(rest)

    def matching(self, at: int, end: int, kind: str) -> int:
        depth = 1
        word = "interface" if kind == "interface" else kind
        for m in re.compile(rf"\b({word}|{END[kind]})\b").finditer(self.text, at, end):
            if m[1] == END[kind]:
                depth -= 1
            elif not re.search(r"(virtual|typedef)\s*$", self.text[max(0, m.start() - 12) : m.start()]) and UNIT.match(self.text, m.start()):
                depth += 1
            if depth == 0:
                return m.start()
        return -1

    def unit(self, kind, name, begun, at, stop, parent, scope, virtual) -> None:
        own = (*scope, name)
        id_ = self.rows.node(kind, own, self.line(begun), parent, virtual=virtual or None)
        self.names: set[str] = set()
        p = at
        # The header ends at the first semicolon outside brackets; an import before the port list has one of its own.
        while p < stop:
            if self.text[p] == ";" and not (re.match(r"\s*import\b", self.text[at:p]) and re.match(r"\s*(?:import\b|#|\()", self.text[p + 1 : p + 200])):
                break
            if self.text[p] in "([{":
                q = closing(self.text, p)
                p = stop if q < 0 or q > stop else q
            p += 1
        depth_head = min(p, stop)
        header = self.text[at:depth_head]
        if m := re.search(rf"\bextends\s+((?:{NAME}::)?{NAME})", header):
            package, _, base = m[1].rpartition("::")
            self.rows.ref(id_, "extends", base, self.line(at), package=package or None)
        for m in re.finditer(rf"\bimport\s+({NAME})::(\*|{NAME})", header):
            self.rows.ref(id_, "imports", m[1], self.line(at + m.start()), item=m[2])
        groups = []
        p = 0
        while p < len(header):
            if header[p] == "(":
                q = closing(header, p)
                q = len(header) if q < 0 else q
                groups.append((header[:p].rstrip().endswith("#"), at + p + 1, header[p + 1 : q]))
                p = q
            p += 1
        index = 0
        for is_param, offset, inner in groups:
            if is_param:
                self.parameters(id_, own, offset, inner, False)
            elif kind != "class":
                index = self.ports(id_, own, offset, inner, index)
        inner_text = self.units(depth_head + 1, stop, id_, own) if depth_head < stop else ""
        if kind == "class":
            self.verification(id_, own, depth_head + 1, inner_text)
        else:
            self.body(id_, own, depth_head + 1, inner_text, index)

    def parameters(self, id_, own, offset, text, local) -> None:
        for o, part in split_top(text):
            is_local = local or bool(re.match(r"\s*localparam\b", part))
            m = re.search(rf"({NAME})\s*(?:\[[^\]]*\]\s*)*=\s*(.*)$", part, re.S) or re.search(rf"({NAME})\s*()$", part.strip())
            if m and m[1] not in RESERVED:
                self.rows.node("parameter", (*own, m[1]), self.line(offset + o + len(part) - len(part.lstrip())), id_, default=m[2].strip() or None, is_localparam=is_local or None)

    def ports(self, id_, own, offset, text, index) -> int:
        direction = None
        for o, part in split_top(text):
            line = self.line(offset + o + len(part) - len(part.lstrip()))
            if m := DIRECTION.match(part):
                direction = m[1]
            names = re.findall(NAME, LITERAL.sub(" ", re.sub(r"\[[^\]]*\]", " ", part.split("=")[0])))
            names = [n for n in names if n not in RESERVED]
            if names:
                interface = names[0] if len(names) > 1 and not DIRECTION.match(part) and "." in part else None
                self.rows.node("port", (*own, names[-1]), line, id_, direction=direction, index=index, interface=interface)
                self.names.add(names[-1])
                index += 1
        return index

    def body(self, id_, own, offset, text, index) -> None:
        line = lambda at: self.line(offset + at)
        work = self.verification(id_, own, offset, text)
        for m in re.finditer(rf"\bimport\s+({NAME})::(\*|{NAME})", work):
            self.rows.ref(id_, "imports", m[1], line(m.start()), item=m[2])
        for m in re.finditer(rf'\b(import|export)\s+"DPI(?:-C)?"\s+(?:context\s+|pure\s+)?(?:(\w+)\s*=\s*)?(function|task)\s+(?:[^;(]*?)({NAME})\s*(?:\(|;)', work):
            f = self.rows.node(m[3], (*own, m[4]), line(m.start()), id_, dpi=m[1])
            self.rows.ref(f, "foreign_binds", m[2] or m[4], line(m.start()), direction=m[1])
        work = blanked(work, re.compile(r'\b(?:import|export)\b[^;]*;'))
        locals_ = set()
        for m in re.finditer(rf"\b(function|task)\b(?:\s+automatic|\s+static)?\s+(?:[^;(]*?)({NAME})\s*(?:\(|;)(.*?)\bend\1\b", work, re.S):
            self.rows.node(m[1], (*own, m[2]), line(m.start()), id_)
        work = blanked(work, re.compile(r"\b(function|task)\b.*?\bend\1\b", re.S))
        for m in re.finditer(rf"\btypedef\s+(enum|struct|union)?\b([^;]*?(?:\{{.*?\}})?)\s*({NAME})\s*;", work, re.S):
            kind = {"enum": "enum", "struct": "struct", "union": "struct"}.get(m[1], "typedef")
            t = self.rows.node(kind, (*own, m[3]), line(m.start()), id_)
            if m[1] == "enum" and "{" in m[2]:
                for _, item in split_top(m[2][m[2].index("{") + 1 : m[2].rindex("}")]):
                    n = re.match(rf"\s*({NAME})", item)
                    if n:
                        self.rows.node("enum_member", (*own, m[3], n[1]), line(m.start()), t)
        work = blanked(work, re.compile(r"\btypedef\b[^;{]*(?:\{.*?\})?[^;]*;", re.S))
        for m in re.finditer(r"\b(parameter|localparam)\b([^;]*);", work):
            self.parameters(id_, own, offset + m.start(2), m[2], m[1] == "localparam")
        work = blanked(work, re.compile(r"\b(?:parameter|localparam|genvar)\b[^;]*;"))
        for m in re.finditer(r"^[ \t]*(input|output|inout)\b([^;]*);", work, re.M):
            for o, part in split_top(m[2]):
                names = [n for n in re.findall(NAME, re.sub(r"\[[^\]]*\]", " ", part)) if n not in RESERVED]
                if names:
                    self.rows.node("port", (*own, names[-1]), line(m.start()), id_, direction=m[1], index=index)
                    self.names.add(names[-1])
                    index += 1
        for m in re.finditer(rf"\b(?:wire|logic|reg|bit|tri|integer|int|byte)\b(?:\s+(?:signed|unsigned))?((?:\s*\[[^\]]*\])*)\s*([^;()]*);", work):
            for o, part in split_top(m[2]):
                n = re.match(rf"\s*({NAME})", part)
                if n and n[1] not in RESERVED:
                    if n[1] not in self.names:
                        self.rows.node("signal", (*own, n[1]), line(m.start(2) + o), id_)
                        self.names.add(n[1])
                    if "=" in part:
                        p = self.rows.node("process", (*own, f"init_{n[1]}"), line(m.start()), id_, style="initialiser")
                        self.flow(p, [n[1]], idents(part.split("=", 1)[1]), line(m.start()), locals_)
        work = blanked(work, re.compile(r"\b(?:wire|logic|reg|bit|tri|integer|int|byte)\b[^;()]*;"))
        n = 0
        for m in re.finditer(r"\bassign\b(?:\s*#\s*\S+)?\s*([^;=]*?)=(?!=)([^;]*);", work):
            p = self.rows.node("process", (*own, f"assign_{n}"), line(m.start()), id_, style="assign", combinational=True)
            self.flow(p, idents(re.sub(r"\[[^\]]*\]", " ", m[1])), idents(m[2]), line(m.start()), locals_)
            n += 1
        work = blanked(work, re.compile(r"\bassign\b[^;]*;"))
        work = self.always(id_, own, offset, work)
        self.instances(id_, own, offset, work)

    def flow(self, process, drives, reads, line, hidden) -> None:
        for name in dict.fromkeys(drives):
            if name not in hidden:
                self.rows.ref(process, "drives", name, line)
        for name in dict.fromkeys(reads):
            if name not in hidden:
                self.rows.ref(process, "reads", name, line)

    def always(self, id_, own, offset, work) -> str:
        pattern = re.compile(r"\b(always_ff|always_comb|always_latch|always|initial|final)\b\s*(@\s*(\*|\([^)]*\)))?")
        at, n, out = 0, 0, work
        while m := pattern.search(out, at):
            stop = self.statement(out, m.end())
            body, line = out[m.end() : stop], self.line(offset + m.start())
            terms = re.findall(rf"(?:(posedge|negedge)\s+)?({NAME})", re.sub(r"\bor\b|,", " ", (m[3] or "").strip("()*")))
            edges = [t for t in terms if t[0]]
            style = m[1]
            combinational = style in ("always_comb", "always_latch") or style == "always" and not edges
            p = self.rows.node("process", (*own, f"{style}_{n}"), line, id_, style=style, combinational=combinational or None, sensitivity=[{"edge": a or None, "name": b} for a, b in terms] or None)
            hidden = set(re.findall(rf"\b(?:int|integer|automatic\s+\w+|logic|bit|byte)\s+(?:\[[^\]]*\]\s*)?({NAME})\s*(?:=|;)", body))
            drives, reads = [], []
            clean = blanked(body, re.compile(r"\b(?:int|integer|byte)\s+\w+\s*;"))
            for a in re.finditer(rf"((?:{NAME}(?:\s*\[[^\]]*\])*(?:\.{NAME})*|\{{[^{{}}=]*\}}))\s*(<=|[-+*/&|^]?=)(?![=])\s*([^;]*);", clean):
                drives += idents(re.sub(r"\[[^\]]*\]", " ", a[1]))
                reads += idents(a[3]) + [x for i in re.findall(r"\[([^\]]*)\]", a[1]) for x in idents(i)]
            for c in re.finditer(r"\b(?:if|case[xz]?|while)\s*\(", clean):
                q = closing(clean, c.end() - 1)
                reads += idents(clean[c.end() : q if q > 0 else len(clean)])
            self.flow(p, drives, [r for r in reads if r not in hidden], line, hidden)
            self.sensitivity(p, edges, reads, line)
            out = out[: m.start()] + re.sub(r"[^\n]", " ", out[m.start() : stop]) + out[stop:]
            at, n = stop, n + 1
        return out

    def sensitivity(self, process, edges, reads, line) -> None:
        """One edge is the clock; of several, those named like resets are, and a single rest is the clock."""
        names = [name for _, name in edges]
        if len(names) == 1:
            self.rows.ref(process, "clocked_by", names[0], line)
        elif names:
            resets = [x for x in names if RESET.search(x)]
            rest = [x for x in names if x not in resets]
            for x in resets:
                self.rows.ref(process, "resets", x, line, is_async=True)
            for x in rest:
                self.rows.ref(process, "clocked_by", x, line, 1.0 if len(rest) == 1 else 0.4)
        if names:
            for x in dict.fromkeys(reads):
                if RESET.search(x) and x not in names:
                    self.rows.ref(process, "resets", x, line, 0.4, is_async=False)

    @staticmethod
    def statement(text: str, at: int) -> int:
        """End of the statement that starts at ``at``."""
        depth = 0
        for m in re.compile(r"\b(begin|end|case[xz]?|endcase|fork|join(?:_any|_none)?)\b|[;()]|\b(if|else|for|while)\b").finditer(text, at):
            word = m[0]
            if word == "(":
                depth += 1
            elif word == ")":
                depth -= 1
            elif word in ("begin", "case", "casex", "casez", "fork"):
                depth += 1
            elif word in ("end", "endcase") or word.startswith("join"):
                depth -= 1
                if depth == 0 and not re.match(r"\s*(?::\s*\w+\s*)?else\b", text[m.end() :]):
                    return m.end()
            elif word == ";" and depth == 0 and not re.match(r"\s*else\b", text[m.end() :]):
                return m.end()
        return len(text)

    def instances(self, id_, own, offset, work) -> None:
        pattern = re.compile(rf"(?<![\w.$`#])({NAME})\s+(?:#\s*\()?")
        at = 0
        while m := pattern.search(work, at):
            target, p = m[1], m.end(1)
            at = m.end(1)
            if target in RESERVED:
                continue
            while p < len(work) and work[p].isspace():
                p += 1
            overrides = None
            if p < len(work) and work[p] == "#":
                p = work.find("(", p)
                q = closing(work, p) if p >= 0 else -1
                if q < 0:
                    continue
                overrides, p = (p + 1, work[p + 1 : q]), q + 1
            first = True
            while n := re.compile(rf"\s*{'' if first else ','}\s*({NAME})\s*(?:\[[^\]]*\]\s*)*\(").match(work, p):
                q = closing(work, n.end() - 1)
                if n[1] in RESERVED or q < 0:
                    break
                line = self.line(offset + n.start(1))
                i = self.rows.node("instance", (*own, n[1]), line, id_)
                self.rows.ref(i, "instantiates", target, self.line(offset + m.start()))
                self.bindings(i, target, "parameterizes", "value_text", overrides, offset)
                self.bindings(i, target, "connects", "expr_text", (n.end(), work[n.end() : q]), offset)
                p, first = q + 1, False
            if not first:
                at = p

    def bindings(self, i, target, kind, value, group, offset) -> None:
        if group is None:
            return
        base, text = group
        for k, (o, part) in enumerate(split_top(text)):
            line = self.line(offset + base + o + len(part) - len(part.lstrip()))
            s = part.strip()
            if s == ".*":
                self.rows.ref(i, kind, target, line, wildcard=True)
            elif m := re.match(rf"\.\s*({NAME})\s*(?:\((.*)\))?$", s, re.S):
                self.rows.ref(i, kind, target, line, port_name=m[1], **{value: (m[2] if m[2] is not None else m[1]).strip()})
            else:
                self.rows.ref(i, kind, target, line, position=k, **{value: s})

    def verification(self, id_, own, offset, text) -> str:
        line = lambda at: self.line(offset + at)
        for kind, end in (("property", "endproperty"), ("sequence", "endsequence"), ("covergroup", "endgroup"), ("clocking", "endclocking")):
            for m in re.finditer(rf"(?<!assert )(?<!cover )(?<!assume )\b(?:default\s+)?{kind}\s+({NAME})\b(.*?)\b{end}\b", text, re.S):
                n = self.rows.node("clocking_block" if kind == "clocking" else kind, (*own, m[1]), line(m.start()), id_)
                for c in re.finditer(rf"@\s*\(\s*(?:posedge|negedge)?\s*({NAME})", m[2]):
                    self.rows.ref(n, "clocked_by", c[1], line(m.start()))
                if kind == "covergroup":
                    for c in re.finditer(rf"(?:({NAME})\s*:\s*)?\bcoverpoint\s+([^;{{]+)", m[2]):
                        names = idents(c[2])
                        cp = self.rows.node("coverpoint", (*own, m[1], c[1] or (names[0] if names else "cp")), line(m.start(2) + c.start()), n)
                        for x in names:
                            self.rows.ref(cp, "covers", x, line(m.start(2) + c.start()))
            text = blanked(text, re.compile(rf"(?<!assert )(?<!cover )(?<!assume )\b(?:default\s+)?{kind}\s+{NAME}\b.*?\b{end}\b", re.S))
        n = 0
        for m in re.finditer(rf"(?:({NAME})\s*:\s*)?\b(assert|assume|cover)\s+property\s*\(", text):
            q = closing(text, m.end() - 1)
            inner = text[m.end() : q if q > 0 else len(text)]
            a = self.rows.node("assertion", (*own, m[1] or f"{m[2]}_{n}"), line(m.start()), id_)
            n += 1
            for c in re.finditer(rf"@\s*\(\s*(?:posedge|negedge)?\s*({NAME})\s*\)", inner):
                self.rows.ref(a, "clocked_by", c[1], line(m.start()))
            for x in idents(re.sub(r"@\s*\([^)]*\)", " ", inner)):
                self.rows.ref(a, "asserts_on", x, line(m.start()))
        for m in re.finditer(rf"\bconstraint\s+({NAME})\s*\{{", text):
            self.rows.node("constraint", (*own, m[1]), line(m.start()), id_)
        return blanked(text, re.compile(rf"(?:{NAME}\s*:\s*)?\b(?:assert|assume|cover)\s+property\s*\([^;]*;|\bconstraint\s+{NAME}\s*\{{[^}}]*\}}"))


@register("systemverilog")
def parse_sv(path: str, text: str) -> Rows:
    return Parser(path, text, "systemverilog").run()


@register("verilog")
def parse_v(path: str, text: str) -> Rows:
    return Parser(path, text, "verilog").run()
