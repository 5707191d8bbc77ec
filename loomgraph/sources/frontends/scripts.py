"""Tcl: timing constraints, power intent and flow scripts; Perl generators."""

from __future__ import annotations

import posixpath
import re

from . import register
from .rows import Rows, line_at

#: Query commands and the kinds of objects they name (fixed values).
QUERIES = {"get_ports": "port", "get_pins": "port", "get_clocks": "clock", "get_cells": "instance", "get_nets": "signal", "all_inputs": "port", "all_outputs": "port", "all_clocks": "clock"}
CONSTRAINTS = ("set_false_path", "set_multicycle_path", "set_input_delay", "set_output_delay", "set_clock_groups", "set_max_delay", "set_min_delay")
READERS = {"read_verilog": "verilog", "read_vhdl": "vhdl", "read_sdc": "sdc", "read_upf": "upf", "load_upf": "upf", "read_file": "file", "analyze": "analyze", "add_files": "file", "add_file": "file", "source": "source"}


def commands(text: str) -> list[tuple[int, list[str]]]:
    """(line, words) of each command. Braced and bracketed words stay whole; ``set`` variables with plain values are filled in."""
    out: list[tuple[int, list[str]]] = []
    known: dict[str, str] = {}
    i, n, line = 0, len(text), 1
    words: list[str] = []
    begun = 1

    def finish() -> None:
        nonlocal words
        if words:
            if words[0] == "set" and len(words) == 3 and "$" not in words[2] and "[" not in words[2]:
                known[words[1]] = words[2].strip('{}"')
            out.append((begun, words))
        words = []

    while i < n:
        c = text[i]
        if c == "\n" or c == ";":
            finish()
            line += c == "\n"
            i += 1
        elif c == "\\" and text[i + 1 : i + 2] == "\n":
            line += 1
            i += 2
        elif c.isspace():
            i += 1
        elif c == "#" and not words:
            while i < n and text[i] != "\n":
                i += 1
        else:
            if not words:
                begun = line
            start, depth, quoted, braced = i, 0, False, c == "{"
            while i < n:
                c = text[i]
                if c == "\\":
                    i += 1
                elif c == '"' and not braced:
                    quoted = not quoted
                elif c in "{[":
                    depth += 1
                elif c in "}]":
                    depth -= 1
                elif depth <= 0 and not quoted and (c.isspace() or c == ";"):
                    break
                line += text[i : i + 1] == "\n"
                i += 1
            word = text[start:i].replace("\\\n", " ")
            if not word.startswith("{"):
                word = re.sub(r"\$\{?(\w+)\}?", lambda m: known.get(m[1], m[0]), word)
            words.append(word)
    finish()
    return out


def plain(word: str) -> str:
    return word.strip().strip('{}"').strip()


def targets(word: str) -> list[tuple[str | None, str]]:
    """(kind of object, pattern) that a word names."""
    word = word.strip()
    if word.startswith("[") and word.endswith("]"):
        inner = commands(word[1:-1])
        if not inner:
            return []
        head, *rest = inner[0][1]
        if head in QUERIES:
            names = [x for w in rest if not w.startswith("-") for x in plain(w).split()]
            return [(QUERIES[head], x) for x in names] or ([(QUERIES[head], "*")] if head.startswith("all_") else [])
        return [t for w in rest for t in targets(w)]
    return [(None, x) for x in plain(word).split()]


def options(words: list[str], flags: tuple[str, ...] = ()) -> tuple[list[tuple[str, str | None]], list[str]]:
    """(name, value) of options, and the other words."""
    named, rest, i = [], [], 1
    while i < len(words):
        w = words[i]
        if re.match(r"-[a-zA-Z]", w):
            follows = words[i + 1] if i + 1 < len(words) else None
            if w[1:] in flags or follows is None or re.match(r"-[a-zA-Z]", follows):
                named.append((w[1:], None))
            else:
                named.append((w[1:], follows))
                i += 1
        else:
            rest.append(w)
        i += 1
    return named, rest


@register("tcl")
def parse_tcl(path: str, text: str) -> Rows:
    rows = Rows(path, "tcl")
    domains: dict[str, dict] = {}
    for k, (line, words) in enumerate(commands(text)):
        head = words[0]
        if head in ("create_clock", "create_generated_clock"):
            named, rest = options(words, ("add", "invert"))
            opts = dict(named)
            on = [t for w in rest for t in targets(w)]
            name = plain(opts.get("name") or (on[0][1] if on else f"clock_{k}"))
            id_ = rows.node("clock", (name,), line, None, period=plain(opts["period"]) if opts.get("period") else None, generated=head != "create_clock" or None)
            for kind, pattern in on:
                rows.ref(id_, "constrains", pattern, line, object_kind=kind, role="target")
            for kind, pattern in targets(opts.get("source") or ""):
                rows.ref(id_, "constrains", pattern, line, object_kind=kind, role="source")
        elif head in CONSTRAINTS:
            named, rest = options(words, ("asynchronous", "physically_exclusive", "logically_exclusive", "setup", "hold", "max", "min", "add_delay"))
            flags = {n for n, v in named if v is None}
            groups = [[p for _, p in targets(v)] for n, v in named if n == "group" and v]
            id_ = rows.node("timing_constraint", (f"{head}_{k}",), line, None, set_type=head, asynchronous=True if "asynchronous" in flags else None, groups=groups or None)
            for n, v in named:
                role = {"from": "from", "to": "to", "through": "through", "clock": "clock", "group": "group"}.get(n)
                for kind, pattern in targets(v or "") if role else []:
                    rows.ref(id_, "constrains", pattern, line, object_kind=kind or "clock", role=role)
            for w in rest:
                for kind, pattern in targets(w) if w.startswith("[") else []:
                    rows.ref(id_, "constrains", pattern, line, object_kind=kind, role="target")
        elif head == "create_power_domain":
            named, rest = options(words, ("include_scope",))
            elements = [e for n, v in named if n == "elements" and v for e in plain(v).split()]
            name = plain(rest[0]) if rest else f"domain_{k}"
            domains[name] = {"line": line, "elements": elements, "strategies": [], "supply": next((plain(v) for n, v in named if n == "supply" and v), None)}
        elif head in ("set_isolation", "set_retention", "set_level_shifter"):
            named, rest = options(words)
            on = plain(dict(named).get("domain") or "")
            if on in domains:
                domains[on]["strategies"].append({"kind": head[4:], "name": plain(rest[0]) if rest else ""})
            else:
                rows.error(line, f"{head} on unknown domain {on}")
        elif head == "set_domain_supply_net" and len(words) > 1 and plain(words[1]) in domains:
            domains[plain(words[1])]["supply"] = plain(dict(options(words)[0]).get("primary_power_net") or "") or None
        elif head in READERS:
            _, rest = options(words, ("sv", "vhdl2008", "autoread", "recursive"))
            for w in rest:
                for f in plain(w).split():
                    if not f.startswith(("$", "[")):
                        rows.ref(rows.file_id, "references_file", posixpath.normpath(posixpath.join(posixpath.dirname(path), f)), line, mode=READERS[head])
    for name, d in domains.items():
        id_ = rows.node("power_domain", (name,), d["line"], None, elements=d["elements"], strategies=d["strategies"], supply=d["supply"])
        for e in d["elements"]:
            rows.ref(id_, "constrains", e, d["line"], object_kind="instance", role="element")
    return rows


@register("perl")
def parse_perl(path: str, text: str) -> Rows:
    """Files that a script opens by literal name; one that writes or prints a module is the generator of what it writes."""
    rows = Rows(path, "perl")
    text = re.sub(r"(?m)^\s*#[^\n]*", "", text)
    generator = re.search(r"<<\s*[\"']?(\w+)[\"']?.*?\bmodule\s+\w+.*?^\1\s*$", text, re.S | re.M) is not None
    for m in re.finditer(r"\bopen\s*\(?\s*(?:my\s+)?[\$\w]+\s*,\s*(?:['\"]\s*(\+?[<>]{1,2})\s*['\"]\s*,\s*)?['\"]\s*(\+?[<>]{0,2})\s*([\w./-]+)['\"]", text):
        write = ">" in (m[1] or m[2] or "<")
        target = posixpath.normpath(posixpath.join(posixpath.dirname(path), m[3]))
        line = line_at(text, m.start())
        if write and (generator or re.search(r"\.s?vh?d?l?$", m[3])):
            rows.ref(rows.file_id, "generated_from", target, line)
        else:
            rows.ref(rows.file_id, "references_file", target, line, mode="write" if write else "read")
    return rows
