"""C and C++ functions, Python testbenches, scenario actions."""

from __future__ import annotations

import ast
import re

from . import register
from .rows import Rows, blanked, line_at

COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"')
#: Words before a parenthesis that name no function (fixed values).
STATEMENTS = frozenset("if for while switch return sizeof catch else do defined alignof decltype static_assert".split())


def functions(path: str, text: str, language: str) -> Rows:
    rows = Rows(path, language)
    bare = blanked(blanked(text, COMMENT), re.compile(r"^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", re.M))
    # Linkage blocks keep their quotes until their brace is opened up; other strings go.
    bare = blanked(re.sub(r'extern\s*"C(?:\+\+)?"', lambda m: " " * len(m[0]), bare), STRING)
    depth, flat, chars = 0, [], list(bare)
    open_flat = re.compile(r"(?:\bnamespace\b[^;{}()=]*|^\s*|[;}]\s*)$")
    stack: list[bool] = []
    for i, c in enumerate(chars):
        if c == "{":
            before = bare[max(0, i - 200) : i]
            tail = re.split(r"[;{}]", before)[-1]
            is_flat = depth == 0 and (not tail.strip() or bool(re.search(r"\bnamespace\b", tail)))
            stack.append(is_flat)
            depth += not is_flat
            flat.append(" " if is_flat else "{" if depth == 1 else " ")
        elif c == "}":
            is_flat = stack.pop() if stack else True
            flat.append(" " if is_flat or depth > 1 else "}")
            depth -= not is_flat
        else:
            flat.append(c if depth == 0 or c == "\n" else " ")
    outer = "".join(flat)
    for m in re.finditer(r"(?:^|[;}\s])([A-Za-z_][\w\s*&:<>,]*?[\s*&])((?:\w+::)*~?\w+)\s*\(([^;{}]*)\)\s*(?:const|noexcept|override|\s)*([;{])", outer):
        name = m[2].rsplit("::", 1)[-1]
        if name in STATEMENTS or re.search(r"\b(?:return|typedef|else|new)\b", m[1]):
            continue
        rows.node("function", (name,), line_at(outer, m.start(2)), None, is_definition=m[4] == "{")
    return rows


@register("c")
def parse_c(path: str, text: str) -> Rows:
    return functions(path, text, "c")


@register("cpp")
def parse_cpp(path: str, text: str) -> Rows:
    return functions(path, text, "cpp")


def top_of(path: str) -> str | None:
    """The design a testbench's file name points at: test_x.py, x_test.py, x_tb.py."""
    m = re.match(r"(?:test_|tb_)(\w+)\.py$|(\w+?)_(?:test|tb)\.py$", path.rsplit("/", 1)[-1])
    return (m[1] or m[2]) if m else None


@register("python")
def parse_python(path: str, text: str, top: str | None = None) -> Rows:
    """Coroutine tests and what they read and drive of the design."""
    rows = Rows(path, "python")
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        rows.error(e.lineno or 1, e.msg)
        return rows
    top = top or top_of(path)
    for f in ast.walk(tree):
        if not isinstance(f, ast.AsyncFunctionDef | ast.FunctionDef):
            continue
        marks = [ast.unparse(d) for d in f.decorator_list]
        if not any(re.match(r"(?:cocotb\.)?test\b", m) for m in marks):
            continue
        id_ = rows.node("function", (f.name,), f.lineno, None, test=True)
        if top:
            rows.ref(id_, "test_covers", top, f.lineno, 0.4)
        dut = f.args.args[0].arg if f.args.args else None
        driven, read = set(), set()
        for x in ast.walk(f):
            if isinstance(x, ast.Assign | ast.AugAssign):
                for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    if s := signal(t, dut):
                        driven.add(s)
            if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in ("setimmediatevalue", "set"):
                if s := signal(x.func.value, dut):
                    driven.add(s)
        for x in ast.walk(f):
            if isinstance(x, ast.Attribute) and isinstance(x.ctx, ast.Load) and (s := signal(x, dut)) and s not in driven:
                read.add(s)
        for kind, names in (("drives", driven), ("reads", read)):
            for n in sorted(names):
                rows.ref(id_, kind, n, f.lineno, 0.6, top=top)
    return rows


def signal(x: ast.AST, dut: str | None) -> str | None:
    """``dut.sig``, also below ``.value`` and subscripts."""
    while isinstance(x, ast.Subscript) or isinstance(x, ast.Attribute) and not (isinstance(x.value, ast.Name) and x.value.id == dut):
        x = x.value
    if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == dut and not x.attr.startswith("_"):
        return x.attr
    return None


@register("sln")
def parse_sln(path: str, text: str) -> Rows:
    """Actions, the actions they invoke, and the designs that their constraints name."""
    rows = Rows(path, "sln")
    bare = blanked(text, re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*", re.S))
    places = list(re.finditer(r"\baction\s+(\w+)", bare))
    for m, after in zip(places, [*places[1:], None]):
        body = bare[m.end() : after.start() if after else len(bare)]
        constraints = [f"{a}=={b.strip()}" for a, b in re.findall(r"(\.[\w.]+)\s*==\s*([^;\n,)]+)", body)]
        id_ = rows.node("action", (m[1],), line_at(bare, m.start()), None, constraints=constraints[:32] or None)
        for c in re.finditer(r">\s*(\w+)", body):
            if c[1] != m[1]:
                rows.ref(id_, "invokes", c[1], line_at(bare, m.end() + c.start()))
        for name in dict.fromkeys(x.split(".")[1] for x in re.findall(r"\.[\w.]+(?=\s*==)", body)):
            rows.ref(id_, "test_covers", name, line_at(bare, m.start()), 0.4)
    return rows
