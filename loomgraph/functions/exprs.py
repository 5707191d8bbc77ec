"""Scalar expressions of the graph: names, globs, identifiers, labels. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the expression languages that are no identifiers.
KEYWORDS = ("posedge", "negedge", "signed", "unsigned", "inside", "with", "open", "others", "null", "true", "false", "when", "else", "and", "or", "not", "xor", "nand", "nor", "xnor", "abs", "mod", "rem", "sll", "srl", "sla", "sra", "rol", "ror", "downto", "to")
#: Based and sized literals, and strings (fixed patterns).
LITERAL = r"""[0-9]*'[sS]?[bBoOdDhH][0-9a-fA-FxXzZ_?]+|"[^"]*"|[xXbBoO]"[^"]*"|'[01xXzZ]'"""
IDENTIFIER = r"(?<![\w.$])[A-Za-z_][A-Za-z0-9_$]*"
#: Fixed pattern: what makes a net's name that of a reset.
RESET_NAME = r"(?:^|_)(?:a?rst|a?reset|clr|clear)(?:_?[nb]i?)?(?:_(?:sync|async|n|b|i|o|in|out))*$"
RESET = "(?i)" + RESET_NAME
#: File suffixes, which are case-sensitive, and their languages.
LANGUAGES = {
    "verilog": (".v", ".vh"),
    "systemverilog": (".sv", ".svh"),
    "vhdl": (".vhd", ".vhdl"),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"),
    "python": (".py",),
    "perl": (".pl", ".pm"),
    "tcl": (".tcl", ".sdc", ".upf", ".xdc"),
    "sln": (".sln",),
}


def name_equals(name: Column, language: Column, wanted: str) -> Column:
    """Equality under the rule that stored VHDL names are lower case. The first test can use statistics."""
    return name.isin(wanted, wanted.lower()) & (name == F.when(language == "vhdl", F.lit(wanted.lower())).otherwise(F.lit(wanted)))


def glob_regex(pattern: str) -> str:
    """A case-sensitive glob (*, ?, [...], [!...]) as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] != "!" else i + 3) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append(c if c.isalnum() or c in "_/ " else "\\" + c)
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def glob_matches(subject: Column, pattern: str) -> Column:
    """Glob match whose literal head is a prefix test of its own, which a scan can use."""
    head = pattern[: next((i for i, c in enumerate(pattern) if c in "*?["), len(pattern))]
    full = subject.rlike(glob_regex(pattern))
    return F.startswith(subject, F.lit(head)) & full if head else full


def has_glob(text: Column) -> Column:
    return text.rlike(r"[*?\[]")


def identifiers(text: Column) -> Column:
    """Distinct identifiers of an expression in order, without literals and keywords."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), LITERAL, " ")
    found = F.regexp_extract_all(bare, F.lit(IDENTIFIER), 0)
    return F.array_distinct(F.filter(found, lambda x: ~F.lower(x).isin(*KEYWORDS)))


def is_reset(name: Column) -> Column:
    return name.rlike(RESET)


def label(qualified: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(qualified, F.lit("")), name)


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def pin_leaf(text: Column) -> Column:
    """``a/b/c[0]`` to ``c``."""
    return F.split_part(F.substring_index(text, "/", -1), F.lit("["), F.lit(1))


def language_of(path: Column) -> Column:
    suffix = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    out = F.lit("unknown")
    for language, suffixes in reversed(LANGUAGES.items()):
        out = F.when(suffix.isin(*suffixes), F.lit(language)).otherwise(out)
    return out


def node_kind(id_: Column) -> Column:
    """The kind that an id of any family states, or null."""
    return (
        F.when(id_.rlike(r"^(file|filelist|library|macro):"), F.split_part(id_, F.lit(":"), F.lit(1)))
        .when(id_.rlike(r"^(unresolved|elab):[^:]+:"), F.split_part(id_, F.lit(":"), F.lit(2)))
        .when(id_.rlike(r"::[^:]+:"), F.regexp_extract(id_, r"::([^:]+):", 1))
    )


def node_name(id_: Column) -> Column:
    """The name that an id of any family states, or null."""
    return (
        F.when(id_.rlike(r"^(file|filelist|library|macro):"), F.regexp_extract(id_, r"^[^:]+:(.*)$", 1))
        .when(id_.rlike(r"^(unresolved|elab):[^:]+:"), F.regexp_extract(id_, r"^[^:]+:[^:]+:(.*)$", 1))
        .when(id_.rlike(r"::[^:]+:"), F.regexp_extract(id_, r"::[^:]+:(.*)$", 1))
    )


def names(array: Column) -> Column:
    """An array as one comma-separated text in order."""
    return F.array_join(F.array_sort(array), ",")
