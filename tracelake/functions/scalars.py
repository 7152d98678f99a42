"""Column functions: classes, ranges, names, text and hashes.  All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mode of each kind of edge.
EDGE_MODES = {
    "structure": ["instantiate", "implements", "contains", "import", "control", "structure", "instance-child"],
    "data-flow": [
        "read", "write", "invoke", "return", "value", "producer", "consumer", "access", "call", "data",
        "payload", "state-read", "state-write", "constructor-binding", "interface-forward",
    ],
    "scheduling": [
        "conflict", "conflict-free", "sequential-before", "sequential-before-reverse",
        "mutually-exclusive", "descending-urgency", "execution-order", "preempts",
        "potential-state-dependency",
    ],
}
# By what a primitive's type (in any case) or constructor is known.
PRIMITIVES = {
    "memory": (r"\b(?:BRAM|RegFile|RAM|ROM)\b", r"^mk(?:BRAM|RegFile|RAM|ROM)"),
    "register": (r"^Reg\s*#", r"^mk(?:C?Reg|DReg)"),
    "fifo": (r"\bFIFOF?\s*#", r"^mk(?:Sized|Pipeline|Bypass)?FIFOF?"),
    "wire": (r"\b(?:Wire|RWire|PulseWire)\b", r"^mk(?:Bypass)?(?:R?Wire|PulseWire)"),
}


def edge_mode(kind: Column, mode: Column | None = None) -> Column:
    """structure, data-flow or scheduling, null for a kind that is none of these; a mode that is given and known wins."""
    by_kind = F.coalesce(*(F.when(kind.isin(*kinds), name) for name, kinds in EDGE_MODES.items()))
    return by_kind if mode is None else F.coalesce(F.when(mode.isin(*EDGE_MODES), mode), by_kind)


def in_range(line: Column, column: Column, r: Column, inclusive_end: bool = False) -> Column:
    """Is a position inside a range (line, col, end_line, end_col)?  Half-open unless told otherwise."""
    after = (line > r["line"]) | ((line == r["line"]) & (column >= r["col"]))
    last = column <= r["end_col"] if inclusive_end else column < r["end_col"]
    return after & ((line < r["end_line"]) | ((line == r["end_line"]) & last))


def range_weight(r: Column) -> Column:
    """Smaller for smaller ranges: lines first, then columns."""
    columns = F.when(r["line"] == r["end_line"], r["end_col"] - r["col"]).otherwise(r["end_col"])
    return (r["end_line"] - r["line"]) * F.lit(1_000_000) + columns


def signed_condition(value: Column) -> Column:
    """id and negated of a condition id that ! negates."""
    negated = value.startswith("!")
    return F.struct(F.when(negated, F.substr(value, F.lit(2))).otherwise(value).alias("id"), negated.alias("negated"))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shortened(text: Column, length: int = 160) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 1), F.lit("…"))).otherwise(text)


def glob(pattern: str) -> str:
    """A regular expression for a path pattern: ** crosses folders, * and ? do not; upper and lower case do not differ.  **/x wants a folder before x."""
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "(?i)^" + "".join(parts.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*|\?)", pattern) if p) + "$"


def path_group(path: Column, globs: list[tuple[str, str]]) -> Column:
    """The group of the first glob that matches; else the folder after the last src, else the last folder, else root."""
    path = F.translate(path, "\\", "/")
    folders = F.array_remove(F.split(F.regexp_replace(path, "[^/]*$", ""), "/"), "")
    behind = F.array_position(F.reverse(folders), "src")  # 1: src is the last folder
    out = F.when(behind > 1, F.get(folders, F.size(folders) - behind.cast("int") + 1)).when(F.size(folders) > 0, F.element_at(folders, -1)).otherwise("root")
    for pattern, group in reversed(globs):
        out = F.when(path.rlike(glob(pattern)), group).otherwise(out)
    return out


def primitive_kind(type_: Column, constructor: Column) -> Column:
    """memory, register, fifo or wire by the first whose type or constructor it is, else null."""
    type_, constructor = F.coalesce(type_, F.lit("")), F.coalesce(constructor, F.lit(""))
    return F.coalesce(*(F.when(type_.rlike("(?i)" + t) | constructor.rlike(c), kind) for kind, (t, c) in PRIMITIVES.items()))


def method_class(return_type: Column) -> Column:
    """Action is an input, ActionValue#(...) a request-response, any other type an output; no type is unknown."""
    kind = squeezed(F.coalesce(return_type, F.lit("")))
    return F.when(kind.rlike(r"(?i)^ActionValue\s*#"), "request-response").when(F.lower(kind) == "action", "input").when(kind != "", "output").otherwise("unknown")


def identifiers(text: Column, keywords: list[str] | None = None) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, keywords))) if keywords else found


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON record with its keys in order; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def binary_parameter(value: Column) -> Column:
    """An integer, or a string of binary digits of at most 53, as a bigint; else null."""
    binary = F.conv(value, 2, 10).try_cast("bigint")
    return F.when(value.rlike("^[01]{2,53}$"), binary).otherwise(value.try_cast("bigint"))


def multiplicity(dimensions: Column) -> Column:
    """status and count of a family: exact if all dimensions are numbers, else parameterized; unresolved without any."""
    numbers = F.transform(dimensions, lambda x: x.try_cast("bigint"))
    exact = F.forall(numbers, lambda x: x.isNotNull())
    product = F.aggregate(numbers, F.lit(1).cast("bigint"), lambda a, x: a * x)
    return F.struct(F.when(F.size(dimensions) == 0, "unresolved").when(exact, "exact").otherwise("parameterized").alias("status"), F.when((F.size(dimensions) > 0) & exact, product).alias("count"))
