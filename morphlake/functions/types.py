"""Rules on the text of declared types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An optional type, whatever stands before it by full path.
_OPTION = r"^(?:(?:core|std)::option::)?Option<(.*)>$"
#: Spellings that mean the same type, replaced in this order after white space is taken out.
SPELLINGS = (
    ("core::option::Option<", "Option<"),
    ("std::option::Option<", "Option<"),
    ("std::string::String", "String"),
    ("alloc::string::String", "String"),
    ("alloc::vec::Vec<", "Vec<"),
    ("std::vec::Vec<", "Vec<"),
    ("core::primitive::", ""),
)


def _spellings(crates: tuple[str, ...]) -> list[tuple[str, str]]:
    """The spellings in order; types of the given crates (a project's setting) lose the crate's name."""
    return [*SPELLINGS[:2], *((f"{c}::", "") for c in crates), *SPELLINGS[2:]]


def split_option(declared: str) -> tuple[str, bool]:
    """Base type and whether the outermost wrapper makes it optional."""
    m = re.fullmatch(_OPTION[1:-1], declared.strip(), re.S)
    return (m[1].strip(), True) if m else (declared.strip(), False)


def normalize_type(declared: str, crates: tuple[str, ...] = ()) -> str:
    out = "".join(declared.split())
    for old, new in _spellings(crates):
        out = out.replace(old, new)
    return out


def compact(text: str) -> str:
    """A type's text without the blanks beside its brackets and before its commas; one blank elsewhere."""
    return re.sub(r" ?([<>()\[\]]) ?| (?=[,;])|(?<=&) ", r"\1", " ".join(text.split()))


def base_type(declared: Column) -> Column:
    t = F.trim(declared)
    return F.when(t.rlike(_OPTION), F.trim(F.regexp_extract(t, _OPTION, 1))).otherwise(t)


def is_optional(declared: Column) -> Column:
    return F.trim(declared).rlike(_OPTION)


def normalized(declared: Column, crates: tuple[str, ...] = ()) -> Column:
    out = F.regexp_replace(declared, r"\s+", "")
    for old, new in _spellings(crates):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


#: What each base type is in Spark. Types not listed are opaque text.
SPARK_TYPES = {
    "u32": "bigint", "i32": "int", "u64": "decimal(20,0)", "i64": "bigint", "u128": "string", "i128": "decimal(38,0)",
    "f64": "double", "bool": "boolean", "String": "string", "Symbol": "string", "Address": "string", "Bytes": "binary",
}


def spark_type(declared: str) -> str:
    """DDL of a declared type. Optional fields are nullable columns of the base's type."""
    base = normalize_type(split_option(declared)[0])
    if base.startswith("BytesN<"):
        return "binary"
    for head, made in (("Vec<", "array<{}>"), ("Option<", "{}")):
        if base.startswith(head) and base.endswith(">"):
            return made.format(spark_type(base[len(head) : -1]))
    if base.startswith("Map<") and base.endswith(">"):
        depth, inner = 0, base[4:-1]
        for i, c in enumerate(inner):
            depth += (c == "<") - (c == ">")
            if c == "," and not depth:
                return f"map<{spark_type(inner[:i])},{spark_type(inner[i + 1:])}>"
    return SPARK_TYPES.get(base, "string")
