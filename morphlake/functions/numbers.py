"""Progress, paging and report arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys in a page of the log, default and largest strict batch, whole progress in basis points.
PAGE, DEFAULT_BATCH, LARGEST_BATCH, WHOLE = 32, 100, 150, 10_000


def page_of(pos: Column) -> Column:
    return F.floor(pos / PAGE).cast("bigint")


def offset_in_page(pos: Column) -> Column:
    return (pos % PAGE).cast("bigint")


def footprint(length: Column) -> Column:
    """Entries that a log of this length takes: its pages and its summary; none if it is empty."""
    return F.when(length == 0, 0).otherwise(F.ceil(length / PAGE) + 1).cast("bigint")


def progress_bp(cursor: Column, total: Column) -> Column:
    done = F.least(cursor, total) * WHOLE
    return F.when(total == 0, F.lit(WHOLE)).otherwise(F.floor(done / F.when(total != 0, total))).cast("bigint")


def remaining(cursor: Column, total: Column) -> Column:
    return F.greatest(total - cursor, F.lit(0)).cast("bigint")


def transactions_needed(rows: Column, batch: Column) -> Column:
    return F.when(batch == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(rows / F.when(batch != 0, batch)))).cast("bigint")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def percent_of(value: int, cap: int) -> str:
    """One decimal, ties to even as in C; n/a without a cap."""
    return "n/a" if cap == 0 else f"{100 * value / cap:.1f}%"


def suffix_stem(name: Column) -> Column:
    """What comes before a version suffix (V and digits), else null."""
    return F.nullif(F.regexp_extract(name, r"^(.+)V([0-9]+)$", 1), F.lit(""))


def version_stem(name: str) -> str | None:
    """The same of one name."""
    m = re.fullmatch(r"(.+)V([0-9]+)", name)
    return m[1] if m else None


def join_versions(versions: list[int]) -> str:
    """none, or a list, or a range if it is more than two in a row."""
    v = sorted(versions)
    if not v:
        return "none"
    return f"{v[0]}-{v[-1]}" if len(v) > 2 and v[-1] - v[0] + 1 == len(v) else ", ".join(map(str, v))


def looks_like_contract(value: Column) -> Column:
    return value.rlike("^C[A-Z0-9]{55}$")


def is_unfilled(text: Column) -> Column:
    return F.ltrim(text).startswith("<TODO")


def is_null_text(text: Column) -> Column:
    return F.trim(text).isin("", "null")
