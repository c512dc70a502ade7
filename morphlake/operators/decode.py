"""Reading rows of an old shape through a new one.

A missing optional field is null, an extra one is dropped, a missing required one is an error
(strict) or marks the row (skip).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.functions.numbers import is_null_text
from morphlake.functions.types import spark_type
from morphlake.plans.model import Shape


def decode(rows: DataFrame, shape: Shape, mode: str = "strict", keep: tuple[str, ...] = ()) -> DataFrame:
    """rows in the new shape. mode skip adds _decode_ok in place of failing."""
    there = set(rows.columns)
    columns, ok = [], F.lit(True)
    for f in shape.fields:
        c = F.col(f.name).cast(spark_type(f.declared)) if f.name in there else F.lit(None).cast(spark_type(f.declared))
        if not f.optional:
            if mode == "strict":
                # the check wraps the value itself, so that pruning can't part them
                c = F.when(c.isNull(), F.raise_error(F.lit(f"{shape.name} v{shape.version}: {f.name} is missing")).cast(spark_type(f.declared))).otherwise(c)
            ok = ok & c.isNotNull()
        columns.append(c.alias(f.name))
    out = rows.select(*keep, *columns, *([ok.alias("_decode_ok")] if mode == "skip" else []))
    return out


def decode_json(rows: DataFrame, column: str, shape: Shape, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of a JSON text by name; what can't be read as its type is null, _decode_ok tells."""
    value = F.from_json(column, shape.struct(), {"mode": "PERMISSIVE"})
    out = rows.select(*keep, value.alias("__v")).select(*keep, *[F.col(f"__v.{f.name}").alias(f.name) for f in shape.fields])
    ok = F.lit(True)
    for f in shape.fields:
        if not f.optional:
            ok = ok & F.col(f.name).isNotNull()
    return out.withColumn("_decode_ok", ok)


def decode_variant(rows: DataFrame, column: str, shape: Shape, mode: str = "strict", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of a VARIANT by name, each as its type. What is missing or of another type is null; for a required field that is
    an error (strict) or marks the row (skip), as in decode."""
    value = F.col(column)
    taken = [F.try_variant_get(value, f"$['{f.name}']", spark_type(f.declared)).alias(f.name) for f in shape.fields]
    return decode(rows.select(*keep, *taken), shape, mode, keep)


def json_field(column: Column, name: str, kind: str) -> Column:
    """A field of a JSON text as its type; an error that names the field where it is missing or
    something else. Numbers may be quoted."""
    value = F.get_json_object(column, f"$.{name}").try_cast(kind)
    message = F.concat(F.lit(f"{name} is missing or not {kind} in "), F.coalesce(column, F.lit("null")))
    return F.when(value.isNull(), F.raise_error(message).cast(kind)).otherwise(value)


def optional_number(text: Column) -> Column:
    """A number in a text, quoted or not; null for a blank text and for null."""
    plain = F.trim(text, F.lit('" \t\r\n'))
    value = plain.try_cast("bigint")
    return F.when(text.isNull() | is_null_text(plain), F.lit(None).cast("bigint")).otherwise(F.coalesce(value, F.raise_error(F.concat(F.lit("not a number: "), text)).cast("bigint")))


def status_view(rows: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A recorded migration's state from its JSON text, with whether it is active."""
    c = F.col(column)
    numbers = [json_field(c, n, "bigint").alias(n) for n in ("from", "to", "cursor", "total")]
    status = json_field(c, "status", "string")
    return rows.select(*keep, *numbers, status.alias("status"), status.isin("Running", "RollingBack").alias("active"))


def validate(rows: DataFrame, shape: Shape) -> int:
    """How many rows lack a required field: an explicit count, before anything is committed."""
    return decode(rows, shape, "skip").filter("NOT _decode_ok").count()
