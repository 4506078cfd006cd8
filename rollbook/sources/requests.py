"""JSON requests: parse, check against a declaration, split into accepted and rejected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each declared kind looks like to Spark, as the leading word of a JSON value's type.
KINDS = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "list": ("ARRAY",),
    "object": ("OBJECT",),
}


@dataclass(frozen=True)
class Param:
    """One declared request parameter.

    ``kind`` is the JSON type a value must have, or ``int`` for anything that reads as a whole number
    (fractions of numbers are cut off, texts must be whole). ``default`` makes it optional.
    """

    name: str
    kind: str | None = None
    required: bool = True
    default: object = None
    allowed: Sequence[object] | None = None


def _number(text: Column, shape: Column) -> Column:
    """What reads as a whole number: fractions of numbers are cut off, texts must be whole."""
    digits = F.trim(text)
    return (
        F.when(shape.isin("DECIMAL", "DOUBLE", "FLOAT"), text.try_cast("double").try_cast("bigint"))
        .when(shape == "BOOLEAN", text.try_cast("boolean").cast("bigint"))
        .when(digits.rlike(r"^[+-]?[0-9]+$"), digits.try_cast("bigint"))
    )


def _checks(param: Param, text: Column, shape: Column) -> tuple[Column, list[Column]]:
    """The value, as text or bigint, and the complaints about it, NULL where there is none.

    ``shape`` is the JSON type of the value: NULL where it is absent, ``VOID`` where it is null.
    """
    absent, optional = shape.isNull(), not param.required or param.default is not None
    if param.default is not None:
        text = F.when(absent, F.lit(str(param.default))).otherwise(text)
    problems = []
    value = text
    if param.kind == "int":
        value = _number(text, F.coalesce(shape, F.lit("STRING")))
        if param.required or param.default is not None:
            problems.append(F.when(text.isNull(), f"{param.name}: required"))
        problems.append(F.when(text.isNotNull() & value.isNull(), f"{param.name}: not an integer"))
    else:
        if not optional:
            problems.append(F.when(absent, f"{param.name}: required"))
        if param.kind is not None:
            wrong = ~shape.isin("VOID", *KINDS[param.kind])
            problems.append(F.when(wrong, f"{param.name}: wrong type"))
    if param.allowed is not None:
        choices = [str(a) for a in param.allowed if a is not None]
        fits = F.coalesce(value.cast("string").isin(*choices), F.lit(None in param.allowed))
        # a missing required parameter is reported once
        asked = F.lit(optional) | ~absent
        problems.append(F.when(asked & ~fits, f"{param.name}: value not allowed"))
    return value, problems


def validate_requests(
    df: DataFrame, body: str, params: Sequence[Param], strict: bool = True, presence: bool = False
) -> DataFrame:
    """Add one column per declared parameter and ``reasons``, the list of everything wrong.

    ``strict`` also refuses parameters that were not declared. A body that is no JSON object is
    ``malformed`` and gets no further complaint. ``presence`` adds ``_has_<name>``: whether the body names the
    parameter, be it as null.
    """
    columns = df.columns
    json = F.try_parse_json(F.col(body))
    # what parses and opens with a bracket is an object; its names come from the parsed body
    opens = F.ltrim(F.col(body), F.lit(" \t\r\n")).startswith("{")
    df = df.withColumn("_json", json).withColumn("_object", F.col("_json").isNotNull() & opens)
    if strict:
        df = df.withColumn("_keys", F.map_keys(F.try_variant_get("_json", "$", "map<string,variant>")))
    # in steps, so that every value is read from the body once
    values = {f"_value_{p.name}": F.try_variant_get("_json", f"$.{p.name}", "variant") for p in params}
    df = df.withColumns(values)
    parts = {}
    for p in params:
        value = F.col(f"_value_{p.name}")
        # the type is looked at only where one is declared
        shape = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0) if p.kind else F.lit("VOID")
        parts[f"_text_{p.name}"] = F.try_variant_get(value, "$", "string")
        parts[f"_shape_{p.name}"] = F.when(value.isNotNull(), shape)
    # A filter on the reasons must not carry the parsing down with it and repeat it per condition; it
    # stays above a generated row.
    extracted = [e.alias(name) for name, e in parts.items()]
    malformed = (~F.coalesce("_object", F.lit(False))).alias("_malformed")
    row = F.struct(*(["_keys"] if strict else []), malformed, *extracted)
    df = df.select(*columns, F.inline(F.array(row)))
    parsed = {p.name: _checks(p, F.col(f"_text_{p.name}"), F.col(f"_shape_{p.name}")) for p in params}
    problems = [problem for _, found in parsed.values() for problem in found]
    if strict:
        declared = F.array(*[F.lit(p.name) for p in params])
        unknown = F.array_sort(F.array_except("_keys", declared))
        unknown = F.transform(unknown, lambda k: F.concat(k, F.lit(": unknown")))
    else:
        unknown = F.array().cast("array<string>")
    reasons = F.when(F.col("_malformed"), F.array(F.lit("malformed"))).otherwise(
        F.concat(F.array_compact(F.array(*problems)), unknown)
    )
    kept = [F.col(c) for c in columns if c not in parsed]
    named = [F.col(f"_shape_{p.name}").isNotNull().alias(f"_has_{p.name}") for p in params if presence]
    return df.select(*kept, *[v.alias(n) for n, (v, _) in parsed.items()], *named, reasons.alias("reasons"))


def split_requests(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted requests and rejected ones, the latter with their reasons."""
    fine = F.size("reasons") == 0
    return validated.where(fine).drop("reasons"), validated.where(~fine)
