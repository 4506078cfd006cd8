"""Export form of rows, derived from the schema."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_FORMAT = "yyyy-MM-dd"


def _render(column: Column, kind: T.DataType, nullable: bool) -> Column:
    if isinstance(kind, T.StructType):
        # a missing object becomes an object of empty values, so that the shape stays the same
        return F.struct(
            *[_render(column[f.name], f.dataType, True).alias(f.name) for f in kind.fields]
        )
    if isinstance(kind, T.ArrayType):
        items = F.transform(column, lambda x: _render(x, kind.elementType, kind.containsNull))
        return F.coalesce(items, F.array().cast(_rendered_type(kind)))
    if isinstance(kind, T.MapType):
        values = F.transform_values(column, lambda _, v: _render(v, kind.valueType, kind.valueContainsNull))
        none = F.create_map().cast(T.MapType(kind.keyType, _type(kind.valueType, kind.valueContainsNull)))
        return F.coalesce(values, none)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(column, DATE_FORMAT)
    elif isinstance(kind, T.DecimalType):
        column = column.cast("decimal(38,0)") if kind.scale == 0 else _whole(column, kind)
        text = column.cast("string")
    else:
        text = column.cast("string")
    numeric = isinstance(kind, (T.NumericType, T.BooleanType))
    return column if numeric and not nullable else F.coalesce(text, F.lit(""))


def _whole(column: Column, kind: T.DecimalType) -> Column:
    """Cut the fraction off, towards zero."""
    if kind.precision - kind.scale <= 18:
        return column.cast("bigint")
    return F.when(column < 0, F.ceil(column)).otherwise(F.floor(column)).cast("decimal(38,0)")


def _rendered_type(kind: T.ArrayType) -> T.ArrayType:
    return T.ArrayType(_type(kind.elementType, kind.containsNull))


def _type(kind: T.DataType, nullable: bool) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _type(f.dataType, True)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return _rendered_type(kind)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _type(kind.valueType, kind.valueContainsNull))
    if isinstance(kind, (T.NumericType, T.BooleanType)) and not nullable:
        if not isinstance(kind, T.DecimalType):
            return kind
        small = kind.scale > 0 and kind.precision - kind.scale <= 18
        return T.LongType() if small else T.DecimalType(38, 0)
    return T.StringType()


def render_rows(df: DataFrame, required: Collection[str] = ()) -> DataFrame:
    """Rows as they leave the system.

    Decimals lose their fraction, moments and dates become ``yyyy-MM-dd``, NULL becomes ``""``, nested
    objects and lists likewise. A column has one type, so numbers that may be NULL come out as text;
    numeric columns named in ``required`` are never NULL and stay numbers.
    """
    return df.select(
        *[
            _render(F.col(f"`{f.name}`"), f.dataType, f.nullable and f.name not in required).alias(f.name)
            for f in df.schema.fields
        ]
    )
