"""Logical type vocabulary and type widening."""

from __future__ import annotations

from pyspark.sql import types as T

_LOGICAL = (
    (T.IntegralType, "int"),
    (T.FractionalType, "float"),
    (T.BooleanType, "bool"),
    (T.StringType, "string"),
    (T.DateType, "date"),
    (T.TimestampType, "timestamp"),
    (T.TimestampNTZType, "timestamp"),
    (T.ArrayType, "array"),
    (T.StructType, "struct"),
    (T.MapType, "map"),
    (T.BinaryType, "binary"),
)


def logical_type(data_type: T.DataType) -> str:
    """Short type name used in profiles, independent of widths and precision."""
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    for cls, name in _LOGICAL:
        if isinstance(data_type, cls):
            return name
    return data_type.typeName()


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Type that holds the values of both columns when two sources are stacked.

    Equal types stay; numbers widen; dates and timestamps become timestamps;
    anything else is stacked as text, so no cast can fail at run time.
    """
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if is_numeric(a) and is_numeric(b):
        return _common_numeric(a, b)
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, temporal) and isinstance(b, temporal):
        if T.TimestampType() in (a, b):
            return T.TimestampType()
        return T.TimestampNTZType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType), True)
    return T.StringType()


def _common_numeric(a: T.DataType, b: T.DataType) -> T.DataType:
    integral = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return integral[max(integral.index(a), integral.index(b))]
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        exact = [_as_decimal(x) for x in (a, b)]
        if None not in exact:
            scale = max(d.scale for d in exact)
            whole = max(d.precision - d.scale for d in exact)
            if whole + scale <= 38:
                return T.DecimalType(whole + scale, scale)
    return T.DoubleType()


def _as_decimal(t: T.DataType) -> T.DecimalType | None:
    if isinstance(t, T.DecimalType):
        return t
    digits = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 20}
    return T.DecimalType(digits[t], 0) if t in digits else None
