"""Normal forms: values that are equal get the same form, and no others, whatever their types.

Numbers compare by exact value, instants by microseconds, dates and local times by the clock; text for display is
made elsewhere.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
#: Beyond this a double does not fit into decimal(38,0); all such doubles are whole and none equals a decimal.
LARGEST = 1e38


def _whole_text(x: Column) -> Column:
    """The digits of a whole double below 1e38, exact: three pieces of 64, 32 and 32 bits."""
    size = F.abs(x)
    high = F.floor(size / 2.0 ** 64)
    low = size - high.cast("double") * 2.0 ** 64
    middle = F.floor(low / 2.0 ** 32)
    last = low - middle.cast("double") * 2.0 ** 32
    wide = lambda c: c.cast("decimal(20,0)")
    digits = (wide(high).cast("decimal(38,0)") * F.lit(2 ** 32).cast("decimal(10,0)")).cast("decimal(38,0)") + wide(middle)
    digits = (digits.cast("decimal(38,0)") * F.lit(2 ** 32).cast("decimal(10,0)")).cast("decimal(38,0)") + wide(last)
    text = digits.cast("decimal(38,0)").cast("string")
    return F.when((x < 0) & (text != "0"), F.concat(F.lit("-"), text)).otherwise(text)


def double_form(x: Column) -> Column:
    """Whole values by their digits, others by the shortest text that gives the double back; -0.0 is 0."""
    x = x.cast("double")
    whole = (F.abs(x) < LARGEST) & (x == F.rint(x))
    return F.when(whole, _whole_text(x)).otherwise(F.concat(F.lit("f"), x.cast("string")))


def decimal_form(d: Column, scale: int) -> Column:
    """The form of a double where one has exactly this value, else the digits."""
    digits = F.regexp_replace(d.cast("string"), r"\.?0+\z", "") if scale else d.cast("string")
    if not scale:
        return digits
    # d = n / 10^s is a double only if 5^s divides n; then d = (n / 5^s) / 2^s
    n = F.regexp_replace(d.cast("string"), r"\.", "").cast("decimal(38,0)")
    if 5 ** scale >= 10 ** 38:
        exact = F.lit(False)
    else:
        five = F.lit(str(5 ** scale)).cast("decimal(38,0)")
        quotient = ((n - n % five) / five).cast("decimal(38,0)")
        exact = (n % five == 0) & (quotient.cast("string") == _whole_text(d.cast("double") * 2.0 ** scale))
    return F.when(d == F.floor(d), d.cast("decimal(38,0)").cast("string")).when(
        exact, F.concat(F.lit("f"), d.cast("double").cast("string"))).otherwise(F.concat(F.lit("d"), digits))


def number_form(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, FLOATING):
        return double_form(c)
    if isinstance(data_type, T.DecimalType):
        return decimal_form(c, data_type.scale)
    return c.cast("string")


def comparable(a: T.DataType, b: T.DataType) -> bool:
    """Whether keys of both types can be equal at all."""
    both = lambda kinds: isinstance(a, kinds) and isinstance(b, kinds)
    return a == b or both(T.NumericType) or both(TIMES)


def key_forms(a: T.DataType, b: T.DataType):
    """How the keys of two comparable types are written as text so that equal keys and only those have the same."""
    def form(c: Column, own: T.DataType) -> Column:
        if isinstance(own, T.NumericType):
            return c.cast("string") if isinstance(a, WHOLE) and isinstance(b, WHOLE) or a == b and isinstance(a, T.DecimalType) else number_form(c, own)
        if isinstance(own, TIMES):
            # a date is its midnight; with an instant on either side the clock of the session says which instant that is
            if isinstance(a, T.TimestampType) or isinstance(b, T.TimestampType):
                return F.unix_micros(c.cast("timestamp")).cast("string")
            return c.cast("timestamp_ntz").cast("string")
        if isinstance(own, T.BinaryType):
            return F.hex(c)
        if isinstance(own, NESTED):
            return F.to_json(F.struct(c.alias("v")))
        return c.cast("string")
    return lambda c: form(c, a), lambda c: form(c, b)


def _has(data_type: T.DataType, kinds) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _has(data_type.elementType, kinds)
    if isinstance(data_type, T.StructType):
        return any(_has(f.dataType, kinds) for f in data_type.fields)
    return isinstance(data_type, kinds)


def _one_zero(c: Column, data_type: T.DataType) -> Column:
    """Nested values with every -0.0 written as 0.0."""
    if not _has(data_type, FLOATING):
        return c
    if isinstance(data_type, T.ArrayType):
        return F.transform(c, lambda x: _one_zero(x, data_type.elementType))
    if isinstance(data_type, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_one_zero(c[f.name], f.dataType).alias(f.name) for f in data_type.fields]))
    return c + F.lit(0.0).cast(data_type)


def cell_form(c: Column, data_type: T.DataType) -> Column:
    """A cell for comparing rows of one table: NaN as NULL, one zero, instants as microseconds, nested values as JSON.

    Keeps simple types, so that it can be hashed without making text.
    """
    if isinstance(data_type, FLOATING):
        return F.nanvl(c, F.lit(None).cast(data_type)) + F.lit(0.0).cast(data_type)
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(data_type, NESTED):
        return F.when(c.isNotNull(), F.to_json(_one_zero(c, data_type)))
    return c
