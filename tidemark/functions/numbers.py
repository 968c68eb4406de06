"""Numbers held as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
# The common form, read without the look for underscores.
_PLAIN = r"^-?\d++(?:\.\d++)?\z"


def parse_number(t: Column) -> Column:
    """Stripped text to double, NULL when it is not a number.

    The pattern guards the cast, which on its own would also take type suffixes ('1d').
    """
    return (
        F.when(t.rlike(_PLAIN), t.try_cast("double"))
        .when(t.rlike(_NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
        .when(t.rlike(r"(?i)^[+-]?inf(inity)?$"), t.try_cast("double"))
        .when(t.rlike(r"(?i)^[+-]?nan$"), F.lit(float("nan")))
    )


def number_text(c: Column) -> Column:
    """Shortest decimal text of a double, in the form used inside failure messages.

    Java switches to scientific notation outside [1e-3, 1e7); the messages only do so outside
    [1e-4, 1e16) and write the exponent with a sign and two digits.
    """
    java = c.cast("string")
    size = F.abs(c)
    mantissa = F.regexp_replace(F.split_part(java, F.lit("E"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(java, F.lit("E"), F.lit(2)).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.format_string("%02d", F.abs(exponent)),
    )
    plain = F.regexp_replace(
        java.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1"
    )
    return (
        F.when(c.isNull(), F.lit("None"))
        .when(F.isnan(c), F.lit("nan"))
        .when(size == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((c == 0) | ((size >= 1e-3) & (size < 1e7)), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )
