"""Text columns: whitespace, categories, boroughs, addresses, ZIPs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed

# Everything that counts as white space: the ASCII and Unicode blanks, line ends and separators.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"[\s\x{1c}-\x{1f}]"
# Cheap test for text that needs no tidying: single blanks between words of the ranges that hold no
# white space. Nothing in it is tried twice.
_TIDY = r"^(?:[!-~\x{a1}-\x{167f}]++(?: [!-~\x{a1}-\x{167f}]++)*+)?+\z"


def literal_map(pairs: list[tuple[str, str]]) -> Column:
    """A constant map, written as SQL text so that building it is one call."""
    return F.expr("map(" + ", ".join(f"'{text}'" for pair in pairs for text in pair) + ")")


def strip(c: Column) -> Column:
    """No white space at the ends. Text that starts and ends in plain ASCII is passed on as it is."""
    tidy = F.ascii(c).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)
    return F.when(tidy, c).otherwise(F.trim(c, F.lit(WHITE_SPACE)))


def collapse_spaces(c: Column) -> Column:
    """Every white-space run becomes one space; none at the ends. Tidy text is not rebuilt."""
    return F.when(c.rlike(_TIDY), c).otherwise(F.trim(F.regexp_replace(c, f"(?U){_SPACE}+", " ")))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def cut(collapsed: Column, max_len: int | None = None) -> Column:
    """NULL when empty; at most ``max_len`` characters if given."""
    filled = F.nullif(collapsed, F.lit(""))
    return filled if max_len is None else F.substring(filled, 1, max_len)


def clean_text(c: Column, max_len: int | None = None) -> Column:
    """Collapsed text, NULL when blank; at most ``max_len`` characters if given."""
    return cut(collapse_spaces(c), max_len)


def category_key(collapsed: Column) -> Column:
    """Upper-case label, the form the alias table is keyed by; empty stays empty."""
    return F.upper(collapsed)


def borough_name(collapsed: Column) -> Column:
    """Canonical borough; anything unknown, empty or 'Unspecified…' is NULL."""
    return F.try_element_at(literal_map(fixed.BOROUGH_SPELLINGS), F.upper(collapsed))


def zip_digits(c: Column) -> Column:
    """First five digits of a ZIP or ZIP+4, empty text when it is neither."""
    return F.regexp_extract(c, rf"(?U)^{_SPACE}*(\d{{5}})(?:{_SPACE}*-?{_SPACE}*\d{{4}})?{_SPACE}*$", 1)


def zip5(digits: Column) -> Column:
    """The digits, or NULL when there are none or all are zero."""
    return F.when(~digits.isin("", "00000"), digits)


def address_key(c: Column) -> Column:
    """Street address reduced to one comparable spelling.

    Upper case, punctuation to spaces, ordinals to plain numbers, then each word replaced by
    its short form. Empty when nothing is left.
    """
    upper = F.upper(c)
    words = F.when(upper.rlike(r"^[A-Z0-9]++(?: [A-Z0-9]++)*+\z"), upper).otherwise(
        F.trim(F.regexp_replace(upper, r"[^A-Z0-9]+", " "))
    )
    # Each word between blanks of its own. No short form is itself a word to be shortened.
    apart = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    apart = F.regexp_replace(apart, r" ([0-9]++)(?:ST|ND|RD|TH)(?= )", " $1")
    for long, short in fixed.ADDRESS_WORDS:
        apart = F.replace(apart, F.lit(f" {long} "), F.lit(f" {short} "))
    return F.trim(F.replace(apart, F.lit("  "), F.lit(" ")))
