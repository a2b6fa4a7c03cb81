"""Small column helpers that the other function modules share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters that Unicode calls white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The same as content of a regular expression's character class.
BLANK = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rx(c, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null where it doesn't match or is empty."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def group_of(c, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, '' where the group is empty and null where the whole doesn't match."""
    return F.when(col(c).rlike(pattern), F.regexp_extract(col(c), pattern, group))


def lower_ascii(c) -> Column:
    """Lower case for A-Z only."""
    return F.translate(col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def replace_all(c, pattern: str, by: str) -> Column:
    return F.regexp_replace(col(c), F.lit(pattern), F.lit(by))


def trim(c) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(col(c), F.lit(SPACES))
