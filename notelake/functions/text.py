"""Column functions on text that Spark does not have under one name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0            "
    "    　"
)


def trimmed(c: Column | str) -> Column:
    """Without leading and trailing Unicode white space (``trim`` alone knows only U+0020)."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE))


def not_blank(c: Column | str) -> Column:
    """True where the text has a character that is no white space; false for null."""
    return F.coalesce(F.length(trimmed(c)) > 0, F.lit(False))


def title_of(key: Column | str) -> Column:
    """Last segment of a key without one ``.md`` suffix."""
    c = F.col(key) if isinstance(key, str) else key
    return F.regexp_replace(F.substring_index(c, "/", -1), r"\.md$", "")
