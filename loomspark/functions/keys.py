"""Keys that are written in different ways by different clients."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.unicode import strip


def hex_key(c: Column | str) -> Column:
    """The hexadecimal digits of a key in lower case; all other characters are removed.

    Null and blank keys mean "no key" and give null. A key that isn't blank
    but holds no hexadecimal digit gives the empty string.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.when(strip(c) != "", F.regexp_replace(F.lower(c), "[^0-9a-f]", ""))
