"""Trimming that matches Unicode white space; Spark's own ``trim`` removes blanks only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the Unicode White_Space characters
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680\u2000\u2001\u2002"
    "\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f"
    "\u3000"
)


def trim(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE))


def ltrim(c: Column | str) -> Column:
    return F.ltrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE))
