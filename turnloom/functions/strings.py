"""String clean-up with the exact character sets of Python's ``str.strip``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that ``str.strip()`` removes.
PYTHON_WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """``str.strip()``. Spark's own ``trim`` removes U+0020 only."""
    return F.btrim(col, F.lit(PYTHON_WHITESPACE))


def strip_newlines(col: Column) -> Column:
    """``str.strip("\\n")``: line feeds only, spaces stay."""
    return F.btrim(col, F.lit("\n"))
