"""Scalar functions (X1-X10), all built-in Spark expressions (no Python UDF)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._names import as_list, col, value
from ..constants import MATCH_NO, MATCH_YES, UNKNOWN


def _c(x: str | Column) -> Column:
    return col(x) if isinstance(x, str) else x


# X1 -------------------------------------------------------------------------

def suffix_year(name: str, pattern: str = r"\((?:[A-Za-z]*)(\d{4})\)\s*$") -> int | None:
    """X1 at plan time: the year inside the last parenthesised group of a column name."""
    m = re.search(pattern, name)
    return int(m.group(1)) if m else None


def suffix_year_col(c: str | Column) -> Column:
    """X1 on data: the year in the last ``(..yyyy)`` group of a text value, else NULL."""
    y = F.regexp_extract(_c(c), r"\(([A-Za-z]*)(\d{4})\)\s*$", 2)
    return F.when(y == "", F.lit(None)).otherwise(y.cast("int"))


def strip_year_suffix_col(c: str | Column) -> Column:
    """X1 companion: the text before the last ``(..yyyy)`` group."""
    return F.regexp_replace(_c(c), r"\s*\([A-Za-z]*\d{4}\)\s*$", "")


# X2-X5 --------------------------------------------------------------------

def last_of(c: str | Column, sep: str = " of ") -> Column:
    """Text after the last ``sep`` (``Department of Energy`` -> ``Energy``); unchanged
    when ``sep`` is absent."""
    return F.substring_index(_c(c), sep, -1)


def zero_pad(c: str | Column, width: int = 2) -> Column:
    """Left-pad with zeros to ``width``; longer values are kept whole (``lpad`` alone
    would cut them)."""
    s = _c(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def percent_text(share: str | Column, decimals: int = 1) -> Column:
    """Share (0..1) as percent text, e.g. ``12.5%``.  Half-even rounding of the percent
    first, as numpy's ``round`` does."""
    pct = F.bround(_c(share) * 100, decimals)
    return F.concat(F.format_string(f"%.{decimals}f", pct), F.lit("%"))


def money_text(x: str | Column, decimals: int = 0) -> Column:
    """Money text ``$1,234,568``."""
    return F.concat(F.lit("$"), F.format_number(_c(x), decimals))


# X6-X10 -------------------------------------------------------------------

def code_labels(c: str | Column, labels: Mapping) -> Column:
    """Code to label through a literal map; an unlisted code gives NULL."""
    pairs = []
    for k, v in labels.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), _c(c))


def fill_unknown(df: DataFrame, columns: Sequence[str], value: str = UNKNOWN) -> DataFrame:
    """Fill NULLs with a constant.  String columns are filled as text; a numeric column
    takes the constant in its own type when it is a number, and otherwise becomes a text
    column filled with it (as a pandas column turns to objects when filled with text)."""
    out = {}
    for c in as_list(columns):
        dt = df.schema[c].dataType
        if isinstance(dt, T.StringType):
            out[c] = F.coalesce(col(c), F.lit(value))
        elif _is_number(value):
            out[c] = F.coalesce(col(c), F.lit(value).cast(dt))
        else:
            out[c] = F.coalesce(col(c).cast("string"), F.lit(str(value)))
    return df.withColumns(out)


def _is_number(v) -> bool:
    try:
        float(v)
        return True
    except (TypeError, ValueError):
        return False


def match_flag(a: str | Column, b: str | Column, yes=MATCH_YES, no=MATCH_NO) -> Column:
    """``yes`` when equal, else ``no`` (NULL on either side is ``no``)."""
    return F.when(_c(a) == _c(b), F.lit(yes)).otherwise(F.lit(no))


def match_int(a: str | Column, b: str | Column) -> Column:
    """X9, 1/0 form."""
    return match_flag(a, b, 1, 0)


def target_value(df: DataFrame, key: str, target, columns: Sequence[str], default=None,
                 prefix: str = "target_") -> DataFrame:
    """One-row DataFrame with the target's value of each column, or ``default`` when the
    target is absent (a target that is present with a NULL value gives NULL).  The filter
    on the key reaches the scan; the aggregate over what is left is one row, so it can be
    broadcast back."""
    cols = as_list(columns)
    one = df.where(col(key) == value(target)).agg(F.count(F.lit(1)).alias("__present"), *[F.max(col(c)).alias(c) for c in cols])
    if default is None:
        return one.select(*[col(c).alias(f"{prefix}{c}") for c in cols])
    text = isinstance(default, str)
    return one.select(*[F.when(F.col("__present") == 0, F.lit(default)).otherwise(col(c).cast("string") if text else col(c))
                        .alias(f"{prefix}{c}") for c in cols])
