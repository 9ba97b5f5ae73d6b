"""Feature matrices for clustering (M1, M2).

The matrix stays a DataFrame: the entity key beside a ``VectorUDT`` column from
``VectorAssembler``, so rows are aligned on the key, never on position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._names import as_list, col
from ..constants import UNKNOWN
from ..functions.scalar import fill_unknown
from .quantiles import median_impute
from .reshape import one_hot
from .windows import standardize


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Pack numeric columns into one vector column (NaN kept, so NULL rows are not dropped
    silently: callers fill them first)."""
    safe = {c: f"__f{i}" for i, c in enumerate(columns)}
    tmp = df.withColumns({v: col(c).cast("double") for c, v in safe.items()})
    va = VectorAssembler(inputCols=list(safe.values()), outputCol=out, handleInvalid="keep")
    return va.transform(tmp).drop(*safe.values())


def features_numeric(df: DataFrame, key: str | Sequence[str], columns: Sequence[str],
                     out: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """M1: the chosen metrics standardised (W3) and assembled; returns key, kept columns,
    the standardised metrics and the vector."""
    keys = as_list(key)
    cols = as_list(columns)
    z = standardize(df.select(*[col(k) for k in keys], *[col(k) for k in keep if k not in cols],
                              *[col(c) for c in cols]), cols)
    return assemble(z, cols, out)


def features_mixed(df: DataFrame, key: str | Sequence[str], numeric: Sequence[str], categorical: Sequence[str],
                   out: str = "features", impute_median: bool = True, fill: str = UNKNOWN,
                   codes: str = "passthrough", categories: dict | None = None,
                   keep: Sequence[str] = ()) -> DataFrame:
    """M2: standardised metrics beside unscaled indicator columns.

    Categorical text columns get NULL -> ``fill`` (X7) then one 0/1 column per value
    (R6); numeric code columns pass through unscaled (``codes="encode"`` one-hot
    encodes them too) unless they hold NULLs, in which case filling makes them text
    and they are encoded, as in the reference.  Metric NULLs take the column median (X8) when
    ``impute_median``; the metrics are then standardised (W3).
    Returns key, kept columns, the processed columns and the vector.
    """
    keys = as_list(key)
    num = as_list(numeric)
    cat = as_list(categorical)
    base = df.select(*[col(k) for k in keys], *[col(k) for k in keep if k not in num + cat],
                     *[col(c) for c in num], *[col(c) for c in cat])
    types = {f.name: f.dataType for f in base.schema.fields}
    text = [c for c in cat if isinstance(types[c], T.StringType)]
    codes_cols = [c for c in cat if c not in text]
    if codes_cols and codes == "passthrough":
        # A code column with NULLs becomes text once filled (and is then encoded); one
        # without NULLs stays numeric.  One aggregate finds which (a plan-time fact).
        nulls = base.agg(*[F.count(F.when(col(c).isNull(), F.lit(1))).alias(c) for c in codes_cols]).first()
        text += [c for c in codes_cols if nulls[c] > 0]
    base = fill_unknown(base, text, fill) if text else base
    if impute_median and num:
        base = median_impute(base, num)
    base = standardize(base, num)
    enc = one_hot(base, cat, numeric="encode" if codes == "encode" else "passthrough", categories=categories)
    fixed = set(keys) | set(keep)
    feat_cols = [c for c in enc.columns if c not in fixed]
    return assemble(enc, feat_cols, out)


def feature_columns(df: DataFrame, key: str | Sequence[str], vector: str = "features",
                    keep: Sequence[str] = ()) -> list[str]:
    """The processed columns that went into the vector, in vector order."""
    fixed = set(as_list(key)) | set(keep) | {vector}
    return [c for c in df.columns if c not in fixed]


def vector_to_columns(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """Unpack a vector column into named double columns."""
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array(F.col(vector))
    return df.withColumns({n: arr[i] for i, n in enumerate(names)})
