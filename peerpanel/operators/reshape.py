"""Reshaping.

Dynamic schemas are resolved from column names or a category list at plan
time.  When a category list has to be discovered from data, it is one small
distinct query whose result size is the number of output columns.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._names import as_list, col


# Default of the ``max_categories`` arguments: Spark's own ``spark.sql.pivotMaxValues``.  A
# category list is a list of output columns, so one that grows with the data is refused.
MAX_CATEGORIES = 10_000


def categories_of(df: DataFrame, column: str, max_categories: int = MAX_CATEGORIES) -> list:
    """Sorted distinct non-NULL values of a category column (a plan-time fact: the list of
    output columns).  Aggregated on the cluster; at most ``max_categories + 1`` values reach
    the driver, and more than ``max_categories`` is an error (use a sparse vector instead,
    :func:`one_hot_vector`)."""
    rows = (df.where(col(column).isNotNull()).select(col(column).alias("v")).distinct().orderBy("v")
            .limit(max_categories + 1).collect())
    if len(rows) > max_categories:
        raise ValueError(f"{column!r} has more than {max_categories} values: too many output columns")
    return [r["v"] for r in rows]


def pivot_strict(df: DataFrame, index: Sequence[str], on: str, value: str,
                 categories: Sequence | None = None, names: dict | None = None,
                 null_name: str | None = None) -> DataFrame:
    """Long to wide with no aggregate function: a second row in a cell is an error.

    One aggregate keyed on ``index``: for each category a count and the value.
    A cell with more than one row raises when the job runs, naming the cell.
    Spark's own ``pivot().sum()`` would add duplicates silently.  A row whose
    category is not in the list raises too, and so does a NULL category unless
    ``null_name`` names a column for it.
    """
    idx = as_list(index)
    cats = list(categories) if categories is not None else categories_of(df, on)
    names = names or {}
    key_text = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(col(k).cast("string"), F.lit("NULL")))
                                   for k in idx])
    lost = F.count(F.when(~_listed(on, cats, null_name is not None), F.lit(1)))
    cells = [(c, col(on) == F.lit(c), names.get(c, str(c))) for c in cats]
    if null_name is not None:
        cells.append(("NULL", col(on).isNull(), null_name))
    aggs = []
    for c, hit, name in cells:
        n = F.count(F.when(hit, F.lit(1)))
        v = F.max(F.when(hit, col(value)))
        unlisted = F.concat(F.lit(f"pivot_strict: a category of {on} is not in the list at "), key_text)
        msg = F.concat(F.lit(f"pivot_strict: more than one row for {on}={c} at "), key_text)
        aggs.append(F.when(lost > 0, F.raise_error(unlisted)).when(n > 1, F.raise_error(msg)).otherwise(v).alias(name))
    return df.groupBy(*[col(k) for k in idx]).agg(*aggs)


def _listed(on: str, cats: Sequence, with_null: bool) -> Column:
    known = col(on).isin(*cats) if cats else F.lit(False)
    return F.coalesce(known, F.lit(with_null))


def pivot_counts(df: DataFrame, index: Sequence[str], on: str, categories: Sequence | None = None,
                 value: str | None = None, names: dict | None = None, null_name: str | None = None) -> DataFrame:
    """R2: pivot counts (or sums of ``value``) with missing cells filled with 0.  A NULL
    category has the column ``null_name``; without a name, and for a category that is not
    in the list, a row raises when the job runs, since it would be lost."""
    idx = as_list(index)
    cats = list(categories) if categories is not None else categories_of(df, on)
    names = names or {}
    lost = F.count(F.when(~_listed(on, cats, null_name is not None), F.lit(1)))
    stop = F.raise_error(F.lit(f"pivot_counts: a category of {on} is NULL or not in the list"))
    cells = [(col(on) == F.lit(c), names.get(c, str(c))) for c in cats]
    if null_name is not None:
        cells.append((col(on).isNull(), null_name))
    aggs = []
    for hit, name in cells:
        if value is None:
            cell = F.count(F.when(hit, F.lit(1)))
        else:
            cell = F.coalesce(F.sum(F.when(hit, col(value))), F.lit(0))
        aggs.append(F.when(lost > 0, stop).otherwise(cell).alias(name))
    return df.groupBy(*[col(k) for k in idx]).agg(*aggs)


# Column names of year blocks: "<attribute> (HD<year>)".  The attribute itself may
# hold parentheses; only the last parenthesised group is the suffix.
YEAR_SUFFIX = r"^(?P<attr>.*) \((?P<prefix>[A-Za-z]*)(?P<year>\d{4})\)$"


def year_blocks(columns: Sequence[str], pattern: str = YEAR_SUFFIX) -> dict[int, list[tuple[str, str]]]:
    """X1 at plan time: {year: [(column, attribute), ...]} from the column names."""
    rx = re.compile(pattern)
    blocks: dict[int, list[tuple[str, str]]] = {}
    for c in columns:
        m = rx.match(c)
        if m:
            blocks.setdefault(int(m.group("year")), []).append((c, m.group("attr")))
    return blocks


def wide_years_to_long(df: DataFrame, static: Sequence[str], year_col: str = "year",
                       pattern: str = YEAR_SUFFIX, method: str = "explode") -> DataFrame:
    """Year-suffixed wide table to one row per entity and year.

    Years are taken newest first; the suffix is stripped; an attribute missing
    in a year is NULL there; an attribute whose type differs between years is an
    error (R4's rule), raised before anything runs.

    ``method="explode"`` reads the table once and emits one struct per year
    (``inline(array(struct..))``).  ``method="union"`` builds one projection per
    year joined by ``unionByName``; it reads the table once per year but lets a
    later year filter prune whole branches.
    """
    static = as_list(static)
    blocks = year_blocks(df.columns, pattern)
    if not blocks:
        raise ValueError("no year-suffixed columns found")
    years = sorted(blocks, reverse=True)
    types = {f.name: f.dataType for f in df.schema.fields}
    attrs: list[str] = []
    attr_type: dict[str, T.DataType] = {}
    for y in years:
        for c, a in blocks[y]:
            if a not in attr_type:
                attrs.append(a)
                attr_type[a] = types[c]
            elif attr_type[a] != types[c]:
                raise TypeError(f"attribute {a!r} has type {attr_type[a].simpleString()} in one year "
                                f"and {types[c].simpleString()} in {y}")
    if method == "union":
        frames = []
        for y in years:
            sel = [col(s) for s in static] + [F.lit(y).alias(year_col)]
            sel += [col(c).alias(a) for c, a in blocks[y]]
            frames.append(df.select(*sel))
        return concat_diagonal(frames).select(*[col(c) for c in static + [year_col] + attrs])
    structs = []
    for y in years:
        have = {a: c for c, a in blocks[y]}
        fields = [F.lit(y).alias(year_col)]
        for a in attrs:
            v = col(have[a]) if a in have else F.lit(None).cast(attr_type[a])
            fields.append(v.alias(a))
        structs.append(F.struct(*fields))
    exploded = df.select(*[col(s) for s in static], F.inline(F.array(*structs)))
    return exploded


def concat_diagonal(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing from a frame is NULL there; a shared
    column with different types in two frames raises before anything runs."""
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to concatenate")
    seen: dict[str, T.DataType] = {}
    order: list[str] = []
    for f in frames:
        for fld in f.schema.fields:
            if fld.name in seen:
                if seen[fld.name] != fld.dataType and not isinstance(fld.dataType, T.NullType):
                    if isinstance(seen[fld.name], T.NullType):
                        seen[fld.name] = fld.dataType
                        continue
                    raise TypeError(f"column {fld.name!r} is {seen[fld.name].simpleString()} in one frame "
                                    f"and {fld.dataType.simpleString()} in another")
            else:
                seen[fld.name] = fld.dataType
                order.append(fld.name)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*[col(c) for c in order])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None,
         var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Wide to long (``unpivot``).  Value columns are cast to their common type."""
    ids = as_list(ids)
    vals = list(values) if values is not None else [c for c in df.columns if c not in ids]
    return df.unpivot([col(i) for i in ids], [col(v) for v in vals], var_name, value_name)


def one_hot(df: DataFrame, columns: Sequence[str], numeric: str = "passthrough",
            categories: dict[str, Sequence] | None = None, prefix_sep: str = "_",
            dtype: str = "int", max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """One 0/1 column per category value, no category dropped, the source column
    removed.  Only string columns are encoded; numeric code columns pass through
    unchanged unless ``numeric="encode"``.  A NULL value gives 0 in every column.

    Category lists come from ``categories`` or one aggregate over all encoded
    columns at once (its size is the number of output columns); a column with more than
    ``max_categories`` values is an error, whatever the others have.
    """
    cols = as_list(columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    enc = [c for c in cols if isinstance(types[c], T.StringType) or numeric == "encode"]
    cats = dict(categories or {})
    todo = [c for c in enc if c not in cats]
    if todo:
        distinct = (df.select(*[col(c).cast("string").alias(c) for c in todo])
                    .unpivot([], [col(c) for c in todo], "variable", "value")
                    .where(F.col("value").isNotNull()).distinct())
        first = Window.partitionBy("variable").orderBy("value")
        long = distinct.withColumn("k", F.row_number().over(first)).where(F.col("k") <= max_categories + 1).collect()
        wide = sorted(r["variable"] for r in long if r["k"] > max_categories)
        if wide:
            raise ValueError(f"more than {max_categories} categories in {wide}: use one_hot_vector")
        found: dict[str, list] = {c: [] for c in todo}
        for r in long:
            found[r["variable"]].append(r["value"])
        for c in todo:
            vals = found[c]
            if not isinstance(types[c], T.StringType):
                vals = sorted({types_cast(types[c], v) for v in vals})
            else:
                vals = sorted(vals)
            cats[c] = vals
    keep = [c for c in df.columns if c not in enc]
    dummies = []
    for c in enc:
        for v in cats[c]:
            dummies.append(F.when(col(c) == F.lit(v), F.lit(1)).otherwise(F.lit(0)).cast(dtype)
                           .alias(f"{c}{prefix_sep}{v}"))
    return df.select(*[col(c) for c in keep], *dummies)


def one_hot_vector(df: DataFrame, columns: Sequence[str], suffix: str = "_vec") -> DataFrame:
    """R6 for wide categories: ``StringIndexer`` + ``OneHotEncoder`` (no category dropped) into
    one sparse vector per column, so thousands of values do not become thousands of
    columns.  NULL and unseen values get their own slot (``handleInvalid="keep"``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    cols = as_list(columns)
    idx = {c: f"__idx{i}" for i, c in enumerate(cols)}
    stages = [StringIndexer(inputCols=[c for c in cols], outputCols=[idx[c] for c in cols],
                            handleInvalid="keep", stringOrderType="alphabetAsc"),
              OneHotEncoder(inputCols=[idx[c] for c in cols], outputCols=[f"{c}{suffix}" for c in cols],
                            dropLast=False, handleInvalid="error")]
    model = Pipeline(stages=stages).fit(df)
    return model.transform(df).drop(*idx.values())


def types_cast(dt: T.DataType, v: str):
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return int(v)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return float(v)
    return v
