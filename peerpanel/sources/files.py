"""File sources and sinks.

Every reader takes an explicit schema: inference costs a full pass over the
input and gives unstable types across files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
               fmt: str | None = None, header: bool = True) -> DataFrame:
    """Scan a table.  CSV gets a header and an explicit schema; Parquet keeps its own
    (a given schema is then a projection, so column pruning still reaches the scan)."""
    paths = [path] if isinstance(path, str) else list(path)
    fmt = fmt or ("csv" if paths[0].lower().endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", header).option("mode", "PERMISSIVE")
        if schema is None:
            raise ValueError("CSV scans need an explicit schema")
        return reader.schema(schema).csv(paths)
    df = reader.format(fmt).load(paths)
    if schema is not None:
        st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in st.fields])
    return df


def cast_lenient(df: DataFrame, col: str, to: str | T.DataType = "bigint", out: str | None = None) -> DataFrame:
    """Cast a text column; malformed values become NULL instead of failing the job
    (a plain cast raises under ANSI mode)."""
    type_name = to if isinstance(to, str) else to.simpleString()
    return df.withColumn(out or col, F.expr(f"try_cast(`{col}` AS {type_name})"))


def read_headerless(spark: SparkSession, path: str | Sequence[str], names: Sequence[str],
                    skip_rows: int = 0, sep: str = ",") -> DataFrame:
    """S3: a sheet without header: every line is data, the caller names the columns.

    ``skip_rows`` drops the first physical lines of each file, blank ones included, wherever splits begin.  Blank
    lines are no rows, as in the CSV reader.  A quoted field may hold line ends, and a split may begin inside of
    one: a first pass counts lines and quotes of every split, whose running sums (a row per split, on the driver as the splits
    are) tell where each split stands; a second pass marks the lines of each record.  Only records of several
    lines are shuffled, to put their lines together.  Quotes come in pairs (``""`` inside of a field).
    """
    schema = ", ".join(f"`{n}` string" for n in names)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), "value")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each split: its lines, whether its quotes are odd in number, whether they are after each of the first ``skip_rows``
        lines, and the last line with an even and with an odd number of quotes before it."""
        held: dict[tuple, list] = {}
        for batch in batches:
            for f, b, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault((f, b), [0, 0, [], -1, -1])
                own[3 + own[1]] = own[0]
                own[0] += 1
                own[1] ^= v.count('"') & 1
                if own[0] <= skip_rows:
                    own[2].append(own[1])
        rows = [(f, b, *own) for (f, b), own in held.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)],
                                         ["file", "block", "lines", "odd", "skipped", "even_at", "odd_at"])

    splits = lines.mapInArrow(count, "file string, block long, lines long, odd int, skipped array<int>, even_at long, odd_at long").collect()
    places: dict[tuple, tuple] = {}
    at = inside = carried = 0
    for k, r in enumerate(sorted(splits, key=lambda r: (r["file"], r["block"]))):
        if not k or r["file"] != before:
            at, inside, carried = 0, 0, None
        before = r["file"]
        places[r["file"], r["block"]] = at, inside, carried
        drop = max(0, min(skip_rows - at, r["lines"]))
        gone = r["skipped"][drop - 1] if drop else 0
        last = r["odd_at"] if inside ^ gone else r["even_at"]  # the last line that begins a record
        if last >= drop:
            carried = at + last
        inside ^= gone ^ r["odd"]
        at += r["lines"]
    shared = spark.sparkContext.broadcast(places)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every kept line with the number of its record's first line, and whether it is all of the record."""
        split, number, inside, record = None, 0, 0, None
        for rows in batches:
            out: list[tuple] = []
            for f, b, v in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if split != (f, b):
                    split = f, b
                    number, inside, record = shared.value[split]
                if number >= skip_rows:
                    opened = inside
                    if not opened:
                        record = number
                    inside ^= v.count('"') & 1
                    out.append((f, record, number, not opened and not inside, v))
                number += 1
            if out:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 ["file", "record", "line", "whole", "value"])

    marked = lines.mapInArrow(mark, "file string, record long, line long, whole boolean, value string")
    joined = marked.where("NOT whole").groupBy("file", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("value"))  # one record
    records = marked.where("whole").select("value").unionByName(joined.select("value"))
    text = F.regexp_replace("value", "\r$", "")
    return records.select(text.alias("value")).where(F.trim("value") != "").select(F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"'}).alias("r")).select("r.*")


def write_panel(df: DataFrame, path: str, partition_by: Sequence[str] | None = ("year",),
                fmt: str = "parquet", mode: str = "overwrite", max_records_per_file: int = 5_000_000) -> None:
    """Write the panel, partitioned by year so later reads prune whole years.

    Rows are rebalanced on the partition columns first: a year goes to as few tasks as its
    size asks for, and AQE splits a large one, so there are not (tasks x years) files;
    ``maxRecordsPerFile`` bounds file size.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).format(fmt).option("maxRecordsPerFile", max_records_per_file)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_panel(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
               years: Sequence[int] | None = None, year_col: str = "year") -> DataFrame:
    """Re-read a written panel; a year list is pushed down as partition pruning."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            raise ValueError("CSV panels need an explicit schema")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if years is not None:
        df = df.where(F.col(year_col).isin(list(years)))
    return df
