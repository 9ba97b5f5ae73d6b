import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerpanel.sources.files import cast_lenient, read_headerless, read_panel, read_table, write_panel


def test_cast_lenient(spark):
    df = spark.createDataFrame([("12",), ("x",), (None,)], "k string")
    out = [r["k"] for r in cast_lenient(df, "k", "bigint").collect()]
    assert out == [12, None, None]


def test_read_table_csv_with_schema(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,name,amount\n1,a,2.5\n2,b,x\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("amount", T.StringType())])
    df = read_table(spark, str(p), schema)
    assert df.columns == ["id", "name", "amount"]
    out = cast_lenient(df, "amount", "double").orderBy("id").collect()
    assert [r["amount"] for r in out] == [2.5, None]


def test_read_table_requires_schema_for_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a\n1\n")
    with pytest.raises(ValueError):
        read_table(spark, str(p))


def test_read_headerless_skip_rows(spark, tmp_path):
    p = tmp_path / "sheet.csv"
    p.write_text("title line\nsecond junk\n1,a\n2,b\n")
    df = read_headerless(spark, str(p), ["id", "name"], skip_rows=2)
    assert sorted((r["id"], r["name"]) for r in df.collect()) == [("1", "a"), ("2", "b")]
    all_rows = read_headerless(spark, str(p), ["id", "name"])
    assert all_rows.count() == 4


def test_write_and_read_panel_partition_pruning(spark, tmp_path):
    df = spark.createDataFrame([(1, 2020, 1.0), (1, 2021, 2.0), (2, 2021, 3.0)], "entity_id long, year int, v double")
    out = str(tmp_path / "panel")
    write_panel(df, out)
    back = read_panel(spark, out, years=[2021])
    assert sorted((r["entity_id"], r["v"]) for r in back.collect()) == [(1, 2.0), (2, 3.0)]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2021" in plan
    csv_out = str(tmp_path / "panel_csv")
    write_panel(df, csv_out, fmt="csv")
    schema = T.StructType([T.StructField("entity_id", T.LongType()), T.StructField("v", T.DoubleType()),
                           T.StructField("year", T.IntegerType())])
    back_csv = read_panel(spark, csv_out, fmt="csv", schema=schema)
    assert back_csv.agg(F.sum("v")).first()[0] == 6.0


def test_read_headerless_skips_per_file(spark, tmp_path):
    d = tmp_path / "sheets"
    d.mkdir()
    (d / "a.csv").write_text("junk a\n1,x\n2,y\n")
    (d / "b.csv").write_text("junk b\n3,z\n")
    df = read_headerless(spark, str(d), ["id", "name"], skip_rows=1)
    assert sorted(r["id"] for r in df.collect()) == ["1", "2", "3"]


def _sheet(rng, rows):
    """A sheet with title lines (one with a lone quote), blank lines and fields with line ends, quotes and separators."""
    text, want = 'A title with a 5" mark\n\nSecond title, with commas\n', []
    for k in range(rows):
        if k % 11 == 5:
            text += "\n"
        fields = []
        for _ in range(3):
            kind = rng.integers(6)
            value = {0: f"v{k}", 1: "two\nlines", 2: 'say ""hi""', 3: "a,b", 4: "x" * int(rng.integers(1, 60)), 5: "end\n\nof\r\nline"}[int(kind)]
            quoted = any(c in value for c in '\n,"')
            text += ("," if fields else "") + (f'"{value}"' if quoted else value)
            fields.append(value.replace('""', '"'))
        text += "\r\n" if k % 5 == 0 else "\n"
        want.append(tuple(fields))
    return text, want


def test_headerless_with_line_ends_in_fields_at_split_borders(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    wants = []
    for name in ("a.csv", "b.csv"):
        text, want = _sheet(rng, 150)
        (tmp_path / name).write_bytes(text.encode())
        wants += want
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for size in ("23", "64", "997", "128m"):  # also splits shorter than the skipped lines and than a record
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_headerless(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["a", "b", "c"], skip_rows=3).collect()
            assert sorted(map(tuple, got)) == sorted(wants), size
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        assert read_headerless(spark, str(tmp_path / "a.csv"), ["a", "b", "c"], skip_rows=100_000).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
