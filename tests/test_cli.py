from peerpanel.__main__ import main


def test_list_and_sql(capsys):
    assert main(["--list"]) == 0
    listed = capsys.readouterr().out.split("\n")
    assert "profile_totals" in listed and any(l.startswith("elbow  (model fit") for l in listed)
    assert main(["top_k", "--sql"]) == 0
    assert "ORDER BY total_with DESC" in capsys.readouterr().out
    assert main(["no_such_query"]) == 2


def test_run_writes_parquet(spark, tmp_path):
    out = str(tmp_path / "res")
    assert main(["dedupe", "/root/testdata/sf0.001", "--out", out]) == 0
    assert spark.read.parquet(out).count() > 0
