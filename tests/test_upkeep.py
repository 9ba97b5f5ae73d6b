import os

import pytest

from peerpanel.operators.aggregates import club
from peerpanel.plans.upkeep import refresh_panel, round_log
from peerpanel.sources.files import read_panel

SCHEMA = "entity_id long, entity_name string, year int, amount double"


def build(rows):
    return club(rows, ["entity_id", "year"], carry=["entity_name"], values=["amount"])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted(tuple(r) for r in df.select("entity_id", "entity_name", "year", "amount").collect())


def files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.startswith("part")) for d in os.listdir(path) if d.startswith("year=")}


def test_three_rounds_equal_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "panel")
    rows = [(e, f"n{e}", y, float(e * y)) for e in range(12) for y in (2019, 2020, 2021, 2022)] + [(None, "x", 2019, 1.0), (3, "n3", None, 1.0)]
    assert refresh_panel(frame(spark, rows), None, path, build) == [2019, 2020, 2021, 2022]
    assert content(read_panel(spark, path)) == content(build(frame(spark, [r for r in rows if r[0] is not None and r[2]])))
    rounds = [
        ([(3, "n3", 2021, 5.0), (3, "n3", 2021, 5.0), (99, "new", 2023, 1.0), (None, "x", 2020, 9.0)], []),  # added, one key without id
        ([(4, "n4", 2020, -1.0)], [(4, "n4", 2022, float(4 * 2022))]),  # moved to another year
        ([], [(99, "new", 2023, 1.0), *[(e, f"n{e}", 2019, float(e * 2019)) for e in range(12)]]),  # two years go
    ]
    for added, removed in rounds:
        before = files(path)
        for r in removed:
            rows.remove(r)
        rows += added
        years = refresh_panel(frame(spark, rows), frame(spark, added + removed), path, build)
        assert years == sorted({r[2] for r in added + removed if r[0] is not None})
        whole = [r for r in rows if r[0] is not None and r[2]]
        assert content(read_panel(spark, path)) == content(build(frame(spark, whole)))
        after = files(path)
        assert all(after[d] == before[d] for d in before if int(d[5:]) not in years)
        assert set(after) == {f"year={r[2]}" for r in whole}
    assert [tuple(r) for r in round_log(spark, path).where("round = 3").orderBy("year").collect()] == [(3, 2019, 0), (3, 2023, 0)]
    assert refresh_panel(frame(spark, rows), frame(spark, []), path, build) == []


def test_a_refresh_that_was_cut_off_is_made_good(spark, tmp_path):
    path = str(tmp_path / "panel")
    rows = [(e, "n", y, 1.0) for e in range(5) for y in (2020, 2021)]
    refresh_panel(frame(spark, rows), None, path, build)
    rows.append((1, "n", 2020, 7.0))

    def fails(part):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        refresh_panel(frame(spark, rows), frame(spark, rows[-1:]), path, fails)
    rows.append((2, "n", 2021, 3.0))
    assert refresh_panel(frame(spark, rows), frame(spark, rows[-1:]), path, build) == [2020, 2021]
    assert content(read_panel(spark, path)) == content(build(frame(spark, rows)))
    assert refresh_panel(frame(spark, rows), frame(spark, []), path, build) == []
