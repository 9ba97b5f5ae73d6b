import numpy as np
import pytest
from pyspark.sql import functions as F

from peerpanel.operators.cluster import (assign_nearest, elbow, fit_kmeans, inertia_k1, kmeans, pca_explained,
                                         pca_project)
from peerpanel.operators.features import features_mixed, features_numeric


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(8, 1, (60, 3)), rng.normal((0, 8, 0), 1, (60, 3))])
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(pts)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double"), pts


def test_inertia_k1_is_n_times_d_on_standardised(spark, blobs):
    df, pts = blobs
    f = features_numeric(df, "k", ["a", "b", "c"])
    assert inertia_k1(f).first()["inertia"] == pytest.approx(len(pts) * 3)


def test_elbow_decreases_below_k1(spark, blobs):
    df, _ = blobs
    f = features_numeric(df, "k", ["a", "b", "c"])
    el = {r["k"]: r["inertia"] for r in elbow(f, [1, 2, 3], restarts=2).collect()}
    assert el[3] <= el[2] <= el[1]


def test_kmeans_assigns_nearest_centre(spark, blobs):
    df, _ = blobs
    f = features_numeric(df, "k", ["a", "b", "c"])
    centres, cost = fit_kmeans(f, 3, restarts=3)
    mine = assign_nearest(f, centres.tolist(), distance="d")
    assert mine.agg(F.sum("d")).first()[0] == pytest.approx(cost, rel=1e-9)
    out = kmeans(f, 3, restarts=3)
    sizes = sorted(r["count"] for r in out.groupBy("cluster").count().collect())
    assert sizes == [60, 60, 60]


def test_pca_projection_centred_uncorrelated(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    y = 0.8 * x + rng.normal(scale=0.3, size=400)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k long, x double, y double")
    f = features_numeric(df, "k", ["x", "y"])
    pr = pca_project(f, 2).select("pc1", "pc2").toPandas()
    assert abs(pr.pc1.mean()) < 1e-9 and abs(pr.pc2.mean()) < 1e-9
    assert abs(np.cov(pr.pc1, pr.pc2)[0, 1]) < 1e-9
    r = np.corrcoef(x, y)[0, 1]
    ev = [row["explained_variance_ratio"] for row in pca_explained(f, 2).orderBy("component").collect()]
    assert ev == pytest.approx([(1 + r) / 2, (1 - r) / 2], abs=1e-9)
    assert sum(ev) == pytest.approx(1.0)


def test_features_mixed_layout(spark):
    df = spark.createDataFrame([(1, 1.0, "a", 11), (2, None, None, 42), (3, 3.0, "b", 11)],
                               "k long, m double, s string, code int")
    f = features_mixed(df, "k", ["m"], ["s", "code"])
    assert [c for c in f.columns if c not in ("k", "features")] == ["m", "code", "s_Unknown", "s_a", "s_b"]
    rows = {r["k"]: r for r in f.collect()}
    assert rows[2]["m"] == 0.0  # median fill, then standardised around the same median
    assert rows[2]["s_Unknown"] == 1 and rows[1]["code"] == 11


def test_features_mixed_code_column_with_nulls_is_encoded(spark):
    df = spark.createDataFrame([(1, 1.0, 11), (2, 2.0, None), (3, 3.0, 42)], "k long, m double, code int")
    f = features_mixed(df, "k", ["m"], ["code"])
    assert [c for c in f.columns if c not in ("k", "features")] == ["m", "code_11", "code_42", "code_Unknown"]


def test_pca_sign_rule_largest_loading_positive(spark):
    from peerpanel.operators.cluster import fit_pca
    rng = np.random.default_rng(11)
    x = rng.normal(size=200)
    y = -0.5 * x + rng.normal(scale=0.5, size=200)
    z = rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z))],
                               "k long, x double, y double, z double")
    f = features_numeric(df, "k", ["x", "y", "z"])
    model, _, _, signs = fit_pca(f, 2)
    pc = model.pc.toArray() * np.array(signs)
    for j in range(2):
        assert pc[np.argmax(np.abs(pc[:, j])), j] > 0


def test_kmeans_is_as_good_as_mllib_and_ignores_partitioning(spark, blobs):
    from pyspark.ml.clustering import KMeans

    df, _ = blobs
    f = features_numeric(df, "k", ["a", "b", "c"])
    _, cost = fit_kmeans(f, 5, restarts=10)
    best = min(KMeans(k=5, seed=s, maxIter=300).fit(f).summary.trainingCost for s in range(42, 52))
    assert cost <= best * (1 + 1e-6)
    labels = [{r["k"]: r["cluster"] for r in kmeans(f.repartition(n), 5, restarts=2).collect()} for n in (1, 7)]
    assert labels[0] == labels[1]


def test_kmeans_refuses_nan(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([1.0, float("nan")]),), (Vectors.dense([1.0, 2.0]),)], ["features"])
    with pytest.raises(Exception, match="NaN"):
        kmeans(df, 2)


def test_kmeans_with_fewer_distinct_rows_than_centres_raises(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(i, Vectors.dense([float(i % 2)])) for i in range(10)], ["k", "features"])
    with pytest.raises(ValueError, match="distinct"):
        kmeans(df, 4)


def test_kmeans_on_many_copies_of_few_vectors(spark):
    """Ten vectors of 1000 rows each: the rows with the smallest hashes alone hold at most five of them."""
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(i, Vectors.dense([float(i % 10), float(i % 10 == 3)])) for i in range(10_000)], ["k", "features"])
    out = kmeans(df, 8, restarts=2).groupBy("cluster").count().collect()
    assert len(out) == 8 and sum(r["count"] for r in out) == 10_000


def test_seeding_finds_a_cluster_of_a_ten_thousandth_of_the_rows(spark):
    """Four rows of 40,000 lie far out; the 4000 rows with the smallest hashes hold none of them."""
    from peerpanel.operators.cluster import _mean, _vectors, candidates
    from peerpanel.operators.features import assemble

    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(0, 1, (39_996, 3)), rng.normal(300, 0.1, (4, 3))])
    df = assemble(spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in pts], "a double, b double, c double"), ["a", "b", "c"])
    data = _vectors(df, "features")
    by_hash = data.orderBy(F.xxhash64("x")).limit(4000)
    assert by_hash.where(F.col("x")[0] > 100).count() == 0
    for n in (1, 5):
        mean = _mean(data)
        drawn = candidates(data.repartition(n), [1, 2, 3], 2, mean)
        assert all(((points + mean)[:, 0] > 100).any() and weights.sum() == 40_000 for points, weights in drawn.values())
    centres, _ = fit_kmeans(df, 2, restarts=2)
    assert sorted(round(float(c[0]) / 100) for c in centres) == [0, 3]


def test_bounds_give_the_centres_of_plain_lloyd_with_fewer_distances(spark):
    from peerpanel.operators.cluster import Fit, lloyd
    from peerpanel.session import cut_lineage

    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.normal(c, 1.5, (400, 4)) for c in rng.uniform(0, 20, (8, 4))]) + 1e4
    data = cut_lineage(spark.createDataFrame([(p.tolist(), int(n)) for p, n in zip(pts, rng.integers(1, 4, len(pts)))], "x array<double>, n long").repartition(3))
    fits = lambda: [Fit(k, k, pts[rng_.choice(len(pts), k, replace=False)]) for k, rng_ in ((k, np.random.default_rng(k)) for k in (2, 8, 12))]
    plain, bound = lloyd(data, fits(), tol=0.0, bounds=False), lloyd(data, fits(), tol=0.0)
    for a, b in zip(plain, bound):
        assert a.iterations == b.iterations and np.abs(a.centres - b.centres).max() <= 1e-9 * np.abs(a.centres).max()
        assert a.cost == pytest.approx(b.cost, rel=1e-9)
        assert set(a.distances) == {len(pts) * a.k}
    long = max(bound, key=lambda f: f.iterations)
    assert long.distances[-1] < 0.5 * long.distances[0] and sum(long.distances) < 0.8 * len(pts) * long.k * len(long.distances)


def test_kmeans_on_executors_without_the_package(tmp_path):
    """The package is on the driver's path only, and tasks start in a folder without it."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {str(root)!r})
from pyspark.ml.linalg import Vectors
from peerpanel.operators.cluster import kmeans
df = s.createDataFrame([(i, Vectors.dense([float(i % 5), float(i % 3)])) for i in range(60)], ["k", "features"])
print("clusters", kmeans(df, 3, restarts=2).select("cluster").distinct().count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "clusters 3" in done.stdout, done.stderr[-2000:]


def test_pca_of_fifty_thousand_one_hot_columns(spark):
    """Sparse rows, compared with the closed form of the small side (rows x rows)."""
    from pyspark.ml.linalg import Vectors

    from peerpanel.operators.cluster import fit_pca

    rng = np.random.default_rng(6)
    d, n = 50_000, 400
    rows, dense = [], np.zeros((n, d))
    for i in range(n):
        at = sorted({int(x) for x in rng.integers(10, d, 6)} | {int(rng.integers(0, 3)), 3 + int(i % 7 == 0)})
        rows.append((i, Vectors.sparse(d, at, [1.0] * len(at)) if i % 50 else Vectors.dense(np.isin(np.arange(d), at).astype(float).tolist())))
        dense[i, at] = 1.0
    df = spark.createDataFrame([r for r in rows if r[0] % 50], ["k", "features"]).union(spark.createDataFrame([r for r in rows if not r[0] % 50], ["k", "features"]))
    centred = dense - dense.mean(axis=0)
    values, left = np.linalg.eigh(centred @ centred.T)
    want = values[::-1][:2] / values.sum()
    got = [r["explained_variance_ratio"] for r in pca_explained(df, 2).orderBy("component").collect()]
    assert got == pytest.approx(list(want), rel=1e-8)
    model, _, _, _ = fit_pca(df, 2)
    assert model.passes < 40
    out = {r["k"]: (r["pc1"], r["pc2"]) for r in pca_project(df, 2).select("k", "pc1", "pc2").collect()}
    for c in range(2):
        mine, theirs = np.array([out[i][c] for i in range(n)]), left[:, -1 - c] * np.sqrt(values[-1 - c])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6


def test_pca_far_from_the_origin_equals_numpy(spark):
    from peerpanel.operators.features import assemble

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 70)) * np.linspace(3, 0.1, 70) + 500
    names = [f"c{j}" for j in range(70)]
    df = assemble(spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in names)), names)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got = [r["explained_variance_ratio"] for r in pca_explained(df, 5).orderBy("component").collect()]
    assert got == pytest.approx(list(values[:5] / values.sum()), rel=1e-7)


def test_many_centres_equal_the_literal_form(spark):
    rng = np.random.default_rng(2)
    centres = np.concatenate([rng.normal(0, 3, (200, 6)), rng.normal(40, 1, (100, 6)), np.zeros((3, 6))])
    centres = np.concatenate([centres, centres[:20]])  # ties
    pts = np.concatenate([rng.normal(0, 4, (500, 6)), rng.normal(40, 2, (200, 6)), centres[:30], np.zeros((2, 6))])
    names = [f"c{j}" for j in range(6)]
    rows = [tuple(map(float, r)) for r in pts] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    small = assign_nearest(df, centres.tolist(), columns=names, distance="d", literals=10**6).select(*names, "cluster", "d").collect()
    large = assign_nearest(df, centres.tolist(), columns=names, distance="d", literals=0).select(*names, "cluster", "d").collect()
    key = lambda r: tuple((x is None, x) for x in r[:6])
    for a, b in zip(sorted(small, key=key), sorted(large, key=key)):
        assert a["cluster"] == b["cluster"] and (a["d"] is None) == (b["d"] is None) and (a["d"] is None or a["d"] == pytest.approx(b["d"], rel=1e-9, abs=1e-9))


def test_five_thousand_centres_of_64_numbers(spark):
    from peerpanel.operators.cluster import NearestCentres
    from peerpanel.operators.features import assemble

    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (5000, 64)) * rng.uniform(0.2, 6, (5000, 1))
    pts = centres[rng.integers(0, 5000, 600)] + rng.normal(0, 0.05, (600, 64))
    names = [f"c{j}" for j in range(64)]
    df = assemble(spark.createDataFrame([tuple(map(float, r)) for r in pts], ", ".join(f"{c} double" for c in names)), names)
    got = [r["cluster"] for r in assign_nearest(df, centres, distance="d").select("cluster").collect()]
    want = np.array([((p - centres) ** 2).sum(axis=1).argmin() for p in pts])
    assert sorted(got) == sorted(want.tolist())
    assert NearestCentres(centres)(pts)[0].tolist() == want.tolist()


def test_passes_over_packed_rows_send_the_changes_only():
    """Sums of three fits (one of many centres) by packed rows and bounds equal plain sums; nothing is sent where nothing moved."""
    import pyarrow as pa

    from peerpanel.operators.cluster import _steps

    rng = np.random.default_rng(11)
    x, n = rng.normal(3, 2, (5000, 5)), rng.integers(1, 4, 5000)
    shift = x.mean(axis=0)
    fits = {f: x[rng.choice(len(x), k, replace=False)] - shift for f, k in ((0, 2), (3, 9), (4, 90))}
    rows = pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(n)], ["x", "n"])

    def sums(batch):
        return {f: np.array(v) for f, v in zip(batch.column("fit").to_pylist(), batch.column("sums").to_pylist())}

    def plain(fits):
        out = {}
        for f, c in fits.items():
            near = ((x - shift)[:, None, :] - c[None]) ** 2
            near = near.sum(axis=2).argmin(axis=1)
            both = np.zeros((len(c), 6))
            np.add.at(both, near, np.concatenate([x - shift, np.ones((len(x), 1))], axis=1) * n[:, None])
            out[f] = both.ravel()
        return out

    packed, first = _steps(iter([rows]), fits, shift, None, True)
    assert packed.num_rows < len(x) / 10 and packed.nbytes < 1.1 * len(x) * (5 * 8 + 8 + 3 * 10)
    base = {f: v[:-2] for f, v in sums(first).items()}
    assert all(np.allclose(base[f], v) for f, v in plain(fits).items())
    still, = _steps(iter([packed.slice(0, 7), packed.slice(7)]), fits, shift, (list(fits), fits), False)
    assert all(not v[:-1].any() for v in sums(still).values())
    moved = {f: fits[f] + rng.normal(0, 0.05, fits[f].shape) for f in (0, 4)}
    again, change = _steps(iter([packed]), moved, shift, (list(fits), fits), True)
    assert all(np.allclose(base[f] + sums(change)[f][:-2], v) for f, v in plain(moved).items())
    last = {f: c + 0.01 for f, c in moved.items()}
    end, = _steps(iter([again]), last, shift, (list(moved), moved), False)
    assert all(np.allclose(base[f] + sums(change)[f][:-2] + sums(end)[f][:-2], v) for f, v in plain(last).items())
