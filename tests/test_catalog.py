"""Catalogue queries against DuckDB on the smallest tables, and properties of what SQL cannot express."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import clustering, distances, linear, validity
from tessera.plans import catalog
from tessera.sources import io
from tessera.streaming import state

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def values(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(v, 5) if isinstance(v, float) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert values(map(tuple, got.select(*sorted(names)).collect())) == values(tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall())


def test_kernels():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.1, (40, 3)) for m in (0, 3, 6)])
    truth = np.repeat([0, 1, 2], 40)
    assert clustering.rand_index(clustering.kmeans(x, 3, 1)[0], truth) == 1
    label = clustering.hdbscan(x, 10, 5)
    assert label.max() == 2 and clustering.rand_index(label[label >= 0], truth[label >= 0]) == 1
    r, w = clustering.mixture(x, 8, 1.0, 1)
    assert np.allclose(r.sum(axis=1), 1) and abs(w.sum() - 1) < 1e-9
    assert clustering.knee(list(range(1, 11)), [100, 50, 20, 8, 7, 6, 5, 4, 3, 2], 1.0) is not None


def test_grids_have_a_row_for_each_cell(spark):
    x = catalog.vectors(spark, SF)
    rows = clustering.kmeans_grid(x, [2, 3]).toPandas()
    assert sorted(rows["k"]) == [2, 3] and clustering.vote(rows)["selected"] in (2, 3)
    ari = clustering.bootstrap_ari(x, 2, runs=3).first()
    assert ari["pairs"] == 3 and ari["mean_ari"] <= 1


def test_grids_fit_all_rows(spark, monkeypatch):
    """No cap on the rows of a fit: the figures are those of numpy kernels over all of them."""
    monkeypatch.setattr(clustering.passes, "BLOCK", 40)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.1, (n, 3)) for m, n in ((0, 150), (3, 100), (6, 90))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    row = clustering.kmeans_grid(points, [3], most=50).first()
    assert math.isclose(row["inertia"], clustering.kmeans(x, 3, 1)[2], rel_tol=1e-9) and row["silhouette"] > 0.9
    tree = clustering.passes.spanning_trees(r := clustering.passes.Rows(points), [5])[5]
    d = clustering.passes.distances(x, x)
    assert len(r.sizes) > 3 and math.isclose(tree[0].sum(), clustering.passes.prim(d, np.sort(d, axis=1)[:, 4])[0].sum())
    label = clustering.hdbscan(x, 10, 5)
    got = clustering.hdbscan_grid(points, [10], [5]).first()
    assert (got["clusters"], got["noise"]) == (label.max() + 1, (label < 0).sum())
    inside = label >= 0
    one = np.eye(label.max() + 1)[label[inside]]
    m = d[np.ix_(inside, inside)] @ one / (one.sum(axis=0) - one)
    a = (m * one).sum(axis=1)
    b = (d[np.ix_(inside, inside)] @ one / one.sum(axis=0) + one * 1e9).min(axis=1)
    assert math.isclose(got["silhouette"], ((b - a) / np.maximum(a, b)).mean(), rel_tol=1e-6)
    assert clustering.mixture_grid(points, [6], [1.0]).first()["clusters"] >= 3
    assert clustering.bootstrap_ari(points, 3, runs=3).first()["mean_ari"] == 1
    assert clustering.prediction_strength(points, [3], repeats=2).first()["strength"] == 1
    assert clustering.gap_statistic(points, [3], references=2).first()["gap"] > 0


def test_grids_have_no_cap_on_rows(spark):
    """More rows than the 20,000 and 5,000 that grids once stopped at, with a far cluster of 12."""
    x = np.concatenate([np.random.default_rng(4).normal(0, 1, (20_400, 2)), np.random.default_rng(5).normal(900, 1, (12, 2))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    assert math.isclose(clustering.kmeans_grid(points, [2]).first()["inertia"], clustering.kmeans(x, 2, 1, starts=1)[2], rel_tol=1e-9)
    got, label = clustering.hdbscan_grid(points.where("id >= 15400"), [10], [5]).first(), clustering.hdbscan(x[15_400:], 10, 5)
    assert (got["clusters"], got["noise"]) == (label.max() + 1, (label < 0).sum())


def test_csv_and_versioned_writes(spark, tmp_path):
    assert io.read_csv(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    (tmp_path / "a.csv").write_text("a,x\n1,2\n,3\n")
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "a.csv"), ["a", "b"]).collect()] == [("1", ""), ("", "")]
    for n in (3, 5):
        io.write_versioned(spark.range(n), str(tmp_path / "out"))
    assert io.read_version(spark, str(tmp_path / "out")).count() == 5 and len(io.versions(spark, str(tmp_path / "out"))) == 2


def test_stream_counts_all_there_is(spark, tmp_path):
    spark.range(100).selectExpr("id % 4 as k").write.parquet(str(tmp_path / "in"))
    got = state.available_now_counts(spark, str(tmp_path / "in"), "k long", "k", str(tmp_path / "cp"), "counts")
    assert {r["k"]: r["n"] for r in got.collect()} == {k: 25 for k in range(4)}


def test_tolerant_sources(spark, tmp_path):
    """JSON maps, array blobs, audio listings, run results by path, and feature folders; what cannot be read is left out."""
    (tmp_path / "cache.json").write_text('{"a": "1", "b": "x"}')
    (tmp_path / "broken.json").write_text('{"a": ')
    got = {n: sorted(tuple(r) for r in io.read_json_map(spark, str(tmp_path / n)).collect()) for n in ("cache.json", "broken.json", "none.json")}
    assert got == {"cache.json": [("a", "1"), ("b", "x")], "broken.json": [], "none.json": []}
    raw = tmp_path / "features" / "raw"
    raw.mkdir(parents=True)
    np.savez(raw / "one.npz", v=np.arange(3.0))
    (raw / "two.npz").write_bytes(b"no zip")
    want = [("one", "v", [0.0, 1.0, 2.0])]
    assert [tuple(r) for r in io.resolve_features(spark, str(tmp_path / "features")).collect()] == want
    with pytest.raises(FileNotFoundError):
        io.resolve_features(spark, str(tmp_path / "nothing"))
    audio = tmp_path / "audio"
    audio.mkdir()
    for name in ("a.wav", "a.mp3", "b.flac", "c.txt"):
        (audio / name).write_bytes(b"x")
    assert sorted((r["stem"], r["path"][-3:]) for r in io.audio_files(spark, str(audio)).collect()) == [("a", "mp3"), ("b", "lac")]
    for source, algorithm in (("x", "kmeans"), ("y", "gmm")):
        (tmp_path / "runs" / source / algorithm).mkdir(parents=True)
        (tmp_path / "runs" / source / algorithm / "run.json").write_text('{"k": 3}')
    runs = io.read_partitioned(spark, str(tmp_path / "runs"), "*/*/run.json", ["source", "algorithm"]).collect()
    assert sorted((r["k"], r["source"], r["algorithm"]) for r in runs) == [(3, "x", "kmeans"), (3, "y", "gmm")]


def test_sinks(spark, tmp_path):
    frames = {"a": spark.range(3), "b": spark.range(4)}
    io.write_together(frames, str(tmp_path / "pair"))
    assert [io.read_version(spark, str(tmp_path / "pair"), n).count() for n in ("a", "b")] == [3, 4]
    assert io.inside("/root/x/../x/y", "/root/x") == "/root/x/y"
    with pytest.raises(ValueError):
        io.inside("/root/x/../y", "/root/x")
    rows = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [3.0, 4.0])], "file string, v array<double>")
    io.write_wide_csv(rows, str(tmp_path / "wide"), "v", "m")
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "wide")).orderBy("file").collect()] == [("a", "3.0", "4.0"), ("b", "1.0", "2.0")]
    assert io.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |"
    with pytest.raises(ValueError):
        io.markdown(spark.range(20), 5)


def test_empty_vectors_and_few_points(spark):
    rows = spark.createDataFrame([(1, []), (2, [1.0]), (3, [1.0, 4.0])], "id long, v array<double>")
    assert {r["id"]: r["d"] for r in rows.select("id", V.flux(F.col("v")).alias("d")).collect()} == {1: [], 2: [], 3: [3.0]}
    points = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [5.0], 1), (4, [9.0], -1)], "id long, v array<double>, label int")
    assert validity.dunn(points).first()["dunn"] is None  # three points, two clusters
    more = points.union(spark.createDataFrame([(5, [5.5], 1)], points.schema))
    assert validity.dunn(more).first()["dunn"] == 4.0


def test_components_against_numpy(spark):
    x = np.random.default_rng(6).normal(size=(300, 5)) @ np.diag([5, 3, 1, 0.1, 0.01])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    mean, axes, shares = linear.components(points)
    values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert np.allclose(shares, values / values.sum()) and linear.choose(shares) == 3 and linear.choose(np.array([1.0])) == 1
    got = {r["id"]: r["v"] for r in linear.projected(points, mean, axes[:2]).collect()}
    assert np.allclose([got[i] for i in range(300)], (x - x.mean(axis=0)) @ axes[:2].T)


def test_block_joins_over_several_groups(spark, monkeypatch):
    """Neighbours, sums and ranks do not depend on how points are dealt; ties go by id."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(700, 3)), 1)
    points = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    monkeypatch.setattr(distances, "_groups", lambda spark, n: 3)
    want = {i: [j for j in np.lexsort((np.arange(700), d[i])) if j != i][:4] for i in range(700)}
    got = {}
    for r in distances.knn(points, points, 4).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got == want
    sums = {(r["id"], r["label"]): (r["n"], r["sum_d"]) for r in distances.label_sums(points).collect()}
    assert all(n == (np.arange(700) % 3 == b).sum() - (i % 3 == b) and math.isclose(s, d[i, np.arange(700) % 3 == b].sum(), rel_tol=1e-6) for (i, b), (n, s) in sums.items())
    near = distances.knn_lsh(points, points, 4, 3, length=2.0)
    found = {}
    for r in near.collect():
        found.setdefault(r["id"], set()).add(round(r["distance"], 6))
    assert sum(len(found.get(i, set()) & {round(d[i, j], 6) for j in want[i]}) for i in range(700)) / sum(len({round(d[i, j], 6) for j in want[i]}) for i in range(700)) > 0.9


def test_sizes_and_their_units(spark):
    """Python's text of exact tenths, halves to the even one; the query's SQL has no unit above GB."""
    rng = np.random.default_rng(9)
    sizes = [0, 1023, 1024, 614_656, 1_048_575, 1_048_576, 2**40 - 1, 2**40, 2**53 + 1, 2**62]
    sizes += [int(x * 2**k) for k in (10, 20, 30, 40) for x in (1.25, 1.35, 1.75, 7.05, 1023.25, 1023.75, 1023.95)] + [int(2**x) for x in rng.uniform(0, 60, 300)]

    def text(n, units):
        k = next((i for i in range(len(units)) if n < 1024 ** (i + 1)), len(units) - 1)
        return f"{n} B" if k == 0 else f"{float(n) / 1024**k:.1f} {units[k]}"

    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", T.human_size(F.col("n")).alias("tb"), T.human_size(F.col("n"), largest="GB").alias("gb"))
    assert [(r["tb"], r["gb"]) for r in rows.collect()] == [(text(n, ["B", "KB", "MB", "GB", "TB"]), text(n, ["B", "KB", "MB", "GB"])) for n in sizes]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Vectors with values that round to a zero with a sign, and halves."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 64)) * 0.05
    x[:, 3], x[:, 5], x[:, 20], x[:, 21] = -1e-9, 1e-9, -2e-8, -0.0
    x[::2] /= 40  # below the peak that is capped
    x[7, :16], x[8, 30] = 0.5, 0.0000125
    folder = tmp_path_factory.mktemp("small")
    rows = pa.table({"vec_id": pa.array(range(200), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * 200, pa.int32())})
    pq.write_table(rows, folder / "embeddings.parquet")
    return str(folder)


def same_bits(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = {i: np.array(v).tobytes() for i, v in con.execute(catalog.SQL[name]).fetchall()}
    got = {i: np.array(v).tobytes() for i, v in catalog.QUERIES[name](spark, folder).collect()}
    return got == want


def test_fused_vectors_keep_signs_at_zero(spark, small):
    assert same_bits(spark, small, "fuse_normalized")


def test_normalized_vectors_keep_signs_at_zero(spark, small):
    assert same_bits(spark, small, "l2_normalize")


def test_capped_vectors_keep_signs_at_zero(spark, small):
    assert same_bits(spark, small, "peak_cap")
