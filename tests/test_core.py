import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkgrove.functions import boxes as B
from sparkgrove.operators.aggregates import prefix_sum
from sparkgrove.operators.dendrogram import dendrogram
from sparkgrove.operators.joins import _closest_of_two, closest_pair, closest_pairs_by_group, range_join
from sparkgrove.operators.knn import core_distance, distances, knn_blocks, near_of_pair
from sparkgrove.operators.mst import Forest, components, forest_edges, kruskal, mst_blocks
from sparkgrove.operators.wspd import box_tree, round_bound, tree_by_windows, window_pairs, wspd
from sparkgrove.plans.hierarchy import dendrogram_of, density_tree, to_linkage
from sparkgrove.sources import points as P
from sparkgrove.sources import sinks as K


def brute_tree(x, k):
    d = distances(x, x)
    cd = np.sort(d, axis=1)[:, k - 1]
    w = np.maximum(np.maximum(d, cd[:, None]), cd[None])
    edges = sorted((w[u, v], u, v) for u in range(len(x)) for v in range(u + 1, len(x)))
    up = list(range(len(x)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    out = []
    for w, u, v in edges:
        if find(u) != find(v):
            up[find(u)] = find(v)
            out.append((u, v, w))
    return out


def tree_rows(df):
    return sorted((r.weight, r.u, r.v) for r in df.collect())


SQUARE = [(0, 0), (0, 1), (1, 0), (1, 1), (10, 10)]
DUPES = [(0, 0), (0, 0), (3, 4), (6, 8), (6, 9)]


@pytest.mark.parametrize("pts, k, core", [(DUPES, 1, [0] * 5), (DUPES, 2, [0, 0, 5, 1, 1]), (DUPES, 3, [5, 5, 5, 5, 34**0.5]), (SQUARE, 3, [1, 1, 1, 1, 181**0.5]), ([(10, 0), (0, 0), (-1, 0)], 3, [11, 10, 11])])
def test_core_distance(spark, pts, k, core):
    df = P.from_numpy(spark, np.array(pts))
    assert [r.cd for r in core_distance(df, k).orderBy("id").collect()] == pytest.approx(core)


def test_dendrogram_fixtures(spark):
    rows = to_linkage(dendrogram_of(P.from_numpy(spark, np.array(DUPES)), 2)).tolist()
    assert rows == [[0, 1, 0, 2], [3, 4, 1, 2], [5, 2, 5, 3], [7, 6, 5, 5]]
    rows = to_linkage(dendrogram_of(P.from_numpy(spark, np.array(SQUARE)), 1))[:, :2].tolist()
    assert rows == [[0, 1], [5, 2], [6, 3], [7, 4]]
    assert to_linkage(dendrogram_of(P.from_numpy(spark, np.array([(0, 0), (3, 4)])), 2)).tolist() == [[0, 1, 5, 2]]


def test_point_file_to_linkage(spark, tmp_path):
    x = np.random.default_rng(40).normal(size=(40, 3)).round(6)
    (tmp_path / "p.txt").write_text("".join(" ".join(map(repr, r)) + "\n" for r in x.tolist()))
    pts = P.read_points(spark, str(tmp_path / "p.txt"))
    assert pts.count() == 40
    m = to_linkage(dendrogram_of(pts, 5))
    want = brute_tree(x, 5)
    assert m[:, 2].tolist() == [w for _, _, w in want] and m[0].tolist() == [*want[0][:2], want[0][2], 2] and m[-1, 3] == 40


def boxes(spark, rows):
    return spark.createDataFrame(rows, "lo1 array<double>, hi1 array<double>, lo2 array<double>, hi2 array<double>")


def test_separation_of_unequal_boxes(spark):
    rows = [
        ([0.0, 0.0], [6.0, 8.0], [30.0, 0.0], [30.0, 8.0]),  # centres 27, radii 5 and 4: gap 18 >= 2 * 5
        ([0.0, 0.0], [6.0, 8.0], [22.0, 0.0], [22.0, 8.0]),  # gap 19 - 9 = 10 >= 10
        ([0.0, 0.0], [6.0, 8.0], [21.0, 0.0], [21.0, 8.0]),  # gap 9
        ([0.0, 0.0], [6.0, 8.0], [1.0, 1.0], [2.0, 2.0]),
    ]
    got = boxes(spark, rows).select(B.sphere_gap("lo1", "hi1", "lo2", "hi2").alias("g"), B.well_separated("lo1", "hi1", "lo2", "hi2").alias("s"), B.min_distance("lo1", "hi1", "lo2", "hi2").alias("d"), B.relation("lo1", "hi1", "lo2", "hi2").alias("r")).collect()
    assert [r.g for r in got[:3]] == [18.0, 10.0, 9.0] and got[3].g < 0
    assert [r.s for r in got] == [True, True, False, False]
    assert [r.d for r in got] == [24.0, 16.0, 15.0, 0.0]
    assert [r.r for r in got] == ["exclude", "exclude", "exclude", "include"]


@pytest.mark.parametrize("cores, far", [((1.0, 2.0, 1.0, 2.0), False), ((12.0, 12.0, 1.0, 3.0), True), ((12.0, 13.0, 1.0, 3.0), False), ((1.0, 1.0, 10.0, 10.0), True)])
def test_unreachable_by_core_distance(spark, cores, far):
    d = boxes(spark, [([0.0, 0.0], [6.0, 8.0], [12.0, 0.0], [12.0, 8.0])])  # gap 0, diagonals 10 and 8
    m1, x1, m2, x2 = map(F.lit, cores)
    assert d.select(B.unreachable("lo1", "hi1", m1, x1, "lo2", "hi2", m2, x2)).first()[0] is far


def test_command_line(spark, tmp_path, capsys):
    from sparkgrove.__main__ import main

    (tmp_path / "p.txt").write_text("0 0\n0 0\n3 4\n6 8\n6 9\n")
    assert main(["-m", "2", "-r", "2", "-o", str(tmp_path / "out"), str(tmp_path / "p.txt")]) == 0
    said = capsys.readouterr().out
    assert said.count("core-dist") == 2 and said.count("tree") == 2 and said.count("dendrogram") == 2 and said.count("pairs") >= 2
    rows = [r.value.split() for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted([int(a), int(b), float(h), int(n)] for a, b, h, n in rows) == [[0, 1, 0, 2], [3, 4, 1, 2], [5, 2, 5, 3], [7, 6, 5, 5]]


def test_pairs_cover_all_points_once(spark):
    x = np.concatenate([np.random.default_rng(2).normal(size=(60, 2)), np.zeros((3, 2)), [[50.0, 50.0]]])
    tree = box_tree(P.from_numpy(spark, x), len(x), 2, 1)
    pairs, nodes = wspd(tree).collect(), {r.node: r for r in tree.collect()}

    def leaves(k):
        return leaves(nodes[k].a) | (leaves(nodes[k].b) if nodes[k].b != nodes[k].a else set()) if nodes[k].a is not None else {k}

    seen = [tuple(sorted((a, b))) for r in pairs for a in leaves(r.u) for b in leaves(r.v)]
    count = sum(r.a is None for r in nodes.values())
    assert len(seen) == len(set(seen)) == count * (count - 1) // 2
    assert 0 < sum(r.separated for r in pairs) and len(pairs) < len(seen)


@pytest.mark.parametrize("k", [1, 4])
def test_tree_by_windows(spark, k):
    x = np.round(np.random.default_rng(k).normal(size=(120, 2)), 1)
    cd = np.sort(distances(x, x), axis=1)[:, k - 1]
    p = spark.createDataFrame([(i, x[i].tolist(), float(cd[i])) for i in range(120)], "id long, c array<double>, cd double")
    got = tree_rows(tree_by_windows(p, 120, 2, 4, most=16))
    assert len(got) == 119 and [w for w, _, _ in got] == [w for _, _, w in brute_tree(x, k)]


def test_windows_and_bound(spark):
    x = np.random.default_rng(5).normal(size=(80, 2))
    tree = box_tree(P.from_numpy(spark, x), 80, 2, 4)
    pairs = wspd(tree, mutual=True).collect()
    large = [r.lower for r in pairs if r.n_u + r.n_v > 12]
    assert round_bound(tree, 12) == min(large) and round_bound(tree, 160) == float("inf")
    high = sorted(r.lower for r in pairs)[len(pairs) // 2]
    assert {(r.u, r.v) for r in window_pairs(tree, -1.0, high).collect()} == {(r.u, r.v) for r in pairs if r.lower < high}
    one = tree.withColumn("comp", F.lit(0))
    assert window_pairs(one, -1.0, high).count() == 0


def test_closest_pair_prunes(spark):
    rng = np.random.default_rng(6)
    a, b = (P.from_numpy(spark, rng.normal(size=(300, 2)) + k) for k in (0, 4))
    x, y = (np.array([r.c for r in t.orderBy("id").collect()]) for t in (a, b))
    d = distances(x, y)
    i, j = np.unravel_index(d.argmin(), d.shape)
    got = closest_pair(a, b.select((F.col("id") + 1000).alias("id"), "c"), 2, block_size=8).first()
    assert (got.u, got.v, got.weight) == (i, j + 1000, d.min())


@pytest.mark.parametrize("mutual", [False, True])
def test_closest_pairs_of_groups(spark, mutual):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(240, 2)), 1) + rng.integers(0, 4, (240, 1)) * 3
    g, cd = rng.integers(0, 4, 240), np.round(rng.uniform(size=240), 1)
    p = spark.createDataFrame([(i, x[i].tolist(), int(g[i]), float(cd[i])) for i in range(240)], "id long, c array<double>, label int, cd double")
    d = distances(x, x)
    w = np.maximum(np.maximum(d, cd[:, None]), cd[None]) if mutual else d
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    want = {(a, b): min((w[i, j], min(i, j), max(i, j)) for i in np.flatnonzero(g == a) for j in np.flatnonzero(g == b)) for a, b in pairs}
    got = closest_pairs_by_group(p, "label", 2, mutual, block_size=8).collect()
    assert {(r.group_a, r.group_b): (r.weight, r.u, r.v) for r in got} == want


def test_closest_of_two_blocks(spark):
    x = np.round(np.random.default_rng(9).normal(size=(90, 2)), 1)
    left, cd = np.arange(90) % 3 == 0, np.round(np.random.default_rng(3).uniform(size=90), 1)
    w = np.maximum(np.maximum(distances(x, x), cd[:, None]), cd[None])
    want = min((w[i, j], min(i, j), max(i, j)) for i in np.flatnonzero(left) for j in np.flatnonzero(~left))
    got = _closest_of_two(pd.DataFrame({"id": np.arange(90), "c": list(x), "cd": cd, "left": left, "a": 0, "b": 1})).iloc[0]
    assert (got.weight, got.u, got.v) == want


def test_prefix_sum(spark):
    v = np.random.default_rng(1).integers(0, 9, 200)
    d = spark.createDataFrame([(int(k), int(x)) for k, x in enumerate(v)], "k long, x long").repartition(5)
    assert [r.before for r in prefix_sum(d, "x", ["k"]).orderBy("k").collect()] == (np.cumsum(v) - v).tolist()
    assert prefix_sum(d.limit(0), "x", ["k"]).count() == 0


@pytest.mark.parametrize("k", [1, 5])
def test_blocks_equal_bruteforce(spark, k):
    rng = np.random.default_rng(k)
    x = np.round(rng.normal(size=(400, 3)) * 4) / 4 + rng.integers(0, 3, (400, 1)) * 10
    df = P.from_numpy(spark, x)
    near = knn_blocks(df, 400, k, 3, block_size=40)
    assert near.count() == 400 * k
    cd = near.filter(F.col("rank") == k).select("id", F.col("dist").alias("cd"))
    got = tree_rows(mst_blocks(df.join(cd, "id"), 400, 3, block_size=40))
    assert got == sorted((w, u, v) for u, v, w in brute_tree(x, k))


@pytest.mark.parametrize("fold_edges", [0, 7, 10**6])
def test_forest_by_rounds(spark, fold_edges):
    rng = np.random.default_rng(9)
    star = [(0, k, 1.0) for k in range(1, 60)]
    chain = [(k, k + 1, float(k)) for k in range(100, 160)]
    some = [(int(u), int(v), float(w)) for u, v, w in zip(rng.integers(200, 300, 400), rng.integers(200, 300, 400), rng.integers(0, 5, 400))]
    rows = star + chain + some + some[:50] + [(v, u, w) for u, v, w in some[:50]]
    e = spark.createDataFrame(rows, "u long, v long, weight double").repartition(3)
    forest, want = Forest(), []
    for w, u, v in sorted({(w, min(u, v), max(u, v)) for u, v, w in rows}):
        if forest.link(u, v):
            want.append((w, u, v))
    got = kruskal(e, 2, fold_edges=fold_edges)
    assert tree_rows(got) == want
    comp = {r.id: r.comp for r in components(got, len(want), fold_edges).collect()}
    ids = {i for _, u, v in want for i in (u, v)}
    assert set(comp) == ids and all((comp[i] == comp[j]) == (forest.find(i) == forest.find(j)) for i in ids for j in ids)
    assert kruskal(e.limit(0), fold_edges=fold_edges).count() == 0


@pytest.mark.parametrize("k", [1, 3, 5])
def test_copies_stay_out_of_blocks(spark, k):
    rng = np.random.default_rng(k)
    x = np.concatenate([np.tile([[1.0, 2.0]], (60, 1)), rng.integers(0, 6, (90, 2)).astype(float), -np.zeros((4, 2)), np.zeros((3, 2))])[rng.permutation(157)]
    df = P.from_numpy(spark, x)
    d = distances(x, x)
    want = np.argsort(d, axis=1, kind="stable")[:, :k]
    got = {(r.id, r.rank): (r.nbr, r.dist) for r in knn_blocks(df, 157, k, 2, block_size=8).collect()}
    assert got == {(i, j + 1): (want[i, j], d[i, want[i, j]]) for i in range(157) for j in range(k)}
    cd = df.withColumn("cd", F.element_at(F.array(*map(F.lit, np.sort(d, axis=1)[:, k - 1].tolist())), (F.col("id") + 1).cast("int")))
    assert tree_rows(mst_blocks(cd, 157, 2, block_size=8)) == sorted((w, u, v) for u, v, w in brute_tree(x, k))


@pytest.mark.parametrize("k", [1, 4])
def test_edges_without_cycles(spark, k):
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(size=(200, 2)).round(1), np.tile([[1.0, 2.0]], (60, 1)), np.zeros((3, 2))])[rng.permutation(263)]
    cd = np.sort(distances(x, x), axis=1)[:, k - 1]
    p = spark.createDataFrame([(i, x[i].tolist(), float(cd[i])) for i in range(263)], "id long, c array<double>, cd double")
    e = forest_edges(p, 263, 2, block_size=64)
    assert e.count() <= 263 * 8 < 263 * 262 // 2
    assert tree_rows(kruskal(e, 2)) == sorted((w, u, v) for u, v, w in brute_tree(x, k))
    assert tree_rows(forest_edges(p.filter("id = 0"), 1, 2)) == []


def test_tree_of_far_groups_takes_few_comparisons(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(150, 2)), rng.normal(size=(100, 2)) + 40, [[500.0, -300.0]]]).round(2)
    cd = np.sort(distances(x, x), axis=1)[:, 2]
    p = spark.createDataFrame([(i, x[i].tolist(), float(cd[i])) for i in range(251)], "id long, c array<double>, cd double")
    rounds = []
    assert tree_rows(mst_blocks(p, 251, 2, block_size=4, rounds=rounds)) == sorted((w, u, v) for u, v, w in brute_tree(x, 3))
    assert 2 <= len(rounds) <= 9 and sum(r["pairs"] for r in rounds) < 2 * 251


def test_pairs_of_blocks_equal_bruteforce(spark):
    x = np.random.default_rng(5).normal(size=(300, 20)).round(1)
    x[100:140] = x[:40]
    df, d = P.from_numpy(spark, x).withColumn("label", F.lit(1)), distances(x, x)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    got = {(r.id, r.rank): (r.nbr, r.dist) for r in knn_blocks(df, 300, 4, 20, block_size=8, pair_points=60).collect()}
    assert got == {(i, j + 1): (want[i, j], d[i, want[i, j]]) for i in range(300) for j in range(4)}


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1.0, 1e7), (1e-15, 0.0), (1e150, 0.0)])
def test_products_keep_to_the_radius(scale, shift):
    rng = np.random.default_rng(12)
    x, y = (rng.normal(size=(n, 20)) * scale + shift for n in (60, 70))
    d = distances(x, y)
    most, y_most = np.sort(d, axis=1)[:, 3] ** 2 * (1 + 1e-12), np.sort(d, axis=0)[2] ** 2 * (1 + 1e-12)
    i, j, w = near_of_pair(x, np.arange(60), most, y, np.arange(70) + 100, y_most, 70)
    got = dict(zip(zip(i.tolist(), j.tolist()), w))
    want = {(int(r), int(c) + 100): d[r, c] for r, c in zip(*np.nonzero(d**2 <= most[:, None]))}
    want |= {(int(c) + 100, int(r)): d[r, c] for r, c in zip(*np.nonzero(d**2 <= y_most[None]))}
    assert want.items() <= got.items() and len(got) <= 1.1 * len(want)  # few beyond the radius, near the origin or not


@pytest.mark.parametrize("k, d", [(5, 3), (20, 3), (5, 8)])
def test_lists_are_looked_for_once(spark, monkeypatch, k, d):
    from sparkgrove.operators import knn, mst
    from sparkgrove.plans import hierarchy

    calls = []
    for module in (knn, mst, hierarchy):
        monkeypatch.setattr(module, "knn_blocks", lambda *args: calls.append(1) or knn_blocks(*args), raising=False)
    x = np.random.default_rng(k).normal(size=(120, d)).round(1)
    x[10:13] = x[0]  # copies, but fewer than k
    got = tree_rows(density_tree(P.from_numpy(spark, x), k))
    assert got == sorted((w, u, v) for u, v, w in brute_tree(x, k)) and len(calls) == 1


def test_tree_of_copies_alone(spark):
    df = P.from_numpy(spark, np.ones((5, 2))).withColumn("cd", F.lit(0.0))
    assert tree_rows(mst_blocks(df, 5, 2)) == [(0.0, 0, v) for v in range(1, 5)]


def test_tree_by_rounds(spark):
    x = np.round(np.random.default_rng(4).normal(size=(150, 2)) * 4) / 4
    df = P.from_numpy(spark, x).withColumn("cd", F.lit(0.0))
    assert tree_rows(mst_blocks(df, 150, 2, block_size=30, fold_edges=20)) == sorted((w, u, v) for u, v, w in brute_tree(x, 1))


def test_strict_pruning_keeps_canonical_edges(spark):
    df = P.from_numpy(spark, np.array([(10, 0), (0, 0), (-1, 0)]))
    cd = df.join(core_distance(df, 3), "id")
    assert [r[1:] for r in tree_rows(mst_blocks(cd, 3, 2, block_size=1))] == [(0, 1), (0, 2)]


def test_range_join(spark):
    x = np.random.default_rng(0).uniform(size=(200, 4))
    df = P.from_numpy(spark, x)
    got = {(r.id, r.nbr) for r in range_join(df, df, 0.3, 4).collect()}
    assert got == set(zip(*np.nonzero(distances(x, x) <= 0.3)))


def test_range_join_keeps_pairs_at_the_radius(spark):
    df = P.from_numpy(spark, np.array([[0.1, 0.0], [-5e-324, 0.0], [1e300, 0.0]]))  # 0.1 / 0.1 is 1, -5e-324 / 0.1 below 0
    got = sorted(tuple(r) for r in range_join(df, df, 0.1, 2).collect())
    assert got == [(0, 0, 0.0), (0, 1, 0.1), (1, 0, 0.1), (1, 1, 0.0), (2, 2, 0.0)]


def test_range_join_deals_copies(spark, monkeypatch):
    monkeypatch.setattr("sparkgrove.operators.joins.SIDE", 4)
    x = np.concatenate([np.zeros((40, 2)), np.random.default_rng(1).uniform(size=(300, 2))])
    a, b = P.from_numpy(spark, x), P.from_numpy(spark, x[:50])
    for other, y in ((a, x), (b, x[:50])):
        want = sorted(zip(*np.nonzero(distances(x, y) <= 0.2)))
        found = range_join(a, other, 0.2, 2)
        got = found.collect()
        assert sorted((r.id, r.nbr) for r in got) == want
        assert all(r.dist == distances(x[r.id : r.id + 1], y[r.nbr : r.nbr + 1])[0, 0] for r in got[:500])
        pieces = found.select(F.spark_partition_id().alias("p"), "id", "nbr").filter("id < 40 and nbr < 40").groupBy("p").count().collect()
        assert max(r["count"] for r in pieces) < 800  # of 1600 pairs of copies
    one = a.filter("id < 40").withColumn("id", F.lit(7).cast("long"))
    assert range_join(one, one, 0.2, 2).count() == range_join(one, a.filter("id < 40"), 0.2, 2).count() == 1600


def test_range_join_odd_rows(spark):
    rows = [(0, [0.0, 0.0]), (1, None), (2, [None, 0.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [0.0]), (6, [0.0, 0.0]), (None, [0.05, 0.0]), ((1 << 60) + 1, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, c array<double>")
    pairs = lambda *a: sorted(((r.id, r.nbr) for r in range_join(*a, 2).collect()), key=str)
    near = [0, 6, None]
    far = (rows[-1][0],) * 2
    assert pairs(df, df, 0.1) == sorted([(i, j) for i in near for j in near] + [far], key=str)
    assert pairs(df, df, 0.0) == sorted([(i, j) for i in (0, 6) for j in (0, 6)] + [(None, None), far], key=str)
    assert pairs(df, df, -1.0) == pairs(df, df.filter("id < 0"), 0.1) == pairs(df.filter("id < 0"), df, 0.1) == []


def test_numbers_round_as_in_c(spark):
    x = np.concatenate([np.random.default_rng(3).uniform(size=(300, 2)).round(12) + 1, [[1.000000000005, 2.5e-300], [-0.0, 0.1]]])
    got = {r.id: r.value for r in K.point_lines(P.from_numpy(spark, x)).collect()}
    assert got == {i: " ".join("%.11e" % v for v in r) for i, r in enumerate(x.tolist())}
    e = spark.createDataFrame([(0, 1, 1.000000000005)], "u long, v long, weight double")
    assert K.edge_lines(e).first().value == "0 1 %.11e" % 1.000000000005


def test_kruskal_forest_and_errors(spark):
    e = spark.createDataFrame([(1, 0, 2.0), (1, 2, 1.0), (0, 2, 2.0), (5, 6, 1.0), (3, 3, 0.0)], "u long, v long, weight double")
    assert tree_rows(kruskal(e, 3)) == [(1.0, 1, 2), (1.0, 5, 6), (2.0, 0, 1)]
    with pytest.raises(ValueError):
        dendrogram(e, 3)
    cycle = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "u long, v long, weight double")
    with pytest.raises(Exception, match="cycle"):
        dendrogram(cycle, 3).collect()


@pytest.mark.parametrize("a, k", [(np.zeros((1, 2)), 1), (np.zeros((3, 1)), 1), (np.zeros((3, 21)), 1), (np.zeros(4), 1), (np.zeros((3, 2)), 0), (np.zeros((3, 2)), 4), (np.array([[1, np.nan], [0, 1]]), 1)])
def test_value_errors(spark, a, k):
    with pytest.raises(ValueError):
        density_tree(P.from_numpy(spark, a), k)


TEXTS = ["1,2\n3,4\n5,6\n7,8\n", "1\t2\n3\t4\n5\t6\n7\t8", "1;2\n3;4\n5;6\n7;8\n", "1, 2\n3, 4\n5, 6\n7, 8\n", "1 2\r\n3 4\r\n5 6\r\n7 8\r\n", "pbbs_sequencePoint2d\n1 2\n3 4\n5 6\n7 8\n", "x,y\n1e0,2E0\n3,4\n5,6\n7,8\n"]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_text_formats(spark, tmp_path, i):
    (tmp_path / "p.csv").write_bytes(TEXTS[i].encode())
    got = [(r.id, r.c) for r in P.read_points(spark, str(tmp_path / "p.csv")).orderBy("id").collect()]
    assert got == [(0, [1, 2]), (1, [3, 4]), (2, [5, 6]), (3, [7, 8])]


@pytest.mark.parametrize("text", ["", "1 2\n3\n", "1 2\nx 3\n", "1 2\nnan 3\n"])
def test_text_errors(spark, tmp_path, text):
    (tmp_path / "p.csv").write_text(text)
    with pytest.raises(ValueError):
        P.read_points(spark, str(tmp_path / "p.csv"))


def test_sinks_round_trip(spark, tmp_path):
    df = P.from_numpy(spark, np.array(SQUARE))
    K.write_points(df, str(tmp_path / "p"))
    assert sorted(tuple(r.c) for r in P.read_points(spark, str(tmp_path / "p")).collect()) == sorted(SQUARE)
    K.write_points_with_header(df, str(tmp_path / "h"), 2)
    assert P.read_points(spark, str(tmp_path / "h")).count() == 5
    seq = spark.createDataFrame([(0, 5), (1, 7)], "pos long, value long")
    K.write_int_sequence(seq, str(tmp_path / "s"))
    assert [r.value for r in P.read_int_sequence(spark, str(tmp_path / "s")).orderBy("pos").collect()] == [5, 7]
    K.write_edges(density_tree(df, 1), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).first().value == "0 1 1.00000000000e+00"
    K.write_two_sequences(seq, seq, str(tmp_path / "t"), "value", "pos")
    assert spark.read.text(str(tmp_path / "t")).count() == 4
