"""Vertex orders, their metrics and the spectral values against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import curves, degrees, distances, motifs, ordering, pagerank, simplify, spectral


def random_edges(n, m, seed, loops=True):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


GRAPHS = {
    "path": [(k, k + 1) for k in range(7)],
    "star": [(0, k) for k in range(1, 6)],
    "bridge": [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)],
    "pieces": [(0, 1), (2, 3), (3, 4), (5, 6), (6, 7), (7, 5), (8, 9), (9, 10), (10, 11), (11, 8), (8, 10)],
    "random": random_edges(30, 60, 1),
}


@pytest.fixture(scope="module")
def graphs(spark):
    return {k: simplify.simplify(spark.createDataFrame(e, "src long, dst long")) for k, e in GRAPHS.items()}


def plain(g):
    n = g.n()
    near = {v: set() for v in range(n)}
    edges = [(r["src"], r["dst"]) for r in g.edges.collect()]
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return n, edges, near


def pieces(left, near):
    out, seen = [], set()
    for v in sorted(left):
        if v not in seen:
            todo, part = [v], set()
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += [y for y in near[x] if y in left and y not in part]
            seen |= part
            out.append(sorted(part))
    return out


def plain_cuthill_mckee(n, near):
    order = []
    for part in sorted(pieces(set(range(n)), near), key=lambda p: min((len(near[v]), v) for v in p)):
        level = [min(part, key=lambda v: (len(near[v]), v))]
        done = set(level)
        while level:
            order += level
            parent = {}
            for place, v in enumerate(level):
                for w in near[v]:
                    if w not in done:
                        parent.setdefault(w, place)
            level = sorted(parent, key=lambda w: (parent[w], len(near[w]), w))
            done |= set(level)
    return {v: k for k, v in enumerate(order)}


def plain_slashburn(n, near, share):
    k, place, front, back, left, rounds = max(1, int(n * share)), {}, 0, n, set(range(n)), 0
    while left:
        rounds += 1
        hubs = sorted(left, key=lambda v: (-sum(w in left for w in near[v]), v))[:k]
        for v in hubs:
            place[v] = front
            front += 1
        left -= set(hubs)
        parts = sorted(pieces(left, near), key=lambda p: (-len(p), p[0]))
        if not parts:
            break
        for part in parts[1:]:
            back -= len(part)
            for i, v in enumerate(part):
                place[v] = back + i
        left = set(parts[0])
        if len(left) < k:
            for i, v in enumerate(sorted(left)):
                place[v] = front + i
            break
    return place, k, rounds


def placed(order):
    return {r["id"]: r["new_id"] for r in order.collect()}


@pytest.mark.parametrize("name", GRAPHS)
def test_cuthill_mckee_is_the_plain_one(graphs, name):
    g = graphs[name]
    n, edges, near = plain(g)
    want = plain_cuthill_mckee(n, near)
    order = ordering.cuthill_mckee(g)
    assert placed(order) == want
    assert placed(ordering.reverse(order)) == {v: n - 1 - k for v, k in want.items()}
    assert ordering.bandwidth(g.edges, order).head()[0] == max(abs(want[a] - want[b]) for a, b in edges)


@pytest.mark.parametrize(("name", "share"), [("path", 0.1), ("star", 0.1), ("bridge", 0.1), ("pieces", 0.2), ("random", 0.1)])
def test_slashburn_is_the_plain_one(graphs, name, share):
    g = graphs[name]
    n, _, near = plain(g)
    place, k, rounds = plain_slashburn(n, near, share)
    order, done = ordering.slashburn(g, share)
    assert placed(order) == place and done == {"k": k, "n_iters": rounds}
    assert ordering.slashburn_metrics(n, k, rounds)["wing_width_ratio"] == k * rounds / n


def test_merged_communities(spark, graphs):
    cliques = [(a + 6 * c, b + 6 * c) for c in range(3) for a in range(6) for b in range(a)] + [(0, 6), (7, 12)]
    g = simplify.simplify(spark.createDataFrame(cliques, "src long, dst long"))
    merged = ordering.modularity_merge(g)
    tops = {r["id"]: r["path"][0] for r in merged.collect()}
    assert all(len({tops[6 * c + k] for k in range(6)}) == 1 for c in range(3)) and len(set(tops.values())) == 3
    order = placed(ordering.hierarchy_order(g))
    assert sorted(order.values()) == list(range(18))
    for c in range(3):
        at = sorted(order[6 * c + k] for k in range(6))
        assert at[-1] - at[0] == 5
    q = ordering.modularity(g, merged.select("id", F.col("path")[0].alias("comm"))).head()[0]
    m = len(cliques)
    deg = [sum(v in e for e in cliques) for v in range(18)]
    want = sum(1 for a, b in cliques if a // 6 == b // 6) / m - sum(sum(deg[6 * c : 6 * c + 6]) ** 2 for c in range(3)) / (4 * m * m)
    assert abs(q - want) < 1e-12
    one = ordering.modularity_merge(graphs["random"]).collect()
    assert sorted(r["id"] for r in one) == list(range(graphs["random"].n()))


def matrices(g):
    n, edges, near = plain(g)
    a, s = np.zeros((n, n)), np.zeros((n, n))
    for x, y in edges:
        a[x, y] = s[x, y] = s[y, x] = 1
    return a, s, pieces(set(range(n)), near)


@pytest.mark.parametrize("name", ["bridge", "pieces", "random"])
def test_spectral_values_are_those_of_dense_matrices(graphs, name):
    g = graphs[name]
    a, s, parts = matrices(g)
    values = np.sort(np.abs(np.linalg.eigvalsh(s)))[::-1]
    first, second = spectral.spectral_norm(g)
    assert first == pytest.approx(values[0], abs=1e-6)
    distinct = [x for x in values[1:] if abs(x - values[0]) > 1e-9 or name == "random"]
    assert second == pytest.approx(distinct[0], abs=1e-5)
    assert spectral.operator_norm(g) == pytest.approx(np.linalg.norm(a, 2), abs=1e-6)
    assert spectral.cyclic_eigenvalue(g) == pytest.approx(np.abs(np.linalg.eigvals(a)).max(), abs=1e-4)
    top = max(parts, key=lambda p: (len(p), -p[0]))
    lap = np.diag(s.sum(1)) - s
    inside = lap[np.ix_(top, top)]
    assert spectral.algebraic_connectivity(g) == pytest.approx(np.linalg.eigvalsh(inside)[1], abs=1e-6)


def test_directed_cycles_have_complex_values(spark):
    ring = simplify.simplify(spark.createDataFrame([(k, (k + 1) % 5) for k in range(5)] + [(0, 2)], "src long, dst long"))
    a, _, _ = matrices(ring)
    assert spectral.cyclic_eigenvalue(ring) == pytest.approx(np.abs(np.linalg.eigvals(a)).max(), abs=1e-6)


def test_values_by_inverse(graphs):
    g = graphs["bridge"]
    _, s, _ = matrices(g)
    lap = np.linalg.eigvalsh(np.diag(s.sum(1)) - s)
    both = simplify.symmetrize(g.edges)
    got = spectral.smallest_by_inverse(g.vertices, spectral.laplacian_product(both), -1.0, 2)
    assert got == pytest.approx(lap[:2], abs=1e-6)


def test_four_cycles_of_a_random_graph(graphs):
    g = graphs["random"]
    _, s, _ = matrices(g)
    n = len(s)
    c = s @ s
    want = sum(c[i, j] * (c[i, j] - 1) / 2 for i in range(n) for j in range(i)) / 2
    m = motifs.motif_counts(g).head()
    assert m["cycle_4"] + m["chordal_cycle_4"] + 3 * m["clique_4"] == want


def test_diameter_of_the_largest_strong_component(spark):
    g = simplify.simplify(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5)], "src long, dst long"))
    assert distances.diameter(g) == 3


def test_p_values(spark):
    df = spark.createDataFrame([(float(x), float(x % 7)) for x in range(40)], "x double, y double")
    got = degrees.with_p_value(df.agg(F.corr("x", "y").alias("r")), "r", 40).head()
    x, y = np.arange(40.0), np.arange(40) % 7.0
    r = np.corrcoef(x, y)[0, 1]
    t = r * np.sqrt(38 / (1 - r * r))
    u = np.linspace(0, abs(t), 200_001)
    density = (1 + u * u / 38) ** (-39 / 2)
    whole = np.linspace(0, 400, 4_000_001)
    norm = ((1 + whole**2 / 38) ** (-39 / 2)).sum() * (whole[1] - whole[0])
    p = 1 - density.sum() * (u[1] - u[0]) / norm
    assert got["r"] == pytest.approx(r) and got["p_value"] == pytest.approx(p, abs=1e-3)


@pytest.mark.parametrize("w", range(1, 14))
def test_rectangle_walk_visits_every_cell_once_in_unit_steps(w):
    for h in range(1, 14):
        cells = list(curves.rectangle_walk(w, h))
        assert sorted(cells) == [(x, y) for x in range(w) for y in range(h)]
        assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(cells, cells[1:], strict=False))


def test_numbers_do_not_depend_on_the_partitions(spark):
    from edgeloom.plans.ranking import numbered

    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 3).alias("t"))
    got = numbered(df.repartition(7), "n", [F.desc("t"), "k"]).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(5000))
    assert [(r["t"], r["k"]) for r in got] == sorted(((r["t"], r["k"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert numbered(df.limit(0), "n", ["k"]).count() == 0


def test_experiments_are_timed_and_valid(spark, graphs):
    g = graphs["bridge"]
    runs = pagerank.experiments(g, {"orig": ordering.original(g), "rnd": ordering.random_order(g)}, ["row", "hilbert"], rounds=6).collect()
    assert {(r["vertex_order"], r["edge_order"]) for r in runs} == {(a, b) for a in ("orig", "rnd") for b in ("row", "hilbert")}
    assert all(r["valid"] == 1 and r["ms"] > 0 and r["m"] == 7 for r in runs)


def test_power_law_fit_and_its_p_value():
    rng = np.random.default_rng(2)
    x = np.arange(1, 3000)
    p = x**-2.3 / (x**-2.3).sum()
    values, counts = np.unique(rng.choice(x, 3000, p=p), return_counts=True)
    fit = degrees.fitted_power_law(values.astype(float), counts)
    assert abs(fit["alpha"] - 2.3) < 0.2 and degrees.power_law_p_value(values.astype(float), counts, fit, 20) > 0.05
    values, counts = np.unique(rng.poisson(40, 3000), return_counts=True)
    poor = degrees.fitted_power_law(values.astype(float), counts)
    assert poor["alpha"] > 3 or degrees.power_law_p_value(values.astype(float), counts, poor, 20) < 0.2


def test_scores_do_not_depend_on_how_they_are_sent(spark, graphs, monkeypatch):
    g = graphs["random"]
    want = {r["id"]: r["score"] for r in pagerank.pagerank(g).collect()}
    monkeypatch.setattr(pagerank, "SENT_TO_ALL", 0)
    monkeypatch.setattr(pagerank, "HUB", 2)
    got = {r["id"]: r["score"] for r in pagerank.pagerank(g).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
