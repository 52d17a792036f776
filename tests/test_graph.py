"""Operators on graphs small enough to check by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import components, curves, degrees, distances, motifs, ordering, pagerank, scc, simplify, spectral

HAND = {
    "path5": [(0, 1), (1, 2), (2, 3), (3, 4)],
    "star6": [(0, k) for k in range(1, 6)],
    "k5": [(a, b) for a in range(5) for b in range(a + 1, 5)],
    "bridge": [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)],
    "chord": [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)],
    "sink": [(0, 1), (1, 2), (2, 0), (2, 3)],
    "messy": [(7, 7), (5, 9), (5, 9), (9, 5), (3, 3)],
}


@pytest.fixture
def graph(spark):
    def make(name):
        return simplify.simplify(spark.createDataFrame(HAND[name], "src long, dst long"))

    return make


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_simplify_drops_loops_first_and_repeats(graph):
    g = graph("messy")
    assert rows(g.edges, "src", "dst") == [(0, 1), (1, 0)]
    assert rows(g.vertices, "id", "orig_id") == [(0, 5), (1, 9)]


def test_simplify_of_nothing(spark):
    g = simplify.simplify(spark.createDataFrame([], "src long, dst long"))
    assert g.n() == 0 and g.m() == 0 and degrees.degrees(g).count() == 0


def test_degrees_sum_to_edges(graph):
    s = degrees.degrees(graph("bridge")).agg(F.sum("out_deg"), F.sum("in_deg"), F.sum("deg")).head()
    assert tuple(s) == (7, 7, 14)


def test_pagerank_keeps_no_dangling_mass(graph):
    g = graph("sink")
    p, n, out = np.full(4, 0.25), 4, [1, 1, 2, 0]
    for _ in range(20):
        q = np.full(4, 0.15 / n)
        for s, d in HAND["sink"]:
            q[d] += 0.85 * p[s] / out[s]
        p = q
    got = [r[1] for r in rows(pagerank.pagerank(g), "id", "score")]
    assert np.allclose(got, p, atol=1e-12) and sum(got) < 1


def test_components_and_strong_components(graph, spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 7), (None, 4)], "src long, dst long")
    assert rows(components.connected_components(links), "id", "comp") == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 8), (9, 8)]
    assert rows(scc.strongly_connected(graph("sink")), "id", "scc") == [(0, 2), (1, 2), (2, 2), (3, 3)]


def test_components_of_a_long_path(spark):
    links = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert components.connected_components(links).agg(F.count_distinct("comp"), F.max("comp")).head() == (1, 0)


@pytest.mark.parametrize(("name", "k3", "k4"), [("k5", 10, 5), ("bridge", 2, 0), ("chord", 2, 0), ("star6", 0, 0)])
def test_cliques(graph, name, k3, k4):
    g = graph(name)
    assert motifs.clique_count(g, 3).head()[0] == k3 and motifs.clique_count(g, 4).head()[0] == k4


def test_induced_motifs(graph):
    chord = motifs.motif_counts(graph("chord")).head()
    assert chord["chordal_cycle_4"] == 1 and chord["cycle_4"] == 0
    star = motifs.motif_counts(graph("star6")).head()
    assert star["star_4"] == 10 and star["wedge"] == 10 and star["triangle"] == 0
    path = motifs.motif_counts(graph("path5")).head()
    assert path["path_4"] == 2


def test_distances(graph):
    nf = distances.neighbourhood(distances.pair_distances(graph("path5")))
    assert rows(nf, "t", "pairs") == [(0, 5), (1, 9), (2, 12), (3, 14), (4, 15)]
    s = distances.distance_stats(nf).head()
    assert s["diameter"] == 4 and s["median_distance"] == 1


def test_hyperball_is_near_the_exact_counts(graph):
    got = [r[1] for r in rows(distances.hyperball(graph("path5")), "t", "pairs")]
    assert np.allclose(got[:5], [5, 9, 12, 14, 15], rtol=0.05)


@pytest.mark.parametrize("name", ["bridge", "star6", "path5"])
def test_orderings_are_permutations(graph, name):
    g = graph(name)
    deg = degrees.degrees(g)
    n = g.n()
    made = [ordering.original(g), ordering.random_order(g), ordering.degree_sort(deg), ordering.hub_sort(deg), ordering.hub_cluster(deg), ordering.degree_groups(deg), ordering.cuthill_mckee(g), ordering.community_order(g, deg), ordering.slashburn(g, 0.2)[0]]
    for o in made:
        assert rows(o, "new_id") == [(k,) for k in range(n)]


def test_cuthill_mckee_of_a_path_has_bandwidth_one(graph):
    g = graph("path5")
    assert ordering.bandwidth(g.edges, ordering.cuthill_mckee(g)).head()[0] == 1


def test_unknown_ordering_is_refused():
    with pytest.raises(ValueError):
        ordering.check_names(["orig", "nope"])


def test_hilbert_keys_are_a_curve(spark):
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    keyed = sorted((r["k"], r["x"], r["y"]) for r in cells.withColumn("k", curves.hilbert_key(F.col("x"), F.col("y"), 16)).collect())
    assert [k for k, _, _ in keyed] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(keyed, keyed[1:], strict=False))


@pytest.mark.parametrize(("w", "h"), [(1, 1), (5, 3), (8, 8), (9, 4), (2, 11)])
def test_rectangle_walk_meets_each_cell_once(w, h):
    cells = list(curves.rectangle_walk(w, h))
    assert sorted(cells) == [(x, y) for x in range(w) for y in range(h)]


def test_spectral_values_match_numpy(graph):
    g = graph("bridge")
    a = np.zeros((6, 6))
    for s, d in HAND["bridge"]:
        a[s, d] = 1
    both = np.minimum(a + a.T, 1)
    want = np.sort(np.abs(np.linalg.eigvalsh(both)))[::-1]
    first, _ = spectral.spectral_norm(g, 6)
    assert abs(first - want[0]) < 1e-6
    lap = np.diag(both.sum(0)) - both
    assert abs(spectral.algebraic_connectivity(g, 5) - np.linalg.eigvalsh(lap)[1]) < 1e-6
    assert abs(spectral.operator_norm(g, 6) - np.linalg.norm(a, 2)) < 1e-6


def test_discrete_power_law_finds_its_exponent(spark):
    rng = np.random.default_rng(1)
    x = np.arange(1, 5000)
    p = x**-2.5 / (x**-2.5).sum()
    sample = rng.choice(x, 4000, p=p)
    fit = degrees.power_law_discrete(spark.createDataFrame([(int(v),) for v in sample], "deg long"))
    assert abs(fit["alpha"] - 2.5) < 0.15


def test_p_value_of_a_correlation():
    assert abs(degrees.student_p(0.5, 20) - 0.02476) < 1e-3


def test_staged_tables_can_be_cleaned_up(spark):
    from edgeloom.plans import durable

    kept = durable.written(spark.range(5), "test")
    keyed = durable.written_by_key(spark.range(5), "id", 2, "test")
    assert kept.count() == 5 and keyed.count() == 5
    name, path = durable._TABLES[-1], durable._PATHS[-1]
    durable._TABLES[:], durable._PATHS[:] = [name], [path]
    durable.clean_up(spark)
    assert not spark.catalog.tableExists(name) and not durable._TABLES and not durable._PATHS
