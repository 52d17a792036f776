"""Every registered query of the library with its SQL twin.

``@query(sql, ids)`` registers a function (spark, sf_dir) -> DataFrame under
its own name; ``ids`` are the rows of the operator inventory it answers for.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom import fixtures, functions, sources
from edgeloom.fixtures import SQL as RAW
from edgeloom.fixtures import simple_sql
from edgeloom.operators import components, curves, degrees, distances, motifs, ordering, pagerank, relational, reports, scc, simplify, spectral
from edgeloom.plans.durable import fresh_path, written
from edgeloom.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
INVENTORY: dict[str, str] = {}


def query(sql: str | None, ids: str):
    def register(f):
        QUERIES[f.__name__] = f
        INVENTORY[f.__name__] = ids
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def graph(spark: SparkSession, d: str, name: str) -> simplify.Graph:
    return simplify.simplify(fixtures.GRAPHS[name](spark, d))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


PS, CC, UU, TR = (simple_sql(n) for n in ("g_ps", "g_cc", "g_uu", "g_tree"))


# B: simplify


@query(f"WITH {PS} SELECT src, dst FROM e", "A8 A9 B1 B2 B3 B4 B5 B6 B7")
def simplify_edges(spark, d):
    return graph(spark, d, "g_ps").edges


@query(f"WITH {PS} SELECT (SELECT count(*) FROM raw) AS raw, (SELECT count(*) FROM raw WHERE src = dst) AS loops, (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m", "B1 B9 G16")
def simplify_counts(spark, d):
    raw = fixtures.g_ps(spark, d)
    g = simplify.simplify(raw)
    one = raw.agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    return one.crossJoin(F.broadcast(g.vertices.agg(F.count(F.lit(1)).alias("n")))).crossJoin(F.broadcast(g.edges.agg(F.count(F.lit(1)).alias("m"))))


@query(f"WITH {CC} SELECT id, orig_id FROM v", "B3 B4 H5")
def vertex_map(spark, d):
    return graph(spark, d, "g_cc").vertices


@query(f"SELECT src, dst FROM ({RAW['g_uu']}) WHERE src <> dst", "B2")
def drop_loops(spark, d):
    return simplify.drop_loops(fixtures.g_uu(spark, d))


@query(f"WITH raw AS ({RAW['g_cc']}), s AS (SELECT DISTINCT src, dst FROM raw) SELECT src, dst, row_number() OVER (ORDER BY dst, src) - 1 AS idx FROM s", "B8 E2 N5")
def sorted_by_dst(spark, d):
    return curves.ordered(fixtures.g_cc(spark, d).distinct(), "column", 0)


@query(f"WITH {UU} SELECT src, dst FROM both_ways", "B13 N1")
def symmetrize(spark, d):
    return simplify.symmetrize(graph(spark, d, "g_uu").edges)


@query(f"WITH {UU} SELECT a, b FROM u", "B14")
def canonical_undirected(spark, d):
    return simplify.undirected(graph(spark, d, "g_uu").edges)


@query(f"WITH {UU} SELECT dst AS src, src AS dst FROM e", "A21")
def transpose(spark, d):
    return simplify.transpose(graph(spark, d, "g_uu").edges)


@query(f"WITH {UU} SELECT src AS row, dst AS col, -1::BIGINT AS val FROM e UNION ALL SELECT src, src, count(*) FROM e GROUP BY src", "B12 K6 K9")
def laplacian_triplets(spark, d):
    return simplify.laplacian(graph(spark, d, "g_uu").edges)


@query(f"WITH {UU} SELECT (count(*) = 0)::INT AS symmetric FROM (SELECT src, dst FROM e EXCEPT SELECT dst, src FROM e)", "G15")
def symmetry_check(spark, d):
    return simplify.is_symmetric(graph(spark, d, "g_uu").edges)


# C: catalog tables (part, customer and orders stand for catalog, categories and log)


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey BETWEEN 20 AND 120", "C1")
def catalog_between(spark, d):
    return relational.between_all(table(spark, d, "part"), {"p_partkey": (20, 120)}).select("p_partkey", "p_name", "p_retailprice")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", "C2 C6")
def catalog_in(spark, d):
    return table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'P%'", "C3")
def catalog_like(spark, d):
    return table(spark, d, "part").where(F.col("p_type").like("P%")).select("p_partkey", "p_type")


@query("SELECT p_partkey, contains(p_type, 'A') AS has FROM part", "C4")
def catalog_contains(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_type").contains("A").alias("has"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 9, 100) AND c_mktsegment <> 'BUILDING'", "C5")
def catalog_downloadable(spark, d):
    c = table(spark, d, "customer")
    return c.where(F.col("c_custkey").isin(1, 5, 9, 100) & (F.col("c_mktsegment") != "BUILDING")).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 30 AND p_retailprice BETWEEN 900 AND 1500 AND p_partkey BETWEEN 1 AND 5000", "C7")
def catalog_multi_between(spark, d):
    return relational.between_all(table(spark, d, "part"), {"p_size": (5, 30), "p_retailprice": (900, 1500), "p_partkey": (1, 5000)}).select("p_partkey", "p_size")


@query("SELECT DISTINCT p_type FROM part", "C8")
def catalog_distinct(spark, d):
    return table(spark, d, "part").select("p_type").distinct()


@query("SELECT c_acctbal FROM customer WHERE c_custkey = 42", "C9")
def catalog_point_lookup(spark, d):
    return table(spark, d, "customer").where("c_custkey = 42").select("c_acctbal")


@query("SELECT c_custkey, CASE WHEN c_custkey = 42 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer", "C10")
def catalog_point_update(spark, d):
    return relational.set_point(table(spark, d, "customer"), "c_custkey", 42, "c_acctbal", 0.0).select("c_custkey", "c_acctbal")


_NEW_SQL = "new AS (SELECT s_suppkey AS c_custkey, s_name AS c_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS c_acctbal FROM supplier), old AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0)"


def _old_new(spark, d):
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("c_acctbal"))
    return table(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_acctbal"), new


@query(f"WITH {_NEW_SQL} SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT * FROM new", "C11 C14 T24")
def upsert_replace(spark, d):
    return relational.upsert(*_old_new(spark, d), ["c_custkey"])


@query(f"WITH {_NEW_SQL} SELECT * FROM old UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)", "C13")
def insert_ignore(spark, d):
    return relational.insert_missing(*_old_new(spark, d), ["c_custkey"])


@query(f"WITH {_NEW_SQL} SELECT o.c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM old o LEFT JOIN new n USING (c_custkey)", "C12 T32")
def partial_update(spark, d):
    return relational.update_columns(*_old_new(spark, d), ["c_custkey"])


@query("SELECT * FROM customer WHERE false", "C15")
def delete_all(spark, d):
    return table(spark, d, "customer").where(F.lit(False))


@query("SELECT c_custkey, NULL::BIGINT AS sb_k, NULL::DOUBLE AS share FROM customer", "C16")
def schema_extend(spark, d):
    return relational.extended(table(spark, d, "customer").select("c_custkey"), {"sb_k": "bigint", "share": "double"})


@query("SELECT p_partkey, p_size, p_retailprice, 16 * p_size + 24 * p_partkey AS struct_size FROM part ORDER BY struct_size", "C17 C18 C24 L1")
def catalog_struct_size(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return p.withColumn("struct_size", functions.struct_size(F.col("p_partkey"), F.col("p_size"))).orderBy("struct_size")


@query("SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) - 1 AS number FROM part", "C19")
def catalog_partition_rank(spark, d):
    return relational.numbered_parts(table(spark, d, "part"), "p_type", ["p_retailprice", "p_partkey"]).select("p_type", "p_partkey", "number")


@query("SELECT c_custkey, n, round(total / c_acctbal, 6) AS ratio FROM (SELECT c_custkey, c_acctbal, o.n, o.total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey) WHERE n IS NOT NULL AND c_acctbal <> 0", "C20")
def left_join_ratio(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    j = table(spark, d, "customer").select("c_custkey", "c_acctbal").join(o, "c_custkey", "left").dropna(subset=["n"]).where("c_acctbal <> 0")
    return j.select("c_custkey", "n", F.round(F.col("total") / F.col("c_acctbal"), 6).alias("ratio"))


_HOLES = "SELECT l_linenumber - 1 AS a, CASE WHEN l_quantity > 25 THEN l_quantity END AS b, l_tax AS c, 0 AS z FROM lineitem"


def _holes(spark, d):
    x = table(spark, d, "lineitem")
    return x.select((F.col("l_linenumber") - 1).alias("a"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("b"), F.col("l_tax").alias("c"), F.lit(0).alias("z"))


@query(f"WITH t AS ({_HOLES}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", sum(CASE WHEN {c} = 0 THEN 1 ELSE 0 END)::BIGINT AS zeros, sum(({c} IS NULL)::INT)::BIGINT AS nulls FROM t" for c in "abcz"), "C21")
def zero_null_profile(spark, d):
    return relational.profile(_holes(spark, d), ["a", "b", "c", "z"])


@query(f"WITH t AS ({_HOLES}) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NOT NULL AND {c} <> 0) AS filled FROM t" for c in "abcz") + ") WHERE filled >= 50", "C22 T28")
def feature_coverage(spark, d):
    return relational.covered_columns(_holes(spark, d), ["a", "b", "c", "z"], 50)


@query(f"WITH t AS ({_HOLES}) SELECT coalesce(b::BIGINT, 0) AS b, count(*) AS n FROM t GROUP BY 1", "C23")
def impute_cast(spark, d):
    return relational.imputed(_holes(spark, d), {"b": "bigint"}).groupBy("b").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'customer' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier", "C26")
def union_all(spark, d):
    a, b = table(spark, d, "customer"), table(spark, d, "supplier")
    return a.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k")).unionByName(b.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("k")))


@query("SELECT c_custkey, n_name, r_name, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", "C27 L12 A24")
def heading_listing(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN l_discount ELSE l_tax END AS value FROM lineitem", "C28")
def stat_verified(spark, d):
    return relational.verified(table(spark, d, "lineitem"), "l_tax", "l_discount", "value").select("l_orderkey", "l_linenumber", "value")


@query("SELECT p_type, p_partkey, floor((row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) / 5)::BIGINT AS chunk FROM part", "C29 N8 O9")
def chunks(spark, d):
    return relational.chunked(table(spark, d, "part"), ["p_partkey"], 5, "p_type").select("p_type", "p_partkey", "chunk")


@query("SELECT coalesce(nullif(p_size, 1), 7) AS n, count(*) AS c FROM part GROUP BY 1", "B9")
def size_fallback(spark, d):
    return table(spark, d, "part").groupBy(F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(7)).alias("n")).agg(F.count(F.lit(1)).alias("c"))


# D: vertex orderings


def _ordered_sql(g: str, key: str) -> str:
    return f"WITH {g}, s AS (SELECT *, avg(out_deg) OVER () AS mean FROM deg) SELECT id, row_number() OVER (ORDER BY {key}, id) - 1 AS new_id FROM s"


@query(f"WITH {CC} SELECT id, id AS new_id FROM v", "D1")
def order_original(spark, d):
    return ordering.original(graph(spark, d, "g_cc"))


@query(f"WITH {PS} SELECT id, row_number() OVER (ORDER BY (id * 2654435761) % 4294967296, id) - 1 AS new_id FROM v", "D2")
def order_random_hash(spark, d):
    return ordering.random_order(graph(spark, d, "g_ps"))


@query(_ordered_sql(PS, "-out_deg"), "D3")
def order_degree_sort(spark, d):
    return ordering.degree_sort(degrees.degrees(graph(spark, d, "g_ps")))


@query(_ordered_sql(PS, "CASE WHEN out_deg > mean THEN -out_deg ELSE 1 END"), "D4")
def order_hubsort(spark, d):
    return ordering.hub_sort(degrees.degrees(graph(spark, d, "g_ps")))


@query(_ordered_sql(PS, "CASE WHEN out_deg > mean THEN 0 ELSE 1 END"), "D5")
def order_hubcluster(spark, d):
    return ordering.hub_cluster(degrees.degrees(graph(spark, d, "g_ps")))


_BINS = "CASE " + " ".join(f"WHEN out_deg >= {t} * mean THEN {i}" for i, t in enumerate((32, 16, 8, 4, 2, 1, 0.5))) + " ELSE 7 END"


@query(_ordered_sql(PS, _BINS), "D6")
def order_dbg(spark, d):
    return ordering.degree_groups(degrees.degrees(graph(spark, d, "g_ps")))


_SORTED = _ordered_sql(PS, "-out_deg").replace("SELECT id, row_number()", ", o AS (SELECT id, row_number()", 1) + ")"


@query(_SORTED + " SELECT max(abs(a.new_id - b.new_id)) AS bandwidth FROM e JOIN o a ON a.id = e.src JOIN o b ON b.id = e.dst", "D13")
def bandwidth_by_order(spark, d):
    g = graph(spark, d, "g_ps")
    return ordering.bandwidth(g.edges, ordering.degree_sort(degrees.degrees(g)))


@query(_SORTED + " SELECT a.new_id AS src, b.new_id AS dst FROM e JOIN o a ON a.id = e.src JOIN o b ON b.id = e.dst", "D15")
def apply_order(spark, d):
    g = graph(spark, d, "g_ps")
    return simplify.apply_ordering(g.edges, ordering.degree_sort(degrees.degrees(g)))


_BIJECTION = "SELECT count(*) AS n, count(*) AS distinct_ids, 0::BIGINT AS least, count(*) - 1 AS most FROM v"


@query(f"WITH {CC} {_BIJECTION}", "D10")
def rcm_check(spark, d):
    return ordering.is_permutation(ordering.cuthill_mckee(graph(spark, d, "g_cc")))


@query(f"WITH {CC} {_BIJECTION}", "D11")
def reverse_rcm_check(spark, d):
    return ordering.is_permutation(ordering.reverse(ordering.cuthill_mckee(graph(spark, d, "g_cc"))))


@query(f"WITH {UU} {_BIJECTION}", "D7 D8")
def slashburn_check(spark, d):
    return ordering.is_permutation(ordering.slashburn(graph(spark, d, "g_uu"), 0.1)[0])


@query(f"WITH {UU} SELECT greatest(1, floor(count(*) * 0.1))::BIGINT AS k FROM v", "N3")
def slashburn_hubs(spark, d):
    g = graph(spark, d, "g_uu")
    return g.vertices.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * 0.1)).alias("k"))


@query(f"WITH {UU} {_BIJECTION}", "D12")
def rabbit_check(spark, d):
    g = graph(spark, d, "g_uu")
    return ordering.is_permutation(ordering.community_order(g, degrees.degrees(g)))


# E: edge orders and tiles


def _hilbert_sql(x: str, y: str, side: str, source: str, cols: str, bits: int = 15) -> str:
    """CTEs h0 .. that fold one bit each, from the highest; bits above the side change nothing but the key's zero part."""
    parts = [f"h0 AS (SELECT {cols}, {x} AS hx, {y} AS hy, 0::BIGINT AS hd, {side} AS side FROM {source})"]
    for i, b in enumerate(range(bits - 1, -1, -1)):
        s = 1 << b
        rx, ry = f"CASE WHEN hx & {s} > 0 THEN 1 ELSE 0 END", f"CASE WHEN hy & {s} > 0 THEN 1 ELSE 0 END"
        parts.append(f"r{i} AS (SELECT *, CASE WHEN {s} < side THEN {rx} ELSE 0 END AS rx, CASE WHEN {s} < side THEN {ry} ELSE 0 END AS ry FROM h{i})")
        flip = f"({s} < side AND ry = 0)"
        nx = f"CASE WHEN {flip} THEN CASE WHEN rx = 1 THEN side - 1 - hy ELSE hy END ELSE hx END"
        ny = f"CASE WHEN {flip} THEN CASE WHEN rx = 1 THEN side - 1 - hx ELSE hx END ELSE hy END"
        parts.append(f"h{i + 1} AS (SELECT {cols}, {nx} AS hx, {ny} AS hy, hd + CASE WHEN {s} < side THEN {s}::BIGINT * {s} * xor(3 * rx, ry) ELSE 0 END AS hd, side FROM r{i})")
    return ", ".join(parts)


_SIDE = "(SELECT greatest(2, (2 ** ceil(log2(count(*))))::BIGINT) FROM v)"


@query(f"WITH {CC} SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS idx FROM e", "E1 F10")
def edges_row_major(spark, d):
    g = graph(spark, d, "g_cc")
    return curves.ordered(g.edges, "row", g.n())


@query(f"WITH {CC} SELECT src, dst, row_number() OVER (ORDER BY dst, src) - 1 AS idx FROM e", "E2")
def edges_col_major(spark, d):
    g = graph(spark, d, "g_cc")
    return curves.ordered(g.edges, "column", g.n())


@query(f"WITH {UU}, {_hilbert_sql('src', 'dst', _SIDE, 'e', 'src, dst')} SELECT src, dst, row_number() OVER (ORDER BY hd) - 1 AS idx FROM h15", "E3 E4 E6 E7 L6")
def edges_hilbert(spark, d):
    g = graph(spark, d, "g_uu")
    return curves.ordered(g.edges, "hilbert", g.n())


@query("SELECT x::BIGINT AS x, y::BIGINT AS y, TRUE AS same FROM range(32) a(x), range(32) b(y)", "E5")
def hilbert_inverse(spark, d):
    cells = spark.range(1024).select((F.col("id") % 32).alias("x"), F.floor(F.col("id") / 32).alias("y"))
    back = cells.withColumn("p", curves.hilbert_point(curves.hilbert_key(F.col("x"), F.col("y"), 32), 32))
    return back.select("x", "y", ((F.col("p.x") == F.col("x")) & (F.col("p.y") == F.col("y"))).alias("same"))


@query("SELECT x::BIGINT AS x, CASE WHEN x = 0 THEN 0 ELSE (2 ** (floor(log2(x)) + 1))::BIGINT END AS above, floor(log2(greatest(x, 1)))::BIGINT AS whole_log FROM range(0, 200) t(x)", "E8 E18")
def power_above(spark, d):
    x = F.col("id")
    whole = F.floor(F.log2(F.greatest(x, F.lit(1)).cast("double")) + 1e-12)
    return spark.range(200).select(x.alias("x"), F.when(x == 0, F.lit(0)).otherwise(F.pow(F.lit(2.0), whole + 1)).cast("long").alias("above"), whole.alias("whole_log"))


@query(f"WITH {PS} SELECT src >> 6 AS qx, dst >> 6 AS qy, count(*) AS nnz FROM e GROUP BY 1, 2", "E9 T22")
def tile_nnz(spark, d):
    return curves.tile_nnz(graph(spark, d, "g_ps").edges, 64)


_TSIDE = "(SELECT greatest(2, (2 ** ceil(log2(greatest(1, ceil(count(*) / 16.0)))))::BIGINT) FROM v)"


@query(f"WITH {UU}, t AS (SELECT src >> 4 AS qx, dst >> 4 AS qy, count(*) AS nnz FROM e GROUP BY 1, 2), {_hilbert_sql('qx', 'qy', _TSIDE, 't', 'qx, qy, nnz')} SELECT qx, qy, nnz, hd AS key, row_number() OVER (ORDER BY hd) - 1 AS q_idx FROM h15", "E11")
def tile_hilbert_order(spark, d):
    g = graph(spark, d, "g_uu")
    return curves.tile_order(curves.tile_nnz(g.edges, 16), g.n(), 16)


@query(f"WITH {UU}, t AS (SELECT src >> 4 AS qx, dst >> 4 AS qy, src & 15 AS x, dst & 15 AS y FROM e), {_hilbert_sql('x', 'y', '16', 't', 'qx, qy, x, y')} SELECT qx, qy, x, y, row_number() OVER (PARTITION BY qx, qy ORDER BY hd) - 1 AS nth FROM h15", "E10")
def tile_inner_order(spark, d):
    return curves.inside_tiles(graph(spark, d, "g_uu").edges, 16)


@query("SELECT a.i AS qx, b.i AS qy, (a.i * 100) // 8 AS x0, ((a.i + 1) * 100) // 8 AS x1, (b.i * 100) // 8 AS y0, ((b.i + 1) * 100) // 8 AS y1 FROM range(8) a(i), range(8) b(i)", "E13")
def quadrant_split(spark, d):
    return curves.quadrants(spark, 100, 3)


@query("SELECT 45::BIGINT AS cells, 45::BIGINT AS distinct_cells, 44::BIGINT AS unit_steps", "E12 N7")
def rectangle_walk_check(spark, d):
    walk = [(0, i, x, y) for i, (x, y) in enumerate(curves.rectangle_walk(9, 5))]
    line = reports.polyline(spark.createDataFrame(walk, "g int, k long, x long, y long"), "k", "g")
    step = F.abs(F.col("x") - F.col("px")) + F.abs(F.col("y") - F.col("py"))
    return line.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("x", "y").alias("distinct_cells"), F.count_if(step == 1).alias("unit_steps"))


@query("SELECT p_partkey, 10 - (p_size - 5) AS x90, 5 + (p_partkey - 10) AS y90 FROM part", "E15")
def rotated_points(spark, d):
    x, y = functions.rotated(F.lit(10), F.lit(5), 90, F.col("p_partkey"), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", x.alias("x90"), y.alias("y90"))


@query("SELECT p_partkey, ceil(log(p_size) / log(4) - 1e-12)::INT AS depth, ((p_partkey + 7) // 8) * 8 AS multiple FROM part", "E16 E17 T13")
def depth_and_multiple(spark, d):
    return table(spark, d, "part").select("p_partkey", functions.critical_depth(F.col("p_size")).alias("depth"), functions.next_multiple(F.col("p_partkey"), 3).alias("multiple"))


@query(f"WITH {UU}, r AS (SELECT src AS row, max(dst) AS last FROM e WHERE src < 100 GROUP BY src) SELECT row, last, max(last) OVER (ORDER BY row DESC ROWS UNBOUNDED PRECEDING) AS envelope FROM r", "E20")
def wing_envelope(spark, d):
    return curves.wing_envelope(graph(spark, d, "g_uu").edges, 100)


# F: PageRank


def _pagerank_sql(g: str, rounds: int = 20) -> str:
    parts = [g, "k AS (SELECT src, count(*) AS n FROM e GROUP BY src)", "w AS MATERIALIZED (SELECT e.src, e.dst, 1.0::DOUBLE / k.n AS w FROM e JOIN k USING (src))", "nn AS (SELECT count(*) AS n FROM v)"]
    parts.append("p0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS score FROM v, nn)")
    for i in range(1, rounds + 1):
        parts.append(f"p{i} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / nn.n + 0.85::DOUBLE * coalesce(s.got, 0) AS score FROM v CROSS JOIN nn LEFT JOIN (SELECT w.dst AS id, sum(p.score * w.w) AS got FROM w JOIN p{i - 1} p ON p.id = w.src GROUP BY w.dst) s ON s.id = v.id)")
    return "WITH " + ", ".join(parts)


@query(_pagerank_sql(PS) + " SELECT id, round(score, 8) AS score FROM p20", "F1 F2 F6")
def pagerank20(spark, d):
    return rounded(pagerank.pagerank(graph(spark, d, "g_ps")), 8)


@query(_pagerank_sql(TR) + " SELECT id, round(score, 8) AS score FROM p20", "F1 T1")
def pagerank_dangling(spark, d):
    return rounded(pagerank.pagerank(graph(spark, d, "g_tree")), 8)


@query(_pagerank_sql(CC) + ", t AS (SELECT sum(score) AS s FROM p20) SELECT id, round(score / s, 8) AS score FROM p20, t", "F3")
def pr_normalized(spark, d):
    return rounded(pagerank.normalized(pagerank.pagerank(graph(spark, d, "g_cc"))), 8)


@query("SELECT 1 AS valid", "F4 F5 T2")
def pagerank_reordered_valid(spark, d):
    g = graph(spark, d, "g_cc")
    order = ordering.degree_sort(degrees.degrees(g))
    moved = simplify.Graph(simplify.apply_ordering(g.edges, order), order.select(F.col("new_id").alias("id"), F.col("id").alias("orig_id")))
    return pagerank.agrees(pagerank.pagerank(g), pagerank.unpermuted(pagerank.pagerank(moved), order))


@query(f"WITH {CC}, k AS (SELECT src, count(*) AS n FROM e GROUP BY src) SELECT e.dst AS id, round(sum(1.0::DOUBLE / k.n), 6) AS value FROM e JOIN k USING (src) GROUP BY e.dst", "F9 K8 G18")
def pagerank_tiled_step(spark, d):
    e = graph(spark, d, "g_cc").edges
    w = e.join(e.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "src").withColumn("w", F.lit(1.0) / F.col("n"))
    tiles = w.groupBy(F.shiftright("src", 6).alias("qx"), F.shiftright("dst", 6).alias("qy"), "dst").agg(F.sum("w").alias("part"))
    return tiles.groupBy(F.col("dst").alias("id")).agg(F.round(F.sum("part"), 6).alias("value"))


@query("SELECT DISTINCT g.event_type AS graph, v.i AS vertex_order, e.i AS edge_order, r.i AS repeat FROM events g, range(11) v(i), range(3) e(i), range(5) r(i)", "F8 O2")
def expt_grid(spark, d):
    g = table(spark, d, "events").select(F.col("event_type").alias("graph")).distinct()
    dim = lambda n, name: spark.range(n).select(F.col("id").alias(name))
    return relational.grid(g, dim(11, "vertex_order"), dim(3, "edge_order"), dim(5, "repeat"))


# G: degrees


@query(f"WITH {PS} SELECT id, out_deg, in_deg, deg FROM deg", "A16 G1")
def degree_table(spark, d):
    return degrees.degrees(graph(spark, d, "g_ps"))


@query(f"WITH {PS} SELECT " + ", ".join(f"max({c}) AS max_{c}, floor(quantile_cont({c}, 0.5))::BIGINT AS median_{c}" for c in ("out_deg", "in_deg", "deg")) + " FROM deg", "G2 T17")
def degree_summary(spark, d):
    return degrees.summary(degrees.degrees(graph(spark, d, "g_ps")))


_CM = "avg(deg - mu)::DOUBLE AS m1, avg((deg - mu) ** 2) AS m2, avg((deg - mu) ** 3) AS m3, avg((deg - mu) ** 4) AS m4"


@query(f"WITH {PS}, c AS (SELECT deg, avg(deg) OVER () AS mu FROM deg), s AS (SELECT any_value(mu) AS mu, {_CM} FROM c) SELECT round(mu, 6) AS mean, round(m2, 6) AS variance, round(sqrt(m2), 6) AS stddev, round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS kurtosis FROM s", "G3")
def degree_moments(spark, d):
    return rounded(degrees.moments(degrees.degrees(graph(spark, d, "g_ps"))))


@query(f"WITH {PS}, s AS (SELECT min(deg) AS lo FROM deg WHERE deg > 0) SELECT round(1 + count(*) / sum(ln(deg / lo::DOUBLE)), 6) AS exponent FROM deg, s WHERE deg > 0", "G5")
def powerlaw_closed_form(spark, d):
    return rounded(degrees.power_law_closed(degrees.degrees(graph(spark, d, "g_ps"))))


@query(f"WITH {PS} SELECT round(1 + count(*) / sum(ln(deg / 30.0::DOUBLE)), 6) AS exponent FROM deg WHERE deg >= 30", "G6")
def powerlaw_tail(spark, d):
    return rounded(degrees.power_law_closed(degrees.degrees(graph(spark, d, "g_ps")), xmin=30))


@query(None, "G4")
def powerlaw_discrete(spark, d):
    fit = degrees.power_law_discrete(degrees.degrees(graph(spark, d, "g_ps")), draws=20)
    return spark.createDataFrame([(fit["alpha"], fit["xmin"], fit["loglik"], fit["ks"], fit["n_tail"], fit["p_value"])], "alpha double, xmin long, loglik double, ks double, n_tail long, p_value double")


@query(f"WITH {PS}, r AS (SELECT out_deg, row_number() OVER (ORDER BY out_deg, id) AS i FROM deg), s AS (SELECT sum(i * out_deg)::DOUBLE AS ranked, count(*) AS n, sum(out_deg)::DOUBLE AS total FROM r) SELECT round(2 * ranked / (n * total) - (n + 1.0::DOUBLE) / n, 6) AS gini, round(2 * ranked / (n * total) - floor((n + 1) / n), 6) AS gini_whole FROM s", "G7 T6")
def gini(spark, d):
    return rounded(degrees.gini(degrees.degrees(graph(spark, d, "g_ps")), "out_deg"))


@query(f"WITH {PS}, mm AS (SELECT count(*) AS m FROM e), p AS (SELECT deg / (2.0::DOUBLE * m) AS p FROM deg, mm WHERE deg > 0) SELECT round(sum(-p * ln(p)) / ln(count(*)), 6) AS entropy FROM p", "G8 T9")
def edge_entropy(spark, d):
    g = graph(spark, d, "g_ps")
    return rounded(degrees.edge_entropy(degrees.degrees(g), g.edges.agg(F.count(F.lit(1)).alias("m"))))


@query(f"WITH {PS} SELECT round(corr(ln(1 + in_deg), ln(1 + out_deg)), 6) AS correlation FROM deg", "L5")
def in_out_corr(spark, d):
    return rounded(degrees.in_out_correlation(degrees.degrees(graph(spark, d, "g_ps"))))


@query(f"WITH {PS} SELECT round(corr(a.out_deg, b.out_deg), 6) AS assortativity_out_deg FROM e JOIN deg a ON a.id = e.src JOIN deg b ON b.id = e.dst", "G10")
def assortativity_out(spark, d):
    g = graph(spark, d, "g_ps")
    return rounded(degrees.assortativity(g, degrees.degrees(g), "out_deg"))


@query(f"WITH {PS} SELECT round(corr(a.in_deg, b.in_deg), 6) AS assortativity_in_deg FROM e JOIN deg a ON a.id = e.src JOIN deg b ON b.id = e.dst", "G10")
def assortativity_in(spark, d):
    g = graph(spark, d, "g_ps")
    return rounded(degrees.assortativity(g, degrees.degrees(g), "in_deg"))


@query(f"WITH {UU} SELECT round(count(r.src) / count(*)::DOUBLE, 6) AS reciprocity FROM e LEFT JOIN e r ON r.src = e.dst AND r.dst = e.src", "G11")
def reciprocity(spark, d):
    return rounded(degrees.reciprocity(graph(spark, d, "g_uu").edges))


@query(f"WITH {UU}, c AS (SELECT (SELECT count(*) FROM v)::DOUBLE AS n, (SELECT count(*) FROM e)::DOUBLE AS m) SELECT round(m / (n * (n - 1) / 2), 6) AS fill, round(m / (n * (n - 1) / 2 + n), 6) AS fill_with_loops FROM c", "G12")
def fill(spark, d):
    g = graph(spark, d, "g_uu")
    n, m = F.lit(float(g.n())), F.lit(float(g.m()))
    return spark.range(1).select(F.round(m / functions.choose(n, 2), 6).alias("fill"), F.round(m / (functions.choose(n, 2) + n), 6).alias("fill_with_loops"))


@query(f"WITH {PS}, h AS (SELECT out_deg AS d, count(*) AS c FROM deg GROUP BY 1), r AS (SELECT sum(c) OVER w AS top, sum(c * d) OVER w AS held FROM h WINDOW w AS (ORDER BY d DESC ROWS UNBOUNDED PRECEDING)), t AS (SELECT sum(c) AS n, sum(c * d) AS t FROM h) SELECT round(min(top / n::DOUBLE), 6) AS share FROM r, t WHERE held / t::DOUBLE >= 1 - top / n::DOUBLE", "G13")
def balanced_inequality(spark, d):
    return rounded(degrees.balanced_inequality(degrees.degrees(graph(spark, d, "g_ps")), "out_deg"))


@query(f"WITH {PS} SELECT max(c) AS mode_count FROM (SELECT count(*) AS c FROM deg GROUP BY deg)", "G14")
def mode_frequency(spark, d):
    return degrees.mode_frequency(degrees.degrees(graph(spark, d, "g_ps")))


# H: components

_WCC = f"WITH RECURSIVE {TR}, reach AS (SELECT id AS a, id AS b FROM v UNION SELECT reach.a, w.dst FROM reach JOIN both_ways w ON w.src = reach.b), comp AS (SELECT a AS id, min(b) AS comp FROM reach GROUP BY a)"
_SCC = f"WITH RECURSIVE {PS}, reach AS (SELECT id AS a, id AS b FROM v UNION SELECT reach.a, e.dst FROM reach JOIN e ON e.src = reach.b), comp AS (SELECT x.a AS id, max(x.b) AS scc FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a)"


@query(f"{_WCC} SELECT id, comp FROM comp", "H1 H8")
def wcc(spark, d):
    return components.connected_components(graph(spark, d, "g_tree").edges)


@query(f"{_WCC} SELECT count(*) AS n_components, max(n) AS largest FROM (SELECT count(*) AS n FROM comp GROUP BY comp)", "H3")
def wcc_summary(spark, d):
    return scc.component_summary(components.connected_components(graph(spark, d, "g_tree").edges), "comp")


@query(f"{_SCC} SELECT id, scc FROM comp", "H2")
def strong_components(spark, d):
    return scc.strongly_connected(graph(spark, d, "g_ps"))


@query(f"{_SCC} SELECT count(*) AS n_components, max(n) AS largest FROM (SELECT count(*) AS n FROM comp GROUP BY scc)", "H3 H6")
def scc_summary(spark, d):
    return scc.component_summary(scc.strongly_connected(graph(spark, d, "g_ps")), "scc")


@query(f"{_WCC}, top AS (SELECT comp FROM comp GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1), i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM comp WHERE comp = (SELECT comp FROM top)) SELECT a.k AS src, b.k AS dst FROM e JOIN i a ON a.id = e.src JOIN i b ON b.id = e.dst", "H4 H5 H8 T27")
def gcc_relabel(spark, d):
    g = graph(spark, d, "g_tree")
    return scc.extract_component(g, components.connected_components(g.edges))


@query(f"WITH RECURSIVE {TR}, hubs AS (SELECT id FROM deg ORDER BY deg DESC, id LIMIT 5), w AS (SELECT src, dst FROM both_ways WHERE src NOT IN (SELECT id FROM hubs) AND dst NOT IN (SELECT id FROM hubs)), reach AS (SELECT DISTINCT src AS a, src AS b FROM w UNION SELECT reach.a, w.dst FROM reach JOIN w ON w.src = reach.b), c AS (SELECT a, min(b) AS comp FROM reach GROUP BY a) SELECT count(*) AS n_components, max(n) AS largest FROM (SELECT count(*) AS n FROM c GROUP BY comp)", "H7")
def hub_removal_components(spark, d):
    g = graph(spark, d, "g_tree")
    hubs = F.broadcast(degrees.degrees(g).orderBy(F.desc("deg"), "id").limit(5).select("id"))  # five rows
    left = g.edges.join(hubs.withColumnRenamed("id", "src"), "src", "left_anti").join(hubs.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return scc.component_summary(components.connected_components(left), "comp")


# I: distances

_NF = f"WITH RECURSIVE {UU}, dist AS (SELECT id AS a, id AS b, 0 AS t FROM v UNION ALL SELECT a, b, t FROM (SELECT DISTINCT w.a, e.dst AS b, w.t + 1 AS t FROM dist w JOIN e ON e.src = w.b) n WHERE NOT EXISTS (SELECT 1 FROM recurring.dist r WHERE r.a = n.a AND r.b = n.b)), per AS (SELECT t, count(*) AS n FROM dist GROUP BY t), nf AS (SELECT t, (sum(n) OVER (ORDER BY t))::BIGINT AS pairs FROM per)".replace("dist AS (SELECT id", "dist(a, b, t) USING KEY (a, b) AS (SELECT id", 1)


@query(f"{_NF} SELECT t, pairs FROM nf", "I2")
def neighbourhood_function(spark, d):
    return distances.neighbourhood(distances.pair_distances(graph(spark, d, "g_uu")))


@query(f"{_NF} SELECT (SELECT max(t) FROM nf)::BIGINT AS diameter, round((SELECT sum(t * n) / sum(n)::DOUBLE FROM per), 6) AS mean_distance, (SELECT min(t) FROM nf WHERE pairs >= ((SELECT max(pairs) FROM nf) + 1) / 2.0) AS median_distance", "I3 I4 I5 I7")
def distance_stats(spark, d):
    return rounded(distances.distance_stats(distances.neighbourhood(distances.pair_distances(graph(spark, d, "g_uu")))))


@query(f"{_NF}, s AS (SELECT t, pairs, lag(pairs) OVER (ORDER BY t) AS p, (SELECT max(pairs) FROM nf) * 0.9::DOUBLE AS goal FROM nf) SELECT round(min(CASE WHEN p IS NULL THEN t::DOUBLE ELSE t - 1 + (goal - p) / (pairs - p) END), 6) AS effective_diameter FROM s WHERE pairs >= goal", "I6 T18")
def effective_diameter(spark, d):
    return rounded(distances.effective_diameter(distances.neighbourhood(distances.pair_distances(graph(spark, d, "g_uu")))))


@query(None, "I1")
def hyperball_estimate(spark, d):
    return rounded(distances.hyperball(graph(spark, d, "g_cc")), 1)


@query(f"{_NF} SELECT a AS source, max(t) AS radius FROM dist GROUP BY a", "I9")
def source_radii(spark, d):
    g = graph(spark, d, "g_uu")
    return distances.eccentricities(g, g.vertices)


# J: motifs

_TRI = "o AS (SELECT CASE WHEN (da, a) < (db, b) THEN a ELSE b END AS lo, CASE WHEN (da, a) < (db, b) THEN b ELSE a END AS hi FROM (SELECT u.a, u.b, x.deg AS da, y.deg AS db FROM u JOIN deg x ON x.id = u.a JOIN deg y ON y.id = u.b)), tri AS (SELECT p.lo AS v1, p.hi AS v2, q.hi AS v3 FROM o p JOIN o q ON q.lo = p.lo JOIN o r ON r.lo = p.hi AND r.hi = q.hi)"
_K4 = "k4 AS (SELECT t.v1, t.v2, t.v3, p.hi AS v4 FROM tri t JOIN o p ON p.lo = t.v1 JOIN o q ON q.lo = t.v2 AND q.hi = p.hi JOIN o r ON r.lo = t.v3 AND r.hi = p.hi)"


@query(f"WITH {PS}, {_TRI} SELECT count(*) AS clique_3 FROM tri", "J1")
def triangles(spark, d):
    return motifs.clique_count(graph(spark, d, "g_ps"), 3)


@query(f"WITH {CC}, {_TRI}, {_K4} SELECT count(*) AS clique_4 FROM k4", "J4")
def clique4(spark, d):
    return motifs.clique_count(graph(spark, d, "g_cc"), 4)


@query(f"WITH {CC}, {_TRI}, {_K4} SELECT count(*) AS clique_5 FROM k4 t JOIN o p ON p.lo = t.v1 JOIN o q ON q.lo = t.v2 AND q.hi = p.hi JOIN o r ON r.lo = t.v3 AND r.hi = p.hi JOIN o s ON s.lo = t.v4 AND s.hi = p.hi", "J5")
def clique5(spark, d):
    return motifs.clique_count(graph(spark, d, "g_cc"), 5)


_FOUR = f"""WITH {UU}, {_TRI}, {_K4},
k AS (SELECT count(*) AS k FROM k4), t3 AS (SELECT count(*) AS t FROM tri),
tv AS (SELECT v, count(*) AS t FROM (SELECT v1 AS v FROM tri UNION ALL SELECT v2 FROM tri UNION ALL SELECT v3 FROM tri) GROUP BY v),
te AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS t FROM (SELECT v1 AS a, v2 AS b FROM tri UNION ALL SELECT v1, v3 FROM tri UNION ALL SELECT v2, v3 FROM tri) GROUP BY 1, 2),
co AS (SELECT sum(c * (c - 1) / 2) AS cc FROM (SELECT x.dst AS a, y.dst AS b, count(*) AS c FROM both_ways x JOIN both_ways y ON y.src = x.src AND x.dst < y.dst GROUP BY 1, 2)),
dd AS (SELECT sum(deg * (deg - 1) / 2) AS w, sum(deg * (deg - 1) * (deg - 2) / 6) AS claw FROM deg),
pp AS (SELECT sum((x.deg - 1) * (y.deg - 1)) AS pp FROM u JOIN deg x ON x.id = u.a JOIN deg y ON y.id = u.b),
tt AS (SELECT sum(tv.t * (deg.deg - 2)) AS tt FROM tv JOIN deg ON deg.id = tv.v), ch AS (SELECT sum(t * (t - 1) / 2) AS ch FROM te),
s1 AS (SELECT *, ch - 6 * k AS chordal FROM k, t3, co, dd, pp, tt, ch), s2 AS (SELECT *, cc / 2 - chordal - 3 * k AS cyc, tt - 4 * chordal - 12 * k AS tailed FROM s1), s3 AS (SELECT *, claw - tailed - 2 * chordal - 4 * k AS star FROM s2)
SELECT t AS triangle, (w - 3 * t)::BIGINT AS wedge, w::BIGINT AS edge_wedge, claw::BIGINT AS claw, k AS clique_4, (pp - 3 * t - 4 * cyc - 2 * tailed - 6 * chordal - 12 * k)::BIGINT AS path_4, star::BIGINT AS star_4, tailed::BIGINT AS tailed_triangle, cyc::BIGINT AS cycle_4, chordal::BIGINT AS chordal_cycle_4, round(3 * t / w::DOUBLE, 6) AS clustering FROM s3"""


@query(_FOUR, "J1 J2 J3 J4 J6a J6b J6c J6d J6e J7")
def motifs4_induced(spark, d):
    return rounded(motifs.motif_counts(graph(spark, d, "g_uu")))


_N = "p_partkey"
_FALL3 = f"({_N} * ({_N} - 1.0::DOUBLE) * ({_N} - 2))"
_MOTIF_SQL = {
    "wedge": f"{_FALL3} / 2",
    "triangle": f"{_FALL3} / 6",
    "star_4": f"{_N} * ((({_N} - 1.0::DOUBLE) * ({_N} - 2) * ({_N} - 3)) / 6)",
    "path_4": f"{_FALL3} * ({_N} - 3) / 2",
    "tailed_triangle": f"3 * ({_N} - 3) * ({_FALL3} / 6)",
    "cycle_4": f"{_FALL3} * ({_N} - 3) / 4",
    "chordal_cycle_4": f"{_FALL3} * ({_N} - 3) / 4 * 2",
    "clique_4": f"{_FALL3} * ({_N} - 3) / 24",
    "clique_5": f"{_FALL3} * ({_N} - 3) * ({_N} - 4) / 120",
}


@query(f"SELECT {_N} AS n, " + ", ".join(f"{e} AS {k}" for k, e in _MOTIF_SQL.items()) + " FROM part", "J9 L5")
def motif_norm_constants(spark, d):
    n = F.col("p_partkey").cast("double")
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), *[functions.motif_constant(n, k).alias(k) for k in _MOTIF_SQL])


# K: spectral


@query(None, "K2 K3 T10")
def spectral_norm(spark, d):
    first, second = spectral.spectral_norm(graph(spark, d, "g_uu"))
    return spark.createDataFrame([(round(first, 5), round(first / second, 5) if second else None)], "spectral_norm double, separation double")


@query(None, "K1")
def op2norm(spark, d):
    return spark.createDataFrame([(round(spectral.operator_norm(graph(spark, d, "g_uu")), 5),)], "op2norm double")


@query(f"WITH {CC} SELECT src AS id, sum(dst + 1.0::DOUBLE) AS value FROM e GROUP BY src", "K8")
def spmv(spark, d):
    g = graph(spark, d, "g_cc")
    return pagerank.spmv(g.edges, g.vertices.select("id", (F.col("id") + 1.0).alias("value")))


# L: scalars


@query("SELECT n_nationkey, CASE WHEN s = 0 THEN '0B' ELSE printf('%s%s', round(s / 1024.0::DOUBLE ** floor(log2(s) / 10), 2)::VARCHAR, ['B','KB','MB','GB','TB'][(floor(log2(s) / 10) + 1)::INT]) END AS size FROM (SELECT n_nationkey, n_nationkey::BIGINT * n_nationkey * n_nationkey * n_nationkey * 37 AS s FROM nation)", "L2")
def human_size(spark, d):
    k = F.col("n_nationkey").cast("long")
    return table(spark, d, "nation").select("n_nationkey", functions.human_size(k * k * k * k * 37).alias("size"))


@query("SELECT p_partkey, p_size * 1000.0::DOUBLE + 0.5 AS plain, -p_size::DOUBLE AS minus, p_size * 10.0::DOUBLE ** 3 AS power FROM part", "L3")
def parse_numeric(spark, d):
    s = F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", functions.parse_numeric(F.concat(F.lit("+"), s, F.lit(",000.5"))).alias("plain"), functions.parse_numeric(F.concat(F.lit("−"), s)).alias("minus"), functions.parse_numeric(F.concat(s, F.lit(" × 10^3"))).alias("power"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') || '_' || p_size AS label FROM part", "L4")
def snake_label(spark, d):
    return table(spark, d, "part").select("p_partkey", functions.snake_label(F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_name"))).alias("label"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y %H-%M-%S') AS text, o_orderdate AS back FROM orders", "L7")
def timestamp_text(spark, d):
    o = table(spark, d, "orders").withColumn("text", F.date_format("o_orderdate", "dd-MM-yyyy HH-mm-ss"))
    return o.select("o_orderkey", "text", F.to_timestamp("text", "dd-MM-yyyy HH-mm-ss").cast("timestamp_ntz").alias("back"))


@query("SELECT p_partkey, p_size * 1024.0::DOUBLE AS k, p_size * 1048576.0::DOUBLE AS m FROM part", "L8")
def size_suffix(spark, d):
    s = F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", functions.size_suffix(F.concat(s, F.lit("K"))).alias("k"), functions.size_suffix(F.concat(s, F.lit(" MiB"))).alias("m"))


@query("SELECT DISTINCT regexp_extract(url, '([^/]+)/[^/]+$', 1) AS folder FROM pages", "L9")
def parent_folder(spark, d):
    return table(spark, d, "pages").select(functions.parent_folder(F.col("url")).alias("folder")).distinct()


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[\\t ]+')) AS token FROM benchmark) GROUP BY token", "L10")
def whitespace_tokens(spark, d):
    return table(spark, d, "benchmark").select(F.explode(F.split("text", "[\\t ]+")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# M, N: reports and plot data


def _runs(spark, d):
    return table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("edge_order"), F.col("value").alias("runtime"), "ts")


_RUNS = "SELECT event_type, user_id % 3 AS edge_order, value AS runtime, ts FROM events"


@query(f"SELECT event_type, edge_order, round(avg(runtime), 6) AS mean, round(stddev_pop(runtime), 6) AS deviation, count(*) AS runs FROM ({_RUNS}) GROUP BY 1, 2", "M1")
def runtime_mean_std(spark, d):
    return rounded(reports.runtime_stats(_runs(spark, d), ["event_type", "edge_order"]))


@query(f"SELECT event_type, " + ", ".join(f"round(avg(runtime) FILTER (edge_order = {k}), 6) AS \"{k}\"" for k in range(3)) + f" FROM ({_RUNS}) GROUP BY event_type", "M1")
def runtime_pivot(spark, d):
    return rounded(reports.runtime_pivot(_runs(spark, d), "event_type", "edge_order", [0, 1, 2]))


@query(f"SELECT event_type, count(*) AS runs FROM ({_RUNS}) GROUP BY event_type HAVING count(*) >= 180", "M3")
def complete_experiments(spark, d):
    return reports.complete(_runs(spark, d), "event_type", 11, 3, 5)


@query("SELECT count(*) AS n FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 7 DAY", "M4")
def min_date_filter(spark, d):
    e = table(spark, d, "events")
    low = e.agg((F.min("ts") + F.expr("INTERVAL 7 DAY")).alias("low"))
    return e.crossJoin(F.broadcast(low)).where("ts >= low").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CC}, p AS (SELECT id, id % 8 AS part FROM v), x AS (SELECT e.src, b.part FROM e JOIN p a ON a.id = e.src JOIN p b ON b.id = e.dst WHERE a.part <> b.part) SELECT (SELECT count(*) FROM x) AS cut, (SELECT sum(c) FROM (SELECT count(DISTINCT part) AS c FROM x GROUP BY src))::BIGINT AS volume", "M6")
def edge_cut(spark, d):
    g = graph(spark, d, "g_cc")
    return reports.edge_cut(g.edges, g.vertices.select("id", (F.col("id") % 8).alias("part")))


@query(f"WITH {CC} SELECT dst // 50 AS x, src // 50 AS y, count(*) AS n FROM e GROUP BY 1, 2", "N2")
def spy_grid(spark, d):
    return reports.spy_grid(graph(spark, d, "g_cc").edges, 50)


@query(f"WITH {CC} SELECT id % 7 AS comm, min(id) AS first, max(id) AS last, max(id) - min(id) + 1 AS side FROM v GROUP BY 1", "N4")
def community_extents(spark, d):
    v = graph(spark, d, "g_cc").vertices.select("id", (F.col("id") % 7).alias("comm"))
    return reports.extents(v, "comm", "id")


@query("SELECT p_partkey, (2 ** floor(log2(p_size)))::BIGINT AS core_side FROM part", "N10")
def dense_core_side(spark, d):
    return table(spark, d, "part").select("p_partkey", F.pow(F.lit(2.0), F.floor(F.log2(F.col("p_size").cast("double")) + 1e-12)).cast("long").alias("core_side"))


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) WHERE i = 3", "O4")
def job_by_index(spark, d):
    return relational.numbered_parts(table(spark, d, "events"), "event_type", ["event_id"]).where("number = 2").select("event_type", "event_id")


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events", "L11")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# A: sources


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""", "A19")
def href_edges(spark, d):
    return sources.href_edges(table(spark, d, "pages"))


@query(f"SELECT src, dst FROM ({RAW['g_ps']}) WHERE src % 2 = 0", "A4 A7 A8 A9 T14")
def text_edges_parsed(spark, d):
    e = fixtures.g_ps(spark, d)
    lines = e.select(F.when(F.col("src") % 2 == 0, F.concat_ws("\t", "src", "dst", F.lit("1.5"))).otherwise(F.concat(F.lit("% "), F.col("src"), F.lit(" "), F.col("dst"))).alias("value"))
    return sources.parse_edge_lines(lines)


# P: scraped statistics


@query(f"WITH {PS} SELECT sum(deg * (deg - 1) // 2)::BIGINT AS wedge, sum(deg * (deg - 1) * (deg - 2) // 6)::BIGINT AS claw, round(2.0::DOUBLE * (SELECT count(*) FROM u) / count(*), 6) AS mean_degree, max(deg) AS max_degree FROM deg", "P")
def scraped_statistics(spark, d):
    x = F.col("deg")
    deg = degrees.degrees(graph(spark, d, "g_ps"))
    return rounded(deg.agg(F.sum((x * (x - 1) / 2).cast("long")).alias("wedge"), F.sum((x * (x - 1) * (x - 2) / 6).cast("long")).alias("claw"), (F.sum("deg") / F.count(F.lit(1))).alias("mean_degree"), F.max("deg").alias("max_degree")))


# Round trips and lists


@query(f"WITH {UU} SELECT src, dst FROM e", "A10 A11 A14")
def edge_file_roundtrip(spark, d):
    path = fresh_path(spark, "edge_files")
    sources.write_edges(graph(spark, d, "g_uu").edges, f"{path}/bin", "bin")
    sources.write_edges(sources.read_edges(spark, f"{path}/bin", "bin"), f"{path}/net", "net")
    return sources.read_edges(spark, f"{path}/net", "net")


@query("SELECT event_type, 2 * count(*) AS n, 2 * sum(user_id)::BIGINT AS users FROM events GROUP BY event_type", "A17 A18")
def csv_append_roundtrip(spark, d):
    path, rows = fresh_path(spark, "runs"), table(spark, d, "events").select("event_type", "user_id")
    for part in ("a", "b"):
        sources.append_csv(rows, f"{path}/{part}")
    back = sources.read_csv_tree(spark, path, "event_type string, user_id long")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


@query("SELECT r_regionkey FROM region", "B11 O5")
def write_if_missing(spark, d):
    path, r = fresh_path(spark, "once"), table(spark, d, "region").select("r_regionkey")
    r.write.mode("ignore").parquet(path)
    r.where("r_regionkey > 2").write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


@query("SELECT r_regionkey, r_name AS name FROM region", "L11")
def row_maps(spark, d):
    m = F.create_map(F.lit("key"), F.col("r_regionkey").cast("string"), F.lit("name"), F.col("r_name"))
    return table(spark, d, "region").select("r_regionkey", m.alias("m")).select("r_regionkey", F.col("m")["name"].alias("name"))


@query("SELECT 'orig' AS name UNION ALL SELECT 'dbg'", "D16")
def ordering_names(spark, d):
    return spark.createDataFrame([(n,) for n in ordering.check_names(["orig", "dbg"])], "name string")


@query("SELECT 5 AS stages, 5 AS timed", "B10 T4")
def stage_timings(spark, d):
    rows = timings(fixtures.g_uu(spark, d))
    return spark.createDataFrame(rows, "stage string, ms double").agg(F.count(F.lit(1)).cast("int").alias("stages"), F.count_if(F.col("ms") > 0).cast("int").alias("timed"))


@query(None, "K4")
def cyclic_eigenvalue(spark, d):
    return spark.createDataFrame([(round(spectral.cyclic_eigenvalue(graph(spark, d, "g_uu")), 5),)], "cyclic_eigenvalue double")


@query(None, "K5")
def algebraic_connectivity(spark, d):
    return spark.createDataFrame([(round(spectral.algebraic_connectivity(graph(spark, d, "g_uu")), 5),)], "algebraic_connectivity double")


# The rest of the inventory: formats, reports and rules


@query("SELECT 3::BIGINT AS first_data_line, 3::INT AS n_columns, (SELECT count(*) FROM nation) AS rows", "A5 A6")
def header_sniffed(spark, d):
    rows = table(spark, d, "nation").select((F.col("n_nationkey") + 2).cast("long").alias("n"), F.concat_ws(" ", "n_nationkey", "n_regionkey", F.lit(1)).alias("value"))
    head = spark.createDataFrame([(0, "% a graph"), (1, "# of nations")], "n long, value string")
    lines = head.unionByName(rows)
    found = sources.first_data_line(lines).crossJoin(F.broadcast(sources.columns_in_text(lines)))
    return found.crossJoin(F.broadcast(sources.without_header(lines).agg(F.count(F.lit(1)).alias("rows"))))  # one row each


@query(_SORTED + " SELECT new_id AS id, id AS new_id FROM o", "A12 A13 D14")
def ordering_roundtrip(spark, d):
    path, g = fresh_path(spark, "orderings"), graph(spark, d, "g_ps")
    sources.write_ordering(ordering.degree_sort(degrees.degrees(g)), f"{path}/net", form="net", m=g.m())
    return ordering.inverted(sources.ordering_to_bin(spark, f"{path}/net", f"{path}/bin"))


@query(f"WITH {UU} SELECT src AS row, dst AS col, -1::BIGINT AS val FROM e UNION ALL SELECT dst, dst, count(*) FROM e GROUP BY dst", "A15 B12")
def triplets_roundtrip(spark, d):
    path = fresh_path(spark, "triplets")
    sources.write_triplets(simplify.laplacian(graph(spark, d, "g_uu").edges, in_degree=True), path)
    return sources.read_triplets(spark, path)


_LABELS = {"size": "p_partkey", "volume": "p_size * 1000", "mean_degree": "p_retailprice"}


def _tables(spark, d):
    p = table(spark, d, "part")
    rows = [("Size", F.format_number("p_partkey", 0)), ("Volume", F.concat(F.col("p_size").cast("string"), F.lit(" × 10^3"))), ("Mean degree", F.col("p_retailprice").cast("string")), ("Network format", F.when(F.col("p_size") > 25, "Unipartite, undirected").otherwise("Unipartite, directed"))]
    text = F.concat(F.lit("<table>"), *[F.concat(F.lit(f"<tr><td>{k}</td><td><i>x</i></td><td>"), v, F.lit("</td></tr>")) for k, v in rows], F.lit("</table>"))
    return p.select(F.col("p_partkey").alias("page_id"), text.alias("html"))


@query("SELECT p_partkey AS page_id, p_partkey::DOUBLE AS size, p_size * 1000.0::DOUBLE AS volume, p_retailprice AS mean_degree, CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS directed FROM part", "A19")
def table_scrape(spark, d):
    return sources.pivoted_values(sources.labelled_values(sources.table_cells(_tables(spark, d))), list(_LABELS))


@query("SELECT 'network_format' AS name UNION ALL SELECT 'volume'", "C25")
def schema_difference(spark, d):
    values = sources.labelled_values(sources.table_cells(_tables(spark, d)))
    return sources.unexpected_columns(values, ["size", "mean_degree"])


@query("SELECT 'g' || s_suppkey AS name, 'vol' AS obj_type, k AS num_parts, s_suppkey * 10 AS num_vertices, s_suppkey * 100 AS num_edges, k + 0.5::DOUBLE AS part_time, 0.25::DOUBLE AS io_time, s_suppkey + k AS comm_vol, s_suppkey * k AS edge_cut, 12.5::DOUBLE AS max_mem_used, 64.0::DOUBLE AS rusage_ru_maxrss, 0.125::DOUBLE AS report_time, k + 0.75::DOUBLE AS perf_time, 3.25::DOUBLE AS perf_total_time, 0.5::DOUBLE AS perf_std FROM supplier, (SELECT unnest([2, 4])::BIGINT AS k)", "A23")
def partition_runs(spark, d):
    key = F.col("s_suppkey")

    def run(k: int):
        fields = [("Name: graphs/g", key), (", #Vertices: ", key * 10), (", #Edges: ", key * 100), (", #Parts: ", F.lit(k)), ("\n - Edgecut: ", key * k), (", communication volume: ", key + k), (".\nI/O:", F.lit("  \t 0.25 sec")), ("\nPartitioning: ", F.lit(f"  {k}.5 sec")), ("\nReporting: ", F.lit(" 0.125 sec\n")), ("Max memory used:  ", F.lit("12.5 MB\n")), ("rusage.ru_maxrss: ", F.lit("64.0 MB\n"))]
        return F.concat(*[F.concat(F.lit(a), b.cast("string")) for a, b in fields])

    text = F.concat(run(2), run(4), F.lit("\n2.75 seconds\n4.75 seconds\n3.25 +- 0.5 mean\n0.5 seconds deviation\n"))
    return sources.partition_runs(table(spark, d, "supplier").select(F.concat(F.lit("/logs/a.vol.output")).alias("path"), text.alias("value")))


@query("SELECT p_partkey, m AS motif, p_partkey * k AS n FROM part, (VALUES ('wedge', 1), ('triangle', 2)) t(m, k)", "J8")
def motif_text(spark, d):
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("heading\n\nPattern Counts:\n[1-2][1-3]: "), key, F.lit("\n[1-2][1-3][2-3]: "), (F.col("p_partkey") * 2).cast("string"), F.lit("\n"))
    return sources.motif_lines(table(spark, d, "part").select("p_partkey", text.alias("value")), {"[1-2][1-3]": "wedge", "[1-2][1-3][2-3]": "triangle"})


@query("SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS loops FROM customer", "G17")
def loops_lookup(spark, d):
    said = F.when(F.col("c_nationkey") % 3 == 1, "Contains loops").when(F.col("c_nationkey") % 3 == 2, "Does not contain loops")
    return table(spark, d, "customer").select("c_custkey", functions.loops_allowed(said).alias("loops"))


@query("WITH RECURSIVE s(x0, x1, y0, y1) AS (SELECT 0::BIGINT, (SELECT count(*) FROM customer)::BIGINT, 0::BIGINT, (SELECT count(*) FROM customer)::BIGINT UNION ALL SELECT CASE WHEN i = 0 THEN x0 ELSE (x0 + x1) // 2 END, CASE WHEN i = 0 THEN (x0 + x1) // 2 ELSE x1 END, CASE WHEN j = 0 THEN y0 ELSE (y0 + y1) // 2 END, CASE WHEN j = 0 THEN (y0 + y1) // 2 ELSE y1 END FROM s, range(2) a(i), range(2) b(j) WHERE 2 * (x1 - x0) > 256 AND 2 * (y1 - y0) > 256) SELECT * FROM s WHERE 2 * (x1 - x0) <= 256 OR 2 * (y1 - y0) <= 256", "E19")
def core_tessellation(spark, d):
    return curves.halved_squares(spark, table(spark, d, "customer").count(), 256)


@query(f"WITH c AS (SELECT x::BIGINT AS hx0, y::BIGINT AS hy0 FROM range(8) a(x), range(8) b(y)), {_hilbert_sql('hx0', 'hy0', '8', 'c', 'hx0, hy0', 3)}, s AS (SELECT hd AS place, hx0 AS qx, hy0 AS qy, lead(hx0) OVER w - hx0 AS dx, lead(hy0) OVER w - hy0 AS dy FROM h3 WINDOW w AS (ORDER BY hd)), t AS (SELECT *, CASE WHEN dx = 1 THEN 'right' WHEN dx = -1 THEN 'left' WHEN dy = 1 THEN 'up' WHEN dy = -1 THEN 'down' END AS step FROM s), u AS (SELECT *, lag(step) OVER (ORDER BY place) AS was FROM t), x AS (SELECT place, qx, qy, coalesce(step, was) AS direction, CASE WHEN was IN ('up', 'left') THEN 'bot_right' ELSE 'top_left' END AS start, CASE WHEN was IS NULL OR coalesce(step, was) IN ('right', 'up') THEN 'top_right' ELSE 'bot_left' END AS finish FROM u) SELECT *, CASE start || finish WHEN 'top_lefttop_right' THEN 0 WHEN 'top_leftbot_left' THEN 90 WHEN 'bot_rightbot_left' THEN 180 ELSE 270 END AS rotation FROM x", "E14")
def quadrant_chain(spark, d):
    return curves.quadrant_chain(spark, 3)


@query(f"WITH {UU} SELECT src AS row, min(dst) AS least, max(dst) AS most FROM e WHERE src >= 20 AND dst >= 20 GROUP BY src", "E20")
def wing_extents(spark, d):
    return curves.outside_extents(graph(spark, d, "g_uu").edges, 20)


@query("SELECT c_custkey, c_acctbal FROM customer", "C20")
def empty_columns_dropped(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(0).alias("zero"), F.lit(None).cast("string").alias("nothing"), F.when(F.col("c_custkey") < 0, 1.0).alias("never"))
    return relational.without_empty_columns(c)


@query("SELECT event_type, max(user_id) AS size, count(*) AS runs, row_number() OVER (ORDER BY max(user_id) DESC, event_type) - 1 AS place FROM events GROUP BY event_type", "M2")
def groups_by_size(spark, d):
    return reports.groups_by_size(table(spark, d, "events"), "event_type", "user_id")


@query("SELECT p_partkey, p_name || ' - ' || format('{:,}', p_partkey * 1000) || ' nodes, ' || format('{:,}', p_partkey * 12345) || ' edges, about ' || p_size || ' MB, fill - ' || format('{:.4E}', 1.0::DOUBLE / (p_partkey + 1)) AS title FROM part", "M5")
def plot_titles(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", functions.title_text(F.col("p_name"), k * 1000, k * 12345, F.col("p_size"), F.lit("MB"), 1.0 / (k + 1)).alias("title"))


@query("SELECT n_regionkey AS part, sum(length(n_name) + 1)::BIGINT AS length, row_number() OVER (ORDER BY sum(length(n_name) + 1) DESC, n_regionkey) - 1 AS place FROM nation GROUP BY 1", "M7")
def inputs_by_size(spark, d):
    path = fresh_path(spark, "inputs")
    table(spark, d, "nation").select(F.col("n_regionkey").alias("part"), F.col("n_name").alias("value")).repartition(1).write.partitionBy("part").text(path)
    files = sources.files_by_size(spark, path).select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("int").alias("part"), "length")
    return files.withColumn("place", F.row_number().over(Window.orderBy(F.desc("length"), "part")) - 1)  # a row per file


@query("SELECT p_partkey, 1 AS marker, CASE WHEN p_partkey * 37 < 5000 THEN 10 ELSE floor(p_partkey * 37 * 0.0002::DOUBLE) * 10 END::BIGINT AS side FROM part", "N6")
def figure_sizes(spark, d):
    n = F.col("p_partkey") * 37
    return table(spark, d, "part").select("p_partkey", functions.marker_size(n).alias("marker"), functions.figure_side(F.lit(10), n).alias("side"))


_FOUR_WAYS = [("left", 5, 5, 2, 5), ("right", 2, 5, 5, 5), ("down", 4, 6, 4, 1), ("up", 4, 1, 4, 6)]


@query("SELECT * FROM (VALUES ('left', 0, 1, 4), ('left', 1, 4, 4), ('left', 2, 4, 6), ('left', 3, 1, 6), ('right', 0, 6, 4), ('right', 1, 1, 4), ('right', 2, 1, 6), ('right', 3, 6, 6), ('down', 0, 5, 5), ('down', 1, 5, 0), ('down', 2, 3, 0), ('down', 3, 3, 5), ('up', 0, 5, 2), ('up', 1, 5, 7), ('up', 2, 3, 7), ('up', 3, 3, 2)) t(way, corner, x, y)", "N9")
def line_rectangles(spark, d):
    lines = spark.createDataFrame(_FOUR_WAYS, "way string, x0 int, y0 int, x1 int, y1 int")
    return lines.select("way", F.posexplode(functions.line_corners(*map(F.col, ("x0", "y0", "x1", "y1")), F.lit(1))).alias("corner", "p")).select("way", "corner", "p.x", "p.y")


@query("SELECT p_partkey + 1 AS line, 1024 AS cache_power, 512 AS quadrant_side, (2 ** floor(log2(p_partkey + 1) + 1e-12))::BIGINT AS core_side FROM part", "N10")
def guide_lines(spark, d):
    return table(spark, d, "part").select(*reports.guide_lines(F.col("p_partkey") + 1))


_CONFIG = '{"mode": "pr_expt", "data-dir": "/data", "time": "01:00", "mem": "4G", "cpus-per-task": 2, "constraint": "any", "reorder": ["rnd", "dbg"], "directed": true, "overwrite": false, "debug": true, "graph-numbers": {"min": 3, "max": 9}}'


@query("SELECT unnest(range(14)) AS place, unnest(['python', '-m', 'edgeloom', '--mode', 'pr_expt', '--data-dir', '/data', '--reorder', 'rnd', 'dbg', '--directed', '--debug', '--graph-numbers', '3']) AS argument UNION ALL SELECT 14, '9'", "O1")
def config_arguments(spark, d):
    return spark.createDataFrame(list(enumerate(functions.main_arguments(json.loads(_CONFIG)))), "place long, argument string")


@query("SELECT p_partkey, (p_partkey + 9 - p_partkey + 1) * (p_size + 1) * 3 - 1 AS last FROM part", "O3")
def job_array_size(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", functions.array_size(k, k + 9, F.col("p_size") + 1, F.lit(3)).cast("long").alias("last"))


@query("SELECT s_suppkey AS job_id, CASE WHEN s_suppkey % 2 = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS state FROM supplier", "O7")
def job_report(spark, d):
    state = F.when(F.col("s_suppkey") % 2 == 0, "COMPLETED").otherwise("FAILED")
    one = F.struct(F.col("s_suppkey").alias("job_id"), F.struct(state.alias("current")).alias("state"))
    return sources.job_states(table(spark, d, "supplier").select(F.to_json(F.struct(F.array(one).alias("jobs"))).alias("value")))


@query("SELECT r_name AS name, 'u' || r_regionkey AS url FROM region WHERE r_regionkey IN (1, 3)", "A20")
def dataset_catalog(spark, d):
    path = fresh_path(spark, "catalog")
    r = table(spark, d, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("u"), F.col("r_regionkey").cast("string")).alias("url"))
    names = [x["r_name"] for x in table(spark, d, "region").where("r_regionkey in (1, 3)").collect()]  # two rows
    r.agg(F.to_json(F.struct(F.collect_list(F.struct("name", "url")).alias("datasets"))).alias("value")).write.text(path)  # a catalog of five
    return sources.read_datasets_json(spark, path, names)


@query(None, "D9 N3")
def slashburn_metrics(spark, d):
    g = graph(spark, d, "g_uu")
    _, done = ordering.slashburn(g, 0.1)
    m = ordering.slashburn_metrics(g.n(), done["k"], done["n_iters"])
    return spark.createDataFrame([tuple(m.values())], "n long, k long, n_iters long, core_side long, wing_width_ratio double")


@query(None, "D7 D8")
def slashburn_order(spark, d):
    return ordering.slashburn(graph(spark, d, "g_uu"), 0.1)[0]


@query(None, "D10 D13")
def cuthill_mckee_order(spark, d):
    return ordering.cuthill_mckee(graph(spark, d, "g_cc"))


@query(None, "D12")
def hierarchy_order(spark, d):
    return ordering.hierarchy_order(graph(spark, d, "g_uu"))


@query(f"WITH {UU}, c AS (SELECT id, id % 4 AS comm FROM v), x AS (SELECT p.comm AS a, q.comm AS b FROM u JOIN c p ON p.id = u.a JOIN c q ON q.id = u.b), s AS (SELECT comm, count(*)::DOUBLE AS d FROM (SELECT a AS comm FROM x UNION ALL SELECT b FROM x) GROUP BY comm) SELECT round((SELECT count(*) FILTER (a = b) / count(*)::DOUBLE FROM x) - sum(d * d) / (4.0::DOUBLE * (SELECT count(*) FROM x) ** 2), 6) AS modularity FROM s", "D12")
def partition_modularity(spark, d):
    g = graph(spark, d, "g_uu")
    return rounded(ordering.modularity(g, g.vertices.select("id", (F.col("id") % 4).alias("comm"))))


@query("SELECT v AS vertex_order, e AS edge_order, 1 AS valid, true AS timed FROM (VALUES ('orig'), ('srt')) a(v), (VALUES ('row'), ('column'), ('hilbert')) b(e)", "F4 F5 F8")
def pagerank_experiments(spark, d):
    g = graph(spark, d, "g_uu")
    runs = pagerank.experiments(g, {"orig": ordering.original(g), "srt": ordering.degree_sort(degrees.degrees(g))}, ["row", "column", "hilbert"])
    return runs.select("vertex_order", "edge_order", "valid", (F.col("ms") > 0).alias("timed"))


@query(None, "G9")
def in_out_corr_test(spark, d):
    deg = degrees.degrees(graph(spark, d, "g_ps"))
    return degrees.with_p_value(degrees.in_out_correlation(deg), "correlation", deg.count())


@query(None, "G10")
def assortativity_test(spark, d):
    g = graph(spark, d, "g_ps")
    return degrees.with_p_value(degrees.assortativity(g, degrees.degrees(g), "out_deg"), "assortativity_out_deg", g.m())


@query(None, "I8")
def diameter_of_core(spark, d):
    return spark.createDataFrame([(distances.diameter(graph(spark, d, "g_ps")),)], "diameter int")


@query("SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 1.0::DOUBLE)) t(place, eigenvalue)", "K7")
def inverse_connectivity(spark, d):
    n = table(spark, d, "nation")
    g = simplify.simplify(n.select(F.col("n_nationkey").cast("long").alias("src"), (F.lit(1000) + F.col("n_regionkey")).cast("long").alias("dst")))
    least = spectral.smallest_by_inverse(g.vertices, spectral.laplacian_product(written(simplify.symmetrize(g.edges), "both")), -1.0, 2)
    return spark.createDataFrame([(i, abs(round(float(x), 5))) for i, x in enumerate(least)], "place int, eigenvalue double")


_MORE = "(SELECT sum(deg * (deg - 1) * (deg - 2) * (deg - 3) // 24)::BIGINT FROM deg) AS cross_count"


@query(f"WITH {UU}, {_TRI}, w AS (SELECT x.dst AS a, y.dst AS b, count(*) AS c FROM both_ways x JOIN both_ways y ON y.src = x.src AND x.dst < y.dst GROUP BY 1, 2) SELECT {_MORE}, (SELECT sum(c * (c - 1) / 2) / 2 FROM w)::BIGINT AS square, (SELECT count(*) FROM tri) AS triangle, (8 * (SELECT sum(c * (c - 1) / 2) / 2 FROM w) + 4 * (SELECT sum(deg * (deg - 1) / 2) FROM deg) + 2 * (SELECT count(*) FROM u))::BIGINT AS tour_count_4", "P")
def scraped_motifs(spark, d):
    g = graph(spark, d, "g_uu")
    m = motifs.motif_counts(g)
    square = F.col("cycle_4") + F.col("chordal_cycle_4") + 3 * F.col("clique_4")
    x = F.col("deg")
    cross = degrees.degrees(g).agg(F.sum((x * (x - 1) * (x - 2) * (x - 3) / 24).cast("long")).alias("cross_count"))
    links = simplify.undirected(g.edges).agg(F.count(F.lit(1)).alias("links"))
    row = m.crossJoin(F.broadcast(cross)).crossJoin(F.broadcast(links))  # one row each
    return row.select("cross_count", square.alias("square"), "triangle", (8 * square + 4 * F.col("edge_wedge") + 2 * F.col("links")).alias("tour_count_4"))


@query(f"{_SCC} SELECT round(max(n) / (SELECT count(*) FROM v)::DOUBLE, 6) AS relative_lscc FROM (SELECT count(*) AS n FROM comp GROUP BY scc)", "P")
def relative_lscc(spark, d):
    g = graph(spark, d, "g_ps")
    return scc.component_summary(scc.strongly_connected(g), "scc").select(F.round(F.col("largest") / F.lit(g.n()), 6).alias("relative_lscc"))


def timings(raw: DataFrame) -> list[tuple[str, float]]:
    """Milliseconds of each step of simplification, each made by an action of its own."""
    out = []

    def timed(name, df):
        began = time.perf_counter()
        df = written(df, name)
        out.append((name, (time.perf_counter() - began) * 1000))
        return df

    kept = timed("ingest", simplify.drop_loops(raw))
    ends = timed("unique_vs", simplify.endpoints(kept))
    ids = timed("sort_vs", simplify.dense_ids(ends, "orig_id"))
    edges = timed("unique_es", simplify.relabel(kept.distinct(), ids))
    timed("sort_es", edges.sortWithinPartitions("src", "dst"))
    return out


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The twenty highest PageRank scores of the customer graph."""
    return pagerank.pagerank(graph(spark, d, "g_cc")).orderBy(F.desc("score"), "id").limit(20)
