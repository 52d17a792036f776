"""Extreme eigenvalues and singular values by Krylov steps whose products run in Spark.

The basis lives in one table with an array of coordinates per vertex. A step
takes one product and two rounds of orthogonalisation, each of which sums all
inner products in a single aggregate; only these sums reach the driver, where
the small projected matrix is solved. Steps go on until the residual of the
wanted values is small enough, or the space is used up; a run that needs more
than ``MOST`` steps fails rather than return a value that has not settled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.components import connected_components
from edgeloom.operators.pagerank import spmv
from edgeloom.operators.scc import extract_component
from edgeloom.operators.simplify import Graph, endpoints, symmetrize, transpose
from edgeloom.plans.durable import forget, written

MOST, TOLERANCE, EVERY = 300, 1e-7, 4
Product = Callable[[DataFrame], DataFrame]


def _sums(df: DataFrame, k: int, values: str = "w") -> np.ndarray:
    """Inner products of the column with the k columns of the basis, and with itself."""
    row = df.agg(*[F.sum(F.col(values) * F.col("q")[i]) for i in range(k)], F.sum(F.col(values) * F.col(values))).head()
    return np.array([x or 0.0 for x in row])


def _less(values: str, parts: np.ndarray):
    """The column without its parts along the basis."""
    along = F.zip_with("q", F.array(*[F.lit(float(x)) for x in parts]), lambda a, b: a * b)
    return F.col(values) - F.aggregate(along, F.lit(0.0), lambda s, x: s + x)


def krylov(vertices: DataFrame, product: Product, wanted: Callable[[np.ndarray], np.ndarray], symmetric: bool, seed: int = 1, flat: bool = False, tolerance: float = TOLERANCE, most: int = MOST) -> np.ndarray:
    """Ritz values of an operator once those that ``wanted`` picks (their indices) have settled.

    ``product`` maps (id, value) to (id, value), absent ids meaning zero;
    ``flat`` keeps to vectors whose values sum to zero.
    """
    n = vertices.count()
    if n - flat < 1:
        return np.zeros(0)
    start = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2000003)) + 1) / 2000004.0 - 0.5
    first = vertices.select("id", start.alias("w"))
    if flat:
        mean = first.agg(F.avg("w")).head()[0]
        first = first.select("id", (F.col("w") - F.lit(mean)).alias("w"))
    norm = np.sqrt(first.agg(F.sum(F.col("w") * F.col("w"))).head()[0])
    basis = written(first.select("id", F.array(F.col("w") / F.lit(float(norm))).alias("q")), "basis")
    h = np.zeros((most + 1, most))
    for k in range(1, most + 1):
        sent = product(basis.select("id", F.element_at("q", k).alias("value"))).withColumnRenamed("value", "w")
        step = written(basis.join(sent, "id", "left").select("id", "q", F.coalesce("w", F.lit(0.0)).alias("w")), "step")
        parts = _sums(step, k)
        size, once = np.sqrt(parts[k]), parts[:k]
        again = step.select("id", "q", _less("w", once).alias("w"))
        if flat:  # rounding must not bring the constant vector back
            mean = again.agg(F.avg("w")).head()[0]
            again = again.select("id", "q", (F.col("w") - F.lit(mean)).alias("w"))
        twice = _sums(again, k)
        h[:k, k - 1] = once + twice[:k]
        h[k, k - 1] = np.sqrt(max(0.0, twice[k] - (twice[:k] ** 2).sum()))
        ended = k >= n - flat or h[k, k - 1] <= 1e-10 * max(size, 1e-300)
        if ended or k % EVERY == 0:
            small = h[:k, :k]
            values, vectors = np.linalg.eigh((small + small.T) / 2) if symmetric else np.linalg.eig(small)
            pick = wanted(values)
            left = h[k, k - 1] * np.abs(vectors[-1, pick]) / np.maximum(np.linalg.norm(vectors[:, pick], axis=0), 1e-300)
            if ended or k >= 2 * len(pick) and (left <= tolerance * max(1e-300, np.abs(values).max())).all():
                return values
        grown = again.select("id", F.concat("q", F.array(_less("w", twice[:k]) / F.lit(float(h[k, k - 1])))).alias("q"))
        grown = written(grown, "basis")
        forget(basis)
        forget(step)
        basis = grown
    raise RuntimeError(f"eigenvalues have not settled in {most} steps")


def _largest(count: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda values: np.argsort(-np.abs(values), kind="stable")[:count]


def spectral_norm(g: Graph, most: int = MOST, **limits) -> tuple[float, float]:
    """Largest and second largest absolute eigenvalue of the symmetrised adjacency matrix."""
    both = written(symmetrize(g.edges), "both")
    values = np.sort(np.abs(krylov(g.vertices, lambda v: spmv(both, v), _largest(2), True, most=most, **limits)))[::-1]
    return float(values[0]) if len(values) else 0.0, float(values[1]) if len(values) > 1 else 0.0


def spectral_separation(g: Graph, most: int = MOST, **limits) -> float:
    first, second = spectral_norm(g, most, **limits)
    return first / second if second else float("inf")


def operator_norm(g: Graph, most: int = MOST, **limits) -> float:
    """Largest singular value of the directed adjacency matrix."""
    back = transpose(g.edges)
    values = krylov(g.vertices, lambda v: spmv(back, spmv(g.edges, v)), _largest(1), True, most=most, **limits)
    return float(np.sqrt(values.max())) if len(values) else 0.0


def cyclic_eigenvalue(g: Graph, most: int = MOST, **limits) -> float:
    """Largest absolute eigenvalue of the directed adjacency matrix, complex and opposite pairs included."""
    values = krylov(g.vertices, lambda v: spmv(g.edges, v), _largest(1), False, most=most, **limits)
    return float(np.abs(values).max()) if len(values) else 0.0


def laplacian_product(both: DataFrame) -> Product:
    """Degree times value less the neighbours' values, over symmetric edges."""
    deg = written(both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")), "deg")

    def product(v: DataFrame) -> DataFrame:
        own = v.join(deg, "id").select("id", (F.col("d") * F.col("value")).alias("value"))
        return own.unionByName(spmv(both, v).select("id", (-F.col("value")).alias("value"))).groupBy("id").agg(F.sum("value").alias("value"))

    return product


def algebraic_connectivity(g: Graph, most: int = MOST, **limits) -> float:
    """Second smallest Laplacian eigenvalue of the largest connected component (0 for a single vertex), the constant vector deflated."""
    inside = written(symmetrize(extract_component(g, connected_components(g.edges))), "inside")
    vertices = written(endpoints(inside).withColumnRenamed("orig_id", "id"), "members")
    values = krylov(vertices, laplacian_product(inside), lambda v: np.argsort(v)[:1], True, flat=True, most=most, **limits)
    return float(values.min()) if len(values) else 0.0


def solved(vertices: DataFrame, product: Product, rhs: DataFrame, tolerance: float = 1e-10, most: int = MOST) -> DataFrame:
    """(id, value) that a positive definite ``product`` maps to ``rhs``, by conjugate gradients."""
    x = written(vertices.join(rhs, "id", "left").select("id", F.lit(0.0).alias("x"), F.coalesce("value", F.lit(0.0)).alias("r"), F.coalesce("value", F.lit(0.0)).alias("p")), "cg")
    now = whole = x.agg(F.sum(F.col("r") * F.col("r"))).head()[0] or 0.0
    for _ in range(most):
        if now <= tolerance**2 * whole:
            return x.select("id", F.col("x").alias("value"))
        sent = product(x.select("id", F.col("p").alias("value"))).withColumnRenamed("value", "s")
        held = written(x.join(sent, "id", "left").select("id", "x", "r", "p", F.coalesce("s", F.lit(0.0)).alias("s")), "cg")
        a = now / held.agg(F.sum(F.col("p") * F.col("s"))).head()[0]
        moved = held.select("id", (F.col("x") + F.lit(a) * F.col("p")).alias("x"), (F.col("r") - F.lit(a) * F.col("s")).alias("r"), "p")
        new = moved.agg(F.sum(F.col("r") * F.col("r"))).head()[0]
        grown = written(moved.select("id", "x", "r", (F.col("r") + F.lit(new / now) * F.col("p")).alias("p")), "cg")
        forget(x)
        forget(held)
        x, now = grown, new
    raise RuntimeError(f"the linear system has not settled in {most} steps")


def smallest_by_inverse(vertices: DataFrame, product: Product, shift: float, count: int = 1, **limits) -> np.ndarray:
    """The ``count`` eigenvalues next above ``shift`` (below all of them) of a symmetric operator: Krylov steps on the inverse of operator - shift."""

    def shifted(v: DataFrame) -> DataFrame:
        own = v.select("id", (F.lit(-shift) * F.col("value")).alias("value"))
        return product(v).unionByName(own).groupBy("id").agg(F.sum("value").alias("value"))

    values = krylov(vertices, lambda v: solved(vertices, shifted, v), _largest(count), True, **limits)
    return np.sort(shift + 1 / values[_largest(count)(values)])
