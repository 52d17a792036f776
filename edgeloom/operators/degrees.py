"""Degrees and the statistics of their distributions, as single-pass aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.simplify import Graph, symmetrize, transpose
from edgeloom.plans.ranking import running_offsets


def degrees(g: Graph) -> DataFrame:
    """id, out_deg, in_deg, deg (undirected) of every vertex, by one aggregate over tagged endpoints."""
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    counts = ends.groupBy("x.id").agg(F.sum("x.o").alias("out_deg"), F.sum("x.i").alias("in_deg"))
    und = symmetrize(g.edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    out = g.vertices.select("id").join(counts, "id", "left").join(und, "id", "left")
    return out.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("out_deg", "in_deg", "deg")])


def summary(deg: DataFrame) -> DataFrame:
    """Largest and truncated median degree of each kind."""
    aggs = []
    for c in ("out_deg", "in_deg", "deg"):
        aggs += [F.max(c).alias(f"max_{c}"), F.floor(F.percentile(c, 0.5)).cast("long").alias(f"median_{c}")]
    return deg.agg(*aggs)


def moments(deg: DataFrame, col: str = "deg") -> DataFrame:
    """Population mean, variance, deviation, skewness and excess kurtosis."""
    return deg.agg(F.avg(col).alias("mean"), F.var_pop(col).alias("variance"), F.stddev_pop(col).alias("stddev"), F.skewness(col).alias("skewness"), F.kurtosis(col).alias("kurtosis"))


def power_law_closed(deg: DataFrame, col: str = "deg", xmin: int | None = None) -> DataFrame:
    """1 + n / sum(ln(d / dmin)) over degrees of at least dmin (the smallest positive one by default)."""
    positive = deg.where(F.col(col) > 0) if xmin is None else deg.where(F.col(col) >= xmin)
    stats = positive.agg(F.count(F.lit(1)).alias("n"), F.sum(F.log(F.col(col).cast("double"))).alias("logs"), F.min(col).alias("least"))
    low = F.col("least") if xmin is None else F.lit(xmin)
    return stats.select((1 + F.col("n") / (F.col("logs") - F.col("n") * F.log(low.cast("double")))).alias("exponent"))


def _zeta(s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Hurwitz zeta by Euler-Maclaurin, element by element."""
    s, q = np.broadcast_arrays(np.asarray(s, float), np.asarray(q, float))
    n = 12
    total = sum((q + k) ** -s for k in range(n))
    a = q + n
    total = total + a ** (1 - s) / (s - 1) + 0.5 * a**-s
    term, fact = s * a ** (-s - 1), 1.0
    for k, b in enumerate((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)):
        fact *= (2 * k + 1) * (2 * k + 2)
        total = total + b * term / fact
        term = term * (s + 2 * k + 1) * (s + 2 * k + 2) / a**2
    return total


def fitted_power_law(x: np.ndarray, count: np.ndarray) -> dict:
    """The discrete power law with the least KS distance over all lower ends, from a histogram (x ascending and positive)."""
    if len(x) < 2:
        return {"alpha": float("nan"), "xmin": 0, "loglik": float("nan"), "ks": float("nan"), "n_tail": 0}
    n = count[::-1].cumsum()[::-1].astype(float)
    logs = (count * np.log(x))[::-1].cumsum()[::-1]
    low, high = np.full(len(x) - 1, 1.01), np.full(len(x) - 1, 8.0)
    q, size, sums = x[:-1].astype(float), n[:-1], logs[:-1]
    loglik = lambda a: -size * np.log(_zeta(a, q)) - a * sums
    for _ in range(60):  # the likelihood is unimodal in alpha
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = loglik(a) < loglik(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    alpha = (low + high) / 2
    best = None
    for k in range(len(alpha)):
        seen = count[k:].cumsum() / size[k]
        ks = float(np.abs(seen - (1 - _zeta(alpha[k], x[k:] + 1.0) / _zeta(alpha[k], q[k]))).max())
        if best is None or ks < best[0]:
            best = (ks, k)
    ks, k = best
    return {"alpha": float(alpha[k]), "xmin": int(x[k]), "loglik": float(loglik(alpha)[k]), "ks": ks, "n_tail": int(size[k])}


def power_law_p_value(x: np.ndarray, count: np.ndarray, fit: dict, draws: int = 100, seed: int = 0) -> float:
    """Share of samples of the fitted law (below its lower end: of the histogram) that lie further from their own fit."""
    if not fit["n_tail"]:
        return float("nan")
    rng, n, below = np.random.default_rng(seed), int(count.sum()), x < fit["xmin"]
    worse = 0
    for _ in range(draws):
        tail = rng.binomial(n, fit["n_tail"] / n)
        drawn = np.floor((fit["xmin"] - 0.5) * (1 - rng.random(tail)) ** (-1 / (fit["alpha"] - 1)) + 0.5)
        values, counts = np.unique(np.minimum(drawn, 1e15), return_counts=True)
        if below.any():
            rest = rng.multinomial(n - tail, count[below] / count[below].sum())
            values, counts = np.concatenate([x[below][rest > 0], values]), np.concatenate([rest[rest > 0], counts])
        worse += fitted_power_law(values, counts)["ks"] >= fit["ks"]
    return worse / draws


def power_law_discrete(deg: DataFrame, col: str = "deg", draws: int = 0) -> dict:
    """alpha, xmin, log-likelihood, KS distance and n_tail of the discrete power law with the least KS distance; p_value if draws are asked for.

    Only the degree histogram (one row per distinct degree, far fewer than
    vertices) leaves the cluster.
    """
    hist = sorted((r[0], r[1]) for r in deg.where(F.col(col) > 0).groupBy(col).agg(F.count(F.lit(1))).collect())
    x, count = np.array([h[0] for h in hist], float), np.array([h[1] for h in hist], np.int64)
    fit = fitted_power_law(x, count)
    return fit | {"p_value": power_law_p_value(x, count, fit, draws)} if draws else fit


def gini(deg: DataFrame, col: str = "deg") -> DataFrame:
    """gini (textbook) and gini_whole (with the integer quotient (n + 1) / n), from the histogram."""
    hist = deg.groupBy(F.col(col).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    hist = running_offsets(hist, [], "d", "c", "before")
    # Ranks before+1 .. before+c share a degree: their sum is c * before + c (c + 1) / 2.
    part = F.sum(F.col("d") * (F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2)).alias("ranked")
    s = hist.agg(part, F.sum("c").alias("n"), F.sum(F.col("d") * F.col("c")).alias("total"))
    base = 2 * F.col("ranked") / (F.col("n") * F.col("total"))
    return s.select((base - (F.col("n") + 1) / F.col("n")).alias("gini"), (base - F.floor((F.col("n") + 1) / F.col("n"))).alias("gini_whole"))


def edge_entropy(deg: DataFrame, m: DataFrame) -> DataFrame:
    """Relative entropy of the edge distribution: -sum(p ln p) / ln n with p = d / 2m; ``m`` has one row (m)."""
    p = F.col("deg") / (2 * F.col("m"))
    return deg.crossJoin(F.broadcast(m)).where("deg > 0").agg((F.sum(-p * F.log(p)) / F.log(F.count(F.lit(1)))).alias("entropy"))  # m: one row


def in_out_correlation(deg: DataFrame) -> DataFrame:
    return deg.agg(F.corr(F.log1p("in_deg"), F.log1p("out_deg")).alias("correlation"))


def with_p_value(one: DataFrame, coefficient: str, n: int) -> DataFrame:
    """One row with a Pearson coefficient of n pairs, and its two-sided p-value beside it."""
    r = one.head()[coefficient]
    p = student_p(r, n) if r is not None and not math.isnan(r) else float("nan")
    return one.sparkSession.createDataFrame([(r, p)], f"{coefficient} double, p_value double")


def assortativity(g: Graph, deg: DataFrame, kind: str) -> DataFrame:
    """Correlation over edges of the endpoints' degrees of one kind."""
    a, b = deg.select(F.col("id").alias("src"), F.col(kind).cast("double").alias("x")), deg.select(F.col("id").alias("dst"), F.col(kind).cast("double").alias("y"))
    return g.edges.join(a, "src").join(b, "dst").agg(F.corr("x", "y").alias(f"assortativity_{kind}"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """Share of edges whose reverse is there."""
    back = transpose(edges).withColumn("back", F.lit(1))
    return edges.join(back, ["src", "dst"], "left").agg((F.count("back") / F.count(F.lit(1))).alias("reciprocity"))


def balanced_inequality(deg: DataFrame, col: str = "deg") -> DataFrame:
    """The share P at which the top P of the degrees hold 1 - P of the edges: the first crossing over degrees in descending order."""
    hist = deg.groupBy(F.col(col).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)  # a row per distinct degree
    run = hist.withColumn("top", F.sum("c").over(w)).withColumn("held", F.sum(F.col("c") * F.col("d")).over(w))
    total = hist.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("d")).alias("t"))
    cross = run.crossJoin(F.broadcast(total)).where(F.col("held") / F.col("t") >= 1 - F.col("top") / F.col("n"))  # total: one row
    return cross.agg(F.min(F.col("top") / F.col("n")).alias("share"))


def mode_frequency(deg: DataFrame, col: str = "deg") -> DataFrame:
    return deg.groupBy(col).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("mode_count"))


def student_p(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson coefficient, by the regularised incomplete beta function."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else float("nan")
    df = n - 2
    x = df / (df + r * r * df / (1 - r * r))
    a, b = df / 2, 0.5

    def fraction(a, b, x):
        c, d, f = 1.0, 1.0 - (a + b) * x / (a + 1), 1.0
        d = 1.0 / (d or 1e-300)
        f = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / ((1.0 + num * d) or 1e-300)
                c = (1.0 + num / c) or 1e-300
                f *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return f

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
