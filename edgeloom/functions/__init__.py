"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def struct_size(n: Column, m: Column) -> Column:
    """Bytes of the edge and vertex arrays of a graph: 16 m + 24 n."""
    return 16 * m + 24 * n


def human_size(size: Column) -> Column:
    """A byte count as text with two decimals and a unit to the base 1024; 0 is ``0B``."""
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB", "PB", "EB")])
    step = F.floor(F.log(size.cast("double")) / F.log(F.lit(1024.0)) + 1e-12).cast("int")
    value = F.round(size / F.pow(F.lit(1024.0), step), 2)
    return F.when(size == 0, F.lit("0B")).otherwise(F.concat(value.cast("string"), F.element_at(units, step + 1)))


def parse_numeric(text: Column) -> Column:
    """Numbers as people write them: blanks and commas inside, a typographic minus, a leading plus, ``x 10^k``."""
    plain = F.regexp_replace(F.regexp_replace(text, "−", "-"), "[\\s ,+]", "")
    base, power = F.regexp_extract(plain, r"^(-?[0-9]*\.?[0-9]+)", 1), F.regexp_extract(plain, r"(?:×|x|\*)10\^?(-?[0-9]+)$", 1)
    number = F.when(base != "", base.cast("double")) * F.when(power != "", F.pow(F.lit(10.0), F.when(power != "", power).cast("double"))).otherwise(F.lit(1.0))
    return F.when(F.lower(plain).isin("inf", "∞"), F.lit(float("inf"))).otherwise(number)


def snake_label(text: Column) -> Column:
    """Lower case, words joined by underscores, a leading number moved to the end; ``join`` becomes ``network_join``."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "_"), r"^_|_$", "")
    lead = F.regexp_extract(plain, r"^([0-9]+)_?(.+)$", 1)
    moved = F.when(lead != "", F.concat(F.regexp_extract(plain, r"^([0-9]+)_?(.+)$", 2), F.lit("_"), lead)).otherwise(plain)
    return F.when(moved == "join", F.lit("network_join")).otherwise(moved)


def critical_depth(threads: Column) -> Column:
    """The smallest d with 4 ** d of at least ``threads``."""
    return F.ceil(F.log(threads.cast("double")) / F.log(F.lit(4.0)) - 1e-12).cast("int")


def next_multiple(n: Column, depth: int) -> Column:
    """The smallest multiple of 2 ** depth that is at least n, in whole numbers."""
    return ((n + ((1 << depth) - 1)) / (1 << depth)).cast("long") * (1 << depth)


def choose(n: Column, k: int) -> Column:
    top, bottom = F.lit(1.0), 1
    for i in range(k):
        top, bottom = top * (n - i), bottom * (i + 1)
    return top / bottom


def motif_constant(n: Column, name: str) -> Column:
    """The most subgraphs of a kind that n vertices can hold."""
    falling = n * (n - 1) * (n - 2)
    return {
        "wedge": falling / 2,
        "triangle": choose(n, 3),
        "star_4": n * choose(n - 1, 3),
        "path_4": falling * (n - 3) / 2,
        "tailed_triangle": 3 * (n - 3) * choose(n, 3),
        "cycle_4": falling * (n - 3) / 4,
        "chordal_cycle_4": falling * (n - 3) / 4 * 2,
        "clique_4": choose(n, 4),
        "clique_5": choose(n, 5),
    }[name]


def size_suffix(text: Column) -> Column:
    """``32K``, ``1.5M``, ``2G`` in bytes."""
    number, unit = F.regexp_extract(text, r"([0-9.]+)", 1).cast("double"), F.upper(F.regexp_extract(text, r"([KMGkmg])", 1))
    return number * F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).otherwise(1)


def parent_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def rotated(cx: Column, cy: Column, angle: int, x: Column, y: Column) -> tuple[Column, Column]:
    """A point turned about a centre by a multiple of 90 degrees."""
    turns = {0: (x, y), 90: (cx - (y - cy), cy + (x - cx)), 180: (2 * cx - x, 2 * cy - y), 270: (cx + (y - cy), cy - (x - cx))}
    return turns[angle % 360]


def loops_allowed(loops: Column) -> Column:
    """Whether a graph's metadata say that it contains loops; null where they say nothing."""
    return F.when(loops.isNotNull() & (loops != ""), loops == "Contains loops")


def figure_side(axis: Column, n: Column) -> Column:
    """Side of a figure: one axis below 5,000 vertices, else an axis for each whole 5,000th part."""
    return F.when(n < 5000, axis).otherwise(F.floor(n * F.lit(0.0002)) * axis).cast("long")


def marker_size(n: Column) -> Column:
    """Markers are one point wide whatever the number of vertices."""
    return F.when(n.isNotNull(), F.lit(1))


#: The corners of a line's rectangle by its direction, each the line's start (S) or end (E) moved by the width in x and y.
_CORNERS = {"left": "E-- S-- S-+ E-+", "right": "E+- S-- S-+ E++", "down": "S+- E+- E-- S--", "up": "S++ E++ E-+ S-+"}


def line_corners(x0: Column, y0: Column, x1: Column, y1: Column, width: Column) -> Column:
    """Corners of the rectangle around a line that runs along an axis, as an array of (x, y)."""

    def corner(code: str) -> Column:
        x, y = (x0, y0) if code[0] == "S" else (x1, y1)
        moved = [v + width if sign == "+" else v - width for v, sign in zip((x, y), code[1:], strict=True)]
        return F.struct(moved[0].alias("x"), moved[1].alias("y"))

    of = {k: F.array(*map(corner, codes.split())) for k, codes in _CORNERS.items()}
    return F.when(x1 < x0, of["left"]).when(x0 < x1, of["right"]).when(y1 < y0, of["down"]).otherwise(of["up"])


def power_below(x: Column) -> Column:
    """The largest power of two that is at most x (x of at least 1)."""
    return F.pow(F.lit(2.0), F.floor(F.log2(x.cast("double")) + 1e-12)).cast("long")


def scientific(x: Column, places: int = 4) -> Column:
    """Text like ``3.9062E-03`` from the exact value of the double; ties to even."""
    exact = F.udf(lambda v: None if v is None else f"{v:.{places}E}", "string")  # no division: a quotient can round to a tie that the value is not
    return exact(x.cast("double"))


def title_text(name: Column, n: Column, m: Column, size: Column, unit: Column, fill: Column) -> Column:
    """Heading of a result plot: counts with thousands separators, size, and the fill in scientific notation."""
    whole = lambda c: F.format_number(c, 0)
    return F.concat(name, F.lit(" - "), whole(n), F.lit(" nodes, "), whole(m), F.lit(" edges, about "), size.cast("string"), F.lit(" "), unit, F.lit(", fill - "), scientific(fill))


def array_size(least: Column, most: Column, vertex_orders: Column, edge_orders: Column) -> Column:
    """Highest index of a job array: graphs by vertex orders by edge orders, counted from 0."""
    return (most - least + 1) * vertex_orders * edge_orders - 1


def main_arguments(config: dict, cluster: bool = False) -> list[str]:
    """Command line of a configuration: values, the orders wanted, switches that are on, the range of graph numbers."""
    out = ["python", "-m", "edgeloom.cluster"] if cluster else ["python", "-m", "edgeloom"]
    for key in ["mode", "data-dir", *(["time", "mem", "cpus-per-task", "constraint"] if cluster else [])]:
        out += [f"--{key}", str(config[key])]
    wanted = config["reorder"]
    out += ["--reorder", *([wanted] if isinstance(wanted, str) else wanted)]
    out += [f"--{key}" for key in ("directed", "overwrite", "debug") if config.get(key)]
    numbers = config["graph-numbers"]
    return [*out, "--graph-numbers", str(numbers["min"]), str(numbers["max"])]
