"""Density clusters with no noise, i.e. connected components of "within eps of each other".

No point pairs are formed. Points fall into cells of a grid on the unit sphere whose diagonal is eps, so
all points of a cell belong together and the graph to solve has one node per occupied cell: its size is
bounded by the Earth's surface, not by the number of detections. Two cells are linked if some pair of
their points lies within eps; that is decided from bounding boxes and one sample point per cell, and only
undecided pairs are cut into sub-cells (a quarter of the side each time) until every pair is settled.
"""

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import chord, haversine_km, unit_xyz
from emberline.operators.lineage import settle
from emberline.operators.ranking import global_rank
from emberline.operators.skew import BROADCAST_ROWS, few, lookup, shuffled

BITS = 21
ORIGIN = 1 << (BITS - 1)
MAX_LEVEL = 10
SLACK = 1e-9


def cell_side(eps_km: float) -> float:
    return chord(eps_km) / math.sqrt(3) * (1 - SLACK)


def _pack(parts: list[Column], bits: int) -> Column:
    a, b, c = parts
    return F.shiftleft(a, 2 * bits).bitwiseOR(F.shiftleft(b, bits)).bitwiseOR(c)


def sphere_cell(lat: Column, lon: Column, eps_km: float) -> Column:
    """Key of the cell that holds a point."""
    side = cell_side(eps_km)
    if 1 / side >= ORIGIN:
        raise ValueError("eps_km is too small for the cell key")
    parts = [F.floor(v / side).cast("long") + ORIGIN for v in unit_xyz(lat, lon)]
    return _pack(parts, BITS)


def with_cell(points: DataFrame, eps_km: float) -> DataFrame:
    return points.withColumn("cell", sphere_cell(F.col("lat"), F.col("lon"), eps_km))


def _sub_cell(eps_km: float, level: int) -> Column:
    """Key, inside its cell, of the sub-cell of a point; the point itself beyond the deepest level."""
    if level == 0:
        return F.lit(0).cast("long")
    if level > MAX_LEVEL:
        return F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string"))
    side, n = cell_side(eps_km), 4**level
    parts = []
    for v in unit_xyz(F.col("lat"), F.col("lon")):
        parts.append(F.floor(v / (side / n)).cast("long") - F.floor(v / side).cast("long") * n)
    return _pack(parts, 2 * level)


def _extent(points: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box and one sample point per group; combined before the shuffle."""
    xyz = unit_xyz(F.col("lat"), F.col("lon"))
    df = points.withColumns({"x": xyz[0], "y": xyz[1], "z": xyz[2]})
    box = [f(c).alias(f"{c}{s}") for c in "xyz" for f, s in ((F.min, "0"), (F.max, "1"))]
    return df.groupBy(*keys).agg(F.min("lat").alias("lat"), F.min_by("lon", "lat").alias("lon"), *box)


_EXTENT = ("lat", "lon", "x0", "x1", "y0", "y1", "z0", "z1")


def _side_of(extent: DataFrame, side: str, keys: list[str]) -> DataFrame:
    return extent.select(
        *[F.col(k).alias(f"{side}_{k}") for k in keys], *[F.col(c).alias(f"{side}_{c}") for c in _EXTENT]
    )


def _judge(pairs: DataFrame, eps_km: float) -> DataFrame:
    """Keep pairs that may be within eps; ``linked`` if they are for sure, ``open`` if that is not known."""
    reach = chord(eps_km)
    least, most = F.lit(0.0), F.lit(0.0)
    for c in "xyz":
        a0, a1, b0, b1 = (F.col(f"{s}_{c}{i}") for s in "ab" for i in "01")
        gap = F.greatest(F.lit(0.0), a0 - b1, b0 - a1)
        span = F.greatest(a1 - b0, b1 - a0)
        least, most = least + gap * gap, most + span * span
    single = [
        (F.col(f"{s}_x0") == F.col(f"{s}_x1"))
        & (F.col(f"{s}_y0") == F.col(f"{s}_y1"))
        & (F.col(f"{s}_z0") == F.col(f"{s}_z1"))
        for s in "ab"
    ]
    near = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= eps_km
    linked = near | (F.sqrt(most) <= reach * (1 - SLACK))
    return (
        pairs.where(F.sqrt(least) <= reach * (1 + SLACK))
        .withColumn("linked", linked)
        .withColumn("open", ~F.col("linked") & ~(single[0] & single[1]))
        .where(F.col("linked") | F.col("open"))
    )


def _candidates(cells: DataFrame, eps_km: float) -> DataFrame:
    """Cell pairs close enough to hold a pair within eps, each once, judged by extent.

    Keys first: a cell looks up at most 62 neighbour keys, and only existing pairs carry extents.
    """
    side = cell_side(eps_km)
    steps = [
        (i << 2 * BITS) + (j << BITS) + k
        for i, j, k in itertools.product(range(-2, 3), repeat=3)
        if (i, j, k) > (0, 0, 0)
    ]
    step = F.explode(F.expr(f"array({', '.join(f'{s}L' for s in steps)})"))
    wanted = cells.select("cell", step.alias("step")).select(
        F.col("cell").alias("a_cell"), (F.col("cell") + F.col("step")).alias("b_cell")
    )
    low, high = F.lit(0.0), F.lit(0.0)
    for shift in (2 * BITS, BITS, 0):
        i = F.shiftright(F.col("b_cell"), shift).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")) - ORIGIN
        near, far = F.least(F.abs(i), F.abs(i + 1)), F.greatest(F.abs(i), F.abs(i + 1))
        low, high = low + near * near, high + far * far
    touches_sphere = (low * side * side <= 1 + 1e-6) & (high * side * side >= 1 - 1e-6)
    pairs = shuffled(wanted.where(touches_sphere)).join(_side_of(cells, "b", ["cell"]), "b_cell")
    pairs = pairs.join(shuffled(_side_of(cells, "a", ["cell"])), "a_cell")
    return _judge(pairs, eps_km).select("a_cell", "b_cell", "linked", "open")


def _refine(points: DataFrame, undecided: DataFrame, eps_km: float) -> list[DataFrame]:
    """Linked pairs among ``undecided`` (a_cell, b_cell), by cutting cells into sub-cells level by level.

    A cell has a bounded number of sub-cells, so the rows per pair are bounded however many points a cell
    holds. Each level reads the points once and combines them before the shuffle.
    """
    found = []
    zero = F.lit(0).cast("long")
    rest = undecided.select("a_cell", "b_cell", zero.alias("a_sub"), zero.alias("b_sub"))
    level = 0
    while (n := rest.count()) > 0:
        level += 1
        involved = rest.select(F.col("a_cell").alias("cell")).union(rest.select("b_cell")).distinct()
        source = points.join(F.broadcast(involved), "cell", "left_semi") if few(involved, 2 * n) else points
        parts = _extent(
            source.withColumn("sub", _sub_cell(eps_km, level - 1)).withColumn("part", _sub_cell(eps_km, level)),
            ["cell", "sub", "part"],
        )
        pairs = rest.join(shuffled(_side_of(parts, "a", ["cell", "sub", "part"])), ["a_cell", "a_sub"]).join(
            shuffled(_side_of(parts, "b", ["cell", "sub", "part"])), ["b_cell", "b_sub"]
        )
        judged = settle(
            _judge(pairs, eps_km).select(
                "a_cell", "b_cell", F.col("a_part").alias("a_sub"), F.col("b_part").alias("b_sub"), "linked"
            ),
            "judged",
        )
        linked = judged.where("linked").select("a_cell", "b_cell").distinct()
        found.append(linked)
        # Written out: the next level reads it four times, and would work it out as often.
        rest = judged.where("NOT linked").drop("linked").join(shuffled(linked), ["a_cell", "b_cell"], "left_anti")
        rest = settle(rest, "undecided")
    return found


def linked_cells(points: DataFrame, eps_km: float) -> DataFrame:
    """All pairs ``a_cell < b_cell`` of cells that hold two points within eps. ``points`` has ``cell``."""
    cells = settle(_extent(points, ["cell"]), "cells")
    judged = settle(_candidates(cells, eps_km), "cell-pairs")
    links = judged.where("linked").select("a_cell", "b_cell")
    return _union([links, *_refine(points, judged.where("open"), eps_km)])


def _draw(c: Column, seed: int) -> Column:
    """A random order of the nodes, new for every round. Equal draws do no harm: any neighbour is valid."""
    return F.xxhash64(c, F.lit(seed))


def contract(edges: DataFrame) -> tuple[DataFrame, int]:
    """Connected components of ``edges`` (a, b): ``node, root`` for every node that has an edge, and their number.

    Each round every node joins its smallest neighbour in a fresh random order, and the graph between the
    joined nodes replaces it: it shrinks by a constant factor, chains and hubs alike. The renaming of the
    last round is then carried back through the earlier ones.
    """
    # Written out: the first round reads the graph many times, and all that leads to it would be planned and run each time.
    both = settle(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), "graph")
    graph = both.union(both.select("v", "u"))
    steps = []
    while True:
        seed = len(steps)
        best = graph.groupBy("u").agg(
            F.min_by("v", _draw(F.col("v"), seed)).alias("v"), F.count(F.lit(1)).alias("_rows")
        )
        mine = _draw(F.col("u"), seed) < _draw(F.col("v"), seed)
        step = settle(best.select("u", F.when(mine, F.col("u")).otherwise(F.col("v")).alias("to"), "_rows"), "step")
        n_nodes, n_edges = step.agg(F.count(F.lit(1)), F.sum("_rows")).first()
        if not n_nodes:
            break
        steps.append((step, n_nodes))
        moved = graph
        for end in "uv":
            names = step.select(F.col("u").alias(end), F.col("to").alias(f"to_{end}"))
            degrees = step.select(F.col("u").alias(end), "_rows"), n_nodes, n_edges
            moved = lookup(moved, names, [end], "inner", right_rows=n_nodes, counts=degrees)
        graph = settle(
            moved.where("to_u <> to_v").select(F.col("to_u").alias("u"), F.col("to_v").alias("v")).distinct(), "graph"
        )
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0), 0
    root, n_root = steps[-1][0].select(F.col("u").alias("node"), F.col("to").alias("root")), steps[-1][1]
    for step, n_nodes in reversed(steps[:-1]):
        later = root.withColumnRenamed("node", "to")
        root = lookup(step.select(F.col("u").alias("node"), "to"), later, ["to"], right_rows=n_root).select(
            "node", F.coalesce("root", "to").alias("root")
        )
        n_root = n_nodes
    # Written out: a look-up reads it twice, and each time with the joins of all rounds.
    return settle(root, "roots"), n_root


def _rooted(df: DataFrame, key: str, roots: tuple[DataFrame, int], out: str) -> DataFrame:
    """Add the root of ``key``, which is the key itself for nodes without edges."""
    named = roots[0].select(F.col("node").alias(key), F.col("root").alias("_root"))
    return lookup(df, named, [key], right_rows=roots[1]).withColumn(out, F.coalesce("_root", key)).drop("_root")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def components(points: DataFrame, eps_km: float, open_limit: int = BROADCAST_ROWS) -> DataFrame:
    """``cell, component`` of every occupied cell. ``points`` has ``cell, lat, lon`` and should be settled.

    With more than ``open_limit`` open pairs the sure links are contracted first: open pairs whose cells
    already belong together, in dense areas nearly all of them, then need no decision. What is left is
    refined and contracted on top.
    """
    cells = settle(_extent(points, ["cell"]), "cells")
    judged = settle(_candidates(cells, eps_km), "cell-pairs")
    sure = judged.where("linked").select("a_cell", "b_cell")
    unsure = judged.where("open").select("a_cell", "b_cell")
    ends = [F.col("a_cell").alias("a"), F.col("b_cell").alias("b")]
    if unsure.count() <= open_limit:
        links = _union([sure, *_refine(points, unsure, eps_km)])
        return _rooted(cells.select("cell"), "cell", contract(links.select(*ends)), "component")

    early = contract(sure.select(*ends))
    unsure = _rooted(_rooted(unsure, "a_cell", early, "a"), "b_cell", early, "b").where("a <> b")
    unsure = settle(unsure, "unsure")
    labels = _rooted(cells.select("cell"), "cell", early, "_early")
    found = _refine(points, unsure.select("a_cell", "b_cell"), eps_km)
    if not found:
        return labels.withColumnRenamed("_early", "component")
    late = contract(shuffled(unsure).join(_union(found), ["a_cell", "b_cell"], "left_semi").select("a", "b"))
    return _rooted(labels, "_early", late, "component").drop("_early")


def label(first: DataFrame) -> DataFrame:
    """Number the components 0, 1, 2, ... by their first point. ``first`` has ``component, first_ord``."""
    return global_rank(first, "first_ord", "label")
