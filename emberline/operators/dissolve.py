"""Union of polygons as edges: inner borders go, the outline is put together to rings.

Everything is joins of edges. Edges are cut where they meet others of their zone, pieces that lie inside another part or between
two parts go, and what is left is linked head to tail. Rings are numbered by pointer jumping, which doubles the known stretch
of every ring each round, so a coast of a million edges takes some twenty rounds and is in no task whole.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import to_3035
from emberline.operators.lineage import settle

#: Coordinates are brought to this many digits, so that points found on two edges are one point.
DIGITS = 9
EDGES_PER_BAND = 64
PIECE = ["region", "x1", "y1", "x2", "y2"]


def _snap(c: Column) -> Column:
    return F.round(c, DIGITS) + F.lit(0.0)


def _oriented(edges: DataFrame) -> DataFrame:
    """Edges with their part's interior on the left: shells run anticlockwise, holes clockwise."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    sides = edges.groupBy("region", "part").agg((twice < 0).alias("_turned"))
    met = edges.join(sides, ["region", "part"])
    pick = lambda a, b: F.when(F.col("_turned"), F.col(a)).otherwise(F.col(b)).alias(b)
    return met.select("region", "part", pick("x2", "x1"), pick("y2", "y1"), pick("x1", "x2"), pick("y1", "y2"))


def _banded(edges: DataFrame, height: float) -> DataFrame:
    band = lambda y: F.floor(y / height).cast("long")
    return edges.withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))


def _height(edges: DataFrame) -> float:
    n, low, high = edges.agg(F.count(F.lit(1)), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    return max((high - low) * EDGES_PER_BAND / n, 1e-6) if n else 1.0


def _as(df: DataFrame, end: str) -> DataFrame:
    return df.select("region", "band", *[F.col(c).alias(c + end) for c in ("id", "part", "x1", "y1", "x2", "y2")])


def _noded(edges: DataFrame, height: float) -> DataFrame:
    """Edges cut at every point where another edge of the zone crosses, touches or overlaps them."""
    banded = _banded(edges, height)
    met = _as(banded, "a").join(_as(banded, "b"), ["region", "band"]).where(
        "ida <> idb AND least(x1a, x2a) <= greatest(x1b, x2b) AND least(x1b, x2b) <= greatest(x1a, x2a)"
        " AND least(y1a, y2a) <= greatest(y1b, y2b) AND least(y1b, y2b) <= greatest(y1a, y2a)"
    )
    dx, dy = F.col("x2a") - F.col("x1a"), F.col("y2a") - F.col("y1a")
    ex, ey = F.col("x2b") - F.col("x1b"), F.col("y2b") - F.col("y1b")
    cross, length = dx * ey - dy * ex, dx * dx + dy * dy
    # Where b's line meets a, and where b's ends lie on a.
    t = ((F.col("x1b") - F.col("x1a")) * ey - (F.col("y1b") - F.col("y1a")) * ex) / cross
    u = ((F.col("x1b") - F.col("x1a")) * dy - (F.col("y1b") - F.col("y1a")) * dx) / cross
    near = 10.0**-DIGITS

    def end(x: str, y: str) -> Column:
        px, py = F.col(x) - F.col("x1a"), F.col(y) - F.col("y1a")
        on = F.abs(px * dy - py * dx) <= near * F.sqrt(length)
        return F.when(on, (px * dx + py * dy) / length)

    crossing = F.when((F.abs(cross) > 0) & u.between(0.0, 1.0), t)
    ends = [end("x1b", "y1b"), end("x2b", "y2b")]
    places = F.filter(F.array(crossing, *ends), lambda v: v.isNotNull() & (v > 0.0) & (v < 1.0))
    cuts = met.select(F.col("ida").alias("id"), F.explode(places).alias("t")).groupBy("id").agg(F.collect_set("t").alias("cuts"))
    point = lambda t: F.struct(
        _snap(F.col("x1") + (F.col("x2") - F.col("x1")) * t).alias("x"), _snap(F.col("y1") + (F.col("y2") - F.col("y1")) * t).alias("y")
    )
    own = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    inner = F.transform(F.array_sort(F.coalesce("cuts", F.array().cast("array<double>"))), point)
    stops = edges.join(cuts, "id", "left").select("region", "part", F.concat(F.array(own("x1", "y1")), inner, F.array(own("x2", "y2"))).alias("p"))
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pieces = stops.select("region", "part", F.explode(pairs).alias("e")).where("e.a <> e.b")
    return pieces.select("region", "part", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def _outline(pieces: DataFrame, edges: DataFrame, height: float) -> DataFrame:
    """Pieces with the union on their left and none of it on their right, each once."""
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    low = F.when(forward, F.struct("x1", "y1", "x2", "y2")).otherwise(
        F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    )
    lines = pieces.groupBy("region", low.alias("line")).agg(
        F.max(forward).alias("_ahead"), F.max(~forward).alias("_back"), F.collect_set("part").alias("parts")
    )
    # A line with parts on both sides is an inner border.
    sided = settle(lines.where("_ahead <> _back").withColumn("id", F.xxhash64("region", "line")), "outline-pieces")
    x, y = (F.col("line.x1") + F.col("line.x2")) / 2, (F.col("line.y1") + F.col("line.y2")) / 2
    middles = sided.select("region", "id", "parts", x.alias("x"), y.alias("y"), F.floor(y / height).cast("long").alias("band"))
    rays = (
        middles.join(_banded(edges.drop("id"), height).where("y1 <> y2"), ["region", "band"])
        .where("NOT array_contains(parts, part) AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1")
        .groupBy("id", "part")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    inside = rays.where("n % 2 = 1").select("id").distinct()
    kept = sided.join(inside, "id", "left_anti")
    pick = lambda a, b: F.when(F.col("_ahead"), F.col(f"line.{a}")).otherwise(F.col(f"line.{b}")).alias(a)
    return kept.select("region", pick("x1", "x2"), pick("y1", "y2"), pick("x2", "x1"), pick("y2", "y1"))


def union_edges(edges: DataFrame) -> DataFrame:
    """``region, x1, y1, x2, y2``: the outline of each region's parts, the interior on the left.

    Parts may touch, overlap, repeat or have borders cut at other places than their neighbours'.
    """
    plain = edges.select("region", F.col("part").cast("string").alias("part"), *[_snap(F.col(c)).alias(c) for c in PIECE[1:]])
    plain = plain.where("x1 <> x2 OR y1 <> y2").withColumn("id", F.xxhash64("region", "part", *PIECE[1:]))
    plain = settle(plain.dropDuplicates(["id"]), "zone-edges")
    height = _height(plain)
    oriented = settle(_oriented(plain).withColumn("id", F.xxhash64("region", "part", *PIECE[1:])), "oriented-edges")
    pieces = settle(_noded(oriented, height), "noded-edges")
    return _outline(pieces, oriented, height)


def _next(outline: DataFrame) -> DataFrame:
    """``id, next``: of the edges that begin where one ends, the one that turns left most."""
    begins = outline.select("region", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("next"), F.col("x2").alias("x3"), F.col("y2").alias("y3"))
    met = outline.join(begins, ["region", "x2", "y2"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ex, ey = F.col("x3") - F.col("x2"), F.col("y3") - F.col("y2")
    turn = F.atan2(dx * ey - dy * ex, dx * ex + dy * ey)
    return met.groupBy("id").agg(F.max_by("next", turn).alias("next"))


def _jumped(state: DataFrame, column: str, join) -> DataFrame:
    ahead = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col(column).alias("_ahead"))
    return settle(state.join(ahead, "to", "left").select("id", F.col("_to").alias("to"), join(F.col(column), F.col("_ahead")).alias(column)), column)


def ring_order(outline: DataFrame) -> DataFrame:
    """``outline`` with ``ring`` (smallest edge id of its ring) and ``seq`` from 0 along it."""
    numbered = settle(outline.withColumn("id", F.xxhash64(*PIECE)), "outline")
    nexts = settle(_next(numbered), "next-edges")
    n = nexts.count()
    if not n:
        return numbered.select(F.col("id").alias("ring"), F.lit(0).cast("long").alias("seq"), *PIECE)
    rounds = range(max(n - 1, 1).bit_length() + 1)
    state = nexts.select("id", F.col("next").alias("to"), F.least("id", "next").alias("ring"))
    before = None
    for _ in rounds:
        state = _jumped(state, "ring", F.least)
        now = state.agg(F.sum(F.col("ring").cast("decimal(38,0)"))).first()[0]
        if now == before:  # smallest ids only fall: an equal sum means that none did
            break
        before = now
    rings = state.select("id", "ring")
    # Cut each ring before its smallest edge and count the edges up to the cut.
    cut = nexts.join(rings, "id").select("id", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("to"), F.lit(1).cast("long").alias("left"))
    state = settle(cut, "cut-rings")
    for _ in rounds:
        if state.where("to IS NOT NULL").isEmpty():
            break
        state = _jumped(state, "left", lambda a, b: a + F.coalesce(b, F.lit(0)))
    lengths = state.join(rings, "id").groupBy("ring").agg(F.max("left").alias("_n"))
    placed = rings.join(state.select("id", "left"), "id").join(lengths, "ring").select("id", "ring", (F.col("_n") - F.col("left")).alias("seq"))
    return numbered.join(placed, "id").select("ring", "seq", *PIECE)


def dissolve_rings(edges: DataFrame) -> DataFrame:
    """``region, part, ring, seq, x1, y1, x2, y2``: the union of each region's parts as ordered rings.

    Shells run anticlockwise, holes clockwise. Where rings touch in a point, each turns back into itself.
    A region is one part, as its holes belong to it.
    """
    return ring_order(union_edges(edges)).select("region", F.lit(0).alias("part"), "ring", "seq", *PIECE[1:])


def rings(ordered: DataFrame) -> DataFrame:
    """``region, part, ring``: one row a ring with its vertices, as ring tables are stored."""
    vertices = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x1", "y1"))), lambda v: F.struct(v["x1"].alias("x"), v["y1"].alias("y")))
    return ordered.groupBy("region", "part", "ring").agg(vertices.alias("_v")).select("region", "part", F.col("_v").alias("ring"))


def outline_stats(ordered: DataFrame) -> DataFrame:
    """``region, n_rings, n_edges, area_km2, perimeter_km`` in equal-area metres; holes count negative."""
    xa, ya = to_3035(F.col("x1"), F.col("y1"))
    xb, yb = to_3035(F.col("x2"), F.col("y2"))
    xa, xb, ya, yb = xa - 4321000.0, xb - 4321000.0, ya - 3210000.0, yb - 3210000.0
    return ordered.groupBy("region").agg(
        F.count_distinct("ring").alias("n_rings"),
        F.count(F.lit(1)).alias("n_edges"),
        (F.abs(F.sum(xa * yb - xb * ya)) / 2e6).alias("area_km2"),
        (F.sum(F.hypot(xb - xa, yb - ya)) / 1e3).alias("perimeter_km"),
    )
