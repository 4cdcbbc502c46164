"""A covering index of polygons: cells that a boundary comes near to, and cells that it doesn't.

A polygon is its edges, as rows.  Each polygon has a grid of its own, finer the shorter
its edges are.  Cells within the tolerance of an edge are border cells: points there are
tested against the edges of their band of cells (a row of the grid), of which a join
keeps those that a ray from the point may cross or that may be near.  All points of any
other cell lie on one side: its centre is tested once, and the points take its answer by
an equi-join.  So no task holds a polygon whole, and a polygon of very many edges costs
a point no more than a simple one.  All of it is built-in expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut

#: Average edges' lengths that a cell is long at least, so that an edge is in few bands, and bands of a polygon at most.
EDGE_LENGTHS, MOST_BANDS = 2, 4096
#: Around lines whose crossing is looked for, so that rounding loses no cell.
LITTLE = 1e-9


def edges_of(shapes: DataFrame, key: str = "shape", polygons: str = "polygons") -> DataFrame:
    """(key, ax, ay, bx, by) of all edges of all rings; shapes without polygons have none."""
    ring = F.col("r")
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), n).alias("a"), F.slice(ring, F.lit(2), n).alias("b"))
    rings = shapes.where(F.col(polygons).isNotNull()).select(key, F.explode(F.flatten(polygons)).alias("r")).where(F.size("r") > 1)
    e = rings.select(key, F.explode(pairs).alias("e"))
    return e.select(key, *[F.col(f"e.{p}")[i].alias(f"{p}{c}") for p in ("a", "b") for i, c in enumerate("xy")])


def grids(edges: DataFrame, tolerance: float) -> DataFrame:
    """(shape, cell): the size of each polygon's cells, no smaller than the tolerance."""
    span = lambda c: F.max(F.greatest(f"a{c}", f"b{c}")) - F.min(F.least(f"a{c}", f"b{c}"))
    length = F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))
    return edges.groupBy("shape").agg(F.greatest(F.greatest(span("x"), span("y")) / MOST_BANDS, EDGE_LENGTHS * length, F.lit(max(2 * tolerance, LITTLE))).alias("cell"))


def _cells(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / F.col("cell")), F.floor(high / F.col("cell")))


def in_cells(lines: DataFrame, tolerance: float) -> DataFrame:
    """lines (ax, ay, bx, by, cell) once for each cell (i, j) that comes within the tolerance of the line's pieces of a cell's length."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.greatest(F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / F.col("cell")), F.lit(1)).cast("int")
    pieces = lines.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda c, d, k: F.col(f"a{c}") + d * (F.col("_k") + k) / F.col("_n")
    low = lambda c, d: F.least(at(c, d, 0), at(c, d, 1)) - tolerance
    high = lambda c, d: F.greatest(at(c, d, 0), at(c, d, 1)) + tolerance
    wide = pieces.withColumn("_is", _cells(low("x", dx), high("x", dx))).withColumn("_js", _cells(low("y", dy), high("y", dy)))
    return wide.withColumn("i", F.explode("_is")).withColumn("j", F.explode("_js")).drop("_n", "_k", "_is", "_js").distinct()


def contained(points: DataFrame, edges: DataFrame, tolerance: float) -> DataFrame:
    """points (shape, x, y, and others) of shapes that have edges, with inside: by the even-odd rule, or nearer than the tolerance to an edge.

    Points must be distinct.  A point without a shape of edges has no row.
    """
    sizes = cut(grids(edges, tolerance), "grids")
    sized = edges.join(sizes, "shape")
    border = in_cells(sized, tolerance + LITTLE).select("shape", "i", "j").distinct().withColumn("border", F.lit(True))
    placed = points.join(sizes, "shape").withColumns({"i": F.floor(F.col("x") / F.col("cell")), "j": F.floor(F.col("y") / F.col("cell"))})
    placed = placed.join(border, ["shape", "i", "j"], "left")
    # a point of a border cell stands for itself, all points of another cell are its centre
    stands = lambda c, k: F.when(F.col("border"), F.col(c)).otherwise((F.col(k) + 0.5) * F.col("cell"))
    placed = cut(placed.withColumns({"kx": stands("x", "i"), "ky": stands("y", "j")}), "placed")
    banded = sized.withColumn("j", F.explode(_cells(F.least("ay", "by") - tolerance - LITTLE, F.greatest("ay", "by") + tolerance + LITTLE))).drop("cell")
    x, y = F.col("kx"), F.col("ky")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    straddles = (F.col("ay") > y) != (F.col("by") > y)
    crosses = straddles & (x < F.greatest("ax", "bx")) & (x < F.col("ax") + (y - F.col("ay")) * dx / dy)
    within = lambda c, v: v.between(F.least(f"a{c}", f"b{c}") - tolerance, F.greatest(f"a{c}", f"b{c}") + tolerance)
    along = F.least(F.greatest(((x - F.col("ax")) * dx + (y - F.col("ay")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-300)), F.lit(0.0)), F.lit(1.0))
    close = within("x", x) & within("y", y) & (F.hypot(x - F.col("ax") - along * dx, y - F.col("ay") - along * dy) < tolerance)
    met = placed.select("shape", "kx", "ky", "j").distinct().join(banded, ["shape", "j"], "left")
    sides = met.select("shape", "kx", "ky", crosses.alias("crosses"), close.alias("close")).groupBy("shape", "kx", "ky")
    sides = sides.agg(((F.count_if("crosses") % 2 == 1) | F.coalesce(F.bool_or("close"), F.lit(False))).alias("inside"))
    return placed.join(sides, ["shape", "kx", "ky"]).select(*points.columns, "inside")


def crossing(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """lines (shape, id, px, py, qx, qy) that touch or cross an edge of their shape: (shape, id), each once."""
    sizes = cut(grids(edges, 0.0), "grids")
    own = in_cells(edges.join(sizes, "shape"), LITTLE).drop("cell")
    ends = {"ax": "px", "ay": "py", "bx": "qx", "by": "qy"}
    theirs = lines.select("shape", "id", *[F.col(v).alias(k) for k, v in ends.items()]).join(sizes, "shape")
    theirs = in_cells(theirs, LITTLE).select("shape", "id", "i", "j", *[F.col(k).alias(v) for k, v in ends.items()])
    both = theirs.join(own, ["shape", "i", "j"])
    side = lambda o, a, p: (F.col(f"{a}x") - F.col(f"{o}x")) * (F.col(f"{p}y") - F.col(f"{o}y")) - (F.col(f"{a}y") - F.col(f"{o}y")) * (F.col(f"{p}x") - F.col(f"{o}x"))
    # segments on one line meet nowhere else than where their boxes do
    boxes = F.lit(True)
    for c in "xy":
        boxes = boxes & (F.least(f"p{c}", f"q{c}") <= F.greatest(f"a{c}", f"b{c}")) & (F.least(f"a{c}", f"b{c}") <= F.greatest(f"p{c}", f"q{c}"))
    apart = (F.col("px") != F.col("qx")) | (F.col("py") != F.col("qy"))
    return both.where(boxes & apart & (side("p", "q", "a") * side("p", "q", "b") <= 0) & (side("a", "b", "p") * side("a", "b", "q") <= 0)).select("shape", "id").distinct()
