"""Growing surfaces through a volume, a generation at a time.

A surface is a table of cells (row, col, x, y, z); a generation is a handful of joins: the new or moving cells find their
neighbours by equi-joins on (row, col), search positions along their normals are rows of their own, the volume
is read at all of them by one sampling join, and the best position of a cell is an aggregate. Only the volume's part around the
search positions takes part in the join. Cells of a generation see the generation before and not each other,
so a result depends neither on their order nor on partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators import spatial as P
from lamina.operators import surface as S
from lamina.operators import volume as V
from lamina.sources import scratch

XYZ = ("x", "y", "z")
#: Steps (row, col) in the order in which they claim a new cell, and the neighbour of the new cell that they come from.
STEPS = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}
_FROM = {"up": "down", "down": "up", "left": "right", "right": "left"}


def _point(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in XYZ])


def _xyz(p: Column) -> list[Column]:
    return [p[c] for c in XYZ]


def neighbours(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """``cells`` (row, col, ...) with the points of ``grid`` around them: structs up, down, left, right, null where there is none."""
    at = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(r).alias("r"), F.lit(c).alias("c")) for n, (r, c) in STEPS.items()])
    asked = cells.select("row", "col", F.explode(at).alias("_s")).select("row", "col", "_s.n", (F.col("row") + F.col("_s.r")).alias("_r"), (F.col("col") + F.col("_s.c")).alias("_c"))
    # a task's rows stay the same however large the surface is
    n = scratch.parts(grid, len(STEPS))
    got = asked.repartition(n, "_r", "_c").join(grid.select(F.col("row").alias("_r"), F.col("col").alias("_c"), _point().alias("p")), ["_r", "_c"])
    found = got.repartition(n, "row", "col").groupBy("row", "col").agg(*[F.max(F.when(F.col("n") == n, F.col("p"))).alias(n) for n in STEPS])
    return cells.join(found, ["row", "col"], "left")


def with_normals(cells: DataFrame, grid: DataFrame, sign: int = 1) -> DataFrame:
    """``cells`` (row, col, x, y, z, ...) with unit normals nx, ny, nz: the cross product of the central differences across and down, clamped to cells that exist; (0, 0, 1) where degenerate."""
    n = neighbours(cells, grid)
    side = {k: [F.coalesce(F.col(k)[c], F.col(c)) for c in XYZ] for k in STEPS}
    across, down = ([q - p for p, q in zip(side[a], side[b], strict=True)] for a, b in (("left", "right"), ("up", "down")))
    v = [sign * c for c in S.cross(across, down)]
    size = S.length(v)
    return n.select(*cells.columns, *[F.when(size > 1e-9, c / size).otherwise(F.lit(1.0 if k == "z" else 0.0)).alias(f"n{k}") for k, c in zip(XYZ, v, strict=True)])


#: Rows of a table that is sent whole to a join.
FEW_ROWS = 50_000


def _met(rows: DataFrame, written: DataFrame, key: list[str], n: int, how: str) -> DataFrame:
    """``rows`` joined with a ``written`` table: sent whole if it is counted and small, else both are dealt into ``n`` partitions."""
    if written.count() <= FEW_ROWS:
        return rows.join(F.broadcast(written), key, how)
    return rows.repartition(n, *key).join(written.hint("merge"), key, how)


def sampled(points: DataFrame, volume: DataFrame, name: str = "value", key: tuple = ("row", "col", "i")) -> DataFrame:
    """``points`` with the volume's value at their x, y, z; their ``key`` must differ.

    Points are written once. The volume is cut to the box of the points, and only the keys of points with a corner in what is left meet it; all others read 0.
    """
    points = scratch.cut(points, "points")
    box = points.agg(*[f(c).alias(f"{c}{k}") for c in XYZ for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if box["xlo"] is None:
        return points.withColumn(name, F.lit(None).cast("double"))
    near = volume
    for c in XYZ:
        near = near.where(F.col(c).between(int(box[f"{c}lo"]) - 2, int(box[f"{c}hi"]) + 2))
    near = scratch.cut(near.select(*[F.col(c).alias(f"t{c}") for c in XYZ], "v"), "near")
    ends = near.agg(*[f(f"t{c}").alias(f"{c}{k}") for c in XYZ for k, f in (("lo", F.min), ("hi", F.max))]).first()
    taps = V.taps(points.select(*key, *[F.col(c).alias(f"p{c}") for c in XYZ]))
    for c in XYZ:
        taps = taps.where(F.col(f"t{c}").between(F.lit(ends[f"{c}lo"]), F.lit(ends[f"{c}hi"])))
    met = _met(taps, near, [f"t{c}" for c in XYZ], scratch.parts(points, 8), "inner")
    value = scratch.cut(met.groupBy(*key).agg(F.sum(F.col("w") * F.col("v")).alias("_read")), "read")
    none = sum((0.0 * F.col(c) for c in XYZ), F.lit(0.0))
    return _met(points, value, list(key), scratch.parts(points), "left").select(*points.columns, F.coalesce("_read", none).alias(name))


def _along(cells: DataFrame, offsets: list[float], at: str = "") -> DataFrame:
    """A row per cell and offset (columns i, t) with x, y, z moved along the normal."""
    out = cells.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("t")) for i, t in offsets])))
    moved = {c: F.col(at + c) + F.col(f"n{c}") * F.col("_o.t") for c in XYZ}
    return out.select(*[c for c in cells.columns if c not in XYZ or at], "_o.i", "_o.t", *[v.alias(c) for c, v in moved.items()])


# --- rings


def ring(surface: DataFrame) -> DataFrame:
    """The cells around a full grid, each one step on from the two cells before it; corners go on from the new rows."""
    ends = surface.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    if ends["r0"] is None:
        return surface
    r0, r1, c0, c1 = ends

    def beyond(rows: DataFrame, edge: int, inner: int, axis: str) -> DataFrame:
        other = "col" if axis == "row" else "row"
        at = F.when(F.col(axis) == edge, 2).otherwise(-1)
        two = rows.where(F.col(axis).isin(edge, inner)) if edge != inner else rows.where(F.col(axis) == edge)
        sums = [F.sum(F.col(c) * (at if edge != inner else F.lit(1))).alias(c) for c in XYZ]
        step = 1 if edge >= inner and edge == {"row": r1, "col": c1}[axis] else -1
        return two.groupBy(other).agg(*sums).withColumn(axis, F.lit(edge + step).cast("long")).select("row", "col", *XYZ)

    s = surface.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *XYZ)
    rows = [beyond(s, r0, min(r0 + 1, r1), "row"), beyond(s, r1, max(r1 - 1, r0), "row")]
    if r0 == r1:
        rows[0] = rows[0].withColumn("row", F.lit(r0 - 1).cast("long"))
    every = reduce(DataFrame.unionByName, [s, *rows])
    cols = [beyond(every, c0, min(c0 + 1, c1), "col"), beyond(every, c1, max(c1 - 1, c0), "col")]
    if c0 == c1:
        cols[0] = cols[0].withColumn("col", F.lit(c0 - 1).cast("long"))
    return reduce(DataFrame.unionByName, [*rows, *cols])


def snapped(cells: DataFrame, volume: DataFrame, search: float) -> DataFrame:
    """``cells`` (row, col, x, y, z, normals) moved along their normals to where the volume changes most: four samples a voxel over a range of ``search``, the first of equal changes."""
    steps = int(search * 4)
    offsets = [(0, 0.0)] + [(i, i / 4 - search / 2) for i in range(1, steps + 1)]
    v = sampled(_along(cells, offsets), volume)
    from pyspark.sql import Window

    change = F.round(F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("row", "col").orderBy("i"))), 9)
    best = v.withColumn("change", change).where("i > 0").groupBy("row", "col").agg(F.max_by(F.struct(*XYZ), F.struct("change", -F.col("i"))).alias("p"))
    return best.select("row", "col", *[F.col("p")[c].alias(c) for c in XYZ])


def grow_rings(surface: DataFrame, volume: DataFrame, generations: int, search: float = 5.0) -> DataFrame:
    """A full grid with ``generations`` rings around it: each extrapolated, then snapped along the normals of the enlarged surface."""
    now = scratch.cut(surface.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *XYZ), "grown")
    for _ in range(generations):
        new = scratch.cut(ring(now), "ring")
        moved = snapped(with_normals(new, now.unionByName(new)), volume, search)
        now = scratch.cut(now.unionByName(moved), "grown")
    return now


# --- moving the edge, or all, of a surface


def edge(surface: DataFrame, direction: str = "all") -> DataFrame:
    """Cells on the given side of a full grid, or on any."""
    e = surface.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    on = {"up": F.col("row") == e[0], "down": F.col("row") == e[1], "left": F.col("col") == e[2], "right": F.col("col") == e[3]}
    return surface.where(reduce(Column.__or__, on.values()) if direction == "all" else on[direction])


def _replaced(surface: DataFrame, moved: DataFrame) -> DataFrame:
    new = moved.select("row", "col", *[F.col(c).alias(f"_{c}") for c in XYZ])
    return surface.join(new, ["row", "col"], "left").select("row", "col", *[F.coalesce(f"_{c}", c).alias(c) for c in XYZ])


def brightest(cells: DataFrame, volume: DataFrame, step: float = 1.0, steps: int = 32, radius: float = 8.0) -> DataFrame:
    """``cells`` with normals moved to the brightest of ``steps`` positions along them, the first of equal ones."""
    v = sampled(_along(cells, [(i, i * step / steps * radius) for i in range(1, steps + 1)]), volume)
    best = v.groupBy("row", "col").agg(F.max_by(F.struct(*XYZ), F.struct(F.round("value", 9), -F.col("i"))).alias("p"))
    return best.select("row", "col", *[F.col("p")[c].alias(c) for c in XYZ])


def trace_edge(surface: DataFrame, volume: DataFrame, direction: str = "all", step: float = 1.0) -> DataFrame:
    """The edge moved along its normals to the brightest voxels."""
    return _replaced(surface, brightest(with_normals(edge(surface, direction), surface, -1), volume, step))


def extrapolate_edge(surface: DataFrame, direction: str = "all", step: float = 1.0) -> DataFrame:
    """The edge moved on by ``step`` in the direction from the cell before it; along the normal where there is none ("all", or equal points)."""
    cells = neighbours(with_normals(edge(surface, direction), surface, -1), surface)
    along = [F.lit(0.0)] * 3 if direction == "all" else [F.col(c) - F.coalesce(F.col(_FROM[direction])[c], F.col(c)) for c in XYZ]
    size = S.length(along)
    return _replaced(surface, cells.select("row", "col", *[(F.col(c) + step * F.when(size > 1e-6, v / size).otherwise(F.col(f"n{c}"))).alias(c) for c, v in zip(XYZ, along, strict=True)]))


def _nearest(cells: DataFrame, targets: DataFrame, radius: float, rounds: int | None = None) -> DataFrame:
    """``cells`` with the nearest of ``targets`` (tid, tx, ty, tz) as ``target`` and its distance ``far``."""
    key = F.concat_ws(",", "row", "col")
    hit = P.nearest(cells.select(key.alias("qid"), *[F.col(c).alias(f"q{c}") for c in XYZ]), targets, radius, rounds)
    near = hit.join(targets, "tid").select(F.split("qid", ",").alias("k"), F.struct(*[F.col(f"t{c}").alias(c) for c in XYZ]).alias("target"), F.col("dist").alias("far"))
    return cells.join(near.select(F.col("k")[0].cast("long").alias("row"), F.col("k")[1].cast("long").alias("col"), "target", "far"), ["row", "col"], "left")


def correct_edge(surface: DataFrame, volume: DataFrame, targets: DataFrame, direction: str = "all", step: float = 1.0, weight: float = 1.0) -> DataFrame:
    """The traced edge, drawn by ``weight`` towards where ``step`` on the way to the nearest correction point leads."""
    cells = with_normals(edge(surface, direction), surface, -1)
    traced = brightest(cells, volume, step).select("row", "col", _point().alias("traced"))
    c = _nearest(cells, targets, max(step, 1.0)).join(traced, ["row", "col"])
    move = F.least(F.lit(step), F.col("far")) / F.col("far")
    drawn = {k: F.col(k) + F.when(F.col("far") > 1e-6, (F.col("target")[k] - F.col(k)) * move).otherwise(0.0) for k in XYZ}
    w = min(weight, 1.0)
    return _replaced(surface, c.select("row", "col", *[(F.col("traced")[k] + w * (F.coalesce(drawn[k], F.col("traced")[k]) - F.col("traced")[k])).alias(k) for k in XYZ]))


def jitter(*parts: Column) -> Column:
    """A number in [-1, 1) that depends on ``parts`` alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 20)) / float(1 << 19) - 1.0


def _clear(points: DataFrame, exclusions: DataFrame | None, distance: float, key: list[str]) -> DataFrame:
    """``points`` that are not closer than ``distance`` to a vertex (x, y, z) of ``exclusions``."""
    if exclusions is None:
        return points
    near = P.within(points.select(*key, *[F.col(c).alias(f"q{c}") for c in XYZ]), exclusions.select(*[F.col(c).alias(f"t{c}") for c in XYZ]), distance)
    return points.join(near.where(F.col("dist") < distance).select(*key).distinct(), key, "left_anti")


def advance(surface: DataFrame, volume: DataFrame, generation: int = 0, steps: int = 16, radius: float = 8.0, straight_2d: float = 0.7, straight_3d: float = 4.0, distance: float = 1.0, z_weight: float = 0.1, noise: float = 0.0, targets: DataFrame | None = None, exclusions: DataFrame | None = None) -> DataFrame:
    """Every cell moved to the best of ``steps`` + 1 positions along its normal: value less 50 times the geometric cost, the first of equal ones, none below -1.

    The cost grows with the turn against the direction from the cell above (in the plane and in space), the distance gone and the drift in z. Cells
    closer than ``radius`` to a correction point are then drawn to it by the distance weight.
    """
    surface = scratch.cut(surface, "surface")
    cells = neighbours(with_normals(surface, surface), surface)
    d = [F.col(c) - F.col("up")[c] for c in XYZ]
    size = S.length(d)
    has = F.col("up").isNotNull()
    dir3 = [F.when(has & (size > 1e-6), v / size).otherwise(F.lit(1.0 if c == "z" else 0.0)) for c, v in zip(XYZ, d, strict=True)]
    dir2 = [F.when(has, v / (size + 1e-9)).otherwise(F.lit(1.0 if c == "x" else 0.0)) for c, v in zip(("x", "y"), d, strict=False)]
    shaken = [F.col(c) + (noise * jitter(F.lit(generation), F.col("row"), F.col("col"), F.lit(c)) if noise else 0.0) for c in XYZ]
    held = cells.select("row", "col", "nx", "ny", "nz", *[F.col(c).alias(f"o{c}") for c in XYZ], *[v.alias(f"p{k}") for k, v in zip("abc", dir3, strict=True)], *[v.alias(f"e{k}") for k, v in zip("ab", dir2, strict=True)], *[v.alias(f"s{c}") for c, v in zip(XYZ, shaken, strict=True)])
    tries = _clear(_along(held, [(i, i / steps * radius) for i in range(steps + 1)], "s").drop("sx", "sy", "sz", "t", "nx", "ny", "nz"), exclusions, 1.0, ["row", "col", "i"])
    v = sampled(tries, volume)
    go = [F.col(c) - F.col(f"o{c}") for c in XYZ]
    far, flat = S.length(go), F.sqrt(go[0] * go[0] + go[1] * go[1])
    cost = straight_3d * F.when(far > 1e-6, 1 - sum((g * F.col(f"p{k}") for g, k in zip(go, "abc", strict=True)), F.lit(0.0)) / far).otherwise(0.0)
    cost += straight_2d * F.when(flat > 1e-6, 1 - (go[0] * F.col("ea") + go[1] * F.col("eb")) / flat).otherwise(0.0)
    cost += distance * far + z_weight * F.abs(go[2])
    v = v.withColumn("score", F.round(F.col("value") - 50.0 * cost, 9))
    best = v.where("score > -1").groupBy("row", "col").agg(F.max_by(F.struct(*XYZ), F.struct("score", -F.col("i"))).alias("p"))
    moved = surface.join(best, ["row", "col"], "left").select("row", "col", *[F.coalesce(F.col("p")[c], F.col(c)).alias(c) for c in XYZ])
    if targets is None:
        return moved
    w = min(distance, 1.0)
    near = _nearest(surface, targets, radius, 1).select("row", "col", "target", "far")
    pulled = moved.join(near, ["row", "col"], "left")
    return pulled.select("row", "col", *[F.when(F.col("far") < radius, F.col(c) + w * (F.col("target")[c] - F.col(c))).otherwise(F.col(c)).alias(c) for c in XYZ])


# --- growing by candidates


def grow_patch(
    seed: DataFrame,
    volume: DataFrame,
    shape: tuple,
    generations: int,
    direction: str = "all",
    steps: int = 16,
    radius: float = 5.0,
    straight_2d: float = 0.7,
    straight_3d: float = 4.0,
    distance: float = 1.0,
    z_weight: float = 0.1,
    noise: float = 0.05,
    exclusions: DataFrame | None = None,
    edt: DataFrame | None = None,
    guide: DataFrame | None = None,
) -> DataFrame:
    """Cells (row, col, x, y, z, generation) of ``seed``, of any outline, and of the cells that ``generations`` of growth add around it.

    An empty cell beside the front starts from its neighbour in the order of ``STEPS`` and tries ``steps`` positions up to ``radius`` along that neighbour's
    normal, each shaken by ``noise``, and one plain step. Positions near ``exclusions`` (1.5) or outside ``shape`` (z, y, x) are out; the least cost wins:
    distance from the mean of the cell's neighbours, turning back, deviation from the plain step's length, drift in z from the neighbours, the
    value of ``edt``, less half that of ``guide`` and a hundredth of the volume's. A cell without a position takes its neighbours' mean.
    ``direction`` "row" or "col" adds rows or columns only.
    """
    ways = {n: s for n, s in STEPS.items() if direction == "all" or s[0 if direction == "row" else 1]}
    step = radius / max(steps, 1)
    state = scratch.cut(seed.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *XYZ, F.lit(0).alias("generation")), "patch")
    for g in range(1, generations + 1):
        around = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(r).alias("r"), F.lit(c).alias("c")) for k, (n, (r, c)) in enumerate(ways.items())])
        front = with_normals(state.where(F.col("generation") == g - 1), state).select("row", "col", F.struct(*XYZ, *[f"n{c}" for c in XYZ]).alias("src"), F.explode(around).alias("s"))
        claims = front.select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), "s.k", "src").join(state.select("row", "col"), ["row", "col"], "left_anti")
        cells = neighbours(claims.groupBy("row", "col").agg(F.min_by("src", "k").alias("src")), state)
        count = sum((F.col(n).isNotNull().cast("int") for n in STEPS), F.lit(0))
        mean = F.struct(*[(sum((F.coalesce(F.col(n)[c], F.lit(0.0)) for n in STEPS), F.lit(0.0)) / count).alias(c) for c in XYZ])
        cells = scratch.cut(cells.select("row", "col", "src", mean.alias("mean")), "front")
        if cells.isEmpty():
            break
        # the plain step comes last and is neither shaken nor read
        tries = cells.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps + 1))))
        plain = F.col("i") > steps
        t = F.when(plain, F.lit(step)).otherwise(F.col("i") * step)
        at = [F.col("src")[c] + F.col("src")[f"n{c}"] * t + F.when(plain, 0.0).otherwise(noise * jitter(F.lit(g), F.col("row"), F.col("col"), F.col("i"), F.lit(c)) if noise else F.lit(0.0)) for c in XYZ]
        tries = tries.select("row", "col", "i", "src", "mean", *[v.alias(c) for c, v in zip(XYZ, at, strict=True)])
        inside = reduce(Column.__and__, [(F.col(c) >= 0) & (F.col(c) < n) for c, n in zip(XYZ, shape[::-1], strict=True)])
        tries = scratch.cut(_clear(tries.where(inside | plain), exclusions, 1.5, ["row", "col", "i"]), "tries")
        for name, field in (("value", volume), ("edt", edt), ("guide", guide)):
            tries = tries.withColumn(name, F.lit(0.0)) if field is None else sampled(tries, field, name)
        go = [F.col(c) - F.col("src")[c] for c in XYZ]
        far = S.length(go)
        back = -S.dot(go, [F.col("src")[f"n{c}"] for c in XYZ]) / far
        dz = F.col("z") - F.col("mean")["z"]
        cost = straight_2d * S.length([F.col(c) - F.col("mean")[c] for c in XYZ]) + distance * (far - step) * (far - step) + z_weight * dz * dz
        cost += straight_3d * F.when(far > 1e-9, F.greatest(F.lit(0.0), back)).otherwise(0.0) + F.coalesce("edt", F.lit(0.0)) - 0.5 * F.coalesce("guide", F.lit(0.0))
        cost -= F.when(F.col("i") > steps, 0.0).otherwise(0.01 * F.coalesce("value", F.lit(0.0)))
        best = tries.groupBy("row", "col").agg(F.min_by(_point(), F.struct(F.round(cost, 9), "i")).alias("p"))
        new = cells.join(best, ["row", "col"], "left").select("row", "col", *[F.coalesce(F.col("p")[c], F.col("mean")[c]).alias(c) for c in XYZ], F.lit(g).alias("generation"))
        state = scratch.cut(state.unionByName(new), "patch")
    return state
