"""Spatial joins over points, surfaces, boxes and triangles.

Distance joins go through grid cells of the search radius: an equi-join on cells, then the exact predicate.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.ranking import numbered
from lamina.sources import scratch


def dist2(a: str, b: str) -> Column:
    """Squared distance of the points with columns ``a``x.. and ``b``x.."""
    return reduce(lambda p, q: p + q, [(F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"])


def _cell(prefix: str, size: float) -> list[Column]:
    return [F.floor(F.col(f"{prefix}{c}") / size).alias(f"c{c}") for c in "xyz"]


def within(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """Pairs of ``points`` (qid, qx, qy, qz) and ``targets`` (tid, tx, ty, tz) at most ``radius`` apart, with ``dist``; none for a radius of 0 or less."""
    # cells are as wide as the ball around a point, which so touches two along an axis; the margin is for rounding
    size, reach = 2 * (radius or 1.0), (radius or 1.0) * (1 + 1e-6)
    p = points
    for c in "xyz":
        p = p.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(f"q{c}") - reach) / size), F.floor((F.col(f"q{c}") + reach) / size))))
    j = p.join(targets.select("*", *_cell("t", size)), ["cx", "cy", "cz"]).withColumn("dist", F.sqrt(dist2("q", "t")))
    return j.where((F.col("dist") <= radius) & F.lit(radius > 0)).drop("cx", "cy", "cz")


def _reach(points: DataFrame, targets: DataFrame) -> float:
    """No point is farther than this from a target; below 0 if a side is empty."""
    box = lambda t, p: t.where(" and ".join(f"not isnan({p}{c})" for c in "xyz")).agg(*[f(f"{p}{c}").alias(f"{c}{k}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max))]).first()
    a, b = box(points, "q"), box(targets, "t")
    if any(x is None for x in (*a, *b)):
        return -1.0
    return math.dist([0.0] * 3, [max(a[f"{c}hi"], b[f"{c}hi"]) - min(a[f"{c}lo"], b[f"{c}lo"]) for c in "xyz"])


def nearest(points: DataFrame, targets: DataFrame, radius: float, rounds: int | None = None) -> DataFrame:
    """For each point the nearest target (ties: smallest tid), by searching cells of doubling radius until all have one; (qid, tid, dist).

    The search ends when no point is left or the radius spans both tables; points with null or NaN coordinates have no row. Each round's rest is written once.
    A caller who wants near targets only may end it after some ``rounds``. Of targets at one place only the smallest tid is searched.
    """
    targets = scratch.cut(targets.groupBy("tx", "ty", "tz").agg(F.min("tid").alias("tid")), "targets")
    reach, found, left = _reach(points, targets), [], points
    while True:
        hit = within(left, targets, radius).groupBy("qid").agg(F.min(F.struct("dist", "tid")).alias("m")).select("qid", F.col("m.tid").alias("tid"), F.col("m.dist").alias("dist"))
        found.append(scratch.cut(hit, "nearest"))
        if radius > reach or len(found) == rounds:
            break
        left = scratch.cut(left.join(found[-1], "qid", "left_anti"), "nearest")
        if left.isEmpty():
            break
        radius *= 2
    return reduce(DataFrame.unionByName, found)


def hausdorff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symmetric Hausdorff distance of two voxel sets (z, y, x): 0 if both are empty, infinite if one is."""
    ids = lambda t, p: t.select(F.concat_ws(",", "z", "y", "x").alias(f"{p}id"), *[F.col(c).cast("double").alias(f"{p}{c}") for c in "xyz"])

    def directed(p, q):
        near = nearest(ids(p, "q"), ids(q, "t"), 2.0)
        return near.agg(F.max("dist").alias("m"), F.count("*").alias("n"))

    empty = [t.isEmpty() for t in (a, b)]
    if any(empty):
        return a.sparkSession.createDataFrame([(0.0 if all(empty) else math.inf,)], "hausdorff double")
    return directed(a, b).unionByName(directed(b, a)).agg(F.max("m").alias("hausdorff"))


def box_pairs(boxes: DataFrame) -> DataFrame:
    """Pairs (a < b) of boxes (id, x0, x1, y0, y1, z0, z1) that share a point, by grids of doubling cells.

    A box lives on the grid whose cells are just no smaller than it, where it touches at most eight cells; it is also sent to the coarser
    grids in use. Two boxes meet on the coarser one's grid, in the first cell that both touch.
    """
    size = F.greatest(*[F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"])
    b = boxes.select("id", *[F.col(f"{c}{n}").cast("double").alias(f"{c}{n}") for c in "xyz" for n in "01"]).withColumn("own", F.ceil(F.log2(F.greatest(size, F.lit(1e-9)))).cast("int"))
    used = F.array_sort(F.collect_set("own"))
    levels = b.agg(used.alias("levels"))
    b = b.join(F.broadcast(levels)).withColumn("level", F.explode(F.filter("levels", lambda v: v >= F.col("own")))).drop("levels")
    cell = F.pow(F.lit(2.0), F.col("level"))
    for c in "xyz":
        lo, hi = F.floor(F.col(f"{c}0") / cell).cast("long"), F.floor(F.col(f"{c}1") / cell).cast("long")
        b = b.withColumn(f"l{c}", lo).withColumn(f"h{c}", hi)
    for c in "xyz":
        b = b.withColumn(f"c{c}", F.explode(F.sequence(f"l{c}", f"h{c}")))
    side = lambda p: b.select("level", "cx", "cy", "cz", *[F.col(k).alias(f"{p}_{k}") for k in ("id", "own", "lx", "ly", "lz", *[f"{c}{n}" for c in "xyz" for n in "01"])])
    j = side("a").join(side("b").hint("merge"), ["level", "cx", "cy", "cz"]).where((F.col("a_id") < F.col("b_id")) & (F.greatest("a_own", "b_own") == F.col("level")))
    for c in "xyz":
        j = j.where((F.greatest(f"a_l{c}", f"b_l{c}") == F.col(f"c{c}")) & (F.col(f"a_{c}1") >= F.col(f"b_{c}0")) & (F.col(f"b_{c}1") >= F.col(f"a_{c}0")))
    return j.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


#: Ids of a block in which members of a place are held together.
BLOCK_IDS = 512


def bbox_overlaps(boxes: DataFrame, grow: float = 1.0) -> DataFrame:
    """Pairs a < b of boxes (id, x0, x1, y0, y1, z0, z1) that overlap when grown, with score = overlap / smaller volume.

    Equal boxes are one place: places meet by ``box_pairs`` and are scored once, then their ids, held in blocks, are paired. So the joins grow with
    the boxes and the pairs of places, and pairs of ids come from equal rows of two blocks each, whatever a place holds.
    """
    ends = [f"{c}{n}" for c in "xyz" for n in (0, 1)]
    grown = boxes.select("id", *[(F.col(e) + (grow if e[1] == "1" else -grow)).alias(e) for e in ends])
    kind, parts = dict(grown.dtypes)["id"], int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = scratch.cut(grown.groupBy(*ends).agg(F.min("id").alias("place"), F.count("*").alias("n")), "places")
    named = grown.join(places, ends).withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK_IDS)))
    blocks = scratch.cut(named.groupBy("place", "block").agg(F.collect_list("id").alias("ids")), "places")

    a, b = (places.select(F.col("place").alias(p), *[F.col(e).alias(f"{p}_{e}") for e in ends]) for p in "ab")
    met = box_pairs(places.withColumnRenamed("place", "id")).unionByName(places.where("x1 >= x0 and y1 >= y0 and z1 >= z0").select(F.col("place").alias("a"), F.col("place").alias("b")))
    side = lambda p, c: F.col(f"{p}_{c}1") - F.col(f"{p}_{c}0")
    size = lambda p: reduce(lambda x, y: x * y, [side(p, c) for c in "xyz"])
    over = reduce(lambda x, y: x * y, [F.least(f"a_{c}1", f"b_{c}1") - F.greatest(f"a_{c}0", f"b_{c}0") for c in "xyz"])
    scored = met.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", (over / F.least(size("a"), size("b"))).alias("score"))

    held = lambda p: blocks.select(F.col("place").alias(p), F.col("block").alias(f"{p}_block"), F.col("ids").alias(f"{p}_ids"))
    two = scored.join(held("a").hint("merge"), "a").join(held("b").hint("merge"), "b").where("a <> b or a_block <= b_block")
    # as many tasks as there are partitions: few rows become many pairs
    two = two.withColumn("same", F.expr("a = b and a_block = b_block")).repartition(parts, "a", "b", "a_block", "b_block")
    p = two.select("score", "same", "b_ids", F.explode("a_ids").alias("p")).select("score", "same", "p", F.explode("b_ids").alias("q")).where("not same or p < q")
    return p.select(F.least("p", "q").cast(kind).alias("a"), F.greatest("p", "q").cast(kind).alias("b"), "score")


def mark_ball(points: DataFrame, radius: int, shape: tuple) -> DataFrame:
    """Voxels (z, y, x) of a volume within ``radius`` of any point (x, y, z), inclusive."""
    r = range(-radius - 1, radius + 2)
    offs = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for i in r for j in r for k in r if (abs(i) - 1) ** 2 + (abs(j) - 1) ** 2 + (abs(k) - 1) ** 2 <= radius * radius or i * i + j * j + k * k <= radius * radius])
    p = points.select("x", "y", "z").distinct().withColumn("o", F.explode(offs))
    p = p.select(*[F.col(c).alias(f"p{c}") for c in "xyz"], *[(F.floor(F.col(c)) + F.col(f"o.{c}")).alias(f"v{c}") for c in "xyz"])
    near = reduce(lambda a, b: a + b, [(F.col(f"p{c}") - F.col(f"v{c}")) * (F.col(f"p{c}") - F.col(f"v{c}")) for c in "xyz"]) <= radius * radius
    inside = reduce(lambda a, b: a & b, [F.col(f"v{c}").between(0, n - 1) for c, n in zip("zyx", shape, strict=True)])
    return p.where(near & inside).select(F.col("vz").alias("z"), F.col("vy").alias("y"), F.col("vx").alias("x")).distinct()


def _vec(p: str, q: str) -> list[Column]:
    return [F.col(f"{p}{c}") - F.col(f"{q}{c}") for c in "xyz"]


#: Triangles that are broadcast (a hundred bytes each), and triangles of a group beyond that.
FEW_TRIANGLES, GROUP_TRIANGLES = 100_000, 10_000


def against_all(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Each point with every triangle, as a sum over a whole mesh needs. A counted small mesh is broadcast; a larger one is dealt into groups and the points are sent to each."""
    count = triangles.count()
    if count <= FEW_TRIANGLES:
        return points.join(F.broadcast(triangles))
    groups = -(-count // GROUP_TRIANGLES)
    key = F.pmod(F.xxhash64(*triangles.columns), F.lit(groups)).cast("int").alias("_group")
    sent = points.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return sent.join(triangles.select("*", key), "_group").drop("_group")


def winding(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Winding number of each point (qid, qx, qy, qz): signed solid angles of all triangles (a.., b.., c..) over 4 pi."""
    j = against_all(points, triangles)
    a, b, c = (_vec(p, "q") for p in "abc")
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    norm = lambda u: F.sqrt(dot(u, u))
    det = a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    la, lb, lc = norm(a), norm(b), norm(c)
    den = la * lb * lc + dot(a, b) * lc + dot(b, c) * la + dot(c, a) * lb
    return j.groupBy("qid").agg((F.sum(2 * F.atan2(det, den)) / (4 * math.pi)).alias("winding"))


def voxelize(rays: DataFrame, triangles: DataFrame) -> DataFrame:
    """Parity test along +x: points (qid, qx, qy, qz) inside the mesh; rays are nudged off edges."""
    j = against_all(rays, triangles)
    y, z = F.col("qy") + 1.234e-5, F.col("qz") + 2.718e-5
    e1, e2 = [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"], [F.col(f"c{c}") - F.col(f"a{c}") for c in "xyz"]
    det = e1[1] * e2[2] - e1[2] * e2[1]
    u = ((y - F.col("ay")) * e2[2] - (z - F.col("az")) * e2[1]) / det
    v = (e1[1] * (z - F.col("az")) - e1[2] * (y - F.col("ay"))) / det
    x = F.col("ax") + u * e1[0] + v * e2[0]
    hit = (F.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (x > F.col("qx"))
    return j.groupBy("qid").agg((F.sum(F.when(F.abs(det) > 1e-12, F.when(hit, 1).otherwise(0)).otherwise(0)) % 2 == 1).alias("inside"))


def asof_interpolate(queries: DataFrame, control: DataFrame) -> DataFrame:
    """Centre (cx, cy) at each z of ``queries`` (qid, z), linear between control points (z, x, y), clamped at the ends.

    Control points become intervals to the next one; intervals and queries meet in buckets of the mean interval's width.
    """
    ends = control.agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.count("z").alias("n")).first()
    lo, hi = (float(ends[k]) if ends["n"] else 0.0 for k in ("lo", "hi"))
    width = (hi - lo) / ends["n"] if hi > lo else 1.0
    c = numbered(control.where("z is not null").select(F.col("z").cast("double").alias("cz"), F.col("x").alias("cx"), F.col("y").alias("cy")), "cz", name="i")
    after = c.select((F.col("i") - 1).alias("i"), *[F.col(f"c{k}").alias(f"n{k}") for k in "zxy"])
    bucket = lambda v: F.floor((v - lo) / width)
    c = c.join(after, "i", "left").withColumn("_b", F.explode(F.sequence(bucket(F.col("cz")), bucket(F.coalesce("nz", "cz")))))
    at = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("z")))
    j = queries.withColumn("_at", at).withColumn("_b", bucket(at)).join(c, "_b").where((F.col("_at") >= F.col("cz")) & (F.col("nz").isNull() | (F.col("_at") < F.col("nz"))))
    t = F.when(F.col("nz").isNull(), 0.0).otherwise((F.col("_at") - F.col("cz")) / (F.col("nz") - F.col("cz")))
    lerp = lambda k: F.col(f"c{k}") + t * (F.coalesce(F.col(f"n{k}"), F.col(f"c{k}")) - F.col(f"c{k}"))
    return j.select("qid", "z", lerp("x").alias("cx"), lerp("y").alias("cy"))
