"""Triangulated elevation: a quadtree of blocks by point counts, each triangulated on its own, and rounds for what a block can't know.

A block has its cells and the points in and around it, MOST_POINTS at the most and FEW for each of its cells, so a tile is never one
task, and the work follows the cells, however dense the points are: a cell with more takes the nearest ones. A cell's height is right if no point of the tile lies in the circle through its triangle's corners. Where
that circle stays where the block knows all points, nothing more is needed. Other circles (and the sides of lines, for cells
beyond a block's points) are searched for points of the tile; blocks for which some are found get these few and
are triangulated again for the cells in question, until no circle holds a point. So all heights are those of
one triangulation of the whole tile.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import discard, settled, shared_dir
from .tiles import BROADCAST_TILES, with_tiles

#: Points that a block starts with at the most; cells along the side of the largest block, a power of two.
MOST_POINTS, LARGEST = 2048, 64
#: Points that a block starts with for each of its cells at the most; a few times those that a triangle and its circle need.
FEW = 64
#: Cells along the side of a bin in which circles are searched; points that a circle adds to a block in one round.
BIN, ADDED = 32, 8
_ROUNDS = 60
_LEAF = ["tile", "side", "br", "bc"]


def delaunay(xy: np.ndarray) -> np.ndarray:
    """Triangles (indices) of a Delaunay triangulation, by adding points from left to right. A triangle whose circle lies left of
    the sweep can't change any more and is set aside, so that a step looks at the open circles only, about as many as the root of the points."""
    n = len(xy)
    if n < 3:
        return np.zeros((0, 3), np.int64)
    mid, span = (xy.min(0) + xy.max(0)) / 2, max(float(np.ptp(xy, axis=0).max()), 1e-9)
    p = np.vstack([(xy - mid) / span, [[-3e3, -2e3], [3e3, -2e3], [0.0, 4e3]]])
    places = p.tolist()
    # open triangles and their circles (x, y, squared radius) fill the first slots of tri and circle
    tri, circle, used = np.zeros((256, 3), np.int64), np.zeros((3, 256)), 1
    tri[0], circle[:, 0] = (n, n + 1, n + 2), _circle(*places[n:])
    closed = []
    for step, i in enumerate(np.argsort(p[:n, 0], kind="stable").tolist()):
        x, y = places[i]
        cx, cy, r2 = circle[:, :used]
        if step % 16 == 0:
            behind = cx + np.sqrt(r2) * (1 + 1e-9) + 1e-12 < x
            closed.append(tri[:used][behind])
            rest = np.flatnonzero(~behind)
            used = len(rest)
            tri[:used], circle[:, :used] = tri[rest], circle[:, rest]
            cx, cy, r2 = circle[:, :used]
        inside = np.flatnonzero((cx - x) ** 2 + (cy - y) ** 2 < r2 * (1 + 1e-12))
        rim: dict[tuple[int, int], tuple[int, int] | None] = {}  # an edge of two triangles inside isn't on the rim
        for a, b, c in tri[inside].tolist():
            for edge in ((a, b), (b, c), (c, a)):
                key = edge if edge[0] < edge[1] else edge[::-1]
                rim[key] = None if key in rim else edge
        new = []
        for edge in rim.values():
            if edge:
                (ax, ay), (bx, by) = places[edge[0]], places[edge[1]]
                if abs((ax - x) * (by - y) - (ay - y) * (bx - x)) > 1e-18:
                    new.append((*edge, i))
        # new ones take the slots of those inside, then further ones; a slot left over counts as behind the sweep
        slots = [*inside.tolist(), *range(used, used + len(new) - len(inside))]
        used += max(len(new) - len(inside), 0)
        tri[slots[len(new) :]], circle[:, slots[len(new) :]] = n, [[-np.inf], [0], [0]]
        slots = slots[: len(new)]
        if used > len(tri):
            tri, circle = np.vstack([tri, np.zeros_like(tri)]), np.hstack([circle, np.zeros_like(circle)])
        if new:
            tri[slots] = new
            circle[:, slots] = np.array([_circle(*(places[k] for k in t)) for t in new]).T
    tri = np.vstack([*closed, tri[:used]])
    return tri[(tri < n).all(1)]


def _circle(a: list[float], b: list[float], c: list[float]) -> tuple[float, float, float]:
    """Centre and squared radius of one triangle; not a number for points on a line, so that nothing lies inside."""
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = 2 * (bx * cy - by * cx)
    if d == 0:
        return (float("nan"),) * 3
    bb, cc = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * bb - by * cc) / d, (bx * cc - cx * bb) / d
    return a[0] + ux, a[1] + uy, ux * ux + uy * uy


def _circles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii."""
    a, b, c = (p[tri[:, k]] for k in range(3))
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    bb, cc = (b * b).sum(1), (c * c).sum(1)
    u = np.column_stack([c[:, 1] * bb - b[:, 1] * cc, b[:, 0] * cc - c[:, 0] * bb]) / d[:, None]
    return a + u, (u * u).sum(1)


def _hull(xy: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """The edges of only one triangle, with the triangle on their left."""
    a, b, c = (xy[tri[:, k]] for k in range(3))
    tri = np.where((_cross(b - a, c - a) < 0)[:, None], tri[:, ::-1], tri)
    edges = np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]])
    _, at, count = np.unique(np.sort(edges, axis=1), axis=0, return_index=True, return_counts=True)
    return edges[at[count == 1]]


def _cells_of(t: np.ndarray, xy: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, triangle, u, v): in which triangles the centres x, y of a regular raster lie; u and v are how far along two edges."""
    xs, ys = np.unique(x), np.unique(y)
    near, far = xy[t].min(1) - 1e-9, xy[t].max(1) + 1e-9
    left, right = np.searchsorted(xs, near[:, 0]), np.searchsorted(xs, far[:, 0], "right")
    low, high = np.searchsorted(ys, near[:, 1]), np.searchsorted(ys, far[:, 1], "right")
    wide, count = right - left, np.maximum(right - left, 0) * np.maximum(high - low, 0)
    k = np.repeat(np.arange(len(t)), count)
    j = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
    place = np.full((len(ys), len(xs)), -1)
    place[np.searchsorted(ys, y), np.searchsorted(xs, x)] = np.arange(len(x))
    cell = place[low[k] + j // np.maximum(wide[k], 1), left[k] + j % np.maximum(wide[k], 1)]
    k, cell = k[cell >= 0], cell[cell >= 0]
    a, ab, ac = xy[t[k, 0]], xy[t[k, 1]] - xy[t[k, 0]], xy[t[k, 2]] - xy[t[k, 0]]
    at, area = np.column_stack([x[cell], y[cell]]) - a, _cross(ab, ac)
    u, v = _cross(at, ac) / area, _cross(ab, at) / area
    hit = (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9)
    return cell[hit], k[hit], u[hit], v[hit]


def _block(cells: pd.DataFrame, points: pd.DataFrame, max_edge: float) -> pd.DataFrame:
    """row, col, z of cells, with what has to be free of points for that to hold, if the block doesn't know: kind 0 a circle (a, b: centre, c: squared
    radius), 1 the side of a line (a x + b y > c), 2 what isn't on a line, 3 any point but those at (a, b) if c; kind -1: nothing."""
    n = len(cells)
    x, y, xy, z = cells["x"].to_numpy(), cells["y"].to_numpy(), points[["x", "y"]].to_numpy(), points["z"].to_numpy()
    out = {"z": np.full(n, np.nan), "kind": np.full(n, -1), "a": np.zeros(n), "b": np.zeros(n), "c": np.zeros(n)}

    def ask(rows, kind: int, a, b, c) -> None:
        out["kind"][rows], out["a"][rows], out["b"][rows], out["c"][rows] = kind, a, b, c

    known = cells[["known_x0", "known_y0", "known_x1", "known_y1"]].iloc[0].to_numpy()
    t = delaunay(xy)
    if not len(t):
        span = xy - xy[0] if n and len(xy) else np.zeros((0, 2))
        far = int((span**2).sum(1).argmax()) if len(span) else 0
        if len(span) and (span[far] ** 2).sum() > 0:
            normal = np.array([-span[far][1], span[far][0]]) / np.hypot(*span[far])
            ask(slice(None), 2, normal[0], normal[1], float(normal @ xy[0]))
        else:
            ask(slice(None), 3, xy[0][0] if len(xy) else x.mean(), xy[0][1] if len(xy) else y.mean(), float(len(xy) > 0))
    else:
        longest = np.sqrt(((xy[t] - np.roll(xy[t], 1, axis=1)) ** 2).sum(2)).max(1)
        centre, r2 = _circles(xy, t)
        r = np.sqrt(r2)[:, None]
        sure = ((centre - r >= known[:2]) & (centre + r <= known[2:])).all(1)
        cell, k, u, v = _cells_of(t, xy, x, y)
        # of several triangles that a centre on an edge lies in, one that is sure
        order = np.lexsort((k, sure[k]))
        cell, k, u, v = cell[order], k[order], u[order], v[order]
        height = z[t[k, 0]] + u * (z[t[k, 1]] - z[t[k, 0]]) + v * (z[t[k, 2]] - z[t[k, 0]])
        short = longest[k] <= max_edge if max_edge > 0 else np.ones(len(k), bool)
        out["z"][cell] = np.where(short, height, np.nan)
        # a triangle without long edges would have its corners within that distance of the cell, and so be among the block's
        inner = np.minimum(np.minimum(x - known[0], known[2] - x), np.minimum(y - known[1], known[3] - y))
        long = ~short & (inner[cell] >= max_edge) if max_edge > 0 else np.zeros(len(k), bool)
        out["kind"][cell] = -1
        unsure = ~sure[k] & ~long
        last = np.full(n, -1)
        last[cell] = np.arange(len(k))
        i = last[last >= 0]
        i = i[unsure[i]]
        ask(cell[i], 0, centre[k[i], 0], centre[k[i], 1], r2[k[i]])
        rest = np.flatnonzero(last < 0)
        if max_edge > 0:
            rest = rest[inner[rest] < max_edge]
        if len(rest):
            edge = _hull(xy, t)
            p, q = xy[edge[:, 0]], xy[edge[:, 1]]
            normal = np.column_stack([q[:, 1] - p[:, 1], p[:, 0] - q[:, 0]])
            normal /= np.sqrt((normal**2).sum(1))[:, None]
            offset = (normal * p).sum(1)
            beyond = np.column_stack([x[rest], y[rest]]) @ normal.T - offset
            best = beyond.argmax(1)
            ask(rest, 1, normal[best, 0], normal[best, 1], offset[best])
    done = pd.DataFrame({"row": cells["row"], "col": cells["col"], **{c: np.asarray(w) for c, w in out.items()}})
    return done.astype({"row": "int32", "col": "int32", "kind": "int32"})


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def _windows(c: Column, size: int) -> Column:
    """The numbers of the blocks of that size along an axis that take part in a place: its own, and those within a quarter of their size."""
    halo = max(size // 4, 1)
    return F.sequence(F.floor((c - halo) / size).cast("int"), F.floor((c + halo) / size).cast("int"))


def _leaves(places: DataFrame, grids: DataFrame, most: int) -> DataFrame:
    """(tile, side, br, bc, n): blocks of side x side cells that cover each tile once; n points lie in or near one. Those with over most points, or over FEW for each cell, are cut in four, down to one cell."""
    size, out = LARGEST, []
    blocks = grids.select("tile", F.explode(F.expr(f"sequence(0, cast(floor((height - 1) / {size}) as int))")).alias("br"), F.expr(f"cast(floor((width - 1) / {size}) as int)").alias("_last"))
    blocks = blocks.select("tile", "br", F.explode(F.expr("sequence(0, _last)")).alias("bc"))
    while True:
        counts = places.select("tile", F.explode(_windows(F.col("row"), size)).alias("br"), "col", "n").select("tile", "br", F.explode(_windows(F.col("col"), size)).alias("bc"), "n")
        counts = counts.groupBy("tile", "br", "bc").agg(F.sum("n").alias("n"))
        blocks = settled(blocks.join(counts, ["tile", "br", "bc"], "left").select("tile", F.lit(size).alias("side"), "br", "bc", F.coalesce("n", F.lit(0)).alias("n")))
        enough = min(most, FEW * size * size)
        out.append(blocks if size == 1 else blocks.where(F.col("n") <= enough))
        full = blocks.where(F.col("n") > enough)
        if size == 1 or full.isEmpty():
            break
        size //= 2
        half = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c)
        blocks = full.select("tile", half("br"), "bc").select("tile", "br", half("bc"))
    leaves = out[0]
    for more in out[1:]:
        leaves = leaves.unionByName(more)
    return leaves


def _known(leaves: DataFrame, specs: DataFrame, resolution: float) -> DataFrame:
    """leaves with the bounds within which a block knows all points; without a bound where the tile has no points beyond."""
    halo = F.greatest(F.floor(F.col("side") / 4), F.lit(1))
    edge = lambda c, last: F.col(c) * F.col("side") + (F.col("side") + halo - 0.5 if last else -halo - 0.5)
    c = with_tiles(leaves, specs, computed=True)
    far = F.lit(1e300)
    x0, x1 = F.col("_west") + edge("bc", False) * resolution, F.col("_west") + edge("bc", True) * resolution
    y0, y1 = F.col("_north") - edge("br", True) * resolution, F.col("_north") - edge("br", False) * resolution
    bounds = [("known_x0", x0, x0 <= F.col("_least_x"), -far), ("known_y0", y0, y0 <= F.col("_least_y"), -far), ("known_x1", x1, x1 >= F.col("_most_x"), far), ("known_y1", y1, y1 >= F.col("_most_y"), far)]
    return c.select("*", *[F.when(F.coalesce(open_end, F.lit(True)), end).otherwise(v).alias(n) for n, v, open_end, end in bounds])


def _triangulate(cells: DataFrame, points: DataFrame, max_edge: float, most: int) -> DataFrame:
    """_block for each block: cells (_LEAF, row, col, x, y, n and bounds) and its points (_LEAF, x, y, z, extra)."""
    types = dict(cells.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in _LEAF) + ", row int, col int, z double, kind int, a double, b double, c double"

    def block(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in [*_LEAF, "row", "col", "z", "kind", "a", "b", "c"]})
        if own["side"].iloc[0] == 1 and own["n"].iloc[0] > min(most, FEW):  # one cell, and of its points only the nearest: all within their distance are known
            first = near[~near["extra"]]
            half = np.sqrt(((first["x"] - own["x"].iloc[0]) ** 2 + (first["y"] - own["y"].iloc[0]) ** 2).max() / 2)
            for c, v in (("known_x0", own["x"] - half), ("known_x1", own["x"] + half), ("known_y0", own["y"] - half), ("known_y1", own["y"] + half)):
                own[c] = v
        near = near.drop_duplicates(["x", "y"]).sort_values(["x", "y"])
        done = _block(own.sort_values(["row", "col"]).reset_index(drop=True), near, max_edge)
        for i, c in enumerate(_LEAF):
            done.insert(i, c, key[i])
        return done

    return cells.groupBy(*_LEAF).cogroup(points.groupBy(*_LEAF)).applyInPandas(block, schema)


def _nearest(dealt: DataFrame, most: int, resolution: float) -> DataFrame:
    """The most points that are nearest to the only cell of each block. Points beyond the ring in which the last of these lies are left
    out by counts of rings, so dense points are counted and not sorted."""
    dx, dy = F.col("x") - (F.col("_west") + F.col("bc") * resolution), F.col("y") - (F.col("_north") - F.col("br") * resolution)
    d = dealt.withColumn("_d", dx * dx + dy * dy)
    d = d.withColumn("_ring", F.floor(4 * F.log2(F.greatest(F.col("_d") / (resolution * resolution), F.lit(1e-12)))).cast("int"))
    rings = d.groupBy(*_LEAF, "_ring").agg(F.count("*").alias("_n"))
    upto = rings.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*_LEAF).orderBy("_ring")))
    # the ring in which the last one lies is the first one with so many up to it
    ends = upto.groupBy(*_LEAF).agg(F.coalesce(F.min(F.when(F.col("_upto") >= most, F.col("_ring"))), F.max("_ring")).alias("_end"))
    d = d.join(ends, _LEAF).where("_ring <= _end")
    return d.withColumn("_k", F.row_number().over(Window.partitionBy(*_LEAF).orderBy("_d", "x", "y"))).where(F.col("_k") <= most)


def _witnesses(asked: DataFrame, points: DataFrame, places: DataFrame, bins: DataFrame, specs: DataFrame, resolution: float) -> DataFrame:
    """(_LEAF, kind, a, b, c, x, y, z): of each circle or side that is asked for the points in it, few of them and the nearest to its middle.

    A circle looks at the bins that it meets, then at the cells of these, the bounds of whose points are known. Where all points of some
    lie in it, the nearest few and one of those are enough to find points, else all that it meets are looked at: those that its rim crosses."""
    asked = asked.withColumnsRenamed({"a": "qa", "b": "qb", "c": "qc"})
    asks = ["kind", "qa", "qb", "qc"]
    q = with_tiles(asked.select(*_LEAF, *asks).distinct(), specs, computed=True)
    r = F.sqrt(F.col("qc")) / resolution
    middle_r, middle_c = (F.col("_north") - F.col("qb")) / resolution, (F.col("qa") - F.col("_west")) / resolution
    low, high = (F.floor(F.col(f"_{n}_{c}") / BIN) for n, c in (("least", "row"), ("most", "row")))
    left, right = (F.floor(F.col(f"_{n}_{c}") / BIN) for n, c in (("least", "col"), ("most", "col")))
    round_ = F.col("kind") == 0
    span = lambda m, lo, hi: F.sequence(
        F.when(round_, F.greatest(lo, F.least(F.floor((m - r) / BIN) - 1, hi))).otherwise(lo).cast("int"), F.when(round_, F.least(hi, F.greatest(F.floor((m + r) / BIN) + 1, lo))).otherwise(hi).cast("int")
    )
    q = q.select(*_LEAF, *asks, F.explode(span(middle_r, low, high)).alias("bin_r"), span(middle_c, left, right).alias("_c")).select(*_LEAF, *asks, "bin_r", F.explode("_c").alias("bin_c"))
    a, b, c, x, y = (F.col(n) for n in ("qa", "qb", "qc", "x", "y"))
    slack, within = 1e-9 * F.greatest(F.abs(c), F.lit(1.0)), c * (1 - 1e-11)

    def looked_at(hit: DataFrame) -> DataFrame:
        """Those of the boxes joined to what is asked that have to be looked at."""
        clamp = lambda v, lo, hi: F.least(F.greatest(v, F.col(lo)), F.col(hi))
        square = lambda u, v: (u - a) * (u - a) + (v - b) * (v - b)
        near = square(clamp(a, "_x0", "_x1"), clamp(b, "_y0", "_y1"))
        corners = [(F.col(f"_x{i}"), F.col(f"_y{j}")) for i in (0, 1) for j in (0, 1)]
        far, over = F.greatest(*[square(*p) for p in corners]), [a * u + b * v - c for u, v in corners]
        most, least, beside = F.greatest(*over), F.least(*over), F.greatest(*[F.abs(o) for o in over])
        kinds = {"_meets": (near < within, most > slack, beside > slack, F.lit(True)), "_whole": (far < within, least > slack, (least > slack) | (most < -slack), (c <= 0) | (near > 1e-18)), "_score": (near, -most, -beside, near)}
        hit = hit.select("*", *[F.when(round_, v[0]).when(F.col("kind") == 1, v[1]).when(F.col("kind") == 2, v[2]).otherwise(v[3]).alias(n) for n, v in kinds.items()]).where("_meets")
        of = Window.partitionBy(*_LEAF, *asks)
        hit = hit.withColumn("_k", F.row_number().over(of.orderBy("_score"))).withColumn("_first", F.row_number().over(of.orderBy(F.desc("_whole"), "_score"))).withColumn("_any", F.max("_whole").over(of))
        return hit.where(~F.col("_any") | (F.col("_k") <= ADDED) | (F.col("_first") == 1))

    hit = looked_at(q.join(bins, ["tile", "bin_r", "bin_c"])).select(*_LEAF, *asks, "bin_r", "bin_c")
    hit = settled(looked_at(hit.join(places, ["tile", "bin_r", "bin_c"])).select(*_LEAF, *asks, "row", "col"))
    if hit.limit(BROADCAST_TILES + 1).count() <= BROADCAST_TILES:
        hit = F.broadcast(hit)  # so that points aren't shuffled for a few cells
    square, over = (x - a) * (x - a) + (y - b) * (y - b), a * x + b * y - c
    inside = F.when(round_, square < within).when(F.col("kind") == 1, over > slack).when(F.col("kind") == 2, F.abs(over) > slack).otherwise((c <= 0) | (square > 1e-18))
    found = points.join(hit, ["tile", "row", "col"]).where(inside)
    score = F.when(F.col("kind") == 1, -(a * x + b * y)).when(F.col("kind") == 2, -F.abs(over)).otherwise(square)
    # the best of each cell, then of those the best few: a circle's points never meet in one task
    best = found.groupBy(*_LEAF, *asks, "row", "col").agg(F.min(F.struct(score.alias("s"), x.alias("x"), y.alias("y"), F.col("z").alias("z"))).alias("w"))
    few = best.groupBy(*_LEAF, *asks).agg(F.slice(F.array_sort(F.collect_list("w")), 1, ADDED).alias("w"))
    few = few.select(*_LEAF, *asks, F.explode("w").alias("w")).select(*_LEAF, *asks, "w.x", "w.y", "w.z")
    return few.withColumnsRenamed({"qa": "a", "qb": "b", "qc": "c"})


def tin(points: DataFrame, grids: DataFrame, max_edge: float = 20.0, resolution: float = 1.0, most_points: int = MOST_POINTS) -> DataFrame:
    """(tile, row, col, z) at cell centres within triangles whose edges are at most max_edge (0: any) of the Delaunay triangulation of
    a tile's points. Points at one place count once, with their mean z. Fewer than 3 points, or points on one line, make no triangle.
    Where four points lie on one circle either diagonal may be taken."""
    spark = points.sparkSession
    path = f"{shared_dir(spark)}/tin-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}", compression="zstd")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    specs = settled(grids.select("tile", "width", "height", F.col("center_min_x").alias("_west"), F.col("center_max_y").alias("_north")))
    p = with_tiles(points.groupBy("tile", "x", "y").agg(F.avg("z").alias("z")), specs, computed=True)
    row = F.floor((F.col("_north") + resolution / 2 - F.col("y")) / resolution).cast("int")
    col = F.floor((F.col("x") - F.col("_west") + resolution / 2) / resolution).cast("int")
    p = stored(p.select("tile", row.alias("row"), col.alias("col"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "z"), "points")
    bounds = lambda low, high: [f(v).alias(f"_{c}{i}") for c in "xy" for i, f, v in ((0, F.min, low(c)), (1, F.max, high(c)))]
    places = p.groupBy("tile", "row", "col").agg(F.count("*").alias("n"), *bounds(F.col, F.col))
    places = settled(places.select("*", *[F.floor(F.col(c) / BIN).cast("int").alias(n) for c, n in (("row", "bin_r"), ("col", "bin_c"))]))
    bins = settled(places.groupBy("tile", "bin_r", "bin_c").agg(*bounds(lambda c: F.col(f"_{c}0"), lambda c: F.col(f"_{c}1"))))
    ends = places.groupBy("tile").agg(*[f(f"_{c}{i}").alias(f"_{n}_{c}") for c in "xy" for n, i, f in (("least", 0, F.min), ("most", 1, F.max))], *[f(c).alias(f"_{n}_{c}") for c in ("row", "col") for n, f in (("least", F.min), ("most", F.max))])
    specs = settled(specs.join(ends, "tile", "left"))
    leaves = settled(_known(_leaves(places, specs, most_points), specs, resolution))
    # which blocks the points of a cell go to, found for cells and not for points
    sides = [r.side for r in leaves.select("side").distinct().collect()]
    near = [places.select("tile", "row", "col", F.lit(s).alias("side"), F.explode(_windows(F.col("row"), s)).alias("br")).withColumn("bc", F.explode(_windows(F.col("col"), s))) for s in sides]
    to = reduce(DataFrame.unionByName, near, places.select("tile", "row", "col", F.lit(0).alias("side"), F.lit(0).alias("br"), F.lit(0).alias("bc")).limit(0))
    dealt = p.join(to.join(leaves.select(*_LEAF, "n", "_west", "_north"), _LEAF), ["tile", "row", "col"]).withColumn("extra", F.lit(False))
    few, full = min(most_points, FEW), (F.col("side") == 1) & (F.col("n") > min(most_points, FEW))
    whole = dealt.where(~full).select(*_LEAF, "x", "y", "z", "extra")
    capped = _nearest(dealt.where(full), few, resolution).select(*_LEAF, "x", "y", "z", "extra")
    dealt = stored(whole.unionByName(capped), "dealt")
    rows = F.expr("sequence(br * side, least((br + 1) * side, height) - 1)")
    cols = F.expr("sequence(bc * side, least((bc + 1) * side, width) - 1)")
    cells = leaves.where("br * side < height and bc * side < width").withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))
    cells = cells.withColumn("x", F.col("_west") + F.col("col") * resolution).withColumn("y", F.col("_north") - F.col("row") * resolution)
    cells = cells.select(*_LEAF, "row", "col", "x", "y", "n", "known_x0", "known_y0", "known_x1", "known_y1")
    # few bytes, much work: with a number of its own, this shuffle isn't coalesced to a few tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    pending, extras, done = cells, dealt.limit(0), []
    for i in range(_ROUNDS):
        own = dealt if not i else dealt.join(pending.select(*_LEAF).distinct(), _LEAF, "left_semi")
        known = own.unionByName(extras.select(*_LEAF, "x", "y", "z", F.lit(True).alias("extra")))
        tried = stored(_triangulate(pending.repartition(tasks, *_LEAF), known.repartition(tasks, *_LEAF), max_edge, most_points), f"tried-{i}")
        asked = tried.where("kind >= 0")
        found = _witnesses(asked, p, places, bins, specs, resolution)
        new = stored(found.join(extras.select(*_LEAF, "x", "y"), [*_LEAF, "x", "y"], "left_anti"), f"new-{i}")
        ask = [*_LEAF, "kind", "a", "b", "c"]
        open_ = asked.join(new.select(*ask).distinct(), ask, "left_semi").select(*_LEAF, "row", "col")
        done.append(tried.join(open_, [*_LEAF, "row", "col"], "left_anti").where("kind <= 0").select("tile", "row", "col", "z"))
        if new.isEmpty():
            break
        # all of a block's points that were found so far serve its cells that are left
        extras = stored(extras.select(*_LEAF, "x", "y", "z").unionByName(new.select(*_LEAF, "x", "y", "z")).distinct(), f"extras-{i}")
        pending = stored(cells.join(open_, [*_LEAF, "row", "col"], "left_semi"), f"pending-{i}")
    else:
        raise RuntimeError("circles did not become empty")
    out = settled(reduce(DataFrame.unionByName, done).where("z is not null and not isnan(z)"))
    discard(spark, path)
    return out
