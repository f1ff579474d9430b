"""Connected regions of changed pixels, of any size, and their polygons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landwatch.functions import geometry as G
from landwatch.functions import kernels as K
from landwatch.functions import projection as P
from landwatch.functions.change import change_type
from landwatch.operators.raster import Grid
from landwatch.schema import geometry_type
from landwatch.session import cut_lineage

c = F.col
STRIDE = 2**31  # pixel id = row * STRIDE + col, which sorts like the raster


def local_labels(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Index of the first pixel (in row-major order) of each pixel's edge-connected set."""
    n = len(row)
    r, k = row.astype(np.int64), col.astype(np.int64)
    key = r * STRIDE + k
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    links = []
    for step in (1, STRIDE):
        at = np.searchsorted(sorted_key, sorted_key + step)
        hit = np.flatnonzero((at < n) & (sorted_key[np.minimum(at, n - 1)] == sorted_key + step))
        links.append((hit, at[hit]))
    u, v = (np.concatenate([a[i] for a in links]) for i in (0, 1))
    root = np.arange(n)
    while True:
        ru, rv = root[u], root[v]
        if np.array_equal(ru, rv):
            break
        low = np.minimum(ru, rv)
        np.minimum.at(root, ru, low)
        np.minimum.at(root, rv, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    out = np.empty(n, dtype=np.int64)
    out[order] = order[root]
    return out


def _components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest node of the component of every node of an undirected graph: keys, node, component.

    Every round points each node at its smallest neighbour, follows the pointers twice and keeps only
    edges between different targets, until no edge is left. No group is collected; the minima are
    aggregates with map-side combine and skewed join keys meet one row per key.
    """
    edges = cut_lineage(edges.select(*keys, "a", "b").where("a <> b").distinct())
    labels = edges.select(*keys, c("a").alias("node")).union(edges.select(*keys, c("b").alias("node"))).distinct()
    labels = labels.withColumn("component", c("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select(*keys, c("b").alias("a"), c("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).select(
            *keys, c("a").alias("node"), F.least("a", "m").alias("to"))
        for _ in range(2):
            low = (low.alias("x").join(low.select(*keys, c("node").alias("to"), c("to").alias("to2")), [*keys, "to"], "left")
                   .select(*keys, "node", F.coalesce("to2", "to").alias("to")))
        low = cut_lineage(low)
        move = lambda df, k: df.join(low.withColumnsRenamed({"node": k, "to": f"_{k}"}), [*keys, k], "left").withColumn(
            k, F.coalesce(f"_{k}", k)).drop(f"_{k}")
        labels = cut_lineage(move(labels, "component"))
        moved = move(move(edges, "a"), "b").where("a <> b")
        edges = cut_lineage(moved.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


def label_regions(mask: DataFrame, keys: list[str], tile: int = 256, width: int = STRIDE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Add component_id to changed pixels: the smallest row * width + col of their 4-connected region.

    ``carry`` names value columns to keep, so that region statistics need no join. Tiles are labelled on their own (a task holds at most one tile), then only pixels on tile
    borders are matched across, and the graph of touching tile labels is solved.
    """
    key_fields = [mask.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("row_idx", T.IntegerType()), T.StructField("col_idx", T.IntegerType()),
                           T.StructField("local", T.LongType()), *[mask.schema[k] for k in carry]])

    def label(table: pa.Table) -> pa.Table:
        # A pixel given twice counts once.
        at = table["row_idx"].to_numpy().astype(np.int64) * STRIDE + table["col_idx"].to_numpy()
        table = table.take(pa.array(np.unique(at, return_index=True)[1]))
        row, col = (table[k].to_numpy() for k in ("row_idx", "col_idx"))
        ids = row.astype(np.int64) * width + col
        out = table.select([*keys, "row_idx", "col_idx"]).append_column("local", pa.array(ids[local_labels(row, col)]))
        for k in carry:
            out = out.append_column(k, table[k])
        return out

    pixels = mask.select(*keys, c("row_idx").cast("int"), c("col_idx").cast("int"), *carry)
    tiled = pixels.withColumns({"tile_row": F.floor(c("row_idx") / tile), "tile_col": F.floor(c("col_idx") / tile)})
    local = cut_lineage(tiled.groupBy(*keys, "tile_row", "tile_col").applyInArrow(label, schema))

    def touching(axis: str, other: str) -> DataFrame:
        last = local.where(c(axis) % tile == tile - 1).select(*keys, other, (c(axis) + 1).alias(axis), c("local").alias("a"))
        first = local.where(c(axis) % tile == 0).select(*keys, other, axis, c("local").alias("b"))
        return last.join(first, [*keys, other, axis]).select(*keys, "a", "b")

    links = touching("col_idx", "row_idx").union(touching("row_idx", "col_idx"))
    found = _components(links, keys).withColumnRenamed("node", "local")
    return (local.join(found, [*keys, "local"], "left")
            .select(*keys, "row_idx", "col_idx", F.coalesce("component", "local").alias("component_id"), *carry))


#: Sides of a pixel, clockwise from the top: neighbour, from corner, to corner; the pixel is on the right hand.
SIDES = ((-1, 0, (0, 0), (0, 1)), (0, 1, (0, 1), (1, 1)), (1, 0, (1, 1), (1, 0)), (0, -1, (1, 0), (0, 0)))


def _settled(jump: np.ndarray) -> np.ndarray:
    """Where following pointers ends; on a cycle, some place of it."""
    for _ in range(max(1, int(len(jump)).bit_length())):
        jump = jump[jump]
    return jump


def tile_chains(row: np.ndarray, col: np.ndarray, tile: int) -> dict[str, np.ndarray]:
    """Outline of one tile's pixels as chains of sides, joined at all corners inside the tile.

    Returns the sides in the order of their chains: ``chain`` (number), ``start`` and ``end`` corner, ``own`` pixel's index, ``way`` (of SIDES),
    and ``kind`` of its chain: 0 a closed ring, 1 open at the tile's border, 2 a side on the border line, which the next tile may take away.
    """
    row, col = row.astype(np.int64), col.astype(np.int64)
    key = np.sort(row * STRIDE + col)
    starts, ends, owns, ways, lines = [], [], [], [], []
    for way, (dr, dc, (ar, ac), (br, bc)) in enumerate(SIDES):
        want = (row + dr) * STRIDE + col + dc
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        own = np.flatnonzero(key[at] != want)
        starts.append((row[own] + ar) * STRIDE + col[own] + ac)
        ends.append((row[own] + br) * STRIDE + col[own] + bc)
        owns.append(own)
        ways.append(np.full(len(own), way))
        lines.append(((row[own] + dr) // tile != row[own] // tile) | ((col[own] + dc) // tile != col[own] // tile))
    start, end, own, way, line = (np.concatenate(v) for v in (starts, ends, owns, ways, lines))
    order = np.lexsort((own, start))
    start, end, own, way, line = (v[order] for v in (start, end, own, way, line))
    n = len(start)
    here = np.arange(n)
    inner = (end // STRIDE % tile != 0) & (end % STRIDE % tile != 0)
    lo = np.minimum(np.searchsorted(start, end, "left"), n - 1)
    two = np.searchsorted(start, end, "right") - lo == 2
    nxt = np.where(two & (own[lo] != own), np.minimum(lo + 1, n - 1), lo)  # at a shared corner the side of the same pixel
    nxt = np.where(inner, nxt, here)
    closed = nxt[_settled(nxt)] != _settled(nxt)
    head, jump = here.copy(), nxt.copy()
    while True:  # the least side of what follows
        low = np.minimum(head, head[jump])
        jump = jump[jump]
        if np.array_equal(low, head):
            break
        head = low
    nxt = np.where(closed & (nxt == head), here, nxt)  # a ring is cut before its least side
    left, jump = (nxt != here).astype(np.int64), nxt.copy()
    while True:
        further = left + left[jump]
        if np.array_equal(further, left):
            break
        left, jump = further, jump[jump]
    last = _settled(nxt)
    walk = np.lexsort((-left, last))
    chain = np.cumsum(np.concatenate([[0], np.diff(last[walk]) != 0])) if n else walk
    return {"chain": chain, "start": start[walk], "end": end[walk], "own": own[walk], "way": way[walk],
            "kind": np.where(closed[walk], 0, np.where(line[walk], 2, 1))}


def straightened(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A closed ring's corners without those on a straight run, from its topmost, leftmost one and back to it."""
    bent = ((x != np.roll(x, 1)) | (x != np.roll(x, -1))) & ((y != np.roll(y, 1)) | (y != np.roll(y, -1)))
    xy = np.stack([x[bent], y[bent]], 1).astype(float)
    xy = np.roll(xy, -int(np.lexsort((xy[:, 0], xy[:, 1]))[0]), axis=0)
    return np.concatenate([xy, xy[:1]])


def _rings(chains: DataFrame, keys: list[str]) -> DataFrame:
    """Ring and place of every open chain by pointer jumping: keys, component_id, cid, ring (least cid of the ring), ahead (chains until that one).

    A round doubles how far each chain looks. When no chain has met a lesser one in a round, all of a ring know its least. Every round is
    one equi-join of rows of a few numbers, written; nothing is collected.
    """
    same = [*keys, "component_id"]
    follow = chains.select(*same, c("start").alias("end"), c("cid").alias("_next"), c("own_start").alias("_own"))
    turn = F.max_by("_next", (c("_own") == c("own_end")).cast("int"))  # at a shared corner the chain of the same pixel
    jump = chains.select(*same, "cid", "end", "own_end").join(follow, [*same, "end"]).groupBy(*same, "cid").agg(turn.alias("jump"))
    state = cut_lineage(jump.withColumns({"ring": c("cid"), "ahead": F.lit(0).cast("long")}))
    step = 1
    while True:
        there = state.select(*same, c("cid").alias("jump"), c("jump").alias("_jump"), c("ring").alias("_ring"), c("ahead").alias("_ahead"))
        less = c("_ring") < c("ring")
        state = cut_lineage(state.join(there, [*same, "jump"]).select(
            *same, "cid", c("_jump").alias("jump"), F.least("ring", "_ring").alias("ring"), F.when(less, c("_ahead") + step).otherwise(c("ahead")).alias("ahead"), less.alias("_less")))
        step *= 2
        done = state.where("_less").isEmpty()
        state = state.drop("_less")
        if done:
            return state.drop("jump")


def region_polygons(labelled: DataFrame, keys: list[str], grid: Grid | None, tile: int = 256) -> DataFrame:
    """One polygon with holes per region, however large: keys, component_id, geometry, pixels.

    Coordinates are the grid's, or column and row numbers of pixel corners when no grid is given. Parts that touch only at a corner stay
    in separate rings. A ring begins at its topmost, leftmost corner.

    A task outlines one tile. Sides on tile borders cancel where the neighbour tile has the pixel beyond; the chains of sides that are
    left meet at border corners, and pointer jumping finds the ring and the place of each. Only outlines are brought together by region,
    which is what the region's row holds.
    """
    grid = grid or Grid(0.0, 0.0, 1.0, 1.0, 0, 0)
    same = [*keys, "component_id"]
    fields = [*[labelled.schema[k] for k in keys], T.StructField("component_id", T.LongType())]
    number = [T.StructField(k, T.LongType()) for k in ("pixels", "start", "end", "own_start", "own_end", "cid")]
    corners = [T.StructField(k, T.ArrayType(T.IntegerType())) for k in ("xs", "ys")]
    pieces = T.StructType([*fields, T.StructField("kind", T.IntegerType()), *number, *corners])

    def outline(table: pa.Table) -> pa.Table:
        row, col = (table[k].to_numpy() for k in ("row_idx", "col_idx"))
        made = tile_chains(row, col, tile)
        first = np.flatnonzero(np.diff(np.concatenate([[-1], made["chain"]])))
        last = np.append(first[1:], len(made["chain"])) - 1
        turned = np.concatenate([[True], made["way"][1:] != made["way"][:-1]])
        turned[first] = True
        at = np.flatnonzero(turned)
        offsets = pa.array(np.append(np.searchsorted(at, first), len(at)), pa.int32())
        place = lambda k: pa.ListArray.from_arrays(offsets, pa.array(k(made["start"][at], STRIDE), pa.int32()))
        pixel = row.astype(np.int64) * STRIDE + col
        labels, count = np.unique(table["component_id"].to_numpy(), return_counts=True)
        total, more = len(first) + len(labels), len(labels)
        column = lambda values: pa.chunked_array([pa.array(values), pa.nulls(more, pa.int64())])
        return pa.table({
            **{k: table[k].take(pa.array(np.zeros(total, np.int64))) for k in keys},
            "component_id": pa.chunked_array([table["component_id"].combine_chunks().take(pa.array(made["own"][first])), pa.array(labels)]),
            "kind": pa.chunked_array([pa.array(made["kind"][first], pa.int32()), pa.nulls(more, pa.int32())]),
            "pixels": pa.chunked_array([pa.nulls(len(first), pa.int64()), pa.array(count)]),
            "start": column(made["start"][first]), "end": column(made["end"][last]), "own_start": column(pixel[made["own"][first]]),
            "own_end": column(pixel[made["own"][last]]), "cid": column(made["start"][first] * 4 + made["way"][first]),
            "xs": pa.chunked_array([place(np.remainder), pa.nulls(more, pa.list_(pa.int32()))]),
            "ys": pa.chunked_array([place(np.floor_divide), pa.nulls(more, pa.list_(pa.int32()))])})

    tiled = labelled.select(*same, "row_idx", "col_idx", F.floor(c("row_idx") / tile).alias("_tr"), F.floor(c("col_idx") / tile).alias("_tc"))
    found = cut_lineage(tiled.groupBy(*keys, "_tr", "_tc").applyInArrow(outline, pieces))
    rest = [k.name for k in (*number, *corners)]
    line = found.where("kind = 2").withColumns({"_lo": F.least("start", "end"), "_hi": F.greatest("start", "end")})
    line = line.groupBy(*same, "_lo", "_hi").agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_f")).where(c("_n") == 1).select(*same, *(c(f"_f.{k}").alias(k) for k in rest))
    chains = cut_lineage(found.where("kind = 1").select(*same, *rest).unionByName(line))
    body = found.where("kind is null or kind = 0").select(*same, "pixels", c("cid").alias("ring"), F.lit(0).cast("long").alias("ahead"), "xs", "ys")
    if not chains.isEmpty():
        body = body.unionByName(chains.join(_rings(chains, keys), [*same, "cid"]).select(*same, "pixels", "ring", "ahead", "xs", "ys"))
    schema = T.StructType([*fields, T.StructField("geometry", geometry_type()), T.StructField("pixels", T.LongType())])

    def polygon(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ring", "ascending"), ("ahead", "descending")])  # nulls, the counts, come last
        ring = table["ring"].drop_null().to_numpy()
        x, y = (table[k].slice(0, len(ring)).combine_chunks() for k in ("xs", "ys"))
        size = np.bincount(np.unique(ring, return_inverse=True)[1], x.value_lengths().to_numpy()).astype(np.int64)
        ends = np.cumsum(size)
        x, y = x.flatten().to_numpy().astype(np.int64), y.flatten().to_numpy().astype(np.int64)
        rings = [straightened(x[e - n:e], y[e - n:e]) for e, n in zip(ends, size)]
        area = [float(np.sum(r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]) / 2) for r in rings]
        rings = [rings[i] for i in sorted(range(len(rings)), key=lambda i: -area[i])]  # the outer ring, then holes
        part = [[{"x": grid.x0 + a * grid.dx, "y": grid.y0 + b * grid.dy} for a, b in r] for r in rings]
        xy = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        shape = pa.struct([("type", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(xy))))])
        return (table.slice(0, 1).select(same).append_column("geometry", pa.array([{"type": "Polygon", "parts": [part]}], shape))
                .append_column("pixels", pa.array([pa.compute.sum(table["pixels"]).as_py()], pa.int64())))

    # A region is little data but a call of its own: partitions of a fixed number are not merged into one task for their few bytes.
    width = int(body.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return body.repartition(width, *same).groupBy(*same).applyInArrow(polygon, schema)


def region_statistics(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, greatest and least difference of each region, from labels that carry ndvi_diff: one aggregate."""
    v = F.nanvl(c("ndvi_diff").cast("double"), F.lit(None).cast("double"))
    stats = labelled.groupBy(*keys, "component_id").agg(
        F.count("*").alias("pixels"), F.avg(v).alias("ndvi_drop_mean"), F.max(v).alias("ndvi_drop_max"), F.min(v).alias("ndvi_diff_min"))
    return stats.na.fill(0.0, ["ndvi_drop_mean", "ndvi_drop_max", "ndvi_diff_min"])


def detect_regions(diff: DataFrame, keys: list[str], grid: Grid, min_area_m2: float = 2500.0, tile: int = 256) -> DataFrame:
    """Changed regions of a projected raster with polygon, area, difference statistics and change type.

    Regions under the least area are dropped before their polygons are traced.
    """
    cell = abs(grid.dx * grid.dy)
    labelled = cut_lineage(label_regions(diff.where(c("changed") == 1), keys, tile, carry=("ndvi_diff",)))
    stats = region_statistics(labelled, keys).withColumn("area_sq_meters", c("pixels") * F.lit(cell))
    stats = stats.where(c("area_sq_meters") >= min_area_m2).drop("pixels")
    kept = labelled.join(stats.select(*keys, "component_id"), [*keys, "component_id"], "left_semi")
    shapes = region_polygons(kept, keys, grid, tile)
    return shapes.join(stats, [*keys, "component_id"]).withColumn("change_type", change_type(c("ndvi_drop_mean")))


def to_degrees(regions: DataFrame, zone: int, south: bool = False) -> DataFrame:
    """Region polygons from a UTM zone to longitude and latitude."""
    moved = K.unproject_parts("geometry.parts", F.lit(zone), F.lit(south))
    return regions.withColumn("geometry", G.geometry(c("geometry.type"), moved))


def ground_area(df: DataFrame, out: str = "area_sq_meters") -> DataFrame:
    """Area in square metres of geometries in degrees, measured in the UTM zone of their centroid."""
    d = df.withColumn("_at", G.centroid(c("geometry")))
    d = d.withColumn("_utm", K.project_parts("geometry.parts", P.utm_zone(c("_at.x")), c("_at.y") < 0))
    return d.withColumn(out, G.area(G.geometry(c("geometry.type"), c("_utm")))).drop("_at", "_utm")
