"""What lies within reach of each change, counted and searched without listing pairs.

A change goes to one grid cell, an asset to every cell from which it can be reached; changes wider than a cell meet assets
by the cells of the distance join, apart from the others. Inside a cell both sides become trees of boxes; a pair
of nodes is settled as a whole once its least and greatest distance (and height difference) fall in one class, and
only the others are opened. Exact distances, by the kernel of the distance join, are left for what a border of a class
cuts. Work on pairs is held in steps of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landwatch.functions import kernels as K
from landwatch.operators.proximity import on_grid
from landwatch.operators.skew import salted_sides

#: Children of a node, node pairs of a step, metres that cover float noise of bounds, metres within which distances may round to the same millimetre.
FAN, MOST, SLACK, TIE = 4, 1 << 17, 1e-5, 2e-3
c = F.col


class Boxes:
    """Boxes of a plane and a height, sorted along a curve inside groups, with the boxes of runs of FAN, of FAN such runs, and so on to one a group."""

    def __init__(self, low: np.ndarray, high: np.ndarray, group: np.ndarray):
        middle = (low + high) / 2
        span = np.maximum(np.ptp(middle, axis=0), 1e-9) if len(low) else 1.0
        spot = ((middle - (middle.min(axis=0) if len(low) else 0.0)) / span * 65535).astype(np.int64)
        curve = np.zeros(len(low), np.int64)
        for bit in range(16):
            for axis in range(3):
                curve |= (spot[:, axis] >> bit & 1) << (3 * bit + axis)
        self.order = np.lexsort((curve, group))
        low, high, group = low[self.order], high[self.order], group[self.order]
        self.levels = [(low, high, group, None)]
        while len(group) > len(np.unique(group)):
            start = np.flatnonzero((np.arange(len(group)) - np.searchsorted(group, group)) % FAN == 0)
            low, high, group = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start), group[start]
            self.levels.append((low, high, group, np.append(start, len(self.levels[-1][0]))))

    def sums(self, values: np.ndarray) -> list[np.ndarray]:
        """Sums of values of the boxes, given in their first order, by level."""
        out = [values[self.order]]
        for *_, first in self.levels[1:]:
            out.append(np.add.reduceat(out[-1], first[:-1]))
        return out

    def below(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes, and the place of each one's parent in ``node``."""
        first = self.levels[level][3]
        n = first[node + 1] - first[node]
        parent = np.repeat(np.arange(len(node)), n)
        return np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n) + first[node][parent], parent


def _points(x: np.ndarray, y: np.ndarray) -> K.Ragged:
    g = K.Ragged.__new__(K.Ragged)
    g.rows = g.parts = g.rings = np.arange(len(x) + 1)
    g.x, g.y = x, y
    return g


def _ends(flat: pa.Array, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest x, y and height of flat geometries that have vertices."""
    g = K.FlatRagged(flat)
    start = np.searchsorted(g.row_of_vertex(), np.arange(len(flat)))
    both = np.stack([g.x, g.y], axis=1)
    return tuple(np.column_stack([f.reduceat(both, start), height]) for f in (np.minimum, np.maximum))


class Meeting:
    """Distinct changes of a cell and of one UTM zone beside the distinct assets of the cell."""

    def __init__(self, change: dict, asset: dict):
        self.change, self.asset = change, asset
        self.a, self.b = (Boxes(*_ends(s["flat"], s["height"]), s["group"]) for s in (change, asset))
        self.flats = [s["flat"].take(pa.array(t.order)) for s, t in ((change, self.a), (asset, self.b))]
        self.polygons = [s["polygon"][t.order] for s, t in ((change, self.a), (asset, self.b))]

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Ground distance of single changes and single assets."""
        one, two = (K.FlatRagged(f.take(pa.array(k))) for f, k in zip(self.flats, (i, j)))
        return K.pair_distance(one, self.polygons[0][i], two, self.polygons[1][j])

    def bounds(self, la: int, lb: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance that a change and an asset of two nodes can have."""
        (a0, a1, *_), (b0, b1, *_) = self.a.levels[la], self.b.levels[lb]
        a0, a1, b0, b1 = a0[i, :2], a1[i, :2], b0[j, :2], b1[j, :2]
        least = np.hypot(*np.maximum(np.maximum(a0 - b1, b0 - a1), 0.0).T)
        most = np.hypot(*np.maximum(a1 - b0, b1 - a0).T)
        if la == 0:  # all of a box lies within half its diagonal of its centre
            near = self.change_reach(i, (b0 + b1) / 2)
            half = np.hypot(*(b1 - b0).T) / 2
            least, most = np.fmax(least, near - half), np.fmin(most, near + half)
        return least - SLACK, most + SLACK

    def change_reach(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        none = np.zeros(len(i), bool)
        return K.pair_distance(K.FlatRagged(self.flats[0].take(pa.array(i))), self.polygons[0][i], _points(at[:, 0], at[:, 1]), none)

    def roots(self) -> tuple[int, int, np.ndarray, np.ndarray]:
        """Levels and node pairs to begin with: groups that meet in this cell for the first time."""
        la, lb = len(self.a.levels) - 1, len(self.b.levels) - 1
        i, j = (k.ravel() for k in np.meshgrid(np.arange(len(self.a.levels[la][2])), np.arange(len(self.b.levels[lb][2])), indexing="ij"))
        ga, gb = self.change["first"][self.a.levels[la][2][i]], self.asset["first"][self.b.levels[lb][2][j]]
        met = (ga | gb).all(axis=1)
        return la, lb, i[met], j[met]

    def opened(self, la: int, lb: int, i: np.ndarray, j: np.ndarray):
        """The pairs one level down on one side, still in the order of the changes."""
        if lb >= la and lb:
            child, parent = self.b.below(lb, j)
            return la, lb - 1, i[parent], child
        child, parent = self.a.below(la, i)
        order = np.argsort(child, kind="stable")
        return la - 1, lb, child[order], j[parent][order]

    def tally(self, reach: float, edges: np.ndarray, steps: Callable) -> tuple[np.ndarray, list[tuple]]:
        """Per change and class the number of assets, and each class as asset group, a distance and a height difference in it."""
        weight = self.b.sums(self.asset["weight"])
        held = [np.zeros((len(x[0]), 0), np.int64) for x in self.a.levels]
        codes: dict[tuple, int] = {}
        kinds: list[tuple] = []

        def add(la, lb, i, j, far, rise, near_class, rise_class):
            by, kind = self.asset["by"][self.b.levels[lb][2][j]], self.change["kind"][self.a.levels[la][2][i]]
            rows, first, which = np.unique(np.stack([by, near_class, rise_class, kind]), axis=1, return_index=True, return_inverse=True)
            for key, at in zip(map(tuple, rows.T.tolist()), first):
                if key not in codes:
                    codes[key] = len(kinds)
                    kinds.append((key[0], float(far[at]), float(rise[at]) if key[2] >= 0 else None))
            place = np.array([codes[k] for k in map(tuple, rows.T.tolist())], np.int64)[which.ravel()]
            if held[la].shape[1] < len(kinds):
                held[la] = np.pad(held[la], ((0, 0), (0, max(8, 2 * len(kinds)) - held[la].shape[1])))
            np.add.at(held[la], (i, place), weight[lb][j])

        work = [self.roots()]
        while work:
            la, lb, i, j = work.pop()
            if len(i) > MOST:
                work += [(la, lb, i[k:k + MOST], j[k:k + MOST]) for k in range(0, len(i), MOST)]
                continue
            kind, known = self.change["kind"][self.a.levels[la][2][i]], self.change["known"][self.a.levels[la][2][i]] & self.asset["known"][self.b.levels[lb][2][j]]
            rise = [self.a.levels[la][k][i, 2] - self.b.levels[lb][1 - k][j, 2] for k in (0, 1)]
            classes = [np.where(known, steps(r, kind), -1) for r in rise]
            least, most = self.bounds(la, lb, i, j)
            open_ = least <= reach
            settled = open_ & (most <= reach) & (np.searchsorted(edges, least, "right") == np.searchsorted(edges, most, "right")) & (classes[0] == classes[1])
            if la == lb == 0:
                rest = np.flatnonzero(open_ & ~settled)
                if len(rest):
                    d = self.exact(i[rest], j[rest])
                    with np.errstate(invalid="ignore"):
                        rest, d = rest[d <= reach], d[d <= reach]
                    add(la, lb, i[rest], j[rest], d, rise[0][rest], np.searchsorted(edges, d, "right"), classes[0][rest])
            hit = np.flatnonzero(settled)
            if len(hit):
                add(la, lb, i[hit], j[hit], np.maximum(most[hit] - SLACK, 0.0), rise[0][hit], np.searchsorted(edges, most[hit], "right"), classes[0][hit])
            if la or lb:
                rest = np.flatnonzero(open_ & ~settled)
                if len(rest):
                    work.append(self.opened(la, lb, i[rest], j[rest]))
        held = [np.pad(h, ((0, 0), (0, max(len(kinds) - h.shape[1], 0))))[:, :len(kinds)] for h in held]
        for level in range(len(held) - 1, 0, -1):
            held[level - 1] += np.repeat(held[level], np.diff(self.a.levels[level][3]), axis=0)
        out = np.empty_like(held[0])
        out[self.a.order] = held[0]
        return out, kinds

    def nearest(self, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Changes, assets and distances: of each change its nearest assets in reach, and any that rounding may put beside them."""
        found = []
        work = [(*self.roots(), np.full(len(self.a.levels[-1][0]), reach))]
        while work:
            la, lb, i, j, limit = work.pop()
            if len(i) > MOST and i[0] != i[-1]:
                cut = np.searchsorted(i, i[len(i) // 2])
                cut = cut if cut else np.searchsorted(i, i[0], "right")
                work += [(la, lb, i[:cut], j[:cut], limit), (la, lb, i[cut:], j[cut:], limit)]
                continue
            last = la == lb == 0
            if last:
                least = most = self.exact(i, j) if len(i) else np.zeros(0)
            else:
                least, most = self.bounds(la, lb, i, j)
            limit = limit.copy()
            np.fmin.at(limit, i, most)
            with np.errstate(invalid="ignore"):
                stay = np.flatnonzero((least <= limit[i] + TIE) & (least <= reach))
            if last:
                found.append((self.a.order[i[stay]], self.b.order[j[stay]], least[stay]))
            elif len(stay):
                la2, lb2, i2, j2 = self.opened(la, lb, i[stay], j[stay])
                work.append((la2, lb2, i2, j2, np.repeat(limit, np.diff(self.a.levels[la][3])) if la2 < la else limit))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _side(table: pa.Table, flat: pa.Array, first: list[str], by: np.ndarray, kind: np.ndarray, height: pa.Array, weight: np.ndarray, polygon: pa.Array) -> dict:
    """What a tree reads of distinct rows; rows of one group share the first-cell flags, known height, class column and kind."""
    flags = np.column_stack([table[k].to_numpy() for k in first]).astype(bool)
    known = ~height.is_null().to_numpy(zero_copy_only=False)
    rows, at, group = np.unique(np.column_stack([flags, known, by, kind]).astype(np.int64), axis=0, return_index=True, return_inverse=True)
    return {"flat": flat, "height": np.where(known, height.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0), "group": group.ravel(), "weight": weight,
            "polygon": polygon.fill_null(False).to_numpy(zero_copy_only=False).astype(bool), "first": flags[at], "known": known[at], "by": by[at], "kind": kind[at]}


def _has_place(flat: pa.Array) -> np.ndarray:
    """Rows with vertices, all of them finite."""
    g = K.FlatRagged(flat)
    row = g.row_of_vertex()
    n = len(flat)
    return (np.bincount(row, minlength=n) > 0) & (np.bincount(row[~(np.isfinite(g.x) & np.isfinite(g.y))], minlength=n) == 0)


def _distinct(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A row for each item, and every row's place among them."""
    _, first, inverse = np.unique(table["_item"].to_numpy(), return_index=True, return_inverse=True)
    return table.take(pa.array(first)), inverse.ravel()


def _array(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _met(changes: pa.Table, assets: pa.Table):
    """Meetings by UTM zone, with the change table of the zone, each row's item, and the distinct assets with their rows' items."""
    changes, assets = (t.filter(pa.array(_has_place(_array(t, k)))) if t.num_rows else t for t, k in ((changes, "c_flat"), (assets, "a_flat")))
    if not changes.num_rows or not assets.num_rows:
        return
    lone, owner = _distinct(assets)
    weight = np.bincount(owner, minlength=lone.num_rows)
    plain = K.FlatRagged(_array(lone, "a_flat"))
    zone, south = changes["c_zone"].to_numpy(), changes["c_south"].to_numpy()
    for z, s in sorted(set(zip(zone.tolist(), south.tolist()))):
        own = changes.filter(pa.array((zone == z) & (south == s)))
        each, item = _distinct(own)
        none = np.zeros(each.num_rows, np.int64)
        left = _side(each, _array(each, "c_flat"), ["_first_x", "_first_y"], none, each["_kind"].to_numpy(), _array(each, "_height"), none + 1, _array(each, "c_poly"))
        x, y = K.utm_xy(plain.x, plain.y, z, s)
        right = _side(lone, K._flat(plain, x, y), ["_first_x", "_first_y"], lone["_by"].to_numpy(), np.zeros(lone.num_rows, np.int64), _array(lone, "_height"), weight, _array(lone, "a_poly"))
        yield Meeting(left, right), own, item, lone, owner


def _sides(changes: DataFrame, assets: DataFrame, max_distance_m: float, within: list[str], carry: list[str], by: list[str], cell_rows: int, ids: bool):
    """Both sides by cell and salt as the kernels read them, with their ids if asked for. ``changes`` has _height and _kind, ``assets`` _height."""
    left, right, n, _, _ = on_grid(changes, assets, max_distance_m, fold=2)
    for k in within:  # null keys meet nothing
        left, right = left.where(c(k).isNotNull()), right.where(c(k).isNotNull())
    cell = [*within, "_wide", "cell_x", "cell_y"]
    wide = lambda yes, no: F.when(c("_wide"), yes).otherwise(no)
    left = left.withColumn("_wide", (c("c_x1") - c("c_x0") > 1) | (c("c_y1") - c("c_y0") > 1) | F.lit(n < 4))
    left = (left.withColumn("_ux", F.explode(F.sequence(c("c_x0"), wide(c("c_x1"), c("c_x0")))))
            .withColumn("cell_y", F.explode(F.sequence(c("c_y0"), wide(c("c_y1"), c("c_y0"))))).withColumn("cell_x", F.pmod("_ux", F.lit(n))))
    right = right.withColumn("_wide", F.explode(F.array(F.lit(False), F.lit(True))))
    right = (right.withColumn("_vx", F.explode(F.sequence(wide(c("a_x0"), c("a_x0") - 1), wide(c("a_x1"), F.least(c("a_x1"), c("a_x0") + n - 2)))))
             .withColumn("cell_y", F.explode(F.sequence(wide(c("a_y0"), c("a_y0") - 1), c("a_y1")))).withColumn("cell_x", F.pmod("_vx", F.lit(n))))
    same = lambda *cols: F.xxhash64(*cols, *[c(k).isNull() if isinstance(k, str) else k.isNull() for k in cols])
    left = left.withColumns({"_first_x": c("_ux") == c("c_x0"), "_first_y": c("cell_y") == c("c_y0")}).withColumn(
        "_item", same("change_geometry", "_height", "_kind", "_first_x", "_first_y", "c_zone", "c_south")).withColumn("_class", same(*carry) if carry else F.lit(0).cast("long"))
    right = right.withColumns({"_first_x": c("_vx") == c("a_x0"), "_first_y": c("cell_y") == c("a_y0"), "_by": same(*by) if by else F.lit(0).cast("long")}).withColumn(
        "_item", same("asset_geometry", "_height", "_by", "_first_x", "_first_y"))
    left = left.select(*dict.fromkeys([*cell, "change_id", *carry]), "c_zone", "c_south", "c_flat", "c_poly", "_height", "_kind", "_first_x", "_first_y", "_item", "_class")
    right = right.select(*cell, "asset_id", *by, "a_flat", "a_poly", "_height", "_first_x", "_first_y", "_item", "_by")
    left, right, salts = salted_sides(left, right, cell, "change_id", "asset_id", cell_rows)
    if not ids:
        left, right = left.drop(*{"change_id"} - {*carry}), right.drop(*{"asset_id"} - {*by})
    return left.groupBy(*cell, *salts).cogroup(right.groupBy(*cell, *salts))


def nearest_in_reach(changes: DataFrame, assets: DataFrame, max_distance_m: float, within: list[str] | None = None, cell_rows: int = 50_000) -> DataFrame:
    """``proximity.matched_changes`` of the distance join of both, without its pairs: change_id, asset_count, nearest_m, nearest_asset_id."""
    within = within or []
    changes = changes.select(*dict.fromkeys([*within, "change_id", "geometry"])).withColumns({"_height": F.lit(None).cast("double"), "_kind": F.lit(0).cast("long")})
    assets = assets.select(*dict.fromkeys([*within, "asset_id", "asset_type", "geometry"])).withColumn("_height", F.lit(None).cast("double"))
    names = ["change_id", "n", "distance_meters", "asset_id"]
    schema = T.StructType([changes.schema["change_id"], T.StructField("n", T.LongType()), T.StructField("distance_meters", T.DoubleType()), assets.schema["asset_id"]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for met, own, item, lone, owner in _met(left, right):
            held, _ = met.tally(max_distance_m, np.zeros(0), lambda rise, kind: np.zeros(len(rise), np.int64))
            counts = held.sum(axis=1)
            i, j, d = met.nearest(max_distance_m)
            # the least asset of equal ones, null first, as min_by would have it
            assets_of = right.filter(pa.array(_has_place(_array(right, "a_flat"))))["asset_id"].combine_chunks()
            rank = pc.sort_indices(assets_of, null_placement="at_start").to_numpy()
            least = rank[np.unique(owner[rank], return_index=True)[1]]
            order = np.argsort(i, kind="stable")
            i, j, d = i[order], j[order], d[order]
            size = np.bincount(i, minlength=len(counts))
            start = np.cumsum(size) - size
            n = size[item]
            row = np.repeat(np.arange(len(item)), n)
            pick = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[item][row]
            lead = np.concatenate([[True], row[1:] != row[:-1]])[:len(row)]
            made.append(pa.table([own["change_id"].take(pa.array(row)), pa.array(np.where(lead, counts[item][row], 0)), pa.array(d[pick]), assets_of.take(pa.array(least[j[pick]]))], names=names))
        return pa.concat_tables(made) if made else pa.table([pa.array([], T_) for T_ in (left["change_id"].type, pa.int64(), pa.float64(), right["asset_id"].type)], names=names)

    found = _sides(changes, assets, max_distance_m, within, [], [], cell_rows, True).applyInArrow(run, schema)
    nearest = F.min_by("asset_id", F.struct(F.round("distance_meters", 3), "asset_id"))
    return found.groupBy("change_id").agg(F.sum("n").alias("asset_count"), F.min("distance_meters").alias("nearest_m"), nearest.alias("nearest_asset_id"))


def pair_classes(changes: DataFrame, assets: DataFrame, max_distance_m: float, distances: list[float], steps: Callable, carry: list[str], by: list[str],
                 within: list[str] | None = None, cell_rows: int = 50_000) -> DataFrame:
    """The pairs of the distance join by class: ``carry`` (of changes), ``by`` (of assets), distance_meters, elevation_diff_m and ``pairs``, how many there are.

    A class has equal ``carry`` and ``by``, distances between the same two of ``distances`` (the lower one included), and equal
    ``steps(height differences, _kind of the change)``: whole numbers from 0 that are constant between two differences at which they are equal.
    The distance and the difference of a row lie in its class; an unknown height gives a null difference. ``changes`` has _height and _kind
    (long), ``assets`` _height. A class may come in several rows.
    """
    within = within or []
    schema = T.StructType([*[changes.schema[k] for k in carry], *[assets.schema[k] for k in by], T.StructField("distance_meters", T.DoubleType()),
                           T.StructField("elevation_diff_m", T.DoubleType()), T.StructField("pairs", T.LongType())])
    edges = np.array(sorted(distances), float)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for met, own, item, lone, _ in _met(left, right):
            held, kinds = met.tally(max_distance_m, edges, steps)
            if not kinds:
                continue
            _, first, group = np.unique(own["_class"].to_numpy(), return_index=True, return_inverse=True)
            both, times = np.unique(group.ravel() * len(held) + item, return_counts=True)  # items of a class of changes, and how often
            total = np.zeros((len(first), len(kinds)), np.int64)
            for k in range(0, len(both), 4096):
                part = both[k:k + 4096]
                np.add.at(total, part // len(held), held[part % len(held)] * times[k:k + 4096, None])
            row, kind = np.nonzero(total)
            listed = {g: at for at, g in enumerate(lone["_by"].to_pylist())}
            asset = np.array([listed[g] for g, _, _ in kinds], np.int64)[kind]
            values = [pa.array([x[k] for x in kinds], pa.float64()).take(pa.array(kind)) for k in (1, 2)]
            taken = [*[_array(own, k).take(pa.array(first[row])) for k in carry], *[_array(lone, k).take(pa.array(asset)) for k in by]]
            made.append(pa.table([*taken, *values, pa.array(total[row, kind])], names=schema.names))
        if made:
            return pa.concat_tables(made)
        kinds_ = [*[left[k].type for k in carry], *[right[k].type for k in by], pa.float64(), pa.float64(), pa.int64()]
        return pa.table([pa.array([], x) for x in kinds_], names=schema.names)

    return _sides(changes, assets, max_distance_m, within, carry, by, cell_rows, False).applyInArrow(run, schema)
