"""Spatial operators: group span, nearest neighbour, radius match, polyline points.

None of them lists the pairs of a group. Span works on hull points or looks up antipodes in a grid that gets finer, nearest neighbour
and radius match meet through grid cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lineside.functions.columns import EARTH_KM, EARTH_M, haversine, local_east, local_north
from lineside.session import settle

_DIRECTIONS = 16


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    phi, lam = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)])


def _central_plane(xyz: np.ndarray) -> np.ndarray | None:
    """Central projection onto a plane, or None when the points do not fit in one hemisphere.

    Great circles become straight lines, so spherical hulls become planar hulls, whatever the centre.
    """
    centre = xyz.mean(axis=0)
    if np.linalg.norm(centre) < 1e-9:
        return None
    centre /= np.linalg.norm(centre)
    if (xyz @ centre).min() <= 1e-9:
        return None
    east = np.cross(centre, [0.0, 0.0, 1.0] if abs(centre[2]) < 0.9 else [1.0, 0.0, 0.0])
    east /= np.linalg.norm(east)
    depth = xyz @ centre
    return np.column_stack([xyz @ east / depth, xyz @ np.cross(east, centre) / depth])


def _outer_rows(codes: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Mask of the points that may be hull points of their group.

    A point strictly inside the polygon of its group's extremes in 16 directions cannot be one.
    """
    n_groups, everyone = codes.max() + 1, np.arange(len(codes))
    angle = np.linspace(0, 2 * np.pi, _DIRECTIONS, endpoint=False)
    corners = np.empty((_DIRECTIONS, n_groups), dtype=int)
    for k, reach in enumerate((plane @ np.vstack([np.cos(angle), np.sin(angle)])).T):
        order = np.lexsort((reach, codes))
        last = np.r_[np.flatnonzero(np.diff(codes[order])), len(codes) - 1]
        corners[k, codes[order[last]]] = everyone[order[last]]
    inside = np.ones(len(codes), dtype=bool)
    for k in range(_DIRECTIONS):
        a, b = plane[corners[k][codes]], plane[corners[(k + 1) % _DIRECTIONS][codes]]
        same = (a == b).all(axis=1)
        side = (b[:, 0] - a[:, 0]) * (plane[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (plane[:, 0] - a[:, 0])
        inside &= same | (side > 1e-15)
    # of points on one line only the extremes count
    half = _DIRECTIONS // 2
    ends = plane[corners[:half]], plane[corners[half:]]
    widest = np.argmax(((ends[1] - ends[0]) ** 2).sum(axis=2), axis=0)
    start, line = ends[0][widest, np.arange(n_groups)], (ends[1] - ends[0])[widest, np.arange(n_groups)]
    away = plane - start[codes]
    off = np.abs(away[:, 0] * line[codes, 1] - away[:, 1] * line[codes, 0]) / np.maximum(np.hypot(*line[codes].T), 1e-300)
    most = np.zeros(n_groups)
    np.maximum.at(most, codes, off)
    extreme = np.zeros(len(codes), dtype=bool)
    extreme[corners] = True
    return np.where((most < 1e-12)[codes], extreme, ~inside)


def _hull_rows(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Indices of the spherical convex hull of points within one hemisphere (all, if they are wider or on one line)."""
    plane = _central_plane(_unit(lat, lon)) if len(lat) > 3 else None
    if plane is None:
        return np.arange(len(lat))
    order = np.lexsort((plane[:, 1], plane[:, 0]))

    def chain(points) -> list[int]:
        kept: list[int] = []
        for i in points:
            while len(kept) > 1:
                o, a = plane[kept[-2]], plane[kept[-1]]
                if (a[0] - o[0]) * (plane[i][1] - o[1]) - (a[1] - o[1]) * (plane[i][0] - o[0]) > 0:
                    break
                kept.pop()
            kept.append(i)
        return kept

    return np.array(sorted(set(chain(order)) | set(chain(order[::-1]))))


def _haversine_km(lat1, lon1, lat2, lon2) -> np.ndarray:
    a = (np.sin(np.radians(lat2 - lat1) / 2) ** 2
         + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2)
    return EARTH_KM * 2 * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0, 1 - a)))


#: Groups in a box of this diagonal (on the unit sphere) lie within 21 degrees of its centre.
_NARROW = 0.7


def group_span(df: DataFrame, group: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Largest great-circle distance (km) between any two points of each group; 0 for one point.

    Exact at any size and width, antipodes included. Inner points are dropped per batch before anything is shuffled, where a batch
    holds many points of a group, and again per (group, slice of the partitions), so a group that holds much of the data is thinned long
    before its outer points meet in one task. Where what is left of a group lies close together, the two farthest are
    hull points. For wider groups that does not hold; see ``_wide_span``. Rows without a coordinate are left out.
    """
    points = df.select(group, F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).dropna(
        subset=["lat", "lon"])
    kind = _kind(points, group) + ", lat double, lon double"
    # a slice is 16 neighbouring partitions; sorting puts a group into few batches
    sliced = points.mapInPandas(_outer_points(group), kind).withColumn("_slice", F.floor(F.spark_partition_id() / 16))
    outer = settle(sliced.repartition(_tasks(df), group, "_slice").sortWithinPartitions(group).drop("_slice").mapInPandas(_outer_points(group), kind))
    box = [F.max(v) - F.min(v) for v in _on_sphere("lat", "lon")]
    wide = settle(outer.groupBy(F.col(group).alias("_g")).agg(F.sqrt(sum((side * side for side in box), F.lit(0.0))).alias("_d"))
                  .where(F.col("_d") >= _NARROW).select("_g"))
    if wide.limit(1).count():
        near = _narrow_span(outer.join(wide, F.col(group).eqNullSafe(F.col("_g")), "left_anti"), group)
        return near.unionByName(_wide_span(outer.join(wide, F.col(group).eqNullSafe(F.col("_g")), "left_semi"), group))
    return _narrow_span(outer, group)


def _tasks(df: DataFrame) -> int:
    """Number of tasks for rows that are few bytes but much work: given, so that it does not follow from their size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _kind(df: DataFrame, column: str) -> str:
    return f"`{column}` {df.schema[column].dataType.simpleString()}"


def _on_sphere(lat: str, lon: str) -> list[Column]:
    """Coordinates on the unit sphere."""
    phi, lam = F.radians(lat), F.radians(lon)
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]


#: Comparisons of points that are made at once in place of a finer grid: so many, or so many for each point.
_COMPARED, _COMPARED_EACH = 2_000_000, 4


def _wide_span(points: DataFrame, group: str) -> DataFrame:
    """Span of groups of any width, by looking up antipodes in a grid that gets finer.

    The farthest point from p is the nearest to its antipode -p, so the span follows from the least gap |p + q|, which
    tells pairs near the antipodes well apart. Cubes are halved from round to round, pairs of cubes that may hold
    the least gap go on: their representatives' gap, less two diagonals, does not exceed the least gap
    between representatives so far. When few points are left in such pairs, these are compared.
    """
    places = settle(points.distinct().select(F.col(group).alias("_g"), "lat", "lon", *[
        (EARTH_M * v).alias(c) for v, c in zip(_on_sphere("lat", "lon"), "xyz")]).withColumns(
        {"_h": F.struct("_g"), "_code": _morton(*(F.col(c) + EARTH_M for c in "xyz"))}))
    budget = max(_COMPARED, _COMPARED_EACH * places.count())
    pairs = places.select("_h").distinct().select("_h", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(1, _MORTON_BITS + 1):
        shift = 3 * (_MORTON_BITS - level)
        edge = _FINEST_M * 2.0 ** (_MORTON_BITS - level)
        open_ = pairs.select("_h", F.explode(F.array("a", "b")).alias("_up")).distinct()
        parent = F.shiftright("_code", shift + 3) if shift + 3 < 64 else F.lit(0).cast("long")
        inside = places.withColumn("_up", parent).join(open_, ["_h", "_up"], "left_semi")
        cells = inside.groupBy("_h", F.shiftright("_code", shift).alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y", "z")).alias("at"))
        first, second = (cells.select("_h", F.shiftright("cell", 3).alias(side), F.col("cell").alias(f"_{side}"), F.col("n").alias(f"n{side}"),
                                      F.col("at").alias(f"at{side}")) for side in "ab")
        met = pairs.select("_h", "a", "b").join(first, ["_h", "a"]).join(second, ["_h", "b"]).where("a < b OR _a <= _b")
        gap = F.sqrt(sum(((F.col(f"ata.{c}") + F.col(f"atb.{c}")) * (F.col(f"ata.{c}") + F.col(f"atb.{c}")) for c in "xyz"), F.lit(0.0)))
        met = settle(met.select("_h", F.col("_a").alias("a"), F.col("_b").alias("b"), "na", "nb", gap.alias("gap")))
        least = met.groupBy("_h").agg(F.min("gap").alias("least"))
        pairs = met.join(least, "_h").where(F.col("gap") - 2 * 3 ** 0.5 * edge <= F.col("least") + 1e-3)
        if (pairs.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0) <= budget:
            break
    place = places.withColumn("cell", F.shiftright("_code", shift))
    left = place.select("_h", F.col("cell").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    right = place.select("_h", "_g", F.col("cell").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    far = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return pairs.select("_h", "a", "b").join(left, ["_h", "a"]).join(right, ["_h", "b"]).groupBy(F.col("_g").alias(group)).agg(F.max(far).alias("span_km"))


#: A batch with fewer points than this for each of its groups is left as it is.
_FEW_POINTS = 8


def _outer_points(group: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Drops points of a batch that cannot be an end of their group's span, as far as the batch can tell."""

    def own_plane(part: pd.DataFrame) -> pd.DataFrame:
        xyz = _unit(part["lat"].to_numpy(), part["lon"].to_numpy())
        # beyond 45 degrees from the centre an inner point may be nearest to an antipode
        centre = xyz.mean(axis=0)
        if np.linalg.norm(centre) < 1e-9 or (xyz @ centre).min() < 0.7072 * np.linalg.norm(centre):
            return part
        return part[_outer_rows(np.zeros(len(part), int), _central_plane(xyz))]

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) < _FEW_POINTS * batch[group].nunique(dropna=False):
                yield batch  # so few points of a group do not tell its inner ones
                continue
            batch = batch.drop_duplicates()
            if len(batch):
                xyz = _unit(batch["lat"].to_numpy(), batch["lon"].to_numpy())
                centre = xyz.mean(axis=0)
                if (xyz @ centre).min() >= 0.7072 * max(np.linalg.norm(centre), 1e-9):
                    batch = batch[_outer_rows(pd.factorize(batch[group], use_na_sentinel=False)[0], _central_plane(xyz))]
                else:
                    batch = pd.concat([own_plane(part) for _, part in batch.groupby(group, dropna=False, sort=False)])
            yield batch

    return outer


def _narrow_span(points: DataFrame, group: str) -> DataFrame:
    """Span of groups that lie close together; what is left of a group is one row."""
    kind = _kind(points, group)

    def span(lat: np.ndarray, lon: np.ndarray) -> float:
        if len(lat) > 32:
            hull = _hull_rows(lat, lon)
            lat, lon = lat[hull], lon[hull]
        if len(lat) > 256:
            return max(float(_haversine_km(lat[i], lon[i], lat[i + 1:], lon[i + 1:]).max()) for i in range(len(lat) - 1))
        return float(_haversine_km(lat[:, None], lon[:, None], lat, lon).max())

    def widest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({group: batch[group], "span_km": [span(np.asarray(a, float), np.asarray(o, float)) for a, o in zip(batch["lat"], batch["lon"])]})

    rows = points.repartition(_tasks(points), group).groupBy(group).agg(F.collect_set(F.struct("lat", "lon")).alias("_p"))
    return rows.select(group, F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon")).mapInPandas(widest, f"{kind}, span_km double")


_FINEST_M = 8.0
_LEVELS = 12  # cell sizes 8 m * 4**level; the coarsest holds the whole earth in one cell
_MORTON_BITS = 21  # bits of a coordinate in cubes of 8 m


def _morton(x: Column, y: Column, z: Column) -> Column:
    """Place along a space-filling curve through cubes of 8 m: a coarser cube is a prefix of its bits.

    Each coordinate's bits are moved two places apart, in halves.
    """
    def apart(c: Column) -> Column:
        v = F.least(F.floor(c / _FINEST_M).cast("long"), F.lit((1 << _MORTON_BITS) - 1))
        for by in (32, 16, 8, 4, 2):
            run = by // 2  # bits that stay together, then twice as many free places
            mask = sum(1 << i for i in range(63) if i // run % 3 == 0)
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(apart(x), 2).bitwiseOR(F.shiftleft(apart(y), 1)).bitwiseOR(apart(z))


#: Cubes of 128 m, 8 km and 524 km, and everything: within one of these a place meets its neighbours on the curve.
_TIERS = (12, 30, 48, None)


def _some_distance(places: DataFrame, by: list[str]) -> DataFrame:
    """A distance within which each place surely has another: that of its neighbours on the curve.

    Neighbours are looked up within small cubes. A place alone in its cube goes on, with one place for each other cube, to the next
    size, so no step holds a whole group in one task.
    """
    found, items = [], places.select(*by, "_lat", "_lon", "x", "y", "z", "_code", F.lit(True).alias("_open"))
    for shift in _TIERS:
        items = items.withColumn("_cube", F.shiftright("_code", shift) if shift else F.lit(0).cast("long"))
        along = Window.partitionBy(*by, "_cube").orderBy("_code", "x", "y", "z")

        def gap(move: Callable[..., Column]) -> Column:
            return F.sqrt(sum(((F.col(c) - move(c).over(along)) * (F.col(c) - move(c).over(along)) for c in "xyz"), F.lit(0.0)))

        items = items.withColumn("_d", F.least(gap(F.lag), gap(F.lead)))
        found.append(items.where("_open AND _d IS NOT NULL").select(*by, "_lat", "_lon", "x", "y", "z", "_d"))
        one = F.min(F.struct("_code", "x", "y", "z", "_lat", "_lon", "_open")).alias("_one")
        items = items.groupBy(*by, "_cube").agg(one, F.count(F.lit(1)).alias("_n")).select(
            *by, *(F.col(f"_one.{c}").alias(c) for c in ("_lat", "_lon", "x", "y", "z", "_code")),
            (F.col("_one._open") & (F.col("_n") == 1)).alias("_open"))
    return reduce(DataFrame.unionByName, found)


#: Groups of up to so many rows are compared within a task; larger ones go along the curve.
_COMPARED_ROWS = 2048


def nearest_neighbour(df: DataFrame, group: str, entity: str, lat: str = "lat", lon: str = "lon", keep: Sequence[str] = ()) -> DataFrame:
    """Metres to the nearest other entity of the same group; NULL for an entity alone in its group. ``keep`` names columns to carry along.

    (group, entity) must be unique. Exact. Rows are written once, by group. Groups of a bounded size, as those of routes are, are
    met whole in a task, many to a batch; the others are looked up along a space-filling curve, without comparing all pairs.
    """
    kinds = [_kind(df, c) for c in (group, entity, *keep)]
    rows = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        group, entity, *keep, F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
    rows = settle(rows.repartition(_tasks(df), group).sortWithinPartitions(group))
    odd = [F.isnan(c) | (F.abs(c) == float("inf")) for c in ("_lat", "_lon")]
    large = settle(rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(odd[0] | odd[1]).alias("_odd")).where(F.col("_odd") | (F.col("_n") > _COMPARED_ROWS)).select("_g"))
    small, along = rows, None
    if large.limit(1).count():
        small = rows.join(large, F.col(group) == F.col("_g"), "left_anti").repartition(_tasks(df), group).sortWithinPartitions(group)
        along = _nearest_along_curve(rows.join(large, F.col(group) == F.col("_g"), "left_semi"), group, entity, "_lat", "_lon", keep)
    schema = ", ".join([*kinds, "_lat double", "_lon double", "_olat double", "_olon double"])
    met = small.mapInArrow(_nearest_within(group, to_arrow_schema(_parse_datatype_string(schema))), schema)
    out = met.select(group, entity, *keep, haversine(F.col("_lat"), F.col("_lon"), F.col("_olat"), F.col("_olon"), EARTH_M).alias("nearest_neighbor_m"))
    return out if along is None else out.unionByName(along)


def _nearest_within(group: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the nearest other row of each row's group; rows come in the order of their groups, rows without a group have none."""

    def nearest(xyz: np.ndarray) -> np.ndarray:
        found = np.empty(xyz.shape[1], np.int64)
        step = max(1, 262_144 // len(found))
        for a in range(0, len(found), step):
            mine = xyz[:, a:a + step]
            apart = sum((mine[k][:, None] - xyz[k]) ** 2 for k in range(3))
            apart[np.arange(mine.shape[1]), np.arange(a, a + mine.shape[1])] = np.inf
            found[a:a + step] = np.argmin(apart, axis=1)
        return found

    def answered(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        lat, lon, named = rows["_lat"].to_numpy(), rows["_lon"].to_numpy(), rows[group].is_valid().to_numpy()
        xyz = EARTH_M * _unit(lat, lon).T
        other = np.full(len(lat), -1)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1 and named[a]:
                other[a:b] = nearest(xyz[:, a:b]) + a
        columns = [_whole(rows[f.name]).cast(f.type) for f in list(schema)[:-2]]
        return pa.RecordBatch.from_arrays(columns + [pa.array(v[other], mask=other < 0) for v in (lat, lon)], schema=schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            if not rows.num_rows:
                continue
            codes = _whole(rows[group]).dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(codes)]
            goes_on = rows[group][-1].is_valid  # its last group may go on in the next batch
            end = int(cuts[-2]) if goes_on else len(codes)
            held = rows.slice(end) if goes_on else None
            if end:
                yield answered(rows.slice(0, end), cuts[cuts <= end])
        if held is not None:
            yield answered(held, np.array([0, held.num_rows]))

    return each


def _nearest_along_curve(df: DataFrame, group: str, entity: str, lat: str, lon: str, keep: Sequence[str]) -> DataFrame:
    """See ``nearest_neighbour``, for groups of any size.

    Places are put in order along a space-filling curve; the neighbours there bound a place's nearest distance. It then asks in the one grid
    whose cubes are at least twice that bound, so its surroundings touch eight cubes at most, and
    places are laid out only at the sizes their group asks at.
    """
    places = settle(
        df.groupBy(group, F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
        .agg(F.count(F.lit(1)).alias("_here"))
        .select("*", *[(EARTH_M * (1 + v)).alias(c) for v, c in zip(_on_sphere("_lat", "_lon"), "xyz")])
        .withColumn("_code", _morton(F.col("x"), F.col("y"), F.col("z"))))
    size = F.lit(_FINEST_M) * F.pow(F.lit(4.0), F.col("_level"))

    def cube(axis: str, beside: Column = F.lit(0.0)) -> Column:
        return F.floor((F.col(axis) + beside) / size).cast("long")

    def packed(x: Column, y: Column, z: Column) -> Column:
        return (x + 2) * F.lit(1 << 42) + (y + 2) * F.lit(1 << 21) + z + 2

    reach = F.col("_d") * (1 + 1e-9) + 1e-6
    fits = F.ceil(F.log(2 * reach / _FINEST_M) / math.log(4.0))
    asks = settle(_some_distance(places, [group])
                  .join(places.where("_here > 1").select(group, "_lat", "_lon"), [group, "_lat", "_lon"], "left_anti")
                  .withColumn("_level", F.greatest(F.lit(0), F.least(F.lit(_LEVELS - 1), fits)).cast("int")))
    asked = asks.groupBy(group).agg(F.collect_set("_level").alias("_levels"))  # at most one per size
    offered = places.join(asked, group).withColumn("_level", F.explode("_levels")).select(
        group, "_level", packed(cube("x"), cube("y"), cube("z")).alias("_cell"), F.col("_lat").alias("_olat"), F.col("_lon").alias("_olon"))
    for axis in "xyz":
        asks = asks.withColumn(f"_c{axis}", F.explode(F.array_distinct(F.array(cube(axis, -reach), cube(axis, reach)))))
    asks = asks.select(group, "_level", packed(F.col("_cx"), F.col("_cy"), F.col("_cz")).alias("_cell"), "_lat", "_lon")
    apart = (F.col("_lat") != F.col("_olat")) | (F.col("_lon") != F.col("_olon"))
    metres = haversine(F.col("_lat"), F.col("_lon"), F.col("_olat"), F.col("_olon"), EARTH_M)
    found = asks.join(offered, [group, "_level", "_cell"]).where(apart).groupBy(group, "_lat", "_lon").agg(F.min(metres).alias("_metres"))
    crowded = places.where("_here > 1").select(group, "_lat", "_lon", F.lit(0.0).alias("_metres"))
    nearest = found.unionByName(crowded).withColumnsRenamed({"_lat": lat, "_lon": lon})
    nearest = nearest.withColumn("nearest_neighbor_m", F.col("_metres")).drop("_metres")
    return df.join(nearest, [group, lat, lon], "left").select(group, entity, *keep, "nearest_neighbor_m")


def radius_matches(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Rows of ``left`` with rows of ``right`` no farther than ``radius`` on a plane.

    Both sides carry plane coordinates: ``x``, ``y`` on the left and ``rx``, ``ry`` on the right.
    Cells are ``radius`` wide; the left side looks into the nine cells around it.
    """
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    asking = left.withColumn("_i", near).withColumn("_j", near).withColumns({
        "_cx": (F.floor(F.col("x") / radius) + F.col("_i")), "_cy": (F.floor(F.col("y") / radius) + F.col("_j"))})
    there = right.withColumns({"_cx": F.floor(F.col("rx") / radius), "_cy": F.floor(F.col("ry") / radius)})
    dx, dy = F.col("x") - F.col("rx"), F.col("y") - F.col("ry")
    return asking.drop("_i", "_j").join(there, ["_cx", "_cy"]).where(dx * dx + dy * dy <= radius * radius).drop("_cx", "_cy")


#: Segments of one cell that share a row key; a cell with more is dealt to several.
_CELL_SEGMENTS = 256


def segments_within(spots: DataFrame, dense: DataFrame, segment: str, radius: float) -> DataFrame:
    """The segments with a point no farther than ``radius`` from each spot, on a plane: ``x, y, segment``, each pair once.

    ``spots`` has distinct ``x``, ``y``, ``dense`` the segment and its points ``rx``, ``ry``. An index holds a row for each cell and segment, with those of
    its points that reach into the cell, so a spot looks into its own cell only and
    the join gives at most one row for a spot and a segment. Cells with many segments are dealt by hash of the segment.
    """
    edge = 4 * radius

    def cell(c: str, beside: float = 0.0) -> Column:
        return F.floor((F.col(c) + beside) / edge).cast("long")

    reached = dense
    for axis, name in (("rx", "_cx"), ("ry", "_cy")):
        reached = reached.withColumn(name, F.explode(F.array_distinct(F.array(cell(axis, -radius), cell(axis, radius)))))
    index = reached.groupBy("_cx", "_cy", segment).agg(F.collect_set(F.struct("rx", "ry")).alias("_points"))
    crowded = index.groupBy("_cx", "_cy").agg(F.ceil(F.count(F.lit(1)) / _CELL_SEGMENTS).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = index.join(crowded, ["_cx", "_cy"], "left").withColumn("_part", F.pmod(F.xxhash64(segment), parts))
    asking = spots.withColumns({"_cx": cell("x"), "_cy": cell("y")}).join(crowded, ["_cx", "_cy"], "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))))

    def near(p: Column) -> Column:
        dx, dy = F.col("x") - p["rx"], F.col("y") - p["ry"]
        return dx * dx + dy * dy <= radius * radius

    return asking.join(dealt.drop("_parts"), ["_cx", "_cy", "_part"]).where(F.exists("_points", near)).select("x", "y", segment)


def densify(df: DataFrame, line: str, points: str, spacing: float) -> DataFrame:
    """Polyline points plus evenly spaced points between them, one row each.

    ``points`` is an array of structs with ``lat`` and ``lon``. Between two points farther apart
    than ``spacing`` metres lie ``int(distance / spacing)`` extra points.
    """
    following = F.get(F.col("_all"), F.col("_pos") + 1)
    legs = df.select(line, F.col(points).alias("_all"), F.posexplode(points).alias("_pos", "_p"))
    legs = legs.select(line, F.col("_p.lat").alias("lat0"), F.col("_p.lon").alias("lon0"),
                       following["lat"].alias("lat1"), following["lon"].alias("lon1"))
    gap = F.hypot(local_east(F.col("lon1")) - local_east(F.col("lon0")),
                  local_north(F.col("lat1")) - local_north(F.col("lat0")))
    extra = F.when(gap > spacing, F.floor(gap / spacing).cast("int")).otherwise(F.lit(0))
    legs = legs.withColumn("_extra", F.coalesce(extra, F.lit(0)))
    legs = legs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_extra"))))
    share = F.col("_k") / (F.col("_extra") + 1)

    def between(start: str, end: str):
        return F.col(start) + F.coalesce(share * (F.col(end) - F.col(start)), F.lit(0.0))

    return legs.select(line, between("lat0", "lat1").alias("lat"), between("lon0", "lon1").alias("lon"))


def distinct_points(df: DataFrame, group: str, order: str, lat: str = "lat", lon: str = "lon", digits: int = 5) -> DataFrame:
    """First point of each group in every ``digits``-digit coordinate cell, by ``order``."""
    cell = [F.bround(F.col(lat), digits).alias("_clat"), F.bround(F.col(lon), digits).alias("_clon")]
    first = F.min_by(F.struct(lat, lon), F.col(order)).alias("_p")
    return df.groupBy(group, *cell).agg(first).select(group, F.col(f"_p.{lat}").alias(lat), F.col(f"_p.{lon}").alias(lon))


def longest_variant(df: DataFrame, group: str, variant: str) -> DataFrame:
    """Per group the variant with the most rows (ties: the smaller name), with its row count."""
    sizes = df.groupBy(group, variant).agg(F.count(F.lit(1)).alias("n_points"))
    return sizes.groupBy(group).agg(
        F.min_by(F.struct(variant, "n_points"), F.struct(-F.col("n_points"), F.col(variant))).alias("_v")
    ).select(group, "_v.*")


#: Tiles are this many reaches wide, so few places lie near a border. Places and segment points of one tile that share a row key.
_TILE_REACHES, _TILE_VISITS, _TILE_POINTS = 8, 1 << 20, 1 << 16

#: Visits beside a visit of the same group, as a mean, from which a group is crowded.
_BESIDE = 16

#: Pairs that a task holds at once, parts a range of counts is cut into, and sums it holds before it passes them on.
_PAIRS, _PARTS, _HELD = 2_000_000, 32, 1_000_000


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``start[i] .. start[i] + n[i] - 1`` for each i, in one row."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _chunks(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices of rows that stand for up to ``most`` pairs each, or for those of one row."""
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _whole(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """The rows of each tile; rows come in the order of their tiles."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("_tile").dictionary_encode()
        at = codes.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            here = codes.dictionary[int(at[a])].as_py()
            if held and here != name:
                yield name, pa.Table.from_batches(held)
                held = []
            name = here
            held.append(batch.slice(a, b - a))
    if held:
        yield name, pa.Table.from_batches(held)


class _Tile:
    """Places and segments of a tile, and which are near each other."""

    def __init__(self, rows: pa.Table, radius: float, most: int):
        self.most = most
        spots, segs = rows.filter(rows["_spot"]), rows.filter(pc.invert(rows["_spot"]))
        self.x, self.y = spots["x"].to_numpy(), spots["y"].to_numpy()
        self.n_segs = segs.num_rows
        rx, ry = _whole(segs["_rx"]), _whole(segs["_ry"])
        of = np.repeat(np.arange(self.n_segs), pc.list_value_length(rx).to_numpy(zero_copy_only=False))
        flat = rx.flatten().to_numpy(), ry.flatten().to_numpy()
        self.first, self.many, self.seg = self._near(*flat, of, radius)
        starts = np.r_[0, np.flatnonzero(np.diff(of)) + 1]
        # places farther apart than this along x, along y share no segment
        self.apart = [float((np.maximum.reduceat(v, starts) - np.minimum.reduceat(v, starts)).max()) * (1 + 1e-9) + 2 * radius + 1e-3 for v in flat]
        groups = _whole(spots["_groups"])
        names = groups.flatten().dictionary_encode()
        self.names, self.group = names.dictionary, names.indices.to_numpy().astype(np.int64)
        self.spot = np.repeat(np.arange(len(self.x)), pc.list_value_length(groups).to_numpy(zero_copy_only=False))
        # what each segment carries: nulls are told by a mask
        carried = [_whole(segs[c]) for c in ("_count", "_truck", "_length")]
        self.rows_of = pc.list_value_length(carried[0]).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first_row = np.cumsum(self.rows_of) - self.rows_of
        flat = [c.flatten() for c in carried]
        self.known = [c.is_valid().to_numpy(zero_copy_only=False) for c in flat]
        self.carries = [c.fill_null(0).to_numpy(zero_copy_only=False) for c in flat]

    def _near(self, rx: np.ndarray, ry: np.ndarray, of: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The segments with a point within ``radius`` of each place, through squares of that width."""
        edge = radius * 1.000001
        west, south = min(rx.min(), self.x.min()), min(ry.min(), self.y.min())
        px, py = (np.floor((v - o) / edge).astype(np.int64) + 1 for v, o in ((rx, west), (ry, south)))
        sx, sy = (np.floor((v - o) / edge).astype(np.int64) + 1 for v, o in ((self.x, west), (self.y, south)))
        wide = max(py.max(), sy.max()) + 3
        order = np.argsort(px * wide + py, kind="stable")
        squares = (px * wide + py)[order]
        beside = (sx[:, None] + np.array([-1, 0, 1])) * wide + sy[:, None]
        start = np.searchsorted(squares, beside - 1, "left")
        n = np.searchsorted(squares, beside + 1, "right") - start
        found = []
        for a, b in _chunks(n.sum(axis=1), self.most):
            at = order[_ranges(start[a:b].ravel(), n[a:b].ravel())]
            spot = np.repeat(np.arange(a, b), n[a:b].sum(axis=1))
            dx, dy = self.x[spot] - rx[at], self.y[spot] - ry[at]
            met = dx * dx + dy * dy <= radius * radius
            found.append(np.unique(spot[met] * self.n_segs + of[at[met]]))
        codes = np.concatenate(found)
        many = np.bincount(codes // self.n_segs, minlength=len(self.x))
        return np.cumsum(many) - many, many, codes % self.n_segs

    def meets(self) -> tuple[np.ndarray, np.ndarray, Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]]:
        """What each group meets, each segment once: group and place of the visits that bring all segments of the place, in the order of the
        groups; and group and segment of the rest, in chunks in the order of the groups.

        A visit brings all of its segments when no visit of its group before it, from west to east, is near enough to share one. Only for the others are
        segments compared. Groups that are crowded in the tile list and sort theirs.
        """
        use = np.flatnonzero(self.many[self.spot] > 0)
        use = use[np.lexsort((self.x[self.spot[use]], self.group[use]))]
        group, spot = self.group[use], self.spot[use]
        if not len(use):
            return group, spot, lambda: iter(())
        x, y = self.x[spot], self.y[spot]
        along = x - x.min()
        key = group * (along.max() + self.apart[0] + 1) + along
        here = np.arange(len(use))
        n = np.searchsorted(key, key + self.apart[0] * (1 + 1e-9) + 1e-3, "right") - here - 1
        n = np.minimum(n, np.searchsorted(group, group, "right") - here - 1)
        visits, beside = np.bincount(group), np.bincount(group, n)
        crowded = (beside > _BESIDE * visits)[group]
        n[crowded] = 0
        early, late = [], []
        for a, b in _chunks(n, self.most):
            i = np.repeat(here[a:b], n[a:b])
            j = _ranges(here[a:b] + 1, n[a:b])
            near = np.abs(y[i] - y[j]) <= self.apart[1]
            early.append(i[near])
            late.append(j[near])
        i, j = np.concatenate(early), np.concatenate(late)
        order = np.argsort(j, kind="stable")
        i, j = i[order], j[order]
        whole = ~crowded
        whole[j] = False

        def rest() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from self._sorted(group[crowded], spot[crowded])
            first = np.r_[0, np.flatnonzero(np.diff(j)) + 1] if len(j) else np.empty(0, np.int64)
            ends, some = np.r_[first[1:], len(j)], j[first]
            cost = np.maximum(self.many[spot[some]] + (np.add.reduceat(self.many[spot[i]], first) if len(first) else 0), self.n_segs // 32)
            for a, b in _chunks(cost, self.most):
                mine, other = some[a:b], i[first[a]:ends[b - 1]]
                seen = np.zeros((b - a) * self.n_segs, bool)
                row = np.repeat(np.arange(b - a), (ends - first)[a:b])
                m = self.many[spot[other]]
                seen[np.repeat(row * self.n_segs, m) + self.seg[_ranges(self.first[spot[other]], m)]] = True
                m = self.many[spot[mine]]
                seg = self.seg[_ranges(self.first[spot[mine]], m)]
                new = ~seen[np.repeat(np.arange(b - a) * self.n_segs, m) + seg]
                if new.any():
                    yield np.repeat(group[mine], m)[new], seg[new]

        return group[whole], spot[whole], rest

    def _sorted(self, group: np.ndarray, spot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Group and segment, each pair once, in the order of the groups, no group in two chunks."""
        n, start = self.many[spot], self.first[spot]
        goes_on = np.empty(0, np.int64)
        for a, b in _chunks(n, self.most):
            codes = np.unique(np.concatenate([goes_on, np.repeat(group[a:b], n[a:b]) * self.n_segs + self.seg[_ranges(start[a:b], n[a:b])]]))
            if b < len(group):
                cut = np.searchsorted(codes, group[b - 1] * self.n_segs)
                codes, goes_on = codes[:cut], codes[cut:]
            if len(codes):
                yield codes // self.n_segs, codes % self.n_segs

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Segment and count of each row with a count."""
        row = np.flatnonzero(self.known[0])
        return np.repeat(np.arange(self.n_segs), self.rows_of)[row], self.carries[0].astype(float)[row]

    def counts_near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the segments near each place, place by place: where those of a place begin, how many, each with its segment's place in the list."""
        seg, value = self.counts()
        n = np.bincount(seg, minlength=self.n_segs)
        start = np.cumsum(n) - n
        spot = np.repeat(np.arange(len(self.x)), self.many)
        at = _ranges(start[self.seg], n[self.seg])
        spot = np.repeat(spot, n[self.seg])
        many = np.bincount(spot, minlength=len(self.x))
        return np.cumsum(many) - many, many, spot, value[at]


_SUMS = ("length", "count_length", "count", "truck_length", "length_trucks", "truck")
_SUM_ROWS = ("x double, y double, n bigint, " + ", ".join(f"s_{c} double, n_{c} bigint" for c in _SUMS) + ", low double, high double, top bigint")


def _folded(how: np.ufunc, value: np.ndarray, first: np.ndarray, many: np.ndarray, none: float) -> np.ndarray:
    """``how`` over the ``many`` values of each row from ``first`` on, rows one after another; ``none`` for rows without one."""
    out = np.full(len(many), none, value.dtype)
    some = np.flatnonzero(many)
    if len(some):
        with np.errstate(all="ignore"):
            out[some] = how.reduceat(value, first[some])
    return out


def _sum_tiles(radius: float, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places that meet a segment (a row each, without a group), and the sums of each group of a tile."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _tiles(batches):
            if not 0 < pc.sum(rows["_spot"]).as_py() < rows.num_rows:
                continue
            tile = _Tile(rows, radius, _PAIRS)
            hit = np.flatnonzero(tile.many)
            yield _batch(schema, len(hit), x=tile.x[hit], y=tile.y[hit])
            (count, truck, length), (vc, vt, vl) = tile.carries, tile.known
            with np.errstate(all="ignore"):
                parts = [(length, vl), (count.astype(float) * length, vc & vl), (count.astype(float), vc), (truck * length, vt & vl), (length, vt & vl), (truck, vt)]
            real = count.astype(float)
            columns = [(np.add, np.ones(len(count), np.int64), 0, "n")]
            for name, (value, known) in zip(_SUMS, parts):
                columns += [(np.add, np.where(known, value, 0.0), 0, f"s_{name}"), (np.add, known.astype(np.int64), 0, f"n_{name}")]
            columns += [(np.maximum, np.where(vc, count, np.iinfo(np.int64).min), np.iinfo(np.int64).min, "top"),
                        (np.minimum, np.where(vc, real, np.inf), np.inf, "low"), (np.maximum, np.where(vc, real, -np.inf), -np.inf, "high")]
            group, spot, rest = tile.meets()
            of_seg = [_folded(how, value, tile.first_row, tile.rows_of, none) for how, value, none, _ in columns]
            of_spot = [_folded(how, value[tile.seg], tile.first, tile.many, none) for (how, _, none, _), value in zip(columns, of_seg)]
            out = {name: np.full(len(tile.names), none, value.dtype) for _, value, none, name in columns}
            with np.errstate(all="ignore"):
                for group, values in ((group, [v[spot] for v in of_spot]), *((g, [v[seg] for v in of_seg]) for g, seg in rest())):
                    if len(group):
                        at = np.r_[0, np.flatnonzero(np.diff(group)) + 1]
                        for (how, _, _, name), value in zip(columns, values):
                            out[name][group[at]] = how(out[name][group[at]], how.reduceat(value, at))
            met = np.flatnonzero(out["n"])
            out = {name: value[met] for name, value in out.items()}
            none = out["n_count"] == 0
            for name in ("top", "low", "high"):
                out[name] = pa.array(out[name], mask=none)
            if len(met):
                yield _batch(schema, len(met), _group=tile.names.take(pa.array(met)), **out)

    return summed


def _batch(schema: pa.Schema, size: int, /, **columns) -> pa.RecordBatch:
    made = [columns.get(f.name) for f in schema]
    return pa.RecordBatch.from_arrays([
        pa.nulls(size, f.type) if v is None else (v if isinstance(v, pa.Array) else pa.array(v)).cast(f.type) for f, v in zip(schema, made)], schema=schema)


#: A group asks for two neighbouring positions of two quantiles, so in at most so many ranges.
_ASKED = 4


#: Cuts that the counts of all groups are first told apart by, and places that are counted so at once.
_CUTS, _PLACES = 255, 1 << 15


def _count_cuts(cuts: list[float]) -> Callable[..., Callable]:
    """How many counts of a group lie between the cuts, packed into as few bytes as they need."""
    bins = len(cuts) + 1

    def job(radius: float, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def out(rows: dict, held: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            names, held = pa.array(list(rows), kind), held[:len(rows)]
            narrow = held.max(axis=1, initial=0)
            done = np.zeros(len(held), bool)
            for dtype in (np.uint8, np.uint16, np.int64):
                fits = np.flatnonzero(~done & (narrow <= np.iinfo(dtype).max))
                done[fits] = True
                for a in range(0, len(fits), 4096):
                    some = fits[a:a + 4096]
                    yield _batch(schema, len(some), _group=names.take(pa.array(some)), parts=pa.array([r.tobytes() for r in held[some].astype(dtype)], pa.binary()))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, held, kind = {}, np.zeros((0, bins), np.int64), schema.field("_group").type

            def add(where: np.ndarray, group: np.ndarray, parts: np.ndarray, row: np.ndarray) -> None:
                for a in range(0, len(group), _PLACES):
                    some = group[a:a + _PLACES]
                    at = np.r_[0, np.flatnonzero(np.diff(some)) + 1]
                    held[where[some[at]]] += np.add.reduceat(parts[row[a:a + _PLACES]], at, axis=0, dtype=np.int64)

            for _, laid in _tiles(batches):
                if not 0 < pc.sum(laid["_spot"]).as_py() < laid.num_rows:
                    continue
                tile = _Tile(laid, radius, _PAIRS)
                group, spot, rest = tile.meets()
                where = np.array([rows.setdefault(g, len(rows)) for g in tile.names.to_pylist()], np.int64)
                if len(rows) > len(held):
                    held = np.concatenate([held, np.zeros((max(len(rows) - len(held), len(held)), bins), np.int64)])
                seg, value = tile.counts()
                of_seg = np.bincount(seg * bins + np.searchsorted(cuts, value, "right"), minlength=tile.n_segs * bins).reshape(-1, bins)
                _, _, near, value = tile.counts_near()
                part = np.searchsorted(cuts, value, "right")
                for block in range(0, len(tile.x), _PLACES):  # few places at once, as each has all parts
                    stop = min(block + _PLACES, len(tile.x))
                    a, b = np.searchsorted(near, [block, stop])
                    of_spot = np.bincount((near[a:b] - block) * bins + part[a:b], minlength=(stop - block) * bins).reshape(-1, bins).astype(np.int32)
                    mine = (spot >= block) & (spot < stop)
                    add(where, group[mine], of_spot, spot[mine] - block)
                for group, seg in rest():
                    add(where, group, of_seg, seg)
                if len(rows) > _HELD // 8:
                    yield from out(rows, held, kind)
                    rows, held = {}, np.zeros((0, bins), np.int64)
            if rows:
                yield from out(rows, held, kind)

        return counted

    return job


def _places_between(cuts: list[float], least: float, most: float, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Between which cuts the asked positions of each group lie; rows come in the order of the groups."""
    bins = len(cuts) + 1
    low, high = np.r_[least, cuts], np.r_[np.array(cuts) - 1, most]

    def asked(names: list, held: np.ndarray) -> pa.RecordBatch:
        total = held.cumsum(axis=1)
        n = total[:, -1:]
        where = np.array([[end((m - 1) * p) for p in (0.5, 0.9) for end in (math.floor, math.ceil)] for m in n[:, 0].tolist()], np.int64).reshape(-1, _ASKED)
        part = (total[:, None, :] <= where[:, :, None]).sum(axis=2)
        below = np.take_along_axis(total - held, part, axis=1)
        keep = np.repeat(n[:, 0] > 0, _ASKED)
        part, k = part.ravel()[keep], (where - below).ravel()[keep]
        group = pa.array(names, schema.field("_group").type).take(pa.array(np.repeat(np.arange(len(names)), _ASKED)[keep]))
        return _batch(schema, len(k), _group=group, i=np.tile(np.arange(_ASKED), len(names))[keep], k=k, low=low[part], high=np.maximum(low, high)[part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = [], []
        for batch in batches:
            for name, packed in zip(batch.column("_group").to_pylist(), batch.column("parts").to_pylist()):
                row = np.frombuffer(packed, {1: np.uint8, 2: np.uint16, 8: np.int64}[len(packed) // bins]).astype(np.int64)
                if names and names[-1] == name:
                    held[-1] += row
                    continue
                if len(names) == 2048:
                    yield asked(names, np.array(held))
                    names, held = [], []
                names.append(name)
                held.append(row)
        if names:
            yield asked(names, np.array(held))

    return run


def _asked_counts(tile: _Tile, asks: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Counts within the ranges asked for, with the row that asks and the number of its range; ``asks`` has the row of each group of the tile."""
    group, spot, rest = tile.meets()
    group, spot = (c[asks[group] >= 0] for c in (group, spot))
    _, _, near, value = tile.counts_near()
    order = np.lexsort((value, near))
    near, value = near[order], value[order]
    known = np.unique(value)
    code = near * (len(known) + 1) + np.searchsorted(known, value)
    for j in range(_ASKED):
        at = asks[group]
        use = np.flatnonzero(low[at, j] < high[at, j])
        first, last = (np.searchsorted(code, spot[use] * (len(known) + 1) + np.searchsorted(known, bound[at[use], j], side), "left") for bound, side in ((low, "left"), (high, "right")))
        n = last - first
        for a, b in _chunks(n, tile.most):
            if n[a:b].any():
                yield value[_ranges(first[a:b], n[a:b])], np.repeat(at[use[a:b]], n[a:b]), j
    seg, value = tile.counts()
    n = np.bincount(seg, minlength=tile.n_segs)
    start = np.cumsum(n) - n
    for group, seg in rest():
        at = np.repeat(asks[group], n[seg])
        found = value[_ranges(start[seg], n[seg])]
        found, at = found[at >= 0], at[at >= 0]
        for j in range(_ASKED):
            inside = (found >= low[at, j]) & (found <= high[at, j]) & (low[at, j] < high[at, j])
            if inside.any():
                yield found[inside], at[inside], j


def _count_parts(radius: float, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many counts of a group lie in each part of the ranges it asks for, with the least and largest of them."""

    def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        code, n, least, most = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(code, kind="stable")
        code = code[order]
        at = np.flatnonzero(np.r_[True, np.diff(code) != 0])
        return code[at], np.add.reduceat(n[order], at), np.minimum.reduceat(least[order], at), np.maximum.reduceat(most[order], at)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, low, high, held, size = None, None, None, [], 0

        def out(code, n, least, most) -> pa.RecordBatch:
            range_ = code // _PARTS
            return _batch(schema, len(code), _group=asking.take(pa.array(range_ // _ASKED)), low=low.ravel()[range_], part=code % _PARTS, n=n, least=least, most=most)

        for name, rows in _tiles(batches):
            if not name:  # the ranges come first
                asking, lows, highs = _whole(rows["_group"]), _whole(rows["_rx"]), _whole(rows["_ry"])
                low, high = np.full((len(asking), _ASKED), np.inf), np.full((len(asking), _ASKED), -np.inf)
                n = pc.list_value_length(lows).to_numpy(zero_copy_only=False).astype(np.int64)
                where = np.repeat(np.arange(len(asking)), n), _ranges(np.zeros(len(n), np.int64), n)
                low[where], high[where] = lows.flatten().to_numpy(), highs.flatten().to_numpy()
                continue
            if asking is None or not 0 < pc.sum(rows["_spot"]).as_py() < rows.num_rows:
                continue
            tile = _Tile(rows, radius, _PAIRS)
            asks = pc.index_in(tile.names, value_set=asking).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            for value, at, j in _asked_counts(tile, asks, low, high):
                a, b = low[at, j], high[at, j]
                part = np.minimum(((value - a) / (b - a) * _PARTS).astype(np.int64), _PARTS - 1)
                held.append(merged([((at * _ASKED + j) * _PARTS + part, np.ones(len(value), np.int64), value, value)]))
                size += len(held[-1][0])
                if size > 2 * _HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > _HELD:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*merged(held))

    return counted


def _group_sums(visits: DataFrame, shapes: DataFrame, kind: str, radius: float) -> tuple[DataFrame, DataFrame]:
    """Sums over the different segments near each group's places, and the places near any segment.

    ``visits`` has ``x``, ``y`` and the groups that pass there (``_groups``, of type ``kind``), ``shapes`` a row for each segment: its points
    ``_rx``, ``_ry`` and lists of what it carries. A segment lies in one tile, by its middle, in the grid that fits its reach; a place
    goes to the tiles of segments that may reach it. So each pair of group and segment is met in one tile, where it is told
    apart and added up: pairs are neither shuffled nor written. Large tiles are dealt by hash of the group and of the segment.
    The positions of the quantiles are narrowed by counts: each pass cuts the ranges they lie in into parts.
    """
    tasks = _tasks(visits)
    tile = ["_level", "_cx", "_cy"]
    reach = F.lit(radius) * F.pow(F.lit(4.0), F.col("_level"))
    edge = reach * _TILE_REACHES
    half = [(F.array_max(c) - F.array_min(c)) / 2 for c in ("_rx", "_ry")]
    level = F.ceil(F.log(((F.greatest(*half) + radius) * (1 + 1e-9) + 1e-6) / radius) / math.log(4.0)).cast("int")
    middle = [(F.array_max(c) + F.array_min(c)) / 2 for c in ("_rx", "_ry")]
    shapes = shapes.withColumn("_level", level).withColumns({c: F.floor(m / edge) for c, m in zip(("_cx", "_cy"), middle)})
    levels = shapes.select("_level").distinct()  # a dozen at most, as each is four times as wide
    places = visits.where("x IS NOT NULL AND y IS NOT NULL AND abs(x) < double('infinity') AND abs(y) < double('infinity')")
    places = places.select("x", "y", "_groups").crossJoin(F.broadcast(levels))
    for c, name in (("x", "_cx"), ("y", "_cy")):
        places = places.withColumn(name, F.explode(F.array_distinct(F.array(F.floor((F.col(c) - reach) / edge), F.floor((F.col(c) + reach) / edge)))))
    deals = places.groupBy(*tile).agg(F.ceil(F.sum(F.size("_groups") + 1) / _TILE_VISITS).alias("_gs")).join(
        shapes.groupBy(*tile).agg(F.ceil(F.sum(F.size("_rx")) / _TILE_POINTS).alias("_ss")), tile)
    deals = settle(deals)

    def each(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))

    named = F.concat_ws(":", *tile, "_g", "_s").alias("_tile")
    mine = F.when(F.col("_gs") == 1, F.col("_groups")).otherwise(F.filter("_groups", lambda g: F.pmod(F.xxhash64(g), F.col("_gs")) == F.col("_g")))
    asking = places.join(deals, tile).withColumn("_g", each("_gs")).withColumn("_s", each("_ss")).select(
        named, F.lit(True).alias("_spot"), "x", "y", mine.alias("_groups"), "_g").where((F.size("_groups") > 0) | (F.col("_g") == 0)).drop("_g")
    there = shapes.join(deals, tile).withColumn("_s", F.pmod(F.xxhash64("_seg"), F.col("_ss"))).withColumn("_g", each("_gs")).select(
        named, F.lit(False).alias("_spot"), "_rx", "_ry", "_count", "_truck", "_length")
    rows = asking.unionByName(there, allowMissingColumns=True).withColumn("_task", F.pmod(F.xxhash64("_tile"), F.lit(tasks)).cast("int"))

    def walk(frame: DataFrame, job: Callable[..., Callable], columns: str) -> DataFrame:
        laid = frame.repartitionById(tasks, F.col("_task")).sortWithinPartitions("_tile")
        schema = f"_group {kind}, {columns}"
        return laid.mapInArrow(job(radius, to_arrow_schema(_parse_datatype_string(schema))), schema)

    sums = [F.sum(F.when(F.col(f"n_{c}") > 0, F.col(f"s_{c}"))).alias(f"s_{c}") for c in _SUMS]
    counts = [F.sum(f"n_{c}").alias(f"n_{c}") for c in _SUMS]
    found = settle(walk(rows, _sum_tiles, _SUM_ROWS).groupBy("_group", "x", "y").agg(
        F.sum("n").alias("n"), *sums, *counts, F.min("low").alias("low"), F.max("high").alias("high"), F.max("top").alias("top")))
    hit = found.where(F.col("_group").isNull()).select("x", "y").distinct()
    carried = found.where(F.col("_group").isNotNull()).drop("x", "y")

    places_of = [(F.col("n_count") - 1) * F.lit(p) for p in (0.5, 0.9)]
    counts_of = shapes.select(F.explode("_count").alias("c")).select(F.col("c").cast("double")).where("c IS NOT NULL")
    bounds = counts_of.agg(F.min("c").alias("least"), F.max("c").alias("most"),
                           F.percentile_approx("c", [i / (_CUTS + 1) for i in range(1, _CUTS + 1)], 10_000).alias("cuts")).first()
    cuts = sorted(set(bounds.cuts or []))
    state_kind = f"_group {kind}, i int, k bigint, low double, high double"
    packed = walk(rows, _count_cuts(cuts), "parts binary").repartition(tasks, "_group").sortWithinPartitions("_group")
    state = settle(packed.mapInArrow(_places_between(cuts, bounds.least or 0.0, bounds.most or 0.0, to_arrow_schema(_parse_datatype_string(state_kind))), state_kind))
    while state.where("low < high").limit(1).count():
        wide = state.where("low < high")
        ranges = wide.groupBy("_group").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("_r")).select(
            "_group", F.lit("").alias("_tile"), F.col("_r.low").alias("_rx"), F.col("_r.high").alias("_ry"),
            F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_task"))
        parts = walk(rows.unionByName(ranges, allowMissingColumns=True), _count_parts, "low double, part int, n bigint, least double, most double").groupBy(
            "_group", "low", "part").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        before = Window.partitionBy("_group", "low").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # few parts each
        parts = parts.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
        closer = wide.select("_group", "i", "k", "low").join(parts, ["_group", "low"]).where("below <= k AND k < below + n").select(
            "_group", "i", (F.col("k") - F.col("below")).alias("k"), F.col("least").alias("low"), F.col("most").alias("high"))
        state = settle(state.where("low >= high").unionByName(closer))
    at = [F.max(F.when(F.col("i") == i, F.col("low"))).alias(f"at{i}") for i in range(4)]
    carried = carried.join(state.groupBy("_group").agg(*at), "_group", "left")
    for i, (name, place) in enumerate(zip(("median_aadt", "p90_aadt"), places_of)):
        below, above = F.col(f"at{2 * i}"), F.col(f"at{2 * i + 1}")
        carried = carried.withColumn(name, below + (above - below) * (place - F.floor(place)))
    return carried, hit


def match_segments(points: DataFrame, segments: DataFrame, group: str, segment: str, radius: float = 30.0,
                   spacing: float = 15.0) -> DataFrame:
    """Traffic around each group's points: segments within ``radius`` metres, and what they carry.

    ``points`` has the group and lat, lon. ``segments`` has the segment id, ``points`` (array of
    lat/lon), ``count`` (whole numbers), ``truck_pct`` and ``length_ft``. Groups without any near segment stay.
    """
    dense = densify(segments, segment, "points", spacing).select(
        F.col(segment).alias("_seg"), local_east(F.col("lon")).alias("rx"), local_north(F.col("lat")).alias("ry"))
    finite = " AND ".join(f"{c} IS NOT NULL AND abs({c}) < double('infinity')" for c in ("rx", "ry"))
    lines = dense.where(finite).groupBy("_seg").agg(F.collect_set(F.struct("rx", "ry")).alias("_p"))
    carries = segments.groupBy(F.col(segment).alias("_seg")).agg(F.collect_list(F.struct(
        F.col("count").cast("bigint").alias("c"), F.col("truck_pct").cast("double").alias("t"), F.col("length_ft").cast("double").alias("l"))).alias("_c"))
    # a segment without an id is near a place, but carries nothing
    shapes = settle(lines.join(carries, "_seg", "left").withColumn("_c", F.coalesce("_c", F.filter(
        F.array(F.struct(*[F.lit(None).cast(k).alias(c) for c, k in (("c", "bigint"), ("t", "double"), ("l", "double"))])), lambda c: F.lit(False)))).select(
        "_seg", F.col("_p.rx").alias("_rx"), F.col("_p.ry").alias("_ry"), F.col("_c.c").alias("_count"), F.col("_c.t").alias("_truck"), F.col("_c.l").alias("_length")))
    # each distinct place is looked up once, whichever groups pass there; places without coordinates are dealt by group
    asking = points.select(F.col(group).alias("_group"), local_east(F.col("lon")).alias("x"), local_north(F.col("lat")).alias("y"))
    nowhere = F.when(F.col("x").isNull() | F.col("y").isNull(), F.pmod(F.xxhash64("_group"), F.lit(1000)))
    visits = settle(asking.groupBy("x", "y", nowhere.alias("_deal")).agg(
        F.collect_list("_group").alias("_groups"), F.count_if(F.col("_group").isNull()).cast("int").alias("_nameless")).drop("_deal"))
    carried, hit = _group_sums(visits, shapes, points.schema[group].dataType.simpleString(), radius)
    everyone = F.concat(F.col("_groups"), F.array_repeat(F.lit(None).cast(points.schema[group].dataType), F.col("_nameless")))
    rates = visits.join(hit.withColumn("_hit", F.lit(1)), ["x", "y"], "left").select(F.explode(everyone).alias("_group"), "_hit").groupBy("_group").agg(
        F.count(F.lit(1)).alias("n_route_points"), (F.count("_hit") / F.count(F.lit(1))).alias("match_rate"))
    total = F.col("s_length")
    carried = carried.select(
        "_group", F.col("n").alias("n_segments"), total.alias("total_length_ft"),
        F.when(total > 0, F.try_divide("s_count_length", total)).otherwise(F.try_divide("s_count", "n_count")).alias("weighted_aadt"),
        F.col("top").alias("max_aadt"),
        F.when(total > 0, F.try_divide("s_truck_length", F.nullif(F.col("s_length_trucks"), F.lit(0.0))))
        .otherwise(F.try_divide("s_truck", "n_truck")).alias("avg_truck_pct"), "median_aadt", "p90_aadt")
    out = rates.join(carried, "_group", "left").withColumnRenamed("_group", group)
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_segments", "max_aadt")}
    zero |= {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("total_length_ft", "weighted_aadt", "median_aadt", "p90_aadt")}
    return out.withColumns(zero)
