"""DuckDB SQL of the fills and repairs, written from their definitions: nearest cells by looking at all pairs of a tile."""

from __future__ import annotations

K = 'tile, "row", col'
_SAME = 'a.tile = b.tile and a."row" = b."row" and a.col = b.col'
_TOUCH = 'a.tile = b.tile and b."row" between a."row" - 1 and a."row" + 1 and b.col between a.col - 1 and a.col + 1'
_D2 = '((a."row" - b."row")**2 + (a.col - b.col)**2)'


def search(source: str, distance: float, passes: int, name: str) -> str:
    """CTEs: name (tile, row, col, v, f) from source (tile, row, col, v). f: v, or the nearest v of each quarter weighted by 1 / distance, smoothed; else 0."""
    quarters = [f'b."row" {v} a."row" and b.col {h} a.col' for v in ("<=", ">=") for h in ("<=", ">=")]
    found = ", ".join(
        f"min({_D2}) filter ({q}) as d{i}, arg_min(b.v, {{'d': {_D2}, 'x': abs(a.col - b.col)}}) filter ({q}) as v{i}" for i, q in enumerate(quarters)
    )
    total = " + ".join(f"coalesce(v{i} / sqrt(d{i}), 0)" for i in range(4))
    weight = " + ".join(f"coalesce(1 / sqrt(d{i}), 0)" for i in range(4))
    out = f""", {name}_q as (select a.tile, a."row", a.col, {found} from {source} a join {source} b
        on a.tile = b.tile and a.v is null and b.v is not null and {_D2} <= {distance} * {distance} group by 1, 2, 3),
      {name}_0 as (select a.tile, a."row", a.col, a.v, coalesce(a.v, ({total}) / nullif({weight}, 0)) as f from {source} a left join {name}_q b on {_SAME})"""
    for i in range(passes):
        out += f""", {name}_{i + 1} as (select a.tile, a."row", a.col, any_value(a.v) as v,
          case when any_value(a.v) is null and any_value(a.f) is not null then avg(b.f) else any_value(a.f) end as f
          from {name}_{i} a join {name}_{i} b on {_TOUCH} group by 1, 2, 3)"""
    return out + f", {name} as (select {K}, v, coalesce(f, 0) as f from {name}_{passes})"


def around(source: str, name: str, **counts: str) -> str:
    """CTE: source with counts over 3 x 3 cells of conditions on b."""
    sums = ", ".join(f"count(*) filter ({c}) as {n}" for n, c in counts.items())
    return f""", {name}_n as (select a.tile, a."row", a.col, {sums} from {source} a join {source} b on {_TOUCH} group by 1, 2, 3),
      {name} as (select a.*, {", ".join("b." + n for n in counts)} from {source} a join {name}_n b on {_SAME})"""


def small(source: str, hole: str, area: int, name: str, most: str = "0") -> str:
    """CTE: name (tile, row, col, area, most) of the cells of those areas of hole cells that have at most that many, with the largest
    value of most in it. Such an area is what can be reached in so many steps; larger ones reach more cells."""
    return f""", {name}_h as (select *, {most} as m from {source} where {hole}),
      {name}_w(tile, r0, c0, "row", col, m, step) as (select tile, "row", col, "row", col, m, 0 from {name}_h
        union select w.tile, w.r0, w.c0, h."row", h.col, h.m, w.step + 1 from {name}_w w join {name}_h h
        on h.tile = w.tile and abs(h."row" - w."row") + abs(h.col - w.col) = 1 where w.step < {area}),
      {name} as (select tile, r0 as "row", c0 as col, count(distinct "row" * 100000 + col) as area, max(m) as most from {name}_w group by 1, 2, 3
        having count(distinct "row" * 100000 + col) <= {area})"""


def nearest(source: str, name: str) -> str:
    """CTE: name (tile, row, col, d2, v): the nearest cell of source that has a v."""
    return f""", {name} as (select a.tile, a."row", a.col, min({_D2}) as d2, arg_min(b.v, {{'d': {_D2}, 'r': b."row", 'c': b.col}}) as v
      from {source} a left join {source} b on a.tile = b.tile and b.v is not null group by 1, 2, 3)"""


def median(source: str, size: int, name: str) -> str:
    """CTE: name (tile, row, col, v): the value of rank n // 2 of the n that are there among size x size cells, edge cells repeated."""
    steps = ", ".join(f"({k})" for k in range(-(size // 2), size // 2 + 1))
    return f""", {name}_e as (select tile, min("row") as r0, max("row") as r1, min(col) as c0, max(col) as c1 from {source} group by tile),
      {name}_p as (select s.tile, s."row", s.col, least(greatest(s."row" + dr, r0), r1) as r, least(greatest(s.col + dc, c0), c1) as c
        from {source} s join {name}_e e on s.tile = e.tile, (values {steps}) x(dr), (values {steps}) y(dc)),
      {name} as (select a.tile, a."row", a.col, list_sort(list(b.v) filter (b.v is not null))[count(b.v) // 2 + 1] as v
        from {name}_p a join {source} b on a.tile = b.tile and a.r = b."row" and a.c = b.col group by 1, 2, 3)"""


def _r(c: str, name: str) -> str:
    return f"round({c}, 6) + 0.0 as {name}"


def _ramp(c: str, low: float, high: float) -> str:
    return f"least(greatest((coalesce({c}, 0) - {low}) / {high - low}, 0), 1)"


def reference(cells: str, support: str) -> str:
    """CTEs up to done, with the outputs of the repaired elevation of cells; cells ends with a table of that name."""
    sql = cells + f""", r0 as (select *, dem is not null as valid, {support} or dem is not null as given from cells)"""
    sql += around("r0", "r1", near="b.valid", supported="b.given") + small("r1", "not given and near >= 4 and supported >= 4", 4, "gap")
    sql += f""", r2 as (select a.*, a.given or b.area is not null as support from r1 a left join gap b on {_SAME}),
      r3 as (select *, case when support then 0.7 * {_ramp('ground_density', 2, 5)} + 0.3 * {_ramp('ground_penetration_ratio', 0.03, 0.2)} else 0 end as confidence from r2),
      seen as (select {K}, dem as v from cells)""" + nearest("seen", "far")
    sql += f""", r4 as (select a.*, valid and confidence < 0.55 as low_confidence, support and not valid and coalesce(sqrt(b.d2) <= 48, false) as filled from r3 a join far b on {_SAME}),
      source as (select {K}, case when not low_confidence and not filled then dem end as v from r4)""" + search("source", 48, 1, "surface")
    sql += f""", r5 as (select a.*, case when low_confidence then confidence * dem + (1 - confidence) * f when filled then f when valid then dem end as z,
        case when filled then 1 when low_confidence then 1 - confidence else 0 end as weight from r4 a join surface b on {_SAME}),
      known as (select {K}, z as v from r5)""" + nearest("known", "whole") + median("whole", 3, "mid")
    sql += f""", r6 as (select a.* exclude (z, near), case when z is not null then (1 - least(weight * 0.75, 1)) * z + least(weight * 0.75, 1) * b.v end as z from r5 a join mid b on {_SAME})"""
    sql += around("r6", "r7", near="b.z is not null", touched='b.support and abs(a."row" - b."row") + abs(a.col - b.col) <= 1') + small("r7", "z is null", 8, "tiny", "near")
    sql += f""", r8 as (select a.*, coalesce(b.most >= 5, false) and touched > 0 as tiny_hole from r7 a left join tiny b on {_SAME}),
      last as (select {K}, z as v from r8)""" + search("last", 12, 1, "plug")
    return sql + f""", done as (select a.*, coalesce(z, case when tiny_hole then f end) as reference from r8 a join plug b on {_SAME})"""


def repaired(cells: str) -> str:
    """The tiles of cells, repaired in windows of 32 cells every 24; cells ends with tables cells and starts."""
    own = 'select s.tile || \'/\' || top || \'/\' || "left" as tile, c."row" - top as "row", c.col - "left" as col, c.tile as t, c."row" as r, c.col as c'
    near = 'c."row" >= top and c."row" < top + 32 and c.col >= "left" and c.col < "left" + 32'
    sql = cells + f""", w as ({own}, coalesce(dem, dsm) as z, dem is not null as valid, dsm, ground_density as g, ground_penetration_ratio as p from starts s join cells c on c.tile = s.tile and {near}),
      src as (select {K}, case when valid then z end as v from w)""" + search("src", 64, 1, "s") + nearest("src", "nr")
    line, column = 'partition by tile, "row" order by col', 'partition by tile, col order by "row"'
    step = lambda w: f"case when lag(f) over ({w}) is null and lead(f) over ({w}) is null then 0 when lag(f) over ({w}) is null then lead(f) over ({w}) - f when lead(f) over ({w}) is null then f - lag(f) over ({w}) else (lead(f) over ({w}) - lag(f) over ({w})) / 2 end"
    sql += f""", felt as (select {K}, f, {step(line)} as gx, {step(column)} as gy from s),
      all_of as (select w.*, f, sqrt(gx * gx + gy * gy) as slope, d2, abs(dsm - f) as h from w join felt a using (tile, "row", col) join nr b using (tile, "row", col)),
      spans as (select tile, min(h) as lo, max(h) as hi, coalesce(avg(z), 0) as mean, greatest(coalesce(stddev_pop(z), 1), 1e-6) as std from all_of group by tile),
      known as (select *, case when valid then 1 else least(greatest(0.5 * exp(-sqrt(d2) / 24) + 0.35 * least(greatest(p, 0), 1)
        + 0.15 * (1 - coalesce((h - lo) / nullif(hi - lo, 0), 0)), 0), 1) end as conf from all_of join spans using (tile))"""
    guess = "(f - mean) / std + 0.0625 * slope + 0.125 * conf - 0.25 * ln(1 + g) / 3.5"
    return sql + f""" select t as tile, r as "row", c as col, {_r(f"avg(case when valid then z else ({guess}) * std + mean end)", "predicted")}, count(*) as covers from known group by 1, 2, 3"""


def sql(cells: str, patches: str, starts: str) -> dict[str, str]:
    """cells and patches: recursive CTEs that end with a table cells and patch. starts: a CTE with the corners of windows."""
    holes = around("cells", "flagged", near="b.dem is not null", supported="b.all_density > 1")
    gappy = patches + f', v as (select {K}, case when z <= 0 then z end as v from patch)'
    found = {
        "search_fill": cells + f", v as (select {K}, dem as v from cells)" + search("v", 64, 1, "s") + f" select {K}, {_r('f', 'filled')} from s",
        "tiny_holes": cells + holes + small("flagged", "dem is null", 8, "tiny", "near")
        + f' select a.tile, a."row", a.col, coalesce(b.most >= 5, false) and all_density > 0 as tiny_hole from flagged a left join tiny b on {_SAME}',
        "promote_gaps": cells + holes + small("flagged", "all_density <= 1 and near >= 4 and supported >= 4", 4, "gap")
        + f' select a.tile, a."row", a.col, all_density > 1 or b.area is not null as promoted from flagged a left join gap b on {_SAME}',
        "reference_dem": reference(cells, "all_density > 0")
        + f" select {K}, {_r('reference', 'reference')}, valid, support, low_confidence, filled, tiny_hole, {_r('weight', 'repair_weight')}, {_r('confidence', 'confidence')} from done",
    }
    found["patch_in_place"] = (
        cells + f", a1 as (select {K}, dsm as v from cells), b1 as (select {K}, mean_intensity as v from cells)" + nearest("a1", "a2") + nearest("b1", "b2")
        + f' select a.tile, a."row", a.col, a.v as dsm, {_r("b.v", "mean_intensity")} from a2 a join b2 b on {_SAME}'
    )
    counted = ", ".join(f"count({b}) as {b}_there, count(*) - count({b}) as {b}_missing" for b in ("dem", "dsm", "mean_return_num"))
    found["written_counters"] = cells + f" select count(*) as cells, {counted} from cells"
    found["repair_tiles"] = repaired(cells + starts)
    same = ["all_density", "ground_density", "vegetation_density", "building_density"]
    rounded = [_r(c, c) for c in ("mean_intensity", "mean_return_num", "last_return_ratio", "ground_penetration_ratio")]
    found["raster_build"] = reference(cells, "all_density > 0") + f", top as (select {K}, dsm as v from cells)" + nearest("top", "high") + f"""
      select a.tile, a."row", a.col, {_r('dem', 'dem_raw')}, {_r('reference', 'dem_reference')}, b.v as dsm, {', '.join(same + rounded)}, valid as dem_valid_mask, support as dem_support_mask,
      low_confidence as dem_lowconf_mask, tiny_hole as dem_tinyhole_mask, {_r('weight', 'dem_repair_weight')}, {_r('confidence', 'dem_confidence')} from done a join high b on {_SAME}"""
    for size in (5, 7):
        found[f"median_filter_{size}"] = gappy + median("v", size, "m") + f" select {K}, {_r('v', 'median')} from m"
    return found
