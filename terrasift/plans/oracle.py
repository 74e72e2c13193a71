"""DuckDB SQL with the rows of the queries, written on its own from their definitions."""

from __future__ import annotations

from . import oracle_fill

_POINTS = """points as (select * from (
  select case when l_orderkey % 2 = 0 then '001' else '002' end as tile,
    cast((l_orderkey*7 + l_partkey*3 + l_linenumber*11) % 64 as double) + cast(cast(floor(l_quantity) as bigint) % 64 as double)/64 as x,
    cast((l_orderkey*5 + l_suppkey*13 + l_linenumber*17) % 64 as double) + cast(cast(round(l_extendedprice*100) as bigint) % 64 as double)/64 as y,
    cast(cast(floor(l_extendedprice) as bigint) % 16384 as double)/64 as z,
    cast((l_partkey*37 + l_suppkey*101) % 65536 as double) as intensity,
    case when l_returnflag='A' and l_linestatus='F' and l_linenumber<=2 then 2 when l_returnflag='N' then 5
         when l_returnflag='R' and l_linestatus='O' then 6 else 1 end as cls,
    l_linenumber as return_num, max(l_linenumber) over (partition by l_orderkey) as num_returns
  from lineitem) where not (cls = 2 and (x-20)*(x-20) + (y-44)*(y-44) < 81))"""
_GRID = _POINTS + """, grids as (select tile, floor(min(x)) as cx, ceil(max(y)) as cy, floor(min(x)) - 0.5 as west, ceil(max(y)) + 0.5 as north,
    cast(floor(max(x) - floor(min(x))) + 1 as int) as width, cast(floor(ceil(max(y)) - min(y)) + 1 as int) as height from points group by tile),
  placed as (select p.*, cast(floor(north - y) as int) as "row", cast(floor(x - west) as int) as col from points p join grids g using (tile)
    where floor(north - y) between 0 and height - 1 and floor(x - west) between 0 and width - 1),
  spine as (select tile, "row", unnest(range(0, width))::int as col from (select tile, width, unnest(range(0, height))::int as "row" from grids))"""
_CELLS = "with " + _GRID + """, bands as (select tile, "row", col, count(*) as n, count(*) filter (cls = 2) as ng, count(*) filter (cls = 5) as nv, count(*) filter (cls = 6) as nb,
    avg(z) filter (cls = 2) as dem, max(z) as dsm, avg(intensity) as mi, avg(return_num) as mr, avg(case when return_num = num_returns then 1.0::double else 0 end) as lr
    from placed where cls in (2, 5, 6) group by all),
  cells as (select s.tile, s."row", s.col, coalesce(n, 0)::double as all_density, coalesce(ng, 0)::double as ground_density, coalesce(nv, 0)::double as vegetation_density,
    coalesce(nb, 0)::double as building_density, dem, dsm, mi as mean_intensity, mr as mean_return_num, coalesce(lr, 0) as last_return_ratio,
    case when coalesce(n, 0) > 0 then ng::double / greatest(n, 1) else 0 end as ground_penetration_ratio from spine s left join bands b on s.tile = b.tile and s."row" = b."row" and s.col = b.col) """
_PATCH = """with patch as (select vec_id as tile, cast((i - 1) // 8 as int) as "row", cast((i - 1) % 8 as int) as col, cast(embedding[i] as double) as z,
    (i - 1) // 8 between 2 and 4 and (i - 1) % 8 between 2 and 5 as mask from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings))"""
_PAIRS = _PATCH + """, pairs as (select tile, "row", col, z as gt, case when mask then z * 0.75 else z + 0.125 end as pred, z * 0.5 as first, mask::int::double as m from patch) """
_WINDOWS = 'window wr as (partition by tile, "row" order by col), wc as (partition by tile, col order by "row")'
_K = 'tile, "row", col'


def _r(c: str, name: str, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0 as {name}"


def _diff(z: str, w: str) -> str:
    b, a = f"lag({z}) over {w}", f"lead({z}) over {w}"
    return f"case when {b} is null and {a} is null then 0 when {b} is null then {a} - {z} when {a} is null then {z} - {b} else ({a} - {b}) / 2 end"


def _u(seed_name: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'0|{seed_name}'", *[f"cast({k} as varchar)" for k in keys]])
    return f"(cast(concat('0x', substr(md5({text}), 1, 8)) as bigint) / 4294967296.0::double)"


def _near(source: str) -> str:
    """Nearest valid cell of each cell, by looking at all pairs of a tile."""
    return f""", near as (select c.tile, c."row", c.col, min((c."row" - v."row")**2 + (c.col - v.col)**2) as d2,
      arg_min(v.v, {{'d': (c."row" - v."row")**2 + (c.col - v.col)**2, 'r': v."row", 'c': v.col}}) as v from {source} c join (select {_K}, v from {source} where v is not null) v on c.tile = v.tile group by 1, 2, 3) """


def _features(radii: tuple[int, ...]) -> str:
    """felt: the filled cells (near) as z with gradients, second differences, and extremes of squares of each radius."""
    span = lambda f, c, r, w: f"{f}({c}) over ({w} rows between {r} preceding and {r} following)"
    line, column = 'partition by tile, "row" order by col', 'partition by tile, col order by "row"'
    wide = "".join(f", {span('max', 'v', r, line)} as a{r}, {span('min', 'v', r, line)} as b{r}" for r in radii)
    square = "".join(f", {span('max', f'a{r}', r, column)} as hi{r}, {span('min', f'b{r}', r, column)} as lo{r}" for r in radii)
    kept = "".join(f", hi{r}, lo{r}" for r in radii)
    return f""", first as (select {_K}, v as z, {_diff("v", "wr")} as gx, {_diff("v", "wc")} as gy{wide} from near {_WINDOWS}),
      felt as (select {_K}, z, gx, gy, {_diff("gx", "wr")} as xx, {_diff("gy", "wc")} as yy{square} from first {_WINDOWS}) """


def _areas(hole: str) -> str:
    """Components of cells that a condition on flagged picks: areas, and labels of their cells."""
    return f""", hole as (select tile, "row", col, "row"::bigint * 4294967296 + col as id from flagged where {hole}),
  links as (select a.tile, a.id as a, b.id as b from hole a join hole b on a.tile = b.tile and ((b."row" = a."row" and abs(b.col - a.col) = 1) or (b.col = a.col and abs(b."row" - a."row") = 1))),
  walk as (select tile, id, id as label from hole union select w.tile, l.b, w.label from walk w join links l on l.tile = w.tile and l.a = w.id where w.label < l.b),
  labels as (select tile, id, min(label) as label from walk group by all), areas as (select tile, label, count(*) as area from labels group by all) """


_GAPS = _PATCH.replace("with ", "with recursive ", 1) + ', cells as (select tile, "row", col, case when z <= 0 then z end as dem from patch)'
_HOLES = ", flagged as (select * from cells)" + _areas("dem is null")
_RCELLS = _CELLS.replace("with ", "with recursive ", 1)


def _errors(by: str) -> str:
    return f"""{by} avg(abs(pred - gt)) as mae, sqrt(avg((pred - gt) * (pred - gt))) as rmse, sum(abs(pred - gt) * m) / greatest(sum(m), 1) as mask_mae,
      sqrt(sum((pred - gt) * (pred - gt) * m) / greatest(sum(m), 1)) as mask_rmse"""


_ROUNDED = ", ".join(_r(c, c) for c in ("mae", "rmse", "mask_mae", "mask_rmse"))
_L1 = "sum(abs(pred - gt) * m) / greatest(sum(m), 1) as hole_l1, sum(abs(pred - gt) * (1 - m)) / greatest(sum(1 - m), 1) as valid_l1, avg(abs(pred - gt)) as l1, sum(abs(first - gt) * m) / greatest(sum(m), 1) as first_l1"
_GRAD = f""", g as (select tile, abs((lead(pred) over wr - pred) - (lead(gt) over wr - gt)) as dx, greatest(m, lead(m) over wr) * (lead(m) over wr * 0 + 1) as wx,
    abs((lead(pred) over wc - pred) - (lead(gt) over wc - gt)) as dy, greatest(m, lead(m) over wc) * (lead(m) over wc * 0 + 1) as wy from pairs {_WINDOWS}),
  grad as (select tile, sum(dx * wx) / greatest(sum(wx), 1) + sum(dy * wy) / greatest(sum(wy), 1) as grad_loss from g group by tile)"""
_lap = lambda b: f"coalesce(lag({b}) over wr, 0) + coalesce(lead({b}) over wr, 0) + coalesce(lag({b}) over wc, 0) + coalesce(lead({b}) over wc, 0) - 4 * {b}"
_CURV = f""", k as (select tile, m, abs(({_lap("pred")}) - ({_lap("gt")})) as d from pairs {_WINDOWS}), curv as (select tile, sum(d * m) / greatest(sum(m), 1) as curvature_loss from k group by tile)"""
_STARTS = """, starts as (select tile, t as top, l as "left" from (select tile, width, unnest(list_distinct(case when height <= 32 then [0] else list_concat(range(0, height - 31, 24), [height - 32]) end)) as t from grids) a,
    lateral (select unnest(list_distinct(case when width <= 32 then [0] else list_concat(range(0, width - 31, 24), [width - 32]) end)) as l) b) """
_W = [2.718281828459045 ** (-0.5 * (k / 0.5) ** 2) for k in (-2, -1, 0, 1, 2)]
_W = [w / sum(_W) for w in _W]


def _smooth() -> str:
    weights = ", ".join(f"({k}, {w!r}::double)" for k, w in zip((-2, -1, 0, 1, 2), _W, strict=True))
    step = lambda src, at, other: f"""select tile, c."{other}", c."{at}", sum(w * v) as v from (select tile, "row", col, k, w, ("{at}" + k + 16) % 16 as pm from {src}, weights) c
      join (select tile, "{other}" as o, "{at}" as a, v from {src}) n using (tile) where n.o = c."{other}" and n.a = case when pm < 8 then pm else 15 - pm end group by 1, 2, 3"""  # noqa: E731
    return f"""{_PATCH}, weights(k, w) as (values {weights}), base as (select tile, "row", col, z as v from patch), a as ({step("base", "col", "row")}), b as ({step("a", "row", "col")})
      select {_K}, {_r("v", "smooth")} from b"""


def _void(strategy: str) -> str:
    """Voids of 8 shapes with radius 1 or 2 over patches: targets of 5 to 22 % of 64 cells."""
    size = lambda n: f"1 + floor({_u(n, 'tile', 'k')} * 2)"
    even = f"""select tile, k, cast(floor({_u("row", "tile", "k")} * 8) as int) as ar, cast(floor({_u("col", "tile", "k")} * 8) as int) as ac from (select distinct tile from patch), (select unnest(range(1, 9)) as k)"""
    if strategy == "vegetation_priority":
        even = f"""select d.tile, k, l."row" as ar, l.col as ac from (select tile, k, total * {_u("weight", "tile", "k")} as u from (select tile, sum(w) as total from heavy group by tile) h, (select unnest(range(1, 9)) as k)) d
          join line l on l.tile = d.tile and d.u >= l.lo and d.u < l.lo + l.w"""
    covers = f'power("row" - ar, 2) + power(col - ac, 2) <= power({size("radius")}, 2)'
    if strategy == "block":
        covers = f'"row" >= ar and "row" < ar + {size("high")} and col >= ac and col < ac + {size("wide")}'
    return f"""{_PATCH}, heavy as (select *, floor(abs(z) * 64) as w from patch), line as (select *, sum(w) over (partition by tile order by "row", col) - w as lo from heavy),
      shapes as ({even}), firsts as (select p.tile, p."row", p.col, min(k) as k from patch p join shapes s using (tile) where {covers} group by 1, 2, 3),
      news as (select tile, k, count(*) as n from firsts group by all), run as (select *, coalesce(sum(n) over (partition by tile order by k rows between unbounded preceding and 1 preceding), 0) as got from news),
      used as (select tile, k from run where got < greatest(floor(64 * (0.05 + 0.17 * {_u("target", "tile")})), 1))
      select p.tile, p."row", p.col, u.k is not null as void from patch p left join firsts f on p.tile = f.tile and p."row" = f."row" and p.col = f.col left join used u on f.tile = u.tile and f.k = u.k"""


_CDF: list[float] = []
_t, _s = 2.718281828459045**-2.0, 0.0
for _i in range(20):
    _s += _t
    _CDF.append(_s)
    _t *= 2.0 / (_i + 1)

ORACLE_SQL = {
    "class_histogram": f"with {_POINTS} select tile, cls, count(*) as n from points group by all",
    "class_masks": f"with {_POINTS} select tile, count(*) filter (cls = 2) as n_ground, count(*) filter (cls = 5) as n_vegetation, count(*) filter (cls = 6) as n_building from points group by tile",
    "tile_headers": f"with {_POINTS} select tile, count(*) as point_count, min(x) as min_x, min(y) as min_y, min(z) as min_z, max(x) as max_x, max(y) as max_y, max(z) as max_z from points group by tile",
    "grid_spec": f"with {_GRID} select tile, cx as center_min_x, cy as center_max_y, west, north, width, height from grids",
    "cell_stats": _CELLS + f"select {_K}, all_density, ground_density, vegetation_density, building_density, {_r('dem', 'dem')}, dsm, {_r('mean_intensity', 'mean_intensity')}, {_r('mean_return_num', 'mean_return_num')}, {_r('last_return_ratio', 'last_return_ratio')}, {_r('ground_penetration_ratio', 'ground_penetration_ratio')}, ground_density > 0 as dem_valid_mask from cells",
    **{f"rasterize_{how}": f"with {_GRID} select s.tile, s.\"row\", s.col, {_r(f'coalesce(v, {0 if how in ("count", "sum") else "null"})', 'v')} from spine s left join (select tile, \"row\", col, {agg}::double as v from placed where cls = 2 group by all) b on s.tile = b.tile and s.\"row\" = b.\"row\" and s.col = b.col" for how, agg in (("count", "count(*)"), ("sum", "sum(z)"), ("mean", "avg(z)"), ("max", "max(intensity)"))},
    "tile_stats": _CELLS + f"select tile, count(*) as n_cells, count(*) filter (all_density > 0) as support, count(dem) as valid, count(dsm) as surface, max(dsm) as max_dsm, {_r('min(dem)', 'min_dem')}, greatest(count(*) filter (all_density > 0) - count(dem), 0) as unresolved from cells group by tile",
    "source_precedence": "select cast(p_partkey % 50 as varchar) as tile, case when bool_or(p_partkey % 3 = 0) then 'reference' else 'default' end as source from part group by p_partkey % 50",
    "skip_done": "select c_custkey as tile from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderkey % 3 = 0)",
    "nodata_round_trip": f"{_PATCH} select {_K}, {_r('case when mask then -9999.0::double else z end', 'stored')}, {_r('case when mask then null else z end', 'back')} from patch",
    "hole_mask": f"{_PATCH} select tile, count(*) filter (mask) as holes, count(*) filter (not mask) as valid from patch group by tile",
    "quality_rules": _CELLS + f""", s as (select tile, count(*)::double as n, sum((dem is null)::int) as dem0, sum((dsm is null)::int) as dsm0, sum((mean_intensity is null)::int) as int0, sum((mean_return_num is null)::int) as ret0,
          min(dem) as dem1, max(dem) as dem2, min(dsm) as dsm1, max(dsm) as dsm2, count(*) filter (dsm < dem - 1) as low from cells group by tile),
        v(tile, rule, severity, raster, value, hit) as (
          select tile, 'missing_core', 'error', 'dem', dem0 / n, dem0 > 0 from s union all select tile, 'missing_core', 'error', 'dsm', dsm0 / n, dsm0 > 0 from s
          union all select tile, 'missing_most', 'error', 'mean_intensity', int0 / n, int0 / n > 0.5 from s union all select tile, 'missing_most', 'error', 'mean_return_num', ret0 / n, ret0 / n > 0.5 from s
          union all select tile, 'missing_some', 'warning', 'mean_intensity', int0 / n, int0 / n > 0.05 and int0 / n <= 0.5 from s union all select tile, 'missing_some', 'warning', 'mean_return_num', ret0 / n, ret0 / n > 0.05 and ret0 / n <= 0.5 from s
          union all select tile, 'span', 'warning', 'dem', dem2 - dem1, dem2 - dem1 > 5000 from s union all select tile, 'span', 'warning', 'dsm', dsm2 - dsm1, dsm2 - dsm1 > 5000 from s
          union all select tile, 'deep', 'warning', 'dem', dem1, dem1 < -500 from s union all select tile, 'dsm_below_dem', 'warning', 'dsm', low / n, low / n > 0.1 from s)
        select tile, rule, severity, raster, {_r('value', 'value')} from v where hit""",
    "quality_status": _CELLS + "select tile, case when count(*) > count(dem) or count(*) > count(dsm) then 'FAIL' else 'OK' end as status from cells group by tile",
    "slope": f"{_PATCH}, g as (select {_K}, {_diff('z', 'wr')} as gx, {_diff('z', 'wc')} as gy from patch {_WINDOWS}) select {_K}, {_r('sqrt(gx * gx + gy * gy)', 'slope')} from g",
    "curvature": f"{_PATCH}, g as (select {_K}, {_diff('z', 'wr')} as gx, {_diff('z', 'wc')} as gy from patch {_WINDOWS}), h as (select {_K}, {_diff('gx', 'wr')} as xx, {_diff('gy', 'wc')} as yy from g {_WINDOWS}) select {_K}, {_r('xx + yy', 'curvature')} from h",
    "openness_multi": f'{_PATCH}, o as (select a.tile, a."row", a.col, any_value(a.z) as z, ' + ", ".join(f'max(b.z) filter (abs(a."row" - b."row") <= {r} and abs(a.col - b.col) <= {r}) as hi{r}, min(b.z) filter (abs(a."row" - b."row") <= {r} and abs(a.col - b.col) <= {r}) as lo{r}' for r in (3, 7, 15, 31)) + f" from patch a join patch b using (tile) group by 1, 2, 3) select {_K}, " + ", ".join(_r(f'z - (hi{r} + lo{r}) / 2', f'openness_s{i}') for i, r in enumerate((3, 7, 15, 31), 1)) + " from o",
    "neighbor_count": _CELLS + 'select a.tile, a."row", a.col, count(*) filter (b.ground_density > 0) as neighbors from cells a join cells b on a.tile = b.tile and b."row" between a."row" - 1 and a."row" + 1 and b.col between a.col - 1 and a.col + 1 group by 1, 2, 3',
    "boundary_band": f"""{_PATCH}, d as (select a.tile, a."row", a.col, any_value(a.mask) as mask, min(abs(a."row" - b."row") + abs(a.col - b.col)) filter (not b.mask) as i, min(abs(a."row" - b."row") + abs(a.col - b.col)) filter (b.mask) as o from patch a join patch b using (tile) group by 1, 2, 3)
        select {_K}, case when mask then least(i, "row" + 1, col + 1, 8 - "row", 8 - col) <= 1 else o <= 2 end as boundary_band from d""",
    "dilate": _CELLS + 'select a.tile, a."row", a.col, bool_or(b.ground_density > 0) as near_ground from cells a join cells b on a.tile = b.tile and b."row" between a."row" - 2 and a."row" + 2 and abs(a."row" - b."row") + abs(a.col - b.col) <= 2 group by 1, 2, 3',
    "median_filter": f"""{_PATCH}, o as (select a.tile, a."row", a.col, list_sort(list(b.z)) as nine from (select {_K}, least(greatest("row" + dr, 0), 7) as r, least(greatest(col + dc, 0), 7) as c from patch, (values (-1), (0), (1)) x(dr), (values (-1), (0), (1)) y(dc)) a
        join patch b on a.tile = b.tile and b."row" = a.r and b.col = a.c group by 1, 2, 3) select {_K}, {_r('nine[5]', 'median')} from o""",
    "gaussian_filter": _smooth(),
    "edt": _CELLS + ', v as (select tile, "row", col, dem as v from cells)' + _near("v") + f"select {_K}, {_r('sqrt(d2)', 'distance')} from near",
    "nearest_fill": _CELLS + ', v as (select tile, "row", col, dem as v from cells)' + _near("v") + f"select {_K}, {_r('v', 'filled')} from near",
    "idw_fill": _GAPS + f""", w as (select a.tile, a."row", a.col, sum(b.dem / ((a."row" - b."row")**2 + (a.col - b.col)**2)) / sum(1 / ((a."row" - b."row")**2 + (a.col - b.col)**2)) as v from cells a join cells b on a.tile = b.tile and a.dem is null and b.dem is not null
        and b."row" between a."row" - 2 and a."row" + 2 and (a."row" - b."row")**2 + (a.col - b.col)**2 <= 4 group by 1, 2, 3) select c.tile, c."row", c.col, {_r('coalesce(c.dem, w.v, 0)', 'idw')} from cells c left join w on c.tile = w.tile and c."row" = w."row" and c.col = w.col""",
    "label_components": _GAPS + _HOLES + "select * from areas",
    "fill_small_holes": _GAPS + _HOLES + ', v as (select tile, "row", col, dem as v from cells)' + _near("v") + f"""select c.tile, c."row", c.col, {_r('coalesce(c.dem, case when a.area <= 8 then n.v end)', 'filled')} from cells c join near n on c.tile = n.tile and c."row" = n."row" and c.col = n.col
        left join labels l on l.tile = c.tile and l.id = c."row"::bigint * 4294967296 + c.col left join areas a on a.tile = l.tile and a.label = l.label""",
    "confidence_map": f"""{_PATCH}, d as (select a.tile, a."row", a.col, any_value(a.z) as z, any_value(a.mask) as mask, sqrt(min((a."row" - b."row")**2 + (a.col - b.col)**2)) as d from patch a join patch b on a.tile = b.tile and not b.mask group by 1, 2, 3),
        h as (select *, min(abs(z * 2 - z)) over (partition by tile) as lo, max(abs(z * 2 - z)) over (partition by tile) as hi from d)
        select {_K}, {_r("case when mask then least(greatest(0.5 * exp(-d / 24.0::double) + 0.35 * least(abs(z), 1) + 0.15 * (1 - coalesce((abs(z * 2 - z) - lo) / nullif(hi - lo, 0), 0)), 0), 1) else 1.0::double end", "confidence")} from h""",
    "display_stretch": f"{_PATCH}, s as (select tile, quantile_cont(z, 0.02) as lo, quantile_cont(z, 0.98) as hi from patch group by tile) select {_K}, cast(floor(coalesce(least(greatest((z - lo) / nullif(hi - lo, 0), 0), 1), 0) * 255) as int) as grey from patch join s using (tile)",
    "sliding_positions": f"with {_GRID}{_STARTS} select tile, top::int as top, \"left\"::int as \"left\", printf('%s_r%05d_c%05d', tile, top, \"left\") as sample_id from starts",
    "window_validity": _CELLS + _STARTS + f'select tile, top::int as top, "left"::int as "left", {_r("valid_ratio", "valid_ratio")} from (select s.tile, s.top, s."left", count(dsm) / 1024.0::double as valid_ratio from starts s join cells c on c.tile = s.tile and c."row" >= top and c."row" < top + 32 and c.col >= "left" and c.col < "left" + 32 group by all) where valid_ratio >= 0.5',
    "window_blend": _CELLS + _STARTS + f'select c.tile, c."row", c.col, {_r("case when count(dsm) = count(*) then avg(dsm + (c.\"row\" - top) - (c.col - \"left\")) end", "blended")}, count(*) as covers from starts s join cells c on c.tile = s.tile and c."row" >= top and c."row" < top + 32 and c.col >= "left" and c.col < "left" + 32 group by 1, 2, 3',
    "flip": f'{_PATCH} select tile, 7 - "row" as "row", 7 - col as col, {_r("z", "z")} from patch',
    "block_round_trip": f"{_PATCH} select {_K}, {_r('z', 'z')}, mask from patch",
    "void_strategy": f"select distinct vec_id as tile, ['irregular', 'block', 'vegetation_priority'][1 + cast(floor({_u('strategy', 'vec_id')} * 3) as int)] as strategy from embeddings",
    **{f"void_{s}": _void(s) for s in ("irregular", "block", "vegetation_priority")},
    "void_points_poisson": f"""{_PATCH}, n as (select *, len(list_filter([{", ".join(f"{x!r}::double" for x in _CDF)}], lambda x: x <= {_u("n", "tile", '"row"', "col")})) as n from patch where mask), p as (select *, unnest(range(1, n + 1))::int as i from n where n > 0)
        select {_K}, i, {_r(f"col + {_u('x', 'tile', chr(34) + 'row' + chr(34), 'col', 'i')}", "x")}, {_r(f"-({chr(34)}row{chr(34)} + {_u('y', 'tile', chr(34) + 'row' + chr(34), 'col', 'i')})", "y")}, {_r("z", "z")} from p""",
    "normalize_dem": f"{_PATCH}, v as (select {_K}, case when not mask then z end as z from patch), s as (select tile, avg(z) as m, case when stddev_pop(z) > 1e-6 then stddev_pop(z) else 1 end as d from v group by tile) select {_K}, {_r('(coalesce(z, m) - m) / d', 'out')} from v join s using (tile)",
    "normalize_density": _CELLS + f", s as (select tile, quantile_cont(ln(1 + all_density), 0.99) as q from cells group by tile) select {_K}, {_r('ln(1 + all_density) / greatest(q, 1)', 'out')} from cells join s using (tile)",
    "normalize_feature": f"{_PATCH}, v as (select {_K}, case when not mask then z * 8 end as z from patch), s as (select tile, avg(z) as m, quantile_cont(abs(z), 0.95) as q from v group by tile) select {_K}, {_r('coalesce(z, m) / greatest(q, 1)', 'out')} from v join s using (tile)",
    "normalize_ratio": f"{_PATCH} select {_K}, {_r('least(greatest(z, 0), 1)', 'out')} from patch",
    "masked_mae_rmse": _PAIRS + f"select tile, {_ROUNDED} from (select {_errors('tile,')} from pairs group by tile)",
    "slope_rmse": _PAIRS + f""", s as (select tile, lead(pred) over wr - pred as px, lead(pred) over wc - pred as py, lead(gt) over wr - gt as gx, lead(gt) over wc - gt as gy, "row", col from pairs {_WINDOWS}),
        d as (select s.tile, sqrt(px * px + py * py) - sqrt(gx * gx + gy * gy) as d, m.m from s join pairs m on m.tile = s.tile and m."row" = s."row" + 1 and m.col = s.col + 1)
        select tile, {_r('sqrt(sum(d * d * m) / greatest(sum(m), 1))', 'slope_rmse')} from d group by tile""",
    "masked_l1": _PAIRS + f"select tile, {_r('hole_l1', 'hole_l1')}, {_r('valid_l1', 'valid_l1')}, {_r('l1', 'l1')} from (select tile, {_L1} from pairs group by tile)",
    "grad_loss": _PAIRS + _GRAD + f" select tile, {_r('grad_loss', 'grad_loss')} from grad",
    "curvature_loss": _PAIRS + _CURV + f" select tile, {_r('curvature_loss', 'curvature_loss')} from curv",
    "total_loss": _PAIRS + _GRAD + _CURV + f", l as (select tile, {_L1} from pairs group by tile) select tile, {_r('hole_l1 + 0.5 * first_l1 + 0.1 * valid_l1 + 0.2 * grad_loss + 0.5 * curvature_loss', 'loss')} from l join grad using (tile) join curv using (tile)",
    "adversarial_losses": f"{_PATCH} select {_r('avg((z / 2 - 1) * (z / 2 - 1))', 'generator_loss')}, {_r('0.5 * (avg((z - 1) * (z - 1)) + avg(z / 2 * z / 2))', 'discriminator_loss')} from patch",
    "eval_rollup": _PAIRS + f""", b as (select tile // 16 as batch, count(distinct tile) as n, {_errors('')} from pairs group by 1), r as (select 'batches' as scope, sum(mae * n) / sum(n) as mae, sum(rmse * n) / sum(n) as rmse, sum(mask_mae * n) / sum(n) as mask_mae, sum(mask_rmse * n) / sum(n) as mask_rmse from b
        union all select 'global', {_errors('')} from pairs) select scope, {_ROUNDED} from r""",
    "stream_cell_stats": "with " + _GRID + f" select {_K}, count(*) as n, count(*) filter (cls = 2) as n_ground, {_r('avg(z) filter (cls = 2)', 'dem')}, max(z) as dsm from placed where cls in (2, 5, 6) group by all",
    "tile_metadata": _CELLS + 'select tile, (max("row") + 1)::int as height, (max(col) + 1)::int as width, 1.0::double as resolution, 2 as bands from cells group by tile',
    "matched_tiles": "select 't' || p_partkey as tile, 't' || p_partkey || '_dem' as dem, 't' || p_partkey || '_dsm' as dsm from part",
    "tile_sources": f"""{_PATCH} select {_K}, {_r("case when tile % 2 = 1 then z when not mask then z * 2 end", "z")},
        case when tile % 3 = 0 then col > 3 else tile % 2 = 1 or not mask end as valid from patch""",
    "terrain_features": _CELLS + ', v as (select tile, "row", col, dem as v from cells)' + _near("v") + _features((3, 7)) + f"""
        select {_K}, {_r("sqrt(gx * gx + gy * gy)", "slope")}, {_r("xx + yy", "curvature")}, {_r("z - (hi3 + lo3) / 2", "openness_s1")}, {_r("z - (hi7 + lo7) / 2", "openness_s2")} from felt""",
    "terrain_stack": _CELLS + ', v as (select tile, "row", col, dem as v from cells)' + _near("v") + _features((3, 7, 15, 31)) + f""",
        d as (select a.tile, a."row", a.col, any_value(a.v is null) as mask, min(abs(a."row" - b."row") + abs(a.col - b.col)) filter (b.v is not null) as i,
          min(abs(a."row" - b."row") + abs(a.col - b.col)) filter (b.v is null) as o from v a join v b using (tile) group by 1, 2, 3),
        edges as (select *, max("row") over (partition by tile) as last_row, max(col) over (partition by tile) as last_col from d)
        select f.tile, f."row", f.col, {_r("z", "z")}, {_r("sqrt(gx * gx + gy * gy)", "slope")}, {_r("xx + yy", "curvature")},
          {", ".join(_r(f"z - (hi{r} + lo{r}) / 2", f"openness_s{i}") for i, r in enumerate((3, 7, 15, 31), 1))}, mask,
          case when mask then least(i, e."row" + 1, e.col + 1, last_row + 1 - e."row", last_col + 1 - e.col) <= 2 else coalesce(o <= 2, false) end as boundary_band
        from felt f join edges e on e.tile = f.tile and e."row" = f."row" and e.col = f.col""",
    "patch_missing": _CELLS + ', v as (select tile, "row", col, dsm as v from cells)' + _near("v") + ', v2 as (select tile, "row", col, mean_intensity as v from cells)' + _near("v2").replace("near as", "near2 as") + f"""
        select tile, 'dsm' as band, (select count(*) from cells c where c.tile = n.tile and dsm is null) as filled, {_r("sum(v)", "total", 3)} from near n group by tile
        union all select tile, 'mean_intensity', (select count(*) from cells c where c.tile = n.tile and mean_intensity is null), {_r("sum(v)", "total", 3)} from near2 n group by tile""",
    "band_table": f"{_PATCH} select {_K}, 'z' as band, {_r('z', 'value')} from patch union all select {_K}, 'm', mask::int::double from patch",
    "shape_rules": "select vec_id as tile, case when vec_id % 7 = 0 then 'lacking' else 'shape' end as rule, 'm' as raster from embeddings where vec_id % 7 = 0 or vec_id % 5 = 0",
    "mask_coverage": f"{_PATCH} select tile, {_r('avg((mask and z > 0)::int::double)', 'coverage')} from patch group by tile",
    "mask_ratio_filter": f"{_PATCH} select tile, {_r('q', 'mask_ratio')} from (select tile, avg((mask and z > 0)::int::double) as q from patch group by tile) where q between 0.05 and 0.125",
    "dem_metrics": _PAIRS + f""", s as (select tile, lead(pred) over wr - pred as px, lead(pred) over wc - pred as py, lead(gt) over wr - gt as gx, lead(gt) over wc - gt as gy, "row", col from pairs {_WINDOWS}),
        d as (select s.tile, sqrt(px * px + py * py) - sqrt(gx * gx + gy * gy) as d, m.m from s join pairs m on m.tile = s.tile and m."row" = s."row" + 1 and m.col = s.col + 1),
        e as (select tile, sqrt(sum(d * d * m) / greatest(sum(m), 1)) as slope_rmse from d group by tile), p as (select {_errors('tile,')} from pairs group by tile)
        select tile, {_ROUNDED}, {_r('slope_rmse', 'slope_rmse')} from p join e using (tile)""",
    "denormalize_dem": f"{_PATCH}, s as (select tile, avg(z) as m from patch where not mask group by tile) select {_K}, {_r('case when mask then m else m + (z - m) / 2 end', 'back')} from patch join s using (tile)",
    "channel_stack": f"{_PATCH} select {_K}, {_r('case when mask then z * 2 else z end', 'c0')}, {_r('z * 2', 'c1')}, mask::int::double as c2, 0.0::double as c3 from patch",
    "padded_windows": _CELLS + f""", starts as (select distinct tile, t as top, l as "left" from (select tile, width, unnest(case when height <= 72 then [0] else list_concat(range(0, height - 71, 40), [height - 72]) end) as t from grids) a,
          lateral (select unnest(case when width <= 72 then [0] else list_concat(range(0, width - 71, 40), [width - 72]) end) as l) b)
        select s.tile, top::int as top, "left"::int as "left", 5184::bigint as places, count(all_density) as cells, {_r("sum(dsm)", "dsm", 3)}, (top + 71)::int as last
        from starts s join cells c on c.tile = s.tile and c."row" between top and top + 71 and c.col between "left" and "left" + 71 group by s.tile, top, "left\"""",
    "sample_meta": f"""with {_GRID}{_STARTS} select printf('%s_r%05d_c%05d', tile, top, "left") as sample_id,
        '{{"sample_id":"' || printf('%s_r%05d_c%05d', tile, top, "left") || '","tile_id":"' || tile || '","row":' || top || ',"col":' || "left" || ',"resolution":1.5}}' as meta from starts""",
    "first_samples": f"with {_GRID}{_STARTS} select printf('%s_r%05d_c%05d', tile, top, \"left\") as sample_id from starts order by 1 limit 3",
    "best_epoch": """with h as (select (year(o_orderdate) * 12 + month(o_orderdate))::int as epoch, round(avg(o_totalprice), 2) as loss from orders group by 1),
        b as (select *, min(loss) over (order by epoch rows between unbounded preceding and 1 preceding) as best_before from h)
        select epoch, loss, best_before, best_before is null or loss < best_before as improved from b""",
    "split_samples": f"{_PATCH} select {_K}, {_r('z', 'z')} from patch where tile % 10 = 0",
    "tile_summary": _CELLS + """, p as (select tile, count(*) as total_points, count(*) filter (cls in (2, 5, 6)) as surface_points, count(*) filter (cls = 2) as ground_points from points group by tile)
        select tile, (max(col) + 1)::int as grid_width, (max("row") + 1)::int as grid_height, count(dem) as observed_cells, count(*) filter (dem is null) as missing_cells,
          count(*) filter (all_density > 0) as support_cells, count(*) filter (dem is not null and ground_density < 2) as low_confidence_cells,
          count(*) filter (all_density > 0 and dem is null) as tiny_hole_cells, count(dem) as reference_cells, any_value(total_points) as total_points, any_value(surface_points) as surface_points,
          any_value(ground_points) as ground_points, greatest(count(*) filter (all_density > 0) - count(dem), 0) as unresolved_cells from cells join p using (tile) group by tile""",
    "predict_tiles": _CELLS + _STARTS + """, v as (select s.tile || '/' || top || '/' || "left" as tile, c."row" - top as "row", c.col - "left" as col, dem as v, c.tile as t, c."row" as r, c.col as c
          from starts s join cells c on c.tile = s.tile and c."row" >= top and c."row" < top + 32 and c.col >= "left" and c.col < "left" + 32)""" + _near("v") + _features(()) + f"""
        select t as tile, r as "row", c as col, {_r("avg(case when v.v is null then f.z + sqrt(gx * gx + gy * gy) * 0.0625 else v.v end)", "predicted")}, count(*) as covers
        from v join felt f on f.tile = v.tile and f."row" = v."row" and f.col = v.col group by 1, 2, 3""",
}
ORACLE_SQL |= oracle_fill.sql(_RCELLS, _PATCH, _STARTS)
ORACLE_SQL["stream_las_cells"] = ORACLE_SQL["stream_cell_stats"]
ORACLE_SQL["las_headers"] = "with " + _POINTS + """ select tile, count(*) as point_count, min(x) as min_x, min(y) as min_y, min(z) as min_z,
    max(x) as max_x, max(y) as max_y, max(z) as max_z from points group by tile"""
ORACLE_SQL["las_round_trip"] = "with " + _POINTS + """ select tile, cls, count(*) as n, sum(x) as sum_x, sum(y) as sum_y, sum(z) as sum_z,
    cast(sum(intensity) as bigint) as sum_intensity, cast(sum(return_num) as bigint) as sum_return_num, cast(sum(num_returns) as bigint) as sum_num_returns
    from points group by tile, cls"""
ORACLE_SQL["raster_round_trip"] = _CELLS + " " + " union all ".join(
    f"""select tile, '{b}' as band, "row", col, round(cast({b} as float)::double, 3) + 0.0 as v from cells""" for b in ("dsm", "all_density", "mean_return_num")
)
ORACLE_SQL["raster_headers"] = "with " + _GRID + " select tile, height, width, 1.0::double as resolution, west, north, -9999.0::double as nodata, 'f4' as dtype from grids"
