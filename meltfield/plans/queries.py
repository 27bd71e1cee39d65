"""Registered queries of the engine over the shared test tables, with DuckDB SQL for the same rows.

Inputs are bound to the tables by plain expressions that both engines read alike (``*_SQL`` below); everything after
that goes through the operators on one side and through independent SQL on the other.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltfield.functions import geometry as G
from meltfield.operators import mask, morphology, spectral
from meltfield.operators.components import ensure_checkpoint_dir
from meltfield.schema import GridSpec, MeltPoolSpec
from meltfield.sinks.vti import slabs, vti_order
from meltfield.sources import grid as grids
from meltfield.sources import scan, synthetic
from meltfield.sources.hatch import ScanStrategy
from meltfield.sources.series import as_series, read_data

# ---- inputs ----------------------------------------------------------------------------------------------------------

SCAN_ROWS_SQL = """select cast(user_id % 20 as string) as file_id, event_id as seq, case when event_id % 5 = 0 then 1 else 0 end as mode,
cast((event_id * 37) % 1000 as double) + 0.25 as x, cast((event_id * 91) % 700 as double) as y, cast((user_id % 20) * 30 as double) as z, cast(200 as double) as power,
case when event_id % 5 = 0 then 1 + cast(event_id % 7 as double) / 8 else cast(1 + event_id % 3 as double) end as param from events"""

VECTORS_SQL = """select s_suppkey as vector_id, cast((s_suppkey * 17) % 90 as double) + 0.37 as sx, cast((s_suppkey * 29) % 60 as double) + 0.11 as sy,
cast(((s_suppkey * 7) % 5) * 6 as double) + 0.2 as sz, cast((s_suppkey * 17) % 90 + (s_suppkey * 13) % 21 - 10 as double) + 0.37 as ex,
cast((s_suppkey * 29) % 60 + (s_suppkey * 11) % 17 - 8 as double) + 0.11 as ey, cast(((s_suppkey * 7) % 5) * 6 as double) + 0.2 + cast(s_suppkey % 3 as double) / 2 as ez,
cast(s_suppkey as double) / 2 as t0, cast(s_suppkey as double) / 2 + 1 as t1 from supplier"""

SERIES_SQL = """select event_type as series_id, row_number() over (partition by event_type order by event_id) - 1 as n,
cast(row_number() over (partition by event_type order by event_id) - 1 as double) / 1000 as t, 148 + (value - 50) / 5 as value from events"""

PORES_SQL = """select distinct cast(l_partkey % 400 as int) as ix, cast(l_suppkey as int) as iy, cast(l_quantity as int) as iz from lineitem"""
PORE_NY, PORE_NZ, PORE_S = 100003, 64, 0.5

EFFECTS_SQL = """select n_name as name, case when n_nationkey % 3 = 0 then null else cast(100 + 10 * n_nationkey as double) end as length_scale_m,
case when n_nationkey % 3 = 0 then cast(5 + n_nationkey as double) else null end as frequency_hz, cast(1 + n_regionkey as double) as sigma_weight from nation"""

GRID = GridSpec.from_box(2.0, [[0.13, 0.29, 0.07], [100.13, 70.29, 30.07]])
POOL = MeltPoolSpec(
    {
        "width": ((8.0, 0.0, 0.0), (1.0, 0.21, 0.4), (0.5, 0.07, 1.1)),
        "depth": ((6.0, 0.0, 0.0), (0.7, 0.21, 0.0), (0.4, 0.07, 0.0)),
        "height": ((4.0, 0.0, 0.0), (0.5, 0.21, 0.0), (0.2, 0.07, 0.0)),
    },
    2.0, 1.0, 2.0,
)
STRATEGY = ScanStrategy(((0.0, 0.0, 0.0), (500.3, 410.7, 300.1)), 200.0, 1.7, 14.0, 30.0, 67.0, 51.0, 0)


def _sql(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f" from {table}", " from {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def scan_rows(spark, sf_dir):
    return _sql(spark, sf_dir, "events", SCAN_ROWS_SQL)


def vectors(spark, sf_dir):
    return _sql(spark, sf_dir, "supplier", VECTORS_SQL)


def series(spark, sf_dir):
    return _sql(spark, sf_dir, "events", SERIES_SQL)


def pores(spark, sf_dir):
    at = _sql(spark, sf_dir, "lineitem", PORES_SQL)
    return at.select(((F.col("ix").cast("long") * PORE_NY + F.col("iy")) * PORE_NZ + F.col("iz")).alias("voxel_id"), "ix", "iy", "iz")


def prepared(spark, sf_dir):
    return G.prepare(vectors(spark, sf_dir), POOL)


def r(name: str, digits: int = 6):
    """Rounded, and never a negative zero."""
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


# ---- SQL pieces ------------------------------------------------------------------------------------------------------


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0 as {n}" for n in names)


def d(value: float) -> str:
    return f"cast({value!r} as double)"


FRAME = f"""frame0 as (select *, ex - sx as dx, ey - sy as dy, ez - sz as dz, (sx + ex) / 2 as cx, (sy + ey) / 2 as cy, (sz + ez) / 2 as cz, t1 - t0 as duration from ({VECTORS_SQL})),
frame1 as (select *, sqrt(dx * dx + dy * dy) as lxy, dx * dx + dy * dy + dz * dz as len2 from frame0),
frame as (select *, case when lxy < 1e-12 then 1.0::double else -dy / lxy end as e0x, case when lxy < 1e-12 then 0.0::double else dx / lxy end as e0y,
  case when lxy < 1e-12 then 0.0::double else dx / lxy end as e1x, case when lxy < 1e-12 then 1.0::double else dy / lxy end as e1y from frame1),
vec as (select *, least(sx, ex) - {d(POOL.maximum('width') / 2)} as xmin, greatest(sx, ex) + {d(POOL.maximum('width') / 2)} as xmax, least(sy, ey) - {d(POOL.maximum('width') / 2)} as ymin,
  greatest(sy, ey) + {d(POOL.maximum('width') / 2)} as ymax, least(sz, ez) - {d(POOL.maximum('depth'))} as zmin, greatest(sz, ez) + {d(POOL.maximum('height'))} as zmax,
  {d(POOL.maximum('width') / 2)} as l0, lxy / 2 as l1, greatest({d(POOL.maximum('height'))}, {d(POOL.maximum('depth'))}) as l2 from frame)"""


def voxel_cte(grid: GridSpec) -> str:
    nx, ny, nz = grid.shape
    o, s = grid.origin, [grid.step(a) for a in range(3)]
    return f"""vox as (select (i * {ny} + j) * {nz} + k as voxel_id, i::int as ix, j::int as iy, k::int as iz, {d(o[0])} + i * {d(s[0])} as x, {d(o[1])} + j * {d(s[1])} as y, {d(o[2])} + k * {d(s[2])} as z
  from range({nx}) a(i), range({ny}) b(j), range({nz}) c(k))"""


AABB = "vox.x between vec.xmin and vec.xmax and vox.y between vec.ymin and vec.ymax and vox.z between vec.zmin and vec.zmax"
OBB = """((x - cx) * e0x + (y - cy) * e0y) * ((x - cx) * e0x + (y - cy) * e0y) <= l0 * l0 and ((x - cx) * e1x + (y - cy) * e1y) * ((x - cx) * e1x + (y - cy) * e1y) <= l1 * l1"""


def modal_sql(dim: str, t: str = "t") -> str:
    return " + ".join(f"{d(a)} * cos({d(2 * math.pi * f)} * {t} + {d(p)})" for (a, f, _), p in zip(POOL.modes[dim], POOL.phases))


PAIRS = f"""pair0 as (select * from vox join vec on {AABB} where {OBB}),
pair1 as (select *, case when len2 > 1e-24 then greatest(0.0::double, least(1.0::double, ((x - sx) * dx + (y - sy) * dy + (z - sz) * dz) / len2)) else 0.0::double end as tf from pair0),
pair as (select *, t0 + tf * (t1 - t0) as t, (x - (sx + tf * dx)) * e0x + (y - (sy + tf * dy)) * e0y as local_y, z - (sz + tf * dz) as local_z from pair1)"""
MELTED = f"""dims as (select *, {modal_sql('width')} as w, case when local_z >= 0 then {modal_sql('height')} else {modal_sql('depth')} end as b, case when local_z >= 0 then {d(POOL.height_shape)} else {d(POOL.depth_shape)} end as n from pair),
melted as materialized (select distinct voxel_id from dims where (local_y / (w / 2)) * (local_y / (w / 2)) + pow(abs(local_z) / b, n) <= 1)"""
MASK = f"with {FRAME}, {voxel_cte(GRID)}, {PAIRS}, {MELTED}"

PORE_CTE = f"""with recursive por as materialized (select (ix::bigint * {PORE_NY} + iy) * {PORE_NZ} + iz as id, ix, iy, iz from ({PORES_SQL})),
off as (select a.v as a, b.v as b, c.v as c from range(-1, 2) a(v), range(-1, 2) b(v), range(-1, 2) c(v) where not (a.v = 0 and b.v = 0 and c.v = 0)),
step as materialized (select p.id as src, p.ix + o.a as jx, p.iy + o.b as jy, p.iz + o.c as jz from por p, off o),
nbr as materialized (select s.src, q.id as dst from step s join por q on q.ix = s.jx and q.iy = s.jy and q.iz = s.jz),
reach as (select id, id as root from por union select nbr.dst, reach.root from reach join nbr on nbr.src = reach.id),
roots as materialized (select id, min(root) as root from reach group by id),
lab as materialized (select roots.id as voxel_id, dense_rank() over (order by root) as label, ix, iy, iz from roots join por using (id)),
big as materialized (select * from lab where label in (select label from lab group by label having count(*) >= 2))"""


# ---- queries ---------------------------------------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


TIMELINE = f"""prev as (select *, lag(x) over w as px, lag(y) over w as py, lag(z) over w as pz from ({SCAN_ROWS_SQL}) window w as (partition by file_id order by seq)),
dts as (select *, case when mode = 1 then param when px is null then 0.0::double when param > 1e-12 then sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) / param else 0.0::double end as dt from prev),
timed as (select *, sum(dt) over (partition by file_id order by seq rows unbounded preceding) as t1 from dts)"""


@query(f"with {TIMELINE} select file_id, seq, mode, {rs('dt', 't1')} from timed")
def scan_read_timeline(spark, sf_dir):
    return scan.timeline(scan_rows(spark, sf_dir)).select("file_id", "seq", "mode", r("dt"), r("t1"))


@query(f"""with {TIMELINE} select file_id, count(*) filter (where mode = 1) as n_delay, round(coalesce(sum(dt) filter (where mode = 1), 0), 6) + 0 as delay_time,
count(*) filter (where mode = 0 and px is not null) as n_vectors from timed group by file_id""")
def scan_delay_rows(spark, sf_dir):
    t = scan.timeline(scan_rows(spark, sf_dir))
    delay = t.groupBy("file_id").agg(F.count(F.when(F.col("mode") == 1, 1)).alias("n_delay"), F.coalesce(F.sum(F.when(F.col("mode") == 1, F.col("dt"))), F.lit(0.0)).alias("delay_time"))
    emitted = scan.raster_vectors(t).groupBy(F.col("file_id").alias("fid")).agg(F.count("*").alias("n"))
    return delay.join(emitted, F.col("file_id") == F.col("fid"), "left").select("file_id", "n_delay", r("delay_time"), F.coalesce("n", F.lit(0)).alias("n_vectors"))


@query(f"with {TIMELINE} select file_id, seq, {rs('px', 'py', 'pz', 'x', 'y', 'z', 't0', 't1')} from (select *, lag(t1) over (partition by file_id order by seq) as t0 from timed) where mode = 0 and px is not null".replace("px, 6) + 0 as px", "px, 6) + 0 as sx").replace("py, 6) + 0 as py", "py, 6) + 0 as sy").replace("pz, 6) + 0 as pz", "pz, 6) + 0 as sz").replace("(x, 6) + 0 as x", "(x, 6) + 0 as ex").replace("(y, 6) + 0 as y", "(y, 6) + 0 as ey").replace("(z, 6) + 0 as z", "(z, 6) + 0 as ez"))
def scan_vectors(spark, sf_dir):
    v = scan.raster_vectors(scan.timeline(scan_rows(spark, sf_dir)))
    return v.select("file_id", "seq", *[r(c) for c in ("sx", "sy", "sz", "ex", "ey", "ez", "t0", "t1")])


@query(f"with {FRAME} select vector_id, {rs('dx', 'dy', 'dz', 'cx', 'cy', 'cz', 'duration', 'e0x', 'e0y', 'e1x', 'e1y')} from frame")
def vector_frame(spark, sf_dir):
    return G.with_frame(vectors(spark, sf_dir)).select("vector_id", *[r(c) for c in ("dx", "dy", "dz", "cx", "cy", "cz", "duration", "e0x", "e0y", "e1x", "e1y")])


@query(f"with {FRAME} select vector_id, {rs('xmin', 'xmax', 'ymin', 'ymax', 'zmin', 'zmax')} from vec")
def vector_bounds_aabb(spark, sf_dir):
    return prepared(spark, sf_dir).select("vector_id", *[r(c) for c in ("xmin", "xmax", "ymin", "ymax", "zmin", "zmax")])


@query(f"with {FRAME} select vector_id, {rs('l0', 'l1', 'l2')} from vec")
def vector_bounds_obb(spark, sf_dir):
    return prepared(spark, sf_dir).select("vector_id", r("l0"), r("l1"), r("l2"))


@query(f"with {voxel_cte(GRID)} select voxel_id, ix, iy, iz, {rs('x', 'y', 'z')} from vox")
def grid_from_box(spark, sf_dir):
    return grids.voxels(spark, GRID).select("voxel_id", "ix", "iy", "iz", r("x"), r("y"), r("z"))


@query(f"""with ends as (select min(least(sx, ex)) as lx, min(least(sy, ey)) as ly, min(least(sz, ez)) as lz, max(greatest(sx, ex)) as hx, max(greatest(sy, ey)) as hy, max(greatest(sz, ez)) as hz from ({VECTORS_SQL})),
n as (select *, ceil((hx + 2.5 - lx) / 5)::bigint as nx, ceil((hy + 2.5 - ly) / 5)::bigint as ny, ceil((hz + 2.5 - lz) / 5)::bigint as nz from ends),
ids as (select n.*, i, j, k from n, range(10000) a(i), range(1000) b(j), range(100) c(k) where i < nx and j < ny and k < nz)
select (i * ny + j) * nz + k as voxel_id, round(lx + i * ((lx + 5) - lx), 6) + 0 as x, round(ly + j * ((ly + 5) - ly), 6) + 0 as y, round(lz + k * ((lz + 5) - lz), 6) + 0 as z from ids""")
def grid_from_vectors(spark, sf_dir):
    g = grids.create_grid(5.0, path_vectors=vectors(spark, sf_dir))
    return grids.voxels(spark, g).select("voxel_id", r("x"), r("y"), r("z"))


def _hatch_sql() -> str:
    s = STRATEGY
    (lx, ly, _), (hx, hy, _) = s.low, s.high
    cx, cy, turn = (lx + hx) / 2, (ly + hy) / 2, math.radians(s.rotation)
    def point(x, name):
        px, py = f"({x} - {d(cx)})", f"(y - {d(cy)})"
        return f"""case when layer = 0 then {x} else cos(a) * {px} - sin(a) * {py} + {d(cx)} end as {name}x, case when layer = 0 then y else sin(a) * {px} + cos(a) * {py} + {d(cy)} end as {name}y"""
    return f"""base as (select l::int as layer, i::int as line, {d(s.first_line)} + i * {d(s.line_step)} as y, l * {d(turn)} as a, l * {d(s.layer_height)} as z from range({s.last_layer + 1}) t(l), range({s.lines}) u(i)),
hatch as (select layer, line, {point(d(lx - s.scan_extension), 's')}, {point(d(hx + s.scan_extension), 'e')}, z from base)"""


@query(f"with {_hatch_sql()} select layer, line, {rs('sx', 'sy', 'ex', 'ey', 'z', digits=5)} from hatch")
def hatch_layers(spark, sf_dir):
    return STRATEGY.hatch(spark).select("layer", "line", *[r(c, 5) for c in ("sx", "sy", "ex", "ey", "z")])


@query(f"""with {_hatch_sql()}, timed as (select *, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) / {d(STRATEGY.scan_speed)} as dur from hatch),
inlayer as (select *, coalesce(sum(dur) over (partition by layer order by line rows between unbounded preceding and 1 preceding), 0) as done from timed),
starts as (select layer, max(done) as last from inlayer group by layer),
begins as (select layer, coalesce(sum(last) over (order by layer rows between unbounded preceding and 1 preceding), 0) as t from starts)
select (layer * {STRATEGY.lines} + line)::bigint as vector_id, layer, round(t + done, 4) + 0 as t0, round(t + done + dur, 4) + 0 as t1 from inlayer join begins using (layer)""")
def hatch_schedule(spark, sf_dir):
    return STRATEGY.vectors(spark).select("vector_id", "layer", r("t0", 4), r("t1", 4))


@query(f"""with {_hatch_sql()} select layer, line, part, printf('%d %.6f %.6f %.6f %.6f %.6f', mode, x, y, z, power, param) as text from (
select layer, line, 0 as part, 1 as mode, sx as x, sy as y, z, 0.0::double as power, 0.0::double as param from hatch union all select layer, line, 1, 0, ex, ey, z, {d(STRATEGY.power)}, {d(STRATEGY.scan_speed)} from hatch)""")
def layer_export_rows(spark, sf_dir):
    return STRATEGY.export_rows(spark).select("layer", "line", "part", "text")


@query(f"select series_id, count(*) as n_samples, round(avg(value), 6) + 0 as mean, round(max(t) filter (where n = 1) - max(t) filter (where n = 0), 6) + 0 as dt from ({SERIES_SQL}) group by series_id")
def spectral_mean(spark, sf_dir):
    return spectral.summary(series(spark, sf_dir)).select("series_id", "n_samples", r("mean"), r("dt"))


N_MODES = 6
DFT = f"""ser as materialized ({SERIES_SQL}), tot as (select series_id, count(*) as cnt, avg(value) as mean, max(t) filter (where n = 1) - max(t) filter (where n = 0) as dt from ser group by series_id),
sums as (select series_id, k, any_value(cnt) as cnt, any_value(dt) as dt, sum(value * cos({d(2 * math.pi)} * ((k * n) % cnt) / cnt)) as re, -sum(value * sin({d(2 * math.pi)} * ((k * n) % cnt) / cnt)) as im
  from ser join tot using (series_id), range(1, {N_MODES}) m(k) group by series_id, k),
modes as (select series_id, 0 as k, mean as amplitude, 0.0::double as frequency, 0.0::double as phase from tot union all
  select series_id, k::int, sqrt(re * re + im * im) / cnt, k / (dt * cnt), atan2(im, re) from sums)"""


@query(f"with {DFT} select series_id, k, {rs('amplitude', 'frequency', 'phase', digits=5)} from modes")
def spectral_modes(spark, sf_dir):
    return spectral.modes_sql(series(spark, sf_dir), N_MODES).select("series_id", "k", r("amplitude", 5), r("frequency", 5), r("phase", 5))


@query(f"with {DFT} select series_id, k, {rs('amplitude', 'frequency', 'phase', digits=5)} from modes")
def spectral_modes_fft(spark, sf_dir):
    return spectral.modes_fft(series(spark, sf_dir), N_MODES).select("series_id", "k", r("amplitude", 5), r("frequency", 5), r("phase", 5))


@query(f"""with {DFT}, cut as (select * from modes where k < 4), grid as (select distinct series_id, j::int as k from cut, range(8) t(j))
select grid.series_id as dim, grid.k, round(coalesce(amplitude, 0) * 0.71, 5) + 0 as amplitude, round(coalesce(frequency, 0), 5) + 0 as frequency, round(coalesce(phase, 0), 5) + 0 as phase from grid left join (select series_id, k::int as k, amplitude, frequency, phase from cut) c using (series_id, k)""")
def spectral_truncate_pad(spark, sf_dir):
    modes = spectral.scaled(spectral.modes_sql(series(spark, sf_dir), 4), 0.71).withColumnRenamed("series_id", "dim")
    return spectral.padded(modes, 8).select("dim", "k", r("amplitude", 5), r("frequency", 5), r("phase", 5))


@query(f"with {DFT} select series_id as dim, round(max(amplitude) filter (where k = 0), 5) + 0 as mean, round(sum(amplitude), 5) + 0 as maximum, count(*) as n_modes from modes group by series_id")
def melt_pool_summary(spark, sf_dir):
    modes = spectral.modes_sql(series(spark, sf_dir), N_MODES).withColumnRenamed("series_id", "dim")
    return spectral.bounds(modes).select("dim", r("mean", 5), r("maximum", 5), "n_modes")


@query(f"with {FRAME} select vector_id, round({modal_sql('width', 't0')}, 6) + 0 as width, round({modal_sql('depth', 't0')}, 6) + 0 as depth, round({modal_sql('height', 't0')}, 6) + 0 as height from vec")
def modal_dimensions(spark, sf_dir):
    v = prepared(spark, sf_dir)
    return v.select("vector_id", *[(F.round(G.modal(POOL, dim, F.col("t0")), 6) + F.lit(0.0)).alias(dim) for dim in ("width", "depth", "height")])


@query("""with p as (select l_returnflag, l_linestatus, l_quantity - 25 as y, l_discount * 100 - 4.9 as z from lineitem)
select l_returnflag, l_linestatus, count(*) as n, count(*) filter (where (y / 20.5) * (y / 20.5) + case when z >= 0 then pow(abs(z) / 4.2::double, 2.5::double) else pow(abs(z) / 6.1::double, 0.7::double) end <= 1) as n_inside from p group by all""")
def lame_inside(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", (F.col("l_quantity") - 25).alias("y"), (F.col("l_discount") * 100 - 4.9).alias("z"))
    hit = G.inside(F.col("y"), F.col("z"), F.lit(41.0), F.lit(4.2), F.lit(6.1), 2.5, 0.7)
    return p.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("n_inside"))


def _within(spark, sf_dir, condition):
    build = mask._build(mask.binned(prepared(spark, sf_dir), GRID))
    return grids.voxels(spark, GRID).join(build, (F.col("iz") == F.col("bin_z")) & condition)


@query(f"with {FRAME}, {voxel_cte(GRID)} select vector_id, count(*) as n from vox join vec on {AABB} group by vector_id")
def cull_aabb(spark, sf_dir):
    return _within(spark, sf_dir, G.in_aabb()).groupBy("vector_id").agg(F.count("*").alias("n"))


@query(f"with {FRAME}, {voxel_cte(GRID)} select vector_id, count(*) as n from vox join vec on {AABB} and {OBB} group by vector_id")
def cull_obb(spark, sf_dir):
    return _within(spark, sf_dir, G.in_aabb() & G.in_obb()).groupBy("vector_id").agg(F.count("*").alias("n"))


@query(f"with {FRAME}, {voxel_cte(GRID)} select (select count(*) from vec) * (select count(*) from vox) as n_pairs, count(*) as n_aabb, count(*) filter (where {OBB}) as n_obb from vox join vec on {AABB}")
def cull_counts(spark, sf_dir):
    hits = _within(spark, sf_dir, G.in_aabb()).agg(F.count("*").alias("n_aabb"), F.count(F.when(G.in_obb(), 1)).alias("n_obb"))
    n = vectors(spark, sf_dir).agg((F.count("*") * GRID.n_voxels).alias("n_pairs"))
    return n.crossJoin(hits)  # one row each


@query(f"with {FRAME}, {voxel_cte(GRID)}, {PAIRS} select vector_id, voxel_id, {rs('tf', 't', 'local_y', 'local_z')} from pair")
def path_projection(spark, sf_dir):
    return mask.candidates(grids.voxels(spark, GRID), prepared(spark, sf_dir), GRID).select("vector_id", "voxel_id", r("tf"), r("t"), r("local_y"), r("local_z"))


@query(f"{MASK} select voxel_id from melted")
def melt_mask_semi(spark, sf_dir):
    return mask.melted_sql(grids.voxels(spark, GRID), prepared(spark, sf_dir), GRID, POOL).select("voxel_id")


@query(f"{MASK} select voxel_id from melted")
def melt_mask_tiles(spark, sf_dir):
    return mask.mask(spark, prepared(spark, sf_dir), GRID, POOL, melted=True).select("voxel_id")


@query(f"{MASK} select voxel_id, ix, iy, iz from vox anti join melted using (voxel_id)")
def porosity_anti(spark, sf_dir):
    return mask.porous_sql(grids.voxels(spark, GRID), prepared(spark, sf_dir), GRID, POOL).select("voxel_id", "ix", "iy", "iz")


@query(f"{MASK} select voxel_id, ix, iy, iz from vox anti join melted using (voxel_id)")
def porosity_tiles(spark, sf_dir):
    return mask.porosity(spark, prepared(spark, sf_dir), GRID, POOL, "tiles").select("voxel_id", "ix", "iy", "iz")


@query(f"{MASK} select voxel_id, ix, iy, iz, (case when m.voxel_id is null then 1 else 0 end)::tinyint as porosity from vox left join (select voxel_id from melted) m using (voxel_id)")
def porosity_dense(spark, sf_dir):
    return mask.dense_field(spark, prepared(spark, sf_dir), GRID, POOL)


@query(f"{MASK} select iz, count(*) as n_voxels, count(*) filter (where m.voxel_id is null) as n_porous from vox left join (select voxel_id from melted) m using (voxel_id) group by iz")
def porosity_by_layer(spark, sf_dir):
    m = grids.with_coordinates(mask.mask(spark, prepared(spark, sf_dir), GRID, POOL), GRID)
    return m.groupBy("iz").agg(F.count("*").alias("n_voxels"), F.count(F.when(~F.col("melted"), 1)).alias("n_porous"))


@query(f"{MASK} select count(*) as n_voxels, (select count(*) from melted) as n_melted, round(1 - (select count(*) from melted) / count(*), 6) + 0 as porosity from vox")
def porosity_summary(spark, sf_dir):
    m = mask.mask(spark, prepared(spark, sf_dir), GRID, POOL)
    return m.agg(F.count("*").alias("n_voxels"), F.count(F.when(F.col("melted"), 1)).alias("n_melted"), (F.round(F.avg((~F.col("melted")).cast("double")), 6) + F.lit(0.0)).alias("porosity"))


@query(f"{MASK} select voxel_id, ix + {GRID.shape[0]}::bigint * (iy + {GRID.shape[1]}::bigint * iz) as vti_index from vox anti join melted using (voxel_id)")
def vti_index(spark, sf_dir):
    return vti_order(mask.porosity(spark, prepared(spark, sf_dir), GRID, POOL, "tiles"), GRID).select("voxel_id", "vti_index")


@query(f"""{MASK}, por as (select ix, iy, iz, voxel_id from vox anti join melted using (voxel_id)), gone as (select ix, iy, iz from vox semi join melted using (voxel_id))
select distinct por.voxel_id, por.ix, por.iy, por.iz from por join gone on abs(por.ix - gone.ix) + abs(por.iy - gone.iy) + abs(por.iz - gone.iz) = 1 and gone.ix between por.ix - 1 and por.ix + 1""")
def pore_surface_cells(spark, sf_dir):
    return morphology.boundary_cells(mask.porosity(spark, prepared(spark, sf_dir), GRID, POOL, "tiles"), GRID)


SMALL = GridSpec.from_box(2.0, [[30.13, 20.29, 6.07], [60.13, 40.29, 18.07]])


@query(f"with {FRAME} select vector_id from vec where xmax >= {d(SMALL.origin[0])} and xmin <= {d(SMALL.high[0])} and ymax >= {d(SMALL.origin[1])} and ymin <= {d(SMALL.high[1])} and zmax >= {d(SMALL.origin[2])} and zmin <= {d(SMALL.high[2])}")
def rve_prune(spark, sf_dir):
    return mask.prune(prepared(spark, sf_dir), SMALL).select("vector_id")


@query()
def random_phase_mask(spark, sf_dir):
    """Phases are drawn by the engine's own hash, which SQL does not have."""
    pool = MeltPoolSpec(POOL.modes, 2.0, 1.0, 2.0, random_phases=True, seed=7)
    return mask.mask(spark, G.prepare(vectors(spark, sf_dir), pool), GRID, pool, melted=True).select("voxel_id")


def _pores(spark, sf_dir):
    return morphology.without_small(morphology.labels(pores(spark, sf_dir)))


@query(f"{PORE_CTE} select voxel_id, label from lab")
def pore_labels(spark, sf_dir):
    return morphology.labels(pores(spark, sf_dir)).select("voxel_id", "label")


@query(f"{PORE_CTE} select label, count(*) as n from big group by label")
def pore_small_removed(spark, sf_dir):
    return _pores(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


def _region(spark, sf_dir, *fields):
    return morphology.region_table(_pores(spark, sf_dir), PORE_S, ["label", *fields])


@query(f"{PORE_CTE} select label, count(*) * {PORE_S**3} as area, count(*) as num_pixels from big group by label")
def pore_volume(spark, sf_dir):
    return _region(spark, sf_dir, "area", "num_pixels")


@query(f"{PORE_CTE} select label, min(ix)::bigint as b0, min(iy)::bigint as b1, min(iz)::bigint as b2, max(ix)::bigint + 1 as b3, max(iy)::bigint + 1 as b4, max(iz)::bigint + 1 as b5 from big group by label")
def pore_bbox(spark, sf_dir):
    t = _region(spark, sf_dir, "bbox")
    return t.select("label", *[F.col(f"`bbox-{i}`").alias(f"b{i}") for i in range(6)])


@query(f"{PORE_CTE} select label, round(avg(ix) * {PORE_S}, 6) + 0 as c0, round(avg(iy) * {PORE_S}, 6) + 0 as c1, round(avg(iz) * {PORE_S}, 6) + 0 as c2 from big group by label")
def pore_centroid(spark, sf_dir):
    t = _region(spark, sf_dir, "centroid")
    return t.select("label", *[(F.round(F.col(f"`centroid-{i}`"), 6) + F.lit(0.0)).alias(f"c{i}") for i in range(3)])


@query(f"{PORE_CTE} select label, round(pow(count(*) * {d(PORE_S**3 * 6 / math.pi)}, {d(1 / 3)}), 6) + 0 as equivalent_diameter_area from big group by label")
def pore_eqdiam(spark, sf_dir):
    return _region(spark, sf_dir, "equivalent_diameter_area").select("label", r("equivalent_diameter_area"))


@query(f"{PORE_CTE} select label, round((max(ix) - min(ix) + 1) * (max(iy) - min(iy) + 1) * (max(iz) - min(iz) + 1) * {d(PORE_S**3)}, 6) + 0 as area_bbox, round(count(*) / ((max(ix) - min(ix) + 1) * (max(iy) - min(iy) + 1) * (max(iz) - min(iz) + 1)), 6) + 0 as extent from big group by label")
def pore_extent(spark, sf_dir):
    return _region(spark, sf_dir, "area_bbox", "extent").select("label", r("area_bbox"), r("extent"))


@query(f"""{PORE_CTE}, cell as (select distinct label, 2 * ix + a.v as u, 2 * iy + b.v as v, 2 * iz + c.v as w from big, range(3) a(v), range(3) b(v), range(3) c(v))
select label, sum(case when (u % 2 + v % 2 + w % 2) % 2 = 0 then 1 else -1 end)::bigint as euler_number from cell group by label""")
def pore_euler(spark, sf_dir):
    return _region(spark, sf_dir, "euler_number")


@query(f"""{PORE_CTE}, near as (select a.label, count(*) as shared from big a join big b on a.label = b.label and abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1 group by a.label)
select label, (6 * count(*) - coalesce(any_value(shared), 0)) * {PORE_S**2} as surface_area from big left join near using (label) group by label""")
def pore_surface_area(spark, sf_dir):
    return _region(spark, sf_dir, "surface_area")


@query(f"""{PORE_CTE} select label, round(n2 * (var_pop(iy) + var_pop(iz)), 3) + 0 as i00, round(n2 * (var_pop(ix) + var_pop(iz)), 3) + 0 as i11, round(n2 * (var_pop(ix) + var_pop(iy)), 3) + 0 as i22,
round(-n2 * covar_pop(ix, iy), 3) + 0 as i01, round(-n2 * covar_pop(ix, iz), 3) + 0 as i02, round(-n2 * covar_pop(iy, iz), 3) + 0 as i12 from big group by label""".replace("n2", f"{PORE_S**2} * count(*) * count(*)"))
def pore_inertia(spark, sf_dir):
    """Inertia tensors times the squared voxel count, which leaves multiples of a quarter to compare."""
    t = _region(spark, sf_dir, "num_pixels", "inertia_tensor")
    return t.select("label", *[(F.round(F.col(f"`inertia_tensor-{i}-{j}`") * F.col("num_pixels") * F.col("num_pixels"), 3) + F.lit(0.0)).alias(f"i{i}{j}") for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))])


#: Values are scaled by this before they are rounded: it moves exact binary fractions off the middle between two roundings.
ODD = 1.2345678


def odd(column, digits: int):
    return F.round(column * ODD, digits) + F.lit(0.0)


EIGEN = f"""t as (select label, {PORE_S**2} * (var_pop(iy) + var_pop(iz)) as a, {PORE_S**2} * (var_pop(ix) + var_pop(iz)) as b, {PORE_S**2} * (var_pop(ix) + var_pop(iy)) as c,
-{PORE_S**2} * covar_pop(ix, iy) as d, -{PORE_S**2} * covar_pop(ix, iz) as e, -{PORE_S**2} * covar_pop(iy, iz) as f from big group by label),
q as (select *, (a + b + c) / 3 as m, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2) + 2 * (d * d + e * e + f * f)) / 6) as p from t),
h as (select *, case when p < 1e-12 then 0 else ((a - m) * ((b - m) * (c - m) - f * f) - d * (d * (c - m) - f * e) + e * (d * f - (b - m) * e)) / (2 * p * p * p) end as r from q),
g as (select *, acos(greatest(-1.0::double, least(1.0::double, r))) / 3 as phi from h),
eig as (select label, greatest(0, m + 2 * p * cos(phi)) as l0, greatest(0, 3 * m - (m + 2 * p * cos(phi)) - (m + 2 * p * cos(phi + {2 * math.pi / 3!r}))) as l1, greatest(0, m + 2 * p * cos(phi + {2 * math.pi / 3!r})) as l2 from g)"""


@query(f"""{PORE_CTE}, {EIGEN} select label, round(l0 * {ODD}, 3) + 0 as eigval_0, round(l1 * {ODD}, 3) + 0 as eigval_1, round(l2 * {ODD}, 3) + 0 as eigval_2,
round(sqrt(greatest(0, 10 * (l0 + l1 - l2))) * {ODD}, 2) + 0 as axis_major_length, round(sqrt(greatest(0, 10 * (l1 + l2 - l0))) * {ODD}, 2) + 0 as axis_minor_length from eig""")
def pore_axes(spark, sf_dir):
    """Eigenvalues and axis lengths; the SQL solves the characteristic equation by angles."""
    t = _region(spark, sf_dir, "inertia_tensor_eigvals", "axis_major_length", "axis_minor_length")
    return t.select("label", *[odd(F.col(f"`inertia_tensor_eigvals-{i}`"), 3).alias(f"eigval_{i}") for i in range(3)], *[odd(F.col(f"axis_{x}_length"), 2).alias(f"axis_{x}_length") for x in ("major", "minor")])


@query(f"""{PORE_CTE}, box as materialized (select label, count(*) as n, min(ix) - 1 as x0, max(ix) + 1 as x1, min(iy) - 1 as y0, max(iy) + 1 as y1, min(iz) - 1 as z0, max(iz) + 1 as z1 from big group by label),
cell as materialized (select label, x, y, z from (select label, y0, y1, z0, z1, unnest(range(x0, x1 + 1)) as x from box where n >= 7), lateral (select unnest(range(y0, y1 + 1)) as y), lateral (select unnest(range(z0, z1 + 1)) as z)),
free as materialized (select label, x, y, z from cell anti join (select label, ix as x, iy as y, iz as z from big) using (label, x, y, z)),
outside as (select label, x0 as x, y0 as y, z0 as z from box where n >= 7 union select f.label, f.x, f.y, f.z from outside o join off on true join free f on f.label = o.label and f.x = o.x + off.a and f.y = o.y + off.b and f.z = o.z + off.c),
hole as (select label, count(*) as n from free anti join outside using (label, x, y, z) group by label)
select box.label, box.n * {PORE_S**3} as area, (box.n + coalesce(hole.n, 0)) * {PORE_S**3} as area_filled from box left join hole using (label)""")
def pore_filled(spark, sf_dir):
    """Volume with holes filled; the SQL floods each bounding box from a corner."""
    return _region(spark, sf_dir, "area", "area_filled")


@query()
def pore_convex(spark, sf_dir):
    """Hull volume, solidity and greatest extent (SQL has no hull)."""
    return _region(spark, sf_dir, "area", "area_convex", "solidity", "feret_diameter_max")


MOMENTS = [(i, j, k) for i in range(4) for j in range(4) for k in range(4)]


def _moment_sql() -> str:
    """Raw moments from the bounding box's corner, central ones from the centroid, and these over the voxel count's power, each by its definition."""
    def power(names, n):
        return " * ".join(f"pow({x}, {e})" for x, e in zip(names, n) if e) or "1.0::double"
    raw = ", ".join(f"round(sum({power(('x', 'y', 'z'), n)}) * {ODD}, 4) + 0 as raw_{n[0]}{n[1]}{n[2]}" for n in MOMENTS)
    central = ", ".join(f"round(sum({power(('x - cx', 'y - cy', 'z - cz'), n)}) * {ODD}, 4) + 0 as central_{n[0]}{n[1]}{n[2]}" for n in MOMENTS)
    normal = ", ".join(f"round(sum({power(('x - cx', 'y - cy', 'z - cz'), n)}) / {PORE_S ** sum(n)!r} / pow(count(*), {sum(n) / 3 + 1!r}) * {ODD}, 4) + 0 as normal_{n[0]}{n[1]}{n[2]}" for n in MOMENTS if sum(n) >= 2)
    return f"""low as (select label, min(ix) as x0, min(iy) as y0, min(iz) as z0 from big group by label),
pts as (select label, (ix - x0) * {d(PORE_S)} as x, (iy - y0) * {d(PORE_S)} as y, (iz - z0) * {d(PORE_S)} as z from big join low using (label)),
mid as (select label, avg(x) as cx, avg(y) as cy, avg(z) as cz from pts group by label)
select label, {raw}, {central}, {normal} from pts join mid using (label) group by label"""


@query(f"{PORE_CTE}, {_moment_sql()}")
def pore_moments(spark, sf_dir):
    t = _region(spark, sf_dir, "moments", "moments_central", "moments_normalized")
    kinds = (("moments", "raw"), ("moments_central", "central"), ("moments_normalized", "normal"))
    return t.select("label", *[odd(F.col(f"`{field}-{i}-{j}-{k}`"), 4).alias(f"{name}_{i}{j}{k}") for field, name in kinds for i, j, k in MOMENTS if name != "normal" or i + j + k >= 2])


@query(f"{PORE_CTE} select label, string_agg(ix || ':' || iy || ':' || iz, ',' order by ix, iy, iz) as coords, min(ix) || '-' || (max(ix) + 1) || ',' || min(iy) || '-' || (max(iy) + 1) || ',' || min(iz) || '-' || (max(iz) + 1) as slice from big group by label")
def pore_coords(spark, sf_dir):
    t = _region(spark, sf_dir, "coords", "slice")
    place = F.array_join(F.transform("coords", lambda v: F.concat_ws(":", *[v[c].cast("string") for c in ("ix", "iy", "iz")])), ",")
    return t.select("label", place.alias("coords"), F.array_join(F.transform("slice", lambda v: F.concat_ws("-", v["start"].cast("string"), v["stop"].cast("string"))), ",").alias("slice"))


@query(f"{MASK} select iz, string_agg(case when m.voxel_id is null then '1' else '0' end, '' order by iy, ix) as points from vox left join (select voxel_id from melted) m using (voxel_id) group by iz having count(*) > count(m.voxel_id)")
def vti_planes(spark, sf_dir):
    """The planes of the raster file as the executors make them, x fastest."""
    planes = slabs(mask.porosity(spark, prepared(spark, sf_dir), GRID, POOL, "tiles"), GRID)
    byte = F.expr("transform(sequence(1, length(bits)), i -> lpad(conv(hex(substring(bits, i, 1)), 16, 2), 8, '0'))")
    return planes.select("iz", F.substring(F.array_join(byte, ""), 1, GRID.shape[0] * GRID.shape[1]).alias("points"))


@query(f"select n, t as c0, value as c1 from ({SERIES_SQL}) where series_id = (select min(event_type) from events)")
def read_data_rows(spark, sf_dir):
    """A series written as comma-separated text with a comment, and read back."""
    own = series(spark, sf_dir)
    one = own.join(F.broadcast(own.agg(F.min("series_id").alias("first"))), F.col("series_id") == F.col("first"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/series-{uuid.uuid4().hex}"
    text = F.concat(F.when(F.col("n") == 0, F.lit("# time, value\n")).otherwise(F.lit("")), F.concat_ws(" , ", F.col("t").cast("string"), F.col("value").cast("string")))
    one.coalesce(1).sortWithinPartitions("n").select(text.alias("value")).write.text(path)
    return as_series(read_data(spark, path), "first").select("n", F.col("t").alias("c0"), F.col("value").alias("c1"))


@query(f"""with e as (select row_number() over (order by n_nationkey) - 1 as i, 100.0::double + 10 * n_nationkey as length, 1.0::double + n_regionkey as weight from nation)
select cast(range as bigint) as n, round(range * (1 / 25000.0::double), 9) + 0 as t, round((select weight / sqrt(sum(weight * weight) over ()) from e order by i limit 1) * 18, 6) + 0 as share, 18.0::double as deviation, 148.0::double as mean from range({int(0.08 / (1 / 25000.0))})""")
def synthetic_series(spark, sf_dir):
    """The series of one effect: its axis, its share of sigma among the nations' effects, and the deviation that it has by itself."""
    effects = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), (100.0 + 10 * F.col("n_nationkey")).alias("length_scale_m"), F.lit(None).cast("double").alias("frequency_hz"), (1.0 + F.col("n_regionkey")).alias("sigma_weight"), "n_nationkey")
    shares = synthetic.normalised(effects, 18.0, 1700.0).join(effects.select("name", "n_nationkey").withColumnRenamed("name", "own"), F.col("name") == F.col("own")).orderBy("n_nationkey").limit(1).select(F.round("sigma_contribution", 6).alias("share"))
    source = synthetic.MeltPoolFilter(148.0, 18.0, 1700.0, (25000.0, 0.08), seed=3)
    source.add_effect("one", (1.7, None, 1.0))
    source.initialize(spark)
    made = source.generate_fluctuations(spark=spark)
    # a band-passed series has a mean near nought, which the target's mean is added to; the deviation is exact
    total = made.agg((F.round(F.stddev_pop("c1"), 6) + F.lit(0.0)).alias("deviation"), F.when(F.abs(F.avg("c1") - 148) < 1.8, F.lit(148.0)).otherwise(F.avg("c1")).alias("mean"))
    return made.select("n", (F.round("c0", 9) + F.lit(0.0)).alias("t")).crossJoin(F.broadcast(shares)).crossJoin(F.broadcast(total))  # one row each


@query(f"""with e as ({EFFECTS_SQL}) select name, round(case when length_scale_m is not null then 1700 / length_scale_m else frequency_hz end, 6) + 0 as frequency_hz, round(sigma_weight / (select sqrt(sum(sigma_weight * sigma_weight)) from e) * 18, 6) + 0 as sigma_contribution from e""")
def effect_normalisation(spark, sf_dir):
    return synthetic.normalised(_sql(spark, sf_dir, "nation", EFFECTS_SQL), 18.0, 1700.0).select("name", r("frequency_hz"), r("sigma_contribution"))


def _filter_sql(f0: float, fs: float) -> str:
    """The cascade of sections as a recursion over the samples; each section has two numbers of state."""
    sections = synthetic.butterworth_band(4, *synthetic.band(f0, fs)).tolist()
    start, later, v, w = [], [], "s.value", "s.value"
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        start += [f"{d(b0)} * {v} as o{i}", f"{d(b1)} * {v} - {d(a1)} * o{i} as p{i}", f"{d(b2)} * {v} - {d(a2)} * o{i} as q{i}"]
        later += [f"{d(b0)} * {w} + f.p{i} as o{i}", f"{d(b1)} * {w} - {d(a1)} * ({d(b0)} * {w} + f.p{i}) + f.q{i}", f"{d(b2)} * {w} - {d(a2)} * ({d(b0)} * {w} + f.p{i})"]
        v, w = f"o{i}", f"({d(b0)} * {w} + f.p{i})"
    return f"""with recursive ser as materialized ({SERIES_SQL}),
f as (select s.series_id, s.n, {', '.join(start)} from ser s where n = 0 union all
select s.series_id, s.n, {', '.join(later)} from f join ser s on s.series_id = f.series_id and s.n = f.n + 1)
select series_id, n, round(o{len(sections) - 1}, 6) + 0 as value from f"""


@query(_filter_sql(50.0, 1000.0))
def bandpass_series(spark, sf_dir):
    """A recursive filter: each value depends on the ones before it."""
    return synthetic.bandpass(series(spark, sf_dir), 50.0, 1000.0).select("series_id", "n", r("value"))
