"""Queries on measures, components, paths and the whole chain from seeds to metrics."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import bricks, fields, graph, measure, plates, rays, sampling, surface
from ..sources.scratch import by_shuffle, materialize, scratch_root
from .fixtures import SIDE, STEP
from .mesh_queries import _mesh
from .registry import query

L = F.lit
KEY = ["sample_id", "i", "j", "k"]


# 2.9 measures of meshes and images

VOLUME = """SELECT sample_id, count(*)*0.5 AS area, abs(sum(ax*("by"*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-"by"*cx)))/6 AS volume FROM soup GROUP BY sample_id"""


@query("mt1_area_volume", "l:sample_id d:area,volume", VOLUME)
def _(f):
    return measure.mesh_area_volume(f.skin())


@query("pr8_mesh_volume", "l:sample_id d:volume", "SELECT sample_id, count(*) AS volume FROM image GROUP BY sample_id")
def _(f):
    return measure.mesh_area_volume(f.skin())


@query("mt2_mesh_ratios", "l:sample_id d:porosity,bs_bv,bs_tv", f"SELECT sample_id, 1-volume/1728.0 AS porosity, area/volume AS bs_bv, area/1728.0 AS bs_tv FROM ({VOLUME})")
def _(f):
    m = measure.mesh_area_volume(f.skin())
    return measure.mesh_ratios(m, m.select("sample_id", L(float(SIDE**3)).alias("domain_volume")))


# normals of the vertices from the faces around them by area (where they cancel, the y axis), and the area of each face with its corners moved along them
SMI = f"""WITH corner AS (SELECT f.sample_id, f.face_id, f.v1, f.v2, f.v3, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS bky, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM faces f
    JOIN verts a ON a.sample_id=f.sample_id AND a.vertex_id=f.v1 JOIN verts b ON b.sample_id=f.sample_id AND b.vertex_id=f.v2 JOIN verts c ON c.sample_id=f.sample_id AND c.vertex_id=f.v3),
    normal AS (SELECT *, (bky-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(bky-ay)*(cx-ax) AS nz FROM corner),
    around AS (SELECT sample_id, v, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT sample_id, v1 AS v, nx, ny, nz FROM normal UNION ALL SELECT sample_id, v2, nx, ny, nz FROM normal UNION ALL SELECT sample_id, v3, nx, ny, nz FROM normal) u GROUP BY ALL),
    moved AS (SELECT v.sample_id, v.vertex_id, x+0.05*coalesce(nx/nullif(l,0),0) AS x, y+0.05*coalesce(ny/nullif(l,0),1) AS y, z+0.05*coalesce(nz/nullif(l,0),0) AS z
        FROM (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM around) n JOIN verts v ON v.sample_id=n.sample_id AND v.vertex_id=n.v),
    grown AS (SELECT sample_id, sum(sqrt(p*p+q*q+r*r))/2 AS s FROM (SELECT f.sample_id, (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) AS p, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) AS q, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) AS r FROM faces f
        JOIN moved a ON a.sample_id=f.sample_id AND a.vertex_id=f.v1 JOIN moved b ON b.sample_id=f.sample_id AND b.vertex_id=f.v2 JOIN moved c ON c.sample_id=f.sample_id AND c.vertex_id=f.v3) t GROUP BY sample_id)
    SELECT m.sample_id, 6*volume*(s-area)/0.05/(area*area) AS smi FROM ({VOLUME}) m JOIN grown USING (sample_id)"""


@query("mt3_structure_model_index", "l:sample_id d:smi", SMI, digits=5)
def _(f):
    v, t = _mesh(f)
    return measure.structure_model_index(v, t, 1.0).select("sample_id", "smi")


CHI_MESH = """SELECT v.sample_id, v.n-e.n+t.n AS chi, (1-(v.n-e.n+t.n)/2.0)/1728.0 AS conn_d FROM (SELECT sample_id, count(*) AS n FROM verts GROUP BY sample_id) v
    JOIN (SELECT sample_id, count(*) AS n FROM medges GROUP BY sample_id) e USING (sample_id) JOIN (SELECT sample_id, count(*) AS n FROM faces GROUP BY sample_id) t USING (sample_id)"""


@query("mt13_connectivity_density", "l:sample_id,chi d:conn_d", CHI_MESH, digits=9)
def _(f):
    v, t = _mesh(f)
    return measure.connectivity_density(v, t, v.select("sample_id").distinct().withColumn("domain_volume", L(float(SIDE**3))))


CHI = """SELECT sample_id, sum(sign) AS chi FROM (SELECT DISTINCT sample_id, 2*i+1+a.d AS x, 2*j+1+b.d AS y, 2*k+1+c.d AS z, CASE WHEN ((a.d=0)::INT+(b.d=0)::INT+(c.d=0)::INT)%2=0 THEN 1 ELSE -1 END AS sign
    FROM image, (VALUES (-1),(0),(1)) a(d), (VALUES (-1),(0),(1)) b(d), (VALUES (-1),(0),(1)) c(d)) GROUP BY sample_id"""


@query("mt14_euler_number", "l:sample_id,chi", CHI)
def _(f):
    return measure.euler_number(f.image())


EDT = """SELECT v.sample_id, v.i, v.j, v.k, min((v.i-b.i)*(v.i-b.i)+(v.j-b.j)*(v.j-b.j)+(v.k-b.k)*(v.k-b.k)) AS d2 FROM voxels v JOIN voxels b ON b.sample_id=v.sample_id AND NOT b.solid GROUP BY ALL"""


@query("mt4_distance_transform", "l:sample_id,i,j,k,d2", EDT)
def _(f):
    return measure.distance_transform(f.voxels())


RIDGE = f"""WITH dt AS ({EDT}) SELECT * FROM dt a WHERE d2 > 0 AND NOT EXISTS (SELECT 1 FROM dt b WHERE b.sample_id=a.sample_id AND b.d2>0 AND b.i BETWEEN a.i-1 AND a.i+1 AND b.j BETWEEN a.j-1 AND a.j+1 AND b.k BETWEEN a.k-1 AND a.k+1
    AND (a.i,a.j,a.k)<>(b.i,b.j,b.k) AND sqrt(a.d2)+sqrt((a.i-b.i)*(a.i-b.i)+(a.j-b.j)*(a.j-b.j)+(a.k-b.k)*(a.k-b.k)) <= sqrt(b.d2)+0.001)"""


@query("mt5_ridge", "l:sample_id,i,j,k,d2", RIDGE)
def _(f):
    return measure.ridge(materialize(measure.distance_transform(f.voxels()), "distances"))


PAINT = f"""{RIDGE.replace("SELECT * FROM dt a", ", r AS (SELECT * FROM dt a", 1)}) SELECT v.sample_id, v.i, v.j, v.k, max(2*sqrt(r.d2)) AS diameter FROM voxels v JOIN r ON r.sample_id=v.sample_id AND v.solid
    AND (v.i-r.i)*(v.i-r.i)+(v.j-r.j)*(v.j-r.j)+(v.k-r.k)*(v.k-r.k) < r.d2 GROUP BY v.sample_id, v.i, v.j, v.k"""


@query("mt6_painted_spheres", "l:sample_id,i,j,k d:diameter", PAINT)
def _(f):
    image = f.voxels()
    distances = materialize(measure.distance_transform(image), "distances")
    return measure.paint_spheres(measure.ridge(distances), image.filter("solid"))


THICKNESS = f"SELECT sample_id, avg(diameter)*0.5 AS thickness, stddev_pop(diameter)*0.5 AS thickness_sd FROM ({PAINT}) GROUP BY sample_id"
SEPARATION = f"SELECT sample_id, avg(diameter)*0.5 AS thickness, stddev_pop(diameter)*0.5 AS thickness_sd FROM ({PAINT.replace('NOT b.solid', 'b.solid').replace('AND v.solid', 'AND NOT v.solid')}) GROUP BY sample_id"


@query("mt7_local_thickness", "l:sample_id d:thickness,thickness_sd", THICKNESS)
def _(f):
    return measure.local_thickness(f.voxels(), 0.5)


@query("mt8_local_separation", "l:sample_id d:thickness,thickness_sd", SEPARATION)
def _(f):
    return measure.local_thickness(f.voxels(), 0.5, inverse=True)


@query("mt12_number_formulas", "l:sample_id d:by_ratio,by_separation", "SELECT sample_id, count(*)/1728.0/0.7 AS by_ratio, 1/0.9 AS by_separation FROM image GROUP BY sample_id")
def _(f):
    n = f.image().groupBy("sample_id").agg((F.count("*") / float(SIDE**3)).alias("bv_tv"))
    return n.select("sample_id", measure.number_by_ratio(F.col("bv_tv"), L(0.7)).alias("by_ratio"), measure.number_by_separation(L(0.9)).alias("by_separation"))


# rays through the middles of the fields of a square across the box: {dirs} directions, {side} x {side} rays each

RAYS = """WITH turn AS (SELECT dir, sin(polar)*cos(turn) AS dx, sin(polar)*sin(turn) AS dy, cos(polar) AS dz FROM (
        SELECT CAST(range AS BIGINT) AS dir, acos(1.0e0-(range+0.5e0)*2.0e0/{dirs}) AS polar, range*3.141592653589793e0*(1.0e0+power(5.0e0,0.5e0)) AS turn FROM range({dirs}))),
    cross_p AS (SELECT *, CASE WHEN abs(dz) < 0.9e0 THEN dy ELSE 0.0e0 END AS cx, CASE WHEN abs(dz) < 0.9e0 THEN -dx ELSE dz END AS cy, CASE WHEN abs(dz) < 0.9e0 THEN 0.0e0 ELSE -dy END AS cz FROM turn),
    p AS (SELECT dir, dx, dy, dz, cx/sqrt(cx*cx+cy*cy+cz*cz) AS px, cy/sqrt(cx*cx+cy*cy+cz*cz) AS py, cz/sqrt(cx*cx+cy*cy+cz*cz) AS pz FROM cross_p),
    q AS (SELECT *, dy*pz-dz*py AS qx, dz*px-dx*pz AS qy, dx*py-dy*px AS qz FROM p),
    uv AS (SELECT q.*, r.range AS ray, ((r.range%{side})+0.5e0)/{side}*2-1 AS u, ((r.range//{side})+0.5e0)/{side}*2-1 AS v, sqrt({n}*{n}*3.0e0)/2 AS rad FROM q, range({side}*{side}) r),
    o AS (SELECT dir, ray, dx, dy, dz, {n}/2.0e0+(px*u+qx*v-dx)*rad AS ox, {n}/2.0e0+(py*u+qy*v-dy)*rad AS oy, {n}/2.0e0+(pz*u+qz*v-dz)*rad AS oz FROM uv),
    hit AS MATERIALIZED (SELECT *, greatest(least(-ox/dx,({n}-ox)/dx), least(-oy/dy,({n}-oy)/dy), least(-oz/dz,({n}-oz)/dz), 0) AS t0,
        least(greatest(-ox/dx,({n}-ox)/dx), greatest(-oy/dy,({n}-oy)/dy), greatest(-oz/dz,({n}-oz)/dz)) AS t1 FROM o WHERE true)"""
SAMPLED = RAYS + """, s AS (SELECT dir, ray, CAST(unnest(generate_series(0, CAST(floor((t1-t0)/sqrt(3.0e0)) AS BIGINT))) AS BIGINT) AS s, ox, oy, oz, dx, dy, dz, t0 FROM hit WHERE t1 > t0),
    spot AS MATERIALIZED (SELECT dir, ray, s, least(greatest(floor(ox+dx*(t0+s*sqrt(3.0e0))),0),{n}-1) AS i, least(greatest(floor(oy+dy*(t0+s*sqrt(3.0e0))),0),{n}-1) AS j, least(greatest(floor(oz+dz*(t0+s*sqrt(3.0e0))),0),{n}-1) AS k FROM s),
    seen AS (SELECT v.sample_id, dir, ray, s, solid, lag(solid) OVER w AS before FROM spot JOIN voxels v ON v.i=spot.i AND v.j=spot.j AND v.k=spot.k WINDOW w AS (PARTITION BY v.sample_id, dir, ray ORDER BY s))
    SELECT sample_id, dir, sqrt(3.0e0)*count(before) AS length, count(*) FILTER (solid <> before) AS crossings FROM seen WHERE before IS NOT NULL GROUP BY ALL"""
WALKED = RAYS + """, cuts AS (SELECT dir, ray, ox, oy, oz, dx, dy, dz, unnest(list_sort(list_concat([t0, t1], list_filter(list_concat(list_transform(range(1, {n}), lambda x: (x-ox)/dx),
            list_transform(range(1, {n}), lambda x: (x-oy)/dy), list_transform(range(1, {n}), lambda x: (x-oz)/dz)), lambda t: t > t0 AND t < t1)))) AS t FROM hit WHERE t1 > t0),
    part AS (SELECT *, lead(t) OVER (PARTITION BY dir, ray ORDER BY t) AS t2 FROM cuts),
    spot AS MATERIALIZED (SELECT dir, ray, t, t2-t AS w, least(greatest(floor(ox+dx*(t+t2)/2),0),{n}-1) AS i, least(greatest(floor(oy+dy*(t+t2)/2),0),{n}-1) AS j, least(greatest(floor(oz+dz*(t+t2)/2),0),{n}-1) AS k FROM part WHERE t2-t > 1e-9),
    seen AS (SELECT v.sample_id, dir, solid, w, lag(solid) OVER o AS before, lag(w) OVER o AS wb FROM spot JOIN voxels v ON v.i=spot.i AND v.j=spot.j AND v.k=spot.k WINDOW o AS (PARTITION BY v.sample_id, dir, ray ORDER BY t))
    SELECT sample_id, dir, sum((w+wb)/2) AS length, count(*) FILTER (solid <> before) AS crossings FROM seen WHERE before IS NOT NULL GROUP BY ALL"""


def _ray_sql(text: str, dirs: int, side: int) -> str:
    return text.replace("{dirs}", str(dirs)).replace("{side}", str(side)).replace("{n}", str(SIDE))


@query("mt9_intercepts", "l:sample_id,dir,crossings d:length", _ray_sql(SAMPLED, 24, 8), digits=4)
def _(f):
    return rays.sampled_intercepts(f.voxels(), 24, 8, jitter=False)


@query("mt9_walked_intercepts", "l:sample_id,dir,crossings d:length", _ray_sql(WALKED, 12, 6), digits=4)
def _(f):
    return rays.walked_intercepts(f.voxels(), 12, 6, jitter=False)


@query("mt10_anisotropy", "l:sample_id d:da")
def _(f):
    """Degree of anisotropy (mode 3) of each image from jittered rays."""
    return measure.degree_of_anisotropy(measure.mean_intercept_lengths(rays.sampled_intercepts(f.voxels(), 24, 8)))


NUMBER = f"SELECT sample_id, sum(crossings)*0.5/(sum(length)*0.5) AS tb_n FROM ({_ray_sql(WALKED, 12, 6)}) GROUP BY sample_id"


@query("mt11_trabecular_number", "l:sample_id d:tb_n", NUMBER)
def _(f):
    return measure.trabecular_number(rays.walked_intercepts(f.voxels(), 12, 6, jitter=False), 0.5)


# components and paths

#: Rounds that hand on the least voxel of the part seen so far, until no voxel hears of a smaller one.
ISLANDS = """WITH RECURSIVE s AS (SELECT sample_id, i, j, k, (i*1048576+j)*1048576+k AS id FROM field WHERE value < 0.35),
    walk(sample_id, i, j, k, root) USING KEY (sample_id, i, j, k) AS (SELECT sample_id, i, j, k, id FROM s
    UNION SELECT o.sample_id, o.i, o.j, o.k, min(w.root) AS root FROM walk w JOIN steps t ON true JOIN s o ON o.sample_id=w.sample_id AND o.i=w.i+t.di AND o.j=w.j+t.dj AND o.k=w.k+t.dk
        JOIN recurring.walk r ON r.sample_id=o.sample_id AND r.i=o.i AND r.j=o.j AND r.k=o.k WHERE w.root < r.root GROUP BY ALL),
    parts AS (SELECT sample_id, root, count(*) AS n FROM walk GROUP BY ALL)
    SELECT sample_id, count(*) AS components, sum(n) - max(n) AS removed FROM parts GROUP BY sample_id"""

@query("fd17_largest_component", "l:sample_id,components,removed", ISLANDS)
def _(f):
    _, counts = bricks.remove_islands(f.field(), 0.35, 5.0)
    return counts.withColumnsRenamed({"n_components": "components", "removed_voxels": "removed"})


@query("gp4_networks", "l:graph_id,networks,largest", """WITH RECURSIVE link AS (SELECT graph_id, a AS u, b AS v FROM edges UNION ALL SELECT graph_id, b, a FROM edges),
    walk(graph_id, u, root) AS (SELECT DISTINCT graph_id, u, u FROM link UNION SELECT w.graph_id, l.v, w.root FROM walk w JOIN link l ON l.graph_id=w.graph_id AND l.u=w.u WHERE w.root < l.v),
    best AS (SELECT graph_id, u, min(root) AS root FROM walk GROUP BY ALL), part AS (SELECT graph_id, root, count(*) AS n FROM best GROUP BY ALL)
    SELECT graph_id, count(*) AS networks, max(n) AS largest FROM part GROUP BY graph_id""")
def _(f):
    return graph.network_sizes(f.common("edges"))


#: Costs from the inlets over the open voxels, in whole billionths: voxels that got cheaper in a round go on.
WALK = """WITH RECURSIVE moves AS (SELECT a.n AS di, b.n AS dj, c.n AS dk, CASE abs(a.n)+abs(b.n)+abs(c.n) WHEN 1 THEN 1000000000 WHEN 2 THEN 1414213562 ELSE 1732050808 END AS w
    FROM (VALUES (-1),(0),(1)) a(n), (VALUES (-1),(0),(1)) b(n), (VALUES (-1),(0),(1)) c(n) WHERE abs(a.n)+abs(b.n)+abs(c.n) > 0),
    {ends},
    walk(sample_id, i, j, k, cost) USING KEY (sample_id, i, j, k) AS (SELECT sample_id, i, j, k, CAST(0 AS BIGINT) FROM inlets
    UNION SELECT o.sample_id, o.i, o.j, o.k, min(w.cost+m.w) AS cost FROM walk w JOIN moves m ON true JOIN way o ON o.sample_id=w.sample_id AND o.i=w.i+m.di AND o.j=w.j+m.dj AND o.k=w.k+m.dk
        LEFT JOIN recurring.walk r ON r.sample_id=o.sample_id AND r.i=o.i AND r.j=o.j AND r.k=o.k WHERE r.cost IS NULL OR w.cost+m.w < r.cost GROUP BY ALL),
    best AS (SELECT sample_id, min(struct_pack(cost := cost, i := i, j := j, k := k)) AS b FROM walk JOIN outlets USING (sample_id, i, j, k) GROUP BY sample_id)"""
#: The way back from the best outlet: of the neighbours that explain the cost the first in i, j, k order.
BACK = """, back(sample_id, step, i, j, k, cost) AS (SELECT sample_id, 0, b.i, b.j, b.k, b.cost FROM best
    UNION ALL SELECT sample_id, step+1, o.i, o.j, o.k, o.cost FROM (SELECT b.sample_id, b.step, min(struct_pack(i := w.i, j := w.j, k := w.k, cost := w.cost)) AS o
        FROM back b JOIN moves m ON true JOIN walk w ON w.sample_id=b.sample_id AND w.i=b.i-m.di AND w.j=b.j-m.dj AND w.k=b.k-m.dk AND w.cost+m.w=b.cost WHERE b.cost > 0 GROUP BY ALL))"""
WINDOW = f"""way AS MATERIALIZED (SELECT sample_id, i, j, k FROM voxels WHERE NOT solid),
    usable AS (SELECT * FROM way WHERE k BETWEEN 1 AND {SIDE - 2} AND i BETWEEN 1 AND {SIDE - 2} AND j BETWEEN 1 AND {SIDE - 2}),
    span AS (SELECT f.sample_id, first, last FROM (SELECT sample_id, min(k) AS first FROM usable GROUP BY ALL) f JOIN
        (SELECT sample_id, max(k) AS last FROM way WHERE k BETWEEN 1 AND {SIDE - 2} GROUP BY ALL) l ON l.sample_id=f.sample_id AND first < last),
    inlets AS (SELECT u.* FROM usable u JOIN span USING (sample_id) WHERE k = first), outlets AS (SELECT w.* FROM way w JOIN span USING (sample_id) WHERE k = last)"""
STATUS = """CASE WHEN first IS NULL THEN 'no open planes' WHEN b IS NULL THEN 'no path' ELSE 'ok' END AS status, b.cost/1e9*0.5 AS length"""
SAMPLES = "(SELECT DISTINCT sample_id FROM image) s"


TORTUOSITY = WALK.format(ends=WINDOW) + f"""
    SELECT s.sample_id, {STATUS}, CASE WHEN b IS NOT NULL THEN greatest(1, b.cost/1e9/(last-first)) END AS tortuosity FROM {SAMPLES} LEFT JOIN span USING (sample_id) LEFT JOIN best USING (sample_id)"""


@query("mt15_tortuosity", "l:sample_id s:status d:length,tortuosity", TORTUOSITY)
def _(f):
    image = f.voxels()
    return measure.tortuosity(image.filter("not solid"), rays.image_sizes(image), voxel=0.5)


@query("mt16_end_distance_ratio", "l:sample_id s:status d:length,tortuosity", WALK.format(ends=WINDOW) + BACK + f""",
    far AS (SELECT sample_id, max(struct_pack(step := step, i := i, j := j, k := k)) AS z FROM back GROUP BY ALL)
    SELECT s.sample_id, {STATUS}, CASE WHEN b IS NOT NULL THEN greatest(1, b.cost/1e9/sqrt((b.i-z.i)*(b.i-z.i)+(b.j-z.j)*(b.j-z.j)+(b.k-z.k)*(b.k-z.k))) END AS tortuosity
    FROM {SAMPLES} LEFT JOIN span USING (sample_id) LEFT JOIN best USING (sample_id) LEFT JOIN far USING (sample_id)""")
def _(f):
    """The shortest way over the straight distance of its ends."""
    image = f.voxels()
    return measure.tortuosity(image.filter("not solid"), rays.image_sizes(image), voxel=0.5, mode=1)


@query("mt17_path_rows", "l:sample_id,step d:x,y,z", WALK.format(ends=WINDOW) + BACK + " SELECT sample_id, step, (i+0.5)*0.5 AS x, (j+0.5)*0.5 AS y, (k+0.5)*0.5 AS z FROM back")
def _(f):
    """The rows of each sample's shortest way from its outlet (step 0) to an inlet, voxel centres in length units."""
    image = f.voxels()
    return measure.path_rows(image.filter("not solid"), rays.image_sizes(image), voxel=0.5)


@query("mt17_path_ends", "l:sample_id,steps b:connected", WALK.format(ends=f"""way AS MATERIALIZED (SELECT sample_id, i, j, k FROM voxels WHERE NOT solid),
    inlets AS (SELECT * FROM way WHERE k = 1), outlets AS (SELECT * FROM way WHERE k = {SIDE - 2})""") + BACK + " SELECT sample_id, max(step) AS steps, min(k) = 1 AS connected FROM back GROUP BY sample_id")
def _(f):
    image = f.voxels()
    opened = image.filter("not solid").select(*KEY)
    first = opened.filter("k = 1")
    last = opened.filter(f"k = {SIDE - 2}")
    paths = bricks.shortest_paths(opened, measure.MOVES, first, last, parents=True)
    ends = paths.join(last, KEY, "left_semi").groupBy("sample_id").agg(F.min(F.struct("cost", "i", "j", "k")).alias("b")).select("sample_id", "b.i", "b.j", "b.k")
    rows = bricks.trace_back(paths, ends)
    return rows.groupBy("sample_id").agg(F.max("step").alias("steps"), (F.min("k") == 1).alias("connected"))


@query("mt18_plane_tortuosity", "l:sample_id s:status d:length,tortuosity", WALK.format(ends=f"""inlets AS (SELECT sample_id, i, j, k FROM voxels WHERE NOT solid AND k = 0 AND i BETWEEN 4 AND {SIDE - 5} AND j BETWEEN 4 AND {SIDE - 5}),
    way AS MATERIALIZED (SELECT sample_id, i, j, k FROM voxels WHERE NOT solid AND i BETWEEN 1 AND {SIDE - 2} AND j BETWEEN 1 AND {SIDE - 2}), outlets AS (SELECT * FROM way WHERE k = {SIDE - 1})""") + f"""
    SELECT s.sample_id, CASE WHEN n IS NULL THEN 'no open planes' WHEN b IS NULL THEN 'no path' ELSE 'ok' END AS status, b.cost/1e9*0.5 AS length, CASE WHEN b IS NOT NULL THEN greatest(1, b.cost/1e9/{SIDE}) END AS tortuosity
    FROM {SAMPLES} LEFT JOIN (SELECT sample_id, count(*) AS n FROM inlets GROUP BY ALL) i USING (sample_id) LEFT JOIN best USING (sample_id)""")
def _(f):
    """The older form, with inlets four voxels from the sides, as images here are small."""
    image = f.voxels()
    return measure.plane_tortuosity(image.filter("not solid"), rays.image_sizes(image), margin=4, voxel=0.5)


# statistics

@query("mt19_medians", "l:sample_id s:metric d:median", "SELECT sample_id, metric, median(value) AS median FROM readings GROUP BY ALL")
def _(f):
    return f.common("readings").groupBy("sample_id", "metric").agg(F.median("value").alias("median"))


@query("mt20_replicate_statistics", "l:sample_id,n s:metric d:mean,sd", "SELECT sample_id, metric, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM readings GROUP BY ALL", digits=4)
def _(f):
    return measure.replicate_statistics(f.common("readings"), ["sample_id"])


@query("mt21_stale_metrics", "l:sample_id b:area_stale,smi_stale", """SELECT sample_id, min(p_size) <> max(p_size)-min(p_size) AS area_stale, max(p_size) <> max(p_size)-min(p_size) AS smi_stale FROM seeds GROUP BY sample_id""")
def _(f):
    s = f.common("seeds").groupBy("sample_id").agg(F.min("p_size").alias("area_version"), F.max("p_size").alias("smi_version"), (F.max("p_size") - F.min("p_size")).alias("mesh_version"))
    return measure.stale_metrics(s.drop("mesh_version"), s.select("sample_id", "mesh_version"), ["area", "smi"])


@query("mt22_metric_rows", "l:sample_id,chi,solid s:tortuosity_status d:area,volume,porosity,bs_bv,bs_tv,conn_d,tb_th,tb_th_sd,tb_sp,tb_sp_sd,tb_n,tortuosity", f"""
    SELECT m.sample_id, c.chi, solid, area, volume, 1-volume/1728.0 AS porosity, area/volume AS bs_bv, area/1728.0 AS bs_tv, conn_d, th.thickness AS tb_th, th.thickness_sd AS tb_th_sd, sp.thickness AS tb_sp, sp.thickness_sd AS tb_sp_sd, tn.tb_n,
        w.status AS tortuosity_status, w.tortuosity
    FROM ({VOLUME}) m JOIN ({CHI}) c USING (sample_id) JOIN (SELECT sample_id, count(*) AS solid FROM image GROUP BY sample_id) n USING (sample_id)
    JOIN (SELECT sample_id, (1-(v.n-e.n+t.n)/2.0)/1728.0 AS conn_d FROM {CHI_MESH.split(" FROM ", 1)[1]}) d USING (sample_id)
    JOIN ({THICKNESS}) th USING (sample_id) JOIN ({SEPARATION}) sp USING (sample_id) JOIN ({NUMBER}) tn USING (sample_id) JOIN ({TORTUOSITY}) w USING (sample_id)""", digits=5)
def _(f):
    """All measures of each image as one row, but for anisotropy and the structure model index, which stand in ``mt10`` and ``mt3``."""
    image = f.image()
    voxels = materialize(f.voxels(), "voxels")
    soup = materialize(f.skin(), "soup")
    v, t = (materialize(part, "mesh") for part in surface.weld(soup, 1e-6))
    row = measure.metric_row(voxels, soup, v, t, 0.5, float(SIDE**3), directions=12, per_side=6, jitter=False)
    return row.join(image.groupBy("sample_id").agg(F.count("*").alias("solid")), "sample_id")


# the chain from seeds to metrics

@query("slice_wall_structure", "l:sample_id,solid_voxels,surface_cells,chi d:porosity", """WITH wall AS (SELECT sample_id, i, j, k, (1-0.3)*wall+0.3*strut AS value FROM contrast),
    s AS (SELECT * FROM wall WHERE value < 0.9),
    chi AS (SELECT sample_id, sum(sign) AS chi FROM (SELECT DISTINCT sample_id, 2*i+1+a.d AS x, 2*j+1+b.d AS y, 2*k+1+c.d AS z, CASE WHEN ((a.d=0)::INT+(b.d=0)::INT+(c.d=0)::INT)%2=0 THEN 1 ELSE -1 END AS sign
        FROM s, (VALUES (-1),(0),(1)) a(d), (VALUES (-1),(0),(1)) b(d), (VALUES (-1),(0),(1)) c(d)) GROUP BY sample_id),
    cells AS (SELECT sample_id, count(*) AS n FROM (SELECT w.sample_id, w.i-a.d AS i, w.j-b.d AS j, w.k-c.d AS k FROM wall w, (VALUES (0),(1)) a(d), (VALUES (0),(1)) b(d), (VALUES (0),(1)) c(d)
        GROUP BY ALL HAVING count(*)=8 AND count(*) FILTER (value<0.9) BETWEEN 1 AND 7) GROUP BY sample_id),
    n AS (SELECT sample_id, count(*) FILTER (value<0.9) AS solid_voxels, 1-CAST(count(*) FILTER (value<0.9) AS DOUBLE)/count(*) AS porosity FROM wall GROUP BY sample_id)
    SELECT n.sample_id, solid_voxels, porosity, coalesce(cells.n, 0) AS surface_cells, coalesce(chi, 0) AS chi FROM n LEFT JOIN cells USING (sample_id) LEFT JOIN chi USING (sample_id)""")
def _(f):
    wall = materialize(fields.assemble(fields.contrasts(f.grid(), f.common("seeds")), 0.9, 0.3), "wall")
    cells = surface.cell_codes(wall, 0.9).groupBy("sample_id").agg(F.count("*").alias("surface_cells"))
    chi = measure.euler_number(wall.filter("value < 0.9"))
    return fields.porosity(wall, 0.9).join(cells, "sample_id", "left").join(chi, "sample_id", "left").na.fill(0, ["surface_cells", "chi"])


#: Solid voxels, porosity and plate thickness of each (sample, step) of rows with ``solid``.
PLATES = f"""SELECT sample_id, step, count(*) FILTER (solid) AS solid_voxels, 1-count(*) FILTER (solid)/CAST(count(*) AS DOUBLE) AS porosity,
    count(*) FILTER (solid)*2.0*{STEP}/nullif(count(*) FILTER (solid <> before_i)+count(*) FILTER (solid <> before_j)+count(*) FILTER (solid <> before_k), 0) AS thickness FROM (
    SELECT *, lag(solid) OVER (PARTITION BY sample_id, step, j, k ORDER BY i) AS before_i, lag(solid) OVER (PARTITION BY sample_id, step, i, k ORDER BY j) AS before_j,
        lag(solid) OVER (PARTITION BY sample_id, step, i, j ORDER BY k) AS before_k FROM ({{rows}})) GROUP BY sample_id, step"""


@query("bt6_sensitivity", "l:sample_id,step,solid_voxels d:threshold,porosity,thickness", "SELECT *, step*0.25 AS threshold FROM (" + PLATES.format(
    rows="SELECT sample_id, i, j, k, r.range AS step, (1-r.range*0.25)*wall+r.range*0.25*strut < 0.8 AS solid FROM contrast, range(5) r") + ")")
def _(f):
    """Openness over its range, one value at a time: what it does to solid, porosity and thickness."""
    stored = plates.plate_bricks(fields.contrasts(f.grid(), f.common("seeds")), ["wall", "strut"])
    swept = sampling.sweep_rows(f.samples().select("sample_id", L(0.5).alias("threshold")), {"threshold": (0.0, 1.0)}, 5).drop("swept")
    counts = plates.plate_counts(stored, ["wall", "strut"], swept, lambda v, s: (1.0 - s["threshold"]) * v["wall"] + s["threshold"] * v["strut"] < 0.8)
    return plates.plate_figures(counts, STEP)


@query("bt5_iso_curve", "l:sample_id,step,solid_voxels d:iso,porosity,thickness", "SELECT *, step*0.25+0.25 AS iso FROM (" + PLATES.format(
    rows="SELECT sample_id, i, j, k, r.range AS step, wall < r.range*0.25+0.25 AS solid FROM contrast, range(6) r") + ")")
def _(f):
    """Thickness over even iso levels, from which a first guess for a target is read."""
    from ..plans.calibrate import iso_curve

    return iso_curve(fields.contrasts(f.grid(), f.common("seeds")).withColumn("value", F.col("wall")), 6, STEP)


@query("bt7_radius_transfer", "l:sample_id,level,seeds", """WITH RECURSIVE s AS (SELECT sample_id, l.n AS level, seed_id, x, y, z, row_number() OVER (PARTITION BY sample_id, l.n ORDER BY seed_id) AS r FROM seeds, (VALUES (2),(3),(4)) l(n)),
    walk AS (SELECT sample_id, level, r, [{'x': x, 'y': y, 'z': z}] AS kept FROM s WHERE r = 1 UNION ALL
    SELECT s.sample_id, s.level, s.r, CASE WHEN len(list_filter(kept, lambda q: sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)+(q.z-s.z)*(q.z-s.z)) <= s.level)) = 0 THEN list_append(kept, {'x': s.x, 'y': s.y, 'z': s.z}) ELSE kept END
    FROM walk w JOIN s ON s.sample_id = w.sample_id AND s.level = w.level AND s.r = w.r + 1)
    SELECT sample_id, level, len(kept) AS seeds FROM walk WHERE (sample_id, level, r) IN (SELECT sample_id, level, max(r) FROM s GROUP BY ALL)""")
def _(f):
    spread = f.common("seeds").withColumn("level", F.explode(F.array(*map(L, (2, 3, 4))))).withColumn("radius", F.col("level").cast("double")).withColumn(
        "sample_id", F.col("sample_id") * 10 + F.col("level"))
    kept = sampling.thin_by_distance(spread, F.col("radius"), 4.0)
    return kept.groupBy("sample_id").agg(F.count("*").alias("seeds")).select(F.floor(F.col("sample_id") / 10).alias("sample_id"), (F.col("sample_id") % 10).alias("level"), "seeds")


@query("bt1_calibrated_iso", "l:sample_id b:settled,near")
def _(f):
    from ..plans.calibrate import calibrate

    stored = plates.plate_bricks(fields.contrasts(f.grid(), f.common("seeds")), ["wall"])

    def porosity(state):
        counts = plates.plate_counts(stored, ["wall"], state.select("sample_id", "knob"), lambda v, s: v["wall"] < s["knob"])
        return plates.plate_figures(counts, STEP).select("sample_id", F.col("porosity").alias("metric"))

    start = f.samples().select("sample_id", L(0.5).alias("knob"), L(0.6).alias("target"), L(0.05).alias("lo"), L(6.0).alias("hi"), L(0.02).alias("tol"))
    done = calibrate(start, porosity, rounds=14)
    return done.select("sample_id", (F.col("status") != "open").alias("settled"), (F.abs(F.col("metric") - 0.6) < 0.1).alias("near"))


def _knob_measures(f, stretches=True):
    """Measures of a recipe (sample_id, stretch, iso, threshold) over the seeds of each sample.

    Porosity from the voxels; thickness by the plate model, twice the solid over its surface; anisotropy as the ratio of the
    intercept lengths along and across the stretch, from lines along the axes. Only stretched recipes ask for new contrasts.
    """
    values, seeds = ["wall", "strut"], f.common("seeds")
    by = ["sample_id", "stretch"] if stretches else ["sample_id"]
    stored = [] if stretches else [plates.plate_bricks(fields.contrasts(f.grid(), seeds), values)]

    def bricks_of(rows):
        """Stored bricks, made for the stretches that have none so far."""
        wanted = rows.select("sample_id", "stretch")
        known = [table.select(*by) for table in stored]
        missing = materialize(wanted.join(reduce(DataFrame.unionByName, known), by, "left_anti") if known else wanted, "stretches")
        if not stored or missing.limit(1).count():
            # a longer cell along x is the same pattern read at a shorter x
            at = f.grid().join(by_shuffle(missing), "sample_id").withColumn("x", F.col("x") / F.col("stretch"))
            near = fields.contrasts(at.drop("stretch"), seeds).join(by_shuffle(missing), "sample_id")
            stored.append(plates.plate_bricks(near, values, by))

    def figures(rows):
        if stretches:
            bricks_of(rows)
        counts = plates.plate_counts(reduce(DataFrame.unionByName, stored), values, rows.select(*by, "iso", "threshold"),
                                     lambda v, s: (1.0 - s["threshold"]) * v["wall"] + s["threshold"] * v["strut"] < s["iso"], by)
        return plates.plate_figures(counts, STEP)

    def measured(figure):
        return lambda rows: figures(rows).select("sample_id", figure.alias("metric"))

    anisotropy, thickness, porosity = (measured(e) for e in (plates.axis_ratio(), F.col("thickness"), F.col("porosity")))
    return {"anisotropy": anisotropy, "thickness": thickness, "porosity": porosity}


@query("bt2_nested_calibration", "l:sample_id,rounds s:anisotropy_status,thickness_status,porosity_status d:stretch,iso,threshold,thickness_metric,porosity_metric")
def _(f):
    """Three targets a sample: anisotropy by stretch, thickness by iso level, porosity by openness."""
    from ..plans.calibrate import nested

    start = f.samples().select("sample_id", L(1.2).alias("stretch"), L(0.9).alias("iso"), L(0.5).alias("threshold"), (F.col("sample_id") % 3 * 0.1 + 1.1).alias("target_anisotropy"),
                               (F.col("sample_id") % 4 * 0.1 + 1.4).alias("target_thickness"), L(0.64).alias("target_porosity"))
    return nested(start, _knob_measures(f), tol=0.015, most=3)


@query("bt4_two_knobs", "l:sample_id,backed_off s:porosity_status b:settled d:iso,threshold,porosity_metric")
def _(f):
    """Thickness by iso level, then porosity by openness, again while the one has moved the other."""
    from ..plans.calibrate import two_knobs

    measures = _knob_measures(f, stretches=False)
    start = f.samples().select("sample_id", L(1.0).alias("stretch"), L(0.0).alias("smooth_k"), (F.col("sample_id") % 4 * 0.1 + 1.4).alias("target_thickness"), L(0.64).alias("target_porosity"))
    return two_knobs(start.withColumn("iso", F.col("target_thickness")), measures["thickness"], measures["porosity"], tol=0.05, passes=2, backs=0)


@query("bt9_reference_trials", "l:sample_id s:trial,number_formula b:converged d:iso,threshold,thickness,thickness_off,porosity,porosity_off,tb_n,tb_n_off")
def _(f):
    """Published rows against a manual trial (iso level as published, openness solved) and a calibrated one (both solved).

    References come through the CSV reader; the number is compared by the formula that each row names.
    """
    from ..plans.calibrate import nested
    from ..sources import tables

    path = f"{scratch_root(f.spark)}/voxframe/literature-{uuid.uuid4().hex}"
    rows = f.samples().select(F.col("sample_id").cast("string").alias("sample_id"), L("box").alias("container_type"), (F.col("sample_id") % 4 * 0.1 + 1.4).alias("tb_th"), (F.col("sample_id") % 3 * 4.0 + 68.0).alias("porosity_pct"),
                              L(0.2).alias("tb_n"), F.when(F.col("sample_id") % 2 == 0, "inv_tbsp").otherwise("bvtv_tbth").alias("tbn_formula"))
    tables.write_csv(rows, path)
    refs = materialize(tables.read_references(f.spark, path).withColumn("sample_id", F.col("sample_id").cast("long")), "references")
    measures = _knob_measures(f, stretches=False)
    start = refs.select("sample_id", L(1.0).alias("stretch"), F.col("tb_th").alias("iso"), L(0.5).alias("threshold"), F.col("tb_th").alias("target_thickness"), (F.col("porosity_pct") / 100).alias("target_porosity"))
    manual = nested(start, {"porosity": measures["porosity"]}, tol=0.03, most=4)
    solved = nested(start, {k: measures[k] for k in ("thickness", "porosity")}, tol=0.03, most=4)
    out = None
    for name, trial in (("manual", manual), ("calibrated", solved)):
        trial = materialize(trial, "trial")
        thick = measures["thickness"](trial).select("sample_id", F.col("metric").alias("thickness"))
        met = F.col("porosity_status").isin("ok", "pinned") & (F.col("thickness_status").isin("ok", "pinned") if name == "calibrated" else L(True))
        part = trial.withColumn("converged", met).select("sample_id", L(name).alias("trial"), "converged", "iso", "threshold", F.col("porosity_metric").alias("porosity")).join(thick, "sample_id")
        out = part if out is None else out.unionByName(part)
    known = out.join(refs.select("sample_id", "tb_th", "porosity_pct", F.col("tb_n").alias("tb_n_ref"), F.col("tbn_formula").alias("number_formula")), "sample_id")
    # plate model: the space between plates is what thickness leaves of the spacing
    separation = F.try_divide(F.col("thickness") * F.col("porosity"), 1 - F.col("porosity"))
    number = F.when(F.col("number_formula") == "inv_tbsp", measure.number_by_separation(separation)).otherwise(measure.number_by_ratio(1 - F.col("porosity"), F.col("thickness")))
    return known.withColumns({"tb_n": number, "thickness_off": F.col("thickness") - F.col("tb_th"), "porosity_off": F.col("porosity") - F.col("porosity_pct") / 100}).withColumn(
        "tb_n_off", F.col("tb_n") - F.col("tb_n_ref"))


@query("bt10_phantom_truth", "l:sample_id,chi s:shape b:thin_ok", """SELECT sample_id, CASE sample_id%4 WHEN 3 THEN 0 ELSE 1 END AS chi, ['slab','cylinder','sphere','torus'][sample_id%4+1] AS shape, true AS thin_ok FROM ids""")
def _(f):
    """Loops and thickness of analytic shapes against their known values: chi 1 without loops, 0 with one; thickness within a voxel and a half."""
    shape = F.get(F.array(*map(L, sampling.SHAPES)), (F.col("sample_id") % 4).cast("int"))
    shapes = f.samples().select("sample_id", shape.alias("shape"), L(4.0).alias("feature"), L(1.0).alias("voxel"))
    image = materialize(sampling.phantom_grid(shapes).select(*KEY, "shape", (F.col("value") < 0.01).alias("solid")), "phantoms")
    chi = measure.euler_number(image.filter("solid"))
    thick = measure.local_thickness(image.select(*KEY, "solid"), 1.0)
    return shapes.join(chi, "sample_id").join(thick, "sample_id").select("sample_id", "chi", "shape", (F.abs(F.col("thickness") - 4.0) <= 2.5).alias("thin_ok"))
