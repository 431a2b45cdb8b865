"""Queries on distances, spatial joins, generators, anisotropy and fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import fields, grid, sampling, spatial
from ..sources.scratch import materialize
from .fixtures import N, STEP, Fixtures
from .registry import query

L = F.lit


class Deferred:
    """A vector whose columns are made on use, so that queries can be listed without a session."""

    def __init__(self, make):
        self._make = make

    def __iter__(self):
        return iter(self._make())

    def __getitem__(self, n):
        return self._make()[n]


P = Deferred(g.vec)


def three(a: float, b: float, c: float) -> g.Vector:
    return (L(a), L(b), L(c))


BOX = (Deferred(lambda: three(0.0, 0.0, 0.0)), Deferred(lambda: three(16.0, 12.0, 10.0)))
GAP = "abs(x-8)-8 AS gx, abs(y-6)-6 AS gy, abs(z-5)-5 AS gz"
BOX_SQL = f"sqrt(greatest(gx,0)*greatest(gx,0)+greatest(gy,0)*greatest(gy,0)+greatest(gz,0)*greatest(gz,0))+least(greatest(gx,gy,gz),0)"
CYL_SQL = "sqrt(greatest(s,0)*greatest(s,0)+greatest(c,0)*greatest(c,0))+least(greatest(s,c),0)"
CYL_FROM = "SELECT *, sqrt((x-8)*(x-8)+(z-8)*(z-8))-7 AS s, abs(y-6)-6 AS c FROM points"


# 2.1 grids

@query("io15_grid_points", "l:sample_id,i,j,k d:x,y,z", "SELECT * FROM grid")
def _(f: Fixtures):
    return f.grid()


@query("io16_padded_grid", "l:sample_id,i,j,k d:x,y,z", f"""SELECT sample_id, a.n AS i, b.n AS j, c.n AS k, a.n*{STEP} AS x, b.n*{STEP} AS y, c.n*{STEP} AS z
    FROM ids, (SELECT range-2 AS n FROM range({N + 4})) a, (SELECT range-2 AS n FROM range({N + 4})) b, (SELECT range-2 AS n FROM range({N + 4})) c""")
def _(f):
    return grid.grid_points(f.samples(), pad=2)


# 2.3 distances and predicates

@query("pr1_box_distance", "l:point_id d:distance", f"SELECT point_id, {BOX_SQL} AS distance FROM (SELECT *, {GAP} FROM points)")
def _(f):
    return f.common("points").select("point_id", g.box_distance(P, *BOX).alias("distance"))


@query("pr2_cylinder_distance", "l:point_id d:distance", f"SELECT point_id, {CYL_SQL} AS distance FROM ({CYL_FROM})")
def _(f):
    return f.common("points").select("point_id", g.cylinder_distance(P, (L(8.0), L(8.0)), L(7.0), L(12.0)).alias("distance"))


@query("pr3_plane_distance", "l:point_id d:distance", "SELECT point_id, (x-1)*0.6+(y-2)*0.0+(z-3)*0.8 AS distance FROM points")
def _(f):
    return f.common("points").select("point_id", g.plane_distance(P, three(1, 2, 3), three(0.6, 0.0, 0.8)).alias("distance"))


@query("pr4_point_distance", "l:point_id d:distance", "SELECT point_id, sqrt((x-8)*(x-8)+(y-8)*(y-8)+(z-8)*(z-8)) AS distance FROM points")
def _(f):
    return f.common("points").select("point_id", g.point_distance(P, three(8.0, 8.0, 8.0)).alias("distance"))


@query("pr5_inside_box", "l:point_id b:by_bounds,by_distance", f"""SELECT point_id, x BETWEEN 0 AND 16 AND y BETWEEN 0 AND 12 AND z BETWEEN 0 AND 10 AS by_bounds,
    {BOX_SQL} < 1e-4 AS by_distance FROM (SELECT *, {GAP} FROM points)""")
def _(f):
    return f.common("points").select("point_id", g.in_bounds(P, *BOX).alias("by_bounds"), g.inside(g.box_distance(P, *BOX)).alias("by_distance"))


@query("pr6_inside_oriented_cylinder", "l:point_id b:inside", """SELECT point_id, t BETWEEN 0 AND 12 AND
    sqrt((x-2-0.6*t)*(x-2-0.6*t)+(y-1-0.8*t)*(y-1-0.8*t)+(z-8)*(z-8)) <= 5 AS inside FROM (SELECT *, (x-2)*0.6+(y-1)*0.8+(z-8)*0.0 AS t FROM points)""")
def _(f):
    return f.common("points").select("point_id", g.in_oriented_cylinder(P, three(2, 1, 8), three(0.6, 0.8, 0.0), L(5.0), L(12.0)).alias("inside"))


@query("pr7_inside_torus", "l:point_id b:inside", """SELECT point_id, (sqrt((x-8)*(x-8)+(y-8)*(y-8))-5)*(sqrt((x-8)*(x-8)+(y-8)*(y-8))-5)+(z-8)*(z-8) < 4 AS inside FROM points""")
def _(f):
    return f.common("points").select("point_id", g.in_torus(g.sub(P, three(8, 8, 8)), L(5.0), L(2.0)).alias("inside"))


@query("pr9_domain_bounds", "l:sample_id d:xmin,xmax,ymin,ymax,zmin,zmax,box_volume,cylinder_volume", """SELECT sample_id, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax,
    min(z) AS zmin, max(z) AS zmax, (max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z)) AS box_volume, pi()*max(x)*max(x)*max(y) AS cylinder_volume FROM seeds GROUP BY sample_id""", digits=4)
def _(f):
    from ..operators.surface import mesh_bounds

    return mesh_bounds(f.common("seeds")).withColumns({
        "box_volume": g.box_volume(tuple(F.col(f"{a}min") for a in "xyz"), tuple(F.col(f"{a}max") for a in "xyz")),
        "cylinder_volume": g.cylinder_volume(F.col("xmax"), F.col("ymax"))})


@query("pr10_radius_functions", "l:point_id d:linear,quadratic,smooth,fixed", """SELECT point_id, 0.2+(0.9-0.2)*t AS linear, 0.2+(0.9-0.2)*t*t AS quadratic,
    0.2+(0.9-0.2)*(t*t*(3-t*2)) AS smooth, 0.2 AS fixed FROM (SELECT point_id, greatest(least((x-1)/10, 1), 0) AS t FROM points)""")
def _(f):
    a = (F.col("x") - 1.0, L(0.2), L(0.9), L(10.0))
    return f.common("points").select("point_id", g.linear_radius(*a).alias("linear"), g.quadratic_radius(*a).alias("quadratic"), g.smoothstep_radius(*a).alias("smooth"), g.constant_radius(*a).alias("fixed"))


@query("pr11_function_dispatch", "l:point_id,option d:radius", """SELECT point_id, point_id % 4 AS option, CASE point_id % 4 WHEN 0 THEN 0.2 WHEN 1 THEN 0.2+(0.9-0.2)*t
    WHEN 2 THEN 0.2+(0.9-0.2)*t*t ELSE 0.2+(0.9-0.2)*(t*t*(3-t*2)) END AS radius FROM (SELECT point_id, greatest(least(abs(y-8)/6, 1), 0) AS t FROM points)""")
def _(f):
    a = (F.abs(g.plane_distance(P, three(0, 8, 0), three(0, 1, 0))), L(0.2), L(0.9), L(6.0))
    option = F.col("point_id") % 4
    return f.common("points").select("point_id", option.alias("option"), g.choose(option, [fn(*a) for fn in g.RADIUS_FUNCTIONS]).alias("radius"))


@query("pr12_container_mask", "l:sample_id,i,j,k", f"SELECT sample_id, i, j, k FROM (SELECT *, sqrt((x-8)*(x-8)+(z-8)*(z-8))-7 AS s, abs(y-6)-6 AS c FROM grid) WHERE {CYL_SQL} < 1e-4")
def _(f):
    return f.grid().filter(g.inside(g.cylinder_distance(P, (L(8.0), L(8.0)), L(7.0), L(12.0))))


@query("pr13_narrow_band", "l:sample_id,ci,cj,ck s:kind", f"""SELECT sample_id, ci, cj, ck, CASE WHEN min(d) > 1.0+{STEP}*3.4641016151377544 THEN 'outside' WHEN max(d) < -(1.0+{STEP}*3.4641016151377544) THEN 'inside' ELSE 'exact' END AS kind
    FROM (SELECT sample_id, i//2 AS ci, j//2 AS cj, k//2 AS ck, {BOX_SQL} AS d FROM (SELECT *, {GAP} FROM grid)) GROUP BY ALL""")
def _(f):
    coarse = f.grid().select("sample_id", *(F.floor(F.col(c) / 2).alias(f"c{c}") for c in "ijk"), g.box_distance(P, *BOX).alias("distance"))
    return spatial.needs_exact(coarse, ["ci", "cj", "ck"], 1.0, STEP * 3.4641016151377544)


@query("pr14_scale_points", "l:sample_id,seed_id d:x,y,z", """SELECT sample_id, seed_id, mx+(x-mx)*1.5 AS x, my+(y-my)*1.5 AS y, mz+(z-mz)*1.5 AS z FROM seeds
    JOIN (SELECT sample_id, (min(x)+max(x))/2 AS mx, (min(y)+max(y))/2 AS my, (min(z)+max(z))/2 AS mz FROM seeds GROUP BY sample_id) USING (sample_id)""")
def _(f):
    return grid.scale_about_centre(f.common("seeds"), 1.5)


def _rois(f: Fixtures):
    s = f.common("seeds").filter("p_size < 12")
    return s.select("sample_id", F.col("seed_id").alias("roi_id"), *(e.alias(f"{a}{m}") for a in "xyz" for m, e in (("min", F.col(a) - 2.5), ("max", F.col(a) + F.col("p_size") / 4))))


ROIS = "SELECT sample_id, seed_id AS roi_id, x-2.5 AS xmin, x+p_size/4.0 AS xmax, y-2.5 AS ymin, y+p_size/4.0 AS ymax, z-2.5 AS zmin, z+p_size/4.0 AS zmax FROM seeds WHERE p_size < 12"


@query("pr15_clip_regions", "l:sample_id,roi_id d:xmin,ymin,zmin,xmax,ymax,zmax s:status", f"""SELECT *, CASE WHEN xmin<xmax AND ymin<ymax AND zmin<zmax THEN 'ok' ELSE 'empty' END AS status FROM (
    SELECT sample_id, roi_id, greatest(xmin,3.0) AS xmin, greatest(ymin,3.0) AS ymin, greatest(zmin,3.0) AS zmin, least(xmax,12.0) AS xmax, least(ymax,12.0) AS ymax, least(zmax,12.0) AS zmax FROM ({ROIS}))""")
def _(f):
    bounds = f.samples().select("sample_id", *(L(v).alias(f"{a}{m}") for a in "xyz" for m, v in (("min", 3.0), ("max", 12.0))))
    return grid.clip_regions(_rois(f), bounds)


MESH_BOX = "SELECT sample_id, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM seeds GROUP BY sample_id"


@query("im2_windows", "l:sample_id,roi_id,points,solid s:choice", f"""WITH box AS ({MESH_BOX}), want AS (
    SELECT 'grid' AS choice, sample_id, 0 AS roi_id, -1.0 AS xmin, 99.0 AS xmax, -1.0 AS ymin, 99.0 AS ymax, -1.0 AS zmin, 99.0 AS zmax FROM ids
    UNION ALL SELECT 'mesh', sample_id, 0, xmin, xmax, ymin, ymax, zmin, zmax FROM box
    UNION ALL SELECT 'roi', b.sample_id, roi_id, greatest(r.xmin,b.xmin), least(r.xmax,b.xmax), greatest(r.ymin,b.ymin), least(r.ymax,b.ymax), greatest(r.zmin,b.zmin), least(r.zmax,b.zmax) FROM box b JOIN ({ROIS}) r USING (sample_id)),
    cut AS (SELECT choice, sample_id, roi_id, greatest(xmin,0) AS xmin, least(xmax,{STEP * (N - 1)}) AS xmax, greatest(ymin,0) AS ymin, least(ymax,{STEP * (N - 1)}) AS ymax, greatest(zmin,0) AS zmin, least(zmax,{STEP * (N - 1)}) AS zmax FROM want)
    SELECT f.sample_id, choice, roi_id, count(*) AS points, count(*) FILTER (value < 0.5) AS solid FROM field f JOIN cut c ON c.sample_id = f.sample_id AND xmin < xmax AND ymin < ymax AND zmin < zmax
    AND i BETWEEN floor(xmin/{STEP}) AND ceil(xmax/{STEP}) AND j BETWEEN floor(ymin/{STEP}) AND ceil(ymax/{STEP}) AND k BETWEEN floor(zmin/{STEP}) AND ceil(zmax/{STEP}) GROUP BY ALL""")
def _(f):
    """Points and solid points of the stored field in each kind of window."""
    bounds = f.common("seeds").groupBy("sample_id").agg(*(e(a).alias(f"{a}{m}") for a in "xyz" for m, e in (("min", F.min), ("max", F.max))))
    parts = []
    for choice in ("grid", "mesh", "roi"):
        windows = grid.choose_windows(f.samples(), bounds, _rois(f), choice).filter("status = 'ok'")
        inside = grid.extract_regions(f.field(), windows, f.samples())
        parts.append(inside.groupBy("sample_id", "roi_id").agg(F.count("*").alias("points"), F.count_if(F.col("value") < 0.5).alias("solid")).withColumn("choice", L(choice)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("pr16_extract_regions", "l:sample_id,roi_id,i,j,k d:value", f"""SELECT f.sample_id, roi_id, i-i0 AS i, j-j0 AS j, k-k0 AS k, value FROM field f JOIN (SELECT sample_id, roi_id,
    greatest(floor(xmin/{STEP}),0) AS i0, greatest(floor(ymin/{STEP}),0) AS j0, greatest(floor(zmin/{STEP}),0) AS k0, least(ceil(xmax/{STEP}),{N - 1}) AS i1, least(ceil(ymax/{STEP}),{N - 1}) AS j1, least(ceil(zmax/{STEP}),{N - 1}) AS k1
    FROM ({ROIS})) r ON r.sample_id = f.sample_id AND i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1 AND k BETWEEN k0 AND k1""")
def _(f):
    return grid.extract_regions(f.field(), _rois(f), f.samples())


# 2.4 joins

D2 = "(p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)+(p.z-s.z)*(p.z-s.z)"


@query("sj1_knn_join", "l:sample_id,point_id,rank,seed_id d:d2", f"""SELECT * FROM (SELECT p.sample_id, p.point_id, s.seed_id, {D2} AS d2,
    row_number() OVER (PARTITION BY p.sample_id, p.point_id ORDER BY {D2}, s.seed_id) AS rank FROM points p JOIN seeds s USING (sample_id)) WHERE rank <= 4""")
def _(f):
    return spatial.knn_join(f.common("points"), f.common("seeds"), 4, ["point_id"])


@query("sj1_knn_join_by_cells", "l:sample_id,point_id,rank,seed_id d:d2", f"""SELECT * FROM (SELECT p.sample_id, p.point_id, s.seed_id, {D2} AS d2,
    row_number() OVER (PARTITION BY p.sample_id, p.point_id ORDER BY {D2}, s.seed_id) AS rank FROM points p JOIN seeds s USING (sample_id)) WHERE rank <= 3""")
def _(f):
    return spatial.knn_join(f.common("points"), f.common("seeds"), 3, ["point_id"], cell=4.0, small_right=0)


@query("sj2_nearest_seed", "l:sample_id,point_id,seed_id d:d2", f"""SELECT p.sample_id, p.point_id, min_by(s.seed_id, ({D2}, s.seed_id)) AS seed_id, min({D2}) AS d2 FROM points p JOIN seeds s USING (sample_id) GROUP BY ALL""")
def _(f):
    return spatial.nearest(f.common("points"), f.common("seeds"), ["point_id"])


@query("sj3_radius_join", "l:sample_id,point_id,seed_id d:distance", f"""SELECT p.sample_id, p.point_id, s.seed_id, sqrt({D2}) AS distance FROM points p JOIN seeds s USING (sample_id) WHERE sqrt({D2}) <= 2.5""")
def _(f):
    return spatial.radius_join(f.common("points"), f.common("seeds"), 2.5, cell=2.5)


@query("sj4_local_metric_knn", "l:sample_id,point_id,metric_rank,seed_id d:m2", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, point_id ORDER BY m2, rank) AS metric_rank FROM (
    SELECT p.sample_id, p.point_id, s.seed_id, row_number() OVER (PARTITION BY p.sample_id, p.point_id ORDER BY {D2}, s.seed_id) AS rank,
    2.0*(s.x-p.x)*(s.x-p.x)+1.0*(s.y-p.y)*(s.y-p.y)+(0.5+p.z/20)*(s.z-p.z)*(s.z-p.z)+(0.25*(s.x-p.x)*(s.y-p.y)+0.0*(s.x-p.x)*(s.z-p.z)+0.125*(s.y-p.y)*(s.z-p.z))*2 AS m2
    FROM points p JOIN seeds s USING (sample_id)) WHERE rank <= 12) WHERE metric_rank <= 4""")
def _(f):
    near = spatial.knn_join(f.common("points"), f.common("seeds"), 12, ["point_id"])
    return spatial.local_metric_knn(near, [L(2.0), L(0.25), L(0.0), L(1.0), L(0.125), F.col("z") / 20 + 0.5], ["point_id"])


def _cells(f):
    return spatial.voronoi_cells(f.grid(), f.common("seeds"), ["i", "j", "k"])


@query("sj10_voronoi_cells", "l:sample_id,i,j,k,id1,id2,face_a,face_b", """SELECT sample_id, i, j, k, id1, id2, least(id1,id2) AS face_a, greatest(id1,id2) AS face_b FROM (
    SELECT sample_id, i, j, k, max(seed_id) FILTER (rank=1) AS id1, max(seed_id) FILTER (rank=2) AS id2 FROM near GROUP BY ALL)""")
def _(f):
    return _cells(f)


CONTACTS = """SELECT sample_id, least(u,v) AS a, greatest(u,v) AS b, count(*) AS faces, avg(mi) AS mi, avg(mj) AS mj, avg(mk) AS mk FROM (
    SELECT o.sample_id, o.seed_id AS u, p.seed_id AS v, (o.i+p.i)/2.0 AS mi, (o.j+p.j)/2.0 AS mj, (o.k+p.k)/2.0 AS mk FROM near o JOIN near p
    ON o.sample_id=p.sample_id AND o.rank=1 AND p.rank=1 AND ((p.i=o.i+1 AND p.j=o.j AND p.k=o.k) OR (p.i=o.i AND p.j=o.j+1 AND p.k=o.k) OR (p.i=o.i AND p.j=o.j AND p.k=o.k+1)) AND o.seed_id<>p.seed_id) GROUP BY ALL"""


@query("sj11_seed_adjacency", "l:sample_id,a,b,faces d:mi,mj,mk", CONTACTS)
def _(f):
    return spatial.seed_adjacency(_cells(f))


@query("sj11_open_contacts", "l:sample_id,a,b b:open", f"SELECT c.sample_id, c.a, c.b, coalesce(f.value > 0.4, false) AS open FROM ({CONTACTS}) c LEFT JOIN field f ON f.sample_id=c.sample_id AND f.i=floor(c.mi+0.5) AND f.j=floor(c.mj+0.5) AND f.k=floor(c.mk+0.5)")
def _(f):
    """Edges of the pore network: contacts of cells that the field leaves open."""
    return spatial.open_contacts(spatial.seed_adjacency(_cells(f)), f.field(), 0.4)


@query("sj7_ray_box", "l:point_id d:entry,leave b:hit", """SELECT point_id, entry, leave, entry <= leave AND leave >= 0 AS hit FROM (SELECT point_id,
    greatest(least((2-x)/0.6,(9-x)/0.6), least((3-y)/0.48,(11-y)/0.48), least((4-z)/0.64,(12-z)/0.64)) AS entry,
    least(greatest((2-x)/0.6,(9-x)/0.6), greatest((3-y)/0.48,(11-y)/0.48), greatest((4-z)/0.64,(12-z)/0.64)) AS leave FROM points)""")
def _(f):
    t0, t1 = g.ray_meets_box(P, three(0.6, 0.48, 0.64), three(2, 3, 4), three(9, 11, 12))
    return f.common("points").select("point_id", t0.alias("entry"), t1.alias("leave")).withColumn("hit", (F.col("entry") <= F.col("leave")) & (F.col("leave") >= 0))


@query("sj8_ray_triangle", "l:point_id d:t", """SELECT point_id, t FROM (SELECT point_id, (12-x)/1.0 AS t, y+(12-x)*0.0 AS hy, z AS hz FROM points) WHERE t > 1e-9
    AND hy >= 1 AND hz >= 1 AND (hy-1)/14.0+(hz-1)/14.0 <= 1""")
def _(f):
    hit = g.ray_meets_triangle(P, three(1, 0, 0), three(12, 1, 1), three(12, 15, 1), three(12, 1, 15))
    return f.common("points").select("point_id", hit.alias("t")).filter("t is not null")


@query("sj9_barycentric", "l:point_id d:u,v,w", "SELECT point_id, 1-v-w AS u, v, w FROM (SELECT point_id, (x-1)/14.0 AS v, (y-1)/12.0 AS w FROM points)")
def _(f):
    u, v, w = g.barycentric(P, three(1, 1, 3), three(15, 1, 3), three(1, 13, 3))
    return f.common("points").select("point_id", u.alias("u"), v.alias("v"), w.alias("w"))


# 2.2 generators

@query("gn7_design_scaling", "l:row_id d:radius,thickness,pullback", """SELECT row_id, u0*(3.0-0.6)+0.6 AS radius, greatest(least(u1*(u0*(3.0-0.6)+0.6),5.0),0.1) AS thickness, u2*0.5+0.5 AS pullback FROM (
    SELECT p_partkey AS row_id, CAST(p_partkey*7919%1000 AS DOUBLE)/1000 AS u0, CAST(p_partkey*104729%1000 AS DOUBLE)/1000 AS u1, CAST(p_size AS DOUBLE)/50 AS u2 FROM part)""")
def _(f):
    unit = f.table("part").select(F.col("p_partkey").alias("row_id"), *((F.col("p_partkey") * p % 1000 / 1000.0).alias(n) for n, p in (("u0", 7919), ("u1", 104729))), (F.col("p_size") / 50.0).alias("u2"))
    return sampling.scale_design(unit, "uniform")


@query("gn6_latin_hypercube", "l:n,bins0,bins1,bins2 b:in_bin", "SELECT count(*) AS n, count(*) AS bins0, count(*) AS bins1, count(*) AS bins2, true AS in_bin FROM part")
def _(f):
    rows = f.table("part").select(F.col("p_partkey").alias("row_id"))
    u = sampling.latin_hypercube(rows, 3, 7)
    n = rows.count()
    return u.agg(F.count("*").alias("n"), *(F.countDistinct(F.floor(F.col(f"u{d}") * n)).alias(f"bins{d}") for d in range(3)),
                 F.min(F.least("u0", "u1", "u2") >= 0).alias("_lo"), F.max(F.greatest("u0", "u1", "u2")).alias("_hi")).withColumn("in_bin", F.col("_lo") & (F.col("_hi") < 1))


@query("gn8_fibonacci_directions", "l:sample_id,d d:dx,dy,dz", """SELECT sample_id, d, sin(p)*cos(t) AS dx, sin(p)*sin(t) AS dy, cos(p) AS dz FROM (
    SELECT sample_id, d, acos(1.0-(d+0.5)*2.0/41) AS p, d*3.141592653589793*3.23606797749979 AS t FROM (SELECT sample_id, seed_id - min(seed_id) OVER (PARTITION BY sample_id) AS d FROM seeds))""")
def _(f):
    rows = f.common("seeds").select("sample_id", (F.col("seed_id") - F.min("seed_id").over(Window.partitionBy("sample_id"))).alias("d"))
    return sampling.fibonacci_directions(rows, L(41))


BASE = "SELECT sample_id, 0.3 AS thickness, 0.5 AS openness, CAST(sample_id%7 AS DOUBLE)/7 AS spread FROM ids"


def _base(f):
    return f.samples().select("sample_id", L(0.3).alias("thickness"), L(0.5).alias("openness"), ((F.col("sample_id") % 7) / 7.0).alias("spread"))


@query("gn9_sweep_rows", "l:sample_id,step s:swept d:thickness,openness,spread", f"""SELECT sample_id, range AS step, 'thickness' AS swept, range*((0.6-0.1)/4)+0.1 AS thickness, openness, spread FROM ({BASE}), range(5)
    UNION ALL SELECT sample_id, range AS step, 'openness' AS swept, thickness, range*((1.0-0.0)/4)+0.0, spread FROM ({BASE}), range(5)""")
def _(f):
    return sampling.sweep_rows(_base(f), {"thickness": (0.1, 0.6), "openness": (0.0, 1.0)}, 5)


@query("gn9_sweep_grid", "l:sample_id,step0,step1 d:thickness,openness,spread", f"""SELECT sample_id, a.range AS step0, b.range AS step1, a.range*((0.6-0.1)/3)+0.1 AS thickness, b.range*(1.0/2)+0.0 AS openness, spread FROM ({BASE}), range(4) a, range(3) b""")
def _(f):
    return sampling.sweep_grid(_base(f), ("thickness", 0.1, 0.6, 4), ("openness", 0.0, 1.0, 3))


@query("gn11_replicates", "l:sample_id,replicate d:spread", f"SELECT sample_id, range+1 AS replicate, spread FROM ({BASE}), range(6)")
def _(f):
    return sampling.replicates(_base(f), 6)


@query("gn12_value_list", "l:sample_id,position d:value", """SELECT sample_id, value, row_number() OVER (PARTITION BY sample_id ORDER BY value) AS position FROM (SELECT DISTINCT sample_id, round(value,6) AS value FROM (
    SELECT sample_id, 1.0+range*0.5 AS value FROM ids, range(7) UNION ALL SELECT sample_id, CAST(p_size AS DOUBLE)/8 FROM seeds))""")
def _(f):
    ranges = f.samples().select("sample_id", L(1.0).alias("lo"), L(4.0).alias("hi"), L(0.5).alias("step"))
    return sampling.value_list(ranges, f.common("seeds").select("sample_id", (F.col("p_size") / 8.0).alias("value")))


@query("gn10_constrained_cohort", "l:sample_id,draw_no d:thickness,spacing,openness b:holds")
def _(f):
    return sampling.constrained_cohort(f.samples().select("sample_id"), 11).withColumn("holds", F.col("spacing") >= F.col("thickness") * 2.5)


@query("gn1_random_points", "l:sample_id,n b:inside", "SELECT sample_id, count(*) AS n, true AS inside FROM seeds GROUP BY sample_id")
def _(f):
    domains = f.common("seeds").groupBy("sample_id").agg(F.count("*").alias("n")).withColumns({f"{a}{m}": L(v) for a in "xyz" for m, v in (("min", 0.1), ("max", 15.9))})
    ball = g.point_distance(P, three(8, 8, 8)) < 7.8
    made = sampling.random_points(domains, "n", ball, 5)
    return made.groupBy("sample_id").agg(F.count("*").alias("n"), F.min(ball).alias("inside"))


@query("gn2_minimum_distance", "l:sample_id,seed_id", """WITH RECURSIVE s AS (SELECT sample_id, seed_id, x, y, z, row_number() OVER (PARTITION BY sample_id ORDER BY seed_id) AS r FROM seeds),
    walk AS (SELECT sample_id, r, [{'id': seed_id, 'x': x, 'y': y, 'z': z}] AS kept FROM s WHERE r = 1 UNION ALL
    SELECT s.sample_id, s.r, CASE WHEN len(list_filter(kept, lambda q: sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)+(q.z-s.z)*(q.z-s.z)) <= 4.0)) = 0 THEN list_append(kept, {'id': s.seed_id, 'x': s.x, 'y': s.y, 'z': s.z}) ELSE kept END
    FROM walk w JOIN s ON s.sample_id = w.sample_id AND s.r = w.r + 1)
    SELECT sample_id, unnest(list_transform(kept, lambda q: q.id)) AS seed_id FROM walk WHERE (sample_id, r) IN (SELECT sample_id, max(r) FROM s GROUP BY sample_id)""")
def _(f):
    return sampling.thin_by_distance(f.common("seeds"), 4.0, 4.0)


@query("gn2_maximal_points", "l:sample_id,close_pairs,open_nodes", "SELECT sample_id, 0 AS close_pairs, 0 AS open_nodes FROM ids")
def _(f):
    """Points that leave no room for another: pairs within the distance and grid nodes with no point within it, counted."""
    points = materialize(sampling.maximal_points(f.samples(), 5.0, seed=7), "maximal")
    own = points.withColumnRenamed("seed_id", "own_id")
    close = spatial.radius_join(own, points, 5.0, cell=5.0).filter("own_id < seed_id").groupBy("sample_id").agg(F.count("*").alias("close_pairs"))
    met = spatial.radius_join(f.grid(), points, 5.0, cell=5.0).select("sample_id", *"ijk").distinct()
    left = f.grid().join(met, ["sample_id", *"ijk"], "left_anti").groupBy("sample_id").agg(F.count("*").alias("open_nodes"))
    return points.select("sample_id").distinct().join(close, "sample_id", "left").join(left, "sample_id", "left").na.fill(0, ["close_pairs", "open_nodes"])


@query("gn3_graded_spacing", "l:sample_id,seed_id", """WITH RECURSIVE s AS (SELECT sample_id, seed_id, x, y, z, 1.5+(5.0-1.5)*greatest(least(abs(x-8)/8,1),0) AS rad, row_number() OVER (PARTITION BY sample_id ORDER BY seed_id) AS r FROM seeds),
    walk AS (SELECT sample_id, r, [{'id': seed_id, 'x': x, 'y': y, 'z': z}] AS kept FROM s WHERE r = 1 UNION ALL
    SELECT s.sample_id, s.r, CASE WHEN len(list_filter(kept, lambda q: sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)+(q.z-s.z)*(q.z-s.z)) <= s.rad)) = 0 THEN list_append(kept, {'id': s.seed_id, 'x': s.x, 'y': s.y, 'z': s.z}) ELSE kept END
    FROM walk w JOIN s ON s.sample_id = w.sample_id AND s.r = w.r + 1)
    SELECT sample_id, unnest(list_transform(kept, lambda q: q.id)) AS seed_id FROM walk WHERE (sample_id, r) IN (SELECT sample_id, max(r) FROM s GROUP BY sample_id)""")
def _(f):
    radius = g.linear_radius(F.abs(F.col("x") - 8.0), L(1.5), L(5.0), L(8.0))
    return sampling.thin_by_distance(f.common("seeds"), radius, 5.0)


@query("gn4_stochastic_radius", "l:sample_id,n b:in_range", "SELECT sample_id, count(*) AS n, true AS in_range FROM seeds GROUP BY sample_id")
def _(f):
    r = sampling.stochastic_radius(L(1.0), L(0.4), L(0.5), L(1.6), 3, F.col("sample_id"), F.col("seed_id"))
    return f.common("seeds").withColumn("r", r).groupBy("sample_id").agg(F.count("*").alias("n"), F.min(F.col("r").between(0.5, 1.6)).alias("in_range"))


@query("gn13_phantoms", "l:sample_id,i,j,k s:shape d:value", """SELECT sample_id, i, j, k, shape, CASE shape WHEN 'slab' THEN abs(z-6)-1 WHEN 'cylinder' THEN sqrt((x-6)*(x-6)+(y-6)*(y-6))-1
    WHEN 'sphere' THEN sqrt((x-6)*(x-6)+(y-6)*(y-6)+(z-6)*(z-6))-1 ELSE sqrt((sqrt((x-6)*(x-6)+(y-6)*(y-6))-2)*(sqrt((x-6)*(x-6)+(y-6)*(y-6))-2)+(z-6)*(z-6))-1 END AS value FROM (
    SELECT sample_id, a.n AS i, b.n AS j, c.n AS k, CAST(a.n AS DOUBLE) AS x, CAST(b.n AS DOUBLE) AS y, CAST(c.n AS DOUBLE) AS z, ['slab','cylinder','sphere','torus'][sample_id%4+1] AS shape
    FROM ids, (SELECT range AS n FROM range(13)) a, (SELECT range AS n FROM range(13)) b, (SELECT range AS n FROM range(13)) c)""")
def _(f):
    shape = F.get(F.array(*map(L, sampling.SHAPES)), (F.col("sample_id") % 4).cast("int"))
    return sampling.phantom_grid(f.samples().select("sample_id", shape.alias("shape"), L(2.0).alias("feature"), L(1.0).alias("voxel")))


# 2.5 anisotropy

@query("ag1_covariance", "l:seed_id d:xx,xy,xz,yy,yz,zz", """SELECT seed_id, c*c*sx+s*s*sy AS xx, c*s*sx*-1+s*c*sy AS xy, 0.0 AS xz, s*s*sx+c*c*sy AS yy, 0.0 AS yz, sz AS zz FROM (
    SELECT seed_id, cos(x/4) AS c, sin(x/4) AS s, greatest(y*y,1e-6) AS sx, greatest(z*z,1e-6) AS sy, 1.0 AS sz FROM seeds)""")
def _(f):
    r = g.rotation_about(three(0, 0, 1), F.col("x") / 4)
    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    return f.common("seeds").select("seed_id", *(e.alias(n) for n, e in zip(names, g.covariance(r, (F.col("y"), F.col("z"), L(1.0))))))


@query("ag3_metric_distance", "l:point_id d:d2,gx,gy,gz", """SELECT point_id, m AS d2, CASE WHEN sqrt(m)<1e-6 THEN 0 ELSE (2*x+0.5*y)/sqrt(m) END AS gx, CASE WHEN sqrt(m)<1e-6 THEN 0 ELSE (0.5*x+1.5*y)/sqrt(m) END AS gy,
    CASE WHEN sqrt(m)<1e-6 THEN 0 ELSE z/sqrt(m) END AS gz FROM (SELECT *, 2*x*x+1.5*y*y+z*z+0.5*x*y*2 AS m FROM points)""")
def _(f):
    m = [L(2.0), L(0.5), L(0.0), L(1.5), L(0.0), L(1.0)]
    gr = g.metric_gradient(m, P)
    return f.common("points").select("point_id", g.metric_distance_sq(m, P).alias("d2"), *(e.alias(f"g{a}") for a, e in zip("xyz", gr)))


@query("ag4_candidate_count", "l:seed_id,k", "SELECT seed_id, least(greatest(ceil(3*x*x), least(12, p_size)), p_size) AS k FROM seeds")
def _(f):
    return f.common("seeds").select("seed_id", g.candidate_count(F.col("x"), F.col("p_size")).alias("k"))


@query("ag5_rotations", "l:seed_id d:ux,uy,uz,length", "SELECT seed_id, 1.0 AS ux, 0.0 AS uy, 0.0 AS uz, sqrt(x*x+y*y+z*z) AS length FROM seeds WHERE x*x+y*y+z*z > 0.01")
def _(f):
    m = g.rotation_to_x(P, F.col("p_size") / 10.0)
    turned = g.apply_matrix(m, P)
    n = g.norm(turned)
    return f.common("seeds").filter("x*x+y*y+z*z > 0.01").select("seed_id", *((e / n).alias(f"u{a}") for a, e in zip("xyz", turned)), n.alias("length"))


@query("ag6_global_warp", "l:point_id d:x,y,z", """SELECT point_id, 8+(c*(x-8)-s*(y-8))/1.0 AS x, 8+(s*(x-8)+c*(y-8))/2.0 AS y, 8+(z-8)/0.5 AS z FROM (SELECT *, cos(0.7) AS c, sin(0.7) AS s FROM points)""")
def _(f):
    m = g.rotation_about(three(0, 0, 1), L(0.7))
    turned = g.apply_matrix(m, g.sub(P, three(8, 8, 8)))
    return f.common("points").select("point_id", *((e / st + 8.0).alias(a) for a, e, st in zip("xyz", turned, (1.0, 2.0, 0.5))))


@query("ag2_blended_metric", "l:point_id d:xx,yy,zz", """SELECT point_id, (sw+0.1)/(sx+0.1) AS xx, (sw+0.1)/(sy+0.1) AS yy, (sw+0.1)/(sz+0.1) AS zz FROM (
    SELECT p.point_id, coalesce(sum(w),0) AS sw, coalesce(sum(w*2.0),0) AS sx, coalesce(sum(w*0.5),0) AS sy, coalesce(sum(w*(1+s.p_size/10.0)),0) AS sz FROM points p LEFT JOIN (
    SELECT p.point_id AS pid, s.p_size, exp(-d2/2)-exp(-4.5) AS w FROM (SELECT p.point_id, s.seed_id, s.p_size, (p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)+(p.z-s.z)*(p.z-s.z) AS d2 FROM points p JOIN seeds s USING (sample_id)) s
    JOIN (SELECT point_id FROM points) p USING (point_id) WHERE d2 <= 9) s ON s.pid = p.point_id GROUP BY p.point_id)""")
def _(f):
    near = spatial.radius_join(f.common("points"), f.common("seeds"), 3.0, cell=3.0).join(f.common("seeds").select("seed_id", "p_size"), "seed_id")
    w = F.exp(-F.col("distance") * F.col("distance") / 2) - F.exp(L(-4.5))
    entries = [w * 2.0, w * 0.0, w * 0.0, w * 0.5, w * 0.0, w * (F.col("p_size") / 10.0 + 1.0)]
    sums = near.groupBy("point_id").agg(F.sum(w).alias("w"), *(F.sum(e).alias(f"c{n}") for n, e in enumerate(entries)))
    all_points = f.common("points").select("point_id").join(sums, "point_id", "left").na.fill(0.0)
    total = F.col("w") + 0.1
    mean = [(F.col(f"c{n}") + (0.1 if n in (0, 3, 5) else 0.0)) / total for n in range(6)]
    inverse = g.inverse_symmetric(mean)
    return all_points.select("point_id", inverse[0].alias("xx"), inverse[3].alias("yy"), inverse[5].alias("zz"))


# 2.6 fields

@query("fd1_contrasts", "l:sample_id,i,j,k,id1,id2 d:wall,strut,edge,face_p", "SELECT * FROM contrast")
def _(f):
    return fields.contrasts(f.grid(), f.common("seeds"))


TAU = "greatest(least(0.5+0.4*(face_p-0.5),1),0)"
SMIN = "least({a},{b})-pow(greatest({k}-abs({a}-({b})),0)/{k},3)*{k}/6.0"


@query("fd5_blended_field", "l:sample_id,i,j,k d:tau,value", f"SELECT sample_id, i, j, k, {TAU} AS tau, (1-{TAU})*wall+{TAU}*strut AS value FROM contrast")
def _(f):
    tau = fields.openness(L(0.5), L(0.4), F.col("face_p"))
    return fields.contrasts(f.grid(), f.common("seeds")).withColumn("tau", tau).withColumn("value", fields.blend(F.col("wall"), F.col("strut"), F.col("tau")))


@query("fd4_boundary_frame", "l:sample_id,i,j,k d:tau", f"""SELECT sample_id, i, j, k, {TAU}*(t*t*(3-2*t)) AS tau FROM (SELECT *, greatest(least(-({BOX_SQL})/2.0,1),0) AS t FROM (SELECT *, {GAP} FROM contrast))""")
def _(f):
    tau = fields.openness(L(0.5), L(0.4), F.col("face_p"))
    return fields.contrasts(f.grid(), f.common("seeds")).withColumn("tau", fields.boundary_frame(tau, g.box_distance(P, *BOX), L(2.0)))


@query("fd6_smooth_min", "l:sample_id,i,j,k d:value,wa,wb", f"""SELECT sample_id, i, j, k, {SMIN.format(a='wall', b='strut', k='0.5')} AS value,
    CASE WHEN wall<strut THEN 1-pow(greatest(0.5-abs(wall-strut),0)/0.5,2)*0.5 ELSE pow(greatest(0.5-abs(wall-strut),0)/0.5,2)*0.5 END AS wa,
    CASE WHEN wall<strut THEN pow(greatest(0.5-abs(wall-strut),0)/0.5,2)*0.5 ELSE 1-pow(greatest(0.5-abs(wall-strut),0)/0.5,2)*0.5 END AS wb FROM contrast""")
def _(f):
    w, s = F.col("wall"), F.col("strut")
    wa, wb = g.smooth_min_weights(w, s, L(0.5))
    return fields.contrasts(f.grid(), f.common("seeds")).select("sample_id", "i", "j", "k", g.smooth_min(w, s, L(0.5)).alias("value"), wa.alias("wa"), wb.alias("wb"))


@query("fd7_rounded_edges", "l:sample_id,i,j,k d:a,b", f"SELECT sample_id, i, j, k, {SMIN.format(a='wall', b='strut', k='0.5')} AS a, {SMIN.format(a='strut', b='edge', k='0.5')} AS b FROM contrast")
def _(f):
    a, b = fields.rounded_edges(F.col("wall"), F.col("strut"), F.col("edge"), L(0.5))
    return fields.contrasts(f.grid(), f.common("seeds")).withColumns({"a": a, "b": b})


@query("fd8_junction_fillet", "l:sample_id,i,j,k d:value", f"SELECT sample_id, i, j, k, {SMIN.format(a='v', b='w', k='0.5')} AS value FROM (SELECT *, 0.5*wall+0.5*strut AS v, strut+0.5*(strut-wall) AS w FROM contrast)")
def _(f):
    w, s, tau = F.col("wall"), F.col("strut"), L(0.5)
    return fields.contrasts(f.grid(), f.common("seeds")).withColumn("value", fields.junction_fillet(fields.blend(w, s, tau), w, s, tau, L(0.5)))


@query("fd9_gradient_normalised", "l:sample_id,i,j,k d:value", """SELECT sample_id, i, j, k, CASE WHEN n > 1e-4 THEN wall/n*2 ELSE wall END - 0.3 + 0.4 AS value FROM (
    SELECT sample_id, i, j, k, max(d) FILTER (rank=2) - max(d) FILTER (rank=1) AS wall, sqrt(power(max(ux) FILTER (rank=2) - max(ux) FILTER (rank=1), 2)
        + power(max(uy) FILTER (rank=2) - max(uy) FILTER (rank=1), 2) + power(max(uz) FILTER (rank=2) - max(uz) FILTER (rank=1), 2)) AS n
    FROM (SELECT *, sqrt(d2) AS d, coalesce((x-sx)/nullif(sqrt(d2),0),0) AS ux, coalesce((y-sy)/nullif(sqrt(d2),0),0) AS uy, coalesce((z-sz)/nullif(sqrt(d2),0),0) AS uz FROM near WHERE rank <= 2) GROUP BY ALL)""")
def _(f):
    c = fields.contrasts(f.grid(), f.common("seeds"), gradients=True)
    return c.withColumn("value", fields.gradient_normalised(F.col("wall"), g.vec("gw"), L(0.3), L(0.4)))


@query("fd10_local_iso", "l:sample_id,i,j,k d:iso", f"SELECT sample_id, i, j, k, 0.2+(0.6-0.2)*greatest(least(abs({BOX_SQL})/4.0,1),0) AS iso FROM (SELECT *, {GAP} FROM grid)")
def _(f):
    return f.grid().withColumn("iso", g.linear_radius(F.abs(g.box_distance(P, *BOX)), L(0.2), L(0.6), L(4.0)))


@query("fd12_stamped_clipped_caged", "l:sample_id,i,j,k d:stamped,clipped,caged", f"""SELECT sample_id, i, j, k, CASE WHEN d>6.0 THEN 0.4+4.0 ELSE value END AS stamped, greatest(value, d+0.4) AS clipped,
    CASE WHEN d<=0 THEN least(value, e-0.7+0.4) ELSE value END AS caged FROM (SELECT *, {BOX_SQL} AS d, sqrt(w[1]*w[1]+w[2]*w[2]) AS e FROM (SELECT *, {GAP}, list_sort([least(x-0,16-x),least(y-0,12-y),least(z-0,10-z)]) AS w FROM field))""")
def _(f):
    d, v, iso = g.box_distance(P, *BOX), F.col("value"), L(0.4)
    return f.field().select("sample_id", "i", "j", "k", fields.stamp_exterior(v, d, iso, L(STEP)).alias("stamped"), fields.clip_to_container(v, d, iso).alias("clipped"),
                            fields.edge_cage(v, fields.box_edge_distance(P, *BOX), d, L(0.7), iso).alias("caged"))


@query("fd13_cylinder_rims", "l:sample_id,i,j,k d:caged", """SELECT sample_id, i, j, k, CASE WHEN greatest(r-8.0, -y, y-12.0)<=0 THEN least(value, sqrt((8.0-r)*(8.0-r)+least(y,12.0-y)*least(y,12.0-y))-0.7+0.4) ELSE value END AS caged
    FROM (SELECT *, sqrt((x-8)*(x-8)+(z-8)*(z-8)) AS r FROM field)""")
def _(f):
    """A cylinder about the y axis: beams along its two rims, inside only."""
    r = F.sqrt((F.col("x") - 8) * (F.col("x") - 8) + (F.col("z") - 8) * (F.col("z") - 8))
    inside = F.greatest(r - 8.0, -F.col("y"), F.col("y") - 12.0)
    rims = fields.cylinder_rim_distance(P, (L(8.0), L(8.0)), L(8.0), L(12.0))
    return f.field().select("sample_id", "i", "j", "k", fields.edge_cage(F.col("value"), rims, inside, L(0.7), L(0.4)).alias("caged"))


AROUND = """FROM field c JOIN field n ON n.sample_id=c.sample_id AND n.i BETWEEN c.i-1 AND c.i+1 AND n.j BETWEEN c.j-1 AND c.j+1 AND n.k BETWEEN c.k-1 AND c.k+1"""


@query("fd16_box_blur", "l:sample_id,i,j,k d:value", f"SELECT c.sample_id, c.i, c.j, c.k, CASE WHEN count(*)=27 THEN sum(n.value)/27 ELSE max(c.value) END AS value {AROUND} GROUP BY ALL")
def _(f):
    return fields.box_blur(f.field())


@query("fd15_binomial_blur", "l:sample_id,i,j,k d:value", f"""SELECT c.sample_id, c.i, c.j, c.k, CASE WHEN max(c.value) < 0.9 THEN sum(CASE WHEN n.value<0.9 THEN n.value*w ELSE 0 END)/sum(CASE WHEN n.value<0.9 THEN w ELSE 0 END) ELSE max(c.value) END AS value
    FROM (SELECT c.*, n.value AS nv, (2-abs(n.i-c.i))*(2-abs(n.j-c.j))*(2-abs(n.k-c.k)) AS w {AROUND}) q(sample_id,i,j,k,x,y,z,value,nv,w) , (SELECT 1) o(o), LATERAL (SELECT q.nv AS value) n, LATERAL (SELECT q.sample_id, q.i, q.j, q.k, q.value) c GROUP BY c.sample_id, c.i, c.j, c.k""")
def _(f):
    return fields.binomial_blur(f.field(), 0.9)


TAUBIN = """SELECT c.sample_id, c.i, c.j, c.k, c.value + CASE WHEN count(n.value)=6 THEN (sum(n.value)/6-c.value)*{f} ELSE 0 END AS value FROM {t} c LEFT JOIN {t} n ON n.sample_id=c.sample_id
    AND abs(n.i-c.i)+abs(n.j-c.j)+abs(n.k-c.k)=1 AND n.i BETWEEN c.i-1 AND c.i+1 AND n.j BETWEEN c.j-1 AND c.j+1 AND n.k BETWEEN c.k-1 AND c.k+1 GROUP BY c.sample_id, c.i, c.j, c.k, c.value"""
TAUBIN_SQL = f"WITH p1 AS ({TAUBIN.format(f=0.5, t='field')}), p2 AS ({TAUBIN.format(f=-0.53, t='p1')}), p3 AS ({TAUBIN.format(f=0.5, t='p2')}), p4 AS ({TAUBIN.format(f=-0.53, t='p3')}) SELECT * FROM p4"


@query("fd14_taubin_rows", "l:sample_id,i,j,k d:value", TAUBIN_SQL)
def _(f):
    return fields.taubin_smooth(f.field(), 2)


@query("fd14_taubin_bricks", "l:sample_id,i,j,k d:value", TAUBIN_SQL)
def _(f):
    return fields.taubin_bricks(f.field(), 2)


@query("fd18_sealed", "l:sample_id,i,j,k d:value", f"SELECT sample_id, i, j, k, CASE WHEN i IN (0,{N - 1}) OR j IN (0,{N - 1}) OR k IN (0,{N - 1}) THEN 0.4+2*2.0 ELSE value END AS value FROM field")
def _(f):
    return fields.seal(f.field(), 0.4, 2.0)


@query("fd19_voxel_porosity", "l:sample_id,domain_voxels,solid_voxels d:porosity", f"""SELECT sample_id, n AS domain_voxels, s AS solid_voxels, 1-s/n AS porosity FROM (SELECT sample_id, CAST(count(*) FILTER (d<=0) AS DOUBLE) AS n,
    CAST(count(*) FILTER (d<=0 AND value<0.4) AS DOUBLE) AS s FROM (SELECT *, {BOX_SQL} AS d FROM (SELECT *, {GAP} FROM field)) GROUP BY sample_id)""")
def _(f):
    return fields.porosity(f.field(), 0.4, g.box_distance(P, *BOX) <= 0)


@query("fd20_legacy_field", "l:sample_id,i,j,k d:foam,value", f"""SELECT sample_id, i, j, k, d2-d1 AS foam, (d3-d1)+0.5*(({SMIN.format(a='d2', b='d3', k='0.5')})-({SMIN.format(a='d1', b='d2', k='0.5')})) AS value FROM (
    SELECT sample_id, i, j, k, max(sqrt(d2)) FILTER (rank=1) AS d1, max(sqrt(d2)) FILTER (rank=2) AS d2, max(sqrt(d2)) FILTER (rank=3) AS d3 FROM near GROUP BY ALL)""")
def _(f):
    wide = spatial.nearest_columns(f.grid(), f.common("seeds"), 3, ["i", "j", "k"])
    d = tuple(F.col(f"d{n}") for n in (1, 2, 3))
    return wide.select("sample_id", "i", "j", "k", fields.legacy_value(d, L(0.5), foam=True).alias("foam"), fields.legacy_value(d, L(0.5)).alias("value"))


@query("fd21_recipes_over_stored_contrasts", "l:sample_id,recipe,solid_voxels", """SELECT sample_id, r.n AS recipe, count(*) FILTER ((1-r.t)*wall+r.t*strut < 0.8) AS solid_voxels FROM contrast, (VALUES (0,0.0),(1,0.5),(2,1.0)) r(n,t) GROUP BY ALL""")
def _(f):
    from functools import reduce

    from ..sources.scratch import materialize

    cached = materialize(fields.contrasts(f.grid(), f.common("seeds")), "contrasts")
    parts = [fields.porosity(fields.assemble(cached, 0.8, t), 0.8).withColumn("recipe", L(n)) for n, t in enumerate((0.0, 0.5, 1.0))]
    return reduce(lambda a, b: a.unionByName(b), parts)


# 2.7 resampling

@query("im1_resample", "l:sample_id,i,j,k d:value b:solid", """SELECT t.sample_id, t.i, t.j, t.k, CASE WHEN count(*)=count(f.value) THEN sum(w*f.value) END AS value, coalesce(CASE WHEN count(*)=count(f.value) THEN sum(w*f.value) END < 0.4, false) AS solid FROM (
    SELECT sample_id, a.n AS i, b.n AS j, c.n AS k, floor(a.n*0.75)+dx.n AS ci, floor(b.n*0.75)+dy.n AS cj, floor(c.n*0.75)+dz.n AS ck,
    CASE dx.n WHEN 1 THEN a.n*0.75-floor(a.n*0.75) ELSE 1-(a.n*0.75-floor(a.n*0.75)) END * CASE dy.n WHEN 1 THEN b.n*0.75-floor(b.n*0.75) ELSE 1-(b.n*0.75-floor(b.n*0.75)) END * CASE dz.n WHEN 1 THEN c.n*0.75-floor(c.n*0.75) ELSE 1-(c.n*0.75-floor(c.n*0.75)) END AS w
    FROM ids, (SELECT range AS n FROM range(14)) a, (SELECT range AS n FROM range(14)) b, (SELECT range AS n FROM range(8)) c, (SELECT range AS n FROM range(2)) dx, (SELECT range AS n FROM range(2)) dy, (SELECT range AS n FROM range(2)) dz) t
    LEFT JOIN field f ON f.sample_id=t.sample_id AND f.i=ci AND f.j=cj AND f.k=ck WHERE w > 0 GROUP BY t.sample_id, t.i, t.j, t.k""")
def _(f):
    t = f.samples().select("sample_id")
    for c, n in zip("kji", (8, 14, 14)):
        t = t.withColumn(c, F.explode(F.sequence(L(0), L(n - 1))))
    return grid.resample(f.field(), t.withColumns({f"g{a}": F.col(c) * 0.75 for a, c in zip("xyz", "ijk")}), 0.4)


@query("im3_voxel_sizes", "l:sample_id,size,solid_voxels", """SELECT sample_id, size, count(*) FILTER (value < 0.4) AS solid_voxels FROM field, (VALUES (1),(2),(3)) s(size) WHERE i%size=0 AND j%size=0 AND k%size=0 GROUP BY ALL""")
def _(f):
    from functools import reduce

    field, parts = f.field(), []
    for size in (1, 2, 3):
        m = (N - 1) // size + 1
        t = f.samples().select("sample_id")
        for c in "kji":
            t = t.withColumn(c, F.explode(F.sequence(L(0), L(m - 1))))
        image = grid.resample(field, t.withColumns({f"g{a}": (F.col(c) * size).cast("double") for a, c in zip("xyz", "ijk")}), 0.4)
        parts.append(image.groupBy("sample_id").agg(F.count_if("solid").alias("solid_voxels")).withColumn("size", L(size)))
    return reduce(lambda a, b: a.unionByName(b), parts)
