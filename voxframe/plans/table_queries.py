"""Queries on graphs, polygons, tetrahedra and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bricks, graph, measure, polygon
from ..sources import tables
from ..sources.scratch import materialize, scratch_root
from .fixtures import STEP
from .registry import query

L = F.lit

# 2.10 graphs


def _sides(edges):
    """Parts and suppliers as vertices of their own: the numbers of many parts reach into those of the suppliers."""
    return edges.withColumns({"a": F.col("a") * 2, "b": F.col("b") * 2 + 1})


def _numbers(edges):
    """The edges by their numbers again."""
    return edges.withColumns({c: F.shiftright(c, 1) for c in "ab"})


@query("gp1_added_edges", "l:graph_id,a,b d:ratio", """SELECT graph_id, a, b, ratio FROM edges UNION ALL SELECT * FROM (SELECT 1 AS graph_id, p_partkey AS a, 1000000+p_size AS b, 0.5 AS ratio FROM part) n
    WHERE a IN (SELECT a FROM edges WHERE graph_id=1) AND b IN (SELECT b FROM edges WHERE graph_id=1) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id=1 AND e.a=n.a AND e.b=n.b)""")
def _(f):
    e = _sides(f.common("edges"))
    new = f.table("part").select(L(1).cast("long").alias("graph_id"), F.col("p_partkey").cast("long").alias("a"), (F.col("p_size") + 1000000).cast("long").alias("b"), L(0.5).alias("ratio"), F.col("p_partkey").alias("seq"))
    return _numbers(graph.add_edges(e, _sides(new), e.select("graph_id", F.explode(F.array("a", "b")).alias("vertex")).distinct()))


@query("gp2_removed", "l:graph_id,a,b d:ratio", "SELECT * FROM edges WHERE NOT (a % 7 = 0) AND NOT (b % 5 = 0 AND graph_id % 2 = 0)")
def _(f):
    e = f.common("edges")
    gone = _sides(e.filter("a % 7 = 0")).select("graph_id", F.col("a").alias("vertex")).distinct()
    return _numbers(graph.remove_edges(graph.remove_vertices(_sides(e), gone), _sides(e.filter("b % 5 = 0 and graph_id % 2 = 0"))))


@query("gp3_ratio_thresholds", "l:graph_id,a,b d:ratio", "SELECT * FROM edges WHERE ratio BETWEEN 0.085 AND 0.095")
def _(f):
    return graph.edges_by_ratio(f.common("edges"), 0.085, 0.095)


@query("gp5_vertex_counts", "l:graph_id,vertices", "SELECT graph_id, count(DISTINCT a)+count(DISTINCT b) AS vertices FROM edges GROUP BY graph_id")
def _(f):
    return graph.vertex_counts(_sides(f.common("edges")))


@query("gp5_edge_lookup", "l:graph_id,a,b d:ratio", """SELECT q.graph_id, q.a, q.b, coalesce(e.ratio, -1) AS ratio FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS graph_id, 1000000+l_suppkey AS a, l_partkey AS b FROM lineitem) q
    LEFT JOIN edges e ON e.graph_id=q.graph_id AND e.a=q.b AND e.b=q.a""")
def _(f):
    asked = f.table("lineitem").select(F.col("l_linenumber").cast("long").alias("graph_id"), (F.col("l_suppkey") + 1000000).cast("long").alias("a"), F.col("l_partkey").cast("long").alias("b")).distinct()
    return graph.edge_lookup(asked, f.common("edges"))


@query("gp5_adjacency", "l:graph_id,vertex,degree,least", """SELECT graph_id, v AS vertex, count(*) AS degree, min(n) AS least FROM (SELECT graph_id, a AS v, b AS n FROM edges UNION SELECT graph_id, b, a FROM edges) GROUP BY ALL""")
def _(f):
    return graph.adjacency(f.common("edges")).select("graph_id", "vertex", F.size("neighbours").alias("degree"), F.get("neighbours", L(0)).alias("least"))


# polygons


def _polys(f):
    return polygon.counter_clockwise(f.common("corners"))


@query("gp7_counter_clockwise", "l:poly_id,vertex_id,seq", "SELECT poly_id, vertex_id, seq FROM polys")
def _(f):
    return _polys(f)


@query("gp7_fixed_orientation", "l:poly_id,vertex_id,seq", "SELECT poly_id, vertex_id, seq FROM polys")
def _(f):
    n = F.count("*").over(Window.partitionBy("poly_id"))
    return polygon.fix_orientation(_polys(f).withColumn("seq", n + 1 - F.col("seq")))


@query("gp6_polygon_figures", "l:poly_id d:signed_area,area,perimeter,mean_edge", """SELECT poly_id, sum(x*y2-x2*y)/2 AS signed_area, abs(sum(x*y2-x2*y))/2 AS area, sum(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))) AS perimeter,
    avg(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))) AS mean_edge FROM pedges GROUP BY poly_id""", digits=4)
def _(f):
    return polygon.polygon_figures(_polys(f))


@query("gp8_polygon_widths", "l:poly_id d:width_min,width_max", """SELECT poly_id, min(w) AS width_min, max(w) AS width_max FROM (SELECT e.poly_id, e.seq, max(v.x*nx+v.y*ny)-min(v.x*nx+v.y*ny) AS w FROM (
    SELECT poly_id, seq, (y-y2)/sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) AS nx, (x2-x)/sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) AS ny FROM pedges WHERE x<>x2 OR y<>y2) e JOIN polys v USING (poly_id) GROUP BY ALL) GROUP BY poly_id""")
def _(f):
    return polygon.polygon_widths(_polys(f))


FLAT_POINTS = "SELECT point_id, CAST(floor(x*60) AS DOUBLE) AS x, CAST(floor(y*60) AS DOUBLE) AS y FROM points"


def _flat_points(f):
    return f.common("points").select("point_id", *(F.floor(F.col(a) * 60).cast("double").alias(a) for a in "xy"))


@query("gp9_points_in_polygons", "l:point_id,poly_id", f"""SELECT point_id, poly_id FROM (SELECT p.point_id, e.poly_id,
    count(*) FILTER ((e.y>p.y)<>(e.y2>p.y) AND CASE WHEN e.y2>e.y THEN (e.x2-e.x)*(p.y-e.y)-(p.x-e.x)*(e.y2-e.y) <= 0 ELSE (e.x2-e.x)*(p.y-e.y)-(p.x-e.x)*(e.y2-e.y) >= 0 END) AS n,
    count(*) FILTER ((e.x2-e.x)*(p.y-e.y)-(p.x-e.x)*(e.y2-e.y)=0 AND p.x BETWEEN least(e.x,e.x2) AND greatest(e.x,e.x2) AND p.y BETWEEN least(e.y,e.y2) AND greatest(e.y,e.y2)) AS edge
    FROM ({FLAT_POINTS}) p, pedges e GROUP BY ALL) WHERE n%2=1 AND edge=0""")
def _(f):
    return polygon.points_in_polygons(_flat_points(f), _polys(f), cell=20.0)


SEGMENT = "sqrt(pow(px-x-(x2-x)*t,2)+pow(py-y-(y2-y)*t,2))"
TO_EDGES = "SELECT *, coalesce(greatest(least(((px-x)*(x2-x)+(py-y)*(y2-y))/nullif((x2-x)*(x2-x)+(y2-y)*(y2-y),0),1),0),0) AS t FROM"


@query("gp10_edge_distances", "l:point_id,poly_id d:nearest,farthest", f"""SELECT point_id, poly_id, min({SEGMENT}) AS nearest, max({SEGMENT}) AS farthest FROM ({TO_EDGES} (
    SELECT p.point_id, p.x AS px, p.y AS py, e.* FROM (SELECT *, point_id % (SELECT count(DISTINCT poly_id) FROM corners) AS pid FROM ({FLAT_POINTS})) p JOIN pedges e ON e.poly_id=p.pid)) GROUP BY ALL""", digits=4)
def _(f):
    n = f.common("corners").select("poly_id").distinct().count()
    return polygon.edge_distances(_flat_points(f).withColumn("poly_id", F.col("point_id") % n), _polys(f))


@query("gp10_vertex_widths", "l:poly_id d:width_min,width_max", f"""SELECT poly_id, min(d) AS width_min, max(d) AS width_max FROM (SELECT poly_id, vseq, min({SEGMENT}) AS d FROM ({TO_EDGES} (
    SELECT v.seq AS vseq, v.x AS px, v.y AS py, e.* FROM polys v JOIN pedges e ON e.poly_id=v.poly_id AND e.seq<>v.seq AND CASE WHEN e.seq=e.n THEN 1 ELSE e.seq+1 END<>v.seq)) GROUP BY ALL) GROUP BY poly_id""", digits=4)
def _(f):
    return polygon.vertex_widths(_polys(f))


@query("gp11_points_in_triangle", "l:point_id b:inside", """SELECT point_id, (a>=-1e-12 AND b>=-1e-12 AND c>=-1e-12) OR (a<=1e-12 AND b<=1e-12 AND c<=1e-12) AS inside FROM (
    SELECT point_id, (14.0-2)*(y-1)-(3.0-1)*(x-2) AS a, (5.0-14)*(y-3)-(15.0-3)*(x-14) AS b, (2.0-5)*(y-15)-(1.0-15)*(x-5) AS c FROM points)""")
def _(f):
    c = lambda x, y: (L(float(x)), L(float(y)))
    return f.common("points").select("point_id", polygon.in_triangle((F.col("x"), F.col("y")), c(2, 1), c(14, 3), c(5, 15)).alias("inside"))


@query("gp12_plane_round_trip", "l:poly_id,seq d:x,y,z", "SELECT poly_id, seq, x, y, 0.5*x-0.25*y+3 AS z FROM polys", digits=4)
def _(f):
    lifted = _polys(f).withColumn("z", F.col("x") * 0.5 - F.col("y") * 0.25 + 3.0)
    flat, frames = polygon.project_to_plane(lifted)
    return polygon.back_to_space(flat, frames)


@query("gp13_inscribed_circles", "l:poly_id b:positive", "SELECT DISTINCT poly_id, true AS positive FROM corners")
def _(f):
    return polygon.inscribed_circles(_polys(f), tolerance=0.01).withColumn("positive", F.col("radius") > 0)


@query("gp14_densified_edges", "l:poly_id,seq,part d:x,y", """SELECT poly_id, seq, part, x+(x2-x)*part/m AS x, y+(y2-y)*part/m AS y FROM (SELECT *, unnest(range(m)) AS part FROM (
    SELECT *, CAST(greatest(1, ceil(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))/25.0)) AS BIGINT) AS m FROM pedges))""")
def _(f):
    return polygon.densify(_polys(f), 25.0)


@query("gp15_tetrahedra", "l:sample_id,tet_id d:volume,moment,mx,my,mz,radius", """SELECT sample_id, tet_id, v AS volume, v/10*(px*px+py*py+pz*pz+qx*qx+qy*qy+qz*qz+rx*rx+ry*ry+rz*rz+px*qx+py*qy+pz*qz+qx*rx+qy*ry+qz*rz+rx*px+ry*py+rz*pz) AS moment,
    (ax+bx+cx+dx)/4 AS mx, (ay+"by"+cy+dy)/4 AS my, (az+bz+cz+dz)/4 AS mz, sqrt(weight-min(weight) OVER (PARTITION BY sample_id)) AS radius FROM (SELECT *, abs(px*(qy*rz-qz*ry)+py*(qz*rx-qx*rz)+pz*(qx*ry-qy*rx))/6 AS v FROM (
    SELECT *, bx-ax AS px, "by"-ay AS py, bz-az AS pz, cx-ax AS qx, cy-ay AS qy, cz-az AS qz, dx-ax AS rx, dy-ay AS ry, dz-az AS rz FROM tets))""", digits=3)
def _(f):
    return polygon.radii_from_weights(polygon.tetrahedron_figures(f.common("tets")))


# 2.1 stored tables: written and read back


def _folder(f, name):
    return f"{scratch_root(f.spark)}/voxframe/{name}-{uuid.uuid4().hex}"


@query("io8_dataset_round_trip", "l:sample_id,seeds,images", "SELECT sample_id, (SELECT count(*) FROM seeds s WHERE s.sample_id=i.sample_id) AS seeds, count(*) AS images FROM image i GROUP BY sample_id")
def _(f):
    path = _folder(f, "dataset")
    tables.save_dataset({"seeds": f.common("seeds"), "image": f.image()}, path)
    seeds = tables.load_table(f.spark, path, "seeds").groupBy("sample_id").agg(F.count("*").alias("seeds"))
    return tables.load_table(f.spark, path, "image").groupBy("sample_id").agg(F.count("*").alias("images")).join(seeds, "sample_id", "left").na.fill(0, ["seeds"])


@query("io9_broken_references", "l:sample_id,point_id", "SELECT sample_id, point_id FROM points WHERE sample_id NOT IN (SELECT sample_id FROM seeds WHERE sample_id % 5 <> 0)")
def _(f):
    return tables.broken_references(f.common("points"), f.common("seeds").filter("sample_id % 5 <> 0"), "sample_id")


@query("io10_recipe_csv", "l:sample_id d:UniformThickness,Openess,Spread,FrameBeam", """SELECT seed_id AS sample_id, x AS UniformThickness,
    CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS Openess, NULL AS Spread, CASE WHEN p_size=1 THEN NULL ELSE CAST(p_size AS DOUBLE)-2 END AS FrameBeam FROM seeds""")
def _(f):
    path = _folder(f, "recipes")
    openness = F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double"))
    tables.write_recipes(f.common("seeds").select(F.col("seed_id").alias("sample_id"), F.col("x").alias("UniformThickness"), openness.alias("Openess"), (F.col("p_size") - 2.0).alias("FrameBeam")), path)
    return tables.read_recipes(f.spark, path)


@query("io13_results_csv", "l:rows,columns d:thickness,pullback,radius_min", "SELECT count(*) AS rows, 7 AS columns, sum(x) AS thickness, sum(y) AS pullback, sum(z) AS radius_min FROM seeds", digits=3)
def _(f):
    path = _folder(f, "results")
    tables.write_results(f.common("seeds").select(F.col("seed_id").alias("sample_id"), F.col("z").alias("radius_min"), (F.col("z") + 1).alias("radius_max"), F.col("x").alias("thickness"),
                                                  F.col("y").alias("pullback"), F.col("x").alias("volume"), F.col("y").alias("smi")), path, "varied")
    back = f.spark.read.csv(path, header=True, inferSchema=True)
    return back.agg(F.count("*").alias("rows"), *(F.sum(c).alias(c) for c in ("thickness", "pullback", "radius_min"))).withColumn("columns", L(len(back.columns)))


@query("bt8_cohort_report", "l:sample_id,solid_voxels d:threshold,porosity", """SELECT sample_id, (sample_id%4)*0.25 AS threshold, count(*) FILTER (v<0.8) AS solid_voxels, 1-CAST(count(*) FILTER (v<0.8) AS DOUBLE)/count(*) AS porosity
    FROM (SELECT sample_id, (1-(sample_id%4)*0.25)*wall+(sample_id%4)*0.25*strut AS v FROM contrast) GROUP BY sample_id""")
def _(f):
    """Recipes of a cohort, the porosity of each and both tables written and read as a report."""
    from ..operators import fields

    path = _folder(f, "report")
    cohort = f.samples().select("sample_id", (F.col("sample_id") % 4 * 0.25).alias("threshold"), L(0.8).alias("iso"))
    contrasts = fields.contrasts(f.grid(), f.common("seeds")).join(cohort, "sample_id")
    field = contrasts.withColumn("value", fields.blend(F.col("wall"), F.col("strut"), F.col("threshold")))
    tables.write_report(cohort, fields.porosity(field, 0.8), path)
    return tables.read_report(f.spark, path)


@query("io11_metrics_csv", "l:sample_id d:thickness,volume,smi", "SELECT seed_id AS sample_id, x AS thickness, CASE WHEN p_size=1 THEN NULL ELSE CAST(p_size AS DOUBLE)-2 END AS volume, NULL AS smi FROM seeds")
def _(f):
    path = _folder(f, "metrics")
    s = f.common("seeds")
    tables.write_csv(s.select(F.col("seed_id").alias("sample_id"), F.col("x").alias(" thickness "), (F.col("p_size") - 2.0).alias("volume")), path)
    return tables.read_metrics(f.spark, path)


@query("io12_batch_csv", "l:rows d:radius,stretch_y", "SELECT count(*) AS rows, sum(x) AS radius, sum(z) AS stretch_y FROM seeds", digits=3)
def _(f):
    path = _folder(f, "batch")
    tables.write_csv(f.common("seeds").select(F.col("x").alias("radius"), F.col("y").alias("thickness_min"), F.col("y").alias("thickness_max"), F.col("z").alias("stretch_y")), path)
    return tables.read_batch(f.spark, path).agg(F.count("*").alias("rows"), F.sum("radius").alias("radius"), F.sum("stretch_y").alias("stretch_y"))


@query("io14_reference_csv", "l:rows d:tb_th,tb_n", "SELECT count(*) AS rows, sum(x) AS tb_th, 1.25*count(*) AS tb_n FROM seeds", digits=3)
def _(f):
    path = _folder(f, "reference")
    s = f.common("seeds")
    tables.write_csv(s.select(F.col("seed_id").cast("string").alias("sample_id"), L("box").alias("container_type"), F.col("x").alias("tb_th")), path)
    return tables.read_references(f.spark, path, {"tb_n": 1.25}).agg(F.count("*").alias("rows"), F.sum("tb_th").alias("tb_th"), F.sum("tb_n").alias("tb_n"))


@query("bt11_batch_chain", "l:row,seeds,solid d:radius,porosity,area,volume")
def _(f):
    """A batch file of recipes to a file of results: thinning, stretched contrasts, graded iso level, largest part, mesh.

    The rows of the file are numbered in the order of their values; row n uses the seeds of the n-th sample.
    """
    from ..functions import geometry as g
    from ..operators import fields, sampling, surface

    recipes, results = _folder(f, "batch"), _folder(f, "batch-results")
    s = f.samples().select("sample_id")
    tables.write_csv(s.select((F.col("sample_id") % 3 * 0.5 + 2.5 + F.col("sample_id") * 1e-6).alias("radius"), L(0.9).alias("thickness_min"), (F.col("sample_id") % 2 * 0.4 + 1.2).alias("thickness_max"),
                              (F.col("sample_id") % 2 * 0.5 + 1.0).alias("stretch_y")), recipes)
    batch = tables.read_batch(f.spark, recipes)
    rows = sampling.number_rows(batch, [F.col(c) for c in batch.columns], "row").join(
        sampling.number_rows(s, [F.col("sample_id")], "row"), "row")
    rows = materialize(rows, "batch-rows")
    seeds = f.common("seeds").join(rows.select("sample_id", "radius"), "sample_id")
    kept_seeds = materialize(sampling.thin_by_distance(seeds, F.col("radius"), 4.0), "batch-seeds")
    grid = f.grid().join(rows.select("sample_id", "stretch_y"), "sample_id").withColumn("y", F.col("y") / F.col("stretch_y")).drop("stretch_y")
    cached = fields.contrasts(grid, kept_seeds).join(rows.select("sample_id", "thickness_min", "thickness_max", "stretch_y"), "sample_id")
    iso = g.linear_radius(F.abs(F.col("x") - 9.0), F.col("thickness_min"), F.col("thickness_max"), L(9.0))
    # the level is taken out of the field, so that one iso value of zero serves all recipes
    field = materialize(cached.select("sample_id", "i", "j", "k", "x", (F.col("y") * F.col("stretch_y")).alias("y"), "z", (fields.blend(F.col("wall"), F.col("strut"), L(0.5)) - iso).alias("value")), "batch-field")
    kept, _ = bricks.remove_islands(field, 0.0, 9.0)
    kept = materialize(kept, "batch-kept")
    vertices, faces = surface.iso_surface(fields.seal(kept, 0.0, STEP), 0.0)
    size = measure.mesh_area_volume(surface.to_soup(vertices, faces))
    out = rows.join(kept_seeds.groupBy("sample_id").agg(F.count("*").alias("seeds")), "sample_id").join(fields.porosity(kept, 0.0).withColumnRenamed("solid_voxels", "solid"), "sample_id").join(size, "sample_id", "left")
    tables.write_csv(out.select("row", "seeds", "solid", "radius", "porosity", "area", "volume"), results)
    return f.spark.read.csv(results, header=True, schema="row long, seeds long, solid long, radius double, porosity double, area double, volume double")
