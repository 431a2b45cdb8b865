"""Queries on surfaces, meshes and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graph, spatial, surface
from ..sources import image_files, mesh_files
from ..sources.scratch import materialize, scratch_root
from .fixtures import N, STEP
from .registry import query

L = F.lit
ISO = 0.35

# 2.8 surfaces

CELLS = f"""SELECT sample_id, i-dx AS i, j-dy AS j, k-dz AS k, sum(CASE WHEN value < {ISO} THEN bit ELSE 0 END) AS code
    FROM field, (SELECT a.n AS dx, b.n AS dy, c.n AS dz, 1 << (a.n+2*b.n+4*c.n) AS bit FROM (VALUES (0),(1)) a(n), (VALUES (0),(1)) b(n), (VALUES (0),(1)) c(n)) GROUP BY ALL HAVING count(*) = 8"""


@query("me1_cell_codes", "l:sample_id,i,j,k,code", f"SELECT * FROM ({CELLS}) WHERE code NOT IN (0, 255)")
def _(f):
    return surface.cell_codes(f.field(), ISO)


CROSSED = " UNION ALL ".join(f"""SELECT a.sample_id, a.i, a.j, a.k, '{ax}' AS axis, a.x+(b.x-a.x)*({ISO}-a.value)/(b.value-a.value) AS x, a.y+(b.y-a.y)*({ISO}-a.value)/(b.value-a.value) AS y,
    a.z+(b.z-a.z)*({ISO}-a.value)/(b.value-a.value) AS z FROM field a JOIN field b ON a.sample_id=b.sample_id AND b.i=a.i+{d[0]} AND b.j=a.j+{d[1]} AND b.k=a.k+{d[2]} WHERE (a.value<{ISO}) <> (b.value<{ISO})"""
                            for ax, d in (("i", (1, 0, 0)), ("j", (0, 1, 0)), ("k", (0, 0, 1))))


@query("me2_edge_vertices", "l:sample_id,i,j,k s:axis d:x,y,z", CROSSED)
def _(f):
    return surface.edge_vertices(f.field(), ISO)


@query("me3_vertex_gradients", "l:sample_id,i,j,k s:axis d:length b:finite", f"SELECT sample_id, i, j, k, axis, 1.0 AS length, true AS finite FROM ({CROSSED})")
def _(f):
    field = f.field()
    n = surface.gradient_normals(surface.edge_vertices(field, ISO), field, ISO, (STEP,) * 3)
    return n.withColumn("length", g.norm(g.vec("n"))).withColumn("finite", ~F.isnan("length"))


@query("me6_counts", "l:sample_id,vertices,cells", f"SELECT v.sample_id, v.n AS vertices, c.n AS cells FROM (SELECT sample_id, count(*) AS n FROM ({CROSSED}) GROUP BY sample_id) v JOIN (SELECT sample_id, count(*) AS n FROM ({CELLS}) WHERE code NOT IN (0,255) GROUP BY sample_id) c USING (sample_id)")
def _(f):
    field = f.field()
    v = surface.edge_vertices(field, ISO).groupBy("sample_id").agg(F.count("*").alias("vertices"))
    return v.join(surface.cell_codes(field, ISO).groupBy("sample_id").agg(F.count("*").alias("cells")), "sample_id")


@query("me4_iso_surface", "l:sample_id,open_edges,bad_edges b:closed,same_cells", f"SELECT sample_id, 0 AS open_edges, 0 AS bad_edges, true AS closed, true AS same_cells FROM ids")
def _(f):
    """The sealed field gives a closed mesh; faces lie only in crossing cells, so their count is bounded by them."""
    from ..operators.fields import seal

    field = f.field()
    sealed = seal(field, ISO, STEP)
    vertices, faces = surface.iso_surface(sealed, ISO)
    t = surface.topology(faces)
    cells = surface.cell_codes(sealed, ISO).groupBy("sample_id").agg(F.count("*").alias("cells"))
    n = faces.groupBy("sample_id").agg(F.count("*").alias("n"))
    return t.join(cells, "sample_id").join(n, "sample_id").select("sample_id", F.col("boundary").alias("open_edges"), L(0).alias("bad_edges"), (F.col("boundary") == 0).alias("closed"),
                                                                  (F.col("n").between(F.col("cells"), F.col("cells") * 12)).alias("same_cells"))


def _mesh(f):
    return surface.weld(materialize(f.skin(), "soup"), 1e-6)


@query("me7_weld", "l:sample_id,vertices,faces", "SELECT v.sample_id, v.n AS vertices, t.n AS faces FROM (SELECT sample_id, count(*) AS n FROM verts GROUP BY sample_id) v JOIN (SELECT sample_id, count(*) AS n FROM faces GROUP BY sample_id) t USING (sample_id)")
def _(f):
    v, t = _mesh(f)
    return v.groupBy("sample_id").agg(F.count("*").alias("vertices")).join(t.groupBy("sample_id").agg(F.count("*").alias("faces")), "sample_id")


@query("me7_weld_positions", "l:sample_id d:x,y,z", "SELECT sample_id, x, y, z FROM verts")
def _(f):
    return _mesh(f)[0]


@query("me9_topology", "l:sample_id,edges,boundary,manifold,non_manifold b:watertight", """SELECT sample_id, count(*) AS edges, count(*) FILTER (n_faces=1) AS boundary, count(*) FILTER (n_faces=2) AS manifold,
    count(*) FILTER (n_faces>2) AS non_manifold, count(*) FILTER (n_faces<>2)=0 AS watertight FROM medges GROUP BY sample_id""")
def _(f):
    return surface.topology(_mesh(f)[1])


@query("me8_edges", "l:sample_id,n_faces,edges", "SELECT sample_id, n_faces, count(*) AS edges FROM medges GROUP BY ALL")
def _(f):
    return surface.mesh_edges(_mesh(f)[1]).groupBy("sample_id", "n_faces").agg(F.count("*").alias("edges"))


@query("me10_vertex_degrees", "l:sample_id,degree,vertices", """SELECT sample_id, degree, count(*) AS vertices FROM (SELECT sample_id, v, count(*) AS degree FROM (SELECT sample_id, a AS v FROM medges UNION ALL SELECT sample_id, b FROM medges) GROUP BY ALL) GROUP BY ALL""")
def _(f):
    d = surface.vertex_neighbours(_mesh(f)[1]).groupBy("sample_id", "vertex_id").agg(F.count("*").alias("degree"))
    return d.groupBy("sample_id", "degree").agg(F.count("*").alias("vertices"))


@query("sj12_vertex_faces", "l:sample_id,size,vertices", """SELECT sample_id, size, count(*) AS vertices FROM (SELECT sample_id, v, count(DISTINCT face_id) AS size FROM (SELECT sample_id, face_id, p AS v FROM half) GROUP BY ALL) GROUP BY ALL""")
def _(f):
    d = surface.vertex_faces(_mesh(f)[1]).withColumn("size", F.size("faces"))
    return d.groupBy("sample_id", "size").agg(F.count("*").alias("vertices"))


@query("me11_mesh_bounds", "l:sample_id d:xmin,xmax,ymin,ymax,zmin,zmax", "SELECT sample_id, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM verts GROUP BY sample_id")
def _(f):
    return surface.mesh_bounds(_mesh(f)[0])


FACE_N = """SELECT s.sample_id, s.tri_id, ("by"-ay)*(cz-az)-(bz-az)*(cy-ay) AS ux, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS uy, (bx-ax)*(cy-ay)-("by"-ay)*(cx-ax) AS uz FROM soup s"""


@query("me12_face_normals", "l:sample_id,tri_id d:nx,ny,nz", f"SELECT sample_id, tri_id, ux/sqrt(ux*ux+uy*uy+uz*uz) AS nx, uy/sqrt(ux*ux+uy*uy+uz*uz) AS ny, uz/sqrt(ux*ux+uy*uy+uz*uz) AS nz FROM ({FACE_N})")
def _(f):
    return surface.to_soup(*_mesh(f))


def _normals_sql(weight: str, fallback: str) -> str:
    return f"""SELECT v.sample_id, v.x, v.y, v.z, {', '.join(f"CASE WHEN sqrt(sx*sx+sy*sy+sz*sz) > 1e-12 THEN s{a}/sqrt(sx*sx+sy*sy+sz*sz) ELSE {f} END AS n{a}" for a, f in zip('xyz', fallback))} FROM (
    SELECT h.sample_id, h.v, sum(ux*w) AS sx, sum(uy*w) AS sy, sum(uz*w) AS sz FROM (SELECT half.sample_id, half.face_id, half.p AS v, n.ux, n.uy, n.uz, {weight} AS w FROM half JOIN ({FACE_N}) n ON n.sample_id=half.sample_id AND n.tri_id=half.face_id
    JOIN soup s ON s.sample_id=half.sample_id AND s.tri_id=half.face_id JOIN verts m ON m.sample_id=half.sample_id AND m.vertex_id=half.p) h GROUP BY ALL) q
    JOIN verts v ON v.sample_id=q.sample_id AND v.vertex_id=q.v"""


@query("me12_vertex_normals", "l:sample_id d:x,y,z,nx,ny,nz", _normals_sql("1.0", "010"))
def _(f):
    return surface.vertex_normals(*_mesh(f))


# unit right triangles: the corner at the right angle is the one whose two edges are axis-parallel
@query("me13_pseudonormals", "l:sample_id d:x,y,z,nx,ny,nz", _normals_sql("""acos(greatest(least(CASE WHEN (m.x,m.y,m.z)=(s.ax,s.ay,s.az) THEN ((s.bx-s.ax)*(s.cx-s.ax)+(s."by"-s.ay)*(s.cy-s.ay)+(s.bz-s.az)*(s.cz-s.az))/sqrt(((s.bx-s.ax)*(s.bx-s.ax)+(s."by"-s.ay)*(s."by"-s.ay)+(s.bz-s.az)*(s.bz-s.az))*((s.cx-s.ax)*(s.cx-s.ax)+(s.cy-s.ay)*(s.cy-s.ay)+(s.cz-s.az)*(s.cz-s.az)))
    WHEN (m.x,m.y,m.z)=(s.bx,s."by",s.bz) THEN ((s.ax-s.bx)*(s.cx-s.bx)+(s.ay-s."by")*(s.cy-s."by")+(s.az-s.bz)*(s.cz-s.bz))/sqrt(((s.ax-s.bx)*(s.ax-s.bx)+(s.ay-s."by")*(s.ay-s."by")+(s.az-s.bz)*(s.az-s.bz))*((s.cx-s.bx)*(s.cx-s.bx)+(s.cy-s."by")*(s.cy-s."by")+(s.cz-s.bz)*(s.cz-s.bz)))
    ELSE ((s.ax-s.cx)*(s.bx-s.cx)+(s.ay-s.cy)*(s."by"-s.cy)+(s.az-s.cz)*(s.bz-s.cz))/sqrt(((s.ax-s.cx)*(s.ax-s.cx)+(s.ay-s.cy)*(s.ay-s.cy)+(s.az-s.cz)*(s.az-s.cz))*((s.bx-s.cx)*(s.bx-s.cx)+(s."by"-s.cy)*(s."by"-s.cy)+(s.bz-s.cz)*(s.bz-s.cz))) END,1),-1))""", "010"))
def _(f):
    return surface.vertex_normals(*_mesh(f), weight="angle")


@query("me18_area_normals", "l:sample_id d:x,y,z,nx,ny,nz", _normals_sql("1.0", "001"))
def _(f):
    return surface.vertex_normals(*_mesh(f), weight="area", fallback=(0.0, 0.0, 1.0))


@query("me14_mesh_components", "l:sample_id,parts,largest", """WITH RECURSIVE link AS MATERIALIZED (SELECT sample_id, a AS u, b AS v FROM medges UNION ALL SELECT sample_id, b, a FROM medges),
    walk(sample_id, u, root) USING KEY (sample_id, u) AS (SELECT sample_id, vertex_id, vertex_id FROM verts
    UNION SELECT l.sample_id, l.v, min(w.root) AS root FROM walk w JOIN link l ON l.sample_id=w.sample_id AND l.u=w.u JOIN recurring.walk r ON r.sample_id=l.sample_id AND r.u=l.v WHERE w.root < r.root GROUP BY ALL),
    parts AS (SELECT sample_id, root, count(*) AS n FROM walk GROUP BY ALL) SELECT sample_id, count(*) AS parts, max(n) AS largest FROM parts GROUP BY sample_id""")
def _(f):
    v, t = _mesh(f)
    sizes = graph.component_sizes(v.select("sample_id", F.col("vertex_id").alias("node")), surface.mesh_edges(t), ["sample_id"])
    return sizes.groupBy("sample_id").agg(F.count("*").alias("parts"), F.max("size").alias("largest"))


MOVED = """SELECT v.sample_id, v.vertex_id, v.x+(m.x-v.x)*{f} AS x, v.y+(m.y-v.y)*{f} AS y, v.z+(m.z-v.z)*{f} AS z FROM {t} v JOIN (
    SELECT l.sample_id, l.a AS v, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM link l JOIN {t} n ON n.sample_id=l.sample_id AND n.vertex_id=l.b GROUP BY ALL) m ON m.sample_id=v.sample_id AND m.v=v.vertex_id"""


@query("me15_mesh_taubin", "l:sample_id d:x,y,z", f"""WITH link AS (SELECT sample_id, a, b FROM medges UNION ALL SELECT sample_id, b, a FROM medges), m1 AS ({MOVED.format(f=0.5, t='verts')}), m2 AS ({MOVED.format(f=-0.53, t='m1')})
    SELECT sample_id, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM m2 GROUP BY sample_id""", digits=4)
def _(f):
    v, t = _mesh(f)
    return surface.taubin_mesh(v, t, 1).groupBy("sample_id").agg(*(F.sum(a).alias(a) for a in "xyz"))


@query("me16_simplified", "l:sample_id,faces_before,target b:fewer,no_degenerate", f"SELECT sample_id, count(*) AS faces_before, CAST(ceil(count(*)*0.9) AS BIGINT) AS target, true AS fewer, true AS no_degenerate FROM soup GROUP BY sample_id")
def _(f):
    v, t = _mesh(f)
    _, after, report = surface.simplify(v, t, ratio=0.9, max_rounds=1)
    bad = after.filter("v1 = v2 or v2 = v3 or v1 = v3").groupBy("sample_id").agg(F.count("*").alias("bad"))
    return report.join(bad, "sample_id", "left").select("sample_id", "faces_before", "target", (F.col("faces_after") < F.col("faces_before")).alias("fewer"), F.col("bad").isNull().alias("no_degenerate"))


# spatial joins with meshes

def _mesh_points(f):
    return f.common("points").withColumn("sample_id", F.col("point_id") % f.table("supplier").count() + 1).withColumns(
        {a: F.col(a) * 0.8 + 0.11 for a in "xyz"})


MESH_POINTS = "SELECT point_id % (SELECT count(*) FROM supplier) + 1 AS sample_id, point_id, x*0.8+0.11 AS x, y*0.8+0.11 AS y, z*0.8+0.11 AS z FROM points"


@query("sj6_inside_mesh", "l:sample_id,point_id", f"SELECT p.sample_id, p.point_id FROM ({MESH_POINTS}) p JOIN image m ON m.sample_id=p.sample_id AND m.i=floor(p.x) AND m.j=floor(p.y) AND m.k=floor(p.z)")
def _(f):
    return spatial.inside_mesh(_mesh_points(f), materialize(f.skin(), "soup"), ["point_id"], cell=1.0)


#: Distance to a set of unit squares, two triangles each: per square clamp in its plane.
SQUARES = """SELECT sample_id, tri_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM spots GROUP BY ALL"""


@query("sj5_nearest_triangle", "l:sample_id,point_id d:distance", f"""SELECT p.sample_id, p.point_id, min(sqrt(greatest(x0-p.x,0,p.x-x1)*greatest(x0-p.x,0,p.x-x1)+greatest(y0-p.y,0,p.y-y1)*greatest(y0-p.y,0,p.y-y1)+greatest(z0-p.z,0,p.z-z1)*greatest(z0-p.z,0,p.z-z1))) AS distance
    FROM ({MESH_POINTS}) p JOIN ({SQUARES}) s ON s.sample_id=p.sample_id GROUP BY ALL""")
def _(f):
    return spatial.nearest_triangle(_mesh_points(f), materialize(f.skin(), "soup"), ["point_id"], cell=1.0)


def _square_distance(points: str, names: str) -> str:
    """Brute force over all squares of the sample, negative where the point's voxel is solid."""
    gap = "+".join(f"power(greatest({a}0-p.{a},0,p.{a}-{a}1),2)" for a in "xyz")
    own = ",".join(f"p.{n}" for n in names.split(","))
    return f"""SELECT {own}, CASE WHEN m.i IS NULL THEN 1 ELSE -1 END * d AS distance FROM (SELECT {own}, p.x, p.y, p.z, sqrt(min({gap})) AS d
        FROM ({points}) p JOIN ({SQUARES}) s ON s.sample_id=p.sample_id GROUP BY ALL) p LEFT JOIN image m ON m.sample_id=p.sample_id AND m.i=floor(p.x) AND m.j=floor(p.y) AND m.k=floor(p.z)"""


@query("sj5_mesh_signed_distance", "l:sample_id,point_id d:distance", _square_distance(MESH_POINTS, "sample_id,point_id"))
def _(f):
    return spatial.mesh_signed_distance(_mesh_points(f), materialize(f.skin(), "soup"), ["point_id"], cell=1.0)


#: A grid that reaches far beyond the images: 8 nodes an axis, 4.1 apart, from -9.
WIDE = """SELECT sample_id, a.n AS i, b.n AS j, c.n AS k, a.n*4.1e0-9 AS x, b.n*4.1e0-9 AS y, c.n*4.1e0-9 AS z
    FROM (SELECT DISTINCT sample_id FROM image) s, (SELECT range AS n FROM range(8)) a, (SELECT range AS n FROM range(8)) b, (SELECT range AS n FROM range(8)) c"""
WIDE_FAR = 0.5 + 3 * 4.1 * 3**0.5


@query("pr13_mesh_band", "l:sample_id,i,j,k s:kind d:distance", f"""WITH d AS MATERIALIZED ({_square_distance(WIDE, "sample_id,i,j,k")}),
    corner AS (SELECT sample_id, distance, unnest(list_distinct([i//3, greatest(CAST(ceil(i/3.0) AS BIGINT)-1, 0)])) AS ci, j, k FROM d WHERE (i%3=0 OR i=7) AND (j%3=0 OR j=7) AND (k%3=0 OR k=7)),
    corner2 AS (SELECT sample_id, distance, ci, unnest(list_distinct([j//3, greatest(CAST(ceil(j/3.0) AS BIGINT)-1, 0)])) AS cj, k FROM corner),
    corner3 AS (SELECT sample_id, distance, ci, cj, unnest(list_distinct([k//3, greatest(CAST(ceil(k/3.0) AS BIGINT)-1, 0)])) AS ck FROM corner2),
    kinds AS (SELECT sample_id, ci, cj, ck, min(distance) AS lo, max(distance) AS hi FROM corner3 GROUP BY ALL)
    SELECT d.sample_id, i, j, k, CASE WHEN lo > {WIDE_FAR} THEN 'outside' WHEN hi < -{WIDE_FAR} THEN 'inside' ELSE 'exact' END AS kind,
        CASE WHEN lo > {WIDE_FAR} THEN lo-{WIDE_FAR - 0.5} WHEN hi < -{WIDE_FAR} THEN hi+{WIDE_FAR - 0.5} ELSE distance END AS distance
    FROM d JOIN kinds x ON x.sample_id=d.sample_id AND ci=i//3 AND cj=j//3 AND ck=k//3""")
def _(f):
    """Signed distance of each image's mesh on a wide grid, exact only where coarse distances cannot prove the side."""
    nodes = f.image().select("sample_id").distinct()
    for c in "ijk":
        nodes = nodes.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(7))))
    voxels = nodes.withColumns({a: F.col(c) * 4.1 - 9.0 for a, c in zip("xyz", "ijk")})
    return spatial.banded_mesh_distance(voxels, materialize(f.skin(), "soup"), 3, 0.5, (4.1, 4.1, 4.1), cell=1.0)


# 2.1 files: written from the mesh or image and read back

def _folder(f, name):
    import uuid

    return f"{scratch_root(f.spark)}/voxframe/{name}-{uuid.uuid4().hex}"


@query("io1_io4_stl_round_trip", "l:sample_id,triangles d:ax,by,cz", """SELECT sample_id, count(*) AS triangles, sum(ax) AS ax, sum("by") AS "by", sum(cz) AS cz FROM soup GROUP BY sample_id""")
def _(f):
    folder = _folder(f, "stl")
    mesh_files.write_files(mesh_files.stl_bytes(f.skin()), folder, ".stl").write.format("noop").mode("overwrite").save()
    back = mesh_files.read_stl(f.spark, f"{folder}/*.stl")
    return back.groupBy(F.regexp_extract("path", r"(\d+)\.stl$", 1).cast("long").alias("sample_id")).agg(F.count("tri_id").alias("triangles"), *(F.sum(c).alias(c) for c in ("ax", "by", "cz")))


@query("io2_io5_ascii_round_trip", "l:sample_id,triangles d:ax,by,cz", """SELECT sample_id, count(*) AS triangles, sum(ax) AS ax, sum("by") AS "by", sum(cz) AS cz FROM soup GROUP BY sample_id""")
def _(f):
    made = mesh_files.stl_bytes(f.skin(), ascii_text=True)

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for s, content in zip(pdf["sample_id"], pdf["content"]):
                c = mesh_files.parse_stl(content)
                rows.append((s, len(c), c[:, 0].sum(), c[:, 4].sum(), c[:, 8].sum()))
            yield pd.DataFrame(rows, columns=["sample_id", "triangles", "ax", "by", "cz"])

    return made.mapInPandas(parse, "sample_id long, triangles long, ax double, by double, cz double")


@query("io6_nrrd_image", "l:sample_id,bytes,solid", f"SELECT sample_id, 12*12*12 AS bytes, count(*) AS solid FROM image GROUP BY sample_id")
def _(f):
    made = image_files.image_bytes(f.voxels(), 0.5)
    body = F.substring("content", F.expr("locate('\n\n', decode(content, 'ISO-8859-1')) + 2"), L(1 << 30))
    return made.select("sample_id", F.length(body).alias("bytes"), (F.length(F.regexp_replace(F.hex(body), "00", "")) / 2).cast("long").alias("solid"))


META = "ObjectType = Image\\nNDims = 3\\nBinaryData = True\\nBinaryDataByteOrderMSB = False\\nOffset = 0 0 0\\nElementSpacing = 0.5 0.5 0.5\\nDimSize = 12 12 12\\nElementType = MET_UCHAR\\nElementDataFile = "


@query("io7_meta_image", "l:sample_id,bytes,solid s:header", f"SELECT sample_id, 12*12*12 AS bytes, count(*) AS solid, concat(E'{META}', sample_id, E'.raw\\n') AS header FROM image GROUP BY sample_id")
def _(f):
    made = image_files.image_bytes(f.voxels(), 0.5, "mhd")
    solid = (F.length(F.regexp_replace(F.hex("content"), "00", "")) / 2).cast("long")
    return made.select("sample_id", F.length("content").alias("bytes"), solid.alias("solid"), F.decode("header", "UTF-8").alias("header"))
