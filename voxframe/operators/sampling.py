"""Row generators: random points, thinned and graded point sets, designs, directions, sweeps.

Randomness is a hash of (sample, row, draw, seed), so that results do not depend on
partitions, retries or the number of executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.scratch import by_shuffle, materialize

CELL = ["_cell_x", "_cell_y", "_cell_z"]


def resolve_seed(seed: int) -> int:
    """Zero asks for a fresh seed, any other value is kept."""
    import secrets

    return seed or secrets.randbelow(1 << 31) + 1


def random_points(domains: DataFrame, n_column: str, inside: Column, seed: int, over: float = 4.0, by: str = "sample_id") -> DataFrame:
    """``n`` uniform points per domain (by, xmin..zmax, and what ``inside`` reads) by rejection: by, seed_id, x, y, z.

    Candidates are numbered and the first n accepted ones stay, so the points of a domain are
    the same however many are drawn; domains left short draw more numbers.
    """
    kept, lo, todo, factor = None, 0, domains.withColumn("_want", F.col(n_column).cast("long")), over
    while True:
        draw = todo.withColumn("_no", F.explode(F.sequence(F.lit(lo).cast("long"), (F.ceil(F.col(n_column) * factor) + lo).cast("long"))))
        place = {a: F.col(f"{a}min") + (F.col(f"{a}max") - F.col(f"{a}min")) * g.hash_uniform(seed, F.col(by), F.col("_no"), F.lit(a)) for a in "xyz"}
        hit = draw.withColumns(place).filter(inside).select(by, "_no", "x", "y", "z")
        kept = materialize(hit if kept is None else kept.unionByName(hit), "draws")
        top = domains.agg(F.max(n_column)).first()[0] or 0
        lo += int(top * factor) + 2
        short = domains.join(kept.groupBy(by).agg(F.count("*").alias("_n")), by, "left").filter(F.coalesce("_n", F.lit(0)) < F.col(n_column)).drop("_n")
        if not short.limit(1).count():
            break
        todo, factor = short.withColumn("_want", F.col(n_column)), factor * 2
        if factor > over * 1024:
            break
    order = Window.partitionBy(by).orderBy("_no")
    return kept.withColumn("seed_id", F.row_number().over(order).cast("long")).join(domains.select(by, F.col(n_column).alias("_want")), by).filter(
        F.col("seed_id") <= F.col("_want")).select(by, "seed_id", "x", "y", "z")


def thin_by_distance(points: DataFrame, radius: Column | float, largest: float, priority: str = "seed_id", by: str = "sample_id", row_id: str = "seed_id") -> DataFrame:
    """Greedy maximal subset with pairwise distances over ``radius``: rows in order of (priority, id), each
    kept if no kept earlier row is within the later row's radius (a Column for graded spacing).

    Close pairs are found once by cells of the largest radius and stored. Then rounds: a row with no
    undecided earlier neighbour is kept unless a kept one is near; equal to the sequential result.
    """
    p = points.select(by, row_id, F.struct(priority, row_id).alias("rank"), "x", "y", "z", g.lit(radius).alias("radius"))
    cells = [F.floor(F.col(a) / largest).cast("int").alias(c) for a, c in zip("xyz", CELL)]
    near = p.select(by, F.col(row_id).alias("_e"), F.col("rank").alias("_rank"), *(F.col(a).alias(f"_{a}") for a in "xyz"), *cells)
    for c in CELL:
        near = near.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    pairs = materialize(p.select("*", *cells).join(by_shuffle(near), [by, *CELL]).filter(
        (F.col("_rank") < F.col("rank")) & (g.point_distance(g.vec(), tuple(F.col(f"_{a}") for a in "xyz")) <= F.col("radius"))).select(
        by, F.col(row_id).alias("late"), F.col("_e").alias("early")), "pairs")
    # state 1 kept, -1 dropped, 0 open
    blocked = pairs.select(by, F.col("late").alias(row_id)).distinct()
    state = materialize(points.select(by, row_id).join(blocked.withColumn("_b", F.lit(1)), [by, row_id], "left").select(
        by, row_id, F.when(F.col("_b").isNull(), 1).otherwise(0).alias("state")), "state")
    while state.filter("state = 0").limit(1).count():
        early = pairs.join(by_shuffle(state.select(by, F.col(row_id).alias("early"), F.col("state").alias("es"))), [by, "early"]).groupBy(by, "late").agg(
            F.max("es").alias("most"), F.min(F.abs("es")).alias("settled"))
        nxt = state.join(early.withColumnRenamed("late", row_id), [by, row_id], "left").select(
            by, row_id, F.when(F.col("state") != 0, F.col("state")).when(F.col("most") == 1, -1).when(F.col("settled") == 1, 1).otherwise(0).alias("state"))
        state = materialize(nxt, "state")
    return points.join(state.filter("state = 1").select(by, row_id), [by, row_id], "left_semi")


def maximal_points(domains: DataFrame, radius: float, seed: int, inside: Column | None = None, levels: int = 10, by: str = "sample_id") -> DataFrame:
    """Points of each domain (by, xmin..zmax, and what ``inside`` reads) more than ``radius`` apart that leave no room for another: by, seed_id, x, y, z.

    Space is cut into cells that hold one point at most. In a round every cell that is still open draws one hashed place;
    places too near to a point drop out, and of places near to one another the one with the least hash stays. Then open
    cells are cut in eight, and those that one point covers altogether close. Rounds end when no cell is open, or after
    ``levels`` cuts: what is left open then is narrower than radius / 2^levels (with ``inside``, cells beyond it stay open
    till then). Equal seeds give equal points on any partitions; seed 0 draws a fresh one. Ids number the points of all domains.
    """
    seed = resolve_seed(seed)
    box = [f"{a}{m}" for a in "xyz" for m in ("min", "max")]
    extra = [c for c in domains.columns if c not in {by, *box}]
    side = radius / 3**0.5
    cells = [f"_c{a}" for a in "xyz"]
    open_ = domains
    for a, c in zip("xyz", cells):
        open_ = open_.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col(f"{a}max") - F.col(f"{a}min")) / side).cast("long") - 1, F.lit(0)))))
    open_ = materialize(open_, "open-cells")
    bins = lambda place: [F.floor(e / radius).cast("long").alias(c) for e, c in zip(place, CELL)]

    def around(points: DataFrame) -> DataFrame:
        """Points copied to the bins within reach, as _x, _y, _z."""
        near = points.select(by, *(F.col(a).alias(f"_{a}") for a in "xyz"), *(c for c in ("_h",) if c in points.columns), *bins(g.vec()))
        for c in CELL:
            near = near.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
        return by_shuffle(near)

    kept: DataFrame | None = None
    for level in range(levels + 1):
        step = side / 2**level
        drawn = [F.col(f"{a}min") + (F.col(c) + g.hash_uniform(seed, F.col(by), *map(F.col, cells), F.lit(level), F.lit(a))) * step for a, c in zip("xyz", cells)]
        place = open_.withColumns({a: e for a, e in zip("xyz", drawn)}).withColumn("_h", F.xxhash64(F.lit(seed), by, *cells, F.lit(level)))
        fits = reduce(lambda u, v: u & v, (F.col(a) <= F.col(f"{a}max") for a in "xyz"))
        place = place.filter(fits if inside is None else fits & inside).select(by, *cells, "x", "y", "z", "_h").withColumns({c: e for c, e in zip(CELL, bins(g.vec()))})
        gap = g.point_distance(g.vec(), g.vec("_"))
        if kept is not None:
            taken = place.join(around(kept), [by, *CELL]).filter(gap <= radius).select(by, *cells)
            place = place.join(taken, [by, *cells], "left_anti")
        place = materialize(place, "places")
        beaten = place.join(around(place).withColumnRenamed("_h", "_other"), [by, *CELL]).filter((gap <= radius) & (F.col("_other") < F.col("_h"))).select(by, *cells)
        new = place.join(beaten, [by, *cells], "left_anti").select(by, "x", "y", "z")
        kept = materialize(new if kept is None else kept.unionByName(new), "points")
        if level == levels:
            break
        for c in cells:
            open_ = open_.withColumn(c, F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)))
        half = step / 2
        low = [F.col(f"{a}min") + F.col(c) * half for a, c in zip("xyz", cells)]
        halved = open_.filter(reduce(lambda u, v: u & v, (e <= F.col(f"{a}max") for e, a in zip(low, "xyz"))))
        middle = [e + half / 2 for e in low]
        far = [F.abs(m - F.col(f"_{a}")) + half / 2 for m, a in zip(middle, "xyz")]
        covered = halved.withColumns({c: e for c, e in zip(CELL, bins(middle))}).join(around(kept), [by, *CELL]).filter(
            far[0] * far[0] + far[1] * far[1] + far[2] * far[2] <= radius * radius).select(by, *cells)
        open_ = materialize(halved.join(covered, [by, *cells], "left_anti").select(by, *box, *extra, *cells), "open-cells")
        if not open_.limit(1).count():
            break
    return number_rows(kept, [F.col(by), F.col("x"), F.col("y"), F.col("z")], "seed_id").select(by, F.col("seed_id").cast("long").alias("seed_id"), "x", "y", "z")


def stochastic_radius(mean: Column, sd: Column, lo: Column, hi: Column, seed: int, *keys, tries: int = 16) -> Column:
    """The first of ``tries`` normal draws within [lo, hi], else the last one clamped."""
    def draw(k: int) -> Column:
        u = F.greatest(g.hash_uniform(seed, *keys, F.lit(2 * k)), F.lit(1e-300))
        return mean + sd * F.sqrt(F.log(u) * -2.0) * F.cos(g.hash_uniform(seed, *keys, F.lit(2 * k + 1)) * 6.283185307179586)

    draws = F.array(*(draw(k) for k in range(tries)))
    good = F.filter(draws, lambda x: x.between(lo, hi))
    return F.coalesce(F.get(good, F.lit(0)), g.clamp(F.element_at(draws, -1), lo, hi))


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """Rows numbered from 0 in a global order without a single-task window: sorted ranges and their counts."""
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_id", 33)
    counts = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    starts = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))
    return ranged.withColumn("_p", part).join(starts, "_p").withColumn(name, F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_s")).drop("_p", "_id", "_s")


def latin_hypercube(rows: DataFrame, n_dims: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """Per dimension a random bin of its own for every row and a random place in it: row_id, u0, u1, ..."""
    n = rows.count()
    out = rows.select(row_id)
    for d in range(n_dims):
        binned = number_rows(rows.select(row_id), [g.hash_uniform(seed, F.col(row_id), F.lit(d), F.lit("bin")), F.col(row_id)], "_bin")
        out = out.join(binned, row_id).withColumn(f"u{d}", (F.col("_bin") + g.hash_uniform(seed, F.col(row_id), F.lit(d), F.lit("in"))) / float(n)).drop("_bin")
    return out


def scale_design(u: DataFrame, kind: str) -> DataFrame:
    """Design columns from unit columns u0..: random (count), uniform (radius) or varied (two radii, in order)."""
    span = lambda c, lo, hi: F.col(c) * (hi - lo) + lo
    if kind == "random":
        df = u.withColumn("count", F.floor(span("u0", 50.0, 2000.0)).cast("int")).withColumn("scale", F.pow(F.col("count").cast("double"), F.lit(-1.0 / 3)) * 5.0)
    elif kind == "uniform":
        df = u.withColumn("radius", span("u0", 0.6, 3.0)).withColumn("scale", F.col("radius"))
    elif kind == "varied":
        a, b = span("u0", 0.6, 3.0), span("u3", 0.6, 3.0)
        df = u.withColumns({"radius_min": F.least(a, b), "radius_max": F.greatest(a, b)}).withColumn("scale", (F.col("radius_min") + F.col("radius_max")) / 2)
    else:
        raise ValueError(kind)
    return df.withColumn("thickness", g.clamp(F.col("u1") * F.col("scale"), 0.1, 5.0)).withColumn("pullback", span("u2", 0.5, 1.0))


def fibonacci_directions(rows: DataFrame, n: Column, index: str = "d") -> DataFrame:
    """Evenly spread directions dx, dy, dz for index 0..n-1."""
    t = F.col(index)
    polar = F.acos(F.lit(1.0) - (t + 0.5) * 2.0 / n)
    turn = t * 3.141592653589793 * (1.0 + 5.0 ** 0.5)
    return rows.withColumns({"dx": F.sin(polar) * F.cos(turn), "dy": F.sin(polar) * F.sin(turn), "dz": F.cos(polar)})


def sweep_rows(base: DataFrame, inputs: dict[str, tuple[float, float]], n: int) -> DataFrame:
    """One input at a time over n even values, the others at the base: base columns, swept, step."""
    parts = []
    for name, (lo, hi) in inputs.items():
        steps = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step")
        parts.append(base.select("*", F.lit(name).alias("swept"), steps).withColumn(name, F.col("step") * ((hi - lo) / max(1, n - 1)) + lo))
    return reduce(DataFrame.unionByName, parts)


def sweep_grid(base: DataFrame, first: tuple[str, float, float, int], second: tuple[str, float, float, int]) -> DataFrame:
    """All combinations of two inputs' even values around the base."""
    out = base
    for k, (name, lo, hi, n) in enumerate((first, second)):
        out = out.withColumn(f"step{k}", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(name, F.col(f"step{k}") * ((hi - lo) / max(1, n - 1)) + lo)
    return out


def constrained_cohort(ids: DataFrame, seed: int, draws: int = 101, ratio: float = 2.5, by: str = "sample_id") -> DataFrame:
    """Per id the first of up to ``draws`` random recipes whose spacing is at least ``ratio`` x thickness, with sampled stretch."""
    u = lambda what: g.hash_uniform(seed, F.col(by), F.col("draw_no"), F.lit(what))
    drawn = ids.withColumn("draw_no", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumns({
        "thickness": u("thickness") * 0.2 + 0.1, "spacing": u("spacing") * 0.7 + 0.3, "openness": u("openness"),
        **{f"stretch_{a}": u(f"stretch_{a}") + 0.5 for a in "xyz"}})
    fields = ["draw_no", "thickness", "spacing", "openness", "stretch_x", "stretch_y", "stretch_z"]
    return drawn.filter(F.col("spacing") >= F.col("thickness") * ratio).groupBy(by).agg(F.min_by(F.struct(*fields), "draw_no").alias("r")).select(by, "r.*")


def replicates(samples: DataFrame, n: int) -> DataFrame:
    return samples.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))


def value_list(ranges: DataFrame, extras: DataFrame, by: str = "sample_id") -> DataFrame:
    """Values lo, lo + step, ... up to hi and extra values; equal ones (at 1e-6) once, numbered in order."""
    steps = F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / F.col("step") + 1e-9).cast("int"))).alias("k")
    values = ranges.select(by, steps, "lo", "step").select(by, (F.col("lo") + F.col("k") * F.col("step")).alias("value"))
    both = values.unionByName(extras.select(by, "value")).withColumn("value", F.round("value", 6)).distinct()
    return both.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("value")))


SHAPES = ("slab", "cylinder", "sphere", "torus")


def phantom_distance(shape: Column, feature: Column, domain: Column) -> Column:
    """Signed distance of an analytic shape centred in a cube of side ``domain``; ``feature`` is its thickness."""
    c = domain / 2
    x, y, z, r = F.col("x") - c, F.col("y") - c, F.col("z") - c, feature / 2
    ring = F.sqrt(x * x + y * y) - feature
    return g.choose(F.array_position(F.array(*map(F.lit, SHAPES)), shape).cast("int") - 1, [
        F.abs(z) - r, F.sqrt(x * x + y * y) - r, F.sqrt(x * x + y * y + z * z) - r, F.sqrt(ring * ring + z * z) - r])


def phantom_grid(shapes: DataFrame) -> DataFrame:
    """Field rows of analytic shapes (sample_id, shape, feature, voxel): a cube of side max(1, 6 x feature)."""
    from .grid import grid_points, grid_size

    side = F.greatest(F.lit(1.0), F.col("feature") * 6.0)
    n = grid_size(side, F.col("voxel"))
    samples = shapes.withColumn("domain", side).withColumns({f"{a}min": F.lit(0.0) for a in "xyz"} | {f"{a}max": (n - 1) * F.col("voxel") for a in "xyz"} | {f"n{a}": n for a in "xyz"})
    return grid_points(samples, keep=("shape", "feature", "voxel", "domain")).withColumn("value", phantom_distance(F.col("shape"), F.col("feature"), F.col("domain")))
