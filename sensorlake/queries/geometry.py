"""Queries on coordinates: geodesy, attitude, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlake.config import Camera
from sensorlake.functions import geo, projection
from sensorlake.functions.records import rounded
from sensorlake.operators import marker_pose as pose_of_markers
from sensorlake.plans import flows
from sensorlake.queries.base import GEO, VEC, geo_points, query, r, table, vec

RAD = "e AS (SELECT *, radians(lat) AS la, radians(lon) AS lo FROM g), n AS (SELECT *, 6378137.0 / sqrt(1.0 - 6.69437999014e-3 * sin(la) * sin(la)) AS n FROM e)"
ECEF = f"{GEO}, {RAD}, c AS (SELECT *, (n + h) * cos(la) * cos(lo) AS x, (n + h) * cos(la) * sin(lo) AS y, (n * (1.0 - 6.69437999014e-3) + h) * sin(la) AS z FROM n)"


def _rounded_sql(names: dict[str, str], digits: int = 4) -> str:
    return ", ".join(f"{r(e, digits)} AS {n}" for n, e in names.items())


def _ecef(spark, sf_dir):
    g = geo_points(spark, sf_dir)
    x, y, z = geo.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("h"))
    return g.select("*", x.alias("x"), y.alias("y"), z.alias("z"))


@query(f"WITH {ECEF} SELECT id, {_rounded_sql({'x': 'x', 'y': 'y', 'z': 'z'})} FROM c")
def lla_to_ecef(spark, sf_dir):
    return _ecef(spark, sf_dir).select("id", *rounded({c: F.col(c) for c in "xyz"}, 4))


STEPS = "q0 AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(z, sqrt(x * x + y * y) * (1.0 - 6.69437999014e-3)) AS b FROM c)" + "".join(
    f", q{i + 1} AS (SELECT * REPLACE (atan2(z + 6.69437999014e-3 * (6378137.0 / sqrt(1.0 - 6.69437999014e-3 * sin(b) * sin(b))) * sin(b), p) AS b) FROM q{i})" for i in range(6))


@query(f"WITH {ECEF}, {STEPS} SELECT id, {_rounded_sql({'lat2': 'degrees(b)', 'lon2': 'degrees(atan2(y, x))'})}, "
       f"{r('p / greatest(cos(b), 1e-12) - 6378137.0 / sqrt(1.0 - 6.69437999014e-3 * sin(b) * sin(b))', 4)} AS h2 FROM q6")
def ecef_to_lla(spark, sf_dir):
    out = geo.with_geodetic(_ecef(spark, sf_dir), ("x", "y", "z"), ("lat2", "lon2", "h2"))
    return out.select("id", *rounded({c: F.col(c) for c in ("lat2", "lon2", "h2")}, 4))


@query(f"WITH {ECEF}, o AS (SELECT x AS ox, y AS oy, z AS oz, la AS ola, lo AS olo FROM c WHERE id = (SELECT min(id) FROM c)), d AS (SELECT id, x - ox AS x, y - oy AS y, z - oz AS z, ola, olo FROM c, o) "
       f"SELECT id, {_rounded_sql({'e': '-sin(olo) * x + cos(olo) * y + 0.0 * z', 'n': '-sin(ola) * cos(olo) * x + -sin(ola) * sin(olo) * y + cos(ola) * z', 'u': 'cos(ola) * cos(olo) * x + cos(ola) * sin(olo) * y + sin(ola) * z'}, 3)} FROM d")
def ecef_to_enu(spark, sf_dir):
    c = _ecef(spark, sf_dir)
    origin = c.agg(F.min_by(F.struct("x", "y", "z", "lat", "lon"), "id").alias("o"))  # one row
    e, n, u = geo.apply(geo.enu_from_ecef(F.col("o.lat"), F.col("o.lon")), tuple(F.col(v) - F.col(f"o.{v}") for v in "xyz"))
    return c.join(F.broadcast(origin)).select("id", *rounded({"e": e, "n": n, "u": u}, 3))


ATT = (f"{GEO}, a AS (SELECT *, radians(lat / 4) AS r, radians(lat / 8) AS p, radians(lon) AS k FROM g)")
M = {
    "m00": "cos(p) * sin(k)", "m01": "-(cos(r) * cos(k) + sin(r) * sin(p) * sin(k))", "m02": "sin(r) * cos(k) - cos(r) * sin(p) * sin(k)",
    "m10": "cos(p) * cos(k)", "m11": "-(sin(r) * sin(p) * cos(k) - cos(r) * sin(k))", "m12": "-sin(r) * sin(k) - cos(r) * sin(p) * cos(k)",
    "m20": "sin(p)", "m21": "sin(r) * cos(p)", "m22": "cos(r) * cos(p)",
}


@query(f"WITH {ATT} SELECT id, {_rounded_sql(M, 6)} FROM a")
def attitude_matrix(spark, sf_dir):
    m = geo.attitude(F.col("lat") / 4, F.col("lat") / 8, F.col("lon"))
    return geo_points(spark, sf_dir).select("id", *rounded({f"m{i}{j}": m[i][j] for i in range(3) for j in range(3)}))


@query(f"WITH {GEO} SELECT id, {r('lon + ((lat * 3 - lon + 180.0) - 360 * floor((lat * 3 - lon + 180.0) / 360) - 180.0) * 0.25')} AS angle FROM g")
def angle_lerp(spark, sf_dir):
    return geo_points(spark, sf_dir).select("id", *rounded({"angle": geo.angle_lerp(F.col("lon"), F.col("lat") * 3, F.lit(0.25))}))


@query(f"WITH {GEO} SELECT id, {r('CASE WHEN lat < 0 THEN -1.0 ELSE 1.0 END * (abs(lat) + (id % 60) / 60.0 + (id % 59) / 3600.0)')} AS deg FROM g")
def dms_parse(spark, sf_dir):
    return geo_points(spark, sf_dir).select("id", *rounded({"deg": geo.dms_to_degrees(F.col("lat"), F.col("id") % 60, F.col("id") % 59)}))


(RS, TS) = geo.span_from_lidar()
BODY = {axis: " + ".join(f"({RS[i][j]!r}) * l{j}" for j in range(3)) + f" + ({TS[i]!r})" for axis, i in (("right", 0), ("fwd", 1), ("up", 2))}
WORLD = (f"{ECEF}, l AS (SELECT *, CAST(id % 7 AS DOUBLE) AS l0, CAST(id % 5 - 2 AS DOUBLE) AS l1, CAST(id % 3 AS DOUBLE) AS l2, radians(lat / 40) AS r, radians(lat / 80) AS p, radians(lon) AS k FROM c), "
         f"b AS (SELECT *, {BODY['fwd']} AS bf, -({BODY['right']}) AS bl, {BODY['up']} AS bu FROM l), "
         "en AS (SELECT *, " + ", ".join(f"({M[f'm{i}0']}) * bf + ({M[f'm{i}1']}) * bl + ({M[f'm{i}2']}) * bu AS e{i}" for i in range(3)) + " FROM b), "
         "t AS (SELECT id, x + (-sin(lo) * e0 + -sin(la) * cos(lo) * e1 + cos(la) * cos(lo) * e2) AS x, y + (cos(lo) * e0 + -sin(la) * sin(lo) * e1 + cos(la) * sin(lo) * e2) AS y, z + (0.0 * e0 + cos(la) * e1 + sin(la) * e2) AS z FROM en)")


@query(f"WITH {WORLD} SELECT id, {_rounded_sql({'x': 'x', 'y': 'y', 'z': 'z'}, 3)} FROM t")
def world_solution(spark, sf_dir):
    k = F.col("id")
    c = _ecef(spark, sf_dir)
    body = geo.lidar_to_body(((k % 7).cast("double"), (k % 5 - 2).cast("double"), (k % 3).cast("double")))
    enu = geo.apply(geo.attitude(F.col("lat") / 40, F.col("lat") / 80, F.col("lon")), body)
    shift = geo.apply(geo.transposed(geo.enu_from_ecef(F.col("lat"), F.col("lon"))), enu)
    return c.select("id", *rounded(dict(zip("xyz", geo.add(tuple(F.col(v) for v in "xyz"), shift), strict=True)), 3))


INVERSE = [" + ".join(f"({RS[i][j]!r}) * (w{i} - ({TS[i]!r}))" for i in range(3)) for j in range(3)]
ROUND_TRIP = (f"WITH {VEC}, l AS (SELECT label, x AS l0, y AS l1, z AS l2 FROM vec), w AS (SELECT *, -(-({BODY['right']})) AS w0, {BODY['fwd']} AS w1, {BODY['up']} AS w2 FROM l), "
              f"d AS (SELECT label, ({INVERSE[0]}) - l0 AS d0, ({INVERSE[1]}) - l1 AS d1, ({INVERSE[2]}) - l2 AS d2 FROM w) "
              f"SELECT label, {r('max(sqrt(d0 * d0 + d1 * d1 + d2 * d2))', 3)} AS gap, count(*) AS n FROM d GROUP BY label")


@query(ROUND_TRIP)
def body_round_trip(spark, sf_dir):
    """Largest deviation of lidar -> body -> lidar, by label."""
    v = tuple(F.col(c) for c in "xyz")
    back = geo.body_to_lidar(geo.lidar_to_body(v))
    gap = geo.norm3(*[a - b for a, b in zip(back, v, strict=True)])
    return vec(spark, sf_dir).groupBy("label").agg(F.max(F.bround(gap, 3)).alias("gap"), F.count("*").alias("n"))


CAM = Camera()
FRONT = "f AS (SELECT id, x / (z + 3) AS a, y / (z + 3) AS b FROM vec WHERE z + 3 > 0)"
PIN = (0.1, 0.01, 0.001, 0.002, 0.0005)


@query(f"WITH {VEC}, {FRONT}, q AS (SELECT *, a * a + b * b AS r2 FROM f), w AS (SELECT *, 1.0 + 0.1 * r2 + 0.01 * r2 * r2 + 0.0005 * r2 * r2 * r2 AS k FROM q) "
       f"SELECT id, {_rounded_sql({'u': f'{CAM.fx!r} * (a * k + 2.0 * 0.001 * a * b + 0.002 * (r2 + 2.0 * a * a)) + {CAM.cx!r}', 'v': f'{CAM.fy!r} * (b * k + 0.001 * (r2 + 2.0 * b * b) + 2.0 * 0.002 * a * b) + {CAM.cy!r}'})} FROM w")
def project_pinhole(spark, sf_dir):
    u, v = projection.pinhole(F.col("x"), F.col("y"), F.col("z") + 3, CAM, PIN)
    return vec(spark, sf_dir).select("id", *rounded({"u": u, "v": v}, 4)).where("u IS NOT NULL")


FISH = (f"{FRONT}, q AS (SELECT *, sqrt(a * a + b * b) AS r, atan(sqrt(a * a + b * b)) AS t FROM f), "
        f"w AS (SELECT *, CASE WHEN r > 0 THEN t * (1.0 + ({CAM.k[0]!r}) * (t*t) + ({CAM.k[1]!r}) * (t*t) * (t*t) + ({CAM.k[2]!r}) * (t*t) * (t*t) * (t*t) + ({CAM.k[3]!r}) * (t*t) * (t*t) * (t*t) * (t*t)) / r ELSE 1.0 END AS k FROM q), "
        f"px AS (SELECT id, {CAM.fx!r} * a * k + {CAM.cx!r} AS u, {CAM.fy!r} * b * k + {CAM.cy!r} AS v FROM w)")


def _fisheye(spark, sf_dir):
    seen = projection.with_fisheye(vec(spark, sf_dir), (F.col("x"), F.col("y"), F.col("z") + 3), ("u", "v"), CAM)
    return seen.select("id", "u", "v").where("u IS NOT NULL")


@query(f"WITH {VEC}, {FISH} SELECT id, {_rounded_sql({'u': 'u', 'v': 'v'})} FROM px")
def project_fisheye(spark, sf_dir):
    return _fisheye(spark, sf_dir).select("id", *rounded({"u": F.col("u"), "v": F.col("v")}, 4))


@query(f"WITH {VEC}, {FISH} SELECT id, CAST(trunc(u) AS INTEGER) AS pu, CAST(trunc(v) AS INTEGER) AS pv FROM px WHERE trunc(u) BETWEEN 0 AND 1263 AND trunc(v) BETWEEN 0 AND 1046")
def image_bounds(spark, sf_dir):
    p = _fisheye(spark, sf_dir).where(projection.in_image(F.col("u"), F.col("v"), CAM))
    return p.select("id", F.col("u").cast("int").alias("pu"), F.col("v").cast("int").alias("pv"))


@query(f"WITH {VEC}, t AS (SELECT id, x, y, z, sqrt(x * x + y * y + z * z) AS th FROM vec) SELECT id, "
       f"{_rounded_sql({'r00': 'cos(th) + (1.0 - cos(th)) * (x / th) * (x / th)', 'r01': '(1.0 - cos(th)) * (x / th) * (y / th) - sin(th) * (z / th)', 'r12': '(1.0 - cos(th)) * (y / th) * (z / th) - sin(th) * (x / th)'}, 6)} FROM t")
def rodrigues(spark, sf_dir):
    m = geo.rodrigues(F.col("x"), F.col("y"), F.col("z"))
    return vec(spark, sf_dir).select("id", *rounded({"r00": m[0][0], "r01": m[0][1], "r12": m[1][2]}))


def _carry(i: str, source: str, here: list[str], there: list[str]) -> str:
    """SQL that carries v0, v1, v2 of source from pose to pose; the result is the table out<i>."""
    pose = lambda p: f"radians({p[3]}) AS r, radians({p[4]}) AS p, radians({p[5]}) AS k, radians({p[0]}) AS la, radians({p[1]}) AS lo, {p[2]} AS hh"
    keep = "id, lat, lon, h, o0, o1, o2"
    n = "6378137.0 / sqrt(1.0 - 6.69437999014e-3 * sin(la) * sin(la))"
    ecef = ["(n + hh) * cos(la) * cos(lo)", "(n + hh) * cos(la) * sin(lo)", "(n * (1.0 - 6.69437999014e-3) + hh) * sin(la)"]
    enu = [["-sin(lo)", "cos(lo)", "0.0"], ["-sin(la) * cos(lo)", "-sin(la) * sin(lo)", "cos(la)"], ["cos(la) * cos(lo)", "cos(la) * sin(lo)", "sin(la)"]]
    dot = lambda row, names: " + ".join(f"({m}) * {v}" for m, v in zip(row, names, strict=True))
    column = lambda m, j: [row[j] for row in m]
    att = [[M[f"m{a}{b}"] for b in range(3)] for a in range(3)]
    body = {axis: text.replace("l0", "v0").replace("l1", "v1").replace("l2", "v2") for axis, text in BODY.items()}
    listed = lambda exprs, name: ", ".join(f"{e} AS {name}{j}" for j, e in enumerate(exprs))
    return ", ".join([
        f"a{i} AS (SELECT {keep}, v0, v1, v2, {pose(here)} FROM {source})",
        f"b{i} AS (SELECT *, {n} AS n, {body['fwd']} AS f0, -({body['right']}) AS f1, {body['up']} AS f2 FROM a{i})",
        f"c{i} AS (SELECT *, {listed([dot(row, ('f0', 'f1', 'f2')) for row in att], 'e')} FROM b{i})",
        f"d{i} AS (SELECT {keep}, {listed([f'{x} + ' + dot(column(enu, j), ('e0', 'e1', 'e2')) for j, x in enumerate(ecef)], 'x')} FROM c{i})",
        f"t{i} AS (SELECT *, {pose(there)} FROM d{i})", f"u{i} AS (SELECT *, {n} AS n FROM t{i})",
        f"g{i} AS (SELECT *, {listed([f'x{j} - ({x})' for j, x in enumerate(ecef)], 'g')} FROM u{i})",
        f"y{i} AS (SELECT *, {listed([dot(row, ('g0', 'g1', 'g2')) for row in enu], 'e')} FROM g{i})",
        f"z{i} AS (SELECT *, {listed([dot(column(att, j), ('e0', 'e1', 'e2')) for j in range(3)], 'f')} FROM y{i})",
        f"s{i} AS (SELECT *, -f1 AS w0, f0 AS w1, f2 AS w2 FROM z{i})", f"out{i} AS (SELECT {keep}, {listed(INVERSE, 'v')} FROM s{i})"])


HERE = ["lat", "lon", "h", "lat / 40", "lat / 80", "lon"]
THERE = ["lat + 1e-5", "lon - 1e-5", "h + 1", "lat / 50", "lat / 90", "lon + 5"]
START = "v AS (SELECT *, o0 AS v0, o1 AS v1, o2 AS v2 FROM (SELECT *, CAST(id % 7 AS DOUBLE) AS o0, CAST(id % 5 - 2 AS DOUBLE) AS o1, CAST(id % 3 AS DOUBLE) AS o2 FROM g))"


@query(f"WITH {GEO}, {START}, {_carry('1', 'v', HERE, THERE)}, {_carry('2', 'out1', THERE, HERE)} "
       f"SELECT id % 10 AS label, {r('max(sqrt((v0 - o0) * (v0 - o0) + (v1 - o1) * (v1 - o1) + (v2 - o2) * (v2 - o2)))', 2)} AS gap, count(*) AS n FROM out2 GROUP BY 1")
def between_poses(spark, sf_dir):
    """Points carried from one pose to another and back; gap is the largest deviation by label."""
    g = geo_points(spark, sf_dir)
    k = F.col("id")
    here = (F.col("lat"), F.col("lon"), F.col("h"), F.col("lat") / 40, F.col("lat") / 80, F.col("lon"))
    there = (F.col("lat") + 1e-5, F.col("lon") - 1e-5, F.col("h") + 1, F.col("lat") / 50, F.col("lat") / 90, F.col("lon") + 5)
    v = ((k % 7).cast("double"), (k % 5 - 2).cast("double"), (k % 3).cast("double"))
    moved = geo.with_between_poses(g, v, here, there, ("m0", "m1", "m2"))
    back = geo.with_between_poses(moved, tuple(F.col(f"m{i}") for i in range(3)), there, here, ("b0", "b1", "b2"))
    gap = geo.norm3(*[F.col(f"b{i}") - c for i, c in enumerate(v)])
    return back.groupBy((k % 10).alias("label")).agg(F.max(F.bround(gap, 2)).alias("gap"), F.count("*").alias("n"))


@query(f"WITH {VEC}, {FRONT}, {FISH[len(FRONT) + 2:]} SELECT id, {r('f.a', 5)} AS x, {r('f.b', 5)} AS y FROM px JOIN f USING (id) WHERE f.a * f.a + f.b * f.b < 4")
def fisheye_undistort(spark, sf_dir):
    """Pixels back to normalised coordinates, where the rays are less than 63 degrees off the axis."""
    x, y, z = F.col("x"), F.col("y"), F.col("z") + 3
    v = vec(spark, sf_dir).where((z > 0) & ((x / z) * (x / z) + (y / z) * (y / z) < 4))
    ray = projection.undistorted(CAM)(F.col("u"), F.col("w"))
    return projection.with_fisheye(v, (x, y, z), ("u", "w"), CAM).select("id", ray.alias("ray")).select("id", *rounded({"x": F.col("ray.x"), "y": F.col("ray.y")}, 5))


@query(f"WITH {VEC} SELECT id, " + ", ".join(f"{r(' + '.join(f'({CAM.r_lidar_camera[j][i]!r}) * ({axis} - ({CAM.t_lidar_camera[j]!r}))' for j, axis in enumerate('xyz')))} AS c{i}" for i in range(3)) + " FROM vec")
def lidar_to_camera(spark, sf_dir):
    c = projection.lidar_to_camera((F.col("x"), F.col("y"), F.col("z")), CAM)
    return vec(spark, sf_dir).select("id", *rounded({f"c{i}": v for i, v in enumerate(c)}))


@query(f"WITH {VEC}, {FRONT}, m AS (SELECT vec.id AS id, x, y, z, 22.3 AS la0, 114.17 AS lo0 FROM vec), o AS (SELECT *, radians(la0) AS la, radians(lo0) AS lo, 6378137.0 / sqrt(1.0 - 6.69437999014e-3 * sin(radians(la0)) * sin(radians(la0))) AS n FROM m), "
       "c AS (SELECT id, (n + 10.0) * cos(la) * cos(lo) + (-sin(lo) * x + -sin(la) * cos(lo) * y + cos(la) * cos(lo) * z) AS x, (n + 10.0) * cos(la) * sin(lo) + (cos(lo) * x + -sin(la) * sin(lo) * y + cos(la) * sin(lo) * z) AS y, "
       f"(n * (1.0 - 6.69437999014e-3) + 10.0) * sin(la) + (0.0 * x + cos(la) * y + sin(la) * z) AS z FROM o), {STEPS} "
       f"SELECT id, {r('degrees(b)', 7)} AS lat, {r('degrees(atan2(y, x))', 7)} AS lon, {r('p / greatest(cos(b), 1e-12) - 6378137.0 / sqrt(1.0 - 6.69437999014e-3 * sin(b) * sin(b))', 3)} AS height FROM q6")
def filled_world(spark, sf_dir):
    """Local positions, as gap filling gives them, back to geodetic ones about the first pose."""
    poses = spark.createDataFrame([(0.0, 22.3, 114.17, 10.0)], "ts double, latitude_deg double, longitude_deg double, height_m double")
    local = vec(spark, sf_dir).select("id", F.col("x").alias("e"), F.col("y").alias("n"), F.col("z").alias("u"))
    out = flows.placed(local, poses)
    return out.select("id", *rounded({"lat": F.col("lat"), "lon": F.col("lon")}, 7), *rounded({"height": F.col("height")}, 3))


POSES = {n: f"CAST({e} AS DOUBLE)" for n, e in {
    "rx": "(c_custkey % 7 - 3) * 0.1", "ry": "(c_custkey % 11 - 5) * 0.1", "rz": "(c_custkey % 13 - 6) * 0.2",
    "tx": "(c_custkey % 5 - 2) * 0.3", "ty": "(c_custkey % 9 - 4) * 0.2", "tz": "2 + (c_custkey % 17) * 0.1"}.items()}


@query(f"SELECT c_custkey AS id, {_rounded_sql(POSES, 4)}, true AS fits FROM customer")
def marker_pose(spark, sf_dir):
    """Poses of markers from the corners that planted poses project."""
    planted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *[F.expr(e).alias(n) for n, e in POSES.items()])
    turn, shift = geo.rodrigues(F.col("rx"), F.col("ry"), F.col("rz")), (F.col("tx"), F.col("ty"), F.col("tz"))
    corners = []
    for corner in pose_of_markers.square(0.5).tolist():
        x, y, z = geo.rigid(turn, shift, tuple(map(F.lit, corner)))
        corners += [x / z, y / z]
    found = pose_of_markers.marker_poses(planted.select("id", F.array(*corners).alias("corners")), 0.5)
    return found.select("id", *rounded({n: F.col(n) for n in POSES}, 4), (F.col("error") < 1e-9).alias("fits"))
