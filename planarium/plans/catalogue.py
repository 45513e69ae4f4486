"""Registered queries over planar cells, with DuckDB SQL that computes the same another way.

Cells come from `part`, features from `embeddings`; every query reads its
whole table.  Floats are rounded on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planarium.functions import geometry as g
from planarium.functions import ramps
from planarium.operators import calibrate, cleanup, communities, estimators, graph, merging, metrics, mosaic, pairs, raster, refine, reports, ward
from planarium.operators import diagnostics as diag
from planarium.operators.quantiles import exact_quantiles
from planarium.sources import cells as source
from planarium.sources.store import written

#: Twice the largest circumradius is 7, so pairs within 8 hold all that overlap.
RADIUS, LOW, HIGH, LAMBDA = 8.0, 0.1, 0.4, 2.0
BOX = (10.0, 90.0, 10.0, 90.0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_parts(spark.read.parquet(f"{sf_dir}/part.parquet"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("cell_id", "label", (F.col("cell_id") % 3 == 0).alias("frozen"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage pairs; sums of them are rounded, never the fractions themselves, so that no sum lies on a tie."""
    return pairs.coverage_map(_cells(spark, sf_dir), RADIUS)


def _unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = lambda k: ((F.col("cell_id") * (k + 3)) % 17) / 4.0 + F.when(F.col("label") == k, 0.0).otherwise(1.5)
    return _cells(spark, sf_dir).select("cell_id", F.array(*(cost(k) for k in range(5))).alias("costs"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("int").alias("y"))


# SQL building blocks: cells, hexagon vertices, radius pairs, and overlap by
# collecting inner vertices and edge crossings and sorting them by angle.
CELLS = """
cells AS (
  SELECT p_partkey AS cell_id,
         CAST(p_partkey*37 % 1009 AS DOUBLE)/10 + 110*(CAST(floor(p_partkey/2000.0) AS INT) % 4) AS cx,
         CAST(p_partkey*91 % 997 AS DOUBLE)/10 + 110*CAST(floor(CAST(floor(p_partkey/2000.0) AS INT)/4.0) AS INT) AS cy,
         CAST(2.0 AS DOUBLE) + CAST(p_size % 7 AS DOUBLE)/4 AS r,
         CAST(p_partkey % 5 AS INT) AS label, p_partkey % 11 = 0 AS clipped, p_partkey % 3 = 0 AS frozen
  FROM part)"""
_V = """
v AS (SELECT cell_id, k, cx+r*cos(k*pi()/3) x, cy+r*sin(k*pi()/3) y, cx+r*cos((k+1)*pi()/3) x2, cy+r*sin((k+1)*pi()/3) y2
      FROM {cells}, range(0,6) t(k))"""
_OVERLAP = (
    _V
    + """,
p AS (SELECT a.cell_id i, b.cell_id j, 1.5*sqrt(3)*a.r*a.r aa, 1.5*sqrt(3)*b.r*b.r ab FROM {cells} a JOIN {cells} b ON a.cell_id<b.cell_id
      AND (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)<={r2}),
dirp AS (SELECT i,j,i s,j t FROM p UNION ALL SELECT i,j,j,i FROM p),
ins AS (SELECT d.i,d.j,a.x,a.y FROM dirp d JOIN v a ON a.cell_id=d.s JOIN v e ON e.cell_id=d.t
        GROUP BY d.i,d.j,d.s,a.k,a.x,a.y HAVING min((e.x2-e.x)*(a.y-e.y)-(e.y2-e.y)*(a.x-e.x))>=-1e-12),
cr0 AS (SELECT p.i,p.j,a.x ax,a.y ay,a.x2-a.x ux,a.y2-a.y uy,b.x-a.x wx,b.y-a.y wy,b.x2-b.x vx,b.y2-b.y vy
        FROM p JOIN v a ON a.cell_id=p.i JOIN v b ON b.cell_id=p.j),
cr AS (SELECT i,j,ax+ux*(wx*vy-wy*vx)/(ux*vy-uy*vx) x, ay+uy*(wx*vy-wy*vx)/(ux*vy-uy*vx) y FROM cr0
       WHERE abs(ux*vy-uy*vx)>1e-9 AND (wx*vy-wy*vx)/(ux*vy-uy*vx) BETWEEN 0 AND 1 AND (wx*uy-wy*ux)/(ux*vy-uy*vx) BETWEEN 0 AND 1),
pts AS (SELECT * FROM ins UNION ALL SELECT * FROM cr),
mid AS (SELECT *, avg(x) OVER w mx, avg(y) OVER w my FROM pts WINDOW w AS (PARTITION BY i,j)),
ring AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) nx, coalesce(lead(y) OVER w, first_value(y) OVER w) ny
         FROM mid WINDOW w AS (PARTITION BY i,j ORDER BY atan2(y-my,x-mx))),
shared AS (SELECT i,j,0.5*abs(sum((x-mx)*(ny-my)-(nx-mx)*(y-my))) AS s FROM ring GROUP BY i,j)"""
)
OK = "ok AS (SELECT * FROM cells WHERE NOT clipped)"
PAIRS = f"WITH {CELLS}, {OK}, {_OVERLAP.format(cells='ok', r2=RADIUS * RADIUS)},\ncf AS (SELECT p.i, p.j, s/least(aa,ab) AS cf FROM p JOIN shared USING (i, j) WHERE s/least(aa,ab) > 1e-9),\nlab AS (SELECT i, j, cf, a.label li, b.label lj, a.frozen fi, b.frozen fj FROM cf JOIN cells a ON a.cell_id = i JOIN cells b ON b.cell_id = j)"
RAMP = f"least(1.0, greatest(0.0, (cf - {LOW}) / ({HIGH} - {LOW})))"
NBRS = f",\nn0 AS (SELECT i, j, {RAMP} AS w FROM cf), nbrs AS (SELECT i, j, w FROM n0 WHERE w <> 0 UNION ALL SELECT j, i, w FROM n0 WHERE w <> 0)"
UNARY = ",\nunary AS (SELECT cell_id, k, ((cell_id * (k + 3)) % 17) / 4.0 + CASE WHEN label = k THEN 0.0 ELSE 1.5 END AS c FROM cells, range(0, 5) t(k))"
HEX = f"WITH {CELLS}, {_V.format(cells='cells')}"


@query(f"{HEX} SELECT cell_id, round(0.5*abs(sum(x*y2-x2*y)), 6) AS area, round(sum(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))), 6) AS perimeter, round(4*pi()*0.5*abs(sum(x*y2-x2*y))/pow(sum(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))), 2), 6) AS circularity FROM v GROUP BY cell_id")
def hull_features(spark, sf_dir):
    return _cells(spark, sf_dir).select("cell_id", g.hull_features(F.col("poly")).alias("h")).select("cell_id", *(F.round(f"h.{c}", 6).alias(c) for c in ("area", "perimeter", "circularity")))


@query(f"WITH {CELLS} SELECT cell_id, round(cx, 6) + 0.0 AS x, round(cy, 6) + 0.0 AS y, round(cx, 6) + 0.0 AS mx, round(cy, 6) + 0.0 AS my, round(2*sqrt(1.5*sqrt(3)*r*r/pi()), 6) AS diameter FROM cells")
def polygon_centers(spark, sf_dir):
    c, m = g.centroid(F.col("poly")), g.vertex_mean(F.col("poly"))
    return _cells(spark, sf_dir).select("cell_id", *((F.round(v, 6) + 0.0).alias(n) for n, v in (("x", c["x"]), ("y", c["y"]), ("mx", m["x"]), ("my", m["y"]))), F.round(g.equivalent_diameter(F.col("poly")), 6).alias("diameter"))


@query(f"{HEX} SELECT cell_id, round(1.5*sqrt(3)*r*r*1.21, 6) AS grown, 19.634954 AS fitted, (SELECT round(0.5*abs(sum(a*d-c*b)), 5) FROM (SELECT least(greatest(x,{BOX[0]}),{BOX[1]}) a, least(greatest(y,{BOX[2]}),{BOX[3]}) b, least(greatest(x2,{BOX[0]}),{BOX[1]}) c, least(greatest(y2,{BOX[2]}),{BOX[3]}) d FROM v WHERE v.cell_id = cells.cell_id)) AS clamped FROM cells")
def polygon_scaling(spark, sf_dir):
    p, x, y = F.col("poly"), F.col("cx"), F.col("cy")
    return _cells(spark, sf_dir).select("cell_id", F.round(g.area(g.scaled(p, x, y, F.lit(1.1))), 6).alias("grown"), F.round(g.area(g.scaled_to_diameter(p, x, y, F.lit(5.0))), 6).alias("fitted"), F.round(g.area(g.clamped(p, BOX)), 5).alias("clamped"))


_BOXED = f"""WITH {CELLS}, {_V.format(cells='cells')},
box AS (SELECT * FROM (VALUES ({BOX[0]},{BOX[2]},{BOX[1]},{BOX[2]}), ({BOX[1]},{BOX[2]},{BOX[1]},{BOX[3]}), ({BOX[1]},{BOX[3]},{BOX[0]},{BOX[3]}), ({BOX[0]},{BOX[3]},{BOX[0]},{BOX[2]})) t(x,y,x2,y2)),
pts AS (
  SELECT cell_id, x, y FROM v WHERE x BETWEEN {BOX[0]} AND {BOX[1]} AND y BETWEEN {BOX[2]} AND {BOX[3]}
  UNION ALL SELECT v.cell_id, b.x, b.y FROM box b, v GROUP BY v.cell_id, b.x, b.y HAVING min((v.x2-v.x)*(b.y-v.y)-(v.y2-v.y)*(b.x-v.x)) >= 0
  UNION ALL SELECT cell_id, ax+ux*t, ay+uy*t FROM (
    SELECT cell_id, ax, ay, ux, uy, (wx*vy-wy*vx)/(ux*vy-uy*vx) t, (wx*uy-wy*ux)/(ux*vy-uy*vx) q FROM (
      SELECT v.cell_id, v.x ax, v.y ay, v.x2-v.x ux, v.y2-v.y uy, b.x-v.x wx, b.y-v.y wy, b.x2-b.x vx, b.y2-b.y vy FROM v, box b) WHERE abs(ux*vy-uy*vx) > 1e-9) WHERE t BETWEEN 0 AND 1 AND q BETWEEN 0 AND 1),
m AS (SELECT *, avg(x) OVER w mx, avg(y) OVER w my FROM pts WINDOW w AS (PARTITION BY cell_id)),
o AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) nx, coalesce(lead(y) OVER w, first_value(y) OVER w) ny FROM m WINDOW w AS (PARTITION BY cell_id ORDER BY atan2(y-my,x-mx)))
SELECT cell_id, round(0.5*abs(sum((x-mx)*(ny-my)-(nx-mx)*(y-my))), 4) + 0.0 AS area FROM o GROUP BY cell_id HAVING 0.5*abs(sum((x-mx)*(ny-my)-(nx-mx)*(y-my))) > 1e-6"""


@query(_BOXED)
def polygon_clip_box(spark, sf_dir):
    a = g.area(g.clipped_to_box(F.col("poly"), BOX))
    return _cells(spark, sf_dir).select("cell_id", a.alias("a")).where("a > 1e-6").select("cell_id", (F.round("a", 4) + 0.0).alias("area"))


_D2 = "(a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)"


@query(f"WITH {CELLS} SELECT a.cell_id AS i, b.cell_id AS j, round(sqrt({_D2}), 6) AS d FROM cells a JOIN cells b ON a.cell_id < b.cell_id AND {_D2} <= {RADIUS * RADIUS}")
def spatial_pairs(spark, sf_dir):
    return pairs.spatial_pairs(_cells(spark, sf_dir), RADIUS).select("i", "j", F.round("d", 6).alias("d"))


@query(f"WITH {CELLS}, {OK} SELECT a.cell_id AS i, b.cell_id AS j, round(1 - sqrt({_D2})/{RADIUS}, 6) AS score FROM ok a JOIN ok b ON a.cell_id < b.cell_id AND sqrt({_D2}) < {RADIUS}")
def proximity_map(spark, sf_dir):
    return pairs.proximity_map(_cells(spark, sf_dir), RADIUS).select("i", "j", F.round("score", 6).alias("score"))


@query(f"{PAIRS} SELECT i, j, round(cf, 5) AS cf FROM cf")
def coverage_fraction_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("i", "j", F.round("cf", 5).alias("cf"))


@query(f"WITH {CELLS}, {_OVERLAP.format(cells='cells', r2=64.0)} SELECT p.i, p.j, round(s/(aa+ab-s), 5) AS iou FROM p JOIN shared USING (i, j) WHERE s/(aa+ab-s) > 1e-9")
def iou_pairs(spark, sf_dir):
    return pairs.iou_pairs(_cells(spark, sf_dir)).select("i", "j", F.round("iou", 5).alias("iou"))


@query(f"{PAIRS} SELECT i, j, round(cf, 5) AS cf FROM cf")
def coverage_turned_rings(spark, sf_dir):
    """Every other ring runs clockwise, and every third repeats its first vertex."""
    p = F.when(F.col("cell_id") % 2 == 0, F.reverse("poly")).otherwise(F.col("poly"))
    cells = _cells(spark, sf_dir).withColumn("poly", p).withColumn("poly", F.when(F.col("cell_id") % 3 == 0, F.concat("poly", F.slice("poly", 1, 1))).otherwise(F.col("poly")))
    return pairs.coverage_map(cells, RADIUS).select("i", "j", F.round("cf", 5).alias("cf"))


def _angles(spark, sf_dir):
    """Cells shaped like an L, every other one clockwise."""
    x, y, r = F.col("cx"), F.col("cy"), 2.013 + (F.col("cell_id") % 7).cast("double") / 4
    ring = F.array(*(g.point(x + a * r, y + b * r) for a, b in ((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))))
    return _cells(spark, sf_dir).withColumn("poly", F.when(F.col("cell_id") % 2 == 0, F.reverse(ring)).otherwise(ring))


_PART = "SELECT cell_id, cx AS x0, cy AS y0, cx + {0} * w AS x1, cy + w AS y1, w FROM l UNION ALL SELECT cell_id, cx, cy + w, cx + w, cy + 2 * w, w FROM l"


@query(f"""WITH {CELLS}, l AS (SELECT cell_id, cx, cy, 2.013 + CAST(cell_id % 7 AS DOUBLE)/4 AS w FROM cells), q AS ({_PART.format(2)}),
o AS (SELECT a.cell_id i, b.cell_id j, any_value(a.w) wa, any_value(b.w) wb, sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS s
  FROM q a JOIN q b ON a.cell_id < b.cell_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY a.cell_id, b.cell_id)
SELECT i, j, round(s / (3*wa*wa + 3*wb*wb - s), 5) AS iou FROM o WHERE s / (3*wa*wa + 3*wb*wb - s) > 1e-6""")
def iou_concave(spark, sf_dir):
    return pairs.iou_pairs(_angles(spark, sf_dir), least=1e-6).select("i", "j", F.round("iou", 5).alias("iou"))


@query(f"""WITH {CELLS}, q AS (SELECT cell_id, cx AS x, cy AS y, pow(2.0, cell_id % 8) / 8 + 0.01 AS s FROM cells),
o AS (SELECT a.cell_id i, b.cell_id j, a.s sa, b.s sb, (least(a.x + a.s, b.x + b.s) - greatest(a.x, b.x)) * (least(a.y + a.s, b.y + b.s) - greatest(a.y, b.y)) AS s
  FROM q a JOIN q b ON a.cell_id < b.cell_id AND a.x < b.x + b.s AND b.x < a.x + a.s AND a.y < b.y + b.s AND b.y < a.y + a.s)
SELECT i, j, round(s / (sa*sa + sb*sb - s), 5) AS iou FROM o WHERE s / (sa*sa + sb*sb - s) > 1e-6""")
def iou_mixed_sizes(spark, sf_dir):
    """Squares whose sides differ by up to 128 times; no radius says how far to look."""
    x, y, r = F.col("cx"), F.col("cy"), F.pow(F.lit(2.0), F.col("cell_id") % 8) / 8 + 0.01
    cells = _cells(spark, sf_dir).withColumn("poly", F.array(*(g.point(x + a * r, y + b * r) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)))))
    return pairs.iou_pairs(cells, least=1e-6).select("i", "j", F.round("iou", 5).alias("iou"))


@query(f"""WITH {CELLS}, {_OVERLAP.format(cells='cells', r2=64.0)}, e AS (SELECT p.i, p.j, s/(aa+ab-s) iou FROM p JOIN shared USING (i, j) JOIN cells a ON a.cell_id = p.i JOIN cells b ON b.cell_id = p.j WHERE a.label = b.label AND s/(aa+ab-s) > 1e-9)
SELECT i AS cell_id, round(max(iou), 5) AS max_iou, max(iou) > 0.05 AS violates FROM (SELECT i, iou FROM e UNION ALL SELECT j, iou FROM e) GROUP BY i""")
def max_iou_in_group(spark, sf_dir):
    """The largest overlap of each cell with one of its own label, and whether it exceeds 5 %."""
    same = calibrate.labelled(pairs.iou_pairs(_cells(spark, sf_dir)), _labels(spark, sf_dir)).where("label_i = label_j").select("i", "j", "iou")
    return graph.both_ways(same).groupBy(F.col("i").alias("cell_id")).agg(F.round(F.max("iou"), 5).alias("max_iou"), (F.max("iou") > 0.05).alias("violates"))


@query(f"""{PAIRS}, s AS (SELECT i, j, cf, 0.1 AS lo FROM cf)
SELECT i, j, round(least(1.0, greatest(0.0, (cf-lo)/0.3)), 6) AS plain, round(CASE WHEN cf < lo THEN (cf-lo)/lo ELSE least(1.0, greatest(0.0, (cf-lo)/0.3)) END, 6) AS signed,
 round(CASE WHEN least(cf, 0.99) <= lo THEN 0.0 ELSE least(1.0, ln(1+10*(least(cf, 0.99)-lo))/ln(1+10*(1-lo))) END, 6) AS logarithmic,
 round(CASE WHEN cf < lo THEN (cf-lo)/lo WHEN least(cf, 0.99) <= lo THEN 0.0 ELSE least(1.0, ln(1+10*(least(cf, 0.99)-lo))/ln(1+10*(1-lo))) END, 6) AS signed_log FROM s""")
def ramp_family(spark, sf_dir):
    cf = F.col("cf")
    return _pairs(spark, sf_dir).select("i", "j", *(F.round(f(cf, LOW, HIGH), 6).alias(n) for n, f in (("plain", ramps.ramp), ("signed", ramps.signed_ramp), ("logarithmic", ramps.log_ramp), ("signed_log", ramps.signed_log_ramp))))


@query(f"WITH {CELLS} SELECT a.cell_id, round(sqrt(min({_D2})), 6) AS nn_d FROM cells a JOIN cells b ON a.cell_id <> b.cell_id AND abs(a.cx-b.cx) < 60 AND abs(a.cy-b.cy) < 60 GROUP BY a.cell_id")
def nn_distance(spark, sf_dir):
    return pairs.nearest_distance(_cells(spark, sf_dir)).select("cell_id", F.round("nn_d", 6).alias("nn_d"))


@query(f"WITH {CELLS}, n AS (SELECT a.cell_id, any_value(a.label) label, sqrt(min({_D2})) d FROM cells a JOIN cells b ON a.cell_id <> b.cell_id AND a.label = b.label AND abs(a.cx-b.cx) < 110 AND abs(a.cy-b.cy) < 110 GROUP BY a.cell_id) SELECT label, count(*) AS n, round(stddev_pop(d)/avg(d), 5) AS cv, round(3*quantile_cont(d, 0.5), 5) AS radius FROM n GROUP BY label")
def nnd_regularity(spark, sf_dir):
    c = _cells(spark, sf_dir)
    near = exact_quantiles(pairs.nearest_distance(c, "label").join(c.select("cell_id", "label"), "cell_id"), "nn_d", [0.5], ["label"]).select("label", F.round(3 * F.col("q_0"), 5).alias("radius"))
    return calibrate.nnd_cv(c).join(near, "label").select("label", "n", F.round("cv", 5).alias("cv"), "radius")


_KNN = "e AS (SELECT vec_id id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings), d AS (SELECT a.id src, b.id dst, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1]-z[2])*(z[1]-z[2]))), 9) d2 FROM e a JOIN e b ON a.id <> b.id), k AS (SELECT src, dst, d2, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM d QUALIFY rank <= 10)"
_KW = f"{_KNN}, s AS (SELECT quantile_cont(sqrt(d2), 0.5) sg FROM k), w AS (SELECT src, dst, exp(-d2/(2*sg*sg)) w FROM k, s), gr AS (SELECT src, dst, max(w) w FROM (SELECT * FROM w UNION ALL SELECT dst, src, w FROM w) GROUP BY src, dst)"


@query(f"WITH {_KNN} SELECT src, dst, round(d2, 5) AS d2, CAST(rank AS INT) AS rank FROM k")
def knn_graph(spark, sf_dir):
    return pairs.knn(_points(spark, sf_dir), 10).select("src", "dst", F.round("d2", 5).alias("d2"), "rank")


@query(f"WITH {_KW} SELECT src, dst, round(w, 5) AS w FROM gr")
def knn_rbf_graph(spark, sf_dir):
    return graph.feature_graph(_points(spark, sf_dir), 10).select("src", "dst", F.round("w", 5).alias("w"))


@query(f"WITH {_KW}, x AS (SELECT a.label a, b.label b, sum(w) w FROM gr JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst GROUP BY 1, 2), st AS (SELECT a, sum(w) s FROM x GROUP BY a) SELECT CAST(x.a AS INT) a, CAST(x.b AS INT) b, round(x.w/sqrt(p.s*q.s), 5) AS weight FROM x JOIN st p ON p.a = x.a JOIN st q ON q.a = x.b WHERE x.a < x.b")
def paga_matrix(spark, sf_dir):
    p = _points(spark, sf_dir)
    return graph.paga(graph.feature_graph(p, 10), p.select("cell_id", F.col("y").alias("label"))).select("a", "b", F.round("weight", 5).alias("weight"))


_GRAPH = f"{PAIRS}, q AS (SELECT li label, count(*) n, quantile_cont(cf, 0.75) t FROM lab WHERE li = lj GROUP BY li), tau AS (SELECT cell_id, coalesce(CASE WHEN n >= 5 THEN t END, 0.05) tau FROM cells LEFT JOIN q USING (label))"


@query(f"{_GRAPH} SELECT cell_id, round(tau, 5) AS tau FROM tau")
def tau_low_per_cluster(spark, sf_dir):
    return calibrate.tau_low_per_cluster(_pairs(spark, sf_dir), _labels(spark, sf_dir)).select("cell_id", F.round("tau", 5).alias("tau"))


@query(f"""{_GRAPH}, gr AS (SELECT a.cell_id src, b.cell_id dst, 1 - sqrt({_D2})/{RADIUS} w FROM ok a JOIN ok b ON a.cell_id < b.cell_id AND sqrt({_D2}) < {RADIUS}),
x AS (SELECT src, dst, w, cf, (p.tau+q.tau)/2 t FROM gr JOIN tau p ON p.cell_id = src JOIN tau q ON q.cell_id = dst LEFT JOIN cf ON i = src AND j = dst),
y AS (SELECT *, CASE WHEN cf IS NULL THEN 0.0 WHEN 0.7 - t <= 0 THEN CAST(cf > t AS INT) ELSE least(1.0, greatest(0.0, (cf-t)/(0.7-t))) END rp FROM x)
SELECT src, dst, round(w*(1-rp), 5) AS scaled, round(greatest(0.0, w - 0.5*rp), 5) AS taken FROM y""")
def repulsion_graph(spark, sf_dir):
    """Proximity edges weakened by coverage, in both ways of weakening."""
    c, cf = pairs.proximity_map(_cells(spark, sf_dir), RADIUS).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("score").alias("w")), written(_pairs(spark, sf_dir), "pairs")
    tau = calibrate.tau_low_per_cluster(cf, _labels(spark, sf_dir))
    a, b = graph.repulsed(c, cf, tau, 0.7), graph.repulsed(c, cf, tau, 0.7, 0.5)
    return a.select("src", "dst", F.round("w", 5).alias("scaled")).join(b.select("src", "dst", F.round("w", 5).alias("taken")), ["src", "dst"])


@query(f"""{PAIRS}, s AS (SELECT count(*) FILTER (li=lj AND fi AND fj) a, count(*) FILTER (li=lj) b, count(*) FILTER (li<>lj AND fi AND fj) c, count(*) FILTER (li<>lj) d,
 quantile_cont(cf, 0.75) FILTER (li=lj AND fi AND fj) qa, quantile_cont(cf, 0.75) FILTER (li=lj) qb, quantile_cont(cf, 0.5) FILTER (li<>lj AND fi AND fj) qc, quantile_cont(cf, 0.5) FILTER (li<>lj) qd FROM lab),
t AS (SELECT CASE WHEN a >= 10 THEN qa WHEN b >= 10 THEN qb ELSE 0.1 END lo, CASE WHEN c >= 10 THEN qc WHEN d >= 10 THEN qd ELSE 0.4 END hi FROM s),
u AS (SELECT CASE WHEN lo >= hi - 0.05 THEN 0.1 ELSE lo END lo, CASE WHEN lo >= hi - 0.05 THEN 0.4 ELSE hi END hi FROM t), z AS (SELECT least(greatest(lo, 0.01), 0.49) lo, hi FROM u)
SELECT round(lo, 5) AS low, round(least(greatest(hi, lo + 0.05), 0.99), 5) AS high FROM z""")
def tau_calibration(spark, sf_dir):
    t = calibrate.calibrated(_pairs(spark, sf_dir), _labels(spark, sf_dir))
    return spark.createDataFrame([(round(t.low, 5), round(t.high, 5))], "low double, high double")


@query(f"{PAIRS}, b AS (SELECT i, j, cf, li, lj, fi, fj FROM lab UNION ALL SELECT j, i, cf, lj, li, fj, fi FROM lab) SELECT i AS cell_id, round(sum(least(1.0, (cf-{LOW})/{1 - LOW})), 5) AS push FROM b WHERE li = lj AND NOT fi AND fj AND cf > {LOW} GROUP BY i")
def label_push(spark, sf_dir):
    return calibrate.label_push(_pairs(spark, sf_dir), _labels(spark, sf_dir), LOW).select("cell_id", F.round("push", 5).alias("push"))


@query(f"{PAIRS} SELECT li AS label, count(*) AS n_violations, round(sum({RAMP}), 4) AS penalty FROM lab WHERE li = lj AND {RAMP} > 0 GROUP BY li")
def violation_count(spark, sf_dir):
    """Flagship: overlapping neighbours of one label, per label."""
    return refine.violations(_pairs(spark, sf_dir), _labels(spark, sf_dir), LOW, HIGH).select("label", "n_violations", F.round("penalty", 4).alias("penalty"))


@query(f"{PAIRS}{NBRS} SELECT i AS cell_id, round(sum(w), 4) AS conflict FROM nbrs JOIN cells a ON a.cell_id = i JOIN cells b ON b.cell_id = j WHERE a.label = b.label AND w > 0 GROUP BY i")
def conflict_scores(spark, sf_dir):
    return refine.conflict_scores(refine.neighbours(_pairs(spark, sf_dir), LOW, HIGH), _labels(spark, sf_dir)).select("cell_id", F.round("conflict", 4).alias("conflict"))


@query(f"{PAIRS}{NBRS} SELECT i AS cell_id, label, round(sum(w), 4) AS score FROM nbrs JOIN cells ON cell_id = j WHERE w > 0 GROUP BY i, label")
def label_scores(spark, sf_dir):
    return refine.label_scores(refine.neighbours(_pairs(spark, sf_dir), LOW, HIGH), _labels(spark, sf_dir)).select("cell_id", "label", F.round("score", 4).alias("score"))


@query(f"{PAIRS}{NBRS}{UNARY} SELECT round(u, 2) AS unary, round(p, 2) AS pairwise, round(u + p, 2) AS energy FROM (SELECT sum(c) u FROM unary JOIN cells USING (cell_id) WHERE k = label), (SELECT {LAMBDA}*sum(w) p FROM nbrs JOIN cells a ON a.cell_id = i JOIN cells b ON b.cell_id = j WHERE i < j AND a.label = b.label)")
def mrf_energy(spark, sf_dir):
    e = refine.energy(_labels(spark, sf_dir), _unary(spark, sf_dir), refine.neighbours(_pairs(spark, sf_dir), LOW, HIGH), LAMBDA)
    return e.select(*(F.round(c, 2).alias(c) for c in ("unary", "pairwise", "energy")))


@query(f"{PAIRS}{NBRS}{UNARY}, s AS (SELECT i AS cell_id, label AS k, sum(w) w FROM nbrs JOIN cells ON cell_id = j GROUP BY 1, 2), e AS (SELECT u.cell_id, u.k, round(c + {LAMBDA}*coalesce(w, 0), 9) e FROM unary u LEFT JOIN s USING (cell_id, k)), best AS (SELECT cell_id, k FROM e QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY e, k) = 1) SELECT cell_id, CAST(CASE WHEN frozen THEN label ELSE k END AS INT) AS label FROM cells JOIN best USING (cell_id)")
def icm_jacobi_sweep(spark, sf_dir):
    return refine.jacobi_sweep(_labels(spark, sf_dir), _unary(spark, sf_dir), refine.neighbours(_pairs(spark, sf_dir), LOW, HIGH), LAMBDA).select("cell_id", "label")


@query()
def icm_sequential(spark, sf_dir):
    """In-place sweeps to a fixpoint; the order of cells matters, so SQL can't express it."""
    return refine.icm_sequential(_labels(spark, sf_dir), _unary(spark, sf_dir), _nbrs(spark, sf_dir), LAMBDA).select("cell_id", "label")


@query(f"{PAIRS} SELECT least(li, lj) AS a, greatest(li, lj) AS b, count(*) AS n_pairs, count(*) FILTER (cf >= {HIGH}) AS n_high, count(*) FILTER (fi AND fj) AS frozen_pairs, count(*) FILTER (fi AND fj AND cf >= {HIGH}) AS frozen_high FROM lab WHERE li <> lj GROUP BY 1, 2")
def merge_gates(spark, sf_dir):
    return calibrate.merge_gates(_pairs(spark, sf_dir), _labels(spark, sf_dir), HIGH)


_DENSE = f"WITH RECURSIVE {CELLS}, e AS (SELECT a.cell_id i, b.cell_id j FROM cells a JOIN cells b ON a.cell_id <> b.cell_id AND a.label = b.label AND {_D2} <= 9), reach AS (SELECT cell_id, cell_id AS c FROM cells UNION SELECT e.j, reach.c FROM reach JOIN e ON e.i = reach.cell_id) SELECT cell_id, min(c) AS component FROM reach GROUP BY cell_id"


@query(_DENSE)
def split_components(spark, sf_dir):
    """Fragments of each label: cells of one label joined within three units."""
    c = _cells(spark, sf_dir)
    same = pairs.spatial_pairs(c, 3.0, keep=("label",)).where("label = label_j")
    return graph.components(c.select("cell_id"), same)


def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return d.join(l, "doc_id", "left").select((F.substring("source", 4, 9).cast("int") % 4).alias("y"), F.when(F.col("quality").isNull(), -1).otherwise(F.col("quality") * 2 + F.col("toxic")).cast("int").alias("label"))


_AGREE = "WITH t AS (SELECT CAST(substring(source, 4, 9) AS INT) % 4 AS y, CAST(CASE WHEN quality IS NULL THEN -1 ELSE quality*2+toxic END AS INT) AS label FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"{_AGREE} SELECT y, label, count(*) AS n FROM t WHERE label >= 0 GROUP BY y, label")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_agreement(spark, sf_dir))


@query(f"{_AGREE}, c AS (SELECT y, label, count(*) n FROM t WHERE label >= 0 GROUP BY 1, 2), s AS (SELECT sum(n*(n-1)/2.0) s, sum(n) t FROM c), a AS (SELECT sum(n*(n-1)/2.0) a FROM (SELECT sum(n) n FROM c GROUP BY y)), b AS (SELECT sum(n*(n-1)/2.0) b FROM (SELECT sum(n) n FROM c GROUP BY label)) SELECT round((s - a*b/(t*(t-1)/2.0))/((a+b)/2 - a*b/(t*(t-1)/2.0)), 6) AS ari FROM s, a, b")
def adjusted_rand_index(spark, sf_dir):
    return metrics.adjusted_rand(_agreement(spark, sf_dir).where("label >= 0")).select(F.round("ari", 6).alias("ari"))


@query(f"{_AGREE}, c AS (SELECT y, label, count(*) n FROM t WHERE label >= 0 GROUP BY 1, 2) SELECT label, arg_max(y, n*1000 - y) AS y, max(n) AS n, round(max(n)/sum(n), 6) AS share FROM c GROUP BY label")
def majority_labels(spark, sf_dir):
    return metrics.majority(_agreement(spark, sf_dir)).select("label", "y", "n", F.round("share", 6).alias("share"))


#: Width of a pixel; the grid spans all vertices, its origin on a multiple of the width.
PIXEL = 2.5


def _grid(cells: DataFrame) -> tuple[tuple[float, float, float, float], int, int]:
    """Bounds of the raster over all cells, and its numbers of columns and rows."""
    b = raster.extent(cells)
    x0, y0 = math.floor(b["x0"] / PIXEL) * PIXEL, math.floor(b["y0"] / PIXEL) * PIXEL
    columns, rows = max(1, math.ceil((b["x1"] - x0) / PIXEL)), max(1, math.ceil((b["y1"] - y0) / PIXEL))
    return (x0, x0 + columns * PIXEL, y0, y0 + rows * PIXEL), columns, rows


_GRID = f"{HEX}, b AS (SELECT floor(min(x)/{PIXEL})*{PIXEL} x0, floor(min(y)/{PIXEL})*{PIXEL} y0, max(x) x1, max(y) y1 FROM v), near AS (SELECT cell_id, CAST(rr AS INT) AS row, CAST(cc AS INT) AS col, x0+(cc+0.5)*{PIXEL} x, y0+(rr+0.5)*{PIXEL} y FROM cells, b, range(-2, 3) o(dx), range(-2, 3) q(dy), LATERAL (SELECT floor((cx-x0)/{PIXEL})+dx AS cc, floor((cy-y0)/{PIXEL})+dy AS rr) WHERE rr >= 0 AND cc >= 0), hit AS (SELECT n.row, n.col, n.cell_id FROM near n JOIN v USING (cell_id) GROUP BY 1, 2, 3 HAVING min((v.x2-v.x)*(n.y-v.y)-(v.y2-v.y)*(n.x-v.x)) >= -1e-12)"


@query(f"{_GRID} SELECT row, col, count(*) AS n FROM hit GROUP BY 1, 2")
def coverage_raster(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    bounds, columns, rows = _grid(cells)
    return raster.coverage_raster(cells, bounds, columns, rows)


_ANGLE_GRID = f"""WITH {CELLS}, l AS (SELECT cell_id, cx, cy, 2.013 + CAST(cell_id % 7 AS DOUBLE)/4 AS w FROM cells), b AS (SELECT floor(min(cx)/{PIXEL})*{PIXEL} x0, floor(min(cy)/{PIXEL})*{PIXEL} y0 FROM l),
near AS (SELECT l.*, CAST(floor((cx-x0)/{PIXEL})+dx AS INT) AS col, CAST(floor((cy-y0)/{PIXEL})+dy AS INT) AS row FROM l, b, range(-1, {math.ceil(7 / PIXEL) + 2}) o(dx), range(-1, {math.ceil(7 / PIXEL) + 2}) q(dy)),
pix AS (SELECT near.*, x0+(col+0.5)*{PIXEL} - cx AS x, y0+(row+0.5)*{PIXEL} - cy AS y FROM near, b)"""


@query(f"{_ANGLE_GRID} SELECT row, col, count(*) AS n FROM pix WHERE x BETWEEN 0 AND 2*w AND y BETWEEN 0 AND 2*w AND (x <= w OR y <= w) GROUP BY 1, 2")
def coverage_raster_concave(spark, sf_dir):
    cells = _angles(spark, sf_dir)
    bounds, columns, rows = _grid(cells)
    return raster.coverage_raster(cells, bounds, columns, rows)


@query(f"{_ANGLE_GRID} SELECT row, col, count(*) AS n FROM pix WHERE x BETWEEN 0 AND 2*w AND y BETWEEN 0 AND 2*w AND x + y <= 3*w GROUP BY 1, 2")
def hull_raster(spark, sf_dir):
    cells = _angles(spark, sf_dir)
    bounds, columns, rows = _grid(cells)
    return raster.hull_raster(cells, bounds, columns, rows)


@query(f"WITH rs AS ({ORACLE_SQL['coverage_raster']}), g AS (SELECT greatest(1, ceil((x1-x0)/{PIXEL})) * greatest(1, ceil((y1-y0)/{PIXEL})) AS pixels FROM ({_GRID} SELECT * FROM b)) SELECT max(n) AS most, round(avg(n), 5) AS mean, round(stddev_pop(n), 5) AS std, count(*) AS covered, round(count(*)/any_value(pixels), 6) AS share FROM rs, g")
def coverage_stats(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    bounds, columns, rows = _grid(cells)
    s = raster.coverage_stats(raster.coverage_raster(cells, bounds, columns, rows), columns, rows)
    return s.select("most", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "covered", F.round("share", 6).alias("share"))


@query("WITH g AS (SELECT event_type, user_id, value FROM events WHERE event_type IS NOT NULL), s AS (SELECT avg(value) m, stddev_pop(value) d FROM g) SELECT dense_rank() OVER (ORDER BY event_type) - 1 AS grp, count(*) AS n, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.95), 5) AS p95, round(avg((value - m)/d), 5) AS z FROM g, s GROUP BY event_type")
def group_quantiles(spark, sf_dir):
    """Groups encoded in sorted order, exact quantiles and standardised means."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type is not null")
    s = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d")).first()
    names = e.select("event_type").distinct().select("event_type", (F.dense_rank().over(Window.orderBy("event_type")) - 1).cast("long").alias("grp"))  # of the few distinct names
    means = e.groupBy("event_type").agg(F.round(F.avg((F.col("value") - s["m"]) / s["d"]), 5).alias("z"))
    q = exact_quantiles(e, "value", [0.5, 0.95], ["event_type"]).select("event_type", "n", F.round("q_0", 5).alias("median"), F.round("q_1", 5).alias("p95"))
    return q.join(means, "event_type").join(names, "event_type").select("grp", "n", "median", "p95", "z")


# --- calibration, diagnostics and merging over the same cells

_BOTH = ", both_ AS (SELECT i, j, cf, li, lj, fi, fj FROM lab UNION ALL SELECT j, i, cf, lj, li, fj, fi FROM lab)"
_ENERGY = f"{PAIRS}{NBRS}{UNARY}, s AS (SELECT i AS cell_id, label AS k, sum(w) w FROM nbrs JOIN cells ON cell_id = j GROUP BY 1, 2), en AS (SELECT u.cell_id, u.k, c + {LAMBDA}*coalesce(w, 0) AS e FROM unary u LEFT JOIN s USING (cell_id, k))"
_POST = f"WITH {CELLS}{UNARY}, low AS (SELECT cell_id, min(c) m FROM unary GROUP BY cell_id), ex AS (SELECT u.cell_id, k, exp(m - c) x FROM unary u JOIN low USING (cell_id)), po AS (SELECT cell_id, k, x / sum(x) OVER (PARTITION BY cell_id) AS p FROM ex)"


def _nbrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(refine.neighbours(_pairs(spark, sf_dir), LOW, HIGH), "nbrs")


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second labeling of the cells."""
    return _cells(spark, sf_dir).select("cell_id", F.when(F.col("cell_id") % 7 == 0, (F.col("label") + 1) % 5).otherwise(F.col("label")).cast("int").alias("y"))


_TRUTH = ", truth AS (SELECT cell_id, CASE WHEN cell_id % 7 = 0 THEN (label + 1) % 5 ELSE label END AS y FROM cells)"


@query(f"{PAIRS}{_BOTH} SELECT i AS cell_id, arg_max(j, (round(cf, 9), -j)) AS neighbour, round(max(cf), 6) AS cf FROM both_ GROUP BY i")
def top_neighbour(spark, sf_dir):
    return diag.top_neighbour(_pairs(spark, sf_dir).withColumn("cf", F.round("cf", 9))).select("cell_id", "neighbour", F.round("cf", 6).alias("cf"))


@query(f"{PAIRS}{_BOTH}, t AS (SELECT i, arg_max(li = lj, (cf, -j)) AS same, any_value(fi) AS f FROM both_ GROUP BY i) SELECT count(*) AS n, round(avg(CAST(same AS INT)), 6) AS consistency FROM t WHERE f")
def quality_gate(spark, sf_dir):
    return diag.quality(_pairs(spark, sf_dir), _labels(spark, sf_dir)).select("n", F.round("consistency", 6).alias("consistency"))


@query(f"{PAIRS} SELECT li AS label, count(*) AS n, round(least(greatest(quantile_cont(cf, 0.75), 0.01), 0.49), 5) AS tau FROM lab WHERE li = lj GROUP BY li HAVING count(*) >= 2")
def tau_of_frozen(spark, sf_dir):
    return calibrate.tau_of_frozen(_pairs(spark, sf_dir), _labels(spark, sf_dir).withColumn("frozen", F.lit(True)), least_pairs=2).select("label", "n", F.round("tau", 5).alias("tau"))


@query(f"""{PAIRS}{UNARY}{_BOTH}, r AS (SELECT cell_id, c, row_number() OVER (PARTITION BY cell_id ORDER BY c) rn FROM unary JOIN (SELECT cell_id FROM cells WHERE NOT frozen) USING (cell_id)),
g AS (SELECT count(*) n_free, quantile_cont(d, 0.5) gap FROM (SELECT cell_id, max(c) FILTER (rn = 2) - max(c) FILTER (rn = 1) d FROM r GROUP BY cell_id)),
pu AS (SELECT i, sum(least(1.0, (cf-{LOW})/{1 - LOW})) p FROM both_ WHERE li = lj AND NOT fi AND fj AND cf > {LOW} GROUP BY i), q AS (SELECT count(*) n_pushed, quantile_cont(p, 0.5) push FROM pu),
an AS (SELECT count(*) n_anchors, coalesce(avg(CAST(cf > {LOW} AS INT)), 0.0) broken FROM lab WHERE li = lj AND fi AND fj)
SELECT round(CASE WHEN n_free >= 10 AND n_anchors >= 10 AND broken <= 0.9 AND n_pushed >= 10 AND gap > 0 THEN gap/push END, 4) AS lam, round(gap, 6) AS gap, round(push, 5) AS push, n_free, n_pushed, n_anchors, round(broken, 6) AS broken FROM g, q, an""")
def penalty_weight(spark, sf_dir):
    p = calibrate.penalty_weight(written(_pairs(spark, sf_dir), "pairs"), _labels(spark, sf_dir), _unary(spark, sf_dir), LOW, most_broken=0.9)
    return p.select(F.round("lam", 4).alias("lam"), F.round("gap", 6).alias("gap"), F.round("push", 5).alias("push"), "n_free", "n_pushed", "n_anchors", F.round("broken", 6).alias("broken"))


@query()
def mixture_threshold(spark, sf_dir):
    """The lower of two components of the coverage fractions; fitted in rounds, so not in SQL."""
    t = calibrate.mixture_threshold(written(_pairs(spark, sf_dir), "pairs"))
    return spark.createDataFrame([(t,)], "tau double")


@query(f"{_POST} SELECT cell_id, CAST(arg_max(k, (p, -k)) AS INT) AS label, round(max(p), 6) AS posterior, max(p) >= 0.5 AS frozen FROM po GROUP BY cell_id")
def frozen_cells(spark, sf_dir):
    return diag.frozen_by_posterior(_unary(spark, sf_dir), 0.5).select("cell_id", "label", F.round("posterior", 6).alias("posterior"), "frozen")


@query(f"{_ENERGY}, r AS (SELECT cell_id, e, row_number() OVER (PARTITION BY cell_id ORDER BY e) rn FROM en) SELECT cell_id, round(max(e) FILTER (rn = 2) - max(e) FILTER (rn = 1), 5) + 0.0 AS gap FROM r GROUP BY cell_id")
def energy_gaps(spark, sf_dir):
    return diag.energy_gaps(_labels(spark, sf_dir), _unary(spark, sf_dir), _nbrs(spark, sf_dir), LAMBDA).select("cell_id", (F.round("gap", 5) + 0.0).alias("gap"))


@query(f"{PAIRS}{NBRS}, c AS (SELECT i AS cell_id, label, count(*) n FROM nbrs JOIN cells ON cell_id = j GROUP BY 1, 2) SELECT cell_id, label, n, round(n / sum(n) OVER (PARTITION BY cell_id), 6) AS share FROM c")
def neighbour_composition(spark, sf_dir):
    return diag.neighbour_shares(_nbrs(spark, sf_dir), _labels(spark, sf_dir)).select("cell_id", "label", "n", F.round("share", 6).alias("share"))


@query(f"WITH {CELLS}{_TRUTH} SELECT y, count(*) AS n, count(*) FILTER (label <> y) AS n_errors, round(count(*) FILTER (label <> y) / count(*), 6) AS share FROM cells JOIN truth USING (cell_id) GROUP BY y")
def error_counts(spark, sf_dir):
    return diag.error_counts(_labels(spark, sf_dir), _truth(spark, sf_dir)).select("y", "n", "n_errors", F.round("share", 6).alias("share"))


@query(f"""{PAIRS}{NBRS}{_TRUTH}, near AS (SELECT i, label AS k, w FROM nbrs JOIN cells ON cell_id = j WHERE w > 0),
z AS (SELECT c.cell_id, any_value(y) y, any_value(c.label) l, coalesce(sum(w) FILTER (k = c.label), 0.0) conflict, count(*) FILTER (k = c.label) n_same, count(*) FILTER (k = y) n_true, any_value(frozen) f FROM cells c JOIN truth USING (cell_id) LEFT JOIN near ON i = c.cell_id WHERE c.label <> y GROUP BY c.cell_id)
SELECT cell_id, CAST(y AS INT) AS y, l AS label, 0.5 AS posterior, round(conflict, 5) AS conflict, n_same, n_true, f AS frozen, CASE WHEN conflict = 0 THEN 'B' WHEN f THEN 'A frozen' ELSE 'A unfixed' END AS diagnosis FROM z""")
def error_summary(spark, sf_dir):
    sure = _labels(spark, sf_dir).select("cell_id", F.lit(0.5).alias("posterior"), "frozen")
    return diag.error_summary(_labels(spark, sf_dir), _truth(spark, sf_dir), _nbrs(spark, sf_dir), sure).withColumn("conflict", F.round("conflict", 5))


@query(f"""{PAIRS}{NBRS}{_TRUTH}, z AS (SELECT c.cell_id, coalesce(sum(w) FILTER (b.label = c.label), 0.0) conflict FROM cells c JOIN truth USING (cell_id) LEFT JOIN nbrs n ON n.i = c.cell_id LEFT JOIN cells b ON b.cell_id = n.j WHERE c.label <> y GROUP BY c.cell_id) SELECT cell_id, round(conflict, 5) AS conflict FROM z ORDER BY conflict DESC, cell_id DESC LIMIT 8""")
def worst_errors(spark, sf_dir):
    """The eight wrong cells with the strongest conflict: the limit is the report's."""
    sure = _labels(spark, sf_dir).select("cell_id", F.lit(0.5).alias("posterior"), "frozen")
    e = diag.error_summary(_labels(spark, sf_dir), _truth(spark, sf_dir), _nbrs(spark, sf_dir), sure)
    return diag.worst(e, F.col("conflict")).select("cell_id", F.round("conflict", 5).alias("conflict"))


@query(f"{PAIRS}{_TRUTH} SELECT p.y = q.y AS same, count(*) AS n, round(CASE WHEN p.y = q.y THEN quantile_cont(cf, 0.99) ELSE quantile_cont(cf, 0.25) END, 5) AS tau FROM cf JOIN truth p ON p.cell_id = i JOIN truth q ON q.cell_id = j GROUP BY p.y = q.y")
def empirical_thresholds(spark, sf_dir):
    return diag.empirical_thresholds(_pairs(spark, sf_dir), _truth(spark, sf_dir)).select("same", "n", F.round("tau", 5).alias("tau"))


@query(f"""{PAIRS}, o AS (SELECT i, j, cf, li = lj AS same, row_number() OVER (PARTITION BY li = lj ORDER BY cf, i, j) - 1 AS r, count(*) OVER (PARTITION BY li = lj) AS n FROM lab), w AS (SELECT * FROM (VALUES (true, 5.0), (true, 35.0), (true, 70.0), (true, 100.0), (false, 5.0), (false, 95.0)) t(same, pct))
SELECT same, CAST(pct AS DOUBLE) AS pct, round(cf, 5) AS cf FROM o JOIN w USING (same) WHERE r = CAST(round_even(pct / 100 * (n - 1), 0) AS BIGINT)""")
def pair_gallery(spark, sf_dir):
    return diag.gallery(written(_pairs(spark, sf_dir), "pairs"), _labels(spark, sf_dir)).select("same", "pct", F.round("cf", 5).alias("cf"))


@query(f"{PAIRS}, hard AS (SELECT i AS cell_id FROM lab WHERE li = lj AND cf > 0.85 UNION SELECT j FROM lab WHERE li = lj AND cf > 0.85) SELECT cell_id, label, frozen AND cell_id NOT IN (SELECT cell_id FROM hard) AS frozen FROM cells")
def hard_pair_release(spark, sf_dir):
    return diag.unfrozen_hard_pairs(_labels(spark, sf_dir), _pairs(spark, sf_dir), 0.85)


@query(f"{PAIRS} SELECT i, j, round(cf, 5) AS cf FROM lab WHERE li <> lj AND li // 2 = lj // 2 AND cf >= {HIGH}")
def merge_boundary(spark, sf_dir):
    """Pairs that are of one label once labels 0 and 1, and 2 and 3, are merged."""
    before = _labels(spark, sf_dir)
    return diag.boundary_pairs(_pairs(spark, sf_dir), before, merging.renamed(before, {1: 0, 3: 2}), HIGH).select("i", "j", F.round("cf", 5).alias("cf"))


@query(f"""{PAIRS}, tl AS (SELECT li AS label, least(greatest(quantile_cont(cf, 0.75), 0.01), 0.49) tau FROM lab WHERE li = lj GROUP BY li HAVING count(*) >= 2),
pl AS (SELECT i, j, cf, CASE WHEN li = lj THEN coalesce(tau, {LOW}) ELSE {LOW} END AS lo FROM lab LEFT JOIN tl ON tl.label = li),
wl AS (SELECT i, j, CASE WHEN cf < lo THEN (cf - lo)/lo WHEN 0.95 - lo <= 0 THEN CAST(cf > lo AS INT) ELSE least(1.0, greatest(0.0, (cf - lo)/(0.95 - lo))) END AS w FROM pl)
SELECT i, j, round(w, 4) AS w FROM wl WHERE abs(w) > 1e-9 UNION ALL SELECT j, i, round(w, 4) FROM wl WHERE abs(w) > 1e-9""")
def adjacency_per_cluster(spark, sf_dir):
    pairs_, labels = written(_pairs(spark, sf_dir), "pairs"), _labels(spark, sf_dir).withColumn("frozen", F.lit(True))
    return mosaic.adjacency(pairs_, labels, calibrate.tau_of_frozen(pairs_, labels, least_pairs=2), LOW, 0.95, ramps.choose(False, True)).where("abs(w) > 1e-9").select("i", "j", F.round("w", 4).alias("w"))


@query(f"WITH {CELLS}, e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(CAST(x AS DOUBLE)) m, count(*) n FROM e GROUP BY label, d) SELECT CAST(label AS INT) AS label, max(n) AS n, round(sum(m * d), 4) AS weighted, round(sqrt(sum(m*m)), 5) AS norm FROM m GROUP BY label")
def cluster_means(spark, sf_dir):
    p = _points(spark, sf_dir)
    m = estimators.cluster_means(p, p.select("cell_id", F.col("y").alias("label")))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return m.select("label", "n", F.round(total(F.transform("mean", lambda x, i: x * (i + 1))), 4).alias("weighted"), F.round(F.sqrt(total(F.transform("mean", lambda x: x * x))), 5).alias("norm"))


@query("WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(CAST(x AS DOUBLE)) m, count(*) n FROM e GROUP BY label, d) SELECT CAST(p.label AS INT) AS a, CAST(q.label AS INT) AS b, round(max(p.n)*max(q.n)/(max(p.n)+max(q.n))*sum((p.m-q.m)*(p.m-q.m)), 4) AS delta FROM m p JOIN m q ON p.d = q.d AND p.label < q.label GROUP BY p.label, q.label")
def ward_deltas(spark, sf_dir):
    p = _points(spark, sf_dir)
    return estimators.ward_deltas(estimators.cluster_means(p, p.select("cell_id", F.col("y").alias("label")))).select("a", "b", F.round("delta", 4).alias("delta"))


@query(f"{PAIRS}, z AS (SELECT label, count(*) n FROM cells GROUP BY label), vo AS (SELECT least(li, lj) a, greatest(li, lj) b, sum({RAMP}) s FROM lab WHERE li <> lj GROUP BY 1, 2) SELECT a, b, round(s/(p.n*q.n), 8) AS v FROM vo JOIN z p ON p.label = a JOIN z q ON q.label = b")
def cross_overlap(spark, sf_dir):
    return merging.cross_overlap(_pairs(spark, sf_dir), _labels(spark, sf_dir), LOW, HIGH).select("a", "b", F.round("v", 8).alias("v"))


@query(f"WITH {CELLS}, z AS (SELECT label, count(*) n FROM cells GROUP BY label) SELECT k AS label, 0.01 * pow(coalesce(n, 0) - (SELECT count(*) FROM cells)/5.0, 2) AS cost FROM (SELECT CAST(range AS INT) AS k FROM range(0, 5)) LEFT JOIN z ON label = k")
def count_costs(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(merging.count_costs(_labels(spark, sf_dir), 0.01, 5))), "label int, cost double")


_CV = f"WITH {CELLS}, n AS (SELECT g, cell_id, min(d) d FROM (SELECT CASE WHEN a.label = b.label THEN a.label ELSE -1 END g, a.cell_id, sqrt({_D2}) d FROM cells a JOIN cells b ON a.cell_id <> b.cell_id AND (a.label = b.label OR (a.label < 2 AND b.label < 2)) AND abs(a.cx-b.cx) < 110 AND abs(a.cy-b.cy) < 110 WHERE a.label < 2) GROUP BY g, cell_id), u AS (SELECT cell_id, min(d) d FROM n GROUP BY cell_id), cv AS (SELECT g, stddev_pop(d)/avg(d) cv FROM n WHERE g >= 0 GROUP BY g)"


@query(f"{_CV} SELECT 0 AS a, 1 AS b, round((SELECT sum(cv) FROM cv) - 2 * (SELECT stddev_pop(d)/avg(d) FROM u), 5) AS gain")
def regularity_gain(spark, sf_dir):
    got = merging.regularity_gains(_cells(spark, sf_dir), _labels(spark, sf_dir), [(0, 1)])
    return spark.createDataFrame([(a, b, round(g, 5)) for (a, b), g in got.items()], "a int, b int, gain double")


@query(f"WITH {CELLS}{UNARY} SELECT cell_id, round(-ln(sum(exp(-c)) FILTER (k IN (0, 3))), 6) + 0.0 AS first, round(-ln(sum(exp(-c)) FILTER (k IN (1, 2, 4))), 6) + 0.0 AS second FROM unary GROUP BY cell_id")
def mixed_unary(spark, sf_dir):
    u = merging.mixed_unary(_unary(spark, sf_dir), [[0, 3], [1, 2, 4]])
    return u.select("cell_id", (F.round(F.get("costs", F.lit(0)), 6) + 0.0).alias("first"), (F.round(F.get("costs", F.lit(1)), 6) + 0.0).alias("second"))


@query(f"{HEX} SELECT CAST(label AS INT) AS label, round(min(x), 6) + 0.0 AS x0, round(max(x), 6) + 0.0 AS x1, round(min(y), 6) + 0.0 AS y0, round(max(y), 6) + 0.0 AS y1 FROM v JOIN cells USING (cell_id) GROUP BY label")
def extents(spark, sf_dir):
    return diag.extents(_cells(spark, sf_dir), "label").select("label", *((F.round(c, 6) + 0.0).alias(c) for c in ("x0", "x1", "y0", "y1")))


@query(f"WITH {CELLS}, {_V.format(cells='cells')} SELECT cell_id, count(*) FILTER (x < {BOX[0]} OR x > {BOX[1]} OR y < {BOX[2]} OR y > {BOX[3]}) > 0 AS crosses FROM v JOIN cells USING (cell_id) WHERE cx BETWEEN {BOX[0]} AND {BOX[1]} AND cy BETWEEN {BOX[2]} AND {BOX[3]} GROUP BY cell_id")
def kept_cells(spark, sf_dir):
    """Cells whose centre lies in the box and of which something is left there, and whether the box cuts them."""
    c = _cells(spark, sf_dir).where(g.kept_in_box(F.col("poly"), F.col("cx"), F.col("cy"), BOX))
    return c.select("cell_id", g.crosses_box(F.col("poly"), BOX).alias("crosses"))


@query("WITH p AS (SELECT CAST(p_partkey * 37 % 101 AS DOUBLE) x, CAST(p_partkey * 91 % 103 AS DOUBLE) y, CAST(p_size AS INT) g FROM part), f AS (SELECT p.*, count(*) OVER (PARTITION BY g) n FROM p) SELECT g, max(n) AS n, max(x) AS x1, min(x) AS x0 FROM f WHERE n >= 3 GROUP BY g")
def point_hulls(spark, sf_dir):
    """Convex hulls of groups of points; their extents are those of the points."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    p = part.select((F.col("p_partkey") * 37 % 101).cast("double").alias("x"), (F.col("p_partkey") * 91 % 103).cast("double").alias("y"), F.col("p_size").cast("int").alias("g"))
    hulls = p.groupBy("g").agg(F.count("*").alias("n"), F.collect_set(g.point(F.col("x"), F.col("y"))).alias("ps")).where("n >= 3").select("g", "n", g.convex_hull(F.col("ps")).alias("h"))
    return hulls.select("g", "n", F.array_max(F.transform("h", lambda p: p["x"])).alias("x1"), F.array_min(F.transform("h", lambda p: p["x"])).alias("x0"))


@query(f"WITH {CELLS} SELECT CAST(label AS INT) AS y, CAST(4 - label AS INT) AS label, count(*) AS n FROM cells GROUP BY label")
def relabelled(spark, sf_dir):
    """Labels named for the best agreement with another labeling: here they are that labeling in reverse."""
    rows = _cells(spark, sf_dir).select(F.col("label").alias("y"), (4 - F.col("label")).cast("int").alias("label"), (4 - F.col("label")).cast("int").alias("was"))
    return metrics.relabelled(rows).where("label = y").groupBy("y", F.col("was").alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {CELLS} SELECT count(*) AS cells, 0 AS improving, TRUE AS lower FROM cells")
def settled_sweeps(spark, sf_dir):
    """Synchronous sweeps brought to rest: no free cell would gain by another label, and the energy isn't above that of the start."""
    labels, unary, nbrs = written(_labels(spark, sf_dir), "labels"), written(_unary(spark, sf_dir), "unary"), written(_nbrs(spark, sf_dir), "nbrs")
    got = refine.icm_settled(labels, unary, nbrs, LAMBDA, 200)
    value = lambda x, name: refine.energy(x, unary, nbrs, LAMBDA).select(F.col("energy").alias(name))
    open_ = refine.wishes(got, unary, nbrs, LAMBDA).agg(F.count("*").alias("cells"), F.count_if(F.col("wish") != F.col("label")).alias("improving"))
    return open_.join(value(labels, "a"), F.lit(True)).join(value(got, "b"), F.lit(True)).select("cells", "improving", F.expr("b <= a").alias("lower"))  # one row each


_STAGES = {"whole": "label", "a_third_off": "CASE WHEN cell_id % 3 = 0 THEN (label + 1) % 5 ELSE label END", "some_open": "CASE WHEN cell_id % 7 = 0 THEN -1 ELSE label END", "two_as_one": "CASE WHEN label = 3 THEN 2 ELSE label END"}


@query(f"""WITH {CELLS}, s AS ({" UNION ALL ".join(f"SELECT {i} AS step, '{n}' AS stage, cell_id, label AS y, CAST({x} AS INT) AS label FROM cells" for i, (n, x) in enumerate(_STAGES.items()))}),
k AS (SELECT step, y, label, count(*) AS n FROM s WHERE label >= 0 GROUP BY ALL), two AS (SELECT step, sum(n * (n - 1) / 2.0) AS c, sum(n) * (sum(n) - 1) / 2.0 AS t FROM k GROUP BY step),
a AS (SELECT step, sum(n * (n - 1) / 2.0) AS a FROM (SELECT step, y, sum(n) AS n FROM k GROUP BY ALL) GROUP BY step), b AS (SELECT step, sum(n * (n - 1) / 2.0) AS b FROM (SELECT step, label, sum(n) AS n FROM k GROUP BY ALL) GROUP BY step),
r AS (SELECT step, (c - a * b / t) / ((a + b) / 2 - a * b / t) AS ari FROM two JOIN a USING (step) JOIN b USING (step)),
two_one AS (SELECT CASE WHEN count(*) FILTER (label = 3) > count(*) FILTER (label = 2) THEN 3 ELSE 2 END AS kept FROM cells)
SELECT step, stage, count(*) AS cells, count(DISTINCT label) FILTER (label >= 0) AS clusters, count(*) FILTER (label < 0) AS unlabelled,
    count(*) FILTER (label >= 0 AND y <> CASE WHEN stage = 'two_as_one' AND label = 2 THEN (SELECT kept FROM two_one) ELSE label END) AS errors, round(any_value(ari), 6) AS ari
FROM s JOIN r USING (step) GROUP BY step, stage""")
def stage_trace(spark, sf_dir):
    """Agreement and errors of four labelings of all cells with the cells' labels, as for the stages of a fit."""
    cells = _cells(spark, sf_dir)
    stages = [(n, cells.select("cell_id", F.expr(x).cast("int").alias("label"))) for n, x in _STAGES.items()]
    return reports.stage_trace(stages, cells.select("cell_id", F.col("label").alias("y"))).withColumn("ari", F.round("ari", 6))


@query()
def conflict_resolution(spark, sf_dir):
    """Joint moves of overlapping pairs of one label, in rounds."""
    return cleanup.resolve_conflicts(_labels(spark, sf_dir), _unary(spark, sf_dir), _nbrs(spark, sf_dir), LAMBDA)[0].select("cell_id", "label")


@query()
def residual_violators(spark, sf_dir):
    """Cells that still overlap fellows, moved or unlabelled, in rounds."""
    return cleanup.clear_residuals(_labels(spark, sf_dir), _unary(spark, sf_dir), _nbrs(spark, sf_dir))[0].select("cell_id", "label")


@query()
def merged_to_k(spark, sf_dir):
    """Clusters of embeddings merged to four by gated linkage over the coverage of the cells of the same ids."""
    p = _points(spark, sf_dir)
    labels = p.select("cell_id", F.col("y").alias("label"), (F.col("cell_id") % 3 == 0).alias("frozen"))
    return merging.merge_to_k(labels, p, written(_pairs(spark, sf_dir), "pairs"), HIGH, 4)[0].select("cell_id", "label")


@query()
def fragment_split(spark, sf_dir):
    return merging.split_fragmented(_cells(spark, sf_dir), _labels(spark, sf_dir))[0].select("cell_id", "label")


@query()
def kmeans_labels(spark, sf_dir):
    return estimators.kmeans(_points(spark, sf_dir), 10)


@query()
def mixture_labels(spark, sf_dir):
    """Likeliest components of a mixture with diagonal covariances, started from k-means."""
    p = written(_points(spark, sf_dir).select("cell_id", "features"), "points")
    m = estimators.fit_mixture(p, estimators.initial_means(p, 10), "diag", rounds=10)
    return diag.frozen_by_posterior(estimators.mixture_unary(p, m), 0.9).select("cell_id", "label", "frozen")


@query()
def mosaic_fit(spark, sf_dir):
    """The whole strategy over the cells, with the embedding of each cell's label and a little of another as features."""
    e = _points(spark, sf_dir).groupBy("y").agg(F.min_by("features", "cell_id").alias("f")).select("y", F.slice("f", 1, 4).alias("f"))
    shift = F.array(*(((F.col("cell_id") * (k + 3)) % 11 - 5) / 25.0 for k in range(4)))
    cells = _cells(spark, sf_dir).join(e, F.col("label") == F.col("y")).select("cell_id", "cx", "cy", "clipped", "poly", F.zip_with("f", shift, lambda a, b: a + b).alias("features"))
    return mosaic.MosaicStrategy(5, radius=RADIUS, refits=0, cleanups=1).fit(written(cells, "cells")).labels.select("cell_id", "label")


@query("SELECT count(*) AS cells, 0 AS disconnected, 0 AS improving FROM embeddings")
def leiden_communities(spark, sf_dir):
    """Communities of the graph of embeddings: none falls apart, and no single one would gain by a move."""
    points = written(_points(spark, sf_dir).select("cell_id", "features"), "points")
    near = written(graph.feature_graph(points, 15), "graph")
    return communities.partition_faults(near, written(communities.leiden(near, points), "labels"))


@query()
def leiden_labels(spark, sf_dir):
    near = written(graph.feature_graph(_points(spark, sf_dir), 15), "graph")
    return communities.leiden(near, _points(spark, sf_dir))


def _embedded(spark, sf_dir):
    """A field of cells with the embeddings as features, as dense as that of the parts at every size."""
    tile = F.floor(F.col("vec_id") / 2000.0).cast("int")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("features"), (F.col("vec_id") % 11 == 0).alias("clipped"),
        ((F.col("vec_id") * 37 % 1009).cast("double") / 10 + 110 * (tile % 4)).alias("cx"), ((F.col("vec_id") * 91 % 997).cast("double") / 10 + 110 * F.floor(tile / 4.0).cast("int")).alias("cy"),
    )
    return written(e.withColumn("poly", source.hexagon(F.col("cx"), F.col("cy"), F.lit(3.5))), "cells")


@query("SELECT count(*) AS cells, 0 AS unlabelled, 0 AS gaps FROM embeddings")
def community_strategy(spark, sf_dir):
    """The whole strategy at its defaults, to ten types: every cell has a label, and labels are consecutive."""
    labels = communities.CommunityStrategy(10, radius=RADIUS).fit(_embedded(spark, sf_dir)).labels
    return labels.agg(F.count("*").alias("cells"), F.count_if(F.col("label").isNull() | (F.col("label") < 0)).alias("unlabelled"), (F.max("label") + 1 - F.count_distinct("label")).alias("gaps"))


_LEAF = "SELECT median(c) AS m FROM (SELECT list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE))) / 2 AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


@query(f"SELECT count(*) AS cells, 10 AS clusters, round((SELECT m FROM ({_LEAF})), 6) AS median_leaf_cost FROM embeddings")
def ward_strategy(spark, sf_dir):
    """Ward clusters with the penalty of near cells, and the median cost of joining two cells, which is its unit."""
    got = ward.WardStrategy(10, radius=RADIUS).fit(_embedded(spark, sf_dir))
    return got.labels.agg(F.count("*").alias("cells"), F.count_distinct("label").alias("clusters"), F.lit(round(got.model["median_leaf_cost"], 6)).alias("median_leaf_cost"))


@query(f"""WITH {CELLS}, d AS (SELECT a.cell_id, b.cell_id AS nn, sqrt({_D2}) AS d FROM cells a JOIN cells b ON a.label = b.label AND a.cell_id <> b.cell_id
    AND a.cx - b.cx BETWEEN -40 AND 40 AND a.cy - b.cy BETWEEN -40 AND 40),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, nn) AS k FROM d) SELECT cell_id, k::INT AS rank, round(d, 6) AS d FROM r WHERE k <= 3""")
def nearest_fellows(spark, sf_dir):
    """The three nearest cells of the same label."""
    return pairs.nearest_fellows(_cells(spark, sf_dir), 3, "label").select("cell_id", "rank", F.round("d", 6).alias("d"))


@query("""WITH c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS p, dense_rank() OVER (ORDER BY label) - 1 AS leaf, count(*) OVER () AS k FROM embeddings GROUP BY label),
f AS (SELECT * FROM c WHERE p = 0), a AS (SELECT c.*, abs(f.n - c.n) + 1.0 AS d, f.leaf AS f0 FROM c, f WHERE c.p BETWEEN 1 AND 4),
t AS (SELECT max(d) * 1.5 AS far, count(*) AS m, any_value(k) AS k FROM a),
z AS (SELECT c.leaf, row_number() OVER (ORDER BY c.leaf) AS i FROM c WHERE c.p > 4)
SELECT (p - 1)::INT AS step, (CASE WHEN p = 1 THEN f0 ELSE k + p - 2 END)::INT AS "left", leaf::INT AS "right", d::DOUBLE AS distance, (p + 1)::INT AS size, FALSE AS padded FROM a
UNION ALL SELECT (t.m + i - 2)::INT, (CASE WHEN i = 2 THEN (SELECT leaf FROM z WHERE i = 1) ELSE t.k + t.m + i - 3 END)::INT, z.leaf::INT, round(t.far * pow(1.01, i - 2), 9), i::INT, TRUE FROM z, t WHERE i > 1
UNION ALL SELECT (t.k - 2)::INT, (2 * t.k - 3)::INT, (t.k + t.m - 1)::INT, round(t.far * pow(1.01, t.k - t.m - 2), 9), t.k::INT, TRUE FROM t""")
def merge_dendrogram(spark, sf_dir):
    """The linkage table of merging the four next largest classes of embeddings into the largest one."""
    sizes = _points(spark, sf_dir).groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").collect()  # a row for each class
    merges = [(sizes[0]["y"], r["y"], abs(sizes[0]["n"] - r["n"]) + 1.0) for r in sizes[1:5]]
    return merging.dendrogram(spark, [r["y"] for r in sizes], merges).withColumn("distance", F.round("distance", 9))
